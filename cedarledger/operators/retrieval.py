"""Chunking of text and exact nearest neighbours by inner product."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import chunk_id, collapse, scrub
from . import store

TARGET, OVERLAP = 800, 100


def chunk(
    sections: DataFrame, key: str = "accession_number", target: int = TARGET, overlap: int = OVERLAP
) -> DataFrame:
    """Chunks of at most target words, overlapping, never across sections.

    sections: key, pos, heading, text. Offsets count characters of the sections' collapsed texts joined by one space each.
    """
    step = max(target - overlap, 1)
    s = sections.select(key, "pos", "heading", collapse(F.col("text")).alias("text")).filter(F.col("text") != "")
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn(
        "base", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    ).withColumn("words", F.split("text", " "))
    n = F.size("words")
    last = F.when(n > target, F.ceil((n - target) / step).cast("int") * step).otherwise(F.lit(0))
    words = lambda at, size: F.array_join(F.slice("words", at + 1, F.lit(size)), " ")
    pieces = F.transform(
        F.sequence(F.lit(0), last, F.lit(step)),
        lambda at: F.struct(
            at.alias("at"), words(at, target).alias("text"), (F.length(words(at, step)) + 1).alias("step_length"),
            F.least(F.lit(target), F.size("words") - at).alias("token_count")
        )
    )
    each = s.select(key, "pos", "heading", "base", F.explode(pieces).alias("c")).select(key, "pos", "heading", "base", "c.*")
    # base tells sections apart; the shuffle by key serves both sums
    lead = F.sum("step_length").over(
        Window.partitionBy(key, "pos", "base").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    )
    each = each.withColumn("start_offset", (F.col("base") + F.coalesce(lead, F.lit(0))).cast("long"))
    each = each.withColumn("end_offset", F.col("start_offset") + F.length("text"))
    return each.select(
        chunk_id(F.col(key).cast("string"), F.col("start_offset"), F.col("end_offset")).alias("chunk_id"), key,
        F.col("heading").alias("section_heading"), "text", "start_offset", "end_offset", "token_count"
    )


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """A deterministic unit vector of word counts by hash: stands in where no embedding model is at hand."""
    at = F.transform(
        F.filter(F.split(F.lower(collapse(text)), " "), lambda w: w != ""),
        lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int")
    )
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(at, lambda x: x == d)).cast("double")
    )
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)).cast("float"))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def top_k(
    vectors: DataFrame, query: list[float], k: int = 5, key: str = "chunk_id", vector: str = "embedding"
) -> DataFrame:
    """The k vectors nearest to one query, ties by key: a scan that keeps k rows a task."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select("*", inner_product(F.col(vector), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


QUERY_BLOCK, VECTOR_BLOCK = 1024, 8192  # vectors in a block
DIGITS = 9  # of a score when neighbours are put in order: sums of products differ in the last bits


def _blocks(df: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """Rows of so many keys and their vectors, one after another, as doubles."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        keys, rows = [], []

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([keys]), pa.array([np.array(rows, np.float64).tobytes()], pa.binary())],
                [f"{name}_keys", f"{name}_rows"]
            )

        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(k)
                rows.append(v)
                if len(keys) == size:
                    yield row()
                    keys, rows = [], []
        if keys:
            yield row()

    return df.filter(F.col(vector).isNotNull()).select(key, vector).mapInArrow(
        run, f"{name}_keys array<{kind}>, {name}_rows binary"
    )


def neighbours(
    queries: DataFrame, vectors: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query, key, score, rank of the k vectors nearest to each query by inner product, exactly; ties (at nine digits) by key.

    Both sides meet in blocks: a pair of blocks is one matrix product, which keeps k rows a query, so what is shuffled grows
    with the number of blocks. Vectors without a value are nobody's neighbour; without queries there are no rows.
    """
    kind = vectors.schema[key].dataType.simpleString()

    def best(batches):
        for batch in batches:
            out = [[], [], []]
            for q_keys, q_rows, keys, rows in zip(*(c.to_pylist() for c in batch.columns)):
                q, v, names = np.frombuffer(q_rows).reshape(len(q_keys), -1), np.frombuffer(rows).reshape(len(keys), -1), np.array(keys)
                for name, s in zip(q_keys, np.round(q @ v.T, DIGITS)):
                    least = np.partition(s, -k)[-k] if k < len(s) else -np.inf
                    at = np.flatnonzero(s >= least)
                    at = at[np.lexsort((names[at], -s[at]))][:k]
                    out[0] += [name] * len(at)
                    out[1] += names[at].tolist()
                    out[2] += s[at].tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out[0], batch.schema.field(0).type.value_type),
                    pa.array(out[1], batch.schema.field(2).type.value_type), pa.array(out[2], pa.float64())
                ],
                ["query", key, "score"]
            )

    pairs = _blocks(queries, key, vector, QUERY_BLOCK, "q").crossJoin(_blocks(vectors, key, vector, VECTOR_BLOCK, "v"))
    found = pairs.mapInArrow(best, f"query {queries.schema[key].dataType.simpleString()}, {key} {kind}, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    vectors: DataFrame, text: str, k: int = 3, embed: Callable[[Column], Column] = hashed_embedding
) -> DataFrame:
    q = vectors.sparkSession.range(1).select(embed(F.lit(text)).alias("e")).first()["e"]
    return top_k(vectors, list(q), k).withColumn("text", scrub(F.col("text")))


def upsert(index: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """New vectors replace those with their key."""
    return index.join(new.select(key), key, "left_anti").unionByName(new)


def delete(index: DataFrame, accession_number: str) -> DataFrame:
    return index.filter(~F.col("accession_number").eqNullSafe(F.lit(accession_number)))


def delete_saved(spark: SparkSession, path: str, accession_number: str) -> int:
    """Delete a filing's vectors from the index at path; gives their number."""
    index = load(spark, path)
    n = index.filter(F.col("accession_number") == accession_number).count()
    if n:
        save(delete(index, accession_number), path)
    return n


def save(index: DataFrame, path: str) -> None:
    """The index may have been read from path."""
    store.replace(index, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
