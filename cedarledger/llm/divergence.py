"""Source divergence audit: how far the terms of each source lie from those of the others of its language.

Map tasks count terms by (lang, source) and send them in packed blocks to shards by a hash of (lang, term). A shard holds all
counts of its terms, so DuckDB can sum them, keep the terms of enough documents, and, once the totals of all groups are
known, compute probabilities, partial sums of differences for pairs of sources, and the shard's own leading terms. Spark
adds up the partial sums and ranks. A frequent term is one row a block, source and shard, whatever share of the text it has.

Probabilities are integers: p = 1 + floor(SCALE * (count + SMOOTHING) / (N + SMOOTHING * V)). A pair's sum over all V terms is
V * |p0 - q0|, p0 and q0 being the probabilities of a term that is missing, plus corrections for the terms that occur in the
one source, in the other, or in both; so no term is listed for sources that lack it.

Null text, lang and source count as empty. Each row is a document of its own, also where rows repeat or share a doc_id. Texts
without terms still make their (lang, source) occur. Ties rank by the bytes of the item. A language that keeps no term has its
pairs with value 0. Extra columns are ignored; an empty table gives no rows. The result has a row for each ordered pair of
sources of a language: that is what is asked for, so it grows with the square of the sources, never with that of rows.
"""

from __future__ import annotations

import re
import shutil
import tempfile
from collections import Counter
from contextlib import contextmanager
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .exchange import by_bucket, partitions, stored

MIN_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
TERM = re.compile(rb"[a-z\x80-\xff]+")  # of lower-cased UTF-8: letters A-Z and all that isn't ASCII
HELD_TERMS = 400_000  # counts a map task holds before it sends them
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("d", pa.int64())])
PARTS = "lang string, source string, part string, item string, value long"


def blocks(groups: dict, shards: int):
    """Counts as (shard, block) rows, a block being an Arrow stream."""
    langs, sources, terms, n, d, shard = [], [], [], [], [], []
    for (lang, source), (words, docs) in groups.items():
        seed = crc32(lang.encode())
        for term, count in words.items():
            terms.append(term)
            n.append(count)
            d.append(docs[term])
            shard.append(crc32(term, seed) % shards)
        langs += [lang] * len(words)
        sources += [source] * len(words)
    at = np.array(shard, np.int64)
    order = np.argsort(at, kind="stable")
    table = pa.table([langs, sources, terms, n, d], schema=COUNTS).take(pa.array(order))
    met, begins = np.unique(at[order], return_index=True)
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for s, begin, end in zip(met.tolist(), begins.tolist(), [*begins[1:].tolist(), len(at)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, COUNTS, options=options) as writer:
            writer.write_table(table.slice(begin, end - begin))
        yield s, sink.getvalue().to_pybytes()


def counted(docs: DataFrame, shards: int) -> DataFrame:
    """bucket (shard), block"""

    def run(batches):
        groups, held = {}, 0

        def flush():
            for s, block in blocks(groups, shards):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([block], pa.binary())], ["bucket", "block"]
                )
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = TERM.findall(text.as_buffer().to_pybytes().lower())  # of bytes, lower() changes A-Z only
                words, seen = groups.setdefault((lang, source), (Counter(), Counter()))
                held -= len(words)
                words.update(found)
                seen.update(set(found))
                held += len(words)
                if held > HELD_TERMS:
                    yield from flush()
                    held = 0
        if groups:
            yield from flush()

    return docs.select("lang", "source", "text").mapInArrow(run, "bucket int, block binary")


@contextmanager
def database():
    """A DuckDB of this task, with a bound on its memory; beyond it DuckDB uses the task's own temporary folder."""
    import duckdb

    folder = tempfile.mkdtemp()
    db = duckdb.connect(config={"threads": 1, "memory_limit": "384MB", "temp_directory": folder})
    try:
        yield db
    finally:
        db.close()
        shutil.rmtree(folder, ignore_errors=True)


_KEPT = """WITH s AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(d)::BIGINT AS d FROM counts GROUP BY ALL)
SELECT lang, source, decode(term) AS term, n, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::INTEGER AS first FROM s
QUALIFY sum(d) OVER (PARTITION BY lang, term) >= {min_docs}"""


def kept_terms(blocks_: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """bucket, lang, source, term, n of terms of enough documents of their lang; first is 1 in one row of a term."""

    def run(batches):
        with database() as db:
            db.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term BLOB, n BIGINT, d BIGINT)")
            bucket = None
            for batch in batches:
                for b, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                    bucket, part = b, pa.ipc.open_stream(block.as_buffer()).read_all()  # noqa: F841
                    db.execute("INSERT INTO counts SELECT * FROM part")
            if bucket is not None:
                for out in db.sql(_KEPT.format(min_docs=min_docs)).to_arrow_reader(50_000):
                    yield out

    return by_bucket(blocks_).mapInArrow(run, "lang string, source string, term string, n long, first int")


_GROUPS = """CREATE TABLE g AS SELECT row_number() OVER (ORDER BY lang, source) AS g, lang, source, v, n + {k} * v AS w, nl + {k} * v AS wl,
CASE WHEN v > 0 THEN (1 + {scale}::HUGEINT * {k} // (n + {k} * v))::BIGINT ELSE 0 END AS p0 FROM totals"""
_CELLS = """CREATE TABLE c AS SELECT g, lang, source, term, p0, (1 + {scale}::HUGEINT * (cells.n + {k}) // w)::BIGINT AS p,
(1 + {scale}::HUGEINT * ((sum(cells.n) OVER (PARTITION BY lang, term))::HUGEINT + {k}) // wl)::BIGINT AS q FROM cells JOIN g USING (lang, source)"""
_PAIRS = """WITH own AS (SELECT g, p, count(*) AS m FROM c GROUP BY ALL),
one AS (SELECT a.g AS a, b.g AS b, sum(m * (abs(p - b.p0) - abs(a.p0 - b.p0))) AS value FROM own JOIN g a USING (g) JOIN g b ON b.lang = a.lang AND b.g <> a.g GROUP BY ALL),
two AS (SELECT x.g AS a, y.g AS b, sum(abs(x.p - y.p) - abs(x.p - y.p0) - abs(x.p0 - y.p) + abs(x.p0 - y.p0)) AS value FROM c x JOIN c y ON y.lang = x.lang AND y.term = x.term AND x.g < y.g GROUP BY ALL),
every AS (SELECT least(a, b) AS a, greatest(a, b) AS b, value FROM one UNION ALL FROM two
UNION ALL SELECT a.g, b.g, a.v::HUGEINT * abs(a.p0 - b.p0) FROM g a JOIN g b ON b.lang = a.lang AND a.g < b.g WHERE {base})
SELECT x.lang, x.source, 'pair' AS part, y.source AS item, sum(value)::BIGINT AS value FROM every JOIN g x ON x.g = a JOIN g y ON y.g = b GROUP BY ALL"""
_TERMS = """SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM c WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {top}"""


def shard_parts(rows: DataFrame, top: int, smoothing: int, scale: int) -> DataFrame:
    """Partial sums of pairs (each pair once) and leading terms of each shard."""

    def run(batches):
        with database() as db:
            db.execute("CREATE TABLE totals (lang VARCHAR, source VARCHAR, n BIGINT, v BIGINT, nl BIGINT)")
            db.execute("CREATE TABLE cells (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT)")
            buckets = set()
            for batch in batches:
                buckets.update(batch.column(0).to_pylist())
                part = pa.Table.from_batches([batch])  # noqa: F841
                db.execute("INSERT INTO totals SELECT DISTINCT lang, source, n, v, nl FROM part WHERE term IS NULL")
                db.execute("INSERT INTO cells SELECT lang, source, term, n FROM part WHERE term IS NOT NULL")
            if not buckets:
                return
            db.execute("CREATE OR REPLACE TABLE totals AS SELECT DISTINCT * FROM totals")
            values = {"k": smoothing, "scale": scale, "top": top, "base": "true" if 0 in buckets else "false"}
            for sql in (_GROUPS, _CELLS):
                db.execute(sql.format(**values))
            for sql in (_PAIRS, _TERMS):
                for out in db.sql(sql.format(**values)).to_arrow_reader(50_000):
                    yield out

    return by_bucket(rows).mapInArrow(run, PARTS)


def audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, smoothing: int = SMOOTHING, scale: int = SCALE
) -> DataFrame:
    """lang, source, part, item, value, rank; see the module."""
    empty = F.lit("")
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")))
    shards = partitions(docs.sparkSession)
    kept = stored(kept_terms(counted(own, shards), min_docs))
    per_lang = kept.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("n").alias("nl"))
    totals = own.select("lang", "source").distinct().join(
        kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left"
    ).join(per_lang, "lang", "left").fillna(0, ["n", "v", "nl"])
    none = F.lit(None)
    rows = kept.select(
        F.pmod(F.crc32(F.encode(F.concat("lang", "term"), "UTF-8")), F.lit(shards)).cast("int").alias("bucket"), "lang", "source", "term", "n",
        none.cast("long").alias("v"), none.cast("long").alias("nl")
    ).unionByName(
        totals.select(  # to every shard
            F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("bucket"), "lang", "source",
            none.cast("string").alias("term"), "n", "v", "nl"
        )
    )
    parts = stored(shard_parts(rows, top, smoothing, scale))
    pairs = parts.filter(F.col("part") == "pair").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    a, b = F.col("source"), F.col("item")
    both = pairs.select(
        "lang", F.explode(F.array(F.struct(a.alias("source"), b.alias("item")), F.struct(b.alias("source"), a.alias("item")))).alias("x"),
        "value"
    ).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = parts.filter(F.col("part") == "term").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    return both.withColumn("rank", F.row_number().over(by)).unionByName(terms)
