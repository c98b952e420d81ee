"""Line deduplication over range-partitioned line hashes.

Each document sends, for every distinct line key that is long enough, a 128-bit hash with its doc_id and the key's line
numbers. The rows are range-partitioned by (hash, doc_id descending, text) and sorted, so one streaming pass meets the
largest doc_id of a key first and knows, once a third document appears, that all others lose their lines. A key whose rows
reach a border of a partition may go on in the next one; its rows are left open and settled by an aggregate over the open
keys, so a key held by a third of all documents is spread over many tasks. What comes back is one compressed bitmap of kept
lines per document that loses any; texts are never sorted.

Null and empty texts are one empty line. Keys are compared by a 128-bit hash. Rows that share a doc_id are one document when
documents are counted; equal rows share their bitmap. A null doc_id counts as smaller than any other. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .exchange import documents, pack, partitions, stored, text_key, unpack

MIN_CHARS = 20
MIN_DOCS = 3
STRIPPED = "\t\n\x0b\x0c\r "
LOWEST = -(1 << 63)
LINES = "hi long, lo long, doc long, text_key long, n_lines int, at binary"
NAMES = ["hi", "lo", "doc", "text_key", "n_lines", "at"]
DROPPED, OPEN, MANY = 0, 1, 2


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keys(text: str, min_chars: int = MIN_CHARS) -> tuple[int, dict[bytes, list[int]]]:
    """Number of lines, and line numbers by key."""
    lines = text.split("\n")
    out: dict[bytes, list[int]] = {}
    for i, line in enumerate(lines):
        if len(line) >= min_chars and len(line := line.strip(STRIPPED)) >= min_chars:
            out.setdefault(line.encode("utf-8").lower(), []).append(i)  # of bytes, lower() changes A-Z only
    return len(lines), out


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                n, found = keys(text.as_py(), min_chars)
                for line, at in found.items():
                    h = xxhash.xxh3_128_intdigest(line)
                    rows.append((_long(h >> 64), _long(h & (1 << 64) - 1), doc, key, n, pack(np.array(at))))
            types = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], NAMES
            )

    own = documents(docs, "doc_id", "text")
    return own.select(
        F.coalesce("doc_id", F.lit(LOWEST)).alias("doc"), text_key().alias("text_key"), "text"
    ).mapInArrow(run, LINES)


def stream(batches, min_docs: int = MIN_DOCS):
    """Rows of a range partition in order of (hash, doc descending): each with what is decided about it, or nothing if
    its lines stay.
    """
    run = doc = None  # key of the current run, its latest document
    best = n_docs = 0  # the run's largest doc_id, documents so far
    held: list[tuple] = []  # the run's rows while fewer than min_docs documents have been met, but those of its first
    first, first_rows = True, []  # whether it is the partition's first run

    def closed(last: bool):
        """Rows to emit at the end of a run."""
        if not last:
            return []
        if n_docs >= min_docs:
            return [(*run, best, 0, 0, b"", MANY)]
        return [(*r, OPEN) for r in first_rows + held]

    for batch in batches:
        columns = [batch.column(i) for i in range(6)]
        hi, lo, docs = (c.to_numpy() for c in columns[:3])
        n = len(hi)
        out: list[tuple] = []
        rows = None
        i = 0
        new = np.flatnonzero((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])) + 1
        ends = [*new.tolist(), n]
        for end in ends if n else []:
            key = (int(hi[i]), int(lo[i]))
            if key != run:
                if run is not None and not first:
                    out += closed(False)
                first = run is None
                run, doc, best, n_docs, held, first_rows = key, None, int(docs[i]), 0, [], []
            elif end - i == 0:
                continue
            if end < n and not first and n_docs == 0 and end - i < min_docs:  # a whole run of too few rows
                i = end
                continue
            if rows is None:
                rows = list(zip(*(c.to_pylist() for c in columns)))
            for r in rows[i:end]:
                if first:
                    out.append((*r, OPEN))
                    continue
                if r[2] != doc:
                    doc = r[2]
                    n_docs += 1
                    if n_docs == min_docs:
                        out += [(*x, DROPPED) for x in held]
                        held = []
                if doc == best:
                    first_rows.append(r)
                elif n_docs >= min_docs:
                    out.append((*r, DROPPED))
                else:
                    held.append(r)
            i = end
        yield _decided(out)
    if run is not None and not first:
        yield _decided(closed(True))


def _decided(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.int32(), pa.binary(), pa.int32()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], [*NAMES, "verdict"]
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Of each document that loses lines: doc (doc_id), text_key, n_dropped, keep (zlib of one bit a line, 1: stays)."""
    lines = hashed_lines(docs, min_chars)
    # the text's key and the first line number make the order total, so that rows of one hash and doc can part as well
    ordered = lines.repartitionByRange(
        partitions(docs.sparkSession), "hi", "lo", F.desc("doc"), "text_key", F.xxhash64("at")
    ).sortWithinPartitions("hi", "lo", F.desc("doc"), "text_key")
    seen = stored(ordered.mapInArrow(lambda b: stream(b, min_docs), LINES + ", verdict int"))
    open_ = seen.filter(F.col("verdict") == OPEN)
    each = open_.groupBy("hi", "lo", "doc").agg(F.lit(1).alias("n")).unionByName(
        seen.filter(F.col("verdict") == MANY).select("hi", "lo", "doc", F.lit(min_docs).alias("n"))
    )
    settled = each.groupBy("hi", "lo").agg(
        F.sum("n").alias("n"), F.max("doc").alias("best")
    ).filter(F.col("n") >= min_docs)
    # a range partition leaves open its first and its last key only, so there are at most two settled keys a partition
    lost = seen.filter(F.col("verdict") == DROPPED).select("doc", "text_key", "n_lines", "at").unionByName(
        open_.join(F.broadcast(settled), ["hi", "lo"]).filter(F.col("doc") != F.col("best")).select("doc", "text_key", "n_lines", "at")
    )

    def bitmaps(batches):
        for batch in batches:
            keep, n_dropped = [], []
            for n, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                bits = np.ones(n, np.uint8)
                for p in parts:
                    bits[unpack(p).astype(np.int64)] = 0
                keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
                n_dropped.append(int(n - bits.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_dropped, pa.int64()), pa.array(keep, pa.binary())],
                ["doc", "text_key", "n_dropped", "keep"]
            )

    return lost.groupBy("doc", "text_key", "n_lines").agg(F.collect_list("at").alias("at")).select("doc", "text_key", "n_lines", "at").mapInArrow(
        bitmaps, "doc long, text_key long, n_dropped long, keep binary"
    )


def apply(docs: DataFrame, bitmaps: DataFrame, *carry: str) -> DataFrame:
    """doc_id, the columns to carry, n_lines, n_dropped, kept (the text without dropped lines)."""
    keyed = docs.select("doc_id", *carry, F.coalesce("text", F.lit("")).alias("_text"))
    keyed = keyed.withColumn("_doc", F.coalesce("doc_id", F.lit(LOWEST))).withColumn("_key", F.xxhash64("_text"))
    b = bitmaps.select(
        F.col("doc").alias("_doc"), F.col("text_key").alias("_key"), "n_dropped", F.col("keep").alias("_keep")
    )
    met = keyed.join(b.hint("shuffle_hash"), ["_doc", "_key"], "left")
    kinds = [f.dataType.simpleString() for f in docs.select("doc_id", *carry).schema]

    def run(batches):
        for batch in batches:
            n = batch.num_columns
            n_lines, kept = [], []
            for text, keep in zip(batch.column(n - 2), batch.column(n - 1).to_pylist()):
                text = text.as_py()
                if keep is None:
                    n_lines.append(text.count("\n") + 1)
                    kept.append(text)
                else:
                    lines = text.split("\n")
                    n_lines.append(len(lines))
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
                    kept.append("\n".join([line for line, bit in zip(lines, bits) if bit]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: n - 2], pa.array(n_lines, pa.int64()), pa.array(kept, pa.string())],
                [*["c%d" % i for i in range(n - 2)], "n_lines", "kept"]
            )

    names = ["doc_id", *carry]
    held = met.select(
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)],
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias(f"c{len(names)}"), "_text", "_keep"
    )
    out = held.mapInArrow(
        run, ", ".join(f"c{i} {k}" for i, k in enumerate([*kinds, "bigint"])) + ", n_lines long, kept string"
    )
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "n_lines", F.col(f"c{len(names)}").alias("n_dropped"),
        "kept"
    )


def digests(applied: DataFrame) -> DataFrame:
    return applied.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def deduplicated(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with all their columns, text without its dropped lines, n_chars (if there is one) the new length. A
    text that loses nothing stays as it is.
    """
    rest = docs.withColumn(
        "_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    ).select("doc_id", "text", "_row")
    out = apply(rest, bitmaps, "_row", "text")
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))
    columns = []
    for c in docs.columns:
        new = text if c == "text" else F.when(
            F.col("n_dropped") > 0, F.length("kept").cast(docs.schema[c].dataType)
        ).otherwise(F.col("_row")[c]) if c == "n_chars" else F.col("_row")[c]
        columns.append(new.alias(c))
    return out.select(*columns)
