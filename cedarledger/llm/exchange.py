"""Packed exchange between executors.

Word-level shuffles move one row per (document, word); here a map task sends one row per (batch of documents, bucket)
that carries arrays. Receivers stream the rows of a bucket, so their memory is bounded by what the bucket's dictionary
holds, never by how many documents share a key: a batch sends each of its distinct words once, however often it occurs.
"""

from __future__ import annotations

import gc
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

_CODES = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest unsigned type that holds them, after a byte with its width."""
    most = int(values.max()) if len(values) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + np.ascontiguousarray(values, dtype=_CODES[width]).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=_CODES[blob[0]], offset=1)


class Numbers(dict):
    """Numbers of words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i


def in_order(x: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative integers, sixteen bits at a time: those are sorted by radix."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    if len(x) and (high := x >> 16).any():
        order = order[np.argsort(high[order].astype(np.uint16), kind="stable")]
    return order


def thinned(docs: np.ndarray, *sums: np.ndarray) -> tuple[bytes | None, list[np.ndarray]]:
    """Sums by document for a row: of the documents met alone, with their packed numbers, where those are few."""
    met = np.flatnonzero(np.bincount(docs))
    return (pack(met), [x[met] for x in sums]) if 3 * len(met) < len(sums[0]) else (None, list(sums))


def added(total: np.ndarray, of: bytes | None, x: np.ndarray) -> np.ndarray:
    """total, which grows as needed, plus sums from thinned()."""
    at = None if of is None else unpack(of).astype(np.int64)
    size = len(x) if at is None else int(at[-1]) + 1 if len(at) else 0
    if size > len(total):
        total = np.concatenate([total, np.zeros(max(size, 2 * len(total)) - len(total), total.dtype)])
    if at is None:
        total[: len(x)] += x
    else:
        total[at] += x
    return total


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle as the session sets them; a cluster sizes this to its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_bucket(df: DataFrame) -> DataFrame:
    """Deal rows out by bucket: each of as many buckets as there are partitions has a task of its own."""
    return df.repartitionById(partitions(df.sparkSession), "bucket")


def together(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by key, so that each task streams the rows of a key one after another."""
    return df.repartition(partitions(df.sparkSession), key).sortWithinPartitions(key)


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """df with a key that the planner takes for a new one. What was aggregated by a key is dealt out by it already, and a join
    with it can't be split where the key is hot on the other side; dealt out once more, both sides come straight from a
    shuffle, and adaptive execution splits the hot one."""
    return df.select(F.explode(F.array(key)).alias(key), *(c for c in df.columns if c != key))


def next_row_ids():
    """Ids for the batches of this task that are the same when the task runs again: partition, then number."""
    from pyspark import TaskContext

    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 32
    n = 0
    while True:
        yield base + n
        n += 1


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that an operator reads, null text as empty; other columns and their names don't matter."""
    return docs.select(
        *(F.coalesce(F.col("text"), F.lit("")).alias("text") if c == "text" else F.col(c) for c in columns)
    )


def text_key():
    """Tells apart rows that share a doc_id but not their text."""
    return F.xxhash64(F.col("text"))


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors and the driver see: the one that the session names in spark.checkpoint.dir."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            # one process: a folder that goes with it
            import atexit
            import shutil
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoints")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder.

    A checkpoint keeps the size that the planner guessed for it. Guesses multiply at every join, so through rounds of stored
    steps they would become numbers of millions of digits; a frame made anew from the checkpoint's rows has no guess.
    """
    spark = df.sparkSession
    shared_folder(spark)
    kept = df.checkpoint()._jdf
    return DataFrame(
        spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark
    )


def shuffles_freed(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are stored by now: Spark deletes them once the driver collects its garbage, and
    a driver with little to do may not for long. What Python lets go of py4j tells the JVM within a second, not at once."""
    gc.collect()
    time.sleep(1.2)
    spark._jvm.System.gc()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store its path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
