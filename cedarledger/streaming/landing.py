"""Filings as a stream: documents that land in a folder go through the batch plan, each batch a run that is committed as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans import ingest
from ..schemas import SOURCE

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_documents(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").load(path)
    part = lambda i: F.element_at(F.split("path", "/"), i)
    source = F.struct(
        F.lit("landing").alias("source_name"), F.col("path").alias("source_url"),
        F.col("modificationTime").alias("retrieved_at"), F.sha2("content", 256).alias("checksum"),
        part(-2).alias("record_id"), F.lit(None).cast("string").alias("field_path")
    )
    return raw.select(
        part(-3).alias("cik"), part(-2).alias("accession_number"), F.decode("content", "UTF-8").alias("value"),
        source.cast(SOURCE).alias("source")
    )


def run(spark: SparkSession, landing: str, tables: str, checkpoint: str) -> None:
    """Take in what has landed since the last call: loans, issues, reporting periods and outcomes of each filing change together.

    A batch that runs twice is a run of its own each time, with the same rows. A re-filing is a new file in its filing's folder.
    """

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ingest.take_assets(batch, tables)

    query = stream_documents(spark, landing).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
