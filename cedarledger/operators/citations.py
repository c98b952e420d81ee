"""Citations of evidence: ordered and without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def distinct_sources(sources: DataFrame, group: str, order: str, per_field: bool = True) -> DataFrame:
    """Of each group's sources the first with a url (and field path, if per_field), in order."""
    keys = [group, "source_url", *(["field_path"] if per_field else [])]
    first = sources.withColumn(
        "_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    ).filter("_n = 1").drop("_n")
    return first.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(order)))


def evidence_sources(evidence: DataFrame, entries: DataFrame, loans: DataFrame, group: str) -> DataFrame:
    """Of each piece of evidence (a value of group) the sources behind it, in order: of the loans that its entries name, one a field path; where it has no entry, of all its loans, one a filing, since that nothing was found is a claim too.

    evidence: group. entries: group, asset_number. loans: group, asset_number, source, seq (their order).
    """
    known = loans.join(evidence.select(group), group, "left_semi")
    named = known.join(entries.select(group, "asset_number").distinct(), [group, "asset_number"], "left_semi")
    every = known.join(entries.select(group).distinct(), group, "left_anti")
    path = F.col("source.field_path")
    both = named.select(group, "seq", "source.source_url", path.alias("field_path")).unionByName(
        every.select(group, "seq", "source.source_url", F.lit(None).cast("string").alias("field_path"))
    )
    first = both.groupBy(group, "source_url", "field_path").agg(F.min("seq").alias("seq"))
    return first.withColumn(
        "position", F.row_number().over(Window.partitionBy(group).orderBy("seq", "source_url", "field_path"))
    )
