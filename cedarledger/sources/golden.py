"""Golden questions: id, question, expected_tools, expected_facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "id string, question string, expected_tools array<string>, expected_facts array<string>"


def golden(spark: SparkSession, path: str) -> DataFrame:
    """From JSON lines, or from YAML where a YAML reader is installed."""
    if path.endswith((".yaml", ".yml")):
        import yaml

        text = spark.read.text(path, wholetext=True).first()[0]
        return spark.createDataFrame(
            [
                (
                    str(c["id"]), c["question"], c.get("expected_tools") or [],
                    [str(f) for f in c.get("expected_facts") or []]
                ) for c in yaml.safe_load(text)
            ],
            SCHEMA
        )
    return spark.read.schema(SCHEMA).json(path)
