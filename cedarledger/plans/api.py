"""What a client can ask about a deal, one function for each question: each takes stored tables and gives a DataFrame.

Unknown deals raise DealNotFound, comparisons of a deal with one period raise InsufficientPeriods. Where one period is
asked for, it is the latest; pairs are the last two unless accession numbers are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import analytics as A, store
from ..sources import certificates
from .ingest import KIND, DealNotFound, both_periods, exists, latest_pair


class Surveillance:
    """Reads tables that ingest.run wrote under one folder."""

    def __init__(self, spark: SparkSession, tables: str):
        self.spark, self.tables = spark, tables

    def table(self, name: str) -> DataFrame:
        df = store.current(self.spark, self.tables, name, KIND[name]).drop("ingest_seq")
        return df.withColumn("cik", F.lpad(F.col("cik").cast("string"), 10, "0")).withColumn(
            "accession_number", F.col("accession_number").cast("string")
        )

    def _pair(self, cik: str, before: str | None = None, after: str | None = None) -> tuple[DataFrame, DataFrame]:
        loans = self.table("loans")
        if before and after:
            own = loans.filter(F.col("cik") == cik)
            return own.filter(F.col("accession_number") == before), own.filter(F.col("accession_number") == after)
        return both_periods(loans, cik)

    def _latest(self, cik: str) -> DataFrame:
        loans = self.table("loans")
        if loans.filter(F.col("cik") == cik).isEmpty():
            raise DealNotFound(cik)
        return latest_pair(loans, cik)[1]

    def deals(self) -> DataFrame:
        """cik, periods, and the name where filing lists were ingested."""
        out = self.table("loans").groupBy("cik").agg(F.count_distinct("accession_number").alias("periods"))
        if not exists(self.spark, f"{self.tables}/deals"):
            return out.withColumn("name", F.lit(None).cast("string"))
        return out.join(self.spark.read.parquet(f"{self.tables}/deals").select("cik", "name"), "cik", "left")

    def outcomes(self, cik: str, kind: str = "assets") -> DataFrame:
        """Status and reason of each filing of assets, reports or narrative."""
        return self.table(f"outcomes_{kind}").filter(F.col("cik") == cik)

    def summary(self, cik: str) -> DataFrame:
        return A.paydown(A.deal_summary(self._latest(cik)))

    def compare(self, cik: str, before: str | None = None, after: str | None = None) -> DataFrame:
        return A.compare_periods(*self._pair(cik, before, after)).orderBy("doc_position", "field_order")

    def status_changes(self, cik: str, before: str | None = None, after: str | None = None) -> DataFrame:
        return A.status_changes(*self._pair(cik, before, after)).withColumn(
            "severity", A.severity_label(F.col("severity_rank"))
        ).orderBy("rank")

    def balance_drift(self, cik: str) -> DataFrame:
        return A.balance_drift(self._latest(cik)).orderBy("rank")

    def noi_changes(self, cik: str, before: str | None = None, after: str | None = None) -> DataFrame:
        return A.noi_changes(*self._pair(cik, before, after)).orderBy("rank")

    def geography(self, cik: str) -> DataFrame:
        return A.geography(self._latest(cik)).orderBy("rank")

    def property_types(self, cik: str) -> DataFrame:
        return A.property_types(self._latest(cik)).orderBy("rank")

    def loan_history(self, cik: str, asset_number: str) -> DataFrame:
        return A.loan_history(
            self.table("loans").filter((F.col("cik") == cik) & (F.col("asset_number") == asset_number))
        ).orderBy("entry")

    def property_profile(self, cik: str, asset_number: str, property_name: str) -> DataFrame:
        return A.property_profiles(self._latest(cik), asset_number=asset_number, property_name=property_name)

    def _last_report(self, cik: str, name: str) -> DataFrame:
        """Of the report with the latest date; reports without one are in order of their accession numbers."""
        reports = self.outcomes(cik, "reports").filter("status = 'created'").withColumn("seq", F.col("accession_number"))
        last = certificates.latest_report(reports).select("accession_number")
        return self.table(name).filter(F.col("cik") == cik).join(last, "accession_number", "left_semi")

    def certificate_distributions(self, cik: str) -> DataFrame:
        return self._last_report(cik, "certificates").orderBy("row_idx")

    def reconciliation(self, cik: str) -> DataFrame:
        return self._last_report(cik, "reconciliations")
