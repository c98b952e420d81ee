"""Monthly certificate reports: distributions, reconciliation of bonds and collateral, and unreadable values.

Works on the grid of html_rows. Two issuers' layouts are known: one table with an identifier column, and a summary table
whose identifiers stand in a second table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import clean_class, clean_cusip, report_decimal, report_issue
from ..operators.matching import contained

# Titles and labels in the reports, and the columns of each layout.
DETAIL, BALANCES = "Certificate Distribution Detail", "Bond / Collateral Reconciliation - Balances"
SUMMARY, FACTORS = "DISTRIBUTION SUMMARY", "DISTRIBUTION SUMMARY - FACTORS"
DETAIL_COLUMNS = {
    "pass_through_rate": 2, "original_balance": 3, "beginning_balance": 4, "principal_distribution": 5, "interest_distribution": 6, "prepayment_penalties": 7,
    "realized_losses": 8, "total_distribution": 9, "ending_balance": 10, "current_credit_support": 11, "original_credit_support": 12,
}
SUMMARY_COLUMNS = {
    "pass_through_rate": 3, "original_balance": 1, "beginning_balance": 2, "principal_distribution": 8, "interest_distribution": 6, "realized_losses": 10,
    "total_distribution": 9, "ending_balance": 13,
}
PERCENT = ("pass_through_rate", "current_credit_support", "original_credit_support")
LABELS = {
    "beginning_scheduled_collateral_balance": "Beginning Scheduled Collateral Balance", "scheduled_principal_collections": "(-) Scheduled Principal Collections",
    "ending_scheduled_collateral_balance": "Ending Scheduled Collateral Balance", "beginning_actual_collateral_balance": "Beginning Actual Collateral Balance",
    "ending_actual_collateral_balance": "Ending Actual Collateral Balance", "beginning_certificate_balance": "Beginning Certificate Balance",
    "principal_distributions": "(-) Principal Distributions", "ending_certificate_balance": "Ending Certificate Balance", "under_over_collateralization": "Ending UC / (OC)",
}
CUSIP = "^[A-Z0-9]{9}$"


def _marked(grid: DataFrame, key: str) -> DataFrame:
    """Rows of the tables that a report is read from: of the first layout those with an identifier, of the second, which counts
    only in reports without any of those, the summary's rows; and the rows of the balances. One shuffle by report; the
    text of a table stays before it.
    """
    has = lambda text: F.contains(F.col("table_text"), F.lit(text))
    cell = lambda i: F.get("cells", F.lit(i))
    report = Window.partitionBy(key)
    least = lambda flag: F.min(F.when(flag, F.col("table_idx"))).over(report)
    rows = grid.filter(F.col(key).isNotNull()).select(
        key, "table_idx", "row_idx", "cells", (has(DETAIL) & has("CUSIP")).alias("detail"), has(SUMMARY).alias("summary"),
        has("Pass-Through").alias("rates"), has(FACTORS).alias("factors"), has("CUSIP").alias("ids"),
        (has(BALANCES) & has(LABELS["beginning_scheduled_collateral_balance"])).alias("balances")
    )
    n = F.size("cells")
    is_detail = (F.col("table_idx") == F.col("detail_at")) & (n >= 13) & cell(1).rlike(CUSIP)
    # a title may stand in a table of its own, before the one that it is for
    rows = rows.withColumns({
        "detail_at": least(F.col("detail")), "balances_at": least(F.col("balances")),
        "summary_at": least(F.col("summary")), "factors_at": least(F.col("factors")),
        "summary_inside": least(F.col("summary") & F.col("rates")), "factors_inside": least(F.col("factors") & F.col("ids"))
    }).withColumns({
        "first_layout": F.coalesce(F.bool_or(is_detail).over(report), F.lit(False)),
        "summary_later": least(F.col("rates") & (F.col("table_idx") > F.col("summary_at"))),
        "factors_later": least(F.col("ids") & (F.col("table_idx") > F.col("factors_at")))
    })
    of = lambda *at: F.coalesce(F.col("table_idx") == F.coalesce(*at), F.lit(False))
    alone, joined = clean_cusip(cell(1)), clean_cusip(F.concat(cell(1), F.coalesce(cell(2), F.lit(""))))
    found = F.when(alone.rlike(CUSIP), alone).when((n >= 3) & joined.rlike(CUSIP), joined)
    rows = rows.withColumns({
        "is_detail": F.coalesce(is_detail, F.lit(False)), "is_summary": of("summary_later", "summary_inside") & (n >= 14),
        "is_balance": of("balances_at"), "named": F.trim(cell(0)),
        "factor_id": F.when(of("factors_inside", "factors_later") & (n >= 2), found)
    })
    by_class = F.max_by("factor_id", F.when(F.col("factor_id").isNotNull(), F.col("row_idx"))).over(Window.partitionBy(key, "named"))
    rows = rows.withColumn("class_id", by_class)
    first = F.col("first_layout")
    return rows.select(
        key, "row_idx", "cells", "first_layout", "is_balance",
        F.when(first, clean_class(cell(0))).otherwise(F.col("named")).alias("class_name"),
        F.when(first, cell(1)).otherwise(F.col("class_id")).alias("cusip"),
        F.when(first, F.col("is_detail")).otherwise(F.col("is_summary") & F.col("class_id").isNotNull()).alias("is_class")
    ).filter("is_class OR is_balance")


def _issues(columns: dict[str, Column]) -> Column:
    each = (F.when(report_issue(raw), F.struct(F.lit(c).alias("field_name"), raw.alias("raw_value"))) for c, raw in columns.items())
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def distributions(grid: DataFrame, key: str = "accession_number") -> DataFrame:
    """One row per certificate class; the second layout is read only where the first gives nothing."""
    cell = lambda i: F.get("cells", F.lit(i)) if i is not None else F.lit(None).cast("string")
    first = F.col("first_layout")
    values = [
        report_decimal(
            F.when(first, cell(i)).otherwise(cell(SUMMARY_COLUMNS.get(c))), c in PERCENT
        ).alias(c) for c, i in DETAIL_COLUMNS.items()
    ]
    bad = F.when(first, _issues({c: cell(i) for c, i in DETAIL_COLUMNS.items()})).otherwise(
        _issues({c: cell(i) for c, i in SUMMARY_COLUMNS.items()})
    )
    return _marked(grid, key).filter("is_class").select(
        key, "row_idx", "class_name", "cusip", *values,
        F.concat(F.lit("certificate_distribution[class="), "class_name", F.lit("]")).alias("field_path"),
        bad.alias("issues")
    )


def _balances() -> dict[str, Column]:
    """Aggregates of the raw value beside each label, in either half of a row; the last in the table wins."""
    cell, n = (lambda i: F.get("cells", F.lit(i))), F.size("cells")
    out = {}
    for c, label in LABELS.items():
        right, left = (n >= 5) & (cell(3) == label), (n >= 2) & (cell(0) == label)
        place = F.when(F.col("is_balance") & (right | left), F.struct("row_idx", F.when(right, cell(4)).otherwise(cell(1)).alias("raw")))
        out[c] = F.max(place)["raw"]
    return out


def reconciliations(grid: DataFrame, key: str = "accession_number") -> DataFrame:
    """One row per report that has the table: its balances, and whether certificate less scheduled collateral balance is
    the reported difference (null if any is unknown).
    """
    raw = _marked(grid, key).filter("is_balance").groupBy(key).agg(*(v.alias(c) for c, v in _balances().items()))
    out = raw.select(
        key, *(report_decimal(F.col(c)).alias(c) for c in LABELS), _issues({c: F.col(c) for c in LABELS}).alias("issues")
    )
    return out.withColumn("reconciles", reconciles()).withColumn("field_path", F.lit("bond_collateral_reconciliation"))


def findings(grid: DataFrame, key: str = "accession_number") -> DataFrame:
    """One row per report with a table that is known: class_count, has_balances, reconciles."""
    raw = _marked(grid, key).groupBy(key).agg(
        F.count_if("is_class").alias("class_count"), F.bool_or("is_balance").alias("has_balances"),
        *(report_decimal(v).alias(c) for c, v in _balances().items())
    )
    return raw.select(key, "class_count", "has_balances", reconciles().alias("reconciles"))


def reconciles() -> Column:
    return F.col("ending_certificate_balance") - F.col("ending_scheduled_collateral_balance") == F.col("under_over_collateralization")


def strict(reconciliations_: DataFrame) -> DataFrame:
    """Fails on a report that doesn't reconcile."""
    return reconciliations_.filter(
        F.when(F.coalesce("reconciles", F.lit(True)), F.lit(True)).otherwise(
            F.raise_error(
                F.lit("certificate less scheduled collateral balance is not the reported difference")
            ).cast("boolean")
        )
    )


_SHOWN = (
    "class_name", "cusip", "beginning_balance", "principal_distribution", "interest_distribution", "ending_balance"
)


def lookup(
    questions: DataFrame, certificates: DataFrame, report: str = "accession_number", question: str = "question",
    key: str = "question_id"
) -> DataFrame:
    """Of each question about a report (a column of both) the first of its certificates whose class or identifier the
    question names. An empty class or identifier is in every question.

    Within a report, names meet only questions that have their rarest piece; no row holds a report's certificates.
    """
    first = F.min("c").alias("c")
    named = certificates.select(report, F.struct("row_idx", *_SHOWN).alias("c")).select(
        report, "c", F.explode(F.array_distinct(F.array("c.class_name", "c.cusip"))).alias("name")
    ).groupBy(report, "name").agg(first)
    asked = questions.select(report, question).filter(F.col(report).isNotNull() & F.col(question).isNotNull()).distinct()
    own = contained(asked.withColumn("_asked", F.col(question)), named, question, "_asked", "name", report)
    found = own.join(named.hint("merge"), [report, "name"]).select(report, question, "c")
    always = asked.join(named.filter("name = ''").select(report, "c"), report)
    best = found.unionByName(always).groupBy(report, question).agg(first)
    return questions.join(best.hint("merge"), [report, question], "left").select(key, report, question, *(f"c.{x}" for x in _SHOWN))


def latest_report(reports: DataFrame) -> DataFrame:
    """Of each deal the report with the latest date."""
    return reports.withColumn(
        "_n", F.row_number().over(Window.partitionBy("cik").orderBy(F.desc_nulls_last("report_date"), F.desc("seq")))
    ).filter("_n = 1").drop("_n")
