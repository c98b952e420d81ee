"""Surveillance analytics over loan snapshots.

Every function takes and returns DataFrames and works on many deals at once: a deal is a value of the by columns. A snapshot
is a row per loan with doc_position, the loan's place in its document; where a loan appears twice in the earlier period
the later place wins, in the current period each appearance gives a row. "Changed" treats null as a value. All ranks have
explicit tie-breaks, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import ADVANCES, CURRENT, FORMULA_VERSION

BY = ("cik",)


def _version() -> Column:
    return F.lit(FORMULA_VERSION).alias("formula_version")


def _names(loans: DataFrame) -> Column:
    return F.transform(
        "properties", lambda p: p["property_name"]
    ) if "properties" in loans.columns else F.array().cast("array<string>")


def advances(raw_fields: Column) -> Column:
    return F.try_element_at(raw_fields, F.lit(ADVANCES)).try_cast("decimal(20,8)")


def _earlier(loans: DataFrame, by: tuple[str, ...], **columns: Column) -> DataFrame:
    """One row per loan: its last appearance."""
    at = loans.select(
        *by, "asset_number", "doc_position", F.struct(*(c.alias(k) for k, c in columns.items())).alias("v")
    )
    return at.groupBy(*by, "asset_number").agg(F.max_by("v", "doc_position").alias("v")).select(
        *by, "asset_number", *(F.col("v")[k].alias(k) for k in columns)
    )


def deal_summary(loans: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Loans, properties, original and actual balance, and the first loan's period end. Without by columns an empty
    input gives one row of zeros.
    """
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0).cast("decimal(20,8)"))), F.lit(0).cast("decimal(30,8)"))
    out = loans.groupBy(*by).agg(
        F.count("*").alias("loan_count"), F.coalesce(
            F.sum(F.size(F.coalesce("properties", F.array()))), F.lit(0)
        ).cast("long").alias("property_count"),
        total(F.col("original_loan_amount")).alias("total_original_loan_amount"), total(F.col("actual_balance_amount")).alias("total_actual_balance_amount"),
        F.min_by("period_ending_date", "doc_position").alias("reporting_period_ending_date"),
    )
    return out.withColumn("formula_version", F.lit(FORMULA_VERSION))


def paydown(summary: DataFrame) -> DataFrame:
    """Share of the original balance that is paid, in percent; null without an original balance."""
    o, a = F.col("total_original_loan_amount").cast("double"), F.col("total_actual_balance_amount").cast("double")
    return summary.withColumn("paydown_percentage", F.when(o > 0, (o - a) / o * 100))


def tracked_fields() -> list[tuple[str, Column]]:
    """Label and value, as text, of each compared field, in order."""
    return [
        ("paymentStatusLoanCode", F.col("payment_status_code")), (
            "reportPeriodEndActualBalanceAmount", F.col("actual_balance_amount").cast("string")
        ),
        (
            "reportPeriodEndScheduledLoanBalanceAmount", F.col("scheduled_balance_amount").cast("string")
        ), ("paidThroughDate", F.col("paid_through_date").cast("string")),
        (ADVANCES, advances(F.col("raw_fields")).cast("string")),
    ]


def compare_periods(before: DataFrame, after: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """One row per loan and tracked field whose value changed. Amounts have one scale, so equal ones are equal as text.
    """
    values = lambda: F.array(
        *(
            F.struct(
                F.lit(i).alias("field_order"), F.lit(k).alias("field_name"), v.alias("x")
            ) for i, (k, v) in enumerate(tracked_fields())
        )
    )
    a = _earlier(before, by, a=values())
    b = after.select(*by, "asset_number", "doc_position", values().alias("b"))
    pairs = b.join(a, [*by, "asset_number"]).select(
        *by, "asset_number", "doc_position", F.explode(F.arrays_zip("a", "b")).alias("p")
    )
    old, new = F.col("p")["a"]["x"], F.col("p")["b"]["x"]
    return pairs.filter(~old.eqNullSafe(new)).select(
        *by, "asset_number", "doc_position", F.col("p")["b"]["field_order"].alias("field_order"), F.col("p")["b"]["field_name"].alias("field_name"), old.alias("value_before"), new.alias("value_after"), _version()
    )


def severity(before: Column, after: Column) -> Column:
    """2: newly not current; 0: current again; 1: other changes."""
    was, is_ = before.eqNullSafe(F.lit(CURRENT)), after.eqNullSafe(F.lit(CURRENT))
    return F.when(was & ~is_, 2).when(is_, 0).otherwise(1)


SEVERITY_LABELS = {2: "newly delinquent", 1: "changed", 0: "cured"}


def severity_label(rank: Column) -> Column:
    return F.coalesce(*(F.when(rank == k, F.lit(v)) for k, v in SEVERITY_LABELS.items()))


def status_changes(before: DataFrame, after: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Loans whose payment status changed, the gravest first, then by asset number as text."""
    a = _earlier(
        before, by, status_before=F.col("payment_status_code"), period_a_ending_date=F.col("period_ending_date")
    )
    b = after.select(
        *by, "asset_number", "doc_position", F.col("payment_status_code").alias("status_after"),
        _names(after).alias("property_names"), F.col("period_ending_date").alias("period_b_ending_date")
    )
    out = b.join(a, [*by, "asset_number"]).filter(~F.col("status_before").eqNullSafe(F.col("status_after"))).withColumn(
        "severity_rank", severity(F.col("status_before"), F.col("status_after"))
    )
    order = Window.partitionBy(*by).orderBy(F.desc("severity_rank"), "asset_number", "doc_position")
    return out.select(
        *by, "asset_number", "property_names", "status_before", "status_after", "severity_rank", "period_a_ending_date",
        "period_b_ending_date", F.row_number().over(order).alias("rank"), _version()
    )


def _drifts(loans: DataFrame) -> DataFrame:
    d = loans.filter(F.col("actual_balance_amount").isNotNull() & F.col("scheduled_balance_amount").isNotNull())
    d = d.withColumn("drift_amount", F.col("actual_balance_amount") - F.col("scheduled_balance_amount"))
    return d.withColumn(
        "drift_percentage",
        F.try_divide(F.col("drift_amount").cast("double"), F.col("scheduled_balance_amount").cast("double")) * 100
    )


def balance_drift(loans: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Actual less scheduled balance, largest magnitude first; loans without one of the two are left out, zero drift
    stays.
    """
    d = _drifts(loans)
    order = Window.partitionBy(*by).orderBy(F.desc(F.abs("drift_amount")), "asset_number", "doc_position")
    return d.select(
        *by, "asset_number", _names(loans).alias("property_names"), "actual_balance_amount", "scheduled_balance_amount",
        "drift_amount", "drift_percentage", F.row_number().over(order).alias("rank"), _version()
    )


def movers(drift: DataFrame, most: int = 10) -> DataFrame:
    """The loans that drifted, the first ones by rank."""
    return drift.filter(F.col("drift_amount") != 0).orderBy("rank").limit(most)


def top_movers(loans: DataFrame, most: int = 10) -> DataFrame:
    """The loans of all deals that drifted most: each task keeps so many rows, and only those meet."""
    top = _drifts(loans).filter(F.col("drift_amount") != 0).orderBy(
        F.desc(F.abs("drift_amount")), "asset_number", "doc_position"
    ).limit(most)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("drift_amount")), "asset_number", "doc_position")
    return top.withColumn("rank", F.row_number().over(order))


def loan_history(loans: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Snapshots of each loan by period end, unknown periods first, with the balance's step from one to the next."""
    order = Window.partitionBy(*by, "asset_number").orderBy(F.asc_nulls_first("period_ending_date"), "doc_position")
    return loans.select(
        *by, "asset_number", F.row_number().over(order).alias("entry"), "period_ending_date", "payment_status_code", "actual_balance_amount", "scheduled_balance_amount",
        advances(F.col("raw_fields")).alias("advances_outstanding"), (
            F.col("actual_balance_amount") - F.lag("actual_balance_amount").over(order)
        ).alias("balance_step"), _version(),
    )


PROFILE_NOTE = "Values at securitization are as of issuance; most recent values are as the servicer last reported them."


def property_profiles(
    loans: DataFrame, by: tuple[str, ...] = BY, asset_number: str | None = None, property_name: str | None = None
) -> DataFrame:
    """Each loan's properties, of a repeated name the first; of one loan and name if they are given."""
    if asset_number is not None:
        loans = loans.filter(F.col("asset_number") == asset_number)
    each = loans.select(*by, "asset_number", "doc_position", F.posexplode("properties").alias("property_index", "p"))
    if property_name is not None:
        each = each.filter(F.col("p")["property_name"] == property_name)
    first = each.groupBy(
        *by, "asset_number", F.col("p")["property_name"].alias("property_name")
    ).agg(F.min_by("p", F.struct("doc_position", "property_index")).alias("p"))
    return first.select(
        *by, "asset_number", "property_name", F.col("p")["property_type_code"].alias("property_type_code"),
        F.col("p")["state"].alias("state"), F.col("p")["at_securitization"].alias("at_securitization"),
        F.col("p")["most_recent"].alias("most_recent"), F.lit(PROFILE_NOTE).alias("note"), _version()
    )


def _noi_pairs(before: DataFrame, after: DataFrame, by: tuple[str, ...]) -> DataFrame:
    a = _earlier(before, by, properties=F.col("properties")).select(
        *by, "asset_number", F.posexplode("properties").alias("i", "p")
    )
    a = a.groupBy(*by, "asset_number", F.col("p")["property_name"].alias("property_name")).agg(
        F.max_by(
            F.struct(F.col("p")["most_recent"]["net_operating_income_amount"].alias("noi")), "i"
        )["noi"].alias("noi_before")
    )
    b = after.select(*by, "asset_number", "doc_position", F.posexplode("properties").alias("property_index", "p"))
    b = b.select(
        *by, "asset_number", "doc_position", "property_index", F.col("p")["property_name"].alias("property_name"),
        F.col("p")["most_recent"]["net_operating_income_amount"].alias("noi_after")
    )
    return b.join(a, [*by, "asset_number", "property_name"])


def noi_changes(before: DataFrame, after: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Properties whose income is known in both periods and differs, the steepest fall first."""
    d = _noi_pairs(before, after, by).withColumn(
        "noi_change", F.col("noi_after") - F.col("noi_before")
    ).filter(F.col("noi_change") != 0)
    order = Window.partitionBy(*by).orderBy("noi_change", "asset_number", "doc_position", "property_index")
    return d.select(
        *by, "asset_number", "property_name", "noi_before", "noi_after", "noi_change",
        F.row_number().over(order).alias("rank"), _version()
    )


NO_NOI_CHANGE = "no property recorded a genuine NOI change between these periods, so none can be said to have deteriorated"


def noi_summary(before: DataFrame, after: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Entries, and properties left out because their income is known in the current period only; a reason where nothing
    is ranked.
    """
    old, new = F.col("noi_before"), F.col("noi_after")
    out = _noi_pairs(before, after, by).groupBy(*by).agg(
        F.count_if(old.isNotNull() & new.isNotNull() & (old != new)).alias("entries"),
        F.count_if(old.isNull() & new.isNotNull()).alias("excluded_first_report_count")
    )
    return out.withColumn(
        "reason", F.when(F.col("entries") == 0, F.lit(NO_NOI_CHANGE))
    ).withColumn("formula_version", F.lit(FORMULA_VERSION))


def distribution(loans: DataFrame, field: str, by: tuple[str, ...] = BY) -> DataFrame:
    """Properties by a code (property_type_code or state): count, share, total and how many have none; most frequent
    first.
    """
    each = loans.select(*by, F.explode("properties").alias("p")).select(
        *by, F.coalesce(F.col("p")[field], F.lit("")).alias("code")
    )
    counted = each.groupBy(*by, "code").agg(F.count("*").alias("property_count"))
    whole = Window.partitionBy(*by)
    out = counted.withColumn("total_property_count", F.sum("property_count").over(whole)).withColumn(
        "missing_count", F.sum(F.when(F.col("code") == "", F.col("property_count")).otherwise(0)).over(whole)
    ).filter(F.col("code") != "")
    order = whole.orderBy(F.desc("property_count"), "code")
    return out.select(
        *by, "code", "property_count",
        (F.col("property_count") * 100.0 / F.col("total_property_count")).alias("property_percentage"),
        "total_property_count", "missing_count", F.row_number().over(order).alias("rank"), _version()
    )


def property_types(loans: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    return distribution(loans, "property_type_code", by)


def geography(loans: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    return distribution(loans, "state", by)


def latest_periods(filings: DataFrame, n: int = 2, by: tuple[str, ...] = BY) -> DataFrame:
    """The last n filings of each deal by report date; unknown dates count as the earliest."""
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last("report_date"), F.desc("seq"))
    return filings.withColumn("recency", F.row_number().over(order)).filter(F.col("recency") <= n)
