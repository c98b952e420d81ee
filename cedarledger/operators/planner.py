"""Routing of questions to analytics by keywords, as a column expression over a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import has_any

# Keywords that call for each tool, in the order in which tools run.
STATUS = ("payment status", "delinquent", "cured", "status change", "current to")
BALANCE = ("balance", "drift", "diverg", "scheduled", "actual balance")
HISTORY = ("history", "over time", "each period", "every period")
SUMMARY = ("deal summary", "overview", "how many loans", "total balance")
PROFILE = ("property profile", "occupancy", "valuation", "square feet")
NOI = ("noi", "deteriorat", "net operating income")
CERTIFICATE = ("certificate", "cusip", "tranche", "credit support", "principal distribution", "interest distribution")
RECONCILIATION = (
    "collateralization", "certificate balance", "collateral balance", "reconciliation", "under collateral",
    "over collateral"
)
NARRATIVE = ("material agreement", "8-k", "10-d", "background", "why", "what happened", "filing text", "explain")


def planned_tools(question: Column) -> Column:
    q = F.lower(question)
    reconciles = has_any(q, RECONCILIATION)
    tools = [
        (has_any(q, STATUS), "rank_loans_by_status_change"), (
            has_any(q, BALANCE) & ~reconciles, "rank_loans_by_balance_drift"
        ), (has_any(q, HISTORY), "get_loan_history"),
        (has_any(q, SUMMARY), "get_deal_summary"), (has_any(q, PROFILE), "get_property_profile"), (
            has_any(q, NOI), "rank_properties_by_noi_change"
        ),
        (
            has_any(q, CERTIFICATE) & ~reconciles, "get_certificate_distribution"
        ), (reconciles, "get_bond_collateral_reconciliation"),
    ]
    return F.filter(F.array(*(F.when(c, F.lit(t)) for c, t in tools)), lambda t: t.isNotNull())


def needs_retrieval(question: Column) -> Column:
    return has_any(F.lower(question), NARRATIVE)


def plan(questions: DataFrame, text: str = "question") -> DataFrame:
    return questions.withColumn("planned_tools", planned_tools(F.col(text))).withColumn(
        "needs_retrieval", needs_retrieval(F.col(text))
    )
