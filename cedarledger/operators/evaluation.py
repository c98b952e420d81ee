"""Evaluation of answers to golden questions and the release gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import citation_ok, fact_form
from .verify import is_refusal, unsupported_loans, unsupported_numbers


def evaluate(answers: DataFrame) -> DataFrame:
    """answers: question_id, expected_tools, expected_facts, tools, final_answer, evidence, citation_urls,
    latency_seconds. One row each with its verdict.
    """
    same = lambda x: F.array_sort(F.array_distinct(x))
    text = fact_form(F.col("final_answer"))
    out = answers.select(
        "question_id", F.array_distinct("tools").alias("actual_tools"), "citation_urls", "latency_seconds",
        (same("tools") == same("expected_tools")).alias("tool_routing_correct"),
        F.filter("expected_facts", lambda f: ~F.contains(text, fact_form(f))).alias("missing_facts"),
        unsupported_numbers(F.col("final_answer"), F.col("evidence")).alias("unsupported_numbers"), unsupported_loans(
            F.col("final_answer"), F.col("evidence")
        ).alias("unsupported_loans"),
        is_refusal(F.col("final_answer")).alias("used_fallback"), F.size("citation_urls").alias("citation_count"), (F.col("evidence") != "").alias("has_evidence"),
    )
    out = out.withColumn(
        "unsupported_claim_count", F.size("unsupported_numbers") + F.size("unsupported_loans")
    ).withColumn("numeric_exact", F.size("unsupported_numbers") == 0)
    out = out.withColumn("uncited", F.col("has_evidence") & (F.col("citation_count") == 0))
    reasons = F.array(
        F.when(~F.col("tool_routing_correct"), F.lit("tool routing mismatch")), F.when(
            F.size("missing_facts") > 0, F.concat(F.lit("missing facts: "), F.concat_ws(", ", "missing_facts"))
        ),
        F.when(
            F.col("unsupported_claim_count") > 0, F.lit("unsupported claims")
        ), F.when(F.col("uncited"), F.lit("uncited despite evidence")),
    )
    return out.withColumn(
        "failure_reasons", F.filter(reasons, lambda r: r.isNotNull())
    ).withColumn("passed", F.size("failure_reasons") == 0)


def gate(results: DataFrame) -> DataFrame:
    """One row: rates over all questions (0 without questions; citation validity 1 without citations), and whether the
    gate passes with the reasons if not.
    """
    rate = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(0.0))
    urls = F.sum(F.size("citation_urls"))
    valid = F.sum(F.size(F.filter("citation_urls", lambda u: citation_ok(u))))
    out = results.agg(
        F.count("*").alias("question_count"), rate(F.col("tool_routing_correct")).alias("tool_routing_accuracy"), rate(F.col("numeric_exact")).alias("numeric_exactness_rate"),
        rate(F.col("citation_count") > 0).alias("citation_coverage_rate"), rate(F.col("used_fallback")).alias("fallback_rate"), F.coalesce(
            F.sum("unsupported_claim_count"), F.lit(0)
        ).alias("total_unsupported_claims"),
        F.coalesce(F.avg("latency_seconds"), F.lit(0.0)).alias("average_latency_seconds"), F.coalesce(
            F.try_divide(valid.cast("double"), urls), F.lit(1.0)
        ).alias("source_url_validity_rate"),
        F.lit(None).cast("double").alias("retrieval_recall_at_k"),  # no labelled retrieval questions
        F.count_if(F.col("uncited")).alias("uncited_count"), F.count_if(~F.col("passed")).alias("failed_count"),
    )
    failures = F.filter(F.array(
        F.when(
            F.col("source_url_validity_rate") < 1, F.lit("source URL validity below 100%")
        ), F.when(F.col("numeric_exactness_rate") < 1, F.lit("numeric exactness below 100%")),
        F.when(
            F.col("uncited_count") > 0, F.lit("answers without citations despite evidence")
        ), F.when(F.col("failed_count") > 0, F.lit("golden questions failed")),
    ), lambda r: r.isNotNull())
    return out.withColumn("gate_failures", failures).withColumn("gate_passed", F.size("gate_failures") == 0)


def report(results: DataFrame) -> DataFrame:
    """The gate's row and each result as lines of JSON: kind (summary or question), question_id, json. Results stay
    where they are.
    """
    summary = gate(results).select(
        F.lit("summary").alias("kind"), F.lit(None).cast("string").alias("question_id"),
        F.to_json(F.struct("*")).alias("json")
    )
    return summary.unionByName(
        results.select(
            F.lit("question").alias("kind"), F.col("question_id").cast("string").alias("question_id"),
            F.to_json(F.struct(*results.columns)).alias("json")
        )
    )
