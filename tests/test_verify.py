"""Checks of drafts, routing of questions, evaluation and the assistant."""

import pytest
from pyspark.sql import functions as F

from cedarledger.operators import evaluation, planner, verify
from cedarledger.plans import assistant

from .test_analytics import frame, loan


def of(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def numbers(spark, draft, evidence, **k):
    return of(spark, verify.unsupported_numbers(F.lit(draft), F.lit(evidence), **k))


@pytest.mark.parametrize("draft,evidence,bad", [
    ("70000000 owed", "$70,000,000.00", []), (
        "about 728.4 of it", "728,470,251.29", ["728.4"]
    ), ("728,470 or so", "728,470,251.29", []), ("12 and 345", "45", ["12"]), ("3 loans", "none", []), ("exactly 12.50", "12.5", []), ("99", "", ["99"]), ("1.0 of 10", "7", ["1.0", "10"]),
])
def test_unsupported_numbers(spark, draft, evidence, bad):
    assert numbers(spark, draft, evidence) == bad


def test_a_lone_zero_supports_any_zero_unless_strict(spark):
    assert numbers(spark, "901 units", "drift 0") == [] and numbers(
        spark, "901 units", "drift 0", strict=True
    ) == ["901"]


def test_unsupported_loans(spark):
    assert of(
        spark, verify.unsupported_loans(F.lit("loan_1, Loans 30, loan 87 and loan 87"), F.lit("loan 30 (x)"))
    ) == ["1", "87"]


def test_repetition(spark):
    loop = "B 7, D 6, C 4, A 5, R 3, " * 6
    plain = " ".join(f"word{i} follows word{i * 7}" for i in range(60))
    assert of(spark, verify.repetitive(F.lit(loop))) and not of(spark, verify.repetitive(F.lit(plain))) and not of(spark, verify.repetitive(F.lit("aa" * 20))) and not of(
        spark, verify.repetitive(F.lit(None).cast("string"))
    )


def test_repetition_needs_more_than_four(spark):
    window = "abcdefghijklmnopqrst"
    filler = "0123456789!?;:-_=+*/"
    four = "".join(window + f"{i}{filler[i:]}{filler[:i]}" for i in range(4))
    assert not of(spark, verify.repetitive(F.lit(four))) and of(spark, verify.repetitive(F.lit(four + window)))


def test_errors_in_order(spark):
    got = of(spark, verify.errors(F.lit("loan 5 has 77"), F.lit("loan 3"), F.lit(True), F.lit(0)))
    assert [e.split(":")[0] for e in got] == [
        "numbers not present in evidence", "loans not present in evidence",
        "evidence was gathered but no citation is available"
    ]
    assert of(
        spark, verify.final_answer(F.lit("d"), F.lit(""), F.array(F.lit("e")))
    ).endswith("(no evidence was gathered for this question)")


@pytest.mark.parametrize("question,tools,retrieval", [
    (
        "Which loans changed payment status, and whose balances diverged from schedule?",
        ["rank_loans_by_status_change", "rank_loans_by_balance_drift"], False
    ),
    (
        "Which loans were cured?", ["rank_loans_by_status_change"], False
    ), ("Give me a deal summary", ["get_deal_summary"], False), ("payment history of loan 30", ["get_loan_history"], False),
    (
        "Does the certificate balance match? reconciliation please", ["get_bond_collateral_reconciliation"], False
    ), ("What changed between the last two reporting periods?", [], False), ("Why? Explain the 8-K", [], True),
    ("CUSIP of the tranche", ["get_certificate_distribution"], False), (
        "Properties in Illinois", ["rank_properties_by_noi_change"], False
    ),
])
def test_routing(spark, question, tools, retrieval):
    assert of(spark, planner.planned_tools(F.lit(question))) == tools and of(
        spark, planner.needs_retrieval(F.lit(question))
    ) == retrieval


ANSWERS = "question_id string, expected_tools array<string>, expected_facts array<string>, tools array<string>, final_answer string, evidence string, citation_urls array<string>, latency_seconds double"
OK = ["https://www.sec.gov/a"]


def test_evaluation(spark):
    rows = [
        (
            "good", ["a", "b"], ["loan 30"], ["b", "a", "a"], "Loans 30 and 16 changed", "loan 30; loan 16", OK, 1.0
        ), ("route", ["a"], [], ["b"], "x", "x", OK, 3.0), ("fact", ["a"], ["loan 16"], ["a"], "Loans 30 and 16", "loan 30, 16", OK, 1.0),
        ("number", ["a"], [], ["a"], "12345", "x", OK, 1.0), ("uncited", ["a"], [], ["a"], "x", "x", [], 1.0), (
            "refused", ["a"], [], ["a"], verify.REFUSAL + "\nx 12", "x 12", ["http://elsewhere"], 1.0
        ),
    ]
    got = {r["question_id"]: r for r in evaluation.evaluate(spark.createDataFrame(rows, ANSWERS)).collect()}
    assert {k for k, r in got.items() if r["passed"]} == {"good", "refused"}
    assert got["fact"]["missing_facts"] == ["loan 16"] and got["number"]["unsupported_numbers"] == ["12345"] and got["refused"]["used_fallback"] and got["uncited"]["uncited"]
    g = evaluation.gate(evaluation.evaluate(spark.createDataFrame(rows, ANSWERS))).first()
    assert not g["gate_passed"] and len(g["gate_failures"]) == 4 and g["source_url_validity_rate"] == 0.8 and abs(g["fallback_rate"] - 1 / 6) < 1e-9


def test_gate_without_questions(spark):
    g = evaluation.gate(evaluation.evaluate(spark.createDataFrame([], ANSWERS))).first()
    # nothing was shown to be exact
    assert g["question_count"] == 0 and g["tool_routing_accuracy"] == 0 and g["source_url_validity_rate"] == 1 and not g["gate_passed"]


def test_report_is_json(spark):
    import json

    r = {
        x["kind"]: x for x in evaluation.report(
            evaluation.evaluate(spark.createDataFrame([("q", ["a"], [], ["a"], "x", "x", OK, 1.0)], ANSWERS))
        ).collect()
    }
    assert json.loads(r["summary"]["json"])["gate_passed"] and "retrieval_recall_at_k" not in json.loads(r["summary"]["json"])
    assert r["question"]["question_id"] == "q" and json.loads(r["question"]["json"])["passed"]


@pytest.fixture
def deal(spark):
    a = frame(
        spark, [loan("16", "B"), loan("30", "0"), loan("4", actual="90", properties=[("Main Plaza", "OF", "NY", "5")])]
    )
    b = frame(
        spark, [loan("16", "0"), loan("30", "B"), loan("4", actual="90", properties=[("Main Plaza", "OF", "NY", "4")])]
    )
    source = F.struct(F.lit("https://www.sec.gov/f").alias("source_url"))
    return assistant.Deal("Trust", a.withColumn("source", source), b.withColumn("source", source))


def test_answer_from_evidence(spark, deal):
    got = assistant.ask(spark, "Which loans changed payment status, and did balances drift?", deal)
    assert not got.errors and not got.used_fallback and "loan 30" in got.final_answer and "1 of 3 loans diverged" in got.evidence and got.citations == ["https://www.sec.gov/f"]


def test_invented_number_is_repaired(spark, deal):
    model = assistant.ScriptedModel("loan 99 owes 1234567", "loan 30 went from 0 to B")
    got = assistant.ask(spark, "Which loans changed payment status?", deal, model)
    assert got.repaired and not got.used_fallback and got.final_answer == "loan 30 went from 0 to B" and "1234567" in model.prompts[1]


def test_stubborn_model_gives_the_evidence(spark, deal):
    got = assistant.ask(spark, "Which loans changed payment status?", deal, assistant.ScriptedModel("loan 99"))
    assert got.used_fallback and got.final_answer.startswith(verify.REFUSAL) and got.evidence in got.final_answer


@pytest.mark.parametrize("question,text", [
    ("deal summary", "3 loans"), ("history of loan 30", "loan 30 on 2026-05-31: status 0"), ("history of loan 77", "no history found for loan 77"), (
        "did NOI deteriorate", "Main Plaza (loan 4): NOI $5.00 -> $4.00"
    ),
    ("occupancy of Main Plaza, loan 4", "Main Plaza: valuation n/a"), ("cusip of class A-1", "no matching certificate class"), (
        "reconciliation of collateral", "no bond and collateral reconciliation"
    ),
])
def test_tools(spark, deal, question, text):
    assert text in assistant.ask(spark, question, deal).evidence


def test_sources_of_the_loans_that_evidence_names(spark):
    path = F.struct(
        F.lit("https://www.sec.gov/f").alias("source_url"),
        F.concat(F.lit("assets["), "asset_number", F.lit("]")).alias("field_path")
    )
    a, b = (frame(spark, [loan("16", x), loan("30", "0")]).withColumn("source", path) for x in ("B", "0"))
    got = assistant.ask(spark, "Which loans changed payment status?", assistant.Deal("Trust", a, b))
    assert got.sources == [("https://www.sec.gov/f", "assets[16]")] and got.citations == ["https://www.sec.gov/f"]
    nothing = assistant.ask(spark, "Which loans changed payment status?", assistant.Deal("Trust", b, b))
    assert "no loans changed" in nothing.evidence and nothing.sources == [("https://www.sec.gov/f", None)] and not nothing.errors


def test_excerpts_cite_their_page(spark):
    from cedarledger.operators import retrieval

    chunks = spark.createDataFrame(
        [("1", "acc", "a material agreement was signed", ("https://www.sec.gov/p",))],
        "chunk_id string, accession_number string, text string, source struct<source_url: string>"
    )
    got = assistant.ask(
        spark, "Explain the material agreement",
        assistant.Deal("Trust", chunks=chunks.withColumn("embedding", retrieval.hashed_embedding(F.col("text"))))
    )
    assert got.citations == ["https://www.sec.gov/p"] and "material agreement was signed" in got.evidence


def test_model_surface():
    model = assistant.ScriptedModel('{"label": "current", "share": 0.5}', "not json")
    assert model.health() and model.info()["model"] == "ScriptedModel"
    assert model.structured("p", {"label": str, "share": float}) == {"label": "current", "share": 0.5}
    for m, fields in ((model, {"label": str}), (assistant.ScriptedModel('{"label": 1}'), {"label": str})):
        with pytest.raises(assistant.ModelError) as e:
            m.structured("p", fields)
        assert e.value.category == "invalid_response"
    with pytest.raises(assistant.ModelError) as e:
        assistant.ScriptedModel().generate("p")
    assert e.value.category == "unavailable"


def test_question_without_tools(spark, deal):
    got = assistant.ask(spark, "Hello", deal)
    assert got.evidence == "" and got.planned_tools == [] and not got.errors
