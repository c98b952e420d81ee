"""Questions about stored deals, and runs."""

import pytest

from cedarledger.plans import api, ingest, jobs

from .test_sources import PLAIN, PREFIXED, REPORT, put


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("deal")
    put(root / "in", "0000000001", "a1", PLAIN.replace("05-13-2026", "04-13-2026").replace(">B<", ">0<"))
    put(root / "in", "0000000001", "a2", PREFIXED)
    put(root / "in", "0000000002", "b1", PLAIN)
    for kind, text in (
        ("reports", REPORT.format("54,899,998.25")), ("narrative", "<h1>T</h1><p>words of a filing</p>")
    ):
        d = root / "in" / kind / "0000000001" / "r1"
        d.mkdir(parents=True)
        (d / "x.htm").write_text(text)
    ingest.run(spark, str(root / "in"), str(root / "out"))
    return api.Surveillance(spark, str(root / "out"))


def test_questions(stored):
    cik = "0000000001"
    assert {(r["cik"], r["periods"]) for r in stored.deals().collect()} == {(cik, 2), ("0000000002", 1)}
    assert stored.summary(cik).first()["loan_count"] == 2
    assert [
        (r["asset_number"], r["severity"]) for r in stored.status_changes(cik).collect()
    ] == [("16", "newly delinquent")]
    assert [r["field_name"] for r in stored.compare(cik).collect()] == ["paymentStatusLoanCode"]
    assert stored.compare(cik, "a2", "a1").first()["value_before"] == "B"
    assert stored.balance_drift(cik).count() == 0 and stored.noi_changes(cik).count() == 0
    assert [(r["code"], r["property_count"]) for r in stored.geography(cik).collect()] == [("NY", 1)]
    assert stored.property_types(cik).count() == 0 and stored.loan_history(cik, "16").count() == 2
    assert stored.property_profile(cik, "29", "B").first()["property_name"] == "B"
    assert stored.certificate_distributions(cik).first()["cusip"] == "9ZK41QAB7" and stored.reconciliation(cik).first()["reconciles"]
    assert stored.table("chunks").first()["section_heading"] == "T"


def test_gates(stored):
    with pytest.raises(ingest.DealNotFound):
        stored.summary("9")
    with pytest.raises(ingest.InsufficientPeriods):
        stored.compare("0000000002")
    assert stored.summary("0000000002").first()["loan_count"] == 2


def test_runs(spark):
    runs = jobs.Runs()
    one = runs.enqueue("k")
    assert runs.enqueue("k") is one and runs.enqueue("other") is not one
    assert runs.perform(one, lambda: 7).result == 7 and one.status == jobs.SUCCEEDED
    two = runs.enqueue("k")
    assert two is not one and runs.perform(two, lambda: 1 / 0).status == jobs.FAILED and "ZeroDivisionError" in two.error
    assert runs.table(spark).count() == 3


def test_runs_that_processes_share(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    folder = str(tmp_path / "queue")
    assert jobs.SharedRuns(spark, folder).table().count() == 0
    with ThreadPoolExecutor(8) as pool:  # each with an object of its own: what they share is the folder
        got = list(pool.map(lambda _: jobs.SharedRuns(spark, folder).enqueue("k"), range(24)))
    assert len({r.job_id for r, _ in got}) == 1 and sum(ours for _, ours in got) == 1
    runs, (run, _) = jobs.SharedRuns(spark, folder), next(g for g in got if g[1])
    assert runs.enqueue("other")[1] and runs.table().filter("status = 'queued'").count() == 2
    assert runs.perform(run, lambda: 7).status == jobs.SUCCEEDED and not runs.abandon(run)
    two, ours = runs.enqueue("k")
    assert ours and two.job_id != run.job_id and runs.perform(two, lambda: 1 / 0).status == jobs.FAILED
    lost, ours = runs.enqueue("k")  # as if its process were killed
    assert ours and not runs.enqueue("k")[1] and runs.abandon(lost) and runs.enqueue("k")[1]
    rows = {r["job_id"]: r for r in runs.table().filter("idempotency_key = 'k'").collect()}
    assert len(rows) == 4 and rows[run.job_id]["status"] == "succeeded" and rows[run.job_id]["ended"] >= rows[run.job_id]["started"]
    assert "ZeroDivisionError" in rows[two.job_id]["error"] and rows[lost.job_id]["error"] == "abandoned"
    (tmp_path / "queue" / "states" / f"{lost.job_id}-9.json").write_text('{"job_id": "x", "sta')  # half a line
    assert runs.table().filter("idempotency_key = 'k'").count() == 4


def test_an_ingestion_is_asked_for_once(spark, tmp_path):
    put(tmp_path / "in", "0000000001", "a1", PLAIN)
    run, ours = jobs.ingest_once(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert ours and run.status == jobs.SUCCEEDED, run.error
    again, ours = jobs.ingest_once(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert ours and again.job_id != run.job_id
    waiting, _ = jobs.SharedRuns(spark, str(tmp_path / "out" / "queue")).enqueue(str(tmp_path / "in"))
    assert jobs.ingest_once(spark, str(tmp_path / "in"), str(tmp_path / "out")) == (jobs.Run(waiting.key, waiting.job_id), False)


def test_deleting_tells_how_many(spark, tmp_path):
    from cedarledger.operators import retrieval

    index = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "chunk_id string, accession_number string")
    retrieval.save(index, str(tmp_path / "i"))
    assert [retrieval.delete_saved(spark, str(tmp_path / "i"), a) for a in ("x", "x", "y")] == [2, 0, 0]
    assert [r["chunk_id"] for r in retrieval.load(spark, str(tmp_path / "i")).collect()] == ["c"]
