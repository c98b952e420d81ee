"""Filings that are filed again: all their tables change together, or none does."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from cedarledger.operators import store
from cedarledger.plans import ingest
from cedarledger.streaming import landing

from .test_sources import PLAIN, PREFIXED, put

CLEAN = "<d><assets><assetNumber>1</assetNumber></assets></d>"
ASSETS = ingest.TABLES["assets"]


def rows(df):
    return sorted(str(r) for r in df.drop("ingest_seq", "source").collect())


def current(spark, out):
    return {name: rows(store.current(spark, out, name, "assets")) for name in ASSETS}


def lying(spark, out):
    """What is in the folders, of whatever run."""
    return {name: rows(store.versions(spark, out, name)) for name in ASSETS}


def take(spark, root, out):
    return ingest.take_assets(ingest.read_documents(spark, f"{root}/assets"), out)


def test_clean_broken_and_corrected_refilings(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    for accession in ("a1", "a2", "a3"):
        put(root, "0000000001", accession, PLAIN)
    put(root, "0000000001", "a4", PREFIXED)
    take(spark, root, out)
    put(root, "0000000001", "a1", CLEAN)
    put(root, "0000000001", "a2", "not xml at all")
    put(root, "0000000001", "a3", PLAIN.replace("05-13-2026", "04-13-2026"))
    take(spark, root, out)
    take(spark, root, str(tmp_path / "fresh"))
    now = current(spark, out)
    assert now == current(spark, str(tmp_path / "fresh")) == lying(spark, out)
    of = lambda name, a: [r for r in now[name] if f"accession_number='{a}'" in r]
    assert len(of("loans", "a1")) == 1 and not of("issues", "a1") and not of("loans", "a2") and not of("issues", "a2")
    assert "status='failed'" in of("outcomes_assets", "a2")[0] and not of("reporting_periods", "a2")
    assert "2026, 4, 13" in of("reporting_periods", "a3")[0] and len(of("loans", "a4")) == 2
    # all filings clean or broken: no issue is left, and the table still reads
    put(root, "0000000001", "a3", CLEAN)
    put(root, "0000000001", "a4", CLEAN)
    take(spark, root, out)
    assert current(spark, out)["issues"] == lying(spark, out)["issues"] == []


def test_a_killed_run_changes_nothing(spark, tmp_path, monkeypatch):
    root, out = tmp_path / "in", str(tmp_path / "out")
    put(root, "1", "a1", PLAIN)
    put(root, "1", "a2", PLAIN)
    take(spark, root, out)
    before = current(spark, out)
    put(root, "1", "a1", CLEAN)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "commit_run", killed)
        with pytest.raises(KeyboardInterrupt):
            take(spark, root, out)
    assert current(spark, out) == before != lying(spark, out)
    take(spark, root, out)
    take(spark, root, str(tmp_path / "fresh"))
    assert current(spark, out) == lying(spark, out) == current(spark, str(tmp_path / "fresh"))


def test_no_two_runs_have_one_number(spark, tmp_path):
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda _: store.next_seq(spark, str(tmp_path / "out")), range(18)))
    assert sorted(got) == list(range(1, 19))


def test_a_replacement_that_was_cut_short_loses_nothing(spark, tmp_path):
    path = tmp_path / "deals"
    rows_ = lambda *r: spark.createDataFrame(r, "k string, v string, ingest_seq int, seq int")
    store.upsert_table(rows_(("a", "x", 1, 9), ("b", "y", 1, 9)), str(path), ["k"], ["ingest_seq", "seq"])
    path.rename(tmp_path / "deals.old")
    store.upsert_table(rows_(("a", "z", 2, 1), ("a", "w", 2, 0)), str(path), ["k"], ["ingest_seq", "seq"])
    assert {(r["k"], r["v"]) for r in spark.read.parquet(str(path)).collect()} == {("a", "z"), ("b", "y")}
    assert not (tmp_path / "deals.old").exists()


def test_stream_takes_refilings(spark, tmp_path):
    root, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    put(root, "1", "a1", PLAIN)
    put(root, "1", "a2", PLAIN)
    landing.run(spark, str(root / "assets"), out, check)
    (root / "assets" / "1" / "a1" / "b.xml").write_text(CLEAN)
    (root / "assets" / "1" / "a2" / "b.xml").write_text("not xml at all")
    landing.run(spark, str(root / "assets"), out, check)
    landing.run(spark, str(root / "assets"), out, check)  # nothing new: no run
    put(tmp_path / "in2", "1", "a1", CLEAN)
    put(tmp_path / "in2", "1", "a2", "not xml at all")
    take(spark, tmp_path / "in2", str(tmp_path / "fresh"))
    assert current(spark, out) == current(spark, str(tmp_path / "fresh")) == lying(spark, out)
