"""The pipeline's stages, each on what its predecessor kept, against plain versions."""

import os

import numpy as np
import pytest

from cedarledger.llm import bpe, exchange

from . import plain
from .conftest import frame

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def written(spark, root, rows, items, labels):
    frame(spark, rows).write.parquet(f"{root}/documents.parquet")
    items.write.parquet(f"{root}/benchmark.parquet")
    labels.write.parquet(f"{root}/labels.parquet")
    return root


@pytest.fixture(scope="module")
def sf_dir(spark, docs_rows, items, labels, tmp_path_factory):
    """All documents, very long ones too, and some of them twice."""
    return written(spark, str(tmp_path_factory.mktemp("sf")), docs_rows + docs_rows[:3], items, labels)


@pytest.fixture(scope="module")
def staged(spark, sf_dir, tmp_path_factory):
    """Name, rows before, rows after and columns of each stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()] if name != "bpe" or "text" in docs.columns else []
        path = str(tmp_path_factory.mktemp(name))
        after = stage(spark, docs, sf_dir)
        after.write.mode("overwrite").parquet(path)
        same_columns = after.columns == docs.columns
        docs = spark.read.parquet(path)
        out.append((name, before, docs.collect(), same_columns))
    return out


def test_stages(staged, items_rows):
    assert [n for n, *_ in staged] == ["quality", "line_dedup", "near_dedup", "decontamination", "bpe"]
    for name, before, rows, same_columns in staged:
        assert name == "bpe" or same_columns
        if name == "quality":
            good = {t for (d, t), r in zip(before, plain.quality(before)) if not r[6]}
            assert {r["text"] for r in rows} <= good and len(rows) > 0.9 * len([1 for _, t in before if t in good])
        elif name == "line_dedup":
            want = sorted((str(r[0]), r[3]) for r in plain.line_dedup(before))
            assert sorted((str(r["doc_id"]), plain.sha(r["text"])) for r in rows) == want
        elif name == "near_dedup":
            stays = sorted((str(d), t) for (d, t), r in zip(before, plain.near_duplicates(before)) if r[3])
            assert sorted((str(r["doc_id"]), r["text"]) for r in rows) == stays
        elif name == "decontamination":
            clean = sorted(str(r[0]) for r in plain.decontamination(before, items_rows) if not r[5])
            assert sorted(str(r["doc_id"]) for r in rows) == clean and len(rows) < len(before)
        else:
            t = bpe.load(bpe.vocabulary())
            want = sorted(
                (
                    str(d), plain.sha(np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes())
                ) for d, x in before
            )
            assert sorted((str(r["doc_id"]), r["ids_sha256"]) for r in rows) == want


def test_run_gives_what_its_stages_give_and_leaves_nothing(spark, sf_dir, staged):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, got.collect())) == sorted(map(str, staged[-1][2])) and staged[-1][2]
    shared = exchange.shared_folder(spark).removeprefix("file:")
    assert not [x for x in os.listdir(shared) if x.startswith("pipeline-")]


def test_stages_of_empty_tables(spark, empty, items, labels, tmp_path):
    root = written(spark, str(tmp_path / "sf"), [], items.limit(0), labels.limit(0))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, root).collect() == [], name
    assert corpus_pipeline.run(spark, root).collect() == []
