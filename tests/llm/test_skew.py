"""Groups that hold a third of all rows, and rows dealt so that groups cross the borders of partitions."""

import random

from cedarledger.llm import components, line_dedup, minhash, substring_dedup

from . import plain
from .conftest import LINE, frame, sentence
from .test_contracts import same


def crowd(n=300):
    r = random.Random(11)
    base = sentence(r, 60)
    out = []
    for i in range(n):
        kind = i % 3
        if kind == 0:
            out.append((i, base + "\n" + LINE))
        elif kind == 1:
            w = base.split()
            w[r.randrange(60)] = f"w{i}"
            out.append((i, " ".join(w) + "\n" + LINE))
        else:
            out.append((i, sentence(r, 40) + "\n" + LINE))
    return out


def test_hot_line_crosses_partitions(spark):
    rows = crowd()
    docs = frame(spark, rows).repartition(7)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        same(
            line_dedup.digests(line_dedup.apply(docs, line_dedup.keep_bitmaps(docs))),
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"], plain.line_dedup(rows)
        )
        same(
            substring_dedup.digests(substring_dedup.remove(docs, substring_dedup.repeats(docs))),
            ["doc_id", "n_words", "n_removed", "kept_sha256"], plain.substring_dedup(rows)
        )
        same(
            minhash.near_duplicates(docs), ["doc_id", "n_shingles", "component_id", "kept"], plain.near_duplicates(rows)
        )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_streamed_lines_decide_runs_inside_batches():
    """All ways to cut one ordered run of rows into batches give the same verdicts."""
    import pyarrow as pa

    rows = [
        (1, 1, 9, 0, 1, b"\x01\x00"), (1, 2, 9, 0, 1, b"\x01\x00"), (1, 2, 8, 0, 1, b"\x01\x00"),
        (1, 2, 7, 0, 1, b"\x01\x00"), (1, 2, 7, 5, 1, b"\x01\x00"), (1, 3, 6, 0, 1, b"\x01\x00"),
        (1, 4, 5, 0, 1, b"\x01\x00")
    ]
    types = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
    batch = lambda part: pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*part), types)], line_dedup.NAMES
    )
    for size in range(1, 8):
        got = []
        for b in line_dedup.stream(iter([batch(rows[i : i + size]) for i in range(0, len(rows), size)])):
            got += [tuple(r.values()) for r in b.to_pylist()]
        dropped = {r[1:4] for r in got if r[6] == line_dedup.DROPPED}
        assert dropped == {(2, 8, 0), (2, 7, 0), (2, 7, 5)}, size
        assert {r[1] for r in got if r[6] == line_dedup.OPEN} == {1, 4}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    out = {r["u"]: r["v"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}


def test_groups_cut_into_blocks(spark, monkeypatch):
    """Chains of near-copies whose ends aren't alike, far more than one block holds."""
    r = random.Random(13)
    words = sentence(r, 120).split()
    rows = []
    for i in range(90):
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            words[r.randrange(120)] = f"edit{i}"
    other = sentence(r, 80).split()
    rows += [
        (200 + i, " ".join(other[:40] + [f"one{i}"] + other[41:])) for i in range(40)
    ] + [(300 + i, sentence(r, 50)) for i in range(20)]
    r.shuffle(rows)
    docs = frame(spark, rows).repartition(5)
    for block in (7, 30, 10_000):
        monkeypatch.setattr(minhash, "BLOCK", block)
        same(
            minhash.near_duplicates(docs), ["doc_id", "n_shingles", "component_id", "kept"], plain.near_duplicates(rows)
        )


def test_small_sets_are_linked_exactly(spark, monkeypatch):
    """One-word edits of texts of 8 to 40 words, at an end or inside, against brute force; groups of any size are cut.
    """
    r = random.Random(19)
    rows = []
    for n in range(8, 41):
        for _ in range(6):
            w = [f"{r.choice('abcdefgh')}{r.randrange(400)}" for _ in range(n)]
            at = r.randrange(n)
            for edited in (w, w + ["end"], w[1:], w[:at] + ["new"] + w[at + 1 :]):
                rows.append((len(rows), " ".join(edited)))
    rows += [
        (
            len(rows) + i, "one and the same start of many short texts, all of them alike but for the end " + f"e{i}"
        ) for i in range(40)
    ]
    r.shuffle(rows)
    docs = frame(spark, rows).repartition(5)
    for block, most in ((7, 3), (10_000, 1 << 16)):
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "FREQUENT", most)
        same(
            minhash.near_duplicates(docs), ["doc_id", "n_shingles", "component_id", "kept"], plain.near_duplicates(rows)
        )
