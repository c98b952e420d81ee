"""Every operator against its plain version, over nulls, empty and very long texts, ties, repeated rows and clashing
columns.
"""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from cedarledger.llm import bpe, decontam, langid, line_dedup, lm, minhash, pii, quality, substring_dedup, token_counts

from . import plain


def same(df, columns, expected):
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    want = Counter(expected)
    assert not (got - want) and not (want - got), (list((got - want).items())[:3], list((want - got).items())[:3])


def test_decontamination(docs, docs_rows, items, items_rows):
    got = decontam.judged(decontam.find(docs, items))
    same(
        got, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        plain.decontamination(docs_rows, items_rows)
    )


def test_decontamination_by_shuffle_gives_the_same(docs, docs_rows, items, items_rows, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    same(
        decontam.judged(decontam.find(docs, items)), ["doc_id", "n_words", "n_hit"],
        [r[:3] for r in plain.decontamination(docs_rows, items_rows)]
    )


def test_decontaminated_documents_keep_their_columns(docs, docs_rows, items, items_rows):
    left = decontam.clean(docs, items)
    assert left.columns == docs.columns
    want = [(d, t) for (d, t), r in zip(docs_rows, plain.decontamination(docs_rows, items_rows)) if not r[5]]
    same(left, ["doc_id", "text"], [x for x in want if x[1] is not None] + [x for x in want if x[1] is None])


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.load(bpe.vocabulary())


def test_encoding_and_decoding(docs, docs_rows, tokenizer):
    want = []
    for d, t in docs_rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append(
            (
                d, len(ids), plain.sha(np.array(ids, "<u4").tobytes()),
                plain.sha(tokenizer.decode(ids, skip_special_tokens=False))
            )
        )
    same(bpe.digests(bpe.encode_decode(docs)), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], want)


def test_joins_of_chunks_against_the_library(tokenizer):
    """Chunks of a few bytes, so that cuts fall inside words, marks and special strings; repeated passages are looked
    up.
    """
    import struct

    r = random.Random(47)
    parts = [
        *" \t\n\r\x0b\x0c", *"abzABZ019.,;:!?|'-_#<>", "'s", "'re", " it's ", "é", "É", "\u0301", "ß", "Σ", "İ", "日",
        "🙂", "\u00a0", "\u0085", "\x1c", "<|endoftext|>", "<|startoftext|>"
    ]
    encoder = bpe.Encoder(tokenizer, mask=0x7)
    assert encoder.splits and encoder.words.parts
    passage = "".join(r.choice(parts) for _ in range(300))
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 120))) + passage * (i % 2) for i in range(1200)]
    known = 0
    for at in range(0, len(texts), 50):
        for text, (ids, shown, _, n_known) in zip(texts[at : at + 50], encoder.encode_batch(texts[at : at + 50])):
            want = tokenizer.encode(text, add_special_tokens=False).ids
            assert ids == struct.pack(f"<{len(want)}I", *want) and shown == tokenizer.decode(want, skip_special_tokens=False), text
            known += n_known
    assert encoder.joins > 1000 and known > 1000


def test_contexts_grow_until_both_sides_agree(tokenizer, monkeypatch):
    """Sides that disagree at first: the context grows, and where nothing helps the library encodes the whole text."""
    encoder = bpe.Encoder(tokenizer, mask=0x7)
    text = "some words of a text that is cut in many places, again and again " * 4
    want = tokenizer.encode(text, add_special_tokens=False).ids
    for w in ("words", "text", "places,", "cut"):
        encoder.words[w.encode()] = encoder.words.of([1, 2, 3])  # as if these words had other ids alone
    ids, _, _, _ = encoder.encode_batch(["x " * 40])[0]
    assert encoder.grown == 0 and len(ids) == 160
    encoder.chunks.clear()
    assert encoder._mended(
        [(b"between", bpe.Chunk(b"a text", b"a", b"text", b"", ""), None)]
    )[0] == encoder.words.of(tokenizer.encode("between", add_special_tokens=False).ids)
    wrong = bpe.Chunk(b"a text here b", b"a", b"b", b"", "")
    encoder.words[b"here"] = encoder.words.of([1, 2, 3])
    assert encoder._mended([(b"between", wrong, None)]) == [None] and encoder.grown > 0
    encoder.splits = False
    assert encoder.encode(text)[0] == np.array(want, "<u4").tobytes()


def test_token_counts(docs, docs_rows, tokenizer):
    want = [
        (
            d, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 2048
        ) for d, t in docs_rows
    ]
    same(
        token_counts.with_limit(token_counts.count_tokens(docs)), ["doc_id", "n_bytes", "n_tokens", "over_limit"], want
    )


def test_line_dedup(docs, docs_rows):
    same(
        line_dedup.digests(line_dedup.apply(docs, line_dedup.keep_bitmaps(docs))),
        ["doc_id", "n_lines", "n_dropped", "kept_sha256"], plain.line_dedup(docs_rows)
    )


def test_line_dedup_returns_documents(docs):
    out = line_dedup.deduplicated(docs, line_dedup.keep_bitmaps(docs))
    assert out.columns == docs.columns and out.schema == docs.schema
    assert out.filter("text IS NULL").count() == 1 and out.filter("n_chars <> length(text)").count() == 0


def test_substring_dedup(docs, docs_rows):
    same(
        substring_dedup.digests(substring_dedup.remove(docs, substring_dedup.repeats(docs))),
        ["doc_id", "n_words", "n_removed", "kept_sha256"], plain.substring_dedup(docs_rows)
    )


def test_near_duplicates(docs, docs_rows):
    same(
        minhash.near_duplicates(docs), ["doc_id", "n_shingles", "component_id", "kept"],
        plain.near_duplicates(docs_rows)
    )


def test_first_of_each_near_duplicate_stays(docs, docs_rows):
    out = minhash.first_of_each(docs)
    assert out.columns == docs.columns
    same(out, ["doc_id", "text"], [x for x, r in zip(docs_rows, plain.near_duplicates(docs_rows)) if r[3]])


def test_another_text_of_a_repeated_doc_id_stays(spark):
    r = random.Random(29)
    a, b = (" ".join(f"w{r.randrange(900)}" for _ in range(30)) for _ in range(2))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b + " end"), (None, a), (4, None), (4, "")]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    same(
        minhash.first_of_each(docs_), ["doc_id", "text"], [x for x, y in zip(rows, plain.near_duplicates(rows)) if y[3]]
    )
    assert minhash.first_of_each(docs_).filter("doc_id = 2").count() == 2


def test_personal_data(docs, docs_rows):
    found = pii.find(docs)
    same(
        pii.digests(found), ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"],
        plain.personal_data(docs_rows)
    )
    for r in found.collect():
        assert set(filter(None, r["base"].split(","))) <= set(r["spans"].split(","))


def test_reliabilities_are_recovered():
    """Votes drawn from planted reliabilities, one labeler without an opinion half the time."""
    r = random.Random(31)
    share, truth = 0.3, [(0.95, 0.1), (0.8, 0.2), (0.7, 0.05), (0.9, 0.4)]
    drawn = Counter()
    for _ in range(20_000):
        personal = r.random() < share
        drawn[
            tuple(-1 if j == 2 and r.random() < 0.5 else int(r.random() < t[not personal]) for j, t in enumerate(truth))
        ] += 1
    prior, table, post = pii.reliabilities(drawn)
    assert abs(prior - share) < 0.03 and all(
        abs(x - y) < 0.05 for got, want in zip(table, truth) for x, y in zip(got, want)
    )
    assert post[1, 1, 1, 1] > 0.95 and post[0, 0, 0, 0] < 0.05


def test_spans_beyond_the_strict_patterns(spark):
    """Written-out addresses, numbers without a country code and named secrets come out; numbers and words like them
    don't.
    """
    r = random.Random(37)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    digits = lambda n: "".join(r.choice("23456789") for _ in range(n))
    planted = {
        "email": lambda: f"{word()} (at) {word()} (dot) com", "phone": lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", "secret": lambda: "".join(
            r.choice("0123456789abcdef") for _ in range(40)
        ),
    }
    shown = {"email": "write to {}", "phone": "please call {}", "secret": 'token = "{}"'}
    rows, want = [], {}
    for i in range(240):
        kind = list(planted)[i % 3]
        value = planted[kind]()
        text = f"{word()} {word()} " + shown[kind].format(value) + f" and {word()}"
        at = text.index(value)
        rows.append((i, text))
        want[i] = f"{kind}:{at}:{at + len(value)}"
    strict = [(1000 + i, f"{word()}@{word()}.org +1 ({digits(3)}) 555-{digits(4)} and 10.{i}.3.4") for i in range(60)]
    decoys = [
        (
            2000 + i,
            f"{word()} isbn {digits(3)} {digits(1)} {digits(2)} {digits(6)} section 1.2.3.999 {word()} 1234 5678 9012 3456 password: please hash {word()}{word()}{word()}{word()}{word()}"
        ) for i in range(60)
    ]
    got = {
        x["doc_id"]: set(filter(None, x["spans"].split(","))) for x in pii.find(
            spark.createDataFrame(rows + strict + decoys, "doc_id long, text string")
        ).collect()
    }
    found = sum(got[i] == {w} for i, w in want.items())
    assert found >= 0.95 * len(want), (found, next((rows[i], got[i], w) for i, w in want.items() if got[i] != {w}))
    assert all(len(got[d]) == 3 for d, _ in strict)
    assert sum(bool(got[d]) for d, _ in decoys) <= 3, [got[d] for d, _ in decoys if got[d]][:3]


def test_secrets_of_the_given_tables(spark):
    """Precision and recall on the values that the tables call tokens."""
    import os
    import re

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("tables are not here")
    named = re.compile(r'token = "([0-9a-f]{40})"')
    docs_ = spark.read.parquet(path)
    want = {
        (
            r["doc_id"], f"secret:{m.start(1)}:{m.end(1)}"
        ) for r in docs_.select("doc_id", "text").collect() for m in named.finditer(r["text"] or "")
    }
    got = {(r["doc_id"], s) for r in pii.find(docs_).collect() for s in r["spans"].split(",") if s.startswith("secret")}
    assert want and got == want


def test_quality_counts(docs, docs_rows, labels):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality.score(docs, labels)
    same(got, columns, plain.quality(docs_rows))
    assert got.filter("base_failed AND kept").count() == 0


def test_quality_scores_by_brute_force(spark, docs, labels):
    """Buckets come from Spark's hash; sums and ratios are redone here."""
    small = docs.filter(F.length("text") < 2000)
    hashed = small.select("doc_id", quality.words(F.col("text")).alias("w")).withColumn(
        "u", F.transform("w", lambda x: F.pmod(F.xxhash64(x), F.lit(quality.BUCKETS)))
    )
    hashed = hashed.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn(
        "p",
        F.zip_with(
            F.expr("slice(h, 1, greatest(size(h) - 1, 0))"), F.expr("slice(h, 2, greatest(size(h) - 1, 0))"),
            lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(quality.BUCKETS))
        )
    )
    rows = [(r["doc_id"], list(r["u"]) + list(r["p"])) for r in hashed.collect()]
    trusted = {
        r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"] and r["doc_id"] is not None
    }
    raw, target = Counter(), Counter()
    for d, g in rows:
        raw.update(g)
        target.update(g if d in trusted else ())
    n, m = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    weight = lambda b: round(math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n), quality.DIGITS)
    want = sorted(round(sum(map(weight, g)) / max(len(g), 1), 9) for _, g in rows)
    got = sorted(round(r["score"], 9) for r in quality.score(small, labels).collect())
    assert np.allclose(got, want, atol=1e-8)


def test_quality_verdicts_by_brute_force(spark, docs, labels):
    """Thresholds from all labelled rows, by trying every cut between two scores; verdicts follow from them."""
    rows = quality.score(docs, labels).collect()
    marks = {}
    for r in labels.filter("doc_id IS NOT NULL").collect():
        bad, toxic, good = marks.get(r["doc_id"], (0, 0, 0))
        marks[r["doc_id"]] = max(bad, r["quality"] == 0), max(toxic, r["toxic"] == 1), max(
            good, r["quality"] == 1 and not r["toxic"]
        )
    judged = [(r["score"], *marks[r["doc_id"]]) for r in rows if not r["base_failed"] and r["doc_id"] in marks]

    def gain(t):
        return sum(int(b) - quality.COST * int(g) for s, b, _, g in judged if s < t)

    cuts = [-math.inf, *(s for s, *_ in judged)]
    best = max(map(gain, cuts))
    lowest_kept = min(r["score"] for r in rows if r["kept"])
    assert all(
        r["kept"] == (
            not r["base_failed"] and r["score"] >= lowest_kept
        ) for r in rows if not marks.get(r["doc_id"], (0, 0, 0))[1]
    )
    assert gain(lowest_kept) == best


def test_documents_labelled_toxic_go(spark):
    """Labelled good and toxic, with a toxic word in a few places: they go, without a label too, and clean ones stay."""
    r = random.Random(17)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(300):
        w = [r.choice(vocabulary) for _ in range(120)]
        if toxic := i % 5 == 0:
            w[r.randrange(120)] = r.choice(["vile", "nasty"])
        rows.append((i, " ".join(w)))
        if i % 10 < 8:
            marks.append((i, 1, int(toxic)))
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {
        x["doc_id"] for x in quality.score(
            docs_, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
        ).collect() if x["kept"]
    }
    assert kept == {i for i in range(300) if i % 5}


def test_cut_by_a_histogram():
    assert quality.cut([]) == -math.inf and quality.cut([(0.0, 0.1, 0, 9)]) == -math.inf
    assert quality.cut([(0.0, 0.1, 3, 0), (0.5, 0.6, 1, 0), (2.0, 2.5, 5, 1)]) == 1.3
    assert quality.cut([(0.0, 0.1, 30, 1), (0.5, 0.6, 1, 9)]) == 0.3


def test_language_model(docs, docs_rows):
    rows = {}
    for r in lm.score(docs).collect():
        rows.setdefault((r["doc_id"], r["n_tokens"]), []).append(r)
    assert sum(map(len, rows.values())) == len(docs_rows)
    held = lambda d: crc32(("" if d is None else str(d)).encode()) % 10 == 0
    tokens = [(d, [*plain.low(t or "").encode().split(), None]) for d, t in docs_rows]
    c = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in tokens:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        known = sum(c[w] > 0 for w in ws)
        assert any(
            r["held_out"] == held(d) and r["n_known"] == known and r["train_tokens"] == n and math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isfinite(r["score"]) and r["score"] < 0 for r in rows[d, len(ws)]
        )


def test_language_model_scores_a_corpus(spark):
    """Held-out texts of a corpus with an order to learn score above their word frequencies, and one text's score is
    made up by hand.
    """
    r = random.Random(41)
    follow = {w: [r.choice(range(60)) for _ in range(3)] for w in range(60)}
    rows = []
    for i in range(250):
        w, out = r.randrange(60), []
        for _ in range(3000):
            out.append(f"word{w}")
            w = r.choice(follow[w])
        rows.append((i, " ".join(out)))
    docs_ = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = lm.score(docs_).collect()
    held = [x for x in got if x["held_out"]]
    assert len(held) > 10 and sum(x["score"] for x in held) > 0.9 * sum(x["base_score"] for x in held)
    keyed = lm._keyed(docs_)
    counts = Counter(w.encode() for i, t in rows if crc32(str(i).encode()) % 10 for w in t.split())
    n_docs = sum(crc32(str(i).encode()) % 10 != 0 for i, _ in rows)
    head = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    first = np.concatenate([[counts[w] for w in head], np.zeros(lm.HEAD - len(head)), [n_docs], np.zeros(lm.CLASSES)])
    p = lm.train(lm.as_symbols(keyed, head), first)
    for i in (0, 7, 200):
        h, last, total = np.zeros((1, lm.HIDDEN), np.float32), lm.END, 0.0
        for y in [*(head.index(w.encode()) for w in rows[i][1].split()), lm.END]:
            h, _ = lm.step(p, p["E"][[last]], h)
            total += float(lm.output(p, h, np.array([y]))[0][0]) / math.log(10)
            last = y
        assert math.isclose(next(x["score"] for x in got if x["doc_id"] == i), total, rel_tol=1e-4)


def test_language_model_spreads_probability_one():
    rng = np.random.default_rng(0)
    p = lm.start(rng.integers(1, 100, lm.SYMBOLS).astype(float))
    h = rng.normal(size=(1, lm.HIDDEN)).astype(np.float32)
    every = np.arange(lm.SYMBOLS)
    real = every[(every <= lm.END) | (every > lm.HEAD)]
    got, _ = lm.output(p, np.repeat(h, len(real), 0), real)
    assert abs(np.exp(got).sum() - 1) < 1e-4


def test_language_model_gradient_by_differences():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in lm.start(np.ones(lm.SYMBOLS)).items()}
    xs = [rng.integers(0, lm.SYMBOLS, 5), rng.integers(0, lm.SYMBOLS, 3)]
    ys = [rng.integers(0, lm.SYMBOLS, 5), rng.integers(0, lm.SYMBOLS, 3)]
    h0 = rng.normal(size=(5, lm.HIDDEN))

    def value():
        h, total = h0, 0.0
        for x, y in zip(xs, ys):
            h, _ = lm.step(p, p["E"][x], h[: len(x)])
            total += lm.output(p, h, y)[0].sum()
        return total

    grads, _, _ = lm.train_window(p, xs, ys, h0)
    c, _ = lm.class_slot(ys[0])
    for name, at in (
        ("U", (2, 5)), ("U", (1, 40)), ("E", (int(xs[0][0]), 3)), ("E", (int(xs[1][1]), 35)), ("C", (1, 2)),
        ("S", (int(c[0]), 2, 1))
    ):
        old = p[name][at]
        p[name][at] = old + 1e-5
        up = value()
        p[name][at] = old - 1e-5
        down = value()
        p[name][at] = old
        assert math.isclose(grads[name][at], (up - down) / 2e-5, rel_tol=1e-3, abs_tol=1e-6), name


def test_every_training_token_gives_a_gradient(monkeypatch):
    """Whatever the size: short documents, long ones, and more tokens than a switch by size would let through."""
    rng = np.random.default_rng(6)
    seen = []
    real = lm.train_window
    monkeypatch.setattr(lm, "train_window", lambda p, xs, ys, h: seen.append(sum(map(len, ys))) or real(p, xs, ys, h))
    for lengths in ([5] * 40, [300, 7, 64, 33], [32] * 600):
        seen.clear()
        trainer = lm.Trainer(lm.start(np.ones(lm.SYMBOLS)), 1)
        trainer.learn([rng.integers(0, lm.SYMBOLS, n).astype(np.int32) for n in lengths])
        assert sum(seen) == sum(lengths) == trainer.tokens and trainer.updates == len(seen)


def test_state_is_carried_through_a_document():
    rng = np.random.default_rng(2)
    p = lm.start(np.ones(lm.SYMBOLS))
    docs = [rng.integers(0, lm.SYMBOLS, n).astype(np.int32) for n in (700, 3, 90)]
    together = lm.log_likelihoods(p, docs)
    for d, got in zip(docs, together):
        h, last, total = np.zeros((1, lm.HIDDEN), np.float32), np.array([lm.END]), 0.0
        for y in d:
            h, _ = lm.step(p, p["E"][last], h)
            last = np.array([y])
            total += float(lm.output(p, h, last)[0][0])
        assert math.isclose(got, total / math.log(10), rel_tol=1e-4)


def test_languages(spark):
    import random

    r = random.Random(3)
    lex = {"en": "the and ing tion wh".split(), "fr": "eau le é ou ment".split(), "de": "ung sch ein ü keit".split()}
    rows = [
        (
            i, " ".join("".join(r.choice(lex[l]) for _ in range(2)) for _ in range(60)), l
        ) for i, l in enumerate(r.choice(list(lex)) for _ in range(240))
    ]
    rows += [
        (1000, None, "en"), (1001, "", "fr"), (1002, "123 !!", "de"), (1003, "theing", None),
        (None, "einung schkeit", None)
    ]
    out = {
        r_["doc_id"]: r_ for r_ in langid.predict(
            spark.createDataFrame(rows, "doc_id long, text string, lang string")
        ).collect()
    }
    assert len(out) == len(rows)
    held = [x for x in rows if x[0] is not None and x[0] < 1000 and out[x[0]]["held_out"]]
    assert held and sum(out[d]["lang_pred"] == l for d, _, l in held) >= 0.97 * len(held)
    assert all(out[d]["held_out"] == (crc32(("" if d is None else str(d)).encode()) % 4 == 2) for d in out)
    assert [out[d]["lang_pred"] for d in (1000, 1001, 1002)] == ["und"] * 3
    assert all(0 <= x["score"] <= 1 for x in out.values())


def test_languages_of_odd_rows(spark):
    """Very long texts, repeated rows, clashing columns; equal rows get equal results."""
    r = random.Random(43)
    lex = {"en": "the and ing tion wh".split(), "fr": "eau le ai ou ment".split()}
    make = lambda l, n: " ".join("".join(r.choice(lex[l]) for _ in range(2)) for _ in range(n))
    rows = [(i, make(l, 40), l, "clash", "clash") for i, l in enumerate(["en", "fr"] * 60)]
    long = make("fr", 60_000)
    rows += [
        (500, long, None, None, None), (500, long, None, None, None), (501, "z" * 300_000, None, None, None),
        (502, make("en", 5) + " " + make("fr", 400), "de", None, None)
    ]
    got = langid.predict(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string, score string")
    ).collect()
    assert len(got) == len(rows) and langid.predict(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string, score string")
    ).columns == ["doc_id", "held_out", "lang_pred", "score"]
    by = {x["doc_id"]: x for x in got}
    assert by[500]["lang_pred"] == by[502]["lang_pred"] == "fr" and by[501]["lang_pred"] in ("en", "fr", "de")
    assert len({(x["lang_pred"], x["score"]) for x in got if x["doc_id"] == 500}) == 1


def test_long_texts_give_a_bounded_part_to_the_sample(spark):
    rows = [(i, "abc " * 100_000, "en") for i in range(3)] + [(10, "short", "fr")]
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {lang for _, lang in got} == {"en", "fr"} and max(len(t) for t, _ in got) == langid.SAMPLE_CHARS


def test_every_label_is_sampled(spark):
    rows = [(i, f"word{i % 90}", f"l{i % 90}") for i in range(900)]
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {lang for _, lang in got} == {lang for _, _, lang in rows}


def test_runs_without_spaces_count_to_their_last_letter():
    import random

    r = random.Random(23)
    lex = {"en": "the and ing tion wh".split(), "fr": "eau le ai ou ment".split()}
    make = lambda l, n, between=" ": between.join("".join(r.choice(lex[l]) for _ in range(2)) for _ in range(n))
    f = langid.fit([(make(l, 200), l) for l in lex for _ in range(10)])
    for first, then in (("en", "fr"), ("fr", "en")):
        text = make(first, 6, "") + make(then, 300, "")
        tokens = langid.words(text)
        assert "".join(tokens) == text and max(map(len, tokens)) <= langid.PIECE
        g = langid.forward_backward(f.scores([tokens]), f.move)[0]
        assert f.langs[int(g.mean(0).argmax())] == then
    assert langid.words("Two words, " + "x" * 24) == ["two", "words", "x" * 24]


def test_code_switched_words_follow_their_language():
    import random

    r = random.Random(5)
    lex = {"en": "the and ing tion wh".split(), "fr": "eau le ai ou ment".split()}
    make = lambda l, n: " ".join("".join(r.choice(lex[l]) for _ in range(2)) for _ in range(n))
    f = langid.fit([(make(l, 200), l) for l in lex for _ in range(10)])
    tokens = langid.words(make("en", 30) + " " + make("fr", 30))
    g = langid.forward_backward(f.scores([tokens]), f.move)[0]
    assert (g[:30].argmax(1) == f.langs.index("en")).mean() > 0.9 and (
        g[30:].argmax(1) == f.langs.index("fr")
    ).mean() > 0.9


def test_forward_backward_by_enumeration():
    import itertools

    rng = np.random.default_rng(4)
    e, move = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    want = np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        p = math.exp(sum(e[t, s] for t, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        for t, s in enumerate(path):
            want[t, s] += p
    want /= want.sum(1, keepdims=True)
    got = langid.forward_backward([e[:2], e, e[:0]], move)
    assert np.allclose(got[1], want, atol=1e-5) and got[2].shape[0] == 0


@pytest.mark.parametrize("run", [
    lambda d, i, l: decontam.judged(decontam.find(d, i)), lambda d, i, l: bpe.encode_decode(d), lambda d, i, l: token_counts.count_tokens(d), lambda d, i, l: line_dedup.apply(d, line_dedup.keep_bitmaps(d)),
    lambda d, i, l: substring_dedup.remove(d, substring_dedup.repeats(d)), lambda d, i, l: minhash.near_duplicates(d), lambda d, i, l: pii.find(d), lambda d, i, l: langid.predict(d),
    lambda d, i, l: quality.score(d, l), lambda d, i, l: lm.score(d),
], ids="decontam bpe counts lines substrings minhash pii langid quality lm".split())
def test_empty_tables(run, empty, items, labels):
    assert run(empty, items.limit(0), labels.limit(0)).collect() == []
    assert run(empty, items, labels).collect() == []


def test_empty_benchmark_and_labels(docs, docs_rows, items, labels):
    assert decontam.judged(decontam.find(docs, items.limit(0))).filter(
        "n_hit > 0 OR contaminated OR n_items > 0"
    ).count() == 0
    got = quality.score(docs, labels.limit(0))
    assert got.count() == len(docs_rows) and got.filter("score <> 0").count() == 0
