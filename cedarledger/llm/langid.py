"""Language identification by a linear-chain conditional random field over words.

Each word of a text gets a language; a run of more than PIECE letters, as in scripts without spaces, counts as consecutive
words of PIECE letters, so every letter gives features. Neighbours are tied by learned transitions, so code-switched text is labelled word by
word. A word's features are its affixes, its character n-grams and lexicon entries (frequent words of the fitting sample),
hashed into a table of fixed size. Marginals come from forward-backward; a document's language is the one with the largest
share of posterior mass over its words, and that share is the score.

The field is fitted on a bounded sample of labelled rows: at most about SAMPLE documents a language, drawn by a hash of
doc_id from the rows meant for learning, and of a text longer than SAMPLE_CHARS a part of that length, from a place drawn by
hash. Prediction covers every word of every text.

A null text or one without a letter gives und and score 0; a table without labelled rows gives und everywhere. One result
per input row, repeated rows included; null doc_id counts as an empty key; extra columns are ignored.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SAMPLE = 100  # documents a language, expected
SAMPLE_CHARS = 100_000  # of a document of the sample, at most
DIM = 1 << 15
LEXICON = 300  # words a language
SEGMENT = 64  # words of one training sequence
PIECE = 24
_WORD = re.compile(r"[^\W\d_]{1,%d}" % PIECE)
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def words(text: str) -> list[str]:
    """Runs of letters; numerals such as fractions or digits in circles, which the pattern takes too, part them."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


class Hashed(dict):
    """Place of a feature in the table."""

    def __missing__(self, name: str) -> int:
        place = crc32(name.encode()) % DIM
        if len(self) < 400_000:
            self[name] = place
        return place


def feature_ids(word: str, lexicon: frozenset[str], hashed: Hashed) -> list[int]:
    """Hashed: two affixes at each end, 1- to 3-grams, the word if the lexicon has it."""
    w = f"^{word}$"
    n = len(w)
    names = ["p" + word[:2], "p" + word[:3], "s" + word[-2:], "s" + word[-3:], *w]
    names += [w[i : i + 2] for i in range(n - 1)]
    names += [w[i : i + 3] for i in range(n - 2)]
    if word in lexicon:
        names.append("=" + word)
    return list(map(hashed.__getitem__, names))


class Numbers(dict):
    """Numbers of words in the order in which they are met; new holds those that nobody has looked at."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i


class Field:
    """Emission weights by feature and language, transitions, languages."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, langs: list[str], lexicon: frozenset[str]):
        self.emit, self.move, self.langs, self.lexicon = emit, move, langs, lexicon
        self.hashed, self.numbers, self.rows = Hashed(), Numbers(), np.zeros((0, len(langs)), np.float32)

    def _look(self) -> None:
        """Scores of the new words."""
        if new := self.numbers.new:
            ids = [feature_ids(w, self.lexicon, self.hashed) for w in new]
            sizes = np.array([len(x) for x in ids])
            flat = np.fromiter((i for x in ids for i in x), np.int64, sizes.sum())
            sums = np.add.reduceat(self.emit[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)
            self.rows = np.concatenate([self.rows, (sums / np.sqrt(sizes)[:, None]).astype(np.float32)])
            self.numbers.new = []

    def scores(self, docs: list[list[str]]) -> list[np.ndarray]:
        if len(self.numbers) > 600_000:
            self.numbers, self.rows = Numbers(), self.rows[:0]
        at = [np.fromiter(map(self.numbers.__getitem__, d), np.int64, len(d)) for d in docs]
        self._look()
        return [self.rows[i] for i in at]


def forward_backward(scores: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """Marginals of each sequence. Sequences advance together, longest first, so a step is one array operation."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    if not len(lengths) or not lengths[0]:
        return [np.zeros((0, move.shape[0])) for _ in scores]
    steps, k = int(lengths[0]), move.shape[0]
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t
    starts = np.concatenate(([0], np.cumsum(active)))
    e = np.empty((starts[-1], k), np.float32)
    for r, i in enumerate(order):
        e[starts[: lengths[r]] + r] = np.exp(scores[i] - scores[i].max(1, keepdims=True)) if len(scores[i]) else 0
    m = np.exp(move - move.max()).astype(np.float32)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    for t in range(steps):
        n = active[t]
        a = e[starts[t] : starts[t] + n]
        if t:
            a = a * (alpha[starts[t - 1] : starts[t - 1] + n] @ m)
        alpha[starts[t] : starts[t] + n] = a / a.sum(1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        b = (beta[starts[t + 1] : starts[t + 1] + n] * e[starts[t + 1] : starts[t + 1] + n]) @ m.T
        beta[starts[t] : starts[t] + n] = b / b.sum(1, keepdims=True)
    g = alpha * beta
    g /= g.sum(1, keepdims=True)
    out: list[np.ndarray] = [None] * len(scores)
    for r, i in enumerate(order):
        out[i] = g[starts[: lengths[r]] + r]
    return out


def fit(rows: list[tuple[str, str]], epochs: int = 2, seed: int = 5) -> Field:
    """Stochastic gradient on the conditional likelihood. Training sequences join segments of two documents, so
    transitions between languages are seen.
    """
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    cut: list[tuple[list[str], int]] = []
    counts: list[dict[str, int]] = [{} for _ in langs]
    for text, lang in rows:
        tokens, y = words(text), langs.index(lang)
        for w in tokens:
            counts[y][w] = counts[y].get(w, 0) + 1
        cut += [(tokens[i : i + SEGMENT // 2], y) for i in range(0, len(tokens), SEGMENT // 2)]
    lexicon = frozenset(w for c in counts for w in sorted(c, key=lambda w: (-c[w], w))[:LEXICON])
    emit, move = np.zeros((DIM, len(langs)), np.float32), np.zeros((len(langs), len(langs)))
    hashed = Hashed()
    seen = {w: feature_ids(w, lexicon, hashed) for c in counts for w in c}
    for _ in range(epochs if len(langs) > 1 else 0):
        order = rng.permutation(len(cut))
        for at in range(0, len(order), 64):
            part = [cut[i] for i in order[at : at + 64]]
            seqs = [
                (a[0] + b[0], [a[1]] * len(a[0]) + [b[1]] * len(b[0])) for a, b in zip(part[::2], part[1::2])
            ] or part and [(part[0][0], [part[0][1]] * len(part[0][0]))]
            ids = [[seen[w] for w in s] for s, _ in seqs]
            scores = [np.array([emit[f].sum(0) / np.sqrt(len(f)) for f in x]).reshape(-1, len(langs)) for x in ids]
            grams = forward_backward(scores, move)
            total = sum(len(x) for x in ids) or 1
            push = np.zeros_like(move)
            for x, (s, y), g in zip(ids, seqs, grams):
                d = -g
                d[np.arange(len(y)), y] += 1
                flat = [f for fs in x for f in fs]
                reps = [len(fs) for fs in x]
                if flat:
                    np.add.at(emit, flat, np.repeat(d / np.sqrt(np.array(reps))[:, None], reps, axis=0) * (0.5 / 8))
                for a, b, p, q in zip(y, y[1:], g, g[1:]):
                    push[a, b] += 1
                    pair = np.outer(p, q) * np.exp(move)
                    push -= pair / pair.sum()
            move += 2.0 * push / total
    return Field(emit, move, langs, lexicon)


def _remainder():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4


def sample(docs: DataFrame, per_language: int = SAMPLE) -> list[tuple[str, str]]:
    """A bounded number of labelled rows for fitting, about per_language of each label; never a row that is held out."""
    known = docs.select("doc_id", "text", "lang").filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (_remainder() != 2)
    )
    # every label is a language
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    space = 1 << 20
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(space))
    shares = docs.sparkSession.createDataFrame(
        [(lang, max(1, round(space * min(1.0, per_language / n)))) for lang, n in sizes.items()],
        "lang string, _below long"
    )
    n = F.length("text")
    part = F.when(
        n > SAMPLE_CHARS,
        F.substring("text", (F.pmod(F.xxhash64("text"), n - SAMPLE_CHARS) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    ).otherwise(F.col("text"))
    met = known.join(F.broadcast(shares), "lang").filter(drawn < F.col("_below"))
    # a doc_id that many rows share is drawn with all of them; the first by hash of their text stay within the bound
    rows = met.orderBy(drawn, F.xxhash64("text"), "lang").select(part.alias("text"), "lang", "doc_id").limit(2 * per_language * len(sizes)).collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"] or 0, r["text"]))]


def predict(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    field = fit(sample(docs, per_language))
    shared = docs.sparkSession.sparkContext.broadcast((field.emit, field.move, field.langs, field.lexicon))

    def run(batches):
        f = Field(*shared.value)
        for batch in batches:
            keys, held, texts = batch.column(0), batch.column(1), batch.column(2)
            at = 0
            while at < len(texts):
                start, size, docs_ = at, 0, []
                while at < len(texts) and size < 400_000:
                    docs_.append(words(texts[at].as_py() or "") if f.langs else [])
                    size += len(docs_[-1])
                    at += 1
                grams = forward_backward(f.scores(docs_), f.move) if f.langs else docs_
                lang, score = [], []
                for g in grams:
                    p = g.mean(0) if len(g) else None
                    lang.append(f.langs[int(p.argmax())] if p is not None else "und")
                    score.append(float(min(1.0, p.max())) if p is not None else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(start, at - start), held.slice(start, at - start), pa.array(lang, pa.string()),
                        pa.array(score, pa.float64())
                    ],
                    ["doc_id", "held_out", "lang_pred", "score"]
                )

    return docs.select("doc_id", (_remainder() == 2).alias("held_out"), "text").mapInArrow(run, SCHEMA)
