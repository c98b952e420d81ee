"""Language-model scoring: a gated recurrent network with a class-factored softmax, written in numpy.

Counts. Every task sends the distinct words of its documents, with training counts and postings, to the bucket of the
word. A bucket sums a word's count first and then turns postings into one partial sum per document, so counts, sums of
log counts and the numbers of known words cover the whole corpus exactly. Of words that many documents of a batch have, the
bucket is only asked for the count: their postings go straight to where the batch's sums meet, so no bucket gets large.

Model. The HEAD most frequent words and the end have symbols of their own; every other word belongs to one of CLASSES
tails by its last two characters. A symbol's probability is P(class | state) P(slot | class, state), both softmax layers
over a gated recurrent state; the last slot of a class is its tail, in which a word has (c + 0.1) / D, with D the
tail's sum over all its words plus the pseudo-count of one unknown word (singletons of the corpus divided by CLASSES).
So the model spreads probability 1 over the known words and one unknown word per tail.

Training. Each task trains a copy of the network on all its training documents, from the same start: truncated
backpropagation over windows of WINDOW tokens, the state carried from window to window through each document, a gradient
taken in every window, and every document gone through once, whatever the input's size. The copies are averaged, weighted by
tokens, in a tree; the number of copies grows with the input.

Scoring carries the state through the whole of each document, whatever its length.

Null texts are empty: one token, the end. A null doc_id has the empty key. Without training documents all counts are 0.
Repeated rows each get their result, and each counts when training. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .exchange import added, by_bucket, documents, in_order, next_row_ids, pack, partitions, stored, text_key, thinned, together, unpack
from .token_counts import OFTEN, dealt, postings

CLASSES = 64
SLOTS = 17  # head words of a class, then its tail
HEAD = CLASSES * (SLOTS - 1) - 1  # the end has a slot too
HIDDEN = 16
WINDOW = 32
GROUP = 512  # documents trained on side by side, of about one length
RATE = 0.01
BATCH_BYTES = 16 << 20
TREE = 16  # copies that one task adds up
BATCH_TOKENS = 6_000_000  # of the documents whose states advance together
SYMBOLS = HEAD + 1 + CLASSES
END = HEAD


def tail_class(word: bytes) -> int:
    return crc32(word.decode("utf-8")[-2:].encode("utf-8")) % CLASSES


class Symbols(dict):
    """Symbol of a word: its rank in the head, or HEAD + 1 + its tail class."""

    def __init__(self, head: list[bytes], most: int = 600_000):
        super().__init__((w, i) for i, w in enumerate(head))
        self.most = most

    def __missing__(self, word: bytes) -> int:
        s = HEAD + 1 + tail_class(word)
        if len(self) < self.most:
            self[word] = s
        return s

    def of(self, words: list[bytes]) -> np.ndarray:
        """With the end."""
        out = np.empty(len(words) + 1, np.int32)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        out[-1] = END
        return out


def class_slot(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    tail = symbol > HEAD
    return np.where(tail, symbol - HEAD - 1, symbol % CLASSES), np.where(tail, SLOTS - 1, symbol // CLASSES)


# ---- the network


def start(symbol_counts: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Small random weights; output biases that give the symbols their frequencies."""
    rng = np.random.default_rng(seed)
    share = np.zeros((CLASSES, SLOTS)) + 0.5
    c, s = class_slot(np.arange(SYMBOLS))
    share[c, s] += symbol_counts
    f = np.float32
    return {
        "E": (rng.normal(size=(SYMBOLS, 3 * HIDDEN)) * 0.3).astype(f),
        "U": (rng.normal(size=(HIDDEN, 3 * HIDDEN)) / math.sqrt(HIDDEN)).astype(f),
        "C": (rng.normal(size=(HIDDEN, CLASSES)) * 0.02).astype(f),
        "c": np.log(share.sum(1) / share.sum()).astype(f),
        "S": (rng.normal(size=(CLASSES, HIDDEN, SLOTS)) * 0.02).astype(f),
        "s": np.log(share / share.sum(1, keepdims=True)).astype(f),
    }


def step(p: dict, e: np.ndarray, h: np.ndarray):
    """One token further, by the token's row of E: new state and what its gradient needs."""
    a = h @ p["U"]
    zr = e[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]
    np.negative(zr, out=zr)
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    an = a[:, 2 * HIDDEN :]
    n = zr[:, HIDDEN:] * an
    n += e[:, 2 * HIDDEN :]
    np.tanh(n, out=n)
    new = h - n
    new *= zr[:, :HIDDEN]
    new += n
    return new, (zr, an, n)


def by_class(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = c.astype(np.int16)  # sorted by radix
    order = np.argsort(c, kind="stable")
    return order, np.searchsorted(c[order], np.arange(CLASSES + 1))


def _softmax_at(w: np.ndarray, bias: np.ndarray, h: np.ndarray, at: np.ndarray, grad: bool):
    """Log softmax of h at one place of each row; with grad, one-hot less softmax. Classes are rows here, so maxima and
    sums run along memory.
    """
    logits = w.T @ h.T
    logits += bias[:, None]
    logits -= logits.max(0)
    rows = np.arange(len(at))
    out = logits[at, rows]
    np.exp(logits, out=logits)
    total = logits.sum(0)
    out -= np.log(total)
    if not grad:
        return out, None
    logits *= -1 / total
    logits[at, rows] += 1
    return out, logits


def output(p: dict, h: np.ndarray, y: np.ndarray, grads: dict | None = None):
    """Natural log probability of symbols y after states h; with grads, adds to them and gives the gradient by h."""
    c, s = class_slot(y)
    out, soft = _softmax_at(p["C"], p["c"], h, c, grads is not None)
    dh = None
    if grads is not None:
        grads["C"] += (soft @ h).T
        grads["c"] += soft.sum(1)
        dh = (p["C"] @ soft).T.copy()
    order, ends = by_class(c)
    sorted_h, sorted_s, inner, inner_dh = h[order], s[order], np.empty(len(y), out.dtype), np.empty_like(h)
    for k in range(CLASSES):
        lo, hi = ends[k], ends[k + 1]
        if lo < hi:
            hk = sorted_h[lo:hi]
            inner[lo:hi], soft = _softmax_at(p["S"][k], p["s"][k], hk, sorted_s[lo:hi], grads is not None)
            if grads is not None:
                grads["S"][k] += (soft @ hk).T
                grads["s"][k] += soft.sum(1)
                np.matmul(soft.T, p["S"][k].T, out=inner_dh[lo:hi])
    out[order] += inner
    if grads is not None:
        dh[order] += inner_dh
    return out, dh


def packed_steps(symbols: list[np.ndarray]):
    """Documents longest first, as steps: order, and symbols of step t over the documents that are that long."""
    order = sorted(range(len(symbols)), key=lambda i: -len(symbols[i]))
    lengths = np.array([len(symbols[i]) for i in order])
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")
    starts = np.concatenate(([0], np.cumsum(active)))
    flat = np.empty(starts[-1], np.int32)
    for r, i in enumerate(order):
        flat[starts[: lengths[r]] + r] = symbols[i]
    return order, active, starts, flat


def train_window(p: dict, xs: list[np.ndarray], ys: list[np.ndarray], h: np.ndarray) -> tuple[dict, np.ndarray, int]:
    """Gradient of the log likelihood over one window from state h; the state after it."""
    x = np.concatenate(xs)
    e = p["E"].take(x, axis=0)
    ends = np.cumsum([len(x) for x in xs]).tolist()
    befores, news, kept = [], [], []
    for n, end in zip(map(len, xs), ends):
        h = h[:n]
        befores.append(h)
        h, k = step(p, e[end - n : end], h)
        news.append(h)
        kept.append(k)
    grads = views(np.zeros(sum(v.size for v in p.values()), p["U"].dtype), p)
    _, dout = output(p, np.concatenate(news), np.concatenate(ys), grads)
    # what a step's gradient is multiplied by doesn't depend on other steps: made at once
    before, zr, an, new = np.concatenate(befores), *(np.concatenate(k) for k in zip(*kept))
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    by_new = (1 - z) * (1 - new * new)
    # of update, reset, candidate
    by = np.stack([(before - new) * z * (1 - z), by_new * an * r * (1 - r), by_new], axis=1)
    back = by.copy()
    back[:, 2] *= r
    turned = np.ascontiguousarray(p["U"].T)
    dh = None
    for n, end in zip(map(len, xs[::-1]), ends[::-1]):
        at = slice(end - n, end)
        d = dout[at]
        if dh is not None:
            d[: len(dh)] += dh
        dh = (back[at] * d[:, None]).reshape(n, 3 * HIDDEN) @ turned
        dh += d * z[at]
    grads["U"] += before.T @ (back * dout[:, None]).reshape(len(x), 3 * HIDDEN)
    d = (by * dout[:, None]).reshape(len(x), 3 * HIDDEN)
    order = np.argsort(x.astype(np.uint16), kind="stable")  # sorted by radix
    at = np.flatnonzero(np.concatenate(([True], np.diff(x[order]) > 0)))
    grads["E"][x[order][at]] = np.add.reduceat(d[order], at, axis=0)
    return grads, h, len(x)


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def views(x: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Parts of one vector in the shapes of like, in its order."""
    ends = np.cumsum([v.size for v in like.values()]).tolist()
    return {k: x[end - v.size : end].reshape(v.shape) for (k, v), end in zip(like.items(), ends)}


class Trainer:
    """Adam on one copy."""

    def __init__(self, p: dict[str, np.ndarray], seed: int):
        self.flat = flat(p)
        self.p = views(self.flat, p)
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.rng = np.random.default_rng(seed)
        self.updates = self.tokens = 0

    def learn(self, docs: list[np.ndarray]) -> None:
        """Documents of about one length go side by side, the groups in random order."""
        order = np.argsort([len(d) for d in docs], kind="stable")
        groups = [order[at : at + GROUP] for at in range(0, len(docs), GROUP)]
        for g in self.rng.permutation(len(groups)):
            self._group([docs[i] for i in groups[g]])

    def _group(self, docs: list[np.ndarray]) -> None:
        _, active, starts, flat = packed_steps(docs)
        h = np.zeros((len(docs), HIDDEN), np.float32)
        last = np.full(len(docs), END, np.int32)
        for t0 in range(0, len(active), WINDOW):
            ys = [flat[starts[t] : starts[t + 1]] for t in range(t0, min(t0 + WINDOW, len(active)))]
            xs = [last[: len(ys[0])], *(a[: len(b)] for a, b in zip(ys, ys[1:]))]
            grads, h, n = train_window(self.p, xs, ys, h)
            self._update(grads, n)
            last = ys[-1]
        self.tokens += len(flat)

    def _update(self, grads: dict, n: int) -> None:
        self.updates += 1
        i = self.updates
        g = flat(grads)
        g /= n
        self.m *= 0.9
        self.m += 0.1 * g
        self.v *= 0.99
        g *= g
        g *= 0.01
        self.v += g
        np.multiply(self.v, 1 / (1 - 0.99**i), out=g)
        np.sqrt(g, out=g)
        g += 1e-6
        np.divide(self.m, g, out=g)
        g *= RATE / (1 - 0.9**i)
        self.flat += g


def log_likelihoods(p: dict, docs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each document's symbols; the state runs through the whole document."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    order, active, starts, flat = packed_steps(docs)
    h = np.zeros((len(docs), HIDDEN), np.float32)
    sums = np.zeros(len(docs))
    last = np.full(len(docs), END, np.int32)
    held, size, t0 = [], 0, 0
    for t in range(len(active)):
        y = flat[starts[t] : starts[t + 1]]
        h, _ = step(p, p["E"].take(last[: len(y)], axis=0), h[: len(y)])
        last = y
        held.append(h)
        size += len(y)
        if size >= 32_768 or t + 1 == len(active):
            got, _ = output(p, np.concatenate(held), flat[starts[t0] : starts[t + 1]])
            rows = np.concatenate([np.arange(len(x)) for x in held])
            sums += np.bincount(rows, weights=got, minlength=len(docs))
            held, size, t0 = [], 0, t + 1
    out[order] = sums / math.log(10)
    return out


# ---- over a corpus


def _keyed(docs: DataFrame) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return documents(docs, "doc_id", "text").select(
        "doc_id", text_key().alias("text_key"), held.alias("held_out"), "text"
    )


def _slices(batch: pa.RecordBatch):
    """Row range and lower-cased words (A-Z only) of each, a bounded number of bytes at a time."""
    texts, at = batch.column(3), 0
    while at < len(texts):
        start_, size, out = at, 0, []
        while at < len(texts) and size < BATCH_BYTES:
            t = texts[at].as_py().encode("utf-8")
            size += len(t)
            out.append(t.lower().split())
            at += 1
        yield start_, out


def as_symbols(keyed: DataFrame, head: list[bytes]) -> DataFrame:
    """doc_id, text_key, held_out, symbols (16 bits each): made once, read by training and by scoring."""
    shared = keyed.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        symbols = Symbols(shared.value)
        for batch in batches:
            texts, at = batch.column(3), 0
            while at < len(texts):
                begin, size, out = at, 0, []
                while at < len(texts) and size < BATCH_BYTES:  # one document's words at a time
                    out.append(
                        symbols.of(texts[at].as_py().encode("utf-8").lower().split()).astype(np.uint16).tobytes()
                    )
                    size += 2 * len(out[-1])
                    at += 1
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(begin, at - begin) for i in range(3)), pa.array(out, pa.binary())],
                    ["doc_id", "text_key", "held_out", "symbols"]
                )

    return stored(keyed.mapInArrow(run, "doc_id long, text_key long, held_out boolean, symbols binary"))


def _symbol_slices(batches):
    """Fields of some rows and the symbols of each, over batches: rows are gathered until they have BATCH_TOKENS tokens.
    """
    fields: list[list] = [[], [], []]
    docs, size = [], 0
    for batch in batches:
        *values, symbols = (c.to_pylist() for c in batch.columns)
        for row, x in enumerate(symbols):
            docs.append(np.frombuffer(x, np.uint16).astype(np.int32))
            size += len(docs[-1])
            for f, v in zip(fields, values):
                f.append(v[row])
            if size >= BATCH_TOKENS:
                yield fields, docs
                fields, docs, size = [[], [], []], [], 0
    if docs:
        yield fields, docs


SPREAD = "bucket int, second boolean, chunk long, words binary, counts binary, spread binary, docs binary, freqs binary, asked binary, ids array<long>, keys array<long>"
SPREAD_NAMES = ["bucket", "second", "chunk", "words", "counts", "spread", "docs", "freqs", "asked", "ids", "keys"]
SPREAD_TYPES = [pa.int32(), pa.bool_(), pa.int64(), *[pa.binary()] * 6, pa.list_(pa.int64()), pa.list_(pa.int64())]
# Of a chunk: sums of its documents, its document list, its frequent words' postings, counts that it asked for. Of a
# bucket: totals by tail class, one of its most frequent words
COUNTED = "chunk long, of binary, logs binary, known binary, ids array<long>, keys array<long>, spread binary, docs binary, freqs binary, asked binary, counts binary, tails array<double>, word binary, n long"
COUNTED_NAMES = [
    "chunk", "of", "logs", "known", "ids", "keys", "spread", "docs", "freqs", "asked", "counts", "tails", "word", "n"
]
COUNTED_TYPES = [
    pa.int64(), *[pa.binary()] * 3, pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 5,
    pa.list_(pa.float64()), pa.binary(), pa.int64()
]


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names
    )


def _named(rows: list[dict], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return _rows([tuple(map(r.get, names)) for r in rows], names, types)


def _sums(per: np.ndarray, docs: np.ndarray, freqs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By document: sum of log10(count + 0.1) and number of known words, from postings in order of their words, per of
    each.
    """
    per = per.astype(np.int64)
    return np.bincount(
        docs, weights=np.repeat(np.log10(counts + 0.1), per) * freqs
    ), np.bincount(docs, weights=np.repeat(counts > 0, per) * freqs).astype(np.int64)


def count_words(keyed: DataFrame) -> DataFrame:
    """Rows of COUNTED, computed once."""
    n_buckets = partitions(keyed.sparkSession)

    def spread(batches):
        ids = next_row_ids()
        for batch in batches:
            held = np.array(batch.column(2).to_pylist(), bool)
            for first, texts in _slices(batch):
                chunk, n = next(ids), len(texts)
                words, word_of, doc_of, freq = postings(texts)
                counts = np.bincount(
                    word_of, weights=freq * ~held[first : first + n][doc_of], minlength=len(words)
                ).astype(np.uint64)
                often = np.bincount(word_of, minlength=len(words)) * OFTEN > n
                of_often = often[word_of]
                rank = np.cumsum(often) - 1  # of a frequent word among the batch's
                own = slice(first, first + n)
                rows = [
                    {
                        "bucket": chunk % n_buckets, "second": True, "chunk": chunk,
                        "ids": batch.column(0)[own].to_pylist(), "keys": batch.column(1)[own].to_pylist()
                    }
                ]
                if often.any():
                    w, d, f = word_of[of_often], doc_of[of_often], freq[of_often]
                    by = in_order(w)
                    per = np.bincount(rank[w], minlength=int(often.sum()))
                    rows.append(
                        {
                            "bucket": chunk % n_buckets, "second": True, "chunk": chunk, "spread": pack(per),
                            "docs": pack(d[by]), "freqs": pack(f[by])
                        }
                    )
                left, doc_left, freq_left = word_of[~of_often], doc_of[~of_often], freq[~of_often]
                for b, at, per_word, by in dealt(words, left, n_buckets):
                    row = {"bucket": b, "chunk": chunk}
                    rows.append(
                        row | {"second": False, "words": b"\n".join([words[i] for i in at]), "counts": pack(counts[at])}
                    )
                    rare, common = at[~often[at]], at[often[at]]
                    if len(rare):
                        rows.append(
                            row | {
                                "second": True, "words": b"\n".join([words[i] for i in rare]),
                                "spread": pack(per_word[~often[at]]), "docs": pack(doc_left[by]),
                                "freqs": pack(freq_left[by])
                            }
                        )
                    if len(common):
                        rows.append(
                            row | {
                                "second": True, "words": b"\n".join([words[i] for i in common]),
                                "asked": pack(rank[common])
                            }
                        )
                for i in range(0, len(rows), 64):
                    yield _named(rows[i : i + 64], SPREAD_NAMES, SPREAD_TYPES)

    def count(batches):
        """First the counts of all words of the partition, then their postings."""
        known: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not r["second"]:
                    for w, n in zip(r["words"].split(b"\n"), unpack(r["counts"]).tolist()):
                        known[w] = known.get(w, 0) + n
                    continue
                if r["words"] is None:  # a document list, or postings of the chunk's frequent words
                    out.append({k: r[k] for k in ("chunk", "ids", "keys", "spread", "docs", "freqs")})
                    continue
                c = np.fromiter(map(known.__getitem__, r["words"].split(b"\n")), np.int64)
                if r["asked"] is not None:
                    out.append({"chunk": r["chunk"], "asked": r["asked"], "counts": pack(c)})
                else:
                    of, (logs, n_known) = thinned(
                        unpack(r["docs"]), *_sums(unpack(r["spread"]), unpack(r["docs"]), unpack(r["freqs"]), c)
                    )
                    out.append({"chunk": r["chunk"], "of": of, "logs": logs.tobytes(), "known": pack(n_known)})
            yield _named(out, COUNTED_NAMES, COUNTED_TYPES)
        if known:
            tails = np.zeros((3, CLASSES))  # sum of counts, distinct words, words met once
            for w, n in known.items():
                if n:
                    k = tail_class(w)
                    tails[0, k] += n
                    tails[1, k] += 1
                    tails[2, k] += n == 1
            top = sorted(((-n, w) for w, n in known.items() if n))[:HEAD]
            yield _named(
                [{"tails": tails.ravel()}, *({"word": w, "n": -n} for n, w in top)], COUNTED_NAMES, COUNTED_TYPES
            )

    sent = by_bucket(keyed.mapInArrow(spread, SPREAD)).sortWithinPartitions("second")
    return stored(sent.mapInArrow(count, COUNTED))


def document_sums(counted: DataFrame) -> DataFrame:
    """doc_id, text_key, logs (sum of log10(c + 0.1) over words), known (words with c > 0)."""

    def gather(batches):
        chunk = None

        def done():
            nonlocal logs, known
            if often is not None:
                per = unpack(often["spread"])
                counts = np.zeros(len(per))
                for r in answers:
                    counts[unpack(r["asked"]).astype(np.int64)] = unpack(r["counts"])
                more = _sums(per, unpack(often["docs"]), unpack(often["freqs"]), counts)
                logs, known = added(logs, None, more[0]), added(known, None, more[1])
            whole = lambda x: np.concatenate([x, np.zeros(len(ids), x.dtype)])[: len(ids)]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(whole(logs)), pa.array(whole(known))],
                ["doc_id", "text_key", "logs", "known"]
            )

        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk"] != chunk:
                    if chunk is not None:
                        yield done()
                    chunk, logs, known, ids, keys, often, answers = r["chunk"], np.zeros(0), np.zeros(0, np.int64), None, None, None, []
                if r["ids"] is not None:
                    ids, keys = r["ids"], r["keys"]
                elif r["spread"] is not None:
                    often = r
                elif r["asked"] is not None:
                    answers.append(r)
                else:
                    logs, known = added(logs, r["of"], np.frombuffer(r["logs"])), added(
                        known, r["of"], unpack(r["known"]).astype(np.int64)
                    )
        if chunk is not None:
            yield done()

    own = counted.filter(F.col("chunk").isNotNull()).select(
        "chunk", "of", "logs", "known", "ids", "keys", "spread", "docs", "freqs", "asked", "counts"
    )
    return together(own, "chunk").mapInArrow(gather, "doc_id long, text_key long, logs double, known long")


def train(symbols: DataFrame, symbol_counts: np.ndarray) -> dict[str, np.ndarray]:
    """The average of the copies that the tasks train."""
    first = start(symbol_counts)
    shared = symbols.sparkSession.sparkContext.broadcast(first)

    def copy(batches):
        number = next(next_row_ids()) >> 32
        trainer = Trainer(shared.value, number)
        for (_, _, held), docs in _symbol_slices(batches):
            if learn := [d for d, h in zip(docs, held) if not h]:
                trainer.learn(learn)
        if trainer.tokens:
            yield _rows(
                [(number, trainer.tokens, (trainer.flat.astype(np.float64) * trainer.tokens).tobytes())],
                ["part", "n", "w"], [pa.int32(), pa.int64(), pa.binary()]
            )

    def add(batches):
        n, w, part = 0, None, None
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["w"], np.float64)
                n, w, part = n + r["n"], x if w is None else w + x, r["part"] if part is None else part
        if w is not None:
            yield _rows([(part // TREE, n, w.tobytes())], ["part", "n", "w"], [pa.int32(), pa.int64(), pa.binary()])

    kind = "part int, n long, w binary"
    left, sums = symbols.rdd.getNumPartitions(), symbols.mapInArrow(copy, kind)
    while left > TREE:  # a task adds up TREE copies, in order
        left = -(-left // TREE)
        sums = sums.repartitionById(
            left, F.floor(F.col("part") / TREE).cast("int")
        ).sortWithinPartitions("part").mapInArrow(add, kind)
    sums = sums.collect()  # TREE rows at most
    n = sum(r["n"] for r in sums)
    if not n:
        return first
    mean = sum(np.frombuffer(r["w"], np.float64) for r in sorted(sums, key=lambda r: r["part"])) / n
    return views(mean.astype(np.float32), first)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row."""
    keyed = _keyed(docs)
    counted = count_words(keyed)
    n_docs = keyed.filter(~F.col("held_out")).count()
    # 3 x CLASSES rows
    tails = counted.filter(F.col("tails").isNotNull()).select(F.posexplode("tails").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    totals = np.zeros(3 * CLASSES)
    for r in tails:
        totals[r["i"]] = r["x"]
    counts, distinct, once = totals.reshape(3, CLASSES)
    most = counted.filter(F.col("word").isNotNull()).orderBy(F.desc("n"), "word").select("word", "n").limit(HEAD).collect()
    head, head_counts = [bytes(r["word"]) for r in most], np.array([r["n"] for r in most], float)
    n_all, v_all = counts.sum() + n_docs, distinct.sum() + (n_docs > 0)
    unknown = max(once.sum() / CLASSES, 0.1)
    for w, n in zip(head, head_counts):
        counts[tail_class(w)] -= n
        distinct[tail_class(w)] -= 1
    symbol_counts = np.concatenate([head_counts, np.zeros(HEAD - len(head)), [n_docs], counts])
    symbols = as_symbols(keyed, head)
    weights = train(symbols, symbol_counts)
    # what a symbol adds besides the network's log probability: a head word gives back its log count, a tail divides by
    # its sum
    besides = np.concatenate(
        [-np.log10(head_counts + 0.1), np.zeros(HEAD - len(head) + 1), -np.log10(counts + 0.1 * distinct + unknown)]
    )
    shared = docs.sparkSession.sparkContext.broadcast((weights, besides))

    def run(batches):
        p, besides_ = shared.value
        types = [pa.int64(), pa.int64(), pa.bool_()]
        for fields, ids in _symbol_slices(batches):
            got = log_likelihoods(p, ids) + np.array([besides_[x].sum() for x in ids])
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, fields, types), pa.array([len(x) for x in ids], pa.int64()), pa.array(got)],
                ["doc_id", "text_key", "held_out", "n_tokens", "part"]
            )

    scored = symbols.mapInArrow(run, "doc_id long, text_key long, held_out boolean, n_tokens long, part double")
    sums = document_sums(counted).groupBy("doc_id", "text_key").agg(
        F.max("logs").alias("logs"), F.max("known").alias("known")
    )
    sums = sums.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "logs", "known")
    met = scored.join(sums, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    end = math.log10(n_docs + 0.1)
    base = F.col("logs") + F.lit(end) - F.col("n_tokens") * F.lit(math.log10(n_all + 0.1 * (v_all + 1)))
    strange = F.col("n_tokens") - 1 - F.col("known")
    return met.select(
        "doc_id", "held_out", "n_tokens", (
            F.col("known") + F.lit(int(n_docs > 0))
        ).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        base.alias("base_score"), (
            F.col("part") + F.col("logs") + strange * F.lit(math.log10(unknown) + 1.0)
        ).alias("score"),
    )
