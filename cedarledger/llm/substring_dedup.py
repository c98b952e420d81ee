"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the nine 5-word sequences in every 13-word window the one with the least hash, so two equal
windows choose the same anchor at the same place. Anchors are first joined on a short fingerprint; those found in one
document only go no further. Around each shared anchor the match is extended to both sides over the windows that chose it:
each such window is identified by its 13 words, and the least doc_id that has it is found. Windows that a smaller doc_id has
too are merged into maximal repeats, and the words of repeats are removed.

No pairs of documents are made: a group of copies costs its number of windows, and of what a batch of documents shares only
one goes to the other batches, so a passage that a third of all documents have makes no large bucket. Null texts have no words. Rows that share a
doc_id are one document, so a window repeated only inside one doc_id stays; equal rows share their result. A null doc_id
counts as smaller than any other. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .exchange import by_bucket, documents, next_row_ids, pack, partitions, text_key, together, unpack
from .minhash import WordHashes, mix

LENGTH = 13
SEED = 5
LOWEST = -(1 << 63)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BATCH_BYTES = 24 << 20


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k word hashes."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = mix(out * _A + h[i : n + i] * _B)
    return out


def anchors(h: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all seeds, and the seed that each window chooses (its position; of equal ones the leftmost)."""
    g = rolled(h, seed)
    n = max(0, len(h) - length + 1)
    best, at = g[:n].copy(), np.arange(n)
    for o in range(1, length - seed + 1):
        less = g[o : n + o] < best
        np.copyto(best, g[o : n + o], where=less)
        np.copyto(at, np.arange(o, n + o), where=less)
    return g, at


def word_batches(batch: pa.RecordBatch, most: int = BATCH_BYTES):
    """Rows of a batch, a bounded number of text bytes at a time: first row, words of each."""
    texts, at = batch.column(batch.num_columns - 1), 0
    while at < len(texts):
        start, size, out = at, 0, []
        while at < len(texts) and size < most:
            t = texts[at].as_py().encode("utf-8")
            size += len(t)
            out.append(t.split())  # of bytes: at ASCII white space
            at += 1
        yield start, out


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names
    )


def _split(of: np.ndarray, p: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Documents, and fingerprints of 48 bits."""
    return pack(of), p.astype(np.uint32).tobytes(), (p >> np.uint64(32)).astype(np.uint16).tobytes()


SPREAD = "bucket int, chunk long, docs binary, low binary, high binary, ids array<long>, keys array<long>"
SPREAD_NAMES, SPREAD_TYPES = ["bucket", "chunk", "docs", "low", "high", "ids", "keys"], [
    pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())
]


def shared_anchors(own: DataFrame, length: int, seed: int) -> DataFrame:
    """doc, text_key, anchors (fingerprints): of each document, its anchors that some other document has too."""
    n_buckets = partitions(own.sparkSession)

    def spread(batches):
        ids, hashes = next_row_ids(), WordHashes()
        for batch in batches:
            for start, texts in word_batches(batch):
                chunk, prints, of = next(ids), [], []
                for d, w in enumerate(texts):
                    if len(w) >= length:
                        g, at = anchors(hashes.of(w), length, seed)
                        p = np.unique(g[np.unique(at)] >> np.uint64(16))
                        prints.append(p)
                        of.append(np.full(len(p), d, np.uint32))
                n = len(texts)
                rows = [
                    (
                        chunk % n_buckets, chunk, None, None, None, batch.column(0).slice(start, n).to_pylist(),
                        batch.column(1).slice(start, n).to_pylist()
                    )
                ]
                if prints:
                    p, of = np.concatenate(prints), np.concatenate(of)
                    # anchors that several documents of the batch have are known to be shared: one of them goes on, for
                    # other batches
                    order = np.argsort(p, kind="stable")
                    p, of = p[order], of[order]
                    first = np.concatenate(([True], p[1:] != p[:-1]))
                    some = ~first
                    some[:-1] |= ~first[1:]
                    if some.any():
                        rows.append((chunk % n_buckets, chunk, *_split(of[some], p[some]), [], []))
                    p, of = p[first], of[first]
                    order = np.argsort((p % np.uint64(n_buckets)).astype(np.int32), kind="stable")
                    p, of = p[order], of[order]
                    ends = np.searchsorted((p % np.uint64(n_buckets)).astype(np.int32), np.arange(n_buckets + 1))
                    for b in range(n_buckets):
                        lo, hi = ends[b], ends[b + 1]
                        if lo < hi:
                            rows.append((b, chunk, *_split(of[lo:hi], p[lo:hi]), None, None))
                yield _rows(rows, SPREAD_NAMES, SPREAD_TYPES)

    def meet(batches):
        """All rows of a partition, one for each batch and bucket: passes on what is known and answers with the anchors
        that two batches have.
        """
        held = []
        for batch in batches:
            lists = []
            for r in batch.to_pylist():
                if r["ids"] is not None:  # a document list, or anchors that are known to be shared
                    lists.append(
                        (
                            r["chunk"], r["docs"], r["low"], r["high"],
                            *((r["ids"], r["keys"]) if r["docs"] is None else (None, None))
                        )
                    )
                else:
                    p = np.frombuffer(r["low"], np.uint32).astype(np.uint64) | np.frombuffer(r["high"], np.uint16).astype(np.uint64) << np.uint64(32)
                    held.append((r["chunk"], unpack(r["docs"]), p))
            yield _rows(lists, MEET_NAMES, MEET_TYPES)
        if held:
            every = np.sort(np.concatenate([p for _, _, p in held]))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            del every
            if len(twice):
                for chunk, of, p in held:
                    at = np.minimum(np.searchsorted(twice, p), len(twice) - 1)
                    hit = twice[at] == p
                    if hit.any():
                        p, of = p[hit], of[hit]
                        yield _rows([(chunk, *_split(of, p), None, None)], MEET_NAMES, MEET_TYPES)

    def gather(batches):
        chunk, parts, ids, keys = None, [], None, None

        def done():
            if not parts:
                return
            of = np.concatenate([unpack(a) for a, _, _ in parts])
            p = np.concatenate(
                [
                    np.frombuffer(b, np.uint32).astype(np.uint64) | np.frombuffer(c, np.uint16).astype(np.uint64) << np.uint64(32) for _, b, c in parts
                ]
            )
            order = np.argsort(of, kind="stable")
            of, p = of[order], p[order]
            docs, at = np.unique(of, return_index=True)
            for i in range(0, len(docs), 500):  # anchors that were found twice come twice
                part = docs[i : i + 500]
                split = np.split(p[at[i] :], at[i + 1 : i + len(part)] - at[i]) if len(part) > 1 else [p[at[i] :]]
                stop = at[i + len(part)] if i + len(part) < len(at) else len(p)
                split[-1] = p[at[i + len(part) - 1] : stop]
                yield _rows(
                    [(ids[d], keys[d], np.unique(x).tobytes()) for d, x in zip(part.tolist(), split)],
                    ["doc", "text_key", "anchors"], [pa.int64(), pa.int64(), pa.binary()]
                )

        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk"] != chunk:
                    if chunk is not None:
                        yield from done()
                    chunk, parts, ids, keys = r["chunk"], [], None, None
                if r["ids"] is not None:
                    ids, keys = r["ids"], r["keys"]
                else:
                    parts.append((r["docs"], r["low"], r["high"]))
        if chunk is not None:
            yield from done()

    met = by_bucket(own.mapInArrow(spread, SPREAD)).mapInArrow(meet, MEET)
    return together(met, "chunk").mapInArrow(gather, "doc long, text_key long, anchors binary")


MEET = "chunk long, docs binary, low binary, high binary, ids array<long>, keys array<long>"
MEET_NAMES, MEET_TYPES = SPREAD_NAMES[1:], SPREAD_TYPES[1:]
WINDOWS = "bucket int, chunk long, ids binary, docs binary, at binary, hash binary, check binary, all_ids array<long>, all_keys array<long>"
WINDOWS_NAMES = ["bucket", "chunk", "ids", "docs", "at", "hash", "check", "all_ids", "all_keys"]
WINDOWS_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64())]
FOUND_NAMES, FOUND_TYPES = ["chunk", "docs", "at", "all_ids", "all_keys"], [
    pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())
]


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc, text_key, starts and ends (in words, packed) of the maximal repeats to remove, for documents that have any.
    """
    own = documents(docs, "doc_id", "text").select(
        F.coalesce("doc_id", F.lit(LOWEST)).alias("doc"), text_key().alias("text_key"), "text"
    )
    n_buckets = partitions(docs.sparkSession)
    seeds = shared_anchors(own, length, seed).dropDuplicates(["doc", "text_key"])
    met = own.join(seeds.hint("shuffle_hash"), ["doc", "text_key"]).select("doc", "text_key", "anchors", "text")

    def extend(batches):
        ids, hashes = next_row_ids(), WordHashes()
        for batch in batches:
            for start, texts in word_batches(batch):
                chunk, n = next(ids), len(texts)
                doc_ids = batch.column(0).slice(start, n).to_numpy()
                keep = []
                for d, (w, prints) in enumerate(zip(texts, batch.column(2).slice(start, n).to_pylist())):
                    h, prints = hashes.of(w), np.frombuffer(prints, np.uint64)
                    g, at = anchors(h, length, seed)
                    if not len(at):
                        continue
                    own_prints = g[at] >> np.uint64(16)
                    windows = np.flatnonzero(
                        prints[np.minimum(np.searchsorted(prints, own_prints), len(prints) - 1)] == own_prints
                    )
                    if len(windows):
                        keep.append(
                            (
                                np.full(len(windows), d, np.uint32), windows.astype(np.uint32),
                                rolled(h, length)[windows], g[at[windows]]
                            )
                        )
                rows = [
                    (
                        chunk % n_buckets, chunk, None, None, None, None, None, doc_ids.tolist(),
                        batch.column(1).slice(start, n).to_pylist()
                    )
                ]
                if keep:
                    of, at, whole, anchor = (np.concatenate(x) for x in zip(*keep))
                    # a window that a smaller doc_id of this batch has too is decided here; the others' least goes on
                    order = np.lexsort((doc_ids[of], anchor, whole))
                    new = np.concatenate(
                        ([True], (whole[order[1:]] != whole[order[:-1]]) | (anchor[order[1:]] != anchor[order[:-1]]))
                    )
                    least = doc_ids[of[order]][np.flatnonzero(new)][np.cumsum(new) - 1]
                    later = np.empty(len(order), bool)
                    later[order] = doc_ids[of[order]] > least
                    if later.any():
                        rows.append(
                            (chunk % n_buckets, chunk, None, pack(of[later]), pack(at[later]), None, None, [], [])
                        )
                        of, at, whole, anchor = of[~later], at[~later], whole[~later], anchor[~later]
                    bucket = (mix(anchor) % np.uint64(n_buckets)).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                    for b in range(n_buckets):
                        i = order[ends[b] : ends[b + 1]]
                        if len(i):
                            local, docs_ = np.unique(of[i], return_inverse=True)
                            rows.append(
                                (
                                    b, chunk, doc_ids[local].tobytes(), pack(docs_) + local.astype(np.uint32).tobytes(),
                                    pack(at[i]), whole[i].tobytes(),
                                    (anchor[i] & np.uint64(0xFFFF)).astype(np.uint16).tobytes(), None, None
                                )
                            )
                yield _rows(rows, WINDOWS_NAMES, WINDOWS_TYPES)

    def judge(batches):
        held = []
        for batch in batches:
            lists = []
            for r in batch.to_pylist():
                if r["all_ids"] is not None:  # a document list, or windows that are decided
                    lists.append(
                        (
                            r["chunk"], r["docs"], r["at"],
                            *((r["all_ids"], r["all_keys"]) if r["docs"] is None else (None, None))
                        )
                    )
                else:
                    ids = np.frombuffer(r["ids"], np.int64)
                    tail = len(r["docs"]) - 4 * len(ids)
                    held.append(
                        (
                            r["chunk"], ids, unpack(r["docs"][:tail]).astype(np.int64),
                            np.frombuffer(r["docs"], np.uint32, offset=tail), r["at"],
                            np.frombuffer(r["hash"], np.uint64), np.frombuffer(r["check"], np.uint16)
                        )
                    )
            yield _rows(lists, FOUND_NAMES, FOUND_TYPES)
        if not held:
            return
        whole = np.concatenate([x[5] for x in held])
        extra = np.concatenate([x[6] for x in held])
        doc = np.concatenate([x[1][x[2]] for x in held])
        order = np.lexsort((doc, extra, whole))
        new = np.ones(len(order), bool)
        new[1:] = (whole[order[1:]] != whole[order[:-1]]) | (extra[order[1:]] != extra[order[:-1]])
        least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        later = np.empty(len(order), bool)
        later[order] = doc[order] > least
        at = 0
        for chunk, _, docs_, local, starts, h, _ in held:
            hit = later[at : at + len(h)]
            at += len(h)
            if hit.any():
                yield _rows(
                    [(chunk, pack(local[docs_[hit]]), pack(unpack(starts)[hit]), None, None)], FOUND_NAMES, FOUND_TYPES
                )

    def merge(batches):
        chunk, parts, ids, keys = None, [], None, None

        def done():
            if not parts:
                return
            of, at = np.concatenate([unpack(a) for a, _ in parts]).astype(np.int64), np.concatenate([unpack(b) for _, b in parts]).astype(np.int64)
            order = np.lexsort((at, of))
            of, at = of[order], at[order]
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (at[1:] > at[:-1] + length)
            first = np.flatnonzero(new)
            last = np.concatenate((first[1:] - 1, [len(of) - 1]))
            rows, b = [], of[first]
            bounds = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
            for lo, hi in zip(bounds.tolist(), [*bounds[1:].tolist(), len(b)]):
                rows.append((ids[b[lo]], keys[b[lo]], pack(at[first[lo:hi]]), pack(at[last[lo:hi]] + length)))
            yield _rows(rows, ["doc", "text_key", "starts", "ends"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk"] != chunk:
                    if chunk is not None:
                        yield from done()
                    chunk, parts, ids, keys = r["chunk"], [], None, None
                if r["all_ids"] is not None:
                    ids, keys = r["all_ids"], r["all_keys"]
                else:
                    parts.append((r["docs"], r["at"]))
        if chunk is not None:
            yield from done()

    judged = by_bucket(met.mapInArrow(extend, WINDOWS)).mapInArrow(
        judge, "chunk long, docs binary, at binary, all_ids array<long>, all_keys array<long>"
    )
    return together(judged, "chunk").mapInArrow(merge, "doc long, text_key long, starts binary, ends binary")


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    own = documents(docs, "doc_id", "text").withColumn(
        "doc", F.coalesce("doc_id", F.lit(LOWEST))
    ).withColumn("text_key", text_key())
    met = own.join(
        found.dropDuplicates(["doc", "text_key"]).hint("shuffle_hash"), ["doc", "text_key"], "left"
    ).select("doc_id", "starts", "ends", "text")

    def run(batches):
        for batch in batches:
            for start, texts in word_batches(batch, 8 << 20):
                n = len(texts)
                removed, kept = [], []
                for w, a, b in zip(
                    texts, batch.column(1).slice(start, n).to_pylist(), batch.column(2).slice(start, n).to_pylist()
                ):
                    left = len(w)
                    if a is not None:
                        out, at = [], 0
                        for x, y in zip(unpack(a).tolist(), unpack(b).tolist()):
                            out += w[at:x]
                            at = y
                        w = out + w[at:]
                    removed.append(left - len(w))
                    kept.append(b" ".join(w).decode("utf-8"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, n), pa.array([len(w) + 0 for w in texts], pa.int64()),
                        pa.array(removed, pa.int64()), pa.array(kept, pa.string())
                    ],
                    ["doc_id", "n_words", "n_removed", "kept"]
                )

    return met.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
