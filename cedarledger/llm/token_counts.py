"""Token counts without ids: pieces are counted once per distinct pre-token and joined to per-document frequencies.

Pre-tokens are the runs between ASCII white space, at which the tokenizer always splits. Each batch of documents sends
its distinct pre-tokens, with the documents and frequencies of each, to the bucket of the pre-token; a bucket counts the
pieces of a pre-token once and answers with sums per document, so what comes back is one number per document and bucket.
Pre-tokens that many documents have are dealt to another bucket by each batch, so none of them makes one bucket large.

Null texts count as empty: 0 bytes, 0 tokens. One result per input row, repeated rows included; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import load, vocabulary
from .exchange import Numbers, added, by_bucket, documents, in_order, next_row_ids, pack, partitions, thinned, together, unpack

PACKED = "bucket int, chunk long, words binary, spread binary, docs binary, freqs binary, doc_ids array<long>, n_bytes array<long>"
PARTIAL = "chunk long, of binary, sums binary, doc_ids array<long>, n_bytes array<long>"
RESULT = "doc_id long, n_bytes long, n_tokens long"
BATCH_BYTES = 24 << 20
KNOWN = 1_000_000  # pre-tokens whose counts a task remembers
OFTEN = 8  # a word in more than one of so many documents of a batch counts as frequent


def slices(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and UTF-8 texts, a bounded number of bytes at a time."""
    keys, texts = batch.column(0).to_pylist(), batch.column(1)
    at = 0
    while at < len(keys):
        out, size, start = [], 0, at
        while at < len(keys) and size < most:
            out.append(texts[at].as_py().encode("utf-8"))
            size += len(out[-1])
            at += 1
        yield keys[start:at], out


def postings(texts_words: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words; and by (word, document): word's number, document's number, frequency."""
    index = Numbers()
    words, docs, freqs = [], [], []
    for d, tokens in enumerate(texts_words):
        counted = Counter(tokens)
        words.append(np.fromiter(map(index.__getitem__, counted), np.uint32, len(counted)))
        freqs.append(np.fromiter(counted.values(), np.uint32, len(counted)))
        docs.append(np.full(len(counted), d, np.uint32))
    none = np.zeros(0, np.uint32)
    return list(index), *(np.concatenate(x) if x else none for x in (words, docs, freqs))


def dealt(words: list[bytes], word_of: np.ndarray, n_buckets: int, salt: np.ndarray | None = None):
    """Per bucket that has any: its number, its words' numbers, and the postings that belong to them, ordered by word.
    Salt, by word, moves a word to another bucket.
    """
    bucket = np.fromiter(map(crc32, words), np.int64, len(words))
    bucket = (bucket if salt is None else bucket + salt) % n_buckets
    order = in_order(bucket)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    ranks = rank[word_of]
    by = in_order(ranks)
    per_word = np.bincount(ranks, minlength=len(words))
    starts = np.concatenate(([0], np.cumsum(per_word)))
    at = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    for b in range(n_buckets):
        lo, hi = at[b], at[b + 1]
        if lo < hi:
            yield b, order[lo:hi], per_word[lo:hi], by[starts[lo] : starts[hi]]


def count_tokens(docs: DataFrame, name: str = "word_bpe_49k.json", path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens: one row per input row."""
    spark = docs.sparkSession
    shared, n_buckets = spark.sparkContext.broadcast(vocabulary(name, path)), partitions(spark)

    def spread(batches):
        ids = next_row_ids()
        for batch in batches:
            for keys, texts in slices(batch):
                chunk = next(ids)
                words, word_of, doc_of, freq = postings([t.split() for t in texts])
                # what many documents of the batch have, has many postings in every batch: each batch sends it elsewhere
                salt = np.where(
                    np.bincount(word_of, minlength=len(words)) * OFTEN > len(texts), crc32(b"%d" % chunk), 0
                )
                rows = [(chunk % n_buckets, chunk, None, None, None, None, keys, [len(t) for t in texts])]
                for b, at, per_word, by in dealt(words, word_of, n_buckets, salt):
                    rows.append(
                        (
                            b, chunk, b"\n".join([words[i] for i in at]), pack(per_word), pack(doc_of[by]),
                            pack(freq[by]), None, None
                        )
                    )
                for i in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), PACKED_TYPES)], PACKED_NAMES
                    )

    def count(batches):
        tokenizer, known = load(shared.value), {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["doc_ids"] is not None:
                    out.append((r["chunk"], None, None, r["doc_ids"], r["n_bytes"]))
                    continue
                words = r["words"].split(b"\n")
                if len(known) > KNOWN:
                    known = {}
                new = [w for w in words if w not in known]
                for w, e in zip(
                    new, tokenizer.encode_batch_fast([w.decode("utf-8") for w in new], add_special_tokens=False)
                ):
                    known[w] = len(e.ids)
                pieces = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                docs_, weight = unpack(r["docs"]), np.repeat(
                    pieces, unpack(r["spread"]).astype(np.int64)
                ) * unpack(r["freqs"])
                of, (sums,) = thinned(docs_, np.bincount(docs_, weights=weight).astype(np.uint64))
                out.append((r["chunk"], of, pack(sums), None, None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, PARTIAL_TYPES)], PARTIAL_NAMES
            )

    packed = documents(docs, "doc_id", "text").mapInArrow(spread, PACKED)
    partial = by_bucket(packed).mapInArrow(count, PARTIAL)
    return together(partial, "chunk").mapInArrow(gather, RESULT)


def gather(batches):
    """Rows of a chunk lie together: adds up its sums."""
    chunk, total, keys, sizes = None, None, None, None

    def done():
        t = np.concatenate([total, np.zeros(len(keys), np.int64)])[: len(keys)]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(t)], ["doc_id", "n_bytes", "n_tokens"]
        )

    for batch in batches:
        for r in batch.to_pylist():
            if r["chunk"] != chunk:
                if chunk is not None:
                    yield done()
                chunk, total, keys, sizes = r["chunk"], np.zeros(0, np.int64), None, None
            if r["doc_ids"] is not None:
                keys, sizes = r["doc_ids"], r["n_bytes"]
            else:
                total = added(total, r["of"], unpack(r["sums"]).astype(np.int64))
    if chunk is not None:
        yield done()


PACKED_NAMES = ["bucket", "chunk", "words", "spread", "docs", "freqs", "doc_ids", "n_bytes"]
PACKED_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.list_(pa.int64())]
PARTIAL_NAMES = ["chunk", "of", "sums", "doc_ids", "n_bytes"]
PARTIAL_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def with_limit(counted: DataFrame, limit: int = 2048) -> DataFrame:
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
