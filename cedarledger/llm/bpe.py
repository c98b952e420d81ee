"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash over its last 16 bytes hits a mask, so equal passages fall into equal chunks at any
offset, in any document. A task keeps a dictionary of the chunks that it has met: a chunk is encoded when it is met first
and looked up afterwards; how often is part of the result. A cut may split a word, so a chunk is encoded between its first
and last white space, and what stands around a cut, a join, is encoded anew with a word of context on either side. The ids of
the context must agree with those that the chunks on both sides have for it; as long as they don't, the context grows by a
word on each side, up to all of both chunks, and then the whole text is encoded by the library.

A new chunk is put together from its words: words that differ only in the case of ASCII letters, or by a closing mark after
a letter, from the ids of their parts, other words through the library, each once per task. Whether the tokenizer splits at
white space, ignores case and sets closing marks apart is tested on it before (assumptions()); one that doesn't split at
white space gets every text whole from the library, one that differs in the rest gets every word from it.

Null texts count as empty and give no ids. Rows are independent: repeated rows give repeated results, extra columns are
ignored, an empty table gives no rows. A task holds its dictionary, whose size is bounded, and a few MB of documents, or one.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .exchange import documents

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string, n_chunks long, n_known long"
WINDOW = 16
CHUNK_MASK = 0x1FF
CACHE_BYTES = 48 << 20
BATCH_CHARS = 1 << 20  # of documents whose joins are encoded together
SPACES = b" \t\n\x0b\x0c\r"
# A punctuation mark after an ASCII letter is a pre-token of its own; the apostrophe is not, as it may begin a
# contraction.
CLOSING, LETTERS = b".,;:!?|", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTER = frozenset(bytes([c]) for c in LETTERS)


def vocabulary(name: str = "word_bpe_49k.json", path: str | None = None) -> str:
    """The tokenizer's definition, read once on the driver (a file of fixed size, a few MB) and sent to the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def load(definition: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(definition)
    t.no_truncation()
    t.no_padding()
    return t


def gear(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes, table: np.ndarray, mask: int = CHUNK_MASK) -> list[int]:
    """Ends of chunks: after byte i if the hash of bytes i-15..i has all bits of mask and a character ends there."""
    n = len(data)
    if n <= WINDOW:
        return [n] if n else []
    b = np.frombuffer(data, dtype=np.uint8)
    h = table[b]
    for step in (1, 2, 4, 8):  # doubles the window each time
        h[step:] += h[:-step] << np.uint32(step)
    hit = np.flatnonzero((h >> np.uint32(16)) & np.uint32(mask) == mask) + 1
    hit = hit[(hit >= WINDOW) & (hit < n)]
    hit = hit[(b[hit] & 0xC0) != 0x80]
    return [*hit.tolist(), n]


class Words(dict):
    """Ids (packed) and decoded form of a word, by its bytes."""

    def __init__(self, tokenizer, parts: bool = True, most: int = 800_000):
        super().__init__()
        self.tokenizer, self.parts, self.most = tokenizer, parts, most
        self.shown = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
        self.packed = [struct.Struct(f"<{n}I").pack for n in range(32)]

    def __missing__(self, word: bytes):
        """White-space-free word: what only differs in case or by closing punctuation is put together from what is
        known.
        """
        last = word[-1]
        if self.parts and last in CLOSING and len(word) > 1 and word[-2] in LETTERS:
            core, end = self[word[:-1]], self[word[-1:]]
            value = (core[0] + end[0], f"{core[1]} {end[1]}")
        elif self.parts and word.isascii() and not word.islower() and word.isalpha():
            value = self[word.lower()]
        else:
            value = self.of(self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids)
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value

    def learn(self, words: set[bytes]) -> None:
        """What the library must encode for these unknown words, at once."""
        if self.parts:
            bare = [w.rstrip(CLOSING) if w[-1] in CLOSING and w.rstrip(CLOSING)[-1:] in LETTER else w for w in words]
            words = {w.lower() if w.isalpha() and w.isascii() else w for w in bare}
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
        for w, e in zip(
            new, self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in new], add_special_tokens=False)
        ):
            self[w] = self.of(e.ids)

    def of(self, ids: list[int]) -> tuple[bytes, str]:
        n = len(ids)
        packed = self.packed[n](*ids) if n < len(self.packed) else struct.pack(f"<{n}I", *ids)
        return packed, " ".join(map(self.shown.__getitem__, ids))


def assumptions(tokenizer) -> tuple[bool, bool]:
    """Whether the tokenizer splits at ASCII white space, and whether words may be put together from their parts, by
    trying it.
    """
    ids = lambda s: tokenizer.encode(s, add_special_tokens=False).ids
    shown = json.loads(tokenizer.to_str())
    kinds = [
        "a", "word", "Tion", "x1", "7", "42", "'s", "it's", "don't", "...", "?!", "-", "_", "#a", "\u00e9t\u00e9",
        "\u65e5\u672c", "\U0001f642", "a.", "<|", "|>", "\u0301", *(t["content"] for t in shown["added_tokens"])
    ]
    alone = {k: ids(k) for k in kinds}
    splits = not any(c in " \t\n\x0b\x0c\r" for t in shown["added_tokens"] for c in t["content"]) and not ids(" \n")
    splits = splits and all(
        ids(x + between + y) == alone[x] + alone[y] for x in kinds for y in kinds for between in (" ", "\n", " \t\r\x0b\x0c ")
    )
    parts = splits and all(
        ids(w + m) == ids(w) + ids(m) for w in ("a", "Z", "word", "naWord") for m in CLOSING.decode()
    ) and all(ids(chr(c) + m) == ids(chr(c)) + ids(m) for c in LETTERS for m in CLOSING.decode())
    parts = parts and all(
        ids(w) == ids(w.lower()) for w in ("A", "Word", "LONGER", "tHe", "Internationalisation", LETTERS.decode())
    )
    return splits, parts


def parted(data: bytes) -> tuple[bytes, list[bytes] | None, bytes]:
    """What stands before the first white space, the words between, what stands after the last. Without white space all is the first."""
    w = data.split()
    before, after = data[0] not in SPACES, data[-1] not in SPACES
    if before and after and len(w) == 1:
        return data, None, b""
    return w[0] if before else b"", w[before : len(w) - after], w[-1] if after else b""


class Chunk:
    """A chunk as it is encoded alone: bytes before its first white space, ids and decoded form between, bytes after its
    last. Without white space all is head and ids is None.
    """

    __slots__ = ("data", "head", "tail", "ids", "shown")

    def __init__(self, data: bytes, head: bytes, tail: bytes, ids: bytes | None, shown: str | None):
        self.data, self.head, self.tail, self.ids, self.shown = data, head, tail, ids, shown

    def inner(self) -> list[bytes]:
        """Words between the first white space and the last."""
        return self.data[len(self.head) : len(self.data) - len(self.tail)].split()


class Encoder:
    """Encodes whole texts; the decoded form is what the library's decode gives for a vocabulary without a decoder."""

    def __init__(self, tokenizer, mask: int = CHUNK_MASK, cache_bytes: int = CACHE_BYTES):
        self.splits, parts = assumptions(tokenizer)
        self.tokenizer, self.words, self.table, self.mask = tokenizer, Words(tokenizer, parts), gear(), mask
        self.chunks: dict[bytes, Chunk] = {}
        self.held, self.most = 0, cache_bytes
        self.joins = self.grown = 0  # joins made anew; times that a context had to grow

    def _chunk(self, data: bytes, fresh: dict[bytes, tuple]) -> tuple[Chunk, bool]:
        """The chunk, and whether it was known."""
        if (got := self.chunks.get(data)) is not None:
            return got, True
        head, words, tail, found = fresh.get(data) or (*parted(data), [None])
        ids, shown = (None, None) if words is None else (b"", "")
        if words:
            packed, decoded = zip(*(map(self.words.__getitem__, words) if None in found else found))
            ids, shown = b"".join(packed), " ".join(filter(None, decoded))
        got = Chunk(data, head, tail, ids, shown)
        cost = 2 * len(data) + 3 * len(got.ids or b"") + 400
        if self.held + cost > self.most:
            self.chunks.clear()
            self.held = 0
        self.chunks[data] = got
        self.held += cost
        return got, False

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str, int, int]]:
        """Of each text its packed ids (little-endian, 32 bits), decoded form, number of chunks and of chunks that were
        known.
        """
        if not self.splits:
            return [
                (*self.words.of(self.tokenizer.encode(t, add_special_tokens=False).ids), int(t != ""), 0) for t in texts
            ]
        cut = []
        for text in texts:
            data = text.encode("utf-8")
            ends = cuts(data, self.table, self.mask)
            cut.append([data[a:b] for a, b in zip([0, *ends], ends)])
        fresh, unknown = {}, set()
        for parts in cut:
            for c in parts:
                if c not in self.chunks and c not in fresh:
                    head, words, tail = parted(c)
                    found = list(map(self.words.get, words or ()))
                    if None in found:
                        unknown.update([w for w, x in zip(words, found) if x is None])
                    fresh[c] = head, words, tail, found
        self.words.learn(unknown)
        plans, joins = [], []  # a text: parts, which are chunks, words or numbers of joins
        for datas in cut:
            parts, known, left, open_ = [], 0, None, []

            def closed(right: Chunk | None):
                pieces = [x for x in open_ if x]
                if len(pieces) == 1:  # cut at white space, or at the text's edge: no word is split
                    parts.append(self.words[pieces[0]])
                elif pieces:
                    parts.append(len(joins))
                    joins.append((b"".join(pieces), left, right))

            for data in datas:
                chunk, old = self._chunk(data, fresh)
                known += old
                open_.append(chunk.head)
                if chunk.ids is not None:
                    closed(chunk)
                    parts.append((chunk.ids, chunk.shown))
                    left, open_ = chunk, [chunk.tail]
            closed(None)
            plans.append((parts, len(datas), known))
        mended = self._mended(joins)
        out = []
        for text, (parts, n, known) in zip(texts, plans):
            found = [mended[p] if isinstance(p, int) else p for p in parts]
            if any(x is None for x in found):  # no context was enough
                out.append((*self.words.of(self.tokenizer.encode(text, add_special_tokens=False).ids), n, known))
            else:
                out.append((b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[0]]), n, known))
        return out

    def _mended(self, joins: list[tuple[bytes, Chunk | None, Chunk | None]]) -> list[tuple[bytes, str] | None]:
        """Ids and decoded form of what stands between the inner parts of two chunks, encoded with context until both
        sides agree; None where they never do.
        """
        out: list[tuple[bytes, str] | None] = [None] * len(joins)
        size, left = 1, list(range(len(joins)))
        self.joins += len(joins)
        while left:
            sides, windows = [], []
            for i in left:
                between, a, b = joins[i]
                before = a.inner()[-size:] if a else []
                after = b.inner()[:size] if b else []
                sides.append((before, after))
                windows.append(b" ".join([*before, between, *after]).decode("utf-8"))
            again = []
            for i, (before, after), e in zip(
                left, sides, self.tokenizer.encode_batch_fast(windows, add_special_tokens=False)
            ):
                ids = struct.pack(f"<{len(e.ids)}I", *e.ids)
                x, y = b"".join([self.words[w][0] for w in before]), b"".join([self.words[w][0] for w in after])
                if len(x) + len(y) <= len(ids) and ids.startswith(x) and ids.endswith(y):
                    out[i] = self.words.of(e.ids[len(x) // 4 : len(e.ids) - len(y) // 4])
                elif len(before) == size or len(after) == size:
                    again.append(i)
            left, size = again, size + 1
            self.grown += len(again)
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        return self.encode_batch([text])[0][:2]


def encode_decode(docs: DataFrame, name: str = "word_bpe_49k.json", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit), decoded, n_chunks, n_known (chunks that its task
    had met before): one row per input row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(name, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(shared.value)
        if tokenizer.decoder is not None:
            raise ValueError("decoding by joining tokens holds only for a vocabulary without a decoder")
        encoder = Encoder(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                part, size, start = [], 0, at
                while at < len(texts) and size < BATCH_CHARS:
                    part.append(texts[at].as_py())
                    size += len(part[-1])
                    at += 1
                ids, decoded, n, known = zip(*encoder.encode_batch(part))
                columns = [
                    pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                    pa.array(decoded, pa.string()), pa.array(n, pa.int64()), pa.array(known, pa.int64())
                ]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(start, at - start), *columns],
                    ["doc_id", "n_tokens", "ids", "decoded", "n_chunks", "n_known"]
                )

    return documents(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )
