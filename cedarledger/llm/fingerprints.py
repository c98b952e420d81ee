"""Document fingerprints by a randomised edit embedding, and documents found by them.

A walk reads a text from its first code point: at step j it emits the character it stands on and goes on to the next one if the
random bit of (j, character) says so. All texts share the bits, so after an edit two walks soon fall into step again, and edit
distance between texts becomes Hamming distance between what their walks emit. Of that a fingerprint samples SLOTS steps a walk. Each
slot gives every step a random priority and takes the first-ranked step that the walk has, so texts of nearly one length sample the
same steps, and a longer text's further steps count as differing, as padding would. The steps that can ever be sampled are few (a
record list a slot, made by rule from a seed), so whole texts are walked and little is written.

Likeness of two fingerprints is the share of slots that agree, of the walk where they agree most. near_first is the least document of
all that are as like as the threshold says, and none is missed. Each fingerprint is compared, in full over all slots, with the first
document of each of its bands. Then it meets every document before the least found so far with which it shares a key; keys are
pieces of bands so many that two alike have one in common (the pigeonhole principle). Equal fingerprints meet once. Rows of a key are
compared inside tasks, a block of BLOCK rows with another, one after another until one is alike, so pairs are never rows: at first
all rows of a key with its first block, then those still open with further blocks.

Each document also meets its successor in order of doc_id: documents are range-partitioned and sorted, and the last row of a partition
waits for the first of the next, of which there are as many as partitions. Walks of many texts go in step, in numpy; few long ones
that are left are finished one by one.

Null text is empty; the empty text's fingerprint is all zeros. A null doc_id comes first; rows of one doc_id are ordered by a hash of
their text, each the other's successor. Equal texts have equal fingerprints, whatever else the row holds. Extra columns are ignored. The
only document's successor is itself. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .exchange import dealt_anew, partitions, shuffles_freed, stored

WALKS, SLOTS, BAND_SLOTS = 2, 64, 8
THRESHOLD = 0.8
BLOCK = 1024  # rows of a key that are compared with as many in one go
ROUND = 16  # times as many rows of a key have been asked after a round as before it
KEY_SLOTS = 7  # chance meetings fall with it to a fourteenth each, keys grow
PERIOD = 8192  # steps after which the shared bits come again
SEED = 20_130_611
LONGEST = 1 << 33  # steps; a text has under 2^31 code points, two steps each on average
CHUNK = 16_000_000  # code points walked together
FEW = 64  # walks that are finished one by one
DONE, HEAD, OPEN = 0, 1, 2
WIDTH = WALKS * SLOTS
ROWS = "part int, kind int, doc_id {}, n_chars long, text string, edited binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
NAMES = [x.split()[0] for x in ROWS.split(", ")]


def once(make):
    """make, called at most once a process. A plain closure goes to executors by value, which a cache of functools doesn't."""
    made = []

    def get():
        if not made:
            made.append(make())
        return made[0]

    return get


@once
def shared_bits() -> np.ndarray:
    """PERIOD x (WALKS * 256) bits; none for 0, the end of a text."""
    r = np.random.RandomState(SEED)
    bits = np.unpackbits(np.frombuffer(r.bytes(PERIOD * WALKS * 32), np.uint8)).reshape(PERIOD, WALKS, 256)
    bits[:, :, 0] = 0
    return np.ascontiguousarray(bits.reshape(PERIOD, WALKS * 256))


@once
def sampled_steps() -> dict[int, list[np.ndarray]]:
    """Step: for each walk the slots whose best step so far it is."""
    r, at = np.random.RandomState(SEED + 1), {}
    for slot in range(WIDTH):
        step, least = 0, r.random_sample()
        while step < LONGEST:
            at.setdefault(step, [[] for _ in range(WALKS)])[slot // SLOTS].append(slot)
            step += int(np.ceil(np.log1p(-r.random_sample()) / np.log1p(-least)))  # the next lower one, as a geometric gap
            least *= r.random_sample()
    return {step: [np.array(s, np.int64) for s in slots] for step, slots in at.items()}


def symbols(text: str) -> np.ndarray:
    return (np.frombuffer(text.encode("utf-32-le"), np.uint32) % 255 + 1).astype(np.uint8)


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of WIDTH symbols a text."""
    out = np.zeros((len(texts), WIDTH), np.uint8)
    parts, starts, at = [], [], 0
    for t in texts:
        parts += [symbols(t), np.zeros(1, np.uint8)]
        starts.append(at)
        at += len(parts[-2]) + 1
    codes = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    bits, steps = shared_bits(), sampled_steps()
    pos = np.tile(np.array(starts, np.int64), WALKS)
    text = np.tile(np.arange(len(texts)), WALKS)
    walk = np.repeat(np.arange(WALKS), len(texts))
    j = 0
    while True:
        on = codes.take(pos) > 0
        pos, text, walk = pos[on], text[on], walk[on]
        if len(pos) <= FEW:
            break
        base = walk * 256
        for j in range(j, j + 128):
            c = codes.take(pos)
            if j in steps:
                for w, slots in enumerate(steps[j]):
                    if len(slots) and len(met := np.flatnonzero((walk == w) & (c > 0))):
                        out[text[met][:, None], slots[None, :]] = c[met][:, None]
            pos += bits[j % PERIOD].take(c + base)
        j += 1
    raw = codes.tobytes()
    rows = _rows() if len(pos) else []
    ahead = sorted(s for s in steps if s >= j)
    for p, t, w in zip(pos.tolist(), text.tolist(), walk.tolist()):
        _alone(raw, p, j, rows[w], [s for s in ahead if len(steps[s][w])], lambda s: steps[s][w], out[t])  # noqa: B023
    return out


@once
def _rows() -> list[list[bytes]]:
    bits = shared_bits()
    return [[bits[j, w * 256 : w * 256 + 256].tobytes() for j in range(PERIOD)] for w in range(WALKS)]


def _alone(raw: bytes, p: int, j: int, rows: list[bytes], ahead: list[int], slots_of, out: np.ndarray) -> None:
    """Finish one walk that stands on p at step j."""
    k = 0
    while raw[p]:
        at = j % PERIOD
        stop = min(ahead[k] - j if k < len(ahead) else PERIOD, PERIOD - at)
        for row in rows[at : at + stop]:
            p += row[raw[p]]
        j += stop
        if k < len(ahead) and j == ahead[k]:
            if raw[p]:
                out[slots_of(j)] = raw[p]
            k += 1


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of symbols: the share of slots that agree, of the walk where most do."""
    return (a == b).reshape(-1, WALKS, SLOTS).mean(axis=2).max(axis=1)


def edited(text: str, following: str) -> str:
    h = len(text) // 2
    return text[: len(text) - h] + following[:h]


def _judged(texts: list[str], own: np.ndarray, following: list[str], theirs: np.ndarray):
    """Digest and fingerprint of each text's edited form, and its likeness to that and to the text that follows."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    prints = fingerprints(changed)
    return [hashlib.sha256(t.encode()).digest() for t in changed], prints, likeness(own, prints), likeness(own, theirs)


def _binary(prints: np.ndarray) -> pa.Array:
    return pa.array([p.tobytes() for p in prints], pa.binary())


def _batch(part, kind, ids, id_type, n, texts, digests, own, changed, near_edited, near_next) -> pa.RecordBatch:
    size = len(ids)
    none = pa.nulls(size, pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part] * size, pa.int32()), pa.array([kind] * size, pa.int32()), pa.array(ids, id_type), pa.array(n, pa.int64()),
            pa.nulls(size, pa.string()) if texts is None else pa.array(texts, pa.string()),
            none if digests is None else pa.array(digests, pa.binary()), _binary(own), none if changed is None else _binary(changed),
            *(pa.nulls(size, pa.float64()) if x is None else pa.array(x, pa.float64()) for x in (near_edited, near_next))
        ],
        NAMES
    )


def sequence(docs: DataFrame) -> DataFrame:
    """Rows of ROWS over documents in order: done, or open with their text; the first row of each partition also as its head."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("row")
    )
    order = [F.asc_nulls_first("doc_id"), "key", "row"]
    ordered = own.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        part, first, kind = TaskContext.get().partitionId(), True, None
        ids, texts, size, kept = [], [], 0, None  # kept: fingerprint of the first of texts where it is known

        def walked(last: bool):
            nonlocal ids, texts, size, kept, first
            fresh = texts if kept is None else texts[1:]
            own_ = fingerprints(fresh)
            own_ = own_ if kept is None else np.concatenate([kept[None, :], own_])
            if first:
                yield _batch(part, HEAD, ids[:1], kind, [len(texts[0])], texts[:1], None, own_[:1], None, None, None)
                first = False
            if len(ids) > 1:
                got = _judged(texts[:-1], own_[:-1], texts[1:], own_[1:])
                yield _batch(part, DONE, ids[:-1], kind, [len(t) for t in texts[:-1]], None, got[0], own_[:-1], *got[1:])
            if last:
                yield _batch(part, OPEN, ids[-1:], kind, [len(texts[-1])], texts[-1:], None, own_[-1:], None, None, None)
            ids, texts, kept = ids[-1:], texts[-1:], own_[-1]
            size = len(texts[0])

        for batch in batches:
            kind = batch.schema.field(0).type
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(d)
                texts.append(t.as_py())
                size += len(texts[-1])
                if size > CHUNK and len(ids) > 1:
                    yield from walked(False)
        if ids:
            yield from walked(True)

    return ordered.select("doc_id", "text").mapInArrow(run, ROWS.format(_kind(docs)))


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def embedded(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited (digest), fingerprint, edited_fingerprint (binary), near_edited, near_next."""
    spark = docs.sparkSession
    seen = stored(sequence(docs))
    shuffles_freed(spark)
    # as many rows as partitions at most: each open row's partition, and the next one that has rows
    parts = sorted(r[0] for r in seen.filter(F.col("kind") == HEAD).select("part").collect())
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, following int")
    heads = seen.filter(F.col("kind") == HEAD).select(
        F.col("part").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print")
    )
    open_ = seen.filter(F.col("kind") == OPEN).select("part", "doc_id", "n_chars", "text", "fingerprint").join(
        follows, "part"
    ).join(heads, "following")

    def finish(batches):
        for b in batches:
            prints = [np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, WIDTH) for i in (3, 5)]
            texts, following = b.column(2).to_pylist(), b.column(4).to_pylist()
            got = _judged(texts, prints[0], following, prints[1])
            yield _batch(0, DONE, b.column(0), b.schema.field(0).type, b.column(1), None, got[0], prints[0], *got[1:])

    last = open_.select("doc_id", "n_chars", "text", "fingerprint", "next_text", "next_print").mapInArrow(
        finish, ROWS.format(_kind(docs))
    )
    return seen.filter(F.col("kind") == DONE).unionByName(last).drop("part", "kind", "text")


def piece(walk: int, start: int, stop: int):
    """The bytes of the slots from start to stop of one walk of the column fingerprint."""
    return F.expr(f"substring(fingerprint, {walk * SLOTS + start + 1}, {stop - start})")


def differing(threshold: float) -> int:
    """Slots of a walk in which two fingerprints may differ and be as like as the threshold says; -1 if it asks for more than all."""
    return max((m for m in range(SLOTS + 1) if (SLOTS - m) / SLOTS >= threshold), default=-1)


def of_walk(hashed: F.Column, walk: F.Column) -> F.Column:
    """The hash with the walk in its lowest bits; WALKS is a power of two."""
    return hashed.bitwiseAND(F.lit(-WALKS)).bitwiseOR(walk.cast("long"))


def keys(walk: int, threshold: float) -> list[F.Column]:
    """Hashes of which any two fingerprints whose walk is as like as the threshold says have one in common.

    Such two differ in `most` slots at most. Of wide bands and narrow ones that are more than most when a wide one counts twice, they
    differ in at most one slot of some wide band, so what is left of it without that slot is equal, or in none of some narrow one.
    There are as few wide bands as give keys of at least KEY_SLOTS slots. The lowest bits of a key tell its walk.
    """
    most = differing(threshold)
    if most < 0:
        return []
    wide = next((n for n in range((most + 1) // 2) if SLOTS - n >= KEY_SLOTS * (most + 1 - n)), (most + 1) // 2)
    bands, length = most + 1 - wide, max(0, SLOTS - wide) // (most + 1 - wide)
    sizes = [length + (i < wide) for i in range(bands)]
    for i in range(SLOTS - sum(sizes)):  # what is left over
        sizes[-1 - i % bands] += 1
    out, at = [], 0
    for i, size in enumerate(sizes):
        for left_out in range(at, at + size) if i < wide and size else [at + size]:
            parts = piece(walk, at, left_out), piece(walk, min(left_out + 1, at + size), at + size)
            out.append(of_walk(F.xxhash64(F.lit(walk), F.lit(len(out)), *parts), F.lit(walk)))
        at += size
    return out


def alike(nodes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """node and the least other of its pairs that are as like as the threshold says, over all slots. A pair may come often."""
    a, b = nodes.select("node", "fingerprint"), nodes.select(F.col("node").alias("other"), F.col("fingerprint").alias("theirs"))
    met = pairs.distinct().join(a, "node").join(b, "other").select("fingerprint", "theirs", "node", "other")

    def verify(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, WIDTH) for i in (0, 1))
            near = pa.array(likeness(x, y) >= threshold)
            yield batch.select([2, 3]).filter(near)

    return met.mapInArrow(verify, "node long, other long").groupBy("node").agg(F.min("other").alias("least"))


def least_of(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found).groupBy("node").agg(F.min("least").alias("least"))


def asking(rows: DataFrame, done: int) -> DataFrame:
    """Of key, node, least and rank (of the node among those of its key), beyond the rank done: the rows that ask, since there are rows
    before their least so far, and those that may be asked, being before the least of another.

    asker numbers those that ask; a row that doesn't has the number of the last one before it. askers: how many ask in the key.
    """
    own = Window.partitionBy("key")
    return rows.filter(f"rank > {done}").select(
        "key", "node", "least", "rank", (F.min("node").over(own) < F.col("least")).alias("asks"),
        (F.col("node") < F.max("least").over(own)).alias("asked")
    ).filter("asks OR asked").select(
        "*", F.sum(F.col("asks").cast("long")).over(own.orderBy("node")).alias("asker"),
        F.sum(F.col("asks").cast("long")).over(own).alias("askers")
    )


def units(open_: DataFrame, done: int, until: int) -> DataFrame:
    """Rows of asking() dealt to units: in one, a block of a key's askers meets a block of what is asked, of the ranks from done to until.

    unit, node, asked here or not, and least: -1 if the row doesn't ask here. A row that asks and is asked in one unit comes once.
    """
    block, mine = f"(rank - 1) DIV {BLOCK}", f"(asker - 1) DIV {BLOCK}"
    first, last = f"{done // BLOCK}L", f"{until // BLOCK - 1}L"
    met = F.expr(f"""array_union(
        CASE WHEN asks THEN transform(sequence({first}, least({block}, {last})), x -> struct({mine} AS i, x AS j)) ELSE array() END,
        CASE WHEN asked AND rank <= {until} AND asker < askers
            THEN transform(sequence(asker DIV {BLOCK}, (askers - 1) DIV {BLOCK}), x -> struct(x AS i, {block} AS j)) ELSE array() END)""")
    return open_.select("*", F.explode(met).alias("at")).select(
        of_walk(F.xxhash64("key", "at.i", "at.j"), F.col("key").bitwiseAND(F.lit(WALKS - 1))).alias("unit"), "node",
        F.expr(f"asked AND at.j = {block}").alias("asked"), F.expr(f"IF(asks AND at.i = {mine}, least, -1L)").alias("least")
    )


def first_alike(unit: np.ndarray, node: np.ndarray, least: np.ndarray, asked: np.ndarray, prints: np.ndarray, most: int):
    """Of rows in order of unit and node: numbers of rows that ask, and of the first row of their unit that differs from them in up to
    most symbols, is asked and is before their least. Rows that ask go through their unit together, a row a step."""
    new = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    size = np.diff(np.r_[new, len(unit)])
    start = np.repeat(new, size)
    end = np.repeat(np.maximum.reduceat(np.where(asked, np.arange(len(unit)), -1), new), size)
    open_, step, found = np.flatnonzero(least >= 0), 0, []
    while len(open_):
        other = start[open_] + step
        on = (node[other] < least[open_]) & (other <= end[open_])
        open_, other = open_[on], other[on]
        near = asked[other] & ((prints[open_] != prints[other]).sum(axis=1) <= most)
        found.append((open_[near], other[near]))
        open_, step = open_[~near], step + 1
    return [np.concatenate([f[i] for f in found]) if found else open_ for i in (0, 1)]


def met_in_units(nodes: DataFrame, dealt: DataFrame, most: int) -> DataFrame:
    """node and the least other that it finds alike in its units."""

    def run(batches):
        held = []  # of the last unit so far, at most two blocks

        def found(columns):
            unit, node, least, asked, prints = columns
            a, b = first_alike(unit, node, least, asked, prints, most)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["node", "least"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            now.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, SLOTS))
            held = [np.concatenate(x) for x in zip(held, now)] if held else now
            size = np.searchsorted(held[0], held[0][-1])
            if size:
                yield found([x[:size] for x in held])
                held = [x[size:] for x in held]
        if held:
            yield found(held)

    walked = F.expr(f"substring(fingerprint, {SLOTS} * CAST(unit & {WALKS - 1} AS INT) + 1, {SLOTS})")
    sent = dealt.join(nodes.select("node", "fingerprint"), "node").select("unit", "node", "least", "asked", walked.alias("walked"))
    return sent.repartition(partitions(nodes.sparkSession), "unit").sortWithinPartitions("unit", "node").mapInArrow(
        run, "node long, least long"
    ).groupBy("node").agg(F.min("least").alias("least"))


def found_by_keys(nodes: DataFrame, near: DataFrame, threshold: float) -> list[DataFrame]:
    """Like near, node and least: lesser ones, of all with which a node shares a key.

    Each asks the rows of its keys that are before its least so far, from the first on, by rounds: at first those of a key's first
    block, by which most members of a group are settled, then many times more. Rounds go on until no row is left unasked.
    """
    each = [key for walk in range(WALKS) for key in keys(walk, threshold)]
    if not each:
        return []
    known = nodes.join(near, "node", "left").select("node", "least", "fingerprint")  # most have no least so far; the shuffle packs nulls well
    ranked = known.select("node", "least", F.explode(F.array(*each)).alias("key")).select(
        "key", "node", F.coalesce("least", "node").alias("least"),
        F.row_number().over(Window.partitionBy("key").orderBy("node")).alias("rank")
    )
    open_ = stored(asking(ranked, 0))
    shuffles_freed(nodes.sparkSession)
    fresh, done, until = [], 0, BLOCK
    last = open_.filter("asked").agg(F.max("rank")).first()[0] or 0
    while done < last:
        if fresh:
            now = least_of(fresh).withColumnRenamed("least", "_now")
            open_ = stored(asking(
                open_.join(now, "node", "left").select("key", "node", F.least("least", "_now").alias("least"), "rank"), done
            ))
        fresh.append(stored(met_in_units(nodes, units(open_, done, until), differing(threshold))))
        shuffles_freed(nodes.sparkSession)
        done, until = until, ROUND * until
    return fresh


def near_first(prints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """fingerprint (binary) and near_first (doc_id), of fingerprints that are near one of an earlier document: the least of all such.

    prints: doc_id, fingerprint, repeated as they are in the documents.
    """
    each = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL")
    ordered = each.repartitionByRange(partitions(prints.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    nodes = stored(ordered.select(F.monotonically_increasing_id().alias("node"), "doc_id", "fingerprint"))  # in order of doc_id

    # most have a near one that is the first of a band
    bands = nodes.select(
        "node",
        F.explode(
            F.array(*(F.xxhash64(F.lit(i), piece(0, i, i + BAND_SLOTS)) for i in range(0, WIDTH, BAND_SLOTS)))
        ).alias("band")
    )
    hubs = bands.groupBy("band").agg(F.min("node").alias("other"), F.count("*").alias("n")).filter("n > 1").select("band", "other")
    pairs = bands.join(dealt_anew(hubs, "band"), "band").filter("other < node").select("node", "other")
    near = stored(alike(nodes, pairs, threshold))
    found = [near, *found_by_keys(nodes, near, threshold)]
    firsts = nodes.select(F.col("node").alias("least"), F.col("doc_id").alias("near_first"))
    return least_of(found).join(firsts, "least").join(nodes, "node").select("fingerprint", "near_first")


def fingerprinted(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document its fingerprints as hex, its likeness to its edited form and its successor, and near_first: the least doc_id
    of all earlier documents that are as like, else the least one with its own fingerprint."""
    rows = embedded(docs)  # stored already, but for as many rows as partitions
    near = near_first(rows.select("doc_id", "fingerprint"), threshold)
    same = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("same_first"))
    known = same.join(near, "fingerprint", "left").select(
        "fingerprint", F.least("same_first", "near_first").alias("near_first")
    )
    hexed = lambda c: F.lower(F.hex(c))
    return rows.join(dealt_anew(known, "fingerprint"), "fingerprint").select(
        "doc_id", "n_chars", hexed("edited").alias("edited_sha256"), hexed("fingerprint").alias("fingerprint"),
        hexed("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next", "near_first"
    )
