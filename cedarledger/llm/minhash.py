"""Near-duplicates by HyperMinHash.

A document's set of word shingles is hashed into REGISTERS buckets; a register keeps the least value of its bucket in
compressed form, the count of leading zeros and the next MANTISSA bits. Empty registers borrow from their neighbours.
Bands of registers give candidates: documents that agree on a band hang together, and each hanging group is resolved by
comparing members of parts not yet joined. Before two full sets are compared, the Jaccard similarity is estimated from
their registers, corrected for registers that agree by chance; only pairs far below the threshold are left out. Links are
always confirmed on the full sets, by integers.

Sets of at most FEW shingles, in which one shingle can move every band, have an exact way beside the bands: in any order of
all shingles, two linked sets share one of their first n - ceil(PERCENT n / 100) + 1. The order puts frequent shingles last.
Sets that share such a shingle are a hanging group too, and are resolved in the same way, whatever their bands say.

Equal sets are one class from the start: a class is compared once, however many copies it has. No pairs are listed, and a
document is compared with a part of its group until one link is found. A group of more than BLOCK members is cut into blocks
that are resolved apart; every member is then compared with one hub of the whole group, and what still hangs outside the
group's largest part goes past every block. So no task holds more than a block, and only the rest is compared again. A
block has at most BLOCK members and about BLOCK_BYTES of sets.

Null or wordless texts have an empty set, are linked with nothing and stay. Documents of fewer words than a shingle have
the whole sequence as their one shingle. Repeated rows are copies. A null doc_id counts as smaller than any other and
gives a null component_id. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components
from .exchange import dealt_anew, documents, stored, text_key, together

SHINGLE = 3
PERCENT = 85
REGISTERS = 64
BANDS = 16
MANTISSA = 10
SURE_SIZE = 256  # smaller sets are compared without an estimate
MARGIN = 0.35  # pairs estimated further below the threshold are left out: about eight standard deviations
BLOCK = 4096  # members of a hanging group that one task holds
BLOCK_BYTES = 64 << 20  # of their sets, expected; one larger set is a block of its own
FEW = 96  # shingles of a set that is also compared by its prefix; bands lose next to nothing from 80 on
FREQUENT = 65_536  # shingles of small sets whose frequency counts in the order; the others come first, by hash
LOWEST = -(1 << 63)
NODE_BYTES = 16  # of a set's name, its hash
SIGNATURES = "doc_id long, text_key long, node binary, n_shingles long, registers binary, few binary"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < self.most:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_set(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; of a shorter sequence, one of all its words."""
    n = len(hashes)
    if not n:
        return hashes
    w = min(k, n)
    h = np.full(n - w + 1, np.uint64(w))
    for i in range(w):
        h = mix(h * _A + hashes[i : n - w + 1 + i] * _B)
    return np.unique(h)


def registers(s: np.ndarray, k: int = REGISTERS) -> np.ndarray:
    """Of a non-empty sorted set: per bucket (top bits) the leading zeros and mantissa of its least value; empty ones
    take the next non-empty register, moved by the distance.
    """
    bits = np.uint64(k.bit_length() - 1)
    bucket = (s >> (np.uint64(64) - bits)).astype(np.int64)
    filled, first = np.unique(bucket, return_index=True)  # sorted, so the first is the least
    low = s[first] << bits
    # leading zeros by comparing against powers of two
    zeros = np.zeros(len(low), np.int64)
    x = low.copy()
    for step in (32, 16, 8, 4, 2, 1):
        small = x < (np.uint64(1) << np.uint64(64 - step))
        zeros += step * small
        x = np.where(small, x << np.uint64(step), x)
    mantissa = ((x << np.uint64(1)) >> np.uint64(64 - MANTISSA)).astype(np.int64)
    packed = (np.minimum(zeros, 62) << MANTISSA) | mantissa
    at = np.searchsorted(filled, np.arange(k))
    source = filled[at % len(filled)]
    away = (source - np.arange(k)) % k
    return ((packed[at % len(filled)] + away * 40503) & 0xFFFF).astype(np.uint16)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z only, and exactly the six ASCII spaces


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            node, n, regs, few = [], [], [], []
            for x in batch.column(2):
                s = shingle_set(hashes.of(words_of(x.as_py().encode("utf-8"))), shingle)
                n.append(len(s))
                node.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                # register i of band j is number j + 16 i, so that a band's registers lie apart
                regs.append(registers(s).reshape(-1, BANDS).T.tobytes() if len(s) else None)
                few.append(s.tobytes() if 0 < len(s) <= FEW else None)
            columns = [
                batch.column(0), batch.column(1), pa.array(node, pa.binary()), pa.array(n, pa.int64()),
                pa.array(regs, pa.binary()), pa.array(few, pa.binary())
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "node", "n_shingles", "registers", "few"])

    return documents(docs, "doc_id", "text").select(
        "doc_id", text_key().alias("text_key"), "text"
    ).mapInArrow(run, SIGNATURES)


def hanging(nodes: DataFrame) -> DataFrame:
    """node, part: nodes that hang together by equal bands, under the least of them; nodes that hang alone are left out.
    """
    width = 2 * REGISTERS // BANDS
    bands = nodes.select(
        "node",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(BANDS - 1)),
                lambda j: F.xxhash64(j, F.substring(F.col("registers"), j * width + 1, F.lit(width)))
            )
        ).alias("band")
    )
    least = bands.groupBy("band").agg(F.min("node").alias("m"), F.count("*").alias("n")).filter("n > 1")
    edges = bands.join(dealt_anew(least, "band"), "band").filter(F.col("node") != F.col("m")).select(
        F.col("node").alias("u"), F.col("m").alias("v")
    )
    under = components(edges)
    return under.select(F.col("u").alias("node"), F.col("v").alias("part")).unionByName(
        under.select(F.col("v").alias("node"), F.col("v").alias("part")).distinct()
    )


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Of a set's shingles in order, so many that every other set linked with it shares one; none if all linked sets are
    equal to it.
    """
    return n + (-percent * n // 100) + 1 if 100 * n >= percent * (n + 1) or 100 * (n - 1) >= percent * n else 0


def frequent(small: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of small sets, sorted by hash, and their places from rare to frequent."""

    def count(batches):
        for batch in batches:
            h, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    rows = small.select("few").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    h = np.array([x["h"] for x in rows], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], (len(rows) - np.arange(len(rows)))[order]


def by_prefix(small: DataFrame, percent: int) -> DataFrame:
    """Confirmed links u, v among small sets: node, least, few."""
    shared = small.sparkSession.sparkContext.broadcast(frequent(small))

    def keys(batches):
        known, place = shared.value
        for batch in batches:
            out = []
            for node, few in zip(*(c.to_pylist() for c in batch.columns)):
                s = np.frombuffer(few, np.uint64)
                if p := prefix_length(len(s), percent):
                    rank = np.zeros(len(s), np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        rank = np.where(known[at] == s, place[at], 0)
                    out += [(node, h.tobytes(), len(s)) for h in s[np.argsort(rank, kind="stable")[:p]]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.binary(), pa.binary(), pa.int64()))],
                ["node", "part", "n_shingles"]
            )

    each = small.select("node", "few").mapInArrow(keys, "node binary, part binary, n_shingles long")
    shared_by = each.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1").select("part")
    met = stored(each.join(dealt_anew(shared_by, "part"), "part"))
    # a set hangs in several groups: in each under a name of its own, the node and then the group
    placed = met.select("node", "part").join(small, "node").select(
        "part", F.concat("node", "part").alias("node"), "least", F.col("few").alias("members")
    )
    found = resolve_groups(placed, met, percent)
    own = lambda c: F.substring(F.col(c), 1, NODE_BYTES)
    return found.select(own("node").alias("u"), own("comp").alias("v")).filter("u <> v").distinct()


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def estimate(agree: np.ndarray, k: int = REGISTERS) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less what agrees by chance: about 2^-MANTISSA times the
    chance of equal zeros.
    """
    chance = 2.0**-MANTISSA / 3
    return (agree / k - chance) / (1 - chance)


def resolve(sets: list[np.ndarray], regs: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Component number of each member of a hanging group."""
    n = len(sets)
    part = np.arange(n)
    sizes = np.array([len(s) for s in sets])
    hub = 0
    for x in range(1, n):
        if part[x] != part[hub] and linked(sets[x], sets[hub], percent):
            part[part == part[x]] = part[hub]
        if (part[:x] == part[x]).all():
            continue
        agree = (regs[:x] == regs[x]).sum(1)
        fit = (part[:x] != part[x]) & (
            100 * np.minimum(sizes[:x], sizes[x]) >= percent * np.maximum(sizes[:x], sizes[x])
        )
        sure = np.minimum(sizes[:x], sizes[x]) < SURE_SIZE
        fit &= sure | (estimate(agree) >= percent / 100 - MARGIN)
        found = np.flatnonzero(fit)
        for y in found[np.argsort(-agree[found], kind="stable")].tolist():
            if part[y] != part[x] and linked(sets[x], sets[y], percent):
                part[part == part[x]] = part[y]
                hub = y
    return part


MEMBERS = "part binary, node binary, least long, members binary"
IN_BLOCK = "key binary, part binary, node binary, least long, comp binary, guest boolean, members binary"
LINKED = "u binary, v binary"


def _groups(batches, n: int):
    """Rows of a key, which lie together, as tuples of n columns; equal nodes (copies of a row) come once."""
    key, rows = None, {}
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if r[0] != key:
                if rows:
                    yield list(rows.values())
                key, rows = r[0], {}
            rows[r[2], r[5] if n > 5 else None] = r
    if rows:
        yield list(rows.values())


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["u", "v"]
    )


def _local(percent: int):
    """Within a block: each node and the first node of its component there (itself, if it is alone)."""

    def run(batches):
        for rows in _groups(batches, 5):
            # largest first: a whole document is a better first partner than a cut one
            rows.sort(key=lambda r: (-len(r[4]), r[3], r[2]))
            own = [np.frombuffer(r[4], np.uint64) for r in rows]
            found = resolve(own, np.array([registers(s) for s in own]), percent).tolist()
            first: dict[int, bytes] = {}
            for p, r in zip(found, rows):
                first.setdefault(p, r[2])
            yield _edges([(r[2], first[p]) for p, r in zip(found, rows)])

    return run


def _past(percent: int):
    """Guests of a block against its members of other components: one edge for each component that a guest is linked
    with.
    """

    def run(batches):
        for rows in _groups(batches, 7):
            hosts, guests = [r for r in rows if not r[5]], [r for r in rows if r[5]]
            if not hosts or not guests:
                continue
            own = [np.frombuffer(r[6], np.uint64) for r in hosts]
            regs, sizes = np.array([registers(s) for s in own]), np.array([len(s) for s in own])
            numbers = {c: i for i, c in enumerate(dict.fromkeys(r[4] for r in rows))}
            part = np.array([numbers[r[4]] for r in hosts])
            out = []
            for g in guests:
                s = np.frombuffer(g[6], np.uint64)
                agree = (regs == registers(s)).sum(1)
                fit = (part != numbers[g[4]]) & (100 * np.minimum(sizes, len(s)) >= percent * np.maximum(sizes, len(s)))
                fit &= (np.minimum(sizes, len(s)) < SURE_SIZE) | (estimate(agree) >= percent / 100 - MARGIN)
                found, met = np.flatnonzero(fit), set()
                for y in found[np.argsort(-agree[found], kind="stable")].tolist():
                    if part[y] not in met and linked(s, own[y], percent):
                        met.add(part[y])
                        out.append((g[4], hosts[y][4]))
            yield _edges(out)

    return run


def _hub_links(percent: int):
    def run(batches):
        for batch in batches:
            out = []
            for comp, members, hub_comp, hub in zip(*(c.to_pylist() for c in batch.columns)):
                if comp != hub_comp and linked(
                    np.frombuffer(members, np.uint64), np.frombuffer(hub, np.uint64), percent
                ):
                    out.append((comp, hub_comp))
            yield _edges(out)

    return run


def resolve_groups(members: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """node, comp (a node) of the members of hanging groups. parts: part, node, n_shingles."""
    blocks = F.greatest(F.count("*") / BLOCK, 8 * F.sum("n_shingles") / BLOCK_BYTES)
    sizes = stored(parts.groupBy("part").agg(F.ceil(blocks).cast("int").alias("blocks")))
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks"))).otherwise(0)
    key = lambda b: F.concat("part", F.encode(b.cast("string"), "UTF-8"))
    placed = members.join(sizes, "part").select(key(block).alias("key"), "part", "node", "least", "members", "blocks")
    if sizes.filter("blocks > 1").isEmpty():
        local = together(placed, "key").select(
            "key", "part", "node", "least", "members"
        ).mapInArrow(_local(percent), LINKED)
        return local.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    placed = stored(placed)
    local = stored(
        together(placed, "key").select("key", "part", "node", "least", "members").mapInArrow(_local(percent), LINKED)
    ).select(F.col("u").alias("node"), F.col("v").alias("comp"))
    # of the groups that were cut: one hub each, the first node of the largest component of any block
    large = placed.filter("blocks > 1").join(local, "node")
    hubs = large.groupBy("part", "comp").agg(F.count("*").alias("n")).groupBy("part").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("hub_comp")
    )
    hub_sets = hubs.join(
        large.select(F.col("node").alias("hub_comp"), F.col("members").alias("hub")).dropDuplicates(["hub_comp"]),
        "hub_comp"
    )
    by_hub = large.select("part", "comp", "members").join(hub_sets, "part").select("comp", "members", "hub_comp", "hub").mapInArrow(_hub_links(percent), LINKED).distinct()
    under_hub = components(by_hub)
    joined = _joined(local, under_hub)
    # what is still outside its group's hub goes past every block of the group
    hub_of = _joined(
        hubs.select("part", F.col("hub_comp").alias("comp")), under_hub
    ).select("part", F.col("comp").alias("main"))
    now = placed.filter("blocks > 1").join(joined, "node").join(hub_of, "part")
    hosts = now.select("key", "part", "node", "least", "comp", F.lit(False).alias("guest"), "members")
    guests = now.filter(F.col("comp") != F.col("main")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        key(F.col("b")).alias("key"), "part", "node", "least", "comp", F.lit(True).alias("guest"), "members"
    )
    more = together(hosts.unionByName(guests), "key").select(
        "key", "part", "node", "least", "comp", "guest", "members"
    ).mapInArrow(_past(percent), LINKED).distinct()
    return _joined(joined, components(more))


def _joined(local: DataFrame, under: DataFrame) -> DataFrame:
    """local with its comp replaced by the component that it belongs to."""
    up = under.select(F.col("u").alias("comp"), F.col("v").alias("_top"))
    return local.join(up, "comp", "left").select(
        *[c for c in local.columns if c != "comp"], F.coalesce("_top", "comp").alias("comp")
    )


def _with_links(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps, and components that links between nodes join; nodes of links may be new."""
    ends = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
    every = stored(comps.unionByName(ends.join(comps, "node", "left_anti").select("node", F.col("node").alias("comp"))))
    of = lambda end: every.select(F.col("node").alias(end), F.col("comp").alias(f"_{end}"))
    edges = links.join(of("u"), "u").join(of("v"), "v").select(
        F.col("_u").alias("u"), F.col("_v").alias("v")
    ).filter("u <> v")
    return _joined(every, components(edges))


def _least(parts: DataFrame, comps: DataFrame) -> DataFrame:
    """Of each node the least doc_id of its component."""
    own = comps.join(parts.select("node", "least"), "node")
    least = own.groupBy("comp").agg(F.min("least").alias("component"))
    return own.select("node", "comp").join(dealt_anew(least, "comp"), "comp").select("node", "component")


def judged(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id (least doc_id of the component), kept: one row per input row."""
    own = documents(docs, "doc_id", "text")
    signed = stored(signatures(own, shingle))
    nodes = signed.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.min(F.coalesce("doc_id", F.lit(LOWEST))).alias("least"), F.first("n_shingles").alias("n_shingles"),
        F.first("registers").alias("registers"), F.first("few").alias("few")
    )
    parts = stored(hanging(nodes.select("node", "registers")).join(nodes.select("node", "least", "n_shingles"), "node"))

    def sets(batches):
        hashes = WordHashes()
        for batch in batches:
            out = []
            for text, node, part, least in zip(*(c for c in batch.columns)):
                s = shingle_set(hashes.of(words_of(text.as_py().encode("utf-8"))), shingle)
                if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == node.as_py():
                    out.append((part.as_py(), node.as_py(), least.as_py(), s.tobytes()))
            for i in range(0, len(out), 500):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c, t) for c, t in zip(
                            zip(*out[i : i + 500]), (pa.binary(), pa.binary(), pa.int64(), pa.binary())
                        )
                    ],
                    ["part", "node", "least", "members"]
                )

    wanted = parts.select(F.col("least").alias("_id"), "node", "part", "least")
    keyed = own.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("_id"), "text")
    members = keyed.join(wanted.hint("shuffle_hash"), "_id").select("text", "node", "part", "least").mapInArrow(sets, MEMBERS)
    comps = resolve_groups(members, parts, percent)
    small = nodes.filter(F.col("few").isNotNull()).select("node", "least", "few")
    links = stored(by_prefix(small, percent))
    if not links.isEmpty():
        comps = _with_links(comps, links)
    resolved = _least(nodes, comps)
    labels = nodes.select("node", "least").join(resolved, "node", "left").select(
        "node", F.coalesce("component", "least").alias("component")
    )
    rows = signed.select("doc_id", "text_key", "n_shingles", "node")
    # sets without a word are no group of copies; a hot group of copies is split, as both sides come straight from a
    # shuffle
    met = rows.filter(F.col("node").isNotNull()).join(dealt_anew(labels, "node"), "node")
    out = met.unionByName(
        rows.filter(F.col("node").isNull()).withColumn("component", F.coalesce("doc_id", F.lit(LOWEST)))
    )
    component = F.nullif(F.col("component"), F.lit(LOWEST))
    return out.select(
        "doc_id", "text_key", "n_shingles", component.alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of the component), kept: one row per input row."""
    return judged(docs, shingle, percent).drop("text_key")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without those of which a near-duplicate with a smaller doc_id stays. All rows of a
    group's least doc_id stay; rows of another text under a doc_id that goes are judged apart.
    """
    gone = judged(docs.select("doc_id", "text")).filter(~F.col("kept")).select(
        F.col("doc_id").alias("_gone"), F.col("text_key").alias("_key")
    ).distinct()
    return docs.join(
        gone.hint("shuffle_hash"),
        docs["doc_id"].eqNullSafe(gone["_gone"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_key"]),
        "left_anti"
    )
