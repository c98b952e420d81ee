"""Operators 11 to 13 against plain versions and, where there is one, their SQL, on odd rows."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import lru_cache
from zlib import crc32

import duckdb
import numpy as np
import pytest
import xxhash

from cedarledger.llm import conversations as C, divergence as D, fingerprints as P, queries as Q

TURNS = "conv_id long, turn int, role string, text string, copies string, repeats string, n long"


def by_sql(name, columns, **tables):
    """Rows of the query's SQL over data frames."""
    db = duckdb.connect()
    for t, df in tables.items():
        frame = df.toArrow()  # noqa: F841
        db.execute(f"CREATE TABLE {t} AS SELECT * FROM frame")
    got = db.execute(Q.oracle_sql()[name])
    at = [[d[0] for d in got.description].index(c) for c in columns]
    return sorted(str(tuple(r[i] for i in at)) for r in got.fetchall())


def as_str(df):
    return sorted(str(tuple(r)) for r in df.collect())


# -- 11

def plain_audit(rows, min_docs, top=50, k=5, scale=10**9):
    count, seen, groups = defaultdict(Counter), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = "".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in low).split(" ")
        words = [w for w in words if w]
        count[lang, source].update(words)
        seen.update((lang, w) for w in set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in seen.items() if x == lang and n >= min_docs]
        own = [g for g in groups if g[0] == lang]
        total = Counter()
        for g in own:
            total.update({w: count[g][w] for w in kept})
        p = lambda c: {w: 1 + scale * (c[w] + k) // (sum(c[x] for x in kept) + k * len(kept)) for w in kept}
        q, of = p(total), {g: p(count[g]) for g in own}
        for g in own:
            pairs = sorted((-sum(abs(of[g][w] - of[o][w]) for w in kept), o[1].encode(), o[1]) for o in own if o != g)
            terms = sorted((q[w] - of[g][w], w.encode(), w) for w in kept if count[g][w] and of[g][w] > q[w])[:top]
            for part, ranked in (("pair", pairs), ("term", terms)):
                out += [(lang, g[1], part, item, -v, i + 1) for i, (v, _, item) in enumerate(ranked)]
    return out


@pytest.mark.parametrize("min_docs", [2, 4, 30])
def test_divergence_is_the_plain_sums(docs, min_docs):
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.select("lang", "source", "text").collect()]
    want = plain_audit(rows, min_docs)
    assert as_str(D.audit(docs, min_docs)) == sorted(map(str, want))
    assert {r[2] for r in want} == ({"pair", "term"} if min_docs < 30 else {"pair"})


def test_divergence_of_hot_source_and_its_sql(spark):
    r = random.Random(3)
    rows = [
        (i, " ".join(r.choice(["the", "Été", "LINE", "x1y", f"w{chr(97 + r.randrange(20))}"]) for _ in range(r.randrange(60))), r.choice(["en", None, "fr"]), "hot" if i % 3 else f"s{i % 7}")
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    got = D.audit(df)
    assert as_str(got) == by_sql("op11_divergence", got.columns, documents=df)
    assert got.filter("part = 'term'").count() > 0


# -- 12

def odd_turns(spark, seed):
    r = random.Random(seed)
    texts = ["Hi.", "", "cut", " \t", "what?", None, "a\nb!", "ok. \n", "Hi.", "é…", "end\x0b."]
    rows = []
    for conv in [None, *range(-3, 120)]:
        for _ in range(r.randrange(1, 8)):
            turn = r.choice([None, *range(7)])
            rows.append((conv, turn, r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), r.choice(texts), "x", "y", 1))
    return rows, spark.createDataFrame(rows, TURNS).repartition(4)


def plain_repair(rows):
    """rows of one conversation, damaged, in order; the cheapest edits by a search from the end."""
    space = "\t\n\x0b\x0c\r "
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(space)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state, inserted):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        to = after[state]
        if inserted < 3:
            c, a, o = best(i, to, inserted + 1)
            ways.append((c + 3, "I" + a, (names[to] + ":", *o)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, o = best(i + 1, state, 0)
            ways.append((c + 4, "D" + a, o))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                for keep in {to, "s"} if state == "" else {to}:
                    if role[:1] == keep:
                        c, a, o = best(i + 1, keep, 0)
                        ways.append((c + more, "K" + a, (f"{role}:{text}", *o)))
                c, a, o = best(i + 1, to, 0)
                ways.append((c + more + 3, "R" + a, (f"{names[to]}:{text}", *o)))
        return min(ways, default=(1 << 40, "", ()))

    cost, audit, out = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    two = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(x not in ("su", "ua", "au") for x in two), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()
    )


def in_order(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))


@pytest.mark.parametrize("damage", [False, True])
def test_repairs_are_the_cheapest(spark, damage):
    rows, df = odd_turns(spark, 11 + damage)
    of = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if code == 1 else text.translate(str.maketrans("", "", ".!?")) if code == 2 else text
        of[conv] += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    want = sorted(str((conv, *plain_repair(in_order(own)))) for conv, own in of.items())
    got = C.repaired(C.damaged(df) if damage else C.kept_as(df))
    assert as_str(got) == want
    if damage:
        assert by_sql("op12_conversations", got.columns, conversations=df) == want


def test_a_long_conversation_streams(spark):
    """Open rows stay few however long it is, and the result is that of the plain search."""
    r = random.Random(5)
    rows = [(i, r.choice(["user", "assistant"]), f"text {i}{r.choice(['.', '!', '', '.'])}") for i in range(180)]
    now, most = C.Conversation(1), 0
    for turn, role, text in rows:
        now.add(turn, role, text, False)
        most = max(most, len(now.open))
    assert now.result()[1:] == plain_repair(rows) and most < 40


# -- 13

def plain_print(text):
    bits, steps, out = P.shared_bits(), P.sampled_steps(), np.zeros(P.WIDTH, np.uint8)
    codes = [ord(c) % 255 + 1 for c in text]
    for w in range(P.WALKS):
        own = bits[:, w * 256 : w * 256 + 256]
        p = j = 0
        while p < len(codes):
            if j in steps:
                out[steps[j][w]] = codes[p]
            p += int(own[j % P.PERIOD, codes[p]])
            j += 1
    return out.tobytes()


def alike(a, b):
    n = P.SLOTS
    return max(sum(x == y for x, y in zip(a[i : i + n], b[i : i + n])) / n for i in range(0, P.WIDTH, n))


def test_fingerprints_are_those_of_plain_walks(docs, docs_rows):
    key = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    rows = sorted(((d, t or "") for d, t in docs_rows), key=lambda x: (x[0] is not None, x[0] or 0, key(x[1])))
    prints = {t: plain_print(t) for _, t in rows}
    want = []
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        h = len(t) // 2
        e = t[: len(t) - h] + after[:h]
        pe = plain_print(e)
        want.append(
            (d, len(t), hashlib.sha256(e.encode()).hexdigest(), prints[t].hex(), pe.hex(), alike(prints[t], pe), alike(prints[t], prints[after]))
        )
    got = P.fingerprinted(docs)
    assert as_str(got.drop("near_first")) == sorted(map(str, want))

    first = {}  # of each fingerprint
    for d, t in rows:
        if d is not None:
            first[prints[t]] = min(d, first.get(prints[t], d))
    bands = defaultdict(list)
    for p, d in first.items():
        for i in range(0, P.WIDTH, P.BAND_SLOTS):
            bands[i, p[i : i + P.BAND_SLOTS]].append((d, p))
    near = dict(first)
    for own in bands.values():
        least = min(d for d, _ in own)
        hubs = [p for d, p in own if d == least]
        for d, p in own:
            if len(hubs) == 1 and alike(p, hubs[0]) >= P.THRESHOLD:
                near[p] = min(near[p], least)
    found = {(r["doc_id"], r["fingerprint"]): r["near_first"] for r in got.collect()}
    assert all(found[d, prints[t].hex()] == near.get(prints[t]) for d, t in rows if d not in (1, 2))
    copies = {d: n for (d, _), n in found.items() if d in range(30, 34)}
    assert set(copies.values()) == {-5}  # the same text with one word more


def varied(r, base, most):
    """A fingerprint that differs from base in up to most random slots of one walk, and in all of the other."""
    out, walk = np.array(base), r.randrange(P.WALKS)
    out[(1 - walk) * P.SLOTS : (2 - walk) * P.SLOTS] = r.randrange(100, 200)
    for slot in r.sample(range(P.SLOTS), r.randint(0, most)):
        out[walk * P.SLOTS + slot] = r.randrange(200, 250)
    return out


@pytest.mark.parametrize("threshold", [0.8, 0.9, 1.0, 0.6, 1.1])
def test_no_earlier_likeness_is_missed(spark, threshold):
    """Also of those that no band of slots brings together, and that are near a later document of a band but not its first."""
    r = random.Random(8)
    prints = []
    for _ in range(12):
        base = np.array([r.randrange(1, 100) for _ in range(P.WIDTH)], np.uint8)
        group = [base]
        for _ in range(25):
            group.append(varied(r, r.choice(group), 14))
        prints += group
    r.shuffle(prints)
    rows = [(i * 3, p.tobytes()) for i, p in enumerate(prints)]
    first = {}
    for d, p in rows:
        first.setdefault(p, d)
    want, missed = {}, 0
    for d, p in rows:
        near = min((e for q, e in first.items() if e < d and alike(p, q) >= threshold), default=None)
        if first[p] == d and near is not None:
            want[p] = near
            banded = [e for q, e in first.items() if e < d and alike(p, q) >= threshold and any(p[i : i + 8] == q[i : i + 8] for i in range(0, P.WIDTH, 8))]
            missed += near not in banded
    got = P.near_first(spark.createDataFrame(rows, "doc_id long, fingerprint binary"), threshold)
    assert {bytes(x["fingerprint"]): x["near_first"] for x in got.collect()} == want
    assert threshold != 0.8 or missed > 5


def test_a_group_is_not_compared_in_pairs(spark, monkeypatch):
    """Copies of which half are too unlike the group's first, but like its second or third."""
    r = random.Random(9)
    base = np.array([r.randrange(1, 100) for _ in range(P.WIDTH)], np.uint8)
    prints = [base] + [varied(r, base, 8) for _ in range(600)]
    rows = [(i, p.tobytes()) for i, p in enumerate(prints[1:] + prints[:1])]
    first = {}
    for d, p in rows:
        first.setdefault(p, d)
    x = np.array([np.frombuffer(p, np.uint8) for p in first])
    ids, near = list(first.values()), [np.flatnonzero(P.likeness(x, y) >= P.THRESHOLD)[0] for y in x]
    want = {p: ids[j] for i, (p, j) in enumerate(zip(first, near)) if j < i}
    assert sum(j == 0 for j in near) < 0.7 * len(near)
    met, count = P.alike, []
    monkeypatch.setattr(P, "alike", lambda nodes, pairs, threshold: (count.append(pairs.count()), met(nodes, pairs, threshold))[1])
    got = P.near_first(spark.createDataFrame(rows, "doc_id long, fingerprint binary"))
    assert {bytes(y["fingerprint"]): y["near_first"] for y in got.collect()} == want
    assert sum(count) < 20 * len(rows), count


def group(r, n, least, most):
    """n fingerprints that differ from one base in some random slots of each walk, and the first alike of each, if there is one."""
    base = np.array([r.randrange(1, 100) for _ in range(P.WIDTH)], np.uint8)
    prints = []
    for _ in range(n):
        out = np.array(base)
        for walk in range(P.WALKS):
            for slot in r.sample(range(P.SLOTS), r.randint(least, most)):
                out[walk * P.SLOTS + slot] = r.randrange(100, 250)
        prints.append(out)
    x = np.array(prints)
    near = [np.flatnonzero(P.likeness(x, y) >= P.THRESHOLD)[0] for y in x]
    return [(i, p.tobytes()) for i, p in enumerate(prints)], {prints[i].tobytes(): j for i, j in enumerate(near) if j < i}


def rows_shuffled(spark, make):
    """Rows written to shuffles by the stages that make runs."""
    sc = spark.sparkContext
    jvm, gateway, context = sc._jvm, sc._gateway, sc._jsc.sc()

    def stages():
        context.listenerBus().waitUntilEmpty(30_000)
        seq = context.statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {seq.apply(i).stageId(): seq.apply(i).shuffleWriteRecords() for i in range(seq.size())}

    before = max(stages(), default=-1)
    make()
    return sum(n for k, n in stages().items() if k > before)


def test_rows_grow_with_a_group_and_not_with_its_square(spark):
    """Members share keys with most others and are alike to next to none, so each has to meet all that were before it."""
    count = []
    for n in (400, 1200):
        rows, want = group(random.Random(n), n, 15, 19)
        prints = spark.createDataFrame(rows, "doc_id long, fingerprint binary")
        got = {}
        count.append(rows_shuffled(spark, lambda: got.update((bytes(x["fingerprint"]), x["near_first"]) for x in P.near_first(prints).collect())))  # noqa: B023
        assert got == want and len(want) < n / 10
    assert 2 * count[0] < count[1] < 3.6 * count[0], count


@pytest.mark.parametrize(("block", "rounds"), [(4, 2), (16, 4), (32, 16)])
def test_likeness_beyond_the_first_block_of_a_key(spark, monkeypatch, block, rounds):
    rows, want = group(random.Random(block), 300, 5, 11)
    assert sum(j > 2 * block for j in want.values()) > (0 if block == 32 else 5)
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "ROUND", rounds)
    got = P.near_first(spark.createDataFrame(rows, "doc_id long, fingerprint binary"))
    assert {bytes(x["fingerprint"]): x["near_first"] for x in got.collect()} == want


def test_steps_through_units_stop_at_the_first_alike():
    """Units of random rows, some of which don't ask or aren't asked, against each row's own search."""
    r = np.random.RandomState(4)
    unit = np.sort(r.randint(0, 40, 500))
    node = np.arange(500) * 3
    least = np.where(r.random_sample(500) < 0.3, -1, np.minimum(node, r.randint(0, 1500, 500)))
    asked = r.random_sample(500) < 0.7
    prints = r.randint(0, 3, (500, P.SLOTS)).astype(np.uint8)
    want = []
    for i in np.flatnonzero(least >= 0):
        for j in range(i):
            if unit[j] == unit[i] and asked[j] and node[j] < least[i] and (prints[i] != prints[j]).sum() <= 40:
                want.append((i, j))
                break
    got = P.first_alike(unit, node, least, asked, prints, 40)
    assert sorted(zip(*(x.tolist() for x in got))) == want and len(want) > 50
    assert [len(x) for x in P.first_alike(unit, node, np.full(500, -1), asked, prints, 40)] == [0, 0]


def test_likeness_falls_with_edits_and_finds_near_copies(spark):
    r = random.Random(2)
    text = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n))
    rows, hits, strange = [], 0, []
    for i in range(40):
        own = text(300)
        words = own.split()
        words[-3] = "edited"
        rows += [(10 * i + 1, own), (10 * i + 2, " ".join(words)), (10 * i + 5, text(300))]
    got = {r["doc_id"]: r for r in P.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(40):
        hits += got[10 * i + 2]["near_first"] == 10 * i + 1
        strange += [got[10 * i + 2]["near_next"], got[10 * i + 5]["near_next"]]
        assert got[10 * i + 5]["near_first"] == 10 * i + 5
        assert got[10 * i + 1]["near_next"] > 0.8
    assert hits == 40 and max(strange) < 0.5
    assert 0.3 < np.mean([r["near_edited"] for r in got.values()]) < 0.9


def test_empty_tables(spark, empty):
    assert D.audit(empty).count() == 0 and P.fingerprinted(empty).count() == 0
    assert C.repaired(C.damaged(spark.createDataFrame([], TURNS))).count() == 0
    one = P.fingerprinted(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert one["near_next"] == one["near_edited"] == 1 and set(one["fingerprint"]) == {"0"} and one["n_chars"] == 0
