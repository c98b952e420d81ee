"""Personal data: strict patterns, plus spans found by weak supervision.

Candidates are what the strict patterns match (base spans) and looser spans beside them: written-out addresses, numbers in
groups, digit runs of a card's length, dotted quads, and secrets (named values, opaque strings). Four labelers vote on each:
a pattern labeler (is it well formed), a gazetteer labeler (top-level domains, calling codes, issuer ranges, address blocks,
names and prefixes of secrets), a context labeler (words before it) and a format labeler (grouping, brackets, variety).
Votes are counted by combination, so what comes back is a table of bounded size. Expectation-maximisation estimates each
labeler's reliability by kind without labels, and a logistic span classifier over votes, length, share of digits and
neighbouring characters is trained on the resulting posteriors. The classifier decides every candidate that is not a base
span; base spans always stay.

Kinds are email, ip, card, phone and secret; secrets are found by the method alone and have no base spans or count.
Null texts count as empty and give no spans. One result per input row, repeated rows included; extra columns are ignored;
an empty table trains nothing and gives no rows. Patterns are linear in the text's length.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .exchange import documents

KINDS = ("email", "ip", "card", "phone")
EVERY = (*KINDS, "secret")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Looser candidates: addresses written out, numbers in groups, values that are named as secret, opaque strings.
_WRITTEN = re.compile(
    r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}+[ ]?(?:\(at\)|\[at\])[ ]?[A-Za-z0-9-]{1,63}+(?:(?:\.|[ ]?(?:\(dot\)|\[dot\])[ ]?)[A-Za-z0-9-]{1,63}+)*"
)  # 64 and 63: as long as the mail standards let a mailbox and a label be
_NUMBER = re.compile(r"(?<![0-9A-Za-z+.(-])\(?[0-9][0-9() .-]{6,24}[0-9](?![0-9A-Za-z])")
_NAMED = re.compile(r"(?<![A-Za-z_-])([A-Za-z_-]{3,40}+)[\"']?[ ]?[:=][ ]?[\"']?([A-Za-z0-9_+/=.-]{8,}+)")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/=-]{24,}+(?![A-Za-z0-9_+/=.-])")
_NORTH_AMERICA = re.compile(r"\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}$")
_GROUPS = re.compile(r"[0-9]{13,19}$|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}$")
_BEFORE = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")

# Gazetteers, stated in part: what a value may end in, begin with or be called.
_DOMAINS = frozenset(
    "com org net edu gov mil int info biz name io co ai app dev eu uk de fr es it nl be ch at pl se no fi dk pt ie cz gr ru ua tr us ca mx br ar au nz jp cn in kr za".split()
)
_CALLING = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
# first two digits of codes of three
_CALLING_THREE = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
_SECRET_NAMES = frozenset(
    "token secret password passwd pwd apikey api_key api-key access_key secret_key private_key auth bearer credential credentials".split()
)
_SECRET_PREFIXES = (
    "AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "glpat-", "sk-", "sk_live_", "xoxb-", "xoxp-", "eyJ"
)
# tokens that their prefix gives away, in parts joined by dots
_PREFIXED = re.compile(
    r"(?<![A-Za-z0-9_+/=.-])(?:" + "|".join(map(re.escape, _SECRET_PREFIXES)) + r")[A-Za-z0-9_+/=-]++(?:\.[A-Za-z0-9_+/=-]++)*+"
)
_NEAR = {
    "email": frozenset(
        "mail email e-mail contact write reach address".split()
    ), "ip": frozenset("ip host server address node peer".split()),
    "card": frozenset(
        "card visa mastercard amex credit debit account payment".split()
    ), "phone": frozenset("phone tel telephone call mobile fax cell dial".split()),
    "secret": _SECRET_NAMES | frozenset(("key", "login")),
}
_AGAINST = {
    "email": frozenset(()), "ip": frozenset(
        "version release section chapter firmware".split()
    ), "card": frozenset("isbn order invoice serial number id".split()),
    "phone": frozenset(
        "version license licence page chapter section isbn figure table year order".split()
    ), "secret": frozenset("commit sha md5 checksum digest hash url path file branch".split()),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            end = max(end, at + 1)
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Strict spans by kind, then start: (kind, start, end) in code points."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [
            ("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(
                len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")
            )
        ]
        for m in _CARD.finditer(text):
            if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]):
    """Looser spans that no base span and no earlier one overlaps."""
    found = []
    if "(at)" in text or "[at]" in text:
        found += [("email", *m.span()) for m in _WRITTEN.finditer(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text)]
        found += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(_digits(m.group())) <= 19]
        found += [("phone", *m.span()) for m in _NUMBER.finditer(text)]
        found += [("secret", *m.span()) for m in _OPAQUE.finditer(text) if not m.group().isdigit()]
    found += [("secret", *m.span()) for m in _PREFIXED.finditer(text) if m.end() - m.start() >= 20]
    if ":" in text or "=" in text:
        found += [("secret", *m.span(2)) for m in _NAMED.finditer(text) if _secret_name(m.group(1))]
    if not found:
        return
    starts, ends = [], []  # of what base spans cover, merged
    for a, b in sorted((a, b) for _, a, b in taken):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    end = 0
    for kind, a, b in sorted(found, key=lambda x: (x[1], EVERY.index(x[0]))):
        i = bisect.bisect_right(starts, a)
        if a >= end and (i == 0 or ends[i - 1] <= a) and (i == len(starts) or b <= starts[i]):
            end = b
            yield kind, a, b


def _secret_name(name: str) -> bool:
    n = name.lower().strip("_-")
    return n in _SECRET_NAMES or re.split("[_-]", n)[-1] in _SECRET_NAMES


def _calling_code(digits: str) -> bool:
    return digits[:1] in _CALLING or digits[:2] in _CALLING or digits[:2] in _CALLING_THREE


def _issuer(digits: str) -> bool:
    """Whether a card number of this length is issued under its first digits."""
    n, four = len(digits), int(digits[:4])
    if n in (13, 16, 19) and digits[0] == "4" or n == 15 and digits[:2] in ("34", "37"):
        return True
    if n == 16 and (51 <= four // 100 <= 55 or 2221 <= four <= 2720):
        return True
    return 16 <= n <= 19 and (four == 6011 or four // 100 in (62, 64, 65) or 3528 <= four <= 3589)


def votes(text: str, kind: str, a: int, b: int) -> tuple[int, ...]:
    """Of the labelers pattern, gazetteer, context, format: 1 personal, 0 not, -1 no opinion."""
    s = text[a:b]
    before = [w.lower() for w in _BEFORE.findall(text[max(0, a - 40) : a])][-3:]
    context = 1 if not _NEAR[kind].isdisjoint(before) else 0 if not _AGAINST[kind].isdisjoint(before) else -1
    if kind == "email":
        plain = re.sub(r" ?[(\[]at[)\]] ?", "@", re.sub(r" ?[(\[]dot[)\]] ?", ".", s))
        pattern = next(emails(plain), None) == (0, len(plain))
        gazetteer = plain.rpartition(".")[2].lower() in _DOMAINS
        form = s[0].isalnum() and ".." not in s
    elif kind == "ip":
        parts = s.split(".")
        pattern = all(len(p) < 4 and int(p) <= 255 for p in parts)
        gazetteer = pattern and 1 <= int(parts[0]) <= 223 and int(parts[0]) != 127  # blocks that hosts have
        form = all(p == "0" or p[0] != "0" for p in parts) and text[max(0, a - 1) : a] not in ("v", "V", ".", "-") and not re.match(r"[.-]?[0-9]", text[b : b + 2])
    elif kind == "card":
        digits = _digits(s)
        pattern, gazetteer, form = luhn(digits), _issuer(digits), _GROUPS.match(s) is not None
    elif kind == "phone":
        digits = _digits(s)
        pattern = 8 <= len(digits) <= 15 if s[0] == "+" else _NORTH_AMERICA.match(s) is not None or len(digits) == 10 and s.isdigit()
        gazetteer = _calling_code(digits) if s[0] == "+" else len(digits) == 10 and digits[0] in "23456789" and digits[3] in "23456789"
        form = s.count("(") == s.count(")") and not re.search(r"[. -]{2}|\d{11}|[.][0-9]{1,2}$", s)
    else:
        named = any(m.start(2) == a and _secret_name(m.group(1)) for m in _NAMED.finditer(text, max(0, a - 48), b))
        pattern = len(s) >= 20 and re.fullmatch(r"[A-Za-z0-9_+/=-]+(?:\.[A-Za-z0-9_+/=-]+)*", s) is not None
        gazetteer = named or s.startswith(_SECRET_PREFIXES)
        form = len(set(s)) >= 10 and any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
    return int(pattern), int(gazetteer), context, int(form)


OPENING, CLOSING = frozenset(" \t\n\"'([<{:=,"), frozenset(" \t\n\"')]>}.,;:!?")


def shape(text: str, a: int, b: int) -> tuple[int, ...]:
    """Of a span: class of its length, quarter of its share of digits, whether it stands apart on either side."""
    digits = sum(c.isdigit() for c in text[a:b])
    return min(3, (b - a) // 10), min(3, 4 * digits // (b - a)), int(a == 0 or text[a - 1] in OPENING), int(b == len(text) or text[b] in CLOSING)


def features(kind: str, v: tuple[int, ...], form: tuple[int, ...]) -> np.ndarray:
    """Of a span, for the classifier: indicators of its votes and its shape, a block for each kind."""
    own = [1.0]
    for y in v:
        own += [y == 1, y == 0]
    own += [form[0] == i for i in range(4)] + [form[1] == i for i in range(4)] + list(form[2:])
    x = np.zeros((len(EVERY), len(own)))
    x[EVERY.index(kind)] = own
    return x.ravel()


def reliabilities(counted: dict[tuple[int, ...], int], rounds: int = 100):
    """Dawid-Skene over vote combinations of one kind: share of personal spans, per labeler P(1 | personal) and P(1 |
    not), and the posterior of each combination.
    """
    keys = sorted(counted)
    n, v = np.array([counted[k] for k in keys], float), np.array(keys)
    post = np.clip(((v == 1).sum(1) + 0.5) / ((v >= 0).sum(1) + 1.0), 0.05, 0.95)  # start from the majority
    for _ in range(rounds):
        prior = np.clip(((n * post).sum() + 1) / (n.sum() + 2), 0.001, 0.999)
        log1, log0 = np.full(len(keys), math.log(prior)), np.full(len(keys), math.log(1 - prior))
        table = []
        for j in range(v.shape[1]):
            said, yes = v[:, j] >= 0, v[:, j] == 1
            p1 = ((n * post * yes).sum() + 3.0) / ((n * post * said).sum() + 4.0)
            p0 = ((n * (1 - post) * yes).sum() + 1.0) / ((n * (1 - post) * said).sum() + 4.0)
            p1, p0 = max(p1, p0), min(p1, p0)  # a labeler is no worse than chance
            table.append((float(p1), float(p0)))
            log1 += np.where(yes, math.log(p1), np.where(said, math.log(1 - p1), 0.0))
            log0 += np.where(yes, math.log(p0), np.where(said, math.log(1 - p0), 0.0))
        post = 1 / (1 + np.exp(np.clip(log0 - log1, -50, 50)))
    return float(prior), table, dict(zip(keys, post.tolist()))


Counted = dict[tuple[str, tuple[int, ...], tuple[int, ...]], int]


def train(counted: Counted, rounds: int = 500) -> np.ndarray | None:
    """Weights of the span classifier, fitted to the posteriors; every kind weighs the same, however frequent it is."""
    xs, ys, ns = [], [], []
    for kind in EVERY:
        own = {k: n for k, n in sorted(counted.items()) if k[0] == kind}
        if not own:
            continue
        by_votes: Counter = Counter()
        for (_, v, _), n in own.items():
            by_votes[v] += n
        post = reliabilities(by_votes)[2]
        total = sum(own.values())
        for (_, v, form), n in own.items():
            xs.append(features(kind, v, form))
            ys.append(post[v])
            ns.append(n / total)
    if not xs:
        return None
    x, y, n = np.array(xs), np.array(ys), np.array(ns)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        w += 1.0 * (x.T @ (n * (y - 1 / (1 + np.exp(-x @ w)))) - 1e-4 * w)
    return w


def _spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


THRESHOLD = 0.8  # least probability of a span beside the base spans


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts of base spans by kind, base spans and all spans as kind:start:end lists."""
    own = documents(docs, "doc_id", "text")

    def tally(batches):
        for batch in batches:
            seen: Counter = Counter()
            for x in batch.column(0):
                text = x.as_py()
                base = base_spans(text)
                for k, a, b in (*base, *candidates(text, base)):
                    seen[k, votes(text, k, a, b), shape(text, a, b)] += 1
            code = lambda t: ",".join(map(str, t))
            columns = [
                pa.array([k for k, _, _ in seen], pa.string()), pa.array([code(v) for _, v, _ in seen], pa.string()),
                pa.array([code(f) for _, _, f in seen], pa.string()), pa.array(list(seen.values()), pa.int64())
            ]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "votes", "shape", "n"])

    # at most 5 kinds x 24 combinations of votes x 64 shapes come back
    counted = own.select("text").mapInArrow(
        tally, "kind string, votes string, shape string, n long"
    ).groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n")).collect()
    numbers = lambda s: tuple(map(int, s.split(",")))
    weights = train({(r["kind"], numbers(r["votes"]), numbers(r["shape"])): r["n"] for r in counted})

    def label(batches):
        order = {k: i for i, k in enumerate(EVERY)}
        decided: dict[tuple, bool] = {}  # bounded by the combinations

        def personal(text: str, k: str, a: int, b: int) -> bool:
            key = k, votes(text, k, a, b), shape(text, a, b)
            if key not in decided:
                decided[key] = 1 / (1 + math.exp(-float(features(*key) @ weights))) >= threshold
            return decided[key]

        for batch in batches:
            rows = []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = x.as_py()
                base = base_spans(text)
                n = Counter(k for k, _, _ in base)
                more = [s for s in candidates(text, base) if personal(text, *s)]
                rows.append(
                    (
                        key, *(n[k] for k in KINDS), _spans(base),
                        _spans(sorted(base + more, key=lambda s: (order[s[0]], s[1], s[2])))
                    )
                )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(
                        c, pa.int64() if i < 5 else pa.string()
                    ) for i, c in enumerate(zip(*rows) if rows else [[]] * 7)
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"]
            )

    return own.mapInArrow(label, SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans"
    )
