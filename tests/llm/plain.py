"""Plain versions of the contracts, by definition and without regard to speed. Documents are (doc_id, text) pairs in row
order.
"""

import collections
import hashlib
import re

LOWEST = -(1 << 63)
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def low(s):
    return s.translate({i: i + 32 for i in range(65, 91)})


def order(d):
    return LOWEST if d is None else d


def decontamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows, widths = collections.defaultdict(set), set()
    for i, t in items:
        w = word.findall(low(t or ""))
        if w:
            n = min(13, len(w))
            widths.add(n)
            for p in range(len(w) - n + 1):
                windows[tuple(w[p : p + n])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = word.findall(low(t or "")), set(), set()
        for n in widths:
            for p in range(len(w) - n + 1):
                if x := windows.get(tuple(w[p : p + n])):
                    hit.update(range(p, p + n))
                    found |= x
        out.append(
            (
                d, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))),
                len(hit) > 0 and 20 * len(hit) >= len(w)
            )
        )
    return out


def line_dedup(docs):
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(order(d))
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        keep = [
            x for x in lines if not (
                len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and order(d) != max(holders[key(x)])
            )
        ]
        out.append((d, len(lines), len(lines) - len(keep), sha("\n".join(keep))))
    return out


def substring_dedup(docs, n=13):
    first = {}
    for d, t in docs:
        w = SPACE_WORD.findall(t or "")
        for p in range(len(w) - n + 1):
            k = tuple(w[p : p + n])
            first[k] = min(first.get(k, order(d)), order(d))
    out = []
    for d, t in docs:
        w, gone = SPACE_WORD.findall(t or ""), set()
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < order(d):
                gone.update(range(p, p + n))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def near_duplicates(docs):
    sets = []
    for _, t in docs:
        w = SPACE_WORD.findall(low(t or ""))
        sets.append(frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), order(d)), order(d))
    out = []
    for i, (d, _) in enumerate(docs):
        c = least[root(i)] if sets[i] else order(d)
        out.append((d, len(sets[i]), None if c == LOWEST else c, c == order(d)))
    return out


def personal_data(docs):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(s[::-1])) % 10 == 0

    out = []
    for d, t in docs:
        t = t or ""
        found = [
            ("email", [m.span() for m in email.finditer(t)]),
            ("ip", [m.span() for m in ip.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]),
            (
                "card",
                [m.span() for m in card.finditer(t) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
            ),
            ("phone", [m.span() for m in phone.finditer(t) if 8 <= len(digits(m.group())) <= 15]),
        ]
        out.append((d, *(len(x) for _, x in found), sha(",".join(f"{k}:{a}:{b}" for k, x in found for a, b in x))))
    return out


def quality(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = SPACE_WORD.findall(t)
        n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = set()
        for i in range(len(w) - 2):
            if n[tuple(w[i : i + 3])] > 1:
                rep.update((i, i + 1, i + 2))
        lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
        out.append(
            (
                d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep),
                len(w) < 50 or 100 * len(rep) > 50 * len(w)
            )
        )
    return out
