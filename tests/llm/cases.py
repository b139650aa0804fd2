"""Small tables with everything that tables may hold, and plain Python versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, key string, id string, name string, th int, leaks int"
WORDS = [f"{a}{b}{c}" for a in ("ba", "lo", "Mi", "ru", "té") for b in ("n", "st", "r") for c in ("a", "ock", "ing", "é")]


def text(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(WORDS) for _ in range(n))


def edited(draw: random.Random, t: str, share: float) -> str:
    return " ".join(draw.choice(WORDS) if draw.random() < share else w for w in t.split(" "))


def rows(seed: int = 0, n: int = 60) -> list[tuple]:
    """(doc_id, text, source): copies, near copies, shared passages, null and empty fields, repeated rows, one long text, odd white space."""
    draw = random.Random(seed)
    base = [text(draw, draw.randrange(3, 90)) for _ in range(n)]
    passage = text(draw, 40)
    out = []
    for i, t in enumerate(base):
        kind = i % 8
        if kind == 1:
            t = base[i - 1]
        elif kind == 2:
            t = edited(draw, base[i - 2], 0.02)
        elif kind == 3:
            t = text(draw, 5) + " " + passage + " " + text(draw, 8)
        elif kind == 4:
            t = edited(draw, base[0], 0.03)
        out.append((n - i if i % 3 else i + n, t, f"s{i % 4}"))
    long = text(draw, 3000)
    out += [(500, None, "s1"), (501, "", None), (502, " \t\n\x0b ", ""), (503, "one two", "s2"), (504, "a b c d e", "s2"), (505, "A B\tC  d\nE", None), (506, "a a a a a a a a a a a a a a a a a a a a", "s2")]
    out += [(507, long, "s3"), (508, long[: len(long) // 2], "s3"), (509, " x y z\x85w", "s1"), (None, base[5], "s1"), (None, None, None), (510, base[7], "s0"), (510, base[7], "s0"), (511, base[9].upper(), "é")]
    return out


def frame(spark, data: list[tuple]):
    full = [(i, t, "en", s, None if t is None else len(t), 1, "k", "x", "y", 3, 4) for i, t, s in data]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def words(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def order(i: int | None) -> int:
    return (1 << 63) - 1 if i is None else i


def repeats(data: list[tuple], window: int = 13) -> Counter:
    first: dict[tuple, int] = {}
    for i, t, _ in data:
        w = words(t)
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, order(i)), order(i))
    out = Counter()
    for i, t, _ in data:
        w = words(t)
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < order(i):
                gone.update(range(j, j + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def shingles(t: str | None, k: int = 5) -> frozenset:
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def jaccard(data: list[tuple], percent: int = 75) -> Counter:
    sets = [shingles(t) for _, t, _ in data]
    parent = list(range(len(data)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for a, (i, _, _) in enumerate(data):
        least[root(a)].append(order(i))
    return Counter((i, len(sets[a]), None if min(least[root(a)]) == order(None) else min(least[root(a)])) for a, (i, _, _) in enumerate(data))
