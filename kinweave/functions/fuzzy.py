"""Fuzzy string similarities in [0, 1]: Arrow UDFs that compare the distinct pairs of a batch together.

Common subsequences are counted bit-parallel over all pairs of a batch at once: a 64-bit word holds a
row of the table for a string of up to 64 characters; longer ones take Python's long integers, one by one.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf

#: White space as Java's patterns know it.
BLANKS = re.compile("[ \t\n\x0b\f\r]+")
#: Characters of the shorter string that a machine word holds, and pairs compared at once.
WORD, TOGETHER = 64, 8192
#: Characters of the longer strings whose windows are compared together.
TABLE = 1 << 16


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one machine word per row of the table."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    """``lcs`` of each pair."""
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b)]
    out = np.zeros(len(a), np.int64)
    size = np.array([len(x) for x in short], np.int64)
    for i in np.flatnonzero(size > WORD):
        out[i] = lcs(short[i], long[i])
    todo = np.flatnonzero((size > 0) & (size <= WORD))
    # pairs of alike lengths together, so that little is padded
    todo = todo[np.argsort([len(long[i]) for i in todo], kind="stable")]
    for at in range(0, len(todo), TOGETHER):
        rows = todo[at : at + TOGETHER]
        x = np.array([short[i] for i in rows], f"U{WORD}").view(np.uint32).reshape(len(rows), WORD)
        wide = max(len(long[i]) for i in rows)
        y = np.array([long[i] for i in rows], f"U{wide}").view(np.uint32).reshape(len(rows), wide)
        full = ~np.uint64(0) >> (WORD - size[rows]).astype(np.uint64)
        v = full.copy()
        for j in range(wide):
            same = np.packbits(x == y[:, j : j + 1], axis=1, bitorder="little").view(np.uint64)[:, 0] & full
            same[y[:, j] == 0] = 0
            u = v & same
            v = (v + u) | (v - u)
        out[rows] = size[rows] - np.bitwise_count(v & full)
    return out


def indel_many(a: list[str], b: list[str]) -> np.ndarray:
    """Twice the common subsequence by both lengths; two empty strings are alike."""
    n = np.array([len(x) + len(y) for x, y in zip(a, b)], float)
    return np.where(n > 0, 2 * lcs_many(a, b) / np.maximum(n, 1), 1.0)


def sorted_many(a: list[str], b: list[str]) -> np.ndarray:
    return indel_many(*([" ".join(sorted(x.split())) for x in side] for side in (a, b)))


def sets_many(a: list[str], b: list[str]) -> np.ndarray:
    """The best of common words, and these with the others of either side; empty strings are unlike all."""
    left, right, row, out = [], [], [], np.zeros(len(a))
    for i, (x, y) in enumerate(zip((set(s.split()) for s in a), (set(s.split()) for s in b))):
        if not x or not y:
            continue
        both = " ".join(sorted(x & y))
        if both and (x <= y or y <= x):
            out[i] = 1.0
            continue
        p, q = (" ".join(filter(None, (both, " ".join(sorted(rest))))) for rest in (x - y, y - x))
        for u, w in [(p, q)] + [(both, p), (both, q)] * bool(both):
            left.append(u)
            right.append(w)
            row.append(i)
    np.maximum.at(out, np.array(row, int), indel_many(left, right))
    return out


def _windows(short: list[str], long: list[str]) -> np.ndarray:
    """The best of the short strings against all windows of the long ones of their length, those at the ends cut short.

    One table for each pair holds the common subsequences with all windows (Alves, Caceres and Song, 2008): after the last
    row, the length for long[i:j] is the number of columns in it whose value is at most i."""
    m, n = (np.array([len(x) for x in side]) for side in (short, long))
    tall, wide = int(m.max()), int(n.max())
    x = np.array(short, f"U{tall}").view(np.uint32).reshape(len(short), tall)
    y = np.array(long, f"U{wide}").view(np.uint32).reshape(len(long), wide)[:, ::-1]  # reversed: a diagonal is a slice of either
    x, y = x.astype(np.int32), y.astype(np.int32)
    x[np.arange(tall) >= m[:, None]] = -1  # what is filled up is like nothing, and changes nothing
    y[np.arange(wide)[::-1] >= n[:, None]] = -2
    h = np.broadcast_to(np.arange(wide, 0, -1, dtype=np.int32), y.shape).copy()
    v = np.zeros(x.shape, np.int32)
    for d in range(tall + wide - 1):
        lo, hi = max(0, d - wide + 1), min(tall, d + 1)
        at = slice(wide - 1 - d + lo, wide - 1 - d + hi)  # columns d - row, the highest first
        hs, vs = h[:, at], v[:, lo:hi]
        same = x[:, lo:hi] == y[:, at]
        down, right = np.where(same, vs, np.maximum(hs, vs)), np.where(same, hs, np.minimum(hs, vs))
        h[:, at], v[:, lo:hi] = down, right
    h = h[:, ::-1]
    best = np.zeros(len(short))
    for k in range(1 - tall, wide):
        i, j = np.maximum(k, 0), np.minimum(k + m, n)
        live = (k > -m) & (k < n)
        if live.any():
            cols = np.arange(i, int(j[live].max()))
            lcs_ = ((h[:, cols] <= i) & (cols < j[:, None])).sum(1)
            best = np.where(live, np.maximum(best, 2 * lcs_ / np.maximum(m + j - i, 1)), best)
    return best


def partial_many(a: list[str], b: list[str]) -> np.ndarray:
    """The best of the shorter string against all windows of the longer one of its length, those at the
    ends cut short; strings of one length are tried both ways."""
    out = np.array([float(not x and not y) for x, y in zip(a, b)])
    sides = []
    for i, (x, y) in enumerate(zip(a, b)):
        if x and y:
            sides += [(i, x, y) if len(x) <= len(y) else (i, y, x)] + [(i, y, x)] * (len(x) == len(y))
    sides.sort(key=lambda s: (len(s[2]), len(s[1])))  # alike lengths together, so that little is filled up
    at = 0
    while at < len(sides):
        some = sides[at : at + max(1, min(1024, TABLE // len(sides[at][2])))]
        some = some[: max(1, sum(len(s[2]) <= 2 * len(some[0][2]) + 16 for s in some))]
        np.maximum.at(out, np.array([s[0] for s in some]), _windows([s[1] for s in some], [s[2] for s in some]))
        at += len(some)
    return out


def indel(a: str, b: str) -> float:
    return float(indel_many([a], [b])[0])


def token_sets(a: str, b: str) -> float:
    return float(sets_many([a], [b])[0])


def partial(a: str, b: str) -> float:
    return float(partial_many([a], [b])[0])


def jaro_winkler(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, (c for c, t in zip(b, taken) if t))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler_many(a: list[str], b: list[str]) -> np.ndarray:
    return np.array([jaro_winkler(x, y) for x, y in zip(a, b)], float)


def trigram_many(a: list[str], b: list[str]) -> np.ndarray:
    """Cosine of the counts of character trigrams inside padded words, of lower-cased strings; 0 where there are none."""
    known: dict[str, Counter] = {}

    def counts(s: str) -> Counter:
        if s not in known:
            known[s] = Counter(p[i : i + 3] for p in (f" {w} " for w in BLANKS.split(s) if w) for i in range(max(1, len(p) - 2)))
        return known[s]

    dot = np.array([sum(n * y[g] for g, n in x.items() if g in y) for x, y in ((counts(s), counts(t)) for s, t in zip(a, b))], float)
    norm = np.array([np.sqrt(float(sum(n * n for n in counts(s).values()))) * np.sqrt(float(sum(n * n for n in counts(t).values()))) for s, t in zip(a, b)], float)
    return np.where(norm > 0, dot / np.where(norm > 0, norm, 1), 0.0)


def _udf(many):
    @pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict = {}
        place = [seen.setdefault(p, len(seen)) for p in zip(a.fillna(""), b.fillna(""))]
        return pd.Series(many([x for x, _ in seen], [y for _, y in seen])[place] if seen else [], dtype="float64")

    return similarity


def kernels() -> dict:
    return {"ratio": _udf(indel_many), "token_sort": _udf(sorted_many), "token_set": _udf(sets_many), "partial": _udf(partial_many), "jaro_winkler": _udf(jaro_winkler_many), "trigram": _udf(trigram_many)}
