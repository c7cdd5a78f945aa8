"""The features of house numbers for all pairs within a block: both sides meet in slices, and what a pair needs is
looked up in tables of the distinct numbers of a slice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the left side of a block that meet the right side at once, and pairs compared together.
SALTED, TOGETHER = 512, 1 << 16
#: What stands for the distance to a number that is not there, and the largest difference that is told.
FAR, MOST = 32_000, 1000


def edits(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances of all strings of ``a`` to all of ``b``."""
    out = np.zeros((len(a), len(b)), np.int16)
    if not a or not b:
        return out
    m, n = (np.array([len(x) for x in side]) for side in (a, b))
    tall, wide = max(1, int(m.max())), max(1, int(n.max()))
    kind = np.int8 if tall + wide < 120 else np.int16
    x = np.array(a, f"U{tall}").view(np.uint32).reshape(len(a), tall)
    y = np.array(b, f"U{wide}").view(np.uint32).reshape(len(b), wide)
    ends = [np.flatnonzero(n == j) for j in range(wide + 1)]
    step = max(1, TOGETHER // len(b))
    for lo in range(0, len(a), step):
        rows = slice(lo, lo + step)
        own, some = x[rows], m[rows]
        shape = (len(own), len(b))
        last = [np.full(shape, j, kind) for j in range(wide + 1)]
        for i in range(tall + 1):
            if i:
                now = [np.full(shape, i, kind)]
                for j in range(1, wide + 1):
                    cell = last[j - 1] + (own[:, i - 1 : i] != y[:, j - 1])
                    np.minimum(cell, np.minimum(last[j], now[j - 1]) + kind(1), out=cell)
                    now.append(cell)
                last = now
            done = np.flatnonzero(some == i)
            if len(done):
                for j, cols in enumerate(ends):
                    if len(cols):
                        out[np.ix_(lo + done, cols)] = last[j][np.ix_(done, cols)]
    return out


def _side(lists: list[list[str]]) -> tuple[list[str], np.ndarray]:
    """The distinct numbers, and by row the places of its own; -1 where there are no more."""
    places: dict[str, int] = {}
    own = [[places.setdefault(x, len(places)) for x in dict.fromkeys(xs)] for xs in lists]
    out = np.full((len(lists), max(map(len, own), default=0)), -1, np.int32)
    for i, xs in enumerate(own):
        out[i, : len(xs)] = xs
    return list(places), out


def compared(a: list[list[str]], first: list[str], b: list[list[str]]):
    """By slices of ``a``, (rows, features) of each of these with all of ``b``: as ``features.number_features``, -1 for null."""
    (xs, at), (ys, to) = _side(a), _side(b)
    value = lambda side: np.array([int(x[:18]) for x in side], np.int64)
    # a last row and column for numbers that are not there
    far, same, apart = (np.full((len(xs) + 1, len(ys) + 1), fill, np.int16) for fill in (FAR, 0, FAR))
    far[:-1, :-1] = edits(xs, ys)
    apart[:-1, :-1] = np.minimum(np.abs(value(xs)[:, None] - value(ys)[None]), MOST)
    known = {y: j for j, y in enumerate(ys)}
    for i, x in enumerate(xs):
        if x in known:
            same[i, known[x]] = 1
    n, k = (at >= 0).sum(1), (to >= 0).sum(1)
    begins = np.array([known.get(x, -2) if x else -2 for x in first], np.int32)
    step = max(1, TOGETHER // max(1, len(b)))
    for lo in range(0, len(a), step):
        rows = slice(lo, min(len(a), lo + step))
        shape = (rows.stop - lo, len(b))
        d, e, both, eq = np.full(shape, FAR, np.int16), np.full(shape, FAR, np.int16), np.zeros(shape, np.int16), np.zeros(shape, bool)
        for i in range(at.shape[1]):
            own = [t[at[rows, i]] for t in (apart, far, same)]
            for j in range(to.shape[1]):
                cols = to[:, j]
                np.minimum(d, own[0].take(cols, 1, mode="wrap"), out=d)
                np.minimum(e, own[1].take(cols, 1, mode="wrap"), out=e)
                both += own[2].take(cols, 1, mode="wrap")
        for j in range(to.shape[1]):
            eq |= begins[rows, None] == to[:, j]
        has = (n[rows, None] > 0) & (k > 0)
        every = n[rows, None] + k - both
        jac = np.where(every > 0, np.floor(both / np.maximum(every, 1) * 1e6 + 0.5) / 1e6, -1.0)
        yield rows, (np.where(has, d, -1).astype(np.int64), np.where(has, e, -1).astype(np.int64), jac, eq.astype(np.int32), (has & (both == 0)).astype(np.int32))


def within_blocks(left: DataFrame, right: DataFrame, a: str, b: str, on: str) -> DataFrame:
    """``a``, ``b`` and the features of all pairs with the same ``on``, which is not null. ``left`` (a, on, numbers, first) and
    ``right`` (b, on, numbers): lists of numbers as texts, and the first number of the left side ("" for none)."""
    left, right = left.where(F.col(on).isNotNull()), right.where(F.col(on).isNotNull())
    salts = left.groupBy(on).agg(F.ceil(F.count("*") / SALTED).cast("int").alias("salts"))
    tasks = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.join(F.broadcast(salts), on).withColumn("salt", F.pmod(F.xxhash64(a), F.col("salts")).cast("int")).drop("salts").repartition(tasks, on, "salt")
    every = right.join(F.broadcast(salts), on).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").repartition(tasks, on, "salt")
    names = [a, b, "num_absdiff", "num_digit_ed", "num_jac", "num_first_eq", "num_conflict"]

    def met(x: pa.Table, y: pa.Table) -> pa.Table:
        ids, others = x.column(a).combine_chunks(), y.column(b).combine_chunks()
        batches = []
        if len(ids) and len(others):
            for rows, found in compared(x.column("numbers").to_pylist(), x.column("first").to_pylist(), y.column("numbers").to_pylist()):
                own, their = np.arange(rows.start, rows.stop).repeat(len(others)), np.tile(np.arange(len(others)), rows.stop - rows.start)
                batches.append(pa.RecordBatch.from_arrays([ids.take(pa.array(own)), others.take(pa.array(their)), *(pa.array(f.ravel()) for f in found)], names))
        return pa.Table.from_batches(batches, pa.schema(zip(names, [pa.int64()] * 4 + [pa.float64(), pa.int32(), pa.int32()])))

    return dealt.groupBy(on, "salt").cogroup(every.groupBy(on, "salt")).applyInArrow(met, f"{a} long, {b} long, num_absdiff long, num_digit_ed long, num_jac double, num_first_eq int, num_conflict int")
