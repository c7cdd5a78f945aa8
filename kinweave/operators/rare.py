"""The rare-word features of all pairs within a block: both sides meet in slices. What a pair's names share is a code of
bits on either side, and the features are looked up in a table of each name's codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of either side of a part of a block, about, whose pairs are made at once; rows of the right side among which words
#: are looked up together, and pairs that are compared together.
LEFT, RIGHT, WIDE, TOGETHER = 512, 2048, 4096, 1 << 17
#: Distinct words of a name that have a bit of a code; names of more are compared word by word.
BITS = 8

FEATURES = ("rw1_max", "rw1_sum", "rw2_max", "rw2_sum", "rw1_share")


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


class Names:
    """Names by their distinct words: ``at`` has the words' places in ``idf``, the largest number for none; ``all`` sums
    the idf of a name's words, repeats included."""

    def __init__(self, at: np.ndarray, idf: np.ndarray, all_: np.ndarray):
        self.at, self.idf, self.all = at, idf, all_

    def __len__(self) -> int:
        return len(self.at)

    def some(self, rows) -> Names:
        at = self.at[rows]
        return Names(at[:, : int((at < len(self.idf) - 1).sum(1).max(initial=0))], self.idf, self.all[rows])

    def table(self) -> list[np.ndarray]:
        """max, sum and share by name and by code: bit i is set where the other name has word i."""
        own, k = self.idf[self.at], self.at.shape[1]
        apart = 1.0 - (np.arange(1 << k)[:, None] >> np.arange(k) & 1)
        most = np.zeros((len(own), 1 << k))
        for i in range(k):
            np.maximum(most, own[:, i, None] * apart[:, i], out=most)
        return self._told(most, own @ apart.T)

    def _told(self, most: np.ndarray, total: np.ndarray) -> list[np.ndarray]:
        return [_rounded(most), _rounded(total), _rounded(total / np.maximum(self.all, 1e-6)[:, None])]

    def plain(self, others: Names) -> list[np.ndarray]:
        """max, sum and share of each name with each other one, word by word."""
        most, total = np.zeros((2, len(self), len(others)))
        has = np.zeros((len(self.idf), len(others)), bool)
        has[others.at, np.arange(len(others))[:, None]] = True
        for i in range(self.at.shape[1]):
            left = np.where(has[self.at[:, i]], 0.0, self.idf[self.at[:, i], None])
            np.maximum(most, left, out=most)
            total += left
        return self._told(most, total)


def names_of(*sides: pa.Array) -> list[Names]:
    """From lists of words with their idf."""
    flat = [x.flatten() for x in sides]
    words = pa.concat_arrays([x.field("word") for x in flat]).dictionary_encode()
    place, weight = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([x.field("idf").to_numpy(zero_copy_only=False) for x in flat])
    n = len(words.dictionary)
    idf = np.zeros(n + 1)
    idf[place] = weight
    out, begin = [], 0
    for lists, x in zip(sides, flat):
        rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        own, begin = slice(begin, begin + len(x)), begin + len(x)
        row, word = np.divmod(np.unique(rows * (n + 1) + place[own]), n + 1)
        count = np.bincount(row, minlength=len(lists))
        at = np.full((len(lists), int(count.max(initial=0))), n)
        at[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = word
        out.append(Names(at, idf, np.bincount(rows, weight[own], len(lists))))
    return out


def compared(a: Names, b: Names) -> Iterator[tuple[slice, slice, list[np.ndarray]]]:
    """Rows of ``a``, rows of ``b`` and, in the order of FEATURES, what each of these has with each of those."""
    for low in range(0, len(b), WIDE):
        cols = slice(low, min(len(b), low + WIDE))
        y = b.some(cols)
        step = max(1, TOGETHER // len(y))
        if max(a.at.shape[1], y.at.shape[1]) > BITS:
            for lo in range(0, len(a), step):
                rows = slice(lo, min(len(a), lo + step))
                one, two = a.some(rows).plain(y), [t.T for t in y.plain(a.some(rows))]
                yield rows, cols, [one[0], one[1], two[0], two[1], one[2]]
            continue
        # the words of a's names, and the bits that they have in those of y
        none = len(a.idf) - 1
        own = np.unique(np.append(a.at, none))
        place = np.zeros(none + 1, np.int64)
        place[own] = np.arange(1, len(own) + 1)
        bit = np.zeros((len(own) + 1, len(y)), np.uint8)
        for j in range(y.at.shape[1]):
            bit[place[y.at[:, j]], np.arange(len(y))] = 1 << j
        bit[[0, place[none]]] = 0
        one, two = a.table(), [t.ravel() for t in y.table()[:2]]
        wide = len(a) and one[0].shape[1]
        one = [t.ravel() for t in one]
        ends = np.arange(len(y)) << y.at.shape[1]
        for lo in range(0, len(a), step):
            rows = slice(lo, min(len(a), lo + step))
            at = place[a.at[rows]]
            mine, theirs = np.zeros((2, len(at), len(y)), np.uint8)
            for i in range(at.shape[1]):
                has = bit[at[:, i]]
                theirs |= has
                mine |= (has != 0).view(np.uint8) << np.uint8(i)
            where = mine.astype(np.intp)
            where += (np.arange(rows.start, rows.stop) * wide)[:, None]
            of_a = [t.take(where, mode="wrap") for t in one]
            np.add(theirs, ends, out=where)
            of_b = [t.take(where, mode="wrap") for t in two]
            yield rows, cols, [of_a[0], of_a[1], of_b[0], of_b[1], of_a[2]]


def within_blocks(left: DataFrame, right: DataFrame, a: str, b: str, on: list[str]) -> DataFrame:
    """``a``, ``b`` and the features, rounded to six places, of all pairs with the same ``on``, which are not null; pairs
    without any word are left out. ``left`` (a, on, words) and ``right`` (b, on, words): words as of ``features.weighed``."""
    n, m = left.groupBy(*on).agg(F.count("*").alias("n")), right.groupBy(*on).agg(F.count("*").alias("m"))
    size = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    cut, at = F.broadcast(n.join(m, on).select(*on, size("n", LEFT).alias("_is"), size("m", RIGHT).alias("_js"))), [*on, "_i", "_j"]
    dealt = lambda n, c: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tasks = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = left.join(cut, on).withColumn("_i", dealt("_is", a)).withColumn("_j", every("_js")).select(*at, a, "words").repartition(tasks, *at)
    y = right.join(cut, on).withColumn("_j", dealt("_js", b)).withColumn("_i", every("_is")).repartition(tasks, *at)
    y = y.select(*[F.col(c).alias(c) for c in (*at, b, "words")])  # a cogroup wants columns of their own on either side
    schema = pa.schema([(a, pa.string()), (b, pa.string()), *((f, pa.float64()) for f in FEATURES)])

    def met(x: pa.Table, y: pa.Table) -> Iterator[pa.RecordBatch]:
        if not (len(x) and len(y)):
            return
        ids, others = (t.column(c).combine_chunks().cast(pa.string()) for t, c in ((x, a), (y, b)))
        names, theirs = names_of(*(_one(t.column("words")) for t in (x, y)))
        known, told = ((n.at < len(n.idf) - 1).any(1) for n in (names, theirs))
        for mine, of in ((known, np.ones(len(theirs), bool)), (~known, told)):
            if mine.any() and of.any():
                p, q = ids.filter(pa.array(mine)), others.filter(pa.array(of))
                last, tiled = None, None
                for rows, cols, found in compared(names.some(mine), theirs.some(of)):
                    n, m = found[0].shape
                    if last != cols or len(tiled) < n * m:
                        last, tiled = cols, q[cols].take(pa.array(np.tile(np.arange(m), n)))
                    yield pa.RecordBatch.from_arrays([p.take(pa.array(np.arange(rows.start, rows.stop).repeat(m))), tiled[: n * m], *(pa.array(f.ravel()) for f in found)], schema=schema)

    def table(x: pa.Table, y: pa.Table) -> pa.Table:
        return pa.Table.from_batches(met(x, y), schema)

    return x.groupBy(*at).cogroup(y.groupBy(*at)).applyInArrow(table, f"{a} string, {b} string, " + ", ".join(f"{f} double" for f in FEATURES))


def _one(column: pa.ChunkedArray) -> pa.Array:
    """One list array that begins at its first element."""
    return pa.concat_arrays(column.chunks)
