"""Benchmark decontamination by greedy string tiling.

1. Seeds are the ``MIN_MATCH``-token shingles of the benchmark's items. A bitmap of their hashes, of at
   most ``MOST_BITS`` bits whatever the benchmark's size, goes to every task, so that one pass over the
   texts hashes all shingles (Karp-Rabin, vectorised) and lists only those that may be seeds.
2. Listed shingles are joined with the seeds. A text and an item are tiled if their shared seeds could
   cover enough of the item; that is summed in Spark, without texts.
3. Pairs that are left get both texts and are tiled: running Karp-Rabin finds the greatest length at
   which unmarked parts of both agree, marks all matches of that length that do not overlap, left to
   right, and goes on below it until ``MIN_MATCH``. Matches are confirmed on the tokens. Marked tokens by
   an item's tokens is its coverage, so passages count wherever their parts stand, in any order.

Texts are not shuffled but for the pairs of step 3. Equal texts and equal items are handled once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _power_tables, arrow, chunks, cut, few, fresh, mix, shingle_hashes, string_bytes, word_hashes

#: Tokens of the shortest tile. An item of fewer tokens has one seed, all of its tokens in a row.
MIN_MATCH = 5
#: Share of an item's tokens that tiles must cover.
COVERAGE = 0.6
#: Bits of the seeds' bitmap: 64 for each seed, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 28
CHUNK = 1 << 20

#: Tokens are runs of letters, digits and bytes above 127.
_BREAKS = np.ones(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _BREAKS[_a:_b] = False
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def token_list(text: str) -> list[bytes]:
    return _TOKEN.findall(pc.utf8_lower(pa.scalar(text or "")).as_py().encode())


def _tokens(column):
    """Yields (first row, token hashes, offsets) of bounded chunks of a text column, lower-cased."""
    data, off = string_bytes(pc.utf8_lower(column))
    for a, b in chunks(off, CHUNK):
        yield a, *word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a], is_sep=_BREAKS)


def _salted(hashes: np.ndarray, k: int) -> np.ndarray:
    return hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def _item_seeds(k: int):
    """Rows (a, b, text) to (a, b, seed, places, tokens, width): an item's distinct seeds."""

    def run(batches):
        for batch in batches:
            for at, words, per in _tokens(batch.column(2)):
                hashes, off = shingle_hashes(words, per, k)
                count = np.diff(per)
                row = np.repeat(np.arange(len(count)), np.diff(off))
                for n in np.unique(count[(count > 0) & (count < k)]).tolist():  # seeds of short items say how long they are
                    own, at_n = shingle_hashes(words, per, n)
                    short = np.flatnonzero(count == n)
                    hashes[off[short]] = _salted(own[at_n[short]], n)
                order = np.lexsort((hashes, row))
                h, r = hashes[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                first = np.flatnonzero(new)
                places = np.diff(np.append(first, len(h)))
                take = pa.array(at + r[first])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(h[first].view(np.int64)), pa.array(places), pa.array(count[r[first]].astype(np.int64)), pa.array(np.minimum(count, k)[r[first]].astype(np.int64))],
                    names=["a", "b", "seed", "places", "tokens", "width"],
                )

    return run


def _text_seeds(bitmap, widths: list[int], most: int):
    """Rows (a, b, text) to (a, b, seed): the shingles of a text that the bitmap does not rule out."""

    def run(batches):
        held = bitmap.value
        mask = np.uint64(len(held) * 64 - 1)
        for batch in batches:
            for at, words, per in _tokens(batch.column(2)):
                for k in widths:
                    hashes, off = shingle_hashes(words, per, k)
                    if k < most:
                        hashes = _salted(hashes, k)
                    bit = hashes & mask
                    on = np.flatnonzero((held[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
                    row = np.searchsorted(off, on, side="right") - 1
                    long = np.diff(per)[row] >= k
                    on, row = on[long], row[long]
                    if not len(on):
                        continue
                    pairs = np.unique(np.rec.fromarrays([row, hashes[on]]))
                    take = pa.array(at + pairs.f0)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.ascontiguousarray(pairs.f1).view(np.int64))], names=["a", "b", "seed"])

    return run


def _grams(ids: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of ``length`` free tokens, and their hashes."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    starts = np.flatnonzero(taken[length:] == taken[:-length])
    up, down = _power_tables(len(ids) + 1)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64) + np.uint64(3)) * up[: len(ids)], out=sums[1:])
    return starts, (sums[starts + length] - sums[starts]) * down[starts]


def marked_tokens(item: np.ndarray, text: np.ndarray, k: int) -> int:
    """Number of the item's tokens that greedy string tiling marks. Tokens are numbers, -1 in ``text``
    for those that the item lacks. Longest matches go first, then those that begin first in the item,
    then in the text."""
    free_item, free_text = np.ones(len(item), bool), text >= 0
    top = min(len(item), len(text))
    while True:
        low, high, best = k, top, None
        while low <= high:
            length = (low + high) // 2 if best or low < high else low
            (s, x), (t, y) = _grams(item, free_item, length), _grams(text, free_text, length)
            common = np.intersect1d(x, y)
            if len(common):
                best, low = (length, s, x, t, y, common), length + 1
            else:
                high = length - 1
        if best is None:
            return int((~free_item).sum())
        length, s, x, t, y, common = best
        waiting: dict = {}
        on = np.isin(y, common)
        for h, p in zip(y[on].tolist(), t[on].tolist()):
            waiting.setdefault(h, []).append(p)
        at = dict.fromkeys(waiting, 0)
        on = np.isin(x, common)
        for h, p in zip(x[on].tolist(), s[on].tolist()):
            if not free_item[p : p + length].all():
                continue
            places = waiting[h]
            while at[h] < len(places):
                q = places[at[h]]
                at[h] += 1
                if free_text[q : q + length].all() and (item[p : p + length] == text[q : q + length]).all():
                    free_item[p : p + length] = free_text[q : q + length] = False
                    break
        top = length - 1


def coverage(item: list[bytes], text: list[bytes], k: int) -> float:
    """Share of an item's tokens that tiles of a text cover; items under ``k`` tokens as a whole."""
    if not item:
        return 0.0
    number: dict[bytes, int] = {}
    own = np.array([number.setdefault(t, len(number)) for t in item])
    k = min(k, len(item))
    other = np.array([number.get(t, -1) for t in text], np.int64)
    # only places near known tokens matter: longer gaps shrink to one unknown token
    near = other >= 0
    keep = near.copy()
    keep[1:] |= near[:-1]
    return marked_tokens(own, other[keep], k) / len(item) if near.any() else 0.0


def _tile(k: int):
    """Rows (a, b, ia, ib, text, item), the item's text among them, to (a, b, ia, ib, coverage)."""

    def run(batches):
        for batch in batches:
            last, tokens, out = None, [], []
            for key, text, item in zip(zip(*(batch.column(i).to_pylist() for i in (0, 1))), batch.column(4), batch.column(5).to_pylist()):
                if key != last:
                    last, tokens = key, token_list(text.as_py())
                out.append(coverage(token_list(item), tokens, k))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.float64())], names=["a", "b", "ia", "ib", "coverage"])

    return run


def _key(text, *names: str) -> list:
    """Two hashes that stand for a text."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias(names[0]), F.xxhash64(F.lit(1), t).alias(names[1])]


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = MIN_MATCH, threshold: float = COVERAGE) -> DataFrame:
    """(a, b, item_id, coverage): for each distinct text of ``docs`` (by the two hashes of ``_key``) the
    items that its tiles cover to ``threshold`` or more."""
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text", *_key(F.col("text"), "ia", "ib"))
    known = cut(items.groupBy("ia", "ib").agg(F.min("text").alias("item")).where("item is not null"))
    seeds = cut(known.select("ia", "ib", "item").transform(arrow, _item_seeds(k), "a long, b long, seed long, places long, tokens long, width long").withColumnsRenamed({"a": "ia", "b": "ib"}))
    widths = [r["width"] for r in seeds.select("width").distinct().orderBy("width").collect()]  # k numbers at most
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 64 * seeds.count()):
        bits *= 2
    bit = F.col("seed").bitwiseAND(F.lit(bits - 1))
    words = seeds.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    held = np.zeros(bits // 64, np.uint64)  # 2 to 32 MB
    held[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    bitmap = spark.sparkContext.broadcast(held)
    del words, held
    source = docs.select(*_key(F.col("text"), "a", "b"), F.coalesce("text", F.lit("")).alias("text"))
    found = source.transform(arrow, _text_seeds(bitmap, widths or [k], k), "a long, b long, seed long").distinct()
    # tiles cover at most k tokens for each place of a shared seed
    could = found.join(seeds, "seed").groupBy("a", "b", "ia", "ib").agg((F.sum("places") * F.max("width")).alias("most"), F.max("tokens").alias("tokens"))
    pairs = cut(could.where(F.col("most") >= threshold * F.col("tokens")).select("a", "b", "ia", "ib"))
    bitmap.unpersist()
    wanted = pairs.select("a", "b").distinct()
    texts = source.join(few(wanted), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.min("text").alias("text"))
    both = pairs.join(texts, ["a", "b"]).join(known, ["ia", "ib"]).select("a", "b", "ia", "ib", "text", "item")
    tiled = both.transform(arrow, _tile(k), "a long, b long, ia long, ib long, coverage double")
    return cut(tiled.where(F.col("coverage") >= threshold).join(items.select("ia", "ib", "item_id"), ["ia", "ib"]).select("a", "b", "item_id", "coverage"))


def tile(docs: DataFrame, benchmark: DataFrame, k: int = MIN_MATCH, threshold: float = COVERAGE) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, text): doc_id, contaminated, items (sorted ids of
    the items of which tiles cover ``threshold`` or more), coverage (the highest of these, else 0).

    Null and empty texts are clean. Items without tokens or id are not searched; an item of fewer than
    ``k`` tokens is leaked where all of them stand in a row. Repeated items give repeated ids once, repeated
    rows repeated results. Empty tables give empty or clean results. Very long texts are hashed in
    parts and tiled as a whole.
    """
    per = leaks(docs, benchmark, k, threshold).groupBy("a", "b").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"))
    m = docs.select("doc_id", *_key(F.col("text"), "a", "b")).join(per, ["a", "b"], "left")
    return m.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame, k: int = MIN_MATCH, threshold: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` (column text and any others) that leak no item, with their columns. Null and
    empty texts stay, repeated rows stay or go together, an empty table gives an empty result."""
    a, b = fresh(docs, "a", "b")
    gone = leaks(docs, benchmark, k, threshold).select(F.col("a").alias(a), F.col("b").alias(b)).distinct()
    return docs.withColumns(dict(zip((a, b), _key(F.col("text"), a, b)))).join(few(gone), [a, b], "left_anti").select(docs.columns)
