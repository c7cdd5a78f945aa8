"""Exact repeated passages: aligned segments, sorted column by column.

Every string of ``SHORT`` bytes has a minimizer: the least of the hashes of its ``SEED``-byte strings, the
first one if several are least. Equal strings have the same minimizer at the same place, so repeats need
only be looked for among occurrences of one minimizer, with the strings aligned to it.

1. One pass over the texts lists minimizers (one for about 80 bytes) with a hash of the segment around
   each: all strings of ``LENGTH`` bytes that hold this occurrence lie in it. Neighbouring
   occurrences of one segment, as in periodic texts, are one row.
2. Minimizers that occur once are dropped. Equal segments collapse: all of them repeats.
3. One segment of each kind is cut out of its text, for minimizers with several kinds. Segments of a
   minimizer, aligned, are a collection to which one column is added each round, from the last to
   the first: the order of suffixes is updated by a stable sort of the new symbols in the old order, as a
   Burrows-Wheeler transform of the collection is, and the common prefixes of neighbours with it.
   Columns are read from, and the transform and prefixes written to, sequential files of the task.
   Prefixes of ``LENGTH`` or more are repeats.
4. Covered intervals go back to the texts; texts without any are not shuffled.

Passages of over ``WORDS`` words that are shorter than ``LENGTH`` bytes, but not than ``SHORT``, come out of
the same rounds: they are reported, and not removed.
"""

from __future__ import annotations

import hashlib
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, WORD, _power_tables, arrow, chunks, cut, dropped, few, mix, stored, string_bytes

#: Bytes of a repeat, of the shortest strings that are aligned, and of those whose hashes are compared.
LENGTH, SHORT, SEED = 400, 256, 96
#: A passage of more words is reported if it repeats, also below LENGTH bytes.
WORDS = 50
#: Bytes before a seed, and from it on, that a string of LENGTH bytes holding it can have.
BEFORE, AFTER = LENGTH - SEED, LENGTH
WIDTH = BEFORE + AFTER
#: Segments of a minimizer that are compared in one piece. Beyond that they are dealt SIDES times, by
#: context: a repeat of SHORT bytes that has at least i of SIDES parts of what it needs besides the seed before
#: it, and fewer than i + 1, has at least SIDES - i - 1 parts behind it.
TOGETHER, SIDES = 4000, 4
#: Segments of a batch of rounds.
BATCH = 12_000
CHUNK = 1 << 20

_HALF = np.uint64(32)
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Rolling:
    """Hashes of substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, starts, ends):
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def minimizers(data: np.ndarray, off: np.ndarray, rolling: Rolling, length: int = SHORT) -> np.ndarray:
    """Sorted places of the minimizers of all strings of ``length`` bytes that lie in one text."""
    n, w = len(data) - SEED + 1, length - SEED + 1
    if len(data) < length:
        return np.zeros(0, np.int64)
    at = np.arange(n, dtype=np.uint64)
    # half of a hash and the place: the least of a window is that of its first least hash
    key = (rolling.of(at.astype(np.int64), at.astype(np.int64) + SEED) >> _HALF << _HALF) | at
    # least of each window of w keys: blocks of w, running minima from both of their ends
    padded = np.concatenate([key, np.full(-n % w, ~np.uint64(0))]).reshape(-1, w)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - w + 1
    least = np.minimum(right[:windows], left[w - 1 : w - 1 + windows])
    # windows that cross from one text into the next are none
    inside = np.ones(windows, bool)
    for b in off[1:-1]:
        inside[max(0, b - length + 1) : b] = False
    places = (least[inside] & ((np.uint64(1) << _HALF) - np.uint64(1))).astype(np.int64)
    return places[np.diff(places, prepend=-1) != 0]


def _segments(off: np.ndarray, places: np.ndarray):
    """Starts and ends of the segments around places, inside their texts, and the texts' numbers."""
    doc = np.searchsorted(off, places, side="right") - 1
    return np.maximum(places - BEFORE, off[doc]), np.minimum(places + AFTER, off[doc + 1]), doc


def _list(batches):
    for batch in batches:
        key = batch.column(0)
        data, off = string_bytes(batch.column(1))
        for a, b in chunks(off, CHUNK):
            d, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
            rolling = Rolling(d)
            p = minimizers(d, o, rolling)
            if not len(p):
                continue
            start, end, doc = _segments(o, p)
            # equal bytes around a seed at another place are another kind
            seed, kind = rolling.of(p, p + SEED), rolling.of(start, end) ^ mix((p - start + 1).astype(np.uint64))
            # one row for neighbouring occurrences of one segment; they are less than SHORT bytes apart
            before, rest = p - start, end - p
            same = np.zeros(len(p), bool)
            same[1:] = (seed[1:] == seed[:-1]) & (kind[1:] == kind[:-1]) & (doc[1:] == doc[:-1]) & (before[1:] == before[:-1]) & (rest[1:] == rest[:-1])
            first = np.flatnonzero(~same)
            times = np.diff(np.append(first, len(p)))
            reach = p[first + times - 1] - p[first]
            p, rest, doc = p[first], rest[first], doc[first]
            yield pa.RecordBatch.from_arrays(
                [
                    key.take(pa.array(a + doc)),
                    pa.array(seed[first].view(np.int64)),
                    pa.array(kind[first].view(np.int64)),
                    pa.array((p - o[doc]).astype(np.int32)),
                    pa.array(rest.astype(np.int16)),
                    pa.array(times.astype(np.int32)),
                    pa.array(reach.astype(np.int32)),
                ],
                names=["row", "seed", "kind", "at", "rest", "times", "reach"],
            )


_LIST = "row long, seed long, kind long, at int, rest smallint, times int, reach int"


def _cut_out(batches):
    """Rows (text, places) to segments."""
    for batch in batches:
        out = []
        for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            for w in wanted:
                before = min(w["at"], BEFORE)
                out.append((w["seed"], w["kind"], before, raw[w["at"] - before : w["at"] + w["rest"]], w["kinds"]))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 5, _CUT.types)], schema=_CUT)


_CUT = pa.schema([("seed", pa.int64()), ("kind", pa.int64()), ("before", pa.int32()), ("bytes", pa.binary()), ("kinds", pa.int64())])


def columnwise(groups: np.ndarray, befores: np.ndarray, texts: list[bytes], short: int = SHORT, width: int = WIDTH, before: int = BEFORE) -> np.ndarray:
    """(segments, before + 1) numbers: of the string that begins in a column, how many bytes another
    segment of the group has alike in the same columns; 0 if fewer than ``short``.

    ``groups`` must be sorted. Column ``before`` is where the seeds begin.
    """
    n = len(texts)
    alike = np.zeros((n, before + 1), np.int16)
    with tempfile.TemporaryFile() as columns, tempfile.TemporaryFile() as transform:
        # columns of symbols, 256 where a segment has none; written once, read from the last to the first
        block = np.full((n, width), 256, np.uint16)
        for i, (b, t) in enumerate(zip(befores, texts)):
            block[i, before - b : before - b + len(t)] = np.frombuffer(t, np.uint8)
        columns.write(np.ascontiguousarray(block.T).tobytes())
        del block
        order, prefix = np.arange(n), np.zeros(n, np.int32)
        base = groups.astype(np.int64) * 257
        for c in range(width - 1, -1, -1):
            columns.seek(2 * n * c)
            symbol = np.frombuffer(columns.read(2 * n), np.uint16)
            key = base[order] + symbol[order]
            moved = np.argsort(key, kind="stable")
            same = np.zeros(n, bool)
            sorted_key = key[moved]
            same[1:] = (sorted_key[1:] == sorted_key[:-1]) & (sorted_key[1:] % 257 != 256)
            at = np.flatnonzero(same)
            new = np.zeros(n, np.int32)
            if len(at):
                new[at] = 1 + _range_minima(prefix, moved[at - 1] + 1, moved[at])
            order, prefix = order[moved], new
            # the round's part of the transform and of the common prefixes, in sequence
            transform.write(symbol[order].tobytes())
            transform.write(np.minimum(prefix, 32767).astype(np.int16).tobytes())
            if c <= before:
                most = np.maximum(prefix, np.append(prefix[1:], 0))
                alike[order, c] = np.where(most >= short, most, 0)
    return alike


def _range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of values[low..high], both ends included, by a table of powers of two."""
    span = high - low + 1
    level = np.zeros(len(span), np.int64)
    out = np.empty(len(span), values.dtype)
    table, k, step = values, 0, 1
    level = np.floor(np.log2(span)).astype(np.int64)
    top = int(level.max())
    while True:
        on = np.flatnonzero(level == k)
        out[on] = np.minimum(table[low[on]], table[high[on] - step + 1])
        if k == top:
            return out
        table = np.minimum(table[:-step], table[step:])
        k, step = k + 1, step * 2


def intervals(alike: np.ndarray) -> list[tuple[int, int]]:
    """Intervals (from, to), relative to the seed, of one row of ``columnwise``: those covered by strings of
    LENGTH bytes that repeat, and shorter strings that repeat and are in no longer one."""
    out = []
    c = np.flatnonzero(alike >= LENGTH)
    if len(c):
        gap = np.flatnonzero(np.diff(c) > LENGTH)
        out += zip(c[np.append(0, gap + 1)].tolist(), (c[np.append(gap, len(c) - 1)] + LENGTH).tolist())
    ends = np.where(alike > 0, np.arange(len(alike)) + alike, 0)
    new = (alike > 0) & (alike < LENGTH) & (ends > np.append(0, ends[:-1]))
    out += [(int(x), int(ends[x])) for x in np.flatnonzero(new)]
    return [(a - BEFORE, b - BEFORE) for a, b in out]


def _compare(batches):
    """Rows sorted by group: intervals (from, to), relative to the seed, of each segment kind."""

    def flush(rows):
        keys = [(r[0], r[4]) for r in rows]
        ids, groups = {}, np.zeros(len(rows), np.int64)
        for i, k in enumerate(keys):
            groups[i] = ids.setdefault(k, len(ids))
        alike = columnwise(groups, np.array([r[2] for r in rows]), [r[3] for r in rows])
        out = []
        for i in np.flatnonzero(alike.any(axis=1)).tolist():
            out.append((rows[i][0], rows[i][1], [{"a": a, "b": b} for a, b in intervals(alike[i])]))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 3, _SPANS.types)], schema=_SPANS)

    rows, last = [], None
    for batch in batches:
        for r in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if len(rows) >= BATCH and (r[0], r[4]) != last:
                yield flush(rows)
                rows = []
            last = (r[0], r[4])
            rows.append(r)
    if rows:
        yield flush(rows)


_SPANS = pa.schema([("seed", pa.int64()), ("kind", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])


def _merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _passage(raw: memoryview, a: int, b: int) -> bool:
    """Whether more than WORDS whole words stand in an interval."""
    part, ends = bytes(raw[a:b]), 0
    if a > 0 and raw[a - 1] not in SEPARATORS and part[0] not in SEPARATORS:
        ends += 1
    if b < len(raw) and raw[b] not in SEPARATORS and part[-1] not in SEPARATORS:
        ends += 1
    return len(_WORD.findall(part)) - ends > WORDS


_WORD = re.compile(WORD.encode())
_OUT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeated"]


def _digest(batches):
    for batch in batches:
        text, spans = batch.column(1), batch.column(2).to_pylist()
        out = []
        for i, found in enumerate(spans):
            raw = memoryview(text[i].as_buffer()) if text[i].is_valid else memoryview(b"")
            runs, h, at = _merged([x for x in found or () if x["b"] - x["a"] >= LENGTH]), hashlib.sha256(), 0
            for a, b in runs:
                h.update(raw[at:a])
                at = b
            h.update(raw[at:])
            repeated = bool(runs) or any(_passage(raw, x["a"], x["b"]) for x in found or ())
            out.append((len(raw), sum(b - a for a, b in runs), len(runs), h.hexdigest(), repeated))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 5, kinds))], names=_OUT)


def covered(docs: DataFrame) -> DataFrame:
    """(row, spans) for the texts of ``docs`` (columns row, text) that hold repeats.

    ``row`` identifies a row by its content: rows that are equal in it count as several occurrences
    and share their spans. Spans are byte intervals, not merged and in no order; those of LENGTH bytes
    or more are covered by repeats, shorter ones are maximal repeats.
    """
    hits, path = stored(docs.select("row", F.coalesce("text", F.lit("")).alias("text")).transform(arrow, _list, _LIST), "seeds")
    # repeated seeds are as many as the data asks for: joined by shuffle at every size
    live = hits.groupBy("seed").agg(F.sum("times").alias("n")).where("n > 1").select("seed")
    near = cut(hits.join(live, "seed"))
    dropped(docs.sparkSession, path)
    before = F.least(F.col("one.at"), F.lit(BEFORE))
    kinds = near.groupBy("seed", "kind").agg(F.sum("times").alias("n"), F.min(F.struct("row", "at", "rest")).alias("one"))
    kinds = cut(kinds.where(before + F.col("one.rest") >= SHORT))
    # written, so that the join reads plain shuffles on both sides and may split a hot seed
    several = cut(kinds.groupBy("seed").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    whole = kinds.where("n > 1").select("seed", "kind", F.array(F.struct((-before).cast("int").alias("a"), F.col("one.rest").cast("int").alias("b"))).alias("spans"))
    wanted = kinds.join(several, "seed").groupBy("one.row").agg(F.collect_list(F.struct("seed", "kind", F.col("one.at").alias("at"), F.col("one.rest").cast("int").alias("rest"), "kinds")).alias("wanted"))
    ids = cut(wanted)
    source = docs.join(few(ids.select("row")), "row", "left_semi").groupBy("row").agg(F.min("text").alias("text"))
    pieces = source.join(ids, "row").select("text", "wanted").transform(arrow, _cut_out, "seed long, kind long, before int, bytes binary, kinds long")
    part = (SHORT - SEED) // SIDES
    context = lambda i: F.xxhash64(F.lit(i), F.expr(f"substring(bytes, greatest(before - {i * part}, 0) + 1, least({i * part}, before))"), F.expr(f"substring(bytes, before + {SEED} + 1, {(SIDES - i - 1) * part})"))
    side = F.explode(F.when(F.col("kinds") <= TOGETHER, F.array(F.lit(0).cast("long"))).otherwise(F.array(*[context(i) for i in range(SIDES)])))
    dealt = pieces.withColumn("side", side).select("seed", "kind", "before", "bytes", "side")
    found = dealt.repartition("seed", "side").sortWithinPartitions("seed", "side", "kind").transform(arrow, _compare, "seed long, kind long, spans array<struct<a:int,b:int>>")
    spans = cut(found.unionByName(whole))
    flat = near.select("row", "seed", "kind", "at", "reach").join(spans, ["seed", "kind"])
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("at")).alias("a"), (s["b"] + F.col("at") + F.col("reach")).alias("b")))
    return flat.select("row", moved.alias("spans")).distinct().groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    repeated.

    Texts are UTF-8 bytes, null is empty. A byte is removed if a string of ``LENGTH`` bytes that covers it
    also begins anywhere else, in the same text (overlaps included) or another row's; all such strings
    go, no occurrence is preferred, so there are no ties. ``repeated`` says that bytes were removed, or that
    a passage of over ``WORDS`` words and at least ``SHORT`` bytes also stands elsewhere. Repeated rows are
    repeats of each other. An empty table gives an empty result.
    """
    own = docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).alias("row"))
    spans = cut(covered(own.select("row", "text")))
    keys = few(spans.select("row"))
    with_spans = own.join(keys, "row", "left_semi").join(spans, "row").select("doc_id", "text", "spans")
    without = own.join(keys, "row", "left_anti").select("doc_id", "text", F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeated boolean"
    return with_spans.transform(arrow, _digest, schema).unionByName(without.transform(arrow, _digest, schema))
