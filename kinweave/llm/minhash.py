"""Near-duplicate documents: universal hash minima, banding, signature and full-set verification,
components by large-star and small-star.

Stages and what is shuffled:

1. One pass over the texts (Arrow batches, numpy) gives each document its set's size, a 128-bit
   fingerprint of its shingle set and 128 minima. Texts are not shuffled.
2. Documents of one set collapse into a node (map-side combined), so exact copies cost nothing
   further, however many there are.
3. 32 bands of 4 minima. Nodes that share a band are candidates. A bucket's members are compared
   with its first node only: a star, not all pairs. Candidates pass a signature test, then are
   confirmed on the full shingle sets of the texts.
4. Buckets of which not all members ended up in one component hold pairs that the stars did not
   decide. They are compared exhaustively, in pairs of blocks of bounded size, each pair of nodes in
   the first band that it shares; only confirmed links leave a task. Nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, chunks, cut, mix, shingle_hashes, string_bytes, word_hashes
from .components import connected_components

#: Minima, and rows of a band: a pair of similarity 0.75 misses all bands once in 190,000 times.
MINIMA, ROWS = 128, 4
BANDS = MINIMA // ROWS
#: Agreement of minima from which a candidate is confirmed on full sets; at a similarity of 0.75
#: the agreement is 0.75 +- 0.04, so that this loses one link in ten million.
AGREE = 0.55
#: Nodes of a block of a bucket that is compared exhaustively.
BLOCK = 256
#: Ids up to this number are broadcast (16 bytes each) when texts are looked up.
BROADCAST_IDS = 1_000_000
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20

_SEED = np.arange(1, 2 * MINIMA + 1, dtype=np.uint64)
_FACTORS = (mix(_SEED[:MINIMA] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (mix(_SEED[MINIMA:] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def minima(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, MINIMA) minima of the universal hashes a*x+b modulo 2^32; all ones for an empty set."""
    out = np.full((len(offsets) - 1, MINIMA), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        buf = np.empty_like(x)
        for k in range(MINIMA):
            np.multiply(x, _FACTORS[k], out=buf)
            buf += _SHIFTS[k]
            out[full, k] = np.minimum.reduceat(buf, offsets[full])
    return out


def text_sets(column, k: int):
    """Yields (first row, hashes, offsets) of bounded chunks of a text column."""
    data, off = string_bytes(column)
    for a, b in chunks(off, CHUNK):
        words, per = word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a])
        yield a, *shingle_hashes(words, per, k)


def _distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes sorted and without repeats within each text, and their offsets."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(row[order].astype(np.int32), kind="stable")]
    h, r = hashes[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[keep], np.searchsorted(r[keep], np.arange(len(offsets)))


SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, minima binary"


def _sketch(k: int, texts: bool = False):
    def run(batches):
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for a, hashes, off in text_sets(text, k):
                h, o = _distinct(hashes, off)
                n = np.diff(o)
                first, second = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    first[full] = np.add.reduceat(h, o[full])
                    second[full] = np.add.reduceat(mix(h + np.uint64(1)), o[full])
                if texts:
                    yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), text.slice(a, len(n))], names=["n_shingles", "set_a", "set_b", "text"])
                    continue
                sig = minima(h, o)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, len(n)).cast(pa.int64()),
                        pa.array(n.astype(np.int64)),
                        pa.array(first.view(np.int64)),
                        pa.array(second.view(np.int64)),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * MINIMA), len(n), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "minima"],
                )

    return run


def sketch(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the shingle set, and the minima."""
    return docs.select(F.col("doc_id").cast("long"), "text").transform(arrow, _sketch(k), SKETCH)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _agreeing(batches):
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, MINIMA) for i in (2, 3))
        keep = (x == y).mean(axis=1) >= AGREE
        yield batch.select([0, 1]).filter(pa.array(keep))


def _confirm(k: int, percent: int):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            for at in range(0, n, 512):
                part = batch.slice(at, 512)
                sets = []
                for i in (2, 3):
                    own = []
                    for _, h, o in text_sets(part.column(i), k):
                        h, o = _distinct(h, o)
                        own += [h[o[d] : o[d + 1]] for d in range(len(o) - 1)]
                    sets.append(own)
                keep = [_linked(x, y, percent) for x, y in zip(*sets)]
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _exhaust(k: int, percent: int):
    """Compares the nodes of two blocks of a bucket; the rows of a task come sorted by group."""

    def group(rows):
        band = rows[0][0]
        nodes, comps, side = ([r[i] for r in rows] for i in (2, 3, 4))
        sets, sigs = [], []
        for _, h, o in text_sets(pa.array([r[5] for r in rows], pa.large_string()), k):
            h, o = _distinct(h, o)
            sigs.append(minima(h, o))
            sets += [h[o[d] : o[d + 1]] for d in range(len(o) - 1)]
        sig = np.concatenate(sigs)
        parent = {c: c for c in comps}

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        left = [i for i, s in enumerate(side) if s != 1]
        right = np.array([i for i, s in enumerate(side) if s != 0])
        for i in left:
            others = right[right > i] if side[i] == 2 else right
            if not len(others):
                continue
            same = sig[others] == sig[i]
            shared = same.reshape(len(others), BANDS, ROWS).all(axis=2)
            first = shared.argmax(axis=1)
            for j in others[(first == band) & shared.any(axis=1) & (same.mean(axis=1) >= AGREE)]:
                if root(comps[i]) != root(comps[j]) and _linked(sets[i], sets[j], percent):
                    parent[root(comps[i])] = root(comps[j])
                    yield nodes[i], nodes[j]

    def run(batches):
        rows, key, out = [], None, []
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (r[0], r[1], r[6]) != key:
                    if rows:
                        out += group(rows)
                    rows, key = [], (r[0], r[1], r[6])
                rows.append(r)
            if out:
                yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [y for _, y in out]}, schema=_PAIR)
                out = []
        if rows:
            out = list(group(rows))
            if out:
                yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [y for _, y in out]}, schema=_PAIR)

    return run


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _lookup(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, text) of the documents named in ``ids``. The ids are broadcast only if they are few."""
    ids = ids.select("node").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.coalesce("text", F.lit("")).alias("text")).join(ids, "node", "left_semi")
    return cut(texts.groupBy("node").agg(F.min("text").alias("text")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """Near-duplicate components of ``docs`` (columns doc_id, text; others are ignored).

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union| of their sets of
    ``k``-word shingles, A-Z lower-cased; fewer than ``k`` words are one shingle. Returns one row
    for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null and empty texts, and texts of separators only, have an empty set, are linked with nothing
    and are kept. Rows that repeat a doc_id count as one document with the texts of all of them,
    and give a row each. A row whose doc_id is null is its own component (component_id null) and is
    kept. An empty table gives an empty result.
    """
    marks = cut(sketch(docs, k))
    key = ["set_a", "set_b", "n_shingles"]
    full = marks.where("n_shingles > 0 and doc_id is not null")
    nodes = full.groupBy(*key).agg(F.min("doc_id").alias("own"), F.first("minima").alias("minima"))
    # ids with several sets: a set that has such an id as its smallest gets a node number of its own
    several = cut(full.groupBy("doc_id").agg(*[f("set_" + c).alias(n + c) for c in "ab" for f, n in ((F.min, "low_"), (F.max, "high_"))]).where("low_a < high_a or low_b < high_b").select("doc_id"))
    repeats = bool(several.head(1))
    if repeats:
        nodes = nodes.join(several.select(F.col("doc_id").alias("own"), F.lit(True).alias("many")), "own", "left").withColumn("node", F.when(F.col("many"), F.xxhash64(*key)).otherwise(F.col("own"))).drop("many")
    else:
        nodes = nodes.withColumn("node", F.col("own"))
    nodes = cut(nodes.select(*key, "own", "node", "minima"))
    bands = nodes.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(j, F.substring(F.col("minima"), j * (4 * ROWS) + 1, F.lit(4 * ROWS))))).alias("band", "bucket"))
    heads = bands.groupBy("band", "bucket").agg(F.min("node").alias("head"), F.max("node").alias("last"), F.count("*").alias("size")).where("head < last").drop("last")
    shared = cut(bands.join(heads, ["band", "bucket"]))
    texts = _lookup(docs, shared.join(several.select(F.col("doc_id").alias("node")), "node", "left_anti") if repeats else shared)
    if repeats:
        apart = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(several, "doc_id", "left_semi").select("doc_id", "text").transform(arrow, _sketch(k, True), "n_shingles long, set_a long, set_b long, text string")
        wanted = nodes.where("node <> own").select(*key, "node").join(shared.select("node").distinct(), "node", "left_semi")
        texts = cut(texts.unionByName(apart.join(wanted, key).groupBy("node").agg(F.min("text").alias("text"))))

    pairs = shared.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    sig = nodes.groupBy("node").agg(F.first("minima").alias("minima"))
    pairs = (
        pairs.join(sig.select(F.col("node").alias("a"), F.col("minima").alias("sa")), "a")
        .join(sig.select(F.col("node").alias("b"), F.col("minima").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
        .transform(arrow, _agreeing, "a long, b long")
    )
    star = cut(
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
        .transform(arrow, _confirm(k, percent), "a long, b long")
    )
    # one document with several texts links the nodes of all of them
    repeated = star.limit(0)
    if repeats:
        of = cut(full.join(several, "doc_id", "left_semi").select("doc_id", *key).distinct().join(nodes.select(*key, "node"), key).select("doc_id", "node"))
        first = of.groupBy("doc_id").agg(F.min("node").alias("b"))
        repeated = cut(of.join(first, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b").distinct())
    found = connected_components(star.unionByName(repeated))

    mixed = shared.where("size > 2").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = mixed.groupBy("band", "bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("size").alias("n")).where("low < high")
    open_ = mixed.join(split.select("band", "bucket", "n"), ["band", "bucket"])
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = open_.withColumn("mine", mine).select(
        "band", "bucket", "node", "component",
        F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(
            F.when(o == F.col("mine"), 2).when(F.col("mine") < o, 0).otherwise(1).alias("side"),
            (F.least(o, F.col("mine")).cast("long") * F.lit(1 << 32) + F.greatest(o, F.col("mine"))).alias("cell"),
        ))).alias("to"),
    )
    more = cut(
        dealt.join(texts, "node")
        .select("band", "bucket", "node", "component", "to.side", "text", "to.cell")
        .repartition("band", "bucket", "cell")
        .sortWithinPartitions("band", "bucket", "cell", "node")
        .transform(arrow, _exhaust(k, percent), "a long, b long")
    )
    if more.head(1):
        found = connected_components(star.unionByName(repeated).unionByName(more))
    placed = nodes.select(*key, "own", "node").join(found, "node", "left").select(*key, "own", "node", F.coalesce("component", "node").alias("component"))
    if repeats:  # components that hold nodes numbered apart are named by their smallest id again
        placed = cut(placed)
        named = placed.join(placed.where("node <> own").select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("own").alias("low"))
        placed = placed.join(named, "component", "left").withColumn("component", F.coalesce("low", "component"))
    placed = placed.select(*key, "component")
    member = marks.drop("minima").join(placed, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return member.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` without near duplicates: of each component the row whose doc_id is the smallest stays.

    Of the rows of one doc_id one stays (that of the smallest text). Rows without a doc_id stay, as do
    those of different ids without words.
    """
    found = cut(near_duplicates(docs, k, percent).where("doc_id is not null").groupBy("doc_id").agg(F.first("kept").alias("kept"), F.count("*").alias("rows")))
    apart = found.where(~F.col("kept") | (F.col("rows") > 1)).select("doc_id")
    many = found.where(F.col("kept") & (F.col("rows") > 1)).select("doc_id")
    if apart.count() <= BROADCAST_IDS:
        apart, many = F.broadcast(apart), F.broadcast(many)
    single = docs.join(apart, "doc_id", "left_anti").select(docs.columns)
    one = F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("row")
    return single.unionByName(docs.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(one).select("row.*"))
