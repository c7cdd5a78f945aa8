"""Near-duplicate vectors by spherical-cap filters from random product codes.

A filter is the cap around a direction. Directions are words of a product code: a vector is cut into
``PARTS`` parts, each part has its own random unit directions, and every combination is a filter, whose
score is the sum of the parts' scores. List decoding finds all filters that a vector exceeds without
trying each: parts' scores are sorted, and partial sums that cannot reach the threshold are cut off.
Vectors that share a filter are compared in double precision, in blocks of bounded size. A pair counts
in the first filter that it shares, so that nothing has to be made distinct; a block gives each of its
vectors a number of links and the smallest vector that it reaches there, not the pairs: what leaves the blocks
grows with the vectors in them, not with the square of a group of near ones.
"""

from __future__ import annotations

from hashlib import blake2b
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, cut
from .components import connected_components

#: Cosine from which vectors are linked.
COSINE = 0.9
#: Parts of the code, filters that a vector exceeds on average, and vectors of a filter.
PARTS, LIST, FILLED = 2, 48, 128
#: Each vector gets its best filters up to this number even if they do not exceed the threshold.
LEAST = 32
#: Vectors up to which LIST and LEAST hold as they are.
SMALL = 100_000
#: Vectors of a block of a filter.
BLOCK = 512


def lists(n: int) -> tuple[int, int]:
    """LIST and LEAST for ``n`` vectors: both grow by half for each factor of ten above SMALL, as filters
    get narrower and near vectors share fewer of them."""
    grown = 1 + max(0.0, log10(max(n, 1) / SMALL)) / 2
    return round(LIST * grown), round(LEAST * grown)


def code(dim: int, size: int) -> list[np.ndarray]:
    """Unit directions of each part; the same for all workers and runs."""
    parts = np.array_split(np.arange(dim), min(PARTS, dim))
    out = []
    for i, p in enumerate(parts):
        d = np.random.default_rng([20240607, dim, size, i]).standard_normal((size, len(p)))
        out.append(d / np.sqrt((d * d).sum(1))[:, None])
    return out


def parameters(n: int, dim: int) -> tuple[int, float]:
    """Directions of a part and the threshold for ``n`` vectors: filters hold FILLED vectors on average
    and a vector exceeds as many filters as ``lists`` says, if it points anywhere."""
    parts = min(PARTS, dim)
    wanted = lists(n)[0]
    filters = max(256, n * wanted // FILLED)
    size = min(8192, max(16, round(filters ** (1 / parts))))
    share = min(0.5, wanted / size**parts)
    # upper quantile of the normal distribution, by bisection of its tail
    from math import erfc, sqrt

    lo, hi = 0.0, 12.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if erfc(mid / sqrt(2)) / 2 > share else (lo, mid)
    return size, lo / sqrt(max(dim / parts, 1))


def filters_of(x: np.ndarray, directions: list[np.ndarray], threshold: float, least: int = LEAST) -> np.ndarray:
    """Numbers of the filters that the unit vector ``x`` exceeds, or of its best ones."""
    at, scores = 0, []
    for d in directions:
        scores.append(d @ x[at : at + d.shape[1]])
        at += d.shape[1]
    if len(scores) == 1:
        scores.append(np.zeros(1))
    a, b = scores
    rank_a, rank_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    found = _reaching(a, b, rank_a, rank_b, threshold)
    if len(found) < least:
        top_a, top_b = rank_a[:least], rank_b[:least]
        s = (a[top_a][:, None] + b[top_b][None]).ravel()
        best = np.argsort(-s, kind="stable")[:least]
        found = top_a[best // len(top_b)] * len(b) + top_b[best % len(top_b)]
    return found


def _reaching(a, b, rank_a, rank_b, threshold):
    """Pairs (i, j) with a[i] + b[j] >= threshold, as i * len(b) + j."""
    sorted_b = -b[rank_b]
    some = rank_a[: np.searchsorted(-a[rank_a], b[rank_b[0]] - threshold, side="right")]
    n = np.searchsorted(sorted_b, a[some] - threshold, side="right")
    if not n.sum():
        return np.zeros(0, np.int64)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(some, n) * len(b) + rank_b[within]


def _unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision; not finite where there is none."""
    x = x.astype(np.float64)
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _unit(kind):
    def run(batches):
        for batch in batches:
            out = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not v or any(c is None for c in v):
                    continue
                raw = np.array(v, kind)
                unit = _unit_rows(raw[None])
                if np.isfinite(raw).all() and np.isfinite(unit).all():
                    key = blake2b(unit.tobytes(), digest_size=16).digest()
                    out.append((i, len(v), *np.frombuffer(key, np.int64).tolist(), raw.tobytes()))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 5, types)], names=["vec_id", "dim", "ha", "hb", "raw"])

    return run


def _decode(settings: dict[int, tuple[int, float, int]], kind):
    def run(batches):
        codes: dict[int, list] = {}
        for batch in batches:
            found = []
            for dim, raw in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                size, threshold, least = settings[dim]
                directions = codes.get(dim) or codes.setdefault(dim, code(dim, size))
                f = filters_of(_unit_rows(np.frombuffer(raw, kind)[None])[0], directions, threshold, least)
                found.append(np.sort(f).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "filters"])

    return run


def _filters(batches):
    """Rows (dim, ha, hb, filters) to a row for each filter."""
    for batch in batches:
        lists = [np.frombuffer(x, np.int32) for x in batch.column(3).to_pylist()]
        if lists:
            at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(np.concatenate(lists))], names=["dim", "ha", "hb", "filter"])


def _first_here(lists: list[np.ndarray], number: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows ``a`` and ``b`` share no filter before ``number``."""
    before = [x[: np.searchsorted(x, number)] for x in lists]
    names, local = np.unique(np.concatenate(before), return_inverse=True)
    bits = np.zeros((len(lists), len(names)), bool)
    bits[np.repeat(np.arange(len(lists)), [len(x) for x in before]), local] = True
    bits = np.packbits(bits[:, bits.sum(axis=0) > 1], axis=1)
    out = np.ones(len(a), bool)
    for at in range(0, len(a), 4096):
        out[at : at + 4096] = ~(bits[a[at : at + 4096]] & bits[b[at : at + 4096]]).any(axis=1)
    return out


def _links(kind):
    """Rows sorted by (dim, filter, cell, node), with side, copies, filters, raw, ha, hb: for each node, how
    many others it links with here first, and the smallest node that these links reach."""

    def group(rows):
        x = _unit_rows(np.frombuffer(b"".join(r[7] for r in rows), kind).reshape(len(rows), -1))
        node, side, copies = (np.array([r[i] for r in rows]) for i in (3, 4, 5))
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        i, j = np.nonzero(x[left] @ x[right].T >= COSINE - 1e-9)
        a, b = left[i], right[j]
        on = (side[a] != 2) | (a < b)
        a, b = a[on], b[on]
        exact = np.einsum("ij,ij->i", x[a], x[b]) >= COSINE
        a, b = a[exact], b[exact]
        if len(a):
            own = _first_here([np.frombuffer(r[6], np.int32) for r in rows], rows[0][1], a, b)
            a, b = a[own], b[own]
        if not len(a):
            return None
        # rows come by node, so the smallest place is the smallest node
        count = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
        low = np.arange(len(rows))
        while True:
            new = low.copy()
            np.minimum.at(new, a, low[b])
            np.minimum.at(new, b, low[a])
            if (new == low).all():
                break
            low = new
        at = np.flatnonzero(count)
        ha, hb = (np.array([rows[i][k] for i in at.tolist()], np.int64) for k in (8, 9))
        return ha, hb, node[at], count[at].astype(np.int64), node[low[at]]

    def emit(parts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=["ha", "hb", "node", "others", "peer"])

    def run(batches):
        rows, key, parts = [], None, []
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(10))):
                if r[:3] != key:
                    if len(rows) > 1 and (got := group(rows)):
                        parts.append(got)
                    rows, key = [], r[:3]
                    if sum(len(p[0]) for p in parts) > 200_000:
                        yield emit(parts)
                        parts = []
                rows.append(r)
        if len(rows) > 1 and (got := group(rows)):
            parts.append(got)
        if parts:
            yield emit(parts)

    return run


def near_vectors(vectors: DataFrame) -> DataFrame:
    """One row per row of ``vectors`` (columns vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors with a cosine of ``COSINE`` or more are linked; each confirmed in double precision. Links of
    equal directions are counted, not listed: they collapse to one node first. Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing and are kept. Vectors of
    different lengths are not compared. A row without an id has none and no component, and is kept.
    Rows that repeat an id are one vector each, and each counts as a link of the others.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = np.float32 if element == "float" else np.float64
    units = cut(vectors.select(F.col("vec_id").cast("long"), "embedding").transform(arrow, _unit(kind), "vec_id long, dim int, ha long, hb long, raw binary"))
    key = ["dim", "ha", "hb"]
    nodes = cut(units.groupBy(*key).agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.min("raw").alias("raw")))
    sizes = {r["dim"]: (*parameters(r["n"], r["dim"]), lists(r["n"])[1]) for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row per vector length
    listed = cut(nodes.select(*key, "raw").transform(arrow, _decode(sizes, kind), "dim int, ha long, hb long, raw binary, filters binary"))
    single = listed.select(*key, "filters").transform(arrow, _filters, "dim int, ha long, hb long, filter int")
    counted = single.groupBy("dim", "filter").agg(F.count("*").alias("n")).where("n > 1")
    member = single.join(counted, ["dim", "filter"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("ha", "hb"), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(
        (F.least(o, F.col("mine")).cast("long") * F.lit(1 << 32) + F.greatest(o, F.col("mine"))).alias("cell"),
        F.when(o == F.col("mine"), 2).when(F.col("mine") < o, 0).otherwise(1).alias("side"),
    ))
    dealt = member.withColumn("mine", mine).select(*key, "filter", F.explode(cells).alias("to"))
    own = nodes.select(*key, "node", "copies").join(listed, key)
    full = dealt.join(own, key).select("dim", "filter", "to.cell", "node", "to.side", "copies", "filters", "raw", "ha", "hb")
    links = cut(full.repartition("dim", "filter", "cell").sortWithinPartitions("dim", "filter", "cell", "node").transform(arrow, _links(kind), "ha long, hb long, node long, others long, peer long"))
    others = links.groupBy("ha", "hb").agg(F.sum("others").alias("others"))
    found = connected_components(links.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    per = nodes.select(*key, "node", "copies").join(others, ["ha", "hb"], "left").join(found, "node", "left")
    known = units.join(per, key).select("vec_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    all_ = vectors.select(F.col("vec_id").cast("long")).join(known, "vec_id", "left")
    return all_.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))
