"""Mixing sources to target weights by weighted fair queueing.

A document's virtual finish time is the words that its source has sent up to its end, in shuffled
order, divided by the source's target. Ordered by finish time over all sources, every prefix holds
the sources in proportion to their targets; the mix is the prefix of the total budget. A source
whose target is above its size is sent again from its start, at most ``max_repeats`` times in all.

Nothing sorts all rows in one task: words are summed per source and hash range, ranges are added up
in a small table, and only within a range do window functions run. A source with a third of all
rows is spread over as many ranges as its rows ask for. The same holds for the global order: ranges
of finish time are summed, and rows are sorted only within the one range in which the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, word_count

#: Weights of the sources, by code point of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No document is sent more often.
MAX_REPEATS = 3
#: Rows of a range of the shuffled order, and of a range of finish times.
RANGE_ROWS = 2000


def source_key(source: Column) -> Column:
    """Orders like the source by code point, null last, and is never null."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("2"))


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds ``target`` to one row per source (columns ``key`` and ``source_size``).

    The weights share the sum of all sizes; a target stops at ``max_repeats`` times its source's
    size, and the excess goes to the others by weight until none is above. That is water filling:
    with sources in order of size by weight, the first level that does not overflow its own source
    holds for it and all later ones.
    """
    by_name = Window.orderBy("key")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before, whole = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = t.withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", (F.sum("source_size").over(whole).cast("double") - F.col("filled")) / F.col("open"))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.first(F.when(fits, F.col("level")), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("final", level)
    return t.select("key", "source_size", F.coalesce(F.least("cap", F.col("final") * F.col("weight")), F.col("cap")).alias("target"))


def finish_times(docs: DataFrame, carry: tuple[str, ...] = (), weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """One row per document: _id, _key, _hash, size, source_size, target, first_finish, round, and
    the columns named in ``carry``.

    ``first_finish`` is the virtual finish time of its first sending; each later one is ``round``
    (source size by target) later. Times are null for a source without words.
    """
    rows = docs.select(
        F.col("doc_id").alias("_id"),
        source_key(F.col("source")).alias("_key"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_hash"),
        word_count(F.col("text")).alias("size"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
    )
    light = rows.select("_key", "_hash", "size")
    slices = light.groupBy("_key", F.substring("_hash", 1, 3).alias("slice")).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    slices = cut(slices)
    per = targets(slices.groupBy(F.col("_key").alias("key")).agg(F.sum("words").alias("source_size"))).withColumnRenamed("key", "_key")
    # 4,096 slices of the hash; neighbouring ones join to a range of about RANGE_ROWS rows
    in_source = Window.partitionBy("_key").orderBy("slice")
    ranged = slices.withColumn("range", F.floor((F.sum("n").over(in_source) - F.col("n")) / RANGE_ROWS))
    first = Window.partitionBy("_key").orderBy("range")
    sums = ranged.groupBy("_key", "range").agg(F.sum("words").alias("words"))
    sums = sums.select("_key", "range", (F.sum("words").over(first) - F.col("words")).alias("before"))
    where = cut(ranged.select("_key", "slice", "range").join(sums, ["_key", "range"]).join(per, "_key"))
    dealt = rows.withColumn("slice", F.substring("_hash", 1, 3)).join(F.broadcast(where) if where.count() <= 500_000 else where, ["_key", "slice"])
    order = Window.partitionBy("_key", "range").orderBy("_hash", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    timed = dealt.withColumn("sent", F.col("before") + F.sum("size").over(order))
    target = F.nullif(F.col("target"), F.lit(0.0))
    return timed.select(
        "_id", "_key", "_hash", "size", "source_size", "target",
        (F.col("sent") / target).alias("first_finish"),
        (F.col("source_size") / target).alias("round"),
        F.col("sent").alias("_sent"),
        *[f"_carry_{c}" for c in carry],
    )


def mix(docs: DataFrame, carry: tuple[str, ...] = (), weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """The mix of ``docs`` (columns doc_id, text, source): doc_id, size, source_size, target, taken,
    sendings, first_finish and the columns named in ``carry``, one row per row of ``docs``.

    ``size`` is the text's number of words (null text: 0). ``taken`` is ``size`` times the number of
    sendings inside the budget, which is the sum of all sizes. Equal finish times are ordered by
    source, hash, id and sending, so reruns agree; rows that are equal in all of these are
    interchangeable. A null source is a source of its own; rows with a null doc_id are mixed like
    others. Documents without words are never taken. An empty table gives an empty result.
    """
    times = cut(finish_times(docs, carry, weights, max_repeats, seed))
    goal = times.agg(F.count("*").alias("n"), F.sum("size").alias("words")).first()
    words, n = goal["words"] or 0, goal["n"]
    sent = times.where("size > 0 and first_finish is not null")
    every = sent.select("_key", "_hash", "_id", "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: F.col("first_finish") + e * F.col("round"))).alias("sending", "finish"))
    grid = float(max(16, n // RANGE_ROWS))
    every = every.withColumn("range", F.floor(F.least(F.col("finish"), F.lit(2.0 * max_repeats)) * grid))
    total = every.groupBy("range").agg(F.sum("size").alias("words"))
    up = Window.orderBy("range")
    last = total.withColumn("until", F.sum("words").over(up)).where(F.col("until") >= words).orderBy("range").first() if words else None
    order = ["finish", "_key", "_hash", "_id", "size", "sending"]
    if last is None:
        inside = F.lit(words > 0)
        taken_in = lambda e: inside
    else:
        room = words - (last["until"] - last["words"])
        edge = every.where(F.col("range") == last["range"]).withColumn("sum", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        end = edge.where(F.col("sum") <= room).orderBy(*[F.col(c).desc() for c in order]).first()

        def taken_in(e):
            finish = F.col("first_finish") + e * F.col("round")
            at = F.floor(F.least(finish, F.lit(2.0 * max_repeats)) * grid)
            if end is None:
                return at < F.lit(last["range"])
            # the last sending inside, compared column by column
            bound = F.struct(F.lit(end["finish"]).alias("finish"), F.lit(end["_key"]).alias("k"), F.lit(end["_hash"]).alias("h"), F.lit(end["_id"]).cast("long").alias("i"), F.lit(end["size"]).cast("long").alias("s"), F.lit(end["sending"]).cast("int").alias("e"))
            own = F.struct(finish.alias("finish"), F.col("_key").alias("k"), F.col("_hash").alias("h"), F.col("_id").cast("long").alias("i"), F.col("size").alias("s"), e.cast("int").alias("e"))
            return (at < F.lit(last["range"])) | ((at == F.lit(last["range"])) & (own <= bound))

    hits = [F.when(F.coalesce(taken_in(F.lit(e)), F.lit(False)), 1).otherwise(0) for e in range(max_repeats)]
    sendings = F.when((F.col("size") > 0) & F.col("first_finish").isNotNull(), sum(hits[1:], hits[0])).otherwise(0)
    out = times.withColumn("sendings", sendings)
    return out.select(
        F.col("_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("sendings")).cast("long").alias("taken"),
        "sendings", "first_finish", *[F.col(f"_carry_{c}").alias(c) for c in carry],
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """The sendings of a mix in global order of finish time, range-partitioned: one row each."""
    one = mixed.where("sendings > 0").withColumn("sending", F.explode(F.sequence(F.lit(0), F.col("sendings") - 1)))
    finish = F.col("first_finish") + F.col("sending") * F.col("source_size") / F.col("target")
    return one.withColumn("finish", finish).orderBy("finish", "source_size", "doc_id", "sending")


#: The same in DuckDB's SQL, over the whole table.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce('1' || source, '2') AS k, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY k) - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
        sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open,
        CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM w),
l AS (SELECT *, (budget - filled) / open AS level FROM f),
m AS (SELECT (SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap) AS final),
t AS (SELECT k, source_size, budget, coalesce(least(cap, final * weight), cap) AS target FROM l, m),
e AS (SELECT d.*, source_size, target, budget,
        CAST(sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / nullif(target, 0) AS first_finish,
        CAST(source_size AS DOUBLE) / nullif(target, 0) AS round FROM d JOIN t USING (k)),
a AS (SELECT e.*, sending, first_finish + sending * round AS finish FROM e, (SELECT unnest([0, 1, 2]) AS sending) WHERE size > 0 AND target > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, k, h, doc_id, size, sending ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM a),
x AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM c WHERE upto <= budget GROUP BY doc_id)
SELECT e.doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM e LEFT JOIN x ON e.doc_id IS NOT DISTINCT FROM x.doc_id
"""
