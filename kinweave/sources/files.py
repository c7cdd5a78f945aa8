"""Sources and sinks: unquoted TSV, Parquet, submission files, JSON reports, and their checks."""

from __future__ import annotations

import json
import zipfile
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import written

RAW = "entity_id string, business_name string, business_address string, country string"
#: Pieces of lists that a task counts before it tells the counts of their ids.
TALLIED = 200_000
#: Repeated entities that are sent to all tasks.
FEW = 100_000
TRUTH = "source1_entity_id string, matched_entity_ids string"


def read_tsv(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """Header, tabs, no quoting, all strings; blanks are empty strings."""
    return spark.read.schema(schema).csv(path, sep="\t", quote="", header=True, recursiveFileLookup=True).fillna("")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", quote="", header=True, emptyValue="")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def listing(spark: SparkSession, root: str) -> list[str]:
    """All files below ``root``, sorted, in whatever file system it is."""
    at, fs = _fs(spark, root)
    out, files = [], fs.listFiles(at, True)
    while files.hasNext():
        out.append(files.next().getPath().toString())
    return sorted(out)


def raw_files(spark: SparkSession, root: str, stems: list[str], ending: str = ".tsv") -> dict[str, str]:
    """The file of each stem below ``root``; none or several are an error."""
    files = listing(spark, root)
    hits = {stem: [f for f in files if f.rsplit("/", 1)[-1] == stem + ending] for stem in stems}
    wrong = {stem: found for stem, found in hits.items() if len(found) != 1}
    if wrong:
        raise FileNotFoundError(f"one file is wanted for each of {sorted(wrong)}; found {wrong}")
    return {stem: found[0] for stem, found in hits.items()}


def artefact(spark: SparkSession, roots: list[str], name: str, required: bool = True) -> str | None:
    """The first file called ``name`` below the first of ``roots`` that has one."""
    for root in roots:
        at, fs = _fs(spark, root)
        found = [f for f in listing(spark, root) if f.rsplit("/", 1)[-1] == name] if fs.exists(at) else []
        if found:
            return found[0]
    if required:
        raise FileNotFoundError(f"no {name} below {roots}")
    return None


def extract_zip(archive: str, to: str) -> list[str]:
    """Unpacks the TSV files of a local archive, without the folders that some systems add; their paths."""
    with zipfile.ZipFile(archive) as z:
        wanted = [n for n in z.namelist() if n.endswith(".tsv") and "__MACOSX" not in n.split("/")]
        z.extractall(to, wanted)
    return [f"{to}/{n}" for n in wanted]


def write_one_tsv(df: DataFrame, path: str, order: str) -> None:
    """One file, ordered; a submission has one row for each entity and is read as a whole."""
    df.orderBy(order).coalesce(1).write.mode("overwrite").csv(path, sep="\t", quote="", header=True, emptyValue="")


def copied(spark: SparkSession, path: str, to: str) -> None:
    """Copies a file or folder, as the candidates beside the results."""
    (a, fs_a), (b, fs_b) = _fs(spark, path), _fs(spark, to)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs_a, a, fs_b, b, False, True, spark._jsc.hadoopConfiguration())


def limited(df: DataFrame, n: int | None, order: str) -> DataFrame:
    """The first ``n`` rows by a column; all if ``n`` is None."""
    return df if n is None else df.orderBy(order).limit(n)


def header_problem(spark: SparkSession, path: str, schema: str = TRUTH) -> str:
    """What is wrong with a file's header; empty if nothing is."""
    want = [c.split()[0] for c in schema.split(", ")]
    got = spark.read.csv(path, sep="\t", quote="", header=True).columns
    return "" if got == want else f"header {got}, wanted {want}"


def integrity(clean: DataFrame, raw: DataFrame, truth: DataFrame | None = None, key: str = "entity_id") -> DataFrame:
    """(problem, n) of normalised records: rows that are missing or too many, repeated ids, nulls, empty
    name cores, and ids of the truth (oth_id) that are unknown."""
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in clean.columns])
    rows = clean.agg(F.count("*").alias("n"), F.countDistinct(key).alias("ids"), nulls.alias("nulls"), F.count_if(F.col("name_core") == "").alias("empty")).withColumn("k", F.lit(1))
    both = rows.join(raw.agg(F.count("*").alias("raw")).withColumn("k", F.lit(1)), "k")
    found = both.select(F.explode(F.create_map(
        F.lit("missing_rows"), F.abs(F.col("n") - F.col("raw")), F.lit("repeated_ids"), F.col("n") - F.col("ids"), F.lit("nulls"), F.col("nulls"), F.lit("empty_names"), F.col("empty"),
    )).alias("problem", "n"))
    if truth is not None:
        unknown = truth.join(clean.select(F.col(key).alias("oth_id")), "oth_id", "left_anti").agg(F.lit("unknown_in_truth").alias("problem"), F.count("*").alias("n"))
        found = found.unionByName(unknown)
    return found


def not_among(results: DataFrame, cands: DataFrame, key: str = "source1_entity_id", a: str = "matched_entity_ids", b: str = "candidate_entity_ids") -> DataFrame:
    """Entities whose matches are no subset of their candidates: key and the ids that are not."""
    ids = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    both = results.select(key, a).join(cands.select(key, b), key, "left").withColumn("extra", F.array_except(ids(F.col(a)), ids(F.col(b))))
    return both.where(F.size("extra") > 0).select(key, F.array_join(F.array_sort("extra"), ",").alias("extra"))


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, compression: str = "zstd") -> None:
    df.write.mode("overwrite").parquet(path, compression=compression)


def write_report(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, indent=2)


def exploded(df: DataFrame, key: str = "source1_entity_id", ids: str = "matched_entity_ids") -> DataFrame:
    """(s1_id, oth_id) pairs of comma lists; empty lists give none."""
    return df.select(F.col(key).alias("s1_id"), F.explode(F.split(ids, ",")).alias("oth_id")).where("oth_id <> ''")


def listed(spine: DataFrame, pairs: DataFrame, order: str | None = None, out: str = "matched_entity_ids") -> DataFrame:
    """One row per entity of ``spine`` (s1_id) with its comma list, by ``order`` descending or by id."""
    key = F.struct((-F.col(order) if order else F.lit(0)).alias("o"), F.col("oth_id"))
    own = pairs.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(key)), lambda x: x["oth_id"]), ",").alias(out))
    return spine.select("s1_id").distinct().join(own, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(out, F.lit("")).alias(out))


def _tallied(batches):
    """How often each id stands in comma lists; and without an id, how many of them a list repeats.

    Lists share long runs of ids: a list is cut after each id that ends in 7, and a piece is taken apart once."""
    codes, pieces, times, more = {"": 0}, {}, Counter(), 0

    def coded(ids):
        return np.array([codes.setdefault(x, len(codes)) for x in ids], np.int64)

    def told():
        n = np.zeros(len(codes), np.int64)
        for kind, many in times.items():
            np.add.at(n, pieces[kind], many)
        ids, n = list(codes)[1:], n[1:]
        return pa.RecordBatch.from_arrays([pa.array([*ids, None], pa.string()), pa.array([*n.tolist(), more], pa.int64())], ["oth_id", "n"])

    place = np.zeros(0, np.int64)
    for b in batches:
        for text in b.column(0):
            own = (text.as_py() or "").split("7,")
            own[-1] = (own[-1],)  # the end of the list: nothing was cut off
            for x in {x for x in own if x not in pieces}:
                pieces[x] = coded(x[0].split(",") if isinstance(x, tuple) else f"{x}7".split(","))
            times.update(own)
            at = np.concatenate([pieces[x] for x in own])
            at = at[at > 0]
            if len(codes) > len(place):
                place = np.zeros(2 * len(codes), np.int64)
            place[at] = np.arange(len(at))
            if (place[at] != np.arange(len(at))).any():
                more += len(at) - len(np.unique(at))
            if len(pieces) > TALLIED:
                yield told()
                codes, pieces, times, more = {"": 0}, {}, Counter(), 0
    yield told()


def problems(result: DataFrame, spine: DataFrame, known: DataFrame, ids: str = "matched_entity_ids") -> DataFrame:
    """(problem, n): counts of what a submission file must not have: repeated, missing or unknown entities, repeated
    ids in a list, unknown ids."""
    # lists are long: all are gone through once, as texts; only entities with several rows are counted pair by pair
    counts = result.select(ids).mapInArrow(_tallied, "oth_id string, n long")
    listed_ids = written(counts.groupBy("oth_id").agg(F.sum("n").alias("count")))
    within = listed_ids.where("oth_id is null").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    again = written(result.groupBy("source1_entity_id").agg(F.count("*").alias("rows")).where("rows > 1").select("source1_entity_id"))
    again = F.broadcast(again) if again.limit(FEW + 1).count() <= FEW else again  # else the lists of all would be sent
    several = exploded(result.join(again, "source1_entity_id", "left_semi").withColumn(ids, F.array_join(F.array_distinct(F.split(ids, ",")), ",")), ids=ids)
    across = several.groupBy("s1_id", "oth_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
    one = F.col("s1_id") == F.col("source1_entity_id")
    found = {
        "repeated_entities": result.agg((F.count("*") - F.countDistinct("source1_entity_id")).alias("n")),
        "missing_entities": spine.select("s1_id").join(result, one, "left_anti").agg(F.count("*").alias("n")),
        "unknown_entities": result.join(spine.select("s1_id"), one, "left_anti").agg(F.count("*").alias("n")),
        "repeated_ids": within.unionByName(across).agg(F.sum("n").alias("n")),
        "unknown_ids": listed_ids.where("oth_id is not null").join(known.select("oth_id"), "oth_id", "left_anti").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")),
    }
    parts = [d.select(F.lit(k).alias("problem"), F.col("n").cast("long").alias("n")) for k, d in found.items()]
    return reduce(DataFrame.unionByName, parts)
