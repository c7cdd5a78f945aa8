"""Cross-fitted boosted trees on pair features (JVM, spark.ml)."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .decide import early_stop, fold_of
from .lineage import written

MAY_MISS = ("num_absdiff", "num_digit_ed", "num_jac", "ce")
#: Models that are fitted at the same time.
AT_ONCE = 4


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """Adds a vector; missing values become -1 with a flag of their own."""
    miss = [c for c in features if c in MAY_MISS and c in df.columns]
    d = df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in miss} | {c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in features})
    return VectorAssembler(inputCols=[*features, *[f"{c}_missing" for c in miss]], outputCol="features").transform(d)


def fit(train: DataFrame, depth: int = 5, rounds: int = 20, step: float = 0.1, min_leaf: int = 5, subsample: float = 0.8, seed: int = 7):
    """Boosted trees on all rows of ``train`` (features, label, es); rows marked es stop the boosting."""
    g = GBTClassifier(labelCol="label", featuresCol="features", maxDepth=depth, maxIter=rounds, stepSize=step, subsamplingRate=subsample, minInstancesPerNode=min_leaf, featureSubsetStrategy="0.8", seed=seed)
    if "es" in train.columns and train.where("es").head(1) and train.where("not es").head(1):
        g = g.setValidationIndicatorCol("es")
    return g.fit(train)


def fitted(tables: list[DataFrame], **how) -> list:
    """``fit`` of each table, several at a time: a fit is a long row of short jobs that leave most cores idle."""
    with ThreadPool(min(AT_ONCE, max(1, len(tables)))) as pool:
        return pool.map(inheritable_thread_target(lambda t: fit(t, **how)), tables, 1)


def predicted(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("p", vector_to_array("probability")[1])


def cross_fitted(pairs: DataFrame, features: list[str], models: list | None = None, **how) -> tuple[DataFrame, list]:
    """Out-of-fold p for each pair (columns s1_id, oth_id, label), and both models. Folds are by entity.
    ``models`` that were fitted before are used as they are."""
    d = assembled(pairs, features).withColumn("fold", fold_of(F.col("s1_id"))).withColumn("es", early_stop(F.col("s1_id"))).withColumn("label", F.col("label").cast("double"))
    # every boosting round reads the rows again: they come from the shared folder, not from the plan above
    d = written(d.select("s1_id", "oth_id", "features", "label", "fold", "es"))
    models = models or fitted([d.where(F.col("fold") != k) for k in (0, 1)], **how)
    out = [predicted(m, d.where(F.col("fold") == k)).select("s1_id", "oth_id", "p", "label", "fold") for k, m in enumerate(models)]
    return out[0].unionByName(out[1]), models


def ensemble(models: list, df: DataFrame, features: list[str]) -> DataFrame:
    """The mean of all models' p."""
    d = assembled(df, features)
    for i, m in enumerate(models):
        d = predicted(m, d).withColumnRenamed("p", f"_p{i}").drop("probability", "rawPrediction", "prediction")
    return d.select("s1_id", "oth_id", (sum(F.col(f"_p{i}") for i in range(len(models))) / len(models)).alias("p"))


def names(features: list[str]) -> list[str]:
    """Names of the vector's places, in order."""
    return [*features, *[f"{c}_missing" for c in features if c in MAY_MISS]]


def save(spark, models: list, features: list[str], path: str) -> None:
    """Writes models and the names of their features to a folder that Spark reaches."""
    for i, m in enumerate(models):
        m.write().overwrite().save(f"{path}/model-{i}")
    spark.createDataFrame([(i, c) for i, c in enumerate(features)], "place int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load(spark, features: list[str], path: str) -> list | None:
    """Models that ``save`` has written; None if there are none. Other features than theirs are an error."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/features")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return None
    known = [r["feature"] for r in spark.read.parquet(f"{path}/features").orderBy("place").collect()]
    if known != list(features):
        raise ValueError(f"the models in {path} were fitted on {known}, not on {list(features)}")
    out = []
    while fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/model-{len(out)}")):
        out.append(GBTClassificationModel.load(f"{path}/model-{len(out)}"))
    return out


def importance(spark, models: list, features: list[str]) -> DataFrame:
    """(feature, gain): the mean share of the gain of each feature, its missing flag included."""
    gain = dict.fromkeys(features, 0.0)
    for m in models:
        for name, x in zip(names(features), m.featureImportances.toArray().tolist()):
            gain[name if name in gain else name.removesuffix("_missing")] += x / len(models)
    return spark.createDataFrame(sorted(gain.items(), key=lambda x: (-x[1], x[0])), "feature string, gain double")


def auc(scored: DataFrame, score: str = "p", label: str = "label") -> DataFrame:
    """One row: the area under the ROC curve, ties counting half; null without rows of both labels."""
    n = scored.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("yes"), F.sum((F.col(label) != 1).cast("long")).alias("no"))
    return auc_of(n)


def auc_of(n: DataFrame) -> DataFrame:
    """``auc`` from s, yes and no: rows of either label by score."""
    # scores are rounded by the caller if they are many: a row for each distinct one
    w = Window.orderBy("s")
    below = F.coalesce(F.sum("no").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return n.withColumn("below", below).agg(F.round(F.try_divide(F.sum(F.col("yes") * (F.col("below") + F.col("no") / 2)), F.sum("yes").cast("double") * F.sum("no")), 6).alias("auc"))


def rescored(texts: DataFrame, scorer, name: str = "ce") -> DataFrame:
    """s1_id, oth_id and ``name`` for pairs of texts (s1_id, oth_id, text_a, text_b): ``scorer`` takes two
    pandas Series and gives one of floats. Batches reach it ordered by length, as padding scorers want."""
    schema = f"s1_id string, oth_id string, {name} double"

    def run(batches):
        for b in batches:
            b = b.iloc[(b["text_a"].str.len() + b["text_b"].str.len()).argsort(kind="stable")]
            yield b[["s1_id", "oth_id"]].assign(**{name: scorer(b["text_a"], b["text_b"]).astype("float64").to_numpy()})

    return texts.select("s1_id", "oth_id", "text_a", "text_b").mapInPandas(run, schema)
