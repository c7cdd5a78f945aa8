"""A linkage run end to end: normalise, block, score pairs, weigh entities, choose thresholds, decide.

Records come as masters (s1_id, name, address, country) and others (oth_id, src and the same), raw. What
a training run learns is held by ``Trained`` and applied to other records by ``linked``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text
from . import blocking, decide, evaluate, features, model
from .lineage import written

#: Features of a candidate among its entity's, besides a nullable second score.
ENTITY = "p rank n_rel pmax psum n_hi n_vhi p2 rel gap sib_name sib_nospace sib_addr sib_addr_eq sib_name_eq sib_n".split()


@dataclass
class Trained:
    pair_models: list
    entity_models: list
    entity_final: object
    pair_threshold: float
    entity_threshold: float
    gains: bool
    countries: DataFrame
    known: dict[str, str] = field(default_factory=dict)
    places: DataFrame | None = None
    report: dict = field(default_factory=dict)
    #: Normalised masters and others, and the features of their candidates, as they were learned from.
    learned: tuple | None = None


def normalised(records: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """Adds the normalised columns; a state column that the records bring along fills in where the
    address names none."""
    brought = "state" in records.columns
    own = records.withColumnRenamed("state", "_brought") if brought else records
    n = text.with_address(text.with_name(own, known=known), known=known)
    return n.withColumn("state", F.when(F.col("state") != "", F.col("state")).otherwise(F.coalesce("_brought", F.lit("")))).drop("_brought") if brought else n


def block(s1: DataFrame, oth: DataFrame, config: Config = Config()) -> DataFrame:
    """Candidates of normalised records, by their cleaned texts."""
    view = lambda df, key: df.select(key, F.col("name_clean").alias("name"), F.col("addr_clean").alias("address"), F.col("country_clean").alias("country"), "state")
    return blocking.candidates(view(s1, "s1_id"), view(oth, "oth_id"), config=config)


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return pairs.join(truth.select("s1_id", "oth_id").distinct().withColumn("label", F.lit(1)), ["s1_id", "oth_id"], "left").fillna(0, ["label"])


def _how(config: Config) -> dict:
    return {"depth": config.depth, "rounds": config.rounds, "step": config.step, "min_leaf": config.min_leaf, "subsample": config.subsample, "seed": config.seed}


def entity_table(scored: DataFrame, oth: DataFrame, config: Config = Config(), ce: DataFrame | None = None) -> DataFrame:
    """One owner for each record with the features of its entity. ``scored``: s1_id, oth_id, p."""
    c = decide.siblings(decide.entity_context(scored.select("s1_id", "oth_id", "p")), oth, config.anchor)
    return decide.with_second_score(c, ce, config.use_ce)


def _chosen(scored: DataFrame, truth: DataFrame, spine: DataFrame, grid) -> tuple[float, float]:
    best = evaluate.best_threshold(evaluate.sweep(scored, truth, spine, list(grid))).first()
    return best["threshold"], best["macro_f05"]


def train(spark: SparkSession, s1: DataFrame, oth: DataFrame, truth: DataFrame, config: Config = Config(), ce: DataFrame | None = None) -> Trained:
    """Learns from raw records and their true pairs (s1_id, oth_id).

    Words of Indic names and states of places are learned first, then pair models (two folds by entity, or
    those in ``config.models`` if they are there), then entity models on the out-of-fold scores. Both
    thresholds are those of the highest macro F0.5 on their grids; the entity stage decides if it gains."""
    names = oth.select(F.col("name").alias("a"), "oth_id").join(truth, "oth_id").join(s1.select("s1_id", F.col("name").alias("b")), "s1_id").where(F.col("a").rlike(text.INDIC))
    words = decide.word_dictionary(names, votes=config.dict_votes, share=config.dict_share, indic=True)
    known = {r["word"]: r["latin"] for r in words.collect()}  # a vocabulary: words, not records
    a, b = normalised(s1, known), normalised(oth, known)
    places = written(decide.city_states(a, config.city_votes, config.city_purity))
    b = decide.infer_states(b, places)
    a, b = written(a), written(b)
    spine = a.select("s1_id", F.col("country_clean").alias("country"))
    names_ = list(config.features)
    own_pairs = written(features.pair_features(block(a, b, config), a, b, tuple(c for c in names_ if c not in features.FEATURES)))
    pairs = labelled(own_pairs, truth)
    models = model.load(spark, names_, config.models) if config.models and not config.retrain else None
    scored, models_ = model.cross_fitted(pairs, names_, models, **_how(config))
    if config.models and models is None:
        model.save(spark, models_, names_, config.models)
    scored = written(scored)
    pair_t, pair_f = _chosen(scored, truth, spine, config.pair_grid)

    own = [*ENTITY, "ce"] if ce is not None and config.use_ce else ENTITY
    table = written(labelled(entity_table(scored, b, config, ce), truth))
    p_ent, entity_models = model.cross_fitted(table, own, **_how(config))
    p_ent = written(p_ent)
    entity_t, entity_f = _chosen(p_ent, truth, spine, config.entity_grid)
    final = model.fit(written(model.assembled(table, own).select("features", F.col("label").cast("double").alias("label"))), **_how(config))
    report = {"pair_f05": pair_f, "entity_f05": entity_f, "auc": model.auc(scored.withColumn("p", F.round("p", 4))).first()["auc"]}
    return Trained(models_, entity_models, final, pair_t, entity_t, entity_f > pair_f, written(spine.select("country").distinct()), known, places, report, (a, b, own_pairs))


def scores(trained: Trained, s1: DataFrame | None, oth: DataFrame | None, config: Config = Config(), ce: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(s1_id, oth_id, country, p) of all candidates of other raw records, by the mean of the pair models, and
    the normalised others. Without records, those that were learned from are scored; nothing of them is made again."""
    names = list(config.features)
    if trained.learned is not None and s1 is None and oth is None:
        a, b, pairs = trained.learned
    else:
        a = normalised(s1, trained.known)
        b = normalised(oth, trained.known)
        if trained.places is not None:
            b = decide.infer_states(b, trained.places)
        a, b = written(a), written(b)
        pairs = written(features.pair_features(block(a, b, config), a, b, tuple(c for c in names if c not in features.FEATURES)))
    p = model.ensemble(trained.pair_models, pairs, names)
    return written(p.join(a.select("s1_id", F.col("country_clean").alias("country")), "s1_id")), b


def linked(trained: Trained, s1: DataFrame | None, oth: DataFrame | None, config: Config = Config(), ce: DataFrame | None = None) -> DataFrame:
    """s1_id, oth_id, p, p_ent (null if the entity stage does not decide): the links of other raw records, or
    without any, of those that were learned from."""
    scored, b = scores(trained, s1, oth, config, ce)
    if trained.gains:
        own = [*ENTITY, "ce"] if ce is not None and config.use_ce else ENTITY
        table = model.assembled(entity_table(scored, b, config, ce), own)
        p_ent = model.predicted(trained.entity_final, table.withColumnRenamed("p", "_p")).select("s1_id", "oth_id", F.col("p").alias("p_ent"))
        scored = scored.join(p_ent, ["s1_id", "oth_id"])
    else:
        scored = scored.withColumn("p_ent", F.lit(None).cast("double"))
    return decide.decided(scored, trained.gains, trained.pair_threshold, trained.entity_threshold, config.unseen, trained.countries).select("s1_id", "oth_id", "p", "p_ent")


def baseline(cands: DataFrame, truth: DataFrame, spine: DataFrame, thresholds: list[float]) -> DataFrame:
    """The sweep without a model: one entity for each record by blk_sim (ties by the smaller id)."""
    own = decide.one_owner(cands.select("s1_id", "oth_id", F.col("blk_sim").alias("p")))
    return evaluate.sweep(own, truth, spine, thresholds)


def leave_one_country_out(pairs: DataFrame, truth: DataFrame, spine: DataFrame, names: list[str], config: Config = Config(), grid: list[float] | None = None) -> DataFrame:
    """(country, trained_on, threshold, macro_f05): each country's entities of fold 0, those without candidates
    included, scored by a model of the other countries' pairs and by one of its own fold 1.

    ``pairs``: s1_id, oth_id, label and the features; ``spine``: s1_id, country. Training pairs are those of
    whole entities up to ``config.sample_pairs``."""
    grid = grid or [round(0.60 + 0.05 * i, 2) for i in range(8)]
    d = model.assembled(pairs, names).join(spine, "s1_id").withColumn("fold", decide.fold_of(F.col("s1_id"))).withColumn("label", F.col("label").cast("double"))
    d = written(d.select("s1_id", "oth_id", "country", "fold", "features", "label"))
    s = spine.withColumn("fold", decide.fold_of(F.col("s1_id")))
    todo = []
    for (country,) in sorted(d.select("country").distinct().collect()):  # a handful of countries
        sides = {"others": d.where(F.col("country") != country), "own": d.where((F.col("country") == country) & (F.col("fold") == 1))}
        todo += [(country, name, evaluate.sampled(rows, config.sample_pairs, config.seed)) for name, rows in sides.items()]
    todo = [x for x in todo if len(x[2].select("label").distinct().head(2)) == 2]
    out = None
    for (country, name, _), m in zip(todo, model.fitted([rows for _, _, rows in todo], **_how(config))):
        held = s.where((F.col("country") == country) & (F.col("fold") == 0)).select("s1_id")
        own_truth = truth.join(held, "s1_id", "left_semi")
        target = d.where((F.col("country") == country) & (F.col("fold") == 0))
        one = evaluate.sweep(model.predicted(m, target).select("s1_id", "oth_id", "p"), own_truth, held, grid)
        one = written(one.select(F.lit(country).alias("country"), F.lit(name).alias("trained_on"), "threshold", "macro_f05"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else pairs.sparkSession.createDataFrame([], "country string, trained_on string, threshold double, macro_f05 double")


def unseen_threshold(loco: DataFrame) -> DataFrame:
    """The threshold (one row, with its mean) that is best on average for countries that were not trained on."""
    mean = loco.where("trained_on = 'others'").groupBy("threshold").agg(F.round(F.avg("macro_f05"), 6).alias("macro_f05"))
    return evaluate.best_threshold(mean)


def variants(config: Config = Config()) -> dict[str, list[str]]:
    """Feature lists: all, and without those that depend on the country."""
    return {"all": list(config.features), "portable": [c for c in config.features if c not in config.country_sensitive]}
