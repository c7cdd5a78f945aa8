import threading
import unicodedata

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kinweave.functions import fuzzy, text
from kinweave.operators import decide, evaluate, linkage, model
from kinweave.plans.queries import ORACLES, QUERIES
from kinweave.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(ORACLES[name]).fetchdf()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


NAMES = {
    "S.A.S. Dupont & Fils": ("sas dupont and fils", "dupont fils", "dupontfils", "sas", False),
    "Kilb0rn Car1yle LLC": ("kilborn car1yle llc", "kilborn carlyle", "kilborncarlyle", "llc", False),
    "8iomed Inc": ("8iomed inc", "biomed", "biomed", "inc", False),
    "5th Avenue Corp.": ("5th avenue corp", "5th avenue", "5thavenue", "corp", False),
    "Desert Living | www.desertliving.com": ("desert living", "desert living", "desertliving", "", False),
    "desertfreshliving.com": ("desertfreshliving", "desertfreshliving", "desertfreshliving", "", True),
    "Acme dba Zenith Pvt Ltd": ("zenith pvt ltd", "zenith", "zenith", "ltd pvt", False),
    "Acme dba": ("acme dba", "acme dba", "acmedba", "", False),
    "Limited": ("ltd", "ltd", "ltd", "ltd", False),
}
ADDRESSES = {
    ("No. 00380 N Main St, Apt 4, Springfield, IL", "US"): ("380 north main street apartment 4 springfield", "4 380", "il", "us"),
    ("#94, MG Rd, Bangalore, Karnataka", "India"): ("94 mg road bengaluru", "94", "ka", "india"),
    ("N°12 R de la Paix, Paris", "France"): ("12 rue de la paix paris", "12", "", "france"),
    ("PO Box 123, Austin, TX", "usa"): ("austin", "", "tx", "us"),
    ("1 St, Springfield, IL 62701", "US"): ("1 street springfield il 62701", "1 62701", "", "us"),
    ("", "India"): ("", "", "", "india"),
}


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    for r in text.with_name(df).collect():
        assert (r.name_clean, r.name_core, r.name_nospace, r.legal_form, r.is_domain) == NAMES[r["name"]], r["name"]


def test_addresses(spark):
    df = spark.createDataFrame(list(ADDRESSES), "address string, country string")
    for r in text.with_address(df).collect():
        assert (r.addr_core, r.addr_numbers, r.state, r.country_clean) == ADDRESSES[(r.address, r.country)], r.address


def test_kernels():
    assert round(fuzzy.indel("956", "955"), 4) == 0.6667
    assert fuzzy.token_sets("a b", "b a c") == 1 and fuzzy.token_sets("", "a") == 0
    assert fuzzy.partial("abc", "xxabcxx") == 1 and fuzzy.partial("", "") == 1
    assert round(fuzzy.jaro_winkler("martha", "marhta"), 4) == 0.9611


def test_half(spark):
    rows = [(2, 3, 2), (0, 0, 0), (0, 1, 0), (0, 0, 3), (3, 3, 3), (1, 1, 4)]
    df = spark.createDataFrame(rows, "tp long, p long, t long")
    got = [round(r[0], 3) for r in df.select(evaluate.f_half(df.tp, df.p, df.t)).collect()]
    assert got == [0.714, 1, 0, 0, 1, 0.625]


def test_entity_context(spark):
    rows = [("A", "r1", 0.95), ("B", "r1", 0.40), ("A", "r2", 0.60), ("B", "r3", 0.30)]
    c = {r.oth_id: r for r in decide.entity_context(spark.createDataFrame(rows, "s1_id string, oth_id string, p double")).collect()}
    assert (c["r1"].s1_id, c["r1"].pmax, c["r1"].n, c["r1"].p2) == ("A", 0.95, 2, 0.6)
    assert (c["r2"]["rank"], round(c["r2"].gap, 2), round(c["r2"].n_rel, 2), round(c["r3"].n_rel, 2)) == (2, 0.35, 1.2, 0.6)



def test_strip_accents_of_whole_texts(spark, tmp_path):
    long = "Élan vital, ÑANDÚ " * 40
    texts = [None, "", "Die Straße über Köln", "Œuvre et æquo", long, long + "Straße É"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def plain(t):
        marks = (c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
        return "".join(marks)

    got = {r.doc_id: r.folded for r in QUERIES["strip_accents_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else plain(t) for i, t in enumerate(texts)}
    assert got[2] == "die straße uber koln" and got[5].endswith("straße e")


def test_boosted_scores_use_the_operator_defaults(spark, monkeypatch):
    from kinweave.operators import model

    asked = []
    monkeypatch.setattr(model, "cross_fitted", lambda pairs, names, **how: asked.append(how) or (pairs, []))
    QUERIES["gbt_crossfit_scores"](spark, SF)
    assert asked == [{}]


OLD = {"S.A.S. Dupont & Fils": "s a s dupont and fils", "O'Brien-Smith (Pvt) Ltd.": "o'brien smith pvt ltd", "ＡＣＭＥ": "acme", "": ""}


def test_older_cleaner(spark):
    from kinweave.functions import tables

    df = spark.createDataFrame([(n,) for n in [*OLD, None]], "name string")
    got = {r[0]: r[1] for r in df.select("name", text.cleaned_before(df.name)).collect()}
    assert got == {**OLD, None: ""}
    c = spark.createDataFrame([("U.S.A.",), ("United States of America",), ("in",), ("Chile",)], "c string")
    assert [r[0] for r in c.select(text.country_before(c.c)).collect()] == ["us", "us", "india", "chile"]
    n = spark.createDataFrame([("zenith pvt ltd",)], "n string")
    assert n.select(text.expanded_before(n.n, tables.OLD_NAME_WORDS)).first()[0] == "zenith private limited"


def test_transliteration():
    words = {"दिल्ली": "dili", "मुंबई": "mumbai", "कंपनी": "kampani", "राम": "ram", "সংঘ": "sangh", "plain": "plain", "ಕರ್ನಾಟಕ": "karnataka", "दुःख": "duhkh"}
    got = {w: text.romanised(w) for w in words}
    assert got["दिल्ली"] == "dili" and got["plain"] == "plain" and got["राम"] == "ram" and got["ಕರ್ನಾಟಕ"] == "karnataka"
    assert "m" in got["मुंबई"] and got["कंपनी"].startswith("kam") and got["সংঘ"].startswith("san")
    assert text.transliterated("राम (plain)", {"राम": "rama"}) == "rama plain" and text.transliterated("a (b)", {}) == "a (b)"
    assert text.indic_words("a, b(c) d'e") == ["a", "b", "c", "d", "e"] and text.latin_words("Ébène & 2x") == ["ebene", "2x"]


def test_learned_indic_words_are_used(spark):
    from kinweave.operators import linkage

    s1 = spark.createDataFrame([(f"S1-{i}", "Ram Stores", "1 MG Road, Pune", "India") for i in range(3)], "s1_id string, name string, address string, country string")
    oth = spark.createDataFrame([(f"S2-{i}", 2, "राम स्टोर्स", "", "India") for i in range(3)], "oth_id string, src int, name string, address string, country string")
    pairs = oth.selectExpr("name as a", "oth_id").join(s1.selectExpr("name as b", "replace(s1_id, 'S1', 'S2') as oth_id"), "oth_id")
    known = {r.word: r.latin for r in decide.word_dictionary(pairs, indic=True).collect()}
    assert known == {"राम": "ram", "स्टोर्स": "stores"}
    assert {r.name_core for r in linkage.normalised(oth, known).collect()} == {"ram stores"}


def test_runner_up_rule(spark):
    """Similarities come from texts, so the rule is seen in what is kept."""
    from kinweave.operators import blocking

    s1 = spark.createDataFrame([("S1-1", "alpha beta gamma", "one two three"), ("S1-2", "alpha beta gamme", "one two three"), ("S1-3", "zzz yyy", "nine ten")], "s1_id string, name string, address string").selectExpr("*", "'x' as country", "'s' as state")
    oth = spark.createDataFrame([("S2-1", "alpha beta gamma", "one two three"), ("S2-2", "qqqq", "wwww")], "oth_id string, name string, address string").selectExpr("*", "'x' as country", "'s' as state")
    got = sorted((r.s1_id, r.blk_sim, r.blk_second) for r in blocking.candidates(s1, oth).where("oth_id = 'S2-1'").collect())
    assert [g[0] for g in got] == ["S1-1", "S1-2"] and got[0][1] == 1.0 and got[0][2] == got[1][1] == got[1][2] >= 0.8
    assert blocking.candidates(s1, oth).where("oth_id = 'S2-2'").count() == 0


def test_salted_grams_change_nothing(spark, monkeypatch):
    from kinweave.operators import blocking
    from kinweave.plans.queries import _linkage

    s1, oth, _ = _linkage(spark, SF)
    want = sorted(map(tuple, blocking.candidates(s1, oth).collect()))
    monkeypatch.setattr(blocking, "SALTED", 7)
    assert sorted(map(tuple, blocking.candidates(s1, oth).collect())) == want


def test_vectorised_kernels_against_plain_ones():
    import random

    random.seed(3)
    some = ["".join(random.choice("ab cé") for _ in range(random.randrange(0, 90))).strip() for _ in range(160)]
    a, b = some[:80], some[80:]

    def plain(x, y):
        return 2 * fuzzy.lcs(x, y) / (len(x) + len(y)) if x or y else 1.0

    def window(x, y):
        if not x or not y:
            return float(not x and not y)
        sides = [(x, y) if len(x) <= len(y) else (y, x)] + [(y, x)] * (len(x) == len(y))
        return max(plain(s, t[max(0, k) : k + len(s)]) for s, t in sides for k in range(1 - len(s), len(t)))

    assert fuzzy.indel_many(a, b).tolist() == [plain(x, y) for x, y in zip(a, b)]
    assert fuzzy.partial_many(a[:25], b[:25]).tolist() == [window(x, y) for x, y in zip(a[:25], b[:25])]
    assert fuzzy.sorted_many(["b a"], ["a b"]).tolist() == [1.0] and fuzzy.sets_many(["a b c"], ["b c d"])[0] > 0.5


def test_files(spark, tmp_path):
    import zipfile

    from kinweave.sources import files

    with zipfile.ZipFile(tmp_path / "raw.zip", "w") as z:
        z.writestr("in/train_source1.tsv", 'entity_id\tbusiness_name\tbusiness_address\tcountry\n1\t"A" Ltd\t\tUS\n')
        z.writestr("__MACOSX/in/train_source1.tsv", "no")
        z.writestr("in/readme.txt", "no")
    root = str(tmp_path / "raw")
    assert len(files.extract_zip(str(tmp_path / "raw.zip"), root)) == 1
    found = files.raw_files(spark, root, ["train_source1"])
    row = files.read_tsv(spark, found["train_source1"]).first()
    assert (row.business_name, row.business_address) == ('"A" Ltd', "")
    with pytest.raises(FileNotFoundError):
        files.raw_files(spark, root, ["test_source1"])
    assert files.artefact(spark, [f"{root}/none", root], "train_source1.tsv").endswith("in/train_source1.tsv")
    assert files.artefact(spark, [root], "none.tsv", required=False) is None
    spine = spark.createDataFrame([("S1-2",), ("S1-1",)], "s1_id string")
    pairs = spark.createDataFrame([("S1-1", "S2-9"), ("S1-1", "S2-10")], "s1_id string, oth_id string")
    out = files.listed(spine, pairs)
    files.write_one_tsv(out, f"{root}/out", "source1_entity_id")
    assert len([f for f in files.listing(spark, f"{root}/out") if "part-" in f]) == 1
    back = files.read_tsv(spark, f"{root}/out", files.TRUTH)
    assert sorted(map(tuple, back.collect())) == [("S1-1", "S2-10,S2-9"), ("S1-2", "")]
    assert files.header_problem(spark, f"{root}/out") == "" and "wanted" in files.header_problem(spark, f"{root}/out", files.RAW)
    files.copied(spark, f"{root}/out", f"{root}/copy")
    assert files.read_tsv(spark, f"{root}/copy", files.TRUTH).count() == 2
    truth = pairs.where("oth_id = 'S2-9'")
    assert evaluate.macro(files.exploded(back), truth, spine).first().macro_f05 == round((1.25 * 0.5 / (0.125 + 1) + 1) / 2, 6)
    files.write_tsv(out, f"{root}/many")
    files.write_parquet(out, f"{root}/p")
    assert files.read_parquet(spark, f"{root}/p", "source1_entity_id").columns == ["source1_entity_id"]
    files.write_report({"é": 1}, f"{root}/r.json")
    assert "é" in open(f"{root}/r.json", encoding="utf-8").read()
    clean = spark.createDataFrame([("1", "a", ""), ("1", "", None)], "entity_id string, name_core string, state string")
    got = {r.problem: r.n for r in files.integrity(clean, clean.limit(1), pairs).collect()}
    assert got == {"missing_rows": 1, "repeated_ids": 1, "nulls": 1, "empty_names": 1, "unknown_in_truth": 2}


def test_scores_and_thresholds(spark):
    from kinweave.operators import model

    s = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.9, 1)], "p double, label int")
    assert model.auc(s).first().auc == 0.875 and model.auc(s.where("label = 1")).first().auc is None
    sweep = spark.createDataFrame([(0.5, 0.7), (0.6, 0.9), (0.7, 0.9)], "threshold double, macro_f05 double")
    assert evaluate.best_threshold(sweep).first().threshold == 0.7
    texts = spark.createDataFrame([("a", "b", "long text", "x"), ("c", "d", "s", "y")], "s1_id string, oth_id string, text_a string, text_b string")
    ce = model.rescored(texts, lambda x, y: x.str.len() / 10)
    assert {(r.s1_id, r.ce) for r in ce.collect()} == {("a", 0.9), ("c", 0.1)}
    pairs = spark.createDataFrame([("a", "b", 0.5), ("e", "f", 0.5)], "s1_id string, oth_id string, p double")
    assert {r.ce for r in decide.with_second_score(pairs, ce).collect()} == {0.9, None} and {r.ce for r in decide.with_second_score(pairs, None).collect()} == {None}


def test_decisions(spark):
    rows = [("A", "r1", 0.9, 0.2, "us"), ("B", "r1", 0.8, 0.9, "us"), ("C", "r2", 0.75, 0.75, "fr")]
    s = spark.createDataFrame(rows, "s1_id string, oth_id string, p double, p_ent double, country string")
    seen = s.where("country = 'us'").select("country")
    of = lambda df: {(r.s1_id, r.oth_id) for r in df.collect()}
    assert of(decide.decided(s, False, 0.7, 0.5)) == {("A", "r1"), ("C", "r2")}
    assert of(decide.decided(s, True, 0.7, 0.5)) == {("B", "r1"), ("C", "r2")}
    assert of(decide.decided(s, True, 0.7, 0.5, 0.8, seen)) == {("B", "r1")}


def test_samples_of_whole_entities(spark):
    pairs = spark.createDataFrame([(f"S1-{i % 50}", f"S2-{i}") for i in range(400)], "s1_id string, oth_id string")
    got = evaluate.sampled(pairs, 100)
    assert got.count() == 96 and {r[1] for r in got.groupBy("s1_id").count().collect()} == {8}
    assert evaluate.sampled(pairs, 10**6).count() == 400 and evaluate.sampled(pairs, 3).count() == 0


def test_learned_linkage_end_to_end(spark, tmp_path):
    from kinweave.config import Config
    from kinweave.operators import features, linkage, model
    from kinweave.plans.queries import _linkage

    s1, oth, truth = _linkage(spark, SF)
    config = Config(rounds=2, depth=3, city_votes=5, city_purity=0.4, models=f"{tmp_path}/models")
    trained = linkage.train(spark, s1, oth, truth, config)
    links = linkage.linked(trained, s1, oth, config)
    assert evaluate.macro(links, truth, s1).first().macro_f05 > 0.8
    gain = model.importance(spark, trained.pair_models, list(config.features))
    assert gain.count() == len(features.FEATURES) and abs(gain.agg({"gain": "sum"}).first()[0] - 1) < 1e-6
    known = model.load(spark, list(config.features), config.models)
    assert [m.treeWeights for m in known] == [m.treeWeights for m in trained.pair_models]
    with pytest.raises(ValueError):
        model.load(spark, ["blk_sim"], config.models)
    assert model.load(spark, ["blk_sim"], f"{tmp_path}/none") is None
    trained.gains = True
    assert linkage.linked(trained, s1, oth, config).where("p_ent is null").count() == 0
    assert set(linkage.variants(config)["all"]) - set(linkage.variants(config)["portable"]) == set(config.country_sensitive)


def test_leave_one_country_out(spark):
    from kinweave.config import Config
    from kinweave.operators import linkage

    rows = [(f"S1-{i}", f"S2-{i}-{k}", "uf"[i % 2], k == 0, 0.9 if k == 0 else 0.1 + 0.01 * (i % 7)) for i in range(120) for k in range(2)]
    pairs = spark.createDataFrame([(a, b, int(y), x) for a, b, _, y, x in rows], "s1_id string, oth_id string, label int, blk_sim double")
    spine = spark.createDataFrame(sorted({(a, c) for a, _, c, _, _ in rows} | {("S1-alone", "u")}), "s1_id string, country string")
    truth = pairs.where("label = 1").select("s1_id", "oth_id")
    got = linkage.leave_one_country_out(pairs, truth, spine, ["blk_sim"], Config(rounds=2, depth=2), [0.6, 0.7])
    assert {(r.country, r.trained_on) for r in got.collect()} == {(c, t) for c in "uf" for t in ("others", "own")}
    assert linkage.unseen_threshold(got).first().macro_f05 > 0.9


def test_streaming_linker(spark, tmp_path):
    from kinweave.plans.queries import _linkage
    from kinweave.streaming.linker import link_stream

    s1, oth, truth = _linkage(spark, SF)
    oth.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(oth.schema).parquet(f"{tmp_path}/in")
    q = link_stream(stream, s1, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    q.processAllAvailable()
    q.stop()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.select("oth_id").distinct().count() > 50 and out.join(truth, ["s1_id", "oth_id"]).count() > 50


def test_blocking_sends_no_products(spark, tmp_path):
    """1,200 masters and 800 records share grams: before, each pair of shared grams was a row that went through an exchange."""
    from kinweave.operators import blocking
    from kinweave.sources import adapters

    spark.createDataFrame([(i, f"alpha beta gamma delta one two street {i} road", "en") for i in range(1200)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    s1 = adapters.masters(spark, str(tmp_path))
    tracker = spark._jsc.sc().statusStore()
    sent = lambda: sum(s.shuffleWriteRecords() for s in _stages(spark, tracker))
    before = sent()
    assert blocking.candidates(s1, adapters.copies(s1)).count() >= 800
    assert sent() - before < 100_000


def _stages(spark, store):
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


def test_rare_words_look_names_up(spark):
    """Repeats, unknown words, names without words and null ones."""
    from kinweave.operators import features

    idf = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "word string, idf double")
    p = spark.createDataFrame([("1", "x", "a a b", "b c"), ("2", "x", "", "a"), ("3", "x", "", ""), ("4", "x", "a", None)], "s1_id string, oth_id string, name_core_1 string, name_core_2 string")
    got = {r.s1_id: (r.rw1_max, r.rw1_sum, r.rw2_max, r.rw2_sum, r.rw1_share) for r in features.rare_words(p, idf).collect()}
    assert got == {"1": (0.5, 0.5, 1.0, 1.0, 0.4), "2": (0.0, 0.0, 0.5, 0.5, 0.0)}


def test_trigram_kernel_is_the_expression(spark):
    from pyspark.sql import functions as F

    from kinweave.operators import features

    p = spark.createDataFrame([("abc abd", "ABC x"), ("", ""), ("a", "a"), ("é ab", "ab  é"), ("aaaa", "aaa")], "a string, b string")
    rows = p.select(features.trigram_cosine(F.col("a"), F.col("b")).alias("x"), fuzzy.kernels()["trigram"](F.lower("a"), F.lower("b")).alias("y")).collect()
    assert all(abs(r.x - r.y) < 1e-12 for r in rows)


def test_submission_problems_read_lists_once(spark, monkeypatch):
    """Repeats within a list, across the rows of an entity and unknown ids; blanks count for nothing. Lists neither go
    through an exchange nor are taken apart by the plan."""
    known = [f"S2-{i}" for i in range(40)]
    rows = [("a", ",".join(known)), ("b", ",".join([*known[10:], "S2-17", "S2-17", "S9-7"])), ("c", "S2-7,,S2-7,"), ("c", "S2-7"), ("d", ""), ("d", None), ("z", "S9-1")]
    result = spark.createDataFrame(rows, "source1_entity_id string, matched_entity_ids string")
    spine = spark.createDataFrame([(x,) for x in "abcde"], "s1_id string")
    found = files.problems(result, spine, spark.createDataFrame([(x,) for x in known], "oth_id string"))
    assert {r.problem: r.n for r in found.collect()} == {"repeated_entities": 2, "missing_entities": 1, "unknown_entities": 1, "repeated_ids": 4, "unknown_ids": 2}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode") <= 1 and "rightHint=(strategy=broadcast)" in plan
    monkeypatch.setattr(files, "TALLIED", 3)
    told = [t for b in files._tallied([pa.RecordBatch.from_arrays([pa.array([ids for _, ids in rows], pa.string())], ["ids"])]) for t in b.to_pylist()]
    count = lambda x: sum(t["n"] for t in told if t["oth_id"] == x)
    assert len([t for t in told if t["oth_id"] is None]) > 1 and (count(None), count("S2-7"), count("S2-17"), count("S2-39"), count("S9-7")) == (3, 4, 4, 2, 1)


def test_models_are_fitted_at_the_same_time(spark, monkeypatch):
    """Both folds wait for each other: before, the first fit had to end before the second began."""
    both = threading.Barrier(2, timeout=20)
    monkeypatch.setattr(model, "fit", lambda t, **how: (both.wait(), t.count())[1])
    assert model.fitted([spark.range(3), spark.range(5)]) == [3, 5]


def test_records_learned_from_are_not_made_again(spark, monkeypatch):
    a = spark.createDataFrame([("m", "en")], "s1_id string, country_clean string")
    b, pairs = spark.createDataFrame([("o",)], "oth_id string"), spark.createDataFrame([("m", "o", 0.75)], "s1_id string, oth_id string, p double")
    monkeypatch.setattr(model, "ensemble", lambda models, df, names: df)
    trained = linkage.Trained([], [], None, 0.5, 0.5, False, a.select(F.col("country_clean").alias("country")), learned=(a, b, pairs))
    assert [tuple(r) for r in linkage.linked(trained, None, None).collect()] == [("m", "o", 0.75, None)]
