"""Nulls, clashing columns, empty tables, very many spans, and the pipeline against a plain version."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from kinweave.llm import chat, html, minhash, mixing, pii, repeats, tiling, toxicity, vectors

WORDS = [f"w{i}" for i in range(400)]
#: Names that the operators use themselves.
CLASH = ["node", "component", "kept", "minima", "set_a", "_spans", "_text", "_items", "_best", "_score", "_key", "_hash", "_id", "size", "taken", "target", "row", "rows", "key", "band", "_a", "_b", "a", "b", "_digit", "_base", "_more", "_m", "_g", "_i", "_back", "half"]


def clashing(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(i, t, None, s, None, *["x"] * len(CLASH)) for i, t, s in rows], schema)


ROWS = [(1, None, None), (2, "", "a"), (3, " \n ", "b"), (4, "one two", "a"), (4, "one two", "a"), (5, "one two", None), (None, "a@b.org", None), (None, None, None), (6, "0 " * 30000, "b"), (7, "é" * 30000, "b")]


def test_clashing_columns(spark):
    d = clashing(spark, ROWS)
    labels = spark.createDataFrame([(4, 1, 1, 0.5), (None, None, None, None)], "doc_id long, quality int, toxic int, _score double")
    b = spark.createDataFrame([(1, None, "x"), (None, "a b c d e f", "x")], "item_id long, text string, _items string")
    for got in (mixing.mix(d), minhash.near_duplicates(d), tiling.tile(d, b), pii.find(d), toxicity.toxicity(d, labels), repeats.repeats(d)):
        assert got.count() == len(ROWS)
    kept = minhash.representatives(d)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "7", "None", "None"]


def test_stages_keep_columns(spark):
    d = clashing(spark, ROWS)
    labels = spark.createDataFrame([(4, 1, 1)], "doc_id long, quality int, toxic int")
    b = spark.createDataFrame([(1, "no such words are in any text")], "item_id long, text string")
    for got in (toxicity.accepted(d, labels), tiling.clean(d, b), pii.redacted(d), minhash.representatives(d)):
        assert got.columns == d.columns
    assert {r.text for r in pii.redacted(d).where("doc_id is null").collect()} == {None, "<email>"}


def test_empty_tables(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_events(chat.messages_as_events(turns))).count() == 0
    d = clashing(spark, [])
    labels, b = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    for got in (toxicity.accepted(d, labels), tiling.clean(d, b), minhash.representatives(d), pii.redacted(d)):
        assert got.count() == 0


def test_nulls_and_repeated_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0]), (3, [None, 1.0]), (4, [])], "vec_id long, embedding array<float>")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in vectors.near_vectors(v).collect())
    assert got == [("1", 2, "1", True)] * 2 + [("2", 2, "1", False), ("3", 0, "3", True), ("4", 0, "4", True), ("None", 0, "None", True)]
    page = "<article><p>a &lt; b</p></article>"
    p = spark.createDataFrame([(1, None, page), (1, None, page), (None, "http://h.org/", ""), (2, "not a url", None)], "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html.extract(p).collect()) == [("1", "a < b", 5)] * 2 + [("2", "", 0), ("None", "", 0)]
    c = spark.createDataFrame([(1, 0, "assistant", None), (1, None, None, "x"), (None, 0, "user", "y")], "conv_id long, turn long, role string, text string")
    out = {str(r.conv_id): (r.n_turns, r.loss_chars) for r in chat.digests(chat.format_events(chat.messages_as_events(c))).collect()}
    assert out == {"1": (2, 0), "None": (1, 0)}


def test_added_spans_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i, n in enumerate([0, 1, 5, 60, 900] * 4):
        base, at = [], 0
        for _ in range(n // 3):
            p = at + int(rng.integers(0, 30))
            at = p + int(rng.integers(1, 20))
            base.append((int(rng.integers(0, 4)), p, at, True, True, 0, 0, 0, 0, 0))
        more = [(int(rng.integers(0, 4)), p := int(rng.integers(0, at + 50)), p + int(rng.integers(1, 25)), False, bool(rng.random() < 0.9), 0, 0, 0, 0, 0) for _ in range(n)]
        rows.append((i, base + more))
    kind = "doc_id long, _spans array<struct<kind:int,pos:int,end:int,base:boolean,sound:boolean,form:int,before:int,after:int,length:int,cue:int>>"
    got = {r.doc_id: [tuple(s) for s in r._spans] for r in pii.selected(spark.createDataFrame(rows, kind), ([], [-1.0] * 4)).collect()}
    added = 0
    for i, spans in rows:
        base = [(p, k, e, True) for k, p, e, b, *_ in spans if b]
        kept, at = [], 0
        for p, e, k in sorted((p, -e, k) for k, p, e, b, ok, *_ in spans if not b and ok):
            if p >= at and all(q >= -e or p >= f for q, _, f, _ in base):
                kept.append((p, k, -e, False))
                at = -e
        added += len(kept)
        assert got[i] == sorted(base + kept)
    assert added > 100


def test_very_many_spans(spark):
    d = clashing(spark, [(1, "1.2.3.4 " * 3000 + "a@b.org", None)])
    r = pii.find(d).first()
    assert (r.n_ip, r.n_email) == (3000, 1) and r.spans.endswith("ip:23992:23999,email:24000:24007")
    assert pii.redacted(d).first().text == "<ip> " * 3000 + "<email>"


def test_pipeline_against_plain_version(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    item = " ".join(f"q{i}" for i in range(40))
    texts = [" ".join(rng.choice(WORDS, int(rng.integers(30, 60)))) + (" idiot moron" if i % 4 == 0 else "") for i in range(400)]
    texts += [texts[j] for j in range(1, 80, 2)]
    texts += [texts[j].replace(" ", "\n", 3).upper() + " tail" for j in range(101, 140, 2)]
    texts += [" ".join(rng.choice(WORDS, 20)) + " " + item + " " + " ".join(rng.choice(WORDS, 20)) for _ in range(5)]
    texts += [" ".join(rng.choice(WORDS, 30)) + f" mail me{i}@site.org now" for i in range(5)]
    rows = [(i, t, "en", (None, "a", "b")[i % 3], len(t)) for i, t in enumerate(texts)]
    columns = dict(zip(("doc_id", "text", "lang", "source", "n_chars"), zip(*rows)))
    pq.write_table(pa.table({k: list(v) for k, v in columns.items()}), tmp_path / "documents.parquet")
    marks = list(range(400))
    pq.write_table(pa.table({"doc_id": marks, "quality": [1] * 400, "toxic": [int(i % 4 == 0) for i in marks]}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [item]}), tmp_path / "benchmark.parquet")

    left = {i: t for i, t, *_ in rows if "idiot" not in t.lower()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in left.items() for w in [t.lower().split()]}
    holders: dict = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, set()).add(i)
    seen, kept = set(), {}
    for i in sorted(left):
        if i in seen:
            continue
        kept[i], open_ = left[i], [i]
        while open_:
            a = open_.pop()
            seen.add(a)
            near = set().union(*(holders[x] for x in sets[a])) - seen
            open_ += [b for b in near if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    clean = {i: t for i, t in kept.items() if item not in t}
    plain = {i: " ".join("<email>" if "@" in w else w for w in t.split(" ")) for i, t in clean.items()}
    documents = pa.table({"doc_id": list(plain), "text": list(plain.values()), "source": [rows[i][3] for i in plain]})
    assert documents.num_rows < len(rows)
    c = duckdb.connect()
    c.register("documents", documents)
    want = {r[0]: r[1:] for r in c.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE}) WHERE taken > 0").fetchall()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: (r["size"], r.source_size, r.target, r.taken) for i, r in got.items()} == want
    assert all(r.text == plain[i] for i, r in got.items()) and any("<email>" in r.text for r in got.values())


def test_extra_columns_of_conversations_and_trees(spark):
    from kinweave.llm import tokens

    names = ["kind", "seq", "target", "way", "part", "event", "copy", "segments", "n_tokens", "before", "tree"]
    extra = [f"'x' as {c}" for c in names]
    c = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, None, None, None)], "conv_id long, turn long, role string, text string").selectExpr("*", *extra)
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(chat.format_events(chat.logged(c))).collect()}
    assert got == {1: (2, 1), None: (1, 0)}
    d = spark.createDataFrame([(1, "two words"), (1, "two words"), (None, None)], "doc_id long, text string")
    e = d.withColumn("edits", tokens.sample_edit(d["text"])).selectExpr("*", *extra)
    rows = tokens.token_counts(e, "/opt/tokenizers/byte_bpe_50k.tiktoken").collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_segments) for r in rows) == [("1", 2, 1)] * 2 + [("None", 0, 0)]


def test_html_without_an_end():
    read = lambda page: html.blocks(html.measured(html.parse(page)))
    pages = {"<p>a</p> tail < b": "a\ntail < b", "a <!-- open <p>no</p> x": "a", "<p>x</p><!-- > y": "x", "a < b > c": "a < b > c", "<p title='a>b'>c</p>": "c"}
    assert {p: read(p) for p in pages} == pages
    assert read("<a " * 200_000) == ("<a " * 200_000).strip()
