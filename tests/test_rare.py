"""Rare words of all pairs within a block: against plain counts for names of any length, and without a row for each pair
in a join of the plan."""

import pyarrow as pa
import pytest

from kinweave.operators import rare
from kinweave.plans.queries import QUERIES

IDF = {f"w{i}": (i * 37 % 101) / 101 for i in range(60)} | {"": 0.0, "common": 0.0, "unknown": 1.0}
LISTS = pa.list_(pa.struct([("word", pa.string()), ("idf", pa.float64())]))


def _lists(names):
    return pa.array([[{"word": w, "idf": IDF[w]} for w in n] for n in names], LISTS)


def _plain(a, b):
    one, two = ([IDF[w] for w in set(x) - set(y)] for x, y in ((a, b), (b, a)))
    return [max(one, default=0), sum(one), max(two, default=0), sum(two), sum(one) / max(sum(IDF[w] for w in a), 1e-6)]


@pytest.mark.parametrize("long", [0, 9, 40])
def test_pairs_are_those_of_plain_counts(monkeypatch, long):
    """repeats, names without words, words of no weight, and names of more words than a code has bits."""
    word = lambda i: f"w{i * i % 60}"
    a = [[], ["common"], ["common", "common"], ["w1", "w1", "w2"], *([word(i + j * j) for j in range(i % 7)] for i in range(40)), [f"w{i}" for i in range(long)]]
    b = [["unknown"], [], *([word(2 * i + j) for j in range(i % 8)] + ["common"] * (i % 2) for i in range(50)), [f"w{i}" for i in range(0, long, 2)]]
    monkeypatch.setattr(rare, "WIDE", 13)
    monkeypatch.setattr(rare, "TOGETHER", 100)
    x, y = rare.names_of(_lists([["w5"], *a])[1:], _lists(b))
    seen = set()
    for rows, cols, found in rare.compared(x, y):
        for i in range(rows.start, rows.stop):
            for j in range(cols.start, cols.stop):
                seen.add((i, j))
                assert [f[i - rows.start, j - cols.start] for f in found] == pytest.approx(_plain(a[i], b[j]), abs=1e-6)
    assert len(seen) == len(a) * len(b)


def test_large_blocks_match_their_parts(spark, tmp_path, monkeypatch):
    """a block cut into many parts loses and repeats no pair, and no join makes a row for each pair (before: one did)."""
    rows = [(i, f"alpha {i % 5} street {i % 7} x y z", "en") for i in range(300)] + [(900, "", "en"), (901, "", "fr"), (902, "zz", None)]
    rows = [(i, t + " tail" * (i % 3) + f" {i}" * (t != ""), c) for i, t, c in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = sorted(map(tuple, QUERIES["rare_word_features"](spark, str(tmp_path)).collect()))
    for name, n in (("LEFT", 40), ("RIGHT", 30), ("WIDE", 7), ("TOGETHER", 64)):
        monkeypatch.setattr(rare, name, n)
    cut = QUERIES["rare_word_features"](spark, str(tmp_path))
    assert sorted(map(tuple, cut.collect())) == whole and len({r[:2] for r in whole}) == len(whole) == 300 * 200 + 1
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan.split("FlatMapCoGroupsInArrow")[0] and "FlatMapCoGroupsInArrow" in plan
