"""House numbers of all pairs within a block: against SQL on odd tables, and without a row for each pair in the plan."""

import duckdb
import pytest

from kinweave.operators import numbers
from kinweave.plans.queries import ORACLES, QUERIES


def _plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_match_a_plain_table():
    a, b = ["", "7", "10", "10023", "999999", "1" * 70, "-5"], ["1", "", "01", "10032", "99", "2" * 60 + "1" * 70, "5"]
    assert numbers.edits(a, b).tolist() == [[_plain(x, y) for y in b] for x in a]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Keys of one to nine digits, among them such as are their own second number, small and large differences, repeated
    rows, rows without a nation and nations of one side only."""
    d = str(tmp_path_factory.mktemp("numbers"))
    keys = [*range(-12, 60), 1001, 10014, *range(10000, 10100, 3), *range(9000, 11000, 7), 999999, 123456789]
    nation = lambda k: None if k % 11 == 5 else k % 3
    spark.createDataFrame([(k, nation(k)) for k in [*keys, *range(20, 30)]] + [(1, 7)], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(k, nation(k + 1)) for k in [*keys[::2], 3, 3]] + [(2, 8)], "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{d}/supplier.parquet")
    return d


def test_number_features_match_sql(spark, odd):
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"create view {t} as select * from read_parquet('{odd}/{t}.parquet/*.parquet')")
    got, want = QUERIES["number_features"](spark, odd), con.execute(ORACLES["number_features"]).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want) and len(want) > 10_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan and "lambda" not in plan  # before: cross products of each pair's lists, one by one
