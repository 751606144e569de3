import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from kgloom.plans.more_queries import ORACLES, QUERIES


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    if isinstance(v, (list, tuple)):
        return [shown(x) for x in v]
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = sorted(str([shown(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    answer = duck.execute(ORACLES[name])
    names = [c[0] for c in answer.description]
    want = sorted(str([shown(r[names.index(c)]) for c in sorted(names)]) for r in answer.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_hybrid_er_score_scores_all_customers(spark, tmp_path):
    a = [(i, f"Customer#{i:09d}", i % 3) for i in (7, 2999, 3001, 4500, 14999)]
    b = [(i, f"Supplier#{i:09d}", i % 2) for i in (7, 3001, 4500, 14999)] + [(5, "Customer#000014999", 2)]
    spark.createDataFrame(a, "c_custkey long, c_name string, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame(b, "s_suppkey long, s_name string, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))

    def edits(x, y):
        last = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row = [i]
            for j, d in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
            last = row
        return last[-1]

    score = lambda x, y: 0.8 * (1 - edits(x[1], y[1]) / max(len(x[1]), len(y[1]))) + 0.2 * (x[2] == y[2])
    want = sorted((x[0], y[0], round(score(x, y), 6)) for x in a for y in b if x[1][-4:] == y[1][-4:] and score(x, y) >= 0.5)
    got = sorted(tuple(r) for r in QUERIES["hybrid_er_score"](spark, str(tmp_path)).select("left_id", "right_id", "score").collect())
    assert got == want and any(x > 3000 for x, _, _ in want)


def test_evidence_of_odd_texts_as_sql_has_it(spark, tmp_path):
    passage = "a passage of ten words and more that some documents have word for word"
    texts = ["first " + passage, "", "the third text which is longer than forty characters in all", None, " some text behind a hard space ", "some text behind a hard space, once more", "", f"{passage} and an end"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, f"of the same id: {passage}")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, "hard space")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("quote_checks", "overlap_prefix"):
        got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
        assert sorted(got, key=str) == sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=str)
