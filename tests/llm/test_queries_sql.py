"""Queries of this subpackage against their SQL."""

import glob
import math
import os

import duckdb
import pytest

from kgloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    shown = lambda v: f"{v:.8g}" if isinstance(v, float) and not math.isnan(v) else v
    got = sorted(str([shown(r[c]) for c in names]) for r in df.collect())
    answer = con.execute(ORACLES[name])
    at = {c[0]: i for i, c in enumerate(answer.description)}
    assert sorted(at) == names
    assert got == sorted(str([shown(r[at[c]]) for c in names]) for r in answer.fetchall())
