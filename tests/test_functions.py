import hashlib
import json
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.functions import ids
from kgloom.functions import text as X
from kgloom.functions import vectors as V

NAMES = ["O'Neil", "Acme Corp.", "acme  corp", "Sèvres", "3com", "R&D", "a b c", "", "  Été -- d'or  ", "__x__1", "naïve Ünïon", "日本 Co", "Corp-x 3d", None]


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def identifier(text):
    text = re.sub("[^a-zA-Z0-9_]+", "_", plain(text).strip().replace("&", "_AND_"))
    if text[:1].isdigit():
        text = "_" + text
    return re.sub("_+", "_", text.strip("_")).upper()


def key(text):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", plain(text).lower())).strip()


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", expr(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


@pytest.mark.parametrize("rule, expr", [(identifier, X.sanitize_identifier), (key, X.normalise), (str.title, X.title)])
def test_text_rules(spark, rule, expr):
    assert column(spark, NAMES, expr) == [None if n is None else rule(n) for n in NAMES]


def test_ids(spark):
    values = ["a", 'q"uote', "back\\slash", "line\nfeed\ttab", "\x01\x1f", "é日😀", ""]
    want = lambda ascii_only: [hashlib.sha256(json.dumps({"label": "L", "name": v}, sort_keys=True, ensure_ascii=ascii_only).encode()).hexdigest()[:16] for v in values]
    assert column(spark, values, lambda c: ids.content_id({"name": c, "label": F.lit("L")})) == want(True)
    assert column(spark, values, lambda c: ids.content_id({"name": c, "label": F.lit("L")}, ascii_only=False)) == want(False)
    relation = [hashlib.sha256(json.dumps({"verb": v, "target": "t", "description": v, "doc": "d"}, sort_keys=True).encode()).hexdigest()[:16] for v in values]
    assert column(spark, values, lambda c: ids.relation_node_id(c, F.lit("t"), c, F.lit("d"))) == relation
    chunk = [hashlib.sha256(json.dumps({"document_id": "d", "chunk_index": 3, "chunk_text": v}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16] for v in values]
    assert column(spark, values, lambda c: ids.chunk_id(F.lit("d"), F.lit(3), c)) == chunk


def test_overlap_prefix(spark):
    text = "the quick brown fox jumps"
    quotes = ["quick brown cat", "zebra", "the quick brown fox jumps over", "", "t"]
    want = [max((k for k in range(1, len(q) + 1) if q[:k] in text), default=0) for q in quotes]
    assert column(spark, quotes, lambda c: X.overlap_prefix(F.lit(text), c)) == want
    assert column(spark, ["the"], lambda c: X.overlap_prefix(F.lit("the"), c)) == [0]


def test_scalars(spark):
    assert column(spark, ["a, ,b ,", "", None], X.comma_list) == [["a", "b"], [], None]
    assert column(spark, ["0.4", "7", "-1", "x", None], X.coverage_score) == [0.4, 1.0, 0.0, 0.5, 0.5]
    assert column(spark, ["b/k/x", "b"], lambda c: X.object_path(c)["key"]) == ["k/x", None]


def test_vectors(spark):
    a, b = [1.0, 2.0, 2.0], [2.0, 0.0, 1.0]
    row = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.normalised(F.col("a")).alias("n")).first()
    assert abs(row["c"] - np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-9
    assert abs(np.linalg.norm(row["n"]) - 1) < 1e-9


def test_ids_are_known_not_to_be_null_and_escape_what_json_escapes(spark):

    names = ["plain", 'q"', "b\\", "[x]", "tab\t", "\x00\x1f", "é", "日😀", "", None, "a~ !#"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.entity_id(F.lit("L]"), F.col("n")).alias("id"))
    want = {n: hashlib.sha256(json.dumps({"label": "L]", "name": n or ""}, sort_keys=True).encode()).hexdigest()[:16] for n in names}
    assert {r["n"]: r["id"] for r in df.collect()} == want
    assert not df.schema["id"].nullable
