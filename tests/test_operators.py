import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.config import DomainConfig
from kgloom.operators import chunking, clustering, events, ontology, relations, resolution, retrieval, scans, validation
from kgloom.plans import pipeline
from kgloom.sources import documents as sources
from kgloom.sources import graph_store as store
from kgloom.sources.graph_store import ParquetGraph


def texts():
    rng = random.Random(4)
    yield from ["", "   ", "One. Two! Three?  Four", "No end", "x" * 500 + " y. " + "z" * 90, "A.B. C", "a.  b"]
    for _ in range(60):
        yield "".join(rng.choice(["word ", "longer-word ", "stop. ", "why? ", "\n", "x" * 40]) for _ in range(rng.randint(1, 120)))


@pytest.mark.parametrize("budget, overlap", [(10, 3), (40, 10), (5, 50)])
def test_chunks_cover_texts(budget, overlap):
    for text in texts():
        parts = chunking.split_sentences(text)
        assert "".join(parts) == text
        found = chunking.chunk_text(text, budget, overlap)
        if not text.strip():
            assert found == []
            continue
        assert found[0][0] == 0 and found[-1][1] == len(text)
        for (a, b, k), (c, d, _) in zip(found, found[1:]):
            assert a < c <= b <= d
        for s in parts:
            assert "".join(chunking.hard_split(s, budget, chunking.quarter_characters)) == s


def test_chunk_rows(spark):
    rows = [(str(i), t) for i, t in enumerate(texts())] + [("none", None)]
    docs = spark.createDataFrame(rows, "document_id string, text string")
    for r in chunking.chunks(docs, 20, 5).join(docs.withColumnRenamed("text", "whole"), "document_id").collect():
        assert r["whole"][r["start_char"] : r["end_char"]] == r["text"]
    got = chunking.sentences(docs).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["idx"]):
        by.setdefault(r["document_id"], []).append(r["sentence"])
    assert by == {d: chunking.split_sentences(t) for d, t in rows if t and t.strip()}


def test_average_linkage_stays_in_components(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    points = np.repeat(centres, 7, axis=0) + rng.normal(scale=0.35, size=(42, 8))
    rows = [(f"{i:03d}", p.tolist()) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    whole = clustering.average_linkage(points, 0.2)
    got = {r["id"]: r["cluster"] for r in clustering.clustering_strategy("agglomerative", distance=0.2).fit(df).collect()}
    want = {f"{i:03d}": min(f"{j:03d}" for j in range(42) if whole[j] == whole[i]) for i in range(42)}
    assert got == want
    with pytest.raises(ValueError):
        clustering.clustering_strategy("other")
    dense = {r["id"]: r["cluster"] for r in clustering.Density(0.2, size=8).fit(df).collect()}
    assert set(dense) == set(got)
    assert clustering.Density(0.2, drop_noise=True).fit(df).count() <= 42


def test_likely_pairs_are_most_close_pairs(spark):
    rng = np.random.default_rng(9)
    points = np.repeat(rng.normal(size=(40, 32)), 3, axis=0) + rng.normal(scale=0.12, size=(120, 32))
    df = spark.createDataFrame([(f"{i:03d}", p.tolist()) for i, p in enumerate(points)], "id string, embedding array<double>")
    exact = {(r["a"], r["b"]) for r in clustering.close_pairs(df, 0.9).collect()}
    likely = {(r["a"], r["b"]) for r in clustering.likely_pairs(df, 0.9).collect()}
    assert likely <= exact and len(likely) >= 0.9 * len(exact) > 0


def test_connected(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in clustering.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert clustering.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_graph_is_idempotent(spark, tmp_path):
    graph = ParquetGraph(spark, str(tmp_path / "g"))
    nodes = spark.createDataFrame([("a", "E", ["E"], {"x": "1"}), ("b", "E", ["E"], {"x": "2"})], "id string, kind string, labels array<string>, properties map<string,string>")
    edges = spark.createDataFrame([("a", "b", "R", {"w": "1"}), ("a", "zz", "R", {})], "source_id string, target_id string, relation_type string, properties map<string,string>")
    for _ in range(2):
        graph.export(nodes, edges)
        n, e = graph.read()
        assert (n.count(), e.count()) == (2, 1)
    later = spark.createDataFrame([("a", "E", ["E", "F"], {"y": "3"})], nodes.schema)
    graph.export(later, edges.limit(0))
    row = graph.read()[0].where("id = 'a'").first()
    assert row["properties"] == {"x": "1", "y": "3"} and row["labels"] == ["E", "F"]
    # In one batch the later row wins, whatever its value, and so it stays through compactions.
    twice = spark.createDataFrame([("a", "E", ["E"], {"x": "9"}, 1), ("a", "E", ["E"], {"x": "4"}, 2)], "id string, kind string, labels array<string>, properties map<string,string>, at int")
    graph.export(twice, edges.limit(0), F.col("at"))
    assert graph.read()[0].where("id = 'a'").first()["properties"]["x"] == "4"
    graph.compact()
    graph.export(spark.createDataFrame([("c", "E", ["E"], {})], nodes.schema), edges.where("false").unionByName(spark.createDataFrame([("c", "a", "R", {}), ("c", "zz", "R", {})], edges.schema)))
    n, e = graph.read()
    assert n.where("id = 'a'").first()["properties"] == {"x": "4", "y": "3"} and (n.count(), e.count()) == (3, 2)
    assert tuple(graph.uploaded(nodes, edges).first()) == (2, 2, 2, 1)
    short = ParquetGraph(spark, str(tmp_path / "s"), keep=1)
    for i in range(4):
        short.export(spark.createDataFrame([("a", "E", ["E"], {"x": str(i)})], nodes.schema), edges.limit(0))
    assert short.read()[0].first()["properties"] == {"x": "3"} and len(short._numbers("done")) <= 2
    graph.clear()
    assert graph.read()[0].count() == 0


def test_resolution_prefers_known(spark):
    rows = [("r1", 0, "agent", 0, "Org", "Acme Corp.", "d", 0.9), ("r2", 0, "agent", 0, "Org", "acme  corp", "d", 0.4), ("r3", 0, "agent", 0, "Org", "Other", "d", 0.4)]
    fillers = spark.createDataFrame(rows, "relation_id string, role_group int, role string, pos int, label string, name string, definition string, confidence double")
    known = spark.createDataFrame([("Org", "ACME CORP", ""), ("Org", "", "x")], "label string, name string, definition string")
    m = resolution.entity_mentions(fillers).unionByName(resolution.known_mentions(known))
    clusters = m.select("norm_key", F.col("norm_key").alias("cluster")).distinct()
    chosen = resolution.canonical(m, clusters)
    row = chosen.where("cluster like '%acme%'").first()
    assert row["canonical_name"] == "ACME CORP" and row["aliases"] == ["Acme Corp.", "acme  corp"] and row["canonical_source"] == "graph"
    done = resolution.resolved(m, clusters, chosen)
    again = resolution.resolved(m, clusters, chosen, spark.createDataFrame([(row["cluster"],)], "cluster string"))
    assert {r["resolved_name"] for r in done.collect()} == {"ACME CORP", "Other"}
    assert {r["name"] for r in again.where("resolved_name <> name").collect()} == set()


def test_decisions_in_order(spark):
    current = spark.createDataFrame([("entity", "a", "old", True), ("entity", "b", "old", True)], "kind string, label string, definition string, is_seed boolean")
    log = [(1, "accept", "entity", "c", "", "why"), (2, "reject", "entity", "a", "", ""), (3, "accept", "entity", "d", "x", ""), (4, "reject", "entity", "d", "", ""), (5, "comment", "entity", "b", "", ""), (6, "accept", "entity", "b", "new", "")]
    decisions = spark.createDataFrame(log, "seq long, action string, kind string, label string, definition string, reasoning string")
    got = {(r["label"], r["definition"], r["is_seed"]) for r in ontology.accepted_types(current, decisions).collect()}
    assert got == {("c", "why", False), ("b", "new", False)}


def test_routes_and_scans():
    config = DomainConfig()
    assert [pipeline.route(h, d, config) for h, d in ((False, 0), (True, 49), (True, 50))] == ["full", "fast", "full"]
    tight = np.array([[1, 0.01 * i] for i in range(5)] + [[0.01 * i, 1] for i in range(5)])
    assert scans.silhouette(tight, np.repeat([0, 1], 5)) > 0.9
    values = iter([0.1, 0.5, 0.505, 0.9])
    assert scans.improved([lambda: next(values)] * 4) == 2


def test_sources(spark, sf, tmp_path):
    docs = sources.from_rows(spark, [("a", "text", {"k": "v"})])
    assert docs.first()["metadata"] == {"k": "v"}
    assert sources.from_parquet(spark, f"{sf}/documents.parquet", metadata=("lang",)).first()["metadata"].keys() == {"lang"}
    (tmp_path / "x.txt").write_text("one\ntwo")
    assert sources.from_text_files(spark, str(tmp_path)).first()["text"] == "one\ntwo"
    assert sources.find_by_name(spark.createDataFrame([("Ab",), ("aB",)], "n string"), "n", "%AB%").count() == 1
    paths = spark.createDataFrame([("b/k",), (None,)], "path string")
    assert sources.with_object_paths(paths).collect() == [("b/k", "b", "k")]


def test_event_times(spark):
    rows = spark.createDataFrame([("2024-01-02T03:04:05+0200",), ("no",)], "t string").select(events.parsed_time(F.col("t")).isNotNull().alias("ok")).collect()
    assert [r["ok"] for r in rows] == [True, False]


def test_hop_and_names(spark):
    docs = spark.createDataFrame([("d1", "We met New York City staff."), ("d2", "newyork")], "document_id string, text string")
    names = spark.createDataFrame([("e1", "New York"), ("e2", "York"), ("e3", "...")], "id string, name string")
    got = {(r["document_id"], r["id"]) for r in retrieval.contained_names(docs, names).collect()}
    assert got == {("d1", "e1"), ("d1", "e2")}
    assert store.first_rows(spark.createDataFrame([(1, 2), (1, 1)], "k int, v int"), ["k"], ["v"]).collect() == [(1, 1)]


def test_required_roles(spark):
    rows = [("r", 0, "agent", 0), ("r", 1, "theme", 0), ("s", 0, "agent", 0)]
    counts = relations.cardinalities(spark.createDataFrame(rows, "relation_id string, role_group int, role string, pos int"))
    got = {r["relation_id"]: (r["a"], r["b"]) for r in counts.select("relation_id", relations.has_required_roles(counts).alias("a"), relations.has_required_roles(counts, True).alias("b")).collect()}
    assert got == {"r": (True, False), "s": (False, False)}


def test_type_splits_counts_and_clusters_all_members(spark):
    row = F.when(F.col("id") % 5 == 0, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
    vectors = spark.range(2100).select("id", F.lit(3).alias("kind"), row.alias("embedding"))
    got = scans.type_splits(vectors, "kind").collect()
    assert [(r["kind"], r["n"], r["n_clusters"], r["is_split"]) for r in got] == [("3", 2100, 2, True)] and got[0]["silhouette"] > 0.99


def slow_linkage(ids, m, distance):
    """Average linkage with every distance taken anew from the vectors."""
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    parts = [[i] for i in range(len(ids))]
    while len(parts) > 1:
        gaps = [(float(np.mean([1 - unit[i] @ unit[j] for i in a for j in b])), x, y) for x, a in enumerate(parts) for y, b in enumerate(parts) if x < y]
        gap, x, y = min(gaps)
        if gap >= distance:
            break
        parts[x] += parts.pop(y)
    return {ids[i]: min(ids[j] for j in part) for part in parts for i in part}


def test_agglomerative_against_slow_linkage(spark, sf):
    rows = [(str(r["vec_id"]), r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").limit(60).collect()]
    m = np.array([v for _, v in rows], np.float64)
    for distance in (0.5, 0.7, 0.85):
        got = {r["id"]: r["cluster"] for r in clustering.Agglomerative(distance).fit(spark.createDataFrame(rows, "id string, embedding array<double>")).collect()}
        assert got == slow_linkage([i for i, _ in rows], m, distance)


def test_density_against_brute_force(spark, sf):
    rows = [(str(r["vec_id"]), r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, m = [i for i, _ in rows], np.array([v for _, v in rows], np.float64)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    close = unit @ unit.T > 1 - 0.62
    core = [i for i in range(len(ids)) if close[i].sum() >= 3]
    label = {i: i for i in core}
    for _ in core:
        for i in core:
            for j in core:
                if close[i, j] and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j], key=lambda x: ids[x])
    names = {i: min(ids[j] for j in core if label[j] == label[i]) for i in core}
    want = {ids[i]: names[i] for i in core}
    for i in range(len(ids)):
        if i not in names and (near := [names[j] for j in core if close[i, j]]):
            want[ids[i]] = min(near)
    frame = spark.createDataFrame(rows, "id string, embedding array<double>")
    assert {r["id"]: r["cluster"] for r in clustering.Density(0.62, drop_noise=True).fit(frame).collect()} == want
    whole = {r["id"]: r["cluster"] for r in clustering.Density(0.62).fit(frame).collect()}
    assert set(whole) == set(ids) and {k: whole[k] for k in want} == want


def slow_chunks(text, budget, overlap):
    """Chunks word by word of the rules: whole sentences, and back over the last ones worth the overlap."""
    if not (text or "").strip():
        return []
    parts = []
    for s in chunking.split_sentences(text):
        parts += chunking.hard_split(s, budget, chunking.quarter_characters) if len(s) > 4 * budget else [s]
    size, out, i = [-(-len(p) // 4) for p in parts], [], 0
    while True:
        j = i + 1
        while j < len(parts) and sum(size[i : j + 1]) <= budget:
            j += 1
        out.append((sum(map(len, parts[:i])), sum(map(len, parts[:j])), sum(size[i:j])))
        if j == len(parts):
            return out
        back = max((b for b in range(i + 1, j) if sum(size[b:j]) >= overlap), default=None)
        i = j if back is None else back


@pytest.mark.parametrize("budget, overlap", [(10, 3), (40, 12), (7, 30)])
def test_chunks_against_slow_chunks(spark, sf, budget, overlap):
    for text in texts():
        assert chunking.chunk_text(text, budget, overlap) == slow_chunks(text, budget, overlap)
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("cast(doc_id as string) document_id", "text").limit(40)
    got = {}
    for r in chunking.chunks(docs, 64, 16).collect():
        got.setdefault(r["document_id"], []).append((r["start_char"], r["end_char"], r["token_count"], r["text"]))
    want = {r["document_id"]: [(a, b, k, r["text"][a:b]) for a, b, k in slow_chunks(r["text"], 64, 16)] for r in docs.collect() if (r["text"] or "").strip()}
    assert {k: sorted(v) for k, v in got.items()} == want


def most_memory(work):
    import tracemalloc

    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_best_rows_of_blocks_take_ties_by_id(spark):
    rng = np.random.default_rng(4)
    rows = [(f"{i:03d}", rng.normal(size=8).tolist()) for i in range(90)]
    rows += [(f"c{i}", rows[7][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    got = {(r["id"], r["rank"]): r["match"] for r in clustering.neighbours(df.where("id = '007'"), df, 12).collect()}
    assert got == {("007", k + 1): m for k, m in enumerate(sorted(["007", *(f"c{i}" for i in range(40))])[:12])}


def test_index_search_meets_lists_in_blocks(spark):
    from kgloom.operators import vector_index

    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(f"{i:04d}", rng.normal(size=8).tolist()) for i in range(1500)], "id string, embedding array<double>")
    found = vector_index.search(df.where("id < '0030'"), vector_index.index(df, 4), 5, probes=4)
    assert "lambdafunction" not in found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    true = {(r["id"], r["match"], r["rank"]) for r in clustering.neighbours(df.where("id < '0030'"), df, 5).collect()}
    assert {(r["id"], r["match"], r["rank"]) for r in found.collect()} == true


def test_average_linkage_needs_no_square_of_memory():
    rng = np.random.default_rng(4)
    hub = rng.normal(size=(1, 16)) + rng.normal(size=(4000, 16)) * 0.3
    assert most_memory(lambda: clustering.average_linkage(hub, 0.2)) < 4000 * 4000 * 8
    copies = np.repeat(rng.normal(size=(5, 16)), 1000, axis=0)
    assert (clustering.average_linkage(copies, 0.2) == np.unique(np.repeat(clustering.average_linkage(copies[::1000], 0.2), 1000), return_inverse=True)[1]).all()


def test_silhouette_of_many_clusters_is_taken_in_parts():
    rng = np.random.default_rng(4)
    points, label = rng.normal(size=(6000, 8)), np.arange(6000) // 2
    assert most_memory(lambda: scans.silhouette(points, label)) < 6000 * 3000 * 8
    few, own = points[:40], label[:40]
    unit = few / np.linalg.norm(few, axis=1, keepdims=True)
    gap = 1 - unit @ unit.T
    inner = [gap[i, i ^ 1] for i in range(40)]
    outer = [min(gap[i, own == c].mean() for c in range(20) if c != own[i]) for i in range(40)]
    assert np.isclose(scans.silhouette(few, own), np.mean([(b - a) / max(a, b) for a, b in zip(inner, outer)]))


def test_candidates_are_picked_without_sorting_all_rows(spark):
    rel = spark.createDataFrame([("r2", "T", "def b", "second"), ("r1", "T", None, "first"), ("r1", "T", "def a", "first")], "relation_id string, label string, definition string, description string")
    fil = spark.createDataFrame([("r2", 0, 0, "A", "x"), ("r1", 1, 0, "A", "y"), ("r1", 0, 1, "A", "z"), ("r0", 0, 0, "A", "of no relation"), ("r1", 0, 0, "", "no label")], "relation_id string, role_group int, pos int, label string, definition string")
    found = ontology.candidates(rel, fil)
    assert {(r["kind"], r["label"], r["definition"], r["source_description"]) for r in found.collect()} == {("relation", "T", None, "first"), ("entity", "A", "z", "first")}
    rows = spark.createDataFrame([(None, 2, "b"), (None, 1, None), ("k", 3, "c")], "k string, n int, v string")
    first = store.first_of_few(rows, ["k"], ["n"])
    assert {tuple(r) for r in first.collect()} == {(None, 1, None), ("k", 3, "c")}
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "Sort" not in plan.replace("SortAggregate", "Sort")
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_violations_are_sorted_in_tasks_of_bounded_size(spark, monkeypatch):
    def run(most):
        monkeypatch.setattr(validation, "TASK_ROWS", most, raising=False)
        rel = spark.range(60).select(F.col("id").cast("string").alias("relation_id"), F.lit("d").alias("document_id"), (F.col("id") / 60).alias("confidence"))
        fil = rel.select("relation_id", F.explode(F.array(F.lit("agent"), F.lit("theme"))).alias("role"), F.lit(0).alias("role_group"), F.lit(0).alias("pos"), F.lit("A").alias("label"), F.col("relation_id").alias("name")).where("relation_id % 7 <> 0 or role = 'agent'")
        ev = rel.select("relation_id", F.lit(0).alias("ev_pos"), F.lit("quote").alias("quote"), F.col("relation_id").alias("chunk_id"))
        parts = rel.select(F.col("relation_id").alias("chunk_id"), "document_id", F.when(F.col("relation_id") % 5 > 0, "a quote").otherwise("none").alias("text"))
        return validation.violations(DomainConfig(), rel, fil, ev, parts, rel.select("document_id").distinct().withColumn("text", F.lit("")))

    small, whole = run(10), run(1000)
    assert "RepartitionByExpression [relation_id" in (plan := small._jdf.queryExecution().optimizedPlan().toString()) and "], 6" in plan
    assert sorted(map(str, small.collect())) == sorted(map(str, whole.collect())) and small.count() > 60


def test_recall_by_two_words_meets_on_both(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.sample(["the", "of", "alpha", "beta", "gamma", "delta"], rng.randint(1, 4))), i % 3, [1.0, 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, name string, label long, embedding array<double>")
    for least in (1, 2, 3):
        out = resolution.recalled(df, df, 1, least, ["label"])
        got = {(r["left_id"], r["right_id"]) for r in out.collect() if r["right_id"] != "0"}
        assert got == {(str(a[0]), str(b[0])) for a in rows for b in rows if a[2] == b[2] and b[0] and len(set(a[1].split()) & set(b[1].split())) >= least}
