"""The construction pipeline and the steps behind its protocols."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.config import DomainConfig, SeedOntology, SeedType
from kgloom.operators import clustering, models, ontology, relations, resolution, retrieval, scans, validation, vector_index
from kgloom.plans import pipeline, prompts
from kgloom.sources.graph_store import ParquetGraph

FILLERS = "relation_id string, role_group int, role string, pos int, label string, name string, definition string, confidence double"
DOCS = [("d1", "Customer Customer#000000001 placed order 12345. Customer Customer#000000002 placed order 12346. "), ("d2", "Customer Customer#000000001 placed order 12399. Nothing else."), ("d3", "No order here."), ("d4", None)]


def documents(spark):
    return spark.createDataFrame(DOCS, "document_id string, text string")


def test_extraction_retries_until_quotes_are_sound(spark):
    def careless(text, context, attempt):
        found = pipeline.orders_of_text(text, context, attempt)
        wrong = "these words are in none of the documents, however long" if attempt < 2 or "12399" in text else None
        return [{**r, "document_id": "made up", "quotes": [wrong or r["quotes"][0]]} for r in found]

    raw = models.extracted(documents(spark), careless, 3).collect()
    assert [(r["document_id"], r["ord"]) for r in raw] == [("d1", 0), ("d1", 1)]
    assert models.extracted(documents(spark), careless, 2).count() == 0
    assert not models.sound({"quotes": ["short"]}, "short") and not models.sound({"quotes": []}, "x")


def test_a_failed_or_generic_role_filling_drops_its_relation(spark):
    raw = models.extracted(documents(spark), pipeline.orders_of_text)

    def fill(relation, text, context):
        if "12346" in relation["description"]:
            raise RuntimeError("no answer")
        found = pipeline.roles_of_order(relation, text, context)
        return [{**f, "label": "Thing" if "12399" in relation["description"] else f["label"]} for f in found]

    got = models.with_fillers(raw, documents(spark), fill, ["thing"]).collect()
    assert [(r["role"], r["name"], r["pos"]) for r in got] == [("agent", "Customer#000000001", 0), ("theme", "Order 12345", 0)]


def test_run_from_documents_to_graph(spark, tmp_path):
    config = DomainConfig(staleness_documents=10, seed=SeedOntology(entity_types=(SeedType("Customer", "who buys"),)))
    graph = ParquetGraph(spark, str(tmp_path / "g"))
    first = pipeline.run(config, documents(spark), pipeline.orders_of_text, pipeline.roles_of_order, sink=graph)
    assert first.path == "full" and (first.ontology.version, first.ontology.docs_since) == (1, 4)
    assert {(r["label"], r["is_seed"]) for r in first.ontology.types.collect()} == {("Customer", True), ("Order", False), ("PLACED_PURCHASE_ORDER", False)}
    assert {(r["label"], r["action"]) for r in first.governance.collect()} == {("Customer", "known"), ("Order", "accept"), ("PLACED_PURCHASE_ORDER", "accept")}
    nodes, edges = graph.read()
    kinds = {r["kind"]: r["count"] for r in nodes.groupBy("kind").count().collect()}
    assert kinds == {"Document": 4, "Chunk": 3, "Relation": 3, "Entity": 5, "Mention": 6}
    types = {r["relation_type"]: r["count"] for r in edges.groupBy("relation_type").count().collect()}
    assert types == {"HAS_CHUNK": 3, "EXTRACTED_FROM": 3, "AGENT": 3, "THEME": 3, "HAS_MENTION": 6, "REFERS_TO": 6}
    assert first.review.first()["n_incomplete"] == 0
    later = spark.createDataFrame([("d5", "CUSTOMER#000000001 asks. Customer Customer#000000001 placed order 12777. ")], "document_id string, text string")
    seen = []
    second = pipeline.run(config, later, pipeline.orders_of_text, pipeline.roles_of_order, before=first.ontology, sink=graph)
    assert second.path == "fast" and second.ontology.docs_since == 5 and second.ontology.version == 1
    assert second.resolution.first()["total_mentions"] > 2  # known entities stand beside the new mentions
    assert graph.read()[0].where("kind = 'Document'").count() == 5
    context = retrieval.contexts(later, *graph.read(), config).first()["context"]
    assert context.startswith("- Customer#000000001 (Customer)") and "- Customer PLACED_PURCHASE_ORDER Order" in context
    strange = pipeline.Ontology(spark.createDataFrame([("relation", "ZZZ", "qqq", False)], pipeline.TYPES))
    moved = pipeline.run(DomainConfig(drift_least=1), later, pipeline.orders_of_text, pipeline.roles_of_order, before=strange)
    assert moved.path == "full" and moved.ontology.docs_since == 1 and not seen


def test_retrieval_by_chunks_and_by_names(spark, tmp_path):
    config = DomainConfig(max_chunks=1)
    graph = ParquetGraph(spark, str(tmp_path / "g"))
    pipeline.run(config, documents(spark), pipeline.orders_of_text, pipeline.roles_of_order, sink=graph)
    nodes, edges = graph.read()
    embed = clustering.Embedder(config.embedding_size)
    entities, rels = retrieval.retrieve(DOCS[1][1], nodes, edges, config, embed)
    assert {r["name"] for r in entities.collect()} == {"Customer#000000001", "Order 12399"} and rels.count() == 1
    # Without an embedder, or without an embedded chunk, names are looked for.
    for found in (retrieval.retrieve("what of CUSTOMER#000000002, please", nodes, edges, config), retrieval.retrieve("what of CUSTOMER#000000002, please", nodes.where("kind <> 'Chunk'"), edges, config, embed)):
        assert [r["name"] for r in found[0].collect()] == ["Customer#000000002"] and found[1].count() == 1
    assert retrieval.prompt_text(entities, rels).first()["text"] == "- Customer: Customer entity.\n- Order: Order entity.\n- PLACED: Customer PLACED_PURCHASE_ORDER Order"
    none = retrieval.retrieve("nothing of it", nodes, edges, config)
    assert none[0].count() == none[1].count() == 0


def test_resolution_clusters_asks_and_splits(spark):
    rows = [("r1", 0, "agent", 0, "Org", "Acme Corporation", "makes anvils", 0.9), ("r2", 0, "agent", 0, "Org", "Acme Corporations", "makes anvils", 0.4), ("r3", 0, "agent", 0, "Org", "Globex", "makes nothing", 0.5), ("r4", 0, "agent", 0, "Org", "GLOBEX", "makes nothing", 0.5)]
    mentions = resolution.entity_mentions(spark.createDataFrame(rows, FILLERS))
    embed = clustering.Embedder(256)
    asked = []

    def arbiter(clusters):
        asked.append(sorted(r["canonical_name"] for r in clusters.collect()))
        yes = F.col("canonical_name").startswith("Acme")
        return clusters.select("cluster", yes.alias("should_merge"), F.lit("Acme Corp").alias("name"), F.lit("Org").alias("label"), F.lit("d").alias("definition"))

    done, chosen, report = resolution.resolve(mentions, DomainConfig(), embed, arbiter)
    assert asked == [["Acme Corporation", "Globex"]]
    assert {(r["name"], r["resolved_name"]) for r in done.collect()} == {("Acme Corporation", "Acme Corp"), ("Acme Corporations", "Acme Corp"), ("Globex", "Globex"), ("GLOBEX", "GLOBEX")}
    got = {(r["canonical_name"], r["method"], r["mention_count"], tuple(r["aliases"])) for r in report.collect()}
    assert ("Acme Corp", "llm", 2, ("Acme Corporation", "Acme Corporations")) in got and {x[1:] for x in got if x[0] != "Acme Corp"} == {("llm_rejected", 2, ())}
    done, _, report = resolution.resolve(mentions, DomainConfig(arbitration_enabled=False), embed, arbiter)
    assert len(asked) == 1 and {r["resolved_name"] for r in done.collect()} == {"Acme Corporation", "Globex"} and {r["method"] for r in report.collect()} == {"embedding"}
    done, _, _ = resolution.resolve(mentions, DomainConfig(resolution_enabled=False), embed, arbiter)
    assert all(r["resolved_name"] == r["name"] for r in done.collect())
    known = spark.createDataFrame([("k1", "Org", "Acme Corporation", "makes anvils"), ("k2", "City", "Paris", "a town")], "id string, label string, name string, definition string")
    known = known.withColumn("embedding", embed(F.concat_ws(" | ", "name", "label", "definition")))
    near = resolution.known_candidates(spark.createDataFrame(rows[:2], FILLERS), known, embed, 1)
    assert [r["name"] for r in near.collect()] == ["Acme Corporation"]


def test_token_batches():
    texts = ["a" * 8, "b" * 8, "c" * 40, "", "d" * 4]
    assert list(models.token_batches(texts, 4)) == [texts[:2], texts[2:3], texts[3:]]
    with pytest.raises(ValueError):
        list(models.token_batches(texts, 4, strict=True))
    assert list(models.token_batches([], 4)) == []


def test_client_embedder_and_cached_types(spark):
    steps = pipeline.client_steps(DomainConfig(embedding_batch_tokens=3), lambda texts: np.array([[len(t), len(texts)] for t in texts]))
    rows = spark.createDataFrame([("aaaa",), (None,), ("b" * 12,)], "t string").coalesce(1)
    assert [r["v"] for r in rows.select(steps.embed(F.col("t")).alias("v")).collect()] == [[4.0, 2.0], [0.0, 2.0], [12.0, 1.0]]
    types = spark.createDataFrame([("relation", "A", "x"), ("relation", "B", "y")], "kind string, label string, definition string")
    held = models.TypeEmbeddings(clustering.Embedder(8))
    one = held.of(types)
    assert held.of(types.orderBy(F.desc("label"))) is one and held.of(types.withColumn("definition", F.lit("z"))) is not one


def test_prompts_hold_what_they_are_given():
    config = DomainConfig(name="bridges", language="fr", context="about bridges", seed=SeedOntology(relation_types=(SeedType("SPANS", "goes over"),)))
    told, asked = prompts.extraction(config, "the text", "types", "known")
    assert all(x in told for x in ("bridges", "fr", "ONTOLOGICAL", "types", "known")) and "the text" in asked
    told, asked = prompts.roles(config, "a relation", "a quote", "the text")
    assert all(f"- {r}:" in told for r in ("agent", "theme", "location")) and "co_agent" in told and "a quote" in asked
    assert prompts.merging([("A", "X", "d", "agent", "r1"), ("A", "X", "e", "theme", "r2"), ("B", "X", "d", "agent", "r1")]).count("\n- ") == 2
    assert "80%" in prompts.governance(config, [("entity", "Pier", "stands in water")]) and "a relation" in prompts.review(config, "t", ["a relation"])


def test_review_and_resolutions_are_logs(spark):
    docs = spark.createDataFrame([("d", "One. Two. Three.")], "document_id string, text string")
    rel = spark.createDataFrame([("r1", "d", "has theme"), ("r2", "d", "has none")], "relation_id string, document_id string, description string")
    fillers = spark.createDataFrame([("r1", "theme")], "relation_id string, role string")
    counted = models.review_counts(models.review_by_rule(docs, rel, fillers)).first()
    assert (counted["n_missing"], counted["n_incomplete"]) == (0, 1) and abs(counted["coverage"] - 2 / 3) < 1e-9
    found = spark.createDataFrame([("rule", "error", "m", "relation", "r1"), ("rule", "warning", "m", "relation", "r2")], "rule_name string, severity string, message string, subject_type string, subject_id string")
    log = validation.resolutions(found, lambda errors: errors.select("rule_name", "subject_id", F.lit("drop").alias("action"), F.lit("why").alias("reasoning"))).collect()
    assert [(r["subject_id"], r["action"]) for r in log] == [("r1", "drop")]
    assert relations.of_documents(rel, docs).count() == 2 and relations.with_document(rel, F.lit(7)).first()["document_id"] == "7"


def test_columns_kept_by_a_model(spark):
    columns = spark.createDataFrame([("t", "name", "string", True), ("t", "made_at", "timestamp", True), ("u", "state", "string", True)], "table_name string, column_name string, data_type string, is_nullable boolean")
    calls = []

    def choose(table, described):
        calls.append(table)
        return '["name", "state", "no such"]'

    memo = {}
    for _ in range(2):
        assert models.kept_columns(columns, choose, memo) == {"t": ["name"], "u": ["state"]}
    assert calls == ["t", "u"]
    assert models.model_code("u", ["state"], {"state": ["on", "off"]}) == "class U(BaseModel):\n    state: Optional[Literal['on', 'off']] = None"


def test_label_trails(spark):
    types = spark.createDataFrame([("EMPLOYS", ["EMPLOYS"]), ("BANK", ["BANK"]), ("HIRES", ["HIRES"])], "label string, trail array<string>")
    shown = lambda df: {r["label"]: r["trail"] for r in df.collect()}
    split = scans.specialised(types, spark.createDataFrame([("EMPLOYS", "EMPLOYS_GOV")], "label string, child string"))
    assert shown(split)["EMPLOYS_GOV"] == ["EMPLOYS", "EMPLOYS_GOV"] and {r["label"] for r in scans.on_trail(split, "EMPLOYS").collect()} == {"EMPLOYS", "EMPLOYS_GOV"}
    merged = shown(scans.abstracted(types, spark.createDataFrame([("EMPLOYS", "WORKS"), ("HIRES", "WORKS")], "label string, parent string")))
    assert merged == {"EMPLOYS": ["WORKS", "EMPLOYS"], "HIRES": ["WORKS", "HIRES"], "BANK": ["BANK"], "WORKS": ["WORKS"]}
    apart = shown(scans.disambiguated(types, spark.createDataFrame([("BANK", "MONEY_BANK"), ("BANK", "RIVER_BANK")], "label string, child string")))
    assert "BANK" not in apart and apart["RIVER_BANK"] == ["RIVER_BANK"]
    assert set(shown(scans.unified(types, spark.createDataFrame([("EMPLOYS", "HIRES_AS"), ("HIRES", "HIRES_AS")], "label string, chosen string")))) == {"BANK", "HIRES_AS"}


def test_index_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    asked = vectors.where("cast(id as int) % 20 = 0")
    held = vector_index.index(vectors)
    true = clustering.neighbours(asked, vectors, 10)
    assert held[0].count() == vectors.count()
    assert vector_index.recall(vector_index.search(asked, held, 10, probes=24), true).first()["recall"] >= 0.9
    assert vector_index.recall(vector_index.search(asked, held, 10, probes=32), true).first()["recall"] == 1.0


def test_governance_merges_likely_candidates(spark):
    rel = spark.createDataFrame([("r", "d", "x", 0.5, "DYNAMIC", "PLACED", "purchase order", "a customer places an order", "PLACED_PURCHASE_ORDER")], "relation_id string, document_id string, description string, confidence double, axis string, verb string, target_category string, definition string, label string")
    fillers = spark.createDataFrame([("r", 0, "agent", 0, "Customers", "c", "who buys things", 1.0)], FILLERS)
    before = pipeline.Ontology(spark.createDataFrame([("entity", "Customer", "who buys things", True)], pipeline.TYPES))
    after, log = pipeline.govern(DomainConfig(auto_merge_cosine=0.8), rel, fillers, before, pipeline.Steps(embed=clustering.Embedder(256)))
    assert {(r["label"], r["action"]) for r in log.collect()} == {("Customers", "auto_merged"), ("PLACED_PURCHASE_ORDER", "accept")}
    assert after.version == 1 and after.types.count() == 2 and ontology.stale(F.lit(1)) is not None
