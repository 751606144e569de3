"""Further operators as queries, in the manner of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.functions import text as X
from kgloom.functions import vectors as V
from kgloom.operators import clustering, events, graph, ontology, relations, resolution, retrieval, scans
from kgloom.plans import derived as D
from kgloom.plans.derived import FILLERS, RELATIONS, VECTORS, cosine_sql, id_sql, table
from kgloom.plans.queries import CANONICAL, NAMES, ORACLES, QUERIES, _mentions, query
from kgloom.sources import documents as sources
from kgloom.sources import graph_store as store

__all__ = ["ORACLES", "QUERIES"]


@query(
    f"""WITH {FILLERS} SELECT fil.name || ' | ' || fil.label || ' | ' || fil.definition AS mention_text, 'Entity class: ' || fil.label || '. Definition: ' || fil.definition AS class_text,
  fil.label || ': ' || fil.definition AS type_text, lower(fil.label) || '||' || trim(regexp_replace(regexp_replace(lower(strip_accents(fil.name)), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS norm_key FROM fil"""
)
def embedding_texts(spark, sf):
    f = D.order_fillers(D.order_relations(spark, sf))
    label, name, meant = F.col("label"), F.col("name"), F.col("definition")
    return f.select(X.mention_text(name, label, meant).alias("mention_text"), X.entity_class_text(label, meant).alias("class_text"), X.type_text(label, meant).alias("type_text"), X.norm_key(label, name).alias("norm_key"))


@query(f"WITH {RELATIONS} SELECT relation_id, 'Generic: PLACED_PURCHASE_ORDER. Definition: ' || definition AS to_embed FROM rel")
def raw_relation_texts(spark, sf):
    return relations.raw_text(D.order_relations(spark, sf)).select("relation_id", "to_embed")


@query("SELECT page_id, string_split(url, '/')[1] AS bucket, substr(url, length(string_split(url, '/')[1]) + 2) AS key FROM pages WHERE url IS NOT NULL")
def object_paths(spark, sf):
    return sources.with_object_paths(table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))).select("page_id", "bucket", "key")


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds FROM orders")
def event_times(spark, sf):
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0000"))
    rows = table(spark, sf, "orders").select("o_orderkey", events.parsed_time(text).alias("t"))
    return rows.select("o_orderkey", F.unix_seconds("t").alias("seconds"))


@query("SELECT c_name FROM customer WHERE c_name ILIKE 'customer%7' ORDER BY c_name LIMIT 1")
def name_lookup(spark, sf):
    return sources.find_by_name(table(spark, sf, "customer").select("c_name"), "c_name", "CUSTOMER%7")


@query(f"WITH {FILLERS} SELECT DISTINCT {id_sql(label='label', name='name')} AS id FROM fil ORDER BY id LIMIT 500")
def entity_scan(spark, sf):
    return store.entity_scan(graph.entity_nodes(D.order_fillers(D.order_relations(spark, sf))), 500).select("id")


@query(
    f"""WITH {RELATIONS}, m AS (SELECT relation_id AS mention_id, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 'c-' || document_id END AS chunk_id FROM rel), d AS (SELECT DISTINCT document_id FROM rel)
SELECT mention_id, document_id FROM m JOIN d ON chunk_id = 'c-' || document_id UNION ALL SELECT mention_id, document_id FROM m, d WHERE chunk_id IS NULL"""
)
def document_mentions(spark, sf):
    rel = D.order_relations(spark, sf)
    chunk = F.concat(F.lit("c-"), "document_id")
    told = rel.select(F.col("relation_id").alias("mention_id"), F.when(F.col("o_orderkey") % 97 != 0, chunk).alias("chunk_id"))
    docs = rel.select("document_id").distinct()
    return graph.document_mentions(told, docs.select(chunk.alias("chunk_id"), "document_id"), docs)


@query(f"WITH {CANONICAL} SELECT count(*) FILTER (name <> canonical_name) AS n_changed FROM (SELECT DISTINCT name, canonical_name, canonical_label, relation_id FROM m JOIN c ON norm_key = cluster WHERE NOT is_known)")
def changed_mentions(spark, sf):
    m = _mentions(spark, sf)
    clusters = m.select("norm_key", F.col("norm_key").alias("cluster")).distinct()
    done = resolution.resolved(m, clusters, resolution.canonical(m, clusters))
    where = m.where("relation_id is not null").select("relation_id", F.concat(F.lit("c-"), "relation_id").alias("chunk_id")).distinct()
    return resolution.changed_mentions(resolution.graph_mentions(done, where))


@query(
    f"""WITH RECURSIVE {NAMES}, k AS (SELECT DISTINCT norm_key FROM m), e AS (SELECT a.norm_key AS a, b.norm_key AS b FROM k a JOIN k b ON right(a.norm_key, 3) = right(b.norm_key, 3) AND a.norm_key <> b.norm_key),
r(v, c) AS (SELECT norm_key, norm_key FROM k UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v) SELECT v AS norm_key, min(c) AS cluster FROM r GROUP BY 1"""
)
def merged_groups(spark, sf):
    groups = resolution.groups(_mentions(spark, sf))
    tail = F.right("norm_key", F.lit(3))
    first = groups.groupBy(tail.alias("t")).agg(F.min("norm_key").alias("a"))
    links = groups.select(tail.alias("t"), F.col("norm_key").alias("b")).join(first, "t").where("a <> b").select("a", "b")
    return resolution.merged_groups(groups, links)


@query(
    f"""WITH {VECTORS}, q AS (SELECT * FROM vec WHERE id::INT % 20 = 0), s AS (SELECT q.id, v.id AS match, 'L' || v.label AS label, {cosine_sql('q.embedding', 'v.embedding')} AS score FROM q, vec v WHERE q.id <> v.id),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, match) AS r FROM s), u AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id, match) AS n FROM t WHERE r <= 5)
SELECT label, match, round(score, 6) AS score FROM u WHERE n = 1"""
)
def similar_entities(spark, sf):
    v = D.vectors(spark, sf)
    mine = F.col("id").cast("int") % 20 == 0
    known = v.select("id", "embedding", F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"), F.lit("n").alias("name"), F.lit("d").alias("definition"))
    return retrieval.similar_entities(v.where(mine), known, others=True).select("label", "match", F.round("score", 6).alias("score"))


@query(f"WITH {VECTORS} SELECT id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS size, label FROM vec")
def vector_norms(spark, sf):
    return D.vectors(spark, sf).select("id", F.round(V.norm(F.col("embedding")), 6).alias("size"), "label")


@query("SELECT n_nationkey, CASE WHEN n_nationkey / 25 >= 0.5 AND n_regionkey / 5 >= 0.3 THEN 'split' WHEN n_nationkey / 25 >= 0.5 OR n_regionkey / 5 >= 0.3 THEN 'watch' ELSE 'keep' END AS what FROM nation")
def split_routing(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", scans.routed(F.col("n_nationkey") / 25, F.col("n_regionkey") / 5).alias("what"))


ROLE_SETS = f"{FILLERS}, rs AS (SELECT relation_id, list_sort(list(DISTINCT role || ':' || label)) AS f FROM fil GROUP BY 1)"


@query(f"WITH {ROLE_SETS}, b AS (SELECT f FROM rs ORDER BY relation_id LIMIT 1) SELECT rs.relation_id, round(len(list_intersect(rs.f, b.f)) / len(list_distinct(list_concat(rs.f, b.f))), 6) AS similarity FROM rs, b")
def role_set_jaccard(spark, sf):
    f = D.order_fillers(D.order_relations(spark, sf))
    sets = f.groupBy("relation_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "role", "label"))).alias("f"))
    base = sets.agg(F.min_by("f", "relation_id").alias("b"))
    return sets.join(F.broadcast(base)).select("relation_id", F.round(scans.jaccard_of(F.col("f"), F.col("b")), 6).alias("similarity"))


@query("SELECT n_name AS label FROM nation WHERE n_nationkey % 5 = 2 OR n_name = (SELECT max(n_name) FROM nation)")
def label_trail(spark, sf):
    n = table(spark, sf, "nation")
    last = n.agg(F.max("n_name").alias("last"))
    types = n.select(F.col("n_name").alias("label"), F.array(F.lit("x"), F.concat(F.lit("old-"), (F.col("n_nationkey") % 5).cast("string"))).alias("trail"))
    named = types.join(last, F.col("label") == F.col("last"), "left").withColumn("trail", F.when(F.col("last").isNotNull(), F.array_append("trail", "old-2")).otherwise(F.col("trail"))).drop("last")
    return scans.on_trail(named, "old-2").select("label")


@query("SELECT round(sum(c_nationkey * c_acctbal) / sum(c_nationkey) - 0.1 * 3, 4) AS quality FROM customer")
def ontology_quality(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("w"), F.col("c_acctbal").alias("h"))
    return scans.quality(rows, 3, 0.1).select(F.round("quality", 4).alias("quality"))


@query(f"WITH {FILLERS} SELECT DISTINCT label FROM fil")
def all_labels(spark, sf):
    return ontology.all_labels(D.order_fillers(D.order_relations(spark, sf)))


@query(f"WITH {FILLERS}, t AS (SELECT DISTINCT 'entity' AS kind, label, definition FROM fil) SELECT kind, string_agg('- ' || label || ': ' || substr(definition, 1, 120), chr(10) ORDER BY label) AS text FROM t GROUP BY 1")
def prompt_types(spark, sf):
    f = D.order_fillers(D.order_relations(spark, sf))
    return ontology.prompt_types(f.select(F.lit("entity").alias("kind"), "label", "definition"))


@query("SELECT n_nationkey, n_nationkey + 7 AS fast, 7 AS full_path, n_nationkey >= 20 AS is_stale FROM nation")
def staleness_counters(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(k, ontology.counted_documents(k, F.lit(7), False).alias("fast"), ontology.counted_documents(k, F.lit(7), True).alias("full_path"), ontology.stale(k, 20).alias("is_stale"))


@query("SELECT event_type AS cluster, list(DISTINCT 'u' || user_id % 3 ORDER BY 'u' || user_id % 3) AS types FROM events GROUP BY 1")
def cluster_types(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("cluster"), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("label"))
    return events.cluster_types(rows)


@query("SELECT sha256(n_name) AS prompt_hash, CASE WHEN n_nationkey % 2 = 0 THEN 'known' ELSE 'new' END AS answer FROM nation")
def memoised_answers(spark, sf):
    n = table(spark, sf, "nation")
    memo = n.where("n_nationkey % 2 = 0").select(F.sha2("n_name", 256).alias("prompt_hash"), F.lit("known").alias("answer"))
    out = events.memoised(n.select(F.col("n_name").alias("prompt")), memo, lambda rows: rows.withColumn("answer", F.lit("new")))
    return out.select("prompt_hash", "answer")


@query("SELECT p_partkey AS id, p_brand || CASE WHEN p_size > 25 THEN '/big' ELSE '' END AS sub_cluster FROM part")
def sub_clusters(spark, sf):
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster"), "p_size")
    out = events.sub_clusters(items, lambda rows: rows.where("p_size > 25").select("id", F.lit("big").alias("cluster")))
    return out.select("id", "sub_cluster")


@query("SELECT event_id, 'events' AS source, event_type AS kind FROM events")
def stamped_events(spark, sf):
    rows = events.stamped(table(spark, sf, "events"), {"source": F.lit("events"), "kind": F.col("event_type")})
    return rows.select("event_id", F.col("metadata")["source"].alias("source"), F.col("metadata")["kind"].alias("kind"))


@query("SELECT label AS cluster, list(vec_id::VARCHAR ORDER BY vec_id::VARCHAR) AS members FROM embeddings GROUP BY 1")
def cluster_members(spark, sf):
    return clustering.members(D.vectors(spark, sf).select("id", F.col("label").alias("cluster")))


@query("SELECT 'User' AS kind, count(DISTINCT user_id) + count(DISTINCT event_type) AS n_nodes, (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS n_edges FROM events")
def event_elements(spark, sf):
    from kgloom.streaming.ingest import event_elements as elements

    nodes, edges = elements(table(spark, sf, "events"))
    return nodes.agg(F.lit("User").alias("kind"), F.count("*").alias("n_nodes")).join(F.broadcast(edges.agg(F.count("*").alias("n_edges"))))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_counts(spark, sf):
    from kgloom.streaming.ingest import window_counts as counts

    rows = counts(table(spark, sf, "events"), "ts", "event_type", "1 hour")
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


RESOLVED = f"""{CANONICAL}, x AS (SELECT m.*, c.*, needs_arbitration AND canonical_name LIKE '%7' AS refused FROM m JOIN c ON norm_key = cluster)"""


@query(
    f"""WITH {RESOLVED} SELECT cluster AS "group", CASE WHEN any_value(refused) THEN NULL ELSE any_value(canonical_name) END AS canonical_name, count(*) AS mention_count,
  CASE WHEN any_value(refused) THEN 'llm_rejected' WHEN any_value(needs_arbitration) THEN 'llm' ELSE 'exact' END AS method, CASE WHEN any_value(refused) THEN [] ELSE any_value(aliases) END AS aliases FROM x GROUP BY 1"""
)
def entity_resolution(spark, sf):
    """All stages with an arbiter that refuses names ending in 7."""
    from kgloom.config import DomainConfig

    arbiter = lambda c: c.select("cluster", (~F.col("canonical_name").endswith("7")).alias("should_merge"), F.col("canonical_name").alias("name"), F.col("canonical_label").alias("label"), F.col("canonical_definition").alias("definition"))
    report = resolution.resolve(_mentions(spark, sf), DomainConfig(), None, arbiter)[2]
    return report.select("group", F.when(F.col("method") != "llm_rejected", F.col("canonical_name")).alias("canonical_name"), "mention_count", "method", "aliases")


def _order_graph(spark, sf):
    rel = D.order_relations(spark, sf)
    fil = D.order_fillers(rel)
    full = relations.described(relations.with_roles(rel, fil))
    return graph.entity_nodes(fil).unionByName(graph.relation_nodes(full)), graph.role_edges(rel, fil)


@query(
    f"""WITH {FILLERS}, q AS (SELECT lower(string_agg(n_name, ' and ' ORDER BY n_name)) AS text FROM nation), s AS (SELECT DISTINCT {id_sql(label='label', name='name')} AS id, name FROM fil ORDER BY id LIMIT 500),
e AS (SELECT id, name FROM s, q WHERE contains(text, lower(name)) ORDER BY id LIMIT 30)
SELECT 'entity' AS part, id FROM e UNION ALL SELECT 'relation', id FROM (SELECT DISTINCT {id_sql(verb='verb', target='target_category', description='description', doc='document_id')} AS id FROM rel JOIN fil USING (relation_id) WHERE {id_sql(label='fil.label', name='fil.name')} IN (SELECT id FROM e) ORDER BY id LIMIT 20)"""
)
def context_retrieve(spark, sf):
    """The whole retrieval for one text, by names, as no chunk is embedded."""
    from kgloom.config import DomainConfig

    text = " and ".join(r["n_name"] for r in table(spark, sf, "nation").select("n_name").orderBy("n_name").collect())
    found = retrieval.retrieve(text, *_order_graph(spark, sf), DomainConfig())
    return found[0].select(F.lit("entity").alias("part"), "id").unionByName(found[1].select(F.lit("relation").alias("part"), "id"))


@query("SELECT c_custkey, round(jaro_winkler_similarity(lower(c_mktsegment), lower(n_name)), 6) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey")
def name_similarity(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", F.round(resolution.jaro_winkler(F.lower("c_mktsegment"), F.lower("n_name")), 6).alias("score"))


@query(
    f"""WITH {VECTORS}, i AS (SELECT id, embedding, 'word' || (id::INT % 50) || ' name' || (id::INT % 7) AS name, label FROM vec), q AS (SELECT * FROM i WHERE id::INT % 20 = 0),
s AS (SELECT q.id AS left_id, i.id AS right_id, {cosine_sql('q.embedding', 'i.embedding')} AS c, q.name AS a, i.name AS b, q.label AS x, i.label AS y FROM q, i), r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY c DESC, right_id) AS n FROM s),
p AS (SELECT *, 0.6 * c + 0.3 * jaro_winkler_similarity(a, b) + 0.1 * (1 - levenshtein(a, b) / greatest(length(a), length(b), 1)) AS score FROM r WHERE (n <= 10 OR len(list_intersect(string_split(a, ' '), string_split(b, ' '))) >= 2) AND x = y),
t AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS rank, max(score) OVER (PARTITION BY left_id) AS best FROM p)
SELECT left_id, right_id, round(score, 6) AS score, rank::INT AS rank FROM t WHERE score >= 0.8 OR best < 0.8 AND rank <= 3"""
)
def hybrid_recall(spark, sf):
    """Vectors and words recall, names and vectors rank, labels have to agree."""
    k = F.col("id").cast("int")
    items = D.vectors(spark, sf).withColumn("name", F.concat(F.lit("word"), (k % 50).cast("string"), F.lit(" name"), (k % 7).cast("string")))
    asked = items.where(k % 20 == 0)
    out = resolution.ranked(resolution.recalled(asked, items, 10, 2, ["label"]), asked, items, {"vector": 0.6, "jaro_winkler": 0.3, "edits": 0.1}, 0.8, 3, ["label"])
    return out.select("left_id", "right_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH {FILLERS}, ty AS (SELECT relation_id, 'T' || (o_orderkey % 5)::VARCHAR AS type FROM rel), mo AS (SELECT type, role || '>' || label AS motif, count(*) AS n FROM fil JOIN ty USING (relation_id) GROUP BY 1, 2),
w AS (SELECT type, motif, n / sum(n) OVER (PARTITION BY type) * ln(1 + (SELECT count(DISTINCT type) FROM mo) / count(*) OVER (PARTITION BY motif)) AS weight FROM mo),
z AS (SELECT type, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY 1), e AS (SELECT 'T' || vec_id AS type, embedding FROM embeddings WHERE vec_id < 5),
c AS (SELECT a.type AS a, b.type AS b, sum(a.weight * b.weight) / (any_value(x.norm) * any_value(y.norm)) AS cosine FROM w a JOIN w b ON a.motif = b.motif AND a.type < b.type JOIN z x ON x.type = a.type JOIN z y ON y.type = b.type GROUP BY 1, 2)
SELECT a, b, round(cosine, 6) AS cosine, round({cosine_sql('u.embedding', 'v.embedding')}, 6) AS meaning FROM c JOIN e u ON u.type = a JOIN e v ON v.type = b WHERE cosine >= 0.5 AND {cosine_sql('u.embedding', 'v.embedding')} >= 0.0"""
)
def merge_scan(spark, sf):
    rel = D.order_relations(spark, sf)
    typed = rel.select("relation_id", F.concat(F.lit("T"), (F.col("o_orderkey") % 5).cast("string")).alias("label"))
    weights = scans.motif_weights(scans.motifs(D.order_fillers(rel), typed))
    types = table(spark, sf, "embeddings").where("vec_id < 5").select(F.concat(F.lit("T"), F.col("vec_id").cast("string")).alias("type"), "embedding")
    out = scans.merge_scan(weights, types, 0.5, 0.0)
    return out.select("a", "b", F.round("cosine", 6).alias("cosine"), F.round("meaning", 6).alias("meaning"))


@query(f"WITH {FILLERS}, n AS (SELECT count(DISTINCT (label, name)) AS n FROM fil), e AS (SELECT count(DISTINCT (relation_id, label, name, role)) AS n FROM fil) SELECT n.n + (SELECT count(DISTINCT relation_id) FROM fil) AS nodes_given, n.n + (SELECT count(DISTINCT relation_id) FROM fil) AS nodes_held, e.n AS edges_given, e.n AS edges_held FROM n, e")
def upload_check(spark, sf):
    """An export into a fresh graph, counted."""
    from kgloom.sources.shared import fresh_path

    graph_of = store.ParquetGraph(spark, fresh_path(spark, "graph"))
    nodes, edges = _order_graph(spark, sf)
    graph_of.export(nodes, edges)
    return graph_of.uploaded(nodes, edges)


@query()
def vector_index_search(spark, sf):
    from kgloom.operators import vector_index

    v = D.vectors(spark, sf)
    found = vector_index.search(v.where(F.col("id").cast("int") % 20 == 0), vector_index.index(v), 10, probes=24)
    return found.withColumn("score", F.round("score", 6))


@query("SELECT doc_id::VARCHAR AS document_id, text, lang, source FROM documents")
def document_source(spark, sf):
    docs = sources.from_parquet(spark, f"{sf}/documents.parquet", metadata=("lang", "source"))
    return docs.select("document_id", "text", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"))


@query("SELECT event_id, coalesce(value / 100 BETWEEN 0 AND 1, false) AS is_confidence, upper(event_type) IN ('ONTOLOGICAL', 'DYNAMIC', 'STRUCTURAL') OR event_id % 3 = 0 AS is_axis FROM events")
def relation_checks(spark, sf):
    axis = F.when(F.col("event_id") % 3 == 0, "STRUCTURAL").otherwise(F.upper("event_type"))
    return table(spark, sf, "events").select("event_id", relations.valid_confidence(F.col("value") / 100).alias("is_confidence"), relations.valid_axis(axis).alias("is_axis"))


@query("""SELECT n_nationkey, sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}') AS hash FROM nation UNION ALL SELECT 1000000 + c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') FROM customer""")
def row_hashes(spark, sf):
    from kgloom.functions import ids

    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), ids.full_hash(F.struct("n_nationkey", "n_name")).alias("hash"))
    return n.unionByName(table(spark, sf, "customer").select((F.col("c_custkey") + 1000000).alias("n_nationkey"), ids.full_hash(F.struct("c_custkey", "c_name")).alias("hash")))


@query(f"WITH {FILLERS} SELECT label, name, min(relation_id) AS relation_id FROM fil GROUP BY 1, 2")
def deduplicated_entities(spark, sf):
    return relations.deduplicated(D.order_fillers(D.order_relations(spark, sf))).select("label", "name", "relation_id")


@query(
    f"""WITH {FILLERS}, e AS (SELECT DISTINCT label, '- ' || label || ': ' || label || ' entity.' AS line FROM fil), g AS (SELECT DISTINCT concat_ws(' ', 'Customer PLACED_PURCHASE_ORDER', t.label) AS g FROM rel LEFT JOIN (SELECT relation_id, label FROM fil WHERE role = 'theme') t USING (relation_id) ORDER BY g LIMIT 2)
SELECT (SELECT string_agg(line, chr(10) ORDER BY line) FROM e) || chr(10) || '- PLACED: ' || (SELECT string_agg(g, '; ' ORDER BY g) FROM g) AS text"""
)
def prompt_context(spark, sf):
    """The whole graph as a context's text: a definition a label, two examples a verb."""
    nodes, _ = _order_graph(spark, sf)
    p = F.col("properties")
    entities = nodes.where("kind = 'Entity'").select("id", p["name"].alias("name"), p["label_class"].alias("label"), p["definition"].alias("definition"))
    rels = nodes.where((F.col("kind") == "Relation") & p["generic"].isNotNull()).select("id", p["generic"].alias("generic"), p["verb"].alias("verb"), p["description"].alias("description"))
    return retrieval.prompt_text(entities, rels)


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS n_distinct, bool_and(event_id IN (SELECT event_id FROM events)) AS is_subset FROM (SELECT event_id FROM events LIMIT 100)")
def sampled_examples(spark, sf):
    """A fixed sample of 100 examples."""
    e = table(spark, sf, "events")
    return events.sampled(e, "event_id", 100).select("event_id").join(e.select("event_id").distinct(), "event_id", "left_semi").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_distinct"), F.lit(True).alias("is_subset"))
