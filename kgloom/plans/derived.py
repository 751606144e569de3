"""Relations, fillers, evidence, chunks and vectors derived from the driver's tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators import relations as R


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_relations(spark: SparkSession, sf: str) -> DataFrame:
    """One relation per order: a customer of a nation places it at a date with a priority."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey").cast("string")
    return rows.select(
        key.alias("relation_id"),
        F.concat(F.lit("batch-"), (F.col("o_orderkey") % 100).cast("string")).alias("document_id"),
        F.concat(F.lit("Customer "), "c_name", F.lit(" placed order "), key).alias("description"),
        ((F.col("o_orderkey") % 100) / 100).alias("confidence"),
        F.lit("DYNAMIC").alias("axis"),
        F.lit("PLACED").alias("verb"),
        F.lit("purchase order").alias("target_category"),
        F.lit("a customer places an order").alias("definition"),
        "o_orderkey",
        "c_name",
        "n_name",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        "o_orderpriority",
    )


def order_fillers(rel: DataFrame) -> DataFrame:
    """Their fillers: some without theme, some with a generic label, some with the agent again as context."""
    k = F.col("o_orderkey")
    return R.role_fillers(
        rel,
        [
            R.filler("agent", F.lit("Customer"), F.col("c_name")),
            F.when(k % 17 != 0, R.filler("theme", F.when(k % 11 == 0, "Document").otherwise("Order"), F.concat(F.lit("Order "), F.col("relation_id")))),
            R.filler("instrument", F.lit("Priority"), F.col("o_orderpriority")),
            F.when(k % 13 == 0, R.filler("context", F.lit("CUSTOMER"), F.upper("c_name"))),
            R.filler("time", F.lit("Date"), F.col("day")),
            R.filler("location", F.lit("Nation"), F.col("n_name"), pos=1),
        ],
    )


RELATIONS = """
rel AS MATERIALIZED (SELECT o_orderkey::VARCHAR AS relation_id, 'batch-' || (o_orderkey % 100)::VARCHAR AS document_id, 'Customer ' || c_name || ' placed order ' || o_orderkey::VARCHAR AS description,
  (o_orderkey % 100)::DOUBLE / 100 AS confidence, 'DYNAMIC' AS axis, 'PLACED' AS verb, 'purchase order' AS target_category, 'a customer places an order' AS definition,
  o_orderkey, c_name, n_name, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
FILLERS = (
    RELATIONS
    + """,
fil0 AS (
  SELECT relation_id, 0 AS role_group, 'agent' AS role, 0 AS pos, 'Customer' AS label, c_name AS name FROM rel
  UNION ALL SELECT relation_id, 1, 'theme', 0, CASE WHEN o_orderkey % 11 = 0 THEN 'Document' ELSE 'Order' END, 'Order ' || relation_id FROM rel WHERE o_orderkey % 17 <> 0
  UNION ALL SELECT relation_id, 2, 'instrument', 0, 'Priority', o_orderpriority FROM rel
  UNION ALL SELECT relation_id, 3, 'context', 0, 'CUSTOMER', upper(c_name) FROM rel WHERE o_orderkey % 13 = 0
  UNION ALL SELECT relation_id, 5, 'time', 0, 'Date', day FROM rel
  UNION ALL SELECT relation_id, 5, 'location', 1, 'Nation', n_name FROM rel),
fil AS MATERIALIZED (SELECT *, label || ' entity.' AS definition, 1.0::DOUBLE AS confidence FROM fil0)"""
)


#: Words of a passage by which it is looked for in documents, and passages up to which their hashes are broadcast.
SHINGLE, BROADCAST_PASSAGES = 8, 100_000


def _runs(text: Column) -> Column:
    """Hashes of all runs of words; the text is split once and the words are bound before the runs are cut."""
    runs = lambda words: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
    return F.get(F.transform(F.array(F.split(text, r"(?U)\s+")), runs), F.lit(0))


def contained_passages(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``doc_id, item_id`` of passages that documents have word for word: they meet on a run of the passage's words, behind its first, and the text is then looked at.

    Passages of fewer words than a run and one more meet all documents, as a stated set.
    """
    long = F.size(F.split("quote", r"(?U)\s+")) > SHINGLE + 1
    keys = marks.where(long).select("item_id", "quote", F.element_at(_runs(F.col("quote")), 2).alias("run"))
    if marks.count() <= BROADCAST_PASSAGES:
        keys = F.broadcast(keys)
    runs = docs.select("doc_id", "text", F.explode(F.array_distinct(_runs(F.col("text")))).alias("run"))
    found = runs.join(keys, "run").where(F.contains("text", F.col("quote"))).select("doc_id", "item_id")
    few = docs.join(F.broadcast(marks.where(~long)), F.contains("text", F.col("quote"))).select("doc_id", "item_id")
    return found.unionByName(few).distinct()


def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark passages that a document contains, and for each document the first 60 characters of the next one.

    Rows of one ``doc_id`` are documents of their own, each with the passages that its text has.
    """
    docs, marks = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))
    told = contained_passages(docs, marks).join(marks, "item_id").select("doc_id", F.lit(True).alias("_in"), F.concat_ws("-", F.col("doc_id").cast("string"), F.col("item_id").cast("string")).alias("relation_id"), "quote")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.lit(False).alias("_in"), F.concat((F.col("doc_id") - 1).cast("string"), F.lit("-next")).alias("relation_id"), F.substring("text", 1, 60).alias("quote"))
    rows = told.unionByName(after).join(docs, "doc_id").where(~F.col("_in") | F.contains("text", F.col("quote")))
    return rows.select("relation_id", F.lit(0).alias("ev_pos"), F.col("doc_id").cast("string").alias("document_id"), "quote", "text")


EVIDENCE = """
ev AS (SELECT d.doc_id::VARCHAR || '-' || item_id::VARCHAR AS relation_id, 0 AS ev_pos, d.doc_id::VARCHAR AS document_id, b.text AS quote, d.text AS text
    FROM documents d JOIN benchmark b ON contains(d.text, b.text)
  UNION ALL SELECT d.doc_id::VARCHAR || '-next', 0, d.doc_id::VARCHAR, n.text[1:60], d.text FROM documents d JOIN documents n ON n.doc_id = d.doc_id + 1)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")


VECTORS = "vec AS (SELECT vec_id::VARCHAR AS id, embedding, label FROM embeddings)"
COSINE = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / ((sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) + 1e-12) * (sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])) + 1e-12))"


def cosine_sql(a: str, b: str) -> str:
    return COSINE.format(a=a, b=b)


def id_sql(**fields: str) -> str:
    body = " || '\", \"".join(f"{k}\": \"' || {v}" for k, v in sorted(fields.items()))
    return f"substr(sha256('{{\"{body} || '\"}}'), 1, 16)"
