"""One query per operator of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import language_unigrams, license_rules, media_png, ngram_jaccard, secret_forest, sentencepiece_bpe, source_mixing, toxicity_compression, warc_bundles, weighted_sampling

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int, which: int) -> Column:
    """Whether a document is in the fold whose labels are held back."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == which, F.lit(False))


#: The mix of the production query: three domains by the source's number, four languages, equal sources.
MIX = source_mixing.MixPlan(weights={"domain": {"web": 5, "forum": 3, "reference": 2}, "lang": {"en": 5, "fr": 2, "de": 2, "es": 1}})


def domain_of(source: Column) -> Column:
    number = F.regexp_extract(source, r"^src(\d{1,9})$", 1).try_cast("int")
    return F.when(number % 3 == 0, "web").when(number % 3 == 1, "forum").otherwise("reference")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = source_mixing.mixed(docs, MIX, domain_of(F.col("source")))
    return out.select("doc_id", "domain_key", "lang", "source", "n_tokens", "copies")


OP1_SQL = """
WITH t AS (
  SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s,
         CASE TRY_CAST(regexp_extract(source, '^src([0-9]{1,9})$', 1) AS INT) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'forum' ELSE 'reference' END AS d,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n
  FROM documents),
leaf AS (SELECT d, l, s, sum(n)::BIGINT AS tokens, (sum(n) * 2)::BIGINT AS cap FROM t GROUP BY 1, 2, 3),
dn AS (SELECT d, sum(cap)::BIGINT AS cap, CASE d WHEN 'web' THEN 5 WHEN 'forum' THEN 3 ELSE 2 END AS w,
         (SELECT (coalesce(sum(tokens), 0) * 60)::BIGINT // 100 FROM leaf) AS budget FROM leaf GROUP BY 1),
d1 AS (SELECT *, cap * sum(w) OVER (ORDER BY cap / w, d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= w * (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS f FROM dn),
d2 AS (SELECT d, (CASE WHEN f THEN cap ELSE ((budget - sum(CASE WHEN f THEN cap ELSE 0 END) OVER ()) * w)::BIGINT // nullif(sum(CASE WHEN f THEN 0 ELSE w END) OVER (), 0)::BIGINT END)::BIGINT AS budget FROM d1),
ln AS (SELECT d, l, sum(cap)::BIGINT AS cap, CASE l WHEN 'en' THEN 5 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 ELSE 1 END AS w, any_value(budget) AS budget
       FROM leaf JOIN d2 USING (d) GROUP BY 1, 2),
l1 AS (SELECT *, cap * sum(w) OVER (PARTITION BY d ORDER BY cap / w, l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= w * (budget - coalesce(sum(cap) OVER (PARTITION BY d ORDER BY cap / w, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS f FROM ln),
l2 AS (SELECT d, l, (CASE WHEN f THEN cap ELSE ((budget - sum(CASE WHEN f THEN cap ELSE 0 END) OVER (PARTITION BY d)) * w)::BIGINT // nullif(sum(CASE WHEN f THEN 0 ELSE w END) OVER (PARTITION BY d), 0)::BIGINT END)::BIGINT AS budget FROM l1),
s1 AS (SELECT leaf.*, budget, cap * count(*) OVER (PARTITION BY d, l ORDER BY cap / 1, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= budget - coalesce(sum(cap) OVER (PARTITION BY d, l ORDER BY cap / 1, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f
       FROM leaf JOIN l2 USING (d, l)),
s2 AS (SELECT d, l, s, tokens, (CASE WHEN f THEN cap ELSE (budget - sum(CASE WHEN f THEN cap ELSE 0 END) OVER (PARTITION BY d, l))::BIGINT // nullif(sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY d, l), 0)::BIGINT END)::BIGINT AS given FROM s1),
p AS (SELECT t.*, given // tokens AS whole, given % tokens AS rest FROM t JOIN s2 USING (d, l, s) WHERE tokens > 0),
q AS (SELECT *, sum(n) OVER (PARTITION BY d, l, s ORDER BY md5('17:' || whole || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM p)
SELECT doc_id, d AS domain_key, lang, source, n AS n_tokens, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::INT AS copies
FROM q WHERE whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = media_png.store_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    read = media_png.read_media(docs)
    payload = F.col("image.payload")
    return read.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("image.dct_hash")).alias("feature"),
        F.col("image.status").alias("status"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_forest.findings(table(spark, sf_dir, "documents"), secret_forest.fit(spark))
    return found.select("doc_id", "start", "end", F.sha2("candidate", 256).alias("candidate_sha256"), "chance", "is_secret")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_jaccard.similar_groups(table(spark, sf_dir, "documents"), ngram_jaccard.Join(words=4, num=85, den=100))
    return found.select("doc_id", "n_shingles", "component_id")


OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] ELSE list_transform(range(1, greatest(1, len(ws) - 3) + 1), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
b AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.b, r.c FROM r JOIN b ON b.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM r GROUP BY 1) m ON m.v = d.doc_id
"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = sentencepiece_bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = warc_bundles.write_bundles(table(spark, sf_dir, "pages"))
    return warc_bundles.read_bundles(bundles).select(*warc_bundles.record_rows(bundles))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT *, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to
FROM q
"""


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.compared(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4, 2)
    model = language_unigrams.fit(docs.where(~held), PIECES)
    found = language_unigrams.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scanned(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 3, 1)
    model = toxicity_compression.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity_compression.flagged(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op2_media``."""
    return op2_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "status")


MEDIA_SQL = """
SELECT doc_id, n AS n_bytes, n + pad AS payload_bytes, sha256(t || repeat(' ', pad)) AS payload_sha256, 'ok' AS status
FROM (SELECT doc_id, t, n, CASE WHEN n = 0 THEN 192 ELSE (192 - n % 192) % 192 END AS pad FROM (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents))
"""


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op7_fingerprint``."""
    return op7_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n FROM documents),
x AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS after FROM d)
SELECT doc_id, n AS n_chars, sha256(substr(t, 1, n - n // 2) || substr(after, 1, n // 2)) AS edited_sha256 FROM x
"""


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op9_licenses``."""
    return op9_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


BASE_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, len(ws)::BIGINT AS n,
  list_filter(range(0, len(ws)), lambda i: ws[i + 1] = 'mit' AND ws[i + 2] = 'license') AS mit,
  list_filter(range(0, len(ws)), lambda i: ws[i + 1] = 'apache' AND ws[i + 2] = 'license') AS apache,
  list_filter(range(0, len(ws)), lambda i: ws[i + 1] = 'general' AND ws[i + 2] = 'public' AND ws[i + 3] = 'license') AS gpl FROM w),
q AS (SELECT *, list_concat(mit, apache, gpl) AS places FROM p)
SELECT doc_id, n AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  array_to_string(list_filter([CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM q
"""


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_media": op2_media,
    "op3_secrets": op3_secrets,
    "op4_jaccard": op4_jaccard,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_warc": op6_warc,
    "op7_fingerprint": op7_fingerprint,
    "op8_language": op8_language,
    "op9_licenses": op9_licenses,
    "op10_toxicity": op10_toxicity,
    "media_payloads": media_payloads,
    "fingerprint_edits": fingerprint_edits,
    "license_base": license_base,
}
ORACLES = {"op1_mixing": OP1_SQL, "op4_jaccard": OP4_SQL, "op6_warc": OP6_SQL, "media_payloads": MEDIA_SQL, "fingerprint_edits": EDITS_SQL, "license_base": BASE_SQL}
