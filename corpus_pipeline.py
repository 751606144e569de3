"""A corpus pipeline: language, near duplicates, secrets, mixing, tokens; each stage reads what its predecessor wrote.

Every stage works on whole texts of any length, takes an empty table to an empty one, and all but the last
return the columns they were given, in their order, whatever further columns there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import language_unigrams, ngram_jaccard, secret_forest, sentencepiece_bpe, source_mixing
from kgloom.llm.queries import MIX, PIECES, domain_of
from kgloom.llm.storage import written

#: A document whose best language is less likely than this is rejected, as are those without a letter.
MIN_LANGUAGE = 0.3
NEAR = ngram_jaccard.Join(words=5, num=80, den=100)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null and empty texts, texts without a letter and those of no clear language go; rows that repeat are judged alike."""
    found = language_unigrams.identify(docs, language_unigrams.fit(docs, PIECES), into="__language")
    kept = found.where((F.col("__language.lang") != language_unigrams.UND) & (F.col("__language.score") >= MIN_LANGUAGE))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id (none is the largest); texts without words stay; of rows equal in doc_id and text one stays."""
    return ngram_jaccard.one_of_each(docs, NEAR)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and ``n_chars`` counted anew; null texts stay null, and a share of trees equal to the threshold masks."""
    masked = secret_forest.redacted(docs, secret_forest.fit(spark))
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, each as often as it is taken; null sources and languages are one each, texts without words take no budget."""
    taken = source_mixing.mixed(docs, MIX, domain_of(F.col("source")))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document with the end id last, and whether they decode to the text; null texts are empty."""
    both = sentencepiece_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), PIECES)
    return both.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: Language models and the tokenizer are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
