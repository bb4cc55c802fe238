"""Corpus pipeline: language ID, line dedup, near-duplicate documents, source mixing,
packing. Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet into the shared checkpoint folder and reads it back. The stages that
hand texts to Python workers bound the session's Arrow batches (``small_batches``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharmlake.llm import language_id, line_dedup, mixing, ngram_join, packing
from pharmlake.llm.tables import read, small_batches, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter, or words labelled with a mean
    confidence below 0.5. Texts in several languages stay."""
    small_batches(spark)
    return _documents(language_id.keep_identified(docs, min_confidence=0.5))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that match an earlier line; a document that loses all its words
    this way is a copy and goes. ``n_chars`` is counted anew."""
    small_batches(spark)
    out = line_dedup.line_dedup(docs, min_words=1)
    empty = (F.size("removed_lines") > 0) & (F.trim(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " ")) == "")
    out = out.where(~F.coalesce(empty, F.lit(False)))
    counted = F.when(F.size("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return _documents(out.withColumn("n_chars", counted))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the first in the order (doc_id
    with nulls last, hash of the text), and of repeated rows with that doc_id and text one,
    the smallest by the other columns."""
    small_batches(spark)
    groups = stored(ngram_join.members(docs), "groups").where("n_shingles > 0")
    named = F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("tid").eqNullSafe(F.col("component_tid"))
    key = [F.col("doc_id").alias("key_id"), F.col("tid").alias("key_tid")]
    gone = groups.where(~named).select(*key).distinct()
    repeated = groups.where(named).groupBy(*key).count().where("count > 1").drop("count")
    rows = docs.select(F.struct(*[c for c in COLUMNS if c != "text"], "text").alias("row"),
                       F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("tid"))
    same = F.col("id").eqNullSafe(F.col("key_id")) & (F.col("tid") == F.col("key_tid"))
    kept = rows.join(gone.union(repeated), same, "left_anti").select("row")
    once = rows.join(repeated, same, "left_semi").groupBy("id", "tid").agg(F.min("row").alias("row")).select("row")
    return kept.union(once).select(*[F.col(f"row.{c}") for c in COLUMNS])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources (at most two epochs) towards equal weights."""
    return _documents(mixing.mix(docs, max_repeats=2.0))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("ngram_join", dedup_documents),
          ("mixing", mix_sources), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
