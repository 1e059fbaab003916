"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, tokens.

Every stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and returns those that it
keeps, the last one token ids.  Each result is written as Parquet into the shared folder and read again.
Stages decide about rows, not ids: rows that repeat an id with another text, or have none, are each judged for themselves.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import byte_bpe, common, decontam, near_dup, quality, secret_scan

#: No DuckDB SQL states the language model or the tokens; the tests hold each stage against brute force.
ORACLE_SQL = None


def _ready(spark: SparkSession) -> None:
    """What every stage with Python workers needs: the package, and Arrow batches that leave room for the other stages' memory."""
    common.ship(spark)
    common.small_batches(spark)


def _marked(docs: DataFrame) -> DataFrame:
    """With ``_t``, a hash of the text; rows equal in id and text share verdicts, rows that only share an id do not."""
    return docs.withColumn("_t", F.xxhash64("text"))


def _join(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` with (``left_semi``) or without (``left_anti``) the rows of ``doc_id, _t``; null ids are ids like any."""
    rows = rows.distinct()
    rows = common.broadcast_if(rows.select(F.col("doc_id").alias("_id"), F.col("_t").alias("_u")), rows.count())
    return docs.join(rows, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_u")), how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and lie within their language's perplexity band."""
    _ready(spark)
    judged, _ = common.write_shared(spark, quality.judge(docs).where("not kept").select("doc_id", F.col("row_key").alias("_t")), "judged")
    return _join(docs.withColumn("_t", F.xxhash64("doc_id", "lang", "text")), judged, "left_anti").drop("_t")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of five-word shingle similarity 0.8 or more: of those with the least id the one of least text hash.

    Repeated rows (equal id and text) leave one; rows without words are in no group and stay.
    """
    _ready(spark)
    found = near_dup.near_duplicates(docs, near_dup.Rule(words=5, percent=80), keys=True).where("root is not null")
    size = common.ROW_BYTES * docs.count()
    found, _ = common.write_shared(spark, found.select("doc_id", F.col("t").alias("_t"), "root"), "groups", size)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_t")).alias("r")).select("root", "r.doc_id", "r._t")
    first, _ = common.write_shared(spark, first, "first", size)
    marked, of = _marked(docs), ["doc_id", "_t"]
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_u"))
    kept = first.select(F.col("doc_id").alias("_id"), F.col("_t").alias("_u"))
    gone = found.select(*of).distinct().join(common.broadcast_if(kept, first.count()), same, "left_anti")
    marked = _join(marked, gone, "left_anti")
    again = found.groupBy(*of).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*of)
    again, _ = common.write_shared(spark, again, "again", size)
    return _join(marked, again, "left_anti").unionByName(_join(marked, again, "left_semi").dropDuplicates(of)).drop("_t")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    _ready(spark)
    docs = _marked(docs)
    found, _ = common.write_shared(spark, decontam.find_items(docs, common.table(spark, sf_dir, "benchmark"), keep=("doc_id", "_t")).select("doc_id", "_t"), "leaks")
    return _join(docs, found, "left_anti").drop("_t")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced and ``n_chars`` counted anew."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids, round_trip`` of every document."""
    import public_tokenizers

    _ready(spark)
    how = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.encode_and_check(docs, *how, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scan", secrets),
    ("byte-level bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the table ``documents``."""
    docs, old = common.table(spark, sf_dir, "documents"), None
    batches = common.small_batches(spark)
    try:
        for name, stage in STAGES:
            docs, path = common.write_shared(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
            if old:
                common.drop_shared(spark, old)
            old = path
    finally:
        spark.conf.set(common.BATCH_KEY, batches)
    return docs
