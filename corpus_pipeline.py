"""A training-data pipeline over ``documents``; each stage works on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlake.llm.byte_bpe import encoding_report
from liftlake.llm.common import table
from liftlake.llm.mixture import mixed_documents
from liftlake.llm.overlap_join import overlap_groups, small_side
from liftlake.llm.secret_scan import mask_secrets, train_models
from liftlake.llm.toxicity import accepted_documents, train
from liftlake.session import batch_by_bytes, materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity model rejects go."""
    batch_by_bytes(spark)
    return accepted_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the smallest doc_id (a null one last), once if it is repeated.

    Texts are linked, not ids: rows without a doc_id, and rows whose doc_id has several texts, get keys of their own,
    a 64-bit digest of id and text.
    """
    batch_by_bytes(spark)
    digests = docs.where("doc_id is not null").groupBy("doc_id").agg(*[f(F.xxhash64(F.col("text").isNull(), "text")).alias(f.__name__) for f in (F.min, F.max)])
    several = small_side(materialize(digests.where("min <> max").select(F.col("doc_id").alias("__several"))))
    marked = docs.join(several, docs.doc_id == several["__several"], "left")
    own = F.col("doc_id").isNull() | F.col("__several").isNotNull()
    marked = marked.withColumn("__own", own).withColumn("__row", F.when(own, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")).otherwise(F.col("doc_id")))
    plain = marked.where("not __own").select(*docs.columns, "__row")
    odd = materialize(marked.where("__own").dropDuplicates(["__row"]).select(*docs.columns, "__row"))

    rows = plain.select(F.col("__row").alias("doc_id"), "text").unionByName(odd.select(F.col("__row").alias("doc_id"), "text"))
    groups = materialize(overlap_groups(rows))
    # of groups with such rows, the smallest key need not be that of the smallest doc_id
    names = odd.select(F.col("__row").alias("doc_id"), F.col("doc_id").alias("__id"), F.lit(True).alias("__odd"))
    order = F.struct((F.col("__odd").isNotNull() & F.col("__id").isNull()).alias("last"), F.coalesce("__id", "doc_id").alias("id"), "doc_id")
    mixed = groups.join(names, "doc_id", "left").groupBy("component_id").agg(F.min(order).alias("first"), F.max(F.coalesce("__odd", F.lit(False))).alias("odd"))
    mixed = materialize(mixed.where("odd").select("component_id", F.col("first.doc_id").alias("__first")))
    groups = groups.join(mixed, "component_id", "left").withColumn("__first", F.coalesce("__first", "component_id"))
    copies = small_side(materialize(groups.where("doc_id <> __first").select(F.col("doc_id").alias("__row")).distinct()))
    repeated = small_side(materialize(groups.groupBy(F.col("doc_id").alias("__row")).count().where("count > 1").select("__row")))
    kept = plain.join(copies, "__row", "left_anti")
    once = kept.join(repeated, "__row", "left_anti").unionByName(kept.join(repeated, "__row", "left_semi").dropDuplicates(["__row"]))
    return once.unionByName(odd.join(copies, "__row", "left_anti")).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's characters become as many ``*``; the documents stay, n_chars with them."""
    batch_by_bytes(spark)
    return mask_secrets(docs, train_models(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, as documents: a row for each time that a document, or a part of it, is taken."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded bytes of each row of the mix."""
    batch_by_bytes(spark)
    return encoding_report(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
    ("byte_bpe", encoding),
]

#: Toxicity scores and byte-level BPE have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
