"""Run history: append-only Parquet table with a commit per batch, and the queries over it."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Hash buckets of dataset ids in a batch, and tasks that share a bucket.
BUCKETS = 16
SPREAD = 4
COMMIT = "batch string, folder string, buckets int, schema string, replaces array<string>"

SUMMARY = ["run_id", "created_at", "dataset_id", "dataset_name", "prompt", "decision", "confidence", "primary_metric"]


def append_runs(runs: DataFrame, path: str, batch: str, buckets: int = BUCKETS) -> bool:
    """Append a batch of finished runs once: False, and nothing written, if a batch of this name is committed.

    A batch is a folder of its own under ``data``, laid out by hash bucket of the dataset id, and counts
    from the moment its commit is written; what a failed or cut-off append leaves is never read. A batch has at most
    ``buckets * SPREAD`` files however many datasets there are, and a dataset with very many runs is
    written by ``SPREAD`` tasks. Two appends of one batch at the same time may both commit: readers take one of them.
    """
    commits = _commits(runs.sparkSession, path)
    if commits is not None and commits.filter(F.col("batch") == batch).limit(1).count():
        return False
    _write_batch(runs, path, batch, buckets, [])
    return True


def _write_batch(runs: DataFrame, path: str, batch: str, buckets: int, replaces: list[str]) -> None:
    spark, folder = runs.sparkSession, uuid.uuid4().hex
    laid = runs.withColumn("__bucket", _bucket(F.col("dataset_id"), buckets))
    laid = laid.repartition(buckets * SPREAD, "__bucket", F.pmod(F.xxhash64("run_id"), F.lit(SPREAD)))
    laid.write.partitionBy("__bucket").parquet(f"{path}/data/__folder={folder}")
    commit = spark.createDataFrame([(batch, folder, buckets, runs.schema.json(), replaces)], COMMIT)
    commit.coalesce(1).write.json(f"{path}/commits/{folder}")


def _bucket(dataset_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(dataset_id), F.lit(buckets)).cast("int")


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(COMMIT).option("recursiveFileLookup", True).json(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _visible(spark: SparkSession, path: str) -> list:
    """One commit per batch, without batches that a compaction replaced: a short list, one row per batch."""
    commits = _commits(spark, path)
    if commits is None:
        return []
    first = commits.groupBy("batch").agg(F.min(F.struct("folder", "buckets", "schema", "replaces")).alias("c")).select("batch", "c.*").collect()
    replaced = {folder for row in first for folder in row.replaces}
    return sorted((row for row in first if row.folder not in replaced), key=lambda row: row.folder)


def read_runs(spark: SparkSession, path: str, dataset_id=None) -> DataFrame:
    """All committed runs, or those of one dataset: then only its bucket's files are read."""
    visible = _visible(spark, path)
    if not visible:
        raise ValueError(f"no runs are committed in {path}")
    out = None
    for buckets, schema in sorted({(row.buckets, row.schema) for row in visible}):
        kind = StructType.fromJson(json.loads(schema))
        folders = [f"{path}/data/__folder={row.folder}" for row in visible if (row.buckets, row.schema) == (buckets, schema)]
        kind_and_place = StructType([*kind.fields, StructField("__folder", StringType()), StructField("__bucket", IntegerType())])
        part = spark.read.schema(kind_and_place).option("basePath", f"{path}/data").parquet(*folders)
        if dataset_id is not None:
            wanted = F.lit(dataset_id).cast(kind["dataset_id"].dataType)
            part = part.filter((F.col("__bucket") == _bucket(wanted, buckets)) & (F.col("dataset_id") == wanted))
        part = part.drop("__folder", "__bucket")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def compact_runs(spark: SparkSession, path: str, batch: str, buckets: int = BUCKETS) -> bool:
    """Rewrite all committed batches as one, under a new name; False if it is committed or there are fewer than two.

    The commit of the new batch names the folders that it replaces, so readers see either them or it.
    Batches that were replaced stay known: a late retry of one of them is still no second copy. One compaction at a time.
    """
    visible = _visible(spark, path)
    if len(visible) < 2 or _commits(spark, path).filter(F.col("batch") == batch).limit(1).count():
        return False
    _write_batch(read_runs(spark, path), path, batch, buckets, [row.folder for row in visible])
    return True


def recent_runs(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first, metadata columns only: the nested report is never read."""
    out = runs.select(*SUMMARY).orderBy(F.desc("created_at"), "run_id")
    return out if limit is None else out.limit(limit)


def runs_of_dataset(runs: DataFrame, dataset_id: str, exclude_run: str | None = None, limit: int = 5) -> DataFrame:
    held = runs.filter(F.col("dataset_id") == dataset_id)
    if exclude_run is not None:
        held = held.filter(F.col("run_id") != exclude_run)
    return held.select(*SUMMARY).orderBy(F.desc("created_at"), "run_id").limit(limit)


def related_runs(runs: DataFrame, limit: int = 5) -> DataFrame:
    """For every run the latest other runs of its dataset.

    They are among the dataset's ``limit + 1`` latest, so each dataset keeps
    that short list (cut before the shuffle) and no run meets every other run.
    """
    newest = W.partitionBy("dataset_id").orderBy(F.desc("created_at"), "run_id")
    slim = runs.select("run_id", "dataset_id", "created_at")
    top = (
        slim.withColumn("rn", F.row_number().over(newest))
        .filter(F.col("rn") <= limit + 1)
        .groupBy("dataset_id")
        .agg(F.array_sort(F.collect_list(F.struct("rn", F.col("run_id").alias("related_id")))).alias("__top"))
    )
    others = F.slice(F.filter("__top", lambda t: t["related_id"] != F.col("run_id")), 1, limit)
    return (
        slim.join(top, "dataset_id")
        .select("run_id", "dataset_id", F.posexplode(others).alias("pos", "t"))
        .select("run_id", "dataset_id", (F.col("pos") + 1).alias("related_rank"), F.col("t.related_id").alias("related_id"))
    )


def runs_of_definition(runs: DataFrame, definition_id: str | None = None) -> DataFrame:
    held = runs.filter(F.col("definition_id").isNotNull() if definition_id is None else F.col("definition_id") == definition_id)
    return held.select("definition_id", *SUMMARY).orderBy("definition_id", F.desc("created_at"), "run_id")


def dataset_rollup(runs: DataFrame) -> DataFrame:
    last = F.max(F.struct("created_at", "run_id", "primary_metric"))
    return (
        runs.groupBy("dataset_id")
        .agg(F.count(F.lit(1)).alias("n_runs"), last.alias("l"))
        .select(
            "dataset_id",
            "n_runs",
            F.col("l.created_at").alias("last_run_at"),
            F.col("l.run_id").alias("last_run_id"),
            F.col("l.primary_metric").alias("last_metric"),
        )
    )


def content_ids(rows: DataFrame, row_id: str, content: str) -> DataFrame:
    """Canonical id per row: the first id holding the same content.

    Only contents seen more than once are joined back, so unique rows never wait
    on a match; the group table has one row per repeated hash, and a heavily
    copied content is split by the skew join.
    """
    hashed = rows.select(F.col(row_id).alias("row_id"), F.sha2(F.col(content), 256).alias("content_hash"))
    repeated = hashed.groupBy("content_hash").agg(F.min("row_id").alias("__first"), F.count(F.lit(1)).alias("n_copies")).filter(
        F.col("n_copies") > 1
    )
    return hashed.join(repeated, "content_hash", "left").select(
        "row_id",
        "content_hash",
        F.coalesce("__first", "row_id").alias("canonical_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )


def distinct_contents(rows: DataFrame, row_id: str, content: str) -> DataFrame:
    return (
        rows.groupBy(F.sha2(F.col(content), 256).alias("content_hash"))
        .agg(F.min(row_id).alias("canonical_id"), F.count(F.lit(1)).alias("n_copies"))
    )


def orphans(rows: DataFrame, key: str, references: list[DataFrame], created: str | None = None, before=None) -> DataFrame:
    """Rows no reference set names, optionally only those older than a cutoff."""
    held = rows if before is None else rows.filter(F.col(created) < F.lit(before))
    used = references[0].select(key)
    for ref in references[1:]:
        used = used.union(ref.select(key))
    return held.join(used, key, "left_anti")
