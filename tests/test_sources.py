"""Run history and row ids on files."""

import pytest
from pyspark.sql import functions as F

from liftlake.operators import units
from liftlake.plans import corpus_queries
from liftlake.plans import testbed as tb
from liftlake.sources import runs as history


def some_runs(spark, first, last, datasets=40):
    ids = spark.range(first, last)
    third = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), (F.col("id") % datasets).cast("string")))
    return ids.select(F.col("id").alias("run_id"), third.alias("dataset_id"), (F.col("id") % 7).alias("confidence"), F.struct("id").alias("report"))


def test_a_retried_append_is_no_second_copy(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert history.append_runs(some_runs(spark, 0, 500), path, "a")
    assert history.append_runs(some_runs(spark, 500, 800), path, "b")
    assert not history.append_runs(some_runs(spark, 0, 500), path, "a")
    assert sorted(r.run_id for r in history.read_runs(spark, path).collect()) == list(range(800))


def test_an_append_that_was_cut_off_is_not_read(spark, tmp_path):
    path = str(tmp_path / "runs")
    history.append_runs(some_runs(spark, 0, 100), path, "a")
    some_runs(spark, 100, 200).withColumn("__bucket", F.lit(0)).write.partitionBy("__bucket").parquet(f"{path}/data/__folder=leftover")
    assert history.read_runs(spark, path).count() == 100
    assert history.append_runs(some_runs(spark, 100, 200), path, "b")
    assert history.read_runs(spark, path).count() == 200


def test_two_commits_of_one_batch_count_once(spark, tmp_path):
    path = str(tmp_path / "runs")
    for _ in range(2):  # as two appends that both saw no commit
        history._write_batch(some_runs(spark, 0, 100), path, "a", 4, [])
    assert history.read_runs(spark, path).count() == 100


def test_one_dataset_reads_one_bucket(spark, tmp_path):
    path = str(tmp_path / "runs")
    history.append_runs(some_runs(spark, 0, 900), path, "a")
    held = history.read_runs(spark, path, "hot")
    assert {r.run_id for r in held.collect()} == set(range(0, 900, 3))
    files = held.select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    assert len({r.f.split("__bucket=")[1].split("/")[0] for r in files}) == 1 and 1 < len(files) <= history.SPREAD
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__bucket" in plan
    assert history.read_runs(spark, path, "none").count() == 0


def test_compaction_keeps_rows_and_retries_out(spark, tmp_path):
    path = str(tmp_path / "runs")
    for k in range(3):
        history.append_runs(some_runs(spark, 100 * k, 100 * k + 100), path, f"day{k}")
    assert history.compact_runs(spark, path, "days") and not history.compact_runs(spark, path, "days")
    assert len(history._visible(spark, path)) == 1
    assert not history.append_runs(some_runs(spark, 0, 100), path, "day0")
    history.append_runs(some_runs(spark, 300, 400).withColumn("note", F.lit("new")), path, "day3", buckets=4)
    back = history.read_runs(spark, path)
    assert sorted(r.run_id for r in back.collect()) == list(range(400)) and back.where("note = 'new'").count() == 100
    assert {r.run_id for r in history.read_runs(spark, path, "hot").collect()} == set(range(0, 400, 3))


def test_an_empty_history_says_so(spark, tmp_path):
    with pytest.raises(ValueError, match="no runs"):
        history.read_runs(spark, str(tmp_path / "none"))


def test_row_ids_do_not_depend_on_partitions(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(5000).select((F.col("id") % 50).alias("v"), F.col("id").alias("k")).repartition(7, "k").write.option("parquet.block.size", 4096).parquet(path)
    rows, name = units.with_implicit_unit(spark.read.parquet(path), scanned=True)
    one = {(r.k, r[name]) for r in rows.collect()}
    assert sorted(i for _, i in one) == list(range(5000))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        again, _ = units.with_implicit_unit(spark.read.parquet(path), scanned=True)
        assert again.rdd.getNumPartitions() != rows.rdd.getNumPartitions()
        assert {(r.k, r[name]) for r in again.collect()} == one
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    some, _ = units.with_implicit_unit(spark.read.parquet(path).filter("v = 3").select("k"), scanned=True)
    ids = [r[name] for r in some.collect()]
    assert len(set(ids)) == len(ids) == 100


def test_row_ids_beyond_the_broadcast_bound_and_of_derived_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(units, "BROADCAST_FILES", 0)
    rows = spark.range(300).select((F.col("id") % 3).alias("__experiment_unit_row_id__"), F.lit("x").alias("a.b"))
    out, name = units.with_implicit_unit(rows)
    assert name == "___experiment_unit_row_id__" and out.columns == [*rows.columns, name]
    assert sorted(r[name] for r in out.collect()) == list(range(300)) == sorted(r[name] for r in out.collect())
    none, _ = units.with_implicit_unit(rows.limit(0))
    assert none.count() == 0


def test_an_index_follows_its_documents(spark, tmp_path):
    def write(*texts):
        docs = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))

    write("pelican harbour")
    before = tb.version(spark, str(tmp_path), "documents")
    old = corpus_queries.index(spark, str(tmp_path))[0].select("term").distinct().count()
    assert corpus_queries.index(spark, str(tmp_path)) is corpus_queries.index(spark, str(tmp_path))
    write("pelican harbour", "lantern orchard meadow")
    assert tb.version(spark, str(tmp_path), "documents") != before
    assert corpus_queries.index(spark, str(tmp_path))[0].select("term").distinct().count() == old + 3
