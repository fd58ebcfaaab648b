"""Sources, sinks and run history. Every order stands for a finished run."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftlake.plans import testbed as tb
from liftlake.plans.registry import query
from liftlake.session import new_table_path
from liftlake.sources import runs as history
from liftlake.sources import tables


def runs(spark, sf_dir):
    k = F.col("o_orderkey")
    return tb.table(spark, sf_dir, "orders").select(
        k.alias("run_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_custkey") % 3 == 0, 0).otherwise(F.col("o_custkey")).alias("dataset_id"),
        F.concat(F.lit("dataset "), F.col("o_custkey").cast("string")).alias("dataset_name"),
        F.col("o_orderpriority").alias("prompt"),
        F.when(F.col("o_orderstatus") == "F", "NO_GO").when(F.col("o_orderstatus") == "O", "GO").otherwise("INCONCLUSIVE").alias("decision"),
        F.when(k % 3 == 0, "HIGH").otherwise("MEDIUM").alias("confidence"),
        F.concat(F.lit("metric "), (k % 4).cast("string")).alias("primary_metric"),
        F.when(k % 5 == 0, F.col("o_custkey") % 100).alias("definition_id"),
        F.struct(F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status")).alias("report"),
    )


RUNS = """WITH ru AS (SELECT o_orderkey AS run_id, o_orderdate AS created_at, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS dataset_id, 'dataset ' || o_custkey AS dataset_name, o_orderpriority AS prompt,
  CASE o_orderstatus WHEN 'F' THEN 'NO_GO' WHEN 'O' THEN 'GO' ELSE 'INCONCLUSIVE' END AS decision, CASE WHEN o_orderkey % 3 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, 'metric ' || (o_orderkey % 4) AS primary_metric,
  CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 100 END AS definition_id FROM orders)"""


@query("sources_csv_roundtrip", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS user_id, s_name, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def csv_roundtrip(spark, sf_dir):
    """Written as CSV, read back with a string id schema: leading zeros survive."""
    folder = new_table_path(spark, "suppliers")
    rows = tb.table(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("user_id"), "s_name", "s_nationkey", "s_acctbal")
    rows.write.option("header", True).csv(folder)
    back = tables.read_csv(spark, folder, "user_id string, s_name string, s_nationkey int, s_acctbal double")
    return back.withColumn("s_acctbal", F.round("s_acctbal", 2))


@query("sources_dataset_catalog", "SELECT 'orders' AS dataset, count(*) AS n_rows FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def dataset_catalog(spark, sf_dir):
    known = tables.DatasetCatalog(spark)
    for name in ("orders", "events"):
        known.add(name, "parquet", f"{sf_dir}/{name}.parquet")
    a, b = (known.load(n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("dataset"), "n_rows") for n in ("orders", "events"))
    return a.unionByName(b)


@query("history_append", RUNS + " SELECT decision, count(*) AS n_runs, count(DISTINCT dataset_id) AS n_datasets FROM ru GROUP BY 1")
def append(spark, sf_dir):
    """Appended in two batches, one of them retried, then read back."""
    back = history.read_runs(spark, _stored(spark, sf_dir))
    return back.groupBy("decision").agg(F.count(F.lit(1)).alias("n_runs"), F.count_distinct("dataset_id").alias("n_datasets"))


def _stored(spark, sf_dir) -> str:
    folder = new_table_path(spark, "runs")
    early = F.col("created_at") < F.lit("1998-01-01").cast("timestamp")
    for batch, held in (("early", early), ("late", ~early), ("early", early)):
        history.append_runs(runs(spark, sf_dir).filter(held), folder, batch)
    return folder


@query("history_compacted_dataset", RUNS + " SELECT run_id, prompt, decision, primary_metric, definition_id FROM ru WHERE dataset_id = 0")
def compacted_dataset(spark, sf_dir):
    """The runs of one dataset, a third of all, from a table whose batches were rewritten as one."""
    folder = _stored(spark, sf_dir)
    history.compact_runs(spark, folder, "all")
    return history.read_runs(spark, folder, 0).select("run_id", "prompt", "decision", "primary_metric", "definition_id")


@query(
    "history_recent",
    RUNS + " SELECT run_id, CAST(epoch_us(created_at) AS BIGINT) AS created_us, dataset_id, dataset_name, prompt, decision, confidence, primary_metric FROM ru",
)
def recent(spark, sf_dir):
    return history.recent_runs(runs(spark, sf_dir)).withColumn("created_us", F.unix_micros(F.col("created_at").cast("timestamp"))).drop("created_at")


@query("history_recent_page", RUNS + " SELECT run_id, decision, primary_metric FROM ru ORDER BY created_at DESC, run_id LIMIT 50")
def recent_page(spark, sf_dir):
    """A top-k report: the 50 newest runs."""
    return history.recent_runs(runs(spark, sf_dir), 50).select("run_id", "decision", "primary_metric")


@query(
    "history_related",
    RUNS
    + """, nw AS (SELECT run_id, dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, run_id) AS rn FROM ru),
c AS (SELECT ru.run_id, ru.dataset_id, nw.run_id AS related_id, nw.rn FROM ru JOIN nw ON nw.dataset_id = ru.dataset_id AND nw.rn <= 6 AND nw.run_id <> ru.run_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY rn) AS INTEGER) AS related_rank FROM c)
SELECT run_id, dataset_id, related_rank, related_id FROM r WHERE related_rank <= 5""",
)
def related(spark, sf_dir):
    return history.related_runs(runs(spark, sf_dir))


@query("history_of_definition", RUNS + " SELECT definition_id, run_id, decision, primary_metric FROM ru WHERE definition_id IS NOT NULL")
def of_definition(spark, sf_dir):
    return history.runs_of_definition(runs(spark, sf_dir)).select("definition_id", "run_id", "decision", "primary_metric")


@query(
    "history_rollup",
    RUNS
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, run_id DESC) AS rn, count(*) OVER (PARTITION BY dataset_id) AS n_runs FROM ru)
SELECT dataset_id, n_runs, CAST(epoch_us(created_at) AS BIGINT) AS last_run_us, run_id AS last_run_id, primary_metric AS last_metric FROM n WHERE rn = 1""",
)
def rollup(spark, sf_dir):
    r = history.dataset_rollup(runs(spark, sf_dir))
    return r.withColumn("last_run_us", F.unix_micros(F.col("last_run_at").cast("timestamp"))).drop("last_run_at")


@query(
    "content_canonical_ids",
    "SELECT doc_id AS row_id, sha256(text) AS content_hash, min(doc_id) OVER (PARTITION BY text) AS canonical_id, count(*) OVER (PARTITION BY text) AS n_copies FROM documents",
)
def canonical(spark, sf_dir):
    return history.content_ids(tb.table(spark, sf_dir, "documents"), "doc_id", "text")


@query("content_distinct", "SELECT sha256(text) AS content_hash, min(doc_id) AS canonical_id, count(*) AS n_copies FROM documents GROUP BY text")
def distinct_contents(spark, sf_dir):
    return history.distinct_contents(tb.table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "history_orphans",
    "SELECT p_partkey AS dataset_key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40) AND p_partkey NOT IN (SELECT s_suppkey FROM supplier)",
)
def orphans(spark, sf_dir):
    """Parts named by neither reference set."""
    parts = tb.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("dataset_key"))
    used = tb.table(spark, sf_dir, "lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)).select(F.col("l_partkey").alias("dataset_key"))
    held = tb.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("dataset_key"))
    return history.orphans(parts, "dataset_key", [used, held])


@query(
    "history_orphans_aged",
    "SELECT c_custkey AS dataset_key, CAST(epoch_us(first_seen) AS BIGINT) AS first_us FROM (SELECT c_custkey, min(o_orderdate) AS first_seen FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) WHERE first_seen < TIMESTAMP '1996-01-01' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def orphans_aged(spark, sf_dir):
    seen = (
        tb.table(spark, sf_dir, "customer")
        .join(tb.table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
        .groupBy(F.col("c_custkey").alias("dataset_key"))
        .agg(F.min("o_orderdate").alias("first_seen"))
    )
    used = tb.table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("dataset_key"))
    old = history.orphans(seen, "dataset_key", [used], "first_seen", "1996-01-01")
    return old.select("dataset_key", F.unix_micros(F.col("first_seen").cast("timestamp")).alias("first_us"))
