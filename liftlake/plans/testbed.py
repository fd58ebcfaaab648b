"""Experiments derived from the star-schema and event tables.

No source table has an arm column, so arms come from key parity, and effects,
imbalances and dirt are planted by deterministic rules over whole tables. Money
is summed in integer cents so that sums do not depend on row order. Each frame
has a SQL twin used by the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def version(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """A digest of path, time and size of the tables' files: what was derived from them is stale when it changes. No column is read."""
    files = None
    for name in names:
        read = table(spark, sf_dir, name).select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").distinct()
        files = read if files is None else files.unionAll(read)
    return files.agg(F.bit_xor(F.xxhash64("*"))).first()[0]


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


# --- one large experiment: customers -------------------------------------------
def customer_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer; arms by key parity, metrics from the customer's orders."""
    cut = F.lit("1996-01-01").cast("timestamp")
    late = F.col("o_orderdate") >= cut
    orders = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.sum(F.when(late, _cents("o_totalprice")).otherwise(0)).alias("post_cents"),
            F.sum(F.when(late, 0).otherwise(_cents("o_totalprice"))).alias("pre_cents"),
            F.count(F.lit(1)).alias("n_orders"),
        )
    )
    joined = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    value = F.coalesce("post_cents", F.lit(0)) / 100.0
    treated = F.col("c_custkey") % 2 == 1
    lift = F.when(treated & (F.col("c_mktsegment") == "BUILDING"), 1.25).when(treated, 1.05).otherwise(1.0)
    return joined.select(
        F.lit("orders").alias("experiment_id"),
        F.col("c_custkey").alias("unit_id"),
        F.when(treated, "treatment").otherwise("control").alias("arm"),
        F.element_at(F.array(F.lit("control"), F.lit("b"), F.lit("c")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("arm3"),
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_nationkey") % 3 == 0, "web").when(F.col("c_nationkey") % 3 == 1, "store").otherwise("phone").alias("channel"),
        F.when(F.col("c_custkey") % 50 == 0, None).otherwise(value).alias("order_value"),
        (value * lift).alias("lifted_value"),
        (F.coalesce("pre_cents", F.lit(0)) / 100.0).alias("order_value_pre"),
        (value > 2000000).cast("int").alias("converted"),
        (value * lift > 2000000).cast("int").alias("lifted_converted"),
        F.coalesce("n_orders", F.lit(0)).alias("n_orders"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").alias("nation"),
    )


CUSTOMER_UNITS = """
ord AS (
  SELECT o_custkey,
         sum(CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS post_cents,
         sum(CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN 0 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END) AS pre_cents,
         count(*) AS n_orders
  FROM orders GROUP BY o_custkey),
cu0 AS (
  SELECT *, CAST(coalesce(post_cents, 0) AS DOUBLE) / 100.0 AS v,
         CASE WHEN c_custkey % 2 = 1 AND c_mktsegment = 'BUILDING' THEN 1.25::DOUBLE WHEN c_custkey % 2 = 1 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END AS lift
  FROM customer LEFT JOIN ord ON c_custkey = o_custkey),
cu AS (
  SELECT 'orders' AS experiment_id, c_custkey AS unit_id,
         CASE WHEN c_custkey % 2 = 1 THEN 'treatment' ELSE 'control' END AS arm,
         CASE c_custkey % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'b' ELSE 'c' END AS arm3,
         c_mktsegment AS segment,
         CASE c_nationkey % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'store' ELSE 'phone' END AS channel,
         CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE v END AS order_value,
         v * lift AS lifted_value,
         CAST(coalesce(pre_cents, 0) AS DOUBLE) / 100.0 AS order_value_pre,
         CASE WHEN v > 2000000 THEN 1 ELSE 0 END AS converted,
         CASE WHEN v * lift > 2000000 THEN 1 ELSE 0 END AS lifted_converted,
         coalesce(n_orders, 0) AS n_orders, c_acctbal AS balance, c_nationkey AS nation
  FROM cu0)
"""


# --- many experiments: one per supplier ---------------------------------------------
def supplier_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One experiment per supplier, one unit per order it serves.

    Planted by supplier number: revenue lifts from -20 % to +20 %, refund harm,
    lopsided arms and missing values.
    """
    li = table(spark, sf_dir, "lineitem")
    per_order = li.groupBy(F.col("l_suppkey").alias("experiment_id"), F.col("l_orderkey").alias("unit_id")).agg(
        F.sum(_cents("l_extendedprice")).alias("cents"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("units"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("returned"),
    )
    e, u = F.col("experiment_id"), F.col("unit_id")
    # divided down so that the parity does not follow the planted rules below
    parity = F.floor(u / 3) % 2
    treated = F.when(e % 7 == 3, F.floor(u / 3) % 10 >= 6).otherwise(parity == 1)
    staged = per_order.withColumn("treated", treated)
    lift = 1.0 + 0.1 * (e % 5 - 2)
    revenue = F.col("cents") / 100.0 * F.when(F.col("treated"), lift).otherwise(1.0)
    return staged.select(
        "experiment_id",
        "unit_id",
        F.when(F.col("treated"), "treatment").otherwise("control").alias("arm"),
        F.when((e % 11 == 4) & (u % 20 == 0), None).otherwise(revenue).alias("revenue"),
        F.when(F.col("treated") & (e % 6 == 4) & (u % 3 == 0), 1).otherwise(F.col("returned")).alias("refund"),
        F.col("units").cast("double").alias("units"),
    )


SUPPLIER_UNITS = """
su0 AS (
  SELECT l_suppkey AS experiment_id, l_orderkey AS unit_id,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents,
         sum(CAST(l_quantity AS BIGINT)) AS units,
         max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned
  FROM lineitem GROUP BY 1, 2),
su1 AS (
  SELECT *, CASE WHEN experiment_id % 7 = 3 THEN (unit_id // 3) % 10 >= 6 ELSE (unit_id // 3) % 2 = 1 END AS treated FROM su0),
su AS (
  SELECT experiment_id, unit_id, CASE WHEN treated THEN 'treatment' ELSE 'control' END AS arm,
         CASE WHEN experiment_id % 11 = 4 AND unit_id % 20 = 0 THEN NULL
              ELSE CAST(cents AS DOUBLE) / 100.0 * (CASE WHEN treated THEN 1.0::DOUBLE + 0.1::DOUBLE * (experiment_id % 5 - 2) ELSE 1.0::DOUBLE END) END AS revenue,
         CASE WHEN treated AND experiment_id % 6 = 4 AND unit_id % 3 = 0 THEN 1 ELSE returned END AS refund,
         CAST(units AS DOUBLE) AS units
  FROM su1)
"""


def supplier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows with duplicates and crossovers: one row per order line."""
    parity = F.when(F.col("l_suppkey") % 4 == 0, F.col("l_linenumber") % 2).otherwise(F.floor(F.col("l_orderkey") / 3) % 2)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("experiment_id"),
        F.col("l_orderkey").alias("unit_id"),
        F.when(parity == 1, "treatment").otherwise("control").alias("arm"),
        F.when(F.col("l_suppkey") % 3 == 0, F.lit(1.0)).otherwise(F.col("l_quantity")).alias("quantity"),
        F.col("l_linenumber").alias("row_order"),
        F.col("l_partkey").alias("part"),
    )


SUPPLIER_ROWS = """
sr AS (
  SELECT l_suppkey AS experiment_id, l_orderkey AS unit_id,
         CASE WHEN (CASE WHEN l_suppkey % 4 = 0 THEN l_linenumber % 2 ELSE (l_orderkey // 3) % 2 END) = 1 THEN 'treatment' ELSE 'control' END AS arm,
         CASE WHEN l_suppkey % 3 = 0 THEN 1.0::DOUBLE ELSE l_quantity END AS quantity,
         l_linenumber AS row_order, l_partkey AS part
  FROM lineitem)
"""


# --- event sessions -------------------------------------------------------------------
FUNNEL_STEPS = ["view", "click", "signup", "purchase"]


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole event log cut into user-days; arms by user parity."""
    return table(spark, sf_dir, "events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("session"),
        F.col("event_type").alias("event"),
        "ts",
        F.when(F.col("user_id") % 2 == 1, "treatment").otherwise("control").alias("arm"),
        "event_id",
    )


SESSIONS = """
se AS (
  SELECT CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS session, event_type AS event, ts,
         CASE WHEN user_id % 2 = 1 THEN 'treatment' ELSE 'control' END AS arm, event_id
  FROM events)
"""


# --- SQL pieces -------------------------------------------------------------------------
def _weights(n: int) -> str:
    return f"(CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"


def sql_normal_sf(z: str) -> str:
    """Upper normal tail of a column with a non-negative or negative value."""
    a, n = f"abs({z})", 400
    h = f"((sqrt({a}*{a} + 76.0::DOUBLE) - {a}) / {n})"
    body = f"list_sum(list_transform(range(0, {n + 1}), lambda i: {_weights(n)} * exp(-{a}*i*{h} - (i*{h})*(i*{h})/2)))"
    upper = f"(exp(-{a}*{a}/2) / sqrt(2*pi()) * {h} / 3 * {body})"
    return f"(CASE WHEN {z} >= 0 THEN {upper} ELSE 1 - {upper} END)"


def sql_normal2(z: str) -> str:
    a, n = f"abs({z})", 400
    h = f"((sqrt({a}*{a} + 76.0::DOUBLE) - {a}) / {n})"
    body = f"list_sum(list_transform(range(0, {n + 1}), lambda i: {_weights(n)} * exp(-{a}*i*{h} - (i*{h})*(i*{h})/2)))"
    return f"(2 * exp(-{a}*{a}/2) / sqrt(2*pi()) * {h} / 3 * {body})"


def sql_t2(t: str, df: str) -> str:
    """Two-sided Student tail for columns t and df."""
    n = 1000
    th = f"atan(abs({t}) / sqrt({df}))"
    length = f"least(pi()/2 - {th}, 12.0::DOUBLE / sqrt({df} - 1))"
    body = (
        f"list_sum(list_transform(range(0, {n + 1}), lambda i: {_weights(n)} * "
        f"pow(greatest(cos({th} + i * {length} / {n}), 0), {df} - 1)))"
    )
    scale = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi())"
    return f"least(1.0, 2 * {scale} * {length} / {n} / 3 * {body})"


def sql_t_crit(df: str) -> str:
    """97.5 % Student quantile by the asymptotic series; for df above about 40."""
    z = "1.959963984540054::DOUBLE"
    return (
        f"({z} + (pow({z},3)+{z})/4/{df} + (5*pow({z},5)+16*pow({z},3)+3*{z})/96/pow({df},2)"
        f" + (3*pow({z},7)+19*pow({z},5)+17*pow({z},3)-15*{z})/384/pow({df},3)"
        f" + (79*pow({z},9)+776*pow({z},7)+1482*pow({z},5)-1920*pow({z},3)-945*{z})/92160/pow({df},4))"
    )


def sql_f_sf(f: str, d1: str, d2: str) -> str:
    """F tail for numerator df of at least 2, by quadrature of the incomplete beta function."""
    n = 1000
    a, b, x = f"({d2}/2.0)", f"({d1}/2.0)", f"({d2} / ({d2} + {d1}*{f}))"
    span = f"(40.0::DOUBLE / {a} / {n})"
    body = (
        f"list_sum(list_transform(range(0, {n + 1}), lambda i: {_weights(n)} * "
        f"exp(-{a} * i * {span}) * pow(1 - {x} * exp(-i * {span}), {b} - 1)))"
    )
    return f"(exp({a} * ln({x}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) * {span} / 3 * {body})"
