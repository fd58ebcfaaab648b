"""Units, integrity and validity checks over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftlake.operators import quality, ranks, units
from liftlake.plans import testbed as tb
from liftlake.plans.registry import query

KEY = ["experiment_id"]


@query(
    "units_split_arms",
    f"""WITH {tb.CUSTOMER_UNITS}
SELECT segment, count(*) AS n_units,
       CAST(sum(CASE WHEN nation % 9 <> 0 AND arm = 'control' THEN 1 ELSE 0 END) AS BIGINT) AS n_control,
       CAST(sum(CASE WHEN nation % 9 <> 0 AND arm <> 'control' THEN 1 ELSE 0 END) AS BIGINT) AS n_treated,
       CAST(sum(CASE WHEN nation % 9 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_unassigned,
       CAST(sum(CASE WHEN nation % 9 = 0 OR arm <> 'control' THEN 1 ELSE 0 END) AS BIGINT) AS n_treated_when_counted
FROM cu GROUP BY segment""",
)
def split_arms(spark, sf_dir):
    """Both null-arm policies side by side; customers of some nations have no arm."""
    cu = tb.customer_units(spark, sf_dir).withColumn("arm", F.when(F.col("nation") % 9 != 0, F.col("arm")))
    strict = units.split_arms(cu, "arm", "control")
    both = units.split_arms(strict.withColumnRenamed("is_control", "strict"), "arm", "control", "treatment")
    return both.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_units"),
        F.count_if(F.col("strict")).alias("n_control"),
        F.count_if(~F.col("strict")).alias("n_treated"),
        F.count_if(F.col("strict").isNull()).alias("n_unassigned"),
        F.count_if(~F.col("is_control")).alias("n_treated_when_counted"),
    )


@query(
    "units_metrics_long",
    f"""WITH {tb.SUPPLIER_UNITS}
SELECT experiment_id, metric, count(*) AS n_rows, count(value) AS n, round(avg(value), 4) AS mean FROM (
  SELECT experiment_id, 'revenue' AS metric, revenue AS value FROM su
  UNION ALL SELECT experiment_id, 'refund', CAST(refund AS DOUBLE) FROM su
  UNION ALL SELECT experiment_id, 'units', units FROM su) GROUP BY ALL""",
)
def metrics_long(spark, sf_dir):
    long = units.metrics_long(tb.supplier_units(spark, sf_dir), ["experiment_id", "unit_id", "arm"], ["revenue", "refund", "units"])
    return long.groupBy("experiment_id", "metric").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean")
    )


@query(
    "units_assignment_merge",
    """SELECT CASE WHEN c_custkey IS NULL OR c_nationkey % 6 = 0 THEN '(none)' WHEN c_custkey % 2 = 1 THEN 'treatment' ELSE 'control' END AS arm,
       count(*) AS n_orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def assignment_merge(spark, sf_dir):
    """Orders (many rows per unit) meet a separate assignment table; unmatched orders keep a null arm."""
    orders = tb.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_totalprice")
    assigned = (
        tb.table(spark, sf_dir, "customer")
        .filter(F.col("c_nationkey") % 6 != 0)
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.when(F.col("c_custkey") % 2 == 1, "treatment").otherwise("control").alias("variant"),
            F.col("c_name").alias("assigned_by"),
        )
    )
    merged = units.merge_assignment(orders, assigned, "user_id", "customer_id", "variant")
    return merged.groupBy(F.coalesce("variant", F.lit("(none)")).alias("arm")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents")
    )


@query(
    "units_single_arm",
    f"""WITH {tb.SUPPLIER_ROWS},
p AS (SELECT experiment_id, unit_id, min(arm) AS arm FROM sr GROUP BY 1, 2 HAVING count(DISTINCT arm) = 1)
SELECT experiment_id, arm, count(*) AS n_units FROM p GROUP BY 1, 2""",
)
def single_arm(spark, sf_dir):
    kept = units.single_arm_units(tb.supplier_rows(spark, sf_dir), KEY, "unit_id", "arm")
    return kept.groupBy("experiment_id", "arm").agg(F.count(F.lit(1)).alias("n_units"))


@query(
    "units_first_row",
    f"""WITH {tb.SUPPLIER_ROWS},
r AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, unit_id ORDER BY row_order, arm, quantity, part) AS rn FROM sr)
SELECT experiment_id, arm, count(*) AS n_units, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(part) AS BIGINT) AS parts
FROM r WHERE rn = 1 GROUP BY 1, 2""",
)
def first_row(spark, sf_dir):
    kept = units.first_row_per_unit(tb.supplier_rows(spark, sf_dir), ["experiment_id", "unit_id"], "row_order")
    return kept.groupBy("experiment_id", "arm").agg(
        F.count(F.lit(1)).alias("n_units"), F.sum("quantity").cast("bigint").alias("quantity"), F.sum("part").alias("parts")
    )


DUPLICATES = f"""WITH {tb.SUPPLIER_ROWS},
pu AS (SELECT experiment_id, unit_id, count(*) AS c, count(DISTINCT arm) AS na, count(DISTINCT quantity) AS nq FROM sr GROUP BY 1, 2),
dup AS (SELECT experiment_id, CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows,
       CAST(sum(CASE WHEN na > 1 THEN 1 ELSE 0 END) AS BIGINT) AS conflicting_arm_units,
       CAST(sum(CASE WHEN na = 1 AND nq > 1 THEN 1 ELSE 0 END) AS BIGINT) AS conflicting_metric_units
FROM pu GROUP BY 1)"""


@query("units_duplicates", DUPLICATES + " SELECT * FROM dup")
def duplicates(spark, sf_dir):
    return units.duplicate_analysis(tb.supplier_rows(spark, sf_dir), KEY, "unit_id", "arm", "quantity")


@query(
    "units_integrity_rows",
    DUPLICATES
    + """
SELECT experiment_id, 'duplicate_rows' AS label, true AS passed, false AS critical, false AS informational, duplicate_rows || ' extra rows' AS detail FROM dup
UNION ALL SELECT experiment_id, 'arm_conflict', false, false, false, conflicting_arm_units || ' units in several arms' FROM dup WHERE conflicting_arm_units > 0
UNION ALL SELECT experiment_id, 'metric_conflict', false, true, false, conflicting_metric_units || ' units with several values' FROM dup
WHERE conflicting_arm_units = 0 AND conflicting_metric_units > 0""",
)
def integrity(spark, sf_dir):
    return units.integrity_rows(duplicates(spark, sf_dir), KEY)


@query(
    "units_control_arm",
    """WITH a AS (SELECT o_orderpriority AS experiment_id,
  CASE o_custkey % 3 WHEN 0 THEN CASE WHEN o_orderpriority LIKE '1%' THEN 'Mens E-Mail' WHEN o_orderpriority LIKE '2%' THEN ' Control ' ELSE 'B' END
    WHEN 1 THEN CASE WHEN o_orderpriority LIKE '1%' THEN 'No E-Mail' WHEN o_orderpriority LIKE '3%' THEN 'no_treatment' ELSE 'A' END ELSE 'C' END AS arm FROM orders),
r AS (SELECT DISTINCT experiment_id, arm, CASE WHEN lower(trim(arm)) = 'control' THEN 0
  WHEN regexp_replace(lower(trim(arm)), '[\\s_-]+', ' ', 'g') IN ('control','ctrl','holdout','no email','no e mail','no campaign','no treatment','untreated') THEN 1 ELSE 2 END AS rk FROM a)
SELECT experiment_id, arg_min(arm, CAST(rk AS VARCHAR) || arm) AS control_arm FROM r GROUP BY 1""",
)
def control(spark, sf_dir):
    p = F.col("o_orderpriority")
    arms = (
        F.when(
            F.col("o_custkey") % 3 == 0,
            F.when(p.like("1%"), "Mens E-Mail").when(p.like("2%"), " Control ").otherwise("B"),
        )
        .when(F.col("o_custkey") % 3 == 1, F.when(p.like("1%"), "No E-Mail").when(p.like("3%"), "no_treatment").otherwise("A"))
        .otherwise("C")
    )
    rows = tb.table(spark, sf_dir, "orders").select(p.alias("experiment_id"), arms.alias("arm"))
    return units.control_arm(rows, KEY, "arm")


@query("units_implicit_id", "SELECT l_returnflag, count(*) AS n_rows, count(*) AS n_units FROM lineitem GROUP BY 1")
def implicit_id(spark, sf_dir):
    """Every row of a table without ids becomes its own unit."""
    rows, name = units.with_implicit_unit(tb.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), scanned=True)
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(name).alias("n_units"))


@query(
    "units_implicit_id_of_derived_rows",
    "SELECT count(*) AS n_rows, count(*) AS n_units, CAST(0 AS BIGINT) AS first_id, count(*) - 1 AS last_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0",
)
def implicit_id_derived(spark, sf_dir):
    """Rows of a join have no place in a file: they are written, and numbered without gaps."""
    joined = tb.table(spark, sf_dir, "orders").join(tb.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).filter("c_acctbal > 0")
    rows, name = units.with_implicit_unit(joined.select("c_mktsegment", "o_totalprice"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(name).alias("n_units"), F.min(name).alias("first_id"), F.max(name).alias("last_id"))


SRM2 = f"""WITH {tb.SUPPLIER_UNITS},
s AS (SELECT experiment_id, CAST(sum(CASE WHEN arm = 'control' THEN 1 ELSE 0 END) AS BIGINT) AS n_control,
       CAST(sum(CASE WHEN arm <> 'control' THEN 1 ELSE 0 END) AS BIGINT) AS n_treated FROM su GROUP BY 1),
srm AS (SELECT *, (n_control - (n_control + n_treated) * 0.5) * (n_control - (n_control + n_treated) * 0.5) / ((n_control + n_treated) * 0.5)::DOUBLE * 2 AS chi2 FROM s),
srmp AS (SELECT *, {tb.sql_normal2('sqrt(chi2)')} AS p_value FROM srm)"""


@query(
    "srm_two_arm",
    SRM2
    + " SELECT experiment_id, n_control, n_treated, round(chi2, 6) AS chi2, round(p_value, 6) AS p_value, p_value >= 0.05 AS passed FROM srmp",
)
def srm_two(spark, sf_dir):
    flagged = units.split_arms(tb.supplier_units(spark, sf_dir), "arm", "control")
    return quality.srm_two_arm(flagged, KEY).select(
        "experiment_id", "n_control", "n_treated", F.round("chi2", 6).alias("chi2"), F.round("p_value", 6).alias("p_value"), "passed"
    )


@query(
    "srm_multi_arm",
    """WITH s AS (SELECT o_orderpriority AS experiment_id, o_custkey % 3 AS arm, count(*) AS n FROM orders GROUP BY 1, 2),
t AS (SELECT *, avg(n) OVER (PARTITION BY experiment_id) AS e FROM s),
g AS (SELECT experiment_id, CAST(count(*) AS INTEGER) AS n_arms, CAST(sum(n) AS BIGINT) AS n, sum((n - e) * (n - e) / e) AS chi2 FROM t GROUP BY 1)
SELECT experiment_id, n_arms, n, round(chi2, 6) AS chi2, round(exp(-chi2 / 2), 6) AS p_value, exp(-chi2 / 2) >= 0.05 AS passed FROM g""",
)
def srm_many(spark, sf_dir):
    rows = tb.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("experiment_id"), (F.col("o_custkey") % 3).alias("arm"))
    return quality.srm_multi_arm(rows, KEY, "arm").withColumn("chi2", F.round("chi2", 6)).withColumn("p_value", F.round("p_value", 6))


@query(
    "quality_nulls",
    f"""WITH {tb.SUPPLIER_UNITS},
m AS (SELECT experiment_id, avg(CASE WHEN revenue IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a, avg(CASE WHEN units > 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS b FROM su GROUP BY 1)
SELECT experiment_id, CASE WHEN a >= b THEN 'revenue' ELSE 'units' END AS worst_column, round(greatest(a, b), 6) AS missing_fraction, greatest(a, b) <= 0.01 AS passed FROM m""",
)
def nulls(spark, sf_dir):
    su = tb.supplier_units(spark, sf_dir).withColumn("units", F.when(F.col("units") <= 60, F.col("units")))
    return quality.null_check(su, KEY, ["revenue", "units"]).withColumn("missing_fraction", F.round("missing_fraction", 6))


def _outlier_long(spark, sf_dir):
    """Revenue is screened in log space, units on their own scale, parcels mostly equal one."""
    li = tb.table(spark, sf_dir, "lineitem")
    group = F.col("l_returnflag").alias("experiment_id")
    spiked = F.when(F.col("l_partkey") % 997 == 7, F.col("l_extendedprice") * 1000).when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_extendedprice"))
    parcels = F.when(F.col("l_discount") > 0.08, F.col("l_quantity")).when(F.col("l_discount") > 0.02, 1.0).otherwise(F.col("l_tax") * 100)
    rows = li.select(
        group,
        F.when(F.col("l_suppkey") % 2 == 1, "treatment").otherwise("control").alias("arm"),
        spiked.alias("revenue"),
        F.col("l_quantity").alias("units"),
        F.round(parcels, 0).alias("parcels"),
    )
    long = rows.unpivot(["experiment_id", "arm"], ["revenue", "units", "parcels"], "metric", "value")
    return long.withColumn("metric_type", F.when(F.col("metric") == "revenue", "continuous_monetary").otherwise("continuous_general"))


OUTLIERS = """WITH base AS (SELECT l_returnflag AS experiment_id, CASE WHEN l_suppkey % 2 = 1 THEN 'treatment' ELSE 'control' END AS arm,
    CASE WHEN l_partkey % 997 = 7 THEN l_extendedprice * 1000 WHEN l_linenumber = 7 THEN 0.0::DOUBLE ELSE l_extendedprice END AS revenue,
    l_quantity AS units,
    round(CASE WHEN l_discount > 0.08::DOUBLE THEN l_quantity WHEN l_discount > 0.02::DOUBLE THEN 1.0::DOUBLE ELSE l_tax * 100 END, 0) AS parcels FROM lineitem),
lg AS (SELECT experiment_id, arm, 'revenue' AS metric, revenue AS value, 'continuous_monetary' AS metric_type FROM base
  UNION ALL SELECT experiment_id, arm, 'units', units, 'continuous_general' FROM base
  UNION ALL SELECT experiment_id, arm, 'parcels', parcels, 'continuous_general' FROM base),
w AS (SELECT *, CASE WHEN metric_type = 'continuous_monetary' THEN CASE WHEN value > 0 THEN ln(value) END ELSE value END AS t FROM lg),
f AS (SELECT experiment_id, metric, arm, any_value(metric_type) AS metric_type, count(*) AS n_rows,
    CAST(sum(CASE WHEN metric_type = 'continuous_monetary' AND value = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero, count(t) AS n_used,
    quantile_cont(t, 0.25) AS q1, quantile_cont(t, 0.5) AS med, quantile_cont(t, 0.75) AS q3, avg(t) AS m, stddev_samp(t) AS sd FROM w GROUP BY 1, 2, 3),
d AS (SELECT w.experiment_id, w.metric, w.arm, quantile_cont(abs(t - med), 0.5) AS mad FROM w JOIN f USING (experiment_id, metric, arm) WHERE q1 = q3 AND t IS NOT NULL GROUP BY 1, 2, 3),
x AS (SELECT w.experiment_id, w.metric, w.arm, count(*) AS n_outliers, max(abs(t - m) / sd) AS max_sigma
  FROM w JOIN f USING (experiment_id, metric, arm) LEFT JOIN d USING (experiment_id, metric, arm)
  WHERE n_used >= 4 AND t IS NOT NULL AND CASE WHEN q1 = q3 THEN mad > 0 AND abs(0.6745::DOUBLE * (t - med) / mad) > 3.5
    ELSE t < q1 - 1.5::DOUBLE * (q3 - q1) OR t > q3 + 1.5::DOUBLE * (q3 - q1) END GROUP BY 1, 2, 3),
o AS (SELECT f.experiment_id, f.metric, f.arm, metric_type, n_rows, n_zero, n_used, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3, round(mad, 6) AS mad,
  coalesce(n_outliers, 0) AS n_outliers, round(max_sigma, 6) AS max_sigma, coalesce(n_outliers, 0) = 0 AS passed, coalesce(max_sigma > 4.0, false) AS critical
  FROM f LEFT JOIN d USING (experiment_id, metric, arm) LEFT JOIN x USING (experiment_id, metric, arm))"""


@query("quality_outliers_per_arm", OUTLIERS + " SELECT * FROM o")
def outliers(spark, sf_dir):
    facts = quality.outlier_facts(_outlier_long(spark, sf_dir), ["experiment_id", "metric"])
    for c in ("q1", "med", "q3", "mad", "max_sigma"):
        facts = facts.withColumn(c, F.round(c, 6))
    return facts


@query(
    "quality_outliers",
    OUTLIERS
    + " SELECT experiment_id, metric, CAST(sum(n_outliers) AS BIGINT) AS n_outliers, bool_and(passed) AS passed, bool_or(critical) AS critical FROM o GROUP BY 1, 2",
)
def outliers_merged(spark, sf_dir):
    return quality.outlier_check(quality.outlier_facts(_outlier_long(spark, sf_dir), ["experiment_id", "metric"]), ["experiment_id", "metric"])


@query("quality_normality")
def normality(spark, sf_dir):
    """Shapiro-Wilk per supplier experiment, metric and arm, with the combined quality row."""
    su = tb.supplier_units(spark, sf_dir)
    long = units.metrics_long(su, ["experiment_id", "unit_id", "arm"], ["revenue", "units"])
    by = ["experiment_id", "metric"]
    per_arm = quality.normality(long, by, "unit_id")
    sizes = long.groupBy(*by, "arm").agg(F.count("value").alias("n"))
    return quality.normality_check(per_arm, sizes, by)


@query(
    "exact_quantiles_hot_group",
    """SELECT 'all' AS experiment_id, count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS med,
 round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem""",
)
def hot_quantiles(spark, sf_dir):
    """One group holding every row, bracketed by a sketch and ranked in many ranges."""
    long = tb.table(spark, sf_dir, "lineitem").select(F.lit("all").alias("experiment_id"), F.col("l_extendedprice").alias("value"))
    q = ranks.exact_quantiles(long, KEY, {"q1": 0.25, "med": 0.5, "p99": 0.99}, parts=32)
    return q.select("experiment_id", "n", *[F.round(c, 4).alias(c) for c in ("q1", "med", "p99")])
