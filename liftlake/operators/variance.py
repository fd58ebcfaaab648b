"""Covariate adjustment (CUPED) from joint moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from liftlake.functions import fixed
from liftlake.functions.arith import ratio
from liftlake.operators.units import clean_double


def _skip(n_pairs: Column, var_x: Column, corr: Column, smallest_arm: Column) -> Column:
    return (
        F.when(n_pairs < fixed.CUPED_MIN_PAIRS, "insufficient_data")
        .when(F.coalesce(var_x, F.lit(0.0)) == 0, "covariate_too_weak")
        .when(corr.isNull() | F.isnan(corr) | (F.abs(corr) < fixed.CUPED_MIN_CORRELATION), "covariate_too_weak")
        .when(smallest_arm < fixed.CUPED_MIN_PAIRS, "insufficient_data")
    )


def joint_moments(units: DataFrame, keys: list[str], arm: str, metric: str, covariate: str) -> DataFrame:
    """Joint moments per arm, one pass: paired rows and rows whose metric has no covariate."""
    y, x = clean_double(metric), clean_double(covariate)
    both = y.isNotNull() & x.isNotNull()
    yp, xp = F.when(both, y), F.when(both, x)
    lone = F.when(x.isNull(), y)
    return (
        units.filter(F.col(arm).isNotNull())
        .groupBy(*keys, F.col(arm).cast("string").alias("arm"))
        .agg(
            F.count(yp).alias("n_pairs"),
            F.avg(yp).alias("mean_y"),
            F.avg(xp).alias("mean_x"),
            F.coalesce(F.var_pop(yp) * F.count(yp), F.lit(0.0)).alias("ss_y"),
            F.coalesce(F.var_pop(xp) * F.count(yp), F.lit(0.0)).alias("ss_x"),
            F.coalesce(F.covar_pop(yp, xp) * F.count(yp), F.lit(0.0)).alias("ss_xy"),
            F.count(lone).alias("n_lone"),
            F.avg(lone).alias("mean_lone"),
            F.coalesce(F.var_pop(lone) * F.count(lone), F.lit(0.0)).alias("ss_lone"),
        )
    )


def pooled_theta(arms: DataFrame, keys: list[str]) -> DataFrame:
    """Add the pooled θ, mean covariate, correlation and skip reason to every arm row.

    Pooling uses the parallel-variance identity on arm moments; the window holds
    one experiment's arms.
    """
    w = W.partitionBy(*keys)
    n = F.sum("n_pairs").over(w)
    my = ratio(F.sum(F.col("n_pairs") * F.col("mean_y")).over(w), n)
    mx = ratio(F.sum(F.col("n_pairs") * F.col("mean_x")).over(w), n)
    staged = arms.withColumn("pairs", n).withColumn("__my", my).withColumn("x_mean", mx)
    dy, dx = F.col("mean_y") - F.col("__my"), F.col("mean_x") - F.col("x_mean")
    staged = (
        staged.withColumn("__syy", F.sum(F.col("ss_y") + F.coalesce(F.col("n_pairs") * dy * dy, F.lit(0.0))).over(w))
        .withColumn("__sxx", F.sum(F.col("ss_x") + F.coalesce(F.col("n_pairs") * dx * dx, F.lit(0.0))).over(w))
        .withColumn("__sxy", F.sum(F.col("ss_xy") + F.coalesce(F.col("n_pairs") * dx * dy, F.lit(0.0))).over(w))
    )
    corr = ratio(F.col("__sxy"), F.sqrt(F.col("__sxx") * F.col("__syy")))
    return (
        staged.withColumn("correlation", corr)
        .withColumn("skip_reason", _skip(F.col("pairs"), F.col("__sxx"), F.col("correlation"), F.min("n_pairs").over(w)))
        .withColumn("theta", F.when(F.col("skip_reason").isNull(), ratio(F.col("__sxy"), F.col("__sxx"))))
        .drop("__my", "__syy", "__sxx", "__sxy")
    )


def theta(units: DataFrame, keys: list[str], arm: str, metric: str, covariate: str) -> DataFrame:
    """One row per experiment: θ, mean covariate, correlation, pairs, skip reason."""
    return pooled_theta(joint_moments(units, keys, arm, metric, covariate), keys).select(
        *keys, "pairs", "x_mean", "correlation", "theta", "skip_reason"
    ).dropDuplicates(keys)


def adjusted_moments(units: DataFrame, keys: list[str], arm: str, metric: str, covariate: str) -> DataFrame:
    """Arm moments of the adjusted metric, without touching unit rows a second time.

    Paired rows become y − θ(x − x̄), whose mean and sum of squares follow from
    the joint moments; rows without a covariate keep y. The two parts are pooled.
    Column names match ``effects.arm_moments`` so tests and power run unchanged.
    """
    arms = pooled_theta(joint_moments(units, keys, arm, metric, covariate), keys)
    t = F.coalesce(F.col("theta"), F.lit(0.0))
    n1, n2 = F.col("n_pairs").cast("double"), F.col("n_lone").cast("double")
    m1 = F.coalesce(F.col("mean_y") - t * (F.col("mean_x") - F.col("x_mean")), F.lit(0.0))
    m2 = F.coalesce(F.col("mean_lone"), F.lit(0.0))
    s1 = F.col("ss_y") - 2 * t * F.col("ss_xy") + t * t * F.col("ss_x")
    raw1 = F.coalesce(F.col("mean_y"), F.lit(0.0))

    def pool(mean1: Column, ss1: Column) -> tuple[Column, Column]:
        mean = ratio(n1 * mean1 + n2 * m2, n1 + n2)
        ss = ss1 + F.col("ss_lone") + ratio(n1 * n2, n1 + n2) * (mean1 - m2) ** 2
        return mean, ss

    mean, ss = pool(m1, s1)
    raw_mean, raw_ss = pool(raw1, F.col("ss_y"))
    n = F.col("n_pairs") + F.col("n_lone")
    return arms.select(
        *keys,
        F.lit(metric).alias("metric"),
        "arm",
        n.alias("n_rows"),
        n.alias("n"),
        mean.alias("mean"),
        ratio(ss, n - 1).alias("var"),
        F.lit(0).cast("long").alias("n_success"),
        n.alias("n_other"),
        raw_mean.alias("raw_mean"),
        ratio(raw_ss, n - 1).alias("raw_var"),
        "theta",
        "skip_reason",
    )


def variance_report(adjusted: DataFrame, keys: list[str]) -> DataFrame:
    """Variance over both arms before and after; a skip row for skipped or many-arm experiments."""
    by = [*keys, "metric"]
    w = W.partitionBy(*by)

    def pooled_var(mean: str, var: str) -> Column:
        grand = F.col(f"__g_{mean}")
        ss = F.sum((F.col("n") - 1) * F.coalesce(F.col(var), F.lit(0.0)) + F.col("n") * (F.col(mean) - grand) ** 2)
        return ratio(ss, F.sum("n") - 1)

    staged = adjusted
    for m in ("mean", "raw_mean"):
        staged = staged.withColumn(f"__g_{m}", ratio(F.sum(F.col("n") * F.col(m)).over(w), F.sum("n").over(w)))
    out = staged.groupBy(*by).agg(
        F.count(F.lit(1)).cast("int").alias("n_arms"),
        F.max("theta").alias("theta"),
        F.max("skip_reason").alias("skip_reason"),
        pooled_var("raw_mean", "raw_var").alias("variance_before"),
        pooled_var("mean", "var").alias("variance_after"),
    )
    reason = F.when(F.col("n_arms") != 2, "multi_arm").otherwise(F.col("skip_reason"))
    skipped = F.col("skip_reason").isNotNull()
    return (
        out.withColumn("skip_reason", reason)
        .withColumn(
            "reduction_pct",
            F.when(skipped, 0.0)
            .when(F.col("variance_before") > 0, 100 * (1 - ratio(F.col("variance_after"), F.col("variance_before"))))
            .otherwise(0.0),
        )
        .withColumn("variance_before", F.when(skipped, 0.0).otherwise(F.col("variance_before")))
        .withColumn("variance_after", F.when(skipped, 0.0).otherwise(F.col("variance_after")))
    )


def adjust_units(units: DataFrame, keys: list[str], metric: str, covariate: str, thetas: DataFrame) -> DataFrame:
    """Unit rows with ``adjusted`` - only for consumers that need rows (resampling, export).

    One θ row per experiment; adaptive execution decides on broadcasting it by
    its measured size and splits an experiment that holds most rows.
    """
    y, x = clean_double(metric), clean_double(covariate)
    return (
        units.join(thetas.select(*keys, "theta", "x_mean"), keys, "left")
        .withColumn(
            "adjusted",
            F.when(x.isNotNull() & F.col("theta").isNotNull(), y - F.col("theta") * (x - F.col("x_mean"))).otherwise(y),
        )
        .drop("theta", "x_mean")
    )
