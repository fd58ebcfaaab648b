"""Validity checks: sample ratio, missing values, outliers, normality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from liftlake.functions import fixed, small_samples, tails
from liftlake.functions.arith import ratio
from liftlake.operators import ranks
from liftlake.operators.units import clean_double, explode_quality, quality_struct
from liftlake.session import materialize


def srm_two_arm(
    units: DataFrame, keys: list[str], is_control: str = "is_control", control_share: float = 0.5, alpha: float = fixed.SRM_ALPHA
) -> DataFrame:
    """χ² goodness of fit of the two arm sizes against the planned split."""
    if not 0.0 < control_share < 1.0:
        raise ValueError("control_share must lie strictly between 0 and 1")
    sizes = units.groupBy(*keys).agg(
        F.count_if(F.col(is_control)).alias("n_control"),
        F.count_if(~F.col(is_control)).alias("n_treated"),
        F.count_if(F.col(is_control).isNull()).alias("n_unassigned"),
    )
    return with_two_arm_srm(sizes, "n_control", "n_treated", control_share, alpha)


def with_two_arm_srm(
    facts: DataFrame, n_control: str, n_treated: str, control_share: float = 0.5, alpha: float = fixed.SRM_ALPHA
) -> DataFrame:
    """Add ``chi2``, ``p_value`` and ``passed`` to rows holding both arm sizes."""
    total = (F.col(n_control) + F.col(n_treated)).cast("double")
    expected_c, expected_t = total * control_share, total * (1.0 - control_share)
    chi2 = (F.col(n_control) - expected_c) ** 2 / expected_c + (F.col(n_treated) - expected_t) ** 2 / expected_t
    return (
        facts.filter(total > 0)
        .withColumn("chi2", chi2)
        .withColumn("p_value", tails.normal_two_sided("sqrt(chi2)"))
        .withColumn("passed", F.col("p_value") >= alpha)
    )


def srm_multi_arm(units: DataFrame, keys: list[str], arm: str, alpha: float = fixed.SRM_ALPHA) -> DataFrame:
    """Equal-share χ² over k ≥ 2 arms."""
    sizes = units.filter(F.col(arm).isNotNull()).groupBy(*keys, arm).agg(F.count(F.lit(1)).alias("n"))
    expected = F.avg("n").over(W.partitionBy(*keys))
    return (
        sizes.withColumn("__e", expected)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).cast("int").alias("n_arms"),
            F.sum("n").alias("n"),
            F.sum((F.col("n") - F.col("__e")) ** 2 / F.col("__e")).alias("chi2"),
        )
        .filter(F.col("n_arms") >= 2)
        .withColumn("p_value", tails.chi_square_sf("chi2", "n_arms - 1"))
        .withColumn("passed", F.col("p_value") >= alpha)
    )


def null_check(units: DataFrame, keys: list[str], columns: list[str], limit: float = fixed.NULL_FRACTION_LIMIT) -> DataFrame:
    """The worst column's missing share against the limit (first column on ties)."""
    if not columns:
        raise ValueError("null_check needs at least one column")
    kinds = dict(units.dtypes)

    def missing(c: str) -> Column:
        return F.isnan(c) | F.col(c).isNull() if kinds[c] in ("double", "float") else F.col(c).isNull()

    shares = units.groupBy(*keys).agg(
        *[F.avg(F.when(missing(c), 1.0).otherwise(0.0)).alias(f"__m{i}") for i, c in enumerate(columns)]
    )
    worst = F.greatest(
        *[F.struct(F.col(f"__m{i}").alias("f"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(columns)]
    ) if len(columns) > 1 else F.struct(F.col("__m0").alias("f"), F.lit(0).alias("i"), F.lit(columns[0]).alias("c"))
    return shares.select(*keys, worst.alias("w")).select(
        *keys,
        F.col("w.c").alias("worst_column"),
        F.col("w.f").alias("missing_fraction"),
        (F.col("w.f") <= limit).alias("passed"),
    )


def outlier_facts(
    long: DataFrame,
    keys: list[str],
    arm: str = "arm",
    value: str = "value",
    metric_type: str = "metric_type",
    iqr_multiplier: float = fixed.IQR_MULTIPLIER,
    parts: int | None = None,
) -> DataFrame:
    """Outlier counts per group and arm.

    Monetary metrics are screened as ln(v) over v > 0, with zeros counted apart;
    other continuous metrics on their own scale; binary metrics are skipped.
    Fences are Tukey's, or a modified z-score around the median where the
    quartiles coincide. Rows are scanned, never shuffled, but for the values near a quartile.
    """
    groups = [*keys, arm]
    v = F.col(value)
    money = F.col(metric_type) == "continuous_monetary"
    held = v.isNotNull() & ~F.isnan(v)
    work = (
        long.filter(F.col(metric_type) != "binary")
        .withColumn("__t", F.when(~money & held, v).when(money & held & (v > 0), F.ln(v)).cast("double"))
    )
    sizes = work.groupBy(*groups).agg(
        F.first(metric_type).alias("metric_type"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(money & (v == 0)).alias("n_zero"),
        F.count("__t").alias("n_used"),
        F.avg("__t").alias("mean"),
        F.stddev_samp("__t").alias("sd"),
        ranks.sketch("__t").alias("__sketch"),
    )
    quarters = {"q1": 0.25, "med": 0.5, "q3": 0.75}
    sizes = materialize(ranks.brackets(sizes, "__sketch", [(p, ranks.MARGIN) for p in quarters.values()]))
    quartiles = ranks.quantiles_of_rows(work, sizes, groups, quarters, "__t", parts).drop("n")
    facts = sizes.drop("__brackets").join(quartiles, groups, "left")
    degenerate = quartiles.filter(F.col("q1") == F.col("q3")).select(*groups, "med")
    if degenerate.limit(1).count():
        spread = work.join(degenerate, groups).select(*groups, F.abs(F.col("__t") - F.col("med")).alias("value"))
        mad = ranks.exact_quantiles(spread, groups, {"mad": 0.5}, parts=parts).drop("n")
        fences = materialize(facts.join(mad, groups, "left"))
    else:
        fences = materialize(facts.withColumn("mad", F.lit(None).cast("double")))
    x, iqr = F.col("__t"), F.col("q3") - F.col("q1")
    flagged = F.when(
        iqr == 0, (F.col("mad") > 0) & (F.abs(ratio(fixed.MAD_SCALE * (x - F.col("med")), F.col("mad"))) > fixed.MAD_LIMIT)
    ).otherwise((x < F.col("q1") - iqr_multiplier * iqr) | (x > F.col("q3") + iqr_multiplier * iqr))
    hits = (
        work.filter(x.isNotNull())
        .select(*groups, "__t")
        .join(fences.filter(F.col("n_used") >= 4).select(*groups, "q1", "med", "q3", "mad", "mean", "sd"), groups)
        .filter(F.coalesce(flagged, F.lit(False)))
        .groupBy(*groups)
        .agg(
            F.count(F.lit(1)).alias("n_outliers"),
            F.max(F.when(F.col("sd") > 0, ratio(F.abs(x - F.col("mean")), F.col("sd")))).alias("max_sigma"),
        )
    )
    out = fences.join(hits, groups, "left")
    n_out = F.coalesce(F.col("n_outliers"), F.lit(0)).cast("long")
    return out.select(
        *groups,
        "metric_type",
        "n_rows",
        "n_zero",
        "n_used",
        "q1",
        "med",
        "q3",
        "mad",
        n_out.alias("n_outliers"),
        "max_sigma",
        (n_out == 0).alias("passed"),
        F.coalesce(F.col("max_sigma") > fixed.OUTLIER_CRITICAL_SIGMA, F.lit(False)).alias("critical"),
    )


def outlier_check(arm_facts: DataFrame, keys: list[str]) -> DataFrame:
    """Arms merged: passes when every arm passes, critical when any arm is."""
    return arm_facts.groupBy(*keys).agg(
        F.sum("n_outliers").alias("n_outliers"),
        F.bool_and("passed").alias("passed"),
        F.bool_or("critical").alias("critical"),
    )


def normality(
    long: DataFrame,
    keys: list[str],
    unit: str,
    arm: str = "arm",
    value: str = "value",
    alpha: float = fixed.NORMALITY_ALPHA,
    seed: int = 42,
) -> DataFrame:
    """Shapiro-Wilk per group and arm over at most 5,000 values.

    The sample is the 5,000 smallest unit hashes: the same rows for a seed on
    any partitioning, and cut before the shuffle by the window's group limit.
    Its size bounds the arrays handed to Python.
    """
    groups = [*keys, arm]
    held = long.filter(F.col(value).isNotNull() & ~F.isnan(value) & F.col(arm).isNotNull())
    order = W.partitionBy(*groups).orderBy(F.xxhash64(F.col(unit), F.lit(seed)), F.col(unit))
    sample = (
        held.select(*groups, unit, F.col(value).cast("double").alias("value"))
        .withColumn("__rn", F.row_number().over(order))
        .filter(F.col("__rn") <= fixed.SHAPIRO_MAX_N)
        .select(*groups, "value")
    )

    @F.pandas_udf("n long, w double, p_value double")
    def screen(values: pd.Series) -> pd.DataFrame:
        out = [(len(v), *small_samples.shapiro_wilk(v)) for v in values]
        return pd.DataFrame(out, columns=["n", "w", "p_value"])

    return (
        sample.groupBy(*groups)
        .agg(F.sort_array(F.collect_list("value")).alias("values"))
        .select(*groups, screen("values").alias("s"))
        .select(*groups, "s.*")
        .filter(F.col("n") >= 3)
        .withColumn("normal", F.col("p_value") >= alpha)
    )


def normality_check(per_arm: DataFrame, arm_sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Quality row; informational when every arm has at least 30 values."""
    return (
        per_arm.groupBy(*keys)
        .agg(F.bool_and("normal").alias("passed"))
        .join(arm_sizes.groupBy(*keys).agg((F.min("n") >= fixed.LARGE_ARM).alias("informational")), keys)
    )


def quality_rows(
    keys: list[str],
    srm: DataFrame | None = None,
    nulls: DataFrame | None = None,
    outliers: DataFrame | None = None,
    normal: DataFrame | None = None,
    integrity: DataFrame | None = None,
) -> DataFrame:
    """Concatenate checks into the quality facts table."""
    parts = []
    if srm is not None:
        parts.append(explode_quality(srm, keys, [quality_struct("srm", F.col("passed"), p_text(F.col("p_value")))]))
    if nulls is not None:
        share = F.format_string("%.1f%% missing in %s", F.col("missing_fraction") * 100, F.col("worst_column"))
        parts.append(explode_quality(nulls, keys, [quality_struct("nulls", F.col("passed"), share)]))
    if outliers is not None:
        count = F.concat(F.col("n_outliers").cast("string"), F.lit(" outliers"))
        parts.append(
            explode_quality(outliers, keys, [quality_struct("outliers", F.col("passed"), count, critical=F.col("critical"))])
        )
    if normal is not None:
        parts.append(
            explode_quality(
                normal,
                keys,
                [quality_struct("normality", F.col("passed"), F.lit("Shapiro-Wilk"), informational=F.col("informational"))],
            )
        )
    if integrity is not None:
        parts.append(integrity)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def p_text(p: Column) -> Column:
    """Display form that never prints a zero p-value."""
    return F.when(p < 0.001, F.lit("p < 0.001")).otherwise(F.format_string("p = %.4f", p))


__all__ = [
    "clean_double",
    "normality",
    "normality_check",
    "null_check",
    "outlier_check",
    "outlier_facts",
    "p_text",
    "quality_rows",
    "srm_multi_arm",
    "srm_two_arm",
    "with_two_arm_srm",
]
