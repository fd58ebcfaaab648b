"""Stratified analysis: eligibility, stratum effects, inverse-variance combination, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlake.functions import fixed, tails
from liftlake.functions.arith import ratio
from liftlake.operators.quality import with_two_arm_srm
from liftlake.operators.units import clean_double


def strata(units: DataFrame, keys: list[str], stratum: str, metric: str, is_control: str = "is_control") -> DataFrame:
    """One row per stratum (missing stratum kept as null): arm sizes and metric moments."""
    y = clean_double(metric)
    yc, yt = F.when(F.col(is_control), y), F.when(~F.col(is_control), y)
    return (
        units.filter(F.col(is_control).isNotNull())
        .groupBy(*keys, F.col(stratum).cast("string").alias("stratum"))
        .agg(
            F.count_if(F.col(is_control)).alias("n_control"),
            F.count_if(~F.col(is_control)).alias("n_treated"),
            F.count(yc).alias("m_control"),
            F.count(yt).alias("m_treated"),
            F.avg(yc).alias("rate_control"),
            F.avg(yt).alias("rate_treated"),
            F.var_samp(yc).alias("var_control"),
            F.var_samp(yt).alias("var_treated"),
            F.bool_and((y == 0) | (y == 1)).alias("zero_one"),
        )
    )


def with_flags(stratum_rows: DataFrame, min_arm: int = fixed.STRATUM_MIN_ARM) -> DataFrame:
    both = (F.col("n_control") > 0) & (F.col("n_treated") > 0)
    enough = (F.col("n_control") >= min_arm) & (F.col("n_treated") >= min_arm)
    return stratum_rows.withColumn("has_both", both).withColumn("sufficient", both & enough)


def eligibility(
    stratum_rows: DataFrame,
    keys: list[str],
    column: str,
    columns: list[str],
    arm: str,
    min_arm: int = fixed.STRATUM_MIN_ARM,
) -> DataFrame:
    """May this column stratify the comparison? One row per experiment with the first failing reason."""
    flagged = with_flags(stratum_rows, min_arm)
    present = F.col("stratum").isNotNull()
    size = F.col("n_control") + F.col("n_treated")
    facts = flagged.groupBy(*keys).agg(
        F.sum(size).alias("n_units"),
        F.coalesce(F.sum(F.when(~present, size)), F.lit(0)).alias("n_missing"),
        F.count_if(present).alias("n_strata"),
        F.count_if(present & F.col("has_both")).alias("n_both"),
        F.count_if(present & F.col("sufficient")).alias("n_sufficient"),
        F.array_join(
            F.array_sort(F.collect_set(F.when(present & F.col("has_both") & ~F.col("sufficient"), F.col("stratum")))), ","
        ).alias("sparse_strata"),
    )
    reason = (
        F.when(F.lit(column not in columns), "column_not_found")
        .when(F.lit(column == arm), "is_treatment_assignment")
        .when(F.col("n_strata") == 0, "no_strata_with_both_arms")
        .when(F.col("n_both") == 0, "perfectly_associated_with_assignment")
        .when(F.col("n_sufficient") == 0, "all_strata_too_sparse")
    )
    return facts.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull())


def stratum_effects(stratum_rows: DataFrame, metric_type: str, min_arm: int = fixed.STRATUM_MIN_ARM) -> DataFrame:
    """Difference and its variance per sufficient stratum."""
    n_c, n_t = F.col("m_control"), F.col("m_treated")
    p_c, p_t = F.col("rate_control"), F.col("rate_treated")
    if metric_type == "binary":
        variance: Column = ratio(p_c * (1 - p_c), n_c) + ratio(p_t * (1 - p_t), n_t)
    else:
        variance = ratio(F.coalesce(F.col("var_control"), F.lit(0.0)), n_c) + ratio(F.coalesce(F.col("var_treated"), F.lit(0.0)), n_t)
    return (
        with_flags(stratum_rows, min_arm)
        .filter(F.col("stratum").isNotNull() & F.col("sufficient"))
        .withColumn("effect", p_t - p_c)
        .withColumn("variance", variance)
    )


def combine_strata(effect_rows: DataFrame, keys: list[str], alpha: float = fixed.ALPHA) -> DataFrame:
    """Inverse-variance weighted effect; strata without variance do not count."""
    used = effect_rows.filter(F.col("variance") > 0)
    weight = 1.0 / F.col("variance")
    z = tails.z_quantile(1 - alpha / 2)
    return (
        used.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("strata_used"),
            (F.sum(weight * F.col("effect")) / F.sum(weight)).alias("effect"),
            F.sqrt(1.0 / F.sum(weight)).alias("standard_error"),
        )
        .withColumn("z", F.col("effect") / F.col("standard_error"))
        .withColumn("p_value", tails.normal_two_sided("z"))
        .withColumn("ci_lower", F.col("effect") - z * F.col("standard_error"))
        .withColumn("ci_upper", F.col("effect") + z * F.col("standard_error"))
        .withColumn("significant", F.col("p_value") < alpha)
    )


def diagnose_strata(stratum_rows: DataFrame, keys: list[str], alpha: float = fixed.SRM_ALPHA) -> DataFrame:
    """Descriptive breakdown that is safe on an invalid experiment: sizes, rates, own allocation check."""
    from pyspark.sql import Window as W

    total = F.sum(F.col("n_control") + F.col("n_treated")).over(W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1)))
    sized = stratum_rows.withColumn("share", (F.col("n_control") + F.col("n_treated")) / total).filter(
        F.col("stratum").isNotNull()
    )
    return (
        with_two_arm_srm(sized, "n_control", "n_treated", 0.5, alpha)
        .withColumn("srm_flagged", ~F.col("passed"))
        .select(*keys, "stratum", "n_control", "n_treated", "share", "rate_control", "rate_treated", "p_value", "srm_flagged")
    )
