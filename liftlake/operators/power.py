"""Achieved power, detectable effects and sample-size plans, on facts rows."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlake.functions import fixed, small_samples, tails

_ND = NormalDist()


def solved_shift(alpha: float, power: float) -> float:
    """The standardized shift x with Φ(x − z) + Φ(−x − z) = power.

    Two-sided normal power depends on effect·√n only, so every detectable effect
    and required size follows from this one constant.
    """
    z = _ND.inv_cdf(1 - alpha / 2)
    lo, hi = 0.0, 50.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if _ND.cdf(mid - z) + _ND.cdf(-mid - z) < power:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def cohens_h(p1: Column, p2: Column) -> Column:
    return 2.0 * F.asin(F.sqrt(p2)) - 2.0 * F.asin(F.sqrt(p1))


def normal_power(effect: Column, effective_n: Column, alpha: float) -> tuple[Column, Column]:
    """The standardized shift, to be staged as ``__shift``, and the power read from it."""
    z = tails.z_quantile(1 - alpha / 2)
    shift = F.struct((F.abs(effect) * F.sqrt(effective_n)).alias("x"))
    both = f"{tails.normal_sf_sql(f'{z!r}D - __shift.x')} + {tails.normal_sf_sql(f'{z!r}D + __shift.x')}"
    return shift, F.expr(both)


def binary_power(paired: DataFrame, alpha: float = fixed.ALPHA, target: float = fixed.TARGET_POWER) -> DataFrame:
    """Power facts for binary comparisons (needs n_c, n_t, mean_c, mean_t)."""
    n_c, n_t = F.col("n_c").cast("double"), F.col("n_t").cast("double")
    effective = n_c * n_t / (n_c + n_t)
    x = solved_shift(alpha, target)
    h = F.abs(cohens_h(F.col("mean_c"), F.col("mean_t")))
    shift, reached = normal_power(h, effective, alpha)
    phi = 2.0 * F.asin(F.sqrt(F.col("mean_c"))) + F.lit(x) / F.sqrt(effective)
    shifted = F.least(F.greatest(F.sin(phi / 2.0) ** 2, F.lit(0.0)), F.lit(1.0))
    inside = (F.col("mean_c") > 0) & (F.col("mean_c") < 1)
    return (
        paired.withColumn("effect_size", h)
        .withColumn("__shift", shift)
        .withColumn("achieved_power", F.when(h > 0, F.least(reached, F.lit(1.0))).otherwise(0.0))
        .drop("__shift")
        .withColumn("mde_rel", F.when(inside, (shifted - F.col("mean_c")) / F.col("mean_c") * 100))
        .withColumn(
            "required_n",
            F.when(h > 1e-9, F.ceil((F.lit(x) / h) ** 2 * (1.0 + n_c / n_t))).otherwise(F.col("n_c")).cast("long"),
        )
        .withColumn("observed_n", F.col("n_c") + F.col("n_t"))
        .withColumn("powered", F.col("achieved_power") >= target)
    )


def pooled_sd(n_c: Column, var_c: Column, n_t: Column, var_t: Column) -> Column:
    return F.when(n_c + n_t > 2, F.sqrt(((n_c - 1) * var_c + (n_t - 1) * var_t) / (n_c + n_t - 2))).otherwise(0.0)


def continuous_power(paired: DataFrame, alpha: float = fixed.ALPHA, target: float = fixed.TARGET_POWER) -> DataFrame:
    """Power facts for continuous comparisons, by the noncentral t distribution."""

    @F.pandas_udf("achieved double, mde double, required double")
    def solve(effect: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.DataFrame:
        d = effect.to_numpy(dtype=float)
        a, b = n1.to_numpy(dtype=float), n2.to_numpy(dtype=float)
        ok = (a + b > 2) & (a > 0) & (b > 0) & np.isfinite(d)
        out = pd.DataFrame({c: np.full(len(d), np.nan) for c in ("achieved", "mde", "required")})
        if ok.any():
            i = np.where(ok)[0]
            out.loc[i, "achieved"] = small_samples.t_power(d[i], a[i], b[i], alpha)
            out.loc[i, "mde"] = small_samples.t_minimum_effect(a[i], b[i], alpha, target)
            j = i[d[i] > 1e-9]
            if len(j):
                out.loc[j, "required"] = small_samples.t_required_n(d[j], b[j] / a[j], alpha, target)
        return out

    sd = pooled_sd(F.col("n_c"), F.col("var_c"), F.col("n_t"), F.col("var_t"))
    return (
        paired.withColumn("__sd", sd)
        .withColumn("effect_size", F.when(F.col("__sd") > 0, F.abs(F.col("mean_t") - F.col("mean_c")) / F.col("__sd")).otherwise(0.0))
        .withColumn("__s", solve("effect_size", "n_c", "n_t"))
        .withColumn(
            "achieved_power",
            F.when(F.col("effect_size") <= 0, 0.0)
            .when(F.isnan("__s.achieved"), 1.0)
            .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__s.achieved")))),
        )
        .withColumn("mde_rel", F.when(F.col("mean_c") != 0, F.col("__s.mde") * F.col("__sd") / F.col("mean_c") * 100))
        .withColumn(
            "required_n",
            F.when((F.col("effect_size") > 1e-9) & ~F.isnan("__s.required"), F.ceil("__s.required")).otherwise(F.col("n_c")).cast("long"),
        )
        .withColumn("observed_n", F.col("n_c") + F.col("n_t"))
        .withColumn("powered", F.col("achieved_power") >= target)
        .drop("__s", "__sd")
    )


def power_facts(paired: DataFrame, alpha: float = fixed.ALPHA, target: float = fixed.TARGET_POWER) -> DataFrame:
    """Both branches, one row per comparison."""
    binary = binary_power(paired.filter(F.col("metric_type") == "binary"), alpha, target)
    other = continuous_power(paired.filter(F.col("metric_type") != "binary"), alpha, target)
    return binary.unionByName(other)


def plan_sample_sizes(plans: DataFrame, alpha: float = fixed.ALPHA, target: float = fixed.TARGET_POWER) -> DataFrame:
    """Plans (metric_type, baseline, mde_rel_pct, baseline_sd, arms, daily_traffic) to sizes and days."""
    x = solved_shift(alpha, target)
    moved = F.least(F.greatest(F.col("baseline") * (1 + F.col("mde_rel_pct") / 100), F.lit(0.0)), F.lit(1.0))
    is_binary = F.col("metric_type") == "binary"

    @F.pandas_udf("double")
    def t_size(effect: pd.Series, binary: pd.Series) -> pd.Series:
        out = np.full(len(effect), np.nan)
        d = effect.to_numpy(dtype=float)
        i = np.where(~binary.to_numpy(dtype=bool) & (d > 1e-9))[0]
        if len(i):
            out[i] = small_samples.t_required_n(d[i], np.ones(len(i)), alpha, target)
        return pd.Series(out)

    effect = F.when(is_binary, F.abs(cohens_h(F.col("baseline"), moved))).otherwise(
        F.abs(F.col("baseline") * F.col("mde_rel_pct") / 100) / F.when(F.col("baseline_sd") > 0, F.col("baseline_sd"))
    )
    sized = plans.withColumn("effect_size", effect).withColumn(
        "n_per_arm",
        F.when(F.col("effect_size") <= 1e-9, None)
        .when(is_binary, F.ceil(2.0 * (F.lit(x) / F.col("effect_size")) ** 2))
        .otherwise(F.ceil(t_size("effect_size", is_binary)))
        .cast("long"),
    )
    return sized.withColumn("n_total", F.col("n_per_arm") * F.col("arms")).withColumn(
        "days", F.when(F.col("daily_traffic") > 0, F.ceil(F.col("n_total") / F.col("daily_traffic")).cast("long"))
    )


def normal_only_plan(plans: DataFrame, alpha: float = fixed.ALPHA, target: float = fixed.TARGET_POWER) -> DataFrame:
    """Binary plans only: no Python worker is started."""
    x = solved_shift(alpha, target)
    moved = F.least(F.greatest(F.col("baseline") * (1 + F.col("mde_rel_pct") / 100), F.lit(0.0)), F.lit(1.0))
    return (
        plans.withColumn("effect_size", F.abs(cohens_h(F.col("baseline"), moved)))
        .withColumn("n_per_arm", F.when(F.col("effect_size") > 1e-9, F.ceil(2.0 * (F.lit(x) / F.col("effect_size")) ** 2)).cast("long"))
        .withColumn("n_total", F.col("n_per_arm") * F.col("arms"))
        .withColumn("days", F.when(F.col("daily_traffic") > 0, F.ceil(F.col("n_total") / F.col("daily_traffic")).cast("long")))
    )


