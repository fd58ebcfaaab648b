"""The whole analysis of a batch of experiments.

Units are read once for the moments and once for the integrity check; everything
after that is facts. Moments, quality rows and effects are written (reliable
checkpoint) because several branches read them. Invalid experiments are removed
by an anti join before any test. Unit values are read again only for continuous
primary metrics (outliers, normality) and for comparisons with a small arm (ranks).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from liftlake.functions import fixed, tails
from liftlake.operators import decide, effects, power, quality, units
from liftlake.session import materialize


@dataclass
class Analysis:
    """Facts tables of a batch."""

    moments: DataFrame
    quality: DataFrame
    validity: DataFrame
    effects: DataFrame
    power: DataFrame
    guardrails: DataFrame
    decisions: DataFrame


def quality_from_moments(moments: DataFrame, keys: list[str], metric: str, alpha: float = fixed.SRM_ALPHA) -> DataFrame:
    """Ratio check over all arms (equal shares; a lone arm fails) and missing-value check, from arm moments: no further scan."""
    share = F.sum("n_rows").over(W.partitionBy(*keys)) / F.greatest(F.count(F.lit(1)).over(W.partitionBy(*keys)), F.lit(2))
    sizes = (
        moments.filter(F.col("metric") == metric)
        .withColumn("__share", share)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).cast("int").alias("n_arms"),
            F.max("n_rows").alias("n_one"),
            (F.sum("n_rows") - F.max("n_rows")).alias("n_other"),
            F.sum((F.col("n_rows") - F.col("__share")) ** 2 / F.col("__share")).alias("chi2"),
            (1.0 - F.sum("n") / F.sum("n_rows")).alias("missing_fraction"),
        )
    )
    two = quality.with_two_arm_srm(sizes.filter("n_arms <= 2"), "n_one", "n_other", 0.5, alpha).select(*keys, "p_value", "passed")
    many = sizes.filter("n_arms > 2").withColumn("p_value", tails.chi_square_sf("chi2", "n_arms - 1"))
    srm = two.unionByName(many.select(*keys, "p_value", (F.col("p_value") >= alpha).alias("passed")))
    nulls = sizes.select(
        *keys, "missing_fraction", F.lit(metric).alias("worst_column"), (F.col("missing_fraction") <= fixed.NULL_FRACTION_LIMIT).alias("passed")
    )
    return quality.quality_rows(keys, srm=srm, nulls=nulls)


def decision_rows(tested: DataFrame, omnibus: DataFrame, keys: list[str], alpha: float = fixed.ALPHA) -> DataFrame:
    """One row per experiment from the tests of one metric.

    Pairs count where the omnibus test is significant or there is none (two arms);
    they are adjusted within the experiment and the winner stands for it. Otherwise
    the omnibus row does.
    """
    blocked = omnibus.filter(~F.coalesce(F.col("p_value") < alpha, F.lit(False))).select(*keys)
    pairs = effects.holm(tested.join(blocked, keys, "left_anti").filter(F.col("p_value").isNotNull()), [*keys, "metric"], alpha)
    pairs = effects.mark_winner(pairs.withColumn("p_value", F.col("adj_p")), keys).withColumn("is_omnibus", F.lit(False))
    shared = {"metric", "test_type", "p_value", *keys}
    whole = omnibus.select(
        *[F.col(c) if c in shared else F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in tested.columns if c != "significant"],
        (F.col("p_value") < alpha).alias("significant"),
        F.lit(False).alias("is_winner"),
        F.lit(True).alias("is_omnibus"),
    )
    return decide.primary_rows(pairs.drop("adj_p").unionByName(whole), keys)


def analyze(
    rows: DataFrame,
    keys: list[str],
    arm: str,
    primary: str,
    guardrails: DataFrame,
    hypotheses: DataFrame,
    control: str | None = None,
    integrity: DataFrame | None = None,
    extra_metrics: list[str] | None = None,
    alpha: float = fixed.ALPHA,
) -> Analysis:
    """Validity, effects, power, guardrails and exactly one decision for every experiment of ``rows``.

    ``rows``: one row per unit. ``guardrails``: keys, metric, higher_is_better.
    ``hypotheses``: keys, expected_effect (null without one). ``control`` names the
    reference arm of all experiments; without it the label rules choose. Rows without
    an arm take no part. Experiments of any number of arms and any arm size are tested:
    small continuous arms by Welch where both look normal, else by ranks.
    """
    metrics = [primary, *(extra_metrics or [])]
    by = [*keys, "metric"]
    is_primary = F.col("metric") == primary
    # Facts are read by many branches below; writing them once keeps the unit
    # scans at one each, however many branches there are.
    moments = materialize(effects.with_metric_kind(effects.arm_moments(rows, keys, arm, metrics), keys))
    paired = effects.pair_with_control(moments, keys, control).filter(F.col("n_c").isNotNull())

    # metrics whose values are looked at again: continuous primaries, and comparisons with a small arm
    small = effects.choose_test(paired).filter(F.col("test_type") == "needs_normality").select(*by)
    continuous = moments.filter(is_primary & (F.col("metric_type") != "binary")).select(*by)
    wanted = materialize(small.union(continuous).distinct())
    # a row is known by the hash of all its columns, so samples do not depend on the values of one metric
    assigned = rows.filter(F.col(arm).isNotNull()).select(*keys, F.col(arm).cast("string").alias("arm"), F.xxhash64(*rows.columns).alias("__row"), *metrics)
    values = units.metrics_long(assigned, [*keys, "arm", "__row"], metrics).join(wanted, by, "left_semi")
    if wanted.limit(1).count():
        normal = materialize(quality.normality(values, by, "__row"))
    else:
        normal = rows.sparkSession.createDataFrame([], quality.normality(values, by, "__row").schema)

    q = quality_from_moments(moments, keys, primary)
    if continuous.limit(1).count():
        kinds = moments.filter(is_primary & (F.col("metric_type") != "binary")).select(*by, "metric_type").distinct()
        arms = quality.outlier_facts(values.join(kinds, by).drop("metric"), keys)
        shape = quality.normality_check(normal.filter(is_primary), moments.filter(is_primary & (F.col("n") > 0)), keys)
        q = q.unionByName(quality.quality_rows(keys, outliers=quality.outlier_check(arms, keys), normal=shape))
    if integrity is not None:
        q = q.unionByName(integrity)
    q = materialize(q)
    valid = decide.validity(q, keys)
    experiments = valid.select(*keys)
    invalid = materialize(valid.filter(F.col("validity") == "INVALID").select(*keys))

    testable = paired.join(invalid, keys, "left_anti")
    chosen = materialize(effects.resolve_small_samples(effects.choose_test(testable), keys, normal))
    by_rank = chosen.filter(F.col("test_type") == "mann_whitney_u").select(*by, "reference_arm", "arm")
    ranked = effects.rank_tests(values, keys, by_rank, alpha) if by_rank.limit(1).count() else None
    tested = materialize(effects.run_tests(chosen, keys, alpha, ranked))
    omnibus = effects.omnibus(moments.filter(is_primary).join(invalid, keys, "left_anti"), keys, values.filter(is_primary))
    head = decision_rows(tested.filter(is_primary), materialize(omnibus), keys, alpha).select(
        *by, "arm", "test_type", "p_value", "significant", "effect_abs", "effect_rel", F.col("mean_c").alias("base_value"), F.col("mean_t").alias("observed_value")
    )
    sized = power.power_facts(testable.filter(is_primary), alpha).select(*keys, "arm", "achieved_power", "mde_rel", "required_n", "observed_n", "powered")
    guard = tested.join(guardrails.select(*keys, "metric", "higher_is_better"), by)
    findings = decide.guardrail_findings(guard)
    status = decide.guardrail_status(findings, experiments, keys)
    facts = (
        valid.join(head.join(sized, [*keys, "arm"], "left").drop("arm"), keys, "left")
        .join(status, keys, "left")
        .join(hypotheses.select(*keys, "expected_effect"), keys, "left")
        .withColumn("has_result", F.col("p_value").isNotNull())
    )
    decisions = decide.confidence(decide.decide(decide.practical_columns(facts)))
    return Analysis(moments, q, valid, tested, sized, findings, decisions)
