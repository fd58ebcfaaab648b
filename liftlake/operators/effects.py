"""Arm moments, test selection and two-arm / many-arm comparisons.

Unit rows are read once, by the moments aggregate. Everything after it works on
facts rows: one row per (experiment, metric, arm) or per comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from liftlake.functions import fixed, tails
from liftlake.functions.arith import ratio
from liftlake.operators import ranks, units as unit_ops
from liftlake.operators.units import clean_double
from liftlake.session import hinted, materialize


def metric_kind(name: Column, all_zero_one: Column) -> Column:
    """binary / continuous_monetary / continuous_general, from values then name."""
    return (
        F.when(all_zero_one, "binary")
        .when(F.lower(name).rlike("|".join(fixed.MONETARY_WORDS)), "continuous_monetary")
        .otherwise("continuous_general")
    )


def arm_moments(units: DataFrame, keys: list[str], arm: str, metrics: list[str]) -> DataFrame:
    """Sufficient statistics per experiment, metric and arm.

    All metrics are aggregated side by side in one map-side-combined pass over
    the wide table; only the small result is reshaped to one row per metric.
    """
    aggregates = [F.count(F.lit(1)).alias("n_rows")]
    for i, m in enumerate(metrics):
        v = clean_double(m)
        aggregates += [
            F.count(v).alias(f"n{i}"),
            F.avg(v).alias(f"m{i}"),
            F.var_samp(v).alias(f"v{i}"),
            F.count_if(v == 1).cast("long").alias(f"s{i}"),
            F.count_if((v != 0) & (v != 1)).alias(f"o{i}"),
        ]
    wide = units.filter(F.col(arm).isNotNull()).groupBy(*keys, F.col(arm).cast("string").alias("arm")).agg(*aggregates)
    return stack_moments(wide, [*keys, "arm"], metrics)


def stack_moments(wide: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"n{i}").alias("n"),
                F.col(f"m{i}").alias("mean"),
                F.col(f"v{i}").alias("var"),
                F.col(f"s{i}").alias("n_success"),
                F.col(f"o{i}").alias("n_other"),
            )
            for i, m in enumerate(metrics)
        ]
    )
    return wide.select(*ids, "n_rows", F.explode(rows).alias("r")).select(*ids, "n_rows", "r.*")


def with_metric_kind(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``metric_type`` per experiment and metric over all of its arms."""
    zero_one = F.sum("n_other").over(W.partitionBy(*keys, "metric")) == 0
    return moments.withColumn("metric_type", metric_kind(F.col("metric"), zero_one))


def pair_with_control(moments: DataFrame, keys: list[str], control: str | None = None) -> DataFrame:
    """One row per treated arm holding both arms' moments.

    ``control`` names the reference arm; without it the label rules choose. The
    windows run over facts: a partition holds one experiment's arms.
    """
    by_metric = [*keys, "metric"]
    if control is None:
        named = unit_ops.with_control_arm(moments, by_metric)
    else:
        named = moments.withColumn("reference_arm", F.lit(control))
    if "metric_type" not in named.columns:
        named = with_metric_kind(named, keys)
    w = W.partitionBy(*by_metric)
    is_ref = F.col("arm") == F.col("reference_arm")

    def ref(c: str) -> Column:
        return F.max(F.when(is_ref, F.col(c))).over(w).alias(f"{c}_c")

    paired = named.select(
        *by_metric,
        "metric_type",
        "reference_arm",
        "arm",
        F.col("n_rows").alias("rows_t"),
        F.col("n").alias("n_t"),
        F.col("mean").alias("mean_t"),
        F.col("var").alias("var_t"),
        F.col("n_success").alias("success_t"),
        ref("n"),
        ref("mean"),
        ref("var"),
        F.max(F.when(is_ref, F.col("n_success"))).over(w).alias("success_c"),
        F.max(F.when(is_ref, F.col("n_rows"))).over(w).alias("rows_c"),
    )
    return paired.filter(F.col("arm") != F.col("reference_arm"))


# --- tests on paired facts --------------------------------------------------
def min_expected_cell(n_c: Column, s_c: Column, n_t: Column, s_t: Column) -> Column:
    n = (n_c + n_t).cast("double")
    s = (s_c + s_t).cast("double")
    return ratio(F.least(n_c * s, n_t * s, n_c * (n - s), n_t * (n - s)), n)


def chi_square_yates(n_c: Column, s_c: Column, n_t: Column, s_t: Column) -> Column:
    """2×2 statistic with the continuity correction (never past the expected count)."""
    a, b = s_c.cast("double"), (n_c - s_c).cast("double")
    c, d = s_t.cast("double"), (n_t - s_t).cast("double")
    n = a + b + c + d
    excess = ratio(F.abs(a * d - b * c), n)
    corrected = excess - F.least(F.lit(0.5), excess)
    return ratio(corrected**2 * n**3, (a + b) * (c + d) * (a + c) * (b + d))


def fisher_exact(n_c: Column, s_c: Column, n_t: Column, s_t: Column) -> Column:
    """Two-sided p: tables at most as likely as the observed one.

    Weights relative to the observed table are walked outwards by the ratio of
    neighbouring hypergeometric terms, so no factorial is evaluated.
    """
    a = s_c.cast("long")
    row, col, n = n_c.cast("long"), (s_c + s_t).cast("long"), (n_c + n_t).cast("long")
    lo = F.greatest(F.lit(0), row + col - n)
    hi = F.least(row, col)
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("all"), F.lit(0.0).alias("tail"))

    def walk(ratio):
        def step(acc, k):
            w = acc["w"] * ratio(k.cast("double"))
            return F.struct(
                w.alias("w"),
                (acc["all"] + w).alias("all"),
                (acc["tail"] + F.when(w <= 1.0 + 1e-7, w).otherwise(0.0)).alias("tail"),
            )

        return step

    r, c, m = row.cast("double"), col.cast("double"), n.cast("double")
    empty = F.array().cast("array<bigint>")
    up = F.aggregate(
        F.when(a < hi, F.sequence(a, hi - 1)).otherwise(empty),
        start,
        walk(lambda k: (r - k) * (c - k) / ((k + 1) * (m - r - c + k + 1))),
    )
    down = F.aggregate(
        F.when(a > lo, F.sequence(a, lo + 1, F.lit(-1).cast("bigint"))).otherwise(empty),
        start,
        walk(lambda k: k * (m - r - c + k) / ((r - k + 1) * (c - k + 1))),
    )
    total = 1.0 + up["all"] + down["all"]
    p = F.least(F.lit(1.0), (1.0 + up["tail"] + down["tail"]) / total)
    return F.when(F.isnan(total) | (total == float("inf")), F.lit(0.0)).otherwise(p)


def odds_ratio(n_c: Column, s_c: Column, n_t: Column, s_t: Column) -> Column:
    top, bottom = (s_c * (n_t - s_t)).cast("double"), (s_t * (n_c - s_c)).cast("double")
    return F.when(bottom > 0, top / bottom).when(top > 0, F.lit(float("inf")))


def welch_columns(n_c: Column, mean_c: Column, var_c: Column, n_t: Column, mean_t: Column, var_t: Column):
    """t, Satterthwaite df and the standard error."""
    a, b = ratio(var_c, n_c), ratio(var_t, n_t)
    se = F.sqrt(a + b)
    df = ratio((a + b) ** 2, ratio(a**2, n_c - 1) + ratio(b**2, n_t - 1))
    return ratio(mean_t - mean_c, se), df, se


def choose_test(paired: DataFrame) -> DataFrame:
    """Add ``test_type`` from moments alone; small continuous arms stay ``needs_normality``."""
    large = (F.col("n_c") >= fixed.LARGE_ARM) & (F.col("n_t") >= fixed.LARGE_ARM)
    expected = min_expected_cell(F.col("n_c"), F.col("success_c"), F.col("n_t"), F.col("success_t"))
    return paired.withColumn("min_expected", F.when(F.col("metric_type") == "binary", expected)).withColumn(
        "test_type",
        F.when((F.col("n_c") == 0) | (F.col("n_t") == 0) | F.col("n_c").isNull(), F.lit("not_testable"))
        .when(
            F.col("metric_type") == "binary",
            F.when(F.col("min_expected") < fixed.MIN_EXPECTED_CELL, "fishers_exact").otherwise("chi_square"),
        )
        .when(large, "welch_t_test")
        .otherwise("needs_normality"),
    )


def resolve_small_samples(chosen: DataFrame, keys: list[str], normal: DataFrame) -> DataFrame:
    """Welch where both arms pass the normality screen, Mann-Whitney otherwise.

    ``normal`` is ``quality.normality`` over keys + metric + arm.
    """
    by = [*keys, "metric"]
    flags = normal.select(*by, "arm", "normal")
    treated = flags.withColumnRenamed("normal", "__nt")
    control = flags.withColumnRenamed("normal", "__nc").withColumnRenamed("arm", "reference_arm")
    both = F.coalesce(F.col("__nt") & F.col("__nc"), F.lit(False))
    return (
        chosen.join(treated, [*by, "arm"], "left")
        .join(control, [*by, "reference_arm"], "left")
        .withColumn(
            "test_type",
            F.when(F.col("test_type") != "needs_normality", F.col("test_type"))
            .when(F.col("__nt").isNull() | F.col("__nc").isNull(), "not_testable")
            .when(both, "welch_t_test")
            .otherwise("mann_whitney_u"),
        )
        .drop("__nt", "__nc")
    )


EFFECT_COLUMNS = [
    "metric_type", "reference_arm", "arm", "test_type", "statistic", "p_value", "n_c", "n_t", "mean_c", "mean_t",
    "effect_abs", "effect_rel", "ci_lower", "ci_upper", "significant",
]


def run_tests(chosen: DataFrame, keys: list[str], alpha: float = fixed.ALPHA, ranked: DataFrame | None = None) -> DataFrame:
    """The effects facts table, one row per comparison.

    ``ranked`` supplies Mann-Whitney facts (keys, metric, arm, u_statistic,
    p_value, median_c, median_t and a resampled ci_lower / ci_upper) for the
    rows that need them; see ``rank_tests``.
    """
    by = [*keys, "metric"]
    if ranked is not None:
        extra = ranked.select(
            *by,
            "arm",
            F.col("u_statistic").alias("__u"),
            F.col("p_value").alias("__mw_p"),
            *[F.col(c).alias(f"__{c}") for c in ("median_c", "median_t", "ci_lower", "ci_upper")],
        )
        chosen = chosen.join(extra, [*by, "arm"], "left")
    else:
        for c in ("u", "mw_p", "median_c", "median_t", "ci_lower", "ci_upper"):
            chosen = chosen.withColumn(f"__{c}", F.lit(None).cast("double"))
    n_c, n_t, s_c, s_t = (F.col(c) for c in ("n_c", "n_t", "success_c", "success_t"))
    kind = F.col("test_type")
    binary = kind.isin("chi_square", "fishers_exact")
    rank = kind == "mann_whitney_u"
    t, df, se = welch_columns(n_c, F.col("mean_c"), F.col("var_c"), n_t, F.col("mean_t"), F.col("var_t"))
    base = F.when(rank, F.col("__median_c")).otherwise(F.col("mean_c"))
    seen = F.when(rank, F.col("__median_t")).otherwise(F.col("mean_t"))
    wald = F.sqrt(ratio(F.col("mean_c") * (1 - F.col("mean_c")), n_c) + ratio(F.col("mean_t") * (1 - F.col("mean_t")), n_t))
    staged = (
        chosen.filter(kind != "not_testable")
        .withColumn("__t", F.when(kind == "welch_t_test", t))
        .withColumn("__df", F.when(kind == "welch_t_test", df))
        .withColumn("effect_abs", seen - base)
        .withColumn("effect_rel", F.when(base != 0, (seen - base) / base))
        .withColumn(
            "statistic",
            F.when(kind == "chi_square", chi_square_yates(n_c, s_c, n_t, s_t))
            .when(kind == "fishers_exact", odds_ratio(n_c, s_c, n_t, s_t))
            .when(rank, F.col("__u"))
            .otherwise(F.col("__t")),
        )
        .withColumn(
            "p_value",
            F.when(kind == "chi_square", tails.normal_two_sided("sqrt(statistic)"))
            .when(kind == "fishers_exact", fisher_exact(n_c, s_c, n_t, s_t))
            .when(rank, F.col("__mw_p"))
            .otherwise(tails.student_t_two_sided("__t", "__df")),
        )
        .withColumn(
            "__half",
            F.when(binary, F.lit(tails.z_quantile(1 - alpha / 2)) * wald).when(
                kind == "welch_t_test", tails.student_t_critical("__df", alpha) * se
            ),
        )
        .withColumn("ci_lower", F.when(rank, F.col("__ci_lower")).otherwise(F.col("effect_abs") - F.col("__half")))
        .withColumn("ci_upper", F.when(rank, F.col("__ci_upper")).otherwise(F.col("effect_abs") + F.col("__half")))
        .withColumn("significant", F.col("p_value") < alpha)
    )
    return staged.select(*by, *EFFECT_COLUMNS)


def compare_arms(
    units: DataFrame, keys: list[str], arm: str, metrics: list[str], control: str | None = None, alpha: float = fixed.ALPHA
) -> DataFrame:
    """Control against every other arm on moments alone (large-sample path)."""
    paired = pair_with_control(arm_moments(units, keys, arm, metrics), keys, control)
    return run_tests(choose_test(paired).filter(F.col("test_type") != "needs_normality"), keys, alpha)


# --- many arms ---------------------------------------------------------------
def omnibus_chi_square(moments: DataFrame, keys: list[str]) -> DataFrame:
    """k×2 independence test without correction."""
    by = [*keys, "metric"]
    held = moments.filter(F.col("n") > 0)
    w = W.partitionBy(*by)
    rate = (F.sum("n_success").over(w) / F.sum("n").over(w)).cast("double")
    cell = held.withColumn("__r", rate).withColumn("__e", F.col("n") * F.col("__r"))
    part = (F.col("n_success") - F.col("__e")) ** 2
    g = (
        cell.groupBy(*by)
        .agg(
            F.count(F.lit(1)).cast("int").alias("n_arms"),
            F.sum(ratio(part, F.col("__e")) + ratio(part, F.col("n") - F.col("__e"))).alias("statistic"),
        )
        .filter(F.col("n_arms") >= 3)
    )
    return g.withColumn("p_value", tails.chi_square_sf("statistic", "n_arms - 1")).withColumn(
        "test_type", F.lit("chi_square")
    )


def omnibus_anova(moments: DataFrame, keys: list[str]) -> DataFrame:
    """One-way ANOVA from arm moments."""
    by = [*keys, "metric"]
    held = moments.filter(F.col("n") > 0)
    w = W.partitionBy(*by)
    grand = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    g = (
        held.withColumn("__g", grand)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).cast("int").alias("n_arms"),
            F.sum("n").alias("__n"),
            F.sum(F.col("n") * (F.col("mean") - F.col("__g")) ** 2).alias("__ssb"),
            F.sum((F.col("n") - 1) * F.coalesce(F.col("var"), F.lit(0.0))).alias("__ssw"),
        )
        .filter(F.col("n_arms") >= 3)
    )
    d1, d2 = F.col("n_arms") - 1, F.col("__n") - F.col("n_arms")
    return (
        g.withColumn("statistic", ratio(F.col("__ssb") / d1, ratio(F.col("__ssw"), d2)))
        .withColumn("p_value", tails.f_sf("statistic", "n_arms - 1", "__n - n_arms"))
        .withColumn("test_type", F.lit("one_way_anova"))
        .drop("__n", "__ssb", "__ssw")
    )


def omnibus(moments: DataFrame, keys: list[str], long: DataFrame | None = None) -> DataFrame:
    """χ² for binary metrics; ANOVA when every arm has 30 values; Kruskal-Wallis otherwise.

    ``long`` (keys, metric, arm, value) feeds the rank test; only experiments
    that need it are ranked. Without it such experiments are left out.
    """
    by = [*keys, "metric"]
    typed = with_metric_kind(moments, keys) if "metric_type" not in moments.columns else moments
    smallest = F.min(F.when(F.col("n") > 0, F.col("n"))).over(W.partitionBy(*by))
    typed = typed.withColumn("__min", smallest)
    names = [*by, "n_arms", "test_type", "statistic", "p_value"]
    parts = [
        omnibus_chi_square(typed.filter(F.col("metric_type") == "binary"), keys).select(*names),
        omnibus_anova(
            typed.filter((F.col("metric_type") != "binary") & (F.col("__min") >= fixed.LARGE_ARM)), keys
        ).select(*names),
    ]
    if long is not None:
        small = (
            typed.filter((F.col("metric_type") != "binary") & (F.col("__min") < fixed.LARGE_ARM)).select(*by).distinct()
        )
        kw = ranks.kruskal_wallis(ranks.arm_ranks(long.join(small, by, "left_semi"), by), by).filter(F.col("n_arms") >= 3)
        parts.append(kw.withColumn("test_type", F.lit("kruskal_wallis")).select(*names))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def gated_pairs(pairs: DataFrame, omnibus_rows: DataFrame, keys: list[str], alpha: float = fixed.ALPHA) -> DataFrame:
    """Pairwise rows of experiments whose omnibus test is significant, Holm-adjusted."""
    by = [*keys, "metric"]
    return holm(pairs.join(omnibus_rows.filter(F.col("p_value") < alpha).select(*by), by, "left_semi"), by, alpha)


def holm(tests: DataFrame, family: list[str], alpha: float = fixed.ALPHA, p: str = "p_value", ties: str = "arm") -> DataFrame:
    """Step-down adjustment within a family; adds ``adj_p`` and re-decides ``significant``."""
    w = W.partitionBy(*family)
    ordered = w.orderBy(p, ties)
    raw = F.least(F.lit(1.0), (F.count(F.lit(1)).over(w) - F.row_number().over(ordered) + 1) * F.col(p))
    stepped = tests.withColumn("__raw", raw)
    return (
        stepped.withColumn("adj_p", F.max("__raw").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
        .drop("__raw")
        .withColumn("significant", F.col("adj_p") < alpha)
    )


def mark_winner(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Flag the largest positive effect among significant pairs, else among all pairs.

    When nothing is significant every pair competes; when no competing effect is
    positive the largest one is taken.
    """
    w = W.partitionBy(*keys, "metric").orderBy(
        F.desc("significant"), F.desc(F.coalesce(F.col("effect_rel") > 0, F.lit(False))), F.desc_nulls_last("effect_rel"), "arm"
    )
    return pairs.withColumn("is_winner", F.row_number().over(w) == 1)


def practical_flags(pairs: DataFrame, keys: list[str], mde: DataFrame) -> DataFrame:
    """|effect| against the winner's detectable effect (``mde_rel``, percent)."""
    by = [*keys, "metric"]
    return pairs.join(mde.select(*by, F.abs("mde_rel").alias("mde_rel")), by, "left").withColumn(
        "practical_significant", F.abs(F.col("effect_rel") * 100) >= F.col("mde_rel")
    )


# --- rank path ---------------------------------------------------------------
def rank_tests(
    long: DataFrame,
    keys: list[str],
    pairs: DataFrame,
    alpha: float = fixed.ALPHA,
    draws: int = 2000,
    seed: int = 42,
    parts: int | None = None,
) -> DataFrame:
    """Mann-Whitney facts for the comparisons in ``pairs`` (keys, metric, reference_arm, arm).

    A control arm's rows are needed once per treated arm, so arms are expanded
    per comparison before counting; only comparisons that need ranks reach here.
    """
    from liftlake.operators import resampling

    by = [*keys, "metric"]
    wanted = pairs.select(*by, "reference_arm", F.col("arm").alias("compared"))
    sides = wanted.select(
        *by, "compared", F.explode(F.array(F.struct(F.col("compared").alias("arm"), F.lit(False).alias("is_control")),
                                           F.struct(F.col("reference_arm").alias("arm"), F.lit(True).alias("is_control")))).alias("s")
    ).select(*by, "compared", "s.arm", "s.is_control")
    rows = long.join(sides, [*by, "arm"]).withColumn("side", F.when(F.col("is_control"), "control").otherwise("treated"))
    group = [*by, "compared"]
    sided = [*group, "side"]
    # counted once, then ranked pooled (the test) and per side (medians, interval)
    counts = materialize(ranks.value_counts(rows, group, by="side"))
    facts = ranks.mann_whitney(ranks.arm_ranks_of_counts(counts, group, "side", parts), group, F.lit("control"), "side")
    facts = resampling.with_exact_mann_whitney(facts)
    ranked = ranks.ranked_counts(counts, sided, parts)
    medians = ranks.quantiles_of_ranked(ranked, sided, {"median": 0.5})
    wide = medians.groupBy(*group).agg(
        F.max(F.when(F.col("side") == "control", F.col("median"))).alias("median_c"),
        F.max(F.when(F.col("side") == "treated", F.col("median"))).alias("median_t"),
    )
    ci = resampling.median_bootstrap_of_ranked(ranked, group, "side", "control", draws, alpha, seed)
    wide, ci = hinted(counts, wide, ci)
    return facts.join(wide, group).join(ci, group, "left").withColumnRenamed("compared", "arm")
