"""Moments, tests, many arms, power, covariate adjustment and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftlake.functions import fixed, tails
from liftlake.operators import effects, power, quality, ranks, resampling, segments, units, variance
from liftlake.plans import testbed as tb
from liftlake.plans.registry import query

KEY = ["experiment_id"]
METRICS = ["revenue", "refund", "units"]


def _r(df, digits: dict[str, int]):
    for c, n in digits.items():
        df = df.withColumn(c, F.round(c, n))
    return df


MOMENTS = f"""WITH {tb.SUPPLIER_UNITS},
lg AS (SELECT experiment_id, arm, 'revenue' AS metric, revenue AS value FROM su
  UNION ALL SELECT experiment_id, arm, 'refund', CAST(refund AS DOUBLE) FROM su UNION ALL SELECT experiment_id, arm, 'units', units FROM su),
mo AS (SELECT experiment_id, metric, arm, count(*) AS n_rows, count(value) AS n, avg(value) AS mean, var_samp(value) AS var,
  CAST(sum(CASE WHEN value = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_success FROM lg GROUP BY 1, 2, 3),
pr AS (SELECT c.experiment_id, c.metric, c.n AS n_c, t.n AS n_t, c.mean AS mean_c, t.mean AS mean_t, c.var AS var_c, t.var AS var_t, c.n_success AS s_c, t.n_success AS s_t
  FROM mo c JOIN mo t ON c.experiment_id = t.experiment_id AND c.metric = t.metric AND c.arm = 'control' AND t.arm = 'treatment')"""

TESTS = (
    MOMENTS
    + f""",
wl AS (SELECT *, sqrt(var_c / n_c + var_t / n_t) AS se, (mean_t - mean_c) / sqrt(var_c / n_c + var_t / n_t) AS t,
  pow(var_c / n_c + var_t / n_t, 2) / (pow(var_c / n_c, 2) / (n_c - 1) + pow(var_t / n_t, 2) / (n_t - 1)) AS df FROM pr WHERE metric <> 'refund'),
wp AS (SELECT experiment_id, metric, 'welch_t_test' AS test_type, n_c, n_t, mean_c, mean_t, t AS statistic, {tb.sql_t2('t', 'df')} AS p_value,
  mean_t - mean_c AS effect_abs, (mean_t - mean_c) / mean_c AS effect_rel,
  mean_t - mean_c - {tb.sql_t_crit('df')} * se AS ci_lower, mean_t - mean_c + {tb.sql_t_crit('df')} * se AS ci_upper FROM wl),
ch AS (SELECT *, n_c + n_t AS nn, s_c + s_t AS ss, abs(s_c::DOUBLE * (n_t - s_t) - (n_c - s_c)::DOUBLE * s_t) / (n_c + n_t) AS ex FROM pr WHERE metric = 'refund'),
cs AS (SELECT *, pow(ex - least(0.5, ex), 2) * pow(nn, 3) / (n_c::DOUBLE * n_t * ss * (nn - ss)) AS chi2,
  1.959963984540054::DOUBLE * sqrt(mean_c * (1 - mean_c) / n_c + mean_t * (1 - mean_t) / n_t) AS half FROM ch),
cp AS (SELECT experiment_id, metric, 'chi_square' AS test_type, n_c, n_t, mean_c, mean_t, chi2 AS statistic, {tb.sql_normal2('sqrt(chi2)')} AS p_value,
  mean_t - mean_c AS effect_abs, CASE WHEN mean_c <> 0 THEN (mean_t - mean_c) / mean_c END AS effect_rel, mean_t - mean_c - half AS ci_lower, mean_t - mean_c + half AS ci_upper FROM cs),
ef AS (SELECT * FROM wp UNION ALL SELECT * FROM cp)"""
)
EFFECT_OUT = """experiment_id, metric, test_type, n_c, n_t, round(mean_c, 4) AS mean_c, round(mean_t, 4) AS mean_t, round(statistic, 5) AS statistic,
 round(p_value, 6) AS p_value, round(effect_abs, 4) AS effect_abs, round(effect_rel, 6) AS effect_rel, round(ci_lower, 3) AS ci_lower, round(ci_upper, 3) AS ci_upper,
 p_value < 0.05 AS significant"""


def _effect_out(df):
    return _r(
        df.select("experiment_id", "metric", "test_type", "n_c", "n_t", "mean_c", "mean_t", "statistic", "p_value", "effect_abs", "effect_rel", "ci_lower", "ci_upper", "significant"),
        {"mean_c": 4, "mean_t": 4, "statistic": 5, "p_value": 6, "effect_abs": 4, "effect_rel": 6, "ci_lower": 3, "ci_upper": 3},
    )


@query(
    "effects_moments",
    MOMENTS + " SELECT experiment_id, metric, arm, n_rows, n, round(mean, 4) AS mean, round(sqrt(var), 4) AS sd, n_success FROM mo",
)
def moments(spark, sf_dir):
    m = effects.arm_moments(tb.supplier_units(spark, sf_dir), KEY, "arm", METRICS)
    return m.select("experiment_id", "metric", "arm", "n_rows", "n", F.round("mean", 4).alias("mean"), F.round(F.sqrt("var"), 4).alias("sd"), "n_success")


@query(
    "effects_test_choice",
    f"""WITH {tb.SUPPLIER_ROWS},
mo AS (SELECT experiment_id, part % 40 AS slice, arm, count(*) AS n, CAST(sum(CASE WHEN quantity > 45 THEN 1 ELSE 0 END) AS BIGINT) AS s FROM sr GROUP BY 1, 2, 3),
pr AS (SELECT c.experiment_id, c.slice, c.n AS n_c, t.n AS n_t, c.s AS s_c, t.s AS s_t,
  least(c.n * (c.s + t.s), t.n * (c.s + t.s), c.n * (c.n + t.n - c.s - t.s), t.n * (c.n + t.n - c.s - t.s))::DOUBLE / (c.n + t.n) AS e
  FROM mo c JOIN mo t ON c.experiment_id = t.experiment_id AND c.slice = t.slice AND c.arm = 'control' AND t.arm = 'treatment')
SELECT experiment_id, slice, n_c, n_t, round(e, 6) AS min_expected, CASE WHEN e < 5 THEN 'fishers_exact' ELSE 'chi_square' END AS test_type FROM pr""",
)
def test_choice(spark, sf_dir):
    rows = tb.supplier_rows(spark, sf_dir).withColumn("slice", F.col("part") % 40).withColumn("large", (F.col("quantity") > 45).cast("int"))
    by = ["experiment_id", "slice"]
    chosen = effects.choose_test(effects.pair_with_control(effects.arm_moments(rows, by, "arm", ["large"]), by, "control"))
    return chosen.filter(F.col("n_c").isNotNull()).select(*by, "n_c", "n_t", F.round("min_expected", 6).alias("min_expected"), "test_type")


@query("effects_two_arm", TESTS + f" SELECT {EFFECT_OUT} FROM ef")
def two_arm(spark, sf_dir):
    return _effect_out(effects.compare_arms(tb.supplier_units(spark, sf_dir), KEY, "arm", METRICS, "control"))


@query(
    "effects_chi_square",
    TESTS + " SELECT experiment_id, n_c, n_t, s_c, s_t, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value FROM cp JOIN (SELECT experiment_id, s_c, s_t FROM cs) USING (experiment_id)",
)
def chi_square(spark, sf_dir):
    paired = effects.pair_with_control(effects.arm_moments(tb.supplier_units(spark, sf_dir), KEY, "arm", ["refund"]), KEY, "control")
    out = paired.select(
        "experiment_id", "n_c", "n_t", F.col("success_c").alias("s_c"), F.col("success_t").alias("s_t"),
        effects.chi_square_yates(F.col("n_c"), F.col("success_c"), F.col("n_t"), F.col("success_t")).alias("statistic"),
    )
    return _r(out.withColumn("p_value", tails.normal_two_sided("sqrt(statistic)")), {"statistic": 6, "p_value": 6})


@query(
    "effects_fisher_exact",
    f"""WITH {tb.SUPPLIER_ROWS},
mo AS (SELECT experiment_id, arm, part % 40 AS slice, count(*) AS n, CAST(sum(CASE WHEN quantity > 45 THEN 1 ELSE 0 END) AS BIGINT) AS s FROM sr GROUP BY ALL),
pr AS (SELECT c.experiment_id, c.slice, c.n AS n_c, t.n AS n_t, c.s AS s_c, t.s AS s_t, c.s + t.s AS k, c.n + t.n AS m
  FROM mo c JOIN mo t ON c.experiment_id = t.experiment_id AND c.slice = t.slice AND c.arm = 'control' AND t.arm = 'treatment'),
tb AS (SELECT *, unnest(generate_series(greatest(0, k - n_t), least(n_c, k))) AS a FROM pr),
lp AS (SELECT *, lgamma(n_c + 1) - lgamma(a + 1) - lgamma(n_c - a + 1) + lgamma(n_t + 1) - lgamma(k - a + 1) - lgamma(n_t - k + a + 1) AS w FROM tb),
pp AS (SELECT *, exp(w - max(w) OVER g) AS q, max(CASE WHEN a = s_c THEN w END) OVER g AS w0, max(w) OVER g AS wm FROM lp WINDOW g AS (PARTITION BY experiment_id, slice))
SELECT experiment_id, slice, n_c, n_t, s_c, s_t, round(sum(CASE WHEN q <= exp(w0 - wm) * (1 + 1e-7) THEN q ELSE 0 END) / sum(q), 6) AS p_value
FROM pp GROUP BY ALL""",
)
def fisher(spark, sf_dir):
    rows = tb.supplier_rows(spark, sf_dir).withColumn("slice", F.col("part") % 40).withColumn("large", (F.col("quantity") > 45).cast("int"))
    by = ["experiment_id", "slice"]
    paired = effects.pair_with_control(effects.arm_moments(rows, by, "arm", ["large"]), by, "control").filter(F.col("n_c").isNotNull())
    p = effects.fisher_exact(F.col("n_c"), F.col("success_c"), F.col("n_t"), F.col("success_t"))
    return paired.select(*by, "n_c", "n_t", F.col("success_c").alias("s_c"), F.col("success_t").alias("s_t"), F.round(p, 6).alias("p_value"))


@query(
    "effects_wald_interval",
    TESTS + " SELECT experiment_id, round(effect_abs * 100, 6) AS diff_pp, round(ci_lower * 100, 6) AS lower_pp, round(ci_upper * 100, 6) AS upper_pp, round(effect_rel, 6) AS effect_rel FROM cp",
)
def wald(spark, sf_dir):
    ef = effects.compare_arms(tb.supplier_units(spark, sf_dir), KEY, "arm", ["refund"], "control")
    return ef.select(
        "experiment_id", F.round(F.col("effect_abs") * 100, 6).alias("diff_pp"), F.round(F.col("ci_lower") * 100, 6).alias("lower_pp"),
        F.round(F.col("ci_upper") * 100, 6).alias("upper_pp"), F.round("effect_rel", 6).alias("effect_rel"),
    )


@query(
    "effects_welch",
    TESTS + " SELECT experiment_id, metric, round(statistic, 6) AS t, round(p_value, 6) AS p_value, round(ci_lower, 3) AS ci_lower, round(ci_upper, 3) AS ci_upper FROM wp",
)
def welch(spark, sf_dir):
    ef = effects.compare_arms(tb.supplier_units(spark, sf_dir), KEY, "arm", ["revenue", "units"], "control")
    return _r(ef.select("experiment_id", "metric", F.col("statistic").alias("t"), "p_value", "ci_lower", "ci_upper"), {"t": 6, "p_value": 6, "ci_lower": 3, "ci_upper": 3})


RANKS = """rk0 AS (SELECT experiment_id, arm, value, CAST(rank() OVER (PARTITION BY experiment_id ORDER BY value) AS DOUBLE) + (count(*) OVER (PARTITION BY experiment_id, value) - 1) / 2.0::DOUBLE AS r,
   count(*) OVER (PARTITION BY experiment_id, value) AS t FROM lg),
ti AS (SELECT experiment_id, sum(pow(t, 3) - t) AS ties FROM (SELECT DISTINCT experiment_id, value, t FROM rk0) GROUP BY 1),
rs AS (SELECT experiment_id, arm, count(*) AS n, sum(r) AS rank_sum FROM rk0 GROUP BY 1, 2)"""


@query(
    "effects_mann_whitney",
    f"""WITH {tb.SUPPLIER_UNITS}, lg AS (SELECT experiment_id, arm, units AS value FROM su), {RANKS},
g AS (SELECT c.experiment_id, c.n AS n_control, t.n AS n_treated, t.rank_sum - t.n * (t.n + 1) / 2.0::DOUBLE AS u, ties, (c.n + t.n)::DOUBLE AS nn
  FROM rs c JOIN rs t ON c.experiment_id = t.experiment_id AND c.arm = 'control' AND t.arm = 'treatment' JOIN ti ON ti.experiment_id = c.experiment_id),
z AS (SELECT *, (greatest(u, n_control * n_treated - u) - n_control * n_treated / 2.0::DOUBLE - 0.5::DOUBLE)
   / sqrt(n_control * n_treated / 12.0::DOUBLE * (nn + 1 - ties / (nn * (nn - 1)))) AS z FROM g)
SELECT experiment_id, n_control, n_treated, round(u, 1) AS u_statistic, round(least(1.0::DOUBLE, 2 * {tb.sql_normal_sf('z')}), 6) AS p_value FROM z""",
)
def mann_whitney(spark, sf_dir):
    long = tb.supplier_units(spark, sf_dir).select("experiment_id", "arm", F.col("units").alias("value"))
    mw = ranks.mann_whitney(ranks.arm_ranks(long, KEY), KEY, F.lit("control"))
    return _r(mw.drop("exact_needed"), {"u_statistic": 1, "p_value": 6})


@query(
    "effects_kruskal_wallis",
    f"""WITH lg AS (SELECT o_orderpriority AS experiment_id, o_orderstatus AS arm, round(o_totalprice / 1000, 0) AS value FROM orders), {RANKS},
g AS (SELECT experiment_id, CAST(count(*) AS INTEGER) AS n_arms, CAST(sum(n) AS BIGINT) AS n, sum(rank_sum * rank_sum / n) AS s FROM rs GROUP BY 1),
h AS (SELECT g.experiment_id, n_arms, n, (12.0::DOUBLE / (n::DOUBLE * (n + 1)) * s - 3.0::DOUBLE * (n + 1)) / (1 - ties / (pow(n, 3) - n)) AS h FROM g JOIN ti USING (experiment_id))
SELECT experiment_id, n_arms, n, round(h, 5) AS statistic, round(exp(-h / 2), 6) AS p_value FROM h""",
)
def kruskal(spark, sf_dir):
    long = tb.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("experiment_id"), F.col("o_orderstatus").alias("arm"), F.round(F.col("o_totalprice") / 1000, 0).alias("value")
    )
    return _r(ranks.kruskal_wallis(ranks.arm_ranks(long, KEY), KEY), {"statistic": 5, "p_value": 6})


@query("effects_small_samples")
def small_samples(spark, sf_dir):
    """Supplier x part-group experiments with few units: normality decides Welch or Mann-Whitney; resampled medians."""
    su = tb.supplier_rows(spark, sf_dir).withColumn("slice", F.col("part") % 20)
    by = ["experiment_id", "slice"]
    rows = su.select(*by, F.concat_ws("/", "unit_id", "row_order", "part").alias("unit_id"), "arm", "quantity")
    long = units.metrics_long(rows, [*by, "unit_id", "arm"], ["quantity"])
    chosen = effects.choose_test(effects.pair_with_control(effects.arm_moments(rows, by, "arm", ["quantity"]), by, "control"))
    normal = quality.normality(long, [*by, "metric"], "unit_id")
    resolved = effects.resolve_small_samples(chosen, by, normal)
    need = resolved.filter(F.col("test_type") == "mann_whitney_u")
    ranked = effects.rank_tests(long, by, need)
    return effects.run_tests(resolved, by, ranked=ranked)


@query("effects_median_bootstrap")
def median_bootstrap(spark, sf_dir):
    """Percentile interval of the median difference for every supplier experiment, 2,000 draws."""
    long = tb.supplier_units(spark, sf_dir).select("experiment_id", "arm", F.col("revenue").alias("value"))
    return resampling.median_bootstrap(long, KEY, "arm", "control")


# --- many arms ---------------------------------------------------------------------
ARM3 = f"""WITH {tb.CUSTOMER_UNITS},
lg AS (SELECT experiment_id, arm3 AS arm, segment, 'lifted3' AS metric, v3 AS value FROM (SELECT *, lifted_value * (CASE arm3 WHEN 'b' THEN 1.1::DOUBLE WHEN 'c' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END) AS v3 FROM cu)
  UNION ALL SELECT experiment_id, arm3, segment, 'won', CASE WHEN lifted_value * (CASE arm3 WHEN 'b' THEN 1.1::DOUBLE WHEN 'c' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END) > 2000000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM cu),
mo AS (SELECT segment AS experiment_id, metric, arm, count(value) AS n, avg(value) AS mean, var_samp(value) AS var, CAST(sum(CASE WHEN value = 1 THEN 1 ELSE 0 END) AS BIGINT) AS s FROM lg GROUP BY 1, 2, 3),
ow AS (SELECT *, sum(s) OVER w / (sum(n) OVER w)::DOUBLE AS rate, sum(n * mean) OVER w / sum(n) OVER w AS grand FROM mo WINDOW w AS (PARTITION BY experiment_id, metric)),
oc AS (SELECT experiment_id, metric, CAST(count(*) AS INTEGER) AS n_arms, 'chi_square' AS test_type, sum(pow(s - n * rate, 2) / (n * rate) + pow(s - n * rate, 2) / (n * (1 - rate))) AS statistic FROM ow WHERE metric = 'won' GROUP BY 1, 2),
oa AS (SELECT experiment_id, metric, CAST(count(*) AS INTEGER) AS n_arms, 'one_way_anova' AS test_type, sum(n) - count(*) AS d2,
  (sum(n * pow(mean - grand, 2)) / (count(*) - 1)) / (sum((n - 1) * var) / (sum(n) - count(*))) AS statistic FROM ow WHERE metric = 'lifted3' GROUP BY 1, 2),
om AS (SELECT experiment_id, metric, n_arms, test_type, statistic, exp(-statistic / 2) AS p_value FROM oc
  UNION ALL SELECT experiment_id, metric, n_arms, test_type, statistic, {tb.sql_f_sf('statistic', '(n_arms - 1)', 'd2::DOUBLE')} FROM oa)"""


def _arm3(spark, sf_dir):
    cu = tb.customer_units(spark, sf_dir)
    v = F.col("lifted_value") * F.when(F.col("arm3") == "b", 1.1).when(F.col("arm3") == "c", 0.9).otherwise(1.0)
    return cu.select(F.col("segment").alias("experiment_id"), "unit_id", F.col("arm3").alias("arm"), v.alias("lifted3"), (v > 2000000).cast("int").alias("won"))


@query(
    "effects_omnibus_chi_square",
    ARM3 + " SELECT experiment_id, metric, n_arms, test_type, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value FROM om WHERE metric = 'won'",
)
def omnibus_chi(spark, sf_dir):
    m = effects.arm_moments(_arm3(spark, sf_dir), KEY, "arm", ["won"])
    return _r(effects.omnibus_chi_square(m, KEY).select("experiment_id", "metric", "n_arms", "test_type", "statistic", "p_value"), {"statistic": 6, "p_value": 6})


@query(
    "effects_omnibus_anova",
    ARM3 + " SELECT experiment_id, metric, n_arms, test_type, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value FROM om WHERE metric = 'lifted3'",
)
def omnibus_anova(spark, sf_dir):
    m = effects.arm_moments(_arm3(spark, sf_dir), KEY, "arm", ["lifted3"])
    return _r(effects.omnibus_anova(m, KEY).select("experiment_id", "metric", "n_arms", "test_type", "statistic", "p_value"), {"statistic": 6, "p_value": 6})


PAIRS3 = (
    ARM3
    + f""",
pr AS (SELECT c.experiment_id, c.metric, t.arm, c.n AS n_c, t.n AS n_t, c.mean AS mean_c, t.mean AS mean_t, c.var AS var_c, t.var AS var_t, c.s AS s_c, t.s AS s_t
  FROM mo c JOIN mo t ON c.experiment_id = t.experiment_id AND c.metric = t.metric AND c.arm = 'control' AND t.arm <> 'control'),
p1 AS (SELECT experiment_id, metric, arm, n_c, n_t, mean_c, mean_t, (mean_t - mean_c) / mean_c AS effect_rel, (mean_t - mean_c) / sqrt(var_c / n_c + var_t / n_t) AS t,
  pow(var_c / n_c + var_t / n_t, 2) / (pow(var_c / n_c, 2) / (n_c - 1) + pow(var_t / n_t, 2) / (n_t - 1)) AS df,
  pow(greatest(abs(s_c::DOUBLE * (n_t - s_t) - (n_c - s_c)::DOUBLE * s_t) / (n_c + n_t) - 0.5, 0), 2) * pow(n_c + n_t, 3) / (n_c::DOUBLE * n_t * (s_c + s_t) * (n_c + n_t - s_c - s_t)) AS chi2 FROM pr),
pv AS (SELECT *, CASE WHEN metric = 'won' THEN {tb.sql_normal2('sqrt(chi2)')} ELSE {tb.sql_t2('t', 'df')} END AS p_value FROM p1),
gt AS (SELECT pv.* FROM pv JOIN om USING (experiment_id, metric) WHERE om.p_value < 0.05),
ho AS (SELECT *, least(1.0::DOUBLE, (count(*) OVER f - row_number() OVER (PARTITION BY experiment_id, metric ORDER BY p_value, arm) + 1) * p_value) AS raw FROM gt WINDOW f AS (PARTITION BY experiment_id, metric)),
ha AS (SELECT *, max(raw) OVER (PARTITION BY experiment_id, metric ORDER BY p_value, arm ROWS UNBOUNDED PRECEDING) AS adj_p FROM ho),
wi AS (SELECT *, adj_p < 0.05 AS significant, row_number() OVER (PARTITION BY experiment_id, metric ORDER BY CASE WHEN adj_p < 0.05 THEN 0 ELSE 1 END, CASE WHEN effect_rel > 0 THEN 0 ELSE 1 END, effect_rel DESC, arm) = 1 AS is_winner FROM ha)"""
)


def _pairs3(spark, sf_dir):
    m = effects.with_metric_kind(effects.arm_moments(_arm3(spark, sf_dir), KEY, "arm", ["lifted3", "won"]), KEY)
    om = effects.omnibus(m, KEY)
    paired = effects.pair_with_control(m, KEY)
    pairs = effects.run_tests(effects.choose_test(paired), KEY)
    return paired, effects.mark_winner(effects.gated_pairs(pairs, om, KEY), KEY)


@query(
    "effects_pairwise_gated",
    PAIRS3 + " SELECT experiment_id, metric, arm, n_c, n_t, round(effect_rel, 6) AS effect_rel, round(p_value, 6) AS p_value FROM gt",
)
def pairwise(spark, sf_dir):
    _, pairs = _pairs3(spark, sf_dir)
    return _r(pairs.select("experiment_id", "metric", "arm", "n_c", "n_t", "effect_rel", "p_value"), {"effect_rel": 6, "p_value": 6})


@query("effects_holm", PAIRS3 + " SELECT experiment_id, metric, arm, round(p_value, 6) AS p_value, round(adj_p, 6) AS adj_p, adj_p < 0.05 AS significant FROM ha")
def holm(spark, sf_dir):
    _, pairs = _pairs3(spark, sf_dir)
    return _r(pairs.select("experiment_id", "metric", "arm", "p_value", "adj_p", "significant"), {"p_value": 6, "adj_p": 6})


@query("effects_winner", PAIRS3 + " SELECT experiment_id, metric, arm, significant, is_winner FROM wi")
def winner(spark, sf_dir):
    _, pairs = _pairs3(spark, sf_dir)
    return pairs.select("experiment_id", "metric", "arm", "significant", "is_winner")


X80 = power.solved_shift(fixed.ALPHA, fixed.TARGET_POWER)
POWER_SQL = f"""bp AS (SELECT *, n_c::DOUBLE * n_t / (n_c + n_t) AS neff, abs(2 * asin(sqrt(mean_t)) - 2 * asin(sqrt(mean_c))) AS h FROM bpr),
bq AS (SELECT *, 1.959963984540054::DOUBLE - h * sqrt(neff) AS za, 1.959963984540054::DOUBLE + h * sqrt(neff) AS zb,
  least(greatest(pow(sin((2 * asin(sqrt(mean_c)) + {X80!r}::DOUBLE / sqrt(neff)) / 2), 2), 0), 1) AS p2 FROM bp),
bw AS (SELECT *, CASE WHEN h > 0 THEN least(1.0::DOUBLE, {tb.sql_normal_sf('za')} + {tb.sql_normal_sf('zb')}) ELSE 0.0::DOUBLE END AS achieved_power,
  (p2 - mean_c) / mean_c * 100 AS mde_rel, CASE WHEN h > 1e-9 THEN CAST(ceil(pow({X80!r}::DOUBLE / h, 2) * (1 + n_c::DOUBLE / n_t)) AS BIGINT) ELSE n_c END AS required_n FROM bq)"""


@query(
    "effects_practical_flags",
    PAIRS3
    + """, bpr AS (SELECT pr.experiment_id, pr.metric, pr.n_c, pr.n_t, pr.mean_c, pr.mean_t FROM pr JOIN wi USING (experiment_id, metric, arm) WHERE is_winner AND metric = 'won'), """
    + POWER_SQL
    + " SELECT wi.experiment_id, wi.arm, round(wi.effect_rel * 100, 6) AS effect_pct, round(bw.mde_rel, 6) AS mde_rel, abs(wi.effect_rel * 100) >= abs(bw.mde_rel) AS practical_significant FROM wi JOIN bw USING (experiment_id, metric)",
)
def practical(spark, sf_dir):
    paired, pairs = _pairs3(spark, sf_dir)
    won = pairs.filter(F.col("metric") == "won")
    best = paired.join(won.filter("is_winner").select("experiment_id", "metric", "arm"), ["experiment_id", "metric", "arm"])
    flagged = effects.practical_flags(won, KEY, power.binary_power(best))
    return flagged.select(
        "experiment_id", "arm", F.round(F.col("effect_rel") * 100, 6).alias("effect_pct"), F.round("mde_rel", 6).alias("mde_rel"), "practical_significant"
    )


# --- power --------------------------------------------------------------------------
def _refund_pairs(spark, sf_dir):
    m = effects.arm_moments(tb.supplier_units(spark, sf_dir), KEY, "arm", ["refund"])
    return effects.pair_with_control(m, KEY, "control")


BINARY_POWER = MOMENTS + ", bpr AS (SELECT * FROM pr WHERE metric = 'refund'), " + POWER_SQL


@query(
    "power_binary",
    BINARY_POWER + " SELECT experiment_id, round(h, 6) AS effect_size, round(achieved_power, 6) AS achieved_power, n_c + n_t AS observed_n, achieved_power >= 0.8 AS powered FROM bw",
)
def power_binary(spark, sf_dir):
    out = power.binary_power(_refund_pairs(spark, sf_dir))
    return _r(out.select("experiment_id", "effect_size", "achieved_power", "observed_n", "powered"), {"effect_size": 6, "achieved_power": 6})


@query("power_detectable_effect", BINARY_POWER + " SELECT experiment_id, round(mde_rel, 6) AS mde_rel FROM bw")
def power_mde(spark, sf_dir):
    return _r(power.binary_power(_refund_pairs(spark, sf_dir)).select("experiment_id", "mde_rel"), {"mde_rel": 6})


@query("power_required_n", BINARY_POWER + " SELECT experiment_id, required_n FROM bw")
def power_n(spark, sf_dir):
    return power.binary_power(_refund_pairs(spark, sf_dir)).select("experiment_id", "required_n")


@query("power_continuous")
def power_continuous(spark, sf_dir):
    m = effects.arm_moments(tb.supplier_units(spark, sf_dir), KEY, "arm", ["revenue", "units"])
    out = power.power_facts(effects.pair_with_control(m, KEY, "control"))
    return out.select("experiment_id", "metric", "effect_size", "achieved_power", "mde_rel", "required_n", "observed_n", "powered")


@query(
    "power_planning_grid",
    f"""WITH b AS (SELECT l_suppkey AS plan_id, avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS baseline, count(*) AS traffic FROM lineitem GROUP BY 1),
g AS (SELECT plan_id, baseline, m AS mde_rel_pct, 2 + plan_id % 3 AS arms, traffic AS daily_traffic FROM b, (SELECT unnest([2.0::DOUBLE, 5.0::DOUBLE, 10.0::DOUBLE]) AS m)),
h AS (SELECT *, abs(2 * asin(sqrt(least(greatest(baseline * (1 + mde_rel_pct / 100), 0), 1))) - 2 * asin(sqrt(baseline))) AS es FROM g),
n AS (SELECT *, CAST(ceil(2 * pow({X80!r}::DOUBLE / es, 2)) AS BIGINT) AS n_per_arm FROM h)
SELECT plan_id, mde_rel_pct, round(es, 6) AS effect_size, n_per_arm, n_per_arm * arms AS n_total, CAST(ceil(n_per_arm * arms / daily_traffic) AS BIGINT) AS days FROM n""",
)
def planning(spark, sf_dir):
    """Sample sizes for three lifts over every supplier's observed baseline."""
    base = tb.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("plan_id")).agg(
        F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("baseline"), F.count(F.lit(1)).alias("daily_traffic")
    )
    plans = base.select(
        "plan_id", "baseline", F.explode(F.array(F.lit(2.0), F.lit(5.0), F.lit(10.0))).alias("mde_rel_pct"), (2 + F.col("plan_id") % 3).alias("arms"), "daily_traffic"
    )
    out = power.normal_only_plan(plans)
    return out.select("plan_id", "mde_rel_pct", F.round("effect_size", 6).alias("effect_size"), "n_per_arm", "n_total", "days")


@query("power_planning_continuous")
def planning_continuous(spark, sf_dir):
    base = tb.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("plan_id")).agg(
        F.avg("l_extendedprice").alias("baseline"), F.stddev_samp("l_extendedprice").alias("baseline_sd"), F.count(F.lit(1)).alias("daily_traffic")
    )
    plans = base.withColumn("metric_type", F.lit("continuous_monetary")).withColumn("mde_rel_pct", F.lit(5.0)).withColumn("arms", F.lit(2))
    return power.plan_sample_sizes(plans).select("plan_id", "effect_size", "n_per_arm", "n_total", "days")


# --- covariate adjustment -----------------------------------------------------------
def _cuped_units(spark, sf_dir):
    """A planted pre-period value for most customers of each segment."""
    cu = tb.customer_units(spark, sf_dir)
    pre = F.col("lifted_value") * 0.9 + F.col("balance") * 20
    return cu.select(
        F.col("segment").alias("experiment_id"), "unit_id", "arm", "lifted_value",
        F.when(F.col("segment") == "MACHINERY", F.when(F.col("unit_id") % 2 == 0, 1.0).otherwise(1.0)).when(F.col("unit_id") % 9 != 4, pre).alias("lifted_value_pre"),
    )


CUPED = f"""WITH {tb.CUSTOMER_UNITS},
q AS (SELECT segment AS experiment_id, unit_id, arm, lifted_value AS y, CASE WHEN segment = 'MACHINERY' THEN 1.0::DOUBLE WHEN unit_id % 9 <> 4 THEN lifted_value * 0.9::DOUBLE + balance * 20 END AS x FROM cu),
t0 AS (SELECT experiment_id, count(*) AS pairs, avg(x) AS x_mean, covar_samp(y, x) AS cxy, var_samp(x) AS vx, CASE WHEN var_samp(x) > 0 THEN corr(y, x) END AS r FROM q WHERE x IS NOT NULL GROUP BY 1),
th AS (SELECT *, CASE WHEN pairs < 10 THEN 'insufficient_data' WHEN vx = 0 OR r IS NULL OR abs(r) < 0.05 THEN 'covariate_too_weak' END AS skip_reason FROM t0),
ad AS (SELECT q.*, th.skip_reason, CASE WHEN x IS NOT NULL AND skip_reason IS NULL THEN y - cxy / vx * (x - x_mean) ELSE y END AS z FROM q JOIN th USING (experiment_id))"""


@query(
    "cuped_theta",
    CUPED + " SELECT experiment_id, pairs, CASE WHEN skip_reason IS NULL THEN round(cxy / vx, 6) END AS theta, round(x_mean, 3) AS x_mean, round(r, 6) AS correlation, skip_reason FROM th",
)
def cuped_theta(spark, sf_dir):
    t = variance.theta(_cuped_units(spark, sf_dir), KEY, "arm", "lifted_value", "lifted_value_pre")
    return _r(t.select("experiment_id", "pairs", "theta", "x_mean", "correlation", "skip_reason"), {"theta": 6, "x_mean": 3, "correlation": 6})


@query(
    "cuped_adjusted_moments",
    CUPED + " SELECT experiment_id, arm, count(*) AS n, round(avg(z), 3) AS mean, round(stddev_samp(z), 3) AS sd FROM ad GROUP BY 1, 2",
)
def cuped_moments(spark, sf_dir):
    """Adjusted arm moments from joint moments alone; the check adjusts every unit row."""
    m = variance.adjusted_moments(_cuped_units(spark, sf_dir), KEY, "arm", "lifted_value", "lifted_value_pre")
    return m.select("experiment_id", "arm", "n", F.round("mean", 3).alias("mean"), F.round(F.sqrt("var"), 3).alias("sd"))


@query(
    "cuped_adjusted_units",
    CUPED + " SELECT experiment_id, arm, count(*) AS n, round(avg(z), 3) AS mean, round(stddev_samp(z), 3) AS sd FROM ad GROUP BY 1, 2",
)
def cuped_units(spark, sf_dir):
    """The row form, for resampling and export."""
    u = _cuped_units(spark, sf_dir)
    rows = variance.adjust_units(u, KEY, "lifted_value", "lifted_value_pre", variance.theta(u, KEY, "arm", "lifted_value", "lifted_value_pre"))
    return rows.groupBy("experiment_id", "arm").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("adjusted"), 3).alias("mean"), F.round(F.stddev_samp("adjusted"), 3).alias("sd")
    )


@query(
    "cuped_variance_report",
    CUPED + """ SELECT experiment_id, any_value(skip_reason) AS skip_reason,
 CASE WHEN any_value(skip_reason) IS NULL THEN round(stddev_samp(y), 2) ELSE 0.0::DOUBLE END AS sd_before,
 CASE WHEN any_value(skip_reason) IS NULL THEN round(stddev_samp(z), 2) ELSE 0.0::DOUBLE END AS sd_after,
 CASE WHEN any_value(skip_reason) IS NULL THEN round(100 * (1 - var_samp(z) / var_samp(y)), 4) ELSE 0.0::DOUBLE END AS reduction_pct FROM ad GROUP BY 1""",
)
def cuped_report(spark, sf_dir):
    m = variance.adjusted_moments(_cuped_units(spark, sf_dir), KEY, "arm", "lifted_value", "lifted_value_pre")
    r = variance.variance_report(m, KEY)
    return r.select(
        "experiment_id", "skip_reason", F.round(F.sqrt("variance_before"), 2).alias("sd_before"), F.round(F.sqrt("variance_after"), 2).alias("sd_after"),
        F.round("reduction_pct", 4).alias("reduction_pct"),
    )


@query("bootstrap_mean_difference")
def mean_bootstrap(spark, sf_dir):
    """Poisson bootstrap over all units of every segment experiment, 10,000 replicates."""
    rows = tb.customer_units(spark, sf_dir).select(F.col("segment").alias("experiment_id"), "unit_id", "arm", F.col("lifted_value").alias("value"))
    return resampling.mean_bootstrap(rows, KEY, "unit_id", "arm", "control")


# --- flagship ------------------------------------------------------------------------
@query("flagship_revenue_by_segment")
def flagship(spark, sf_dir):
    """Sample-ratio check, effect on order value overall and per segment and channel, Holm-adjusted."""
    cu = tb.customer_units(spark, sf_dir).withColumn("population", F.lit("all"))
    cells = segments.segment_cells(cu, KEY, "arm", ["lifted_value", "lifted_converted"], ["population", "segment", "channel"])
    rows = segments.segment_effects(cells, KEY, "control")
    # the ratio check reads the population cells: no second scan
    sizes = cells.filter((F.col("dimension") == "population") & (F.col("metric") == "lifted_value")).groupBy(*KEY).agg(
        F.sum(F.when(F.col("arm") == "control", F.col("n_rows"))).alias("n_control"),
        F.sum(F.when(F.col("arm") != "control", F.col("n_rows"))).alias("n_treated"),
    )
    srm = quality.with_two_arm_srm(sizes, "n_control", "n_treated").select(
        "experiment_id", F.col("p_value").alias("srm_p_value"), F.col("passed").alias("srm_passed")
    )
    out = rows.join(srm, "experiment_id").select(
        "experiment_id", "srm_p_value", "srm_passed", "metric", "dimension", "segment", "arm", "status", "test_type", "n_c", "n_t",
        "effect_abs", "effect_rel", "ci_lower", "ci_upper", "p_value", "adj_p", "reliable",
    )
    return _r(out, {"srm_p_value": 6, "effect_abs": 3, "effect_rel": 6, "ci_lower": 2, "ci_upper": 2, "p_value": 6, "adj_p": 6})
