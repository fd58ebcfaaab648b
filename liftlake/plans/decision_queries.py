"""Decisions for one experiment per supplier, with planted lifts, harm and dirt."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftlake.operators import decide, segments, units
from liftlake.plans import analysis
from liftlake.plans import testbed as tb
from liftlake.plans.effect_queries import KEY, POWER_SQL, _r
from liftlake.plans.registry import query


def decision_units(spark, sf_dir):
    su = tb.supplier_units(spark, sf_dir)
    return su.withColumn("big_order", (F.col("revenue") > 60000).cast("int"))


def integrity(spark, sf_dir):
    """Crossovers planted for some suppliers, conflicting values for others."""
    li = tb.table(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_suppkey") % 13 == 6, F.col("l_linenumber")).otherwise(F.col("l_orderkey"))
    rows = li.select(
        F.col("l_suppkey").alias("experiment_id"),
        F.col("l_orderkey").alias("unit_id"),
        F.when(side % 2 == 1, "treatment").otherwise("control").alias("arm"),
        F.when(F.col("l_suppkey") % 17 == 2, F.col("l_quantity")).otherwise(1.0).alias("value"),
    )
    return units.integrity_rows(units.duplicate_analysis(rows, KEY, "unit_id", "arm", "value"), KEY)


def experiments(spark, sf_dir):
    return tb.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("experiment_id")).distinct()


def hypotheses(spark, sf_dir):
    e = F.col("experiment_id")
    return experiments(spark, sf_dir).select(
        "experiment_id",
        F.when(e % 10 == 9, "Session Length").when(e % 2 == 0, " big_order ").otherwise("BIG_ORDER").alias("primary_metric"),
        F.when(e % 8 == 7, "no_change").when(e % 3 == 0, "decrease").otherwise("increase").alias("expected_direction"),
        F.when(e % 4 == 0, 0.05).when(e % 4 == 1, 0.30).cast("double").alias("expected_effect"),
    )


def requests(spark, sf_dir):
    e = F.col("experiment_id")
    wanted = (
        F.when(e % 4 == 0, F.array(F.lit("Refund"), F.lit(" units ")))
        .when(e % 4 == 1, F.array(F.lit("Latency"), F.lit("")))
        .when(e % 4 == 2, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("REFUND"), F.lit("Latency"), F.lit("refund"), F.lit("Big Order")))
    )
    return experiments(spark, sf_dir).select("experiment_id", F.posexplode(wanted).alias("request_no", "requested"))


def labels(spark, sf_dir):
    e = F.col("experiment_id")
    held = F.array_compact(F.array(F.lit("Big Order"), F.lit("Refund"), F.when(e % 5 != 0, F.lit("Units"))))
    return experiments(spark, sf_dir).select("experiment_id", F.explode(held).alias("metric_label"))


def primary_labels(spark, sf_dir):
    return experiments(spark, sf_dir).withColumn("primary_label", F.lit("Big Order"))


def resolutions(spark, sf_dir):
    return decide.resolve_guardrails(requests(spark, sf_dir), labels(spark, sf_dir), primary_labels(spark, sf_dir), KEY)


def guardrail_metrics(spark, sf_dir):
    found = resolutions(spark, sf_dir).filter("resolved")
    return found.select("experiment_id", F.lower("resolved_label").alias("metric"), (F.lower("resolved_label") != "refund").alias("higher_is_better"))


def run(spark, sf_dir) -> analysis.Analysis:
    hyp = hypotheses(spark, sf_dir).withColumn(
        "expected_effect", F.when(F.lower(F.trim("primary_metric")) == "big_order", F.col("expected_effect"))
    )
    return analysis.analyze(
        decision_units(spark, sf_dir), KEY, "arm", "big_order", guardrail_metrics(spark, sf_dir), hyp, integrity=integrity(spark, sf_dir),
        extra_metrics=["refund", "units"],
    )


# --- SQL twins, each building on the one before -----------------------------------------
EXPERIMENTS = "ex AS (SELECT DISTINCT l_suppkey AS experiment_id FROM lineitem)"
REQUESTS = """rq AS (SELECT experiment_id, unnest(range(0, len(w))) AS request_no, unnest(w) AS requested FROM (SELECT experiment_id, CASE experiment_id % 4 WHEN 0 THEN ['Refund', ' units '] WHEN 1 THEN ['Latency', ''] WHEN 2 THEN [] ELSE ['REFUND', 'Latency', 'refund', 'Big Order'] END AS w FROM ex)),
lb AS (SELECT experiment_id, unnest(CASE WHEN experiment_id % 5 <> 0 THEN ['Big Order', 'Refund', 'Units'] ELSE ['Big Order', 'Refund'] END) AS metric_label FROM ex),
rc AS (SELECT experiment_id, lower(trim(requested)) AS n, min(request_no) AS request_no, arg_min(trim(requested), request_no) AS requested FROM rq WHERE trim(requested) <> '' GROUP BY 1, 2),
rs AS (SELECT rc.experiment_id, CAST(request_no AS INTEGER) AS request_no, requested, metric_label IS NOT NULL AS resolved, metric_label AS resolved_label FROM rc LEFT JOIN lb ON lb.experiment_id = rc.experiment_id AND lower(metric_label) = n AND metric_label <> 'Big Order')"""
HYPOTHESES = """hy AS (SELECT experiment_id, CASE WHEN experiment_id % 10 = 9 THEN 'Session Length' WHEN experiment_id % 2 = 0 THEN ' big_order ' ELSE 'BIG_ORDER' END AS primary_metric,
  CASE WHEN experiment_id % 8 = 7 THEN 'no_change' WHEN experiment_id % 3 = 0 THEN 'decrease' ELSE 'increase' END AS expected_direction, CASE experiment_id % 4 WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 0.30::DOUBLE END AS expected_effect FROM ex)"""
BASE = f"WITH {tb.SUPPLIER_UNITS},\n{EXPERIMENTS},\n{REQUESTS},\n{HYPOTHESES}"
QUALITY = (
    BASE
    + f""",
lg AS (SELECT experiment_id, arm, 'big_order' AS metric, CASE WHEN revenue > 60000 THEN 1.0::DOUBLE WHEN revenue IS NOT NULL THEN 0.0::DOUBLE END AS value FROM su UNION ALL SELECT experiment_id, arm, 'refund', CAST(refund AS DOUBLE) FROM su UNION ALL SELECT experiment_id, arm, 'units', units FROM su),
mo AS (SELECT experiment_id, metric, arm, count(*) AS n_rows, count(value) AS n, avg(value) AS mean, var_samp(value) AS var, CAST(sum(CASE WHEN value = 1 THEN 1 ELSE 0 END) AS BIGINT) AS s FROM lg GROUP BY 1, 2, 3),
sz AS (SELECT experiment_id, sum(n_rows) FILTER (WHERE arm = 'control') AS a, sum(n_rows) FILTER (WHERE arm <> 'control') AS b, 1 - sum(n) / sum(n_rows)::DOUBLE AS miss FROM mo WHERE metric = 'big_order' GROUP BY 1),
sr AS (SELECT *, pow(a - b, 2) / (a + b)::DOUBLE AS chi2 FROM sz),
sp AS (SELECT *, {tb.sql_normal2('sqrt(chi2)')} AS p FROM sr),
ir AS (SELECT l_suppkey AS experiment_id, l_orderkey, count(DISTINCT CASE WHEN (CASE WHEN l_suppkey % 13 = 6 THEN l_linenumber ELSE l_orderkey END) % 2 = 1 THEN 1 ELSE 0 END) AS na,
   count(DISTINCT CASE WHEN l_suppkey % 17 = 2 THEN l_quantity ELSE 1.0::DOUBLE END) AS nv FROM lineitem GROUP BY 1, 2),
ic AS (SELECT experiment_id, count(*) FILTER (WHERE na > 1) AS arms, count(*) FILTER (WHERE na = 1 AND nv > 1) AS vals FROM ir GROUP BY 1),
va AS (SELECT sp.experiment_id, p < 0.05 AS srm_failed, arms > 0 AS arm_conflict, arms = 0 AND vals > 0 AS critical_failure, p < 0.05 OR miss > 0.01 OR arms > 0 OR vals > 0 AS any_failure,
   CASE WHEN arms = 0 AND vals > 0 THEN 'metric_conflict' END AS critical_label FROM sp JOIN ic USING (experiment_id)),
vd AS (SELECT *, CASE WHEN srm_failed OR arm_conflict OR critical_failure THEN 'INVALID' WHEN any_failure THEN 'CAUTION' ELSE 'VALID' END AS validity FROM va)"""
)
TESTED = (
    QUALITY
    + f""",
pr AS (SELECT c.experiment_id, c.metric, c.n AS n_c, t.n AS n_t, c.mean AS mean_c, t.mean AS mean_t, c.var AS var_c, t.var AS var_t, c.s AS s_c, t.s AS s_t FROM mo c JOIN mo t ON c.experiment_id = t.experiment_id AND c.metric = t.metric AND c.arm = 'control' AND t.arm = 'treatment'
  JOIN vd ON vd.experiment_id = c.experiment_id WHERE validity <> 'INVALID'),
p1 AS (SELECT *, CASE WHEN metric = 'units' THEN 'welch_t_test' ELSE 'chi_square' END AS test_type, (mean_t - mean_c) / sqrt(var_c / n_c + var_t / n_t) AS t, pow(var_c / n_c + var_t / n_t, 2) / (pow(var_c / n_c, 2) / (n_c - 1) + pow(var_t / n_t, 2) / (n_t - 1)) AS df,
  CASE WHEN metric <> 'units' THEN pow(greatest(abs(s_c::DOUBLE * (n_t - s_t) - (n_c - s_c)::DOUBLE * s_t) / (n_c + n_t) - 0.5, 0), 2) * pow(n_c + n_t, 3) / (n_c::DOUBLE * n_t * (s_c + s_t) * (n_c + n_t - s_c - s_t)) ELSE 1 END AS chi2 FROM pr),
ef AS (SELECT *, CASE WHEN metric = 'units' THEN {tb.sql_t2('t', 'df')} ELSE {tb.sql_normal2('sqrt(chi2)')} END AS p_value, mean_t - mean_c AS effect_abs, (mean_t - mean_c) / mean_c AS effect_rel FROM p1),
es AS (SELECT *, p_value < 0.05 AS significant FROM ef),
gf AS (SELECT es.*, lower(resolved_label) <> 'refund' AS higher_is_better, CASE WHEN lower(resolved_label) <> 'refund' THEN effect_rel < 0 ELSE effect_rel > 0 END AS is_harmful FROM es JOIN rs ON rs.experiment_id = es.experiment_id AND resolved AND lower(resolved_label) = metric),
gs AS (SELECT ex.experiment_id, CASE WHEN count(metric) = 0 THEN 'NOT_AVAILABLE' WHEN bool_or(significant AND is_harmful) THEN 'FAIL' WHEN bool_or(NOT significant AND is_harmful) THEN 'WARNING' ELSE 'PASS' END AS guardrail_status,
   coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE significant AND is_harmful), '') AS violated_metrics, coalesce(string_agg(metric, ',' ORDER BY metric), '') AS evaluated_metrics FROM ex LEFT JOIN gf USING (experiment_id) GROUP BY 1),
bpr AS (SELECT * FROM pr WHERE metric = 'big_order'),
"""
    + POWER_SQL
)
DECIDED = (
    TESTED
    + """,
fa AS (SELECT vd.*, es.metric, es.test_type, es.p_value, es.significant, es.effect_abs, es.effect_rel, es.mean_c AS base_value, es.mean_t AS observed_value, bw.achieved_power, bw.mde_rel, bw.required_n, bw.achieved_power >= 0.8 AS powered,
   gs.guardrail_status, gs.violated_metrics, gs.evaluated_metrics, CASE WHEN lower(trim(hy.primary_metric)) = 'big_order' THEN hy.expected_effect END AS expected_effect, es.p_value IS NOT NULL AS has_result
   FROM vd LEFT JOIN es ON es.experiment_id = vd.experiment_id AND es.metric = 'big_order' LEFT JOIN bw ON bw.experiment_id = vd.experiment_id JOIN gs ON gs.experiment_id = vd.experiment_id JOIN hy ON hy.experiment_id = vd.experiment_id),
pc AS (SELECT *, CASE WHEN expected_effect IS NOT NULL THEN expected_effect * 100 ELSE abs(mde_rel) END AS threshold_pct FROM fa),
ps AS (SELECT *, CASE WHEN threshold_pct IS NULL THEN NULL WHEN coalesce(base_value, 0) = 0 THEN 'data_error' WHEN expected_effect IS NOT NULL THEN 'user_specified' ELSE 'post_hoc_mde' END AS threshold_source FROM pc),
px AS (SELECT *, CASE WHEN threshold_source IN ('user_specified', 'post_hoc_mde') THEN abs(effect_rel * 100) >= threshold_pct END AS exceeds_threshold FROM ps),
pp AS (SELECT *, CASE WHEN threshold_source = 'user_specified' THEN exceeds_threshold END AS practical FROM px),
dr AS (SELECT *, CASE WHEN validity = 'INVALID' THEN 'failed_validity' WHEN NOT has_result THEN 'no_test' WHEN NOT significant AND NOT powered THEN 'not_significant_underpowered' WHEN NOT significant THEN 'not_significant'
   WHEN exceeds_threshold AND effect_rel < 0 THEN 'significant_loss' WHEN practical = false THEN 'below_target' WHEN threshold_source = 'post_hoc_mde' AND NOT exceeds_threshold THEN 'below_detectable_effect'
   WHEN practical IS NULL AND threshold_source IS DISTINCT FROM 'post_hoc_mde' THEN 'practical_unknown' WHEN guardrail_status = 'FAIL' THEN 'guardrail_failed' WHEN guardrail_status = 'WARNING' THEN 'guardrail_warning'
   WHEN guardrail_status = 'NOT_AVAILABLE' THEN 'no_guardrail' ELSE 'all_clear' END AS reason FROM pp),
de AS (SELECT *, CASE WHEN reason = 'failed_validity' THEN 'INVALID' WHEN reason IN ('no_test', 'not_significant', 'not_significant_underpowered') THEN 'INCONCLUSIVE' WHEN reason IN ('significant_loss', 'below_target', 'below_detectable_effect', 'guardrail_failed') THEN 'NO_GO'
   WHEN reason IN ('practical_unknown', 'guardrail_warning', 'no_guardrail') THEN 'GO_WITH_CAUTION' ELSE 'GO' END AS decision,
   CASE WHEN reason IN ('failed_validity', 'no_test', 'guardrail_failed') THEN 'LOW' WHEN reason IN ('not_significant', 'significant_loss', 'below_target') THEN CASE WHEN validity = 'VALID' THEN 'HIGH' ELSE 'MEDIUM' END WHEN reason = 'all_clear' THEN 'HIGH' ELSE 'MEDIUM' END AS recommendation_confidence,
   CASE WHEN reason IN ('failed_validity', 'no_test', 'not_significant', 'not_significant_underpowered', 'significant_loss') THEN 'NOT_AVAILABLE' ELSE guardrail_status END AS reported_guardrail,
   CASE WHEN reason NOT IN ('failed_validity', 'no_test', 'not_significant', 'not_significant_underpowered') THEN practical END AS practical_reported,
   CASE WHEN validity = 'INVALID' THEN 'LOW' WHEN any_failure OR powered IS NULL OR NOT powered THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
   CASE WHEN srm_failed THEN 'srm' WHEN arm_conflict THEN 'arm_conflict' WHEN critical_failure THEN 'critical_quality' WHEN any_failure THEN 'quality_warning' WHEN powered IS NULL THEN 'no_test' WHEN NOT powered THEN 'underpowered' ELSE 'all_clear' END AS confidence_reason FROM dr)"""
)


@query("guardrails_resolution", BASE + " SELECT * FROM rs")
def guardrail_resolution(spark, sf_dir):
    return resolutions(spark, sf_dir)


@query(
    "guardrails_request_state",
    BASE
    + """ SELECT ex.experiment_id, nullif(count(requested), 0) AS n_requested, CASE WHEN count(requested) > 0 THEN count(*) FILTER (WHERE resolved) END AS n_resolved,
 CASE WHEN count(requested) = 0 THEN 'NOT_SPECIFIED' WHEN count(*) FILTER (WHERE resolved) = 0 THEN 'REQUESTED_NOT_FOUND' WHEN count(*) FILTER (WHERE resolved) < count(requested) THEN 'PARTIALLY_AVAILABLE' ELSE 'AVAILABLE' END AS request_state
 FROM ex LEFT JOIN rs USING (experiment_id) GROUP BY 1""",
)
def request_state(spark, sf_dir):
    return decide.request_state(resolutions(spark, sf_dir), experiments(spark, sf_dir), KEY)


@query(
    "guardrails_findings",
    TESTED + " SELECT experiment_id, metric, test_type, round(effect_rel, 6) AS effect_rel, round(p_value, 6) AS p_value, significant, is_harmful, significant AND is_harmful AS violated FROM gf",
)
def findings(spark, sf_dir):
    g = run(spark, sf_dir).guardrails
    return _r(g.select("experiment_id", "metric", "test_type", "effect_rel", "p_value", "significant", "is_harmful", "violated"), {"effect_rel": 6, "p_value": 6})


@query("guardrails_status", TESTED + " SELECT * FROM gs")
def status(spark, sf_dir):
    return decide.guardrail_status(run(spark, sf_dir).guardrails, experiments(spark, sf_dir), KEY)


def _pairs_with_omnibus(spark, sf_dir):
    from liftlake.operators import effects
    from liftlake.plans.effect_queries import _arm3

    m = effects.with_metric_kind(effects.arm_moments(_arm3(spark, sf_dir), KEY, "arm", ["won"]), KEY)
    om = effects.omnibus(m, KEY)
    pairs = effects.run_tests(effects.choose_test(effects.pair_with_control(m, KEY)), KEY)
    gated = effects.mark_winner(effects.gated_pairs(pairs, om, KEY), KEY).withColumn("is_omnibus", F.lit(False))
    rows = om.select(
        "experiment_id", "metric", F.lit(None).cast("string").alias("arm"), "p_value", F.col("p_value").alias("adj_p"), (F.col("p_value") < 0.05).alias("significant"),
        F.lit(None).cast("double").alias("effect_rel"), F.lit(False).alias("is_winner"), F.lit(True).alias("is_omnibus"),
    )
    return gated.select(*rows.columns).unionByName(rows)


from liftlake.plans.effect_queries import PAIRS3  # noqa: E402


@query(
    "decisions_primary_row",
    PAIRS3
    + """, al AS (SELECT experiment_id, arm, round(adj_p, 6) AS adj_p, significant, false AS is_omnibus, CASE WHEN is_winner THEN 0 WHEN significant THEN 1 ELSE 2 END AS rk FROM wi WHERE metric = 'won'
  UNION ALL SELECT experiment_id, NULL, round(p_value, 6), p_value < 0.05, true, 3 FROM om WHERE metric = 'won'),
r AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY rk, arm) AS rn FROM al)
SELECT experiment_id, arm, adj_p, significant, is_omnibus FROM r WHERE rn = 1""",
)
def primary_row(spark, sf_dir):
    return _r(decide.primary_rows(_pairs_with_omnibus(spark, sf_dir), KEY).select("experiment_id", "arm", "adj_p", "significant", "is_omnibus"), {"adj_p": 6})


VERDICTS = (
    TESTED
    + """,
hv AS (SELECT hy.*, es.effect_rel, es.significant, es.metric, CASE WHEN expected_direction = 'no_change' THEN 'no_change_not_evaluated' WHEN es.metric IS NULL THEN 'metric_not_matched' END AS note
   FROM hy LEFT JOIN es ON es.experiment_id = hy.experiment_id AND es.metric = lower(trim(hy.primary_metric))),
hw AS (SELECT *, CASE WHEN note IS NULL THEN CASE WHEN expected_direction = 'increase' THEN effect_rel > 0 ELSE effect_rel < 0 END END AS ds, CASE WHEN note IS NULL THEN abs(effect_rel) / expected_effect END AS ratio FROM hv),
hz AS (SELECT *, CASE WHEN note IS NOT NULL THEN NULL WHEN NOT ds OR NOT significant THEN 'NOT_SUPPORTED' WHEN ratio IS NULL OR ratio >= 1 THEN 'SUPPORTED' ELSE 'PARTIALLY_SUPPORTED' END AS verdict FROM hw)"""
)


@query(
    "hypotheses_verdicts",
    VERDICTS
    + """ SELECT experiment_id, primary_metric, expected_direction, expected_effect, CASE WHEN note IS NULL THEN round(effect_rel, 6) END AS observed_effect, ds AS direction_supported,
 CASE WHEN note IS NULL THEN significant END AS statistically_significant, round(ratio, 5) AS achievement_ratio, verdict, note FROM hz""",
)
def verdicts(spark, sf_dir):
    e = run(spark, sf_dir).effects.withColumn("is_omnibus", F.lit(False)).withColumn("is_winner", F.lit(True))
    return _r(decide.hypothesis_verdicts(hypotheses(spark, sf_dir), e, KEY), {"observed_effect": 6, "achievement_ratio": 5})


@query(
    "decisions_practical",
    DECIDED + " SELECT experiment_id, round(threshold_pct, 5) AS threshold_pct, threshold_source, exceeds_threshold, practical FROM de",
)
def practical(spark, sf_dir):
    return _r(run(spark, sf_dir).decisions.select("experiment_id", "threshold_pct", "threshold_source", "exceeds_threshold", "practical"), {"threshold_pct": 5})


@query("decisions_validity", QUALITY + " SELECT experiment_id, srm_failed, arm_conflict, critical_failure, any_failure, critical_label, validity FROM vd")
def validity(spark, sf_dir):
    return run(spark, sf_dir).validity


@query(
    "decisions",
    DECIDED
    + " SELECT experiment_id, validity, has_result, significant, round(effect_rel, 6) AS effect_rel, powered, practical, guardrail_status, decision, reason, recommendation_confidence FROM de",
)
def decisions(spark, sf_dir):
    d = run(spark, sf_dir).decisions
    return _r(
        d.select("experiment_id", "validity", "has_result", "significant", "effect_rel", "powered", "practical", "guardrail_status", "decision", "reason", "recommendation_confidence"),
        {"effect_rel": 6},
    )


@query(
    "decisions_confidence",
    DECIDED + " SELECT experiment_id, confidence, CASE confidence WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 3 ELSE 5 END AS stars, confidence_reason FROM de",
)
def confidence(spark, sf_dir):
    return run(spark, sf_dir).decisions.select("experiment_id", "confidence", "stars", "confidence_reason")


def datasets(spark, sf_dir):
    counts = decision_units(spark, sf_dir).groupBy("experiment_id").agg(F.count(F.lit(1)).alias("users"))
    return counts.withColumn("shape", F.when(F.col("experiment_id") % 9 == 8, "unknown").otherwise("raw_user_level"))


@query(
    "decisions_impact",
    DECIDED
    + """, us AS (SELECT experiment_id, count(*) AS users FROM su GROUP BY 1),
im AS (SELECT hy.experiment_id, hy.expected_direction, hy.expected_effect, base_value, observed_value, users, metric IS NOT NULL AND lower(trim(hy.primary_metric)) = 'big_order' AS matched,
  CASE WHEN NOT (metric IS NOT NULL AND lower(trim(hy.primary_metric)) = 'big_order') THEN 'no_result_for_metric' WHEN hy.experiment_id % 9 = 8 THEN 'unknown_dataset_shape' ELSE 'scaled_to_observed_population' END AS warning
  FROM hy JOIN de USING (experiment_id) JOIN us USING (experiment_id))
SELECT experiment_id, warning, CASE WHEN warning = 'scaled_to_observed_population' THEN 'population_scaled' ELSE 'unavailable' END AS method,
 CASE WHEN matched THEN round(base_value * (1 + CASE expected_direction WHEN 'increase' THEN expected_effect WHEN 'decrease' THEN -expected_effect END), 6) END AS expected_value,
 CASE WHEN matched THEN round(observed_value - base_value, 6) END AS observed_absolute,
 CASE WHEN warning = 'scaled_to_observed_population' THEN round((observed_value - base_value) * users, 4) END AS incremental_count FROM im""",
)
def impact(spark, sf_dir):
    d = run(spark, sf_dir).decisions.select("experiment_id", "metric", "test_type", "base_value", "observed_value")
    i = decide.impact(d, hypotheses(spark, sf_dir), datasets(spark, sf_dir), KEY)
    return _r(i.select("experiment_id", "warning", "method", "expected_value", "observed_absolute", "incremental_count"), {"expected_value": 6, "observed_absolute": 6, "incremental_count": 4})


@query(
    "decisions_other_metrics",
    TESTED
    + """ SELECT experiment_id, metric, round(effect_abs, 6) AS effect_abs, round(effect_rel, 6) AS effect_rel, CASE WHEN effect_rel > 0 THEN 'increase' WHEN effect_rel < 0 THEN 'decrease' ELSE 'no_change' END AS direction,
 significant AND effect_rel < 0 AS is_trade_off FROM es WHERE metric <> 'big_order'""",
)
def other_metrics(spark, sf_dir):
    e = run(spark, sf_dir).effects.withColumn("is_omnibus", F.lit(False))
    o = decide.other_metrics(e, experiments(spark, sf_dir).withColumn("primary_metric", F.lit("big_order")), KEY)
    return _r(o.select("experiment_id", "metric", "effect_abs", "effect_rel", "direction", "is_trade_off"), {"effect_abs": 6, "effect_rel": 6})


@query(
    "decisions_trade_offs",
    TESTED
    + " SELECT experiment_id, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE significant AND effect_rel < 0), '') AS trade_offs, count(*) AS n_metrics FROM es WHERE metric <> 'big_order' GROUP BY 1",
)
def trade_offs(spark, sf_dir):
    e = run(spark, sf_dir).effects.withColumn("is_omnibus", F.lit(False))
    return decide.trade_offs(decide.other_metrics(e, experiments(spark, sf_dir).withColumn("primary_metric", F.lit("big_order")), KEY), KEY)


def _segments_of(spark, sf_dir):
    """Reliable order-size segments per supplier."""
    su = decision_units(spark, sf_dir).withColumn("size", F.when(F.col("units") > 25, "large").otherwise("small"))
    cells = segments.segment_cells(su, KEY, "arm", ["big_order"], ["size"])
    return segments.segment_summary(segments.segment_effects(cells, KEY, "control"), KEY).select("experiment_id", "reliable_dimensions")


AUDIT = (
    DECIDED
    + f""",
sc0 AS (SELECT experiment_id, CASE WHEN units > 25 THEN 'large' ELSE 'small' END AS seg, arm, count(b) AS n, CAST(sum(b) AS BIGINT) AS s FROM (SELECT *, CASE WHEN revenue > 60000 THEN 1 WHEN revenue IS NOT NULL THEN 0 END AS b FROM su) GROUP BY 1, 2, 3),
sc1 AS (SELECT c.experiment_id, c.seg, c.n AS nc, t.n AS nt, c.s AS sc, t.s AS st, least(c.n * (c.s + t.s), t.n * (c.s + t.s), c.n * (c.n + t.n - c.s - t.s), t.n * (c.n + t.n - c.s - t.s))::DOUBLE / (c.n + t.n) AS me
   FROM sc0 c JOIN sc0 t ON c.experiment_id = t.experiment_id AND c.seg = t.seg AND c.arm = 'control' AND t.arm = 'treatment' WHERE c.n >= 30 AND t.n >= 30),
sf1 AS (SELECT *, unnest(generate_series(greatest(0, sc + st - nt), least(nc, sc + st))) AS a FROM sc1 WHERE me < 5),
sf2 AS (SELECT *, lgamma(nc + 1) - lgamma(a + 1) - lgamma(nc - a + 1) + lgamma(nt + 1) - lgamma(sc + st - a + 1) - lgamma(nt - sc - st + a + 1) AS w FROM sf1),
sf3 AS (SELECT *, max(w) OVER g AS wm, max(CASE WHEN a = sc THEN w END) OVER g AS w0 FROM sf2 WINDOW g AS (PARTITION BY experiment_id, seg)),
sf4 AS (SELECT experiment_id, seg, sum(CASE WHEN w - wm <= w0 - wm + 1e-7 THEN exp(w - wm) ELSE 0 END) / sum(exp(w - wm)) AS p FROM sf3 GROUP BY 1, 2),
sc2 AS (SELECT *, CASE WHEN me >= 5 THEN pow(greatest(abs(sc::DOUBLE * (nt - st) - (nc - sc)::DOUBLE * st) / (nc + nt) - 0.5, 0), 2) * pow(nc + nt, 3) / (nc::DOUBLE * nt * (sc + st) * (nc + nt - sc - st)) ELSE 0 END AS chi2 FROM sc1),
sc3 AS (SELECT sc2.experiment_id, sc2.seg, CASE WHEN me < 5 THEN sf4.p ELSE {tb.sql_normal2('sqrt(chi2)')} END AS p FROM sc2 LEFT JOIN sf4 ON sf4.experiment_id = sc2.experiment_id AND sf4.seg = sc2.seg),
sc4 AS (SELECT *, count(*) OVER (PARTITION BY experiment_id) AS m, min(p) OVER (PARTITION BY experiment_id) AS pmin FROM sc3),
rd AS (SELECT ex.experiment_id, CASE WHEN bool_or(m >= 2 AND least(1, pmin * m) < 0.05) THEN 'size' ELSE '' END AS reliable_dimensions FROM ex LEFT JOIN sc4 USING (experiment_id) GROUP BY 1),
dz AS (SELECT de.*, rd.reliable_dimensions FROM de JOIN rd USING (experiment_id)),
au AS (
 SELECT experiment_id, 'srm' AS label, 'VALIDITY' AS category, CASE WHEN srm_failed THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN srm_failed THEN 'fail' ELSE 'pass' END AS value, CASE WHEN srm_failed THEN 'BLOCKS_DECISION' ELSE 'SUPPORTS_DECISION' END AS impact FROM dz
 UNION ALL SELECT experiment_id, 'arm_conflict', 'VALIDITY', CASE WHEN arm_conflict THEN 'FAIL' ELSE 'PASS' END, CASE WHEN arm_conflict THEN 'found' ELSE 'none' END, CASE WHEN arm_conflict THEN 'BLOCKS_DECISION' ELSE 'SUPPORTS_DECISION' END FROM dz
 UNION ALL SELECT experiment_id, 'critical_checks', 'DATA_QUALITY', 'PASS', 'none_failed', 'SUPPORTS_DECISION' FROM dz WHERE NOT critical_failure
 UNION ALL SELECT experiment_id, 'primary_metric', 'STATISTICAL_SIGNIFICANCE', CASE WHEN has_result THEN 'INFO' ELSE 'NOT_AVAILABLE' END, coalesce(metric, 'no_test'), 'NEUTRAL' FROM dz
 UNION ALL SELECT experiment_id, 'significance', 'STATISTICAL_SIGNIFICANCE', CASE WHEN significant THEN 'PASS' ELSE 'WARNING' END, CASE WHEN significant THEN 'significant' ELSE 'not_significant' END, CASE WHEN significant THEN 'SUPPORTS_DECISION' ELSE 'NEUTRAL' END FROM dz WHERE has_result
 UNION ALL SELECT experiment_id, 'practical', 'PRACTICAL_SIGNIFICANCE', CASE WHEN practical_reported IS NULL THEN 'NOT_AVAILABLE' WHEN practical_reported THEN 'PASS' ELSE 'WARNING' END, CASE WHEN practical_reported IS NULL THEN 'not_established' WHEN practical_reported THEN 'confirmed' ELSE 'below_threshold' END,
   CASE WHEN practical_reported IS NULL THEN 'LIMITS_CONFIDENCE' WHEN practical_reported THEN 'SUPPORTS_DECISION' ELSE 'NEUTRAL' END FROM dz
 UNION ALL SELECT experiment_id, 'power', 'POWER', CASE WHEN powered IS NULL THEN 'NOT_AVAILABLE' WHEN powered THEN 'PASS' ELSE 'WARNING' END, CASE WHEN powered IS NULL THEN 'not_calculated' WHEN powered THEN 'sufficient' ELSE 'underpowered' END,
   CASE WHEN powered IS NULL THEN 'NEUTRAL' WHEN powered THEN 'SUPPORTS_DECISION' ELSE 'LIMITS_CONFIDENCE' END FROM dz
 UNION ALL SELECT experiment_id, 'guardrails', 'GUARDRAILS', reported_guardrail, lower(reported_guardrail), CASE reported_guardrail WHEN 'PASS' THEN 'SUPPORTS_DECISION' WHEN 'FAIL' THEN 'BLOCKS_DECISION' ELSE 'LIMITS_CONFIDENCE' END FROM dz
 UNION ALL SELECT experiment_id, 'segmentation', 'SEGMENTATION', 'INFO', CASE WHEN reliable_dimensions <> '' THEN 'reliable:' || reliable_dimensions ELSE 'no_reliable_difference' END, 'NEUTRAL' FROM dz
 UNION ALL SELECT va.experiment_id, 'metric_conflict', 'DATA_QUALITY', 'FAIL', 'critical', 'BLOCKS_DECISION' FROM va WHERE critical_failure
 UNION ALL SELECT experiment_id, 'nulls', 'DATA_QUALITY', 'WARNING', 'warning', 'LIMITS_CONFIDENCE' FROM sp WHERE miss > 0.01)"""
)


@query(
    "decisions_audit",
    AUDIT + " SELECT *, CASE WHEN impact = 'SUPPORTS_DECISION' THEN 'supporting' WHEN impact IN ('LIMITS_CONFIDENCE', 'BLOCKS_DECISION') THEN 'warning' ELSE 'neutral' END AS side FROM au",
)
def audit(spark, sf_dir):
    a = run(spark, sf_dir)
    d = a.decisions.join(_segments_of(spark, sf_dir), "experiment_id", "left")
    return decide.audit_facts(d, a.quality, KEY)


NARRATIVE = (
    DECIDED
    + """,
rq2 AS (SELECT ex.experiment_id, CASE WHEN count(requested) = 0 THEN 'no_guardrails_evaluated' WHEN count(*) FILTER (WHERE resolved) = 0 THEN 'requested_guardrails_missing' ELSE 'requested_guardrails_untested' END AS rqt FROM ex LEFT JOIN rs USING (experiment_id) GROUP BY 1),
nr AS (SELECT de.*, rqt FROM de JOIN rq2 USING (experiment_id))"""
)


@query(
    "decisions_narrative",
    NARRATIVE
    + """ SELECT experiment_id, decision, CASE WHEN decision IN ('GO', 'GO_WITH_CAUTION') THEN concat_ws(';', CASE WHEN significant THEN 'significant' END, CASE WHEN practical_reported THEN 'practically_meaningful' WHEN practical_reported IS NULL THEN 'practical_not_established' END,
  CASE validity WHEN 'VALID' THEN 'checks_passed' ELSE 'checks_with_warnings' END, CASE WHEN powered THEN 'powered' END, CASE reported_guardrail WHEN 'NOT_AVAILABLE' THEN rqt WHEN 'PASS' THEN 'guardrails_passed' WHEN 'WARNING' THEN 'guardrail_warning' END)
  ELSE concat_ws(';', reason, CASE WHEN decision = 'NO_GO' AND reported_guardrail = 'FAIL' THEN 'failed:' || violated_metrics END) END AS why,
 CASE WHEN decision = 'GO_WITH_CAUTION' THEN concat_ws(';', CASE reported_guardrail WHEN 'NOT_AVAILABLE' THEN rqt WHEN 'WARNING' THEN 'guardrail_warning' END, CASE WHEN reported_guardrail = 'NOT_AVAILABLE' THEN 'business_impact_unvalidated' END,
  CASE WHEN reported_guardrail = 'NOT_AVAILABLE' THEN 'primary_metric_only' END, CASE WHEN practical_reported IS NULL THEN 'practical_not_established' END) ELSE '' END AS prevents_go,
 CASE WHEN decision = 'INVALID' THEN 'fix_validity_and_rerun' WHEN decision = 'INCONCLUSIVE' AND NOT powered THEN 'increase_sample' WHEN decision = 'INCONCLUSIVE' THEN 'address_missing_result' WHEN decision = 'NO_GO' THEN 'do_not_ship' WHEN decision = 'GO' THEN 'roll_out_and_monitor' ELSE 'controlled_rollout' END AS next_step FROM nr""",
)
def narrative(spark, sf_dir):
    d = run(spark, sf_dir).decisions.join(request_state(spark, sf_dir).select("experiment_id", "request_state"), "experiment_id")
    return decide.narrative(d).select("experiment_id", "decision", "why", "prevents_go", "next_step")


@query(
    "decisions_monitoring",
    DECIDED
    + """ SELECT de.experiment_id, coalesce(string_agg(DISTINCT metric_label, ',' ORDER BY metric_label) FILTER (WHERE lower(replace(metric_label, ' ', '_')) IS DISTINCT FROM metric AND NOT list_contains(string_split(evaluated_metrics, ','), lower(metric_label))), '') AS watch
 FROM de JOIN lb USING (experiment_id) GROUP BY 1""",
)
def monitoring(spark, sf_dir):
    held = labels(spark, sf_dir).withColumn("metric_label", F.lower(F.replace("metric_label", F.lit(" "), F.lit("_"))))
    out = decide.monitoring(run(spark, sf_dir).decisions, held, KEY)
    return out.select("experiment_id", F.array_join(F.transform(F.filter(F.split("watch", ","), lambda x: x != ""), lambda x: F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))), ",").alias("watch"))


@query(
    "display_effects",
    TESTED
    + """, dp AS (SELECT *, metric <> 'units' AS b FROM es)
SELECT experiment_id, metric, CASE WHEN b THEN printf('%.2f%%', round(mean_c * 100, 2)) ELSE printf('%.2f', round(mean_c, 2)) END AS control_text, CASE WHEN b THEN printf('%.2f%%', round(mean_t * 100, 2)) ELSE printf('%.2f', round(mean_t, 2)) END AS treated_text,
 CASE WHEN effect_rel >= 0 THEN '+' ELSE '' END || printf('%.1f%%', round(effect_rel * 100, 1)) AS delta_text, CASE WHEN p_value < 0.001 THEN '< 0.001' ELSE '= ' || printf('%.4f', p_value) END AS p_text FROM dp""",
)
def display(spark, sf_dir):
    return decide.display_columns(run(spark, sf_dir).effects).select("experiment_id", "metric", "control_text", "treated_text", "delta_text", "p_text")


@query(
    "display_power",
    TESTED
    + """ SELECT experiment_id, CASE WHEN mde_rel IS NULL THEN 'N/A' ELSE printf('%.1f%% relative', abs(mde_rel)) END AS mde_text, CASE WHEN achieved_power >= 0.999 THEN '>99.9%' ELSE printf('%.1f%%', achieved_power * 100) END AS power_text,
 format('{:,}', n_c + n_t) || CASE WHEN achieved_power >= 0.8 THEN ' units, powered' ELSE ' units, needs ' || format('{:,}', required_n) || ' per arm' END AS sample_text FROM bw""",
)
def display_power(spark, sf_dir):
    return decide.power_display(run(spark, sf_dir).power).select("experiment_id", "mde_text", "power_text", "sample_text")


@query("display_summary", DECIDED + " SELECT experiment_id, replace(decision, '_', ' ') || ' - ' || replace(reason, '_', ' ') AS summary FROM de")
def display_summary(spark, sf_dir):
    return decide.summary_text(run(spark, sf_dir).decisions).select("experiment_id", "summary")


# --- run status: every order is a run, its lines are the steps -----------------------------
@query(
    "runs_status",
    """WITH s AS (SELECT l_orderkey AS run_id, CASE l_linenumber % 7 WHEN 1 THEN 'validation' WHEN 2 THEN 'experiment' WHEN 3 THEN 'segmentation' WHEN 4 THEN 'funnel' ELSE 'decision' END AS step,
  CASE WHEN l_returnflag = 'R' AND l_discount > 0.09 THEN 'FAILED' WHEN l_discount > 0.08 THEN 'WARNING' WHEN l_linestatus = 'O' AND l_tax > 0.05 THEN 'SKIPPED' ELSE 'SUCCESS' END AS status FROM lineitem),
g AS (SELECT run_id, CAST(coalesce(max(CASE status WHEN 'FAILED' THEN 3 WHEN 'WARNING' THEN 2 WHEN 'SKIPPED' THEN 1 ELSE 0 END) FILTER (WHERE NOT (status = 'SKIPPED' AND step IN ('segmentation', 'funnel'))), 0) AS INTEGER) AS severity, count(*) AS n_steps FROM s GROUP BY 1)
SELECT *, CASE severity WHEN 3 THEN 'FAILED' WHEN 2 THEN 'WARNING' WHEN 1 THEN 'SKIPPED' ELSE 'SUCCESS' END AS run_status FROM g""",
)
def run_status(spark, sf_dir):
    n = F.col("l_linenumber") % 7
    step = F.when(n == 1, "validation").when(n == 2, "experiment").when(n == 3, "segmentation").when(n == 4, "funnel").otherwise("decision")
    status_ = (
        F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.09), "FAILED")
        .when(F.col("l_discount") > 0.08, "WARNING")
        .when((F.col("l_linestatus") == "O") & (F.col("l_tax") > 0.05), "SKIPPED")
        .otherwise("SUCCESS")
    )
    steps = tb.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), step.alias("step"), status_.alias("status"))
    return decide.run_status(steps, ["run_id"])


# --- definitions: one per part --------------------------------------------------------------
@query(
    "definitions_audit",
    """WITH d AS (SELECT p_partkey AS k, p_size AS s, p_type AS t, p_brand AS b FROM part),
v AS (SELECT *, CASE WHEN s % 10 = 0 THEN 0 WHEN s % 10 = 1 THEN 2 ELSE 1 END AS nc, 2 + k % 2 AS nv, CASE WHEN s % 7 = 3 THEN 90.0::DOUBLE ELSE 100.0::DOUBLE END AS total, s % 9 = 4 AS same_id, k % 5 AS h, k % 6 AS m, b = 'Brand#11' AS nodata FROM d)
SELECT k AS definition_id, h IN (0, 1, 3, 4) AS ok_hypotheses, nc = 1 AS ok_control, NOT same_id AS ok_variant_ids, total = 100 AS ok_allocation, m <> 5 AS ok_metrics,
 h IN (1, 4, 2) AS ready_hypothesis, nc >= 1 AND nv > nc AS ready_variants, m NOT IN (0, 4) AS ready_metric, NOT nodata AS ready_data,
 h IN (1, 4, 2) AND nc >= 1 AND nv > nc AND m NOT IN (0, 4) AND NOT nodata AS is_ready FROM v""",
)
def definitions(spark, sf_dir):
    """Definition rules over one definition per part, with planted faults."""
    k, s = F.col("p_partkey"), F.col("p_size")
    n_controls = F.when(s % 10 == 0, 0).when(s % 10 == 1, 2).otherwise(1)
    total = F.when(s % 7 == 3, 90.0).otherwise(100.0)
    n_variants = (2 + k % 2).cast("int")
    variants = F.transform(
        F.sequence(F.lit(1), n_variants),
        lambda i: F.struct(
            F.when(s % 9 == 4, "v").otherwise(F.concat(F.lit("v"), i.cast("string"))).alias("id"), (i <= n_controls).alias("is_control"), (total / n_variants).alias("allocation_pct")
        ),
    )

    def hyp(role: str, text: str = "it works"):
        return F.struct(F.lit(role).alias("role"), F.lit(text).alias("statement"), F.lit("m").alias("primary_metric"))

    hyps = (
        F.when(k % 5 == 0, F.array(hyp("primary", " ")))
        .when(k % 5 == 1, F.array(hyp("primary")))
        .when(k % 5 == 2, F.array(hyp("primary"), hyp("primary")))
        .when(k % 5 == 3, F.filter(F.array(hyp("primary")), lambda _: F.lit(False)))
        .otherwise(F.array(hyp("primary"), hyp("secondary")))
    )

    def met(role: str, name: str = "m"):
        return F.struct(F.lit(role).alias("role"), F.lit(name).alias("name"))

    mets = (
        F.when(k % 6 == 0, F.array(met("secondary")))
        .when(k % 6 == 4, F.array(met("primary", "  ")))
        .when(k % 6 == 5, F.array(met("primary"), met("primary")))
        .otherwise(F.array(met("primary"), met("guardrail")))
    )
    rows = tb.table(spark, sf_dir, "part").select(
        k.alias("definition_id"), variants.alias("variants"), hyps.alias("hypotheses"), mets.alias("metrics"), F.when(F.col("p_brand") == "Brand#11", "").otherwise("ds").alias("dataset_id")
    )
    return decide.definition_audit(rows).drop("variants", "hypotheses", "metrics", "dataset_id")
