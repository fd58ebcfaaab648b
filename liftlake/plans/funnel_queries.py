"""Funnels over the whole event log, and stage summaries over customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftlake.operators import effects, funnels
from liftlake.plans import testbed as tb
from liftlake.plans.effect_queries import KEY, _r
from liftlake.plans.registry import query

STEPS = tb.FUNNEL_STEPS

PER_USER = f"""WITH {tb.SESSIONS},
u0 AS (SELECT session, bool_or(event = 'view') AS s1, bool_or(event = 'click') AS s2, bool_or(event = 'signup') AS s3, bool_or(event = 'purchase') AS s4, arg_min(arm, ts) AS arm FROM se GROUP BY 1),
us AS (SELECT session, arm, CASE WHEN NOT s1 THEN 0 WHEN NOT s2 THEN 1 WHEN NOT s3 THEN 2 WHEN NOT s4 THEN 3 ELSE 4 END AS reached FROM u0)"""
STEP_ROWS = """cn AS (SELECT {g} i AS step_no, ['view','click','signup','purchase'][i] AS step, count(*) FILTER (WHERE reached >= i) AS users FROM us, (SELECT unnest([1,2,3,4]) AS i) GROUP BY ALL),
fs AS (SELECT {g} step_no, step, users, users / (first_value(users) OVER w)::DOUBLE AS from_start,
   CASE WHEN step_no = 1 THEN 1.0::DOUBLE WHEN lag(users) OVER w > 0 THEN users / (lag(users) OVER w)::DOUBLE ELSE 0.0::DOUBLE END AS from_previous FROM cn WINDOW w AS ({p} ORDER BY step_no)),
fl AS (SELECT *, lag(step) OVER ({p} ORDER BY step_no) AS prev FROM fs)"""
ALL = PER_USER + ",\n" + STEP_ROWS.format(g="", p="")
BY_ARM = PER_USER + ",\n" + STEP_ROWS.format(g="arm, ", p="PARTITION BY arm")


def _users(spark, sf_dir, group=None):
    return funnels.user_steps(tb.sessions(spark, sf_dir), [], "session", "event", STEPS, group, "ts" if group else None)


@query(
    "funnel_step_order",
    """WITH m AS (SELECT event_type AS event, CAST(floor(quantile_cont(CAST(epoch_us(ts) AS DOUBLE), 0.5)) AS BIGINT) AS median_us FROM events GROUP BY 1)
SELECT 'events' AS log, event, median_us, CAST(row_number() OVER (ORDER BY median_us, event) AS INTEGER) AS position FROM m""",
)
def step_order(spark, sf_dir):
    ev = tb.table(spark, sf_dir, "events").withColumn("log", F.lit("events"))
    return funnels.step_order(ev, ["log"], "event_type", "ts")


@query("funnel_user_steps", PER_USER + " SELECT reached, count(*) AS n_users FROM us GROUP BY 1")
def user_steps(spark, sf_dir):
    return _users(spark, sf_dir).groupBy("reached").agg(F.count(F.lit(1)).alias("n_users"))


@query(
    "funnel_step_sets",
    f"""WITH {tb.SESSIONS}
SELECT 'view' AS step, count(DISTINCT session) AS users FROM se WHERE event = 'view'
UNION ALL SELECT 'click', count(*) FROM (SELECT session FROM se WHERE event = 'view' INTERSECT SELECT session FROM se WHERE event = 'click')
UNION ALL SELECT 'signup', count(*) FROM (SELECT session FROM se WHERE event = 'view' INTERSECT SELECT session FROM se WHERE event = 'click' INTERSECT SELECT session FROM se WHERE event = 'signup')
UNION ALL SELECT 'purchase', count(*) FROM (SELECT session FROM se WHERE event = 'view' INTERSECT SELECT session FROM se WHERE event = 'click' INTERSECT SELECT session FROM se WHERE event = 'signup' INTERSECT SELECT session FROM se WHERE event = 'purchase')""",
)
def step_sets(spark, sf_dir):
    """The set intersections of the steps, from one aggregate instead of one set operation per step."""
    return funnels.funnel_steps(_users(spark, sf_dir), [], STEPS).select("step", "users")


@query("funnel_strict", ALL + " SELECT step_no, step, users, round(from_start, 6) AS from_start, round(from_previous, 6) AS from_previous, false AS empty_start FROM fl")
def strict(spark, sf_dir):
    return _r(funnels.funnel_steps(_users(spark, sf_dir), [], STEPS), {"from_start": 6, "from_previous": 6})


@query(
    "funnel_summary",
    ALL
    + """ SELECT round((SELECT from_start FROM fl WHERE step_no = 4), 6) AS overall_conversion, prev AS drop_from, step AS drop_to, round(1 - from_previous, 6) AS drop_rate
FROM fl WHERE step_no > 1 ORDER BY from_previous, step_no LIMIT 1""",
)
def summary(spark, sf_dir):
    return _r(funnels.funnel_summary(funnels.funnel_steps(_users(spark, sf_dir), [], STEPS), []), {"overall_conversion": 6, "drop_rate": 6})


@query(
    "funnel_by_group",
    BY_ARM + " SELECT arm, step_no, step, users, round(from_start, 6) AS from_start, round(from_previous, 6) AS from_previous, false AS empty_start FROM fl",
)
def by_group(spark, sf_dir):
    per_user = funnels.user_steps(tb.sessions(spark, sf_dir), [], "session", "event", STEPS, "arm")
    return _r(funnels.funnel_steps(per_user, ["arm"], STEPS), {"from_start": 6, "from_previous": 6})


CONVERSIONS = PER_USER + ", cv AS (SELECT arm, session, CASE WHEN reached = 4 THEN 1 ELSE 0 END AS converted FROM us)"


@query("funnel_conversions", CONVERSIONS + " SELECT arm, count(*) AS n_users, CAST(sum(converted) AS BIGINT) AS n_converted FROM cv GROUP BY 1")
def conversions(spark, sf_dir):
    cv = funnels.conversions(_users(spark, sf_dir, "arm"), len(STEPS))
    return cv.groupBy("arm").agg(F.count(F.lit(1)).alias("n_users"), F.sum("converted").alias("n_converted"))


@query(
    "funnel_conversion_effect",
    CONVERSIONS
    + f""",
m AS (SELECT count(*) FILTER (WHERE arm = 'control') AS nc, count(*) FILTER (WHERE arm <> 'control') AS nt, sum(converted) FILTER (WHERE arm = 'control') AS sc, sum(converted) FILTER (WHERE arm <> 'control') AS st FROM cv),
x AS (SELECT *, pow(greatest(abs(sc::DOUBLE * (nt - st) - (nc - sc)::DOUBLE * st) / (nc + nt) - 0.5, 0), 2) * pow(nc + nt, 3) / (nc::DOUBLE * nt * (sc + st) * (nc + nt - sc - st)) AS chi2 FROM m)
SELECT 'chi_square' AS test_type, nc AS n_c, nt AS n_t, round(chi2, 6) AS statistic, round({tb.sql_normal2('sqrt(chi2)')}, 6) AS p_value FROM x""",
)
def conversion_effect(spark, sf_dir):
    """The derived conversion table feeds the two-arm test."""
    cv = funnels.conversions(_users(spark, sf_dir, "arm"), len(STEPS)).withColumn("experiment_id", F.lit("funnel"))
    out = effects.compare_arms(cv, KEY, "arm", ["converted"], "control")
    return _r(out.select("test_type", "n_c", "n_t", "statistic", "p_value"), {"statistic": 6, "p_value": 6})


@query(
    "funnel_group_comparison",
    BY_ARM
    + """, wd AS (SELECT arm, 1 - from_previous AS rate, row_number() OVER (PARTITION BY arm ORDER BY from_previous, step_no) AS rn FROM fl WHERE step_no > 1),
w AS (SELECT arm, rate FROM wd WHERE rn = 1)
SELECT arg_min(arm, rate) AS better_group, arg_max(arm, rate) AS worse_group, round(min(rate), 6) AS better_rate, round(max(rate), 6) AS worse_rate, min(rate) < max(rate) AS differs FROM w""",
)
def group_comparison(spark, sf_dir):
    per_user = funnels.user_steps(tb.sessions(spark, sf_dir), [], "session", "event", STEPS, "arm")
    s = funnels.funnel_summary(funnels.funnel_steps(per_user, ["arm"], STEPS), ["arm"])
    return _r(funnels.compare_drops(s, [], "arm"), {"better_rate": 6, "worse_rate": 6})


# --- unit-level stages: ordered a lot -> spent a lot -> amount -------------------------
STAGES = ["visit", "conversion", "spend"]


def _stages(spark, sf_dir):
    cu = tb.customer_units(spark, sf_dir)
    up = F.when(F.col("arm3") == "b", 1.15).when(F.col("arm3") == "c", 0.97).otherwise(1.0)
    v = F.col("lifted_value") * up
    return cu.select(
        F.lit("crm").alias("experiment_id"), "unit_id", F.col("arm3").alias("arm"), (v > 1500000).cast("int").alias("visit"),
        (v > 2500000).cast("int").alias("conversion"), v.alias("spend"),
    )


STAGE_SQL = f"""WITH {tb.CUSTOMER_UNITS},
v AS (SELECT arm3 AS arm, lifted_value * CASE arm3 WHEN 'b' THEN 1.15::DOUBLE WHEN 'c' THEN 0.97::DOUBLE ELSE 1.0::DOUBLE END AS v FROM cu),
lg AS (SELECT arm, 1 AS stage_no, 'visit' AS metric, CASE WHEN v > 1500000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM v UNION ALL SELECT arm, 2, 'conversion', CASE WHEN v > 2500000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM v
  UNION ALL SELECT arm, 3, 'spend', v FROM v),
mo AS (SELECT stage_no, metric, arm, count(*) AS n, avg(y) AS mean, var_samp(y) AS var, sum(y) AS s FROM lg GROUP BY 1, 2, 3),
pr AS (SELECT c.stage_no, c.metric, t.arm, c.n AS n_c, t.n AS n_t, c.mean AS mean_c, t.mean AS mean_t, c.var AS var_c, t.var AS var_t, c.s AS s_c, t.s AS s_t FROM mo c JOIN mo t ON c.metric = t.metric AND c.arm = 'control' AND t.arm <> 'control'),
p1 AS (SELECT *, (mean_t - mean_c) / sqrt(var_c / n_c + var_t / n_t) AS t, pow(var_c / n_c + var_t / n_t, 2) / (pow(var_c / n_c, 2) / (n_c - 1) + pow(var_t / n_t, 2) / (n_t - 1)) AS df,
  CASE WHEN metric <> 'spend' THEN pow(greatest(abs(s_c * (n_t - s_t) - (n_c - s_c) * s_t) / (n_c + n_t) - 0.5, 0), 2) * pow(n_c + n_t, 3) / (n_c::DOUBLE * n_t * (s_c + s_t) * (n_c + n_t - s_c - s_t)) ELSE 1 END AS chi2 FROM pr),
pv AS (SELECT *, CASE WHEN metric = 'spend' THEN {tb.sql_t2('t', 'df')} ELSE {tb.sql_normal2('sqrt(chi2)')} END AS p_value FROM p1),
sg AS (SELECT *, p_value < 0.05 AS significant FROM pv)"""


@query("crm_stage_summary", STAGE_SQL + " SELECT stage_no, metric, arm, n_c, n_t, round((mean_t - mean_c) / mean_c, 6) AS effect_rel, round(p_value, 6) AS p_value, significant FROM sg")
def stage_summary(spark, sf_dir):
    s = funnels.stage_summary(_stages(spark, sf_dir), KEY, "arm", STAGES)
    return _r(s.select("stage_no", "metric", "arm", "n_c", "n_t", "effect_rel", "p_value", "significant"), {"effect_rel": 6, "p_value": 6})


@query(
    "crm_stage_bridge",
    STAGE_SQL
    + """, nx AS (SELECT arm, metric AS stage, lead(metric) OVER w AS next_stage, significant AS a, lead(significant) OVER w AS b FROM sg WINDOW w AS (PARTITION BY arm ORDER BY stage_no))
SELECT arm, stage, next_stage, CASE WHEN a AND b THEN 'carried_through' WHEN a THEN 'did_not_carry' ELSE 'later_only' END AS bridge FROM nx WHERE next_stage IS NOT NULL AND (a OR b)""",
)
def stage_bridge(spark, sf_dir):
    return funnels.stage_bridge(funnels.stage_summary(_stages(spark, sf_dir), KEY, "arm", STAGES), KEY).drop("experiment_id")
