"""Segments, interaction tests and strata on the customer experiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftlake.operators import segments, strata, units
from liftlake.plans import testbed as tb
from liftlake.plans.effect_queries import _r
from liftlake.plans.registry import CHECK_SQL, query

KEY = ["experiment_id"]
DIMS = ["segment", "channel"]

CELLS = f"""WITH {tb.CUSTOMER_UNITS},
dm AS (SELECT *, 'segment' AS dimension, segment AS seg FROM cu UNION ALL SELECT *, 'channel', channel FROM cu),
lg AS (SELECT experiment_id, arm, dimension, seg AS segment, 'lifted_value' AS metric, lifted_value AS value FROM dm
  UNION ALL SELECT experiment_id, arm, dimension, seg, 'lifted_converted', CAST(lifted_converted AS DOUBLE) FROM dm),
ce AS (SELECT experiment_id, dimension, segment, metric, arm, count(*) AS n_rows, count(value) AS n, avg(value) AS mean, var_samp(value) AS var,
  CAST(sum(CASE WHEN value = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_success FROM lg GROUP BY 1, 2, 3, 4, 5)"""

EFFECTS = (
    ",\n"
    + f"""pr AS (SELECT c.experiment_id, c.dimension, c.segment, c.metric, c.n AS n_c, t.n AS n_t, c.mean AS mean_c, t.mean AS mean_t, c.var AS var_c, t.var AS var_t, c.n_success AS s_c, t.n_success AS s_t
  FROM ce c JOIN ce t ON c.experiment_id = t.experiment_id AND c.dimension = t.dimension AND c.segment = t.segment AND c.metric = t.metric AND c.arm = 'control' AND t.arm = 'treatment'),
p1 AS (SELECT *, n_c >= 30 AND n_t >= 30 AS enough, sqrt(var_c / n_c + var_t / n_t) AS se, (mean_t - mean_c) / sqrt(var_c / n_c + var_t / n_t) AS t,
  pow(var_c / n_c + var_t / n_t, 2) / (pow(var_c / n_c, 2) / (n_c - 1) + pow(var_t / n_t, 2) / (n_t - 1)) AS df,
  pow(greatest(abs(s_c::DOUBLE * (n_t - s_t) - (n_c - s_c)::DOUBLE * s_t) / (n_c + n_t) - 0.5, 0), 2) * pow(n_c + n_t, 3) / nullif(n_c::DOUBLE * n_t * (s_c + s_t) * (n_c + n_t - s_c - s_t), 0) AS chi2,
  1.959963984540054::DOUBLE * sqrt(mean_c * (1 - mean_c) / n_c + mean_t * (1 - mean_t) / n_t) AS half FROM pr WHERE metric <> 'x'),
tst AS (SELECT *, metric = 'lifted_converted' AS bin FROM p1 WHERE enough),
pv AS (SELECT *, CASE WHEN bin THEN {tb.sql_normal2('sqrt(chi2)')} ELSE {tb.sql_t2('t', 'df')} END AS p_value, CASE WHEN bin THEN 'chi_square' ELSE 'welch_t_test' END AS test_type,
  mean_t - mean_c AS effect_abs, (mean_t - mean_c) / mean_c AS effect_rel,
  mean_t - mean_c - CASE WHEN bin THEN half ELSE {tb.sql_t_crit('df')} * se END AS ci_lower, mean_t - mean_c + CASE WHEN bin THEN half ELSE {tb.sql_t_crit('df')} * se END AS ci_upper FROM tst),
ho AS (SELECT *, count(*) OVER f AS m, least(1.0::DOUBLE, (count(*) OVER f - row_number() OVER (PARTITION BY experiment_id, metric, dimension ORDER BY p_value, segment) + 1) * p_value) AS raw
  FROM pv WINDOW f AS (PARTITION BY experiment_id, metric, dimension)),
ha AS (SELECT *, max(raw) OVER (PARTITION BY experiment_id, metric, dimension ORDER BY p_value, segment ROWS UNBOUNDED PRECEDING) AS adj FROM ho),
sg AS (SELECT experiment_id, dimension, segment, metric, 'SUFFICIENT' AS status, test_type, n_c, n_t, effect_abs, effect_rel, ci_lower, ci_upper, p_value,
    CASE WHEN m >= 2 THEN adj END AS adj_p, m >= 2 AND adj < 0.05 AS reliable FROM ha
  UNION ALL SELECT experiment_id, dimension, segment, metric, 'INSUFFICIENT', NULL, n_c, n_t, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p1 WHERE NOT enough)"""
)
SEG_OUT = """round(effect_abs, 3) AS effect_abs, round(effect_rel, 6) AS effect_rel, round(ci_lower, 2) AS ci_lower, round(ci_upper, 2) AS ci_upper, round(p_value, 6) AS p_value, round(adj_p, 6) AS adj_p, reliable"""


def _cells(spark, sf_dir, dims=None):
    return segments.segment_cells(tb.customer_units(spark, sf_dir), KEY, "arm", ["lifted_value", "lifted_converted"], dims or DIMS)


@query(
    "segments_cells",
    CELLS + " SELECT dimension, segment, metric, arm, n_rows, n, round(mean, 3) AS mean, n_success FROM ce",
)
def cells(spark, sf_dir):
    return _cells(spark, sf_dir).select("dimension", "segment", "metric", "arm", "n_rows", "n", F.round("mean", 3).alias("mean"), "n_success")


@query("segments_effects", CELLS + EFFECTS + f" SELECT dimension, segment, metric, status, test_type, n_c, n_t, {SEG_OUT} FROM sg")
def effects(spark, sf_dir):
    rows = segments.segment_effects(_cells(spark, sf_dir), KEY, "control")
    return _r(
        rows.select("dimension", "segment", "metric", "status", "test_type", "n_c", "n_t", "effect_abs", "effect_rel", "ci_lower", "ci_upper", "p_value", "adj_p", "reliable"),
        {"effect_abs": 3, "effect_rel": 6, "ci_lower": 2, "ci_upper": 2, "p_value": 6, "adj_p": 6},
    )


@query(
    "segments_holm",
    CELLS + EFFECTS + " SELECT dimension, metric, segment, round(p_value, 6) AS p_value, round(adj_p, 6) AS adj_p, reliable FROM sg WHERE status = 'SUFFICIENT'",
)
def holm(spark, sf_dir):
    rows = segments.segment_effects(_cells(spark, sf_dir), KEY, "control").filter(F.col("status") == "SUFFICIENT")
    return _r(rows.select("dimension", "metric", "segment", "p_value", "adj_p", "reliable"), {"p_value": 6, "adj_p": 6})


# the additive logit by bisection on the arm effect: each segment's odds solve a quadratic equation
_BOTH, _ALL = "(c.sc + c.st)", "(c.nc + c.nt)"


def _odds(q: str) -> str:
    b = f"(c.nc + c.nt * {q} - {_BOTH} * (1 + {q}))"
    return f"(2 * {_BOTH} / ({b} + sqrt({b} * {b} + 4 * {q} * ({_ALL} - {_BOTH}) * {_BOTH})))"


def _deviance(n: str, s: str, odds: str) -> str:
    return f"{s} * ln({s} * (1 + {odds}) / ({n} * {odds})) + ({n} - {s}) * ln(({n} - {s}) * (1 + {odds}) / {n})"


_MISSED = f"c.st - c.nt * exp(mid) * {_odds('exp(mid)')} / (1 + exp(mid) * {_odds('exp(mid)')})"
INTERACTIONS = (
    ",\n"
    + f"""ip AS (SELECT c.experiment_id, c.metric, c.dimension, c.n::DOUBLE AS nc, t.n::DOUBLE AS nt, c.n_success::DOUBLE AS sc, t.n_success::DOUBLE AS st
  FROM ce c JOIN ce t ON c.experiment_id = t.experiment_id AND c.dimension = t.dimension AND c.segment = t.segment AND c.metric = t.metric AND c.arm = 'control' AND t.arm = 'treatment'
  WHERE c.n >= 30 AND t.n >= 30),
ig AS (SELECT experiment_id, metric, dimension, CAST(count(*) AS INTEGER) AS k, bool_and(sc > 0 AND sc < nc AND st > 0 AND st < nt) AS inside, list({{'nc': nc, 'nt': nt, 'sc': sc, 'st': st}}) AS cells FROM ip WHERE metric <> 'lifted_value' GROUP BY 1, 2, 3),
ib AS (SELECT experiment_id, metric, dimension, cells, 0 AS step, -30::DOUBLE AS lo, 30::DOUBLE AS hi FROM ig WHERE k >= 2 AND inside
  UNION ALL SELECT experiment_id, metric, dimension, cells, step + 1, CASE WHEN score > 0 THEN mid ELSE lo END, CASE WHEN score > 0 THEN hi ELSE mid END
  FROM (SELECT *, list_sum(list_transform(cells, lambda c: {_MISSED})) AS score FROM (SELECT *, (lo + hi) / 2 AS mid FROM ib WHERE step < 60))),
iv AS (SELECT experiment_id, metric, dimension, greatest(0, 2 * list_sum(list_transform(cells, lambda c: {_deviance('c.nc', 'c.sc', _odds('q'))} + {_deviance('c.nt', 'c.st', f"(q * {_odds('q')})")}))) AS x
  FROM (SELECT *, exp((lo + hi) / 2) AS q FROM ib WHERE step = 60)),
il AS (SELECT ig.experiment_id, ig.metric, ig.dimension, k, x, CASE k WHEN 2 THEN {tb.sql_normal2('sqrt(x)')} WHEN 3 THEN exp(-x / 2) WHEN 4 THEN {tb.sql_normal2('sqrt(x)')} + sqrt(2 * x / pi()) * exp(-x / 2) WHEN 5 THEN exp(-x / 2) * (1 + x / 2) END AS p
  FROM ig LEFT JOIN iv ON ig.experiment_id = iv.experiment_id AND ig.metric = iv.metric AND ig.dimension = iv.dimension)"""
)


@query(
    "segments_interaction_binary",
    CELLS.replace("WITH ", "WITH RECURSIVE ", 1).replace("lifted_converted AS DOUBLE) FROM dm)", "lifted_converted AS DOUBLE) FROM dm UNION ALL SELECT experiment_id, arm, dimension, seg, 'converted', CAST(converted AS DOUBLE) FROM dm)")
    + INTERACTIONS
    + " SELECT experiment_id, metric, dimension, k AS n_segments, k - 1 AS df1, round(x, 6) AS statistic, round(p, 6) AS p_value, coalesce(p < 0.05, false) AS heterogeneous FROM il",
)
def interaction_binary(spark, sf_dir):
    c = segments.segment_cells(tb.customer_units(spark, sf_dir), KEY, "arm", ["lifted_converted", "converted"], DIMS)
    t = segments.interaction_tests(c, KEY, "control")
    return _r(t.select(*KEY, "metric", "dimension", "n_segments", "df1", "statistic", "p_value", "heterogeneous"), {"statistic": 6, "p_value": 6})


# least squares on unit rows with dummy variables: solved here for the two-arm additive model by profiling the arm effect
FITS = """,
w AS (SELECT c.dimension, c.segment, c.n AS nc, t.n AS nt, c.mean AS mc, t.mean AS mt, (c.n - 1) * c.var + (t.n - 1) * t.var AS sse, t.n::DOUBLE * c.n / (t.n + c.n) AS wt
  FROM ce c JOIN ce t ON c.dimension = t.dimension AND c.segment = t.segment AND c.metric = t.metric AND c.arm = 'control' AND t.arm = 'treatment'
  WHERE c.metric = 'lifted_value' AND c.n >= 30 AND t.n >= 30),
b AS (SELECT dimension, sum(wt * (mt - mc)) / sum(wt) AS d, CAST(count(*) AS INTEGER) AS k, sum(sse) AS within, sum(nc + nt) AS nn FROM w GROUP BY 1),
f AS (SELECT w.dimension, k, sum(wt * pow(mt - mc - d, 2)) AS between_ss, any_value(within) AS within, any_value(nn) AS nn FROM w JOIN b USING (dimension) GROUP BY 1, 2),
g AS (SELECT dimension, k, (between_ss / (k - 1)) / (within / (nn - 2 * k)) AS f, (nn - 2 * k)::DOUBLE AS d2 FROM f WHERE k >= 2)"""


@query(
    "segments_interaction_continuous",
    CELLS
    + FITS
    + f"""
SELECT dimension, k AS n_segments, round(f, 6) AS statistic, round({tb.sql_f_sf('f', '(k - 1)', 'd2')}, 6) AS p_value FROM g""",
)
def interaction_continuous(spark, sf_dir):
    c = segments.segment_cells(tb.customer_units(spark, sf_dir), KEY, "arm", ["lifted_value"], DIMS)
    t = segments.interaction_tests(c, KEY, "control").filter(F.col("n_segments") >= 2)
    return _r(t.select("dimension", "n_segments", "statistic", "p_value"), {"statistic": 6, "p_value": 6})


@query(
    "segments_summary",
    CELLS
    + EFFECTS
    + """ SELECT experiment_id, metric, count(*) FILTER (WHERE status = 'SUFFICIENT') AS n_tested, count(*) FILTER (WHERE status <> 'SUFFICIENT') AS n_insufficient,
 coalesce((SELECT string_agg(DISTINCT s2.dimension, ',' ORDER BY s2.dimension) FROM sg s2 WHERE s2.metric = sg.metric AND s2.reliable), '') AS reliable_dimensions, true AS ran
 FROM sg GROUP BY experiment_id, metric""",
)
def summary(spark, sf_dir):
    return segments.segment_summary(segments.segment_effects(_cells(spark, sf_dir), KEY, "control"), KEY)


@query(
    "segments_summary_with_heterogeneity",
    CELLS.replace("WITH ", "WITH RECURSIVE ", 1)
    + EFFECTS
    + FITS
    + INTERACTIONS
    + f""",
hd AS (SELECT metric, dimension, coalesce(p < 0.05, false) AS differs FROM il UNION ALL SELECT 'lifted_value', b.dimension, coalesce({tb.sql_f_sf('f', '(g.k - 1)', 'd2')} < 0.05, false) FROM b LEFT JOIN g USING (dimension))
SELECT experiment_id, metric, count(*) FILTER (WHERE status = 'SUFFICIENT') AS n_tested, count(*) FILTER (WHERE status <> 'SUFFICIENT') AS n_insufficient,
 coalesce((SELECT string_agg(DISTINCT s2.dimension, ',' ORDER BY s2.dimension) FROM sg s2 WHERE s2.metric = sg.metric AND s2.reliable), '') AS reliable_dimensions,
 (SELECT coalesce(string_agg(hd.dimension, ',' ORDER BY hd.dimension) FILTER (WHERE differs), '') FROM hd WHERE hd.metric = sg.metric HAVING count(*) > 0) AS heterogeneous_dimensions, true AS ran
 FROM sg GROUP BY experiment_id, metric""",
)
def summary_mixed(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return segments.segment_summary(segments.segment_effects(c, KEY, "control"), KEY, segments.interaction_tests(c, KEY, "control"))


# the flagship adds a whole-population dimension and the ratio check
CHECK_SQL["flagship_revenue_by_segment"] = (
    CELLS.replace(
        "UNION ALL SELECT *, 'channel', channel FROM cu)",
        "UNION ALL SELECT *, 'channel', channel FROM cu UNION ALL SELECT *, 'population', 'all' FROM cu)",
    )
    + EFFECTS
    + f""",
sr0 AS (SELECT experiment_id, pow(count(*) FILTER (WHERE arm = 'control') - count(*) / 2.0::DOUBLE, 2) / (count(*) / 2.0::DOUBLE) * 2 AS chi2 FROM cu GROUP BY 1),
sr1 AS (SELECT experiment_id, {tb.sql_normal2('sqrt(chi2)')} AS p FROM sr0)
SELECT experiment_id, round(p, 6) AS srm_p_value, p >= 0.05 AS srm_passed, metric, dimension, segment, 'treatment' AS arm, status, test_type, n_c, n_t, {SEG_OUT} FROM sg JOIN sr1 USING (experiment_id)"""
)


# --- strata -------------------------------------------------------------------------
STRATA = f"""WITH {tb.CUSTOMER_UNITS},
st AS (SELECT experiment_id, stratum, count(*) FILTER (WHERE arm = 'control') AS n_control, count(*) FILTER (WHERE arm <> 'control') AS n_treated,
  avg(v) FILTER (WHERE arm = 'control') AS rate_control, avg(v) FILTER (WHERE arm <> 'control') AS rate_treated,
  coalesce(var_samp(v) FILTER (WHERE arm = 'control'), 0) AS var_control, coalesce(var_samp(v) FILTER (WHERE arm <> 'control'), 0) AS var_treated
  FROM (SELECT *, CASE WHEN nation % 11 = 5 THEN NULL WHEN nation = 7 THEN segment || '-' || CAST(nation AS VARCHAR) ELSE segment || '-' || channel END AS stratum, {{v}} AS v FROM cu) GROUP BY 1, 2)"""


def _strata(spark, sf_dir, metric: str):
    """Segment x channel strata, one nation apart (sparse); customers of some nations have no stratum."""
    cu = tb.customer_units(spark, sf_dir).withColumn(
        "stratum",
        F.when(
            F.col("nation") % 11 != 5,
            F.concat_ws("-", "segment", F.when(F.col("nation") == 7, F.col("nation").cast("string")).otherwise(F.col("channel"))),
        ),
    )
    return strata.strata(units.split_arms(cu, "arm", "control"), KEY, "stratum", metric)


@query(
    "strata_eligibility",
    STRATA.format(v="lifted_value")
    + """,
fl AS (SELECT *, n_control > 0 AND n_treated > 0 AS both_arms, n_control >= 10 AND n_treated >= 10 AS suff FROM st)
SELECT experiment_id, CAST(sum(n_control + n_treated) AS BIGINT) AS n_units, CAST(coalesce(sum(n_control + n_treated) FILTER (WHERE stratum IS NULL), 0) AS BIGINT) AS n_missing,
 count(*) FILTER (WHERE stratum IS NOT NULL) AS n_strata, count(*) FILTER (WHERE stratum IS NOT NULL AND both_arms) AS n_both, count(*) FILTER (WHERE stratum IS NOT NULL AND suff) AS n_sufficient,
 coalesce(string_agg(stratum, ',' ORDER BY stratum) FILTER (WHERE stratum IS NOT NULL AND both_arms AND NOT suff), '') AS sparse_strata,
 CASE WHEN count(*) FILTER (WHERE stratum IS NOT NULL AND suff) = 0 THEN 'all_strata_too_sparse' END AS reason,
 count(*) FILTER (WHERE stratum IS NOT NULL AND suff) > 0 AS eligible FROM fl GROUP BY 1""",
)
def eligibility(spark, sf_dir):
    return strata.eligibility(_strata(spark, sf_dir, "lifted_value"), KEY, "stratum", ["stratum"], "arm")


@query(
    "strata_perfect_association",
    f"""WITH {tb.CUSTOMER_UNITS}
SELECT experiment_id, count(*) AS n_units, CAST(0 AS BIGINT) AS n_missing, count(DISTINCT arm) AS n_strata, CAST(0 AS BIGINT) AS n_both, CAST(0 AS BIGINT) AS n_sufficient,
 '' AS sparse_strata, 'perfectly_associated_with_assignment' AS reason, false AS eligible FROM cu GROUP BY 1""",
)
def perfect(spark, sf_dir):
    cu = tb.customer_units(spark, sf_dir).withColumn("landing_page", F.when(F.col("arm") == "control", "old").otherwise("new"))
    rows = strata.strata(units.split_arms(cu, "arm", "control"), KEY, "landing_page", "lifted_value")
    return strata.eligibility(rows, KEY, "landing_page", ["landing_page"], "arm")


@query(
    "strata_rates",
    STRATA.format(v="CAST(lifted_converted AS DOUBLE)")
    + " SELECT stratum, n_control, n_treated, round(rate_control, 6) AS rate_control, round(rate_treated, 6) AS rate_treated FROM st",
)
def rates(spark, sf_dir):
    return _r(_strata(spark, sf_dir, "lifted_converted").select("stratum", "n_control", "n_treated", "rate_control", "rate_treated"), {"rate_control": 6, "rate_treated": 6})


def _effects_sql(v: str, binary: bool) -> str:
    var = (
        "rate_control * (1 - rate_control) / n_control + rate_treated * (1 - rate_treated) / n_treated"
        if binary
        else "var_control / n_control + var_treated / n_treated"
    )
    return STRATA.format(v=v).replace("{v}", v) + (
        f", se AS (SELECT experiment_id, stratum, rate_treated - rate_control AS effect, {var} AS variance FROM st"
        " WHERE stratum IS NOT NULL AND n_control >= 10 AND n_treated >= 10)"
    )


@query(
    "strata_effects",
    _effects_sql("lifted_value", False) + " SELECT stratum, round(effect, 3) AS effect, round(sqrt(variance), 3) AS se FROM se",
)
def stratum_effects(spark, sf_dir):
    e = strata.stratum_effects(_strata(spark, sf_dir, "lifted_value"), "continuous_monetary")
    return e.select("stratum", F.round("effect", 3).alias("effect"), F.round(F.sqrt("variance"), 3).alias("se"))


COMBINE = f""", cb AS (SELECT experiment_id, count(*) AS strata_used, sum(effect / variance) / sum(1 / variance) AS effect, sqrt(1 / sum(1 / variance)) AS standard_error FROM se WHERE variance > 0 GROUP BY 1),
cz AS (SELECT *, effect / standard_error AS z FROM cb)
SELECT strata_used, round(effect, {{d}}) AS effect, round(standard_error, {{d}}) AS standard_error, round({tb.sql_normal2('z')}, 6) AS p_value,
 round(effect - 1.959963984540054::DOUBLE * standard_error, {{d}}) AS ci_lower, round(effect + 1.959963984540054::DOUBLE * standard_error, {{d}}) AS ci_upper FROM cz"""


def _combined(rows, digits):
    out = strata.combine_strata(rows, KEY).select("strata_used", "effect", "standard_error", "p_value", "ci_lower", "ci_upper")
    return _r(out, {"effect": digits, "standard_error": digits, "p_value": 6, "ci_lower": digits, "ci_upper": digits})


@query("strata_combined", _effects_sql("lifted_value", False) + COMBINE.format(d=3))
def combined(spark, sf_dir):
    return _combined(strata.stratum_effects(_strata(spark, sf_dir, "lifted_value"), "continuous_monetary"), 3)


@query("strata_combined_binary", _effects_sql("CAST(lifted_converted AS DOUBLE)", True) + COMBINE.format(d=6))
def combined_binary(spark, sf_dir):
    return _combined(strata.stratum_effects(_strata(spark, sf_dir, "lifted_converted"), "binary"), 6)


@query(
    "strata_diagnostic",
    STRATA.format(v="lifted_value")
    + f""",
dg AS (SELECT *, (n_control + n_treated) / (sum(n_control + n_treated) OVER ())::DOUBLE AS share, pow(n_control - n_treated, 2) / (n_control + n_treated)::DOUBLE AS chi2 FROM st),
dp AS (SELECT *, {tb.sql_normal2('sqrt(chi2)')} AS p FROM dg WHERE stratum IS NOT NULL)
SELECT stratum, n_control, n_treated, round(share, 6) AS share, round(rate_control, 4) AS rate_control, round(rate_treated, 4) AS rate_treated, round(p, 6) AS p_value, p < 0.05 AS srm_flagged FROM dp""",
)
def diagnostic(spark, sf_dir):
    d = strata.diagnose_strata(_strata(spark, sf_dir, "lifted_value"), KEY)
    return _r(d.drop("experiment_id"), {"share": 6, "rate_control": 4, "rate_treated": 4, "p_value": 6})
