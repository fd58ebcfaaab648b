"""Dataset classification over a lake of differently shaped datasets.

The datasets are whole-table views of the source tables under the column names
uploads usually have. The column catalog is profiled once per application and
folder, as a written (checkpointed) table all classification queries read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.functions import fixed
from liftlake.operators import catalog as co
from liftlake.operators import segments
from liftlake.plans import testbed as tb
from liftlake.plans.registry import query
from liftlake.session import materialize

# dataset -> (SQL body, [(column, is_numeric)]); the Spark side mirrors the bodies below
DATASETS = {
    "checkout": (
        "SELECT unit_id AS user_id, arm AS variant, converted, order_value, order_value_pre, channel AS device, balance AS refund_amount, nation AS age, segment AS plan FROM cu",
        [("user_id", 1), ("variant", 0), ("converted", 1), ("order_value", 1), ("order_value_pre", 1), ("device", 0), ("refund_amount", 1), ("age", 1), ("plan", 0)],
    ),
    "event_log": (
        "SELECT event_id, user_id, event_type, ts AS timestamp, value AS latency, props FROM events",
        [("event_id", 1), ("user_id", 1), ("event_type", 0), ("timestamp", 0), ("latency", 1), ("props", 0)],
    ),
    "anonymous_log": (
        "SELECT event_type, ts AS timestamp, value AS amount FROM events",
        [("event_type", 0), ("timestamp", 0), ("amount", 1)],
    ),
    "arm_summary": (
        "SELECT arm AS variant, count(*) AS users, CAST(sum(converted) AS BIGINT) AS conversions, round(sum(lifted_value)) AS revenue FROM cu GROUP BY 1",
        [("variant", 0), ("users", 1), ("conversions", 1), ("revenue", 1)],
    ),
    "arm_rates": (
        "SELECT arm3 AS variant, round(avg(converted), 6) AS click_rate FROM cu GROUP BY 1",
        [("variant", 0), ("click_rate", 1)],
    ),
    "crm": (
        "SELECT arm3 AS segment, nation AS recency, order_value_pre AS history, channel, n_orders AS visit, lifted_converted AS conversion, lifted_value AS spend, balance AS page_load_ms FROM cu",
        [("segment", 0), ("recency", 1), ("history", 1), ("channel", 0), ("visit", 1), ("conversion", 1), ("spend", 1), ("page_load_ms", 1)],
    ),
    "single_arm": (
        "SELECT unit_id AS customer_id, 'A' AS \"group\", lifted_value AS order_total, balance AS pre_metric FROM cu",
        [("customer_id", 1), ("group", 0), ("order_total", 1), ("pre_metric", 1)],
    ),
    "line_items": (
        "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem",
        [("l_orderkey", 1), ("l_partkey", 1), ("l_suppkey", 1), ("l_linenumber", 1), ("l_quantity", 1), ("l_extendedprice", 1), ("l_discount", 1), ("l_tax", 1), ("l_returnflag", 0), ("l_linestatus", 0), ("l_shipdate", 0)],
    ),
}


def lake(spark, sf_dir) -> dict[str, DataFrame]:
    cu = materialize(tb.customer_units(spark, sf_dir))  # five of the datasets below
    ev = tb.table(spark, sf_dir, "events")
    c = F.col
    return {
        "checkout": cu.select(
            c("unit_id").alias("user_id"), c("arm").alias("variant"), "converted", "order_value", "order_value_pre", c("channel").alias("device"),
            c("balance").alias("refund_amount"), c("nation").alias("age"), c("segment").alias("plan"),
        ),
        "event_log": ev.select("event_id", "user_id", "event_type", c("ts").alias("timestamp"), c("value").alias("latency"), "props"),
        "anonymous_log": ev.select("event_type", c("ts").alias("timestamp"), c("value").alias("amount")),
        "arm_summary": materialize(
            cu.groupBy(c("arm").alias("variant")).agg(
                F.count(F.lit(1)).alias("users"), F.sum("converted").alias("conversions"), F.round(F.sum("lifted_value")).alias("revenue")
            )
        ),
        "arm_rates": materialize(cu.groupBy(c("arm3").alias("variant")).agg(F.round(F.avg("converted"), 6).alias("click_rate"))),
        "crm": cu.select(
            c("arm3").alias("segment"), c("nation").alias("recency"), c("order_value_pre").alias("history"), "channel", c("n_orders").alias("visit"),
            c("lifted_converted").alias("conversion"), c("lifted_value").alias("spend"), c("balance").alias("page_load_ms"),
        ),
        "single_arm": cu.select(c("unit_id").alias("customer_id"), F.lit("A").alias("group"), c("lifted_value").alias("order_total"), c("balance").alias("pre_metric")),
        "line_items": tb.table(spark, sf_dir, "lineitem"),
    }


_CATALOGS: dict[tuple[str, str, int], DataFrame] = {}
#: Tables that the lake is made of.
LAKE_TABLES = ("customer", "orders", "lineitem", "events")


def lake_catalog(spark, sf_dir) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, tb.version(spark, sf_dir, *LAKE_TABLES))
    if key not in _CATALOGS:
        _CATALOGS[key] = materialize(co.build_catalog(lake(spark, sf_dir)))
    return _CATALOGS[key]


def _catalog_sql() -> str:
    bodies = ",\n".join(f"ds_{d} AS ({body})" for d, (body, _) in DATASETS.items())
    rows = []
    for d, (_, columns) in DATASETS.items():
        for i, (c, numeric) in enumerate(columns):
            q = f'"{c}"'
            distinct = f"count(DISTINCT {q})"
            zero_one = f"coalesce(bool_and({q} IN (0, 1)), true)" if numeric else f"count({q}) = 0"
            total = f"CAST(sum({q}) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
            values = f"CASE WHEN count(DISTINCT {q}) <= 64 THEN string_agg(DISTINCT CAST({q} AS VARCHAR), ',' ORDER BY CAST({q} AS VARCHAR)) END"
            rows.append(
                f"SELECT '{d}' AS dataset, {i + 1} AS position, '{c}' AS column_name, {'true' if numeric else 'false'} AS is_numeric, count(*) AS n_rows, count(*) - count({q}) AS n_null,"
                f" (count(*) - count({q})) / count(*)::DOUBLE AS null_fraction, {distinct} AS n_distinct, {zero_one} AS zero_one, {total} AS column_sum, {values} AS vals FROM ds_{d}"
            )
    return f"WITH {tb.CUSTOMER_UNITS},\n{bodies},\ncat AS (" + "\nUNION ALL ".join(rows) + ")"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _first(words) -> str:
    pos = f"list_position({_list(words)}, lower(column_name))"
    return f"arg_min(column_name, {pos}) FILTER (WHERE coalesce({pos}, 0) > 0)"


CATALOG = _catalog_sql()
ROLES = (
    CATALOG
    + f""",
ro AS (SELECT dataset, any_value(n_rows) AS n_rows, {_first(fixed.USER_NAMES)} AS user_column, {_first(fixed.ARM_NAMES)} AS variant_column, {_first(fixed.EVENT_NAMES)} AS event_column,
  {_first(fixed.TIMESTAMP_NAMES)} AS timestamp_column, {_first(fixed.OUTCOME_NAMES)} AS outcome_column, {_first(fixed.ARM_SIZE_NAMES)} AS size_column, {_first(fixed.FUNNEL_EVENT_NAMES)} AS funnel_event_column FROM cat GROUP BY 1),
cs AS (SELECT cat.*, ro.* EXCLUDE (dataset, n_rows), lower(column_name) AS low,
  column_name IS NOT DISTINCT FROM user_column OR column_name IS NOT DISTINCT FROM variant_column OR lower(column_name) IN (SELECT unnest({_list(fixed.EVENT_NAMES + fixed.TIMESTAMP_NAMES)})) AS excluded,
  lower(column_name) IN (SELECT unnest({_list(fixed.COVARIATE_NAMES)})) AS covariate_name FROM cat JOIN ro USING (dataset))"""
)


def _label(col: str) -> str:
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.METRIC_LABELS.items())
    title = f"array_to_string(list_transform(string_split(replace({col}, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    return f"CASE lower({col}) {known} ELSE {title} END"


PROMPTS_SQL = """(SELECT 'checkout' AS dataset, 'Did variant B lift order value?' AS prompt UNION ALL SELECT 'crm', 'How did it go?')"""


def prompts(spark):
    return spark.createDataFrame([("checkout", "Did variant B lift order value?"), ("crm", "How did it go?")], "dataset string, prompt string")


METRIC = (
    ROLES
    + f""",
pm0 AS (SELECT cs.*, lower(prompt) AS pr FROM cs LEFT JOIN {PROMPTS_SQL} p USING (dataset)),
pm1 AS (SELECT *, NOT excluded AND is_numeric AS num, coalesce(NOT excluded AND is_numeric AND (contains(pr, low) OR contains(pr, lower({_label('column_name')}))), false) AS named,
  coalesce(list_position({_list(fixed.OUTCOME_NAMES)}, low), 0) AS vr FROM pm0),
pm2 AS (SELECT dataset, count(*) FILTER (WHERE named) AS n_named, max(column_name) FILTER (WHERE named) AS nm, arg_min(column_name, vr) FILTER (WHERE NOT excluded AND vr > 0) AS vocab,
  count(*) FILTER (WHERE num AND NOT covariate_name) AS n_lone, max(column_name) FILTER (WHERE num AND NOT covariate_name) AS lone, count(*) FILTER (WHERE num) AS n_num FROM pm1 GROUP BY 1),
pm3 AS (SELECT *, CASE WHEN n_named = 1 THEN nm WHEN vocab IS NOT NULL THEN vocab WHEN n_lone = 1 THEN lone END AS metric_column FROM pm2),
pm AS (SELECT dataset, metric_column, CASE WHEN metric_column IS NULL THEN 'none_found' WHEN n_named = 1 THEN 'named_in_request' WHEN n_num <= 1 THEN 'no_competing_metric' ELSE 'default_priority' END AS metric_reason,
  CASE WHEN metric_column IS NOT NULL THEN {_label('metric_column')} END AS metric_label FROM pm3)"""
)


@query(
    "catalog_profile",
    CATALOG
    + " SELECT dataset, CAST(position AS INTEGER) AS position, column_name, is_numeric, n_rows, n_null, round(null_fraction, 6) AS null_fraction, n_distinct, zero_one, round(column_sum / n_rows, 4) AS column_mean FROM cat",
)
def profile(spark, sf_dir):
    """Unlike the queries below this one profiles afresh."""
    cat = co.build_catalog(lake(spark, sf_dir))
    return cat.select(
        "dataset", "position", "column_name", "is_numeric", "n_rows", "n_null", F.round("null_fraction", 6).alias("null_fraction"), "n_distinct", "zero_one",
        F.round(F.col("column_sum") / F.col("n_rows"), 4).alias("column_mean"),
    )


def _ctx(spark, sf_dir):
    cat = lake_catalog(spark, sf_dir)
    return cat, co.role_tags(cat)


@query("catalog_role_tags", ROLES + " SELECT * FROM ro")
def role_tags(spark, sf_dir):
    return _ctx(spark, sf_dir)[1]


@query("catalog_primary_metric", METRIC + " SELECT * FROM pm")
def primary_metric(spark, sf_dir):
    return co.primary_metric(*_ctx(spark, sf_dir), prompts(spark))


@query(
    "catalog_available_metrics",
    ROLES
    + f""" SELECT dataset, {_label('column_name')} AS metric_label, arg_min(column_name, position) AS column_name FROM cs
WHERE NOT excluded AND is_numeric AND NOT covariate_name AND NOT regexp_matches(low, '(?:^|_)(?:{"|".join(fixed.DEMOGRAPHIC_WORDS)})(?:_|\\d|$)') GROUP BY 1, 2""",
)
def available(spark, sf_dir):
    return co.available_metrics(*_ctx(spark, sf_dir))


@query(
    "catalog_metric_types",
    CATALOG
    + f" SELECT dataset, column_name, CASE WHEN zero_one THEN 'binary' WHEN regexp_matches(lower(column_name), '{'|'.join(fixed.MONETARY_WORDS)}') THEN 'continuous_monetary' ELSE 'continuous_general' END AS metric_type FROM cat WHERE is_numeric",
)
def metric_types(spark, sf_dir):
    return co.metric_types(lake_catalog(spark, sf_dir))


FACTS = (
    METRIC
    + f""",
df AS (SELECT dataset, any_value(n_rows) AS n_rows, any_value(user_column) AS user_column, any_value(variant_column) AS variant_column, any_value(event_column) AS event_column, any_value(timestamp_column) AS timestamp_column,
  any_value(outcome_column) AS outcome_column, any_value(size_column) AS size_column, max(n_distinct) FILTER (WHERE column_name = user_column) AS n_users, max(n_distinct) FILTER (WHERE column_name = variant_column) AS n_arms,
  max(vals) FILTER (WHERE column_name = variant_column) AS arm_values, max(column_sum) FILTER (WHERE column_name = size_column) AS size_sum,
  bool_or(column_name IS DISTINCT FROM variant_column AND (contains(low, 'rate') OR contains(low, 'ratio'))) AS has_rate,
  coalesce(arg_min(column_name, list_position({_list(fixed.OUTCOME_NAMES)}, low)) FILTER (WHERE column_name IS DISTINCT FROM variant_column AND coalesce(list_position({_list(fixed.OUTCOME_NAMES)}, low), 0) > 0),
    arg_min(column_name, position) FILTER (WHERE column_name IS DISTINCT FROM variant_column AND low NOT IN (SELECT unnest({_list(fixed.ARM_SIZE_NAMES)})) AND n_distinct BETWEEN 2 AND 8)) AS row_outcome,
  count(*) FILTER (WHERE column_name IS DISTINCT FROM variant_column AND low NOT IN (SELECT unnest({_list(fixed.ARM_SIZE_NAMES)}))) AS n_plain FROM cs GROUP BY 1)"""
)


@query(
    "catalog_unit_counts",
    FACTS
    + " SELECT dataset, coalesce(n_arms, 0) AS n_arms, CASE WHEN user_column IS NOT NULL THEN n_users WHEN size_column IS NOT NULL THEN CAST(size_sum AS BIGINT) ELSE n_rows END AS n_units, coalesce(arm_values, '') AS arm_values FROM df",
)
def unit_counts(spark, sf_dir):
    return co.unit_counts(*_ctx(spark, sf_dir))


@query(
    "catalog_shape",
    FACTS
    + """, vt AS (SELECT *, event_column IS NOT NULL OR timestamp_column IS NOT NULL AS logs FROM df),
v2 AS (SELECT *, CASE WHEN logs AND outcome_column IS NULL THEN 'raw_event_level' WHEN NOT logs AND outcome_column IS NOT NULL THEN CASE WHEN user_column IS NOT NULL THEN 'raw_user_level' ELSE 'aggregated_ab_test' END END AS structural_vote,
  CASE WHEN n_users > 0 THEN CASE WHEN n_rows / n_users::DOUBLE >= 1.5 THEN 'raw_event_level' ELSE 'raw_user_level' END END AS quantitative_vote FROM vt)
SELECT dataset, structural_vote, quantitative_vote, CASE WHEN user_column IS NULL THEN CASE WHEN variant_column IS NOT NULL AND size_column IS NOT NULL AND coalesce(structural_vote, 'aggregated_ab_test') = 'aggregated_ab_test' THEN 'aggregated_ab_test' ELSE 'unknown' END
  WHEN structural_vote IS NOT NULL AND quantitative_vote IS NOT NULL AND structural_vote <> quantitative_vote THEN 'unknown' ELSE coalesce(structural_vote, quantitative_vote, 'unknown') END AS shape FROM v2""",
)
def shape(spark, sf_dir):
    return co.dataset_shape(*_ctx(spark, sf_dir))


GRAIN = (
    FACTS
    + """,
g0 AS (SELECT *, event_column IS NOT NULL OR timestamp_column IS NOT NULL AS logs, coalesce(n_rows / nullif(n_users, 0)::DOUBLE >= 1.5, user_column IS NOT NULL) AS repeated,
  list_filter([CASE WHEN variant_column IS NOT NULL THEN 'arm_column' END, CASE WHEN row_outcome IS NOT NULL THEN 'row_outcome' END, 'no_event_column', 'no_timestamp_column', 'no_size_column',
    CASE WHEN n_plain - CASE WHEN row_outcome IS NOT NULL THEN 1 ELSE 0 END > 0 THEN 'row_attributes' END], lambda x: x IS NOT NULL) AS signals FROM df),
gr AS (SELECT *, CASE WHEN user_column IS NOT NULL AND (logs OR repeated) THEN 'user_events' WHEN user_column IS NOT NULL THEN 'user_rows' WHEN variant_column IS NOT NULL AND size_column IS NOT NULL THEN 'arm_rows'
  WHEN logs THEN 'anonymous_events' WHEN has_rate AND variant_column IS NOT NULL THEN 'rate' WHEN variant_column IS NOT NULL AND len(signals) >= 3 THEN 'implicit' ELSE 'none' END AS k FROM g0),
go AS (SELECT dataset, CASE WHEN k IN ('user_events', 'anonymous_events') THEN 'event_level' WHEN k IN ('user_rows', 'implicit') THEN 'unit_level' WHEN k = 'arm_rows' THEN 'aggregate_level' ELSE 'unknown' END AS grain,
  CASE WHEN k IN ('user_events', 'user_rows') THEN 'explicit_column' WHEN k = 'implicit' THEN 'implicit_row' ELSE 'missing' END AS identifier,
  CASE k WHEN 'user_events' THEN 0.97::DOUBLE WHEN 'user_rows' THEN 0.95::DOUBLE WHEN 'arm_rows' THEN 0.91::DOUBLE WHEN 'anonymous_events' THEN 0.9::DOUBLE WHEN 'rate' THEN 0.4::DOUBLE WHEN 'implicit' THEN least(0.5::DOUBLE + 0.1::DOUBLE * len(signals), 0.95::DOUBLE) ELSE 0.3::DOUBLE END AS confidence,
  array_to_string(CASE k WHEN 'user_events' THEN list_filter(['user_column', CASE WHEN event_column IS NOT NULL THEN 'event_column' END, CASE WHEN timestamp_column IS NOT NULL THEN 'timestamp_column' END, CASE WHEN repeated THEN 'repeated_rows' END], lambda x: x IS NOT NULL)
    WHEN 'user_rows' THEN ['user_column', 'one_row_per_unit'] WHEN 'arm_rows' THEN ['size_column', 'arm_column']
    WHEN 'anonymous_events' THEN list_filter([CASE WHEN event_column IS NOT NULL THEN 'event_column' END, CASE WHEN timestamp_column IS NOT NULL THEN 'timestamp_column' END, 'no_user_column'], lambda x: x IS NOT NULL)
    WHEN 'rate' THEN ['rate_column', 'no_size_column'] ELSE signals END, ',') AS evidence,
  CASE k WHEN 'anonymous_events' THEN 'unit_identifier_required' WHEN 'rate' THEN 'rate_without_denominator' WHEN 'none' THEN 'no_experiment_structure' END AS blocking_reason, k FROM gr)"""
)


@query("catalog_grain", GRAIN + " SELECT dataset, grain, identifier, round(confidence, 2) AS confidence, evidence, blocking_reason FROM go")
def grain(spark, sf_dir):
    g = co.dataset_grain(*_ctx(spark, sf_dir))
    return g.withColumn("evidence", F.array_join("evidence", ",")).withColumn("confidence", F.round("confidence", 2))


@query(
    "catalog_experiment_gate",
    GRAIN
    + f""",
gt AS (SELECT df.*, go.grain, go.identifier, pm.metric_column, c.zero_one AS m01, CASE
  WHEN user_column IS NULL AND identifier <> 'implicit_row' AND variant_column IS NOT NULL AND size_column IS NOT NULL THEN 'aggregated_data'
  WHEN user_column IS NULL AND identifier <> 'implicit_row' AND variant_column IS NOT NULL AND has_rate THEN 'rate_without_denominator'
  WHEN user_column IS NULL AND identifier <> 'implicit_row' AND grain = 'event_level' THEN 'event_log_without_unit_id'
  WHEN user_column IS NULL AND identifier <> 'implicit_row' THEN 'no_unit_identifier'
  WHEN variant_column IS NULL THEN 'no_variant_column' WHEN coalesce(n_arms, 99) < 2 THEN 'single_arm' WHEN pm.metric_column IS NULL THEN 'no_metric' END AS reason
  FROM df JOIN go USING (dataset) LEFT JOIN pm USING (dataset) LEFT JOIN cat c ON c.dataset = df.dataset AND c.column_name = pm.metric_column)
SELECT dataset, CASE WHEN reason IS NULL THEN 'ok' ELSE 'refused' END AS status, reason, CASE WHEN reason IS NULL THEN coalesce(user_column, '__experiment_unit_row_id__') END AS user_column,
  CASE WHEN reason IS NULL THEN variant_column END AS variant_column, CASE WHEN reason IS NULL THEN metric_column END AS metric_column,
  CASE WHEN reason IS NULL THEN CASE WHEN m01 THEN 'binary' WHEN regexp_matches(lower(metric_column), '{'|'.join(fixed.MONETARY_WORDS)}') THEN 'continuous_monetary' ELSE 'continuous_general' END END AS metric_type,
  reason IS NULL AND user_column IS NULL AS implicit_unit FROM gt""",
)
def gate(spark, sf_dir):
    return co.experiment_gate(*_ctx(spark, sf_dir), prompts(spark))


def _timing(col: str) -> str:
    return (
        f"CASE WHEN regexp_matches({col}, '{'|'.join(fixed.PRE_TREATMENT_WORDS)}') THEN 'pre_treatment'"
        f" WHEN regexp_matches({col}, '{'|'.join(fixed.POST_TREATMENT_WORDS)}') THEN 'post_treatment' ELSE 'unknown' END"
    )


@query("catalog_treatment_timing", ROLES + f" SELECT dataset, column_name, {_timing('low')} AS timing FROM cs WHERE NOT excluded")
def timing(spark, sf_dir):
    return co.timing_tags(*_ctx(spark, sf_dir))


STAGE_CASE = "CASE " + " ".join(f"WHEN low IN (SELECT unnest({_list(names)})) THEN {i + 1}" for i, (_, names) in enumerate(fixed.FUNNEL_STAGES)) + " END"


@query(
    "catalog_funnel_stages",
    ROLES
    + f""", sc AS (SELECT dataset, {STAGE_CASE} AS stage_no, position, column_name FROM cs WHERE NOT excluded),
s1 AS (SELECT dataset, CAST(stage_no AS INTEGER) AS stage_no, arg_min(column_name, position) AS column_name FROM sc WHERE stage_no IS NOT NULL GROUP BY 1, 2)
SELECT *, count(*) OVER (PARTITION BY dataset) AS n_stages FROM s1 QUALIFY count(*) OVER (PARTITION BY dataset) >= 2""",
)
def stages(spark, sf_dir):
    return co.stage_columns(*_ctx(spark, sf_dir))


@query(
    "catalog_ratio_candidates",
    ROLES
    + f""", rt AS (SELECT *, first_value(column_name) OVER (PARTITION BY dataset ORDER BY coalesce(nullif(list_position({_list(fixed.RATIO_DENOMINATORS)}, low), 0), 999)) AS d0,
  min(coalesce(nullif(list_position({_list(fixed.RATIO_DENOMINATORS)}, low), 0), 999)) OVER (PARTITION BY dataset) AS dr,
  CASE low {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.RATE_NUMERATORS.items())} END AS rate FROM cs WHERE NOT excluded)
SELECT dataset, coalesce(rate, column_name || '_per_' || CASE WHEN lower(d0) LIKE '%s' THEN left(d0, len(d0) - 1) ELSE d0 END) AS metric_name, column_name AS numerator, d0 AS denominator
FROM rt WHERE dr < 999 AND (rate IS NOT NULL OR low IN (SELECT unnest({_list(fixed.MONEY_NUMERATORS)})))""",
)
def ratios(spark, sf_dir):
    return co.ratio_candidates(*_ctx(spark, sf_dir))


@query(
    "catalog_stratification_candidates",
    METRIC
    + " SELECT dataset, column_name, n_distinct FROM cs JOIN pm USING (dataset) WHERE NOT excluded AND column_name IS DISTINCT FROM metric_column AND NOT covariate_name AND n_distinct BETWEEN 2 AND 20",
)
def stratification(spark, sf_dir):
    cat, roles = _ctx(spark, sf_dir)
    return co.stratification_candidates(cat, roles, co.primary_metric(cat, roles, prompts(spark)))


LOWER = "|".join(fixed.LOWER_IS_BETTER_WORDS)
HIGHER = "|".join(fixed.HIGHER_IS_BETTER_WORDS)


@query(
    "catalog_guardrail_candidates",
    METRIC
    + f""" SELECT dataset, column_name, {_label('column_name')} AS metric_label, NOT regexp_matches(low, '{LOWER}') AS higher_is_better FROM cs JOIN pm USING (dataset)
WHERE NOT excluded AND column_name IS DISTINCT FROM metric_column AND is_numeric AND (regexp_matches(low, '{LOWER}') OR regexp_matches(low, '(?:^|_)(?:{HIGHER})(?:_|\\d|$)'))""",
)
def guardrails(spark, sf_dir):
    cat, roles = _ctx(spark, sf_dir)
    return co.guardrail_candidates(cat, roles, co.primary_metric(cat, roles, prompts(spark)))


@query(
    "catalog_covariates",
    METRIC
    + f""", cv AS (SELECT cs.*, metric_column, lower(metric_column) AS m, NOT excluded AND column_name IS DISTINCT FROM metric_column AND covariate_name AND is_numeric AS explicit FROM cs JOIN pm USING (dataset)),
c2 AS (SELECT *, CASE WHEN coalesce(list_position({_list(fixed.ADJUSTMENT_COVARIATE_NAMES)}, low), 0) > 0 THEN list_position({_list(fixed.ADJUSTMENT_COVARIATE_NAMES)}, low)
  {" ".join(f"WHEN low = m || '_{a}' THEN {100 + 2 * i + 1} WHEN low = '{a}_' || m THEN {100 + 2 * i + 2}" for i, a in enumerate(fixed.COVARIATE_AFFIXES))} END AS o FROM cv)
SELECT dataset, coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (WHERE explicit), '') AS explicit_names, CASE WHEN count(*) FILTER (WHERE explicit) = 1 THEN max(column_name) FILTER (WHERE explicit) END AS unique_name,
  arg_min(column_name, o) FILTER (WHERE o IS NOT NULL) AS adjustment_name FROM c2 GROUP BY 1""",
)
def covariates(spark, sf_dir):
    cat, roles = _ctx(spark, sf_dir)
    return co.covariates(cat, roles, co.primary_metric(cat, roles, prompts(spark)))


@query(
    "catalog_funnel_tables",
    ROLES
    + """ SELECT dataset, any_value(user_column) IS NOT NULL AND any_value(timestamp_column) IS NOT NULL AND coalesce(max(CASE WHEN column_name = funnel_event_column THEN n_distinct END) >= 2, false) AS is_funnel,
 any_value(funnel_event_column) AS event_column, any_value(timestamp_column) AS timestamp_column, any_value(variant_column) AS group_column FROM cs GROUP BY 1""",
)
def funnel_tables(spark, sf_dir):
    return co.funnel_tables(*_ctx(spark, sf_dir))


@query(
    "segments_dimensions",
    METRIC
    + f""", sd AS (SELECT cs.*, metric_column FROM cs JOIN pm USING (dataset) WHERE column_name IS DISTINCT FROM user_column AND column_name IS DISTINCT FROM variant_column AND column_name IS DISTINCT FROM metric_column),
s2 AS (SELECT dataset, column_name, CASE WHEN low IN (SELECT unnest({_list(fixed.EVENT_NAMES + fixed.TIMESTAMP_NAMES + fixed.COVARIATE_NAMES)})) THEN 'identifier_or_metric_column' WHEN {_timing('low')} = 'post_treatment' THEN 'post_treatment_variable'
  WHEN null_fraction > 0.3 THEN 'excessive_missing_values' WHEN n_distinct < 2 THEN 'too_few_distinct_values' WHEN n_distinct IS NULL OR n_distinct > 10 THEN 'high_cardinality' END AS skip_reason FROM sd)
SELECT *, skip_reason IS NULL AS usable FROM s2""",
)
def dimensions(spark, sf_dir):
    cat, roles = _ctx(spark, sf_dir)
    chosen = co.primary_metric(cat, roles, prompts(spark))
    return segments.discover_dimensions(cat, roles.join(chosen.select("dataset", "metric_column"), "dataset", "left"))
