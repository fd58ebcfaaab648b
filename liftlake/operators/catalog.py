"""Column catalog of many datasets and the roles read from it.

``build_catalog`` scans data; everything else is column logic over the catalog (one
row per dataset and column), so a lake of datasets is classified in one job.
Vocabularies are fixed lists of a few dozen words and are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from liftlake.functions import fixed
from liftlake.operators.effects import metric_kind
from liftlake.session import materialize

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
LOW_CARDINALITY = 64  # columns whose values are listed; every rule's cut-off is at most 20

CATALOG_SCHEMA = (
    "dataset string, position int, column_name string, is_numeric boolean, n_rows bigint, n_null bigint, "
    "null_fraction double, n_distinct bigint, zero_one boolean, column_sum double, values array<string>"
)


def _is_numeric(kind: str) -> bool:
    return kind in _NUMERIC or kind.startswith("decimal")


def _kept(kind: str) -> str:
    """The type that a column's values are counted in: one whose values differ just where their texts do."""
    if kind in ("tinyint", "smallint", "int"):
        return "bigint"
    own = kind in ("bigint", "float", "double", "boolean", "date", "timestamp_ntz") or kind.startswith("decimal")
    return kind if own else "string"


def _counts(held: dict[str, DataFrame], listed: list[tuple], kept: str) -> DataFrame:
    """no, value, text, number, cnt: the values of all columns counted in one type (null also for NaN), by the number of the column."""
    parts = []
    for dataset, df in held.items():
        own = [row for row in listed if row[0] == dataset and row[4] == kept]
        if own:
            values = [F.col(f"`{row[2]}`") for row in own]
            values = [F.when(~F.isnan(v), v) if kept in ("float", "double") else v.cast(kept) for v in values]
            parts.append(df.select(F.posexplode(F.array(*values)).alias("at", "value")).select((F.col("at") + own[0][5]).alias("no"), "value"))
    cells, value = reduce(DataFrame.unionByName, parts), F.col("value")
    # grouping takes both zeros for one, their texts differ
    minus = F.when(value == 0, value.cast("string") == "-0.0") if kept in ("float", "double") else F.lit(None).cast("boolean")
    counts = materialize(cells.groupBy("no", "value", minus.alias("minus")).agg(F.count(F.lit(1)).alias("cnt")))
    number = value.cast("double") if _is_numeric(kept) else F.lit(None).cast("double")
    return counts.select("no", "value", F.when(F.col("minus"), "-0.0").otherwise(value.cast("string")).alias("text"), number.alias("number"), "cnt")


def _plain(df: DataFrame) -> list[tuple[str, str]]:
    return [(c, kind) for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct"))]


def build_catalog(datasets: dict[str, DataFrame]) -> DataFrame:
    """Catalog of any number of datasets in one aggregate over all their cells for each type of column.

    Values are counted by (column, value) in the column's own type, combined before the shuffle, so ``n_distinct`` is exact for
    every column and a frequent value is no hot key. A dataset is read once for each type, only the columns of that type; one that is
    costly to derive should be written before. The value counts are written; columns are summed up from them, and the value sets
    are gathered of columns with at most ``LOW_CARDINALITY`` values (null for others).
    """
    held = {name: df for name, df in datasets.items() if _plain(df)}
    if not held:
        raise ValueError("no dataset has a plain column")
    spark = next(iter(held.values())).sparkSession
    columns = [(name, i + 1, c, _is_numeric(kind), _kept(kind)) for name, df in held.items() for i, (c, kind) in enumerate(_plain(df))]
    # numbered by type, so that the columns of a type follow each other in a dataset
    listed = [(*row, no) for no, row in enumerate(sorted(columns, key=lambda row: (row[4], row[0], row[1])))]
    counts = [_counts(held, listed, kept) for kept in sorted({row[4] for row in listed})]
    facts = [
        c.groupBy("no").agg(
            F.sum("cnt").alias("n_rows"),
            F.sum(F.when(F.col("value").isNull(), F.col("cnt")).otherwise(0)).alias("n_null"),
            F.count("value").alias("n_distinct"),
            F.bool_and(F.when(F.col("value").isNotNull(), F.col("number").isNotNull() & F.col("number").isin(0.0, 1.0))).alias("zero_one"),
            F.sum(F.col("number") * F.col("cnt")).alias("column_sum"),
        )
        for c in counts
    ]
    facts = materialize(reduce(DataFrame.unionByName, facts))
    small = F.broadcast(facts.filter(F.col("n_distinct") <= LOW_CARDINALITY).select("no"))
    # bounded by LOW_CARDINALITY values a column
    values = [c.filter(F.col("value").isNotNull()).join(small, "no", "left_semi").select("no", "text") for c in counts]
    values = reduce(DataFrame.unionByName, values).groupBy("no").agg(F.array_sort(F.collect_list("text")).alias("values"))
    columns = spark.createDataFrame([row[:4] + row[5:] for row in listed], "dataset string, position int, column_name string, is_numeric boolean, no int")
    n, missing = F.coalesce("n_rows", F.lit(0)), F.coalesce("n_null", F.lit(0))
    distinct = F.coalesce("n_distinct", F.lit(0))
    return columns.join(facts, "no", "left").join(values, "no", "left").select(
        "dataset",
        "position",
        "column_name",
        "is_numeric",
        n.alias("n_rows"),
        missing.alias("n_null"),
        F.when(n > 0, missing / n).otherwise(1.0).alias("null_fraction"),
        distinct.alias("n_distinct"),
        F.coalesce("zero_one", F.lit(True)).alias("zero_one"),
        "column_sum",
        F.when(distinct <= LOW_CARDINALITY, F.coalesce("values", F.array().cast("array<string>"))).alias("values"),
    )


def profile(df: DataFrame, dataset: str) -> DataFrame:
    """Catalog rows of one table."""
    return build_catalog({dataset: df})


# --- names -------------------------------------------------------------------
def _first_match(vocabulary: list[str]) -> Column:
    """Aggregate: the column whose lower-cased name comes first in the vocabulary."""
    rank = F.array_position(F.array(*[F.lit(t) for t in vocabulary]), F.lower("column_name"))
    return F.min(F.when(rank > 0, F.struct(rank.alias("r"), F.col("position"), F.col("column_name").alias("c"))))["c"]


def label(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in fixed.METRIC_LABELS.items() for x in kv])
    return F.coalesce(known[F.lower(name)], F.initcap(F.replace(name, F.lit("_"), F.lit(" "))))


def treatment_timing(name: Column) -> Column:
    """pre_treatment wins over post_treatment; plain substring match on purpose."""
    low = F.lower(name)
    return (
        F.when(low.rlike("|".join(fixed.PRE_TREATMENT_WORDS)), "pre_treatment")
        .when(low.rlike("|".join(fixed.POST_TREATMENT_WORDS)), "post_treatment")
        .otherwise("unknown")
    )


def has_word(name: Column, words: list[str]) -> Column:
    """A word as its own underscore-delimited part of the name."""
    return F.lower(name).rlike(r"(?:^|_)(?:" + "|".join(words) + r")(?:_|\d|$)")


def lower_is_better(name: Column) -> Column:
    return F.lower(name).rlike("|".join(fixed.LOWER_IS_BETTER_WORDS))


def role_tags(catalog: DataFrame) -> DataFrame:
    """One row per dataset: the column found for every role."""
    return catalog.groupBy("dataset").agg(
        F.max("n_rows").alias("n_rows"),
        _first_match(fixed.USER_NAMES).alias("user_column"),
        _first_match(fixed.ARM_NAMES).alias("variant_column"),
        _first_match(fixed.EVENT_NAMES).alias("event_column"),
        _first_match(fixed.TIMESTAMP_NAMES).alias("timestamp_column"),
        _first_match(fixed.OUTCOME_NAMES).alias("outcome_column"),
        _first_match(fixed.ARM_SIZE_NAMES).alias("size_column"),
        _first_match(fixed.FUNNEL_EVENT_NAMES).alias("funnel_event_column"),
    )


def _structural(catalog: DataFrame, roles: DataFrame) -> DataFrame:
    """Catalog rows with their dataset's roles and flags for structural columns."""
    name, low = F.col("column_name"), F.lower("column_name")
    joined = catalog.drop("n_rows").join(roles, "dataset")
    is_id = name.eqNullSafe(F.col("user_column")) | name.eqNullSafe(F.col("variant_column"))
    is_log = low.isin([*fixed.EVENT_NAMES, *fixed.TIMESTAMP_NAMES])
    return joined.withColumn("excluded", is_id | is_log).withColumn("covariate_name", low.isin(fixed.COVARIATE_NAMES))


# --- metrics -----------------------------------------------------------------
def primary_metric(catalog: DataFrame, roles: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """The primary metric per dataset and why.

    A metric named in the dataset's request text wins if exactly one is; then the
    outcome vocabulary in order; then the only numeric non-covariate column.
    """
    c = _structural(catalog, roles)
    if prompts is not None:
        c = c.join(prompts.select("dataset", F.lower("prompt").alias("prompt")), "dataset", "left")
    else:
        c = c.withColumn("prompt", F.lit(None).cast("string"))
    free = ~F.col("excluded")
    numeric = free & F.col("is_numeric")
    low = F.lower("column_name")
    named = numeric & (F.contains(F.col("prompt"), low) | F.contains(F.col("prompt"), F.lower(label(F.col("column_name")))))
    rank = F.array_position(F.array(*[F.lit(t) for t in fixed.OUTCOME_NAMES]), low)
    by_vocab = F.min(F.when(free & (rank > 0), F.struct(rank.alias("r"), F.col("position"), F.col("column_name").alias("c"))))["c"]
    lone = numeric & ~F.col("covariate_name")
    g = c.groupBy("dataset").agg(
        F.count_if(F.coalesce(named, F.lit(False))).alias("n_named"),
        F.max(F.when(named, F.col("column_name"))).alias("named"),
        by_vocab.alias("vocab"),
        F.count_if(lone).alias("n_lone"),
        F.max(F.when(lone, F.col("column_name"))).alias("lone"),
        F.count_if(numeric).alias("n_numeric"),
    )
    chosen = (
        F.when(F.col("n_named") == 1, F.col("named"))
        .when(F.col("vocab").isNotNull(), F.col("vocab"))
        .when(F.col("n_lone") == 1, F.col("lone"))
    )
    reason = (
        F.when(F.col("metric_column").isNull(), "none_found")
        .when(F.col("n_named") == 1, "named_in_request")
        .when(F.col("n_numeric") <= 1, "no_competing_metric")
        .otherwise("default_priority")
    )
    return g.withColumn("metric_column", chosen).select(
        "dataset", "metric_column", reason.alias("metric_reason"), label(F.col("metric_column")).alias("metric_label")
    )


def available_metrics(catalog: DataFrame, roles: DataFrame) -> DataFrame:
    """Label to column map of numeric outcome columns; the first column wins a label."""
    c = _structural(catalog, roles)
    keep = (
        ~F.col("excluded")
        & F.col("is_numeric")
        & ~F.col("covariate_name")
        & ~has_word(F.col("column_name"), fixed.DEMOGRAPHIC_WORDS)
    )
    return (
        c.filter(keep)
        .withColumn("metric_label", label(F.col("column_name")))
        .groupBy("dataset", "metric_label")
        .agg(F.min(F.struct("position", "column_name"))["column_name"].alias("column_name"))
    )


def metric_types(catalog: DataFrame) -> DataFrame:
    """Kind of every numeric column."""
    return catalog.filter("is_numeric").select(
        "dataset", "column_name", metric_kind(F.col("column_name"), F.col("zero_one")).alias("metric_type")
    )


# --- shape and grain -----------------------------------------------------------
def _dataset_facts(catalog: DataFrame, roles: DataFrame) -> DataFrame:
    """Per-dataset facts the shape, grain and gate rules read."""
    name, low = F.col("column_name"), F.lower("column_name")
    c = catalog.drop("n_rows").join(roles, "dataset")
    is_user, is_arm = name.eqNullSafe(F.col("user_column")), name.eqNullSafe(F.col("variant_column"))
    not_arm = ~is_arm
    small = not_arm & ~low.isin(fixed.ARM_SIZE_NAMES) & F.col("n_distinct").between(2, 8)
    outcome_rank = F.array_position(F.array(*[F.lit(t) for t in fixed.OUTCOME_NAMES]), low)
    named_outcome = F.min(
        F.when(not_arm & (outcome_rank > 0), F.struct(outcome_rank.alias("r"), "position", F.col("column_name").alias("c")))
    )["c"]
    low_card = F.min(F.when(small, F.struct("position", F.col("column_name").alias("c"))))["c"]
    g = c.groupBy("dataset").agg(
        F.max(F.when(is_user, F.col("n_distinct"))).alias("n_users"),
        F.max(F.when(is_arm, F.col("n_distinct"))).alias("n_arms"),
        F.max(F.when(is_arm, F.col("values"))).alias("arm_values"),
        F.max(F.when(name.eqNullSafe(F.col("size_column")), F.col("column_sum"))).alias("size_sum"),
        F.bool_or(not_arm & low.rlike("rate|ratio")).alias("has_rate"),
        F.coalesce(named_outcome, low_card).alias("row_outcome"),
        F.count_if(not_arm & ~low.isin(fixed.ARM_SIZE_NAMES)).alias("n_plain"),
    )
    return roles.join(g, "dataset").withColumn("rows_per_user", F.when(F.col("n_users") > 0, F.col("n_rows") / F.col("n_users")))


def unit_counts(catalog: DataFrame, roles: DataFrame) -> DataFrame:
    """Arms, units and sorted arm values."""
    f = _dataset_facts(catalog, roles)
    units = (
        F.when(F.col("user_column").isNotNull(), F.col("n_users"))
        .when(F.col("size_column").isNotNull(), F.col("size_sum").cast("long"))
        .otherwise(F.col("n_rows"))
    )
    return f.select(
        "dataset",
        F.coalesce(F.col("n_arms"), F.lit(0)).alias("n_arms"),
        units.alias("n_units"),
        F.coalesce(F.array_join("arm_values", ","), F.lit("")).alias("arm_values"),
    )


def dataset_shape(catalog: DataFrame, roles: DataFrame) -> DataFrame:
    """Structural vote against rows-per-user vote."""
    f = _dataset_facts(catalog, roles)
    logs = F.col("event_column").isNotNull() | F.col("timestamp_column").isNotNull()
    outcome = F.col("outcome_column").isNotNull()
    has_user = F.col("user_column").isNotNull()
    structural = (
        F.when(logs & ~outcome, "raw_event_level")
        .when(outcome & ~logs & has_user, "raw_user_level")
        .when(outcome & ~logs, "aggregated_ab_test")
    )
    quantitative = F.when(
        F.col("rows_per_user").isNotNull(),
        F.when(F.col("rows_per_user") >= fixed.EVENT_ROWS_PER_USER, "raw_event_level").otherwise("raw_user_level"),
    )
    arm_sizes = F.col("variant_column").isNotNull() & F.col("size_column").isNotNull()
    shape = (
        F.when(~has_user & arm_sizes & (structural.isNull() | (structural == "aggregated_ab_test")), "aggregated_ab_test")
        .when(~has_user, "unknown")
        .when(structural.isNotNull() & quantitative.isNotNull(), F.when(structural == quantitative, structural).otherwise("unknown"))
        .otherwise(F.coalesce(structural, quantitative, F.lit("unknown")))
    )
    return f.select("dataset", structural.alias("structural_vote"), quantitative.alias("quantitative_vote"), shape.alias("shape"))


def dataset_grain(catalog: DataFrame, roles: DataFrame) -> DataFrame:
    """What one row stands for, how units are identified, and the evidence."""
    f = _dataset_facts(catalog, roles)
    has_user, has_arm = F.col("user_column").isNotNull(), F.col("variant_column").isNotNull()
    has_event, has_time = F.col("event_column").isNotNull(), F.col("timestamp_column").isNotNull()
    has_size = F.col("size_column").isNotNull()
    repeated = F.coalesce(F.col("rows_per_user") >= fixed.EVENT_ROWS_PER_USER, has_user)
    logs = has_event | has_time
    attributes = F.col("n_plain") - F.when(F.col("row_outcome").isNotNull(), 1).otherwise(0) > 0
    signals = F.array_compact(
        F.array(
            F.when(has_arm, F.lit("arm_column")),
            F.when(F.col("row_outcome").isNotNull(), F.lit("row_outcome")),
            F.lit("no_event_column"),
            F.lit("no_timestamp_column"),
            F.lit("no_size_column"),
            F.when(attributes, F.lit("row_attributes")),
        )
    )
    n_signals = F.size(signals)
    case = (
        F.when(has_user & (logs | repeated), "user_events")
        .when(has_user, "user_rows")
        .when(has_arm & has_size, "arm_rows")
        .when(logs, "anonymous_events")
        .when(F.col("has_rate") & has_arm, "rate_without_denominator")
        .when(has_arm & (n_signals >= 3), "implicit_rows")
        .otherwise("no_structure")
    )
    staged = f.withColumn("case", case)
    k = F.col("case")
    return staged.select(
        "dataset",
        F.when(k.isin("user_events", "anonymous_events"), "event_level")
        .when(k.isin("user_rows", "implicit_rows"), "unit_level")
        .when(k == "arm_rows", "aggregate_level")
        .otherwise("unknown")
        .alias("grain"),
        F.when(k.isin("user_events", "user_rows"), "explicit_column")
        .when(k == "implicit_rows", "implicit_row")
        .otherwise("missing")
        .alias("identifier"),
        F.when(k == "user_events", 0.97)
        .when(k == "user_rows", 0.95)
        .when(k == "arm_rows", 0.91)
        .when(k == "anonymous_events", 0.9)
        .when(k == "rate_without_denominator", 0.4)
        .when(k == "implicit_rows", F.least(0.5 + 0.1 * n_signals, F.lit(0.95)))
        .otherwise(0.3)
        .alias("confidence"),
        F.when(
            k == "user_events",
            F.array_compact(
                F.array(
                    F.lit("user_column"),
                    F.when(has_event, F.lit("event_column")),
                    F.when(has_time, F.lit("timestamp_column")),
                    F.when(repeated, F.lit("repeated_rows")),
                )
            ),
        )
        .when(k == "user_rows", F.array(F.lit("user_column"), F.lit("one_row_per_unit")))
        .when(k == "arm_rows", F.array(F.lit("size_column"), F.lit("arm_column")))
        .when(
            k == "anonymous_events",
            F.array_compact(F.array(F.when(has_event, F.lit("event_column")), F.when(has_time, F.lit("timestamp_column")), F.lit("no_user_column"))),
        )
        .when(k == "rate_without_denominator", F.array(F.lit("rate_column"), F.lit("no_size_column")))
        .otherwise(signals)
        .alias("evidence"),
        F.when(k == "anonymous_events", "unit_identifier_required")
        .when(k == "rate_without_denominator", "rate_without_denominator")
        .when(k == "no_structure", "no_experiment_structure")
        .alias("blocking_reason"),
    )


def experiment_gate(catalog: DataFrame, roles: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """Resolved (user, variant, metric, type) or the specific refusal."""
    f = _dataset_facts(catalog, roles).join(dataset_grain(catalog, roles).select("dataset", "grain", "identifier"), "dataset")
    # an implicit row id is not a catalog column, so the exclusion list is unchanged by it
    metric = primary_metric(catalog, roles, prompts)
    kinds = metric_types(catalog).withColumnRenamed("column_name", "metric_column")
    j = f.join(metric, "dataset", "left").join(kinds, ["dataset", "metric_column"], "left")
    has_user, has_arm = F.col("user_column").isNotNull(), F.col("variant_column").isNotNull()
    implicit = F.col("identifier") == "implicit_row"
    refusal = (
        F.when(~has_user & ~implicit & has_arm & F.col("size_column").isNotNull(), "aggregated_data")
        .when(~has_user & ~implicit & has_arm & F.col("has_rate"), "rate_without_denominator")
        .when(~has_user & ~implicit & (F.col("grain") == "event_level"), "event_log_without_unit_id")
        .when(~has_user & ~implicit, "no_unit_identifier")
        .when(~has_arm, "no_variant_column")
        .when(F.coalesce(F.col("n_arms"), F.lit(99)) < 2, "single_arm")
        .when(F.col("metric_column").isNull(), "no_metric")
    )
    ok = refusal.isNull()
    return j.select(
        "dataset",
        F.when(ok, "ok").otherwise("refused").alias("status"),
        refusal.alias("reason"),
        F.when(ok, F.coalesce("user_column", F.lit("__experiment_unit_row_id__"))).alias("user_column"),
        F.when(ok, F.col("variant_column")).alias("variant_column"),
        F.when(ok, F.col("metric_column")).alias("metric_column"),
        F.when(ok, F.coalesce("metric_type", F.lit("continuous_general"))).alias("metric_type"),
        (ok & ~has_user).alias("implicit_unit"),
    )


# --- candidates ----------------------------------------------------------------
def timing_tags(catalog: DataFrame, roles: DataFrame) -> DataFrame:
    """Pre- / post-treatment tag of every non-structural column."""
    c = _structural(catalog, roles)
    return c.filter(~F.col("excluded")).select("dataset", "column_name", treatment_timing(F.col("column_name")).alias("timing"))


def stage_columns(catalog: DataFrame, roles: DataFrame) -> DataFrame:
    """Funnel-stage columns in canonical order, when a dataset has at least two stages."""
    low = F.lower("column_name")
    stage = F.lit(None).cast("int")
    for i, (_, names) in reversed(list(enumerate(fixed.FUNNEL_STAGES))):
        stage = F.when(low.isin(names), i + 1).otherwise(stage)
    c = _structural(catalog, roles).filter(~F.col("excluded")).withColumn("stage_no", stage).filter(F.col("stage_no").isNotNull())
    one = c.groupBy("dataset", "stage_no").agg(F.min(F.struct("position", "column_name"))["column_name"].alias("column_name"))
    return one.withColumn("n_stages", F.count(F.lit(1)).over(W.partitionBy("dataset"))).filter(F.col("n_stages") >= 2)


def ratio_candidates(catalog: DataFrame, roles: DataFrame) -> DataFrame:
    """Numerator columns over the dataset's first denominator column; named, not computed."""
    c = _structural(catalog, roles).filter(~F.col("excluded"))
    low = F.lower("column_name")
    rank = F.array_position(F.array(*[F.lit(t) for t in fixed.RATIO_DENOMINATORS]), low)
    rates = F.create_map(*[F.lit(x) for kv in fixed.RATE_NUMERATORS.items() for x in kv])
    denominator = F.min(F.when(rank > 0, F.struct(rank.alias("r"), F.col("column_name").alias("c")))).over(W.partitionBy("dataset"))["c"]
    staged = c.withColumn("denominator", denominator).withColumn("__rate", rates[low]).withColumn(
        "__money", low.isin(fixed.MONEY_NUMERATORS)
    )
    singular = F.when(F.lower("denominator").endswith("s"), F.expr("left(denominator, length(denominator) - 1)")).otherwise(
        F.col("denominator")
    )
    return staged.filter(F.col("denominator").isNotNull() & (F.col("__rate").isNotNull() | F.col("__money"))).select(
        "dataset",
        F.coalesce("__rate", F.concat_ws("_per_", F.col("column_name"), singular)).alias("metric_name"),
        F.col("column_name").alias("numerator"),
        "denominator",
    )


def stratification_candidates(catalog: DataFrame, roles: DataFrame, metric: DataFrame) -> DataFrame:
    c = _structural(catalog, roles).join(metric.select("dataset", "metric_column"), "dataset", "left")
    keep = (
        ~F.col("excluded")
        & ~F.col("column_name").eqNullSafe(F.col("metric_column"))
        & ~F.col("covariate_name")
        & F.col("n_distinct").between(2, fixed.STRATIFICATION_MAX_CARDINALITY)
    )
    return c.filter(keep).select("dataset", "column_name", "n_distinct")


def guardrail_candidates(catalog: DataFrame, roles: DataFrame, metric: DataFrame) -> DataFrame:
    """Numeric columns named like guardrails, with the direction that is better."""
    name = F.col("column_name")
    c = _structural(catalog, roles).join(metric.select("dataset", "metric_column"), "dataset", "left")
    keep = (
        ~F.col("excluded")
        & ~name.eqNullSafe(F.col("metric_column"))
        & F.col("is_numeric")
        & (lower_is_better(name) | has_word(name, fixed.HIGHER_IS_BETTER_WORDS))
    )
    return c.filter(keep).select(
        "dataset", "column_name", label(name).alias("metric_label"), (~lower_is_better(name)).alias("higher_is_better")
    )


def covariates(catalog: DataFrame, roles: DataFrame, metric: DataFrame) -> DataFrame:
    """Covariate columns: all explicit names, the unique one, and the one the adjustment uses."""
    low = F.lower("column_name")
    c = _structural(catalog, roles).join(metric.select("dataset", "metric_column"), "dataset", "left")
    explicit = ~F.col("excluded") & ~F.col("column_name").eqNullSafe(F.col("metric_column")) & F.col("covariate_name") & F.col("is_numeric")
    rank = F.array_position(F.array(*[F.lit(t) for t in fixed.ADJUSTMENT_COVARIATE_NAMES]), low)
    m = F.lower("metric_column")
    generated = F.array(*[x for a in fixed.COVARIATE_AFFIXES for x in (F.concat(m, F.lit("_" + a)), F.concat(F.lit(a + "_"), m))])
    gen_rank = F.array_position(generated, low)
    order = F.when(rank > 0, rank).when(gen_rank > 0, gen_rank + 100)
    used = F.min(F.when(order.isNotNull(), F.struct(order.alias("o"), F.col("column_name").alias("c"))))["c"]
    return c.groupBy("dataset").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(explicit, F.col("column_name")))), ",").alias("explicit_names"),
        F.when(F.count_if(explicit) == 1, F.max(F.when(explicit, F.col("column_name")))).alias("unique_name"),
        used.alias("adjustment_name"),
    )


def funnel_tables(catalog: DataFrame, roles: DataFrame) -> DataFrame:
    """Datasets a funnel can run on: user, event with two or more values, timestamp."""
    c = catalog.drop("n_rows").join(roles, "dataset")
    event_values = F.max(F.when(F.col("column_name").eqNullSafe(F.col("funnel_event_column")), F.col("n_distinct")))
    g = c.groupBy("dataset", "user_column", "funnel_event_column", "timestamp_column", "variant_column").agg(event_values.alias("__ev"))
    return g.select(
        "dataset",
        (
            F.col("user_column").isNotNull()
            & F.coalesce(F.col("__ev") >= 2, F.lit(False))
            & F.col("timestamp_column").isNotNull()
        ).alias("is_funnel"),
        F.col("funnel_event_column").alias("event_column"),
        "timestamp_column",
        F.col("variant_column").alias("group_column"),
    )


def catalog_from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A catalog given as literal rows (dataset definitions kept outside the lake, tests)."""
    return spark.createDataFrame(rows, CATALOG_SCHEMA)
