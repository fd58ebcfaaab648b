"""Guardrails, hypotheses, validity, decisions and their explanations.

Every function is column logic over facts tables: one row per experiment, per
comparison or per requested metric. Reasons are canonical codes; display text is
rendered last so that rounding can never change a decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from liftlake.functions import fixed


def _norm(c: Column) -> Column:
    return F.lower(F.trim(c))


# --- guardrails ----------------------------------------------------------------
def resolve_guardrails(requests: DataFrame, labels: DataFrame, primary: DataFrame, keys: list[str]) -> DataFrame:
    """Requested guardrail names against available labels: exact after trim and case fold.

    ``requests``: keys, requested, request_no. ``labels``: keys, metric_label.
    ``primary``: keys, primary_label - never its own guardrail.
    """
    clean = (
        requests.withColumn("requested", F.trim("requested"))
        .filter(F.length("requested") > 0)
        .withColumn("__n", F.lower("requested"))
        .groupBy(*keys, "__n")
        .agg(F.min(F.struct("request_no", "requested")).alias("r"))
        .select(*keys, "__n", "r.request_no", "r.requested")
    )
    usable = (
        labels.join(primary.select(*keys, "primary_label"), keys, "left")
        .filter(~F.col("metric_label").eqNullSafe(F.col("primary_label")))
        .groupBy(*keys, _norm(F.col("metric_label")).alias("__n"))
        .agg(F.max("metric_label").alias("resolved_label"))
    )
    return (
        clean.join(usable, [*keys, "__n"], "left")
        .withColumn("resolved", F.col("resolved_label").isNotNull())
        .select(*keys, "request_no", "requested", "resolved", "resolved_label")
    )


def request_state(resolutions: DataFrame, experiments: DataFrame, keys: list[str]) -> DataFrame:
    counts = resolutions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_requested"), F.count_if("resolved").alias("n_resolved")
    )
    state = (
        F.when(F.col("n_requested").isNull(), "NOT_SPECIFIED")
        .when(F.col("n_resolved") == 0, "REQUESTED_NOT_FOUND")
        .when(F.col("n_resolved") < F.col("n_requested"), "PARTIALLY_AVAILABLE")
        .otherwise("AVAILABLE")
    )
    return experiments.select(*keys).join(counts, keys, "left").withColumn("request_state", state)


def harmful(effect: Column, higher_is_better: Column) -> Column:
    return F.when(higher_is_better, effect < 0).otherwise(effect > 0)


def guardrail_findings(effects: DataFrame) -> DataFrame:
    """Per guardrail: moved the wrong way, and violated when significantly so.

    A zero baseline has no relative effect; the absolute one carries the sign.
    """
    effect = F.coalesce(F.col("effect_rel"), F.col("effect_abs"), F.lit(0.0))
    return effects.withColumn("is_harmful", harmful(effect, F.col("higher_is_better"))).withColumn(
        "violated", F.col("significant") & F.col("is_harmful")
    )


def guardrail_status(findings: DataFrame, experiments: DataFrame, keys: list[str]) -> DataFrame:
    """One status per experiment. A guardrail without a test (null ``significant``) is never
    evaluated, and one that moved the wrong way untested is at least a warning."""
    g = findings.groupBy(*keys).agg(
        F.bool_or("violated").alias("__fail"),
        F.bool_or(F.coalesce(~F.col("significant"), F.lit(True)) & F.col("is_harmful")).alias("__warn"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("violated"), F.col("metric")))), ",").alias("violated_metrics"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("significant").isNotNull(), F.col("metric")))), ",").alias("evaluated_metrics"),
    )
    status = (
        F.when(F.col("__fail"), "FAIL")
        .when(F.col("__warn"), "WARNING")
        .when(F.col("__fail").isNull(), "NOT_AVAILABLE")
        .otherwise("PASS")
    )
    return (
        experiments.select(*keys)
        .join(g, keys, "left")
        .withColumn("guardrail_status", status)
        .select(
            *keys,
            "guardrail_status",
            F.coalesce("violated_metrics", F.lit("")).alias("violated_metrics"),
            F.coalesce("evaluated_metrics", F.lit("")).alias("evaluated_metrics"),
        )
    )


# --- primary row, hypotheses -----------------------------------------------------
def primary_rows(effects: DataFrame, keys: list[str]) -> DataFrame:
    """The decision-facing row: winner, else first significant pair, else first pair, else omnibus."""
    rank = (
        F.when(F.col("is_winner"), 0)
        .when(~F.col("is_omnibus") & F.col("significant"), 1)
        .when(~F.col("is_omnibus"), 2)
        .otherwise(3)
    )
    w = W.partitionBy(*keys).orderBy(rank, "arm")
    return effects.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def hypothesis_verdicts(hypotheses: DataFrame, effects: DataFrame, keys: list[str], abs_ratio: bool = True) -> DataFrame:
    """Expected against observed effect.

    ``hypotheses``: keys, primary_metric, expected_direction, expected_effect
    (non-negative relative magnitude or null). ``abs_ratio=False`` divides the
    signed effect by the unsigned magnitude, so a correct decrease can never be
    more than partially supported; the default compares magnitudes.
    """
    pairs = effects.filter(~F.col("is_omnibus"))
    rank = F.row_number().over(W.partitionBy(*keys, _norm(F.col("metric"))).orderBy(F.desc("is_winner"), F.desc("significant"), "arm"))
    one = pairs.withColumn("__rn", rank).filter(F.col("__rn") == 1).select(
        *keys, _norm(F.col("metric")).alias("__m"), "effect_rel", "significant", F.lit(True).alias("__hit")
    )
    j = hypotheses.withColumn("__m", _norm(F.col("primary_metric"))).join(one, [*keys, "__m"], "left")
    direction, effect = F.col("expected_direction"), F.col("effect_rel")
    note = (
        F.when(direction == "no_change", "no_change_not_evaluated")
        .when(F.col("__hit").isNull(), "metric_not_matched")
        .when(effect.isNull(), "zero_baseline")
    )
    supported = F.when(note.isNull(), F.when(direction == "increase", effect > 0).otherwise(effect < 0))
    size = F.abs(effect) if abs_ratio else effect
    ratio = F.when(note.isNull() & (F.col("expected_effect") != 0), size / F.col("expected_effect"))
    verdict = (
        F.when(note.isNotNull(), None)
        .when(~supported | ~F.col("significant"), "NOT_SUPPORTED")
        .when(ratio.isNull() | (ratio >= 1.0), "SUPPORTED")
        .otherwise("PARTIALLY_SUPPORTED")
    )
    return j.select(
        *keys,
        "primary_metric",
        "expected_direction",
        "expected_effect",
        F.when(note.isNull(), effect).alias("observed_effect"),
        supported.alias("direction_supported"),
        F.when(note.isNull(), F.col("significant")).alias("statistically_significant"),
        ratio.alias("achievement_ratio"),
        verdict.alias("verdict"),
        note.alias("note"),
    )


# --- practical significance, validity, decision ------------------------------------
def practical_columns(facts: DataFrame) -> DataFrame:
    """Add threshold_pct, threshold_source, practical and exceeds_threshold.

    Needs expected_effect (null without a matching hypothesis), mde_rel
    (percent), base_value, effect_rel. A post-hoc detectable effect never yields
    a practical verdict, only ``exceeds_threshold``.
    """
    user = F.col("expected_effect").isNotNull()
    threshold = F.when(user, F.abs("expected_effect") * 100).otherwise(F.abs("mde_rel"))
    known = threshold.isNotNull() & ~F.isnan(threshold)
    baseline = F.coalesce(F.col("base_value") != 0, F.lit(False))
    source = F.when(~known, None).when(~baseline, "data_error").when(user, "user_specified").otherwise("post_hoc_mde")
    staged = facts.withColumn("threshold_pct", F.when(known, threshold)).withColumn("threshold_source", source)
    exceeds = F.when(
        F.col("threshold_source").isin("user_specified", "post_hoc_mde"), F.abs(F.col("effect_rel") * 100) >= F.col("threshold_pct")
    )
    return staged.withColumn("exceeds_threshold", exceeds).withColumn(
        "practical", F.when(F.col("threshold_source") == "user_specified", F.col("exceeds_threshold"))
    )


def validity(quality: DataFrame, keys: list[str]) -> DataFrame:
    """INVALID on a failed ratio check, an arm conflict or a critical failure; CAUTION on others."""
    failed = ~F.col("passed")
    g = quality.groupBy(*keys).agg(
        F.coalesce(F.bool_or(failed & (F.col("label") == "srm")), F.lit(False)).alias("srm_failed"),
        F.coalesce(F.bool_or(failed & (F.col("label") == "arm_conflict")), F.lit(False)).alias("arm_conflict"),
        F.coalesce(F.bool_or(failed & F.col("critical")), F.lit(False)).alias("critical_failure"),
        F.coalesce(F.bool_or(failed & ~F.col("informational")), F.lit(False)).alias("any_failure"),
        F.max(F.when(failed & F.col("critical"), F.col("label"))).alias("critical_label"),
    )
    return g.withColumn(
        "validity",
        F.when(F.col("srm_failed") | F.col("arm_conflict") | F.col("critical_failure"), "INVALID")
        .when(F.col("any_failure"), "CAUTION")
        .otherwise("VALID"),
    )


def decide(facts: DataFrame) -> DataFrame:
    """Add decision, reason and recommendation_confidence.

    Reads validity, has_result, significant, powered, effect_rel (or effect_abs
    on a zero baseline), practical, exceeds_threshold, threshold_source and
    guardrail_status. The first matching rule wins. A significant loss with no
    threshold at all falls through to the unknown-practical rule; the order is
    kept on purpose.
    """
    negative = F.coalesce(F.col("effect_rel"), F.col("effect_abs"), F.lit(0.0)) < 0
    post_hoc = F.coalesce(F.col("threshold_source") == "post_hoc_mde", F.lit(False))
    exceeds = F.col("exceeds_threshold")
    unknown = F.col("practical").isNull() & ~post_hoc
    base = F.when(F.col("validity") == "VALID", "HIGH").otherwise("MEDIUM")
    guard = F.col("guardrail_status")
    underpowered = ~F.coalesce(F.col("powered"), F.lit(True))
    rules: list[tuple[Column, str, str, Column]] = [
        (F.col("validity") == "INVALID", "INVALID", "failed_validity", F.lit("LOW")),
        (~F.col("has_result"), "INCONCLUSIVE", "no_test", F.lit("LOW")),
        (~F.col("significant") & underpowered, "INCONCLUSIVE", "not_significant_underpowered", F.lit("MEDIUM")),
        (~F.col("significant"), "INCONCLUSIVE", "not_significant", base),
        (F.coalesce(exceeds, F.lit(False)) & negative, "NO_GO", "significant_loss", base),
        (F.coalesce(~F.col("practical"), F.lit(False)), "NO_GO", "below_target", base),
        (post_hoc & F.coalesce(~exceeds, F.lit(False)), "NO_GO", "below_detectable_effect", F.lit("MEDIUM")),
        (unknown, "GO_WITH_CAUTION", "practical_unknown", F.lit("MEDIUM")),
        (guard == "FAIL", "NO_GO", "guardrail_failed", F.lit("LOW")),
        (guard == "WARNING", "GO_WITH_CAUTION", "guardrail_warning", F.lit("MEDIUM")),
        (guard == "NOT_AVAILABLE", "GO_WITH_CAUTION", "no_guardrail", F.lit("MEDIUM")),
    ]
    chosen = F.lit("GO|all_clear|HIGH")
    for when, decision, reason, confidence in reversed(rules):
        chosen = F.when(when, F.concat(F.lit(f"{decision}|{reason}|"), confidence)).otherwise(chosen)
    parts = F.split(F.col("__d"), r"\|")
    # the guardrail verdict is only reached when every earlier rule let the row pass
    early = F.col("reason").isin(
        "failed_validity", "no_test", "not_significant_underpowered", "not_significant", "significant_loss"
    )
    return (
        facts.withColumn("__d", chosen)
        .withColumn("decision", parts[0])
        .withColumn("reason", parts[1])
        .withColumn("recommendation_confidence", parts[2])
        .drop("__d")
        .withColumn("reported_guardrail", F.when(early, "NOT_AVAILABLE").otherwise(guard))
        .withColumn(
            "practical_reported",
            F.when(F.col("reason").isin("failed_validity", "no_test", "not_significant", "not_significant_underpowered"), None).otherwise(
                F.col("practical")
            ),
        )
    )


def confidence(facts: DataFrame) -> DataFrame:
    """Overall confidence level and stars; needs validity columns and powered."""
    level = (
        F.when(F.col("srm_failed") | F.col("arm_conflict") | F.col("critical_failure"), "LOW")
        .when(F.col("any_failure"), "MEDIUM")
        .when(F.col("powered").isNull(), "MEDIUM")
        .when(~F.col("powered"), "MEDIUM")
        .otherwise("HIGH")
    )
    why = (
        F.when(F.col("srm_failed"), "srm")
        .when(F.col("arm_conflict"), "arm_conflict")
        .when(F.col("critical_failure"), "critical_quality")
        .when(F.col("any_failure"), "quality_warning")
        .when(F.col("powered").isNull(), "no_test")
        .when(~F.col("powered"), "underpowered")
        .otherwise("all_clear")
    )
    return (
        facts.withColumn("confidence", level)
        .withColumn("stars", F.when(F.col("confidence") == "LOW", 1).when(F.col("confidence") == "MEDIUM", 3).otherwise(5))
        .withColumn("confidence_reason", why)
    )


# --- impact, other metrics ----------------------------------------------------------
def impact(effects: DataFrame, hypotheses: DataFrame, datasets: DataFrame, keys: list[str]) -> DataFrame:
    """Expected and observed values, and counts scaled to the population for binary metrics.

    ``effects``: one primary row per experiment. ``datasets``: keys, shape, users.
    """
    j = hypotheses.join(effects, keys, "left").join(datasets.select(*keys, "shape", "users"), keys, "left")
    matched = F.col("metric").isNotNull() & (_norm(F.col("metric")) == _norm(F.col("primary_metric")))
    is_binary = F.col("test_type").isin("chi_square", "fishers_exact")
    signed = F.when(F.col("expected_direction") == "increase", F.col("expected_effect")).when(
        F.col("expected_direction") == "decrease", -F.col("expected_effect")
    )
    warning = (
        F.when(~F.coalesce(matched, F.lit(False)), "no_result_for_metric")
        .when(~is_binary, "not_a_binary_metric")
        .when(F.coalesce(F.col("shape"), F.lit("unknown")) == "unknown", "unknown_dataset_shape")
        .when(F.coalesce(F.col("users"), F.lit(0)) <= 0, "no_population")
        .when(F.col("base_value").isNull() | F.col("observed_value").isNull(), "no_baseline")
        .otherwise("scaled_to_observed_population")
    )
    scaled = F.col("warning") == "scaled_to_observed_population"
    return (
        j.withColumn("warning", warning)
        .withColumn("expected_value", F.when(matched, F.col("base_value") * (1 + signed)))
        .withColumn("observed_absolute", F.when(matched, F.col("observed_value") - F.col("base_value")))
        .withColumn("method", F.when(scaled, "population_scaled").otherwise("unavailable"))
        .withColumn("baseline_count", F.when(scaled, F.col("base_value") * F.col("users")))
        .withColumn("observed_count", F.when(scaled, F.col("observed_value") * F.col("users")))
        .withColumn("incremental_count", F.col("observed_count") - F.col("baseline_count"))
    )


def other_metrics(effects: DataFrame, primary: DataFrame, keys: list[str]) -> DataFrame:
    """Every non-primary comparison: change, direction, and whether it is a trade-off."""
    change = F.coalesce(F.col("effect_rel"), F.col("effect_abs"))
    return (
        effects.filter(~F.col("is_omnibus"))
        .join(primary.select(*keys, "primary_metric"), keys)
        .filter(F.col("metric") != F.col("primary_metric"))
        .withColumn("direction", F.when(change > 0, "increase").when(change < 0, "decrease").otherwise("no_change"))
        .withColumn("is_trade_off", F.col("significant") & (F.col("direction") == "decrease"))
    )


def trade_offs(others: DataFrame, keys: list[str]) -> DataFrame:
    return others.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_trade_off"), F.col("metric")))), ",").alias("trade_offs"),
        F.count(F.lit(1)).alias("n_metrics"),
    )


# --- audit and narrative --------------------------------------------------------------
def audit_facts(decisions: DataFrame, quality: DataFrame, keys: list[str]) -> DataFrame:
    """One row per fact behind a decision: status, category, impact."""

    def fact(label: str, category: str, status: Column, value: Column, effect: Column) -> Column:
        return F.struct(
            F.lit(label).alias("label"),
            F.lit(category).alias("category"),
            status.alias("status"),
            value.alias("value"),
            effect.alias("impact"),
        )

    def two(ok: Column, category: str, label: str, bad_status: str, bad_impact: str, good: str, bad: str) -> Column:
        return fact(
            label,
            category,
            F.when(ok, "PASS").otherwise(bad_status),
            F.when(ok, good).otherwise(bad),
            F.when(ok, "SUPPORTS_DECISION").otherwise(bad_impact),
        )

    has = F.col("has_result")
    guard = F.col("reported_guardrail")
    rows = F.array_compact(
        F.array(
            two(~F.col("srm_failed"), "VALIDITY", "srm", "FAIL", "BLOCKS_DECISION", "pass", "fail"),
            two(~F.col("arm_conflict"), "VALIDITY", "arm_conflict", "FAIL", "BLOCKS_DECISION", "none", "found"),
            F.when(
                ~F.col("critical_failure"),
                fact("critical_checks", "DATA_QUALITY", F.lit("PASS"), F.lit("none_failed"), F.lit("SUPPORTS_DECISION")),
            ),
            F.when(
                has,
                fact("primary_metric", "STATISTICAL_SIGNIFICANCE", F.lit("INFO"), F.col("metric"), F.lit("NEUTRAL")),
            ).otherwise(
                fact("primary_metric", "STATISTICAL_SIGNIFICANCE", F.lit("NOT_AVAILABLE"), F.lit("no_test"), F.lit("NEUTRAL"))
            ),
            F.when(
                has,
                fact(
                    "significance",
                    "STATISTICAL_SIGNIFICANCE",
                    F.when(F.col("significant"), "PASS").otherwise("WARNING"),
                    F.when(F.col("significant"), "significant").otherwise("not_significant"),
                    F.when(F.col("significant"), "SUPPORTS_DECISION").otherwise("NEUTRAL"),
                ),
            ),
            fact(
                "practical",
                "PRACTICAL_SIGNIFICANCE",
                F.when(F.col("practical_reported").isNull(), "NOT_AVAILABLE").when(F.col("practical_reported"), "PASS").otherwise("WARNING"),
                F.when(F.col("practical_reported").isNull(), "not_established").when(F.col("practical_reported"), "confirmed").otherwise("below_threshold"),
                F.when(F.col("practical_reported").isNull(), "LIMITS_CONFIDENCE").when(F.col("practical_reported"), "SUPPORTS_DECISION").otherwise("NEUTRAL"),
            ),
            fact(
                "power",
                "POWER",
                F.when(F.col("powered").isNull(), "NOT_AVAILABLE").when(F.col("powered"), "PASS").otherwise("WARNING"),
                F.when(F.col("powered").isNull(), "not_calculated").when(F.col("powered"), "sufficient").otherwise("underpowered"),
                F.when(F.col("powered").isNull(), "NEUTRAL").when(F.col("powered"), "SUPPORTS_DECISION").otherwise("LIMITS_CONFIDENCE"),
            ),
            fact(
                "guardrails",
                "GUARDRAILS",
                guard,
                F.lower(guard),
                F.when(guard == "PASS", "SUPPORTS_DECISION").when(guard == "FAIL", "BLOCKS_DECISION").otherwise("LIMITS_CONFIDENCE"),
            ),
            fact(
                "segmentation",
                "SEGMENTATION",
                F.when(F.col("reliable_dimensions").isNull(), "NOT_AVAILABLE").otherwise("INFO"),
                F.when(F.col("reliable_dimensions").isNull(), "not_run")
                .when(F.col("reliable_dimensions") != "", F.concat(F.lit("reliable:"), F.col("reliable_dimensions")))
                .otherwise("no_reliable_difference"),
                F.lit("NEUTRAL"),
            ),
        )
    )
    base = decisions.select(*keys, F.explode(rows).alias("f")).select(*keys, "f.*")
    failed = quality.filter(~F.col("passed") & ~F.col("informational") & (F.col("critical") | ~F.col("label").isin("srm", "arm_conflict")))
    extra = failed.select(
        *keys,
        "label",
        F.lit("DATA_QUALITY").alias("category"),
        F.when(F.col("critical"), "FAIL").otherwise("WARNING").alias("status"),
        F.when(F.col("critical"), "critical").otherwise("warning").alias("value"),
        F.when(F.col("critical"), "BLOCKS_DECISION").otherwise("LIMITS_CONFIDENCE").alias("impact"),
    )
    return base.unionByName(extra).withColumn(
        "side",
        F.when(F.col("impact") == "SUPPORTS_DECISION", "supporting")
        .when(F.col("impact").isin("LIMITS_CONFIDENCE", "BLOCKS_DECISION"), "warning")
        .otherwise("neutral"),
    )


def narrative(decisions: DataFrame) -> DataFrame:
    """Why, what prevents a full go, and the next step, as code lists."""
    go = F.col("decision").isin("GO", "GO_WITH_CAUTION")
    guard, state = F.col("reported_guardrail"), F.col("request_state")
    requested = F.when(state == "REQUESTED_NOT_FOUND", "requested_guardrails_missing").when(
        state.isin("AVAILABLE", "PARTIALLY_AVAILABLE"), "requested_guardrails_untested"
    ).otherwise("no_guardrails_evaluated")
    why = F.when(
        go,
        F.array_compact(
            F.array(
                F.when(F.col("significant"), F.lit("significant")),
                F.when(F.col("practical_reported"), "practically_meaningful").when(
                    F.col("practical_reported").isNull(), "practical_not_established"
                ),
                F.when(F.col("validity") == "VALID", "checks_passed").when(F.col("validity") == "CAUTION", "checks_with_warnings"),
                F.when(F.col("powered"), F.lit("powered")),
                F.when(guard == "NOT_AVAILABLE", requested).when(guard == "PASS", "guardrails_passed").when(guard == "WARNING", "guardrail_warning"),
            )
        ),
    ).otherwise(
        F.array_compact(
            F.array(F.col("reason"), F.when((F.col("decision") == "NO_GO") & (guard == "FAIL"), F.concat(F.lit("failed:"), F.col("violated_metrics"))))
        )
    )
    prevents = F.when(
        F.col("decision") == "GO_WITH_CAUTION",
        F.array_compact(
            F.array(
                F.when(guard == "NOT_AVAILABLE", requested).when(guard == "WARNING", "guardrail_warning"),
                F.when(guard == "NOT_AVAILABLE", F.lit("business_impact_unvalidated")),
                F.when(guard == "NOT_AVAILABLE", F.lit("primary_metric_only")),
                F.when(F.col("practical_reported").isNull(), F.lit("practical_not_established")),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))
    step = (
        F.when(F.col("decision") == "INVALID", "fix_validity_and_rerun")
        .when((F.col("decision") == "INCONCLUSIVE") & ~F.coalesce(F.col("powered"), F.lit(True)), "increase_sample")
        .when(F.col("decision") == "INCONCLUSIVE", "address_missing_result")
        .when(F.col("decision") == "NO_GO", "do_not_ship")
        .when(F.col("decision") == "GO", "roll_out_and_monitor")
        .otherwise("controlled_rollout")
    )
    return (
        decisions.withColumn("why", F.array_join(why, ";"))
        .withColumn("prevents_go", F.array_join(prevents, ";"))
        .withColumn("next_step", step)
    )


def monitoring(decisions: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Available metrics that are neither primary nor an evaluated guardrail."""
    held = labels.groupBy(*keys).agg(F.array_sort(F.collect_set("metric_label")).alias("__all"))
    taken = F.concat(F.array(F.col("metric")), F.split("evaluated_metrics", ","))
    return decisions.join(held, keys, "left").withColumn(
        "watch", F.coalesce(F.array_join(F.array_except(F.col("__all"), taken), ","), F.lit(""))
    ).drop("__all")


# --- display --------------------------------------------------------------------------
def p_display(p: Column) -> Column:
    return F.when(p < 0.001, "< 0.001").otherwise(F.format_string("= %.4f", p))


def display_columns(effects: DataFrame) -> DataFrame:
    """Printable values: rates in percent, money in dollars, differences in points."""
    binary = F.col("metric_type") == "binary"
    money = F.col("metric_type") == "continuous_monetary"

    def value(c: str) -> Column:
        sign = F.when(F.col(c) < 0, "-").otherwise("")
        return (
            F.when(binary, F.format_string("%.2f%%", F.col(c) * 100))
            .when(money, F.concat(sign, F.lit("$"), F.format_string("%.2f", F.abs(c))))
            .otherwise(F.format_string("%.2f", F.col(c)))
        )

    def bound(c: str) -> Column:
        plus = F.when(F.col(c) >= 0, "+").otherwise("")
        sign = F.when(F.col(c) < 0, "-").otherwise("")
        return (
            F.when(binary, F.concat(plus, F.format_string("%.2fpp", F.col(c) * 100)))
            .when(money, F.concat(plus, sign, F.lit("$"), F.format_string("%.2f", F.abs(c))))
            .otherwise(F.concat(plus, F.format_string("%.2f", F.col(c))))
        )

    return (
        effects.withColumn("control_text", value("mean_c"))
        .withColumn("treated_text", value("mean_t"))
        .withColumn(
            "delta_text",
            F.when(F.col("effect_rel").isNull(), "N/A").otherwise(
                F.concat(F.when(F.col("effect_rel") >= 0, "+").otherwise(""), F.format_string("%.1f%%", F.col("effect_rel") * 100))
            ),
        )
        .withColumn("p_text", p_display(F.col("p_value")))
        .withColumn("ci_text", F.concat(F.lit("["), bound("ci_lower"), F.lit(", "), bound("ci_upper"), F.lit("]")))
    )


def power_display(power: DataFrame) -> DataFrame:
    mde = F.when(F.col("mde_rel").isNull() | F.isnan("mde_rel"), "N/A").otherwise(F.format_string("%.1f%% relative", F.abs("mde_rel")))
    achieved = F.when(F.col("achieved_power") >= 0.999, ">99.9%").otherwise(F.format_string("%.1f%%", F.col("achieved_power") * 100))
    return (
        power.withColumn("mde_text", mde)
        .withColumn("power_text", achieved)
        .withColumn(
            "sample_text",
            F.concat(
                F.format_number("observed_n", 0),
                F.when(F.col("powered"), " units, powered").otherwise(F.concat(F.lit(" units, needs "), F.format_number("required_n", 0), F.lit(" per arm"))),
            ),
        )
    )


def summary_text(decisions: DataFrame) -> DataFrame:
    return decisions.withColumn(
        "summary", F.concat_ws(" ", F.replace("decision", F.lit("_"), F.lit(" ")), F.lit("-"), F.replace("reason", F.lit("_"), F.lit(" ")))
    )


# --- run status, definitions ------------------------------------------------------------
def run_status(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Worst step status per run; a skipped segmentation or funnel step does not count."""
    severity = F.when(F.col("status") == "FAILED", 3).when(F.col("status") == "WARNING", 2).when(F.col("status") == "SKIPPED", 1).otherwise(0)
    counted = ~((F.col("status") == "SKIPPED") & F.col("step").isin("segmentation", "funnel"))
    g = steps.groupBy(*keys).agg(F.coalesce(F.max(F.when(counted, severity)), F.lit(0)).alias("severity"), F.count(F.lit(1)).alias("n_steps"))
    return g.withColumn(
        "run_status",
        F.when(F.col("severity") == 3, "FAILED").when(F.col("severity") == 2, "WARNING").when(F.col("severity") == 1, "SKIPPED").otherwise("SUCCESS"),
    )


def definition_audit(definitions: DataFrame) -> DataFrame:
    """Definition rules as flags; array columns of structs, no explode needed.

    variants: array<struct<id,is_control,allocation_pct>>; hypotheses:
    array<struct<role,statement,primary_metric>>; metrics: array<struct<role,name>>.
    """
    v, h, m = F.col("variants"), F.col("hypotheses"), F.col("metrics")
    n_control = F.size(F.filter(v, lambda x: x["is_control"]))
    total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x["allocation_pct"])
    ids = F.transform(v, lambda x: x["id"])
    n_primary = F.size(F.filter(h, lambda x: x["role"] == "primary"))
    n_metric = F.size(F.filter(m, lambda x: x["role"] == "primary"))
    filled = F.exists(
        h, lambda x: (x["role"] == "primary") & (F.trim(x["statement"]) != "") & (F.trim(x["primary_metric"]) != "")
    )
    return (
        definitions.withColumn("ok_hypotheses", (F.size(h) == 0) | (n_primary == 1))
        .withColumn("ok_control", (F.size(v) == 0) | (n_control == 1))
        .withColumn("ok_variant_ids", F.size(F.array_distinct(ids)) == F.size(v))
        .withColumn("ok_allocation", (F.size(v) == 0) | (F.abs(total - 100.0) <= 0.5))
        .withColumn("ok_metrics", n_metric <= 1)
        .withColumn("ready_hypothesis", filled)
        .withColumn("ready_variants", (n_control >= 1) & (F.size(v) > n_control))
        .withColumn("ready_metric", F.exists(m, lambda x: (x["role"] == "primary") & (F.trim(x["name"]) != "")))
        .withColumn("ready_data", F.coalesce(F.length("dataset_id") > 0, F.lit(False)))
        .withColumn("is_ready", F.col("ready_hypothesis") & F.col("ready_variants") & F.col("ready_metric") & F.col("ready_data"))
    )
