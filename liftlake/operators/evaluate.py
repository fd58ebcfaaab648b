"""Evaluation jobs: decisions against labels, safety invariants, retrieval quality, judges, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlake.functions import fixed

CHECKED = ["decision", "validity", "significant", "power_sufficient", "guardrail_status", "effect_direction", "srm_passed"]


def effect_direction(facts: DataFrame) -> DataFrame:
    effect = F.coalesce(F.col("effect_rel"), F.lit(0.0))
    sign = F.when(~F.coalesce(F.col("significant"), F.lit(False)), "none").when(effect < 0, "negative").when(effect > 0, "positive")
    return facts.withColumn("effect_direction", sign.otherwise("none"))


def case_checks(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str] | None = None) -> DataFrame:
    """Field-by-field comparison; a null expectation is not checked. PASS / FAIL / UNSAFE per case."""
    fields = fields or CHECKED
    j = expected.select(*keys, *[F.col(f).cast("string").alias(f"exp_{f}") for f in fields]).join(
        actual.select(*keys, *[F.col(f).cast("string").alias(f"act_{f}") for f in fields]), keys
    )
    bad = {f: F.col(f"exp_{f}").isNotNull() & ~F.col(f"exp_{f}").eqNullSafe(F.col(f"act_{f}")) for f in fields}
    failed = F.array_compact(F.array(*[F.when(bad[f], F.lit(f)) for f in fields]))
    unsafe = bad["decision"] & (
        ((F.col("exp_decision") == "INVALID") & (F.col("act_decision") != "INVALID"))
        | (F.col("exp_decision").isin("NO_GO", "INCONCLUSIVE") & (F.col("act_decision") == "GO"))
    )
    return (
        j.withColumn("failed_fields", F.array_join(failed, ","))
        .withColumn("status", F.when(unsafe, "UNSAFE").when(F.col("failed_fields") == "", "PASS").otherwise("FAIL"))
    )


def confusion(checks: DataFrame) -> DataFrame:
    return checks.groupBy(F.col("exp_decision").alias("expected"), F.col("act_decision").alias("actual")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_accuracy(checks: DataFrame) -> DataFrame:
    return checks.groupBy(F.col("exp_decision").alias("expected")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("exp_decision") == F.col("act_decision")).cast("double")).alias("accuracy")
    )


def _rate(flag: Column, among: Column | None = None) -> Column:
    value = F.when(flag, 1.0).otherwise(0.0)
    return F.coalesce(F.avg(value if among is None else F.when(among, value)), F.lit(0.0))


def decision_rates(checks: DataFrame, guardrail_failed: str = "guardrail_failed") -> DataFrame:
    """One row: accuracies and the safety-related error rates."""
    exp, act = F.col("exp_decision"), F.col("act_decision")
    go = act == "GO"
    return checks.agg(
        F.count(F.lit(1)).alias("n_cases"),
        _rate(F.col("failed_fields") == "").alias("overall_accuracy"),
        _rate(exp == act).alias("decision_accuracy"),
        _rate(go, exp != "GO").alias("false_positive_rate"),
        _rate(~go, exp == "GO").alias("false_negative_rate"),
        _rate(exp.isin("INVALID", "NO_GO", "INCONCLUSIVE") & go).alias("unsafe_go_rate"),
        _rate(F.col(guardrail_failed) & act.isin("GO", "GO_WITH_CAUTION")).alias("guardrail_override_rate"),
        _rate((exp == "INVALID") & (act != "INVALID")).alias("invalid_experiment_approval_rate"),
    )


def invariant_violations(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Five predicates that must hold for every (facts, decision) row; returns the violations."""
    decision = F.col("decision")
    significant = F.coalesce(F.col("significant"), F.lit(False))
    rules = {
        "srm_fail_never_go": F.col("srm_failed") & (decision == "GO"),
        "failed_guardrail_never_go": (F.col("guardrail_status") == "FAIL") & (decision == "GO"),
        "invalid_must_be_invalid": (F.col("srm_failed") | F.col("arm_conflict") | F.col("critical_failure")) & (decision != "INVALID"),
        "underpowered_never_confident_go": ~F.coalesce(F.col("powered"), F.lit(True))
        & significant
        & (F.col("recommendation_confidence") == "HIGH")
        & (decision == "GO"),
        "not_significant_never_claimed": F.col("has_result") & ~significant & decision.isin("GO", "NO_GO"),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return facts.select(*keys, F.explode(broken).alias("invariant"))


def invariant_summary(facts: DataFrame, keys: list[str]) -> DataFrame:
    n = facts.agg(F.count(F.lit(1)).alias("n"))
    v = invariant_violations(facts, keys).agg(F.count(F.lit(1)).alias("n_violations"))
    return v.withColumn("n_checked", 5 * n.select("n").scalar())


def compare_versions(scores: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Deltas of every score between two versions (version, metric, value)."""
    wide = (
        scores.filter(F.col("version").isin(baseline, candidate))
        .groupBy("metric")
        .agg(
            F.max(F.when(F.col("version") == baseline, F.col("value"))).alias("baseline_value"),
            F.max(F.when(F.col("version") == candidate, F.col("value"))).alias("candidate_value"),
        )
    )
    delta = F.col("candidate_value") - F.col("baseline_value")
    worse = (F.col("metric").isin(fixed.HIGHER_BETTER_SCORES) & (delta < 0)) | (
        F.col("metric").isin(fixed.LOWER_BETTER_SCORES) & (delta > 0)
    )
    return wide.withColumn("delta", delta).withColumn(
        "verdict", F.when(delta == 0, "unchanged").when(worse, "regression").otherwise("improvement")
    )


# --- retrieval -------------------------------------------------------------------------
def first_relevant_rank(ranked: DataFrame, labels: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query the best rank of a relevant chunk; ``labels``: query_id, chunk_id."""
    hits = ranked.join(labels.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi")
    best = hits.groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return queries.select("query_id").join(best, "query_id", "left")


def retrieval_scores(first_ranks: DataFrame) -> DataFrame:
    r = F.col("first_rank")
    return first_ranks.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg(F.when(r == 1, 1.0).otherwise(0.0)).alias("hit_at_1"),
        F.avg(F.when(r <= 3, 1.0).otherwise(0.0)).alias("hit_at_3"),
        F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"),
        F.avg(F.coalesce(F.when(r <= 3, 1.0 / F.log2(r + 1)), F.lit(0.0))).alias("ndcg_at_3"),
        F.count_if(r.isNull() | (r > 3)).alias("n_misses"),
    )


def rag_scores(retrieved: DataFrame, labels: DataFrame, facts: DataFrame, queries: DataFrame) -> DataFrame:
    """Precision, recall and fact coverage per query.

    ``retrieved``: query_id, chunk_id, content (k rows per query); ``labels``:
    relevant chunks; ``facts``: query_id, fact. A fact is covered when any
    retrieved content contains it.
    """
    relevant = labels.select("query_id", "chunk_id").distinct().withColumn("__rel", F.lit(1))
    got = retrieved.join(relevant, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_retrieved"), F.count("__rel").alias("n_hits")
    )
    wanted = labels.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("n_relevant"))
    covered = (
        facts.join(retrieved.select("query_id", F.lower("content").alias("__c")), "query_id", "left")
        .groupBy("query_id", "fact")
        .agg(F.coalesce(F.max(F.contains(F.col("__c"), F.lower(F.col("fact"))).cast("int")), F.lit(0)).alias("hit"))
        .groupBy("query_id")
        .agg(F.avg("hit").alias("fact_coverage"))
    )
    return (
        queries.select("query_id")
        .join(got, "query_id", "left")
        .join(wanted, "query_id", "left")
        .join(covered, "query_id", "left")
        .select(
            "query_id",
            F.coalesce(F.col("n_hits") / F.col("n_retrieved"), F.lit(0.0)).alias("precision_at_k"),
            F.coalesce(F.col("n_hits") / F.col("n_relevant"), F.lit(0.0)).alias("recall_at_k"),
            F.coalesce("fact_coverage", F.lit(1.0)).alias("fact_coverage"),
        )
    )


# --- scenarios and prose -------------------------------------------------------------------
def numeric_consistency(facts: DataFrame, reports: DataFrame, keys: list[str], numbers: list[str]) -> DataFrame:
    """Numbers must pass from facts to reports unchanged; no citation without retrieved evidence."""
    j = facts.select(*keys, "expected_decision", "expected_confidence", "n_evidence", *[F.col(c).alias(f"f_{c}") for c in numbers]).join(
        reports.select(*keys, "decision", "confidence", "n_citations", *[F.col(c).alias(f"r_{c}") for c in numbers]), keys
    )
    same = F.lit(True)
    for c in numbers:
        same = same & F.col(f"f_{c}").eqNullSafe(F.col(f"r_{c}"))
    return j.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("decision") == F.col("expected_decision"), 1.0).otherwise(0.0)).alias("decision_accuracy"),
        F.avg(F.when(F.col("confidence") == F.col("expected_confidence"), 1.0).otherwise(0.0)).alias("confidence_accuracy"),
        F.avg(F.when(same, 1.0).otherwise(0.0)).alias("numeric_consistency"),
        F.avg(F.when((F.col("n_evidence") == 0) & (F.col("n_citations") > 0), 1.0).otherwise(0.0)).alias("unsupported_citation_rate"),
    )


def number_tokens(text: Column) -> Column:
    """Numbers in a text, without thousands separators and percent signs."""
    found = F.regexp_extract_all(text, F.lit(fixed.NUMBER_PATTERN), F.lit(0))
    return F.transform(found, lambda t: F.replace(F.regexp_replace(t, "%+$", ""), F.lit(","), F.lit("")))


def unsupported_numbers(rows: DataFrame, prose: str, facts: str) -> DataFrame:
    """Numbers of the prose that occur nowhere in the facts text."""
    extra = F.filter(
        number_tokens(F.col(prose)),
        lambda t: (F.length(t) > 0) & ~t.isin("-", "+") & ~F.array_contains(number_tokens(F.col(facts)), t),
    )
    return rows.withColumn("unsupported", F.array_join(extra, " ")).withColumn("n_unsupported", F.size(extra))


# --- judges ------------------------------------------------------------------------------
def explanation_summary(scores: DataFrame) -> DataFrame:
    dims = ["groundedness", "completeness", "decision_consistency", "clarity"]
    return scores.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(d).alias(f"avg_{d}") for d in dims],
        F.avg(F.when(F.col("n_unsupported") > 0, 1.0).otherwise(0.0)).alias("unsupported_claim_rate"),
    )


def repeat_agreement(scores: DataFrame, case: str, score: str) -> DataFrame:
    """Spread of repeated scores per case and the share of the modal score.

    Scores are a handful of levels, so (case, score) counts are aggregated
    first; ties for the mode go to the lowest score.
    """
    counts = scores.groupBy(case, score).agg(F.count(F.lit(1)).alias("__c"))
    s, c = F.col(score), F.col("__c")
    total = F.sum(c)
    return counts.groupBy(case).agg(
        total.alias("n_runs"),
        (F.sum(s * c) / total).alias("mean_score"),
        F.sqrt(F.greatest(F.sum(s * s * c) / total - (F.sum(s * c) / total) ** 2, F.lit(0.0))).alias("sd_score"),
        F.max(F.struct(c.alias("c"), (-s).alias("s")))["s"].alias("__mode"),
        (F.max(c) / total).alias("agreement_rate"),
    ).withColumn("modal_score", -F.col("__mode")).drop("__mode")


def order_swap(verdicts: DataFrame, case: str) -> DataFrame:
    """Is a pairwise verdict the same after swapping the candidates? (case, presentation, verdict)."""
    g = verdicts.groupBy(case).agg(
        F.max(F.when(F.col("presentation") == "original", F.col("verdict"))).alias("original_verdict"),
        F.max(F.when(F.col("presentation") == "swapped", F.col("verdict"))).alias("swapped_verdict"),
    )
    back = F.when(F.col("swapped_verdict") == "A", "B").when(F.col("swapped_verdict") == "B", "A").otherwise("TIE")
    return g.withColumn("consistent", F.col("original_verdict") == back)


# --- traces ------------------------------------------------------------------------------
def trace_checks(steps: DataFrame, keys: list[str], scenario: str = "scenario") -> DataFrame:
    """Observed step sequences against their scenario's expected one.

    ``steps``: keys, scenario, step_no, step, label, detail. A trace is a run's
    own few steps, so collecting it is bounded by the pipeline's length.
    """
    seq = F.transform(F.array_sort(F.collect_list(F.struct("step_no", "step"))), lambda s: s["step"])
    filled = F.bool_and((F.length(F.trim("label")) > 0) & (F.length(F.trim("detail")) > 0))
    g = steps.groupBy(*keys, scenario).agg(seq.alias("actual"), filled.alias("labels_ok"))
    expected = F.create_map(*[x for k, v in fixed.TRAJECTORIES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return (
        g.withColumn("expected", expected[F.col(scenario)])
        .withColumn("correct_sequence", F.col("actual") == F.col("expected"))
        .withColumn("unnecessary_steps", F.array_join(F.filter("actual", lambda s: ~F.array_contains("expected", s)), ","))
        .withColumn("missing_steps", F.array_join(F.array_except("expected", "actual"), ","))
        .withColumn("reached_terminal", F.element_at("actual", -1) == "decision")
    )


def trace_summary(checks: DataFrame) -> DataFrame:
    one = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return checks.agg(
        F.count(F.lit(1)).alias("n_traces"),
        one(F.col("correct_sequence")).alias("correct_rate"),
        one(F.col("unnecessary_steps") != "").alias("unnecessary_rate"),
        one(F.col("reached_terminal")).alias("completion_rate"),
        one(F.col("labels_ok")).alias("labels_ok_rate"),
    )


