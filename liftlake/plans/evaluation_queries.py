"""Evaluation jobs over decisions, retrieval results, judge scores and traces derived from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftlake.functions import fixed
from liftlake.operators import evaluate
from liftlake.plans import testbed as tb
from liftlake.plans.corpus_queries import TFIDF, chunks, questions, tfidf_ranked
from liftlake.plans.decision_queries import DECIDED, KEY, run
from liftlake.plans.effect_queries import _r
from liftlake.plans.registry import query
from liftlake.session import materialize

# --- labels against decisions: expectations planted by supplier number -------------------
def _actual(spark, sf_dir):
    d = evaluate.effect_direction(run(spark, sf_dir).decisions)
    return d.withColumn("power_sufficient", F.col("powered")).withColumn("srm_passed", ~F.col("srm_failed")).withColumn(
        "guardrail_failed", F.col("guardrail_status") == "FAIL"
    )


def _expected(spark, sf_dir, actual):
    """Labels: mostly what was decided, with planted disagreements and unchecked fields."""
    e = F.col("experiment_id")
    return actual.select(
        "experiment_id",
        F.when(e % 9 == 0, "GO").when(e % 9 == 1, "INVALID").when(e % 9 == 2, "NO_GO").otherwise(F.col("decision")).alias("decision"),
        F.when(e % 4 != 0, F.col("validity")).alias("validity"),
        F.when(e % 5 == 0, F.lit(True)).otherwise(F.col("significant")).alias("significant"),
        F.lit(None).cast("boolean").alias("power_sufficient"),
        F.col("reported_guardrail").alias("guardrail_status"),
        F.when(e % 6 == 5, "positive").otherwise(F.col("effect_direction")).alias("effect_direction"),
        "srm_passed",
    )


def _checks(spark, sf_dir):
    a = _actual(spark, sf_dir).drop("guardrail_status").withColumnRenamed("reported_guardrail", "guardrail_status")
    x = _expected(spark, sf_dir, a.withColumnRenamed("guardrail_status", "reported_guardrail"))
    return evaluate.case_checks(x, a, KEY).join(a.select("experiment_id", "guardrail_failed"), "experiment_id")


CHECKS = (
    DECIDED
    + """,
ac AS (SELECT *, CASE WHEN NOT coalesce(significant, false) THEN 'none' WHEN coalesce(effect_rel, 0) < 0 THEN 'negative' WHEN coalesce(effect_rel, 0) > 0 THEN 'positive' ELSE 'none' END AS effect_direction FROM de),
ce AS (SELECT experiment_id, guardrail_status = 'FAIL' AS guardrail_failed, decision AS act, CASE experiment_id % 9 WHEN 0 THEN 'GO' WHEN 1 THEN 'INVALID' WHEN 2 THEN 'NO_GO' ELSE decision END AS exp,
  experiment_id % 5 = 0 AND significant IS DISTINCT FROM true AS bad_sig, experiment_id % 6 = 5 AND effect_direction <> 'positive' AS bad_dir FROM ac),
ch AS (SELECT *, exp <> act AS bad_dec, concat_ws(',', CASE WHEN exp <> act THEN 'decision' END, CASE WHEN bad_sig THEN 'significant' END, CASE WHEN bad_dir THEN 'effect_direction' END) AS failed_fields FROM ce),
ck2 AS (SELECT *, CASE WHEN bad_dec AND ((exp = 'INVALID' AND act <> 'INVALID') OR (exp IN ('NO_GO', 'INCONCLUSIVE') AND act = 'GO')) THEN 'UNSAFE' WHEN failed_fields = '' THEN 'PASS' ELSE 'FAIL' END AS status FROM ch)"""
)


@query("eval_case_checks", CHECKS + " SELECT experiment_id, exp AS expected, act AS actual, failed_fields, status FROM ck2")
def case_checks(spark, sf_dir):
    return _checks(spark, sf_dir).select("experiment_id", F.col("exp_decision").alias("expected"), F.col("act_decision").alias("actual"), "failed_fields", "status")


@query("eval_confusion", CHECKS + " SELECT exp AS expected, act AS actual, count(*) AS n FROM ck2 GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return evaluate.confusion(_checks(spark, sf_dir))


@query("eval_class_accuracy", CHECKS + " SELECT exp AS expected, count(*) AS n, round(avg(CASE WHEN exp = act THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy FROM ck2 GROUP BY 1")
def class_accuracy(spark, sf_dir):
    return _r(evaluate.class_accuracy(_checks(spark, sf_dir)), {"accuracy": 9})


RATES_SQL = """ SELECT count(*) AS n_cases, round(avg(CASE WHEN failed_fields = '' THEN 1.0::DOUBLE ELSE 0 END), 9) AS overall_accuracy, round(avg(CASE WHEN exp = act THEN 1.0::DOUBLE ELSE 0 END), 9) AS decision_accuracy,
 round(coalesce(avg(CASE WHEN act = 'GO' THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE exp <> 'GO'), 0), 9) AS false_positive_rate, round(coalesce(avg(CASE WHEN act <> 'GO' THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE exp = 'GO'), 0), 9) AS false_negative_rate,
 round(avg(CASE WHEN exp IN ('INVALID', 'NO_GO', 'INCONCLUSIVE') AND act = 'GO' THEN 1.0::DOUBLE ELSE 0 END), 9) AS unsafe_go_rate, round(avg(CASE WHEN guardrail_failed AND act IN ('GO', 'GO_WITH_CAUTION') THEN 1.0::DOUBLE ELSE 0 END), 9) AS guardrail_override_rate,
 round(avg(CASE WHEN exp = 'INVALID' AND act <> 'INVALID' THEN 1.0::DOUBLE ELSE 0 END), 9) AS invalid_experiment_approval_rate FROM ck2"""


@query("eval_decision_rates", CHECKS + RATES_SQL)
def decision_rates(spark, sf_dir):
    r = evaluate.decision_rates(_checks(spark, sf_dir))
    return _r(r, {c: 9 for c in r.columns if c != "n_cases"})


def _tampered(spark, sf_dir):
    """Decisions with some rows overwritten, so that invariants have something to find."""
    e = F.col("experiment_id")
    d = run(spark, sf_dir).decisions
    return d.withColumn("decision", F.when(e % 8 == 3, "GO").otherwise(F.col("decision"))).withColumn(
        "recommendation_confidence", F.when(e % 8 == 3, "HIGH").otherwise(F.col("recommendation_confidence"))
    )


INVARIANTS = (
    DECIDED
    + """,
ta AS (SELECT * REPLACE (CASE WHEN experiment_id % 8 = 3 THEN 'GO' ELSE decision END AS decision, CASE WHEN experiment_id % 8 = 3 THEN 'HIGH' ELSE recommendation_confidence END AS recommendation_confidence) FROM de),
iv AS (SELECT experiment_id, 'srm_fail_never_go' AS invariant FROM ta WHERE srm_failed AND decision = 'GO'
 UNION ALL SELECT experiment_id, 'failed_guardrail_never_go' FROM ta WHERE guardrail_status = 'FAIL' AND decision = 'GO'
 UNION ALL SELECT experiment_id, 'invalid_must_be_invalid' FROM ta WHERE (srm_failed OR arm_conflict OR critical_failure) AND decision <> 'INVALID'
 UNION ALL SELECT experiment_id, 'underpowered_never_confident_go' FROM ta WHERE NOT coalesce(powered, true) AND coalesce(significant, false) AND recommendation_confidence = 'HIGH' AND decision = 'GO'
 UNION ALL SELECT experiment_id, 'not_significant_never_claimed' FROM ta WHERE has_result AND NOT coalesce(significant, false) AND decision IN ('GO', 'NO_GO'))"""
)


@query("eval_invariant_violations", INVARIANTS + " SELECT * FROM iv")
def violations(spark, sf_dir):
    return evaluate.invariant_violations(_tampered(spark, sf_dir), KEY)


@query("eval_invariants_hold", DECIDED + " SELECT CAST(0 AS BIGINT) AS n_violations, 5 * count(*) AS n_checked FROM de")
def invariants_hold(spark, sf_dir):
    """The decisions as made: no violation."""
    return evaluate.invariant_summary(run(spark, sf_dir).decisions, KEY)


@query(
    "eval_version_comparison",
    CHECKS
    + f""", v1 AS ({RATES_SQL}),
v2 AS (SELECT m.metric, CASE m.metric WHEN 'decision_accuracy' THEN decision_accuracy WHEN 'overall_accuracy' THEN overall_accuracy WHEN 'unsafe_go_rate' THEN unsafe_go_rate WHEN 'false_positive_rate' THEN false_positive_rate ELSE false_negative_rate END AS b FROM v1,
  (SELECT unnest(['decision_accuracy', 'overall_accuracy', 'unsafe_go_rate', 'false_positive_rate', 'false_negative_rate']) AS metric) m)
SELECT metric, b AS baseline_value, CASE WHEN metric IN ('decision_accuracy', 'overall_accuracy') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS candidate_value, round(CASE WHEN metric IN ('decision_accuracy', 'overall_accuracy') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - b, 9) AS delta,
 CASE WHEN CASE WHEN metric IN ('decision_accuracy', 'overall_accuracy') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - b = 0 THEN 'unchanged' ELSE 'improvement' END AS verdict FROM v2""",
)
def versions(spark, sf_dir):
    """The planted labels (baseline) against a version that agrees with every decision (candidate)."""
    names = ["decision_accuracy", "overall_accuracy", "unsafe_go_rate", "false_positive_rate", "false_negative_rate"]
    checks = _checks(spark, sf_dir)
    clean = checks.withColumn("exp_decision", F.col("act_decision")).withColumn("failed_fields", F.lit(""))

    def rows(df, version):
        wide = evaluate.decision_rates(df).select(F.lit(version).alias("version"), *[F.round(n, 9).alias(n) for n in names])
        return wide.unpivot(["version"], names, "metric", "value")

    return evaluate.compare_versions(rows(checks, "a").unionByName(rows(clean, "b")), "a", "b").withColumn("delta", F.round("delta", 9))


# --- retrieval quality -----------------------------------------------------------------------
def _sentences(df, ids, text):
    parts = F.transform(F.split(F.col(text), r"[.\n]"), lambda s: F.trim(s))
    return df.select(*ids, F.explode(F.array_distinct(F.filter(parts, lambda s: F.length(s) >= 25))).alias("sentence"))


def relevant(spark, sf_dir):
    """A chunk is relevant to a question when they share a whole sentence."""
    a = _sentences(questions(spark, sf_dir), ["query_id"], "query_text")
    b = _sentences(chunks(spark, sf_dir), ["chunk_id"], "content")
    return a.join(b, "sentence").select("query_id", "chunk_id").distinct()


RELEVANT = """qs AS (SELECT DISTINCT item_id AS query_id, trim(unnest(regexp_split_to_array(text, '[.\\n]'))) AS s FROM benchmark),
ds AS (SELECT DISTINCT chunk_id, trim(unnest(regexp_split_to_array(content, '[.\\n]'))) AS s FROM ck),
re AS (SELECT DISTINCT query_id, chunk_id FROM qs JOIN ds USING (s) WHERE length(s) >= 25)"""
RANKED = TFIDF.replace("{bar}", "0.12") + f", {RELEVANT}, tk3 AS (SELECT * FROM rk WHERE rank <= 3)"


@query(
    "eval_retrieval",
    RANKED
    + """, fr AS (SELECT item_id AS query_id, (SELECT min(rank) FROM tk3 JOIN re ON re.query_id = tk3.query_id AND re.chunk_id = tk3.chunk_id WHERE tk3.query_id = item_id) AS r FROM benchmark)
SELECT count(*) AS n_queries, round(avg(CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS hit_at_1, round(avg(CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0 END), 9) AS hit_at_3, round(avg(coalesce(1.0::DOUBLE / r, 0)), 9) AS mrr,
 round(avg(coalesce(1.0::DOUBLE / log2(r + 1), 0)), 9) AS ndcg_at_3, count(*) FILTER (WHERE r IS NULL) AS n_misses FROM fr""",
)
def retrieval(spark, sf_dir):
    first = evaluate.first_relevant_rank(tfidf_ranked(spark, sf_dir), relevant(spark, sf_dir), questions(spark, sf_dir))
    return _r(evaluate.retrieval_scores(first), {"hit_at_1": 9, "hit_at_3": 9, "mrr": 9, "ndcg_at_3": 9})


@query(
    "eval_rag",
    RANKED
    + """, fa AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS fact FROM benchmark),
cv AS (SELECT fa.query_id, fact, max(CASE WHEN contains(lower(content), fact) THEN 1 ELSE 0 END) AS hit FROM fa LEFT JOIN tk3 USING (query_id) LEFT JOIN ck USING (chunk_id) GROUP BY 1, 2),
cq AS (SELECT query_id, avg(hit) AS cov FROM cv GROUP BY 1),
gq AS (SELECT tk3.query_id, count(*) AS n, count(re.chunk_id) AS h FROM tk3 LEFT JOIN re ON re.query_id = tk3.query_id AND re.chunk_id = tk3.chunk_id GROUP BY 1),
wq2 AS (SELECT query_id, count(*) AS w FROM re GROUP BY 1)
SELECT item_id AS query_id, round(coalesce(h / n::DOUBLE, 0), 9) AS precision_at_k, round(coalesce(h / w::DOUBLE, 0), 9) AS recall_at_k, round(coalesce(cov, 1), 9) AS fact_coverage
FROM benchmark LEFT JOIN gq ON gq.query_id = item_id LEFT JOIN wq2 ON wq2.query_id = item_id LEFT JOIN cq ON cq.query_id = item_id""",
)
def rag(spark, sf_dir):
    q = questions(spark, sf_dir)
    got = materialize(tfidf_ranked(spark, sf_dir)).join(chunks(spark, sf_dir).select("chunk_id", "content"), "chunk_id")
    facts = q.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("query_text"), F.lit("[a-z]{9,}"), F.lit(0)))).alias("fact"))
    return _r(evaluate.rag_scores(got, relevant(spark, sf_dir), facts, q), {"precision_at_k": 9, "recall_at_k": 9, "fact_coverage": 9})


# --- scenarios, prose, judges, traces ---------------------------------------------------------
@query(
    "eval_numeric_consistency",
    DECIDED
    + """ SELECT count(*) AS n, round(avg(CASE WHEN experiment_id % 12 = 1 AND decision <> 'GO' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 9) AS decision_accuracy, round(avg(CASE WHEN experiment_id % 7 = 2 AND confidence <> 'HIGH' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 9) AS confidence_accuracy,
 round(avg(CASE WHEN experiment_id % 15 = 4 AND mde_rel IS NOT NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 9) AS numeric_consistency, round(avg(CASE WHEN experiment_id % 3 = 0 AND experiment_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS unsupported_citation_rate FROM de""",
)
def numeric_consistency(spark, sf_dir):
    """Reports copied from the facts with planted alterations."""
    e = F.col("experiment_id")
    facts = run(spark, sf_dir).decisions
    scenarios = facts.select(
        "experiment_id", F.when(e % 12 == 1, "GO").otherwise(F.col("decision")).alias("expected_decision"), F.when(e % 7 == 2, "HIGH").otherwise(F.col("confidence")).alias("expected_confidence"),
        F.when(e % 3 == 0, 0).otherwise(2).alias("n_evidence"), "p_value", "mde_rel",
    )
    reports = facts.select(
        "experiment_id", "decision", "confidence", F.when(e % 2 == 0, 1).otherwise(0).alias("n_citations"), "p_value",
        F.when(e % 15 == 4, F.col("mde_rel") + 1).otherwise(F.col("mde_rel")).alias("mde_rel"),
    )
    r = evaluate.numeric_consistency(scenarios, reports, KEY, ["p_value", "mde_rel"])
    return _r(r, {c: 9 for c in r.columns if c != "n"})


@query(
    "eval_unsupported_numbers",
    r"""WITH p AS (SELECT o_orderkey, 'Order of ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || ' dollars is up ' || CAST(o_custkey % 50 AS VARCHAR) || '% over -' || CAST(o_orderkey % 9 AS VARCHAR) || ' lots' AS prose,
  'total=' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' lift=' || CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 50 + 1 ELSE o_custkey % 50 END AS VARCHAR) || '%' AS facts FROM orders),
t AS (SELECT o_orderkey, list_transform(regexp_extract_all(prose, '[-+]?\d[\d,]*\.?\d*%?'), lambda x: replace(rtrim(x, '%'), ',', '')) AS a, list_transform(regexp_extract_all(facts, '[-+]?\d[\d,]*\.?\d*%?'), lambda x: replace(rtrim(x, '%'), ',', '')) AS b FROM p),
u AS (SELECT o_orderkey, list_filter(a, lambda x: x <> '' AND x NOT IN ('-', '+') AND NOT list_contains(b, x)) AS u FROM t)
SELECT o_orderkey, array_to_string(u, ' ') AS unsupported, CAST(len(u) AS INTEGER) AS n_unsupported FROM u""",
)
def unsupported_numbers(spark, sf_dir):
    total = F.floor("o_totalprice").cast("bigint")
    lift = F.col("o_custkey") % 50
    rows = tb.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("Order of "), F.format_number(total, 0), F.lit(" dollars is up "), lift.cast("string"), F.lit("% over -"), (F.col("o_orderkey") % 9).cast("string"), F.lit(" lots")).alias("prose"),
        F.concat(F.lit("total="), total.cast("string"), F.lit(" lift="), F.when(F.col("o_orderkey") % 4 == 0, lift + 1).otherwise(lift).cast("string"), F.lit("%")).alias("facts"),
    )
    return evaluate.unsupported_numbers(rows, "prose", "facts").select("o_orderkey", "unsupported", "n_unsupported")


@query(
    "eval_explanation_summary",
    """WITH s AS (SELECT 1 + l_orderkey % 5 AS g, 1 + l_partkey % 5 AS c, 1 + l_suppkey % 5 AS d, 1 + l_linenumber % 5 AS k, CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END AS u FROM lineitem)
SELECT count(*) AS n, round(avg(g), 9) AS avg_groundedness, round(avg(c), 9) AS avg_completeness, round(avg(d), 9) AS avg_decision_consistency, round(avg(k), 9) AS avg_clarity, round(avg(u), 9) AS unsupported_claim_rate FROM s""",
)
def explanation(spark, sf_dir):
    s = tb.table(spark, sf_dir, "lineitem").select(
        (1 + F.col("l_orderkey") % 5).alias("groundedness"), (1 + F.col("l_partkey") % 5).alias("completeness"), (1 + F.col("l_suppkey") % 5).alias("decision_consistency"),
        (1 + F.col("l_linenumber") % 5).alias("clarity"), (F.col("l_discount") > 0.08).cast("int").alias("n_unsupported"),
    )
    r = evaluate.explanation_summary(s)
    return _r(r, {c: 9 for c in r.columns if c != "n"})


@query(
    "eval_judge_agreement",
    """WITH s AS (SELECT l_partkey AS case_id, 1 + CAST(l_quantity AS BIGINT) % 5 AS s FROM lineitem), c AS (SELECT case_id, s, count(*) AS c FROM s GROUP BY 1, 2)
SELECT case_id, CAST(sum(c) AS BIGINT) AS n_runs, round(sum(s * c) / sum(c)::DOUBLE, 6) AS mean_score, round(sqrt(greatest(sum(s * s * c) / sum(c)::DOUBLE - pow(sum(s * c) / sum(c)::DOUBLE, 2), 0)), 6) AS sd_score,
 CAST(arg_min(s, -c * 100 + s) AS BIGINT) AS modal_score, round(max(c) / sum(c)::DOUBLE, 6) AS agreement_rate FROM c GROUP BY 1""",
)
def judge_agreement(spark, sf_dir):
    s = tb.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("case_id"), (1 + F.col("l_quantity").cast("bigint") % 5).alias("score"))
    return _r(evaluate.repeat_agreement(s, "case_id", "score"), {"mean_score": 6, "sd_score": 6, "agreement_rate": 6})


@query(
    "eval_order_swap",
    """WITH v AS (SELECT o_orderkey AS case_id, (['A', 'B', 'TIE'])[o_custkey % 3 + 1] AS o, (['B', 'A', 'TIE'])[o_custkey % 4 % 3 + 1] AS s FROM orders)
SELECT case_id, o AS original_verdict, s AS swapped_verdict, o = CASE s WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE 'TIE' END AS consistent FROM v""",
)
def order_swap(spark, sf_dir):
    k = F.col("o_custkey")
    first = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("TIE")), (k % 3 + 1).cast("int"))
    second = F.element_at(F.array(F.lit("B"), F.lit("A"), F.lit("TIE")), (k % 4 % 3 + 1).cast("int"))
    pair = F.array(
        F.struct(F.lit("original").alias("presentation"), first.alias("verdict")), F.struct(F.lit("swapped").alias("presentation"), second.alias("verdict"))
    )
    v = tb.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.explode(pair).alias("p")).select("case_id", "p.*")
    return evaluate.order_swap(v, "case_id")


NAMES = list(fixed.TRAJECTORIES)


def _steps(spark, sf_dir):
    """Every order is a run of one scenario; some runs lose, repeat or add a step."""
    k = F.col("o_orderkey")
    scenario = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("o_custkey") % len(NAMES) + 1).cast("int"))
    plan = F.create_map(*[x for n, s in fixed.TRAJECTORIES.items() for x in (F.lit(n), F.array(*[F.lit(t) for t in s]))])
    steps = plan[scenario]
    seen = (
        F.when(k % 10 == 1, F.filter(steps, lambda s: s != "planner"))
        .when(k % 10 == 2, F.concat(steps, F.array(F.lit("chat"))))
        .when(k % 10 == 3, F.reverse(steps))
        .otherwise(steps)
    )
    return tb.table(spark, sf_dir, "orders").select(k.alias("run_id"), scenario.alias("scenario"), F.posexplode(seen).alias("step_no", "step")).select(
        "*", F.col("step").alias("label"), F.when((F.col("run_id") % 25 == 7) & (F.col("step_no") == 1), " ").otherwise("done").alias("detail")
    )


_PLAN_SQL = "CASE o_custkey % 5 " + " ".join(
    f"WHEN {i} THEN [" + ", ".join(f"'{s}'" for s in steps) + "]" for i, steps in enumerate(fixed.TRAJECTORIES.values())
) + " END"
TRACES = f"""WITH p AS (SELECT o_orderkey AS run_id, (['{"', '".join(NAMES)}'])[o_custkey % 5 + 1] AS scenario, {_PLAN_SQL} AS e FROM orders),
a AS (SELECT *, CASE run_id % 10 WHEN 1 THEN list_filter(e, lambda s: s <> 'planner') WHEN 2 THEN list_append(e, 'chat') WHEN 3 THEN list_reverse(e) ELSE e END AS a FROM p),
tc AS (SELECT run_id, scenario, a = e AS correct_sequence, array_to_string(list_filter(a, lambda s: NOT list_contains(e, s)), ',') AS unnecessary_steps, array_to_string(list_filter(e, lambda s: NOT list_contains(a, s)), ',') AS missing_steps,
  a[-1] = 'decision' AS reached_terminal, run_id % 25 <> 7 AS labels_ok FROM a)"""


@query("eval_trace_checks", TRACES + " SELECT * FROM tc")
def trace_checks(spark, sf_dir):
    return evaluate.trace_checks(_steps(spark, sf_dir), ["run_id"]).select(
        "run_id", "scenario", "correct_sequence", "unnecessary_steps", "missing_steps", "reached_terminal", "labels_ok"
    )


@query(
    "eval_trace_summary",
    TRACES
    + """ SELECT count(*) AS n_traces, round(avg(CASE WHEN correct_sequence THEN 1.0::DOUBLE ELSE 0 END), 9) AS correct_rate, round(avg(CASE WHEN unnecessary_steps <> '' THEN 1.0::DOUBLE ELSE 0 END), 9) AS unnecessary_rate,
 round(avg(CASE WHEN reached_terminal THEN 1.0::DOUBLE ELSE 0 END), 9) AS completion_rate, round(avg(CASE WHEN labels_ok THEN 1.0::DOUBLE ELSE 0 END), 9) AS labels_ok_rate FROM tc""",
)
def trace_summary(spark, sf_dir):
    r = evaluate.trace_summary(evaluate.trace_checks(_steps(spark, sf_dir), ["run_id"]))
    return _r(r, {c: 9 for c in r.columns if c != "n_traces"})
