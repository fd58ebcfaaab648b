"""Units, validity, tests, power, adjustment and resampling on small exact frames."""

import random

import pytest
from pyspark.sql import functions as F

from liftlake import session
from liftlake.functions import small_samples
from liftlake.operators import effects, power, quality, ranks, resampling, strata, units, variance

KEY = ["e"]


def binary_rows(spark, counts, extra=""):
    """counts: arm -> (n, successes)."""
    parts = [
        spark.range(n).select(F.lit("x").alias("e"), F.lit(arm).alias("arm"), (F.col("id") < s).cast("int").alias("y"), (F.col("id") + 1000000 * i).alias("u"))
        for i, (arm, (n, s)) in enumerate(counts.items())
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def test_two_arm_ratio_check(spark):
    rows = spark.createDataFrame([("bad", 568, 412), ("ok", 6212, 6188)], "e string, n_control long, n_treated long")
    got = {r["e"]: r for r in quality.with_two_arm_srm(rows, "n_control", "n_treated").collect()}
    assert got["bad"]["p_value"] < 0.001 and not got["bad"]["passed"]
    assert got["ok"]["passed"]


def test_many_arm_ratio_check(spark):
    even = {chr(97 + i): (n, 0) for i, n in enumerate([3334, 3333, 3333, 3333, 3333, 3334])}
    skewed = {chr(97 + i): (n, 0) for i, n in enumerate([100, 3980, 3980, 3980, 3980, 3980])}
    assert quality.srm_multi_arm(binary_rows(spark, even), KEY, "arm").first()["passed"]
    assert not quality.srm_multi_arm(binary_rows(spark, skewed), KEY, "arm").first()["passed"]


def test_test_choice(spark):
    big = effects.compare_arms(binary_rows(spark, {"control": (11900, 500), "b": (11900, 560)}), KEY, "arm", ["y"]).first()
    assert big["test_type"] == "chi_square"
    small = effects.compare_arms(binary_rows(spark, {"control": (22, 2), "b": (21, 1)}), KEY, "arm", ["y"]).first()
    assert small["test_type"] == "fishers_exact"
    assert small["p_value"] == pytest.approx(1.0)


def test_fisher_reference_table(spark):
    # tea tasting: 3 of 4 against 1 of 4
    row = effects.compare_arms(binary_rows(spark, {"control": (4, 1), "b": (4, 3)}), KEY, "arm", ["y"]).first()
    assert row["p_value"] == pytest.approx(34 / 70)


def test_zero_variance_and_empty_arms_do_not_fail(spark):
    rows = spark.createDataFrame([("x", "control", 5.0)] * 40 + [("x", "b", 5.0)] * 40, "e string, arm string, v double")
    row = effects.compare_arms(rows, KEY, "arm", ["v"]).first()
    assert row["p_value"] is None and row["effect_abs"] == 0.0
    one = rows.filter(F.col("arm") == "b")
    assert effects.compare_arms(one, KEY, "arm", ["v"], "control").count() == 0


def test_omnibus_gate_holm_and_winner(spark):
    m = effects.arm_moments(binary_rows(spark, {"control": (1000, 100), "a": (1000, 120), "b": (1000, 300)}), KEY, "arm", ["y"])
    om = effects.omnibus(m, KEY)
    pairs = effects.run_tests(effects.choose_test(effects.pair_with_control(m, KEY)), KEY)
    out = {r["arm"]: r for r in effects.mark_winner(effects.gated_pairs(pairs, om, KEY), KEY).collect()}
    assert out["b"]["is_winner"] and not out["a"]["is_winner"]
    assert all(r["adj_p"] >= r["p_value"] for r in out.values())
    assert out["b"]["adj_p"] == pytest.approx(2 * out["b"]["p_value"])
    null = effects.arm_moments(binary_rows(spark, {"control": (1000, 100), "a": (1000, 101), "b": (1000, 99)}), KEY, "arm", ["y"])
    assert effects.gated_pairs(
        effects.run_tests(effects.choose_test(effects.pair_with_control(null, KEY)), KEY), effects.omnibus(null, KEY), KEY
    ).count() == 0


def test_control_label_rules(spark):
    rows = [("a", "Mens E-Mail"), ("a", "No E-Mail"), ("a", "Womens E-Mail"), ("b", "B"), ("b", "A"), ("c", "Variant"), ("c", " CONTROL ")]
    got = {r["e"]: r["control_arm"] for r in units.control_arm(spark.createDataFrame(rows, "e string, arm string"), KEY, "arm").collect()}
    assert got == {"a": "No E-Mail", "b": "A", "c": " CONTROL "}


def test_assignment_merge(spark):
    left = spark.createDataFrame([("1", 5.0), ("1", 6.0), ("3", 7.0)], "user_id string, order_value double")
    right = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], "customer_id string, variant string, extra string")
    out = units.merge_assignment(left, right, "user_id", "customer_id", "variant")
    assert out.columns == ["user_id", "order_value", "variant"]
    assert sorted((r["user_id"], r["variant"]) for r in out.collect()) == [("1", "a"), ("1", "a"), ("3", None)]
    twice = right.unionByName(right.limit(1))
    with pytest.raises(Exception, match="duplicate assignment"):
        units.merge_assignment(left, twice, "user_id", "customer_id", "variant").collect()
    with pytest.raises(ValueError):
        units.merge_assignment(left.withColumn("variant", F.lit("q")), right, "user_id", "customer_id", "variant")


def test_duplicate_severity(spark):
    rows = [
        ("same", "u1", "a", 1.0), ("same", "u1", "a", 1.0), ("same", "u2", "b", 0.0),
        ("cross", "u1", "a", 1.0), ("cross", "u1", "b", 1.0), ("metric", "u1", "a", 1.0), ("metric", "u1", "a", 0.0),
    ]
    d = units.duplicate_analysis(spark.createDataFrame(rows, "e string, u string, arm string, v double"), KEY, "u", "arm", "v")
    got = {r["e"]: (r["duplicate_rows"], r["conflicting_arm_units"], r["conflicting_metric_units"]) for r in d.collect()}
    assert got == {"same": (1, 0, 0), "cross": (1, 1, 0), "metric": (1, 0, 1)}
    q = {(r["e"], r["label"]): r["critical"] for r in units.integrity_rows(d, KEY).collect() if not r["passed"]}
    assert q == {("cross", "arm_conflict"): False, ("metric", "metric_conflict"): True}


def test_rank_buckets_do_not_change_results(spark):
    rng = random.Random(7)
    data = [("hot", "control" if i % 2 else "t", float(rng.randrange(400))) for i in range(4000)] + [("cold", "t" if i % 3 else "control", rng.random()) for i in range(30)]
    long = spark.createDataFrame(data, "e string, arm string, value double").repartition(7)
    whole = {tuple(r) for r in ranks.arm_ranks(long, KEY).collect()}
    cut = {tuple(r) for r in ranks.arm_ranks(long, KEY, parts=13).collect()}
    assert whole == cut
    mw = {r["e"]: r for r in ranks.mann_whitney(ranks.arm_ranks(long, KEY, parts=13), KEY, F.lit("control")).collect()}
    flip = {r["e"]: r for r in ranks.mann_whitney(ranks.arm_ranks(long, KEY), KEY, F.lit("t")).collect()}
    for e in ("hot", "cold"):
        assert mw[e]["u_statistic"] + flip[e]["u_statistic"] == mw[e]["n_control"] * mw[e]["n_treated"]
        assert mw[e]["p_value"] == pytest.approx(flip[e]["p_value"])
    q = ranks.exact_quantiles(spark.createDataFrame([("x", v) for v in (1.0, 2.0, 4.0, 8.0)], "e string, value double"), KEY, {"q": 0.25}, parts=2)
    assert q.first()["q"] == 1.75


def test_exact_rank_distribution():
    assert small_samples.mann_whitney_exact(3, 3, 9) == pytest.approx(0.1)
    assert small_samples.mann_whitney_exact(5, 5, 23) == pytest.approx(0.031746, rel=1e-4)
    assert small_samples.mann_whitney_exact(8, 500, 2000) == pytest.approx(1.0)


def test_shapiro_published_example():
    w, p = small_samples.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.7888, abs=1e-4) and p == pytest.approx(0.0067, abs=1e-4)


def test_outlier_rules(spark):
    flat = [("flat", "a", 0.0)] * 96 + [("flat", "a", 1.0)] * 4  # median spread 0: nothing has a basis
    wild = [("wild", "a", float(i % 10)) for i in range(100)] + [("wild", "a", 5000.0)]
    few = [("few", "a", 1.0), ("few", "a", 900.0)]
    long = spark.createDataFrame(flat + wild + few, "e string, arm string, value double").withColumn("metric_type", F.lit("continuous_general"))
    got = {r["e"]: (r["n_outliers"], r["critical"]) for r in quality.outlier_facts(long, KEY, parts=5).collect()}
    assert got == {"flat": (0, False), "wild": (1, True), "few": (0, False)}
    money = spark.createDataFrame([("m", "a", 0.0)] * 50 + [("m", "a", 40.0 + i) for i in range(50)] + [("m", "a", 1e6)], "e string, arm string, value double")
    r = quality.outlier_facts(money.withColumn("metric_type", F.lit("continuous_monetary")), KEY).first()
    assert (r["n_zero"], r["n_used"], r["n_outliers"], r["critical"]) == (50, 51, 1, True)


def test_power_anchor(spark):
    row = spark.createDataFrame([(145292, 145292, 0.1204, 0.1189)], "n_c long, n_t long, mean_c double, mean_t double")
    out = power.binary_power(row).first()
    assert out["achieved_power"] == pytest.approx(0.2383, abs=5e-4)
    assert out["mde_rel"] == pytest.approx(2.8265, abs=2e-3)
    assert out["required_n"] == pytest.approx(734459, rel=2e-3)


def test_t_power_table():
    import numpy as np

    one = np.array([64.0])
    assert small_samples.t_power(np.array([0.5]), one, one, 0.05)[0] == pytest.approx(0.8015, abs=1e-4)
    assert small_samples.t_required_n(np.array([0.5]), np.array([1.0]), 0.05, 0.8)[0] == pytest.approx(63.766, abs=1e-3)
    assert small_samples.t_minimum_effect(one, one, 0.05, 0.8)[0] == pytest.approx(0.4991, abs=1e-4)


def test_adjustment_keeps_the_pooled_mean_and_matches_rows(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        x = rng.gauss(50, 10)
        rows.append(("x", f"u{i}", "control" if i % 2 else "t", 0.9 * x + rng.gauss(0, 4) + (1 if i % 2 else 0), x if i % 11 else None))
    df = spark.createDataFrame(rows, "e string, u string, arm string, y double, x double")
    m = variance.adjusted_moments(df, KEY, "arm", "y", "x")
    t = variance.theta(df, KEY, "arm", "y", "x")
    by_row = variance.adjust_units(df, KEY, "y", "x", t).groupBy("arm").agg(F.avg("adjusted").alias("m"), F.var_samp("adjusted").alias("v"))
    want = {r["arm"]: r for r in by_row.collect()}
    got = {r["arm"]: r for r in m.collect()}
    for arm in want:
        assert got[arm]["mean"] == pytest.approx(want[arm]["m"]) and got[arm]["var"] == pytest.approx(want[arm]["v"])
    pooled = sum(r["mean"] * r["n"] for r in got.values()) / sum(r["n"] for r in got.values())
    assert pooled == pytest.approx(df.agg(F.avg("y")).first()[0])
    report = variance.variance_report(m, KEY).first()
    assert report["reduction_pct"] > 50
    short = variance.theta(df.limit(8), KEY, "arm", "y", "x").first()
    assert short["skip_reason"] == "insufficient_data"


def test_mean_bootstrap_is_partition_invariant_and_covers(spark):
    rng = random.Random(5)
    rows = [("x", f"u{i}", "control" if i % 2 else "t", rng.gauss(10 + (i % 2 == 0), 2)) for i in range(2000)]
    df = spark.createDataFrame(rows, "e string, u string, arm string, value double")
    a = resampling.mean_bootstrap(df.repartition(1), KEY, "u", "arm", "control", draws=400).first()
    b = resampling.mean_bootstrap(df.repartition(9), KEY, "u", "arm", "control", draws=400).first()
    assert (a["ci_lower"], a["ci_upper"]) == pytest.approx((b["ci_lower"], b["ci_upper"]))
    se = 2 * (2 / 1000) ** 0.5
    assert a["ci_upper"] - a["ci_lower"] == pytest.approx(2 * 1.96 * se, rel=0.15)
    assert a["ci_lower"] < 1.0 < a["ci_upper"] + 0.1


def test_median_bootstrap_matches_plain_resampling(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    c, t = rng.exponential(1.0, 301), rng.exponential(1.3, 400)
    rows = [("x", "control", float(v)) for v in c] + [("x", "t", float(v)) for v in t]
    got = resampling.median_bootstrap(spark.createDataFrame(rows, "e string, arm string, value double"), KEY, "arm", "control").first()
    plain = np.median(rng.choice(t, (4000, 400)), axis=1) - np.median(rng.choice(c, (4000, 301)), axis=1)
    lo, hi = np.percentile(plain, [2.5, 97.5])
    assert got["ci_lower"] == pytest.approx(lo, abs=0.05) and got["ci_upper"] == pytest.approx(hi, abs=0.05)


def test_strata(spark):
    rows = [("x", "control" if i % 2 else "t", "s1" if i < 100 else "s2", float(i % 2 == 0 and i % 4 == 0)) for i in range(200)]
    df = units.split_arms(spark.createDataFrame(rows, "e string, arm string, s string, y double"), "arm", "control")
    e = strata.stratum_effects(strata.strata(df, KEY, "s", "y"), "binary")
    combined = strata.combine_strata(e, KEY)
    effects_ = [r["effect"] for r in e.collect()]
    assert combined.count() in (0, 1)  # a zero-variance control arm leaves only the treated variance
    for r in combined.collect():
        assert min(effects_) <= r["effect"] <= max(effects_)
    same = strata.eligibility(strata.strata(df.withColumn("page", F.col("arm")), KEY, "page", "y"), KEY, "page", ["page"], "arm").first()
    assert same["reason"] == "perfectly_associated_with_assignment"
    assert strata.eligibility(strata.strata(df, KEY, "s", "y"), KEY, "s", ["other"], "arm").first()["reason"] == "column_not_found"


def test_exact_rank_distribution_of_a_lopsided_pair():
    import tracemalloc
    from itertools import combinations

    for n1, n2 in ((2, 5), (3, 4), (4, 6)):
        sums = [sum(c) - n1 * (n1 - 1) // 2 for c in combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            want = min(1.0, 2 * min(sum(s <= u for s in sums), sum(s >= u for s in sums)) / len(sums))
            assert small_samples.mann_whitney_exact(n1, n2, u) == pytest.approx(want)
            assert small_samples.mann_whitney_exact(n2, n1, u) == pytest.approx(want)
    tracemalloc.start()
    p = small_samples.mann_whitney_exact(8, 1_000_000, 3_000_000.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the limit for a large second arm: eight uniforms sum to at most 3 with probability 4541 / 8!
    assert peak < 100e6 and p == pytest.approx(2 * 4541 / 40320, abs=1e-5)


def test_quantiles_survive_a_poor_sketch(spark, monkeypatch):
    import numpy as np

    rng = random.Random(3)
    data = [("hot", rng.gauss(0, 1)) for _ in range(30_000)] + [("tied", 5.0) for _ in range(3000)] + [("tied", float(i % 3)) for i in range(90)] + [("few", 1.0), ("few", 4.0), ("none", None), ("none", float("nan"))]
    long = spark.createDataFrame(data, "e string, value double").repartition(6)
    want = {e: np.percentile([v for g, v in data if g == e], [1, 50, 75]) for e in ("hot", "tied", "few")}
    for k, margin in ((4096, 0.006), (16, 0.0)):
        monkeypatch.setattr(ranks, "SKETCH_K", k)
        monkeypatch.setattr(ranks, "MARGIN", margin)
        got = {r["e"]: [r["a"], r["b"], r["c"]] for r in ranks.exact_quantiles(long, KEY, {"a": 0.01, "b": 0.5, "c": 0.75}, parts=5).collect()}
        assert set(got) == set(want)
        for e in want:
            assert got[e] == pytest.approx(list(want[e]))


def test_ranks_of_arms_by_plain_counting(spark):
    from collections import Counter

    rng = random.Random(11)
    data = [("hot", rng.choice("abc"), float(rng.randrange(50))) for _ in range(3000)] + [("cold", "a", 1.0), ("cold", "b", 1.0), ("cold", "b", 0.5)]
    got = {(r["e"], r["arm"]): (r["n"], r["rank_sum"]) for r in ranks.arm_ranks(spark.createDataFrame(data, "e string, arm string, value double"), KEY, parts=9).collect()}
    for e in ("hot", "cold"):
        values = Counter(v for g, _, v in data if g == e)
        rank, below = {}, 0
        for v in sorted(values):
            rank[v], below = below + (values[v] + 1) / 2, below + values[v]
        for arm in {a for g, a, _ in data if g == e}:
            mine = [rank[v] for g, a, v in data if g == e and a == arm]
            assert got[e, arm] == (len(mine), pytest.approx(sum(mine)))


@pytest.mark.parametrize("draws, bags", [(4000, 1), (300, 10)])
def test_mean_bootstrap_width_is_the_analytic_one(spark, draws, bags):
    rng = random.Random(8)
    rows = [("x", f"u{i}", "control" if i % 3 else "t", rng.gauss(5, 1 + (i % 3 == 0))) for i in range(9000)]
    got = resampling.mean_bootstrap(spark.createDataFrame(rows, "e string, u string, arm string, value double").repartition(5), KEY, "u", "arm", "control", draws=draws, bags=bags).first()
    width = 2 * 1.959964 * (4 / 3000 + 1 / 6000) ** 0.5
    assert got["ci_upper"] - got["ci_lower"] == pytest.approx(width, rel=0.05)
    assert got["replicates"] == draws * bags


def test_median_bootstrap_survives_a_poor_sketch(spark, monkeypatch):
    rng = random.Random(2)
    rows = [("x", "control" if i % 2 else "t", rng.gauss(0, 1) + (i % 2)) for i in range(40_000)]
    df = spark.createDataFrame(rows, "e string, arm string, value double")
    good = resampling.median_bootstrap(df, KEY, "arm", "control", parts=3).first()
    monkeypatch.setattr(ranks, "SKETCH_K", 16)
    monkeypatch.setattr(ranks, "MARGIN", -0.0299)
    poor = resampling.median_bootstrap(df, KEY, "arm", "control", parts=3).first()
    assert tuple(poor) == tuple(good)
    # the analytic sd of a normal median is sqrt(pi / 2 / n)
    assert good["ci_upper"] - good["ci_lower"] == pytest.approx(2 * 1.96 * (2 * 1.5708 / 20_000) ** 0.5, rel=0.1)


def test_many_positions_are_no_broadcast(spark, monkeypatch):
    """A written table of many rows is small on disk; its joins must not gather it, and give the same rows."""
    rows = [(e, arm, float((e * 7 + i * i) % 13)) for e in range(40) for arm in ("control", "treatment") for i in range(12)]
    long = spark.createDataFrame(rows, "e int, arm string, value double")
    results = []
    for few in (10**9, 100):
        monkeypatch.setattr(session, "FEW_ROWS", few)
        ranked = ranks.ranked_counts(ranks.value_counts(long, ["e"], by="arm"), ["e", "arm"])
        found = resampling.median_bootstrap_of_ranked(ranked, ["e"], "arm", "control", draws=200)
        results.append(sorted(map(tuple, found.collect())))
        plan = found._jdf.queryExecution().executedPlan().toString()
    assert results[0] == results[1] and len(results[0]) == 40
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
