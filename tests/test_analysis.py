"""Units to decisions for experiments of different shapes: one decision each."""

import random

import pytest

from liftlake.plans.analysis import analyze

SHAPES = {
    "even3": {"control": (1000, 0.0), "b": (1000, 0.0), "c": (1000, 0.0)},
    "skew3": {"control": (500, 0.0), "b": (250, 0.5), "c": (250, 0.4)},
    "won3": {"control": (300, 0.0), "b": (300, 0.0), "c": (300, 3.0)},
    "small": {"control": (20, 0.0), "b": (20, 5.0)},
    "spread": {"control": (20, 0.0), "b": (20, 5.0)},
    "outlier": {"control": (200, 0.0), "b": (200, 0.0)},
    "holdout": {"holdout": (200, 0.0), "b": (200, 3.0)},
}


@pytest.fixture(scope="module")
def result(spark):
    draw, rows = random.Random(5), []
    for name, arms in SHAPES.items():
        for arm, (n, shift) in arms.items():
            for i in range(n):
                noise = draw.randint(0, 1) + draw.random() / 100 if name == "spread" else draw.random()
                rows.append((name, arm, 1e7 if name == "outlier" and arm == "b" and i == 0 else 10 + shift + noise))
    rows.append(("even3", None, 1.0))
    df = spark.createDataFrame(rows, "e string, arm string, v double")
    none = spark.createDataFrame([], "e string, metric string, higher_is_better boolean")
    expected = spark.createDataFrame([(k, None) for k in SHAPES], "e string, expected_effect double")
    run = analyze(df, ["e"], "arm", "v", none, expected)
    return {"decisions": run.decisions.collect(), "effects": run.effects.collect(), "validity": {r.e: r.validity for r in run.validity.collect()}}


def test_one_decision_for_every_experiment(result):
    assert sorted(r.e for r in result["decisions"]) == sorted(SHAPES)


def test_ratio_check_looks_at_all_arms(result):
    assert result["validity"]["even3"] != "INVALID"
    assert result["validity"]["skew3"] == "INVALID"


def test_one_critical_outlier_blocks(result):
    assert result["validity"]["outlier"] == "INVALID"


def test_small_arms_are_tested(result):
    kinds = {r.e: (r.test_type, r.p_value) for r in result["effects"] if r.e in ("small", "spread")}
    assert all(p < 0.001 for _, p in kinds.values())
    assert kinds["spread"][0] == "mann_whitney_u"


def test_winner_and_reference_arm(result):
    rows = {r.e: r for r in result["decisions"]}
    assert rows["won3"].significant and rows["won3"].effect_abs > 2.5
    assert rows["holdout"].significant and rows["holdout"].effect_abs > 2.5
    assert not rows["even3"].significant
