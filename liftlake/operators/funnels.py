"""Strict funnels over event logs, and stage summaries over unit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from liftlake.functions import fixed
from liftlake.operators import effects, ranks


def step_order(events: DataFrame, keys: list[str], event: str, timestamp: str) -> DataFrame:
    """Events ordered by median timestamp, event name as tie-break.

    An event type may hold most of the log and almost only distinct timestamps,
    so the median is an exact distributed order statistic. Interpolated medians
    are whole microseconds, rounded down.
    """
    micros = events.select(*keys, F.col(event).alias("event"), F.unix_micros(F.col(timestamp).cast("timestamp")).alias("us"))
    groups = [*keys, "event"]
    # counted over integers: microseconds since 1970 are exact in a double until 2255
    medians = ranks.exact_quantiles(
        micros.filter(F.col("event").isNotNull() & F.col("us").isNotNull()).select(*groups, F.col("us").cast("double").alias("value")),
        groups,
        {"median_us": 0.5},
    )
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy("median_us", "event")
    return medians.select(*groups, F.floor("median_us").cast("long").alias("median_us")).withColumn(
        "position", F.row_number().over(w)
    )


def user_steps(
    events: DataFrame, keys: list[str], user: str, event: str, steps: list[str], group: str | None = None, order_col: str | None = None
) -> DataFrame:
    """One row per user: the number of leading steps the user has done.

    A user reaches step k only with every earlier step done too (sets, not time
    order). One map-side-combined aggregate; a user with very many events
    shrinks to one partial row per task. With ``order_col`` the user's group is
    the one on the first row; otherwise groups are counted apart.
    """
    if len(steps) < 2:
        raise ValueError("a funnel needs at least two steps")
    done = [F.bool_or(F.col(event) == s).alias(f"__s{i}") for i, s in enumerate(steps)]
    ids = [*keys, *([group] if group and not order_col else []), user]
    extra = [F.min(F.struct(order_col, group))[group].alias(group)] if group and order_col else []
    per_user = events.filter(F.col(user).isNotNull()).groupBy(*ids).agg(*done, *extra)
    reached: Column = F.lit(0)
    prefix = F.lit(True)
    for i in range(len(steps)):
        prefix = prefix & F.coalesce(F.col(f"__s{i}"), F.lit(False))
        reached = reached + F.when(prefix, 1).otherwise(0)
    names = [*keys, *([group] if group else []), user]
    return per_user.select(*names, reached.alias("reached"))


def funnel_steps(per_user: DataFrame, keys: list[str], steps: list[str]) -> DataFrame:
    """Users per step with conversion from the start and from the previous step.

    A group whose first step is empty keeps its rows and is flagged.
    """
    counts = per_user.groupBy(*keys).agg(*[F.count_if(F.col("reached") > i).alias(f"__n{i}") for i in range(len(steps))])
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step_no"),
                F.lit(s).alias("step"),
                F.col(f"__n{i}").alias("users"),
                (F.col("__n0") if i == 0 else F.col(f"__n{i - 1}")).alias("previous"),
                F.col("__n0").alias("start"),
            )
            for i, s in enumerate(steps)
        ]
    )
    r = counts.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    return r.select(
        *keys,
        "step_no",
        "step",
        "users",
        F.when(F.col("start") > 0, F.col("users") / F.col("start")).alias("from_start"),
        F.when(F.col("step_no") == 1, F.when(F.col("start") > 0, 1.0))
        .when(F.col("previous") > 0, F.col("users") / F.col("previous"))
        .when(F.col("start") > 0, 0.0)
        .alias("from_previous"),
        (F.col("start") == 0).alias("empty_start"),
    )


def funnel_summary(step_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Overall conversion and the worst drop (the first one on ties)."""
    prev = F.lag("step").over(W.partitionBy(*keys).orderBy("step_no")) if keys else F.lag("step").over(
        W.partitionBy(F.lit(1)).orderBy("step_no")
    )
    staged = step_rows.filter(~F.col("empty_start")).withColumn("__prev", prev)
    later = F.col("step_no") > 1
    worst = F.min(F.when(later, F.struct("from_previous", "step_no", F.col("__prev").alias("a"), F.col("step").alias("b"))))
    return (
        staged.groupBy(*keys)
        .agg(F.max(F.struct("step_no", "from_start"))["from_start"].alias("overall_conversion"), worst.alias("w"))
        .select(
            *keys,
            "overall_conversion",
            F.col("w.a").alias("drop_from"),
            F.col("w.b").alias("drop_to"),
            (1.0 - F.col("w.from_previous")).alias("drop_rate"),
        )
    )


def conversions(per_user: DataFrame, n_steps: int) -> DataFrame:
    """Every user seen, converted when the whole funnel was done."""
    return per_user.withColumn("converted", (F.col("reached") >= n_steps).cast("int")).drop("reached")


def compare_drops(summary: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Of two groups, which loses fewer users at its worst step. Other group counts give no row."""
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    two = summary.withColumn("__n", F.count(F.lit(1)).over(w)).filter(F.col("__n") == 2)
    best = F.min(F.struct("drop_rate", F.col(group).alias("g"), "drop_from", "drop_to"))
    worst = F.max(F.struct("drop_rate", F.col(group).alias("g"), "drop_from", "drop_to"))
    return two.groupBy(*keys).agg(best.alias("b"), worst.alias("w")).select(
        *keys,
        F.col("b.g").alias("better_group"),
        F.col("w.g").alias("worse_group"),
        F.col("b.drop_rate").alias("better_rate"),
        F.col("w.drop_rate").alias("worse_rate"),
        (F.col("b.drop_rate") < F.col("w.drop_rate")).alias("differs"),
    )


# --- unit tables whose columns are funnel stages ------------------------------
def stage_summary(
    units: DataFrame, keys: list[str], arm: str, stages: list[str], control: str | None = None, alpha: float = fixed.ALPHA
) -> DataFrame:
    """Every stage metric, every arm against the control; no omnibus gate, no adjustment."""
    order = F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i + 1))])
    return effects.compare_arms(units, keys, arm, stages, control, alpha).withColumn("stage_no", order[F.col("metric")])


def stage_bridge(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Does an arm's effect carry from each stage to the next?"""
    w = W.partitionBy(*keys, "arm").orderBy("stage_no")
    staged = summary.withColumn("next_metric", F.lead("metric").over(w)).withColumn(
        "next_significant", F.lead("significant").over(w)
    )
    a, b = F.col("significant"), F.col("next_significant")
    return (
        staged.filter(F.col("next_metric").isNotNull())
        .withColumn(
            "bridge",
            F.when(a & b, "carried_through").when(a & ~b, "did_not_carry").when(~a & b, "later_only"),
        )
        .filter(F.col("bridge").isNotNull())
        .select(*keys, "arm", F.col("metric").alias("stage"), F.col("next_metric").alias("next_stage"), "bridge")
    )
