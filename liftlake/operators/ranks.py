"""Distributed order statistics: exact quantiles, mid-ranks and rank tests.

One group may hold a large share of all rows, so no group is ever sorted in one task.

Ranks: values collapse to (group, value) counts, which are range-partitioned by (group, value). Each task
adds up its sorted range once, and the totals of the ranges, one row per task and group, shift it by what lies before.

Quantiles: a mergeable sketch per group brackets each one; rows outside all brackets collapse to
one count per gap, so a second pass shuffles only the few per cent of values inside. These are ranked as above, so
the result is exact. A group whose sketch was further off than ``MARGIN`` (a position falls into a gap) is ranked in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from liftlake.functions import tails
from liftlake.functions.arith import ratio
from liftlake.session import hinted, materialize

#: Size of the sketches; their rank error is about 0.13 per cent.
SKETCH_K = 4096
#: Ranks on either side of a quantile that its bracket holds, as a share of the group.
MARGIN = 0.006


def value_counts(long: DataFrame, keys: list[str], value: str = "value", by: str | None = None) -> DataFrame:
    """Counts per distinct non-missing value (and per ``by``, e.g. the arm)."""
    held = long.filter(F.col(value).isNotNull() & ~F.isnan(value))
    names = [*keys, *([by] if by else [])]
    return held.groupBy(*names, F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("cnt"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group and value; ``__group`` and ``__value`` are hashes of both."""
    part = TaskContext.get().partitionId()
    group, total, held = None, 0, None

    def add(rows: pa.Table, first: np.ndarray) -> pa.Table:
        """``first``: where a new (group, value) begins."""
        nonlocal group, total
        counts = np.add.reduceat(rows["cnt"].to_numpy(), first)
        groups = rows["__group"].to_numpy()[first]
        before = np.cumsum(counts) - counts
        starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
        sizes = np.diff(np.append(starts, len(groups)))
        before = before - np.repeat(before[starts], sizes)
        if groups[0] == group:
            before[: sizes[0]] += total
        group, total = groups[-1], int(before[-1] + counts[-1])
        repeat = np.diff(np.append(first, rows.num_rows))
        out = rows.drop_columns(["__group", "__value"])
        for name, column in (("__below", before), ("tied", counts)):
            out = out.append_column(name, pa.array(np.repeat(column, repeat), pa.int64()))
        return out.append_column("__part", pa.array(np.full(rows.num_rows, part, np.int32)))

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        names = np.stack([rows["__group"].to_numpy(), rows["__value"].to_numpy()])
        first = np.flatnonzero(np.append(True, (names[:, 1:] != names[:, :-1]).any(0)))
        # the last value may go on in the next batch: its rows, one per arm, wait
        held = rows.slice(int(first[-1]))
        if len(first) > 1:
            yield from add(rows.slice(0, int(first[-1])), first[:-1]).to_batches()
    if held is not None:
        yield from add(held.combine_chunks(), np.zeros(1, np.int64)).to_batches()


def ranked_counts(counts: DataFrame, keys: list[str], parts: int | None = None, order: tuple[str, ...] = ("value",)) -> DataFrame:
    """Add ``before`` (rows of the group below this value), ``tied`` (rows at it) and ``n`` (rows of the group).

    ``counts`` has (keys, value) and a ``cnt``, once or several times (e.g. per arm); other columns pass through.
    ``parts`` sets the number of ranges, else the session's shuffle partitions do.
    """
    if not keys:
        raise ValueError("ranked_counts needs at least one key column")
    by = [*keys, *order]
    hashed = counts.withColumn("cnt", F.col("cnt").cast("long")).withColumn("__group", F.xxhash64(*keys)).withColumn("__value", F.xxhash64(*order))
    ranged = (hashed.repartitionByRange(parts, *by) if parts else hashed.repartitionByRange(*by)).sortWithinPartitions(*by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hashed.schema.fields if f.name not in ("__group", "__value"))
    # written at once: the ranges are drawn from a sample, so they must not be drawn again by another reader
    run = materialize(ranged.mapInArrow(_running, f"{schema}, __below long, tied long, __part int"))
    by_keys = W.partitionBy(*keys)
    # a value's rows repeat its ``tied``; the last value of a group in a part ends it
    totals = (
        run.groupBy(*keys, "__part").agg(F.max(F.col("__below") + F.col("tied")).alias("__upto"), F.min("__below").alias("__from"))
        .select(*keys, "__part", (F.col("__upto") - F.col("__from")).alias("__total"))
        .select(
            *keys,
            "__part",
            F.sum("__total").over(by_keys).alias("n"),
            (F.sum("__total").over(by_keys.orderBy("__part")) - F.col("__total")).alias("__offset"),
        )
    )
    (totals,) = hinted(run, totals)
    return run.join(totals, [*keys, "__part"]).withColumn("before", F.col("__offset") + F.col("__below")).drop("__part", "__offset", "__below")


def _at(position: Column) -> Column:
    """The group's value at a zero-based position, as a conditional maximum."""
    return F.max(F.when((F.col("before") <= position) & (position < F.col("before") + F.col("cnt")), F.col("value")))


def quantile_columns(probs: dict[str, float]) -> list[Column]:
    """Aggregates over ``ranked_counts`` for linearly interpolated quantiles."""
    out = []
    for name, p in probs.items():
        h = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.floor(h), F.ceil(h)
        out += [_at(lo).alias(f"__{name}_lo"), _at(hi).alias(f"__{name}_hi"), F.max(h - lo).alias(f"__{name}_w")]
    return out


def quantiles_of_ranked(ranked: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    held = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *quantile_columns(probs))
    return held.select(
        *keys,
        "n",
        *[
            (F.col(f"__{q}_lo") + (F.col(f"__{q}_hi") - F.col(f"__{q}_lo")) * F.col(f"__{q}_w")).alias(q)
            for q in probs
        ],
    )


def sketch(value: str = "value") -> Column:
    """An aggregate for ``brackets``; merges from task to task."""
    return F.kll_sketch_agg_double(value, F.lit(SKETCH_K))


def _edge(sketches: str, rank: float) -> Column:
    if rank <= 0 or rank >= 1:
        return F.lit(float("-inf") if rank <= 0 else float("inf"))
    return F.kll_sketch_get_quantile_double(sketches, F.lit(rank))


def brackets(facts: DataFrame, sketches: str, ranks_: list[tuple[float, float]]) -> DataFrame:
    """Replace the sketches by ``__brackets``: for each (rank, width) the values between which the rank lies."""
    spans = [F.struct(_edge(sketches, p - w).alias("low"), _edge(sketches, p + w).alias("high")) for p, w in ranks_]
    return facts.withColumn("__brackets", F.when(F.col(sketches).isNotNull(), F.array(*spans))).drop(sketches)


def bracketed_counts(long: DataFrame, facts: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Counts of values inside the group's brackets, and of the gaps between them (``gap``, at the bracket's end below)."""
    # not named like the output: inside a lambda a name may resolve to the alias beside it
    held = long.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("__raw"))
    held = held.join(facts.filter(F.col("__brackets").isNotNull()).select(*keys, "__brackets"), keys)
    inside = F.exists("__brackets", lambda b: (b["low"] <= F.col("__raw")) & (F.col("__raw") <= b["high"]))
    below = F.array_max(F.transform("__brackets", lambda b: F.when(b["high"] < F.col("__raw"), b["high"]).otherwise(float("-inf"))))
    placed = held.select(*keys, F.when(inside, F.col("__raw")).otherwise(below).alias("value"), (~inside).alias("gap"))
    return placed.groupBy(*keys, "value", "gap").agg(F.count(F.lit(1)).alias("cnt"))


def quantiles_of_rows(long: DataFrame, facts: DataFrame, keys: list[str], probs: dict[str, float], value: str = "value", parts: int | None = None) -> DataFrame:
    """Exact interpolated quantiles from rows and written ``facts`` with their ``__brackets``; written."""
    ranked = ranked_counts(bracketed_counts(long, facts, keys, value), keys, parts, ("value", "gap"))
    found = materialize(quantiles_of_ranked(ranked.withColumn("value", F.when(~F.col("gap"), F.col("value"))), keys, probs))
    lost = found.filter(" or ".join(f"`{q}` is null" for q in probs))
    if not lost.limit(1).count():
        return found
    lost = lost.select(*keys)
    full = quantiles_of_ranked(ranked_counts(value_counts(long.join(lost, keys, "left_semi"), keys, value), keys, parts), keys, probs)
    return materialize(found.join(lost, keys, "left_anti").unionByName(full))


def exact_quantiles(long: DataFrame, keys: list[str], probs: dict[str, float], value: str = "value", parts: int | None = None) -> DataFrame:
    """Exact interpolated quantiles per group, safe for one dominant group."""
    held = long.filter(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("__x", F.col(value).cast("double"))
    facts = held.groupBy(*keys).agg(sketch("__x").alias("__sketch"))
    facts = materialize(brackets(facts, "__sketch", [(p, MARGIN) for p in probs.values()]))
    return quantiles_of_rows(long, facts, keys, probs, value, parts)


def arm_ranks(long: DataFrame, keys: list[str], arm: str = "arm", parts: int | None = None) -> DataFrame:
    """Rank sums, sizes and tie terms per group and arm."""
    return arm_ranks_of_counts(value_counts(long, keys, by=arm), keys, arm, parts)


def arm_ranks_of_counts(per_arm: DataFrame, keys: list[str], arm: str = "arm", parts: int | None = None) -> DataFrame:
    """The same from (keys, arm, value, cnt) rows."""
    ranked = ranked_counts(per_arm, keys, parts)
    mid = F.col("before") + (F.col("tied") + 1) / 2.0
    size = F.col("tied").cast("double")
    # t values tied make a term of t^3 - t: each of them brings t^2 - 1
    return ranked.groupBy(*keys, arm).agg(
        F.sum("cnt").alias("n"), F.sum(mid * F.col("cnt")).alias("rank_sum"), F.sum(F.col("cnt") * (size * size - 1.0)).alias("tie_part")
    )


def mann_whitney(ranks: DataFrame, keys: list[str], control: Column, arm: str = "arm") -> DataFrame:
    """Two-arm U test from ``arm_ranks``; U belongs to the treated arm.

    Tie- and continuity-corrected normal tail. ``exact_needed`` marks tie-free
    groups with an arm of at most 8 units, where the exact distribution applies
    (``small_samples.with_exact_mann_whitney``).
    """
    is_control = F.col(arm) == control
    g = ranks.groupBy(*keys).agg(
        F.sum(F.when(is_control, F.col("n"))).alias("n_control"),
        F.sum(F.when(~is_control, F.col("n"))).alias("n_treated"),
        F.sum(F.when(~is_control, F.col("rank_sum"))).alias("rank_sum"),
        F.sum("tie_part").alias("ties"),
    )
    n1, n2 = F.col("n_treated").cast("double"), F.col("n_control").cast("double")
    n = n1 + n2
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2.0
    mean = n1 * n2 / 2.0
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - ratio(F.col("ties"), n * (n - 1))))
    z = ratio(F.greatest(u, n1 * n2 - u) - mean - 0.5, sd)
    p = F.when(F.col("__z").isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2.0 * tails.normal_sf("__z")))
    return g.filter((F.col("n_control") > 0) & (F.col("n_treated") > 0)).withColumn("__z", z).select(
        *keys,
        "n_control",
        "n_treated",
        u.alias("u_statistic"),
        p.alias("p_value"),
        ((F.col("ties") == 0) & (F.least("n_control", "n_treated") <= 8)).alias("exact_needed"),
    )


def kruskal_wallis(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """Tie-corrected H over all arms of a group."""
    g = ranks.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("n_arms"),
        F.sum("n").alias("n"),
        F.sum(F.col("rank_sum") ** 2 / F.col("n")).alias("s"),
        F.sum("tie_part").alias("ties"),
    )
    n = F.col("n").cast("double")
    h = 12.0 / (n * (n + 1)) * F.col("s") - 3.0 * (n + 1)
    correction = 1.0 - ratio(F.col("ties"), n**3 - n)
    return (
        g.filter(F.col("n_arms") >= 2)
        .select(*keys, "n_arms", "n", ratio(h, correction).alias("statistic"))
        .withColumn("p_value", tails.chi_square_sf("statistic", "n_arms - 1"))
    )
