"""Resampling intervals and exact small-sample p-values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlake.functions import fixed, small_samples
from liftlake.operators import ranks
from liftlake.session import hinted, materialize


def with_exact_mann_whitney(facts: DataFrame) -> DataFrame:
    """Replace the normal p-value of the rows marked ``exact_needed``."""

    @F.pandas_udf("double")
    def exact(n1: pd.Series, n2: pd.Series, u: pd.Series, needed: pd.Series, p: pd.Series) -> pd.Series:
        out = [
            small_samples.mann_whitney_exact(int(a), int(b), float(c)) if flag else q
            for a, b, c, flag, q in zip(n1, n2, u, needed, p)
        ]
        return pd.Series(out, dtype=float)

    return facts.withColumn("p_value", exact("n_treated", "n_control", "u_statistic", "exact_needed", "p_value"))


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)


#: Widths of brackets around the median, as shares of the group.
_WIDTHS = (0.01, 0.02, 0.04, 0.08, 0.16, 0.32, 0.5)


def median_bootstrap(
    long: DataFrame,
    keys: list[str],
    arm: str,
    control: str,
    draws: int = 2000,
    alpha: float = fixed.ALPHA,
    seed: int = 42,
    parts: int | None = None,
) -> DataFrame:
    """Percentile interval of the difference of medians.

    Resampled medians land within some sqrt(n) positions of the middle, so only values in a bracket around the
    median are ranked; everything else is counted.
    """
    groups = [*keys, arm]
    held = long.filter(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("__x", F.col("value").cast("double"))
    facts = held.groupBy(*groups).agg(ranks.sketch("__x").alias("__sketch"), F.count(F.lit(1)).alias("n"))
    facts = ranks.brackets(facts, "__sketch", [(0.5, w) for w in _WIDTHS])
    # six times sqrt(n) positions are twelve standard deviations
    reach = 6.0 / F.sqrt("n") + 2.0 / F.col("n") + ranks.MARGIN
    place = F.lit(len(_WIDTHS))
    for k in range(len(_WIDTHS) - 1, 0, -1):
        place = F.when(reach <= _WIDTHS[k - 1], k).otherwise(place)
    facts = materialize(facts.withColumn("__brackets", F.array(F.element_at("__brackets", place))))
    positions = materialize(_positions(facts.select(*groups, "n"), groups, draws, seed))
    near = ranks.ranked_counts(ranks.bracketed_counts(long, facts, groups), groups, parts, ("value", "gap"))
    found = materialize(_values_at(near, positions, groups))
    lost = found.filter(F.col("gap")).select(*groups).distinct()
    if lost.limit(1).count():  # a sketch was further off than its margin: rank these groups in full
        full = ranks.ranked_counts(ranks.value_counts(long.join(lost, groups, "left_semi"), groups), groups, parts).withColumn("gap", F.lit(False))
        found = found.join(lost, groups, "left_anti").unionByName(_values_at(full, positions.join(lost, groups, "left_semi"), groups))
    return _median_interval(found, keys, arm, control, draws, alpha, seed)


def median_bootstrap_of_ranked(
    ranked: DataFrame, keys: list[str], arm: str, control: str, draws: int = 2000, alpha: float = fixed.ALPHA, seed: int = 42
) -> DataFrame:
    """The same from ranked (keys, arm, value) counts."""
    groups = [*keys, arm]
    positions = materialize(_positions(ranked.groupBy(*groups).agg(F.max("n").alias("n")), groups, draws, seed))
    return _median_interval(_values_at(ranked.withColumn("gap", F.lit(False)), positions, groups), keys, arm, control, draws, alpha, seed)


def _drawn(size: int, digest: int, draws: int, seed: int) -> np.ndarray:
    """The positions of a group's draws; seeded by its keys, so that every call and every retry repeats them."""
    rng = np.random.default_rng([seed, int(digest) & 0xFFFFFFFF, (int(digest) >> 32) & 0xFFFFFFFF])
    return small_samples.resampled_median_positions(int(size), draws, rng)


def _positions(sizes: DataFrame, groups: list[str], draws: int, seed: int) -> DataFrame:
    """Distinct zero-based positions that a group's resampled medians take, twice ``draws`` at most, a row for each."""

    @F.pandas_udf("array<bigint>")
    def distinct(n: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series([np.unique(_drawn(size, h, draws, seed)) for size, h in zip(n, digest)])

    drawn = sizes.withColumn("digest", F.xxhash64(*groups))
    drawn = drawn.select(*groups, "n", "digest", F.explode(distinct("n", "digest")).alias("at"))
    # positions spread over some sqrt(n): so wide are the lots in which they meet the ranked values
    step = F.greatest(F.floor(F.sqrt("n") / 32), F.lit(1)).cast("long")
    return drawn.withColumn("__step", step).withColumn("__lot", F.expr("at div __step"))


def _values_at(ranked: DataFrame, positions: DataFrame, groups: list[str]) -> DataFrame:
    """groups, n, digest, at, value, gap of each position; a group's values meet its positions in lots, so none is gathered whole."""
    reach = positions.groupBy(*groups).agg(F.min("at").alias("__low"), F.max("at").alias("__high"), F.first("__step").alias("__step"))
    reach, positions = hinted(positions, reach, positions)
    near = ranked.select(*groups, "value", "gap", "before", (F.col("before") + F.col("cnt")).alias("upto")).join(reach, groups)
    near = near.filter((F.col("upto") > F.col("__low")) & (F.col("before") <= F.col("__high")))
    # a value tied over many positions is in each lot it covers; there are some hundred lots, whatever the size of the group
    lots = F.expr("sequence(greatest(before, __low) div __step, least(upto - 1, __high) div __step)")
    near = near.select(*groups, "value", "gap", "before", "upto", F.explode(lots).alias("__lot"))
    met = positions.select(*groups, "__lot", "n", "digest", "at").join(near, [*groups, "__lot"])
    return met.filter((F.col("before") <= F.col("at")) & (F.col("at") < F.col("upto"))).select(*groups, "n", "digest", "at", "value", "gap")


def _median_interval(found: DataFrame, keys: list[str], arm: str, control: str, draws: int, alpha: float, seed: int) -> DataFrame:
    """An arm's draws are looked up among its distinct positions: arrays of at most twice ``draws`` values."""
    is_control = F.col(arm) == control
    point = F.struct("at", "value")
    sides = found.groupBy(*keys).agg(
        *[
            column
            for name, mine in (("c", is_control), ("t", ~is_control))
            for column in (
                F.sort_array(F.collect_list(F.when(mine, point))).alias(name),
                F.max(F.when(mine, F.col("n"))).alias(f"n_{name}"),
                F.max(F.when(mine, F.col("digest"))).alias(f"h_{name}"),
            )
        ]
    )

    @F.pandas_udf("ci_lower double, ci_upper double")
    def interval(
        c_at: pd.Series, c: pd.Series, n_c: pd.Series, h_c: pd.Series, t_at: pd.Series, t: pd.Series, n_t: pd.Series, h_t: pd.Series
    ) -> pd.DataFrame:
        def medians(at: np.ndarray, value: np.ndarray, n: int, digest: int) -> np.ndarray:
            return value[np.searchsorted(at, _drawn(n, digest, draws, seed))].mean(axis=1)

        out = []
        for control_side, treated_side in zip(zip(c_at, c, n_c, h_c), zip(t_at, t, n_t, h_t)):
            both = len(control_side[0]) and len(treated_side[0])
            diff = medians(*treated_side) - medians(*control_side) if both else None
            out.append(np.percentile(diff, [100 * alpha / 2, 100 * (1 - alpha / 2)]) if both else (None, None))
        return pd.DataFrame(out, columns=["ci_lower", "ci_upper"], dtype=float)

    sides = sides.select(*keys, interval("c.at", "c.value", "n_c", "h_c", "t.at", "t.value", "n_t", "h_t").alias("i"))
    return sides.select(*keys, "i.*")


def _thresholds(rate: float) -> np.ndarray:
    """Cumulative Poisson probabilities, as thresholds on a 64-bit hash."""
    k = np.arange(int(rate + 12 * np.sqrt(rate) + 16))
    log = -rate + k * np.log(rate) - np.array([math.lgamma(x + 1) for x in k])
    return np.minimum(np.cumsum(np.exp(log)) * 2.0**64, 2.0**64 - 2048).astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit avalanche (splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Tasks whose vectors are added in one group of the first round.
_ROUND = 256


def _summed(vectors: DataFrame, groups: list[str]) -> DataFrame:
    """Replicate sums of each group added element by element, in two rounds, so that no task holds those of all tasks."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)

    def add(table: pa.Table) -> pa.Table:
        out = table.slice(0, 1)
        for name in ("sw", "swv"):
            total = sum(np.frombuffer(v.as_buffer(), np.float64) for v in table[name].combine_chunks())
            out = out.set_column(out.schema.get_field_index(name), name, pa.array([total.tobytes()], pa.binary()))
        return out

    for part in (F.col("part") % _ROUND, F.lit(0)):
        vectors = vectors.withColumn("part", part.cast("int")).groupBy(*groups, "part").applyInArrow(add, schema)
    return vectors


def mean_bootstrap(
    long: DataFrame,
    keys: list[str],
    unit: str,
    arm: str,
    control: str,
    draws: int = 10_000,
    alpha: float = fixed.ALPHA,
    seed: int = 42,
    value: str = "value",
    bags: int = 1,
) -> DataFrame:
    """Percentile interval of the difference of means, by the Poisson bootstrap.

    A unit's weight in a replicate is a function of its hash, the replicate and the seed, so the result does
    not depend on partitioning or retries. Each task sends two vectors of ``draws`` sums per group; unit rows are never shuffled.

    With ``bags`` > 1 it is the bag of little bootstraps: units are dealt to ``bags`` bags by their hash, each bag is resampled
    to the full size (weights of mean ``bags``), and the ends of the bags' intervals are averaged. A unit is in one bag, so
    ``draws`` of some hundred a bag do the work of thousands.
    """
    groups = [*keys, arm, "__bag"]
    rows = long.filter(F.col(value).isNotNull() & ~F.isnan(value) & F.col(arm).isNotNull()).select(
        *keys, arm, F.pmod(F.xxhash64(F.col(unit), F.lit(seed), F.lit("bag")), F.lit(bags)).cast("int").alias("__bag"),
        F.xxhash64(F.col(unit), F.lit(seed)).alias("__h"), F.col(value).cast("double").alias("__v"),
    )
    schema = _fields(rows, groups) + ", part int, sw binary, swv binary"
    salts = _mix(np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    thresholds = _thresholds(float(bags))

    def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def send() -> Iterator[pd.DataFrame]:
            for key, (sw, swv) in held.items():
                yield pd.DataFrame({**{g: [k] for g, k in zip(groups, key)}, "part": np.int32(part), "sw": [sw.tobytes()], "swv": [swv.tobytes()]})
            held.clear()

        for pdf in batches:
            for key, rows in pdf.groupby(groups, sort=False, dropna=False):
                sw, swv = held.setdefault(key, (np.zeros(draws), np.zeros(draws)))
                hashes, values = rows["__h"].to_numpy().astype(np.uint64), rows["__v"].to_numpy()
                step = max(1, 2_000_000 // draws)
                for i in range(0, len(values), step):
                    bits = _mix(hashes[i : i + step, None] ^ salts[None, :])
                    weights = np.searchsorted(thresholds, bits.ravel(), side="right").reshape(bits.shape).astype(float)
                    sw += weights.sum(axis=0)
                    swv += values[i : i + step] @ weights
                if len(held) * draws > 4_000_000:  # bound task memory: sums may be sent early
                    yield from send()
        yield from send()

    sums = _summed(rows.mapInPandas(accumulate, schema), groups)

    @F.pandas_udf("array<double>")
    def means(sw: pd.Series, swv: pd.Series) -> pd.Series:
        out = []
        for w, wv in zip(sw, swv):
            w, wv = np.frombuffer(w), np.frombuffer(wv)
            out.append(np.divide(wv, w, out=np.full(len(w), np.nan), where=w > 0))
        return pd.Series(out)

    is_control = F.col(arm) == control
    side = sums.select(*groups, means("sw", "swv").alias("m")).groupBy(*keys, "__bag").agg(
        F.max(F.when(~is_control, F.col("m"))).alias("t"), F.max(F.when(is_control, F.col("m"))).alias("c")
    )
    diffs = F.filter(F.zip_with("t", "c", lambda t, c: t - c), lambda d: d.isNotNull() & ~F.isnan(d))
    # one value a replicate: the arrays are bounded by ``draws``
    ends = side.select(*keys, F.sort_array(diffs).alias("d")).filter(F.size("d") > 0)
    return ends.groupBy(*keys).agg(
        F.sum(F.size("d")).alias("replicates"), F.avg(_array_percentile("d", alpha / 2)).alias("ci_lower"), F.avg(_array_percentile("d", 1 - alpha / 2)).alias("ci_upper")
    )


def _array_percentile(ordered: str, p: float) -> Column:
    """Linearly interpolated percentile of an ordered array."""
    h = (F.size(ordered) - 1) * F.lit(p)
    low, high = F.get(ordered, F.floor(h).cast("int")), F.get(ordered, F.ceil(h).cast("int"))
    return low + (high - low) * (h - F.floor(h))
