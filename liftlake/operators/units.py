"""Unit tables: arms, assignment, duplicates, long metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from liftlake.functions import fixed
from liftlake.session import materialize

#: Files whose paths and offsets (some 200 bytes each) are broadcast to number rows; more are joined by a shuffle.
BROADCAST_FILES = 100_000


def clean_double(column: str) -> Column:
    """The metric as double with NaN read as missing."""
    value = F.col(column).cast("double")
    return F.when(F.isnan(value), None).otherwise(value)


def split_arms(units: DataFrame, arm: str, control: str, null_arm: str = "exclude") -> DataFrame:
    """Add ``is_control``. A missing arm is excluded (null flag) by default;
    ``null_arm="treatment"`` counts it as treated."""
    if null_arm not in ("exclude", "treatment"):
        raise ValueError("null_arm must be 'exclude' or 'treatment'")
    if null_arm == "treatment":
        return units.withColumn("is_control", F.col(arm).eqNullSafe(F.lit(control)))
    return units.withColumn("is_control", F.col(arm) == F.lit(control))


def metrics_long(units: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """One row per unit and metric. Rank-based operators need this; moments do not
    (``effects.arm_moments`` aggregates the wide table and reshapes the result)."""
    typed = units.select(*ids, *[clean_double(m).alias(m) for m in metrics])
    return typed.unpivot(ids, metrics, "metric", "value")


def merge_assignment(
    units: DataFrame, assignment: DataFrame, unit: str, assigned_unit: str, arm: str
) -> DataFrame:
    """Left many-to-one merge that imports only the key and the arm.

    The one-row-per-unit rule is checked inside the job: the first duplicate
    assignment fails the query instead of picking a row.
    """
    if arm in units.columns and arm != unit:
        raise ValueError(f"column '{arm}' exists on both sides of the assignment merge")
    slim = (
        assignment.groupBy(F.col(assigned_unit).alias("__unit"))
        .agg(F.count(F.lit(1)).alias("__n"), F.max(arm).alias("__arm"))
        .select(
            "__unit",
            F.when(F.col("__n") == 1, F.col("__arm"))
            .otherwise(F.raise_error(F.concat(F.lit("duplicate assignment for unit "), F.col("__unit").cast("string"))))
            .alias(arm),
        )
    )
    return units.join(slim, units[unit] == slim["__unit"], "left").drop("__unit")


def first_row_per_unit(rows: DataFrame, unit_keys: list[str], order_col: str) -> DataFrame:
    """Keep each unit's first row by ``order_col``; partial aggregation, no window sort."""
    rest = [c for c in rows.columns if c not in unit_keys and c != order_col]
    picked = rows.groupBy(*unit_keys).agg(F.min(F.struct(order_col, *rest)).alias("__row"))
    return picked.select(*unit_keys, "__row.*").select(*rows.columns)


def duplicate_analysis(rows: DataFrame, keys: list[str], unit: str, arm: str, metric: str) -> DataFrame:
    """Extra rows, units in several arms, and units with conflicting metric values.

    "More than one distinct value" is min < max, so no distinct aggregate is
    needed and a unit with very many rows shrinks before the shuffle.
    """
    value = clean_double(metric)
    per_unit = rows.groupBy(*keys, unit).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(arm).alias("arm_lo"),
        F.max(arm).alias("arm_hi"),
        F.min(value).alias("value_lo"),
        F.max(value).alias("value_hi"),
    )
    severe = F.col(unit).isNotNull() & (F.col("arm_lo") < F.col("arm_hi"))
    ambiguous = (
        F.col(unit).isNotNull() & (F.col("arm_lo") == F.col("arm_hi")) & (F.col("value_lo") < F.col("value_hi"))
    )
    return per_unit.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum(F.col("n_rows") - 1).alias("duplicate_rows"),
        F.count_if(severe).alias("conflicting_arm_units"),
        F.count_if(ambiguous).alias("conflicting_metric_units"),
    )


def single_arm_units(rows: DataFrame, keys: list[str], unit: str, arm: str) -> DataFrame:
    """Units seen in exactly one non-null arm."""
    per_unit = rows.groupBy(*keys, unit).agg(F.min(arm).alias("arm"), F.max(arm).alias("__hi"))
    return per_unit.filter(F.col("arm") == F.col("__hi")).drop("__hi")


QUALITY_FIELDS = "struct<label:string,passed:boolean,critical:boolean,informational:boolean,detail:string>"


def quality_struct(label: str, passed: Column, detail: Column, critical=None, informational=None) -> Column:
    return F.struct(
        F.lit(label).alias("label"),
        passed.alias("passed"),
        (F.lit(False) if critical is None else critical).alias("critical"),
        (F.lit(False) if informational is None else informational).alias("informational"),
        detail.alias("detail"),
    )


def explode_quality(facts: DataFrame, keys: list[str], checks: list[Column]) -> DataFrame:
    """Facts row to quality rows; null structs (checks that do not apply) vanish."""
    return facts.select(*keys, F.explode(F.array_compact(F.array(*checks))).alias("q")).select(*keys, "q.*")


def integrity_rows(duplicates: DataFrame, keys: list[str]) -> DataFrame:
    """Quality rows from ``duplicate_analysis``."""
    arm_conflict = F.col("conflicting_arm_units") > 0
    metric_conflict = ~arm_conflict & (F.col("conflicting_metric_units") > 0)
    return explode_quality(
        duplicates,
        keys,
        [
            quality_struct(
                "duplicate_rows", F.lit(True), F.concat(F.col("duplicate_rows").cast("string"), F.lit(" extra rows"))
            ),
            F.when(
                arm_conflict,
                quality_struct(
                    "arm_conflict",
                    F.lit(False),
                    F.concat(F.col("conflicting_arm_units").cast("string"), F.lit(" units in several arms")),
                ),
            ),
            F.when(
                metric_conflict,
                quality_struct(
                    "metric_conflict",
                    F.lit(False),
                    F.concat(F.col("conflicting_metric_units").cast("string"), F.lit(" units with several values")),
                    critical=F.lit(True),
                ),
            ),
        ],
    )


def control_rank(arm: Column) -> Column:
    """0 for the word control, 1 for a holdout label, 2 otherwise."""
    plain = F.lower(F.trim(arm.cast("string")))
    return (
        F.when(plain == "control", 0)
        .when(F.regexp_replace(plain, r"[\s_-]+", " ").isin(fixed.HOLDOUT_LABELS), 1)
        .otherwise(2)
    )


def control_arm(units: DataFrame, keys: list[str], arm: str) -> DataFrame:
    """The reference arm per experiment."""
    present = units.filter(F.col(arm).isNotNull())
    ranked = F.struct(control_rank(F.col(arm)).alias("r"), F.col(arm).cast("string").alias("arm"))
    return present.groupBy(*keys).agg(F.min(ranked)["arm"].alias("control_arm"))


def with_control_arm(facts: DataFrame, keys: list[str], arm: str = "arm") -> DataFrame:
    """Add ``reference_arm`` to a facts table with one row per arm."""
    ranked = F.struct(control_rank(F.col(arm)).alias("r"), F.col(arm).cast("string").alias("arm"))
    return facts.withColumn("reference_arm", F.min(ranked).over(W.partitionBy(*keys))["arm"])


def implicit_unit_name(columns: list[str]) -> str:
    name = "__experiment_unit_row_id__"
    while name in columns:
        name = "_" + name
    return name


def with_implicit_unit(rows: DataFrame, scanned: bool = False) -> tuple[DataFrame, str]:
    """A row id for tables where one row is one unit: the same each time it is evaluated, whatever the partitions.

    Rows are numbered by their place in the Parquet files behind them, files in order of path: 0 to n - 1 over
    a whole table. ``scanned`` says that ``rows`` only choose columns or filter rows of a scan of Parquet files
    (filtered rows keep gaps between their ids). Other rows are written first, since a plan does not fix their order.
    """
    name = implicit_unit_name(rows.columns)
    file, place, start = f"{name}file", f"{name}place", f"{name}start"
    source = rows if scanned else materialize(rows)
    read = source.metadataColumn("_metadata")
    placed = source.select("*", read["file_path"].alias(file), read["row_index"].alias(place))
    # one row per file; only file footers and row positions are read
    sizes = materialize(placed.groupBy(file).agg((F.max(place) + 1).alias("n")))
    before = F.coalesce(F.sum("n").over(W.orderBy(file).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(sizes.select(file, before.alias(start)))
    if starts.count() <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    numbered = placed.join(starts, file)
    return numbered.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col(start) + F.col(place)).alias(name)), name
