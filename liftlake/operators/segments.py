"""Heterogeneous effects: dimension discovery, per-segment tests, interaction tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from liftlake.functions import fixed, tails
from liftlake.operators import catalog as catalog_ops
from liftlake.operators import effects
from liftlake.operators.units import clean_double
from liftlake.session import materialize


def discover_dimensions(catalog: DataFrame, roles: DataFrame) -> DataFrame:
    """Usable segmentation columns and, for every other column, why it was skipped.

    ``catalog`` has a row per dataset and column; ``roles`` one row per dataset
    with user_column, variant_column and metric_column.
    """
    joined = catalog.join(roles.select("dataset", "user_column", "variant_column", "metric_column"), "dataset")
    name = F.col("column_name")
    is_reserved = F.coalesce(
        name.eqNullSafe(F.col("user_column")) | name.eqNullSafe(F.col("variant_column")) | name.eqNullSafe(F.col("metric_column")),
        F.lit(False),
    )
    known = [*fixed.EVENT_NAMES, *fixed.TIMESTAMP_NAMES, *fixed.COVARIATE_NAMES]
    many = F.col("n_distinct").isNull() | (F.col("n_distinct") > fixed.SEGMENT_MAX_CARDINALITY)
    reason = (
        F.when(F.lower(name).isin(known), "identifier_or_metric_column")
        .when(catalog_ops.treatment_timing(name) == "post_treatment", "post_treatment_variable")
        .when(F.col("null_fraction") > fixed.SEGMENT_MAX_MISSING, "excessive_missing_values")
        .when(F.col("n_distinct") < 2, "too_few_distinct_values")
        .when(many, "high_cardinality")
    )
    return joined.filter(~is_reserved).select("dataset", "column_name", reason.alias("skip_reason")).withColumn(
        "usable", F.col("skip_reason").isNull()
    )


def segment_cells(units: DataFrame, keys: list[str], arm: str, metrics: list[str], dimensions: list[str]) -> DataFrame:
    """Arm moments of every (dimension, segment) in one grouping-sets aggregate.

    Rows are expanded once per dimension and combined map-side; all metrics are
    aggregated side by side. Missing segment values are not segments. The cells
    are written: tests, small-segment rows and interaction tests all read them.
    """
    if not dimensions:
        raise ValueError("segment_cells needs at least one dimension")
    held = units.filter(F.col(arm).isNotNull()).select(
        *keys,
        F.col(arm).cast("string").alias("arm"),
        *[F.col(d).cast("string").alias(f"__d{i}") for i, d in enumerate(dimensions)],
        *[clean_double(m).alias(f"__y{j}") for j, m in enumerate(metrics)],
    )
    aggregates = [F.count(F.lit(1)).alias("n_rows")]
    for j in range(len(metrics)):
        y = F.col(f"__y{j}")
        aggregates += [
            F.count(y).alias(f"n{j}"),
            F.avg(y).alias(f"m{j}"),
            F.var_samp(y).alias(f"v{j}"),
            F.count_if(y == 1).cast("long").alias(f"s{j}"),
            F.count_if((y != 0) & (y != 1)).alias(f"o{j}"),
        ]
    base = [F.col(k) for k in keys] + [F.col("arm")]
    dims = [F.col(f"__d{i}") for i in range(len(dimensions))]
    sets = [[*base, d] for d in dims]
    # grouping() is 0 for the one dimension the row belongs to
    grouped = held.groupingSets(sets, *base, *dims).agg(
        *[F.grouping(f"__d{i}").alias(f"__g{i}") for i in range(len(dimensions))], *aggregates
    )
    which, segment = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in reversed(list(enumerate(dimensions))):
        which = F.when(F.col(f"__g{i}") == 0, F.lit(d)).otherwise(which)
        segment = F.when(F.col(f"__g{i}") == 0, F.col(f"__d{i}")).otherwise(segment)
    labelled = grouped.withColumn("dimension", which).withColumn("segment", segment).filter(F.col("segment").isNotNull())
    return materialize(effects.stack_moments(labelled, [*keys, "dimension", "segment", "arm"], metrics))


def segment_effects(
    cells: DataFrame, keys: list[str], control: str, min_arm: int = fixed.SEGMENT_MIN_ARM, alpha: float = fixed.ALPHA
) -> DataFrame:
    """Per-segment comparison against the control; small segments are reported, not tested."""
    by = [*keys, "dimension", "segment"]
    kinds = effects.metric_kind(
        F.col("metric"), F.sum("n_other").over(W.partitionBy(*keys, "metric", "dimension")) == 0
    )
    paired = effects.pair_with_control(cells.withColumn("metric_type", kinds), by, control)
    enough = (F.coalesce(F.col("n_c"), F.lit(0)) >= min_arm) & (F.col("n_t") >= min_arm)
    sized = paired.withColumn("status", F.when(enough, "SUFFICIENT").otherwise("INSUFFICIENT"))
    tested = effects.run_tests(effects.choose_test(sized.filter(enough)), by, alpha)
    small = sized.filter(~enough).select(*by, "metric", "metric_type", "reference_arm", "arm", "n_c", "n_t")
    adjusted = holm_within_dimension(tested, keys, alpha)
    return adjusted.withColumn("status", F.lit("SUFFICIENT")).unionByName(
        small.withColumn("n_c", F.coalesce("n_c", F.lit(0))).withColumn("status", F.lit("INSUFFICIENT")), allowMissingColumns=True
    )


def holm_within_dimension(tested: DataFrame, keys: list[str], alpha: float = fixed.ALPHA) -> DataFrame:
    """Step-down adjustment over a dimension's tested segments; needs at least two."""
    family = [*keys, "metric", "dimension", "arm"]
    out = effects.holm(tested, family, alpha, ties="segment")
    several = F.count(F.lit(1)).over(W.partitionBy(*family)) >= 2
    return out.withColumn("reliable", several & (F.col("adj_p") < alpha)).withColumn(
        "adj_p", F.when(several, F.col("adj_p"))
    ).withColumn("significant", F.when(several, F.col("significant")).otherwise(F.col("p_value") < alpha))


def _testable_cells(cells: DataFrame, keys: list[str], control: str, min_arm: int) -> DataFrame:
    """Two-arm cells of segments large enough in both arms, in dimensions with two such segments."""
    by = [*keys, "metric", "dimension"]
    seg = W.partitionBy(*by, "segment")
    enough = (F.min("n").over(seg) >= min_arm) & (F.count(F.lit(1)).over(seg) == 2)
    kept = cells.withColumn("__ok", enough).filter("__ok").drop("__ok")
    return kept.withColumn("treated", (F.col("arm") != control).cast("int"))


def _logit_deviance_sql(cells: str) -> str:
    """Deviance of logit(arm + segment) on an array of two-arm cells (nc, nt, sc, st), no cell without or with only successes.

    For a given arm effect d each segment's odds u have a closed form: the positive root that makes its
    fitted successes equal the observed. What is left is one monotone equation in d, solved by bisection.
    """
    both, total = "(c.sc + c.st)", "(c.nc + c.nt)"

    def with_odds(d: str, body: str) -> str:
        inner = tails._let("of", {"q": "og.q", "u": f"if(og.b > 0D, 2D * {both} / (og.b + og.r), (og.r - og.b) / (2D * og.a))"}, body)
        root = tails._let("og", {"q": "oe.q", "a": "oe.a", "b": "oe.b", "r": f"sqrt(oe.b * oe.b + 4D * oe.a * {both})"}, inner)
        bound = {"q": "od.q", "a": f"od.q * ({total} - {both})", "b": f"c.nc + c.nt * od.q - {both} * (1D + od.q)"}
        return tails._let("od", {"q": f"exp({d})"}, tails._let("oe", bound, root))

    missed = with_odds("md.d", "c.st - c.nt * of.q * of.u / (1D + of.q * of.u)")
    score = f"aggregate({cells}, 0D, (a, c) -> a + {missed})"
    halved = f"if({score} > 0D, named_struct('lo', md.d, 'hi', b.hi), named_struct('lo', b.lo, 'hi', md.d))"
    effect = f"aggregate(sequence(1, 60), named_struct('lo', -30D, 'hi', 30D), (b, i) -> {tails._let('md', {'d': '(b.lo + b.hi) / 2D'}, halved)}, b -> (b.lo + b.hi) / 2D)"

    def part(n: str, s: str, odds: str) -> str:
        return f"{s} * ln({s} * (1D + {odds}) / ({n} * {odds})) + ({n} - {s}) * ln(({n} - {s}) * (1D + {odds}) / {n})"

    deviance = with_odds("dv.d", f"{part('c.nc', 'c.sc', 'of.u')} + {part('c.nt', 'c.st', '(of.q * of.u)')}")
    return tails._let("dv", {"d": effect}, f"greatest(0D, 2D * aggregate({cells}, 0D, (a, c) -> a + {deviance}))")


def _additive_error_sql(cells: str) -> str:
    """Between-cell squared error left by the weighted additive fit of cell means (nc, nt, mc, mt)."""
    weight = "(c.nc * c.nt / (c.nc + c.nt))"
    sums = {"d": f"aggregate({cells}, 0D, (a, c) -> a + {weight} * (c.mt - c.mc)) / aggregate({cells}, 0D, (a, c) -> a + {weight})"}
    return tails._let("ad", sums, f"aggregate({cells}, 0D, (a, c) -> a + {weight} * pow(c.mt - c.mc - ad.d, 2D))")


def interaction_tests(
    cells: DataFrame, keys: list[str], control: str, min_arm: int = fixed.SEGMENT_MIN_ARM, alpha: float = fixed.ALPHA
) -> DataFrame:
    """Does the effect itself differ across segments?

    Cells are sufficient statistics, so the whole data is used: binary metrics by
    the likelihood ratio of the saturated and the additive logit, others by the
    nested F-test. A group is one dimension's cells, an array of bounded length.
    Separation (a cell with no or only successes) yields a null p: not assessed.
    """
    by = [*keys, "metric", "dimension"]
    kinds = effects.metric_kind(F.col("metric"), F.sum("n_other").over(W.partitionBy(*by)) == 0)
    kept = _testable_cells(cells.withColumn("metric_type", kinds), keys, control, min_arm)
    treated = F.col("treated") == 1
    sides = [
        F.max(F.when(~treated if side == "c" else treated, F.col(column).cast("double"))).alias(short + side)
        for column, short in (("n", "n"), ("n_success", "s"), ("mean", "m"), ("var", "v"))
        for side in "ct"
    ]
    paired = kept.groupBy(*by, "segment").agg(F.first("metric_type").alias("metric_type"), *sides)
    cell = F.struct(*[short + side for short in "nsmv" for side in "ct"])
    groups = paired.groupBy(*by).agg(
        F.first("metric_type").alias("metric_type"), F.count(F.lit(1)).cast("int").alias("n_segments"), F.collect_list(cell).alias("__cells")
    )
    several = (F.col("n_segments") >= 2) & F.expr("forall(__cells, c -> c.nc is not null and c.nt is not null)")
    inside = F.expr("forall(__cells, c -> c.sc > 0 and c.sc < c.nc and c.st > 0 and c.st < c.nt)")
    binary = F.col("metric_type") == "binary"
    within = "aggregate(__cells, 0D, (a, c) -> a + (c.nc - 1D) * coalesce(c.vc, 0D) + (c.nt - 1D) * coalesce(c.vt, 0D))"
    fitted = (
        groups.withColumn("df1", F.col("n_segments") - 1)
        .withColumn("df2", F.when(several & ~binary, F.expr("aggregate(__cells, 0D, (a, c) -> a + c.nc + c.nt) - 2D * n_segments")))
        .withColumn("__within", F.when(several & ~binary, F.expr(within)))
        .withColumn(
            "statistic",
            F.when(several & binary & inside, F.expr(_logit_deviance_sql("__cells"))).when(
                (F.col("__within") > 0) & (F.col("df2") > 0), F.expr(f"{_additive_error_sql('__cells')} / df1 / (__within / df2)")
            ),
        )
        .select(*by, "metric_type", "n_segments", "statistic", "df1", "df2")
    )
    p = F.when(
        F.col("statistic").isNotNull(),
        F.when(F.col("metric_type") == "binary", tails.chi_square_sf("statistic", "df1")).otherwise(
            tails.f_sf("statistic", "df1", "df2")
        ),
    )
    return fitted.withColumn("p_value", p).withColumn(
        "heterogeneous", F.coalesce(F.col("p_value") < alpha, F.lit(False))
    )


def segment_summary(segment_rows: DataFrame, keys: list[str], interactions: DataFrame | None = None) -> DataFrame:
    """Reliable and heterogeneous dimensions per experiment and metric."""
    by = [*keys, "metric"]
    reliable: Column = F.array_sort(F.collect_set(F.when(F.coalesce("reliable", F.lit(False)), F.col("dimension"))))
    out = segment_rows.groupBy(*by).agg(
        F.count_if(F.col("status") == "SUFFICIENT").alias("n_tested"),
        F.count_if(F.col("status") == "INSUFFICIENT").alias("n_insufficient"),
        F.array_join(reliable, ",").alias("reliable_dimensions"),
    )
    if interactions is not None:
        mixed = interactions.groupBy(*by).agg(
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("heterogeneous"), F.col("dimension")))), ",").alias(
                "heterogeneous_dimensions"
            )
        )
        out = out.join(mixed, by, "left")
    return out.withColumn("ran", F.lit(True))
