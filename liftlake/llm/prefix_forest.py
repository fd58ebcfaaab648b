"""Approximate nearest neighbours by a hash-prefix forest.

A tree is the sorted array of all vectors' hash strings, ``BITS`` signs of random
projections each. A query descends to the entries that share the longest prefixes with
its own string; the trees ascend together, one bit at a time, while too few candidates
are found: a query stops only where one tree alone, which holds no entry twice, has as
many ids as are asked for besides its own, or at the root, where all are candidates. How far is fitted: for a bounded sample of queries the true neighbours are
found by brute force, and the deepest level at which the trees find enough of them is
where every query starts. Entries below one prefix lie in sorted arrays of bounded size,
so a prefix that holds a third of all vectors is many arrays; queries meet each of them
in blocks, and only the best of an array leave its task.

Equal vectors are one entry that keeps as many of its smallest ids as are asked for
(and one more, for the query's own): no other of them can be among the nearest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from liftlake.session import materialize

TREES = 16
BITS = 64
#: Queries with true neighbours that fit the level; they are those of smallest hash.
FIT_QUERIES = 64
FIT_RECALL = 0.96
ARRAY_ROWS = 2048
QUERY_BLOCK = 256
#: Queries whose best entries a task keeps before it hands them on.
HELD_QUERIES = 50_000
#: Entries from all trees, counted once per tree, below which a query ascends in any case, as a multiple of the neighbours asked for.
LEAST_CANDIDATES = 8
_SEED = 20_240_501


def _usable(vector: Column) -> Column:
    """Whether a vector takes part: it has components, all finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _planes(dim: int, tree: int) -> np.ndarray:
    return np.random.default_rng([_SEED, dim, tree]).standard_normal((dim, BITS))


def _labels(vectors: np.ndarray, tree: int) -> np.ndarray:
    """Hash strings as unsigned numbers, first bit highest: their order is that of the strings."""
    bits = np.packbits(vectors @ _planes(vectors.shape[1], tree) > 0, axis=1)
    return np.ascontiguousarray(bits).view(">u8").ravel().astype(np.uint64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _entries(vectors: DataFrame, k: int) -> DataFrame:
    """entry, vec, ids: distinct usable vectors (as doubles) with their k + 1 smallest ids."""
    exact = F.transform("vec", lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.where("id is not null").where(_usable(F.col("vec"))).select("id", exact.alias("vec"))
    rows = rows.withColumn("entry", F.xxhash64("vec")).withColumn("dim", F.size("vec"))
    best = rows.withColumn("place", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("place") <= k + 1)
    return best.groupBy("vec", "dim").agg(F.min("entry").alias("hash"), F.min("id").alias("entry"), F.sort_array(F.collect_list("id")).alias("ids"))


def _strings(rows: DataFrame, key: str, held: Column | None = None) -> DataFrame:
    """key, tree, label (as signed number), dim, held (``held`` of the row, else 1) of each row and tree."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                for dim in np.unique(sizes):
                    own = lists.filter(pa.array(sizes == dim))
                    keys, held = (batch.column(i).filter(pa.array(sizes == dim)) for i in (0, 2))
                    length = pa.array(np.full(len(keys), dim, np.int32))
                    points = _matrix(own)
                    for tree in range(TREES):
                        tag = pa.array(np.full(len(keys), tree, np.int32))
                        yield pa.RecordBatch.from_arrays([keys, tag, pa.array(_labels(points, tree).view(np.int64)), length, held], names=["key", "tree", "label", "dim", "held"])

    held = (F.lit(1) if held is None else held).cast("int")
    return rows.select(F.col(key).alias("key"), "vec", held.alias("held")).mapInArrow(label, "key long, tree int, label long, dim int, held int")


def _prefix(label: str, level: int) -> Column:
    """The first ``level`` bits of a hash string."""
    return F.shiftrightunsigned(label, BITS - level) if level else F.lit(0).cast("long")


def _nearest_of(found: list[tuple], k: int) -> list[tuple]:
    """The k best (vector id, score) of one query, each once, ties to the smaller id."""
    return sorted(set(found), key=lambda f: (-f[1], f[0]))[:k]


def _best_of(queries: list, rows: list, k: int) -> list[tuple]:
    """(query, vector id, score) of the nearest of some entries to each query, ties by id, the query's own row left out."""
    points = np.array([r["vec"] for r in rows], np.float64)
    out = []
    scores = np.array([q["vec"] for q in queries], np.float64) @ points.T
    holders = Counter(i for r in rows for i in r["ids"])
    for q, row in zip(queries, scores):
        keep = min(k + holders[q["key"]], len(rows))  # entries with the query's own id may give nothing
        edge = np.partition(row, len(row) - keep)[len(row) - keep]
        # entries a rounding error apart stay for the exact comparison
        for at in np.flatnonzero(row >= edge - 1e-9 * max(1.0, abs(edge))):
            exact = float(np.dot(np.asarray(q["vec"], np.float64), points[at]))
            out += [(q["key"], i, exact) for i in rows[at]["ids"] if i != q["key"]]
    return out


_FOUND = "query_id long, vec_id long, score double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _brute(entries: DataFrame, sample: list, k: int) -> DataFrame:
    """The true neighbours of a bounded list of queries, over all entries."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = []
            for dim in {len(q["vec"]) for q in sample}:
                own = [r for r in rows if len(r["vec"]) == dim]
                found += _best_of([q for q in sample if len(q["vec"]) == dim], own, k) if own else []
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return _ranked(entries.select("vec", "ids").mapInArrow(scan, _FOUND), k)


def fitted_level(entries: DataFrame, strings: DataFrame, queries: DataFrame, k: int, recall: float = FIT_RECALL) -> int:
    """The deepest level at which the trees together find ``recall`` of the true neighbours of the sampled queries."""
    sample = [{"key": r.key, "vec": list(r.vec)} for r in queries.orderBy(F.xxhash64("key"), "key").limit(FIT_QUERIES).collect()]
    if not sample:
        return 0
    true = _brute(entries, sample, k).select("query_id", "vec_id")
    owner = entries.select(F.explode("ids").alias("vec_id"), "entry")
    true = materialize(true.join(owner, "vec_id").select("query_id", "entry"))
    keys = [q["key"] for q in sample]
    asked = _strings(queries.where(F.col("key").isin(keys)), "key").select(F.col("key").alias("query_id"), "tree", F.col("label").alias("q"))
    shared = F.lit(BITS) - F.length(F.regexp_replace(F.bin(F.col("q").bitwiseXOR(F.col("label"))), "^0$", ""))
    depth = true.join(asked, "query_id").join(strings.withColumnRenamed("key", "entry"), ["entry", "tree"])
    depth = depth.groupBy("query_id", "entry").agg(F.max(shared).alias("depth")).groupBy("depth").count().collect()
    hits = dict((r["depth"], r["count"]) for r in depth)
    total, found = sum(hits.values()), 0
    for level in range(BITS, -1, -1):
        found += hits.get(level, 0)
        if found >= recall * total:
            return level
    return 0


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query by inner product, ties to the smaller id.

    ``vectors`` and ``queries``: id, vec. A query's own id is no candidate. Rows with a null id, and vectors that are
    null, empty, zero or hold null or non-finite components, take no part. Vectors meet those of their own length only.
    Repeated rows of an id and vector count once. Empty tables: no rows.
    """
    entries = materialize(_entries(vectors, k))
    asked = queries.where("id is not null").where(_usable(F.col("vec")))
    asked = materialize(asked.select(F.col("id").alias("key"), F.transform("vec", lambda x: x.cast("double") + F.lit(0.0)).alias("vec")).distinct())
    strings = materialize(_strings(entries, "entry", F.size("ids")))
    level = fitted_level(entries, strings, asked, k)
    labels = materialize(_strings(asked, "key").drop("held"))
    own_entries = materialize(entries.select(F.explode("ids").alias("key")).join(asked.select("key"), "key", "left_semi").groupBy("key").agg(F.count("*").alias("own")))

    # synchronous ascent: one level up in all trees for the queries that have too few candidates
    start, pending, levels = level, labels, None
    while True:
        held = strings.groupBy("tree", "dim", _prefix("label", level).alias("prefix")).agg(F.count("*").alias("n"), F.sum("held").alias("held"))
        count = pending.withColumn("prefix", _prefix("label", level)).join(held, ["tree", "dim", "prefix"], "left").join(own_entries, "key", "left")
        others = F.coalesce("held", F.lit(0)) - F.coalesce("own", F.lit(0))
        count = count.groupBy("key").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.max(others).alias("others"))
        done = count.where(F.lit(level == 0) | (F.col("n") >= LEAST_CANDIDATES * k) & (F.col("others") >= k)).select("key", F.lit(level).alias("level"))
        done = materialize(done)
        levels = done if levels is None else levels.union(done)
        if level == 0:
            break
        pending = materialize(pending.join(done, "key", "left_anti"))
        if not pending.limit(1).count():
            break
        level -= 1
    levels = materialize(levels)

    found = []
    used = {r.level for r in levels.select("level").distinct().collect()}
    for depth in sorted(used | {start}):
        points = strings.select("key", "tree", "label").withColumn("prefix", _prefix("label", depth))
        arrays = points.groupBy("tree", "prefix").agg(F.ceil(F.count("*") / ARRAY_ROWS).alias("arrays"))
        points = points.join(arrays, ["tree", "prefix"]).withColumn("array", F.pmod(F.xxhash64("key"), "arrays"))
        points = points.join(entries.select(F.col("entry").alias("key"), "vec", "dim", "ids"), "key")
        # all arrays below a prefix come to one task, so that a query leaves it with one list of best entries, not one an array
        points = points.repartition("tree", "prefix", "dim").groupBy("tree", "prefix", "dim", "array").agg(F.sort_array(F.collect_list(F.struct("label", "vec", "ids"))).alias("points"))
        own = labels.drop("dim").join(levels.where(F.col("level") == depth).select("key"), "key").withColumn("prefix", _prefix("label", depth))
        blocks = own.groupBy("tree", "prefix").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
        own = own.join(blocks, ["tree", "prefix"]).withColumn("block", F.pmod(F.xxhash64("key"), "blocks")).join(asked, "key").withColumn("dim", F.size("vec"))
        own = own.groupBy("tree", "prefix", "dim", "block").agg(F.collect_list(F.struct("key", "vec")).alias("asked"))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}  # the best so far of each query this task has met

            def leave() -> pa.RecordBatch:
                best = [(q, *f) for q, found in held.items() for f in found]
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array([f[i] for f in best], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

            for batch in batches:
                for row in range(batch.num_rows):
                    more: dict[int, list] = {}
                    for q, i, score in _best_of(batch.column(1)[row].as_py(), batch.column(0)[row].as_py(), k):
                        more.setdefault(q, []).append((i, score))
                    for q, found in more.items():
                        held[q] = _nearest_of(held.get(q, []) + found, k)
                    if len(held) > HELD_QUERIES:
                        yield leave()
            yield leave()

        # by key, not by a broadcast
        met = points.hint("merge").join(own.hint("merge"), ["tree", "prefix", "dim"])
        found.append(met.select("points", "asked").mapInArrow(meet, _FOUND))
    result = found[0]
    for more in found[1:]:
        result = result.union(more)
    return _ranked(result, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
