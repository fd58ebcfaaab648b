"""Hard-negative mining over an STR-packed R-tree.

Packing: rows are range-partitioned by length, label and first coordinate (ties by a hash of the id, so that
a vector that is repeated very often is no hot range), and sorted tile by tile over the next coordinates
inside slabs of ``SLAB_ROWS``. The order is a written table; runs of ``LEAF_ROWS`` rows are the leaves.

Search: a task reads its rows in subtrees of some thousand, takes minimum bounding boxes of leaves and, ``FAN_OUT`` at
a time, of the nodes above. For a vector q the inner products in a box lie between the sums of min(q*low, q*high)
and max(q*low, q*high) over the coordinates. A block of anchors walks a subtree through one queue, the node with the
highest bound first. An anchor leaves a node that lies outside its score windows or strictly below its k-th score, where a tie
could still win by its id; a leaf is one matrix product for the anchors that are left. Each task keeps the best k of each
anchor through all its subtrees and sends them once, so rows sent are anchors x k x tasks.

Two searches follow each other: positives (same label), then negatives within the windows that the positives set.
Anchors are broadcast ``ANCHORS`` at a time, each block against all rows.

Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part. Rows that share an
id are rows of their own, but no row meets an anchor with its own id. Vectors of different lengths do not meet. Where
products could leave 2**53 they are computed in Python's integers; scores beyond a long are returned as the nearest long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from liftlake.session import materialize

SCALE = 256
LEAF_ROWS = 64
FAN_OUT = 16
SUBTREE_ROWS = 8192
SLAB_ROWS = 32768
#: Anchors of one pass over the rows, and of one walk over a subtree.
ANCHORS = 16_384
WALK = 256
EXACT = float(1 << 53)
LONG = (-(1 << 63), (1 << 63) - 1)

_POINTS = "id long, label int, size int, vec binary, first double"


def scaled_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, label, size, vec (little-endian doubles of ``floor(scale * x)``), first (the first coordinate) of the rows that take part.

    Where ``scale * x`` is beyond a double the value itself has no fraction and is kept unscaled, with ``size`` negative.
    """

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, label, vec in zip(*(batch.column(c) for c in range(3))):
                if not (i.is_valid and label.is_valid and vec.is_valid) or not len(vec) or vec.values.null_count:
                    continue
                x = vec.values.to_numpy().astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    y = np.floor(x * scale)
                fits = np.isfinite(y).all()
                for column, value in zip(out, (i.as_py(), label.as_py(), len(x) if fits else -len(x), (y if fits else x).tobytes(), x[0])):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.float64()))], names=["id", "label", "size", "vec", "first"])

    return vectors.select("id", F.col("label").cast("int"), "vec").mapInArrow(scaled, _POINTS)


def _matrix(size: int, raw: list[bytes], scale: int) -> np.ndarray:
    """Rows of doubles, or of Python integers where doubles could round."""
    flat = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), abs(size))
    if size > 0 and np.abs(flat).max(initial=0) < EXACT:
        return flat
    return np.array([[int(x) * (1 if size > 0 else scale) for x in row] for row in flat], object)


def _tiles(keys: np.ndarray, rows: np.ndarray, axis: int) -> Iterator[np.ndarray]:
    """Sort-tile-recursive: slabs along one coordinate, each tiled along the next, down to leaves."""
    leaves = -(-len(rows) // LEAF_ROWS)
    if leaves <= 1 or axis >= keys.shape[1]:
        yield rows
        return
    rows = rows[np.argsort(keys[rows, axis], kind="stable")]
    rest = keys.shape[1] - axis
    slabs = min(leaves, max(2, round(leaves ** (1 / rest))))
    step = -(-leaves // slabs) * LEAF_ROWS
    for at in range(0, len(rows), step):
        yield from _tiles(keys, rows[at : at + step], axis + 1)


def packed_tree(points: DataFrame) -> DataFrame:
    """The points in the order of their leaves, written; ``leaf`` numbers the leaves of a slab."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slab(table: pa.Table) -> Iterator[pa.RecordBatch]:
            label, size = table["label"].to_numpy(), table["size"].to_numpy()
            order, leaf = [], []
            for a, b in _runs(np.stack([size, label], 1)):
                flat = np.frombuffer(b"".join(table["vec"].slice(a, b - a).to_pylist()), np.float64).reshape(b - a, -1)
                for rows in _tiles(flat, np.arange(b - a), 0):
                    leaf += [len(leaf) and leaf[-1] + 1] * len(rows)
                    order.append(rows + a)
            yield from table.take(np.concatenate(order)).append_column("leaf", pa.array(leaf, pa.int64())).combine_chunks().to_batches(max_chunksize=SUBTREE_ROWS)

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLAB_ROWS):
                held.append(batch.slice(at, SLAB_ROWS))
                n += held[-1].num_rows
                if n >= SLAB_ROWS:
                    yield from slab(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield from slab(pa.Table.from_batches(held))

    total = points.count()
    spark = points.sparkSession
    slabs = max(spark.sparkContext.defaultParallelism, -(-total // (4 * SLAB_ROWS)))
    dealt = points.repartitionByRange(slabs, "size", "label", "first", F.xxhash64("id")).sortWithinPartitions("size", "label", "first", F.xxhash64("id"))
    return materialize(dealt.mapInArrow(pack, _POINTS + ", leaf long"))


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal rows."""
    if len(keys):
        cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
        yield from zip(cuts.tolist(), np.append(cuts[1:], len(keys)).tolist())


class _Node:
    """A minimum bounding box over the coordinates and the labels, with children or a range of rows."""

    __slots__ = ("low", "high", "labels", "children", "rows")

    def __init__(self, low, high, labels, children=(), rows=None):
        self.low, self.high, self.labels, self.children, self.rows = low, high, labels, children, rows


def _subtree(matrix: np.ndarray, labels: np.ndarray, leaf: np.ndarray) -> _Node:
    level = []
    for a, b in _runs(np.stack([leaf, labels], 1)):
        for lo in range(a, b, LEAF_ROWS):
            hi = min(lo + LEAF_ROWS, b)
            level.append(_Node(matrix[lo:hi].min(0), matrix[lo:hi].max(0), (labels[lo], labels[lo]), rows=(lo, hi)))
    while len(level) > 1:
        above = []
        for at in range(0, len(level), FAN_OUT):
            part = level[at : at + FAN_OUT]
            low, high = np.min([n.low for n in part], 0), np.max([n.high for n in part], 0)
            above.append(_Node(low, high, (min(n.labels[0] for n in part), max(n.labels[1] for n in part)), part))
        level = above
    return level[0]


def _bounds(anchors: np.ndarray, nodes: list[_Node]) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each anchor in each box."""
    low, high = np.stack([n.low for n in nodes], 1), np.stack([n.high for n in nodes], 1)
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ low + down @ high, up @ high + down @ low


class _Best:
    """The k best (score, id) of each anchor and window. ``low`` and ``high`` are scores, anchors x windows."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.found: list[list[list[tuple]]] = [[[] for _ in row] for row in low]
        # one below the k-th score would do; until k are known it is the window itself
        self.floor = low.copy()

    def add(self, anchor: int, scores: np.ndarray, ids: np.ndarray) -> None:
        for w in range(self.low.shape[1]):
            fits = np.flatnonzero((scores >= self.floor[anchor, w]) & (scores <= self.high[anchor, w]))
            if len(fits):
                if len(fits) > self.k:
                    fits = fits[np.lexsort((ids[fits], -scores[fits]))[: self.k]]
                top = sorted(self.found[anchor][w] + [(-int(s), int(i)) for s, i in zip(scores[fits], ids[fits])])[: self.k]
                self.found[anchor][w] = top
                if len(top) == self.k:
                    self.floor[anchor, w] = max(self.floor[anchor, w], -top[-1][0])


def _walk(root: _Node, matrix: np.ndarray, ids: np.ndarray, labels: np.ndarray, anchors: dict, best: _Best, chosen: np.ndarray, same: bool) -> None:
    """One block of anchors (``chosen``) through one subtree, the node with the highest bound first."""
    vectors, own, kind = anchors["vectors"][chosen], anchors["ids"][chosen], anchors["labels"][chosen]

    def interested(mine: np.ndarray, least: np.ndarray, most: np.ndarray, node: _Node) -> np.ndarray:
        rows = chosen[mine]
        inside = ((most[:, None] >= best.floor[rows]) & (least[:, None] <= best.high[rows])).any(1)
        if same:
            return inside & (kind[mine] >= node.labels[0]) & (kind[mine] <= node.labels[1])
        return inside & ~((kind[mine] == node.labels[0]) & (kind[mine] == node.labels[1]))

    everyone = np.arange(len(chosen))
    least, most = _bounds(vectors, [root])
    queue: list[tuple] = [(-most[:, 0].max(), 0, root, everyone, least[:, 0], most[:, 0])]
    ticket = 0
    while queue:
        _, _, node, mine, least, most = heapq.heappop(queue)
        on = interested(mine, least, most, node)
        mine = mine[on]
        if not len(mine):
            continue
        if node.rows is None:
            least, most = _bounds(vectors[mine], node.children)
            for c, child in enumerate(node.children):
                on = interested(mine, least[:, c], most[:, c], child)
                if on.any():
                    ticket += 1
                    heapq.heappush(queue, (-most[on, c].max(), ticket, child, mine[on], least[on, c], most[on, c]))
            continue
        a, b = node.rows
        scores = vectors[mine] @ matrix[a:b].T
        near = (scores[:, :, None] >= best.floor[chosen[mine]][:, None, :]) & (scores[:, :, None] <= best.high[chosen[mine]][:, None, :])
        for m in np.flatnonzero(near.any((1, 2))):
            at = mine[m]
            fits = (ids[a:b] != own[at]) & ((labels[a:b] == kind[at]) == same)
            if fits.any():
                best.add(chosen[at], scores[m][fits], ids[a:b][fits])


def _search(tree: DataFrame, anchors: list[dict], k: int, same: bool, scale: int) -> DataFrame:
    """no, window, score, id: the k best of each anchor's windows in each task. ``anchors`` are of one length each."""
    loaded = tree.sparkSession.sparkContext.broadcast(anchors)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = loaded.value
        best = [_Best(b["low"], b["high"], k) for b in blocks]
        for batch in batches:
            for at in range(0, batch.num_rows, SUBTREE_ROWS):
                part = batch.slice(at, SUBTREE_ROWS)
                ids, labels, sizes, leaf = (part.column(c).to_numpy() for c in (0, 1, 2, 5))
                for a, b in _runs(sizes[:, None]):
                    for block, found in zip(blocks, best):
                        if block["size"] != abs(int(sizes[a])):
                            continue
                        matrix = _matrix(int(sizes[a]), part.column(3).slice(a, b - a).to_pylist(), scale)
                        vectors = block["vectors"]
                        if matrix.dtype == object or vectors.dtype == object or np.abs(matrix).max() * np.abs(vectors).max() * matrix.shape[1] >= EXACT:
                            matrix, block = _integers(matrix), block | {"vectors": _integers(vectors)}
                            found.floor, found.high = _integers(found.floor, -np.inf), _integers(found.high, np.inf)
                        root = _subtree(matrix, labels[a:b], leaf[a:b])
                        for first in range(0, len(block["ids"]), WALK):
                            _walk(root, matrix, ids[a:b], labels[a:b], block, found, np.arange(first, min(first + WALK, len(block["ids"]))), same)
        out: tuple[list, ...] = ([], [], [], [])
        for block, found in zip(blocks, best):
            for no, windows in zip(block["no"].tolist(), found.found):
                for w, rows in enumerate(windows):
                    for score, i in rows:
                        for column, x in zip(out, (no, w, str(-score), i)):
                            column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.string(), pa.int64()))], names=["no", "win", "score", "id"])

    # as many tasks as the cluster runs at once, whatever the number of rows: what they send follows the anchors
    tasks = tree.sparkSession.sparkContext.defaultParallelism
    found = tree.coalesce(tasks).mapInArrow(meet, "no long, win int, score string, id long")
    # exact up to 38 digits; longer numbers are ordered by sign and length first
    exact = F.when(F.length("score") <= 38, F.col("score").cast("decimal(38,0)"))
    size = F.when(F.col("score").startswith("-"), -F.length("score")).otherwise(F.length("score"))
    keyed = found.withColumn("digits", F.when(exact.isNull(), size).otherwise(F.lit(0))).withColumn("exact", exact)
    far = F.when(F.col("digits") < 0, -1).when(F.col("digits") > 0, 1).otherwise(0)
    text = F.when(F.col("digits") > 0, F.col("score")).otherwise(F.translate("score", "0123456789", "9876543210"))
    order = [F.desc(far), F.desc(F.col("digits")), F.desc_nulls_last("exact"), F.desc(text), F.col("id")]
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("no", "win").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("no", "win", "rank", "id", "score")


def _integers(values: np.ndarray, free: float | None = None) -> np.ndarray:
    """Doubles as Python integers; ``free`` (an open end of a window) stays as it is."""
    if values.dtype == object:
        return values
    return np.array([[x if x == free else int(x) for x in row] for row in values.tolist()], object).reshape(values.shape)


def _long(text: str) -> int:
    return min(max(int(text), LONG[0]), LONG[1])


def _blocks(rows: list, scale: int, windows) -> list[dict]:
    """Anchor rows as arrays, by vector length; ``windows`` gives the score windows of an anchor's number."""
    out = []
    for size in sorted({r.size for r in rows}):
        mine = [r for r in rows if r.size == size]
        vectors = _matrix(size, [bytes(r.vec) for r in mine], scale)
        low, high = (np.array(x, object) for x in zip(*[zip(*windows(r.no)) for r in mine]))
        if all(abs(x) < EXACT or x in (-np.inf, np.inf) for x in np.concatenate([low.ravel(), high.ravel()])):
            low, high = low.astype(np.float64), high.astype(np.float64)
        out.append({"size": abs(size), "vectors": vectors, "ids": np.array([r.id for r in mine]), "labels": np.array([r.label for r in mine]), "no": np.array([r.no for r in mine]), "low": low, "high": high})
    return out


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` and ``anchors`` have id, label, vec. A positive is one of the first ``positives`` rows of the anchor's label by score
    (then id); its negatives are the first ``negatives`` rows of other labels with ``low * positive <= 100 * negative <= high * positive``.
    """
    spark = vectors.sparkSession
    tree = packed_tree(scaled_vectors(vectors, scale))
    asked = scaled_vectors(anchors, scale).select("*", F.xxhash64("id", "label", "size", "vec").alias("lot"))
    asked = materialize(asked)
    blocks = max(1, -(-asked.count() // ANCHORS))
    found = None
    for block in range(blocks):
        # hashed, so a block is about ANCHORS rows
        rows = asked.where(F.pmod("lot", F.lit(blocks)) == block).orderBy("label", "vec", "id").collect()
        rows = [type(r)(**(r.asDict() | {"no": n})) for n, r in enumerate(rows)]
        if not rows:
            continue
        first = _search(tree, _blocks(rows, scale, lambda no: [(-np.inf, np.inf)]), positives, True, scale).collect()
        chosen: dict[int, list] = {}
        for r in sorted(first, key=lambda r: r["rank"]):
            chosen.setdefault(r.no, []).append((r.id, int(r.score)))
        some = [r for r in rows if r.no in chosen]
        if not some:
            continue
        # an anchor with fewer positives has empty windows in their place
        none = (np.inf, -np.inf)
        windows = {no: [(-(-low * s // 100), high * s // 100) for _, s in of] + [none] * (positives - len(of)) for no, of in chosen.items()}
        hits = _search(tree, _blocks(some, scale, lambda no: windows[no]), negatives, False, scale)
        named = [(r.no, w, r.id, i, _long(str(s))) for r in some for w, (i, s) in enumerate(chosen[r.no])]
        named = spark.createDataFrame(named, "no long, win int, anchor_id long, positive_id long, positive_score long")
        score = F.when(F.length("score") <= 38, F.col("score").cast("decimal(38,0)"))
        nearest = F.when(score.between(*[F.lit(str(x)).cast("decimal(38,0)") for x in LONG]), score.cast("long")).when(F.col("score").startswith("-"), F.lit(LONG[0])).otherwise(F.lit(LONG[1]))
        out = hits.join(F.broadcast(named), ["no", "win"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", nearest.cast("long").alias("negative_score"))
        out = materialize(out) if blocks > 1 else out
        found = out if found is None else found.unionByName(out)
    if found is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return found


def mine_report(embeddings: DataFrame) -> DataFrame:
    """The query's contract: labels of ids divisible by 7 are moved on by one of ten, ids divisible by 50 are anchors."""
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("id"), label.cast("int").alias("label"), F.col("embedding").alias("vec"))
    return hard_negatives(vectors, vectors.where("id % 50 = 0"))
