"""N-gram Jaccard join: which documents share so many word shingles that they are near copies.

T-occurrence search. Two sets with Jaccard >= t share at least ``ceil(t * n)``
shingles of either, so of a document's inverted lists all but ``ceil(t * n) - 1``
are *short* ones and any partner occurs in at least one of them; the others are the
*long* ones of DivideSkip. Lists are ranked by (document count where frequent,
hash), one order for all documents, so the long lists of passages that many
documents share are never merged. The short lists are merged by sorting postings by
shingle; the long ones are only probed, by binary search in the sorted set of a
candidate, when its overlap is counted. Shingles are ranked by count for the whole
table, exactly or by the cell of their hash, so that those which texts share by chance
stay out of the short lists however large the table is.

Only the components are asked for, so a list of k copies needs no k * k / 2 pairs:
each list is tied to its first document, links are verified, and only lists whose
documents are still in different components are looked at again, by blocks. No
candidate is dropped: after the second step every pair that shares a short list is
either verified or already connected.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from liftlake.llm.common import PART_BYTES, components, free_memory, in_parts, spans_by_bytes, text_buffer
from liftlake.session import materialize

SHINGLE = 5
THRESHOLD = 75  # per cent
BATCH_BYTES = 1 << 20
#: Frequent shingles whose counts order the lists and whose postings are salted. Any order gives the same links.
FREQUENT = 65_536
#: The others are ordered by how many shingles have the same leading bits, counted to 65,535.
CELL_BITS = 22
CELL_MOST = 65_535
LOTS = 256
LOCAL_REPEATS = 3
LOCAL_BYTES = 16 << 20
SALTS = 64
#: Documents of a list that are always held against each other as pairs, in the second step.
BLOCK = 64
#: Longer lists are held together block by block if they have so many documents in a block on average, else as pairs too.
CROWD = 16
#: Documents and shingles in a block: a task holds two blocks.
BLOCK_DOCS = 512
BLOCK_SHINGLES = 200_000
#: Rows of ids, keys or labels (40 bytes at most) that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word with A-Z lower-cased, and the words before each row."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    inside = (data != 32) & ((data < 9) | (data > 13))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    first[rows] = inside[rows]
    at = np.flatnonzero(inside).astype(np.int32)
    starts = np.flatnonzero(first)
    before = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), before
    word_of = np.searchsorted(at, starts)
    sizes = np.diff(np.append(word_of, len(at)))
    place = np.arange(len(at), dtype=np.int32) - np.repeat(word_of.astype(np.int32), sizes)
    power = np.full(int(sizes.max()), _GOLDEN | np.uint64(1))
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.add.reduceat(_BYTE[low[at]] * power[place], word_of)
    return _mix(sums + sizes.astype(np.uint64) * _GOLDEN), before


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, one without words none."""
    data, offsets = text_buffer(texts)
    sets: list[np.ndarray] = []
    factors = _mix(np.arange(1, width + 1, dtype=np.uint64) + _GOLDEN) | np.uint64(1)
    for lo, hi in spans_by_bytes(offsets, BATCH_BYTES):
        words, before = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        n = max(0, len(words) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled += words[k : k + n] * factors[k]
        rolled = _mix(rolled).view(np.int64)
        for a, b in zip(before[:-1], before[1:]):
            if b - a >= width:
                sets.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:
                short = (words[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                sets.append(_mix(np.array([short], np.uint64)).view(np.int64))
            else:
                sets.append(np.zeros(0, np.int64))
    return sets


def cell_of(hashes: np.ndarray) -> np.ndarray:
    """The cell of each shingle: the leading bits of its hash, so that cells of sorted hashes are sorted."""
    return (hashes >> (64 - CELL_BITS)) + (1 << (CELL_BITS - 1))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal sorted values start, and how long they are."""
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))
    return starts, np.diff(np.append(starts, len(values)))


def _frequent(docs: DataFrame, limit: int) -> np.ndarray:
    """Shingles with the most documents, as (hash, count) columns."""
    return _counted(docs, limit)[0]


def _counted(docs: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles with the most documents, as (hash, count) columns, and how many shingles of all sets each cell has.

    Each task sums what repeats inside ``LOCAL_BYTES`` of its text, over all documents;
    shingles that nowhere repeat locally are not frequent. Bounded by ``limit``.
    Those that repeat only across the table are told from rare ones by their cell: a task counts
    each up to 255 and sends the counts, packed in ``LOTS`` rows, beside its repeats.
    """

    def rows(lots, hashes, counts, cells) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lots, pa.int32()), pa.array(hashes, pa.int64()), pa.array(counts, pa.int64()), pa.array(cells, pa.binary())], names=["lot", "hash", "df", "cells"])

    def repeats(sets: list[np.ndarray], cells: np.ndarray) -> pa.RecordBatch:
        hashes = np.concatenate(sets)
        sets.clear()
        hashes.sort()
        of = cell_of(hashes)
        starts, counts = _runs(of)
        at = of[starts]
        cells[at] = np.minimum(cells[at] + counts, 255)
        del of
        starts, counts = _runs(hashes)
        keep = counts >= LOCAL_REPEATS
        return rows((hashes[starts[keep]] & (LOTS - 1)).astype(np.int32), hashes[starts[keep]], counts[keep], [None] * int(keep.sum()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held, cells = [], 0, np.zeros(1 << CELL_BITS, np.uint8)
        for batch in batches:
            _, offsets = text_buffer(batch.column(0))
            for lo, hi in spans_by_bytes(offsets, PART_BYTES):
                size = offsets[hi] - offsets[lo]
                if sets and held + size > LOCAL_BYTES:
                    yield repeats(sets, cells)
                    held = 0
                sets += shingle_sets(batch.column(0).slice(lo, hi - lo))
                held += size
        if sets:
            yield repeats(sets, cells)
            for lot, part in enumerate(np.split(cells, LOTS)):
                yield rows([lot], [None], [None], [zlib.compress(part.tobytes(), 1)])
        free_memory()

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros((1 << CELL_BITS) // LOTS, np.int64)
        for part in group.column("cells").drop_null():
            total += np.frombuffer(zlib.decompress(part.as_buffer()), np.uint8)
        lot = group.column("lot")[0].as_py()
        found = group.filter(group.column("hash").is_valid()).group_by("hash").aggregate([("df", "sum")]).sort_by([("df_sum", "descending"), ("hash", "ascending")]).slice(0, limit)
        mine = rows([lot], [None], [None], [np.minimum(total, CELL_MOST).astype(np.uint16).tobytes()])
        known = rows([lot] * found.num_rows, found.column("hash").to_numpy(), found.column("df_sum").to_numpy(), [None] * found.num_rows)
        return pa.Table.from_batches([mine, known])

    schema = "lot int, hash long, df long, cells binary"
    lots = docs.select("text").mapInArrow(count, schema).groupBy("lot").applyInArrow(add, schema)
    top = lots.orderBy(F.col("cells").isNull(), F.desc("df"), "hash").limit(limit + LOTS).collect()
    found = np.array([(r.hash, r.df) for r in top if r.cells is None], np.int64).reshape(-1, 2)
    cells = np.zeros((LOTS, (1 << CELL_BITS) // LOTS), np.uint16)
    for r in top:
        if r.cells is not None:
            cells[r.lot] = np.frombuffer(r.cells, np.uint16)
    return found[np.argsort(found[:, 0])], cells.reshape(-1)


def packed_bins(hashes: np.ndarray) -> bytes:
    """How many hashes fall into each of ``K`` bins, four bits a bin, a quarter to half as many bins as hashes.

    Counts above 15 are stored as 15; what is cut is the size of the set less the sum of the bins.
    """
    size = max(2, 1 << max(0, (len(hashes) // 2).bit_length() - 1))
    counts = np.minimum(np.bincount((hashes & (size - 1)).astype(np.int64), minlength=size), 15).astype(np.uint8)
    return (counts[: size // 2] | (counts[size // 2 :] << 4)).tobytes()


def _bins(packed: bytes) -> np.ndarray:
    both = np.frombuffer(packed, np.uint8)
    return np.concatenate([both & 15, both >> 4]).astype(np.int32)


def may_reach(n_one: int, one: bytes, n_other: int, other: bytes, threshold: int) -> bool:
    """Whether two sets can reach the threshold: in no bin can more be common than the smaller count.

    Never false for sets that do. Halves of the finer bins are added until both have as many;
    what was cut from the counts of either is taken as common.
    """
    x, y = _bins(one), _bins(other)
    cut = (n_one - int(x.sum())) + (n_other - int(y.sum()))
    while len(x) > len(y):
        x = x[: len(x) // 2] + x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] + y[len(y) // 2 :]
    return (int(np.minimum(x, y).sum()) + cut) * (100 + threshold) >= (n_one + n_other) * threshold


def _short_lists(docs: DataFrame, frequent: np.ndarray, cells: np.ndarray, threshold: int) -> DataFrame:
    """doc_id, n, key (digest of the set), the document's short lists (hot ones apart) and the bins of the set."""
    schema = "doc_id long, n int, key binary, short array<long>, hot array<long>, bins binary"

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = frequent[:, 0], frequent[:, 1]
        for batch in in_parts(batches, "text"):
            ids, sizes, keys, short, hot, bins = batch.column(0), [], [], [], [], []
            for s in shingle_sets(batch.column(1)):
                n = len(s)
                sizes.append(n)
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bins.append(packed_bins(s))
                rank = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    rank = np.where(known[at] == s, df[at], 0)
                best = np.lexsort((s, rank * (CELL_MOST + 1) + cells[cell_of(s)]))[: n - -(-threshold * n // 100) + 1] if n else np.zeros(0, np.int64)
                is_hot = rank[best] > 0
                short.append(s[best[~is_hot]])
                hot.append(s[best[is_hot]])
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(short, pa.list_(pa.int64())), pa.array(hot, pa.list_(pa.int64())), pa.array(bins, pa.binary())], names=["doc_id", "n", "key", "short", "hot", "bins"])
        free_memory()

    return docs.select("doc_id", "text").mapInArrow(lists, schema)


def small_side(ids: DataFrame) -> DataFrame:
    """A written table of ids, broadcast only behind a check of its number of rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _first_of_class(filled: DataFrame) -> DataFrame:
    """key, first (smallest doc_id) and first_rows (rows with that id) of the sets that several rows have."""
    rows = filled.groupBy("key", "doc_id").agg(F.count("*").alias("rows"))
    found = rows.groupBy("key").agg(F.min(F.struct("doc_id", "rows")).alias("m"), F.sum("rows").alias("rows")).where("rows > 1")
    return small_side(materialize(found.select("key", F.col("m.doc_id").alias("first"), F.col("m.rows").alias("first_rows"))))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the given documents; the ids are broadcast only behind a check of their number."""
    return docs.join(small_side(materialize(ids)), "doc_id", "left_semi").select("doc_id", "text")


def _occurring(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose whole sets, by the counts in their bins, may share enough to reach the threshold.

    Only the bins travel, an eighth to a quarter of a byte for each shingle; most pairs that
    merely share a passage end here, before any text is moved.
    """
    pairs = materialize(pairs)
    ids = small_side(materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()))
    own = materialize(sets.join(ids, "doc_id", "left_semi").select("doc_id", "n", "bins").distinct())
    both = pairs.join(own.toDF("a", "na", "bins_a"), "a").join(own.toDF("b", "nb", "bins_b"), "b").select("a", "b", "na", "bins_a", "nb", "bins_b")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in range(2, 6)))
            keep = pa.array([may_reach(*row, threshold) for row in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    return both.mapInArrow(probe, "a long, b long").distinct()


def _reaches(one: np.ndarray, other: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets reach the Jaccard threshold; the shorter one probes the longer by binary search."""
    small, large = (one, other) if len(one) < len(other) else (other, one)
    if not len(small) or 100 * len(small) < threshold * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= threshold * (len(small) + len(large) - both)


def _linked_in_blocks(meeting: DataFrame, members: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Links between documents of different components, for all documents of each two blocks that meet.

    A block's texts travel once for each block it meets, not once for each pair.
    """
    met = meeting.select(F.col("left").alias("block")).union(meeting.select("right")).distinct()
    rows = materialize(members.join(met, "block", "left_semi"))
    rows = materialize(rows.join(_texts(docs, rows.select("doc_id").distinct()), "doc_id"))
    left = meeting.join(rows, meeting.left == rows.block).select("left", "right", "block", "doc_id", "component", "text")
    right = meeting.where("left <> right").join(rows, F.col("right") == rows.block).select("left", "right", "block", "doc_id", "component", "text")

    def link(group: pa.Table) -> pa.Table:
        block, ids, label = (group.column(c).to_numpy() for c in ("block", "doc_id", "component"))
        sets = shingle_sets(group.column("text").combine_chunks())
        same = group.column("left")[0].as_py() == group.column("right")[0].as_py()
        sizes = np.array([len(s) for s in sets])
        found = []
        for i in range(len(ids)):
            open_to = (label[i + 1 :] != label[i]) & (ids[i + 1 :] != ids[i]) & (100 * np.minimum(sizes[i + 1 :], sizes[i]) >= threshold * np.maximum(sizes[i + 1 :], sizes[i]))
            if not same:
                open_to &= block[i + 1 :] != block[i]
            found += [(ids[i], ids[j]) for j in np.flatnonzero(open_to) + i + 1 if _reaches(sets[i], sets[j], threshold)]
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return left.union(right).groupBy("left", "right").applyInArrow(link, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    pairs = materialize(pairs)
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = materialize(_texts(docs, ids))
    rows = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    rows = rows.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "text_a", "b", "text_b")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, "text_b"):
            linked = []
            left = batch.column(1).dictionary_encode() if batch.num_rows else None
            lefts = shingle_sets(left.dictionary) if left is not None else []
            for i, right in enumerate(shingle_sets(batch.column(3))):
                one = lefts[left.indices[i].as_py()]
                if _reaches(one, right, threshold):
                    linked.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(linked, pa.int32())), batch.column(2).take(pa.array(linked, pa.int32()))], names=["a", "b"])
        free_memory()

    return rows.mapInArrow(probe, "a long, b long").distinct()


def overlap_groups(docs: DataFrame, threshold: int = THRESHOLD, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text, any other columns).

    * Rows without text or words: 0 shingles, their own component.
    * Equal sets: one class, linked to its smallest doc_id; a class of any size is one node of the join.
    * Repeated rows: one result row each. A doc_id with several texts is one node with the links of all of them.
    * Null doc_id: counted, component null, links with nothing. Empty table: no rows.
    """
    docs = docs.select("doc_id", "text")
    sets = materialize(_short_lists(docs, *_counted(docs, frequent), threshold))

    # one node for equal sets: the lists of its other rows are not moved
    filled = sets.where("n > 0 and doc_id is not null")
    firsts = _first_of_class(filled)
    placed = filled.join(firsts, "key", "left").where("first is null or doc_id = first")
    classes = placed.where("first_rows is null or first_rows = 1").select("doc_id", "n", "short", "hot")
    again = placed.where("first_rows > 1").groupBy("key").agg(F.min(F.struct("doc_id", "n", "short", "hot")).alias("m")).select("m.*")
    classes = classes.union(again)
    postings = classes.select("doc_id", "n", F.size("short").alias("cold"), F.posexplode(F.concat("short", "hot")).alias("at", "hash"))
    must = F.expr(f"n - cast(ceil({2 * threshold} * n / {100 + threshold}D) as int) + 1")
    salt = F.when(F.col("at") < F.col("cold"), 0).otherwise(F.pmod("doc_id", F.lit(SALTS)) + 1).cast("int")
    postings = postings.select("hash", salt.alias("salt"), "doc_id", "n", (F.col("at") < must).alias("strong"))

    # of two linked sets the smaller one has a common shingle among its strong ones: others of a list meet nobody there
    whole = Window.partitionBy("hash", "salt").orderBy("doc_id", "n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = postings.withColumn("least", F.min(F.when(F.col("strong"), F.col("n"))).over(whole)).where("strong or salt > 0 or n >= least")

    # every list tied to its first document; a hot list is cut into salted parts first, then tied to the first of their firsts
    running = Window.partitionBy("hash", "salt").orderBy("doc_id", "n")
    tied = kept.withColumn("head", F.first(F.struct("doc_id", "n")).over(running))
    tied = materialize(tied.where("head.doc_id <> doc_id or salt > 0"))
    parts = tied.where("salt > 0").groupBy("hash", "salt").agg(F.min("head").alias("part"), F.min("least").alias("part_least"))
    every = Window.partitionBy("hash").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("hash", "salt", F.first("part").over(every).alias("top"), F.min("part_least").over(every).alias("all_least"))
    stars = tied.join(parts, ["hash", "salt"], "left").where("salt = 0 or strong or n >= all_least").select("hash", "doc_id", "n", "strong", F.coalesce("top", "head").alias("head"))
    stars = materialize(stars.where("head.doc_id <> doc_id").select("hash", F.col("head.doc_id").alias("first"), F.col("head.n").alias("head_n"), "doc_id", "n", "strong").withColumnRenamed("first", "head"))

    near_size = f"100 * least(n, head_n) >= {threshold} * greatest(n, head_n)"
    near = stars.where(near_size).select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = materialize(_verified(_occurring(near, sets, threshold), docs, threshold))

    # lists whose documents are still apart
    label = small_side(components(links).select(F.col("node").alias("doc_id"), "component"))
    nodes = stars.select("hash", F.col("head").alias("doc_id"), F.col("head_n").alias("n"), F.lit(True).alias("strong"), "head").distinct()
    nodes = nodes.union(stars.select("hash", "doc_id", "n", "strong", "head"))
    nodes = nodes.join(label, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    apart = nodes.groupBy("hash").agg(F.count("*").alias("docs"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("hash", "docs")
    still = materialize(nodes.join(apart, "hash"))

    # long ones: blocks of documents under one head. A list whose documents are strewn over many blocks is one of pairs:
    # blocks that meet for a few documents would move all their texts
    many = still.where(F.col("docs") > BLOCK)
    tops = many.groupBy("doc_id", "component").agg(F.min("head").alias("top"), F.max("n").alias("n"))
    sizes = tops.groupBy("top").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    tops = materialize(tops.join(sizes, "top").select("doc_id", "component", F.xxhash64("top", F.pmod(F.xxhash64("doc_id"), "parts")).alias("block")))
    of_list = materialize(many.select("hash", "docs", "doc_id").join(tops, "doc_id").groupBy("hash", "docs", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi")))
    crowded = materialize(of_list.groupBy("hash").agg(F.max("docs").alias("docs"), F.count("*").alias("blocks")).where(f"docs >= {CROWD} * blocks").select("hash"))

    # the other ones: the pairs themselves
    few = still.join(crowded, "hash", "left_anti")
    l, r = few.select("hash", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("strong").alias("sa"), F.col("component").alias("ca")), few.select("hash", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("strong").alias("sb"), F.col("component").alias("cb"))
    open_pairs = l.join(r, "hash").where("a < b and ca <> cb").where(f"na <= nb and sa and 100 * na >= {threshold} * nb or nb <= na and sb and 100 * nb >= {threshold} * na")
    more = materialize(_verified(_occurring(open_pairs.select("a", "b").distinct(), sets, threshold), docs, threshold))

    # blocks meet where they share a list
    of_list = of_list.join(crowded, "hash", "left_semi")
    l, r = of_list.select("hash", F.col("block").alias("left"), F.col("lo").alias("l1"), F.col("hi").alias("l2")), of_list.select("hash", F.col("block").alias("right"), F.col("lo").alias("r1"), F.col("hi").alias("r2"))
    meeting = l.join(r, "hash").where("left <= right and (l1 <> r2 or l2 <> r1)").select("left", "right").distinct()
    more = more.union(materialize(_linked_in_blocks(materialize(meeting), tops, docs, threshold)))

    # copies join their class, and a doc_id with several texts ties their classes
    own = filled.select("doc_id", "key").join(firsts, "key").select("doc_id", "first").where("doc_id <> first")
    nodes = components(links.union(more).union(own.select(F.col("first").alias("a"), F.col("doc_id").alias("b"))))
    out = sets.select("doc_id", F.col("n").cast("long").alias("n_shingles"))
    out = out.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
