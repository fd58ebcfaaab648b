"""Mixing sources to target weights, with DataFrame functions only.

The words of each source's documents form one stream, packed into blocks of
``BLOCK_WORDS``. Output shards draw how many of their slots each source gets; a
source's slots are numbered through all shards, mapped to its blocks through one
pseudorandom permutation of the block numbers for each pass over the source, and the
drawn blocks are joined to the documents by (source, block).

A row is known by a 128-bit digest of all its columns (maps apart), not by its doc_id, so rows without an id and
different rows of one id stay apart. Rows that are alike in all columns are counted as copies and placed one after the other.

The draw is the multinomial one conditioned on the source totals: all slots of the mix
are shuffled by a permutation, and a shard counts the sources among its share. So the
totals meet the targets to the word (plain draws would stray by the square root of the
number of slots), and within a pass a block is taken once at most, so a document is
taken three times at most where targets stop at three times a source. A source's
unfilled last block is the last of each pass; its last slot may be cut.

Permutations are swap-or-not ones: any size, no table, the same on each run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from liftlake.llm.common import WORD
from liftlake.session import materialize

BLOCK_WORDS = 1024
SHARD_SLOTS = 1024
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
ROUNDS = 16
_CELL = 65_536
#: Rows of a bucket of prefix sums, and copies of one row that a task lists.
_BUCKET_ROWS = 2048
_COPIES = 4096
_PRIME = 2_147_483_647


def permuted(index: Column, size: Column, key: Column) -> Column:
    """Where ``index`` goes in a pseudorandom permutation of 0 .. size - 1."""

    def swap(at: Column, r: Column) -> Column:
        pivot = F.pmod(F.pmod(key * 48_271 + r * 16_807 + 11, F.lit(_PRIME)) * 1_103_515_245, size)
        other = F.pmod(pivot - at, size)
        coin = F.pmod(F.pmod(F.greatest(at, other), F.lit(_PRIME)) * (r * 69_621 + 40_692) + key * 39_373 + r, F.lit(_PRIME))
        return F.when(F.pmod(F.floor(coin / 64), F.lit(2)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(ROUNDS).cast("long")), index.cast("long"), swap)


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_no, source_size, target, words (target rounded), slots, first_slot: one row per source.

    A target is weight times one level, or ``max_repeat`` times the source where that is
    less; the level is the one at which all targets add up to all words. In the order of
    limit over weight, the sources below the level come first.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    s = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    s = s.withColumn("source_no", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_no") % len(weights) + 1))
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(max_repeat)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "source_no")
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    before = F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("limit")
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) - before) / rest)
    free = F.col("limit") / F.col("weight") > F.col("level")
    s = s.withColumn("level", F.min(F.when(free, F.struct(F.col("limit") / F.col("weight"), "source_no", "level"))).over(everything)["level"])
    s = s.withColumn("target", F.coalesce(F.least("limit", F.col("weight") * F.col("level")), "limit"))
    s = s.withColumn("words", F.round("target").cast("long"))
    blocks = F.ceil(F.col("source_size") / BLOCK_WORDS)
    passes = F.expr("case when source_size > 0 then words div source_size else 0L end")
    slots = passes * blocks + F.ceil((F.col("words") - passes * F.col("source_size")) / BLOCK_WORDS)
    s = s.withColumn("blocks", blocks).withColumn("slots", slots)
    return s.withColumn("first_slot", F.sum("slots").over(by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("slots"))


def drawn_blocks(targets: DataFrame, seed: int = 7) -> DataFrame:
    """shard, source_no, pass, block, take: the blocks of the mix and how many words of each it takes."""
    spark = targets.sparkSession
    n = targets.agg(F.sum("slots")).first()[0] or 0
    shuffled = spark.range(n).select(F.expr(f"id div {SHARD_SLOTS}").alias("shard"), permuted(F.col("id"), F.lit(max(n, 1)), F.lit(seed)).alias("ticket"))
    shuffled = shuffled.withColumn("cell", F.expr(f"ticket div {_CELL}"))
    held = targets.where("slots > 0").select("source_no", "first_slot", (F.col("first_slot") + F.col("slots")).alias("end_slot"))
    held = held.withColumn("cell", F.explode(F.expr(f"sequence(first_slot div {_CELL}, (end_slot - 1) div {_CELL})")))
    counts = shuffled.join(held, "cell").where("ticket >= first_slot and ticket < end_slot").groupBy("shard", "source_no").agg(F.count("*").alias("drawn"))
    ahead = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = counts.withColumn("first", F.sum("drawn").over(ahead) - F.col("drawn"))
    # a row for each shard and source: their slots are made wherever these rows go
    slots = slots.repartition("shard", "source_no")
    slots = slots.select("shard", "source_no", F.explode(F.expr("sequence(first, first + drawn - 1)")).alias("slot"))
    slots = slots.join(targets.select("source_no", "source_size", "words", "blocks"), "source_no")
    slots = slots.selectExpr("shard", "source_no", "source_size", "words", "slot div blocks as pass", "slot % blocks as place", f"source_size div {BLOCK_WORDS} as filled")
    key = F.col("source_no") * 101 + F.col("pass") * 7 + seed
    block = F.when(F.col("place") < F.col("filled"), permuted(F.col("place"), F.greatest("filled", F.lit(1)), key)).otherwise(F.col("filled"))
    left = F.expr(f"words - pass * source_size - place * {BLOCK_WORDS}")
    length = F.when(F.col("place") < F.col("filled"), F.lit(BLOCK_WORDS)).otherwise(F.expr(f"source_size - filled * {BLOCK_WORDS}"))
    return slots.select("shard", "source_no", "pass", block.alias("block"), F.least(length, left).alias("take"))


def _keys(docs: DataFrame) -> list[Column]:
    """Two independent hashes of a row; nulls are told apart from each other and from empty values."""
    columns = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    flags = [c.isNull() for c in columns]
    return [F.xxhash64(F.lit(no), *flags, *columns).alias(f"__key{no}") for no in (1, 2)]


def _placed(targets: DataFrame, sized: DataFrame) -> DataFrame:
    """Each row's place in its source's stream. Prefix sums go over buckets of rows first, so a hot source is many small groups."""
    rows = sized.join(targets.select("source", "source_no"), sized.source.eqNullSafe(targets.source)).drop(targets.source)
    buckets = max(64, sized.count() // _BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod("__key1", F.lit(buckets))).withColumn("words", F.col("size") * F.col("copies"))
    running = Window.unboundedPreceding, Window.currentRow
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("words").alias("sum"))
    sums = sums.withColumn("base", F.sum("sum").over(Window.partitionBy("source_no").orderBy("bucket").rowsBetween(*running)) - F.col("sum")).drop("sum")
    inside = Window.partitionBy("source_no", "bucket").orderBy("__key1", "__key2").rowsBetween(*running)
    rows = rows.withColumn("inside", F.sum("words").over(inside) - F.col("words"))
    return rows.join(sums, ["source_no", "bucket"]).select("doc_id", "__key1", "__key2", "copies", "source_no", "size", (F.col("base") + F.col("inside")).alias("start"))


def _each_copy(placed: DataFrame) -> DataFrame:
    """A row for each copy, at its own place; very many copies are listed by many tasks."""
    lots = placed.withColumn("lot", F.explode(F.expr(f"sequence(0L, (copies - 1) div {_COPIES})"))).repartition("source_no", "__key1", "lot")
    copy = F.explode(F.expr(f"sequence(lot * {_COPIES}, least(copies, (lot + 1) * {_COPIES}) - 1)"))
    return lots.withColumn("copy", copy).withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("lot", "copies")


def _pieces(placed: DataFrame) -> DataFrame:
    """A row for each block that a document reaches into, with its words there (from, to: inside the block)."""
    reach = F.expr(f"sequence(start div {BLOCK_WORDS}, (start + size - 1) div {BLOCK_WORDS})")
    rows = placed.where("size > 0").withColumn("block", F.explode(reach))
    first = F.col("block") * BLOCK_WORDS
    return rows.withColumn("from", F.greatest("start", first) - first).withColumn("to", F.least(F.col("start") + F.col("size"), first + BLOCK_WORDS) - first)


def _prepared(docs: DataFrame, weights: tuple[float, ...], max_repeat: int) -> tuple[DataFrame, DataFrame]:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", "source", size.alias("size"), *_keys(docs)).groupBy("doc_id", "source", "size", "__key1", "__key2")
    sized = materialize(sized.agg(F.count(F.lit(1)).alias("copies")))
    targets = materialize(source_targets(sized, weights, max_repeat))
    return targets, materialize(_placed(targets, sized))


def mix_report(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of ``docs`` (doc_id, source, text, any other columns).

    Null or wordless texts: size 0, taken 0. Null source: a source of its own, the last.
    Repeated rows: each counts and is returned. Empty table: no rows.
    """
    targets, placed = _prepared(docs, weights, max_repeat)
    drawn = drawn_blocks(targets, seed)
    took = F.when(F.col("take") > F.col("from"), F.least("to", "take") - F.col("from")).otherwise(0)
    copies = _each_copy(placed)
    hits = _pieces(copies).join(drawn.select("source_no", "block", "take"), ["source_no", "block"], "left")
    taken = hits.groupBy("source_no", "start", "doc_id", "size").agg(F.sum(took).alias("taken"))
    rows = taken.select("doc_id", "source_no", "size", "taken").unionByName(copies.where("size = 0").select("doc_id", "source_no", "size", F.lit(0).cast("long").alias("taken")))
    return rows.join(targets.select("source_no", "source_size", "target"), "source_no").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 7) -> DataFrame:
    """The mix as documents: for each pass over its source, what the mix takes of a row, in its order.

    A row that is taken whole keeps its text as it is; of one at the edge of a taken
    block the taken words stay, joined by single spaces (n_chars follows). Columns are those of
    ``docs``; texts without words are taken by no block. Null and shared ids and repeated rows are rows like others.
    """
    targets, placed = _prepared(docs, weights, max_repeat)
    drawn = drawn_blocks(targets, seed)
    hits = _pieces(_each_copy(placed)).join(drawn.select("source_no", "block", "pass", "take"), ["source_no", "block"]).where("least(to, take) > from")
    at = F.col("block") * BLOCK_WORDS - F.col("start")
    part = F.struct((at + F.col("from")).alias("lo"), (at + F.least("to", "take")).alias("hi"))
    parts = hits.groupBy("__key1", "__key2", "copy", "pass", "size").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.sum(F.least("to", "take") - F.col("from")).alias("took"))
    parts = parts.select("__key1", "__key2", F.struct("parts", "took", "size").alias("__mix"))
    keyed = docs.select("*", *_keys(docs))
    repeated = materialize(placed.where("copies > 1 and size > 0").select("__key1", "__key2"))
    if repeated.limit(1).count():
        # copies are placed one by one, so one of the rows stands for all
        by = ["__key1", "__key2"]
        keyed = keyed.join(repeated, by, "left_anti").unionByName(keyed.join(repeated, by, "left_semi").dropDuplicates(by))
    rows = keyed.join(parts, ["__key1", "__key2"])
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("__mix.parts", lambda p: F.slice(words, (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")))), " ")
    rows = rows.withColumn("text", F.when(F.col("__mix.took") == F.col("__mix.size"), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*docs.columns)
