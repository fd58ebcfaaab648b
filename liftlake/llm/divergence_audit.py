"""Source divergence audit: how far the term frequencies of sources of a language are apart, and through which terms.

1. Document frequencies are summed in each task and then by (lang, term); terms in at least
   ``least_docs`` documents of their language are kept.
2. The kept terms, range-partitioned and sorted, become minimal acyclic transducers of up to
   ``SHARD_TERMS`` terms. A term's ordinal in its language is that of its shard plus the terms before.
3. All texts stream through the transducers and are counted again by (lang, source, ordinal). Transducers are
   broadcast ``BROADCAST_BYTES`` at a time; a larger vocabulary takes one pass over the texts for each such part.
4. Counts are kept in blocks of ``WIDTH`` ordinals. Pairs of sources meet block by block, ``SOURCES`` against
   ``SOURCES``, in matrices, and terms are ranked with their ordinals as tie-breaks.

Counts of a hot source are summed in rounds of ``FAN_IN`` tasks, so no task reads the blocks of all others.
All arithmetic is in integers. Null lang, source and text are ''. An empty table gives no rows; a group
whose language keeps no terms has pairs of value 0 and no terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from liftlake.llm.common import spans_by_bytes, text_buffer
from liftlake.llm.term_transducer import TermTransducer
from liftlake.session import materialize

LEAST_DOCS = 30
SHARD_TERMS = 1 << 16
BROADCAST_BYTES = 64 << 20
WIDTH = 4096
SOURCES = 64
FAN_IN = 64
TOP_TERMS = 50
SCALE = 1_000_000_000
SMOOTH = 5
#: Distinct (lang, term) or (group, ordinal) pairs a task holds before it sends them.
HELD = 1 << 19
PIECE_BYTES = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_BLOCKS = "lang string, source string, block int, part int, ordinals binary, counts binary"


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of about ``PIECE_BYTES`` that end between terms."""
    at = 0
    while at < len(text):
        stop = at + PIECE_BYTES
        tail = _TERM.match(text, stop - 1) if stop < len(text) else None
        stop = tail.end() if tail else stop
        yield text[at:stop]
        at = stop


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def document_frequencies(docs: DataFrame) -> DataFrame:
    """lang, term, df over all documents; ``docs`` has lang and text without nulls."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for lang, terms in held.items():
                words = pa.array(list(terms), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, pa.array(terms.values(), pa.int64())], names=["lang", "term", "df"])
            held.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer().to_pybytes().translate(_LOWER)
                distinct: set[bytes] = set()
                for piece in (raw,) if len(raw) <= PIECE_BYTES else _pieces(raw):
                    distinct.update(_TERM.findall(piece))
                terms = held.setdefault(lang, Counter())
                size -= len(terms)
                terms.update(distinct)
                size += len(terms)
                if size > HELD:
                    yield from send()
                    size = 0
        yield from send()

    return docs.select("lang", "text").mapInArrow(count, "lang string, term string, df long").groupBy("lang", "term").agg(F.sum("df").alias("df"))


def vocabulary(kept: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """Transducers over the rows (lang, term): lang, low and high (first and last term), terms, transducer."""
    total = kept.count()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        lang = None

        def shard() -> pa.RecordBatch:
            made = TermTransducer.build(held).to_bytes()
            arrays = [pa.array([lang]), pa.array([held[0].decode()]), pa.array([held[-1].decode()]), pa.array([len(held)], pa.int64()), pa.array([made], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "low", "high", "terms", "transducer"])

        for batch in batches:
            for now, term in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if held and (now != lang or len(held) == shard_terms):
                    yield shard()
                    held = []
                lang = now
                held.append(term)
        if held:
            yield shard()

    ordered = kept.select("lang", "term").repartitionByRange(max(1, -(-total // shard_terms)), "lang", "term").sortWithinPartitions("lang", "term")
    return ordered.mapInArrow(build, "lang string, low string, high string, terms long, transducer binary")


class _Part:
    """Transducers that are broadcast together: by language, in order, each with the ordinal of its first term."""

    def __init__(self, shards: list[tuple[str, str, str, int, bytes]]):
        self.raw: dict[str, list[tuple[bytes, bytes, int, bytes]]] = {}
        for lang, low, high, first, made in shards:
            self.raw.setdefault(lang, []).append((low.encode(), high.encode(), first, made))

    def open(self) -> dict[str, list[tuple[int, int, int, TermTransducer]]]:
        head = lambda term: int.from_bytes(term[:8].ljust(8, b"\0"), "big")
        return {lang: [(head(low), head(high), first, TermTransducer.from_bytes(made)) for low, high, first, made in shards] for lang, shards in self.raw.items()}


def _parts(shards: DataFrame) -> tuple[list[list[tuple]], dict[str, int]]:
    """Shards in order, grouped into parts of bounded size, as (lang, low, high, first ordinal, terms); and the terms of each language."""
    listed = shards.select("lang", "low", "high", "terms", F.length("transducer").alias("bytes")).collect()
    sizes: dict[str, int] = {}
    parts, held = [], BROADCAST_BYTES
    for row in sorted(listed, key=lambda r: (r.lang, r.low.encode())):
        if held + row.bytes > BROADCAST_BYTES:
            parts.append([])
            held = 0
        parts[-1].append((row.lang, row.low, row.high, sizes.get(row.lang, 0)))
        held += row.bytes
        sizes[row.lang] = sizes.get(row.lang, 0) + row.terms
    return parts, sizes


def _load(spark: SparkSession, shards: DataFrame, part: list[tuple]):
    """The part's transducers as a broadcast variable."""
    first = {(lang, low): (high, at) for lang, low, high, at in part}
    langs = sorted({p[0] for p in part})
    found = shards.where(F.col("lang").isin(langs) & (F.struct("lang", "low") >= F.struct(F.lit(part[0][0]), F.lit(part[0][1]))) & (F.struct("lang", "low") <= F.struct(F.lit(part[-1][0]), F.lit(part[-1][1]))))
    rows = [(r.lang, r.low, *first[r.lang, r.low], bytes(r.transducer)) for r in found.select("lang", "low", "transducer").collect()]
    return spark.sparkContext.broadcast(_Part(sorted(rows, key=lambda r: (r[0], r[3]))))


def _lookup(shards: list[tuple[int, int, int, TermTransducer]], data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Ordinals in the language; each token goes through the one or two shards whose range holds its first eight bytes."""
    if len(shards) == 1:
        found = shards[0][3].ordinals(data, starts, stops)
        return np.where(found < 0, found, found + shards[0][2])
    head = np.zeros(len(starts), np.uint64)
    for k in range(8):
        inside = starts + k < stops
        head = (head << np.uint64(8)) | np.where(inside, data[np.where(inside, starts + k, 0)], 0).astype(np.uint64)
    order = np.argsort(head, kind="stable")
    head = head[order]
    out = np.full(len(starts), -1, np.int64)
    for low, high, first, made in shards:
        near = order[np.searchsorted(head, np.uint64(low)) : np.searchsorted(head, np.uint64(high), "right")]
        if len(near):
            found = made.ordinals(data, starts[near], stops[near])
            out[near] = np.where(found < 0, out[near], found + first)
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["lang", "source", "block", "part", "ordinals", "counts"])


def _block_rows(lang: str, source: str | None, part: int, ordinals: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """Rows of ascending ordinals, cut into blocks."""
    block = ordinals // WIDTH
    cuts = np.flatnonzero(np.diff(block, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(block))):
        yield lang, source, int(block[a]), part, (ordinals[a:b] % WIDTH).astype(np.uint16).tobytes(), counts[a:b].astype(np.int64).tobytes()


def _counted(docs: DataFrame, loaded) -> DataFrame:
    """Blocks of counts by task of each (lang, source), and of each lang under a null source."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = loaded.value.open()
        task = TaskContext.get().partitionId()
        groups: dict[tuple[str, str], int] = {}
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def fold() -> None:
            codes, place = np.unique(np.concatenate(held), return_inverse=True)
            held[:], counts[:] = [codes], [np.bincount(place, np.concatenate(counts), len(codes)).astype(np.int64)]

        def send() -> Iterator[pa.RecordBatch]:
            fold()
            codes, n = held[0], counts[0]
            names, rows = list(groups), []
            by_lang: dict[str, list[int]] = {}
            for g, (lang, source) in enumerate(names):
                a, b = np.searchsorted(codes, [g << 40, (g + 1) << 40])
                if a < b:
                    rows += _block_rows(lang, source, task, codes[a:b] & ((1 << 40) - 1), n[a:b])
                    by_lang.setdefault(lang, []).append((a, b))
                if len(rows) > 4096:
                    yield _batch(rows)
                    rows = []
            for lang, ranges in by_lang.items():
                ordinals, place = np.unique(np.concatenate([codes[a:b] for a, b in ranges]) & ((1 << 40) - 1), return_inverse=True)
                sums = np.zeros(len(ordinals), np.int64)
                np.add.at(sums, place, np.concatenate([n[a:b] for a, b in ranges]))
                rows += _block_rows(lang, None, task, ordinals, sums)
            if rows:
                yield _batch(rows)
            held.clear()
            counts.clear()
            groups.clear()

        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            named = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for lo, hi in spans_by_bytes(offsets, PIECE_BYTES):
                text = data[offsets[lo] : offsets[hi]]
                pieces = [(text, offsets[lo : hi + 1] - offsets[lo])]
                if hi - lo == 1 and len(text) > PIECE_BYTES:
                    pieces = ((np.frombuffer(p, np.uint8), np.array([0, len(p)])) for p in _pieces(text.tobytes()))
                for piece, ends in pieces:
                    row, starts, stops = _tokens(piece, ends)
                    low = np.frombuffer(piece.tobytes().translate(_LOWER), np.uint8)
                    of_lang: dict[str, list[int]] = {}
                    for r in range(lo, hi):
                        if named[r][0] in shards:
                            of_lang.setdefault(named[r][0], []).append(r - lo)
                    for lang, rows in of_lang.items():
                        group = np.full(hi - lo, -1, np.int64)
                        group[rows] = [groups.setdefault(named[lo + r], len(groups)) for r in rows]
                        mine = group[row] >= 0
                        found = _lookup(shards[lang], low, starts[mine], stops[mine])
                        known = found >= 0
                        codes, n = np.unique((group[row[mine][known]] << 40) | found[known], return_counts=True)
                        held.append(codes)
                        counts.append(n)
                if sum(map(len, held)) > 4 * HELD:
                    fold()
                    if len(held[0]) > 2 * HELD:
                        yield from send()
        if held:
            yield from send()

    return docs.mapInArrow(count, _BLOCKS)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and stop of every term; a term ends where its row does."""
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    stops = np.flatnonzero(inside & (np.append(~inside[1:], True) | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    return np.searchsorted(offsets, starts, "right") - 1, starts, stops


def _summed(blocks: DataFrame, tasks: int) -> DataFrame:
    """Blocks of the same group added up, ``FAN_IN`` tasks at a time."""

    def add(table: pa.Table) -> pa.Table:
        at = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in table["ordinals"].combine_chunks()])
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table["counts"].combine_chunks()])
        sums = np.zeros(WIDTH, np.int64)
        np.add.at(sums, at, n)
        at = np.flatnonzero(sums)
        one = table.slice(0, 1)
        one = one.set_column(4, "ordinals", pa.array([at.astype(np.uint16).tobytes()], pa.binary()))
        return one.set_column(5, "counts", pa.array([sums[at].tobytes()], pa.binary()))

    while True:
        tasks = -(-tasks // FAN_IN)
        part = F.floor(F.col("part") / FAN_IN).cast("int") if tasks > 1 else F.lit(0)
        blocks = blocks.withColumn("part", part).groupBy("lang", "source", "block", "part").applyInArrow(add, _BLOCKS)
        if tasks <= 1:
            return blocks


def recount(docs: DataFrame, shards: DataFrame, parts: list[list[tuple]]) -> DataFrame:
    """Every text streamed through the vocabulary: lang, source (null: the whole lang), block, ordinals, counts; only counts above 0."""
    tasks = docs.rdd.getNumPartitions()
    found = None
    for part in parts:
        blocks = materialize(_summed(_counted(docs, _load(docs.sparkSession, shards, part)), tasks).drop("part"))
        found = blocks if found is None else found.unionByName(blocks)
    if len(parts) > 1:  # a block may lie on the edge of two parts
        found = materialize(_summed(found.withColumn("part", F.lit(0)).select(*[c.split()[0] for c in _BLOCKS.split(", ")]), 1).drop("part"))
    return found


def _shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / total) without leaving 64 bits: three digits of the quotient at a time."""
    rest = counts + SMOOTH
    out = np.zeros(len(rest), np.int64)
    step = 1
    while step < SCALE:
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
        step *= 1000
    return out + 1


def _dense(row: dict) -> np.ndarray:
    """Shares of all ordinals of a block, those that do not occur too."""
    width = min(WIDTH, row["terms"] - row["block"] * WIDTH)
    counts = np.zeros(width, np.int64)
    if row["ordinals"] is not None:
        counts[np.frombuffer(row["ordinals"], np.uint16)] = np.frombuffer(row["counts"], np.int64)
    return _shares(counts, row["total"] + SMOOTH * row["terms"])


def _pair_sums(cells: DataFrame) -> DataFrame:
    """lang, a, b (a < b), value: the distance of two sources, over all terms."""

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["source"].encode())
        same = key[2].as_py() == key[3].as_py()
        left = [r for r in rows if r["mine"] == key[2].as_py()]
        right = left if same else [r for r in rows if r["mine"] == key[3].as_py()]
        out: tuple[list, list, list] = ([], [], [])
        if left and right:
            shares = np.stack([_dense(r) for r in right])
            for i, one in enumerate(left):
                skip = i + 1 if same else 0
                sums = np.abs(shares[skip:] - (shares[i] if same else _dense(one))).sum(1)
                for other, value in zip(right[skip:], sums.tolist()):
                    a, b = sorted((one["source"], other["source"]), key=str.encode)
                    for column, x in zip(out, (a, b, value)):
                        column.append(x)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(out[0]), pa.string()), "a": pa.array(out[0], pa.string()), "b": pa.array(out[1], pa.string()), "value": pa.array(out[2], pa.int64())})

    mine = F.pmod(F.xxhash64("source"), F.col("lots")).cast("int").alias("mine")
    dealt = cells.select("*", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("lots").cast("int") - 1)))
    dealt = dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other")
    return dealt.groupBy("lang", "block", "i", "j").applyInArrow(meet, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _top_terms(cells: DataFrame, top: int) -> DataFrame:
    """lang, source, ordinal, value: of each group and block the ``top`` terms that it uses more than its language does."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for row in batch.to_pylist():
                at = np.frombuffer(row["ordinals"], np.uint16).astype(np.int64)
                p = _shares(np.frombuffer(row["counts"], np.int64), row["total"] + SMOOTH * row["terms"])
                everywhere = np.zeros(WIDTH, np.int64)
                everywhere[np.frombuffer(row["all_ordinals"], np.uint16)] = np.frombuffer(row["all_counts"], np.int64)
                f = p - _shares(everywhere[at], row["all_total"] + SMOOTH * row["terms"])
                best = np.lexsort((at, -f))[:top]
                best = best[f[best] > 0]
                for column, x in zip(out, ([row["lang"]] * len(best), [row["source"]] * len(best), (at[best] + row["block"] * WIDTH).tolist(), f[best].tolist())):
                    column.extend(x)
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["lang", "source", "ordinal", "value"])

    return cells.mapInArrow(choose, "lang string, source string, ordinal long, value long")


def _named(ranked: DataFrame, loaded) -> DataFrame:
    """Ordinals of one part of the vocabulary as terms."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = loaded.value.open()
        firsts = {lang: np.array([s[2] for s in of]) for lang, of in shards.items()}
        for batch in batches:
            terms = []
            for lang, ordinal in zip(batch.column("lang").to_pylist(), batch.column("ordinal").to_pylist()):
                shard = shards[lang][int(np.searchsorted(firsts[lang], ordinal, "right")) - 1]
                terms.append(shard[3].term(ordinal - shard[2]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("source"), pa.array(terms, pa.string()), batch.column("value"), batch.column("rank")], names=["lang", "source", "item", "value", "rank"])

    return ranked.select("lang", "source", "ordinal", "value", "rank").mapInArrow(name, "lang string, source string, item string, value long, rank int")


def divergence_report(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    spark = docs.sparkSession
    docs = _prepared(docs)
    kept = materialize(document_frequencies(docs).where(F.col("df") >= least_docs).select("lang", "term"))
    shards = materialize(vocabulary(kept))
    parts, sizes = _parts(shards)
    groups = docs.select("lang", "source").distinct()
    per_lang = groups.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.ceil(F.col("n") / SOURCES).cast("int").alias("lots"))
    terms = spark.createDataFrame(list(sizes.items()), "lang string, terms long")

    if parts:
        counted = recount(docs, shards, parts)
        n = F.sum(F.expr("total")).alias("total")
        totals = materialize(_block_totals(counted).groupBy("lang", "source").agg(n))
        of_source = totals.where("source is not null")
        groups = groups.join(terms, "lang", "left").join(of_source, ["lang", "source"], "left").join(per_lang, "lang")
        groups = materialize(groups.select("lang", "source", "lots", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total")))
    else:
        groups = materialize(groups.join(per_lang, "lang").withColumn("terms", F.lit(0).cast("long")).withColumn("total", F.lit(0).cast("long")))

    pairs = groups.alias("g").join(groups.alias("h"), (F.col("g.lang") == F.col("h.lang")) & (F.col("g.source") != F.col("h.source")) & (F.col("g.terms") == 0)).select("g.lang", "g.source", F.col("h.source").alias("item"), F.lit(0).cast("long").alias("value"))
    ranked_terms = spark.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    if parts:
        blocks = counted.where("source is not null")
        # a source has a row in every block of its language, also where it has no term
        cells = groups.where("terms > 0").withColumn("block", F.explode(F.expr(f"sequence(0, cast((terms - 1) div {WIDTH} as int))")))
        sums = materialize(_pair_sums(cells.join(blocks, ["lang", "source", "block"], "left")))
        pairs = pairs.unionByName(sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value"))
        pairs = pairs.unionByName(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

        everywhere = counted.where("source is null").select("lang", "block", F.col("ordinals").alias("all_ordinals"), F.col("counts").alias("all_counts"))
        everywhere = everywhere.join(totals.where("source is null").select("lang", F.col("total").alias("all_total")), "lang")
        tops = _top_terms(blocks.join(groups, ["lang", "source"]).join(everywhere, ["lang", "block"]), top)
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
        tops = materialize(tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
        for part in parts:
            # a part is a range of (lang, ordinal)
            after = F.struct("lang", "ordinal") >= F.struct(F.lit(part[0][0]), F.lit(part[0][3]).cast("long"))
            mine = tops.where(after)
            if part is not parts[-1]:
                following = parts[parts.index(part) + 1][0]
                mine = mine.where(F.struct("lang", "ordinal") < F.struct(F.lit(following[0]), F.lit(following[3]).cast("long")))
            ranked_terms = ranked_terms.unionByName(_named(mine, _load(spark, shards, part)).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked_pairs = pairs.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return ranked_pairs.unionByName(ranked_terms)


def _block_totals(counted: DataFrame) -> DataFrame:
    """lang, source, total of each block."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(np.frombuffer(c.as_buffer(), np.int64).sum()) for c in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], names=["lang", "source", "total"])

    return counted.select("lang", "source", "counts").mapInArrow(add, "lang string, source string, total long")
