"""Substring dedup: passages of ``WINDOW`` words and more that stand earlier as well are removed.

Rabin-Karp: the hash of a window is the difference of two prefix sums of word hashes
times powers of an odd base, so each window costs a constant, whatever its width. Equal
windows meet in a bucket chosen by a second hash; there each is counted, and all but the
earliest become removal windows, which merge into maximal intervals per document.

Postings travel as packed blocks (8 bytes of hash, about 1 of place), one block per
bucket and about ``BATCH_BYTES`` of text. What repeats inside such a batch is settled
before the shuffle, so a window that stands in a third of all rows sends one posting per
batch. Buckets hold ``BUCKET_WORDS`` words, so their number grows with the text; beyond
``FANOUT`` of them they are split in two rounds. Two windows are taken for equal if both
hashes agree: 64 bits and the 12 of the bucket.

A document is named by its doc_id and the hash of its text. The order is that of (doc_id,
place of the window), a null doc_id last; windows of equal doc_id and place, as in repeated
rows, are not before one another. A null text has no words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.llm.common import spans_by_bytes, text_buffer
from liftlake.session import materialize

WINDOW = 20
BATCH_BYTES = 16 << 20
#: Text whose words are hashed at a time; a longer text goes in pieces of about this size.
PIECE_BYTES = 1 << 20
BUCKET_WORDS = 4 << 20
FANOUT = 4096
#: Removal intervals that may be broadcast to the texts; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

_BLOCK = "bucket long, ids array<long>, digests array<long>, counts array<int>, starts binary, hashes binary"
_SPANS = "doc_id long, digest long, spans array<int>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_LETTER = np.uint64(0xE7037ED1A0B428DB)
_BASES = [(int(b), pow(int(b), -1, 1 << 64)) for b in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the words before each row."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    first[rows] = inside[rows]
    starts = np.flatnonzero(first)
    before = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), before
    at = np.flatnonzero(inside).astype(np.int32)
    word_of = np.searchsorted(at, starts)
    sizes = np.diff(np.append(word_of, len(at)))
    place = np.arange(len(at), dtype=np.int32) - np.repeat(word_of.astype(np.int32), sizes)
    power = np.full(int(sizes.max()), _LETTER)
    power[0] = 1
    sums = np.add.reduceat(_BYTE[data[at]] * np.multiply.accumulate(power)[place], word_of)
    return _mix(sums + sizes.astype(np.uint64) * _LETTER), before


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text cut at white space into pieces of about ``PIECE_BYTES``; a longer word is not cut."""
    at = 0
    while at < len(data):
        stop = at + PIECE_BYTES
        while stop < len(data):
            near = data[stop : stop + PIECE_BYTES]
            gap = np.flatnonzero((near == 32) | ((near > 8) & (near < 14)))
            if len(gap):
                stop += int(gap[0])
                break
            stop += PIECE_BYTES
        yield data[at:stop]
        at = stop


def _rolled(words: np.ndarray, width: int, base: int, inverse: int) -> np.ndarray:
    """The polynomial hash of each window of ``width`` words, from prefix sums."""
    n = len(words) - width + 1
    powers = np.full(len(words), np.uint64(base))
    powers[0] = 1
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * np.multiply.accumulate(powers), out=sums[1:])
    back = np.full(n, np.uint64(inverse))
    back[0] = 1
    return (sums[width:] - sums[:n]) * np.multiply.accumulate(back)


def _windows(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, second hash, row, place) of every window, some thousand at a time, in the order of rows and places."""
    for lo, hi in spans_by_bytes(offsets, PIECE_BYTES):
        text = data[offsets[lo] : offsets[hi]]
        if hi - lo == 1 and len(text) > PIECE_BYTES:
            held, done = np.zeros(0, np.uint64), 0
            for piece in _pieces(text):
                held = np.concatenate([held, _word_hashes(piece, np.array([0, len(piece)]))[0]])
                n = len(held) - width + 1
                if n > 0:
                    yield *(_mix(_rolled(held, width, *b)) for b in _BASES), np.full(n, lo, np.int32), np.arange(done, done + n, dtype=np.int32)
                    held, done = held[n:], done + n
            continue
        words, before = _word_hashes(text, offsets[lo : hi + 1] - offsets[lo])
        if len(words) < width:
            continue
        sizes = np.diff(before)
        row = np.repeat(np.arange(lo, hi, dtype=np.int32), sizes)
        place = np.arange(len(words), dtype=np.int32) - np.repeat(before[:-1].astype(np.int32), sizes)
        whole = (place + width <= np.repeat(sizes, sizes))[: len(words) - width + 1]
        first, second = (_mix(_rolled(words, width, *b))[whole] for b in _BASES)
        yield first, second, row[: len(whole)][whole], place[: len(whole)][whole]


def _pack(starts: np.ndarray, counts: np.ndarray) -> bytes:
    """Places as differences, low bytes first, so that the shuffle's compression finds the zeros."""
    steps = np.diff(starts, prepend=np.int32(0)).astype(np.uint32)
    steps[np.cumsum(counts) - counts] = starts[np.cumsum(counts) - counts]
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(packed: bytes, counts: np.ndarray) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    sums = np.cumsum(steps, dtype=np.int64)
    first = np.cumsum(counts) - counts
    return (sums - np.repeat(sums[first] - steps[first], counts)).astype(np.int32)


def _blocks(bucket: np.ndarray, hashes: np.ndarray, row: np.ndarray, place: np.ndarray, ids: pa.Array, digests: pa.Array) -> Iterator[pa.RecordBatch]:
    """One row for each bucket; postings come ordered by row and place."""
    order = np.argsort(bucket, kind="stable")
    bucket, hashes, row, place = bucket[order], hashes[order], row[order], place[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    out: list[list] = [[], [], [], [], [], []]
    for a, b in zip(cuts, np.append(cuts[1:], len(bucket))):
        first = np.flatnonzero(np.diff(row[a:b], prepend=-1))
        counts = np.diff(np.append(first, b - a)).astype(np.int32)
        rows = pa.array(row[a:b][first])
        for column, value in zip(out, (bucket[a], ids.take(rows), digests.take(rows), counts, _pack(place[a:b], counts), hashes[a:b].tobytes())):
            column.append(value)
    yield _batch(*out)


def _nested(parts: list, kind: pa.DataType) -> pa.Array:
    parts = [pa.array(p, kind) if not isinstance(p, pa.Array) else p for p in parts]
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(parts) if parts else pa.array([], kind))


def _batch(bucket, ids, digests, counts, starts, hashes) -> pa.RecordBatch:
    arrays = [pa.array(bucket, pa.int64()), _nested(ids, pa.int64()), _nested(digests, pa.int64()), _nested(counts, pa.int32()), pa.array(starts, pa.binary()), pa.array(hashes, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "ids", "digests", "counts", "starts", "hashes"])


def _merged(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Maximal intervals [from, to) of the union, flat."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    first = np.append(True, starts[1:] > stops[:-1])
    last = np.append(first[1:], True)
    return np.stack([starts[first], stops[last]], 1).astype(np.int32).ravel()


def _removals(row: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that lose words, and their intervals; ``row`` and ``place`` need not be ordered."""
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    cuts = np.flatnonzero(np.diff(row, prepend=-1))
    return row[cuts], [_merged(place[a:b], place[a:b] + width) for a, b in zip(cuts, np.append(cuts[1:], len(row)))]


def _postings(docs: DataFrame, buckets: int, width: int) -> DataFrame:
    """Blocks of windows by bucket. A block with a negative bucket holds intervals that its batch alone decides."""

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("digest", "ascending")])).combine_chunks()
        ids, digests = (rows[c].combine_chunks() if rows.num_rows else pa.array([], pa.int64()) for c in ("doc_id", "digest"))
        position = np.cumsum(np.append(False, np.diff(ids.fill_null(0).to_numpy()) != 0) | np.append(False, np.diff(ids.is_valid().to_numpy(zero_copy_only=False).astype(int)) != 0)) if rows.num_rows else np.zeros(0, int)
        again = np.append(False, (np.diff(position) == 0) & (np.diff(digests.to_numpy()) == 0))[: rows.num_rows]
        data, offsets = text_buffer(rows["text"].combine_chunks().filter(pa.array(~again)) if rows.num_rows else pa.array([], pa.string()))
        ids, digests, position = ids.filter(pa.array(~again)), digests.filter(pa.array(~again)), position[~again].astype(np.int32)
        del rows
        found = list(_windows(data, offsets, width))
        if not found:
            return
        hashes, second, row, place = (np.concatenate(c) for c in zip(*found))
        del found
        # equal windows of the batch: the first stands for all, those at its own (doc_id, place) beside it
        order = np.argsort(hashes, kind="stable")
        lead = np.append(True, hashes[order][1:] != hashes[order][:-1])
        head = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
        later = np.zeros(len(order), bool)
        later[order] = (second[order] == second[head]) & ((position[row[order]] != position[row[head]]) | (place[order] != place[head]))
        del order, lead, head
        if later.any():
            lost, spans = _removals(row[later], place[later], width)
            lost = pa.array(lost)
            yield _batch([-1 - int(hashes[0] >> np.uint64(44))], [ids.take(lost)], [digests.take(lost)], [np.array([len(s) for s in spans], np.int32)], [np.concatenate(spans).tobytes()], [b""])
        stay = ~later
        bucket = ((second[stay] >> np.uint64(32)) * np.uint64(min(buckets, FANOUT)) >> np.uint64(32)).astype(np.int16)
        yield from _blocks(bucket, hashes[stay], row[stay], place[stay], ids, digests)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            offsets = text_buffer(batch.column(2))[1]
            for lo, hi in spans_by_bytes(offsets, BATCH_BYTES):
                part = int(offsets[hi] - offsets[lo])
                if size and size + part > BATCH_BYTES:
                    yield from settle(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(batch.slice(lo, hi - lo))
                size += part
        if held:
            yield from settle(pa.Table.from_batches(held))

    out = docs.mapInArrow(pack, _BLOCK)
    if buckets <= FANOUT:
        return out
    finer = -(-buckets // FANOUT)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = pa.Table.from_batches([batch.slice(i, 1)])
                if block["bucket"][0].as_py() < 0:
                    yield block.to_batches()[0]
                    continue
                hashes, doc, place, ids, digests = _unfold(block)
                fine = (hashes.view(np.uint64) % np.uint64(finer)).astype(np.int64)
                yield from _blocks(block["bucket"][0].as_py() * finer + fine, hashes, doc, place, ids, digests)

    return out.repartition("bucket").mapInArrow(split, _BLOCK)


def _unfold(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """hash, index of the document, place of each posting, and the documents."""
    ids, digests = (pa.concat_arrays(blocks[c].chunks).flatten() for c in ("ids", "digests"))
    counts = [np.asarray(c.values) for c in blocks["counts"].combine_chunks()] if blocks.num_rows else []
    hashes = np.concatenate([np.frombuffer(h.as_buffer(), np.int64) for h in blocks["hashes"].combine_chunks()])
    place = np.concatenate([_unpack(s.as_buffer(), c) for s, c in zip(blocks["starts"].combine_chunks(), counts)])
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.concatenate(counts))
    return hashes, doc, place, ids, digests


def _lots(lots: int, ids: pa.Array, digests: pa.Array, spans: list[np.ndarray]) -> pa.Table:
    """Intervals of documents, packed into a row for each lot of documents."""
    lot = (digests.to_numpy().view(np.uint64) % np.uint64(lots)).astype(np.int64)
    order = np.argsort(lot, kind="stable")
    cuts = np.flatnonzero(np.diff(lot[order], prepend=-1))
    out: list[list] = [[], [], [], [], [], []]
    for rows in np.split(order, cuts[1:]) if len(order) else []:
        mine = pa.array(rows)
        counts = np.array([len(spans[r]) for r in rows], np.int32)
        for column, value in zip(out, (lot[rows[0]], ids.take(mine), digests.take(mine), counts, np.concatenate([spans[r] for r in rows]).astype(np.int32).tobytes(), b"")):
            column.append(value)
    return pa.Table.from_batches([_batch(*out)])


def _intervals(blocks: pa.Table) -> tuple[pa.Array, pa.Array, list[np.ndarray]]:
    """Documents and intervals of packed rows."""
    ids, digests = (pa.concat_arrays(blocks[c].chunks).flatten() for c in ("ids", "digests"))
    flat = np.concatenate([np.frombuffer(s.as_buffer(), np.int32) for s in blocks["starts"].combine_chunks()])
    return ids, digests, np.split(flat, np.cumsum(pa.concat_arrays(blocks["counts"].chunks).flatten().to_numpy())[:-1])


def _count_bucket(blocks: pa.Table, width: int, lots: int) -> pa.Table:
    """All windows of a bucket: those equal to an earlier one, as intervals by lot of documents."""
    if blocks["bucket"][0].as_py() < 0:
        return _lots(lots, *_intervals(blocks))
    hashes, doc, place, ids, digests = _unfold(blocks)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    order = order[np.append(same, False) | np.append(False, same)]
    hashes, doc, place = hashes[order], doc[order], place[order]
    # documents ranked by doc_id, nulls last; ties share a rank
    by_id = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="min").to_numpy().astype(np.int64)
    position = (by_id[doc] << 32) | place
    lead = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, int)
    earliest = np.repeat(np.minimum.reduceat(position, lead), np.diff(np.append(lead, len(hashes)))) if len(hashes) else position
    lost, spans = _removals(doc[position > earliest], place[position > earliest], width)
    lost = pa.array(lost, pa.int32())
    return _lots(lots, ids.take(lost), digests.take(lost), spans)


def _merge_lot(blocks: pa.Table) -> pa.Table:
    """The intervals of each document of a lot, from all buckets, merged into maximal ones."""
    ids, digests, spans = _intervals(blocks)
    order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), digests.to_numpy()))
    names = list(zip(digests.take(order).to_pylist(), ids.take(order).to_pylist()))
    cuts = [i for i, name in enumerate(names) if not i or name != names[i - 1]]
    merged = []
    for a, b in zip(cuts, cuts[1:] + [len(names)]):
        flat = np.concatenate([spans[r] for r in order[a:b]]).reshape(-1, 2)
        merged.append(_merged(flat[:, 0], flat[:, 1]))
    first = pa.array(order[cuts])
    return pa.table({"doc_id": ids.take(first), "digest": digests.take(first), "spans": _nested(merged, pa.int32())})


def removal_intervals(docs: DataFrame, width: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """doc_id, digest (``xxhash64`` of the text), spans: from, to, from, to, ... of the words to remove, maximal and ordered.

    Only documents that lose words have a row; repeated rows share one.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    if buckets is None:
        total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(8, total // (6 * BUCKET_WORDS))

    def count(blocks: pa.Table) -> pa.Table:
        return _count_bucket(blocks, width, buckets)

    # a lot of documents is about as large as a bucket of windows
    found = _postings(keyed, buckets, width).groupBy("bucket").applyInArrow(count, _BLOCK)
    return found.groupBy("bucket").applyInArrow(_merge_lot, _SPANS)


def _cut(docs: DataFrame, width: int) -> tuple[DataFrame, str]:
    """``docs`` with a column of intervals, null where nothing goes, and its name."""
    names = iter(f"__{k}" for k in range(len(docs.columns) + 3) if f"__{k}" not in docs.columns)
    spans, by_id, by_text = next(names), next(names), next(names)
    found = materialize(removal_intervals(docs, width).select(F.col("doc_id").alias(by_id), F.col("digest").alias(by_text), F.col("spans").alias(spans)))
    n, ints = found.agg(F.count("*"), F.sum(F.size(spans))).first()
    if n * 48 + (ints or 0) * 4 <= BROADCAST_BYTES:
        found = F.broadcast(found)
    joined = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found[by_id]) & (F.xxhash64(docs["text"]) == found[by_text]), "left")
    return joined.drop(by_id, by_text), spans


def _kept_words(text: str | None, spans) -> tuple[int, int, bytes]:
    """Words, words removed, and the others joined by one space. ``bytes.split`` splits at exactly the white space of the word rule."""
    words = (text or "").encode().split()
    n = len(words)
    if spans is not None:
        spans = spans.as_py()
        for start, stop in zip(spans[-2::-2], spans[::-2]):
            del words[start:stop]
    return n, n - len(words), b" ".join(words)


def without_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` with only the kept words in ``text``, joined by one space; texts that lose nothing stay as they are, null ones too."""
    joined, spans = _cut(docs, width)
    columns = docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            cut = [t if s.as_py() is None else _kept_words(t.as_py(), s)[2].decode() for t, s in zip(texts, batch.column(spans))]
            cut = [t.as_py() if isinstance(t, pa.Scalar) else t for t in cut]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string()) if c == "text" else batch.column(c) for c in columns], names=columns)

    return joined.mapInArrow(rewrite, docs.schema)


def dedup_report(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row. Empty and null texts have no words; a text shorter than a window loses none."""
    joined, spans = _cut(docs.select("doc_id", "text"), width)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, cut in zip(batch.column(1), batch.column(2)):
                n, lost, kept = _kept_words(text.as_py(), cut if cut.is_valid else None)
                rows.append((n, lost, hashlib.sha256(kept).hexdigest()))
            n, lost, digest = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.select("doc_id", "text", spans).mapInArrow(report, "doc_id long, n_words long, n_removed long, kept_sha256 string")
