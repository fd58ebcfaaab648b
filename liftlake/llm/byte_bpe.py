"""Byte-level BPE encoding and decoding.

A text is cut into matches of the vocabulary's pattern (words). A word's bytes are its
first parts; among neighbouring parts the pair whose bytes have the lowest rank is
joined, the leftmost first, until no pair has a rank. The merges of all new distinct
words of a batch are folded together, one merge of each word a round, as array
operations; a task keeps a bounded table of words it has met. Decoding concatenates
the pieces of the ids.

The fold by Spark's higher-order functions over a literal rank map gave the same ids but
took hundreds of core microseconds a distinct word, see README; this form runs in Arrow
functions instead. Each row is worked on where it is read: no shuffle.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from liftlake.llm.common import free_memory, spans_by_bytes, text_buffer

BATCH_BYTES = 1 << 20
#: Parts of words (8 bytes each, in some ten arrays) that are merged at a time.
TABLE_PARTS = 1 << 16
#: Words a task remembers; beyond that it starts anew.
KNOWN_WORDS = 200_000
# Fixed value: white space as Unicode has it, for the pattern's \s.
_SPACE = r"\t-\r \x85\xa0  -     　"


class BytePairs:
    """A vocabulary: pieces by rank, and what each pair of pieces that makes a piece is joined to."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = len(self.pieces)
        pairs = [(ranks[p[:i]] * self.size + ranks[p[i:]], r) for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks]
        table = np.array(sorted(pairs), np.int64)
        self.pairs, self.joined = table[:, 0].copy(), table[:, 1].copy()
        self.words = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))
        self.known: dict[str, bytes] = {}

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (of one byte or more)."""
        done: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        length = np.array([len(w) for w in words], np.int64)
        # words of about one length fill a table; a long one is a table of its own
        for low in sorted({int(n).bit_length() for n in length}):
            group = np.flatnonzero((length >= 1 << (low - 1)) & (length < 1 << low))
            step = max(1, TABLE_PARTS >> low)
            for at in range(0, len(group), step):
                rows = group[at : at + step]
                for row, ids in zip(rows, self._fold([words[r] for r in rows])):
                    done[row] = ids
        return done

    def _fold(self, words: list[bytes]) -> list[np.ndarray]:
        length = np.array([len(w) for w in words], np.int64)
        ids = np.full((len(words), int(length.max())), -1, np.int64)
        ids[np.arange(ids.shape[1]) < length[:, None]] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        none = self.size
        rank = np.full((len(words), ids.shape[1]), none, np.int64)
        rank[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(words))
        result: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        while len(live):
            best = rank.argmin(axis=1)
            row = np.arange(len(live))
            value = rank[row, best]
            over = value == none
            for r in np.flatnonzero(over):
                result[live[r]] = ids[r, : length[r]].copy()
            if over.any():
                keep = ~over
                ids, rank, live, length, best, value = ids[keep], rank[keep], live[keep], length[keep], best[keep], value[keep]
                row = np.arange(len(live))
                if not len(live):
                    break
            # close the gap behind the joined pair
            shift = np.arange(ids.shape[1])[None, :-1] > best[:, None]
            ids[:, :-1] = np.where(shift, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(shift, rank[:, 1:], rank[:, :-1])
            ids[:, -1], rank[:, -1] = -1, none
            ids[row, best] = value
            length -= 1
            after = np.minimum(best + 1, ids.shape[1] - 1)
            rank[row, best] = np.where(after > best, self._rank(ids[row, best], ids[row, after]), none)
            before = np.maximum(best - 1, 0)
            rank[row, before] = np.where(best > 0, self._rank(ids[row, before], ids[row, best]), rank[row, before])
            width = int(length.max())
            if width < ids.shape[1]:
                ids, rank = ids[:, :width], rank[:, :width]
        return result

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joined[at], self.size)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.words.findall(text) for text in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        new = list({w for words in cut for w in words} - self.known.keys())
        for word, ids in zip(new, self.merged([w.encode() for w in new])):
            self.known[word] = ids.astype("<u4").tobytes()
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]

    def forget(self) -> None:
        """Drop the words met, at the end of a task: workers outlive it and share the executor's limit with the next stage."""
        self.known.clear()
        free_memory()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def _vocabulary(path: str, pattern: str) -> BytePairs:
    return BytePairs(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of each row. Null and empty texts have none; repeated rows are each returned."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for lo, hi in spans_by_bytes(offsets, BATCH_BYTES):
                own = batch.slice(lo, hi - lo)
                ids = _vocabulary(path, pattern).encode([t or "" for t in own.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
        _vocabulary(path, pattern).forget()

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded (binary) of rows of (doc_id, ids)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.array([_vocabulary(path, pattern).decode(ids) for ids in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), whole], names=["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(decode, "doc_id long, ids binary, decoded binary")


def encoding_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; the decoded bytes are those of the ids, not of the text."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for lo, hi in spans_by_bytes(offsets, BATCH_BYTES):
                own, vocabulary = batch.slice(lo, hi - lo), _vocabulary(path, pattern)
                ids = vocabulary.encode([t or "" for t in own.column(1).to_pylist()])
                digests = [[hashlib.sha256(x).hexdigest() for x in column] for column in (ids, map(vocabulary.decode, ids))]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *map(pa.array, digests)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        _vocabulary(path, pattern).forget()

    return docs.select("doc_id", "text").mapInArrow(report, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
