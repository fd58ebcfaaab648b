"""Secret scans: fixed rules, and character Markov models for what no rule names.

Two models of character pairs, one of random strings and one of ordinary identifiers,
are compared by the log-likelihood ratio over each run of identifier characters. They
are trained from labelled samples in a bounded number of documents: the values that the rules find are
random; ordinary is the text around them, and identifiers in the usual styles (camel case, snake case,
paths, ...) made of its words. Pairs are interpolated with single characters, so a pair that
the samples lack weighs little, and the random model is mixed with an even distribution, so alphabets that they lack count as random.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.llm.common import free_memory, in_parts, spans_by_bytes, text_buffer

BATCH_BYTES = 1 << 20
KINDS = ("assign", "access", "hex", "random")
# The rules.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
RUN_LEAST = 16
#: Characters of a run; the last state is everything else.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Documents that train the models (those of smallest hash).
TRAIN_DOCS = 4_000
EVEN_SHARE = 0.5
#: Share of single characters, and of an even distribution among these, in a model of pairs.
SINGLE_SHARE = 0.1
#: Log-likelihood ratio from which a run counts as a secret. On held-out samples identifiers stay below -8, and
#: 99 of 100 random strings of 20 characters and more with digits or capitals are above 4.
LEAST_RATIO = 4.0
_WORDS = re.compile(rb"[A-Za-z]{2,}")
_LONG_RUN = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % RUN_LEAST)

_STATE = np.full(256, len(ALPHABET), np.uint8)
_STATE[np.frombuffer(ALPHABET, np.uint8)] = np.arange(len(ALPHABET))
_HEX_BYTE = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))


def _joined(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and row starts of batches of texts, with a newline behind each; no rule crosses a newline."""
    data, offsets = text_buffer(texts)
    for lo, hi in spans_by_bytes(offsets, BATCH_BYTES):
        own = offsets[lo : hi + 1] - offsets[lo]
        buffer = np.insert(data[offsets[lo] : offsets[hi]], own[1:], 10)
        yield lo, buffer, own + np.arange(hi - lo + 1)


def _runs(inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def base_spans(buffer: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of what the rules find, by start and then kind."""
    raw = buffer.tobytes()
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw)]
    found += [(int(a), 2, int(b)) for a, b in zip(*_runs(_HEX_BYTE[buffer], 24))]
    return sorted(found)


def identifiers(text: bytes) -> list[bytes]:
    """Identifiers in the usual styles, of a text's own words."""
    words = [w.lower() for w in _WORDS.findall(text)]
    out = []
    for i in range(0, len(words) - 3, 3):
        a, b, c, d = words[i : i + 4]
        styles = (
            lambda: a + b.title() + c.title() + d.title(),
            lambda: a.title() + b.title() + c.title(),
            lambda: b"_".join((a, b, c, d)),
            lambda: b"_".join((a, b, c)).upper(),
            lambda: b"-".join((a, b, c)),
            lambda: b"/".join((a, b, c, d.title())),
            lambda: a + b + c + b"_%d" % (i % 100),
        )
        out.append(styles[i // 3 % len(styles)]())
    return out


def labelled_samples(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """(random, ordinary) strings of a text: the values that the rules find; the text without them, and identifiers of its words.

    Long runs with a digit are what is to be judged, so they teach nothing.
    """
    spans = base_spans(np.frombuffer(text + b"\n", np.uint8))
    random = [ASSIGN.match(text[a:b]).group(2) if kind == 0 else text[a:b] for a, kind, b in spans]
    rest, end = [], 0
    for a, _, b in spans:
        if b > end:
            rest.append(text[end:a])
            end = b
    rest = _LONG_RUN.sub(lambda m: b"\n" if any(48 <= c < 58 for c in m[0]) else m[0], b"\n".join([*rest, text[end:]]))
    return random, [rest, *identifiers(rest)]


def _pairs(strings: list[bytes]) -> np.ndarray:
    size = len(ALPHABET) + 1
    state = _STATE[np.frombuffer(b"\n".join(strings) + b"\n", np.uint8)].astype(np.int64)
    before = np.concatenate([[size - 1], state[:-1]])
    return np.bincount((before * size + state)[state < size - 1], minlength=size * size)


def ratios_of(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratios, random over ordinary, from counts of pairs (kind, before, state)."""
    counts = counts.reshape(2, len(ALPHABET) + 1, len(ALPHABET) + 1)
    single = counts.sum(axis=1) + 0.5
    single = (1 - SINGLE_SHARE) * single / single.sum(axis=1, keepdims=True) + SINGLE_SHARE / len(ALPHABET)
    pair = counts / np.maximum(counts.sum(axis=2, keepdims=True), 1)
    model = (1 - SINGLE_SHARE) * pair + SINGLE_SHARE * single[:, None, :]
    return np.log(EVEN_SHARE / len(ALPHABET) + (1 - EVEN_SHARE) * model[0]) - np.log(model[1])


def train_models(docs: DataFrame, limit: int = TRAIN_DOCS) -> np.ndarray:
    """The table of log-likelihood ratios, random over ordinary, by pair of character states."""
    size = len(ALPHABET) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((2, size * size), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for kind, strings in enumerate(labelled_samples((text or "").encode())):
                    pairs[kind] += _pairs(strings)
        kind, pair = np.nonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(pairs[kind, pair])], names=["kind", "pair", "n"])

    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi").select("text")
    counts = np.zeros((2, size * size))
    for row in sample.mapInArrow(count, "kind int, pair int, n long").groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect():
        counts[row.kind, row.pair] = row.n
    return ratios_of(counts)


def _span_lists(texts: pa.Array, ratios: np.ndarray, least_ratio: float) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of the secrets of each text, in characters."""
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    for lo, buffer, rows in _joined(texts):
        found = base_spans(buffer)
        state = _STATE[buffer].astype(np.int64)
        starts, ends = _runs(state < len(ALPHABET), RUN_LEAST)
        step = ratios[np.concatenate([[len(ALPHABET)], state[:-1]]), state]
        total = np.concatenate([[0.0], np.cumsum(step)])
        letters = np.concatenate([[0], np.cumsum(state < 52)])  # digits alone are a number
        likely = (total[ends] - total[starts] >= least_ratio) & (letters[ends] > letters[starts])
        taken = np.zeros(len(buffer) + 1, np.int32)
        for a, _, b in found:
            taken[a] += 1
            taken[b] -= 1
        covered = np.concatenate([[0], np.cumsum(np.cumsum(taken[:-1]) > 0)])
        free = covered[ends] == covered[starts]
        found = sorted(found + [(int(a), 3, int(b)) for a, b in zip(starts[likely & free], ends[likely & free])])
        of_row = np.searchsorted(rows, [a for a, _, _ in found], "right") - 1
        chars = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])
        for row, (a, kind, b) in zip(of_row, found):
            first = chars[rows[row]]
            spans[lo + row].append((int(chars[a] - first), kind, int(chars[b] - first)))
    return spans


def find_secrets(docs: DataFrame, ratios: np.ndarray, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of each row.

    Null text: as the empty one. A run that touches a rule's span adds nothing. Repeated rows: each returned.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    names = [part.split()[0] for part in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, "text"):
            spans = _span_lists(batch.column(1), ratios, least_ratio)
            count = [[sum(kind == k for _, kind, _ in own) for own in spans] for k in range(4)]
            text = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in own) for own in spans]
            base = [hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in own if k < 3).encode()).hexdigest() for own in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in count], pa.array(base, pa.string()), pa.array(text, pa.string())], names=names)
        free_memory()

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def mask_secrets(docs: DataFrame, ratios: np.ndarray, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """Each row of ``docs`` (text, any other columns) with the characters of its own text's secrets as ``*``. Null text stays null."""
    place = docs.columns.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, "text"):
            texts = batch.column(place).to_pylist()
            for row, spans in enumerate(_span_lists(batch.column(place), ratios, least_ratio)):
                parts, end = [], 0
                for a, _, b in spans:  # ordered; those of two rules may overlap
                    if b > end:
                        parts += [texts[row][end:a], "*" * (b - max(a, end))]
                        end = b
                if parts:
                    texts[row] = "".join(parts) + texts[row][end:]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
        free_memory()

    return docs.mapInArrow(mask, docs.schema)


def secret_report(docs: DataFrame) -> DataFrame:
    """Both steps: models trained on a bounded sample of ``docs``, then every whole text scanned."""
    return find_secrets(docs, train_models(docs))
