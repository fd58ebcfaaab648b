"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlake.session import materialize

#: White space of the word rule, as bytes and as a pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a function holds apart from its batch, which may be many times as large.
PART_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans_by_bytes(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes; a longer text stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(stop, n)
        start = min(stop, n)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def in_parts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``PART_BYTES`` of that column, since what is made of texts takes several times their room."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        for lo, hi in spans_by_bytes(offsets, PART_BYTES):
            yield batch.slice(lo, hi - lo)


def free_memory() -> None:
    """Hand memory that a task no longer needs back to the system; Python workers outlive their tasks and share the executor's limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of an edge list: node, component (the smallest node reachable).

    Labels shrink by taking the smallest label among neighbours and then the label
    of the label, so long chains close in few rounds. Each round is a written
    table, so a lost executor costs that round only. Sums are combined before the
    shuffle, so a node with very many edges is no hot group.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    both = materialize(pairs.union(pairs.select("v", "u")).distinct())
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = materialize(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        if not step.where("old <> label").limit(1).count():
            return step.select("node", F.col("label").alias("component"))
        labels = step.select("node", "label")
