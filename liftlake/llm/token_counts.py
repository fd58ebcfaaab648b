"""Token counts: texts are encoded in batches of about equal bytes and only lengths come back.

A long text is split where no token can cross: a space after something that is no
space. The vocabulary has no piece with a word mark behind another character, so the
encoding of the whole is that of the parts; the mark that the library puts before a
text stands for the space that was split off.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftlake.llm.common import spans_by_bytes, text_buffer

BATCH_BYTES = 1 << 20
SPLIT_CHARS = 1 << 16
OVER_LIMIT = 4096
_SPACES = " ▁"


@functools.cache
def _encoder(model: str) -> sentencepiece.SentencePieceProcessor:
    encoder = sentencepiece.SentencePieceProcessor(model_file=model)
    marked = (encoder.id_to_piece(i).lstrip("▁") for i in range(encoder.get_piece_size()))
    if any("▁" in piece for piece in marked):
        raise ValueError("the vocabulary has pieces that cross a space; texts cannot be split")
    return encoder


def safe_parts(text: str, size: int = SPLIT_CHARS) -> list[str]:
    """Parts whose token counts add up to the text's."""
    parts, start = [], 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at != -1 and text[at - 1] in _SPACES:
            at = text.find(" ", at + 1)
        if at == -1 or at + 1 >= len(text):
            break
        parts.append(text[start:at])
        start = at + 1
    return [*parts, text[start:]]


def count_tokens(docs: DataFrame, model: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the tokens of ``text`` as one more column; null and empty texts have 0.

    ``model`` is the path of a sentencepiece model on every executor.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
        encoder = _encoder(model)
        for column in batches:
            counts = np.zeros(len(column), np.int64)
            _, offsets = text_buffer(column)
            for lo, hi in spans_by_bytes(offsets, BATCH_BYTES):
                parts, rows = [], []
                for row, value in enumerate(column.slice(lo, hi - lo).to_pylist(), lo):
                    for part in safe_parts(value) if value else ():
                        parts.append(part)
                        rows.append(row)
                for row, ids in zip(rows, encoder.encode(parts, num_threads=1)):
                    counts[row] += len(ids)
            yield pa.array(counts)

    lengths.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(name, F.arrow_udf(lengths, T.LongType())(F.col(text)))


def token_report(docs: DataFrame, model: str, limit: int = OVER_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row. Null text: 0, 0, false. Repeated rows: each returned."""
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return count_tokens(sized, model).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
