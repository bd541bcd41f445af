"""Packing by power-of-two decomposition.

A document's ids (with its end id) are cut into pieces whose lengths are powers of two: as many of the full length as
fit, then the binary digits of the rest, longest first. Each piece is a sequence of its own, so no sequence crosses
documents and none holds padding; a batch takes sequences of one length. Sequences are numbered by length (longest
first), document and start, so equal lengths lie together.

Null text: as an empty one (the end id alone: one piece of length 1). Empty table: no rows. Null ids: packed like
others. Repeated rows or ids: each row is packed; the pieces of one id, length and start are numbered by what they hold. Long texts: whole. Further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravelsift.llm.common import bounded_batches, materialize
from gravelsift.llm.tokens import byte_tokenizer


def cut(n: int, longest: int) -> list[int]:
    """The lengths of the pieces of n ids."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if n % longest >> k & 1]


def split_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int, longest: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit integers), doc_tokens."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = byte_tokenizer(tokenizer_path)
        end = int(end_id).to_bytes(4, "little")
        for frame in frames:
            for k in range(0, len(frame), 500):
                part = frame.iloc[k : k + 500]
                rows = []
                for doc_id, text in zip(part.doc_id.tolist(), part.text, strict=True):
                    data = tokenizer.encode(text).astype("<u4", copy=False).tobytes() + end
                    start, n = 0, len(data) // 4
                    for length in cut(n, longest):
                        rows.append((doc_id, start, length, data[4 * start : 4 * (start + length)], n))
                        start += length
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens"])

    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInPandas(run, "doc_id long, start long, length long, ids binary, doc_tokens long")


def number_sequences(pieces: DataFrame) -> DataFrame:
    """Add sequence_id (from 0, gapless, ordered by length from the longest, document, start) and offset (0) to pieces.

    Pieces are written before they are sorted by ranges over all tasks, as the ranges are found from a pass of their own,
    which would cut all texts again; the sorted ones are written too, and only the rows of each range are counted.
    """
    pieces, _ = materialize(pieces, "pieces-cut")
    ties = [c for c in ("ids_crc32", "ids") if c in pieces.columns][:1]  # rows of one id with different texts
    order = [F.desc("length"), "doc_id", "start", *ties]
    ordered = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    written, _ = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), "pieces")
    at = written.withColumn("_range", F.shiftright("_at", 33))
    counts = sorted(at.groupBy("_range").count().collect())
    first, total = [], 0
    for r, n in counts:
        first.append((int(r), total))
        total += n
    starts = written.sparkSession.createDataFrame(first, "_range long, _first long")
    return (
        at.join(F.broadcast(starts), "_range")
        .withColumn("sequence_id", F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("_at", "_range", "_first")
    )
