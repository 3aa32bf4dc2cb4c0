"""Packing documents into training sequences by power-of-two decomposition.

The ids of a document (its tokens, then one end id) are cut into pieces whose
lengths are powers of two: as many of the longest length as fit, then the
binary digits of what is left, longest first. Pieces of one length form a
bucket, so a batch is drawn from one bucket, needs no padding, and no sequence
crosses documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import bounded_batches, slices
from .tokens import Encoder


def binary_pieces(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n ids, longest first. longest is a power of two."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(df: DataFrame, path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (the exponent of length), and ids if asked for.

    Every piece is a sequence of its own, so offset is 0 and there is no
    padding. sequence_id is the task's number and a counter within it: unique,
    and the same when a lost task runs again over the same input split.
    A document of n ids gives at most n / length + log2(length) pieces.

    Null or empty text is a document of the end id alone. Null ids stay null,
    repeated rows are packed each by itself, other columns are not read.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    bounded_batches(df.sparkSession)
    Encoder(path)  # refuses a file of another kind here rather than on the executors
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        sequence = TaskContext.get().partitionId() << 40
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for part in slices(batch, 1):
                ids, at = encoder.texts(part.column(1))
                ids = np.ascontiguousarray(ids.astype("<u4", copy=False))
                owner, start, size, crc, total, kept = [], [], [], [], [], []
                for d, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    own, p = np.concatenate((ids[a:b], end)), 0
                    for k in binary_pieces(len(own), length):
                        owner.append(d)
                        start.append(p)
                        size.append(k)
                        crc.append(zlib.crc32(own[p : p + k]))
                        total.append(len(own))
                        if with_ids:
                            kept.append(own[p : p + k].astype(np.int32))
                        p += k
                n, sizes = len(owner), np.array(size, np.int64)
                columns = [part.column(0).take(pa.array(owner, pa.int64())), pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(np.arange(sequence, sequence + n)), pa.array(np.zeros(n, np.int64)), pa.array(np.log2(sizes).astype(np.int32))]
                sequence += n
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []), names)

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int" + ", ids array<int>" * with_ids
    return df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
