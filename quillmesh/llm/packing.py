"""Operator 5: packing by power-of-two decomposition.

A document of n ids is cut into pieces of binary lengths, longest first: as many full windows as fit,
then the binary digits of the rest. A piece is a sequence of its own, so no sequence crosses
documents, and as every length is a power of two none is padded. Pieces of equal length form a
bucket, from which batches of equal shape are drawn. The pass is narrow: no shuffle, nothing held
beyond a batch of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table
from .wordbpe import library_encoder

WINDOW = 4096
END_OF_DOCUMENT = 2


def binary_lengths(n: int, window: int) -> list[int]:
    """Powers of two that add up to ``n``, none over ``window`` (itself a power of two), falling."""
    rest = n % window
    return [window] * (n // window) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack_power_of_two(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_OF_DOCUMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut all documents into power-of-two pieces.

    Returns per piece: id, ``start``, ``length``, ``ids`` (little-endian uint32), ``doc_tokens``,
    ``bucket`` (log2 of the length), ``sequence_id`` and ``offset`` (0: a piece fills its sequence).
    Null and empty texts hold only the end id, so each document has at least one piece; repeated rows
    are packed each. Other columns are not read; an empty table gives no pieces.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    tail = end_id.to_bytes(4, "little")

    def run(batches):
        encoder = library_encoder(tokenizer_path)
        for batch in batches:
            row, start, length, total, ids = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                data = encoder.id_bytes(text) + tail
                n, at = len(data) // 4, 0
                for size in binary_lengths(n, window):
                    row.append(k)
                    start.append(at)
                    length.append(size)
                    total.append(n)
                    ids.append(data[4 * at : 4 * (at + size)])
                    at += size
            bucket = np.log2(np.asarray(length, dtype="int64")).round().astype("int32") if length else np.zeros(0, "int32")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array(bucket)],
                [id_col, "start", "length", "ids", "doc_tokens", "bucket"],
            )

    pieces = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, bucket int")
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences as Parquet, one folder per length."""
    pieces.write.partitionBy("bucket").parquet(path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_power_of_two(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
