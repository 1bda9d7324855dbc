"""Operator 6: token counts with a digest cache.

Each text's digest, after the normalising steps that provably leave its count alone, is looked up
among stored counts, together with the digest of the tokenizer (file bytes, library and its version).
Only one text of each missing digest is encoded; its count is appended to the cache, and every
document then reads its count from there.

Plan: one shuffle of texts, combined on the map side so that copies leave their task once; the
lookup joins reuse that partitioning or move (id, digest, size) only.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_folder, small_batches, table
from .wordbpe import Splitter, library_encoder

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"


def tokenizer_digest(path: str) -> str:
    """Digest of what decides a count: the file's bytes, the library and its version."""
    if path.endswith(".model"):
        import sentencepiece as lib
    else:
        import tokenizers as lib
    h = hashlib.sha256(f"{lib.__name__} {lib.__version__}\n".encode())
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()


def normalised(text, path: str):
    """Column of a text's normal form: texts with equal forms have equal counts.

    For files that begin with NFC, white space to one space and lower case: runs of ASCII white space
    become one space, and ASCII texts lower case (beyond ASCII, lowering before NFC could change what
    NFC composes). Texts that may hold an added token, which is matched before these steps, and texts
    for other files stay as they are.
    """
    try:
        added = Splitter(path).added
    except (ValueError, KeyError, TypeError, UnicodeDecodeError):
        return text
    if any("<|" not in a for a in added):
        return text
    short = F.regexp_replace(text, r"[\t\n\x0B\f\r ]+", " ")
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(F.contains(text, F.lit("<|")), text).when(plain, F.lower(short)).otherwise(short)


def _size(encoder, text: str) -> int:
    return len(encoder.id_bytes(text)) // 4


_counters: dict[str, object] = {}


def counter(path: str):
    """Function from a list of texts to token counts, one per worker."""
    if path not in _counters:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _counters[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            try:
                library_encoder(path)
                _counters[path] = lambda texts: list(map(_size, repeat(library_encoder(path)), texts))
            except (ValueError, KeyError, TypeError):  # not a word-level file: whole texts go to the library
                from tokenizers import Tokenizer

                library = Tokenizer.from_file(path)
                library.no_truncation()
                library.no_padding()
                _counters[path] = lambda texts: [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    return _counters[path]


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException:  # nothing stored yet
        return None
    return stored.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Token counts of all documents through the cache at folder ``cache``.

    Returns id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (``n_tokens > limit``), one row
    per input row, repeated rows and ids included. Null texts count as empty: 0 bytes, 0 tokens. An
    empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col), text.alias("_text"), F.unhex(F.sha2(normalised(text, tokenizer_path), 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))

    def count(batches):
        tokens = counter(tokenizer_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.asarray(tokens(b.column(1).to_pylist()), dtype="int64"))], ["digest", "n_tokens"])

    distinct = keyed.groupBy("digest").agg(F.first("_text").alias("_text"))
    stored = read_cache(spark, cache, version)
    misses = distinct if stored is None else distinct.join(stored.select("digest"), "digest", "left_anti")
    misses.mapInArrow(count, "digest binary, n_tokens long").withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache, version)
    return keyed.drop("_text").join(counts, "digest").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # a cache of its own, so that each run of this query does all its work
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), new_folder(spark, "token-counts"))
