"""Which texts contain which strings, without comparing every text with every string.

Each string is looked up by one of its grams, the rarest in the texts. Texts are read as UTF-8 bytes, in
which a substring is a run of bytes: a gram is eight bytes, for shorter strings four, two or one. A sketch of
the grams' frequencies chooses the grams, a filter of the chosen ones thins the texts' places; both have a
fixed size. What is left joins strings by gram and is compared byte by byte in the window around it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZES = (8, 4, 2, 1)
SKETCH_BITS, FILTER_BITS = 16, 23
CHUNK = 1 << 20  # bytes of a text that are worked on at a time


def _mixed(grams: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (grams + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        return x * np.uint64(0xD6E8FEB86659FD93)


def _places(grams: np.ndarray, size: int, bits: int) -> np.ndarray:
    return (_mixed(grams, size) >> np.uint64(64 - bits)).astype(np.int64)


def grams_of(data: bytes, size: int) -> np.ndarray:
    """The gram at each place of ``data``, as numbers."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    every = np.ndarray(n, dtype="<u8", buffer=data + bytes(8), strides=(1,))
    return every & np.uint64((1 << 8 * size) - 1) if size < 8 else every.copy()


def gram_size(n: int) -> int:
    return next((s for s in SIZES if s <= n), 0)


def _pieces(text: str, overlap: int):
    """(place, bytes) parts of a text that overlap, so that no gram is lost between two."""
    data = text.encode()
    for i in range(0, max(1, len(data)), CHUNK):
        yield i, data[i : i + CHUNK + overlap]


def _sketch(texts: DataFrame, sizes: list[int]) -> dict[int, np.ndarray]:
    """Frequencies of the grams of each size, by hash: as many numbers as the sketch has places."""

    def run(batches):
        counts = {s: np.zeros(1 << SKETCH_BITS, dtype=np.int64) for s in sizes}
        for b in batches:
            for text in b.column(0).to_pylist():
                for s in sizes:
                    for _, part in _pieces(text, s - 1):
                        counts[s] += np.bincount(_places(grams_of(part, s), s, SKETCH_BITS), minlength=1 << SKETCH_BITS)
        yield pa.RecordBatch.from_pydict({"size": pa.array(sizes, pa.int32()), "counts": pa.array([c.tobytes() for c in counts.values()], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_buffer(), dtype=np.int64) for c in group["counts"])
        return pa.table({"size": group["size"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    # the counts of many partitions meet in two steps, so that no task holds those of all
    parts = texts.mapInArrow(run, "size int, counts binary").withColumn("some", F.spark_partition_id() % 64)
    some = parts.groupBy("size", "some").applyInArrow(add, "size int, counts binary")
    return {r["size"]: np.frombuffer(bytes(r["counts"]), dtype=np.int64) for r in some.groupBy("size").applyInArrow(add, "size int, counts binary").collect()}


def containing(texts: DataFrame, strings: DataFrame, key: str = "path", text: str = "text", value: str = "doi") -> DataFrame:
    """(value, key) for every string of ``strings`` and every text that holds it, once each.

    Strings and texts are compared as they are, so both should be in one case. Empty and null strings,
    null texts and null keys take no part; repeated rows change nothing. Windows are as long as the longest string.
    """
    from pyspark.sql.types import StringType

    needles = strings.select(F.col(value).cast(StringType()).alias("needle")).filter("needle <> ''").distinct()
    body = texts.select(F.col(key).alias("where"), F.col(text).alias("body")).filter(F.col("where").isNotNull() & F.col("body").isNotNull())
    kind = body.schema["where"].dataType.simpleString()
    lengths = needles.groupBy(F.when(F.octet_length("needle") >= 8, 8).when(F.octet_length("needle") >= 4, 4).when(F.octet_length("needle") >= 2, 2).otherwise(1).alias("size"))
    found = {r["size"]: r["longest"] for r in lengths.agg(F.max(F.octet_length("needle")).alias("longest")).collect()}
    if not found:
        return strings.sparkSession.createDataFrame([], f"`{value}` string, `{key}` {kind}")
    sizes, longest = sorted(found), max(found.values())
    sketch = _sketch(body.select("body"), sizes)

    def choose(batches):
        for b in batches:
            rows = []
            for needle in b.column(0).to_pylist():
                data = needle.encode()
                s = gram_size(len(data))
                grams = grams_of(data, s)
                at = int(np.argmin(sketch[s][_places(grams, s, SKETCH_BITS)]))
                rows.append((needle, s, int(grams[at].astype(np.int64)), at, len(data)))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["needle", "size", "gram", "at", "bytes"])

    chosen = needles.mapInArrow(choose, "needle string, size int, gram long, at int, bytes int")

    def mark(batches):
        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        for b in batches:
            for s in sizes:
                own = np.asarray(b.column(0)) == s
                bits[_places(np.asarray(b.column(1))[own].astype(np.uint64), s, FILTER_BITS)] = True
        yield pa.RecordBatch.from_pydict({"bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    def either(group: pa.Table) -> pa.Table:
        return pa.table({"bits": pa.array([np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in group["bits"]]).tobytes()], pa.binary())})

    marks = chosen.select("size", "gram").mapInArrow(mark, "bits binary").withColumn("some", F.spark_partition_id() % 64)
    marks = marks.groupBy("some").applyInArrow(either, "bits binary").groupBy().applyInArrow(either, "bits binary").collect()
    wanted = strings.sparkSession.sparkContext.broadcast(np.unpackbits(np.frombuffer(bytes(marks[0]["bits"]), dtype=np.uint8)).astype(bool))  # 2 ** FILTER_BITS bytes

    def look(batches):
        for b in batches:
            where, size, gram, window, place = [], [], [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                data = t.encode()
                for s in sizes:
                    for begin, part in _pieces(t, s - 1):
                        grams = grams_of(part, s)
                        for i in np.flatnonzero(wanted.value[_places(grams, s, FILTER_BITS)]).tolist():
                            low = max(0, begin + i - longest)
                            where.append(k)
                            size.append(s)
                            gram.append(int(grams[i].astype(np.int64)))
                            window.append(data[low : begin + i + longest])
                            place.append(begin + i - low)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(where, pa.int64())), pa.array(size, pa.int32()), pa.array(gram, pa.int64()), pa.array(window, pa.binary()), pa.array(place, pa.int32())],
                ["where", "s", "g", "window", "place"],
            )

    hits = body.mapInArrow(look, f"where {kind}, s int, g long, window binary, place int")
    start = F.col("place") - F.col("at")
    same = (start >= 0) & (F.substring("window", start + 1, F.col("bytes")) == F.encode("needle", "utf-8"))
    met = hits.join(chosen, (F.col("s") == F.col("size")) & (F.col("g") == F.col("gram"))).filter(same)
    return met.select(F.col("needle").alias(value), F.col("where").alias(key)).distinct()


def notes_containing_doi(articles: DataFrame, notes: DataFrame, key: str = "pos", doi: str = "doi", path: str = "path", text: str = "text") -> DataFrame:
    """(key, doi, path) where exactly one note's text holds the article's DOI anywhere, in any case."""
    from ..functions.text import normalize_doi

    a = articles.select(key, normalize_doi(doi).alias("doi")).filter("doi <> ''")
    lower = notes.select(path, F.lower(text).alias("_text"))
    held = containing(lower, a.select(F.lower("doi").alias("doi")), path, "_text", "doi")
    one = held.groupBy("doi").agg(F.count("*").alias("n"), F.min(path).alias(path)).filter("n = 1").select(F.col("doi").alias("d"), path)
    return a.join(one, F.lower("doi") == F.col("d")).select(key, "doi", path)
