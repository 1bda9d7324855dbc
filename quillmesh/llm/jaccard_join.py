"""Operator 4: n-gram Jaccard join, size-aware with heavy and light sets.

Documents with equal shingle sets form a class and only classes are joined.

Light sets (fewer shingles than a boundary) emit fixed-size subsets: two sets whose overlap must reach
c share a subset of c shingles, so equal subsets decide the link without looking at the sets again.
Of the sets that share a subset the smallest one links with every other that links with any, so a star
per subset keeps all connections. Heavy sets scan inverted lists: with shingles in one global order,
rare ones first, linked sets meet in the list of one of their first shingles, and length and position
bounds thin the candidates before the sets are intersected. The boundary is the size at which
enumeration would cost more rows than scanning and verifying.

The order comes from a sketch of document frequencies over all documents (its size grows with the
text up to a bound, so it can be sent everywhere); it decides cost, never results. Lists are worked off
in two passes that leave no link out: first every member meets a few leaders of its list (the logarithm
of its length), then only pairs from different components of the first pass meet. Short lists are
joined. Long ones are cut into classes of size, of which only equal and neighbouring ones can link, and
these into blocks; pairs of blocks are compared in place, and only pairs that pass become rows. Before
any set is fetched, candidates are thinned by parity vectors: two sets differ in at least as many
shingles as their vectors differ in bits.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from .components import connected_components
from .shared import Scratch, small_batches, table, worker_starts, written
from .shingles import mix, set_digest, sets_with_digests, shingle_sets

WORDS, PERCENT = 3, 90
SKETCH_BITS = range(21, 25)  # least and most (exclusive) size of the frequency sketch, as a power of two
BLOOM_BITS = range(20, 27)
SLICE_BITS = 15
SHORT_LIST = 16  # members up to which a list is joined with itself
BLOCK_ROWS = 1_024
TILE_ROWS = 256
VERIFY_COST = 32  # rows that scanning and verifying one set costs, against one row per subset
LARGEST_LIGHT = 64
MOST_LEADERS = 16
LEAST_PARITY_BITS = 512


def least_overlap(a, b, percent: int):
    """Smallest overlap with 100 * overlap >= percent * union, for set sizes a and b."""
    return -((-percent * (a + b)) // (100 + percent))


def partner_sizes(n: int, percent: int) -> range:
    return range(-((-percent * n) // 100), 100 * n // percent + 1)


def subset_sizes(n: int, percent: int, below: int) -> list[int]:
    """Overlaps that a light set of size n can need with a light partner."""
    return sorted({least_overlap(n, m, percent) for m in partner_sizes(n, percent) if m < below})


def light_boundary(percent: int) -> int:
    """First size whose subsets outnumber the rows that scanning its prefix and verifying would cost."""
    for n in range(1, LARGEST_LIGHT):
        rows = sum(comb(n, c) for c in subset_sizes(n, percent, LARGEST_LIGHT))
        if rows > prefix_length(n, percent) + VERIFY_COST:
            return n
    return LARGEST_LIGHT


def prefix_length(n: int, percent: int) -> int:
    """Shingles of which one at least is shared with any linked set of any size."""
    return n + ((-percent * n) // 100) + 1


def parity_bits(n: int, percent: int) -> int:
    """Length of a set's parity vector: a power of two, several times the greatest allowed difference."""
    return max(LEAST_PARITY_BITS, 1 << (4 * n * (100 - percent) // percent).bit_length())


def parity_vector(shingles: np.ndarray, percent: int) -> bytes:
    """Bit i: whether an odd number of shingles falls on i. Shorter vectors are folds of longer ones."""
    bits = parity_bits(len(shingles), percent)
    at = (mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """Lower bound of the symmetric difference of two sets by their parity vectors."""
    a, b = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def sized_bits(wanted: int, allowed: range) -> int:
    """Power of two that holds ``wanted`` places, within the allowed sizes."""
    return min(max(int(wanted).bit_length(), allowed[0]), allowed[-1])


def _merged_slices(parts: DataFrame, combine) -> dict[int, np.ndarray]:
    """Combine sparse slices (slice, places, values) of all partitions; the result has a fixed size."""

    def run(group: pa.Table) -> pa.Table:
        total = np.zeros(1 << SLICE_BITS, dtype=np.uint32)
        for places, values in zip(group["places"], group["values"]):
            at = np.frombuffer(places.as_buffer(), dtype="<u2")
            total[at] = combine(total[at], np.frombuffer(values.as_buffer(), dtype="<u4"))
        levels = np.ceil(np.log2(total.astype(np.float64) + 1)).astype(np.uint8)
        return pa.table({"slice": pa.array([group["slice"][0].as_py()], pa.int32()), "levels": pa.array([levels.tobytes()], pa.binary())})

    merged = parts.groupBy("slice").applyInArrow(run, "slice int, levels binary")
    return {r["slice"]: np.frombuffer(bytes(r["levels"]), dtype=np.uint8) for r in merged.collect()}


def _slices(counts: np.ndarray):
    """Sparse slices of a count table as Arrow rows."""
    rows = []
    for s in range(len(counts) >> SLICE_BITS):
        part = counts[s << SLICE_BITS : (s + 1) << SLICE_BITS]
        at = np.flatnonzero(part)
        if len(at):
            rows.append((s, at.astype("<u2").tobytes(), part[at].astype("<u4").tobytes()))
    if rows:
        s, p, v = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(p, pa.binary()), pa.array(v, pa.binary())], ["slice", "places", "values"])


_SEEDS = np.array([0, 1, 0xA0761D6478BD642F], dtype=np.uint64)

SLICE_SCHEMA = "slice int, places binary, values binary"


def frequency_levels(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """log2 of the document frequency of shingles, by the low bits of their hash, over all documents."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = sized_bits(size // 64, SKETCH_BITS)

    def run(batches):
        worker_starts()
        counts = np.zeros(1 << bits, dtype=np.uint32)
        mask = np.uint64(len(counts) - 1)
        for b in batches:
            for s in shingle_sets(b.column(0), words):
                counts[(s & mask).astype(np.int64)] += 1  # two shingles of a set in one place count once
        yield from _slices(counts)

    levels = np.zeros(1 << bits, dtype=np.uint8)
    for s, part in _merged_slices(docs.select(text_col).mapInArrow(run, SLICE_SCHEMA), np.add).items():
        levels[s << SLICE_BITS : (s + 1) << SLICE_BITS] = part
    return levels


def subset_signatures(shingles: np.ndarray, percent: int, below: int, seed: int = 1) -> list[tuple[int, list[int]]]:
    """Signatures of the fixed-size subsets of a light set; a subset's size is part of its signature.

    Two seeds give signatures that collide independently; together they stand for the subset.
    """
    n, out = len(shingles), []
    with np.errstate(over="ignore"):
        parts = mix(shingles * _SEEDS[seed] + np.uint64(seed))
        whole = parts.sum(dtype=np.uint64)
        for c in subset_sizes(n, percent, below):
            gone = list(combinations(range(n), n - c))
            sums = whole - (parts[np.array(gone)].sum(axis=1, dtype=np.uint64) if n > c else np.zeros(1, np.uint64))
            out.append((c, mix(sums ^ (np.uint64(c) * np.uint64(0x9E3779B97F4A7C15))).astype(np.int64).tolist()))
    return out


def signatures(docs: DataFrame, levels, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(id, n, d1, d2, prefix, subsets, seconds, overlaps, parity) per document, in one narrow pass."""
    kind = docs.schema[id_col].dataType.simpleString()
    below = light_boundary(percent)
    least_heavy = min(partner_sizes(below, percent))  # lighter sets never link with a heavy one

    def run(batches):
        worker_starts()
        mask = np.uint64(len(levels.value) - 1)
        for b in batches:
            n, d1, d2, prefix, subsets, seconds, overlaps, parity = [], [], [], [], [], [], [], []
            for s, only in sets_with_digests(b.column(1), words):
                n.append(len(s))
                x = set_digest(s, only)
                d1.append(int(x[0]))
                d2.append(int(x[1]))
                if len(s) >= least_heavy:
                    # rare shingles first; a level is a power of two of the frequency
                    rank = levels.value[(s & mask).astype(np.int64)].astype(np.uint64)
                    need = prefix_length(len(s), percent)
                    edge = np.partition(rank, need - 1)[need - 1]
                    few = s[rank <= edge]
                    order = np.lexsort((few, rank[rank <= edge]))[:need]
                    prefix.append(few[order].astype(np.int64))
                    parity.append(parity_vector(s, percent))
                else:
                    prefix.append(None)
                    parity.append(None)
                # one shingle links with its equal only, above one half, and equal sets are one class
                light = (1 if percent > 50 else 0) < len(s) < below
                found, again = (subset_signatures(s, percent, below, seed) if light else [] for seed in (1, 2))
                subsets.append([x for _, xs in found for x in xs] or None)
                seconds.append([x for _, xs in again for x in xs] or None)
                overlaps.append([c for c, xs in found for _ in xs] or None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(subsets, pa.list_(pa.int64())), pa.array(seconds, pa.list_(pa.int64())), pa.array(overlaps, pa.list_(pa.int32())), pa.array(parity, pa.binary())],
                [id_col, "n", "d1", "d2", "prefix", "subsets", "seconds", "overlaps", "parity"],
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n long, d1 long, d2 long, prefix array<bigint>, subsets array<bigint>, seconds array<bigint>, overlaps array<int>, parity binary")


def _needed(a, b, percent: int):
    """Least overlap of sizes a and b, as a column."""
    return F.ceil(F.lit(percent) * (F.col(a) + F.col(b)) / F.lit(100 + percent) - F.lit(1e-9))


def _bloom(ids: DataFrame, bits: int) -> np.ndarray:
    """Filter of 2**bits places for the ids in column ``id``; a false hit costs work, never a wrong result."""

    def run(batches):
        seen = np.zeros(1 << bits, dtype=bool)
        for b in batches:
            seen[_places(b.column(0).to_numpy(), bits)] = True
        yield from _slices(seen)

    out = np.zeros(1 << bits, dtype=bool)
    for s, part in _merged_slices(ids.mapInArrow(run, SLICE_SCHEMA), np.maximum).items():
        out[s << SLICE_BITS : (s + 1) << SLICE_BITS] = part > 0
    return np.packbits(out)


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parity vectors allow a link."""

    @F.pandas_udf("boolean")
    def close(n: pd.Series, m: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        allowed = n + m - 2 * least_overlap(n, m, percent)
        return pd.Series([least_difference(p, q) <= d for p, q, d in zip(x, y, allowed)], dtype=bool)

    left, right = (classes.select(F.col("rep").alias(r), F.col("n").alias(n), F.col("parity").alias(v)) for r, n, v in (("ra", "na", "va"), ("rb", "nb", "vb")))
    met = pairs.join(left, F.col("a") == F.col("ra")).join(right, F.col("b") == F.col("rb"))
    return met.filter(close("na", "nb", "va", "vb")).select("a", "b")


def size_class(n: str, percent: int):
    """Class of a set size, as a column: sizes that can link lie in the same or in neighbouring classes."""
    if percent >= 100:
        return F.col(n).cast("int")
    return F.floor(F.log(F.col(n)) / F.lit(log(100 / percent) * (1 + 1e-9))).cast("int")


def _folded(vectors: list, size: int) -> np.ndarray:
    """Parity vectors as rows of 64-bit words, longer ones folded to ``size`` bytes."""
    rows = (np.bitwise_xor.reduce(np.frombuffer(v, dtype=np.uint8).reshape(-1, size), axis=0) for v in vectors)
    return np.array(list(rows), dtype=np.uint8).reshape(-1, size).view(np.uint64)


def compare_blocks(rep, n, pos, part, guest, parity, second, alone: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two blocks of one list cell, or of one block with itself, that may link.

    Two members meet if their components differ, one of them is at home in the cell, and length,
    position and parity bounds allow a link. Members are sorted by component and compared in tiles,
    so tiles of one component are passed over.
    """
    order = np.lexsort((rep, part))
    rep, n, pos, part, guest, second = (x[order] for x in (rep, n, pos, part, guest, second))
    size = min(map(len, parity))
    words = _folded([parity[i] for i in order], size)
    left, right = (np.arange(len(rep)),) * 2 if alone else (np.flatnonzero(~second), np.flatnonzero(second))
    found_a, found_b = [], []
    for i in range(0, len(left), TILE_ROWS):
        x = left[i : i + TILE_ROWS]
        for j in range(i if alone else 0, len(right), TILE_ROWS):
            y = right[j : j + TILE_ROWS]
            if part[x[0]] == part[x[-1]] == part[y[0]] == part[y[-1]]:
                continue
            nx, ny = n[x][:, None], n[y][None, :]
            need = least_overlap(nx, ny, percent)
            ok = (part[x][:, None] != part[y][None, :]) & ~(guest[x][:, None] & guest[y][None, :])
            ok &= (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (np.minimum(nx - pos[x][:, None], ny - pos[y][None, :]) >= need)
            if alone and i == j:
                ok &= x[:, None] < y[None, :]
            if not ok.any():
                continue
            differ = np.zeros(ok.shape, dtype=np.uint32)
            for w in range(words.shape[1]):
                differ += np.bitwise_count(words[x, w][:, None] ^ words[y, w][None, :])
            a, b = np.nonzero(ok & (differ <= nx + ny - 2 * need))
            found_a.append(rep[x[a]])
            found_b.append(rep[y[b]])
    none = np.zeros(0, dtype=np.int64)
    a, b = np.concatenate([none, *found_a]), np.concatenate([none, *found_b])
    return np.maximum(a, b), np.minimum(a, b)


def _close_in_long_lists(marked: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) pairs from different components that meet in a long list and may link.

    A list is cut into cells by size class; a member is at home in its class and a guest in the next.
    A cell of many members is dealt out as pairs of blocks.
    """
    vectors = classes.select(F.col("rep").alias("r"), "parity")
    both = F.explode(F.array(F.struct(F.lit(0).alias("up"), F.lit(False).alias("guest")), F.struct(F.lit(1).alias("up"), F.lit(True).alias("guest"))))
    members = marked.select("token", "rep", "n", "pos", "part", both.alias("s"))
    members = members.select("token", (size_class("n", percent) + F.col("s.up")).alias("cell"), F.col("s.guest").alias("guest"), "rep", "n", "pos", "part")
    cells = members.groupBy("token", "cell").agg(F.count("*").alias("many"), F.min("part").alias("x"), F.max("part").alias("y"), F.min("guest").alias("deserted"))
    cells = cells.filter("x <> y and not deserted").select(F.col("token").alias("t"), F.col("cell").alias("c"), F.ceil(F.col("many") / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = members.join(cells, (F.col("token") == F.col("t")) & (F.col("cell") == F.col("c"))).join(vectors, F.col("rep") == F.col("r"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = placed.select("token", "cell", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "rep", "n", "pos", "part", "guest", "parity")

    def compare(group: pa.Table) -> pa.Table:
        first, second = group["first"][0].as_py(), group["second"][0].as_py()
        rep, n, pos, part, own = (group[c].to_numpy().astype(np.int64) for c in ("rep", "n", "pos", "part", "own"))
        a, b = compare_blocks(rep, n, pos, part, np.asarray(group["guest"]).astype(bool), group["parity"].to_pylist(), own != first, first == second, percent)
        return pa.table({"a": a, "b": b})

    return task.groupBy("token", "cell", "first", "second").applyInArrow(compare, "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets link. Only sets of classes in pairs move.

    A class's set is that of a text of its smallest id with the class's digest, as an id may have several.
    """
    spark = docs.sparkSession
    reps = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    wanted = classes.select("rep", F.col("least").alias("i"), F.col("d1").alias("e1"), F.col("d2").alias("e2")).join(reps, F.col("rep") == F.col("k"), "left_semi")
    wanted = scratch.written(wanted, "candidate-classes")
    bits = sized_bits(8 * wanted.count(), BLOOM_BITS)
    bloom = spark.sparkContext.broadcast(_bloom(wanted.select("i"), bits))  # a full filter only moves more sets

    def run(batches):
        worker_starts()
        for b in batches:
            at = _places(b.column(0).to_numpy(zero_copy_only=False), bits)
            hit = (bloom.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            part = b.filter(pa.array(hit.astype(bool)))
            sets, x = [], []
            for s, only in sets_with_digests(part.column(1), words):
                sets.append(s.tobytes())
                x.append(set_digest(s, only))
            d = np.array(x, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sets, pa.binary())], ["id", "d1", "d2", "shingles"])

    source = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col))
    met = source.mapInArrow(run, "id long, d1 long, d2 long, shingles binary").join(wanted, (F.col("id") == F.col("i")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))
    sets = scratch.written(met.groupBy(F.col("rep").alias("id")).agg(F.first("shingles").alias("shingles")), "shingle-sets")

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            a, b = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
            both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    left, right = (sets.select(F.col("id").alias(i), F.col("shingles").alias(s)) for i, s in (("ia", "sa"), ("ib", "sb")))
    met = pairs.join(left, F.col("a") == F.col("ia")).join(right, F.col("b") == F.col("ib"))
    return met.filter(linked("sa", "sb")).select("a", "b")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) per row of ``docs``; ids are integers.

    Two documents link when 100 * intersection >= percent * union of their shingle sets; the component
    is the smallest id reachable by links. Documents without words, or with a null text, have an empty
    set, link with nothing and are their own component. Rows that repeat an id are one node, so
    different texts under one id connect what they link with; null ids are their own component. Other
    columns are not read. An empty table gives an empty result; ids of another type raise a TypeError.

    Texts are compared by 64-bit hashes of their shingles, equal sets by 128-bit digests and equal
    subsets by two 64-bit signatures; a set of one shingle by a digest of its words.
    """
    if not isinstance(docs.schema[id_col].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"{id_col}: ids must be integers, not {docs.schema[id_col].dataType.simpleString()}")
    with Scratch(docs.sparkSession) as scratch:
        return _components(docs, scratch, words, percent, id_col, text_col)


def _components(docs: DataFrame, scratch: Scratch, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    levels = spark.sparkContext.broadcast(frequency_levels(docs, text_col, words))  # 2**24 bytes at most
    signed = scratch.written(signatures(docs, levels, id_col, text_col, words, percent).withColumnRenamed(id_col, "id"), "jaccard-signatures")
    usable = signed.filter((F.col("n") > 0) & F.col("id").isNotNull())
    classes = usable.groupBy("d1", "d2").agg(F.min("id").cast("long").alias("least"), *(F.first(c).alias(c) for c in ("n", "prefix", "subsets", "seconds", "overlaps", "parity")))
    classes = scratch.written(classes.withColumn("rep", F.monotonically_increasing_id()), "jaccard-classes")  # numbers are kept by writing them
    # ids with several sets connect their classes
    several = signed.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("n", "d1", "d2")).alias("x"), F.max(F.struct("n", "d1", "d2")).alias("y"))
    several = scratch.written(several.filter("x <> y").select(F.col("id").alias("i")), "jaccard-several")
    repeats = not several.isEmpty()
    if repeats:
        held = usable.join(several, F.col("id") == F.col("i"), "left_semi").select("id", F.col("d1").alias("c1"), F.col("d2").alias("c2")).distinct()
        held = scratch.written(held.join(classes.select("d1", "d2", "rep"), (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2"))).select("id", "rep"), "jaccard-held")
        least = held.groupBy("id").agg(F.min("rep").alias("b")).withColumnRenamed("id", "i")
        joint = held.join(least, F.col("id") == F.col("i")).select(F.col("rep").alias("a"), "b").filter("a <> b")

    # light sets: a star per shared subset
    subsets = classes.filter(F.col("subsets").isNotNull()).select("rep", "n", F.explode(F.arrays_zip("subsets", "seconds", "overlaps")).alias("s"))
    subsets = subsets.select("rep", "n", F.col("s.subsets").alias("sig"), F.col("s.seconds").alias("sig2"), F.col("s.overlaps").alias("c"))
    heads = subsets.groupBy("sig", "sig2", "c").agg(F.min(F.struct("n", "rep")).alias("head"), F.count("*").alias("many")).filter("many > 1").select(F.col("sig").alias("k"), F.col("sig2").alias("k2"), F.col("c").alias("kc"), F.col("head.n").alias("hn"), F.col("head.rep").alias("head"))
    light = subsets.join(heads, (F.col("sig") == F.col("k")) & (F.col("sig2") == F.col("k2")) & (F.col("c") == F.col("kc"))).filter((F.col("head") != F.col("rep")) & (_needed("hn", "n", percent) <= F.col("c")))
    light = light.select(F.col("rep").alias("a"), F.col("head").alias("b"))

    # heavy sets: inverted lists of the first shingles, those of two members or more
    lists = classes.filter(F.col("prefix").isNotNull()).select("rep", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    many = lists.groupBy("token").agg(F.count("*").cast("int").alias("many")).filter("many > 1").withColumnRenamed("token", "k")
    shared = scratch.written(lists.join(many, F.col("token") == F.col("k")).drop("k"), "jaccard-lists")

    def possible(n1: str, p1: str, n2: str, p2: str):
        """Length and position bounds for a pair that meets first at these positions."""
        shorter_tail = F.least(F.col(n1) - F.col(p1), F.col(n2) - F.col(p2))
        return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (shorter_tail >= _needed(n1, n2, percent))

    place = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("token", "rep"), "rep"))
    leaders = shared.withColumn("place", place).filter(F.col("place") <= MOST_LEADERS).filter(F.col("place") <= F.ceil(F.log2("many")))
    leaders = leaders.select(F.col("token").alias("k"), F.col("rep").alias("lr"), F.col("n").alias("ln"), F.col("pos").alias("lp"))
    first = shared.join(leaders, (F.col("token") == F.col("k")) & (F.col("rep") != F.col("lr")) & possible("n", "pos", "ln", "lp"))
    first = first.select(F.greatest("rep", "lr").alias("a"), F.least("rep", "lr").alias("b")).distinct()
    first = scratch.written(_close(first, classes, percent), "jaccard-candidates")
    links = _verified(first, classes, docs, scratch, id_col, text_col, words, percent).union(light)
    links = scratch.written(links.union(joint) if repeats else links, "jaccard-links")
    parts = connected_components(links, scratch)

    marked = shared.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("token", "rep", "n", "pos", "many", F.coalesce("component", "rep").alias("part"))
    mixed = marked.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x <> y").select(F.col("token").alias("k"))
    marked = scratch.written(marked.join(mixed, F.col("token") == F.col("k"), "left_semi"), "jaccard-marked-lists")
    short = marked.filter(F.col("many") <= SHORT_LIST)
    other = short.select(F.col("token").alias("t2"), F.col("rep").alias("r2"), F.col("n").alias("n2"), F.col("pos").alias("p2"), F.col("part").alias("q2"))
    second = short.join(other, (F.col("token") == F.col("t2")) & (F.col("rep") > F.col("r2")) & (F.col("part") != F.col("q2")) & possible("n", "pos", "n2", "p2"))
    second = _close(second.select(F.col("rep").alias("a"), F.col("r2").alias("b")).distinct(), classes, percent)
    second = second.union(_close_in_long_lists(marked.filter(F.col("many") > SHORT_LIST), classes, percent)).distinct()
    second = scratch.written(second.join(first, ["a", "b"], "left_anti"), "jaccard-candidates")
    if second.limit(1).count():
        more = scratch.written(_verified(second, classes, docs, scratch, id_col, text_col, words, percent), "jaccard-links")
        # the components so far are stars already
        parts = connected_components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), scratch)

    placed = scratch.written(classes.select("rep", "least", F.col("d1").alias("c1"), F.col("d2").alias("c2")).join(parts.withColumnRenamed("id", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep")), "jaccard-parts")
    names = placed.groupBy("part").agg(F.min("least").alias("name")).withColumnRenamed("part", "p")
    by_class = placed.join(names, F.col("part") == F.col("p")).select("c1", "c2", "rep", "name")
    out = signed.select("id", "n", "d1", "d2").join(by_class.drop("rep"), (F.col("n") > 0) & F.col("id").isNotNull() & (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")), "left")
    if repeats:  # an empty text under an id that has others goes with them
        of_several = least.join(by_class.select("rep", F.col("name").alias("joint")), F.col("b") == F.col("rep")).select("i", "joint")
        out = out.join(of_several, F.col("id") == F.col("i"), "left")
    else:
        out = out.withColumn("joint", F.lit(None).cast("long"))
    return written(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("name", "joint", "id").alias("component_id")), "jaccard-components")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def oracle_sql() -> str:
    return r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
e as (select doc_id, len(s) as n, unnest(s) as x from s),
l as (select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(id, c) as (select doc_id, doc_id from s union select l.a, r.c from r join l on l.b = r.id)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, m.c as component_id from s join (select id, min(c) as c from r group by id) m on m.id = s.doc_id
"""
