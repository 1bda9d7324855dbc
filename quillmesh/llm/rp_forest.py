"""Operator 1: embedding near-duplicates with a random-projection tree forest.

Trees are fitted on a bounded sample: each node projects its vectors on a random direction and splits
them at the median; vectors near the split spill into both children. Splitting ends at small nodes and
at dense ones, where most sampled pairs are near-duplicates already and a split would cut links.
Every vector is routed through every tree, vectors of a leaf are compared with each other in double
precision, and verified links are united into components.

Leaves that are still larger than a block get a tree of their own, fitted on a bounded sample of the
leaf, so leaves stay small whatever the size of the table. Dense ones are dealt out as pairs of blocks,
and so is what MAX_LEVELS of trees, each of MAX_DEPTH splits at most, have not divided: no link is lost by
it, but the comparisons in such a leaf grow with its square. Three levels divide a leaf by up to 8,192
each, so they end at dense leaves only for tables below some 10**13 vectors. Large leaves whose vectors
all share an earlier leaf, as copies of one vector do in each tree, are not compared again.

Identical vectors are one class with a count, so copies are compared once. A pair that shares several
leaves is counted in the first of them only, so a leaf returns counts and a spanning set of edges
instead of pairs.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .components import connected_components
from .shared import Scratch, small_batches, table, worker_starts, written

COSINE = 0.9
TREES = 8
OVERLAP = 0.14  # share of a node's vectors that go to both children
LEAF_ROWS = 250
SAMPLE_ROWS = 65_536
SAMPLE_BYTES = 1 << 24  # of the sample of one dimension, and of all that the driver takes
LEAST_SAMPLE_LEAF = 64  # leaves of more rows than a block are split further on their own
DENSE_SHARE = 0.05
BLOCK_ROWS = 2_048
MAX_DEPTH = 24
SUBTREE_SAMPLE = 16_384  # vectors a leaf's own tree is fitted on, about
SUBTREE_BYTES = 1 << 26  # of a leaf's sample, and of a block of its rows
LEAST_SUBTREE_LEAF = 32
SUBTREE_BLOCK = 65_536
MAX_LEVELS = 3
PLACES = 8_192  # numbers below a leaf that is split; the last two mark leaves that stay
DENSE, SMALL = PLACES - 2, PLACES - 1
SEED = 1905


@dataclass
class Tree:
    """Nodes by number: row of its direction, bounds of the spill zone, children, leaf id (-1 at inner nodes)."""

    directions: np.ndarray
    turn: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf id) pairs for unit vectors ``x``."""
        rows, leaves = [], []
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if self.leaf[node] >= 0:
                rows.append(at)
                leaves.append(np.full(len(at), self.leaf[node]))
                continue
            p = x[at] @ self.directions[self.turn[node]]
            stack.append((self.left[node], at[p <= self.high[node]]))
            stack.append((self.right[node], at[p >= self.low[node]]))
        if not rows:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(rows), np.concatenate(leaves)


def grow(sample: np.ndarray, rng, leaf_rows: int, first_leaf: int, overlap: float = OVERLAP, cosine: float = COSINE) -> Tree:
    """One tree over unit sample vectors; leaves are numbered from ``first_leaf``."""
    dim = sample.shape[1]
    nodes: list[list] = [[-1, 0.0, 0.0, -1, -1, -1]]
    directions: list[np.ndarray] = []
    stack = [(0, np.arange(len(sample)), 0)]
    leaves = first_leaf
    while stack:
        node, at, depth = stack.pop()
        end = len(at) <= leaf_rows or depth >= MAX_DEPTH
        if not end:
            i, j = rng.integers(0, len(at), (2, 512))
            apart = i != j
            near = (sample[at[i[apart]]] * sample[at[j[apart]]]).sum(1) >= cosine
            end = bool(near.mean() >= DENSE_SHARE) if apart.any() else True
        if not end:
            direction = rng.normal(size=dim).astype(np.float32)
            direction /= np.linalg.norm(direction)
            p = sample[at] @ direction
            low, high = np.quantile(p, [0.5 - overlap / 2, 0.5 + overlap / 2])
            end = not (p.min() < low and p.max() > high)
        if end:
            nodes[node][5] = leaves
            leaves += 1
            continue
        nodes[node][:5] = [len(directions), low, high, len(nodes), len(nodes) + 1]
        directions.append(direction)
        for side in (at[p <= high], at[p >= low]):
            nodes.append([-1, 0.0, 0.0, -1, -1, -1])
            stack.append((len(nodes) - 1, side, depth + 1))
    kinds = (np.int32, np.float32, np.float32, np.int32, np.int32, np.int64)
    return Tree(np.array(directions, dtype=np.float32).reshape(-1, dim), *(np.array([n[k] for n in nodes], dtype=t) for k, t in enumerate(kinds)))


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, scaled first so that squares neither overflow nor vanish."""
    x = np.asarray(x, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) with ``embedding`` null where it links with nothing; one row per id, null ids left out."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = x.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(x, lambda c: c != 0), F.lit(False))
    return vectors.filter(F.col("vec_id").isNotNull()).select("vec_id", F.when(good, x).alias("embedding")).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _rows_matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


@F.pandas_udf(BinaryType())
def encoded(leaves: pd.Series) -> pd.Series:
    """Leaf numbers as bytes, which cost nothing to carry and are read only where links are found."""
    return pd.Series([np.asarray(x, dtype="<i8").tobytes() for x in leaves], dtype=object)


def first_shared(codes_a: list[np.ndarray], codes_b: list[np.ndarray], this: int) -> np.ndarray:
    """Matrix: whether a and b share no leaf numbered below ``this``."""
    a, b = ([c[c < this] for c in codes] for codes in (codes_a, codes_b))
    both = np.intersect1d(np.concatenate(a) if a else [], np.concatenate(b) if b else [])
    if not len(both):
        return np.ones((len(a), len(b)), dtype=bool)
    # leaves in slices, so the incidence matrices stay small
    shared = np.zeros((len(a), len(b)), dtype=bool)
    for part in np.array_split(both, -(-len(both) // 4096)):
        m = [np.zeros((len(codes), len(part)), dtype=np.float32) for codes in (a, b)]
        for codes, x in zip((a, b), m):
            for i, c in enumerate(codes):
                at = np.searchsorted(part, c)
                at = at[(at < len(part)) & (part[np.minimum(at, len(part) - 1)] == c)]
                x[i, at] = 1
        shared |= (m[0] @ m[1].T) > 0
    return ~shared


def spanning(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id reachable by each row over the boolean adjacency ``near``."""
    label = ids.copy()
    while True:
        low = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        low = np.minimum(low, label)
        if (low == label).all():
            return label
        label = low


def compare_leaf(leaf: int, ids, sizes, x, codes, side, cosine: float):
    """Links and edges of one leaf, or of one pair of its blocks.

    ``side``: 0 for rows of the first block, 1 for the second; a block meets itself with all rows at 0.
    ``codes`` holds the leaf numbers of each row as bytes.
    Returns (id, links) for rows with links and (id, smaller id) edges that span them.
    """
    u = unit(x)
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1)
    alone = not len(b)
    if alone:
        b = a
    near = (u[a] @ u[b].T) >= cosine
    if alone:
        np.fill_diagonal(near, False)
    links = np.zeros(len(ids), dtype=np.int64)
    if near.any():
        ra, cb = near.any(axis=1), near.any(axis=0)
        rows, cols = np.flatnonzero(ra), np.flatnonzero(cb)
        numbers = lambda at: [np.frombuffer(codes[int(i)].as_py(), dtype="<i8") for i in at]
        fresh = near[np.ix_(rows, cols)] & first_shared(numbers(a[rows]), numbers(b[cols]), leaf)
        links[a[rows]] += fresh @ sizes[b[cols]]
        if not alone:
            links[b[cols]] += fresh.T @ sizes[a[rows]]
        part = np.unique(np.concatenate([a[rows], b[cols]]))
        place = np.full(len(ids), -1)
        place[part] = np.arange(len(part))
        adjacency = np.zeros((len(part), len(part)), dtype=bool)
        adjacency[np.ix_(place[a[rows]], place[b[cols]])] = near[np.ix_(rows, cols)]
        adjacency |= adjacency.T
        low = spanning(adjacency, ids[part])
        moved = low < ids[part]
        return (ids[links > 0], links[links > 0]), (ids[part][moved], low[moved])
    none = np.zeros(0, dtype=np.int64)
    return (none, none), (none, none)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector id.

    ``n_links`` counts the other vectors with a cosine of at least ``cosine`` that the forest finds,
    ``component_id`` is the smallest id reachable by links, ``kept`` marks that vector. Vectors that
    are null, zero, empty or hold null or non-finite components link with nothing. Rows that repeat
    an id are one vector (the smallest); rows without an id link with nothing and stay as they are, a
    row each, without a component. Vectors are compared with those of equal dimension, dimensions with
    few vectors without a tree. Other columns are not read. An empty table gives an empty result.
    """
    with Scratch(vectors.sparkSession) as scratch:
        return _linked(vectors, scratch, cosine, trees)


def fitted_forest(classes: DataFrame, cosine: float, trees: int) -> dict[int, list[Tree] | list[int]]:
    """Trees by dimension, for dimensions with more vectors than a leaf; their leaves are numbered through.

    Samples are drawn in one job and bounded by rows and bytes, all of them together by SAMPLE_BYTES:
    the dimensions with most vectors come first. Of the others those with more vectors than a block
    get numbers of leaves instead of trees: each holds all vectors of the dimension, and ``deepened``
    fits its tree on an executor.
    """
    shapes = classes.groupBy(F.size("embedding").alias("d")).count().filter(F.col("count") > LEAF_ROWS).collect()
    rng, forest, leaf, room, fitted = np.random.default_rng(SEED), {}, 0, SAMPLE_BYTES, {}
    for dim, rows in sorted(((r["d"], r["count"]) for r in shapes), key=lambda r: (-r[1], r[0])):
        share = min(rows, SAMPLE_ROWS, room // (4 * dim))
        if share >= min(rows, 8 * LEAF_ROWS):
            fitted[dim] = (rows, share)
            room -= 4 * dim * share
        elif rows > BLOCK_ROWS:
            forest[dim] = [-(dim * trees + t) for t in range(trees)]
    drawn: dict[int, tuple[list, list]] = {dim: ([], []) for dim in fitted}
    if fitted:
        # a row is drawn by its hash; a few more than wanted are taken and cut, so the sample's size holds
        wanted = F.create_map(*[F.lit(x) for dim, (rows, share) in fitted.items() for x in (dim, min(1.0, 1.1 * share / rows + 64 / rows))])
        hashed = classes.select("rep", "embedding", F.size("embedding").alias("d")).filter(F.col("d").isin(list(fitted)))
        hashed = hashed.withColumn("h", F.pmod(F.xxhash64("rep"), F.lit(1 << 30))).filter(F.col("h") < wanted[F.col("d")] * (1 << 30))
        sample = hashed.select("d", "h", "rep", F.col("embedding").cast("array<float>").alias("embedding")).toArrow()
        at = np.asarray(sample["d"])
        for dim, (rows, share) in sorted(fitted.items()):
            part = sample.take(pa.array(np.flatnonzero(at == dim)))
            order = np.lexsort((np.asarray(part["rep"]), np.asarray(part["h"])))[:share]
            x = unit(_rows_matrix(part["embedding"].combine_chunks().take(pa.array(order)))).astype(np.float32)
            least = max(LEAST_SAMPLE_LEAF, int(LEAF_ROWS * len(x) / rows))
            forest[dim] = []
            for _ in range(trees):
                forest[dim].append(grow(x, rng, least, leaf, cosine=cosine))
                leaf = int(forest[dim][-1].leaf.max()) + 1
    return forest


def routed(classes: DataFrame, forest: dict[int, list[Tree] | list[int]], trees: int = TREES) -> DataFrame:
    """``classes`` (rep, size, embedding) with the numbers of each vector's leaves.

    Vectors of a dimension without trees are all in one leaf, or in each leaf that the forest names; such
    leaves have negative numbers.
    """
    shared_forest = classes.sparkSession.sparkContext.broadcast(forest)  # bounded by SAMPLE_BYTES and the number of trees
    kind = classes.schema["embedding"].dataType.simpleString()

    def route(batches):
        worker_starts()
        for batch in batches:
            found: list[list[int]] = [[] for _ in range(batch.num_rows)]
            dims = np.diff(batch.column(2).offsets.to_numpy()) if batch.num_rows else np.zeros(0, int)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                grown = shared_forest.value.get(int(d))
                if not grown or isinstance(grown[0], int):
                    for r in at.tolist():
                        found[r].extend(grown or [-int(d) * trees])
                    continue
                x = unit(_rows_matrix(batch.column(2).take(pa.array(at)))).astype(np.float32)
                for tree in grown:
                    rows, leaves = tree.route(x)
                    for r, k in zip(at[rows].tolist(), leaves.tolist()):
                        found[r].append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], ["rep", "size", "embedding", "leaves"])

    return classes.select("rep", "size", "embedding").mapInArrow(route, f"rep long, size long, embedding {kind}, leaves array<bigint>")


def deepened(rows: DataFrame, scratch: Scratch, cosine: float) -> DataFrame:
    """``rows`` with every leaf of more than a block split by a tree of its own, fitted on a sample of it.

    The first trees see one sample, so their leaves grow with the table; this goes on until no leaf is
    large but dense ones, which stay whole. A leaf's number becomes its old one and a place below it.
    Trees meet the rows of their leaf in blocks; no leaf is gathered in one task.
    """
    leaf_rows, sample_rows, least_leaf = LEAF_ROWS, SUBTREE_SAMPLE, LEAST_SUBTREE_LEAF
    for level in range(MAX_LEVELS):
        each = rows.select("rep", F.explode("leaves").alias("leaf"))
        open_leaf = F.pmod("leaf", F.lit(PLACES)) != DENSE if level else F.lit(True)
        large = each.groupBy("leaf").count().filter((F.col("count") > BLOCK_ROWS) & open_leaf)
        large = scratch.written(large.select(F.col("leaf").alias("k"), F.col("count").alias("n")), "large-leaves")
        if not large.limit(1).count():
            break
        members = rows.select("rep", "embedding", F.explode("leaves").alias("leaf")).join(large, F.col("leaf") == F.col("k")).drop("k")
        fits = F.floor(F.lit(SUBTREE_BYTES) / (8 * F.size("embedding")))
        drawn = members.filter(F.pmod(F.xxhash64("rep", "leaf"), F.lit(1 << 20)) * F.col("n") < F.least(F.lit(sample_rows), fits) * (1 << 20))

        def fit(group: pa.Table) -> pa.Table:
            leaf, n = group["leaf"][0].as_py(), group["n"][0].as_py()
            sample = unit(_rows_matrix(group["embedding"])[np.argsort(group["rep"].to_numpy())]).astype(np.float32)
            tree = grow(sample, np.random.default_rng([SEED, abs(leaf)]), max(least_leaf, int(leaf_rows * len(sample) / n)), 0, cosine=cosine)
            return pa.table({"k": pa.array([leaf], pa.int64()), "tree": pa.array([pickle.dumps(tree)], pa.binary()), "n": pa.array([n], pa.int64()), "dim": pa.array([sample.shape[1]], pa.int32())})

        trees = scratch.written(drawn.groupBy("leaf").applyInArrow(fit, "k long, tree binary, n long, dim int"), "subtrees")

        def in_blocks(dim):
            return F.ceil(F.col("n") / F.least(F.lit(SUBTREE_BLOCK), F.greatest(F.lit(1), F.floor(F.lit(SUBTREE_BYTES) / (8 * dim))))).cast("int")

        dealt = members.select("leaf", F.pmod(F.xxhash64("rep"), in_blocks(F.size("embedding")).cast("long")).cast("int").alias("block"), "rep", "embedding")
        sent = trees.select("k", "tree", F.explode(F.sequence(F.lit(0), in_blocks(F.col("dim")) - 1)).alias("b"))

        def split(left: pa.Table, right: pa.Table) -> pa.Table:
            r, leaf, to = np.zeros(0, np.int64), 0, np.zeros(0, np.int64)
            if left.num_rows and right.num_rows:
                leaf, tree = left["leaf"][0].as_py(), pickle.loads(right["tree"][0].as_py())
                at, places = tree.route(unit(_rows_matrix(left["embedding"])).astype(np.float32))
                r, to = left["rep"].to_numpy()[at], leaf * PLACES + (places if tree.leaf.max() > 0 else DENSE)
                to = np.broadcast_to(to, r.shape)
            return pa.table({"r": r, "l": np.full(len(r), leaf, dtype=np.int64), "to": to})

        moved = dealt.groupBy("leaf", "block").cogroup(sent.groupBy("k", "b")).applyInArrow(split, "r long, l long, to long")
        moved = each.join(moved, (F.col("rep") == F.col("r")) & (F.col("leaf") == F.col("l")), "left").select("rep", F.coalesce("to", F.col("leaf") * PLACES + SMALL).alias("leaf"))
        leaves = moved.groupBy("rep").agg(F.collect_list("leaf").alias("leaves"))  # of one vector: trees times spill
        rows = scratch.written(rows.drop("leaves").join(leaves, "rep"), "routed-vectors")
    return rows


def _linked(vectors: DataFrame, scratch: Scratch, cosine: float, trees: int) -> DataFrame:
    small_batches(vectors.sparkSession)
    everything = scratch.written(usable_vectors(vectors).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding")), "vectors")
    usable = everything.filter(F.col("embedding").isNotNull())
    classes = usable.groupBy("h1", "h2").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("size"), F.first("embedding").alias("embedding"))
    classes = scratch.written(classes, "vector-classes")
    rows = scratch.written(routed(classes, fitted_forest(classes, cosine, trees), trees), "routed-vectors")
    rows = deepened(rows, scratch, cosine)

    # leaves that exceed a block are dealt out as pairs of blocks; a leaf whose rows all share an earlier one has no pair to count
    counts = rows.select(F.explode("leaves").alias("leaf"), F.array_min("leaves").alias("first")).groupBy("leaf")
    counts = counts.agg(F.count("*").alias("count"), F.min("first").alias("x"), F.max("first").alias("y")).filter((F.col("count") > 1) & ((F.col("x") != F.col("y")) | (F.col("x") == F.col("leaf"))))
    counts = counts.select(F.col("leaf").alias("k"), F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = rows.withColumn("codes", encoded("leaves")).select("rep", "size", "embedding", "codes", F.explode("leaves").alias("leaf")).join(counts, F.col("leaf") == F.col("k"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep", "leaf"), F.col("blocks").cast("long")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = placed.select("leaf", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "rep", "size", "embedding", "codes")

    def compare(group: pa.Table) -> pa.Table:
        leaf, first, second = (group[c][0].as_py() for c in ("leaf", "first", "second"))
        side = (group["own"].to_numpy() != first).astype(np.int8)
        (ids, links), (a, b) = (np.zeros(0, np.int64),) * 2, (np.zeros(0, np.int64),) * 2
        if first == second or (0 < side.sum() < len(side)):
            (ids, links), (a, b) = compare_leaf(leaf, group["rep"].to_numpy(), group["size"].to_numpy(), _rows_matrix(group["embedding"]), group["codes"], side, cosine)
        return pa.table({"a": np.concatenate([ids, a]), "links": pa.array(np.concatenate([links, np.zeros(len(a), np.int64)])), "b": pa.array([None] * len(ids) + b.tolist(), pa.int64())})

    found = scratch.written(task.groupBy("leaf", "first", "second").applyInArrow(compare, "a long, links long, b long"), "vector-links")
    links = found.filter(F.col("b").isNull()).groupBy("a").agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter(F.col("b").isNotNull()).select("a", "b"), scratch)
    by_class = classes.select("h1", "h2", "rep", "size").join(links.withColumnRenamed("a", "rep"), "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    by_class = by_class.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    joined = everything.select("vec_id", "h1", "h2", F.col("embedding").isNotNull().alias("good")).join(by_class, F.col("good") & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    component = F.coalesce("c", "vec_id")
    result = joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
    nameless = vectors.filter(F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return written(result.union(nameless), "vector-components")


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def oracle_sql() -> str:
    return """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings where embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
n as (select vec_id, e, sqrt(list_dot_product(e, e)) as s from v),
l as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.9),
r(id, c) as (select vec_id, vec_id from embeddings union select l.a, r.c from r join l on l.b = r.id),
c as (select a, count(*) as k from l group by a)
select m.id as vec_id, cast(coalesce(c.k, 0) as bigint) as n_links, m.c as component_id, m.id = m.c as kept from (select id, min(c) as c from r group by id) m left join c on c.a = m.id
"""
