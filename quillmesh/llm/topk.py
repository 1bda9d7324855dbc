"""Operator 3: exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped into buckets of similar length (Euclidean norm), longest first. A query brings a
lower bound for its k-th best score, found among a bounded set of the longest vectors. Dividing the
bound by the query's length and the bucket's greatest length gives the cosine that a vector of this
bucket needs: above 1 the bucket is skipped, a high one prunes by the query's strongest coordinates
(a vector that reaches the cosine must lie in an interval on each of them), a low one by length alone.
What is left is verified by its exact integer product.

Work is dealt out as (block of a bucket, chunk of queries); both sides of such a pair are bounded.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, table, written

SCALE = 256
TOP = 5
SEED_ROWS = 256
BLOCK_ROWS = 32_768
LEAST_BLOCK_ROWS = 1_024
BLOCKS_WANTED = 48
QUERY_CHUNK = 8_192
MAX_BUCKETS = 512
COORDINATE_COSINE = 0.6
FOCUS = 3
EXACT, WIDE = 2.0**53, 2.0**62
BLOCK_BYTES, QUERY_BYTES = 1 << 24, 1 << 22  # of a block's vectors and of a chunk of queries
LARGEST = 2.0**480  # components from which squares leave doubles
LONG = np.iinfo(np.int64)


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, dim, norm): floor(scale * x) of the usable vectors as whole doubles, one row per id.

    Left out: null ids, null or empty vectors and those with null or non-finite components, or ones of
    2**480 or more. Of rows that repeat an id the smallest vector counts, so repeated rows change nothing.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(LARGEST)))
    usable = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).filter(finite)
    ints = usable.select("vec_id", F.transform(x, lambda c: whole(F.lit(scale) * c.cast("double"))).alias("v"))
    one = ints.groupBy("vec_id").agg(F.min("v").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return one.select("vec_id", "v", F.size("v").alias("dim"), F.sqrt(square).alias("norm"))


def whole(x):
    """Floor of a double column as a double; from 2**53 on doubles are whole numbers already."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _products(q: np.ndarray, v: np.ndarray, qnorms: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Exact integer products, those beyond 64 bits as the nearest 64-bit number.

    Doubles hold products below 2**53, 64-bit integers most others; Python's integers take the rows
    and columns that are longer.
    """
    bound = float(qnorms.max(initial=0)) * float(norms.max(initial=0))
    if bound < EXACT:
        return (q @ v.T).astype(np.int64)
    if bound < WIDE and max(np.abs(q).max(initial=0), np.abs(v).max(initial=0)) < WIDE:
        return q.astype(np.int64) @ v.astype(np.int64).T
    far_q, far_v = qnorms >= 2.0**31, norms >= 2.0**31
    out = np.zeros((len(q), len(v)), dtype=np.int64)
    near = np.ix_(~far_q, ~far_v)
    out[near] = _products(q[~far_q], v[~far_v], qnorms[~far_q], norms[~far_v])
    for rows, columns in ((far_q, np.ones(len(v), bool)), (~far_q, far_v)):
        if rows.any() and columns.any():
            exact = integers(q[rows]) @ integers(v[columns]).T
            out[np.ix_(rows, columns)] = np.clip(exact, int(LONG.min), int(LONG.max)).astype(np.int64)
    return out


def integers(x: np.ndarray) -> np.ndarray:
    """Whole doubles as Python's integers."""
    return np.array([[int(c) for c in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        at_least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= at_least)
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_block(ids, v, norms, qids, q, qnorms, bounds, k):
    """Best k of a block for each query, at or above its bound, as (query, id, score) arrays."""
    order = np.argsort(-norms, kind="stable")
    ids, v, norms = ids[order], v[order], norms[order]
    top = float(norms[0])
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(bounds > 0, bounds / (qnorms * top), -1.0)  # local cosine threshold
    need = np.nan_to_num(need, nan=np.inf, posinf=np.inf)
    slack = 1e-9

    def keep(i: int, at: np.ndarray, scores: np.ndarray):
        ok = (ids[at] != qids[i]) & (scores >= bounds[i])
        at, scores = at[ok], scores[ok]
        if len(at):
            best = _best(ids[at], scores, k)
            out.append((int(qids[i]), ids[at][best], scores[best]))

    by_length = np.flatnonzero(need < COORDINATE_COSINE)
    by_coordinate = np.flatnonzero((need >= COORDINATE_COSINE) & (need <= 1 + slack))
    if len(by_length):
        shortest = np.where(bounds[by_length] > 0, bounds[by_length] / np.maximum(qnorms[by_length], 1e-300), -1.0) * (1 - slack)
        reach = np.searchsorted(-norms, -shortest, side="right")  # length pruning: a prefix of the block
        for part in range(0, len(by_length), 256):
            rows, far = by_length[part : part + 256], reach[part : part + 256]
            scores = _products(q[rows], v[: far.max()], qnorms[rows], norms[: far.max()])
            for i, n, s in zip(rows, far, scores):
                keep(i, np.arange(n), s[:n])
    if len(by_coordinate):
        unit = v / np.maximum(norms, 1e-300)[:, None]
        for i in by_coordinate:
            c = min(1.0, need[i] * (1 - slack))
            u = q[i] / qnorms[i]
            n = int(np.searchsorted(-norms, -(bounds[i] / qnorms[i]) * (1 - slack), side="right"))
            focus = np.argsort(-np.abs(u))[:FOCUS]
            left = np.arange(n)
            for f in focus:
                # a unit vector with cosine >= c to u has its f-th coordinate in this interval
                spread = math.sqrt(max(0.0, (1 - c * c) * (1 - u[f] * u[f])))
                low = -1.0 if u[f] <= -c else c * u[f] - spread
                high = 1.0 if u[f] >= c else c * u[f] + spread
                x = unit[left, f]
                left = left[(x >= low - slack) & (x <= high + slack)]
            if len(left):
                keep(i, left, _products(q[i : i + 1], v[left], qnorms[i : i + 1], norms[left])[0])
    return out


def exact_top_k(vectors: DataFrame, is_query, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best integer inner products of each query.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id. All usable rows but
    the query's own are candidates; a query with fewer gets all of them. Vectors are compared with
    those of equal dimension. An empty table, or no query, gives no rows. Rows that repeat an id are one
    vector. Products beyond 64 bits are given, and ranked, as the nearest 64-bit number. Blocks and
    chunks of queries are bounded by rows and by bytes.
    """
    with Scratch(vectors.sparkSession) as scratch:
        return written(_searched(scratch.written(integer_vectors(vectors, scale), "integer-vectors"), is_query, k), "top-products")


def _searched(base: DataFrame, is_query, k: int) -> DataFrame:
    head = base.agg(F.count("*").alias("n"), F.max("dim").alias("widest")).first()
    total = head["n"]
    wanted = max(1, min(MAX_BUCKETS, -(-total // max(LEAST_BLOCK_ROWS, min(BLOCK_ROWS, total // BLOCKS_WANTED)))))
    cuts = sorted(set(base.approxQuantile("norm", [i / wanted for i in range(1, wanted)], 0.25 / wanted))) if total and wanted > 1 else []
    rows_per_block = max(LEAST_BLOCK_ROWS, min(BLOCK_ROWS, total // BLOCKS_WANTED))
    bucket = F.lit(0)
    if cuts:
        bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("norm")))
    base = base.withColumn("bucket", bucket)
    # a bucket count, its greatest length and its number of blocks: at most MAX_BUCKETS rows a dimension
    held = F.greatest(F.lit(1), F.least(F.lit(rows_per_block), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim")))))
    sizes = base.groupBy("bucket", "dim").agg(F.count("*").alias("n"), F.max("norm").alias("longest"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / held).cast("int"))
    n_queries = base.filter(is_query).count()
    chunks = max(1, -(-n_queries // max(1, min(QUERY_CHUNK, QUERY_BYTES // (8 * (head["widest"] or 1))))))

    seeds = base.orderBy(F.desc("norm"), "vec_id").limit(max(k + 1, min(SEED_ROWS, BLOCK_BYTES // (8 * (head["widest"] or 1))))).select("vec_id", "v", "dim").toArrow()
    seed_by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in sorted(set(seeds["dim"].to_pylist())):
        part = seeds.take(pa.array([i for i, x in enumerate(seeds["dim"].to_pylist()) if x == d]))
        seed_by_dim[d] = (np.array(part["vec_id"].to_pylist()), _matrix(part["v"], d))

    @F.pandas_udf("double")
    def lower_bound(ids: pd.Series, vs: pd.Series) -> pd.Series:
        out = []
        for i, x in zip(ids, vs):
            got = seed_by_dim.get(len(x))
            bound = -math.inf
            if got is not None:
                s, x = got[1], np.asarray(x)
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = (s @ x)[got[0] != i]
                if len(scores) >= k and float(np.abs(s).max()) * float(np.abs(x).max()) * len(x) < EXACT:
                    bound = float(np.partition(scores, len(scores) - k)[len(scores) - k])
            out.append(bound)
        return pd.Series(out, dtype="float64")

    queries = base.filter(is_query).select("vec_id", "v", "dim", "norm").withColumn("bound", lower_bound("vec_id", "v"))
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int"))
    reachable = (F.col("bound") <= 0) | (F.col("norm") * F.col("longest") >= F.col("bound") * (1 - 1e-9))
    plan = F.broadcast(sizes.select("bucket", F.col("dim").alias("d"), "longest", "blocks"))
    asked = queries.join(plan, (F.col("dim") == F.col("d")) & reachable).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.select(*(F.col(c).alias(f"q_{c}") for c in ("bucket", "dim", "block", "chunk", "vec_id", "v", "norm", "bound")))

    blocks = F.broadcast(sizes.select(F.col("bucket").alias("b"), F.col("dim").alias("d"), "blocks"))
    stored = base.join(blocks, (F.col("bucket") == F.col("b")) & (F.col("dim") == F.col("d")))
    stored = stored.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks").cast("long")).cast("int"))
    stored = stored.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select("bucket", "dim", "block", "chunk", "vec_id", "v", "norm")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            dim = left["dim"][0].as_py()
            found = search_block(
                left["vec_id"].to_numpy(), _matrix(left["v"], dim), left["norm"].to_numpy(),
                right["q_vec_id"].to_numpy(), _matrix(right["q_v"], dim), right["q_norm"].to_numpy(), right["q_bound"].to_numpy(), k,
            )
        return pa.table(
            {
                "query_id": pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]) if found else [], pa.int64()),
                "vec_id": pa.array(np.concatenate([f[1] for f in found]) if found else [], pa.int64()),
                "score": pa.array(np.concatenate([f[2] for f in found]) if found else [], pa.int64()),
            }
        )

    key = ["bucket", "dim", "block", "chunk"]
    found = stored.groupBy(*key).cogroup(asked.groupBy(*(f"q_{c}" for c in key))).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def oracle_sql() -> str:
    return """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
  from v q, v c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
