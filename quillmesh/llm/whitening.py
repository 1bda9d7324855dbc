"""Operator 13: whitening of embeddings by LOBPCG with distributed covariance products.

The covariance is never formed. A block of directions is multiplied by it in one pass over the centred
rows, summed by partition and then by slices of the result. Each iteration takes the residuals of the
current block, makes them orthogonal to the block and to the previous directions, multiplies them in one
pass, and solves the Rayleigh-Ritz problem over all three. It goes on until a product taken anew certifies
the residuals. What reaches the driver is as large as a block: dimensions times directions.

Sums are exact integers. A row is centred as (x - q) - r / n, where q and r are quotient and remainder of
its dimension's sum by n, so nothing is lost before the multiplication.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, small_batches, table, worker_starts, written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
GUARD = 8  # directions beyond the wanted ones
CERTIFIED, ENOUGH = 2e-14, 1e-11  # residuals against the largest eigenvalue: sought, and demanded
LEAST_EIGENVALUE = 1e-12  # against the largest; smaller ones are rounding
MAX_ROUNDS = 500
SLICE_BYTES = 1 << 16
PART_ENTRIES = 1 << 20  # entries of the rows that are worked on at a time
LARGEST = 2.0**52


def integer_rows(vectors: DataFrame, id_col: str, vec_col: str, scale: int, shift: int) -> DataFrame:
    """(vec_id, dim, x): floor(scale * c) + shift of the usable vectors' entries c, a row for each row."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * scale < LARGEST)))
    whole = F.transform("v", lambda c: F.floor(F.lit(scale) * c.cast("double")) + F.lit(shift))
    return rows.select("vec_id", F.size("v").alias("dim"), whole.alias("x"))


def _parts(batches, dim: int):
    """The rows of Arrow batches as integer matrices of bounded size."""
    step = max(1, PART_ENTRIES // dim)
    for b in batches:
        flat = b.column(b.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        for i in range(0, len(flat), step):
            yield flat[i : i + step]


def exact_sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each entry."""

    def run(batches):
        worker_starts()
        n, total = 0, np.zeros(dim, dtype=object)
        for x in _parts(batches, dim):
            n += len(x)
            fits = float(np.abs(x).max()) * len(x) < 2.0**62
            total += x.sum(axis=0).astype(object) if fits else x.astype(object).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(dim + 1), pa.int32()), "s": pa.array([Decimal(int(t)) for t in (n, *total)], pa.decimal128(38, 0))})

    found = rows.select("x").mapInArrow(run, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s")).collect()
    sums = {r["at"]: int(r["s"]) for r in found}
    return sums.get(0, 0), [sums.get(i + 1, 0) for i in range(dim)]


class Centre:
    """Mean of each entry as an integer and a fraction, to centre rows without loss."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = [s % n for s in sums]
        self.fraction = np.array([r / n for r in self.rest])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the entries of (n * x - S)^2, exact; None beyond 64 bits."""
        y = x - self.whole
        if (float(np.abs(y).max(initial=0)) + 1) ** 2 * self.n**2 * y.shape[1] < 2.0**62:
            return (((self.n * y - np.array(self.rest, dtype=np.int64)) ** 2).sum(axis=1)).tolist()
        exact = y.astype(object) * self.n - np.array(self.rest, dtype=object)
        return [v if v < 1 << 63 else None for v in (exact * exact).sum(axis=1)]


def summed(rows: DataFrame, dim: int, shape: tuple[int, int], make) -> np.ndarray:
    """Sum over all rows of ``make`` (from integer rows to a matrix of ``shape``).

    Partitions add up their rows; slices of their matrices are added by group, each in one small task.
    """
    height, width = shape
    step = max(1, SLICE_BYTES // (8 * width))

    def run(batches):
        worker_starts()
        total = None
        for x in _parts(batches, dim):
            total = make(x) if total is None else total + make(x)
        if total is not None:
            parts = [total[i : i + step].tobytes() for i in range(0, height, step)]
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(len(parts)), pa.int32()), "part": pa.array(parts, pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_buffer()) for p in group["part"])
        return pa.table({"slice": group["slice"].slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    schema = "slice int, part binary"
    found = rows.select("x").mapInArrow(run, schema).groupBy("slice").applyInArrow(add, schema).collect()
    return np.concatenate([np.frombuffer(bytes(r["part"])) for r in sorted(found, key=lambda r: r["slice"])]).reshape(shape)


def _orthonormal(block: np.ndarray, image: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray | None]:
    """Orthonormal directions that span ``block``, without those of lengths below ``least``; their image under the same steps."""
    u, s, vt = np.linalg.svd(block, full_matrices=False)
    keep = s > least
    turn = vt.T[:, keep] / s[keep]
    return u[:, keep], None if image is None else image @ turn


def lobpcg(product, dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), eigenvectors and the certified residual of the symmetric operator ``product``.

    ``product`` gives the operator's image of a block of columns. The residual is the greatest length of
    A x - e x among the wanted pairs over the greatest e, by a product taken anew. A RuntimeError says
    that residuals above ENOUGH do not fall any more.
    """
    size = min(dim, wanted + GUARD)
    x = np.linalg.qr(np.random.default_rng(13).standard_normal((dim, size)))[0]
    ax, p, ap, fresh = product(x), None, None, True
    best, worse = np.inf, 0

    def rotate():
        g = x.T @ ax
        e, c = np.linalg.eigh((g + g.T) / 2)
        return e[::-1], x @ c[:, ::-1], ax @ c[:, ::-1]

    for _ in range(MAX_ROUNDS):
        e, x, ax = rotate()
        top = max(float(e[0]), 0.0)
        if not top:
            return e[:wanted], x[:, :wanted], 0.0
        residuals = ax - x * e
        worst = float(np.linalg.norm(residuals[:, :wanted], axis=0).max()) / top
        worse = 0 if worst < best / 2 else worse + 1
        best = min(best, worst)
        if worst <= CERTIFIED or worst <= ENOUGH and worse >= 3:
            if fresh:
                return e[:wanted], x[:, :wanted], worst
            x = np.linalg.qr(x)[0]
            ax, p, ap, fresh = product(x), None, None, True
            continue
        if worse >= 50:
            break
        # residuals, orthogonal to the block and the previous directions; what has converged drops out
        base = x if p is None else np.hstack([x, p])
        w = residuals / np.maximum(np.linalg.norm(residuals, axis=0), 1e-300)
        w = w[:, np.linalg.norm(residuals, axis=0) > 1e-16 * top]
        for _ in range(2):
            w = w - base @ (base.T @ w)
            w = _orthonormal(w, None, 1e-10)[0]
        if not w.shape[1] or base.shape[1] + w.shape[1] > dim:
            w = w[:, : max(0, dim - base.shape[1])]
        if not w.shape[1] and fresh:
            return e[:wanted], x[:, :wanted], worst if worst <= ENOUGH else _unsettled(worst)
        aw = product(w) if w.shape[1] else np.zeros((dim, 0))
        s, image = np.hstack([base, w]), np.hstack([ax, aw] if p is None else [ax, ap, aw])
        g = s.T @ image
        _, c = np.linalg.eigh((g + g.T) / 2)
        c = c[:, ::-1][:, :size]
        x, ax, fresh = s @ c, image @ c, False
        p, ap = s[:, size:] @ c[size:], image[:, size:] @ c[size:]
        back = x.T @ p
        p, ap = _orthonormal(p - x @ back, ap - ax @ back, 1e-6)
        p = p - x @ (x.T @ p)
    return _unsettled(best)


def _unsettled(residual: float):
    raise RuntimeError(f"residuals stay at {residual:.3g} of the largest eigenvalue")


def _whitened(rows: DataFrame, dim: int, components: int) -> DataFrame | None:
    """The result for the vectors of one dimension; None where nothing varies."""
    n, sums = exact_sums(rows, dim)
    centre = Centre(n, sums)

    def product(block: np.ndarray) -> np.ndarray:
        def make(x: np.ndarray) -> np.ndarray:
            y = centre.rows(x)
            return y.T @ (y @ block)

        return summed(rows, dim, block.shape, make) / n

    trace = float((summed(rows, dim, (1, dim), lambda x: (centre.rows(x) ** 2).sum(axis=0)[None, :]) / n).sum())
    if trace <= 0:
        return None
    e, x, _ = lobpcg(product, dim, min(dim, components))
    keep = e > LEAST_EIGENVALUE * e[0]
    e, x = e[keep], x[:, keep]
    k = len(e)
    onto = x / np.sqrt(e)

    def moments(rows_in: np.ndarray) -> np.ndarray:
        w = centre.rows(rows_in) @ onto
        return np.vstack([w.T @ w, w.sum(axis=0)])

    sums_of = summed(rows, dim, (k + 1, k), moments) / n
    error = float(np.abs(sums_of[:k] - np.outer(sums_of[k], sums_of[k]) - np.eye(k)).max())
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        worker_starts()
        for b in batches:
            step = max(1, PART_ENTRIES // max(dim, 8 * k))
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                v = np.concatenate(list(_parts([part], dim)))
                m = len(v)
                at = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    part.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(centre.deviations(v), pa.int64()).take(at), pa.array((centre.rows(v) @ onto).ravel()),
                    pa.array(np.tile(e / trace, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable vector and component.

    Left out are vectors that are null or empty or hold null or non-finite entries, and those with
    entries of 2**52 / scale or more, which doubles do not hold as integers. Entries c become
    floor(scale * c) + shift; all usable vectors are the fit list. Components, at most ``components`` and
    the dimension, are numbered from 1 by falling eigenvalue; those whose eigenvalue is rounding (below
    1e-12 of the largest) have no rows, so equal vectors, or a single one, give none. ``deviation`` is
    null beyond 64 bits. Vectors of several dimensions are fitted by dimension, ``n`` being the
    dimension's number. Repeated rows, ids and null ids are rows like others; an empty table gives no
    rows; other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    with Scratch(spark) as scratch:
        rows = scratch.written(integer_rows(vectors, id_col, vec_col, scale, shift), "whitening-rows")
        dims = sorted(r["dim"] for r in rows.select("dim").distinct().collect())
        found = [w for d in dims if (w := _whitened(rows.filter(F.col("dim") == d), d, components)) is not None]
        kind = rows.schema["vec_id"].dataType.simpleString()
        none = spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
        for part in found:
            none = none.union(part) if part is not found[0] else part
        return written(none, "whitened")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
