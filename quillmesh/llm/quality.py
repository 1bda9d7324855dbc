"""Operator 2: quality scores from document statistics.

Statistics of a whole text (character classes, word lengths, repetition, compressibility) go through
random Fourier features, whose inner products approximate a Gaussian kernel. Ridge weights come from
normal equations that each partition sums on its own, per fold, so that kernel width and ridge
strength are chosen by cross-validation from the sums alone. Isotonic regression on out-of-fold
outputs turns them into probabilities.

Fitting reads a bounded sample of labelled rows (``max_rows``); scoring is one narrow pass.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .shared import fold_of, small_batches, table, worker_starts

MAX_TRAINING_ROWS = 20_000
FEATURES = 256
WIDTHS = (0.3, 1.0, 3.0)
RIDGES = (1e-3, 1e-2, 1e-1, 1.0, 10.0)
INNER_FOLDS = 3
SUM_PARTITIONS = 4
SEED = 20240229

_CLASS = np.zeros(256, dtype=np.uint8)  # 0: other sign
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[128:] = 5
_SENTENCE = np.zeros(256, dtype=bool)
_SENTENCE[[ord(c) for c in ".,;:'\"()-"]] = True

STATISTICS = 30


def statistics(text: str | None) -> list[float]:
    """Statistics of one whole text; an empty or null text has zeros only."""
    if not text:
        return [0.0] * STATISTICS
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    byte = np.bincount(data, minlength=256)
    n = len(data)
    kinds = np.bincount(_CLASS, weights=byte, minlength=6)
    share = byte[byte > 0] / n
    odd = int(byte[~_SENTENCE & (_CLASS == 0)].sum())
    words = text.split()
    nw = max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    lines = text.split("\n")
    line_set = set(lines)
    top = counts.most_common(3)
    repeats = sum(map(operator.eq, words, words[1:]))
    letters = max(1.0, kinds[3] + kinds[4])
    packed = len(zlib.compress(raw, 1))
    pairs = set(zip(words, words[1:]))
    sentences = max(1, int(byte[46]))
    return [
        np.log1p(n), np.log1p(nw), np.log1p(len(lines)), kinds[1] / n, kinds[2] / n, kinds[3] / letters, kinds[5] / n, kinds[0] / n,
        odd / n, odd / nw, byte[ord("|")] / nw, byte[ord("!")] / nw, byte[ord("#")] / nw, byte[10] / nw, min(5.0, byte[46] / nw),
        float(-(share * np.log2(share)).sum()), float(lengths.mean()), float(lengths.std()), np.log1p(float(lengths.max())),
        len(counts) / nw, len(counts) / nw**0.8, len(pairs) / nw, repeats / nw, (top[0][1] if top else 0) / nw, sum(c for _, c in top) / nw,
        1 - len(line_set) / len(lines), packed / n, sum(map(str.isupper, words)) / nw, sum(map(str.isalpha, words)) / nw, np.log1p(nw / sentences),
    ]


def statistics_matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=float).reshape(-1, STATISTICS)


@dataclass
class Basis:
    """Standardised statistics to random Fourier features, one block per kernel width."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    def __call__(self, x: np.ndarray, width: float) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) / np.sqrt(STATISTICS)
        with np.errstate(all="ignore"):
            waves = np.sqrt(2.0 / FEATURES) * np.cos(z @ (self.directions / width) + self.phases)
        return np.column_stack([waves, z, np.ones(len(z))])


@dataclass
class QualityModel:
    basis: Basis
    width: float
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, texts) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        raw = self.basis(statistics_matrix(texts), self.width) @ self.weights
        level = np.interp(raw, self.knots, self.values)
        # a thousandth of the raw output keeps the order inside isotonic plateaus
        return np.clip(0.999 * level + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots at the mean of each block, values rising from 0 to 1 at most.

    Equal inputs are pooled first, so the result does not depend on the order of rows.
    """
    knots, group, many = np.unique(x, return_inverse=True, return_counts=True)
    blocks: list[list[float]] = []  # sum of y, count, sum of x
    for xi, yi, n in zip(knots, np.bincount(group, weights=y), many):
        blocks.append([yi, float(n), xi * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, t = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][2] += t
    b = np.array(blocks)
    # a pseudo-count keeps small end blocks from claiming certainty
    return b[:, 2] / b[:, 1], np.maximum.accumulate((b[:, 0] + 0.5 * y.mean()) / (b[:, 1] + 0.5))


def _solve(a: np.ndarray, c: np.ndarray, ridge: float) -> np.ndarray:
    penalty = np.full(len(a), ridge)
    penalty[-1] = 1e-9
    return np.linalg.solve(a + np.diag(penalty + 1e-9), c)


def fit_quality(sample: DataFrame) -> QualityModel:
    """Fit on a bounded frame of (id, text, y). With one class or no rows the score is its mean, or 0.5.

    Repeated rows count as often as they occur; null texts are empty ones.
    """

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        worker_starts()
        return pd.Series(list(statistics_matrix(texts)) if len(texts) else [])

    y = (F.col("y") > 0).cast("double")
    fold = F.pmod(F.xxhash64("_id", F.lit("inner")), F.lit(INNER_FOLDS)).cast("int")
    rows = sample.select(stats("_text").alias("x"), y.alias("y"), fold.alias("fold")).repartition(SUM_PARTITIONS, "fold").persist()
    try:
        moments = [F.struct(F.avg(F.col("x")[i]), F.stddev_pop(F.col("x")[i])).alias(f"m{i}") for i in range(STATISTICS)]
        head = rows.agg(F.count("y").alias("n"), F.avg("y").alias("rate"), *moments).first()
        rng = np.random.default_rng(SEED)
        directions, phases = rng.normal(size=(STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
        if not head["n"]:
            basis = Basis(np.zeros(STATISTICS), np.ones(STATISTICS), directions, phases)
            return QualityModel(basis, 1.0, np.zeros(FEATURES + STATISTICS + 1), np.array([0.0]), np.array([0.5]))
        mean = np.array([head[f"m{i}"][0] for i in range(STATISTICS)])
        scale = np.array([head[f"m{i}"][1] for i in range(STATISTICS)])
        basis = Basis(mean, np.where(scale > 1e-9, scale, 1.0), directions, phases)
        if head["rate"] in (0.0, 1.0):
            return QualityModel(basis, 1.0, np.zeros(FEATURES + STATISTICS + 1), np.array([0.0]), np.array([head["rate"]]))

        def sums(batches):
            """Normal equations of this partition, by fold and kernel width."""
            held: dict[tuple[int, int], list] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.array(b.column(0).to_pylist(), dtype=float)
                t, f = np.array(b.column(1)), np.array(b.column(2))
                for k, width in enumerate(WIDTHS):
                    z = basis(x, width)
                    for i in np.unique(f):
                        zi, ti = z[f == i], t[f == i]
                        got = held.setdefault((int(i), k), [0.0, 0.0, 0.0, 0])
                        for j, part in enumerate((zi.T @ zi, zi.T @ ti, ti @ ti, len(ti))):
                            got[j] = got[j] + part
            if held:
                keys = list(held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in keys]), pa.array([k for _, k in keys]), pa.array([held[q][0].tobytes() for q in keys]), pa.array([held[q][1].tobytes() for q in keys]), pa.array([float(held[q][2]) for q in keys]), pa.array([held[q][3] for q in keys])],
                    ["fold", "width", "a", "c", "yy", "n"],
                )

        total: dict[tuple[int, int], list] = {}
        size = FEATURES + STATISTICS + 1
        for r in rows.mapInArrow(sums, "fold long, width long, a binary, c binary, yy double, n long").toLocalIterator():
            got = total.setdefault((r["fold"], r["width"]), [np.zeros((size, size)), np.zeros(size), 0.0, 0])
            got[0] += np.frombuffer(bytes(r["a"])).reshape(size, size)
            got[1] += np.frombuffer(bytes(r["c"]))
            got[2] += r["yy"]
            got[3] += r["n"]
        folds = sorted({f for f, _ in total})

        def without(k: int, fold: int | None):
            parts = [total[f, k] for f in folds if f != fold or len(folds) == 1]
            return sum(p[0] for p in parts), sum(p[1] for p in parts)

        def loss(k: int, ridge: float) -> float:
            out = 0.0
            for f in folds:
                w = _solve(*without(k, f), ridge)
                a, c, yy, _ = total[f, k]
                out += yy - 2 * w @ c + w @ a @ w
            return out

        _, k, ridge = min((loss(k, r), k, r) for k in range(len(WIDTHS)) for r in RIDGES)
        weights = _solve(*without(k, None), ridge)
        by_fold = {f: _solve(*without(k, f), ridge) for f in folds}

        def outputs(batches):
            """Out-of-fold outputs, for calibration."""
            for b in batches:
                if b.num_rows:
                    z, f = basis(np.array(b.column(0).to_pylist(), dtype=float), WIDTHS[k]), np.array(b.column(2))
                    raw = np.array([zi @ by_fold[int(i)] for zi, i in zip(z, f)])
                    yield pa.RecordBatch.from_arrays([pa.array(raw), b.column(1)], ["raw", "y"])

        pairs = rows.mapInArrow(outputs, "raw double, y double").collect()
        # copies differ in the last digits of an output, by where they stand in a batch
        knots, values = isotonic(np.array([r["raw"] for r in pairs]).round(9), np.array([r["y"] for r in pairs]))
        return QualityModel(basis, WIDTHS[k], weights, knots, values)
    finally:
        rows.unpersist()


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` plus a score from 0 to 1 per whole text; null texts score as empty ones.

    One narrow pass; repeated rows score alike, an empty table gives none. Other columns are kept and
    not read; one named like ``score_col`` is replaced.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        worker_starts()
        return pd.Series(model.score(texts.tolist()), dtype="float64")

    return docs.withColumn(score_col, score(F.col(text_col)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", 5, 0, MAX_TRAINING_ROWS))
    scored = score_quality(docs, model)
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
