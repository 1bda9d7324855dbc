"""Operator 7: toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts and digit substitutions
become plain letters, everything that is no letter becomes a space. The lexicon holds whole words and
word beginnings, each weighted by its log odds between toxic and clean training documents; exception
phrases (words or word pairs around a match that clean documents use) cancel the match they cover.
The sum of weights is normalised by a fitted power of the document's length and mapped to a score by
a logistic curve.

Learning reads a bounded sample of labelled rows outside the held-out fold (``max_rows``); scoring is
one narrow pass over all whole texts.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .shared import fold_of, small_batches, table, worker_starts

MAX_TRAINING_ROWS = 20_000
PREFIX_LENGTHS = range(3, 11)
SIGNIFICANCE = 1.0  # patterns expected to pass by chance
LENGTH_POWERS = (0.125, 0.25, 0.5, 1.0)
NEAR_COPY = 0.8  # shingle Jaccard from which a row is a copy
SKETCH, BAND = 128, 4  # min-hashes of a row, and how many of them a bucket's key takes
PROPOSED = 0.65  # estimate from which a pair is verified, four deviations below NEAR_COPY

#: Look-alike letters (Cyrillic and Greek) and digit or symbol substitutions; fixed values.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i",
}


class Folding(dict):
    """Translation table from code point to folded text, filled as characters occur."""

    def __missing__(self, point: int) -> str:
        c = unicodedata.normalize("NFKC", chr(point)).lower()
        self[point] = out = "".join(LOOK_ALIKES.get(x, x if x.isalpha() else " ") for x in c) or " "
        return out


FOLD = Folding()


#: Characters without width, which would split a word.
UNSEEN = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")


def _word(w: str) -> str:
    """A word without the punctuation around it.

    Of the signs @ $ ! at its edges those stand for letters that touch a letter, but for a final "!".
    A leading "@" may also be a mark before a name, so such a word is given both ways.
    """
    if "@" not in w and "$" not in w and w[0] != "!":
        return w.strip("!.,;:?")
    w = w.strip(".,;:?")
    rest = w.lstrip("@$!")
    head, rest = w[: len(w) - len(rest)], rest.rstrip("!.,;:?")
    body = rest.rstrip("@$")
    if not body:
        return ""
    head, tail = head if body[0].isalpha() else "", rest[len(body) :] if body[-1].isalpha() else ""
    return f"{body}{tail} {head}{body}{tail}" if head.startswith("@") else f"{head}{body}{tail}"


def fold(text: str | None) -> str:
    """Folded text with a space at both ends, so that patterns can carry word boundaries.

    Characters without width are dropped; a sign inside a word stands for a letter, see ``_word`` for
    those at its edges.
    """
    text = text or ""
    words = (text if text.isascii() else UNSEEN.sub("", text)).split()
    return f" {' '.join([w if w.isalpha() else _word(w) for w in words])} ".lower().translate(FOLD) if words else " "


def patterns_of(folded: str) -> set[str]:
    """Patterns a text contains: ' word ' for whole words and ' begin' for word beginnings."""
    words = set(folded.split())
    out = {f" {w} " for w in words if len(w) >= PREFIX_LENGTHS[0]}
    for k in PREFIX_LENGTHS:
        out.update(f" {w[:k]}" for w in words if len(w) >= k)
    return out


def shingles_of(folded: str) -> set[str]:
    """Three-word shingles of a folded text; a shorter text is one shingle."""
    words = folded.split()
    return {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}


def jaccard(a: set[str], b: set[str]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


_MULTIPLY, _ADD = np.random.default_rng(0x5EED).integers(1, 2**63, (2, SKETCH), dtype=np.uint64) | np.uint64(1)


def sketch(shingles: set[str]) -> np.ndarray:
    """SKETCH min-hashes; two sets agree in a share of them that estimates their Jaccard."""
    h = np.fromiter((zlib.crc32(x.encode()) for x in shingles), np.uint64, len(shingles))
    out = np.full(SKETCH, 2**32 - 1, np.uint64)
    for i in range(0, len(h), 1024):
        np.minimum(out, ((h[i : i + 1024, None] * _MULTIPLY + _ADD) >> np.uint64(32)).min(axis=0), out=out)
    return out.astype("<u4")


class CopyFinder:
    """Greedy choice among rows in id order: a row goes only into an earlier kept row of its label.

    Sketches propose pairs; ``known`` holds, by (row, kept row), whether the exact Jaccard suffices. A
    pass names the pairs it lacks and goes on by the estimate, so passes repeat until none is lacking.
    """

    def __init__(self, labels: list[int], sketches: np.ndarray):
        self.labels, self.sketches, self.known = labels, sketches, {}
        bands = np.ascontiguousarray(sketches).view(np.dtype((np.void, 4 * BAND)))
        self.keys = [[(y, i, k) for i, k in enumerate(row.tolist())] for y, row in zip(labels, bands)]

    def choose(self) -> tuple[dict[int, int], list[tuple[int, int]]]:
        """({row: the kept row it is a copy of}, pairs to verify)"""
        buckets: dict[tuple, list[int]] = {}
        copies, lacking = {}, []
        for row, keys in enumerate(self.keys):
            near = np.array(sorted({k for key in keys for k in buckets.get(key, ())}), dtype=np.int64)
            into = None
            if len(near):
                alike = (self.sketches[near] == self.sketches[row]).mean(axis=1)
                order = np.lexsort((near, -alike))
                proposed = [(int(near[i]), float(alike[i])) for i in order if alike[i] >= PROPOSED]
                into = next((k for k, _ in proposed if self.known.get((row, k))), None)
                if into is None and (unknown := [(k, e) for k, e in proposed if (row, k) not in self.known]):
                    likely = unknown[0][1] >= NEAR_COPY
                    lacking += [(row, k) for k, _ in (unknown[:1] if likely else unknown)]
                    into = unknown[0][0] if likely else None
            if into is None:
                for key in keys:
                    buckets.setdefault(key, []).append(row)
            else:
                copies[row] = into
        return copies, lacking


def without_copies(sample: DataFrame) -> DataFrame:
    """One row of each group of near copies of the bounded sample, so that copies are not taken for evidence.

    A row goes only if a kept row of the same label, with a smaller id, has a shingle Jaccard of
    NEAR_COPY or more to it; that is computed on the whole shingle sets. Equal sets are met by digest.
    Of each row the driver holds a sketch of fixed size, never the text. The result is persisted.
    """
    spark = sample.sparkSession

    def sketched(batches):
        worker_starts()
        for b in batches:
            digests, sketches = [], []
            for t in b.column(1).to_pylist():
                shingles = shingles_of(fold(t))
                digests.append(hashlib.blake2b("\n".join(sorted(shingles)).encode(), digest_size=16).digest())
                sketches.append(sketch(shingles).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], [*b.schema.names, "digest", "sketch"])

    def verified(batches):
        for b in batches:
            row, kept, text, other = (b.column(i).to_pylist() for i in range(4))
            same = [jaccard(shingles_of(fold(s)), shingles_of(fold(t))) >= NEAR_COPY for s, t in zip(text, other)]
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(kept, pa.int64()), pa.array(same)], ["row", "kept", "same"])

    rows = sample.select("_id", "_text", "y").mapInArrow(sketched, f"_id {sample.schema['_id'].dataType.simpleString()}, _text string, y int, digest binary, sketch binary")
    rows = rows.groupBy("digest", "y").agg(F.min(F.struct("_id", "_text", "sketch")).alias("r")).select("digest", "y", "r.*").persist()
    try:
        known = rows.select("_id", "digest", "y", "sketch").orderBy("_id", "digest", "y").collect()
        finder = CopyFinder([r["y"] for r in known], np.frombuffer(b"".join(bytes(r["sketch"]) for r in known), "<u4").reshape(len(known), SKETCH))
        name = [(bytes(r["digest"]), r["y"]) for r in known]
        copies, lacking = finder.choose()
        while lacking:
            pairs = spark.createDataFrame([(r, k, *name[r], name[k][0]) for r, k in lacking], "row long, kept long, digest binary, y int, other binary")
            left = rows.join(F.broadcast(pairs), ["digest", "y"]).select("row", "kept", "_text", "other", "y")
            right = rows.select(F.col("digest").alias("other"), "y", F.col("_text").alias("_other"))
            both = left.join(right, ["other", "y"]).select("row", "kept", "_text", "_other")
            finder.known |= {(r["row"], r["kept"]): r["same"] for r in both.mapInArrow(verified, "row long, kept long, same boolean").collect()}
            copies, lacking = finder.choose()
        if copies:
            gone = spark.createDataFrame([name[r] for r in copies], "digest binary, y int")
            kept = rows.join(F.broadcast(gone), ["digest", "y"], "left_anti").select("_id", "_text", "y").persist()
        else:
            kept = rows.select("_id", "_text", "y").persist()
        kept.count()
        return kept
    finally:
        rows.unpersist()


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    power: float = 0.5
    slope: float = 1.0
    intercept: float = -2.0
    _automaton: object = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def __setstate__(self, state):
        self.__dict__ |= state | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for p, w in self.weights.items():
                self._automaton.add_word(p, (len(p), w))
            for p in self.exceptions:
                self._automaton.add_word(p, (len(p), None))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def weight(self, folded: str) -> float:
        """Sum of the weights of matches that no exception phrase covers; of a word's matches the longest counts."""
        automaton = self.automaton()
        if not len(automaton):
            return 0.0
        hits: dict[int, tuple[int, float]] = {}
        covered: list[tuple[int, int]] = []
        for end, (size, w) in automaton.iter(folded):
            start = end - size + 1
            if w is None:
                covered.append((start, end))
            elif start not in hits or hits[start][0] < size:
                hits[start] = (size, w)
        if covered:
            # one sweep: the furthest end of the phrases that begin at or before a hit
            total, end, k = 0.0, 0, 0
            covered.sort()
            for at in sorted(hits):
                while k < len(covered) and covered[k][0] <= at:
                    end, k = max(end, covered[k][1]), k + 1
                if at >= end:
                    total += hits[at][1]
            return total
        return sum(w for _, w in hits.values())

    def score(self, text: str | None) -> float:
        folded = fold(text)
        x = self.weight(folded) / max(1, folded.count(" ")) ** self.power
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * x))))


def log_tail(k: int, n: int, p: float) -> float:
    """log of P(X >= k) for X binomial(n, p), k > n p, by its largest terms."""
    total, term = 0.0, 1.0
    for i in range(k, min(n, k + 200)):
        term *= (n - i) / (i + 1) * p / (1 - p)
        total += term
        if term < 1e-12:
            break
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    return first + math.log1p(total)


def choose_lexicon(counts: dict[str, tuple[int, int]], toxic: int, clean: int, candidates: int) -> dict[str, float]:
    """Patterns whose toxic share is beyond chance over all candidates, with their log odds.

    A beginning that says no more than a longer pattern is left out, so "stu" does not stand beside
    "stupid" when every hit of it is that word.
    """
    if not toxic or not clean:
        return {}
    base, found = toxic / (toxic + clean), {}
    for p, (t, c) in counts.items():
        if t >= 2 and t / (t + c) >= min(0.5, 3 * base) and log_tail(t, t + c, base) + math.log(max(1, candidates)) < math.log(SIGNIFICANCE):
            found[p] = (t, c)
    same: dict[tuple[str, int, int], str] = {}
    for p in sorted(found, key=lambda p: (len(p), p)):
        same[(p[: PREFIX_LENGTHS[0] + 1], *found[p])] = p  # the longest of a chain with equal counts
    kept = set(same.values())
    return {p: log_odds(t, c, toxic, clean) for p, (t, c) in found.items() if p in kept}


def log_odds(t: float, c: float, toxic: int, clean: int) -> float:
    return math.log((t + 0.5) / (c + 0.5)) - math.log(toxic / clean)


def refine(words: dict[str, tuple[int, int]], model: "ToxicityModel", toxic: int, clean: int) -> tuple[dict[str, float], list[str]]:
    """Weights of single words below a matched beginning, and exception phrases.

    A word's counts are shrunk towards the share of the beginning it extends; words that clean
    documents use like any other get weight 0. A pair of words around a match is an exception when
    clean documents use it (three times at least) no less than chance.
    """
    single: dict[str, float] = {}
    phrases: list[str] = []
    prior_odds = toxic / clean
    for p, (t, c) in words.items():
        if p.count(" ") == 2:
            odds = math.exp(model.weight(p)) * prior_odds
            share = odds / (1 + odds)
            w = math.log((t + 2 * share) / (c + 2 * (1 - share))) - math.log(prior_odds)
            single[p] = w if w > 0.5 else 0.0
        elif c >= 3 and log_odds(t, c, toxic, clean) < 0.5:
            phrases.append(p)
    return single, sorted(phrases)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[float, float, float]:
    """Slope, intercept and mean loss of a one-variable logistic fit by damped Newton steps."""
    scale = float(np.median(np.abs(x[y > 0]))) if (y > 0).any() else 1.0  # the usual size of a positive
    scale = scale or 1.0
    z = np.column_stack([x / scale, np.ones_like(x)])
    w = np.zeros(2)
    penalty = np.diag([ridge, ridge * 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-9, 1 - 1e-9)
    loss = float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    return float(w[0] / scale), float(w[1]), loss


def _pair_counts(sample: DataFrame, emit, schema: str) -> DataFrame:
    """Sum (toxic, clean) document counts of what ``emit(folded, y)`` yields, combined per batch first."""

    def run(batches):
        worker_starts()
        for b in batches:
            toxic, clean = Counter(), Counter()
            for text, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                (toxic if y else clean).update(emit(fold(text)))
            keys = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], ["p", "t", "c"])

    return sample.mapInArrow(run, schema).groupBy("p").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def fit_toxicity(sample: DataFrame) -> ToxicityModel:
    """Fit on a bounded frame of (id, text, y). Without both classes every document scores low.

    Repeated rows and near copies of one label count once; null texts are empty ones.
    """
    sample = without_copies(sample)
    try:
        sizes = {r["y"]: r["count"] for r in sample.groupBy((F.col("y") > 0).cast("int").alias("y")).count().collect()}
        toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
        model = ToxicityModel()
        if not toxic or not clean:
            return model
        schema = "p string, t long, c long"
        # candidates come from toxic documents; clean ones only count those
        pool = _pair_counts(sample.filter("y > 0"), patterns_of, schema).filter("t >= 2")
        tried = pool.count()
        # fewer toxic documents than this are not beyond chance, even without clean ones
        least = math.log(max(1, tried) / SIGNIFICANCE) / -math.log(toxic / (toxic + clean))
        # bounded by the sample: each toxic row of it brings at most its own words and beginnings
        names = frozenset(r["p"] for r in pool.filter(F.col("t") > least).collect())
        counts = {r["p"]: (r["t"], r["c"]) for r in _pair_counts(sample, lambda s: patterns_of(s) & names, schema).collect()}
        model.weights = choose_lexicon(counts, toxic, clean, tried)
        if model.weights:
            words = {r["p"]: (r["t"], r["c"]) for r in _around_matches(sample, model, schema).collect()}
            single, model.exceptions = refine(words, model, toxic, clean)
            model.weights |= single
            model._automaton = None
        rows = [(r["w"], r["n"], r["y"]) for r in _weights(sample, model).collect()]
        w, n, y = (np.array(c, dtype=float) for c in zip(*rows))
        fits = [(fit_logistic(w / np.maximum(1, n) ** a, y), a) for a in LENGTH_POWERS]
        (model.slope, model.intercept, _), model.power = min(fits, key=lambda f: f[0][2])
        return model
    finally:
        sample.unpersist()


def _around_matches(sample: DataFrame, model: ToxicityModel, schema: str) -> DataFrame:
    """Document counts of matched words, and of the word pairs they stand in."""

    def around(folded: str) -> set[str]:
        out: set[str] = set()
        if not model.weight(folded):
            return out
        words = folded.split()
        for i, w in enumerate(words):
            s = f" {w} "
            if model.weight(s):
                out.add(s)
                if i:
                    out.add(f" {words[i - 1]} {w} ")
                if i + 1 < len(words):
                    out.add(f" {w} {words[i + 1]} ")
        return out

    return _pair_counts(sample, around, schema).filter("t + c >= 2")


def _weights(sample: DataFrame, model: ToxicityModel) -> DataFrame:
    def run(batches):
        for b in batches:
            folded = [fold(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([float(model.weight(f)) for f in folded]), pa.array([f.count(" ") for f in folded], pa.int64()), pa.array([int(y > 0) for y in b.column(2).to_pylist()], pa.int64())], ["w", "n", "y"])

    return sample.mapInArrow(run, "w double, n long, y long")


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` plus a score from 0 to 1 per whole text; null texts score as empty ones.

    One narrow pass; repeated rows score alike, an empty table gives none. Other columns are kept and
    not read; one named like ``score_col`` is replaced.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        worker_starts()
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.withColumn(score_col, score(F.col(text_col)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", 3, 1, MAX_TRAINING_ROWS))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
