"""Operator 11: spelling variants grouped by a rare-first prefix filter over positional bigrams.

Words are counted over all texts on the JVM. One edit touches at most two bigrams of a word, so of the
three bigrams of a word that come first in one global order (rarest first, equal ones by their place)
at least one survives any edit and is also among the other word's three: equal words are joined on
(bigram, place, length) of these three alone. An edit that keeps the length keeps places; one more
letter keeps them before the edit and moves them by one behind it, which gives three exact probes for
each bigram. Letter parities thin what meets, and ``levenshtein`` on the JVM decides.

The order has one entry for each pair of the alphabet's 90 letters, 8,100 at most, so it is sent
everywhere. A cell of the join that holds many words is dealt out in blocks on both sides.
"""

from __future__ import annotations

from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, small_batches, table, worker_starts, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
LEAST_CHARS, LEAST_COUNT, TIMES, DROP_PERIOD = 7, 2, 10, 31
PREFIX = 3  # bigrams that one edit can touch, and one more
CELL_WORDS = 4_096


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, drop_period: int = DROP_PERIOD
) -> DataFrame:
    """(word, n): the words of all texts with at least ``least_chars`` letters that occur ``least_count`` times.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. Where ``drop_period``
    divides the crc32 of "<id>:<run>", the run loses its letter number crc32 modulo its length (0: no
    run does). Null texts have no words; a null id is written as nothing; repeated rows count again.
    """
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(f"[a-zÀ-ÿ]{{{least_chars},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    word = F.col("run")
    if drop_period:
        found = found.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
        at = (F.col("h") % F.length("run")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % drop_period == 0, shorter).otherwise(F.col("run"))
    words = found.select(word.alias("word")).filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """Place of each bigram in the global order: those that fewer words hold come first, ties by the bigram."""

    def count(batches):
        worker_starts()
        held: dict[str, int] = {}
        for b in batches:
            for w in b.column(0).to_pylist():
                for g in {w[i : i + 2] for i in range(len(w) - 1)}:
                    held[g] = held.get(g, 0) + 1
        yield pa.RecordBatch.from_pydict({"gram": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    rows = words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r["gram"]: i for i, r in enumerate(sorted(rows, key=lambda r: (r["n"], r["gram"])))}


def rarest(word: str, order: dict[str, int]) -> list[tuple[int, int]]:
    """The word's first bigrams in the global order, as (bigram's place in the order, place in the word)."""
    return nsmallest(PREFIX, ((order[word[i : i + 2]], i) for i in range(len(word) - 1)))


def prefixes(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """(word, n, chars, parity, gram, at): a row for each of the word's rarest bigrams.

    ``parity`` has a bit for each letter (two letters may share one) that says whether its count is odd.
    """
    shared = words.sparkSession.sparkContext.broadcast(order)
    bit = {c: 1 << (i % 63) for i, c in enumerate(LETTERS)}

    def run(batches):
        worker_starts()
        for b in batches:
            at, chars, parity, gram, place = [], [], [], [], []
            for k, w in enumerate(b.column(0).to_pylist()):
                p = 0
                for c in w:
                    p ^= bit[c]
                for g, i in rarest(w, shared.value):
                    at.append(k)
                    chars.append(len(w))
                    parity.append(p)
                    gram.append(g)
                    place.append(i)
            taken = b.take(pa.array(at, pa.int64()))
            columns = [*taken.columns, pa.array(chars, pa.int32()), pa.array(parity, pa.int64()), pa.array(gram, pa.int32()), pa.array(place, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "chars", "parity", "gram", "at"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, chars int, parity long, gram int, at int")


def _dealt(side: DataFrame, cells: DataFrame, own: str, other: str, key: list[str]) -> DataFrame:
    """Rows of one side of the join with their block of ``own`` and every block of ``other``."""
    met = side.join(cells, key, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in (own, other)})
    mine = F.pmod(F.xxhash64("word"), F.col(own).cast("long")).cast("int")
    return met.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))


def near_pairs(first: DataFrame) -> DataFrame:
    """(a, na, b, nb): every pair of words that differ by one letter inserted, deleted or replaced, once."""
    probe = F.explode(
        F.array(
            F.struct(F.col("at").alias("p"), F.col("chars").alias("l")),
            F.struct(F.col("at").alias("p"), (F.col("chars") + 1).alias("l")),
            F.struct((F.col("at") + 1).alias("p"), (F.col("chars") + 1).alias("l")),
        )
    )
    key = ["g", "p", "l"]
    left = first.select("word", "n", "chars", "parity", F.col("gram").alias("g"), probe.alias("q")).select("word", "n", "chars", "parity", "g", "q.p", "q.l")
    right = first.select("word", "n", "parity", F.col("gram").alias("g"), F.col("at").alias("p"), F.col("chars").alias("l"))
    sizes = left.select(*key, F.lit(1).alias("x"), F.lit(0).alias("y")).union(right.select(*key, F.lit(0), F.lit(1))).groupBy(*key).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    large = sizes.filter((F.greatest("x", "y") > CELL_WORDS) & (F.col("y") > 0)).select(*key, *(F.ceil(F.col(c) / CELL_WORDS).cast("int").alias(f"{c}_block") for c in ("x", "y")))
    large = large.withColumns({c: F.greatest(c, F.lit(1)) for c in ("x_block", "y_block")})
    a = _dealt(left, large, "x_block", "y_block", key).select(*key, "x_block", "y_block", F.col("word").alias("a"), F.col("n").alias("na"), F.col("chars"), F.col("parity").alias("pa"))
    b = _dealt(right, large, "y_block", "x_block", key).select(*(F.col(c).alias(f"r_{c}") for c in (*key, "x_block", "y_block")), F.col("word").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    same = [F.col(c) == F.col(f"r_{c}") for c in (*key, "x_block", "y_block")]
    differ = F.bit_count(F.col("pa").bitwiseXOR(F.col("pb")))
    likely = F.when(F.col("l") == F.col("chars"), (F.col("a") < F.col("b")) & (differ <= 2)).otherwise(differ == 1)
    met = a.join(b, [*same, likely, F.levenshtein("a", "b", 1) == 1])
    return met.select("a", "na", "b", "nb").distinct()


def _followed(forms: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """(word, root) for words with a form: forms followed to the last by doubling steps.

    A form occurs TIMES as often as its word at least, so a chain has few links and no circle.
    """
    now, links = forms.select("word", F.col("form").alias("root")), 1
    longest = max(1, len(str(most)))  # links that counts up to ``most`` allow, TIMES being 10 or more
    while links < longest:
        to = now.select(F.col("word").alias("w"), F.col("root").alias("r"))
        now = scratch.written(now.join(to, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root")), "spelling-roots")
        links *= 2
    return now


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, times: int = TIMES, drop_period: int = DROP_PERIOD
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``word_counts``.

    Two words are near if one inserted, deleted or replaced letter makes one the other; n_near counts a
    word's near words. Its form is that of the largest n (ties: the smallest in code-point order) if
    this is at least ``times`` (10 or more) the word's n, else null; root follows forms to the last and
    is the word itself where it has none. An empty table, or texts without such words, give no rows.
    Other columns are not read, so their names cannot clash. ``least_chars`` is 4 at least, as shorter
    words have fewer than three bigrams.
    """
    if least_chars < PREFIX + 1 or times < 10:
        raise ValueError("words need 4 letters or more, forms 10 times the count or more")
    spark = docs.sparkSession
    small_batches(spark)
    with Scratch(spark) as scratch:
        counted = word_counts(docs.select(id_col, text_col), id_col, text_col, least_chars, least_count, drop_period)
        words = scratch.written(counted, "spelling-words")
        first = scratch.written(prefixes(words, bigram_order(words)), "spelling-prefixes")
        pairs = near_pairs(first)
        both = F.explode(F.array(F.struct(F.col("a").alias("w"), F.col("b").alias("o"), F.col("nb").alias("m")), F.struct(F.col("b").alias("w"), F.col("a").alias("o"), F.col("na").alias("m"))))
        near = pairs.select(both.alias("s")).groupBy(F.col("s.w").alias("w")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("s.m")).alias("m"), F.col("s.o").alias("o"))).alias("best"))
        near = near.select("w", "n_near", F.col("best.o").alias("best"), (-F.col("best.m")).alias("best_n"))
        met = words.join(near, F.col("word") == F.col("w"), "left")
        enough = F.col("best_n") >= F.lit(times) * F.col("n")
        kept = [F.when(enough, F.col(c)).alias(name) for c, name in (("best", "form"), ("best_n", "form_n"))]
        met = scratch.written(met.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *kept), "spelling-forms")
        most = met.agg(F.max("n")).first()[0] or 0
        roots = _followed(met.filter(F.col("form").isNotNull()), most, scratch).withColumnRenamed("word", "w")
        out = met.join(roots, F.col("word") == F.col("w"), "left")
        return written(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), "form_n"), "spelling-variants")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
