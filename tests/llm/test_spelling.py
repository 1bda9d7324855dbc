"""Operator 11 against brute force, and its edge cases."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.llm import spelling

DOCS = "doc_id long, text string"


def edit_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least_chars=7, least_count=2, times=10, period=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if period and h % period == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_chars:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= least_count}
    out, form = {}, {}
    for w, n in counts.items():
        near = [o for o in counts if edit_one(w, o)]
        best = min(near, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= times * n else None
        out[w] = (n, len(near))
    result = set()
    for w, (n, near) in out.items():
        root = w
        while form[root]:
            root = form[root]
        result.add((w, form[w], root, n, near, counts[form[w]] if form[w] else None))
    return result


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("cell", [3, 4096])
def test_spelling_variants(spark, monkeypatch, cell):
    monkeypatch.setattr(spelling, "CELL_WORDS", cell)
    r = random.Random(cell)
    letters = "abcéß×ÿz"
    stems = ["".join(r.choice(letters) for _ in range(r.randrange(7, 12))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "abababab", "bababab", "aaaaaaab"]
    words = []
    for s in stems:
        words += [s] * r.choice((3, 30, 400))
        for _ in range(25):
            i, kind = r.randrange(len(s)), r.randrange(3)
            v = s[:i] + ("" if kind == 0 else r.choice(letters)) + s[i + (kind < 2) :]
            words += [v] * r.choice((1, 2, 3, 25))
    r.shuffle(words)
    rows = [(i, " ".join(w.upper() if r.random() < 0.2 and w.isascii() else w for w in words[i::40])) for i in range(40)]
    rows += [(3, rows[3][1]), (100, None), (101, ""), (None, "aaaaaaa " * 5), (102, "İstanbullu don't2aaaaaaa_aaaaaaa\u0100aaaaaaab")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"word": F.lit(1), "n": F.lit("x"), "id": F.lit(None).cast("string"), "run": F.lit(0), "h": F.lit(2)})
    got = rows_of(spelling.spelling_variants(docs))
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert any(root not in (word, form) for word, form, root, *_ in got)


def test_spelling_without_words(spark):
    empty = spark.createDataFrame([], DOCS)
    assert spelling.spelling_variants(empty).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, ""), (3, "short words only"), (4, "onlyonce")], DOCS)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(empty, least_chars=3)


def test_spelling_very_long_words(spark):
    """Words of a hundred thousand letters, near ones among them."""
    r = random.Random(1)
    word = "".join(r.choice("abcdefgh") for _ in range(100_000))
    other = word[:50_000] + "zz" + word[50_000:]
    near = word[:70_000] + "q" + word[70_001:]
    text = " ".join([word] * 2 + [other] * 2 + [near] * 20)
    got = {len(w): (form == near, root == near, n, k) for w, form, root, n, k, _ in rows_of(spelling.spelling_variants(spark.createDataFrame([(1, text)], DOCS), drop_period=0)) if w != near}
    assert got == {100_000: (True, True, 2, 1), 100_002: (False, False, 2, 0)}


def test_ties_of_forms_go_to_the_smaller_word(spark):
    text = "aaaaaaa " * 2 + "aaaaaaz " * 20 + "aaaaaaé " * 20 + "baaaaaa " * 19
    got = {w: (form, n_near) for w, form, _, _, n_near, _ in rows_of(spelling.spelling_variants(spark.createDataFrame([(1, text)], DOCS), drop_period=0))}
    assert got["aaaaaaa"] == ("aaaaaaz", 3) and got["aaaaaaz"] == (None, 2)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=4, max_size=9), st.integers(0, 8), st.sampled_from("abcd"), st.integers(0, 2), st.randoms(use_true_random=False))
def test_near_words_share_a_rarest_bigram(word, at, letter, kind, r):
    """Whatever the order, words one edit apart meet at one of the three probes of their rarest bigrams."""
    at = min(at, len(word) - 1)
    other = word[:at] + ("" if kind == 0 else letter) + word[at + (kind < 2) :]
    if len(other) < 4 or not edit_one(word, other):
        return
    a, b = sorted((word, other), key=len)
    grams = sorted({w[i : i + 2] for w in (a, b) for i in range(len(w) - 1)})
    r.shuffle(grams)
    order = {g: i for i, g in enumerate(grams)}
    moves = (0,) if len(a) == len(b) else (0, 1)
    met = {(g, p + m) for g, p in spelling.rarest(a, order) for m in moves} & set(spelling.rarest(b, order))
    assert met
