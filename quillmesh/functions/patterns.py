"""What a regular expression needs: literals of which a match must hold one.

A pattern is tried only on texts that hold one of its literals, which a plain substring search finds far
faster than the pattern. Only what is certain counts; a pattern without a certain literal is always tried.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _branches(p: str) -> list[str]:
    """Alternatives of a pattern at its own level."""
    out, depth, begin, i = [], 0, 0, 0
    while i < len(p):
        c = p[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = _class_end(p, i)
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            out.append(p[begin:i])
            begin = i + 1
        i += 1
    return [*out, p[begin:]]


def _class_end(p: str, i: int) -> int:
    """Place of the bracket that ends the class which begins at ``i``."""
    i += 2 if p[i + 1 : i + 2] == "^" else 1
    i += p[i : i + 1] == "]"
    while p[i] != "]":
        i += 2 if p[i] == "\\" else 1
    return i


def _group_end(p: str, i: int) -> int:
    depth = 0
    while True:
        if p[i] == "\\":
            i += 1
        elif p[i] == "[":
            i = _class_end(p, i)
        elif p[i] == "(":
            depth += 1
        elif p[i] == ")":
            depth -= 1
            if not depth:
                return i
        i += 1


def _sequence(p: str) -> frozenset[str]:
    """Literals of the best part of a pattern without alternatives; empty if nothing is certain."""
    found: list[frozenset[str]] = []
    run, i = "", 0

    def close():
        nonlocal run
        if run:
            found.append(frozenset([run.lower()]))
        run = ""

    while i < len(p):
        c, at = p[i], i
        if c == "(":
            i = _group_end(p, i)
            inner = p[at + 1 : i]
            head = re.match(r"\?(?::|[a-zA-Z]+:|P?<[A-Za-z_]\w*>)", inner)
            inner = inner[head.end() :] if head else ("" if inner.startswith("?") else inner)  # look-arounds and flags hold no text
            literal = None
            group = needed(inner) if inner else frozenset()
        elif c == "[":
            i = _class_end(p, i)
            literal, group = None, frozenset()
        elif c == "\\":
            i += 1
            if p[i : i + 2] in ("p{", "P{"):
                i = p.index("}", i)
            literal = p[i] if not p[i].isalnum() else None
            group = frozenset()
        else:
            literal, group = (None, frozenset()) if c in ".^$" else (c, frozenset())
        i += 1
        count = re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})[?+]?").match(p, i)
        optional = bool(count) and (count[0][0] in "*?" or re.match(r"\{0+[,}]", count[0]))
        i = count.end() if count else i
        if literal is not None and not optional:
            run += literal
            if count:
                close()
        else:
            close()
            if group and not optional:
                found.append(group)
    close()
    return max(found, key=lambda g: (min(map(len, g)), -len(g)), default=frozenset())


def needed(pattern: str) -> frozenset[str]:
    """Lower-case literals of which each match holds one, in lower case; empty if that is not certain."""
    each = [_sequence(b) for b in _branches(pattern)]
    return frozenset().union(*each) if all(each) else frozenset()


def folded(text: Column) -> Column:
    """Lower case for ``needed``: signs that match plain letters without case become these."""
    return F.replace(F.translate(F.lower(text), "ſK", "sk"), F.lit("i̇"), F.lit("i"))


def may_match(low: Column, patterns) -> Column | None:
    """Whether a text, given as ``folded``, holds a literal of each pattern's; None where a pattern needs none."""
    each = [needed(p) for p in patterns]
    if not all(each):
        return None
    literals = sorted(frozenset().union(*each))
    kept = [x for x in literals if not any(y != x and y in x for y in literals)]
    out = F.lit(False)
    for x in kept:
        out = out | F.contains(low, F.lit(x))
    return out
