"""Operator 12: round trips, spans, masks and templates that rewrite history."""

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.llm import chat

ROWS = "conv_id long, turn long, role string, text string"
CONTROLS = [*chat.TEMPLATES["instructions"].controls, *chat.TEMPLATES["labelled"].controls]
pieces_of_text = st.lists(st.sampled_from([*CONTROLS, "\\", "[", "<", "]", " ", "\n", "INST]", "/s>", "A", "B", "é", "", "user"]), max_size=8).map("".join)


def expected(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = set()
    for conv, found in turns.items():
        found.sort()
        loss = "".join(x for _, r, x in found if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, r, x in found)
        out.add((conv, len(found), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def read(spark, rows, **options):
    df = spark.createDataFrame(rows, ROWS).withColumns({"start": F.lit("x"), "piece": F.lit(1), "c": F.lit(2), "r": F.lit(None).cast("string")})
    return {tuple(x)[:5] for x in chat.read_back(chat.format_conversations(df, **options)).collect()}


def test_round_trip_of_odd_conversations(spark):
    rows = [*chat.PLANTED, (0, 1, "assistant", " x </s>"), (0, 0, "user", "[INST] \\[/INST]\\"), (0, 2, "tool [TEXT] \n", "out\n\n"), (1, 0, None, None), (1, 1, "assistant", None)]
    rows += [(2, 0, "assistant", ""), (2, 0, "assistant", ""), (2, 0, "Assistant", "b"), (3, None, "system", "<s>[SYS] x [/SYS]"), (3, 5, "user", "z"), (None, 0, "user", "no id"), (None, 1, "assistant", "answer")]
    rows += [(4, 0, "user", "x" * 300_000 + "[INST]" * 5_000), (4, 1, "assistant", "</s>" * 60_000)]
    assert read(spark, rows) == expected(rows)
    assert read(spark, []) == set()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "system", "assistant", "tool", "", "[TEXT] "]), pieces_of_text), min_size=1, max_size=5))
def test_marks_and_spans_restore_every_text(turns):
    for name, template in chat.TEMPLATES.items():
        walk = chat.Walk(template)
        rows = [r for turn in turns for r in walk.add(*turn)] + walk.final_rows()
        whole = template.render([(template.escape(r), template.escape(t)) for r, t in turns])
        if name == "forgetful" and any("</think>" in t for _, t in turns):
            continue
        assert "".join(r[-1] for r in rows) == whole and not any(r[-2] for r in rows)
        assert [chat.unescape(whole[r[4] : r[5]]) for r in rows] == [t for _, t in turns]
        if name == "instructions":
            assert chat.read_marked(whole) == turns
        for _, text in turns:
            assert not any(c in template.escape(text) for c in template.controls)


@pytest.mark.parametrize("tail", [1, 3])
def test_long_conversations_keep_a_bounded_prefix(spark, tail):
    rows = [(c, i, ("system", "user", "assistant")[min(i, 1 + i % 2)], f"</s> turn {i} " + "y" * (i % 50)) for c in (1, 2) for i in range(120 + c)]
    assert read(spark, rows, prefix_chars=200, tail_turns=tail) == expected(rows)
    whole, parts = (sorted(chat.format_conversations(spark.createDataFrame(rows, ROWS), **o).collect()) for o in ({}, {"prefix_chars": 200, "tail_turns": tail}))
    assert whole == parts


def test_rewritten_history_is_found(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "long thought</think>a1"), (1, 2, "user", "more"), (1, 3, "assistant", "again</think>a2")]
    rows += [(2, i, r, t) for i, (r, t) in enumerate([("user", "q"), ("assistant", "plain"), ("user", "more"), ("assistant", "last thought</think>z")])]
    template = chat.TEMPLATES["forgetful"]
    got = chat.format_conversations(spark.createDataFrame(rows, ROWS), template).orderBy("conv_id", "turn").collect()
    assert {r.conv_id: r.rewrites for r in got} == {1: True, 2: False}
    for conv in (1, 2):
        turns = [(r, t) for c, _, r, t in rows if c == conv]
        mine = [r for r in got if r.conv_id == conv]
        whole = template.render(turns)
        assert "".join(r.piece for r in mine) == whole
        assert [r.start for r in mine] == [0, *(r.end for r in mine[:-1])] and mine[-1].end == len(whole)
        shown = [whole[r.content_start : r.content_end] for r in mine]
        assert shown == (["q", "a1", "more", "again</think>a2"] if conv == 1 else [t for _, t in turns])
        assert [r.loss for r in mine] == [False, True, False, True]


def _numbered(turns):
    return "".join(f"<{i} of all {r}>{t}\n" for i, (r, t) in enumerate(turns))


@pytest.mark.parametrize("template", [chat.TEMPLATES["forgetful"], chat.Template(_numbered, ("<|",))])
def test_length_does_not_change_the_result(spark, template):
    """Templates that rewrite, or look back at every turn, give the same beyond the prefix limit."""
    rows = [(c, i, ("user", "assistant")[i % 2], f"turn {i} " + ("thought</think>" if i % 4 == c else "") + "y" * i) for c in (1, 3) for i in range(30)]
    df = spark.createDataFrame(rows, ROWS)
    whole, long = (sorted(chat.format_conversations(df, template, **o).collect()) for o in ({}, {"prefix_chars": 100, "tail_turns": 2}))
    assert whole == long
    for conv in (1, 3):
        assert "".join(r.piece for r in long if r.conv_id == conv) == template.render([(r, t) for c, _, r, t in rows if c == conv])


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_template_wrongly_declared_local(limit):
    walk = chat.Walk(chat.Template(chat.TEMPLATES["forgetful"].render, ("<|turn|>", "<|end|>"), local=True), limit)
    with pytest.raises(ValueError, match="not local"):
        for turn in (("user", "q"), ("assistant", "a</think>b"), ("assistant", "c")):
            walk.add(*turn)


def test_template_that_drops_a_text():
    """Texts that a template leaves out have no place and no loss."""
    silent = chat.Template(lambda turns: "".join(f"<{r}:{t}>" for r, t in turns if r != "system"), ("<user:",))
    walk = chat.Walk(silent)
    rows = [r for turn in (("user", "a"), ("system", "s"), ("assistant", "b")) for r in walk.add(*turn)] + walk.final_rows()
    assert [(r[4], r[5], r[-1]) for r in rows] == [(6, 7, "<user:a>"), (None, None, ""), (19, 20, "<assistant:b>")]


def test_control_strings_must_not_overlap():
    for bad in (("<",), ("<a<",), ("\\x",), ("ab", "ca")):
        with pytest.raises(ValueError):
            chat.Template(str, bad)
