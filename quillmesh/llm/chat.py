"""Operator 12: chat formatting by rendering successive turn prefixes of a black-box template.

A template is a function from turns to one string; nothing is known of it but its outputs. The prefixes
of a conversation, one turn longer each time, are rendered one after the other. Where an output goes on
from the one before, what it adds is the new turn's span; where it does not, the template has rewritten
history, which is reported. Two more renderings with one-letter texts in the turn's place show where in
its span the text begins and ends: they differ in nothing else. Loss falls on the assistants' texts.

Rows are sorted by conversation and turn within their partitions and worked off as a stream. For a
template that is declared ``local``, what is kept of a conversation is bounded: prefixes grow to
PREFIX_CHARS, beyond that a prefix is its first turn and its last TAIL_TURNS ones. Any other template is
given whole prefixes, however long. The output has a row for each turn; its pieces joined are the
formatted text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, small_batches, table, worker_starts, written

PREFIX_CHARS = 1 << 20
TAIL_TURNS = 8
BATCH_CHARS = 1 << 22
ASSISTANT = "assistant"
#: A conversation of control strings, formatted with those of the table.
PLANTED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, ASSISTANT, "</s>[INST] ok [/INST]")]
PIECES = "conv_id {kind}, turn long, role string, start long, end long, content_start long, content_end long, loss boolean, rewrites boolean, piece string"

Turns = list[tuple[str, str]]


@dataclass(frozen=True)
class Template:
    """A function from (role, text) turns to a string, and the control strings that mark turns in it.

    Texts and roles are escaped before the function sees them: a backslash is doubled, and one more goes
    behind the first sign of each control string, so that none is left and every text can be restored.

    ``local`` declares that a turn only adds to the output, and that what it adds hangs on no turns but the
    first and the last few before it. Only then a long conversation need not be held; rewriting is an error.
    """

    render: Callable[[Turns], str]
    controls: tuple[str, ...]
    local: bool = False

    def __post_init__(self):
        firsts = {c[:1] for c in self.controls}
        if any(len(c) < 2 or "\\" in c or firsts & set(c[1:]) for c in self.controls):
            raise ValueError("control strings have two signs or more, no backslash, and first signs that occur nowhere else in them")

    def escape(self, text: str) -> str:
        pattern = "|".join([r"\\", *map(re.escape, self.controls)])
        return re.sub(pattern, lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def _instructions(turns: Turns) -> str:
    forms = {"user": "[INST] {1} [/INST]", "system": "[SYS] {1} [/SYS]", ASSISTANT: " {1}</s>"}
    return "<s>" + "".join(forms.get(role, "[ROLE] {0} [TEXT] {1} [/ROLE]").format(role, text) for role, text in turns)


def _labelled(turns: Turns) -> str:
    return "".join(f"<|turn|>{role}\n{text}<|end|>\n" for role, text in turns)


def _forgetful(turns: Turns) -> str:
    """Of all assistant turns but the last, what stands before "</think>" is left out."""
    last = max((i for i, (role, _) in enumerate(turns) if role == ASSISTANT), default=-1)
    return _labelled([(r, t.rpartition("</think>")[2] if r == ASSISTANT and i < last else t) for i, (r, t) in enumerate(turns)])


TEMPLATES = {
    "instructions": Template(_instructions, ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/ROLE]"), local=True),
    "labelled": Template(_labelled, ("<|turn|>", "<|end|>"), local=True),
    "forgetful": Template(_forgetful, ("<|turn|>", "<|end|>")),
}

_MARKED = re.compile(
    r"(?:<s>)?(?:\[INST\] (?P<user>.*?) \[/INST\]|\[SYS\] (?P<system>.*?) \[/SYS\]"
    r"|\[ROLE\] (?P<role>.*?) \[TEXT\] (?P<text>.*?) \[/ROLE\]| (?P<assistant>.*?)</s>)",
    re.DOTALL,
)


def read_marked(formatted: str) -> Turns:
    """The turns of a text in the "instructions" template, by its marks alone."""
    turns, at = [], 0
    while at < len(formatted):
        m = _MARKED.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup if m["role"] is None else "role"
        turns.append((unescape(m["role"]), unescape(m["text"])) if kind == "role" else (kind, unescape(m[kind])))
        at = m.end()
    return turns


def _shared_ends(a: str, b: str) -> tuple[int, int]:
    """Lengths of the common beginning and of the common end of two texts, which do not overlap."""

    def common(x: str, y: str) -> int:
        low, high = 0, min(len(x), len(y))
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if x[low:mid] == y[low:mid] else (low, mid - 1)
        return low

    head = common(a, b)
    return head, common(a[head:][::-1], b[head:][::-1])


def _content(out: str, a: str, b: str, seen: int) -> tuple[int, int] | None:
    """Where the text lies in ``out``, whose renderings with "A" and "B" in its place are ``a`` and ``b``.

    The first ``seen`` signs are known to be equal. None if the text does not show, or changes the rest.
    """
    if a == b:
        return None
    head, tail = _shared_ends(a[seen:], b[seen:])
    head += seen
    if len(out) < head + tail or out[seen:head] != a[seen:head] or (tail and out[-tail:] != a[-tail:]):
        return None
    return head, len(out) - tail


class Walk:
    """The prefixes of one conversation, a turn at a time. Rows are (turn, role, start, end, content start, content end, rewrites, piece)."""

    def __init__(self, template: Template, prefix_chars: int = PREFIX_CHARS, tail_turns: int = TAIL_TURNS):
        self.template, self.limit, self.tail = template, prefix_chars, tail_turns
        self.turns: Turns = []
        self.roles: list[str] = []
        self.rows: list[tuple] = []
        self.out, self.done, self.number, self.rewrites, self.streams = "", 0, 0, False, False

    def add(self, role: str, text: str) -> list[tuple]:
        """Take one more turn; gives rows that nothing can change any more."""
        render, turn = self.template.render, (self.template.escape(role), self.template.escape(text))
        now = render([*self.turns, turn])
        seen = len(self.out) if now.startswith(self.out) else 0
        self.rewrites |= bool(self.out) and not seen
        if self.rewrites and self.template.local:
            raise ValueError("the template rewrites what it has written, so it is not local")
        found = _content(now, *(render([*self.turns, (turn[0], x)]) for x in "AB"), seen)
        begin = self.done - len(self.out)  # of ``now`` in the formatted text
        span = tuple(begin + x for x in found) if found and found[0] >= seen else (None, None)
        self.rows.append((self.number, role, self.done, begin + len(now), *span, self.rewrites, now[seen:]))
        self.number += 1
        self.turns.append(turn)
        self.roles.append(role)
        self.done, self.out = begin + len(now), now
        if not self.template.local or (len(now) <= self.limit and not self.streams):
            return []
        ready, self.rows, self.streams = self.rows, [], True
        if len(self.turns) > self.tail + 1:
            self.turns = [self.turns[0], *self.turns[-self.tail :]]
            self.out = render(self.turns)
        return ready

    def final_rows(self) -> list[tuple]:
        """The rows still held. Where history was rewritten, places are those in the last output."""
        if not self.rewrites:
            return self.rows
        render, rows, at = self.template.render, [], 0
        for i, (role, (name, _)) in enumerate(zip(self.roles, self.turns)):
            a, b = (render([*self.turns[:i], (name, x), *self.turns[i + 1 :]]) for x in "AB")
            found = _content(self.out, a, b, 0)
            found = found if found and found[0] >= at else None
            end = len(self.out) if i + 1 == len(self.turns) else found[1] if found else at
            rows.append((i, role, at, end, *(found or (None, None)), True, self.out[at:end]))
            at = end
        self.done = len(self.out)
        return rows


def _groups(batches) -> Iterator[tuple]:
    """(first column's value, whether its group begins here, the row) of sorted rows."""
    begun, key = False, None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            fresh = not begun or row[0] != key
            begun, key = True, row[0]
            yield key, fresh, row


def format_conversations(
    rows: DataFrame, template: Template = TEMPLATES["instructions"], conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS, tail_turns: int = TAIL_TURNS,
) -> DataFrame:
    """One row per turn: conv_id, turn (from 0), role, start, end, content_start, content_end, loss, rewrites, piece.

    ``piece`` is the turn's part of the formatted conversation, at start to end (code points); its text,
    escaped, is at content_start to content_end. ``loss`` marks the assistants' texts. ``rewrites`` says
    that the template changed what it had written: all rows of the conversation say so, places are those in
    the whole conversation's rendering, and content is null where a text does not show there.

    Whether a conversation is held whole hangs on the template alone, never on its length. One that is
    ``local`` looks back at no more than the first turn and ``tail_turns`` others, so prefixes beyond
    ``prefix_chars`` are cut to these without a change of the result; one that is not is given every
    prefix whole, which takes memory with the conversation and time with its turns times its length.

    Null texts and roles are empty. Turns go by number, equal ones by role and text; repeated rows are
    turns of their own; rows without an id are one conversation. An empty table gives no rows. Other
    columns are not read.
    """
    spark = rows.sparkSession
    small_batches(spark)
    kind = rows.schema[conv_col].dataType.simpleString()
    names = ["conv_id", "turn", "role", "start", "end", "content_start", "content_end", "loss", "rewrites", "piece"]
    types = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.bool_(), pa.string()]

    def run(batches):
        worker_starts()
        ids, made, size, walk, conv = [], [], 0, None, None

        def batch(id_type):
            columns = list(zip(*made)) if made else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, t) for c, t in zip(columns, types))], names)

        def take(found):
            for turn, role, start, end, c0, c1, rewrites, piece in found:
                ids.append(conv)
                made.append((turn, role, start, end, c0, c1, role == ASSISTANT and c0 is not None, rewrites, piece))
            return sum(len(r[-1]) for r in found)

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if walk is None or row[0] != conv:
                    size += take(walk.final_rows()) if walk else 0
                    walk, conv = Walk(template, prefix_chars, tail_turns), row[0]
                size += take(walk.add(row[1], row[2]))
                if size >= BATCH_CHARS:
                    yield batch(id_type)
                    ids, made, size = [], [], 0
        if walk:
            take(walk.final_rows())
            yield batch(id_type)

    picked = rows.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), *(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(n) for x, n in ((role_col, "r"), (text_col, "x"))))
    ordered = picked.repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x")
    return ordered.mapInArrow(run, PIECES.format(kind=kind))


def read_back(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the formatted pieces alone.

    Turns are read by the marks of the "instructions" template, the loss text from the masked places.
    Pieces are taken in order as a stream, so one turn is held at a time.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        worker_starts()
        ids, made, state, id_type = [], [], None, None

        def close():
            n, turns, chars, loss, size = state
            made.append((n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def typed(stream):
            nonlocal id_type
            for b in stream:
                id_type = b.schema.field(0).type
                yield b

        for conv, fresh, (_, start, c0, c1, lossy, piece) in _groups(typed(batches)):
            if fresh:
                if state:
                    close()
                ids.append(conv)
                state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_marked(piece):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            if lossy:
                text = unescape(piece[c0 - start : c1 - start])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(piece)
        if state:
            close()
            columns = zip(*made)
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("conv_id", "start", "content_start", "content_end", "loss", "piece")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    with Scratch(spark) as scratch:
        return written(read_back(scratch.written(format_conversations(rows.union(planted)), "chat-pieces")), "chat-digests")
