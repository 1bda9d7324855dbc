"""Operator 8: BPE encoding and decoding with a tokenization automaton.

Compilation follows the successive merge-gadget construction. The start state accepts every base
symbol and loops. The gadget of a merge ``a b -> ab`` takes every path that reads ``a`` and then
``b``: the state after ``a`` is replaced by a copy without the ``b`` arc, and an arc ``ab`` is added
that leads to where ``a b`` led. Applying all gadgets in rank order leaves a deterministic automaton
over tokens in which each string has exactly one path, its BPE tokenization.

A copy differs from its original by one arc, so during construction states are (original, removed
arc, rank). Then the automaton is compiled: tokens are numbered by a walk over the tree of left parts,
the latest merge first, so that what one removal closes (a token, and those that it begins and that
are merged no earlier) is one interval of numbers. A state's transition table is the sorted list of
its closed intervals, and an arc exists for every token outside of them.

Encoding a pre-split word walks these tables only: a symbol table over the arc labels names the tokens
that spell what follows, the state's intervals which of them have an arc. Decoding emits the arc labels
of the ids.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import holds, small_batches, table, worker_starts
from .wordbpe import Memo, Splitter, chunks

class TokenAutomaton:
    """Tables of the compiled automaton.

    ``symbols``: the arc labels symbol by symbol: what may follow, and the token spelt so far or -1;
    ``closed[state]``: starts and ends of the intervals of token numbers that have no arc there;
    ``state_after``: where a token's arcs lead.
    """

    def __init__(self, base: dict[str, int], merges: list[tuple[str, str]], vocab: dict[str, int]):
        """``base``: symbols without a merge; ``merges`` in rank order; ``vocab``: label to id."""
        # one state per gadget; state 0 is the start
        copied_from, removed, at = [0], [-1], [-1]
        self.state_after: dict[int, int] = {i: 0 for i in base.values()}
        left: dict[int, int] = {}
        born: dict[int, int] = {i: -1 for i in base.values()}

        def is_open(state: int, t: int) -> bool:
            """Whether no copy on the way to ``state`` removed a left part of ``t`` while that stood alone."""
            low, dies = {}, 1 << 60
            while True:
                low[t] = (born[t], dies)
                if t not in left:
                    break
                dies, t = born[t], left[t]
            while state:
                hit = low.get(removed[state])
                if hit and hit[0] < at[state] <= hit[1]:
                    return False
                state = copied_from[state]
            return True

        self.skipped = 0
        for rank, (x, y) in enumerate(merges):
            a, b, ab = vocab[x], vocab[y], vocab[x + y]
            if a not in self.state_after or b not in self.state_after or ab in born or not is_open(self.state_after[a], b):
                self.skipped += 1  # no path reads a and then b at this rank: the gadget adds nothing
                continue
            target = self.state_after[b]
            copied_from.append(self.state_after[a])
            removed.append(b)
            at.append(rank)
            self.state_after[a] = len(at) - 1
            self.state_after[ab], left[ab], born[ab] = target, a, rank
        inverse = {i: s for s, i in vocab.items()}
        self.label = {t: inverse[t] for t in born}
        self.token = {s: t for t, s in self.label.items()}
        self.longest = max(map(len, self.token), default=0)
        self._compile(copied_from, removed, at, left, born)

    def _compile(self, copied_from, removed, at, left, born) -> None:
        self.symbols: dict = {}
        for label in sorted(self.token):  # a label comes behind those it begins with
            node = self.symbols
            for c in label[:-1]:
                node = node.setdefault(c, ({}, -1))[0]
            node[label[-1]] = (node.get(label[-1], ({}, -1))[0], self.token[label])
        begins: dict[int, list[int]] = {}
        for t in sorted(left, key=born.__getitem__, reverse=True):
            begins.setdefault(left[t], []).append(t)
        self.number: dict[int, int] = {}
        after: dict[int, int] = {}  # first number behind a token and all it begins
        stack = [(t, False) for t in born if t not in left]
        while stack:
            t, done = stack.pop()
            if done:
                after[t] = len(self.number)
                continue
            self.number[t] = len(self.number)
            stack.append((t, True))
            stack += [(c, False) for c in reversed(begins.get(t, ()))]

        def closes(state: int) -> tuple[int, int]:
            x, end = removed[state], self.number[removed[state]] + 1
            for c in begins.get(x, ()):
                if born[c] < at[state]:
                    break
                end = after[c]
            return self.number[x], end

        one = [closes(s) if s else (0, 0) for s in range(len(at))]
        self.closed: dict[int, tuple[array, array]] = {}
        for state in set(self.state_after.values()):
            found, s = [], state
            while s:
                found.append(one[s])
                s = copied_from[s]
            starts, ends = array("i"), array("i")
            for start, end in sorted(found):
                if ends and start <= ends[-1]:
                    ends[-1] = max(ends[-1], end)
                else:
                    starts.append(start)
                    ends.append(end)
            self.closed[state] = starts, ends

    def encode(self, word: str, suffix: str = "") -> list[int]:
        """The one accepted path that spells ``word``; its last symbol carries ``suffix``.

        From each place on, the tables name the arcs that spell what follows; longer ones are taken
        first. A place that was left without success is never entered again, so the walk is linear.
        """
        if not word:
            return []
        whole = self.token.get(word + suffix)
        if whole is not None:
            return [whole]  # the arc of the start state, which has one for every token
        symbols, after, closed, number, longest, n = self.symbols, self.state_after, self.closed, self.number, self.longest, len(word)
        dead: set[int] = set()
        left: list = []  # places on the path with the tokens not tried there and the intervals of their state
        ids: list[int] = []
        at, starts, ends = 0, (), ()
        while True:
            found, node, k = [], symbols, at  # (end, token) of what spells what follows, the longest last
            for c in word[at : at + longest]:
                step = node.get(c)
                if step is None:
                    break
                node, t = step
                k += 1
                if t >= 0:
                    found.append((k, t))
            else:
                if k == n and suffix:
                    if found and found[-1][0] == n:
                        found.pop()
                    for c in suffix:
                        step = node.get(c)
                        if step is None:
                            break
                        node, t = step
                    else:
                        if t >= 0:
                            found.append((n, t))
            while True:
                if not found:
                    dead.add(at)
                    if not left:
                        raise ValueError(f"the automaton has no path for {word!r}")
                    at, found, starts, ends = left.pop()
                    ids.pop()
                    continue
                end, t = found.pop()
                if end in dead:
                    continue
                place = bisect_right(starts, number[t])
                if not place or ends[place - 1] <= number[t]:
                    break
            ids.append(t)
            if end == n:
                return ids
            left.append((at, found, starts, ends))
            at = end
            starts, ends = closed[after[t]]


class AutomatonTokenizer:
    """Whole texts to ids and back; ids as space-joined decimals so that a chunk is one memo lookup."""

    def __init__(self, path: str, memo: int = 400_000):
        self.splitter = Splitter(path)
        model = self.splitter.spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a plain BPE model")
        self.suffix, vocab = model["end_of_word_suffix"] or "", model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        self.automaton = TokenAutomaton({s: i for s, i in vocab.items() if s not in made}, merges, vocab)
        if self.splitter.spec["decoder"] is not None:
            raise ValueError(f"{path}: labels are joined by one space, as for files without a decoder")
        self.emit = {str(i).encode(): s.encode() for s, i in vocab.items()} | {str(i).encode(): s.encode() for s, i in self.splitter.added.items()}
        self.word_ids = Memo(self._word, memo // 2)
        # with a space behind each id and label, so that texts are plain concatenations
        self.chunk_ids = Memo(self._chunk, memo)
        self.chunk_labels = Memo(lambda chunk: (out := self.decode(self.chunk_ids[chunk])) and out + b" ", memo // 2)

    def _word(self, word: str) -> bytes:
        return b" ".join(b"%d" % i for i in self.automaton.encode(word, self.suffix))

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.word_ids[w] + b" " for w in self.splitter.words(chunk)])

    def _pieces(self, text: str):
        """(chunks, id of the added token behind them or None) of a text, in order."""
        s, at = self.splitter, 0
        if s.added_pattern is not None and "<|" in text:
            for m in s.added_pattern.finditer(text):
                yield chunks(text[at : m.start()]), b"%d " % s.added[m.group()]
                at = m.end()
        yield chunks(text[at:] if at else text), None

    def encode(self, text: str | None) -> bytes:
        """Decimal ids joined by one space."""
        return self.encode_decode(text)[0]

    def decode(self, ids: bytes) -> bytes:
        """Arc labels of the ids, joined by one space as the library does without a decoder."""
        return b" ".join(map(self.emit.__getitem__, ids.split()))

    def encode_decode(self, text: str | None) -> tuple[bytes, bytes]:
        """``encode(text)`` and ``decode`` of it: a chunk is coded once, its ids decoded once."""
        ids, labels = [], []
        for found, added in self._pieces(text) if text else ():
            ids += map(self.chunk_ids.__getitem__, found)
            labels += map(self.chunk_labels.__getitem__, found)
            if added is not None:
                ids.append(added)
                labels.append(self.decode(added) + b" ")
        return b"".join(ids)[:-1], b"".join(labels)[:-1]


_built: dict[str, AutomatonTokenizer] = {}


def tokenizer(path: str) -> AutomatonTokenizer:
    worker_starts("automaton")
    if path not in _built:
        holds("automaton", _built.clear)
        _built[path] = AutomatonTokenizer(path)
    return _built[path]


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text.

    Returns id, ``ids`` (decimal ids joined by one space), ``decoded`` and ``n_tokens``. One narrow
    pass, no shuffle. Null and empty texts have no tokens and decode to an empty string; repeated
    rows give repeated rows, an empty table none; other columns of ``docs`` are not read.
    """
    return _mapped(docs, tokenizer_path, id_col, text_col, digests=False)


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        t = tokenizer(path)
        for batch in batches:
            first, second, count = [], [], []
            for text in batch.column(1).to_pylist():
                ids, out = t.encode_decode(text)
                count.append(ids.count(b" ") + 1 if ids else 0)
                first.append(hashlib.sha256(ids).hexdigest() if digests else ids.decode())
                second.append(hashlib.sha256(out).hexdigest() if digests else out.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] if digests else [id_col, "n_tokens", "ids", "decoded"]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, `{names[2]}` string, `{names[3]}` string")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return _mapped(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "doc_id", "text", digests=True)
