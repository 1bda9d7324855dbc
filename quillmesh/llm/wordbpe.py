"""Word-level BPE encoding of whole texts with a memo of white-space-free chunks.

The vocabulary this serves (``word_bpe_49k.json``) normalises (NFC, white space to one space, lower
case), splits with a pattern none of whose alternatives crosses white space, and merges inside the
pieces. A text's ids are therefore the concatenation of the ids of its white-space-separated chunks,
so each distinct chunk is encoded once per worker and afterwards costs one dictionary lookup.
"""

from __future__ import annotations

import json
import re
import unicodedata

import regex

from .shared import holds, worker_starts

#: White space as the tokenizer's pattern sees it; ``str.split`` also cuts at U+001C to U+001F.
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Signs that form a piece of their own behind a word.
PLAIN_SIGNS = frozenset(".,;:!?")


def chunks(text: str) -> list[str]:
    """The white-space-free chunks of a text, in order."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [x for x in SPACES.split(text) if x]
    return text.split()


def byte_alphabet() -> list[str]:
    """Printable stand-in of each byte in byte-level vocabularies, by the public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Splitter:
    """Normalisation and pre-splitting of one chunk, driven by the tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        steps = spec["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or spec["post_processor"]:
            raise ValueError(f"{path}: not a lower-casing word-level BPE file")
        if spec["truncation"] or spec["padding"] or any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
            raise ValueError(f"{path}: truncation, padding or stripping added tokens are not handled")
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.stand_in = {i: c for i, c in enumerate(byte_alphabet())}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.added_pattern = re.compile("|".join(map(re.escape, self.added))) if self.added else None
        self.spec, self.path, self._library = spec, path, None

    def words(self, chunk: str) -> list[str]:
        """Pieces of a chunk, each in the byte stand-in alphabet.

        A chunk with code points that Python's Unicode tables do not know is split by the library,
        whose tables may be newer. Plain words, with or without one sign behind them, need no pattern.
        """
        body, sign = (chunk[:-1], chunk[-1]) if chunk[-1] in PLAIN_SIGNS else (chunk, "")
        if body.isalpha() and (body.isascii() or ("İ" not in body and unicodedata.is_normalized("NFC", body))):
            low = body.lower() if "Σ" not in body else body.replace("Σ", "σ").lower()
            if not low.isascii():
                low = low.encode("utf-8").decode("latin-1").translate(self.stand_in)
            return [low, sign] if sign else [low]
        if not chunk.isprintable() and any(unicodedata.category(c) == "Cn" for c in chunk):
            return self._library_words(chunk)
        if not chunk.isascii():
            # lower-casing is per character: no final-sigma rule
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        out = self.pieces(chunk.lower())
        return [w if w.isascii() and w.isprintable() else w.encode("utf-8").decode("latin-1").translate(self.stand_in) for w in out]

    def _library_words(self, chunk: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        whole = self._library.normalizer.normalize_str(chunk)
        return [w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(whole)]


class Memo(dict):
    """Bounded memo from chunk to value, in two generations.

    When the younger is full it becomes the older, whose unused entries go at the next turn. So at
    most ``limit`` entries are held and what keeps being used is not computed again.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.half, self.older = make, max(1, limit // 2), {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class WordEncoder:
    """Ids of whole texts as little-endian uint32 bytes.

    ``encode_word`` maps one pre-split word (stand-in alphabet) to ids. The memos hold at most
    ``limit`` chunks and half as many words.
    """

    def __init__(self, splitter: Splitter, encode_word, limit: int = 400_000):
        self.splitter = splitter
        self.word_ids = Memo(lambda w: b"".join(i.to_bytes(4, "little") for i in encode_word(w)), limit // 2)
        self.chunk_ids = Memo(self._chunk, limit)

    def _chunk(self, chunk: str) -> bytes:
        words = self.splitter.words(chunk)
        return self.word_ids[words[0]] if len(words) == 1 else b"".join(map(self.word_ids.__getitem__, words))

    def id_bytes(self, text: str | None) -> bytes:
        """Ids of a text (null: empty); strings of added tokens become their ids."""
        if not text:
            return b""
        s = self.splitter
        if s.added_pattern is None or "<|" not in text or not s.added_pattern.search(text):
            return b"".join(map(self.chunk_ids.__getitem__, chunks(text)))
        out, at = [], 0
        for m in s.added_pattern.finditer(text):
            out += map(self.chunk_ids.__getitem__, chunks(text[at : m.start()]))
            out.append(s.added[m.group()].to_bytes(4, "little"))
            at = m.end()
        out += map(self.chunk_ids.__getitem__, chunks(text[at:]))
        return b"".join(out)


_library: dict[str, WordEncoder] = {}


def library_encoder(path: str) -> WordEncoder:
    """The encoder of this worker whose words are merged by the tokenizers library."""
    worker_starts("library encoder")
    if path not in _library:
        holds("library encoder", _library.clear)
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path).model
        _library[path] = WordEncoder(Splitter(path), lambda w: [t.id for t in model.tokenize(w)])
    return _library[path]
