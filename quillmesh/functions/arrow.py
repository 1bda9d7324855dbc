"""Arrow functions for what Spark has no built-in for: entities, composition, case folding, decoding, URL joining."""

from __future__ import annotations

import codecs
import html
import re
import unicodedata
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F

BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
DECLARED = (re.compile(rb"""(?i)<meta[^>]+charset\s*=\s*["']?\s*([\w.:-]+)"""), re.compile(rb"""(?i)<\?xml[^>]+encoding\s*=\s*["']([\w.:-]+)"""), re.compile(rb"""(?i)content-type[^>]+charset=([\w.:-]+)"""))
PRIVATE = re.compile("[\ue000-\uf8ff]")  # signs of no script, which misread pages hold
#: What misread text looks like; fixed values.
MISREAD = ("鈥", "Ã", "â€“", "â€”", "â€", "Â")


def arrow_function(kind: str):
    """Like ``pandas_udf``, but made at the first call, so that importing needs no session."""

    def wrap(f):
        def call(*columns):
            return F.pandas_udf(f, kind)(*columns)

        call.__doc__ = f.__doc__
        return call

    return wrap


@arrow_function("string")
def html_unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


@arrow_function("string")
def compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@arrow_function("string")
def casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


@arrow_function("string")
def url_join(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else urljoin(b or "", x) for b, x in zip(base, link)], dtype=object)


def codec_name(label: str | None) -> str | None:
    try:
        return codecs.lookup(label.strip()).name if label else None
    except (LookupError, ValueError):
        return None


def declared_encodings(raw: bytes) -> list[str]:
    """Encodings that the first 64 KiB declare, in order."""
    names = (codec_name(m.decode("ascii", "ignore")) for pattern in DECLARED for m in pattern.findall(raw[:65536]))
    return list(dict.fromkeys(n for n in names if n))


def encoding_candidates(raw: bytes) -> list[str]:
    """Encodings to try, in order: byte order mark, declared ones, then common ones."""
    marked = next(([codec_name(name)] for mark, name in BOMS if raw.startswith(mark)), [])
    common = [codec_name(n) for n in ("utf-8", "utf-8-sig", "gb18030", "cp1252")]
    return list(dict.fromkeys([*marked, *declared_encodings(raw), *common]))


def decode_quality(text: str, name: str, declared: list[str]) -> tuple[int, int, int, int]:
    """(cost, replaced, misread, undeclared): the less, the better, compared in this order.

    The cost weighs replaced characters with 100 and misread ones with 20, adds one for an encoding that is
    not among those declared, if any are, and five for a text whose beginning does not look like a page.
    """
    replaced, misread = text.count("\ufffd"), sum(text.count(m) for m in MISREAD) + len(PRIVATE.findall(text))
    undeclared = int(bool(declared) and name not in declared)
    head = text[:20_000].lower()
    plain = 0 if any(x in head for x in ("<html", "<meta", "<!doctype html")) else 5
    return replaced * 100 + misread * 20 + undeclared + plain, replaced, misread, undeclared


def best_decoding(raw: bytes) -> tuple[tuple[int, int, int, int], str, str]:
    """(quality, encoding, text) of the best candidate, the earliest of equals."""
    declared, best = declared_encodings(raw), None
    for name in encoding_candidates(raw):
        text = raw.decode(name, "replace")
        quality = decode_quality(text, name, declared)
        if best is None or quality < best[0]:
            best = (quality, name, text)
    return best


def decode_page(raw: bytes | None) -> str | None:
    """Text of a page by the best of the candidate encodings; composed."""
    return None if raw is None else unicodedata.normalize("NFC", best_decoding(raw)[2])


@arrow_function("string")
def decode_html(s: pd.Series) -> pd.Series:
    return pd.Series([decode_page(None if x is None else bytes(x)) for x in s], dtype=object)


DECODED = "encoding string, cost int, replaced int, misread int, undeclared int, text string"


@arrow_function(DECODED)
def decode_report(s: pd.Series) -> pd.DataFrame:
    """The chosen encoding, the four parts of its quality and the text; nulls for null content."""
    rows = []
    for x in s:
        if x is None:
            rows.append((None,) * 6)
            continue
        quality, name, text = best_decoding(bytes(x))
        rows.append((name, *quality, unicodedata.normalize("NFC", text)))
    return pd.DataFrame(rows, columns=["encoding", "cost", "replaced", "misread", "undeclared", "text"])


@arrow_function("binary")
def encode_text(text: pd.Series, name: pd.Series) -> pd.Series:
    """Bytes of a text in the named encoding, marks included where the encoding has them; null if it cannot hold the text."""

    def one(t, n):
        try:
            return None if t is None or n is None else t.encode(n)
        except (UnicodeEncodeError, LookupError):
            return None

    return pd.Series([one(t, n) for t, n in zip(text, name)], dtype=object)
