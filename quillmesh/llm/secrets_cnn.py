"""Operator 10: secret scan, fixed patterns plus a character convolutional network.

Three base patterns always count. Every other token-like run of a text is a candidate: the network
reads the characters before it, the candidate itself and those after it (a long candidate in
overlapping windows, of which the greatest counts), and adds the candidate when its calibrated
probability reaches a threshold chosen under a recall constraint on held-back findings.

The network is plain numpy: character embedding, one convolution, separate maxima over context and
candidate, and a dense output. It is trained on labelled findings: candidates of a bounded sample of
documents, marked by the base patterns, and generated ones in further public formats.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table, worker_starts

MAX_SAMPLE_DOCUMENTS = 20_000
MAX_FINDINGS = 6_000
GENERATED = 3_000
RECALL = 0.98
BEFORE, BODY, AFTER = 24, 48, 8
STEP = BODY // 2  # between the windows of a run longer than BODY
LEAST_SHARED = 12  # characters of a secret from which a window of a longer run counts as holding it
WINDOWS_AT_ONCE = 4_096
SEED = 71
KINDS = ("assign", "access", "hex", "network")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base findings, sorted by start, then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # a run of 16 or more starts where the maximal run starts, so this equals all runs filtered by length
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Token-like runs that are not plain words or numbers."""
    out = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if s.isalpha() and (s.islower() or s.isupper() or s.istitle()):
            continue
        body = s.strip(".-_=/+")
        if len(body) >= 12 and (any(map(str.isdigit, body)) or (body.isalnum() and not body[1:].islower() and not body.isupper())):
            out.append((m.start(), m.end()))
    return out


_CODE = np.zeros(256, dtype=np.int16)
_CODE[:] = 3
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789+/_.=-:\"'@ \n,;()"):
    _CODE[ord(_c)] = 4 + _i
for _c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _CODE[ord(_c)] = 1 + 60 + ord(_c) - 65
ALPHABET = int(_CODE.max()) + 1


def window(text: str, start: int, end: int) -> np.ndarray:
    """Codes of a candidate and its surroundings; 0 pads, so positions line up."""
    row = np.zeros(BEFORE + BODY + AFTER, dtype=np.int16)

    def put(at: int, part: str, room: int, right: bool = False):
        raw = np.frombuffer(part.encode("latin-1", "replace"), dtype=np.uint8)[:room]
        place = at + room - len(raw) if right else at
        row[place : place + len(raw)] = _CODE[raw]

    put(0, text[max(0, start - BEFORE) : start], BEFORE, right=True)
    put(BEFORE, text[start : min(end, start + BODY)], BODY)
    put(BEFORE + BODY, text[end : end + AFTER], AFTER)
    return row


def window_spans(start: int, end: int) -> list[tuple[int, int]]:
    """Pieces of a candidate that the network reads: itself, or overlapping ones over a longer run's whole length."""
    if end - start <= BODY:
        return [(start, end)]
    return [(a, a + BODY) for a in (*range(start, end - BODY, STEP), end - BODY)]


def shared(a: int, b: int, start: int, end: int) -> int:
    return max(0, min(b, end) - max(a, start))


@dataclass
class CharCNN:
    """Parameters of the network with its calibration and threshold."""

    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    dense: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    WIDTH, DIMS, FILTERS = 5, 10, 24

    @classmethod
    def fresh(cls, rng) -> "CharCNN":
        w, d, f = cls.WIDTH, cls.DIMS, cls.FILTERS
        e = rng.normal(0, 0.3, (ALPHABET, d)).astype(np.float32)
        e[0] = 0
        return cls(e, rng.normal(0, (2 / (w * d)) ** 0.5, (w * d, f)).astype(np.float32), np.zeros(f, np.float32), rng.normal(0, 0.1, 3 * f).astype(np.float32), 0.0)

    def forward(self, codes: np.ndarray):
        n, length = codes.shape
        x = self.embed[codes]
        padded = np.pad(x, ((0, 0), (self.WIDTH // 2, self.WIDTH // 2), (0, 0)))
        cols = np.concatenate([padded[:, i : i + length] for i in range(self.WIDTH)], axis=2)
        h = np.maximum(cols.reshape(n * length, -1) @ self.conv + self.conv_bias, 0).reshape(n, length, -1)
        body = h[:, BEFORE : BEFORE + BODY]
        spots = [h[:, :BEFORE].argmax(1), BEFORE + body.argmax(1), None]
        filled = (codes[:, BEFORE : BEFORE + BODY] > 0)[:, :, None]
        mean = (body * filled).sum(1) / np.maximum(1, filled.sum(1))
        pooled = np.concatenate([np.take_along_axis(h, spots[0][:, None], 1)[:, 0], np.take_along_axis(h, spots[1][:, None], 1)[:, 0], mean], axis=1)
        return pooled @ self.dense + self.bias, (cols, h, spots, filled, pooled)

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(codes[i : i + 512])[0] for i in range(0, len(codes), 512)]) if len(codes) else np.zeros(0)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(codes) + self.shift, -30, 30)))

    def gradients(self, codes: np.ndarray, y: np.ndarray):
        z, (cols, h, spots, filled, pooled) = self.forward(codes)
        n, length, f = h.shape
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n).astype(np.float32)
        dpool = dz[:, None] * self.dense
        dh = np.zeros_like(h)
        rows, chans = np.arange(n)[:, None], np.arange(f)
        np.add.at(dh, (rows, spots[0], chans), dpool[:, :f])
        np.add.at(dh, (rows, spots[1], chans), dpool[:, f : 2 * f])
        dh[:, BEFORE : BEFORE + BODY] += filled * (dpool[:, None, 2 * f :] / np.maximum(1, filled.sum(1))[:, None])
        dh *= h > 0
        flat = dh.reshape(n * length, f)
        dcols = (flat @ self.conv.T).reshape(n, length, self.WIDTH, self.DIMS)
        dx = np.zeros((n, length + self.WIDTH - 1, self.DIMS), np.float32)
        for i in range(self.WIDTH):
            dx[:, i : i + length] += dcols[:, :, i]
        dembed = np.zeros_like(self.embed)
        half = self.WIDTH // 2
        np.add.at(dembed, codes, dx[:, half : half + length])
        dembed[0] = 0
        return [dembed, cols.reshape(n * length, -1).T @ flat, flat.sum(0), pooled.T @ dz, np.float32(dz.sum())]


def train(codes: np.ndarray, y: np.ndarray, finding: np.ndarray, beyond: np.ndarray, epochs: int = 6, batch: int = 128) -> CharCNN:
    """Train by Adam on most findings; calibrate and choose the threshold on the held-back quarter.

    ``finding`` numbers the finding each window belongs to, ``beyond`` has the kind, from 1, of secrets
    that no base pattern covers, else 0: only those are the network's to find, so the recall is
    theirs, and holds for each kind. A finding is held back with all its windows and counts by the
    greatest probability, as in a scan.
    """
    rng = np.random.default_rng(SEED)
    net = CharCNN.fresh(rng)
    order = rng.permutation(int(finding.max()) + 1)
    held = np.isin(finding, order[: len(order) // 4])
    back, fit = np.flatnonzero(held), np.flatnonzero(~held)
    names = ("embed", "conv", "conv_bias", "dense", "bias")
    m = [np.zeros_like(np.asarray(getattr(net, k), dtype=np.float32)) for k in names]
    v = [np.zeros_like(x) for x in m]
    step = 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for i in range(0, len(fit), batch):
            part = fit[i : i + batch]
            step += 1
            for k, (name, g) in enumerate(zip(names, net.gradients(codes[part], y[part]))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                setattr(net, name, getattr(net, name) - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
    z, t = net.logits(codes[back]), y[back]
    if 0 < t.sum() < len(t):
        from .toxicity import fit_logistic

        net.slope, net.shift, _ = fit_logistic(z.astype(float), t, ridge=1e-2)
    levels = []
    for kind in np.unique(beyond[back][beyond[back] > 0]):
        aim = back[beyond[back] == kind]
        best = np.zeros(len(order))
        np.maximum.at(best, finding[aim], net.probability(codes[aim]))
        levels.append(np.quantile(best[np.unique(finding[aim])], 1 - RECALL, method="lower"))
    # the highest threshold that still finds the wanted share of the held-back secrets
    net.threshold = float(min(levels, default=net.threshold))
    return net


def generated_findings(n: int = GENERATED) -> tuple[list[np.ndarray], list[int], list[int], list[int]]:
    """Findings in public formats the base patterns do not all cover, and look-alikes that are no secrets.

    Of each window: codes, label, number of its finding, kind of secret beyond the base patterns (0: none; one kind is any in a long run).
    """
    r = random.Random(SEED)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda a=3, b=9: "".join(r.choice(low) for _ in range(r.randint(a, b)))
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    prose = lambda: " ".join(word() for _ in range(6))
    path = lambda a, b: (sep := r.choice("//._-")).join(word() + r.choice(("", "", "", str(r.randint(0, 99)))) for _ in range(r.randint(a, b))) + sep
    positives = (
        lambda: (f"{r.choice(('Authorization: Bearer ', 'bearer ', 'x-auth: ', 'key: ', 'credential '))}", some(low + up + dig, 24, 60)),
        lambda: (r.choice(("", "secret_key = ", "PRIVATE ", "aws ")), some(low + up + dig + "+/", 36, 44)),
        lambda: ("", r.choice(("ghp_", "sk_live_", "xoxb-", "glpat-")) + some(low + up + dig, 20, 36)),
        lambda: (r.choice(("pwd=", "pass: ", "auth=", "")), some("0123456789ABCDEF", 32, 40)),
    )
    negatives = (
        lambda: (f"{word()}.{r.randint(0, 99)}@", f"mail{r.randint(0, 9)}.example.com"),
        lambda: ("https://", f"www.{word()}{r.randint(0, 99)}.org/{word()}/{word()}-{word()}"),
        lambda: ("", f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}.{word()}"),
        lambda: ("", f"{word()}-{word()}-{r.randint(1, 999)}"),
        lambda: ("", f"{word(5, 9)}_{word(4, 8)}_{r.randint(1, 9)}"),
        lambda: (f"+1 ({r.randint(200, 999)}) ", f"{r.randint(200, 999)}-{r.randint(1000, 9999)}-{r.randint(1000, 9999)}"),
        lambda: ("", f"{word(4, 8)}.{word(4, 8)}{r.randint(0, 9)}"),
        lambda: ("", "".join(word(3, 6).title() for _ in range(r.randint(2, 3))) + r.choice(("", "2"))),
    )
    rows, y, finding, beyond = [], [], [], []
    for i in range(n):
        kinds = positives if i % 2 else negatives
        kind = r.randrange(len(kinds))
        lead, body = kinds[kind]()
        # a sixth of the findings stand at the end or in the middle of a long run
        head, tail = (path(3, 12), r.choice(("", "", "/" + path(2, 6)))) if i % 12 < 2 and not lead.startswith("+1") else ("", "")
        before = f"{prose()} {'' if head else lead}"
        text = f"{before}{head}{body}{tail} {prose()}"
        start = len(before) + len(head)
        stop = start + len(body) + len(tail)
        covered = any(s < stop and len(before) < e for s, _, e in base_spans(text))
        for a, b in window_spans(len(before), stop):
            held = shared(a, b, start, start + len(body))
            if b - a < BODY or not i % 2 or not held or held >= LEAST_SHARED:
                rows.append(window(text, a, b))
                y.append(int(bool(i % 2 and held)))
                finding.append(i)
                beyond.append(0 if covered or not y[-1] else len(kinds) + 1 if head else kind + 1)
    return rows, y, finding, beyond


_KEY_PREFIX = re.compile(r"(?:^|[/._=+-])(?:gh[opsur]_|github_pat_|[rs]k_(?:live|test)_|xox[abeoprs]-|glpat-|AIza|eyJ)[A-Za-z0-9]", re.ASCII)
_KEY_LEAD = re.compile(r"(?:bearer|basic|auth|authorization|credentials?|key|private|pass|pwd|secret|token|aws)[^A-Za-z0-9]*$", re.ASCII | re.IGNORECASE)
_TURN = re.compile(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def looks_like_key(text: str, start: int, end: int) -> bool:
    """True for a run that may be a key: a known prefix, a word for a key before it, or letters and digits mixed at random."""
    s = text[start:end]
    return bool(_KEY_PREFIX.search(s) or _KEY_LEAD.search(text[max(0, start - BEFORE) : start]) or any(len(_TURN.findall(x)) >= 5 for x in re.split(r"[/._=+-]+", s)))


def sample_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(codes, y) of at most MAX_FINDINGS candidates of at most MAX_SAMPLE_DOCUMENTS documents, in hash order.

    A candidate that a base assign or access finding covers, or a long hexadecimal one with letters
    and digits, is labelled a secret. Of the others those that look like a key are left out, as
    nothing tells what they are; the rest is labelled no secret.
    """
    small_batches(docs.sparkSession)
    drawn = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_drawn")).distinct().orderBy(F.xxhash64("_drawn"), "_drawn").limit(MAX_SAMPLE_DOCUMENTS)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(drawn), F.col("_id") == F.col("_drawn"), "left_semi")

    def run(batches):
        worker_starts()
        for b in batches:
            codes, y = [], []
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                found = base_spans(text)
                for start, end in candidates(text):
                    for a, b in window_spans(start, end):
                        hits = [(k, s, e) for s, k, e in found if s < b and a < e]
                        if end - start > BODY and hits and all(shared(a, b, s, e) < LEAST_SHARED for _, s, e in hits):
                            continue  # only the rim of a finding
                        if not hits and looks_like_key(text, a, b):
                            continue
                        digits = any(k == 2 and text[s:e].isdigit() for k, s, e in hits)
                        codes.append(window(text, a, b).astype("<i2").tobytes())
                        y.append(int(bool(hits) and not (digits and len(hits) == 1)))
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), pa.array(y, pa.int32())], ["codes", "y"])

    found = texts.select("_text").mapInArrow(run, "codes binary, y int").distinct()
    return found.orderBy(F.xxhash64("codes"), "codes").limit(MAX_FINDINGS)


def fit_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> CharCNN:
    rows, y, finding, beyond = generated_findings()
    for r in sample_findings(docs, id_col, text_col).collect():
        rows.append(np.frombuffer(bytes(r["codes"]), dtype="<i2"))
        y.append(r["y"])
        finding.append(finding[-1] + 1)
        beyond.append(0)
    return train(np.stack(rows).astype(np.int64), np.array(y, dtype=np.float32), np.array(finding), np.array(beyond))


def probabilities(text: str, spans: list[tuple[int, int]], net: CharCNN) -> np.ndarray:
    """Greatest probability of each candidate's windows; of very long runs few windows are held at once."""
    best, rows, owners = np.zeros(len(spans)), [], []

    def score():
        np.maximum.at(best, owners, net.probability(np.stack(rows).astype(np.int64)))
        rows.clear()
        owners.clear()

    for i, span in enumerate(spans):
        for a, b in window_spans(*span):
            rows.append(window(text, a, b))
            owners.append(i)
            if len(rows) >= WINDOWS_AT_ONCE:
                score()
    if rows:
        score()
    return best


def all_spans(text: str, net: CharCNN) -> list[tuple[int, int, int]]:
    """Base findings and the candidates the network adds, as (start, kind index, end)."""
    found = base_spans(text)
    left = [c for c in candidates(text) if not any(s < c[1] and c[0] < e for s, _, e in found)]
    if left:
        found = sorted(found + [(a, 3, b) for (a, b), q in zip(left, probabilities(text, left, net)) if q >= net.threshold])
    return found


def scan_secrets(docs: DataFrame, net: CharCNN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every whole text: id, ``n_assign``, ``n_access``, ``n_hex``, ``base`` and ``spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and kind, comma-joined. Null
    and empty texts have none. One narrow pass; repeated rows give repeated rows, an empty table none;
    other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind_of_id = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        worker_starts()
        for b in batches:
            counts, base, spans = ([], [], []), [], []
            for text in b.column(1).to_pylist():
                found = all_spans(text, net) if text else []
                for k in range(3):
                    counts[k].append(sum(kind == k for _, kind, _ in found))
                say = lambda rows: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in rows)
                base.append(say([x for x in found if x[1] < 3]))
                spans.append(say(found))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(spans, pa.string())], [id_col, "n_assign", "n_access", "n_hex", "base", "spans"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind_of_id}, n_assign long, n_access long, n_hex long, base string, spans string")


def redact(docs: DataFrame, net: CharCNN, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding of every text replaced by ``mark``; null texts stay null."""
    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for start, _, end in all_spans(text, net):
            if end <= at:
                continue
            if start >= at:
                out += [text[at:start], mark]
            at = end
        return "".join(out) + text[at:]

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        worker_starts()
        return pd.Series([clean(t) for t in texts], dtype=object)

    return docs.withColumn(text_col, cleaned(F.col(text_col)))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, fit_secrets(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")
