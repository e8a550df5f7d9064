"""Secret scans: fixed patterns, and a battery of randomness tests for everything else.

A run of letters, digits and "+/_-" with its "=" padding is a candidate. The smallest alphabet that holds it is its
inferred encoding. Three tests ask whether it could be random in that alphabet: chi-squared
uniformity of its symbols, runs above and below the middle of the alphabet, and serial
correlation of neighbours. A candidate that passes all three gets an e-value: how much
likelier its characters are under the random alphabet than in ordinary text. The e-value
grows with the length, as far as the characters tell. Within a document, candidates are
discovered by the e-value form of the Benjamini-Hochberg rule, which bounds the expected share
of false discoveries whatever the dependence; candidates are weighted by length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ASSIGN = re.compile(
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run that is long enough holds no shorter match of its own.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20
# "=" only pads (six at most, in base32): behind any other "=", as in NAME=value, a run starts anew.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,6}")
# Alphabets, from small to large; an encoding is the first that holds all characters.
DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (
    ("decimal", DIGITS),
    ("hex", DIGITS + "abcdef"),
    ("HEX", DIGITS + "ABCDEF"),
    ("base32", UPPER + "234567"),
    ("lower", UPPER.lower()),
    ("base36", DIGITS + UPPER.lower()),
    ("letters", UPPER + UPPER.lower()),
    ("base62", DIGITS + UPPER + UPPER.lower()),
    ("base64", UPPER + UPPER.lower() + DIGITS + "+/"),
    ("base64url", UPPER + UPPER.lower() + DIGITS + "-_"),
    ("any", UPPER + UPPER.lower() + DIGITS + "+/-_"),
)
# The largest share of each letter a to z in English, French, German and Spanish
# text, per mille. As upper bounds they make e-values too small rather than too large.
LETTER_SHARES = (
    125, 22, 47, 58, 175, 22, 30, 61, 77, 6, 14, 60, 32,
    98, 87, 30, 14, 76, 80, 91, 64, 18, 24, 5, 20, 11,
)
# Shares of capitals, digits and signs among the characters of words.
UPPER_SHARE, DIGIT_SHARE, SIGN_SHARE = 0.03, 0.02, 0.01
# Least p-value that passes a test, and the false-discovery rate.
PASS = 0.001
FDR = 0.01
# A candidate's weight grows with its length up to this one.
FULL_WEIGHT = 40


def _text_log_shares() -> dict[str, float]:
    shares = {}
    for letter, share in zip(UPPER, LETTER_SHARES):
        shares[letter.lower()] = share / 1000
        shares[letter] = UPPER_SHARE * share / 1000
    shares.update(dict.fromkeys(DIGITS, DIGIT_SHARE / 10))
    shares.update(dict.fromkeys("+/=_-", SIGN_SHARE / 5))
    return {c: math.log(p) for c, p in shares.items()}


TEXT_LOG_SHARES = _text_log_shares()
_SETS = tuple((name, frozenset(symbols), {c: i for i, c in enumerate(symbols)}) for name, symbols in ALPHABETS)


def encoding_of(token: str) -> tuple[str, dict[str, int]]:
    """Name and symbol values of the smallest alphabet that holds the token (without padding)."""
    seen = set(token)
    for name, symbols, values in _SETS:
        if seen <= symbols:
            return name, values
    raise ValueError("not a candidate")


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_p(values: np.ndarray, size: int) -> float:
    """Upper tail for uniform symbols, by the Wilson-Hilferty approximation."""
    counts = np.bincount(values, minlength=size)
    expected = len(values) / size
    statistic = float(((counts - expected) ** 2).sum() / expected)
    degrees = size - 1
    spread = 2 / (9 * degrees)
    z = ((statistic / degrees) ** (1 / 3) - (1 - spread)) / math.sqrt(spread)
    return math.erfc(z / math.sqrt(2)) / 2


def runs_p(values: np.ndarray, size: int) -> float:
    """Runs of symbols in the lower and the upper half of the alphabet."""
    high = values * 2 >= size
    up = int(high.sum())
    down = len(high) - up
    n = up + down
    if not up or not down:
        return 2.0 ** (1 - n)
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * up * down / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return 1.0 if variance <= 0 else _two_sided((runs - mean) / math.sqrt(variance))


def serial_p(values: np.ndarray) -> float:
    """Correlation of each symbol with the next, the last with the first."""
    x = values - values.mean()
    power = float((x * x).sum())
    if power == 0:
        return 0.0
    n = len(values)
    r = float((x * np.roll(x, -1)).sum()) / power
    return _two_sided((r + 1 / (n - 1)) * math.sqrt(n))


def log_e_value(token: str) -> float | None:
    """Log of the token's e-value against ordinary text; None if it fails a test."""
    core = token.rstrip("=")
    if len(core) < 16 or "=" in core:
        return None
    _, values = encoding_of(core)
    size = len(values)
    symbols = np.array([values[c] for c in core])
    if min(chi_squared_p(symbols, size), runs_p(symbols, size), serial_p(symbols)) < PASS:
        return None
    return -len(core) * math.log(size) - sum(map(TEXT_LOG_SHARES.__getitem__, core))


def discoveries(tokens: list[str]) -> list[bool]:
    """Which candidates of one document are secrets, at the false-discovery rate `FDR`."""
    logs = [log_e_value(t) for t in tokens]
    raw = [min(len(t), FULL_WEIGHT) for t in tokens]
    mean = sum(raw) / len(raw) if raw else 1
    weighted = [-math.inf if v is None else v + math.log(w / mean) for v, w in zip(logs, raw)]
    order = sorted(range(len(tokens)), key=lambda i: -weighted[i])
    cut = 0
    for rank, i in enumerate(order, 1):
        if weighted[i] >= math.log(len(tokens) / (FDR * rank)):
            cut = rank
    chosen = set(order[:cut])
    return [i in chosen for i in range(len(tokens))]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' whole matches, sorted."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        spans += [
            (m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH
        ]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def random_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the battery adds: discovered candidates apart from base spans."""
    found = list(CANDIDATE.finditer(text))
    if not found:
        return []
    secret = discoveries([m[0] for m in found])
    taken = [(start, end) for start, _, end in base]
    return [
        (m.start(), 3, m.end())
        for m, yes in zip(found, secret)
        if yes and not any(a < m.end() and m.start() < b for a, b in taken)
    ]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def _scan(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[], [], [], []]
        digests, spans = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            added = random_spans(text, base)
            kinds = [kind for _, kind, _ in base + added]
            for kind in range(4):
                counts[kind].append(kinds.count(kind))
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            spans.append(_joined(base + added))
        columns = [batch.column(k) for k in keys] + [pa.array(c, pa.int64()) for c in counts]
        columns += [pa.array(digests, pa.string()), pa.array(spans, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*keys, *RESULT])


RESULT = ("n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")


def scan(docs: DataFrame) -> DataFrame:
    """Secrets in every whole text, in one pass without a shuffle.

    Returns doc_id, n_assign, n_access, n_hex, n_random, base_sha256 (of the base spans) and
    spans: kind:start:end by start, then kind, comma-joined; code points, end exclusive. A null
    text counts as empty and has no spans. Repeated rows give repeated rows; other columns are
    left out. The false-discovery control is one per document, so a result doesn't depend on
    other rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        partial(_scan, keys=["doc_id"]),
        f"doc_id {id_type}, n_assign long, n_access long, n_hex long, n_random long, "
        "base_sha256 string, spans string",
    )
