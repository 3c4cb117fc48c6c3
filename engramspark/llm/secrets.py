"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Random strings are poor material for a byte-pair vocabulary: they cost far more tokens than words of the same length do. A
run of at least 12 key-like characters is a candidate if it mixes kinds of characters, or is of letters of one case; known digests and identifiers (hexadecimal of a
digest's length, UUIDs, numbers and dates, paths, dotted names and words joined by hyphens) are excluded; of the rest those with few characters per token
are secrets, where letters of one case, as words are, must have fewer. This test adds spans to those of the patterns and removes none.

Edge cases: null and empty texts have no spans; whole texts are scanned, of any length; positions are code points; repeated
rows give equal rows; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored (by
``masked``, kept).
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, bytes_of, small_batches

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")

_RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
_ONE_CASE = re.compile(r"[a-z]+|[A-Z]+")
_ALPHABET = "abcdefghijklmnopqrstuvwxyz" * 2
#: Characters per token under which a run of letters of one case is random, by its least length; words of 20 letters or more are seldom under 2.
ONE_CASE = ((20, 1.95), (12, 1.6))
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
_UUID = re.compile(r"[0-9a-fA-F]{8}-?(?:[0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}")
_NUMBER = re.compile(r"[0-9+/_=-]+")
_STAMP = re.compile(r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}[Tt_-][0-9]{2}(?:-?[0-9]{2}){0,2}[Zz]?(?:[+-][0-9]{2,4})?")
_NAMES = re.compile(r"(?:[A-Za-z]?[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,8})(?:[-_/+=]+(?:[A-Za-z]?[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,8}))*[-_/+=]*")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def pattern_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns: leftmost, non-overlapping for each kind."""
    out = []
    low = text.encode().lower()
    if any(w in low for w in _WORDS):
        out += [Span("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"akia" in low:
        out += [Span("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [Span("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def is_identifier(run: str) -> bool:
    """Known digests and identifiers: random or not, they are no secrets by themselves."""
    return bool(_DIGEST.fullmatch(run) or _UUID.fullmatch(run) or _NUMBER.fullmatch(run) or _STAMP.fullmatch(run) or _NAMES.fullmatch(run))


def mixed(run: str) -> bool:
    """At least two of: digits, small letters, capitals; with a digit, or capitals inside."""
    digit, small, big = any(c.isdigit() for c in run), any(c.islower() for c in run), any(c.isupper() for c in run)
    return digit and (small or big) or small and big and sum(c.isupper() for c in run[1:]) >= 3


def is_random(run: str, encode, chars_per_token: float = 2.2) -> bool:
    """Whether a run has so few characters per token as only random strings have."""
    if len(run) < 12:
        return False
    if _ONE_CASE.fullmatch(run):
        most = next(x for n, x in ONE_CASE if len(run) >= n)
        return len(run) < most * len(encode(run)) and run.lower() not in _ALPHABET
    return mixed(run) and not is_identifier(run) and len(run) < chars_per_token * len(encode(run))


def random_spans(text: str, encode, chars_per_token: float = 2.2) -> list[Span]:
    """Runs whose characters per token under the vocabulary are under ``chars_per_token``, or for letters of one case under ``ONE_CASE``."""
    out = []
    for m in _RUN.finditer(text):
        run = m[0].strip("=-_/+")
        if is_random(run, encode, chars_per_token):
            start = m.start() + m[0].index(run)
            out.append(Span("random", start, start + len(run)))
    return out


def spans(text: str, encode, chars_per_token: float = 2.2) -> list[Span]:
    """All spans, by start, then by kind; a random string that a pattern's span covers isn't told twice."""
    base = pattern_spans(text)
    extra = [s for s in random_spans(text, encode, chars_per_token) if not any(b.start <= s.start and s.end <= b.end for b in base)]
    return sorted(base + extra, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def told(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


def _encoder(name: str):
    from .packing import tokenizer

    return tokenizer(name).encode_ordinary


def find_secrets(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken", chars_per_token: float = 2.2) -> DataFrame:
    """doc_id and the spans of each document, an array of (kind, start, end). ``name`` is the tiktoken vocabulary's. No shuffle."""

    def each(b):
        encode = _encoder(name)
        return {"doc_id": b.column(0), "spans": [[s._asdict() for s in spans(x.decode("utf-8", "replace"), encode, chars_per_token)] for x in b.column(1).to_pylist()]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", bytes_of().alias("raw")), each, f"doc_id {kind}, spans array<struct<kind string, start long, end long>>")


def digest_columns(found: DataFrame) -> DataFrame:
    """The columns of the ``op7`` contract from ``find_secrets``."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s.kind != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"), count("random"))


def masked(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken", chars_per_token: float = 2.2, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; overlapping spans are replaced as one. ``n_chars``, if there, follows. Null texts stay null."""

    small_batches(docs.sparkSession)
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        encode = _encoder(name)
        return texts.map(lambda x: x if x is None else cover(x, spans(x, encode, chars_per_token), mark))

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def cover(text: str, found: list[Span], mark: str) -> str:
    """``text`` with the spans, merged where they overlap, replaced by ``mark``."""
    parts, at = [], 0
    for s in found:
        if s.start >= at:
            parts += [text[at : s.start], mark]
        at = max(at, s.end)
    return "".join([*parts, text[at:]]) if found else text


def sha256_of(found: list[Span]) -> str:
    return hashlib.sha256(told([s for s in found if s.kind != "random"]).encode()).hexdigest()
