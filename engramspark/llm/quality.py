"""Quality rules as a short-circuit cascade.

Each rule is a predicate over one document. On a bounded sample the driver measures what a rule costs and how much it
rejects, and orders the rules by rejection per cost; a document leaves the cascade at the first rule that rejects it. A
verdict depends on the set of rules alone, never on their order, the sample or the clock.

Edge cases: a null text is empty, has no words, and is rejected by ``few_words``; repeated rows are judged alike; an
empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored (by ``keep_good``, kept).
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Sequence
from functools import cached_property
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, bytes_of, fresh, small_batches

_SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_OTHER_THAN_LETTERS = bytes(set(range(256)) - set(_LETTERS))
_SPACE = b" \t\n\r\x0b\x0c"


class Doc:
    """Lazily computed features of one text; a rule pays only for what it asks for."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # of bytes: splits at the six ASCII spaces alone

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        bare = self.raw.translate(None, _SPACE)
        return len(bare) if bare.isascii() else len(bare.decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.raw.count(c) for c in _SYMBOLS.encode())

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(_SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        seen = Counter(windows)
        if len(seen) == len(windows):
            return 0
        total, end = 0, 0  # end: first position not covered yet
        for i, x in enumerate(windows):
            if seen[x] > 1:
                total += i + 3 - max(i, end)
                end = i + 3
        return total

    @cached_property
    def letters(self) -> tuple[int, int]:
        """ASCII capitals, ASCII letters."""
        bare = self.raw.translate(None, _OTHER_THAN_LETTERS)
        return len(bare) - len(bare.translate(None, _UPPER)), len(bare)

    @cached_property
    def n_bangs(self) -> int:
        return self.raw.count(b"!")

    @cached_property
    def n_stutters(self) -> int:
        return sum(a == b for a, b in zip(self.words, self.words[1:]))


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Doc], bool]


#: Thresholds are exact integer comparisons, so that any engine agrees on them.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda d: d.n_words < 50),
    Rule("repeated_windows", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("repeated_lines", lambda d: 2 * d.n_dup_lines > len(d.lines)),
    Rule("word_length", lambda d: d.word_chars < 3 * d.n_words or d.word_chars > 10 * d.n_words),
    Rule("capitals", lambda d: 2 * d.letters[0] > d.letters[1]),
    Rule("exclamations", lambda d: 4 * d.n_bangs > d.n_words),
    Rule("stutter", lambda d: 5 * d.n_stutters > d.n_words),
)
BASE = ("few_words", "repeated_windows")


class Measured(NamedTuple):
    name: str
    cost_us: float
    rejected: float


def calibrate(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 200, sample_bytes: int = 1 << 18) -> list[Measured]:
    """Cost (microseconds a document, its features included) and selectivity of each rule on at most ``sample_rows`` texts of at most ``sample_bytes`` each, best rejection per cost first.

    The sample only decides the order of evaluation. Spark reads no more partitions than it takes to fill it, and what comes
    to the driver is at most ``sample_rows * sample_bytes``.
    """
    raw = bytes_of()
    texts = [bytes(r.raw) for r in docs.where(F.octet_length(raw) <= sample_bytes).select(raw.alias("raw")).limit(sample_rows).collect()]
    n, found = max(1, len(texts)), []
    for r in rules:
        began = time.perf_counter()
        hits = sum(r.rejects(Doc(x)) for x in texts)
        found.append(Measured(r.name, (time.perf_counter() - began) * 1e6 / n, hits / n))
    at = {r.name: i for i, r in enumerate(rules)}
    return sorted(found, key=lambda m: (-m.rejected / max(m.cost_us, 1e-9), at[m.name]))


def in_order(measured: Sequence[Measured], rules: Sequence[Rule] = RULES) -> list[Rule]:
    """The rules in the order measured; those not measured come last."""
    by, first = {r.name: r for r in rules}, [m.name for m in measured]
    return [by[n] for n in first if n in by] + [r for r in rules if r.name not in first]


def judge(doc: Doc, rules: Sequence[Rule]) -> str | None:
    """The first rule that rejects the document, or None."""
    for r in rules:
        if r.rejects(doc):
            return r.name
    return None


def quality_verdicts(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 200) -> DataFrame:
    """doc_id, the base features, base_failed, kept and failed_rule (the first in the calibrated order; null if kept), one row per row of ``docs``. No shuffle."""
    ordered = in_order(calibrate(docs, rules, sample_rows), rules)
    base = [r for r in rules if r.name in BASE]

    def each(b):
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        out: dict[str, list] = {"doc_id": b.column(0), **{n: [] for n in names}, "base_failed": [], "kept": [], "failed_rule": []}
        for raw in b.column(1).to_pylist():
            d = Doc(raw)
            for n in names:
                out[n].append(getattr(d, n))
            failed = judge(d, ordered)
            out["base_failed"].append(any(r.rejects(d) for r in base))
            out["kept"].append(failed is None)
            out["failed_rule"].append(failed)
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", bytes_of().alias("raw")), each, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, failed_rule string")


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 200) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns. The cascade alone runs: no feature is computed that no rule asks for."""
    small_batches(docs.sparkSession)
    ordered = in_order(calibrate(docs, rules, sample_rows), rules)

    @F.pandas_udf("boolean")
    def good(raws: pd.Series) -> pd.Series:
        return pd.Series([judge(Doc(x), ordered) is None for x in raws], dtype=bool)

    (mark,) = fresh(docs, "quality_ok")
    return docs.withColumn(mark, good(bytes_of())).where(F.col(mark)).drop(mark)
