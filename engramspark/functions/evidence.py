"""Evidence levels, trust bands and score priors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DEFAULT, EVIDENCE_DELTA, EVIDENCE_RANK, TRUST_BANDS


def lookup(table: dict, key: Column) -> Column:
    """The value of a small constant table, or null."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.coalesce(key, F.lit("\0")))


def is_level(level: Column) -> Column:
    return F.coalesce(level.isin(*EVIDENCE_RANK), F.lit(False))


def level_of(meta: Column, tags: Column, default: str | None = None) -> Column:
    """The level in the metadata if it is one, else that of the first tag that names one, else the default."""
    named = F.transform(F.filter(tags, lambda t: t.startswith("evidence:")), lambda t: F.substring(t, 10, 64))
    first = F.get(F.filter(named, lambda t: t.isin(*EVIDENCE_RANK)), 0)
    return F.coalesce(F.when(is_level(meta), meta), first, F.lit(default).cast("string"))


def strictest(meta: Column, tags: Column) -> Column:
    """The rank of the highest level on either carrier, or null."""
    named = F.transform(F.filter(tags, lambda t: t.startswith("evidence:")), lambda t: lookup(EVIDENCE_RANK, F.substring(t, 10, 64)))
    return F.greatest(lookup(EVIDENCE_RANK, meta), F.array_max(named))


def badge(level: Column) -> Column:
    return F.when(is_level(level) & (level != "single_source"), F.concat(F.lit("["), level, F.lit("] "))).otherwise("")


def band(vocabulary: str, value: Column) -> Column:
    """Trust band 1 to 3 of a value in one of three vocabularies, or null."""
    return lookup(TRUST_BANDS[vocabulary], F.lower(F.trim(value)))


def delta(level: Column) -> Column:
    return F.coalesce(lookup(EVIDENCE_DELTA, level), F.lit(0.0))


def recency(age_days: Column, half_life: float = DEFAULT.recency_half_life, most: float = DEFAULT.recency_max) -> Column:
    """Boost that halves with every ``half_life`` days; 0 where the age isn't known."""
    boost = F.lit(most) * F.exp(-F.log(F.lit(2.0)) * F.greatest(age_days.cast("double"), F.lit(0.0)) / half_life)
    return F.when(age_days.isNotNull(), boost).otherwise(F.lit(0.0))  # greatest() skips nulls


def event_proximity(gap_days: Column, trusted: Column, half_life: float = DEFAULT.event_half_life, most: float = DEFAULT.event_max) -> Column:
    """Boost by closeness of the event to the time asked about; 0 for dates that weren't verified."""
    return F.when(trusted, recency(F.abs(gap_days), half_life, most)).otherwise(F.lit(0.0))


def grade(strong: Column, n: Column) -> Column:
    """Grade of a decision by its evidence: any strong kind, any at all, none."""
    return F.when(strong, F.lit("corroborated")).when(n > 0, F.lit("single_source")).otherwise(F.lit("unverified"))
