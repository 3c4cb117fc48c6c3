"""Partial dates, validity intervals and kref parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_partial(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), F.lit(False))


def lower_bound(text: Column) -> Column:
    """First day of a year, month or day; null if it is none."""
    padded = F.when(F.length(text) == 4, F.concat(text, F.lit("-01-01"))).when(F.length(text) == 7, F.concat(text, F.lit("-01"))).otherwise(text)
    return F.when(is_partial(text), F.try_to_date(padded, "yyyy-MM-dd"))


def upper_bound(text: Column) -> Column:
    """Last day of a year, month or day; null if it is none."""
    year = F.try_to_date(F.concat(F.substring(text, 1, 4), F.lit("-12-31")), "yyyy-MM-dd")
    return F.when(is_partial(text), F.when(F.length(text) == 4, year).when(F.length(text) == 7, F.last_day(lower_bound(text))).otherwise(lower_bound(text)))


def excluded(valid_from: Column, valid_to: Column, as_of: Column) -> Column:
    """Whether ``as_of`` lies outside the interval; an absent bound is open."""
    return F.coalesce(as_of < lower_bound(valid_from), F.lit(False)) | F.coalesce(as_of > upper_bound(valid_to), F.lit(False))


def moment(text: Column) -> Column:
    """ISO time to a timestamp, without a zone in the session's; null if it is none."""
    return F.try_to_timestamp(text)


def kref_slug(kref: Column) -> Column:
    """Name of the item of a kref: its last segment without revision and kind."""
    return F.regexp_replace(last_segment(kref), r"\.[^.]*$", "")


def kref_kind(kref: Column) -> Column:
    """Kind of the item: what follows the last dot."""
    return F.regexp_extract(last_segment(kref), r"\.([^.]+)$", 1)


def last_segment(kref: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(kref, r"\?.*$", ""), r"([^/]+)$", 1)


def space_of(kref: Column) -> Column:
    """Project and space of a kref of three segments or more, else null."""
    path = F.regexp_extract(kref, r"^kref://([^?]+)/[^/?]+", 1)
    return F.when(path.contains("/"), path)


def session_id(context: Column, user: Column, day: Column, sequence: Column) -> Column:
    """``context:user-<hash>:yyyymmdd:nnn``."""
    return F.concat_ws(":", context, F.concat(F.lit("user-"), F.substring(F.sha2(user, 256), 1, 10)), F.date_format(day, "yyyyMMdd"), F.lpad(sequence.cast("string"), 3, "0"))
