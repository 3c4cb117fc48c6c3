"""What models answer, as data: JSON found in a reply, and the fields of a summary with their defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LISTS = "array<string>"
SUMMARY = (
    f"title string, summary string, events {_LISTS}, implications {_LISTS}, knowledge struct<facts {_LISTS}, decisions {_LISTS}, actions {_LISTS}, open_questions {_LISTS}>, "
    f"classification struct<topics {_LISTS}, entities {_LISTS}>"
)


def json_in(reply: Column) -> Column:
    """The JSON text in a reply, or null: the whole, the whole without a code fence, or the first object or list in it. A reply is short: each of its closing brackets is tried."""
    whole = F.trim(F.regexp_replace(F.coalesce(reply, F.lit("")), r"^\s+|\s+$", ""))
    bare = F.regexp_replace(F.regexp_replace(whole, r"(?i)^```(?:json)?\s*\n?", ""), r"\n?```\s*$", "")
    valid = lambda c: F.when((c != "") & F.try_parse_json(c).isNotNull(), c)
    first = F.regexp_extract(bare, r"(?s)^[^{\[]*(.*)$", 1)

    def shortest(closing: str) -> Column:
        parts = F.split(first, f"\\{closing}")
        starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), closing), F.lit(closing)))
        return F.get(F.filter(starts, lambda s: F.try_parse_json(s).isNotNull()), 0)

    found = F.when(first.startswith("{"), shortest("}")).otherwise(shortest("]"))
    return F.coalesce(valid(whole), valid(bare), F.when(first != "", found))


def summary_fields(json: Column) -> Column:
    """A summary's fields, absent lists empty and an absent title the usual one; null where there is no JSON object."""
    x = F.from_json(json, SUMMARY)
    none = F.array().cast(_LISTS)
    told = lambda c: F.filter(F.coalesce(c, none), lambda v: F.trim(v) != "")
    knowledge = F.struct(*(told(x.knowledge[k]).alias(k) for k in ("facts", "decisions", "actions", "open_questions")))
    classes = F.struct(*(told(x.classification[k]).alias(k) for k in ("topics", "entities")))
    title = F.coalesce(F.when(F.trim(x.title) != "", x.title), F.lit("Conversation summary"))
    out = F.struct(title.alias("title"), F.coalesce(x.summary, F.lit("")).alias("summary"), told(x.events).alias("events"), told(x.implications).alias("implications"), knowledge.alias("knowledge"), classes.alias("classification"))
    return F.when(F.coalesce(json, F.lit("")).startswith("{"), out)
