"""Small predicates and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .evidence import is_level

#: Captures that assert something about earlier work.
RELATING = ("architecture", "decision", "implementation", "reflection", "synthesis")


def evidence_tag(level: Column) -> Column:
    """``evidence:<level>``; any other value ends the query with an error."""
    return F.when(is_level(level), F.concat(F.lit("evidence:"), level)).otherwise(F.raise_error(F.concat(F.lit("unknown evidence level: "), F.coalesce(level, F.lit("null")))))


def quarantined(metadata: Column) -> Column:
    return F.coalesce(metadata["quarantined"] == "true", F.lit(False))


def earns_discovery(kind: Column) -> Column:
    return F.coalesce(kind.isin(*RELATING), F.lit(False))


def channel_space(channel: Column, project: Column, team: Column, group: Column) -> Column:
    """Space of a message by its channel; channels that aren't known are personal."""
    named = lambda c: F.coalesce(F.when(c != "", c), F.lit("default"))
    path = F.when(channel == "team_channel", F.concat(F.lit("work/"), named(team))).when(channel == "group_dm", F.concat(F.lit("groups/"), named(group))).otherwise("personal")
    return F.concat(project, F.lit("/"), path)


def policy_tags(tags: Column) -> Column:
    """The tags that runs mustn't touch."""
    return F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: (t == "published") | t.startswith("evidence:"))


def protected(tags: Column, allow_published: bool = False) -> Column:
    return F.lit(False) if allow_published else F.coalesce(F.array_contains(tags, "published"), F.lit(False))


def recall_signature(query: Column, spaces: Column, kinds: Column, mode: Column, graph: Column) -> Column:
    """What makes two recalls the same."""
    return F.concat_ws("\x1f", query, F.array_join(spaces, ","), F.array_join(kinds, ","), mode, graph.cast("string"))


def numeric_score(base: Column, score: Column) -> Column:
    """The score before any prior, where it was kept, else the score; absent stays absent."""
    return F.coalesce(base, score).cast("double")
