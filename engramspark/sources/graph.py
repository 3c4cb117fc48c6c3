"""Scans of the memory graph's own tables (``schemas.TABLES``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hidden(kind: Column) -> Column:
    """Kinds that runs write about themselves."""
    return kind.startswith("_") | (kind == "space-profile")


def spaces_under(spaces: DataFrame, project: str, root: str = "") -> DataFrame:
    """The spaces of a project at or below a path, the root first."""
    path = F.col("space_path")
    inside = (path == root) | path.startswith(root.rstrip("/") + "/") if root else F.lit(True)
    return spaces.where((F.col("project") == project) & inside).dropDuplicates(["space_path"]).orderBy(F.length("space_path"), "space_path")


def items_of(items: DataFrame, space: str | None = None, kind: str | None = None, deprecated: bool = False) -> DataFrame:
    """Items by space and kind; both filters reach the scan."""
    out = items if deprecated else items.where(~F.col("deprecated"))
    out = out if space is None else out.where(F.col("space_path") == space)
    return out if kind is None else out.where(F.col("kind") == kind)


def latest_revisions(revisions: DataFrame) -> DataFrame:
    """One revision per item: the flagged one, else the highest number."""
    return revisions.groupBy("item_kref").agg(F.max_by(F.struct(*[c for c in revisions.columns if c != "item_kref"]), F.struct(F.coalesce("latest", F.lit(False)), "number")).alias("x")).select("item_kref", "x.*")


def split_list(text: Column) -> Column:
    """A comma-separated list as an array, blanks out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def live_entities(items: DataFrame, revisions: DataFrame) -> DataFrame:
    """Entities that aren't deprecated, with the title and aliases of their latest revision."""
    live = items_of(items, kind="entity").select("item_kref", "slug")
    return live.join(latest_revisions(revisions), "item_kref").select("item_kref", "slug", "title", split_list(F.col("metadata")["aliases"]).alias("aliases"))


def fresh_revisions(items: DataFrame, revisions: DataFrame, ledger: DataFrame, since: str | None) -> DataFrame:
    """What an incremental run reads: the latest revisions of visible items after the cursor, or of unreadable time, that the ledger hasn't parked."""
    seen = items_of(items).where(~hidden(F.col("kind"))).select("item_kref")
    rows = latest_revisions(revisions).where(~F.coalesce("deprecated", F.lit(False))).join(seen, "item_kref", "left_semi")
    if since is not None:
        rows = rows.where(F.col("created_at").isNull() | (F.col("created_at") > F.lit(since).cast("timestamp")))
    return rows.join(ledger.where("parked_at IS NOT NULL").select(F.col("key").alias("item_kref")), "item_kref", "left_anti")


def recall_projection(revisions: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """The columns of a recalled memory; with ``artifacts`` (kref, name, location, text) the full text too, '' where it is missing. Without, no content column is read."""
    base = revisions.select(
        "kref", F.col("item_kref").alias("_item_kref"), "title", "summary", F.col("memory_type").alias("type"), F.regexp_extract("item_kref", r"^kref://[^/]+/(.*)/[^/]+$", 1).alias("space"),
        "created_at", "tags", "evidence_level", "source", "event_date", "event_date_confidence", "valid_from", "valid_to", "grounding_stale",
    )
    if artifacts is None:
        return base
    one = artifacts.groupBy("kref").agg(F.min_by(F.struct(F.col("name").alias("artifact_name"), F.col("location").alias("artifact_location"), F.col("text").alias("content")), "name").alias("a"))
    return base.join(one, "kref", "left").select(*base.columns, "a.artifact_name", "a.artifact_location", F.coalesce("a.content", F.lit("")).alias("content"))


def normalized_messages(messages: DataFrame) -> DataFrame:
    """Messages with blank ones out; an index is a message's place before that."""
    return messages.where(F.trim(F.coalesce("content", F.lit(""))) != "")


def bundle_members(revisions: DataFrame, members: DataFrame) -> DataFrame:
    """Members of the bundles among the revisions, each bundle once."""
    bundles = revisions.where(F.col("item_kref").endswith(".bundle")).select("item_kref").distinct()
    return members.join(bundles, "item_kref", "left_semi").dropDuplicates()


def known_shas(mentions: DataFrame, commits: DataFrame, least: int = 7) -> DataFrame:
    """Mentions (token) that are the beginning of one commit's hash, with it. They meet by their first ``least`` digits; a token is one hash's where the smallest and the largest that it begins are the same."""
    hexes = mentions.where(F.col("token").rlike(rf"^[0-9a-f]{{{least},40}}$")).select("token").distinct()
    head = lambda c: F.substring(F.col(c), 1, least).alias("head")
    met = hexes.select("token", head("token")).join(commits.select("hash", head("hash")), "head").where(F.col("hash").startswith(F.col("token")))
    return met.groupBy("token").agg(F.min("hash").alias("hash"), F.max("hash").alias("last")).where("hash = last").drop("last")


def first_source(*sources: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows of each session from the first source that has any."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s.join(out.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
    return out
