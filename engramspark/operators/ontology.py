"""Typed decomposition of conversations: nodes, their edges, aliases and beliefs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug, title_of, word_tokens

KINDS = ("entity", "fact", "decision", "event", "action", "question")


def typed_nodes(rows: DataFrame, conv: str, kinds: Sequence[str] = KINDS, limit: int = 20) -> DataFrame:
    """conv, kind, pos, slug, title and text of the nodes of each conversation, from one array column of strings per kind: at most ``limit`` of a kind by position, the first surface of each slug."""
    each = [rows.select(F.col(conv).alias("conv"), F.lit(k).alias("kind"), F.posexplode(k).alias("pos", "text")) for k in kinds if k in rows.columns]
    flat = each[0]
    for x in each[1:]:
        flat = flat.unionByName(x)
    flat = flat.withColumn("slug", slug(F.col("text"))).where("slug <> ''")
    first = flat.groupBy("conv", "kind", "slug").agg(F.min_by(F.struct("pos", "text"), "pos").alias("x")).select("conv", "kind", "slug", "x.pos", "x.text")
    nth = F.row_number().over(Window.partitionBy("conv", "kind").orderBy("pos"))
    return first.withColumn("nth", nth).where(F.col("nth") <= limit).select("conv", "kind", F.col("pos").cast("long").alias("pos"), "slug", title_of(F.col("text")).alias("title"), "text")


def promoted(rows: DataFrame, conv: str, entities: str = "entity", limit: int = 8) -> DataFrame:
    """The entities of each conversation that become items, with an ABOUT edge: the first surface of each slug, at most eight."""
    return typed_nodes(rows.select(conv, F.col(entities).alias("entity")), conv, ["entity"], limit).select("conv", "slug", "title", F.lit("ABOUT").alias("edge_type"))


def mention_edges(nodes: DataFrame, kinds: Sequence[str] = ("fact", "decision", "action")) -> DataFrame:
    """conv, kind, slug, entity: statements that name an entity of their conversation, its words side by side. Both sides of a conversation are at most twenty rows a kind, so they meet by an equi-join on it."""
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(word_tokens(c), " "), F.lit(" "))
    names = nodes.where("kind = 'entity'").select("conv", F.col("slug").alias("entity"), spaced(F.col("text")).alias("name"))
    said = nodes.where(F.col("kind").isin(*kinds)).select("conv", "kind", "slug", spaced(F.col("text")).alias("said"))
    return said.join(names, "conv").where(F.expr("contains(said, name)") & (F.trim("name") != "")).select("conv", "kind", "slug", "entity").distinct()


def resolved_aliases(surfaces: DataFrame, entities: DataFrame) -> DataFrame:
    """slug of new surfaces (surface) -> hub, among entities (slug, aliases): an entity of the very slug wins, else the smallest that lists it as an alias, else itself."""
    new = surfaces.select("surface", slug(F.col("surface")).alias("slug"))
    exact = entities.select(F.col("slug"), F.col("slug").alias("own"))
    listed = entities.select(F.col("slug").alias("hub"), F.explode("aliases").alias("a")).groupBy(slug(F.col("a")).alias("slug")).agg(F.min("hub").alias("hub"))
    return new.join(exact, "slug", "left").join(listed, "slug", "left").select("surface", "slug", F.coalesce("own", "hub", "slug").alias("hub"))


def belief_edges(claims: DataFrame, own: DataFrame, existing: DataFrame) -> DataFrame:
    """source, target, edge_type and found of claims (source, target_text, edge_type): the target is a fact of this call, else one that exists, else a kref as it stands; claims without a target, or about themselves, go."""
    c = claims.withColumn("target_slug", slug(F.col("target_text")))
    mine = own.select(F.col("slug").alias("target_slug"), F.col("slug").alias("here")).distinct()
    there = existing.select(F.col("slug").alias("target_slug"), F.col("kref").alias("there"))
    kref = F.when(F.col("target_text").startswith("kref://"), F.col("target_text"))
    both = c.join(mine, "target_slug", "left").join(there, "target_slug", "left").withColumn("target", F.coalesce("here", "there", kref))
    found = F.when(F.col("here").isNotNull(), "call").when(F.col("there").isNotNull(), "graph").otherwise("kref")
    return both.where(F.col("target").isNotNull() & (F.col("target") != F.col("source"))).select("source", "target", "edge_type", found.alias("found"))


def provenance_complete(markers: DataFrame, edges: DataFrame) -> DataFrame:
    """Markers (id, expected) with ``complete``: as many DERIVED_FROM edges (target) came in as were promised, or none were."""
    n = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"))
    return markers.join(n, "id", "left").select("id", ((F.coalesce("expected", F.lit(0)) <= 0) | (F.coalesce("n", F.lit(0)) >= F.col("expected"))).alias("complete"))


def flattened(entities: Column, facts: Column, decisions: Column, implications: Column) -> dict[str, Column]:
    """An extraction as metadata strings: blanks out, each kind with its own separator."""
    full = lambda c: F.filter(c, lambda x: F.trim(x) != "")
    return {"entities": F.array_join(full(entities), ", "), "facts": F.array_join(full(facts), "; "), "decisions": F.array_join(full(decisions), "; "), "implications": F.array_join(full(implications), "\n")}


def canonical_date(dates: Column) -> Column:
    """The smallest valid ISO date of an array, as strings compare."""
    return F.array_min(F.filter(dates, lambda x: F.coalesce(x.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), F.lit(False))))
