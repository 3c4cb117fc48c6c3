"""Graph legs: traversal, bridges between angles, fact recall, neighbours of entities, disputes, chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import BELIEF_EDGES, DEFAULT, DISPUTE_BASES, Config
from .ranking import top_k


def edge_class(edge_type: Column, basis: Column | None = None) -> Column:
    """0 for belief edges, 1 for others; a dispute without a basis that counts isn't a belief (2)."""
    belief = edge_type.isin(*BELIEF_EDGES)
    if basis is None:
        return F.when(belief, 0).otherwise(1)
    unfounded = belief & ~F.coalesce(basis.isin(*DISPUTE_BASES), F.lit(False))
    return F.when(unfounded, 2).when(belief, 0).otherwise(1)


def both_ends(edges: DataFrame, source: str, target: str, *more: str) -> DataFrame:
    """Each edge from either end: node, other, direction, and the columns asked for."""
    out = edges.select(F.col(source).alias("node"), F.col(target).alias("other"), F.lit("out").alias("direction"), *more)
    return out.unionByName(edges.select(F.col(target).alias("node"), F.col(source).alias("other"), F.lit("in").alias("direction"), *more))


def expand(seeds: DataFrame, edges: DataFrame, types: Sequence[str] = DEFAULT.walked, key: Sequence[str] = ()) -> DataFrame:
    """One hop from the seeds (node, seed_rank) over edges (source, target, edge_type): for each node reached that is no seed the first discovery in the order of seed, class, type and node. Score 0: its relevance wasn't measured."""
    walked = both_ends(edges.where(F.col("edge_type").isin(*types)), "source", "target", "edge_type")
    found = seeds.join(walked, "node").select(*key, F.col("other").alias("reached"), F.col("node").alias("from_node"), "edge_type", "direction", "seed_rank")
    known = seeds.select(*key, F.col("node").alias("reached"))
    fresh = found.join(known, [*key, "reached"], "left_anti")
    order = F.struct(F.col("seed_rank"), edge_class(F.col("edge_type")).alias("class"), F.col("edge_type"), F.col("from_node"), F.col("direction"))
    first = fresh.groupBy(*key, "reached").agg(F.min_by(F.struct("from_node", "edge_type", "direction"), order).alias("x"))
    return first.select(*key, "reached", "x.*", F.lit(0.0).alias("score"))


def degree(edges: DataFrame, node: str) -> DataFrame:
    """How many edges each node has at this end."""
    return edges.groupBy(node).agg(F.count("*").alias("degree"))


def neighbours(seeds: DataFrame, about: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Two hops from seeds (memory_id) over ``about`` (memory_id, entity_id): the smallest anchors of each seed, then the smallest other memories of each anchor. Hubs come last among anchors. No score."""
    hub = degree(about, "entity_id").withColumn("hub", (F.col("degree") > config.hub_degree).cast("int"))
    anchors = seeds.join(about, "memory_id").select(F.col("memory_id").alias("seed_id"), "entity_id").join(hub, "entity_id")
    anchors = top_k(anchors, ["seed_id"], [F.col("hub"), F.col("entity_id")], config.anchors_per_seed, "anchor_rank")
    near = anchors.select("seed_id", "entity_id", "anchor_rank").join(about.select("entity_id", F.col("memory_id").alias("reached_id")), "entity_id").where("reached_id <> seed_id")
    return top_k(near, ["seed_id", "entity_id"], [F.col("reached_id")], config.siblings_per_anchor, "sibling_rank").select("seed_id", "entity_id", "reached_id", F.col("anchor_rank").cast("long"), F.col("sibling_rank").cast("long"))


def related(anchors: DataFrame, relations: DataFrame, edges_per_anchor: int = 3) -> DataFrame:
    """From anchors (entity_id) over ``relations`` (source, target, relation) to other entities: the first edges of each anchor, the generic relation last."""
    ends = both_ends(relations, "source", "target", "relation").withColumnRenamed("node", "entity_id")
    order = [(F.col("relation") == "RELATES_TO").cast("int"), F.col("relation"), F.col("other"), F.col("direction")]
    return top_k(anchors.join(ends, "entity_id"), ["entity_id"], order, edges_per_anchor, "edge_rank")


def bridges(hits: DataFrame, about: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Entities that the hits (angle, memory_id, score > 0) of two angles or more are about: link is the second best of the angles' best scores, the highest first, and among equals the largest entity."""
    per_angle = hits.where("score > 0").join(about, "memory_id").groupBy("entity_id", "angle").agg(F.max("score").alias("best"))
    linked = per_angle.groupBy("entity_id").agg(F.sort_array(F.collect_list("best"), asc=False).alias("all"), F.count("*").alias("angles")).where("angles >= 2")
    return linked.select("entity_id", F.element_at("all", 2).alias("link"), "angles")


def bridge_rows(found: DataFrame, about: DataFrame, seen: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Memories about the best bridges that weren't seen: two of each, hubs' last, four in all. Ranked before the caps, so a memory counts for its first bridge alone."""
    hub = degree(about, "entity_id").withColumn("hub", (F.col("degree") > config.hub_degree).cast("int")).select("entity_id", "hub")
    best = found.orderBy(F.col("link").desc(), F.col("entity_id").desc()).limit(config.bridges).withColumn("bridge_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("link").desc(), F.col("entity_id").desc())))
    near = best.join(hub, "entity_id").join(about.select("entity_id", "memory_id"), "entity_id").join(seen.select("memory_id"), "memory_id", "left_anti")
    near = top_k(near, ["memory_id"], [F.col("hub"), F.col("bridge_rank")], 1, "__first")
    near = top_k(near, ["entity_id"], [F.col("memory_id")], config.nodes_per_bridge, "node_rank")
    order = [F.col("hub"), F.col("bridge_rank"), F.col("node_rank")]
    return top_k(near, [], order, config.bridge_results, "position").select("position", "memory_id", "entity_id", F.round(F.col("link") * config.bridge_factor, 6).alias("score"))


def fact_leg(hits: DataFrame, base: DataFrame, seen: DataFrame, scope: Sequence[str] = (), config: Config = DEFAULT) -> DataFrame:
    """The best facts (memory_id, space, score) in scope that weren't seen, scored just under the least base score (null counts as 0)."""
    inside = hits.where(F.col("space").isin(*scope)) if scope else hits
    floor = base.agg(F.min(F.coalesce("score", F.lit(0.0))).alias("floor"))  # one row
    best = top_k(inside, [], [F.col("score").desc_nulls_last(), F.col("memory_id")], config.fact_limit, "fact_rank").join(seen.select("memory_id"), "memory_id", "left_anti")
    kept = top_k(best, [], [F.col("fact_rank")], config.fact_results, "position")
    return kept.join(F.broadcast(floor)).select("position", "memory_id", F.round(F.col("floor") * config.fact_factor, 6).alias("score"))


def contested(rows: DataFrame, disputes: DataFrame, ident: str, config: Config = DEFAULT) -> DataFrame:
    """Adds ``contested_by``: at most three disputing memories, the smallest, from disputes (disputing, disputed, basis) whose basis counts."""
    counted = disputes.where(F.col("basis").isin(*DISPUTE_BASES)).select(F.col("disputed").alias(ident), "disputing").distinct()
    least = top_k(counted, [ident], [F.col("disputing")], config.contested)  # a row that thousands dispute is cut before it is gathered
    by = least.groupBy(ident).agg(F.array_sort(F.collect_list("disputing")).alias("contested_by"))
    return rows.join(by, ident, "left")


def chain_depth(edges: DataFrame, depth: int = DEFAULT.chain_depth) -> DataFrame:
    """How many steps each newer node's chain of SUPERSEDES has, along the first edge of each, at most ``depth``; a chain that bites its tail stops there.

    By doubling: a table of jumps of 1, 2, 4, ... steps, of which each node takes those that its depth needs, so it takes
    log2(depth) joins and not depth of them.
    """
    one = edges.where("newer_id <> older_id").groupBy(F.col("newer_id").alias("n")).agg(F.min("older_id").alias("to"))
    at = one.select("n", F.col("n").alias("here"), F.lit(0).alias("depth"))
    jumps, powers, p = {1: one}, [1], 1
    while p * 2 <= depth:
        prev = jumps[p]
        jumps[p * 2] = prev.alias("a").join(prev.alias("b"), F.col("a.to") == F.col("b.n")).select(F.col("a.n"), F.col("b.to").alias("to"))
        p *= 2
        powers.append(p)
    for p in reversed(powers):
        step = jumps[p].select(F.col("n").alias("here"), "to")
        at = at.join(step, "here", "left").select("n", F.when(F.col("to").isNotNull() & (F.col("depth") + p <= depth), F.col("to")).otherwise(F.col("here")).alias("here"), F.when(F.col("to").isNotNull() & (F.col("depth") + p <= depth), F.col("depth") + p).otherwise(F.col("depth")).alias("depth"))
    return at.select(F.col("n").alias("newer_id"), F.col("depth").cast("long").alias("depth"))


def ripple(supersedes: DataFrame, depends: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Decisions that depend on a superseded fact, at most twenty a fact: fact, dependent and what superseded it."""
    stale = supersedes.groupBy(F.col("older").alias("fact")).agg(F.min("newer").alias("superseded_by"))
    hit = depends.select("dependent", "fact").distinct().join(stale, "fact")
    return top_k(hit, ["fact"], [F.col("dependent")], config.ripple, "ripple_rank").select("fact", "dependent", "superseded_by")


def cleared(stale: DataFrame, live: DataFrame, depends: DataFrame) -> DataFrame:
    """Stale marks (dependent, superseded_by) that go: the superseder isn't live any more, or the dependent depends on it now."""
    gone = stale.join(live.select(F.col("id").alias("superseded_by")), "superseded_by", "left_anti").withColumn("reason", F.lit("superseder_gone"))
    again = stale.join(live.select(F.col("id").alias("superseded_by")), "superseded_by", "left_semi")
    again = again.join(depends.select("dependent", F.col("fact").alias("superseded_by")).distinct(), ["dependent", "superseded_by"], "left_semi").withColumn("reason", F.lit("reconfirmed"))
    return gone.unionByName(again)


def tracked_path(paths: DataFrame, tracked: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``resolved``: the tracked file of this path, else the only one that ends with it at a slash, else ''. Suffixes meet by an equi-join."""
    parts = F.split("file", "/")
    ends = tracked.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))
    one = ends.groupBy("suffix").agg(F.count("*").alias("n"), F.min("file").alias("only"), F.max((F.col("suffix") == F.col("file")).cast("int")).alias("exact"))
    one = one.select(F.col("suffix").alias(path), F.when(F.col("exact") == 1, F.col("suffix")).when(F.col("n") == 1, F.col("only")).otherwise("").alias("resolved"))
    return paths.join(one, path, "left").withColumn("resolved", F.coalesce("resolved", F.lit("")))
