"""Queries of traversal, bridges, beliefs, chains and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import ranking as R
from ..operators import sessions as S
from ..operators.maintenance import orphans
from ..sources import memory as M
from ..sources.memory import VIEWS, with_views
from .registry import query

_EDGES_SQL = """e AS (SELECT newer_id AS source, older_id AS target, CASE newer_id % 4 WHEN 0 THEN 'SUPERSEDES' WHEN 1 THEN 'CONTRADICTS' WHEN 2 THEN 'DEPENDS_ON' ELSE 'OTHER' END AS edge_type FROM v_supersedes),
b AS (SELECT source AS node, target AS other, 'out' AS direction, edge_type FROM e UNION ALL SELECT target, source, 'in', edge_type FROM e)"""


def _typed(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("newer_id") % 4
    kind = F.when(m == 0, "SUPERSEDES").when(m == 1, "CONTRADICTS").when(m == 2, "DEPENDS_ON").otherwise("OTHER")
    return M.supersedes(spark, d).select(F.col("newer_id").alias("source"), F.col("older_id").alias("target"), kind.alias("edge_type"))


@query(
    with_views(
        "v_supersedes",
        body=_EDGES_SQL
        + """, s AS (SELECT o_orderkey AS node, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS seed_rank FROM orders QUALIFY seed_rank <= 2),
f AS (SELECT b.other AS reached, b.node AS from_node, b.edge_type, b.direction, row_number() OVER (PARTITION BY b.other ORDER BY seed_rank, CASE WHEN b.edge_type IN ('CONTRADICTS', 'SUPERSEDES', 'SUPPORTS') THEN 0 ELSE 1 END, b.edge_type, b.node, b.direction) AS k
  FROM s JOIN b ON b.node = s.node WHERE b.edge_type <> 'OTHER' AND b.other NOT IN (SELECT node FROM s))
SELECT reached, from_node, edge_type, direction FROM f WHERE k = 1""",
    )
)
def edge_expand_1hop(spark: SparkSession, d: str) -> DataFrame:
    o = M.table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), "o_custkey", "o_totalprice")
    seeds = R.top_k(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("node")], 2, "seed_rank").select("node", "seed_rank")
    return G.expand(seeds, _typed(spark, d)).select("reached", "from_node", "edge_type", "direction")


@query(
    with_views(
        "v_supersedes",
        body="""d AS (SELECT newer_id AS disputing, older_id // 8 AS disputed, CASE newer_id % 3 WHEN 0 THEN 'agent' WHEN 1 THEN 'evidence-assessor' ELSE 'import' END AS basis FROM v_supersedes),
g AS (SELECT disputed, list_slice(list_sort(list_distinct(list(disputing))), 1, 3) AS who FROM d WHERE basis <> 'import' GROUP BY disputed)
SELECT o_orderkey, coalesce(array_to_string(who, ','), '') AS contested_by FROM orders LEFT JOIN g ON disputed = o_orderkey""",
    )
)
def contested_markers(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("newer_id") % 3
    disputes = M.supersedes(spark, d).select(F.col("newer_id").alias("disputing"), F.floor(F.col("older_id") / 8).cast("long").alias("disputed"), F.when(m == 0, "agent").when(m == 1, "evidence-assessor").otherwise("import").alias("basis"))
    rows = M.table(spark, d, "orders").select("o_orderkey")
    return G.contested(rows, disputes, "o_orderkey").select("o_orderkey", F.coalesce(F.array_join("contested_by", ","), F.lit("")).alias("contested_by"))


@query(
    with_views(
        "v_about",
        body="""g AS (SELECT entity_id, count(*) AS degree FROM v_about GROUP BY entity_id),
a AS (SELECT memory_id AS seed_id, v.entity_id, row_number() OVER (PARTITION BY memory_id ORDER BY (degree > 12)::INT, v.entity_id) AS anchor_rank FROM v_about v JOIN g ON g.entity_id = v.entity_id WHERE memory_id % 100 = 0),
n AS (SELECT a.*, v.memory_id AS reached_id, row_number() OVER (PARTITION BY seed_id, a.entity_id ORDER BY v.memory_id) AS sibling_rank FROM a JOIN v_about v ON v.entity_id = a.entity_id WHERE anchor_rank <= 6 AND v.memory_id <> seed_id)
SELECT seed_id, entity_id, reached_id, anchor_rank, sibling_rank FROM n WHERE sibling_rank <= 5""",
    )
)
def neighbour_2hop(spark: SparkSession, d: str) -> DataFrame:
    """The seeds are the query set: every hundredth memory, against all edges."""
    about = M.about(spark, d)
    seeds = about.where("memory_id % 100 = 0").select("memory_id").distinct()
    return G.neighbours(seeds, about)


@query(
    """WITH r AS (SELECT DISTINCT l_partkey * 2 AS source, l_suppkey * 2 + 1 AS target, CASE l_partkey % 3 WHEN 0 THEN 'USES' WHEN 1 THEN 'PART_OF' ELSE 'RELATES_TO' END AS relation FROM lineitem),
b AS (SELECT source AS entity_id, target AS other, 'out' AS direction, relation FROM r UNION ALL SELECT target, source, 'in', relation FROM r)
SELECT entity_id, other, relation, direction, edge_rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY (relation = 'RELATES_TO')::INT, relation, other, direction) AS edge_rank FROM b) WHERE edge_rank <= 3"""
)
def relation_3hop(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("l_partkey") % 3
    rel = M.table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("source"), (F.col("l_suppkey") * 2 + 1).alias("target"), F.when(m == 0, "USES").when(m == 1, "PART_OF").otherwise("RELATES_TO").alias("relation")).distinct()
    anchors = rel.select(F.col("source").alias("entity_id")).union(rel.select("target")).distinct()
    return G.related(anchors, rel).select("entity_id", "other", "relation", "direction", F.col("edge_rank").cast("long").alias("edge_rank"))


@query(
    with_views(
        "v_about",
        body="""h AS (SELECT o_orderkey AS memory_id, o_custkey % 5 AS angle, (o_orderkey * 7919 % 1000) / 1000.0E0 AS score FROM orders),
p AS (SELECT entity_id, angle, max(score) AS best FROM h JOIN v_about v ON v.memory_id = h.memory_id WHERE score > 0 GROUP BY entity_id, angle)
SELECT entity_id, list_sort(list(best), 'DESC')[2] AS link, count(*) AS angles FROM p GROUP BY entity_id HAVING count(*) >= 2""",
    )
)
def entity_bridge(spark: SparkSession, d: str) -> DataFrame:
    return G.bridges(_hits(spark, d), M.about(spark, d))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return M.table(spark, d, "orders").select(F.col("o_orderkey").alias("memory_id"), (F.col("o_custkey") % 5).alias("angle"), (F.col("o_orderkey") * 7919 % 1000 / 1000.0).alias("score"))


@query()
def entity_bridge_rows(spark: SparkSession, d: str) -> DataFrame:
    hits, about = _hits(spark, d), M.about(spark, d)
    best = R.top_k(hits, ["angle"], [F.col("score").desc(), F.col("memory_id")], 200)
    return G.bridge_rows(G.bridges(best, about), about, best.select("memory_id"))


@query(
    with_views(
        "v_revisions",
        body="""h AS (SELECT doc_id AS memory_id, base_score AS score, row_number() OVER (ORDER BY base_score DESC, doc_id) AS fact_rank FROM v_revisions WHERE space IN ('src1', 'src2', 'src3')),
s AS (SELECT doc_id FROM v_revisions WHERE doc_id % 5 = 0)
SELECT row_number() OVER (ORDER BY fact_rank) AS position, memory_id, round((SELECT min(base_score) FROM v_revisions WHERE doc_id % 5 = 0 AND base_score > 0.3E0) * 0.9E0, 6) AS score FROM h
WHERE fact_rank <= 3 AND memory_id NOT IN (SELECT doc_id FROM s) ORDER BY fact_rank LIMIT 2""",
    )
)
def fact_leg_floor(spark: SparkSession, d: str) -> DataFrame:
    """A leg of recall: its limit is the feature."""
    r = M.revisions(spark, d).select(F.col("doc_id").alias("memory_id"), "space", F.col("base_score").alias("score"))
    seen = r.where("memory_id % 5 = 0")
    out = G.fact_leg(r, seen.where("score > 0.3"), seen, ["src1", "src2", "src3"])
    return out.select(F.col("position").cast("long").alias("position"), "memory_id", "score")


@query(with_views("v_about", body="SELECT entity_id, count(*) AS degree, count(*) > 12 AS hub FROM v_about GROUP BY entity_id"))
def hub_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.degree(M.about(spark, d), "entity_id").withColumn("hub", F.col("degree") > 12)


@query(
    f"""WITH RECURSIVE v AS ({VIEWS["v_supersedes"]}), c AS (SELECT newer_id, older_id AS at, 1 AS depth FROM v UNION ALL SELECT c.newer_id, v.older_id, depth + 1 FROM c JOIN v ON v.newer_id = c.at WHERE depth < 10)
SELECT newer_id, max(depth)::BIGINT AS depth FROM c GROUP BY newer_id"""
)
def supersedes_depth(spark: SparkSession, d: str) -> DataFrame:
    return G.chain_depth(M.supersedes(spark, d))


@query(
    with_views(
        "v_supersedes",
        body="""s AS (SELECT newer_id AS newer, older_id AS older FROM v_supersedes), f AS (SELECT older AS fact, min(newer) AS superseded_by FROM s GROUP BY older),
dep AS (SELECT DISTINCT l_partkey AS dependent, l_orderkey AS fact FROM lineitem)
SELECT fact, dependent, superseded_by FROM (SELECT f.fact, dependent, superseded_by, row_number() OVER (PARTITION BY f.fact ORDER BY dependent) AS k FROM dep JOIN f ON f.fact = dep.fact) WHERE k <= 20""",
    )
)
def grounding_ripple(spark: SparkSession, d: str) -> DataFrame:
    s = M.supersedes(spark, d).select(F.col("newer_id").alias("newer"), F.col("older_id").alias("older"))
    dep = M.table(spark, d, "lineitem").select(F.col("l_partkey").alias("dependent"), F.col("l_orderkey").alias("fact"))
    return G.ripple(s, dep)


@query(
    with_views(
        "v_supersedes",
        body="""dep AS (SELECT DISTINCT l_partkey AS dependent, l_orderkey AS fact FROM lineitem),
st AS (SELECT DISTINCT dependent, newer_id AS superseded_by FROM dep JOIN v_supersedes ON older_id = fact), live AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F')
SELECT superseded_by, dependent, CASE WHEN superseded_by NOT IN (SELECT id FROM live) THEN 'superseder_gone' ELSE 'reconfirmed' END AS reason FROM st
WHERE superseded_by NOT IN (SELECT id FROM live) OR EXISTS (SELECT 1 FROM dep WHERE dep.dependent = st.dependent AND dep.fact = st.superseded_by)""",
    )
)
def grounding_clear(spark: SparkSession, d: str) -> DataFrame:
    dep = M.table(spark, d, "lineitem").select(F.col("l_partkey").alias("dependent"), F.col("l_orderkey").alias("fact")).distinct()
    stale = dep.join(M.supersedes(spark, d), F.col("older_id") == F.col("fact")).select("dependent", F.col("newer_id").alias("superseded_by")).distinct()
    live = M.table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"))
    return G.cleared(stale, live, dep).select("superseded_by", "dependent", "reason")


@query(
    """WITH n AS (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
SELECT c_custkey, nth FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS nth FROM n) WHERE nth <= greatest(1, floor((SELECT count(*) FROM customer) * 0.5E0))"""
)
def orphan_entities(spark: SparkSession, d: str) -> DataFrame:
    """A budgeted pass: its limit is the feature."""
    nodes = M.table(spark, d, "customer").select("c_custkey")
    return orphans(nodes, M.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(
    """SELECT l_orderkey, l_partkey, bool_or(coalesce(42 BETWEEN s - 20 AND e + 20, false)) AS line_hit FROM (
  SELECT l_orderkey, l_partkey, l_linenumber * 12 AS s, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber * 12 + 6 END AS e FROM lineitem) GROUP BY l_orderkey, l_partkey"""
)
def anchor_line_match(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of an anchor (orders of a part) whose lines come within the slack of line 42; a missing range is no hit."""
    li = M.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_linenumber") * 12).alias("s"), F.when(F.col("l_linenumber") != 7, F.col("l_linenumber") * 12 + 6).alias("e"))
    hit = F.coalesce(F.lit(42).between(F.col("s") - 20, F.col("e") + 20), F.lit(False))
    return li.groupBy("l_orderkey", "l_partkey").agg(F.bool_or(hit).alias("line_hit"))


@query(
    """WITH p AS (SELECT a.o_orderkey AS id, b.o_orderkey AS other_id, abs(epoch(a.o_orderdate) - epoch(b.o_orderdate))::BIGINT AS gap FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey
  WHERE abs(epoch(a.o_orderdate) - epoch(b.o_orderdate)) <= 14 * 86400)
SELECT id, other_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, other_id) AS k FROM p) WHERE k = 1"""
)
def correlate_window(spark: SparkSession, d: str) -> DataFrame:
    o = M.table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    return S.correlated(o, o.select("o_custkey", F.col("id").alias("other_id"), "ts"), ["o_custkey"])


@query(
    with_views(
        "v_supersedes",
        body="""b AS (SELECT newer_id, older_id FROM v_supersedes)
SELECT o_orderkey, count(DISTINCT l_partkey) AS evidence, coalesce(array_to_string(list_sort(list_distinct(list(b.older_id) FILTER (b.older_id IS NOT NULL))), ','), '') AS supersedes, coalesce(array_to_string(list_sort(list_distinct(list(c.newer_id) FILTER (c.newer_id IS NOT NULL))), ','), '') AS superseded_by
FROM orders LEFT JOIN b ON b.newer_id = o_orderkey LEFT JOIN b c ON c.older_id = o_orderkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    )
)
def why_chain(spark: SparkSession, d: str) -> DataFrame:
    """Each decision with its evidence and what it supersedes and is superseded by: aggregated by key before they meet."""
    s = M.supersedes(spark, d)
    told = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = s.groupBy(F.col("newer_id").alias("o_orderkey")).agg(told("older_id").alias("supersedes"))
    by = s.groupBy(F.col("older_id").alias("o_orderkey")).agg(told("newer_id").alias("superseded_by"))
    ev = M.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_partkey").alias("evidence"))
    rows = M.table(spark, d, "orders").select("o_orderkey").join(ev, "o_orderkey", "left").join(out, "o_orderkey", "left").join(by, "o_orderkey", "left")
    return rows.select("o_orderkey", F.coalesce("evidence", F.lit(0)).alias("evidence"), F.coalesce("supersedes", F.lit("")).alias("supersedes"), F.coalesce("superseded_by", F.lit("")).alias("superseded_by"))


@query(
    """WITH t AS (SELECT p_partkey, lower(p_brand) || '/' || p_partkey AS file FROM part), s AS (SELECT DISTINCT p_partkey % 500 || '' AS path FROM part),
e AS (SELECT file, unnest([file, split_part(file, '/', 2)]) AS suffix FROM t), g AS (SELECT suffix, count(*) AS n, min(file) AS one FROM e GROUP BY suffix)
SELECT path, CASE WHEN n = 1 THEN one ELSE '' END AS resolved FROM s LEFT JOIN g ON g.suffix = path"""
)
def tracked_paths(spark: SparkSession, d: str) -> DataFrame:
    p = M.table(spark, d, "part")
    tracked = p.select(F.concat(F.lower("p_brand"), F.lit("/"), F.col("p_partkey").cast("string")).alias("file"))
    return G.tracked_path(p.select((F.col("p_partkey") % 500).cast("string").alias("path")).distinct(), tracked)


