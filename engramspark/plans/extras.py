"""Queries of search, decomposition and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context as C
from ..operators import ontology as O
from ..operators import search as S
from ..operators.ranking import top_k
from ..schemas import STOPWORDS
from ..sources import memory as M
from ..sources.memory import with_views
from .registry import query

_ASKED = [(1, "thanes reon onnt"), (2, "der chen schen"), (3, "que les eau"), (4, "osar cion boado")]


_STOP = ", ".join(f"'{x}'" for x in STOPWORDS)
_KEYS = f"list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({_STOP}))"


@query(
    f"""WITH w AS (SELECT doc_id AS id, source AS space, {_KEYS.format("text")} AS w FROM documents), g AS (SELECT space, count(*) AS n, avg(len(w)) AS mean FROM w GROUP BY space),
q AS (SELECT query_id, unnest(list_distinct({_KEYS.format("query")})) AS token FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in _ASKED)}) v(query_id, query)),
h AS (SELECT space, id, length, token, count(*) AS tf FROM (SELECT space, id, len(w) AS length, unnest(w) AS token FROM w) WHERE token IN (SELECT token FROM q) GROUP BY ALL), f AS (SELECT space, token, count(*) AS df FROM h GROUP BY ALL),
s AS (SELECT query_id, h.space, id, sum(ln(1 + (n - df + 0.5E0) / (df + 0.5E0)) * tf * 2.2E0 / (tf + 1.2E0 * (0.25E0 + 0.75E0 * length / mean))) AS score FROM h JOIN f ON f.space = h.space AND f.token = h.token JOIN g ON g.space = h.space JOIN q ON q.token = h.token GROUP BY ALL)
SELECT query_id, space, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s) WHERE k <= 10"""
)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the limit is the feature."""
    queries = spark.createDataFrame(_ASKED, "query_id int, query string")
    scored = S.bm25(M.table(spark, d, "documents"), queries, "doc_id", "text", ["source"])
    return top_k(scored, ["query_id"], [F.col("score").desc(), F.col("id")], 10).select("query_id", F.col("source").alias("space"), "id", F.round("score", 6).alias("score"))


_SLUG = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '-')"


def _cut(slug: str) -> str:
    """A slug of more than 80 characters, cut, with a hash of the whole."""
    return f"CASE WHEN length({slug}) > 80 THEN substr({slug}, 1, 80) || '-' || substr(sha256({slug}), 1, 8) ELSE {slug} END"


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as an extraction: capitalised words are entities, what the assistant says are facts, what the user says questions."""
    m = M.messages(spark, d)
    by = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("idx", F.col("content").alias("t"))))), lambda x: x.t)
    words = F.regexp_extract_all(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "content"))), lambda x: x.content), " "), F.lit(_NAME), F.lit(0))
    return m.groupBy("session_id").agg(words.alias("entity"), by("assistant").alias("fact"), by("user").alias("question"))


_NAME = "[A-Z][a-z]+"
_SAID = "SELECT session_id AS conv, '{1}' AS kind, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS pos, content AS text FROM v_messages WHERE role = '{0}'"
_NODES = rf"""e AS (SELECT session_id AS conv, regexp_extract_all(string_agg(content, ' ' ORDER BY idx), '{_NAME}') AS w FROM v_messages GROUP BY session_id),
f AS (SELECT conv, 'entity' AS kind, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS text FROM e UNION ALL {_SAID.format("assistant", "fact")} UNION ALL {_SAID.format("user", "question")}),
s0 AS (SELECT *, {_SLUG.format("text")} AS long FROM f), s AS (SELECT conv, kind, pos, text, {_cut("long")} AS slug FROM s0 WHERE long <> ''), g AS (SELECT conv, kind, slug, min(pos) AS pos, min_by(text, pos) AS text FROM s GROUP BY conv, kind, slug),
nodes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv, kind ORDER BY pos) AS nth FROM g) WHERE nth <= 20)"""


@query(with_views("v_messages", body=f"{_NODES} SELECT conv, kind, slug, pos FROM nodes WHERE kind <> 'entity'"))
def decompose_nodes(spark: SparkSession, d: str) -> DataFrame:
    return O.typed_nodes(_summaries(spark, d), "session_id", ["fact", "question"]).select("conv", "kind", "slug", "pos")


@query(with_views("v_messages", body=f"{_NODES} SELECT conv, slug, text AS title, 'ABOUT' AS edge_type FROM nodes WHERE kind = 'entity' AND nth <= 8"))
def promote_entities(spark: SparkSession, d: str) -> DataFrame:
    return O.promoted(_summaries(spark, d), "session_id")


_SPACED = r"' ' || array_to_string(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}]+'), ' ') || ' '"


@query(with_views("v_messages", body=f"{_NODES} SELECT DISTINCT a.conv, a.kind, a.slug, b.slug AS entity FROM nodes a JOIN nodes b ON a.conv = b.conv AND a.kind <> 'entity' AND b.kind = 'entity' AND contains({_SPACED.format('a.text')}, {_SPACED.format('b.text')})"))
def decompose_about_edges(spark: SparkSession, d: str) -> DataFrame:
    return O.mention_edges(O.typed_nodes(_summaries(spark, d), "session_id"), ["fact", "question"])


@query(
    f"""WITH e AS (SELECT DISTINCT {_SLUG.format("p_brand")} AS slug, p_type FROM part), l AS (SELECT {_SLUG.format("p_type")} AS slug, min(slug) AS hub FROM e GROUP BY 1), u AS (SELECT p_type AS surface FROM part UNION SELECT p_brand FROM part UNION SELECT 'New Thing'),
x AS (SELECT surface, {_SLUG.format("surface")} AS slug FROM u) SELECT surface, x.slug, CASE WHEN x.slug IN (SELECT slug FROM e) THEN x.slug ELSE coalesce(hub, x.slug) END AS hub FROM x LEFT JOIN l ON l.slug = x.slug"""
)
def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import slug

    p = M.table(spark, d, "part")
    entities = p.groupBy(slug(F.col("p_brand")).alias("slug")).agg(F.collect_set("p_type").alias("aliases"))
    surfaces = p.select(F.col("p_type").alias("surface")).union(p.select("p_brand")).union(spark.createDataFrame([("New Thing",)], "surface string")).distinct()
    return O.resolved_aliases(surfaces, entities)


@query("WITH e AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey AS id, (o_orderkey % 5 = 0) OR coalesce(n, 0) >= o_orderkey % 5 AS complete FROM orders LEFT JOIN e ON id = o_orderkey")
def marker_provenance(spark: SparkSession, d: str) -> DataFrame:
    markers = M.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).alias("expected"))
    return O.provenance_complete(markers, M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("target")))


@query(
    with_views(
        "v_revisions",
        body="""b AS (SELECT space, doc_id, '# ' || doc_id || chr(10) || title AS block FROM v_revisions), r AS (SELECT *, row_number() OVER w AS n, sum(length(block) + 2) OVER (PARTITION BY space ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - 2 AS t FROM b WINDOW w AS (PARTITION BY space ORDER BY doc_id))
SELECT space, string_agg(block, chr(10) || chr(10) ORDER BY doc_id) AS context FROM r WHERE n = 1 OR t <= 4000 GROUP BY space""",
    )
)
def why_context(spark: SparkSession, d: str) -> DataFrame:
    rows = M.revisions(spark, d).select("space", "doc_id", F.concat(F.lit("# "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("title")).alias("block"))
    return C.joined_blocks(C.blocks_within(rows, "space", "doc_id", "block", 4000), "space", "doc_id", "block")


@query(
    with_views(
        "v_revisions",
        body="""i AS (SELECT item_id, space, max(base_score) AS score, min(doc_id) AS id, count(*) AS n FROM v_revisions GROUP BY item_id, space),
f AS (SELECT i.space, r.doc_id AS id, r.base_score AS score FROM i JOIN v_revisions r ON r.item_id = i.item_id AND r.space = i.space WHERE i.n > 0)
SELECT space, id, score FROM (SELECT *, row_number() OVER (PARTITION BY space ORDER BY score DESC, id) AS k FROM f) WHERE k <= 8""",
    )
)
def collect_top_revisions(spark: SparkSession, d: str) -> DataFrame:
    r = M.revisions(spark, d).select("item_id", "space", F.col("doc_id").alias("id"), F.col("base_score").alias("score"))
    items = r.groupBy("item_id", "space").agg(F.collect_list(F.struct("id", "score")).alias("siblings"), F.max("score").alias("score"), F.min("id").alias("id"))
    return C.flattened_revisions(items, "space", "siblings", 8).select("space", "id", "score")


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT e.vec_id, e.label, list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))) AS score FROM e, (SELECT v FROM e WHERE vec_id = 0) q)
SELECT label, vec_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM s WHERE score >= 0.1E0) WHERE k <= 3"""
)
def siblings_by_embedding(spark: SparkSession, d: str) -> DataFrame:
    v = M.vectors(spark, d)
    rows = v.withColumn("asked", v.where("vec_id = 0").select("embedding").scalar())
    return C.siblings_by_vector(rows, "label", "vec_id", F.col("asked"), "embedding", 0.1, 3).select("label", "vec_id", F.round("score", 4).alias("score"))
