"""Queries of recall, ranking, siblings, merges and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import evidence as E
from ..functions import text as T
from ..operators import ranking as R
from ..sources import memory as M
from ..sources.memory import with_views
from .registry import DELTA, RECENCY, query



@query(
    with_views(
        "v_revisions",
        body=f"""s AS (SELECT space, doc_id, base_score + {DELTA} + {RECENCY} AS score FROM v_revisions)
SELECT space, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY space ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""",
    )
)
def recall_weighted_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = R.with_priors(M.revisions(spark, d).select("space", "doc_id", "base_score", "evidence_level", "age_days"))
    return R.top_k(scored, ["space"], [F.col("score").desc(), F.col("doc_id")], 5).select("space", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    with_views(
        "v_revisions",
        body="""SELECT doc_id, evidence_level AS level, CASE evidence_level WHEN 'official' THEN 3 WHEN 'corroborated' THEN 3 WHEN 'single_source' THEN 2 WHEN 'unverified' THEN 1 END AS band,
      CASE WHEN evidence_level IS NULL OR evidence_level = 'single_source' THEN '' ELSE '[' || evidence_level || '] ' END AS badge FROM v_revisions""",
    )
)
def evidence_badges(spark: SparkSession, d: str) -> DataFrame:
    level = F.col("evidence_level")
    return M.revisions(spark, d).select("doc_id", level.alias("level"), E.band("evidence_level", level).alias("band"), E.badge(level).alias("badge"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'official' WHEN doc_id % 3 = 1 AND doc_id % 4 = 0 THEN 'corroborated' WHEN doc_id % 3 = 2 AND doc_id % 4 = 0 THEN 'corroborated' ELSE 'unverified' END AS level,
  CASE WHEN doc_id % 3 = 0 THEN 3 WHEN doc_id % 4 = 0 THEN 2 END AS strictest FROM documents"""
)
def evidence_resolve(spark: SparkSession, d: str) -> DataFrame:
    docs = M.table(spark, d, "documents").select("doc_id")
    meta = F.when(F.col("doc_id") % 3 == 0, "official").when(F.col("doc_id") % 3 == 1, "nonsense")
    tags = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("published"), F.lit("evidence:bogus"), F.lit("evidence:corroborated"))).otherwise(F.array(F.lit("published")))
    return docs.select("doc_id", E.level_of(meta, tags, "unverified").alias("level"), E.strictest(meta, tags).alias("strictest"))


@query(
    with_views(
        "v_revisions",
        body=f"""r AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN evidence_level END AS lv, item_id % 10 AS grp FROM v_revisions)
SELECT grp, doc_id, round(CASE WHEN bool_or(lv IS NOT NULL) OVER (PARTITION BY space, grp) THEN base_score + {DELTA.replace("evidence_level", "lv")} ELSE base_score END, 6) AS score FROM r""",
    )
)
def evidence_noop_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = M.revisions(spark, d).select("space", (F.col("item_id") % 10).alias("grp"), "doc_id", "base_score", F.when(F.col("doc_id") % 7 == 0, F.col("evidence_level")).alias("lv"))
    return R.evidence_weighted(rows, ["space", "grp"], "lv").select("grp", "doc_id", F.round("score", 6).alias("score"))


@query(
    with_views(
        "v_revisions",
        body=f"""SELECT doc_id, round(base_score + {DELTA} + least({RECENCY} + CASE WHEN doc_id % 3 <> 0 THEN 0.12E0 * exp(-ln(2E0) * abs(doc_id % 90 - 45) / 45E0) ELSE 0E0 END, 0.12E0), 6) AS score FROM v_revisions""",
    )
)
def recall_rerank_priors(spark: SparkSession, d: str) -> DataFrame:
    rows = M.revisions(spark, d).withColumn("gap", F.col("doc_id") % 90 - 45)
    return R.with_priors(rows, gap="gap", trusted=F.col("doc_id") % 3 != 0).select("doc_id", F.round("score", 6).alias("score"))


@query(
    with_views(
        "v_revisions",
        body="""b AS (SELECT space, doc_id, base_score, doc_id % 97 / 97.0E0 AS ce, min(base_score) OVER w AS bl, max(base_score) OVER w AS bh, min(doc_id % 97 / 97.0E0) OVER w AS cl, max(doc_id % 97 / 97.0E0) OVER w AS ch
  FROM v_revisions WINDOW w AS (PARTITION BY space))
SELECT space, doc_id, round(0.4E0 * CASE WHEN bh > bl THEN (base_score - bl) / (bh - bl) ELSE 0E0 END + 0.6E0 * CASE WHEN ch > cl THEN (ce - cl) / (ch - cl) ELSE 0E0 END, 6) AS fused FROM b""",
    )
)
def cross_encoder_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = M.revisions(spark, d).select("space", "doc_id", "base_score", (F.col("doc_id") % 97 / 97.0).alias("ce"))
    return R.fused(rows, ["space"], "base_score", "ce").select("space", "doc_id", F.round("fused", 6).alias("fused"))


@query(
    """SELECT o_orderkey, excluded, row_number() OVER (PARTITION BY o_custkey ORDER BY excluded, o_totalprice DESC, o_orderkey) AS position FROM (
  SELECT *, coalesce(DATE '1996-06-15' < lo, false) OR coalesce(DATE '1996-06-15' > hi, false) AS excluded FROM (
    SELECT o_orderkey, o_custkey, o_totalprice,
      CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN date_trunc('year', o_orderdate)::DATE WHEN o_orderkey % 4 = 2 THEN date_trunc('month', o_orderdate)::DATE ELSE o_orderdate::DATE END AS lo,
      CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN (date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE ELSE last_day(o_orderdate::DATE) END AS hi
    FROM orders))"""
)
def asof_partition(spark: SparkSession, d: str) -> DataFrame:
    day, key = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey")
    start = F.when(key % 4 == 1, F.substring(day, 1, 4)).when(key % 4 == 2, F.substring(day, 1, 7)).when(key % 4 == 3, day)
    end = F.when(key % 3 == 1, F.substring(day, 1, 4)).when(key % 3 == 2, F.substring(day, 1, 7))
    out = D.excluded(start, end, F.to_date(F.lit("1996-06-15")))
    rows = M.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", out.alias("out"))
    return R.as_of_order(rows, F.col("out"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", F.col("as_of_excluded").alias("excluded"), F.col("position").cast("long").alias("position"))


@query(
    """SELECT o_orderkey, strftime(CASE o_orderkey % 4 WHEN 0 THEN date_trunc('year', o_orderdate)::DATE WHEN 1 THEN date_trunc('month', o_orderdate)::DATE WHEN 2 THEN o_orderdate::DATE END, '%Y-%m-%d') AS lower,
  strftime(CASE o_orderkey % 4 WHEN 0 THEN (date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE WHEN 1 THEN last_day(o_orderdate::DATE) WHEN 2 THEN o_orderdate::DATE END, '%Y-%m-%d') AS upper FROM orders"""
)
def valid_interval_bounds(spark: SparkSession, d: str) -> DataFrame:
    day, key = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey")
    text = F.when(key % 4 == 0, F.substring(day, 1, 4)).when(key % 4 == 1, F.substring(day, 1, 7)).when(key % 4 == 2, day).otherwise(F.lit("sometime"))
    show = lambda c: F.date_format(c, "yyyy-MM-dd")
    return M.table(spark, d, "orders").select("o_orderkey", show(D.lower_bound(text)).alias("lower"), show(D.upper_bound(text)).alias("upper"))


@query(with_views("v_revisions", body="SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN base_score END AS score FROM v_revisions WHERE doc_id % 11 = 0 OR base_score >= 0.6E0"))
def min_score_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = M.revisions(spark, d).select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.col("base_score")).alias("score"))
    return R.at_least(rows, "score", 0.6)


@query(
    """WITH q AS (SELECT unnest(['entry', 'station', 'answer', 'la', 'de']) AS t), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)
SELECT doc_id, round((SELECT sum(ln(1 + len(list_filter(w, lambda x: x = q.t)))) FROM q) / 6, 6) AS score FROM d"""
)
def keyword_overlap_score(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*(F.lit(x) for x in ("entry", "station", "answer", "la", "de")))
    docs = M.table(spark, d, "documents").select("doc_id", T.key_tokens(F.col("text")).alias("w"))
    return docs.select("doc_id", F.round(T.overlap_score(words, F.col("w")), 6).alias("score"))


@query(
    with_views(
        "v_revisions",
        body="""a AS (SELECT 0 AS angle, space, doc_id, base_score AS score FROM v_revisions WHERE doc_id % 2 = 0 UNION ALL SELECT 1, space, doc_id, (doc_id * 31 % 1000) / 1000.0E0 FROM v_revisions WHERE doc_id % 3 = 0
  UNION ALL SELECT 2, space, doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 0.5E0 END FROM v_revisions),
m AS (SELECT *, row_number() OVER (PARTITION BY space, doc_id ORDER BY coalesce(score, 0E0) DESC, angle) AS k FROM a)
SELECT space, doc_id, angle, score FROM (SELECT *, row_number() OVER (PARTITION BY space ORDER BY coalesce(score, 0E0) DESC, doc_id) AS rank FROM m WHERE k = 1) WHERE rank <= 10""",
    )
)
def multi_angle_merge(spark: SparkSession, d: str) -> DataFrame:
    r = M.revisions(spark, d).select("space", "doc_id", "base_score")
    one = r.where("doc_id % 2 = 0").select(F.lit(0).alias("angle"), "space", "doc_id", F.col("base_score").alias("score"))
    two = r.where("doc_id % 3 = 0").select(F.lit(1).alias("angle"), "space", "doc_id", (F.col("doc_id") * 31 % 1000 / 1000.0).alias("score"))
    three = r.select(F.lit(2).alias("angle"), "space", "doc_id", F.when(F.col("doc_id") % 5 != 0, F.lit(0.5)).alias("score"))
    best = R.merged(one.unionByName(two).unionByName(three), ["space"], "doc_id", "score", "angle")
    return R.top_k(best, ["space"], [F.coalesce("score", F.lit(0.0)).desc(), F.col("doc_id")], 10).select("space", "doc_id", "angle", "score")


@query(
    with_views(
        "v_revisions",
        body="""k AS (SELECT space, doc_id, base_score AS score, CASE doc_id % 6 WHEN 0 THEN 'base' WHEN 1 THEN 'fact' WHEN 2 THEN 'sibling' ELSE 'edge' END AS kind FROM v_revisions),
n AS (SELECT *, count(*) OVER (PARTITION BY space) AS n, count(*) FILTER (kind = 'base') OVER (PARTITION BY space) AS b, row_number() OVER (PARTITION BY space, kind ORDER BY score DESC NULLS LAST, doc_id) AS r FROM k)
SELECT space, doc_id, kind FROM n WHERE n <= 15 OR kind = 'base' OR r <= CASE kind WHEN 'edge' THEN greatest(15 - b, 0) WHEN 'fact' THEN 2 ELSE 3 END""",
    )
)
def final_cap(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("doc_id") % 6
    rows = M.revisions(spark, d).select("space", "doc_id", F.col("base_score").alias("score"), F.when(m == 0, "base").when(m == 1, "fact").when(m == 2, "sibling").otherwise("edge").alias("kind"))
    return R.capped(rows, "space", "kind", "score", "doc_id", 15).select("space", "doc_id", "kind")


@query(
    with_views(
        "v_revisions",
        body="""k AS (SELECT space, doc_id, base_score, CASE WHEN doc_id % 9 = 0 THEN 2 WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS part, '- [' || coalesce(evidence_level, 'none') || '] #' || doc_id AS line FROM v_revisions),
n AS (SELECT *, row_number() OVER (PARTITION BY space, part ORDER BY base_score DESC, doc_id) AS r FROM k)
SELECT space, string_agg(line, chr(10) ORDER BY part, r) AS context FROM n WHERE r <= CASE part WHEN 0 THEN 20 ELSE 2 END GROUP BY space""",
    )
)
def context_topk(spark: SparkSession, d: str) -> DataFrame:
    part = F.when(F.col("doc_id") % 9 == 0, 2).when(F.col("doc_id") % 10 == 0, 1).otherwise(0)
    line = F.concat(F.lit("- ["), F.coalesce("evidence_level", F.lit("none")), F.lit("] #"), F.col("doc_id").cast("string"))
    rows = M.revisions(spark, d).select("space", "doc_id", "base_score", part.alias("part"), line.alias("line"))
    nth = F.row_number().over(Window.partitionBy("space", "part").orderBy(F.col("base_score").desc(), "doc_id"))
    kept = rows.withColumn("r", nth).where(F.col("r") <= F.when(F.col("part") == 0, 20).otherwise(2))
    return kept.groupBy("space").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "r", "line"))), lambda x: x.line), "\n").alias("context"))


@query(
    with_views(
        "v_revisions",
        body="""s AS (SELECT item_id, doc_id, base_score AS score, age_days, length(text) AS n, bool_or(base_score >= 0.4E0) OVER (PARTITION BY item_id) AS strong,
  sum(length(text)) OVER (PARTITION BY item_id ORDER BY age_days DESC, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM v_revisions),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN strong THEN -score ELSE -age_days END, doc_id) AS rank FROM s WHERE CASE WHEN strong THEN score >= 0.4E0 ELSE run <= 20000 END)
SELECT item_id, doc_id, rank FROM k WHERE rank <= 5""",
    )
)
def sibling_strong_or_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = M.revisions(spark, d).select("item_id", "doc_id", F.col("base_score").alias("score"), "age_days", "text")
    return R.strong_or_budget(rows, "item_id", "doc_id", "score", "age_days", "text").select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(with_views("v_revisions", body="SELECT item_id, max_by(doc_id, number) AS doc_id, max(number) AS number FROM v_revisions WHERE NOT deprecated GROUP BY item_id"))
def latest_revision(spark: SparkSession, d: str) -> DataFrame:
    rows = M.revisions(spark, d).where(~F.col("deprecated")).select("item_id", "doc_id", "number")
    return R.latest(rows, "item_id", "number").select("item_id", "doc_id", "number")


@query()
def mmr_diversify(spark: SparkSession, d: str) -> DataFrame:
    rows = M.revisions(spark, d).select("space", "doc_id", "base_score", "title")
    best = R.top_k(rows, ["space"], [F.col("base_score").desc(), F.col("doc_id")], 30)
    return R.diversified(best, "space", "doc_id", "base_score", "title", 10)


@query(
    with_views(
        "v_revisions",
        body="""SELECT doc_id, coalesce(bool_or(line_hit), false) AS line_hit, coalesce(bool_or(anchor_hit), false) AS anchor_hit, max(score) AS score FROM (
  SELECT doc_id, doc_id % 10 = 0 AS line_hit, true AS anchor_hit, CAST(NULL AS DOUBLE) AS score FROM v_revisions WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, NULL, NULL, base_score FROM v_revisions WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, NULL, NULL, 0.25E0 FROM v_revisions WHERE doc_id % 4 = 0) GROUP BY doc_id""",
    )
)
def why_merge_legs(spark: SparkSession, d: str) -> DataFrame:
    r = M.revisions(spark, d).select("doc_id", "base_score")
    anchor = r.where("doc_id % 5 = 0").select("doc_id", (F.col("doc_id") % 10 == 0).alias("line_hit"), F.lit(True).alias("anchor_hit"))
    semantic = r.where("doc_id % 3 = 0").select("doc_id", F.col("base_score").alias("score"))
    bridge = r.where("doc_id % 4 = 0").select("doc_id", F.lit(0.25).alias("score"))
    return R.merged_candidates([anchor, semantic, bridge], "doc_id", ["line_hit", "anchor_hit"], ["score"])


@query(
    """WITH c AS (SELECT l_orderkey, count(*) AS n, bool_or(l_linenumber BETWEEN 2 AND 4) AS line_hit, bool_or(l_returnflag = 'R') AS anchor_hit, bool_or(l_linestatus = 'O') AS active, round(avg(l_discount), 6) AS probability,
  bool_or(l_returnflag = 'R') AND bool_or(l_linestatus = 'O') AS both_legs, max(l_shipdate) AS decided FROM lineitem GROUP BY l_orderkey),
g AS (SELECT *, l_orderkey % 100 AS question FROM c)
SELECT question, l_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY line_hit DESC, anchor_hit DESC, active DESC, probability DESC, both_legs DESC, decided DESC, l_orderkey) AS rank FROM g) WHERE rank <= 5"""
)
def why_rank(spark: SparkSession, d: str) -> DataFrame:
    li = M.table(spark, d, "lineitem")
    c = li.groupBy("l_orderkey").agg(
        F.bool_or(F.col("l_linenumber").between(2, 4)).alias("line_hit"),
        F.bool_or(F.col("l_returnflag") == "R").alias("anchor_hit"),
        F.bool_or(F.col("l_linestatus") == "O").alias("active"),
        F.round(F.avg("l_discount"), 6).alias("probability"),
        F.max("l_shipdate").alias("decided"),
    )
    c = c.withColumns({"both_legs": F.col("anchor_hit") & F.col("active"), "commit_match": F.lit(False), "question": F.col("l_orderkey") % 100})
    return R.top_k(c, ["question"], [*R.candidate_order(), F.col("l_orderkey")], 5).select("question", "l_orderkey", F.col("rank").cast("long").alias("rank"))
