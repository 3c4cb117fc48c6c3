"""Runs that change the graph: consolidation, captures of commits and sessions, the maintenance passes, assessments and what they may do."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.privacy import first_credential, screened
from ..functions.text import content_key, one_line, slug, title_of
from ..schemas import DEFAULT, Config
from ..sources.store import written
from . import rendering, sessions
from .maintenance import insert_new
from .ranking import top_k

#: Keys of metadata and prefix of tags that only assessors and operators may write.
TRUST_KEYS, TRUST_PREFIX = ("evidence_level",), "evidence:"


# --- passes


class Pass(NamedTuple):
    """A step of a run: from the tables to those that it replaces. ``needs`` names tables without which it is left out."""

    name: str
    run: Callable[[Mapping[str, DataFrame]], Mapping[str, DataFrame]]
    needs: tuple[str, ...] = ()


def run_passes(spark: SparkSession, tables: Mapping[str, DataFrame], passes: Sequence[Pass]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after all passes, and a report: pass, status (``done``, ``failed``, ``left out``), table, rows before and after, error.

    A pass sees what those before it left. What it replaces is written before the next begins, so a failure is its own: the
    tables stay as they were, the report says why, and the run goes on.
    """
    now, report = dict(tables), []
    for p in passes:
        if any(n not in now for n in p.needs):
            report.append((p.name, "left out", None, None, None, None))
            continue
        try:
            new = {k: written(v, k) for k, v in p.run(now).items()}
            counts = [(k, now[k].count() if k in now else 0, v.count()) for k, v in new.items()]
        except Exception as e:  # a pass that fails is told, not raised: the others don't depend on it
            report.append((p.name, "failed", None, None, None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
            continue
        now |= new
        report += [(p.name, "done", k, a, b, None) for k, a, b in counts]
    return now, spark.createDataFrame(report, "pass string, status string, table string, before long, after long, error string")


# --- assessments

ASSESSMENT = "array<struct<index int, relevance_score double, should_deprecate boolean, deprecation_reason string, suggested_tags array<string>, metadata_updates string, relationship_type string, related_indices array<int>>>"


def parsed_assessments(replies: DataFrame, rows: DataFrame) -> DataFrame:
    """A model's assessments (batch, reply: JSON text) by revision (rows: batch, index, kref): kref, nth, relevance, should_deprecate, reason, tags, metadata (a map, from an object or a list of keys and values) and related, an array of (target, edge_type). Entries without a known index go."""
    each = replies.select("batch", F.posexplode(F.from_json("reply", ASSESSMENT)).alias("nth", "x")).where("x.index is not null")
    found = each.join(rows.select("batch", F.col("index").alias("i"), "kref"), (each["batch"] == rows["batch"]) & (F.col("x.index") == F.col("i"))).select(each["batch"], "nth", "x", "kref")
    names = rows.groupBy("batch").agg(F.map_from_entries(F.collect_list(F.struct("index", "kref"))).alias("names"))
    pairs = F.from_json("x.metadata_updates", "array<struct<key string, value string>>")
    listed = F.map_from_entries(F.filter(pairs, lambda p: (F.coalesce(p.key, F.lit("")) != "") & p.value.isNotNull()))
    named = F.map_filter(F.from_json("x.metadata_updates", "map<string,string>"), lambda k, v: (k != "") & v.isNotNull())
    metadata = F.when(F.trim("x.metadata_updates").startswith("["), listed).otherwise(named)
    kind = F.coalesce(F.when(F.col("x.relationship_type") != "", F.col("x.relationship_type")), F.lit("REFERENCED"))
    targets = F.transform(F.coalesce("x.related_indices", F.array().cast("array<int>")), lambda i: F.struct(F.element_at("names", i).alias("target"), kind.alias("edge_type")))
    related = F.filter(targets, lambda t: t.target.isNotNull() & (t.target != F.col("kref")))
    return found.join(names, "batch").select(
        "batch", "kref", "nth", F.coalesce("x.relevance_score", F.lit(0.5)).alias("relevance"), F.coalesce("x.should_deprecate", F.lit(False)).alias("should_deprecate"),
        F.coalesce("x.deprecation_reason", F.lit("")).alias("reason"), F.coalesce("x.suggested_tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce(metadata, F.create_map().cast("map<string,string>")).alias("metadata"), related.alias("related"),
    )


class Actions(NamedTuple):
    """What a run may do: krefs to deprecate, (kref, tag), (kref, key, value) and (source, target, edge_type)."""

    deprecations: DataFrame
    tags: DataFrame
    metadata: DataFrame
    edges: DataFrame


def actions(assessed: DataFrame, published: DataFrame, blocked: DataFrame | None = None, total: int | None = None, dry_run: bool = False, allow_published: bool = False, config: Config = DEFAULT) -> Actions:
    """The actions of assessments (nth, kref, should_deprecate, tags, metadata, related), in their order.

    A kref is deprecated once, unless a guard blocked it or it is published (published: kref), and no more than the budget's
    share of the assessments. Tags and keys that carry trust are stripped: a model doesn't grade. A dry run does nothing.
    """
    rows = assessed.where(F.lit(not dry_run))
    first = rows.where("should_deprecate").groupBy("kref").agg(F.min("nth").alias("nth"))
    for out in [blocked, *([] if allow_published else [published])]:
        if out is not None:
            first = first.join(out.select("kref").distinct(), "kref", "left_anti")
    budget = max(1, int((assessed.count() if total is None else total) * config.deprecation_ratio))
    from .ranking import numbered

    gone = numbered(first, [F.col("nth"), F.col("kref")], "place").where(F.col("place") <= budget).select("kref")
    tags = rows.select("kref", F.explode("tags").alias("tag")).where(~F.col("tag").startswith(TRUST_PREFIX)).distinct()
    metadata = rows.select("kref", "nth", F.explode("metadata").alias("key", "value")).where(~F.col("key").isin(*TRUST_KEYS))
    last = metadata.groupBy("kref", "key").agg(F.max_by("value", "nth").alias("value"))
    edges = rows.select(F.col("kref").alias("source"), F.explode("related").alias("r")).select("source", "r.target", "r.edge_type").distinct()
    return Actions(gone, tags, last, edges)


class Deterministic(Exception):
    """A model's failure that comes again with the same input."""


def assessed(rows: DataFrame, assess: Callable[[list[str]], Sequence[str]], ident: str, text: str, batch: str) -> DataFrame:
    """ident, status and result of each row, a batch a call.

    A batch that fails by itself (``Deterministic``) is taken apart and its rows asked for one by one: those that fail again
    are ``parked`` and the rest ``done``; if all fail, none is to blame and all are ``systemic``. Any other failure leaves the
    rows ``skipped`` for a later run. Batches are of a bounded number of rows, so one is a pandas frame.
    """
    kind = rows.schema[ident].dataType.simpleString()

    def ask(texts: list[str]) -> tuple[str, list]:
        try:
            out = list(assess(texts))
            return ("done", out) if len(out) == len(texts) else ("skipped", [None] * len(texts))
        except Deterministic:
            return "parked", [None] * len(texts)
        except Exception:  # transient or unknown: retried by a later run
            return "skipped", [None] * len(texts)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(ident)
        texts = g[text].fillna("").tolist()
        status, out = ask(texts)
        told = [status] * len(g)
        if status == "parked" and len(g) > 1:
            alone = [ask([t]) for t in texts]
            told, out = [s for s, _ in alone], [o[0] for _, o in alone]
            if all(s == "parked" for s in told):
                told = ["systemic"] * len(g)
        return pd.DataFrame({ident: g[ident].to_numpy(), "status": told, "result": out})

    return rows.select(ident, text, batch).groupBy(batch).applyInPandas(run, f"{ident} {kind}, status string, result string")


def ledger_keys(revisions: DataFrame) -> DataFrame:
    """The item that a revision's failure is kept under: its kref without the revision; empty ones go."""
    return revisions.select("kref", F.regexp_replace("kref", r"\?.*$", "").alias("key")).where("key <> ''")


# --- captures


def consolidated(messages: DataFrame, summaries: DataFrame | None = None, least: int = 1) -> DataFrame:
    """One revision of each session (session_id, idx, role, content): slug, title, summary, content, message_count, cleared_count and status.

    The summary is the model's (summaries: session_id, summary), else the fallback; what is kept is screened, the conversation
    as Markdown is the artifact. A session of fewer than ``least`` messages is ``skipped`` and keeps its buffer.
    """
    short = rendering.fallback_summary(messages).withColumnRenamed("summary", "short")
    told = short if summaries is None else short.join(summaries.select("session_id", "summary"), "session_id", "left")
    text = F.col("short") if summaries is None else F.coalesce(F.when(F.trim("summary") != "", F.col("summary")), F.col("short"))
    counts = messages.groupBy("session_id").agg(F.count("*").alias("message_count"))
    both = counts.join(told.select("session_id", screened(text).alias("summary")), "session_id").join(sessions.markdown(messages), "session_id")
    enough = F.col("message_count") >= least
    return both.select(
        "session_id", F.concat(F.lit("session-"), slug(F.col("session_id").cast("string"))).alias("slug"), title_of(F.col("summary")).alias("title"), "summary",
        screened(F.col("markdown")).alias("content"), "message_count", F.when(enough, F.col("message_count")).otherwise(0).alias("cleared_count"), F.when(enough, "stored").otherwise("skipped").alias("status"),
    )


class Capture(NamedTuple):
    """Rows to write, in this order: nodes (key, kind, text), edges (source, target, edge_type), then the markers (key, expected) that say a commit or session is whole."""

    nodes: DataFrame
    edges: DataFrame
    markers: DataFrame


def capture(found: DataFrame, unit: str, markers: DataFrame, failed: DataFrame | None = None) -> Capture:
    """What decisions found in commits or sessions (unit, title, text, anchors, evidence) write, for units that have no marker yet.

    A decision's key is that of its unit and title, so a second run writes nothing twice. Credentials keep a decision out.
    Markers promise how many decisions a unit has, and are withheld for units of which a part ``failed``: these are mined again.

    All goes by unit, once: what repeats does so within a unit, or within one decision. Keys are made where they are read.
    """
    fresh = found.join(markers.select(F.col("key").alias(unit)), unit, "left_anti")
    clean = first_credential(F.concat_ws("\n", "title", "text")).isNull()
    told = lambda c: F.when(F.col("__clean"), F.col(c)).alias(c)
    fresh = fresh.withColumns({"__clean": clean, "__title": one_line(F.col("title"))}).dropDuplicates([unit, "__title", "__clean"])
    new = written(fresh.select(unit, "__clean", told("__title"), *(told(c) for c in ("text", "anchors", "evidence"))), "decisions")
    keyed = new.where("__clean").withColumn("key", content_key(F.col(unit).cast("string"), F.col("__title")))
    # without a unit or a title, a key may be another unit's too
    bare = (F.coalesce(F.col(unit).cast("string"), F.lit("")) == "") | (F.coalesce("__title", F.lit("")) == "")
    keyed = keyed.where(~bare).unionByName(keyed.where(bare).dropDuplicates(["key"]))
    evidence = keyed.select("key", F.explode(F.array_distinct("evidence")).alias("text")).where(F.trim("text") != "").withColumn("ekey", content_key(F.col("key"), F.col("text")))
    anchors = keyed.select("key", F.explode(F.array_distinct(F.transform("anchors", sessions.normal_path))).alias("path")).where("path <> ''")
    nodes = (
        keyed.select("key", F.lit("decision").alias("kind"), "text")
        .unionByName(evidence.select(F.col("ekey").alias("key"), F.lit("evidence").alias("kind"), "text"))
        .unionByName(anchors.select("path").distinct().select(F.col("path").alias("key"), F.lit("anchor").alias("kind"), F.col("path").alias("text")))
    )
    edges = (
        anchors.select(F.col("key").alias("source"), F.col("path").alias("target"), F.lit("IMPLEMENTED_IN").alias("edge_type"))
        .unionByName(evidence.select(F.col("key").alias("source"), F.col("ekey").alias("target"), F.lit("MOTIVATED_BY").alias("edge_type")))
        .unionByName(keyed.select(F.col("key").alias("source"), F.col(unit).cast("string").alias("target"), F.lit("DERIVED_FROM").alias("edge_type")))
    )
    counted = keyed.select(unit, F.lit(1).alias("n")).unionByName(new.select(unit, F.lit(0).alias("n")))
    every = counted.groupBy(F.col(unit).alias("key")).agg(F.sum("n").alias("expected"))
    return Capture(nodes, edges, every if failed is None else every.join(failed.select(F.col(unit).alias("key")), "key", "left_anti"))


def enriched(new: DataFrame, known: DataFrame, keys: Sequence[str], into: str) -> tuple[DataFrame, DataFrame]:
    """Enrich or create: rows of known keys add what they have in the array ``into`` to it; the others are new rows."""
    both = new.join(known.select(*keys, F.col(into).alias("__there")), [*keys], "left_semi").join(known.select(*keys, F.col(into).alias("__there")), [*keys])
    return both.select(*keys, F.array_union("__there", into).alias(into)), insert_new(known, new, keys)


def partial(report: DataFrame, deadline: float) -> DataFrame:
    """A run's steps (step, seconds, in order nth) with what a deadline leaves: those that end within it are ``done``, the rest ``pending``, and the whole is ``partial`` if any is."""
    from pyspark.sql import Window

    w = Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)  # the steps of one run, a short list
    done = F.sum("seconds").over(w) <= deadline
    told = report.withColumn("status", F.when(done, "done").otherwise("pending"))
    return told.withColumn("partial", F.max((F.col("status") == "pending").cast("int")).over(Window.partitionBy()) == 1)


def decision_sources(edges: DataFrame, revisions: DataFrame, entity: str) -> DataFrame:
    """Decisions about an entity: sources of its ABOUT edges whose metadata has a ``decision``, with their prose (title, decision, rationale, summary) and time."""
    src = edges.where((F.col("edge_type") == "ABOUT") & (F.col("target") == entity)).select(F.col("source").alias("kref")).distinct()
    meta = lambda k: F.coalesce(F.element_at("metadata", k), F.lit(""))
    prose = rendering.whole_text(F.coalesce("title", F.lit("")), meta("decision"), meta("rationale"), F.coalesce("summary", F.lit("")))
    return revisions.where(meta("decision") != "").join(src, "kref", "left_semi").select("kref", prose.alias("text"), "created_at")


def newer(a: Column, b: Column) -> Column:
    """Whether a parsed date is later than another; unknown dates are never newer."""
    return F.coalesce(F.try_to_timestamp(a) > F.try_to_timestamp(b), F.lit(False))


def reflected(captures: DataFrame, spaces: DataFrame, default: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Captures (nth, kind, text, event_date, space, stack) as revisions (slug, title, text, event_date, space, stack), and what was dropped (nth, problem): dates that aren't ISO are left out and told, an unknown space is the default, and only in a space of its own does a capture stack upon the item that it resembles; the batch (one row: batch_stack) stacks if all its captures do."""
    iso = F.col("event_date").rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$") & (F.try_to_timestamp(F.rpad("event_date", 10, "-01-01"), F.lit("yyyy-MM-dd")).isNotNull() | (F.length("event_date") == 10))
    known = captures.join(spaces.select(F.col("space").alias("__s")), F.col("space") == F.col("__s"), "left")
    stack = F.coalesce("stack", F.lit(False)) & F.col("__s").isNotNull()
    rows = known.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(
        "nth", "kind", slug(title_of(F.col("text"))).alias("slug"), title_of(F.col("text")).alias("title"), "text", F.when(iso, F.col("event_date")).alias("event_date"), F.coalesce("__s", F.lit(default)).alias("space"), stack.alias("stack")
    )
    problems = captures.select("nth", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "no text").when(F.col("event_date").isNotNull() & ~F.coalesce(iso, F.lit(False)), "date").alias("problem")).where("problem is not null")
    batch = rows.agg(F.coalesce(F.bool_and("stack"), F.lit(False)).alias("batch_stack"))
    return rows, problems, batch


def projects_of(calls: DataFrame, projects: DataFrame, default: str) -> DataFrame:
    """calls with the project that they name, where it exists, else the default."""
    there = projects.select(F.col("project").alias("__p")).distinct()
    return calls.join(there, F.col("project") == F.col("__p"), "left").withColumn("project", F.coalesce("__p", F.lit(default))).drop("__p")


# --- picks of models


def angles(drafts: DataFrame, most: int = 3) -> DataFrame:
    """query_id, nth and angle: the first lines of a model's drafts (query_id, draw, draft) that differ in more than case and white space, without numbering."""
    lines = drafts.select("query_id", "draw", F.posexplode(F.split("draft", r"\r\n|\n|\r")).alias("line", "t"))
    bare = lines.withColumn("angle", F.regexp_replace(F.trim(F.regexp_replace("t", r"^\s+|\s+$", "")), r"^[0-9.) -]+", "")).where("angle <> ''")
    key = F.lower(F.trim(F.regexp_replace("angle", r"\s+", " ")))
    first = bare.withColumn("key", key).groupBy("query_id", "key").agg(F.min(F.struct("draw", "line", "angle")).alias("x")).select("query_id", "x.draw", "x.line", "x.angle")
    return top_k(first, ["query_id"], [F.col("draw"), F.col("line")], most).select("query_id", F.col("rank").cast("int").alias("nth"), "angle")


def with_picks(siblings: DataFrame, picks: DataFrame, items: DataFrame, config: Config = DEFAULT, calls: int = 16) -> DataFrame:
    """item, kref and score of the siblings that a recall shows.

    Of the first ``calls`` items (items: item, place, primary, primary_score) a model picks (picks: item, kref, nth): its picks
    score 1.0, 0.9 and so on, and the best other sibling (siblings: item, kref, score) joins them with its own score if that is
    strong. Items without picks keep all their siblings by score, the item's own revision at the item's score at least.
    """
    asked = items.where(F.col("place") <= calls).select("item")
    chosen = picks.join(asked, "item", "left_semi").join(siblings.select("item", "kref"), ["item", "kref"], "left_semi")
    mine = chosen.select("item", "kref", F.round(F.greatest(F.lit(0.1), 1.0 - 0.1 * (F.col("nth") - 1)), 1).alias("score"))
    has = mine.select("item").distinct()
    best = top_k(siblings.join(has, "item", "left_semi"), ["item"], [F.col("score").desc(), F.col("kref")], 1).where(F.col("score") >= config.sibling_strong)
    extra = best.select("item", "kref", "score").join(mine.select("item", "kref"), ["item", "kref"], "left_anti")
    rest = siblings.join(has, "item", "left_anti").join(items.select("item", "primary", "primary_score"), "item", "left")
    floor = F.when(F.col("kref") == F.col("primary"), F.greatest("score", "primary_score")).otherwise(F.col("score"))
    return mine.unionByName(extra).unionByName(rest.select("item", "kref", floor.alias("score")))


def answers(candidates: DataFrame) -> DataFrame:
    """What a why-question's candidates show: match (``anchor+line``, ``anchor`` or ``semantic``) and anchors, each file with its line ranges (files: comma-separated, line_ranges: ``file:a-b;...``)."""
    match = F.when(F.coalesce("line_hit", F.lit(False)), "anchor+line").when(F.col("anchored"), "anchor").otherwise("semantic")
    ranges = F.transform(F.filter(F.split(F.coalesce("line_ranges", F.lit("")), ";"), lambda r: r.contains(":")), lambda r: F.struct(F.regexp_extract(r, r"^(.*):[^:]*$", 1).alias("file"), F.regexp_extract(r, r":([^:]*)$", 1).alias("lines")))
    names = F.filter(F.transform(F.split(F.coalesce("files", F.lit("")), ","), lambda f: F.trim(f)), lambda f: f != "")
    anchors = F.transform(names, lambda f: F.struct(f.alias("file"), F.array_join(F.transform(F.filter(ranges, lambda r: r.file == f), lambda r: r.lines), ",").alias("lines")))
    return candidates.withColumns({"match": match, "anchors": anchors})


def ambiguous_spellings(relations: DataFrame) -> DataFrame:
    """Spellings of a registry (relation, spelling) that don't name one relation: normalised to nothing, a relation's own name, or more than one relation's."""
    from ..functions.text import edge_name

    told = relations.select("relation", "spelling", edge_name(F.col("spelling")).alias("name"))
    many = told.groupBy("name").agg(F.countDistinct("relation").alias("n")).where("n > 1 and name is not null").select("name", F.lit("several relations").alias("problem"))
    own = relations.select(F.col("relation").alias("name")).distinct().withColumn("own", F.lit(True))
    out = told.join(many, "name", "left").join(own, "name", "left")
    return out.withColumn("problem", F.when(F.col("name").isNull(), "nothing left").when(F.col("own"), "a relation's name").otherwise(F.col("problem"))).where("problem is not null").select("relation", "spelling", "problem")


