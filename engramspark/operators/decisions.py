"""Decisions about code: anchors, evidence bridges, correlation of sessions with commits, screening of what models claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.privacy import first_credential
from ..functions.text import containment, jaccard, one_line, tokens, word_tokens
from ..schemas import DEFAULT, Config
from ..sources.store import written
from .ranking import top_k


def line_hit(start: Column, end: Column, line: Column, slack: int = DEFAULT.anchor_slack) -> Column:
    """Whether a line lies in a range widened by the slack; a missing range is no hit."""
    return F.coalesce(line.between(start.try_cast("int") - slack, end.try_cast("int") + slack), F.lit(False))


def anchored(anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """Decisions implemented in anchors (anchor, line): decision, anchor, line_hit and the commit of the edge (source, target, edge_type, line_start, line_end, commit_hash)."""
    into = edges.where("edge_type = 'IMPLEMENTED_IN'").select(F.col("source").alias("decision"), F.col("target").alias("anchor"), "line_start", "line_end", "commit_hash")
    met = anchors.join(into, "anchor").withColumn("hit", line_hit(F.col("line_start"), F.col("line_end"), F.col("line")))
    return met.groupBy("decision", "anchor").agg(F.bool_or("hit").alias("line_hit"), F.max("commit_hash").alias("commit_hash"))


def evidence_bridge(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Decisions motivated by the evidence found (evidence, score): the best score of each."""
    into = edges.where("edge_type = 'MOTIVATED_BY'").select(F.col("source").alias("decision"), F.col("target").alias("evidence"))
    return hits.join(into, "evidence").groupBy("decision").agg(F.max("score").alias("score"))


def supersede_candidates(new: DataFrame, old: DataFrame, hint: float = 0.35, blind: float = 0.5, hint_words: float = 0.2) -> DataFrame:
    """Older decisions that a new one replaces: of a shared anchor, strictly older, and similar enough, less so where the new one's hint points at the old one.

    Texts of an anchor with the same words are one set. Sets meet by the set-similarity join, at ``blind``; at ``hint`` only
    those that are small enough for a hint to point at one of them. Decisions meet by the sets that did.
    """
    from .similarity import close_sets, signed_sets

    side = lambda df, kind: df.select("id", F.explode(F.array_distinct("anchors")).alias("anchor"), F.col("decided_at").alias("at"), tokens(F.col("text")).alias("t"), (tokens(F.coalesce("hint", F.lit(""))) if kind == "new" else F.array().cast("array<string>")).alias("hint"), F.lit(kind).alias("side"))
    said = signed_sets(side(new, "new").unionByName(side(old, "old")), "id", "t", ["anchor"], "at", "hint", "side")
    said = said.withColumn("hint", F.transform("hint", lambda x: F.xxhash64(x)))
    sets = written(said.groupBy("anchor", "__s").agg(F.first("__h").alias("__h")).withColumnRenamed("__s", "__id"), "classes")
    close = close_sets(sets, blind, ["anchor"])
    words = said.agg(F.max(F.size("hint")).alias("n")).first().n or 0
    if words and hint < blind:
        # a hint of n words points at sets of n / hint_words at most, which are close to sets of at most that over hint
        least = close_sets(sets.where(F.size("__h") <= words / hint_words / hint + 1e-9), hint, ["anchor"]).where(F.col("similarity") < blind)
        close = close.unionByName(least)
    close = close.select("anchor", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p"), "similarity").select("anchor", "p.*", "similarity")
    a = said.where("side = 'new'").select("anchor", F.col("__s").alias("x"), F.col("__id").alias("newer"), F.col("at").alias("na"), F.col("hint").alias("nh"))
    small = F.when(F.size("__h") <= words / hint_words + 1e-9, F.col("__h")).otherwise(F.array().cast("array<bigint>"))
    b = said.where("side = 'old'").select("anchor", F.col("__s").alias("y"), F.col("__id").alias("older"), F.col("at").alias("oa"), small.alias("ot"))
    later = (F.col("newer") != F.col("older")) & (F.col("oa") < F.col("na"))
    alike = a.join(b.withColumnRenamed("y", "x"), ["anchor", "x"]).where(later).withColumn("similarity", F.lit(1.0))
    met = a.join(close, ["anchor", "x"]).join(b, ["anchor", "y"]).where(later)
    pointed = jaccard(F.col("nh"), F.col("ot")) >= hint_words
    both = alike.select("newer", "older", "nh", "ot", "similarity").unionByName(met.select("newer", "older", "nh", "ot", "similarity"))
    kept = both.where(F.when(F.col("similarity") >= blind, F.lit(True)).otherwise(pointed & (F.col("similarity") >= hint)))
    return kept.select("newer", "older", F.col("similarity").alias("score")).distinct()


def correlated_targets(found: DataFrame, by_sha: DataFrame, by_file: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The decision that each of a session's findings (finding, session, text, at, symbols) is about.

    By commit hash (finding, target, ...): similar enough. By file: also a shared symbol or more similar, and within two
    weeks. Targets carry target, target_session, target_text, target_at, target_symbols and deprecated.
    """
    lex = jaccard(tokens(F.col("text")), tokens(F.col("target_text")))
    one = found.join(by_sha, "finding").withColumns({"tier": F.lit(1), "lex": lex}).where("lex >= 0.2")
    near = F.abs(F.unix_seconds("at") - F.unix_seconds("target_at")) <= config.correlate_days * 86400
    two = found.join(by_file, "finding").withColumns({"tier": F.lit(2), "lex": lex}).where((F.col("lex") >= 0.2) & (F.arrays_overlap("symbols", "target_symbols") | (F.col("lex") >= 0.5)) & near)
    both = one.unionByName(two).where(~F.col("deprecated") & ~F.col("target_session").eqNullSafe(F.col("session")))
    return top_k(both, ["finding"], [F.col("tier"), F.col("lex").desc(), F.col("target_at").desc(), F.col("target")], 1).select("finding", "target", "tier", F.round("lex", 6).alias("lex"))


def verbatim(statement: Column, source: Column, least: float = 0.6) -> Column:
    """Whether a statement stands in its source: as it is but for case and white space, or with most of its words. Capitals first: a letter that has several as its capital is the same as these."""
    plain = lambda c: one_line(F.upper(c))  # noqa: E731 (not lower(upper(c)), which Spark takes for lower(c))
    words = lambda c: F.array_distinct(word_tokens(plain(c)))
    return F.lower(plain(source)).contains(F.lower(plain(statement))) | (containment(words(statement), words(source)) >= least)


def screened_decisions(rows: DataFrame, files: Column, anchors: int = 8, evidence: int = 6) -> DataFrame:
    """Claimed decisions (title, confidence, anchors, evidence) that stand: no credential in any part, anchors that exist or were changed, and evidence where confidence is low."""
    clean = lambda c, n: F.slice(F.filter(c, lambda x: first_credential(x).isNull()), 1, n)
    real = F.slice(F.array_union(F.array_intersect("anchors", files), files), 1, anchors)
    out = rows.withColumns({"anchors": real, "evidence": clean("evidence", evidence)}).where(first_credential(F.col("title")).isNull())
    return out.where((F.col("confidence") != "low") | (F.size("evidence") > 0))


def symbol_bridges(decisions: DataFrame, entities: DataFrame) -> DataFrame:
    """ABOUT edges from decisions (id, symbols, text) to entities (slug, name): a symbol of the entity's slug, or its name in the text.

    What a decision has in common with entities goes by its id to parts of so many decisions, and only there becomes edges:
    a part's size doesn't depend on how many decisions there are, or how many have one name.
    """
    from ..functions.text import slug
    from .similarity import mentions, small

    there = small(written(entities.select("slug").distinct(), "slugs"))
    names = written(entities.select("slug", F.array_join(word_tokens(F.col("name")), " ").alias("words")).where("words <> ''").distinct(), "names")
    by_symbol = decisions.select("id", F.explode("symbols").alias("s")).select("id", slug(F.col("s")).alias("own")).join(there.withColumnRenamed("slug", "own"), "own", "left_semi")
    named = mentions(decisions.withColumn("w", word_tokens(F.col("text"))), "id", "w", names, "words")
    met = by_symbol.select("id", "own", F.lit(None).cast("string").alias("words")).unionByName(named.select("id", F.lit(None).cast("string").alias("own"), "words"))
    met = met.repartition(decisions.count() // 16_384 + 1, "id").join(small(names), "words", "left")
    return met.select("id", F.coalesce("own", "slug").alias("slug")).distinct().select("id", "slug", F.lit("ABOUT").alias("edge_type"))


def about_sources(edges: DataFrame, nodes: DataFrame, entity: str, kind: str) -> DataFrame:
    """Nodes of a kind that are about an entity, with how many edges each has at either end; edges of other nodes aren't counted."""
    from .similarity import small

    src = small(written(edges.where((F.col("edge_type") == "ABOUT") & (F.col("target") == entity)).select(F.col("source").alias("kref")).distinct(), "sources"))
    ends = edges.select(F.col("source").alias("kref")).unionAll(edges.select(F.col("target").alias("kref"))).join(src, "kref", "left_semi").groupBy("kref").agg(F.count("*").alias("edges"))
    return nodes.where(F.col("kind") == kind).join(src, "kref", "left_semi").join(ends, "kref", "left")


def grounded_by_index(decisions: DataFrame, facts: DataFrame) -> DataFrame:
    """DEPENDS_ON edges of decisions (conv, decision, based_on) to facts (conv, pos, fact) by position."""
    by = decisions.select("conv", "decision", F.explode("based_on").alias("pos"))
    return by.join(facts, ["conv", "pos"]).select(F.col("decision").alias("source"), F.col("fact").alias("target"), F.lit("DEPENDS_ON").alias("edge_type")).distinct()


def tiered_diff(lines: DataFrame, per_file: int = 40) -> DataFrame:
    """Diff lines (file, nth, line) that a packet shows: changed lines first, comments and context after, at most so many a file, in their order."""
    tier = F.when(F.col("line").rlike(r"^[+-](?![+-])") & ~F.col("line").rlike(r"^[+-]\s*(?:#|//|/\*|\*)"), 0).when(F.col("line").rlike(r"^[+-](?![+-])"), 1).otherwise(2)
    return top_k(lines.withColumn("tier", tier), ["file"], [F.col("tier"), F.col("nth")], per_file).drop("rank", "tier")
