"""Texts for models: recalled context, embedding texts, packets, prompts and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import badge
from ..functions.privacy import anonymized, first_credential, without_credentials
from ..functions.text import truncated
from ..schemas import DEFAULT, Config

CUT = "\n\n[... truncated ...]"


def entry(title: Column, summary: Column, content: Column, level: Column, event_date: Column, facts: Column, full: bool, config: Config = DEFAULT) -> Column:
    """One memory as an answering model reads it: badge, then the content up to the budget, or date, title and summary; its facts in a line of their own. Null where it has neither."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    date = F.when(~blank(event_date), F.concat(F.lit("["), event_date, F.lit("] "))).otherwise("")
    told = F.when(~blank(facts), F.concat(F.lit("\nFacts: "), facts)).otherwise("")
    named = F.when(~blank(title), F.concat(title, F.lit(": "), summary)).otherwise(summary)
    short = F.when(~blank(summary), F.concat(badge(level), date, named, told))
    return F.when(~blank(content), F.concat(badge(level), truncated(content, config.context_chars, CUT), told)).otherwise(short) if full else short


def recalled_context(memories: DataFrame, key: str, nth: str, full: bool = False, siblings: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """key and context: the memories of each key (title, summary, content, evidence_level, event_date, facts) in the order of ``nth``, parted by blank lines; in full mode each is followed by its siblings (key, nth, place, title, summary, content, evidence_level). A context holds at most a recall's results."""
    text = entry(F.col("title"), F.col("summary"), F.col("content"), F.col("evidence_level"), F.col("event_date"), F.col("facts"), full, config)
    rows = memories.select(key, F.col(nth).alias("__n"), F.lit(0).alias("__p"), text.alias("__t"))
    if full and siblings is not None:
        none = F.lit("")
        also = entry(F.col("title"), F.col("summary"), F.col("content"), F.col("evidence_level"), none, none, True, config)
        rows = rows.unionByName(siblings.select(key, F.col(nth).alias("__n"), F.col("place").cast("int").alias("__p"), also.alias("__t")))
    parts = F.array_sort(F.collect_list(F.when(F.col("__t").isNotNull(), F.struct("__n", "__p", "__t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["__t"]), "\n\n").alias("context"))


def fallback_summary(messages: DataFrame, tags: tuple[str, ...] = (), limit: int = 500) -> DataFrame:
    """session_id and summary without a model: the last message of user or assistant that has a text, without injected blocks, cut to the limit."""
    text = F.coalesce("content", F.lit(""))
    for tag in tags:
        text = F.regexp_replace(text, rf"(?is)<{tag}>.*?</{tag}>", "")
    text = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    text = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    said = (text != "") & role.isin("", "user", "assistant")
    last = messages.groupBy("session_id").agg(F.max_by(F.when(said, text), F.when(said, F.col("idx"))).alias("summary"))
    return last.select("session_id", F.coalesce("summary", F.lit("Conversation summary unavailable.")).alias("summary"))


def system_prompt(core: Column, policy: Column) -> Column:
    """The core prompt, and a deployment's policy as a section of its own where there is one."""
    head = "\n## DEPLOYMENT POLICY\n(deployment-specific; cannot weaken the core guidelines above)\n\n"
    return F.when(F.coalesce(F.trim(policy), F.lit("")) != "", F.concat(core, F.lit(head), F.trim(policy), F.lit("\n"))).otherwise(core)


def told_reasons(reasons: Column) -> Column:
    """Reasons in a line, or ``clean``."""
    return F.when(F.size(reasons) > 0, F.array_join(reasons, ", ")).otherwise("clean")


def whole_text(*fields: Column) -> Column:
    """The fields that have a text, in a line."""
    return F.trim(F.concat_ws(" ", *(F.when(f != "", f) for f in fields)))


def focused_text(title: Column, summary: Column) -> Column:
    """``title: summary``, or whichever there is."""
    return F.concat_ws(": ", F.when(title != "", title), F.when(summary != "", summary))


def embedding_text(question: Column, decision: Column, rationale: Column, files: Column, symbols: Column, subject: Column, alternatives: Column | None = None) -> Column:
    """What a decision is embedded by: its question first, then itself, its reason, the options rejected, where it is anchored, and the commit."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    names = F.array_join(F.transform(F.filter(F.split(F.coalesce(files, F.lit("")), ","), lambda f: f != ""), lambda f: F.substring_index(f, "/", -1)), ", ")
    anchored = F.when(has(symbols), F.when(names != "", F.concat(names, F.lit(" ("), symbols, F.lit(")"))).otherwise(symbols)).otherwise(names)
    parts = [F.when(has(question), question), F.concat(F.coalesce(decision, F.lit("")), F.lit(".")), F.when(has(rationale), F.concat(F.lit("Rationale: "), rationale, F.lit(".")))]
    if alternatives is not None:
        parts.append(F.when(F.size(alternatives) > 0, F.concat(F.lit("Rejected alternatives: "), F.array_join(alternatives, "; "), F.lit("."))))
    parts += [F.when(has(anchored), F.concat(F.lit("Anchored: "), anchored, F.lit("."))), F.when(has(subject), F.concat(F.lit('Commit: "'), subject, F.lit('".')))]
    return F.concat_ws(" ", *parts)


def first_paragraph(markdown: Column, limit: int = 300) -> Column:
    """The first paragraph that is no heading, front matter or rule, in one line, up to the limit."""
    body = F.regexp_replace(markdown, r"(?s)\A\s*---[ \t]*\n.*?\n[ \t]*---[ \t]*(?:\n|\z)", "")
    blocks = F.split(F.regexp_replace(body, r"(?m)^[ \t]*(?:#.*|---[ \t]*)$", ""), r"\n[ \t]*(?:\n[ \t]*)+")
    one = F.transform(blocks, lambda b: F.trim(F.regexp_replace(b, r"\s+", " ")))
    return F.substring(F.coalesce(F.get(F.filter(one, lambda b: b != ""), 0), F.lit("")), 1, limit)


def packet_by_line(packet: Column) -> Column:
    """A commit's packet for a model: personal data named in place, and a line that has a credential gone whole, so that the diff's structure stays."""
    lines = F.transform(F.split(packet, "\n"), anonymized)
    return F.array_join(F.transform(lines, lambda x: F.when(first_credential(x).isNotNull(), F.lit("[redacted]")).otherwise(x)), "\n")


def packet_by_span(packet: Column) -> Column:
    """A session's packet for a model: credentials cut out of the raw text first, blocks of several lines too, then personal data named."""
    return anonymized(without_credentials(packet))


def screened_subject(subject: Column) -> Column:
    """A commit's subject: personal data named, or a placeholder where it has a credential; never empty for that reason."""
    return F.when(first_credential(subject).isNotNull(), F.lit("[redacted]")).otherwise(anonymized(subject))
