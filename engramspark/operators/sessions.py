"""Sessions and transcripts: last messages, prefilters, salience, selection, chunks, commits."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DEFAULT, Config

STORE = "(?i)" + "|".join(
    (
        r"\b(?:preference|prefer|i\s+(?:always\s+use|dislike|hate|like|love))\b",
        r"\b(?:usually|typically|always|never|tend\s+to)\b",
        r"\b(?:decision|decided|choosing|chose|going\s+with|let'?s\s+(?:go\s+with|switch\s+to|use))\b",
        r"\b(?:important|remember(?:\s+this)?|key\s+(?:detail|fact|point|thing))\b",
        r"\bmy\s+(?:approach|configuration|config|convention|rule|setup|stack|style|workflow)\b",
        r"\bwe\s+(?:agreed|chose|decided|picked|settled\s+on)\b",
        r"\b(?:avoid|don'?t\s+(?:do|ever|forget|use)|should\s+(?:never|always))\b",
        r"\b(?:we\s+use|i\s+use|i\s+rely\s+on|our\s+(?:project|team)\s+uses)\b",
    )
)
SKIP = "(?is)^(?:" + "|".join(
    (
        r"(?:absolutely|acknowledged?|agreed|awesome|cheers|cool|correct|done|exactly|got\s+it|great|makes?\s+sense|no|nope|of\s+course|okay|ok|perfect|right|sounds\s+good|sure|thank\s+you|thanks?|ty|understood?|will\s+do|yep|yes|yup)[.!?\s]*$",
        r"(?:here\s+is|here'?s|i\s+will|i'll|let\s+me|sure[,!]?\s+here)[^.!?]{0,60}[.!]?\s*$",
        r"```.{0,2000}```\s*$",
    )
) + ")"
DECIDE = r"(?i)let'?s go with|we'?ll use|going with|decided|instead of|rather than|opt(?:ed)? for|reject(?:ed)?|revert|결정|선택|채택|기각|가기로|대신|롤백"
_ALTERNATIVE = r"(?i)considered\b.{0,80}\bbut\b|why not\b|\S+ 말고|\S+ 대신"
_MEASURED = r"(?i)benchmark|measured|실측|p9\d|\brecall\b|\bF1\b|\d+(?:[.]\d+)?\s*(?:tokens?\b|MB\b|ms\b|s\b|x\b|%|점)"
_REVIEW = r"(?i)blocker|confirmed|critical|defect|지적|리뷰"
_SHA = r"\b[0-9a-f]{7,40}\b"
_FILE = r"\b[\w./\\-]+[.](?:cpp|c|go|h|java|json|js|md|py|rs|toml|tsx|ts|yaml|yml)\b"
_TICKS = r"`[^`\s][^`]*`"
ASSENT = r"(?i)^\s*(?:approved?|do it|go ahead|yes|승인|그래|좋아|ㄱㄱ)\b"
_BLOB = r"[A-Za-z0-9+/=]{120,}"


def last_messages(messages: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """The last ``limit`` messages of each session after skipping ``offset`` from the end, with the session's count."""
    w = Window.partitionBy("session_id")
    nth = F.row_number().over(w.orderBy(F.col("idx").desc()))
    return messages.withColumns({"back": nth, "message_count": F.count("*").over(w)}).where(F.col("back").between(offset + 1, offset + limit)).drop("back")


def worth_storing(messages: DataFrame, window: int = 4, config: Config = DEFAULT) -> DataFrame:
    """For each session whether its last messages look like a memory: long enough together, the last no filler, a signal in any."""
    w = Window.partitionBy("session_id").orderBy(F.col("idx").desc())
    tail = messages.withColumn("back", F.row_number().over(w)).where((F.col("back") <= window) & (F.coalesce("content", F.lit("")) != ""))
    one = tail.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "content"))), lambda x: x.content), " ").alias("all"), F.max_by("content", "idx").alias("last"))
    good = (F.length(F.trim("all")) >= config.least_chars) & ~F.trim("last").rlike(SKIP) & F.col("all").rlike(STORE)
    return one.select("session_id", good.alias("candidate"))


def base_salience(text: Column) -> Column:
    """Points of a message by itself: decisions, alternatives, measurements, reviews, hashes, identifiers; less for blobs and pasted code."""
    lines = F.split(text, "\n")
    full = F.filter(lines, lambda x: F.trim(x) != "")
    dull = F.size(F.filter(full, lambda x: F.length(F.regexp_replace(x, r"(?U)[^\p{L}]", "")) / F.greatest(F.lit(1), F.length(x)) < 0.2))
    code = F.size(F.filter(full, lambda x: x.rlike(r"^(?:[ \t{}]|class |def |import )")))
    one = lambda c, n: F.when(c, n).otherwise(0)
    names = one(text.rlike(_FILE), 1) + F.least(F.lit(2), F.regexp_count(text, F.lit(_TICKS)))
    return (
        one(text.rlike(DECIDE), 3)
        + one(text.rlike(_ALTERNATIVE), 3)
        + one(text.rlike(_MEASURED), 2)
        + one(text.rlike(_REVIEW), 2)
        + one(text.rlike(_SHA), 2)
        + F.least(F.lit(3), names)
        - one((F.size(lines) >= 5) & (dull / F.size(lines) > 0.8), 2)
        - one(text.rlike(_BLOB), 2)
        - one((F.length(text) > 500) & (F.size(lines) > 9) & ~text.rlike(DECIDE) & (F.size(full) > 0) & (code / F.size(full) > 0.7), 2)
    ).cast("long")


def salience(messages: DataFrame) -> DataFrame:
    """Adds ``score``: the base and a point for a short assent right after a message that scored 4 or more.

    That message's score may hold a point of its own, so runs of assents matter: within a run that starts after score s, all
    get the point if s >= 4, and after s = 3 none does. A fold over each session's scores, which are one short array, gives
    it exactly.
    """
    base = messages.withColumn("base", base_salience(F.col("content"))).withColumn("assents", (F.col("role") == "user") & (F.length("content") <= 80) & F.col("content").rlike(ASSENT))
    rows = base.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("idx", "role", "content", "base", "assents"))).alias("m"))
    start = F.struct(F.lit(0).cast("long").alias("prev"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        score = x.base + F.when(x.assents & (acc.prev >= 4), 1).otherwise(0)
        return F.struct(score.cast("long").alias("prev"), F.array_append(acc.out, score.cast("long")).alias("out"))

    scored = rows.withColumn("s", F.aggregate("m", start, step).out)
    return scored.select("session_id", F.explode(F.arrays_zip("m", "s")).alias("x")).select("session_id", "x.m.idx", "x.m.role", "x.m.content", F.col("x.s").alias("score"))


def selected(scored: DataFrame, config: Config = DEFAULT, first: int = 2, last: int = 3) -> DataFrame:
    """Salient messages with their neighbours, and the frame of each session; ``elided`` counts those left out right before a row."""
    w = Window.partitionBy("session_id").orderBy("idx")
    flag = F.max((F.col("score") >= config.salience).cast("int")).over(w.rowsBetween(-1, 1))
    at, n = F.row_number().over(w), F.count("*").over(Window.partitionBy("session_id"))
    marked = scored.withColumns({"at": at, "n": n, "keep": flag}).where((F.col("keep") == 1) | (F.col("at") <= first) | (F.col("at") > F.col("n") - last))
    return marked.withColumn("elided", (F.col("at") - F.lag("at", 1, 0).over(w) - 1).cast("long")).drop("at", "n", "keep")


def chunks(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(session_id, chunk, idx): greedy packing of each session's selected messages by characters; of too many chunks the first and last stay, then those of the highest mean score. Sequential, so a session is one pandas frame."""
    kind = rows.schema["session_id"].dataType.simpleString()

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        out: list[list[int]] = []
        size = 0
        for i, n in enumerate(g["chars"]):
            if not out or size + n > config.chunk_chars:
                out.append([])
                size = 0
            out[-1].append(i)
            size += n
        if len(out) > config.chunks:
            mean = lambda c: g["score"].iloc[c].mean()
            inner = sorted(range(1, len(out) - 1), key=lambda k: (-mean(out[k]), k))[: config.chunks - 2]
            out = [out[k] for k in sorted({0, len(out) - 1, *inner})]
        flat = [(k, i) for k, c in enumerate(out) for i in c]
        return pd.DataFrame({"session_id": g["session_id"].iloc[0], "chunk": [k for k, _ in flat], "idx": g["idx"].iloc[[i for _, i in flat]].to_numpy()})

    return rows.select("session_id", "idx", "score", F.length("content").alias("chars")).groupBy("session_id").applyInPandas(pack, f"session_id {kind}, chunk int, idx long")


def markdown(messages: DataFrame) -> DataFrame:
    """Each session as one document: a heading per message, its time, its text."""
    part = lambda x: F.concat(F.lit("### "), F.initcap(x.role), F.lit("\n"), F.when(x.ts.isNotNull(), F.concat(F.lit("<sub>"), x.ts, F.lit("</sub>\n"))).otherwise(""), F.lit("\n"), x.content, F.lit("\n"))
    rows = messages if "ts" in messages.columns else messages.withColumn("ts", F.lit(None).cast("string"))
    all_ = F.array_sort(F.collect_list(F.struct("idx", "role", F.col("ts").cast("string").alias("ts"), "content")))
    return rows.groupBy("session_id").agg(F.concat(F.lit("# Conversation "), F.first(F.col("session_id").cast("string")), F.lit("\n\n---\n\n"), F.array_join(F.transform(all_, part), "\n")).alias("markdown"))


_GENERATED = r"(?s)^(?:dist/.*|build/.*|.*__pycache__.*|.*[.](?:lock|snap|pb[.]go|min[.]js|min[.]css)|.*_pb2(?:_grpc)?[.]py|package-lock[.]json|pnpm-lock[.]yaml)$"


def commit_filter(parents: Column, subject: Column, body: Column, files: Column) -> Column:
    """Why a commit isn't worth mining, or null; in doubt it is."""
    bare = F.trim(F.coalesce(body, F.lit(""))) == ""
    return (
        F.when((F.size(parents) >= 2) & bare, "merge")
        .when((F.size(files) > 0) & F.forall(files, lambda f: f.rlike(_GENERATED)), "generated_files")
        .when(bare & F.lower(subject).rlike(r"bump|release v|chore\(release\)"), "version_bump")
        .when(bare & (F.size(files) == 0) & (F.size(F.split(F.trim(subject), r"\s+")) <= 3), "trivial")
    )


def anchor_slug(repo: Column, path: Column) -> Column:
    from ..functions.text import slug

    return slug(F.concat(repo, F.lit("::"), normal_path(path)))


def normal_path(path: Column) -> Column:
    """Forward slashes, no leading ./ and no slashes at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"^(?:\./)+", ""), "^/+|/+$", "")


def correlated(decisions: DataFrame, others: DataFrame, key: Sequence[str], days: int = DEFAULT.correlate_days) -> DataFrame:
    """Pairs of one key within ``days`` of each other, the nearest of each decision: an interval join in buckets of ``days``, so a key's rows meet only those of three buckets."""
    b = lambda c: F.floor(F.unix_seconds(c) / (days * 86400)).cast("long")
    left = decisions.withColumn("bucket", F.explode(F.array(*(b(F.col("ts")) + i for i in (-1, 0, 1)))))
    right = others.withColumnRenamed("ts", "other_ts").withColumn("bucket", b(F.col("other_ts")))
    met = left.join(right, [*key, "bucket"]).where((F.col("id") != F.col("other_id")) & (F.abs(F.unix_seconds("ts") - F.unix_seconds("other_ts")) <= days * 86400))
    gap = F.abs(F.unix_seconds("ts") - F.unix_seconds("other_ts"))
    return met.groupBy("id").agg(F.min_by(F.struct("other_id", gap.alias("gap")), F.struct(gap, F.col("other_id"))).alias("x")).select("id", "x.other_id", "x.gap")
