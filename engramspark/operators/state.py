"""State of sessions from their logs: pointers, generations, identities, cursors and metadata.

A store that keeps such state answers from the last writes; here the log of operations is a table, and the state at each of
its rows, or at its end, is a plan. What depends on the row before only through counts and gaps is a window; what is a
decision after a decision (a claim that may lose, a cursor that moves when it fires) is a fold over one key's operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import session_id as generated_id
from ..schemas import DEFAULT, Config

DAY = 86_400


def _folded(log: DataFrame, keys: list[str], row: Column, start: Column, step) -> DataFrame:
    """keys and ``x``, what the fold gave for each row of a key in its order."""
    rows = log.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    return rows.select(*keys, F.explode(F.aggregate("__rows", start, step).out).alias("x"))


def active_sessions(log: DataFrame, ttl: int = DAY) -> DataFrame:
    """The session pointer of each key after each operation (key, at in seconds, seq, op, session_id, only_if): key, seq, active and won.

    ``set`` writes; ``claim`` writes where no pointer is alive, and has won if it did; ``clear`` deletes, with ``only_if``
    only the pointer that holds it. A pointer lives ``ttl`` seconds from its writing; reading (``get``) doesn't prolong it.
    """
    state = F.struct(F.lit(None).cast("string").alias("active"), F.lit(0).cast("long").alias("until"), F.array().cast("array<struct<seq:bigint,active:string,won:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        alive = F.when(acc.until > x["at"], acc.active)
        writes = (x["op"] == "set") | ((x["op"] == "claim") & alive.isNull())
        goes = (x["op"] == "clear") & (x["only_if"].isNull() | alive.eqNullSafe(x["only_if"]))
        active = F.when(writes, x["session_id"]).when(goes, F.lit(None)).otherwise(alive)
        until = F.when(writes, x["at"] + ttl).otherwise(acc.until).cast("long")
        won = F.when(x["op"] == "claim", alive.isNull())
        row = F.struct(x["seq"].cast("long").alias("seq"), active.alias("active"), won.alias("won"))
        return F.struct(active.alias("active"), until.alias("until"), F.array_append(acc.out, row).alias("out"))

    row = F.struct("at", "seq", "op", "session_id", "only_if")
    return _folded(log, ["key"], row, state, step).select("key", "x.seq", "x.active", "x.won")


def generations(log: DataFrame, ttl: int = DAY) -> DataFrame:
    """The consolidation count of each base session after each operation (key, at in seconds, seq, op: ``bump`` or ``get``): it starts again where none came for longer than ``ttl``."""
    order = Window.partitionBy("key").orderBy("at", "seq")
    new = F.coalesce((F.col("at") - F.lag("at").over(order) >= ttl).cast("int"), F.lit(0))
    runs = log.withColumn("run", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("key", "run").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return runs.select("key", "seq", F.count_if(F.col("op") == "bump").over(own).alias("generation"))


def resolved_sessions(calls: DataFrame) -> DataFrame:
    """session_id and source of calls (user_id, context, host_env, pointer, day, sequence): the host's session for a call without a user, else the user's live pointer, else a generated one. Without any identity both are null: the caller must name a session."""
    user = F.when(F.trim("user_id") != "", F.col("user_id"))
    host = F.when(user.isNull() & (F.trim("host_env") != ""), F.col("host_env"))
    pointer = F.when(user.isNotNull(), F.col("pointer"))
    new = F.when(user.isNotNull(), generated_id(F.col("context"), user, F.col("day"), F.col("sequence")))
    source = F.when(host.isNotNull(), "host-env").when(pointer.isNotNull(), "active-pointer").when(new.isNotNull(), "generated")
    return calls.withColumns({"session_id": F.coalesce(host, pointer, new), "source": source})


def assessments_due(messages: DataFrame, least: int = 3, window: int = 6, query: int = 3, recent: int = 300) -> DataFrame:
    """When the background assessment runs (session_id, idx, role, content): after an assistant's message, once ``least`` messages came since it last did. session_id, idx, seen (the cursor then), first (of the window it reads) and query (the ends of its last messages)."""
    w = Window.partitionBy("session_id").orderBy("idx")
    told = messages.withColumn("seen", F.row_number().over(w).cast("long"))
    ends = F.transform(F.collect_list(F.struct("idx", "content")).over(w.rowsBetween(1 - query, 0)), lambda x: F.right(x.content, F.lit(recent)))
    told = told.withColumn("query", F.array_join(F.filter(ends, lambda x: x != ""), " "))
    start = F.struct(F.lit(0).cast("long").alias("cursor"), F.array().cast("array<struct<idx:bigint,seen:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fires = x.seen - acc.cursor >= least
        row = F.struct(x.idx.cast("long").alias("idx"), x.seen.alias("seen"))
        return F.struct(F.when(fires, x.seen).otherwise(acc.cursor).alias("cursor"), F.when(fires, F.array_append(acc.out, row)).otherwise(acc.out).alias("out"))

    fired = _folded(told.where("role = 'assistant'"), ["session_id"], F.struct("idx", "seen"), start, step).select("session_id", "x.idx", "x.seen")
    first = F.greatest(F.lit(1), F.col("seen") - window + 1).alias("first")
    return fired.join(told.select("session_id", "idx", "query"), ["session_id", "idx"]).select("session_id", "idx", "seen", first, "query")


def remined(sessions: DataFrame, recorded: DataFrame, least: int = 10) -> DataFrame:
    """Sessions (session_id, messages) to be mined again: never recorded, or grown by more than ``least`` messages since (recorded: session_id, seen)."""
    both = sessions.join(recorded, "session_id", "left")
    return both.where(F.col("seen").isNull() | (F.col("messages") > F.col("seen") + least)).select("session_id", "messages", (F.col("messages") - F.coalesce("seen", F.lit(0))).alias("new"))


def session_metadata(log: DataFrame, at: Column, ttl: int = DEFAULT.session_ttl) -> DataFrame:
    """session_id and metadata (a map) at a time, from upserts (session_id, at in seconds, field, value): the last value of each field since the session last expired, and nothing where it has expired since. Every upsert prolongs the life of the whole."""
    w = Window.partitionBy("session_id").orderBy("at")
    new = F.coalesce((F.col("at") - F.lag("at").over(w) >= ttl).cast("int"), F.lit(0))
    live = log.withColumn("life", F.sum(new).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    live = live.withColumns({"now": F.max("life").over(Window.partitionBy("session_id")), "touched": F.max("at").over(Window.partitionBy("session_id"))})
    live = live.where((F.col("life") == F.col("now")) & (F.col("touched") + ttl > at))
    fields = live.groupBy("session_id", "field").agg(F.max_by("value", F.struct("at", "value")).alias("value"))
    return fields.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("metadata"))


def cleared(messages: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The buffer without the sessions that are cleared, and how many messages each of these had."""
    gone = messages.join(sessions.select("session_id").distinct(), "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("cleared_count"))
    return messages.join(sessions.select("session_id").distinct(), "session_id", "left_anti"), gone


def answered(messages: DataFrame, answers: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The buffer with the assistant's answers (session_id, content) appended, and the assessments that they set off."""
    last = messages.groupBy("session_id").agg(F.max("idx").alias("last"))
    new = answers.join(last, "session_id", "left").select("session_id", (F.coalesce("last", F.lit(-1)) + 1).cast("long").alias("idx"), F.lit("assistant").alias("role"), "content")
    both = messages.select("session_id", F.col("idx").cast("long").alias("idx"), "role", "content").unionByName(new)
    due = assessments_due(both).join(new.select("session_id", "idx"), ["session_id", "idx"], "left_semi")
    return both, due
