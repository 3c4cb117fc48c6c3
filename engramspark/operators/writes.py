"""What runs write: classified executions, artifacts, profiles, queues, ledgers, reports. All are appends that skip what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug, title_of
from ..schemas import DEFAULT, KIND_PRIORITY, RELATIONS, WALKED_EDGES, Config
from .maintenance import insert_new
from .ranking import top_k


def tool_executions(rows: DataFrame, *keys: str) -> DataFrame:
    """Executions (task, status, exit_code, stdout, stderr) as memories: an error by status or exit code, with the parts of its output that are kept."""
    failed = F.coalesce(F.lower("status").isin("blocked", "error", "failed"), F.lit(False)) | (F.coalesce("exit_code", F.lit(0)) != 0)
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    return rows.select(
        *keys,
        F.when(failed, "error").otherwise("action").alias("type"),
        title_of(F.col("task"), 60).alias("title"),
        F.concat_ws("\n", F.col("task"), F.when(failed & (cut("stderr", 200) != ""), cut("stderr", 200)), F.when(cut("stdout", 500) != "", cut("stdout", 500))).alias("summary"),
    )


def artifacts(rows: DataFrame, name: str, content: str) -> DataFrame:
    """name, sha256 and the file name that carries its first twelve digits."""
    h = F.sha2(F.col(content), 256)
    return rows.select(F.col(name).alias("name"), h.alias("sha256"), F.concat(F.substring(h, 1, 12), F.lit("-"), F.col(name)).alias("file"))


def discovered_edges(hits: DataFrame, source: str, least: float = 0.3, limit: int = 3) -> DataFrame:
    """REFERENCED edges from each source to the best hits (source, kref, score) of its queries: the best score of a kref, never itself."""
    best = hits.where(F.col(source) != F.col("kref")).groupBy(source, "kref").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    return top_k(best, [source], [F.col("score").desc(), F.col("kref")], limit).select(F.col(source).alias("source"), F.col("kref").alias("target"), F.lit("REFERENCED").alias("edge_type"), "score")


def evidence_edges(votes: DataFrame) -> DataFrame:
    """SUPPORTS and CONTRADICTS edges of new memories: votes (source, supports, contradicts) are arrays of krefs; disputes carry the assessor's basis."""
    s = votes.select("source", F.explode("supports").alias("target"), F.lit("SUPPORTS").alias("edge_type"), F.lit(None).cast("string").alias("basis"))
    c = votes.select("source", F.explode("contradicts").alias("target"), F.lit("CONTRADICTS").alias("edge_type"), F.lit("evidence-assessor").alias("basis"))
    return s.unionByName(c).where("source <> target").distinct()


def profile_revisions(profiles: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New profile rows and their SUPERSEDES edges: revision numbers go on from the last one of each space."""
    last = before.groupBy("space").agg(F.max("number").alias("last"))
    new = profiles.join(last, "space", "left").withColumn("number", F.coalesce("last", F.lit(0)) + 1)
    edges = new.where("last IS NOT NULL").select(F.concat_ws("?r=", "space", F.col("number").cast("string")).alias("source"), F.concat_ws("?r=", "space", F.col("last").cast("string")).alias("target"), F.lit("SUPERSEDES").alias("edge_type"))
    return new.drop("last"), edges


def flushed(queue: DataFrame, results: DataFrame, attempts: int = 3) -> DataFrame:
    """What became of queued writes: succeeded, dropped after the last attempt or a failure that will recur, else failed and kept."""
    both = queue.join(results.select("key", "error_class"), "key", "left")
    tried = F.coalesce("attempts", F.lit(0)) + 1
    fate = F.when(F.col("error_class").isNull(), "succeeded").when((F.col("error_class") == "deterministic") | (tried >= attempts), "dropped").otherwise("failed")
    return both.withColumns({"attempts": tried, "fate": fate})


def failure_class(status: Column, message: Column) -> Column:
    """Whether a failure is transient, will recur, or can't be told: by HTTP status, else by words."""
    code = F.when(status.between(100, 599), status)
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(code.isin(408, 425, 429) | (code >= 500), "transient")
        .when(code.between(400, 499), "deterministic")
        .when(low.rlike(r"timed? ?out|connection|temporar|unavailable|rate.?limit"), "transient")
        .when(low.rlike(r"invalid|malformed|not found|unsupported|schema"), "deterministic")
        .otherwise("unknown")
    )


def pruned(ledger: DataFrame, protect: str | None = None, config: Config = DEFAULT) -> DataFrame:
    """The ledger's rows up to its size: protected and parked ones stay first, then the latest seen."""
    keep = F.when(F.col("key") == F.lit(protect), 0).when(F.col("parked_at").isNotNull(), 1).otherwise(2)
    return ledger.orderBy(keep, F.col("last_seen").desc_nulls_last(), "key").limit(config.ledger_rows)


def recorded(ledger: DataFrame, failures: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The ledger after failures (key, at, deterministic, error_class): counts add up, and a key is parked when its deterministic attempts reach the threshold."""
    new = failures.groupBy("key").agg(F.count("*").alias("n"), F.count_if("deterministic").alias("d"), F.min("at").alias("first"), F.max("at").alias("last"), F.max_by("error_class", "at").alias("error"))
    both = ledger.join(new, "key", "full")
    total = F.coalesce("deterministic_attempts", F.lit(0)) + F.coalesce("d", F.lit(0))
    return both.select(
        "key",
        (F.coalesce("attempts", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("int").alias("attempts"),
        total.cast("int").alias("deterministic_attempts"),
        F.coalesce("first_seen", "first").alias("first_seen"),
        F.coalesce("last", "last_seen").alias("last_seen"),
        F.coalesce("error", "last_error_class").alias("last_error_class"),
        F.coalesce("parked_at", F.when(total >= config.park_after, F.col("last"))).alias("parked_at"),
    )


def unparked(ledger: DataFrame, now: str, days: int = 14) -> DataFrame:
    """The ledger without rows that weren't seen for so many days."""
    return ledger.where(F.col("last_seen") >= F.expr(f"timestamp'{now}' - interval {days} days"))


def evidence_atoms(new: DataFrame, existing: DataFrame, threshold: float = 0.8, limit: int = 4) -> DataFrame:
    """Atoms (decision, pos, statement) to write: not there by slug, not near what is there, alternatives first by position, at most four a decision."""
    from ..functions.text import jaccard, tokens

    rows = new.withColumn("slug", slug(F.col("statement"))).dropDuplicates(["decision", "slug"])
    rows = rows.join(existing.select("decision", slug(F.col("statement")).alias("slug")).distinct(), ["decision", "slug"], "left_anti")
    old = existing.groupBy("decision").agg(F.collect_list(tokens(F.col("statement"))).alias("old"))
    both = rows.join(old, "decision", "left").withColumn("w", tokens(F.col("statement")))
    near = F.coalesce(F.exists("old", lambda o: jaccard(o, F.col("w")) >= threshold), F.lit(False))
    return top_k(both.where(~near), ["decision"], [F.col("pos"), F.col("slug")], limit, "nth").select("decision", "pos", "slug", "statement")


def retired(decisions: DataFrame, edges: DataFrame, marker: str) -> DataFrame:
    """Decisions with those that derive from a marker deprecated."""
    out = edges.where((F.col("target") == marker) & (F.col("edge_type") == "DERIVED_FROM")).select(F.col("source").alias("kref")).distinct().withColumn("__gone", F.lit(True))
    return decisions.join(out, "kref", "left").withColumn("deprecated", F.col("deprecated") | F.coalesce("__gone", F.lit(False))).drop("__gone")


def run_report(actions: DataFrame) -> DataFrame:
    """One row: how many proposals a run had, what was refused and why, as counts and as Markdown."""
    by = actions.groupBy(F.coalesce("refused", F.lit("applied")).alias("outcome")).agg(F.count("*").alias("n"))
    rows = by.agg(F.sum("n").alias("proposals"), F.array_sort(F.collect_list(F.struct("outcome", "n"))).alias("outcomes"))
    lines = F.transform("outcomes", lambda x: F.concat(F.lit("- "), x.outcome, F.lit(": "), x.n.cast("string")))
    return rows.select(F.coalesce("proposals", F.lit(0)).alias("proposals"), F.concat(F.lit("# Run report\n\n"), F.array_join(lines, "\n")).alias("markdown"))


def ontology_spec(spark) -> DataFrame:
    """The graph's vocabulary as rows: node kinds, edges that are walked, relations."""
    kinds = [("kind", k, str(i)) for i, k in enumerate((*KIND_PRIORITY, "entity", "action", "question"))]
    edges = [("edge", e, str(i)) for i, e in enumerate(WALKED_EDGES)]
    relations = [("relation", r, ",".join(sorted(s))) for r, s in sorted(RELATIONS.items())]
    return spark.createDataFrame(kinds + edges + relations, "part string, name string, detail string")


def once(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``insert_new`` under the name that writers use."""
    return insert_new(table, rows, keys)
