"""Transcripts, skills, queues and commits as sources."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_jsonl_transcript(spark: SparkSession, path: str) -> DataFrame:
    """session (the file), idx, role and content of a transcript of one JSON object a line: text blocks are joined, tool results and reminders left out, lines that aren't JSON skipped."""
    schema = "type string, timestamp string, message struct<role: string, content: variant>"
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("session"), F.monotonically_increasing_id().alias("at"), F.from_json("value", schema).alias("x")).where("x.message.role IS NOT NULL")
    content = F.col("x.message.content")
    plain = F.try_variant_get(content, "$", "string")
    blocks = F.try_variant_get(content, "$", "array<struct<type:string,text:string>>")
    text = F.array_join(F.transform(F.filter(blocks, lambda b: b.type == "text"), lambda b: b.text), "\n")
    shown = F.when(F.schema_of_variant(content).startswith("ARRAY"), text).otherwise(plain)
    clean = F.trim(F.regexp_replace(F.coalesce(shown, F.lit("")), r"(?s)<system-reminder>.*?</system-reminder>", ""))
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("session").orderBy("at")) - 1
    return rows.select("session", "at", F.col("x.message.role").alias("role"), clean.alias("content")).withColumn("idx", nth).where("content <> ''").drop("at")


def parse_markdown(docs: DataFrame) -> DataFrame:
    """session_id, idx, role, ts and content from (session_id, markdown): the inverse of the renderer."""
    body = F.regexp_replace("markdown", r"(?s)\A.*?\n---\n+", "")
    parts = F.filter(F.split(body, r"(?m)^### (?=(?:User|Assistant|System|Tool)$)"), lambda x: F.trim(x) != "")
    rows = docs.select("session_id", F.posexplode(parts).alias("idx", "part"))
    head, rest = F.substring_index("part", "\n", 1), F.regexp_replace("part", r"\A[^\n]*\n", "")
    ts = F.nullif(F.regexp_extract(rest, r"\A<sub>([^<]*)</sub>", 1), F.lit(""))
    content = F.regexp_replace(F.regexp_replace(rest, r"\A(?:<sub>[^<]*</sub>\n)?\n?", ""), r"\n+\z", "")
    return rows.select("session_id", F.col("idx").cast("long").alias("idx"), F.lower(head).alias("role"), ts.alias("ts"), content.alias("content"))


def read_skills(spark: SparkSession, path: str) -> DataFrame:
    """file, name, description, nth, section, level, inline and content of Markdown skills: front matter, then sections by heading."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    text = files.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("t"))
    front = F.regexp_extract("t", r"(?s)\A---\n(.*?)\n---\n", 1)
    field = lambda k: F.trim(F.regexp_extract(front, rf"(?m)^{k}:\s*(.*)$", 1))
    body = F.regexp_replace("t", r"(?s)\A---\n.*?\n---\n", "")
    parts = text.select("file", field("name").alias("name"), field("description").alias("description"), F.posexplode(F.split(body, r"(?m)^(?=#{2,6} )")).alias("nth", "part")).where(F.trim("part") != "")
    head = F.regexp_extract("part", r"\A(#{2,6}) (.*)", 2)
    return parts.select("file", "name", "description", "nth", head.alias("section"), F.length(F.regexp_extract("part", r"\A(#{2,6}) ", 1)).alias("level"), F.col("part").contains("<!-- inline -->").alias("inline"), F.trim(F.regexp_replace("part", r"\A#{2,6} [^\n]*\n", "")).alias("content"))


def read_queue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A queue of JSON lines; malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


class GitLog(DataSource):
    """``spark.read.format("gitlog").option("repo", path).option("range", "HEAD").load()``: one row per commit."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "repo string, hash string, author string, author_date string, subject string, body string, parents array<string>, files array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(self.options)


class _GitReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.repo, self.range = options["repo"], options.get("range", "HEAD")
        self.limit = int(options.get("maxcommits", "50"))
        if self.range.startswith("-"):
            raise ValueError("a revision range can't begin with a hyphen")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        def git(*args: str) -> str:
            return subprocess.run(["git", "-C", self.repo, *args], capture_output=True, text=True, timeout=20, check=True).stdout

        told = git("log", f"--max-count={self.limit}", "--format=%H%x1f%an%x1f%aI%x1f%s%x1f%b%x1f%P%x1e", self.range)
        for one in told.split("\x1e"):
            f = one.strip("\n").split("\x1f")
            if len(f) == 6:
                parents = f[5].split()
                names = git("diff", "--name-only", f"{parents[0]}..{f[0]}") if parents else git("show", "--format=", "--name-only", f[0])
                yield self.repo, f[0], f[1], f[2], f[3], f[4].strip(), parents, [x for x in names.split("\n") if x]
