import json
import subprocess

from pyspark.sql import functions as F

from engramspark.operators.sessions import markdown
from engramspark.sources import transcripts as X
from engramspark.streaming import sessions as K

SCHEMA = "session_id string, ts timestamp, content string"


def _write(path, name, rows):
    (path / name).write_text("\n".join(json.dumps(dict(zip(("session_id", "ts", "content"), r))) for r in rows))


def test_buffer_with_expiry(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    _write(src, "1.json", [("a", "2024-01-01 10:00:00", "one"), ("a", "2024-01-01 10:01:00", "two"), ("b", "2024-01-01 10:00:30", "x")])
    read = lambda: spark.readStream.schema(SCHEMA).json(str(src)).withWatermark("ts", "0 seconds")

    def run():
        q = K.buffered(read(), keep=2).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    _write(src, "2.json", [("a", "2024-01-01 10:30:00", "three")])
    run()
    _write(src, "3.json", [("c", "2024-01-01 14:00:00", "late")])
    run()
    _write(src, "4.json", [("c", "2024-01-01 14:01:00", "later")])
    run()
    rows = spark.read.parquet(str(out)).collect()
    last = {r.session_id: r for r in sorted((r for r in rows if not r.expired), key=lambda r: r["count"])}
    assert (last["a"]["count"], last["a"].last) == (3, ["two", "three"]) and last["c"]["count"] == 2
    assert {r.session_id for r in rows if r.expired} == {"a", "b"}


def test_session_window_stream(spark, tmp_path):
    _write(tmp_path, "1.json", [("a", "2024-01-01 10:00:00", ""), ("a", "2024-01-01 10:50:00", ""), ("a", "2024-01-01 12:00:00", ""), ("b", "2024-01-01 20:00:00", "")])
    s = spark.readStream.schema(SCHEMA).json(str(tmp_path)).withWatermark("ts", "0 seconds").withColumn("event_id", F.lit(1))
    q = K.sessions(s, "session_id").writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.key, r.events) for r in spark.table("sess").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_cursor_keeps_unreadable_times(spark):
    d = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-03-01 00:00:00"), (3, "?"), (4, None)], "id int, created string")
    assert sorted(r.id for r in K.since(d, "created", "2024-02-01 00:00:00").collect()) == [2, 3, 4]


def test_retry_delay():
    assert [K.retry_delay(i) for i in range(7)] == [1, 2, 4, 8, 16, 30, 30]


def test_markdown_round_trip(spark):
    m = spark.createDataFrame([("s", 0, "user", "Hi\n\nthere", "2024-01-01T00:00:00Z"), ("s", 1, "assistant", "### not a role\ntext", None)], "session_id string, idx long, role string, content string, ts string")
    got = X.parse_markdown(markdown(m)).orderBy("idx").collect()
    assert [(r.idx, r.role, r.content, r.ts) for r in got] == [(0, "user", "Hi\n\nthere", "2024-01-01T00:00:00Z"), (1, "assistant", "### not a role\ntext", None)]


def test_transcript(spark, tmp_path):
    lines = [
        {"type": "user", "message": {"role": "user", "content": "hello <system-reminder>x</system-reminder>"}},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "one"}, {"type": "tool_use", "text": "no"}, {"type": "text", "text": "two"}]}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "text": "no"}]}},
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    got = X.read_jsonl_transcript(spark, str(tmp_path / "t.jsonl")).orderBy("idx").collect()
    assert [(r.idx, r.role, r.content) for r in got] == [(0, "user", "hello"), (1, "assistant", "one\ntwo")]


def test_skills_and_queue(spark, tmp_path):
    (tmp_path / "s.md").write_text("---\nname: x\ndescription: does y\n---\nintro\n## One\n<!-- inline -->\ntext\n### Two\nmore\n")
    got = X.read_skills(spark, str(tmp_path)).orderBy("nth").collect()
    assert [(r.name, r.section, r.level, r.inline) for r in got] == [("x", "", 0, False), ("x", "One", 2, True), ("x", "Two", 3, False)]
    (tmp_path / "q.jsonl").write_text('{"a": 1}\n{bad\n{"a": 2}\n')
    assert sorted(r.a for r in X.read_queue(spark, str(tmp_path / "q.jsonl"), "a int").collect()) == [1, 2]


def test_git_source(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    for i in range(3):
        (tmp_path / f"f{i}.txt").write_text(str(i))
        git("add", ".")
        git("commit", "-q", "-m", f"change {i}", "-m", "because")
    spark.dataSource.register(X.GitLog)
    rows = spark.read.format("gitlog").option("repo", str(tmp_path)).load().collect()
    assert [(r.subject, r.body, r.files) for r in rows] == [(f"change {i}", "because", [f"f{i}.txt"]) for i in (2, 1, 0)]
