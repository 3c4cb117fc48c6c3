import re
from collections import Counter

import duckdb
import pytest

from engramspark.llm import quality as Q
from engramspark.llm.queries import OP1_SQL, QUERIES

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = W.findall(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(tri)
    cover = {i + k for i, t in enumerate(tri) if c[t] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if W.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), dup, len(cover)


def test_features_and_order(odd):
    rows = Q.quality_verdicts(odd).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        if r.doc_id in (None, 3):  # several texts
            continue
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (r.failed_rule is None) and not (r.kept and r.base_failed)


def test_verdict_does_not_depend_on_order():
    docs = ["", "a b c " * 40, "good words that differ each time " + " ".join(f"w{i}" for i in range(60)), "A " * 70, "%%% " * 60, "x\n" * 80]
    for t in docs:
        verdicts = {Q.judge(Q.Doc(t.encode()), order) is None for order in (Q.RULES, Q.RULES[::-1])}
        assert len(verdicts) == 1


def test_calibration_prefers_rejection_per_cost(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(50)], "doc_id long, text string")
    found = Q.calibrate(docs)
    assert {m.name for m in found} == {r.name for r in Q.RULES}
    assert found[0].rejected > 0 and all(a.rejected / a.cost_us >= b.rejected / b.cost_us for a, b in zip(found, found[1:]))


def test_empty_and_kept_columns(odd, none):
    assert Q.quality_verdicts(none).collect() == []
    kept = Q.keep_good(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in Q.quality_verdicts(odd).where("kept").collect())


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001"])
def test_sql(spark, d):
    got = sorted(map(tuple, QUERIES["op1_quality_rules"](spark, d).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert got == sorted(con.execute(OP1_SQL).fetchall())
