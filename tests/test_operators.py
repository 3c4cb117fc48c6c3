import random

import pytest
from pyspark.sql import functions as F

from engramspark.operators import graph as G
from engramspark.operators import maintenance as U
from engramspark.operators import ranking as R
from engramspark.operators import sessions as S
from engramspark.operators import similarity as J


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_weights_are_idempotent_and_noop(spark):
    d = df(spark, [(1, 0.5, "official", "g"), (2, 0.6, None, "g"), (3, 0.5, None, "h")], "id int, base_score double, evidence_level string, k string")
    once = R.evidence_weighted(d, ["k"])
    assert {r.id: r.score for r in once.collect()} == {1: 0.65, 2: 0.6, 3: 0.5}
    assert sorted(map(str, R.evidence_weighted(once, ["k"]).collect())) == sorted(map(str, once.collect()))


def test_fusion_of_constants(spark):
    d = df(spark, [("q", 0.5, 0.1), ("q", 0.5, 0.9), ("p", 0.3, None)], "k string, a double, b double")
    assert sorted((r.k, round(r.fused, 6)) for r in R.fused(d, ["k"], "a", "b").collect()) == [("p", 0.3), ("q", 0.0), ("q", 0.6)]


def test_mmr(spark):
    d = df(spark, [("q", 1, 1.0, "red fox"), ("q", 2, 0.95, "red fox"), ("q", 3, 0.7, "blue sea"), ("q", 4, None, "x")], "q string, id int, s double, t string")
    got = [r.id for r in R.diversified(d, "q", "id", "s", "t", 4).orderBy("mmr_rank").collect()]
    assert got == [1, 2, 3, 4] or got == [1, 3, 2, 4]
    assert [r.id for r in R.diversified(d, "q", "id", "s", "t", 4, lam=0.3).orderBy("mmr_rank").collect()] == [1, 3, 2, 4]


def test_similar_pairs_brute(spark):
    r = random.Random(3)
    sets = [[f"w{r.randrange(12)}" for _ in range(r.randint(1, 8))] for _ in range(80)]
    rows = [(i, i % 2, sorted(set(s))) for i, s in enumerate(sets)]
    rep = {i: min(j for j, h, u in rows if h == g and u == w) for i, g, w in rows}
    for t in (0.4, 0.6, 0.75, 1.0):
        got = [(x.a, x.b) for x in J.similar_pairs(df(spark, rows, "id int, g int, w array<string>"), "id", "w", t, ["g"]).collect()]
        near = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) >= t  # noqa: B023, E731
        want = {(a, b) for a, g, u in rows for b, h, v in rows if a < b and g == h and rep[a] == a and rep[b] == b and near(u, v)} | {(rep[i], i) for i, _, _ in rows if rep[i] != i}
        assert set(got) == want and len(got) == len(want)


def test_similar_pairs_of_many_blocks(spark, monkeypatch):
    """Sets of all sizes, cut into many blocks; and nothing that is written has more rows than there are sets."""
    r = random.Random(5)
    base = [[f"w{int(40 * r.random() ** 2)}" for _ in range(r.choice((1, 2, 5, 20, 60)))] for _ in range(60)]
    sets = [{w if r.random() < 0.85 else f"w{r.randrange(60)}" for w in r.choice(base)} for _ in range(150)]
    rows = [(i, "p" if i % 4 else "q", sorted(s)) for i, s in enumerate(sets)]
    tables, kept = [], J.written
    monkeypatch.setattr(J, "written", lambda d, name: tables.append(kept(d, name)) or tables[-1])
    monkeypatch.setattr(J, "_BLOCK", 150, raising=False)
    monkeypatch.setattr(J, "_AT_ONCE", 500, raising=False)
    rep = {i: min(j for j, h, u in rows if h == g and u == w) for i, g, w in rows}
    for t in (0.5, 0.82):
        got = {(x.a, x.b): x.similarity for x in J.similar_pairs(df(spark, rows, "id int, g string, w array<string>"), "id", "w", t, ["g"]).collect()}
        own = [(i, g, set(u)) for i, g, u in rows if rep[i] == i]
        want = {(a, b): len(u & v) / len(u | v) for a, g, u in own for b, h, v in own if a < b and g == h and len(u & v) / len(u | v) >= t}
        assert got == want | {(rep[i], i): 1.0 for i, _, _ in rows if rep[i] != i}
        assert max(x.count() for x in tables) <= max(len(rows), len(got))


def test_duplicate_candidates_meet_without_texts(spark):
    rows = df(spark, [(1, "g", "the cache is kept in memory"), (2, "g", "cache the is kept in memory"), (3, "g", "the cache is not kept in memory"), (4, "g", "in memory the cache is kept")], "id int, g string, body string")
    got = U.duplicate_candidates(rows, "id", "body", 0.7, ["g"])
    assert sorted((r.a, r.b) for r in got.collect()) == [(1, 2), (1, 4)]
    assert "body" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_expand_first_discovery(spark):
    edges = df(spark, [(1, 9, "REFERENCED"), (2, 9, "SUPERSEDES"), (9, 1, "CONTRADICTS"), (1, 2, "SUPPORTS"), (3, 8, "NOT_WALKED")], "source int, target int, edge_type string")
    seeds = df(spark, [(1, 1), (2, 2), (3, 3)], "node int, seed_rank int")
    (r,) = G.expand(seeds, edges).collect()
    assert (r.reached, r.from_node, r.edge_type, r.direction, r.score) == (9, 1, "CONTRADICTS", "in", 0.0)


def test_chain_depth_with_cycle(spark):
    e = df(spark, [(i, i - 1) for i in range(1, 25)] + [(100, 101), (101, 100), (50, 50)], "newer_id int, older_id int")
    got = {r.newer_id: r.depth for r in G.chain_depth(e).collect()}
    assert got[3] == 3 and got[24] == 10 and got[100] == 10 and 50 not in got


def test_bridges_second_best(spark):
    hits = df(spark, [(0, 1, 0.9), (0, 2, 0.5), (1, 3, 0.4), (1, 1, 0.0)], "angle int, memory_id int, score double")
    about = df(spark, [(1, 7), (2, 7), (3, 7), (1, 8)], "memory_id int, entity_id int")
    (r,) = G.bridges(hits, about).collect()
    assert (r.entity_id, r.link, r.angles) == (7, 0.4, 2)


def test_guard_order(spark):
    d = df(spark, [(1, None, "official", "long enough reason", True), (2, 9, "official", "long enough reason", True), (3, 9, "corroborated", "short", None), (4, 9, "corroborated", "long enough reason", True), (5, 9, None, None, None)], "id int, age int, level string, reason string, ref boolean")
    got = {r.id: r.x for r in d.select("id", U.guard(F.col("age"), F.col("level"), F.col("reason"), F.col("ref")).alias("x")).collect()}
    assert got == {1: "min_age", 2: "evidence", 3: "evidence", 4: "reference", 5: None}


def test_budget_is_never_zero(spark):
    d = spark.range(3)
    assert U.budgeted(d, [F.col("id")], 0.1).count() == 1


def test_merge_map_and_repoint(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 30)] + [(100, 105), (105, 103)] + [(200, x) for x in r.sample(range(201, 260), 20)]
    got = {x.node: x.root for x in U.merge_map(df(spark, pairs, "a int, b int")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[103] == 100 and set(v for k, v in got.items() if k >= 200) == {200}
    edges = df(spark, [(1, 5, "X"), (2, 5, "X"), (1, 2, "X"), (900, 105, "X")], "source int, target int, edge_type string")
    out = U.repointed(edges, df(spark, list(got.items()), "node int, root int")).collect()
    assert [tuple(x) for x in out] == [(900, 100, "X")]


def test_insert_is_idempotent(spark):
    table, rows = df(spark, [(1, "a")], "k int, v string"), df(spark, [(1, "b"), (2, "c"), (2, "c")], "k int, v string")
    new = U.insert_new(table, rows, ["k"])
    assert [tuple(r) for r in new.collect()] == [(2, "c")]
    assert U.insert_new(table.union(new), rows, ["k"]).count() == 0


def test_slug_collisions(spark):
    rows = df(spark, [("s", 1, "use postgres for storage"), ("s", 2, "use postgres for the storage"), ("s", 3, "paint walls green")], "base string, id int, t string")
    assert {r.id: r.slug for r in U.slugs_guarded(rows, "base", "id", "t").collect()} == {1: "s", 2: "s", 3: "s-2"}


def test_regrade_only_lifts(spark):
    d = df(spark, [(1, "unverified"), (2, "corroborated"), (3, "official"), (4, None)], "id int, level string")
    e = df(spark, [(1, True), (2, False), (3, False), (4, False)], "id int, strong boolean")
    assert {r.id: r.proposed for r in U.regraded(d, e).collect()} == {1: "corroborated", 4: "single_source"}


def test_tracked_path(spark):
    t = df(spark, [("src/a.py",), ("lib/a.py",), ("src/b.py",), ("a.py",)], "file string")
    p = df(spark, [("a.py",), ("b.py",), ("src/a.py",), ("y.py",)], "path string")
    assert {r.path: r.resolved for r in G.tracked_path(p, t).collect()} == {"a.py": "a.py", "b.py": "src/b.py", "src/a.py": "src/a.py", "y.py": ""}


@pytest.mark.parametrize("text, want", [("We decided to use it", 3), ("why not `x` and `y`?", 5), ("took 30 ms", 2), ("see src/main.py and 0123abc", 3), ("hello", 0)])
def test_salience(spark, text, want):
    assert spark.range(1).select(S.base_salience(F.lit(text)).alias("s")).first().s == want


def test_assent_depends_on_the_score_before(spark):
    m = df(spark, [("s", 0, "assistant", "why not `x`"), ("s", 1, "user", "yes"), ("s", 2, "user", "go ahead with `a` and decided"), ("s", 3, "user", "yes")], "session_id string, idx long, role string, content string")
    assert [r.score for r in S.salience(m).orderBy("idx").collect()] == [4, 1, 4, 1]


def test_selection_and_chunks(spark):
    m = df(spark, [("s", i, "user", "x" * 5000, 3 if i == 10 else 0) for i in range(20)], "session_id string, idx long, role string, content string, score int")
    got = S.selected(m).orderBy("idx").collect()
    assert [r.idx for r in got] == [0, 1, 9, 10, 11, 17, 18, 19] and [r.elided for r in got] == [0, 0, 7, 0, 0, 5, 0, 0]
    c = S.chunks(m).collect()
    assert len({r.chunk for r in c}) == 6 and {0, 19} <= {r.idx for r in c} and 10 in {r.idx for r in c}


def test_prefilter(spark):
    long = "I always use the same long set of tools for this kind of work, and more."
    m = df(spark, [("a", 0, "user", long), ("b", 0, "user", long), ("b", 1, "user", "thanks!"), ("c", 0, "user", "I always use it"), ("d", 0, "user", "The weather was quite nice on the coast the other day, was it.")], "session_id string, idx long, role string, content string")
    assert {r.session_id: r.candidate for r in S.worth_storing(m).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_commit_filter(spark):
    def f(parents, subject, body, *files):
        arr = lambda x: F.array(*(F.lit(i) for i in x)).cast("array<string>")
        return spark.range(1).select(S.commit_filter(arr(parents), F.lit(subject), F.lit(body), arr(files)).alias("r")).first().r

    assert f("ab", "Merge branch", "", "a.py") == "merge" and f("ab", "Merge branch", "why", "a.py") is None
    assert f("a", "a long subject here", "", "x/yarn.lock", "dist/a.py") == "generated_files"
    assert f("a", "Bump version to 1.2", "", "a.py") == "version_bump"
    assert f("a", "fix it", "") == "trivial" and f("a", "fix it", "", "a.py") is None


def test_about_edges_of_late_mentions(spark, tmp_path):
    """An entity is found wherever a message names it."""
    from engramspark import plans

    late = "words that say nothing " * 10 + "and then Grenoble at last"
    rows = [(1, 0, "user", "Where is Lyon"), (1, 1, "assistant", late)]
    df(spark, rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.kind, r.entity) for r in plans.QUERIES["decompose_about_edges"](spark, str(tmp_path)).collect()}
    assert ("fact", "grenoble") in got and ("question", "lyon") in got


def test_merge_map_of_a_long_path(spark):
    path = [1, *range(100, 1, -1)]
    pairs = [*zip(path, path[1:]), (500, 500)]
    got = {x.node: x.root for x in U.merge_map(df(spark, pairs, "a int, b int")).collect()}
    assert got == {i: 1 for i in path} | {500: 500}


def test_collapse_without_budget(spark):
    pairs = df(spark, [("s", 2 * i, 2 * i + 1, 0.9) for i in range(50)], "space string, a int, b int, similarity double")
    assert U.collapse(pairs, "space").count() == 50 and U.collapse(pairs, "space", 7).count() == 7
