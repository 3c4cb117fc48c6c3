import datetime as dt

from pyspark.sql import functions as F

from engramspark.functions import predicates as Q
from engramspark.operators import context as C
from engramspark.operators import decisions as D
from engramspark.operators import ontology as O
from engramspark.operators import search as H
from engramspark.operators import writes as W
from engramspark.schemas import TABLES
from engramspark.sources import graph as A

T = [dt.datetime(2024, 1, i) for i in range(1, 29)]


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def revs(spark, rows):
    cols = [c.split(" ")[0] for c in TABLES["revisions"].replace("map<string,string>", "map").split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], TABLES["revisions"])


def test_scans(spark):
    s = df(spark, [("p", "", None), ("p", "a", None), ("p", "a/b", None), ("p", "ab", None), ("q", "a", None), ("p", "a", None)], TABLES["spaces"])
    assert [r.space_path for r in A.spaces_under(s, "p", "a").collect()] == ["a", "a/b"]
    assert [r.space_path for r in A.spaces_under(s, "p").collect()] == ["", "a", "ab", "a/b"]
    items = df(spark, [("i1", "p", "a", "x", "entity", False), ("i2", "p", "a", "y", "fact", False), ("i3", "p", "b", "z", "entity", True)], TABLES["items"])
    assert [r.item_kref for r in A.items_of(items, kind="entity").collect()] == ["i1"] and A.items_of(items, deprecated=True).count() == 3
    r = revs(spark, [dict(kref="i1?r=1", item_kref="i1", number=1, latest=True, metadata={"aliases": "A, B ,,"}, title="one"), dict(kref="i1?r=2", item_kref="i1", number=2, metadata={}, title="two"), dict(kref="i3?r=1", item_kref="i3", number=1)])
    (e,) = A.live_entities(items, r).collect()
    assert (e.title, e.aliases) == ("one", ["A", "B"])


def test_incremental(spark):
    items = df(spark, [(f"i{k}", "p", "a", "x", "space-profile" if k == 4 else "fact", k == 5) for k in range(6)], TABLES["items"])
    r = revs(spark, [dict(kref=f"i{k}?r=1", item_kref=f"i{k}", number=1, created_at=None if k == 1 else T[k + 2]) for k in range(6)])
    ledger = df(spark, [("i3", 2, 2, None, None, None, T[0]), ("i2", 1, 1, None, None, None, None)], TABLES["ledger"])
    got = A.fresh_revisions(items, r, ledger, "2024-01-03 12:00:00").collect()
    assert sorted(x.item_kref for x in got) == ["i1", "i2"]  # no time; after; parked, profile and deprecated ones aren't read


def test_projection_and_sources(spark):
    r = revs(spark, [dict(kref="k1", item_kref="kref://p/a/b/x.fact", number=1, title="t")])
    art = df(spark, [("k1", "b.md", "/b", "B"), ("k1", "a.md", "/a", "A")], "kref string, name string, location string, text string")
    (x,) = A.recall_projection(r, art).collect()
    assert (x.space, x.artifact_name, x.content) == ("a/b", "a.md", "A") and "content" not in A.recall_projection(r).columns
    s = A.first_source(df(spark, [("a", 1)], "session_id string, n int"), df(spark, [("a", 2), ("b", 3), ("b", 4)], "session_id string, n int"))
    assert sorted(map(tuple, s.collect())) == [("a", 1), ("b", 3), ("b", 4)]
    commits = df(spark, [("abcdef0123" * 4,), ("abcdef0999" * 4,)], "hash string")
    got = A.known_shas(df(spark, [("abcdef01",), ("abcdef0",), ("1234567",), ("hello",)], "token string"), commits).collect()
    assert [(g.token, g.hash[:10]) for g in got] == [("abcdef01", "abcdef0123")]


def test_known_shas_makes_no_row_of_every_prefix(spark):
    commits = df(spark, [("abcdef0123" * 4,), ("abcdef0123" * 4,), ("abcdef0999" * 4,), ("abcdef0",)], "hash string")
    got = A.known_shas(df(spark, [("abcdef01" + "2",), ("abcdef0999" * 4,), ("abcdef0",), ("abcdef01x",)], "token string"), commits)
    assert sorted((g.token[:10], g.hash[:10]) for g in got.collect()) == [("abcdef012", "abcdef0123"), ("abcdef0999", "abcdef0999")]
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_failure_class_of_halves(spark, tmp_path):
    """408.5 is 408 and 424.5 is 424, as in a cast of SQL."""
    from engramspark import plans

    df(spark, [(1, 408.5, "view"), (2, 424.5, "view"), (3, 407.5, "view"), (4, 425.5, "view")], "event_id long, value double, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = plans.QUERIES["failure_classes"](spark, str(tmp_path)).orderBy("event_id").collect()
    assert [r["class"] for r in got] == ["transient", "deterministic", "transient", "deterministic"]


def test_verbatim_in_capitals_that_are_several_letters(spark):
    rows = [("STRASSE IM", "auf die straße im tal"), ("TAL STRASSE", "auf die straße im tal"), ("DIE STRASE IM TAL", "auf der straße am tag")]
    got = df(spark, rows, "a string, b string").select(D.verbatim(F.col("a"), F.col("b")).alias("v")).collect()
    assert [r.v for r in got] == [True, True, False]


def test_supersede_candidates_brute(spark):
    """By sets that meet, not by all pairs of an anchor."""
    import random

    r = random.Random(11)
    text = lambda: " ".join(f"word{r.randrange(14)}" for _ in range(r.randint(1, 9)))
    rows = [(i, r.sample("fgh", r.randint(1, 2)), r.randrange(6), text(), r.choice((None, "word1 word2", "word3 word4 word5"))) for i in range(70)]
    new, old = (df(spark, x, "id int, anchors array<string>, decided_at int, text string, hint string") for x in (rows[:45], rows[25:]))
    j = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    w = lambda t: set((t or "").split())
    want = {(a[0], b[0], j(w(a[3]), w(b[3]))) for a in rows[:45] for b in rows[25:] if set(a[1]) & set(b[1]) and a[0] != b[0] and b[2] < a[2] and j(w(a[3]), w(b[3])) >= (0.35 if j(w(a[4]), w(b[3])) >= 0.2 else 0.5)}
    got = D.supersede_candidates(new, old)
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(s < 0.5 for _, _, s in want)
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()


def _plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_sources_about_counts_no_other_edges(spark):
    edges = df(spark, [("a", "e", "ABOUT"), ("b", "e", "ABOUT"), ("c", "f", "ABOUT"), ("c", "a", "SUPPORTS"), ("a", "a", "SUPPORTS"), ("x", "e", "ABOUT")], "source string, target string, edge_type string")
    got = D.about_sources(edges, df(spark, [("a", "fact"), ("b", "fact"), ("x", "other")], "kref string, kind string"), "e", "fact")
    assert sorted((r.kref, r.edges) for r in got.collect()) == [("a", 4), ("b", 1)]
    assert _plan(got).count("LeftSemi") > 1


def test_symbol_bridges_by_parts_of_decisions(spark):
    decisions = df(spark, [(1, ["Big Thing"], "a red fox"), (1, ["Big Thing"], "a red fox"), (2, ["no"], "red, red"), (3, [], "big thing")], "id int, symbols array<string>, text string")
    got = D.symbol_bridges(decisions, df(spark, [("big-thing", "Red Fox"), ("big-thing", "Red Fox"), ("r", "red"), ("s", "Red"), ("t", "")], "slug string, name string"))
    assert sorted((r.id, r.slug) for r in got.collect()) == [(1, "big-thing"), (1, "r"), (1, "s"), (2, "r"), (2, "s")]
    assert "Repartition" in _plan(got)


def test_key_tokens_look_stop_words_up(spark):
    from engramspark.functions import text as T

    docs = df(spark, [(1, "The fox and a x1 FOX, y the den")], "i int, t string")
    got = docs.select(T.key_tokens(F.col("t")).alias("w"))
    assert got.first().w == ["fox", "x1", "fox", "den"] and "array_contains" not in _plan(got)
    score = docs.select(T.overlap_score(F.array(F.lit("fox"), F.lit("den"), F.lit("no")), T.key_tokens(F.col("t"))).alias("s")).first().s
    assert abs(score - (1.0986122887 + 0.6931471806) / 4) < 1e-9


def test_bm25_cuts_texts_once(spark):
    docs = df(spark, [(1, "the quick brown fox"), (2, "red fox"), (3, "")], "id int, t string")
    few = df(spark, [(1, "a fox"), (2, "red")], "query_id int, query string")
    many = few.unionByName(spark.range(2000).select(F.lit(3).alias("query_id"), F.concat(F.lit("w"), "id").alias("query")))
    one, two = (H.bm25(docs, q, "id", "t") for q in (few, many))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and one.count() == 3
    assert "regexp_extract_all(lower(t" not in _plan(one)


def test_predicates(spark):
    r = spark.range(1).select(
        Q.evidence_tag(F.lit("official")).alias("a"), Q.quarantined(F.create_map(F.lit("quarantined"), F.lit("true"))).alias("b"), Q.earns_discovery(F.lit("fact")).alias("c"), Q.earns_discovery(F.lit("synthesis")).alias("d"),
        Q.channel_space(F.lit("team_channel"), F.lit("P"), F.lit(""), F.lit("")).alias("e"), Q.policy_tags(F.array(F.lit("published"), F.lit("x"), F.lit("evidence:official"))).alias("f"), Q.protected(F.array(F.lit("published"))).alias("g"),
    ).first()
    assert tuple(r) == ("evidence:official", True, False, True, "P/work/default", ["published", "evidence:official"], True)


def test_ontology(spark):
    rows = df(spark, [("c", ["Ada Lovelace", "ada lovelace", "Engine"], ["Ada Lovelace wrote it", "nobody"], [f"q {i}" for i in range(30)])], "conv string, entity array<string>, fact array<string>, question array<string>")
    nodes = O.typed_nodes(rows, "conv").cache()
    assert {(r.kind, r.slug) for r in nodes.collect() if r.kind == "entity"} == {("entity", "ada-lovelace"), ("entity", "engine")}
    assert nodes.where("kind = 'question'").count() == 20
    assert [(r.slug, r.entity) for r in O.mention_edges(nodes).collect()] == [("ada-lovelace-wrote-it", "ada-lovelace")]
    ents = df(spark, [("ibm", ["Big Blue"]), ("big-red", ["Red"])], "slug string, aliases array<string>")
    got = {r.surface: r.hub for r in O.resolved_aliases(df(spark, [("big blue",), ("IBM",), ("New",)], "surface string"), ents).collect()}
    assert got == {"big blue": "ibm", "IBM": "ibm", "New": "new"}
    claims = df(spark, [("a", "b", "SUPERSEDES"), ("a", "a", "SUPERSEDES"), ("a", "zz", "SUPERSEDES"), ("a", "kref://x", "CONTRADICTS"), ("a", "old one", "CONTRADICTS")], "source string, target_text string, edge_type string")
    got = O.belief_edges(claims, df(spark, [("a",), ("b",)], "slug string"), df(spark, [("old-one", "kref://old")], "slug string, kref string"))
    assert sorted((r.target, r.found) for r in got.collect()) == [("b", "call"), ("kref://old", "graph"), ("kref://x", "kref")]


def test_decisions(spark):
    a = D.verbatim(F.lit("THE  quick fox"), F.lit("see the quick\nfox run"))
    b = D.verbatim(F.lit("alpha beta gamma delta"), F.lit("gamma of alpha and beta"))
    c = D.verbatim(F.lit("alpha beta gamma delta"), F.lit("alpha only"))
    assert tuple(spark.range(1).select(a, b, c).first()) == (True, True, False)
    rows = df(spark, [("t", "low", ["x.py"], []), ("u", "high", ["made-up.py"], ["token = 'abcdefgh1'", "fine"]), ("Bearer abc", "high", [], [])], "title string, confidence string, anchors array<string>, evidence array<string>")
    got = D.screened_decisions(rows, F.array(F.lit("a.py"), F.lit("x.py"))).collect()
    assert [(r.title, r.anchors, r.evidence) for r in got] == [("u", ["a.py", "x.py"], ["fine"])]
    old = df(spark, [(1, ["f"], 5, "cache results in memory", None), (2, ["f"], 9, "cache results in memory", None), (3, ["g"], 1, "cache results in memory", None)], "id int, anchors array<string>, decided_at int, text string, hint string")
    new = df(spark, [(9, ["f"], 9, "cache the results on disk", "memory cache results")], "id int, anchors array<string>, decided_at int, text string, hint string")
    assert [(r.newer, r.older) for r in D.supersede_candidates(new, old).collect()] == [(9, 1)]
    g = D.grounded_by_index(df(spark, [("c", "d", [1, 7])], "conv string, decision string, based_on array<int>"), df(spark, [("c", 1, "f")], "conv string, pos int, fact string"))
    assert [tuple(r) for r in g.collect()] == [("d", "f", "DEPENDS_ON")]


def test_correlation_tiers(spark):
    found = df(spark, [(1, "s", "cache results in memory today", T[10], ["lru"])], "finding int, session string, text string, at timestamp, symbols array<string>")
    cols = "finding int, target string, target_session string, target_text string, target_at timestamp, target_symbols array<string>, deprecated boolean"
    sha = df(spark, [(1, "d1", "s", "cache results in memory", T[9], [], False), (1, "d2", None, "nothing alike", T[9], [], False)], cols)
    file = df(spark, [(1, "d3", None, "cache results in a store", T[9], ["lru"], False), (1, "d4", None, "cache results in memory today", T[27], ["lru"], False), (1, "d5", None, "cache results in memory today", T[9], [], True)], cols)
    assert [(r.target, r.tier) for r in D.correlated_targets(found, sha, file).collect()] == [("d3", 2)]


def test_writes(spark):
    hits = df(spark, [("a", "a", 0.9), ("a", "b", 0.2), ("a", "b", 0.5), ("a", "c", 0.1)], "s string, kref string, score double")
    assert [(r.target, r.score) for r in W.discovered_edges(hits, "s").collect()] == [("b", 0.5)]
    new, edges = W.profile_revisions(df(spark, [("x",), ("y",)], "space string"), df(spark, [("x", 3)], "space string, number int"))
    assert sorted((r.space, r.number) for r in new.collect()) == [("x", 4), ("y", 1)] and [(r.source, r.target) for r in edges.collect()] == [("x?r=4", "x?r=3")]
    atoms = W.evidence_atoms(df(spark, [("d", 0, "we measured ten percent faster loads"), ("d", 1, "We measured ten percent faster loads!"), ("d", 2, "users asked for it")], "decision string, pos int, statement string"), df(spark, [("d", "users asked for it")], "decision string, statement string"))
    assert [r.pos for r in atoms.collect()] == [0]
    led = df(spark, [(f"k{i}", 1, 1, None, T[i], None, T[0] if i == 0 else None) for i in range(5)], TABLES["ledger"])
    from engramspark.schemas import Config

    assert sorted(r.key for r in W.pruned(led, "k1", Config(ledger_rows=3)).collect()) == ["k0", "k1", "k4"]
    assert sorted(r.key for r in W.unparked(led, "2024-01-17 00:00:00", 14).collect()) == ["k2", "k3", "k4"]
    gone = W.retired(df(spark, [("d", False), ("e", False)], "kref string, deprecated boolean"), df(spark, [("d", "m", "DERIVED_FROM"), ("e", "m", "ABOUT")], "source string, target string, edge_type string"), "m")
    assert {r.kref: r.deprecated for r in gone.collect()} == {"d": True, "e": False}


def test_contexts(spark):
    rows = df(spark, [("g", i, "x" * 10) for i in range(5)], "k string, o int, b string")
    assert [r.o for r in C.blocks_within(rows, "k", "o", "b", 34).orderBy("o").collect()] == [0, 1, 2]
    assert [r.o for r in C.blocks_within(rows, "k", "o", "b", 3).collect()] == [0]
    parts = df(spark, [("g", "regular", 0.1 * i, i) for i in range(5)] + [("g", "fact", 0.1 * i, 10 + i) for i in range(4)], "k string, p string, s double, i int")
    assert C.composed(parts, "k", "p", "s", "i", top=3).count() == 5 and C.composed(parts, "k", "p", "s", "i", top=0).count() == 9
    kept = C.with_primary(df(spark, [("i", 2)], "item string, id int"), df(spark, [("i", 1), ("j", 3)], "item string, id int"), "item", "id")
    assert sorted(map(tuple, kept.collect())) == [("i", 1), ("i", 2)]


def test_bm25(spark):
    docs = df(spark, [(1, "red fox fox"), (2, "red dog"), (3, "blue sea"), (4, None)], "id int, t string")
    got = H.bm25(docs, df(spark, [(1, "a fox"), (2, "red")], "query_id int, query string"), "id", "t").orderBy("query_id", F.desc("score")).collect()
    assert [(r.query_id, r.id) for r in got] == [(1, 1), (2, 2), (2, 1)]
    vec = df(spark, [(1, 3, 0.9)], "query_id int, id int, score double")
    assert [(r.id, r.score_method) for r in H.hybrid(df(spark, [(1, 1, 2.0)], "query_id int, id int, score double"), vec, 5).orderBy("rank").collect()] == [(1, "fulltext"), (3, "vector")]
