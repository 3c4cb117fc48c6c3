"""SimHash near-duplicates by multi-index hashing.

A fingerprint is the bitwise majority over the XXH64 hashes of a text's 3-word shingles. Two fingerprints link if at most
two bits differ. Of two halves, either the high ones differ in at most one bit or the low ones are equal: so the high half is
looked up with all values of its Hamming ball of radius 1, the low half as it is, and complete distances are verified. Of
two high halves that differ in one bit, only the one with the bit set looks up the other, and a pair that the high half
finds isn't taken from the low half, so each pair is met once.

Equal texts, and all texts of one fingerprint, are one node before anything is joined. A half that more than ``hot``
fingerprints share is not joined within itself: its fingerprints look up all values of their complete Hamming balls of
radius 2 instead, by whole fingerprints, which finds the same links with no key that repeats. Links make components by large
and small stars.

A text of which every thirtieth word was changed is ten bits away, out of reach of any ball. ``without_copies`` therefore
looks a second time at the one document that it keeps of each component: segments, runs of some seven words whose ends the
words themselves decide, are fingerprinted too, and documents are linked that have ``share`` of the longer one's distinct
segments in common. Within a segment no pairs are made: each of its documents is held against the segment's first under
each of three orders, so copies of one text, thousands of them, all meet the same few; what is left meets again.

Edge cases: a null or empty text, or one of spaces, has fingerprint 0 and links like any other; a text of one or two words
is one shingle; repeated rows are separate documents of equal fingerprint; null doc_ids are kept, and a component is named
by its smallest doc_id (null if it has none); an empty table gives an empty result; columns other than ``doc_id`` and
``text`` are ignored (by ``without_copies``, kept).
"""

from __future__ import annotations

import zlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, bytes_of, fresh, remove, written

SEED, DISTANCE = 42, 2


def fingerprint(raw: bytes) -> int:
    """The unsigned fingerprint of a text's UTF-8 bytes."""
    words = raw.lower().split()  # of bytes: A-Z alone, and the six ASCII spaces
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < 3:
        return h(b" ".join(words), SEED)
    hashes = np.array([h(s, SEED) for s in map(b" ".join, zip(words, words[1:], words[2:]))], "<u8")
    ones = np.zeros(64, "<i8")
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="<i8")
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def segments(raw: bytes, every: int = 6, least: int = 3) -> list[int]:
    """The fingerprints of a text's distinct segments, signed. A segment ends at a word whose hash is divisible by ``every``, after ``least`` words at the earliest; case and punctuation at the ends of words don't count."""
    words = [w.strip(b".,;:!?\"'()") for w in raw.lower().split()]
    h, found, at = xxhash.xxh64_intdigest, set(), 0
    for i, w in enumerate(words, 1):
        if i - at >= least and not zlib.crc32(w) % every:
            found.add(h(b" ".join(words[at:i]), SEED))
            at = i
    if at < len(words):
        found.add(h(b" ".join(words[at:]), SEED))
    return [x - (1 << 64) if x >> 63 else x for x in sorted(found)]


def fingerprints(docs: DataFrame, parts: bool = False) -> DataFrame:
    """doc_id, text_hash (64 bits) and fp (the fingerprint as a signed long) of each row, with ``parts`` also the fingerprints of its segments. No shuffle."""

    def each(b):
        raws = b.column(2).to_pylist()
        out = {"doc_id": b.column(0), "text_hash": b.column(1), "fp": np.array([fingerprint(x) for x in raws], "<u8").view("<i8")}
        return out | ({"parts": [segments(x) for x in raws]} if parts else {})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), bytes_of().alias("raw")), each, f"doc_id {kind}, text_hash long, fp long" + ", parts array<long>" * parts)


def _differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, hot: int = 8192) -> DataFrame:
    """All pairs (a, b) of different fingerprints of ``fps`` (fp, distinct) that differ in one or two bits, each once."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    sides = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("half"), high.alias("key")), F.struct(F.lit(1).alias("half"), low.alias("key")))).alias("k")).select("fp", "k.half", "k.key")
    crowded = written(sides.groupBy("half", "key").count().where(F.col("count") > hot).select("half", "key"), "crowded")
    any_crowded = bool(crowded.head(1))
    set_bits = F.filter(F.array(*(F.lit(1 << i).cast("long") for i in range(32))), lambda bit: high.bitwiseAND(bit) != 0)
    balls = fps.select("fp", F.explode(F.array_append(F.transform(set_bits, lambda bit: high.bitwiseXOR(bit)), high)).alias("key"))
    highs, lows = sides.where("half = 0"), sides.where("half = 1")
    if any_crowded:
        highs, lows = (x.join(crowded, ["half", "key"], "left_anti") for x in (highs, lows))
    near = balls.select(F.col("fp").alias("a"), "key").join(highs.select(F.col("fp").alias("b"), "key"), "key").where(_differing("a", "b").between(1, DISTANCE))
    # equal high halves meet from both ends
    near = near.where((F.shiftrightunsigned("a", 32) != F.shiftrightunsigned("b", 32)) | (F.col("a") < F.col("b"))).select("a", "b")
    same = lows.select(F.col("fp").alias("a"), "key").join(lows.select(F.col("fp").alias("b"), "key"), "key").where((F.col("a") < F.col("b")) & (_differing("a", "b") == DISTANCE)).select("a", "b")
    out = near.unionByName(same.where(F.bit_count(F.shiftrightunsigned("a", 32).bitwiseXOR(F.shiftrightunsigned("b", 32))) == DISTANCE))
    if any_crowded:
        members = sides.join(crowded, ["half", "key"], "left_semi").select("fp").distinct()
        bits = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
        flips = bits + [x ^ y for i, x in enumerate(bits) for y in bits[i + 1 :]]
        table = fps.sparkSession.createDataFrame([(flips,)], "flips array<long>")  # 2,080 numbers, whatever the input
        around = members.join(F.broadcast(table)).select(F.col("fp").alias("a"), F.explode("flips").alias("flip")).select("a", F.col("a").bitwiseXOR(F.col("flip")).alias("fp"))
        whole = around.join(fps, "fp").select("a", F.col("fp").alias("b"))
        out = out.unionByName(whole).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return out


def components(edges: DataFrame) -> DataFrame:
    """node and root for every node of ``edges`` (a, b, each once, a != b): roots are the components' smallest nodes.

    Alternating large and small stars: each round hangs neighbours on the smallest node around, and rows that a round
    makes are written, so lineage stays short. A round shuffles each edge twice; hubs are aggregated before they are shuffled.
    """
    now, state = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star"), None
    while True:
        # large star: larger neighbours hang on the least of the neighbourhood
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: a node and its smaller neighbours hang on the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        now = written(small, "star")
        r = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not r.n or state == (r.n, r.h):
            break
        state = (r.n, r.h)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, hot: int = 8192) -> DataFrame:
    """doc_id, text_hash, fp, n_near, component_id and root of each row of ``docs``; component_id is the smallest doc_id that links lead to, root a fingerprint that is the component's own."""
    return grouped(written(fingerprints(docs), "fingerprints"), hot)


def grouped(rows: DataFrame, hot: int = 8192) -> DataFrame:
    """``near_duplicates`` from ``fingerprints``."""
    nodes = written(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "nodes")
    pairs = written(links(nodes.select("fp"), hot), "links")
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.join(nodes.select(F.col("fp").alias("b"), F.col("n").alias("m")), "b").groupBy("a").agg(F.sum("m").alias("near"))
    roots = components(pairs)
    least = roots.join(nodes, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least").alias("component"))
    named = roots.join(least, "root").select(F.col("node").alias("fp"), "root", "component")
    facts = nodes.join(near.withColumnRenamed("a", "fp"), "fp", "left").join(named, "fp", "left")
    facts = facts.select("fp", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return rows.join(facts, "fp").select("doc_id", "text_hash", "fp", "n_near", "component_id", "root")


def contract(found: DataFrame) -> DataFrame:
    """The columns of the ``op9`` contract."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


#: Added to nodes by exclusive or, they make other orders.
_ORDERS = (0, 0x5DEECE66D1234567, -0x61C8864680B583EB)


def segment_links(texts: DataFrame, share: float = 0.45, least: int = 8) -> DataFrame:
    """Pairs (a, b) of nodes of ``texts`` (node, parts; distinct) that have at least ``share`` of the longer one's segments in common. Nodes of fewer than ``least`` segments have no links.

    In rounds: each node is held against the first nodes of its segments, and the later node of every pair found leaves, until
    no pair is found. So all that is left of many copies of one text meets again, and no round makes pairs within a segment.
    A pair that wasn't close stays so unless a segment gets another first; so from the second round on, only the nodes of
    segments that lost one of their firsts are held against theirs again.
    """
    rows = texts.select("node", F.size("parts").alias("n"), "parts").where(F.col("n") >= least)
    each = rows.select("node", F.explode("parts").alias("part"))
    shared = each.groupBy("part").agg(F.count("*").alias("times")).where("times > 1").select("part")
    sizes = rows.select("node", "n")
    each = _promising(written(each.join(shared, "part", "left_semi"), "parts"), sizes, share)
    sizes = written(sizes.join(each.select("node").distinct(), "node", "left_semi"), "sizes")
    orders = [F.min(F.col("node").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x)) for x in _ORDERS]

    def firsts_of(each: DataFrame) -> DataFrame:
        return each.groupBy("part").agg(F.array_distinct(F.array(*orders)).alias("firsts")).select("part", F.explode("firsts").alias("first"))

    firsts, again, out = written(firsts_of(each), "firsts"), each, None
    while True:
        met = again.join(firsts, "part").where("node != first").groupBy("node", "first").agg(F.count("*").alias("common"))
        met = met.join(sizes, "node").where(F.col("common") >= share * F.col("n")).drop("n")
        close = met.join(sizes.withColumnsRenamed({"node": "first", "n": "m"}), "first").where(F.col("common") >= share * F.col("m"))
        close = written(close.select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b")).distinct(), "links")
        out = close if out is None else out.unionByName(close)
        if not close.head(1):
            return out
        gone = written(close.select(F.col("b").alias("node")).distinct(), "gone")
        changed = written(firsts.join(gone.withColumnRenamed("node", "first"), "first", "left_semi").select("part").distinct(), "changed")
        old, each = each, written(each.join(gone, "node", "left_anti"), "parts")
        members = written(each.join(changed, "part", "left_semi"), "members")
        firsts = written(firsts.join(changed, "part", "left_anti").unionByName(firsts_of(members)), "firsts")
        again = written(each.join(written(members.select("node").distinct(), "nodes"), "node", "left_semi"), "again")
        remove(texts.sparkSession, old._engram_path)


def _promising(each: DataFrame, sizes: DataFrame, share: float) -> DataFrame:
    """The segments (node, part; those of more than one node) of nodes that have the share of theirs in common with any: no other can have a link."""
    enough = each.groupBy("node").agg(F.count("*").alias("common")).join(sizes, "node").where(F.col("common") >= share * F.col("n")).select("node")
    return written(each.join(enough, "node", "left_semi"), "parts")


def without_copies(docs: DataFrame, hot: int = 8192, broadcast_rows: int = 2_000_000, share: float | None = 0.45) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id (nulls last), then of the smallest text hash; all its columns are kept. Of rows so kept that ``segment_links`` joins, again one stays (``share`` None: all).

    The rows that go, two numbers each, are broadcast if they are no more than ``broadcast_rows``, so no text is shuffled;
    more are taken out by a shuffled join.
    """
    rows = written(fingerprints(docs, parts=share is not None), "fingerprints")
    found = written(grouped(rows, hot).select("root", "doc_id", "text_hash"), "grouped")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")

    def rest(found: DataFrame) -> DataFrame:
        first = found.groupBy("root").agg(F.min(order).alias("first"), F.max(order).alias("last")).where(F.col("first") != F.col("last")).select("root", "first")
        out = found.join(first, "root").where(order != F.col("first")).select(F.col("doc_id").alias("go_doc"), F.col("text_hash").alias("go_hash")).distinct()
        return written(out, "copies")

    def without(df: DataFrame, hash_name: str, going: DataFrame) -> DataFrame:
        few = going.count() <= broadcast_rows
        return df.join(F.broadcast(going) if few else going, (df[hash_name] == going["go_hash"]) & df["doc_id"].eqNullSafe(going["go_doc"]), "left_anti")

    going = rest(found)
    if share is not None:
        kept = without(rows, "text_hash", going)
        nodes = kept.select(F.col("fp").alias("node"), "parts")
        if rows.groupBy("fp").agg(F.countDistinct("doc_id", "text_hash").alias("k"), F.count("*").alias("n")).where("n > k").head(1):
            nodes = nodes.dropDuplicates(["node"])
        roots = components(written(segment_links(nodes, share), "links"))
        named = kept.select("doc_id", "text_hash", "fp").join(roots.withColumnRenamed("node", "fp"), "fp")
        going = written(going.unionByName(rest(named.select("root", "doc_id", "text_hash"))), "copies")
    (h,) = fresh(docs, "copies_hash")
    left = docs.withColumn(h, F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = without(left, h, going)
    twice = rows.groupBy("doc_id", "text_hash").count().where("count > 1").head(1)
    return (kept.dropDuplicates(["doc_id", h]) if twice else kept).drop(h)
