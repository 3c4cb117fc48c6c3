"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Lengths are integers of 1 to the capacity, so the packing depends on how many pieces there are of each length and on
nothing else. Best-fit decreasing therefore runs over the histogram of lengths, of at most ``capacity`` rows, with a segment
tree over remaining capacities that finds the tightest open bin in logarithmic time; pieces of one length, and bins of one
remaining capacity, are placed in runs. The runs number at most 2 * capacity**2 whatever the input. A piece finds its place
from its length and its rank among the pieces of that length, which needs no sort: tasks number their own pieces, and
prefix sums over the tasks' counts do the rest.

Edge cases: a null text is empty and yields one piece, the end token; longer documents are cut into pieces of the
capacity, of which the first may be shorter; repeated rows are packed each; an empty table gives an empty result; columns
other than ``doc_id`` and ``text`` are ignored. Texts of any length are encoded whole, runs of millions of one character too.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_right
from collections import defaultdict, deque
from typing import NamedTuple

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, slices, small_batches, written

CAPACITY = 1024
END_ID = 2

_tokenizers: dict[str, object] = {}
#: ``tiktoken`` looks for the end of a run of white space by backtracking, whose stack a run of some 980,000 overflows.
LONG_SPACE = 100_000
_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")


def tokenizer(name: str):
    """The byte-level BPE of a vocabulary file, as ``tiktoken`` runs it: the ids are those that ``tokenizers`` gives, several times faster. Added tokens of a JSON file are special tokens: ``encode`` with ``allowed_special="all"`` gives their ids, ``encode_ordinary`` takes them for text."""
    if name not in _tokenizers:
        import public_tokenizers as P
        import tiktoken

        path = name if "/" in name else P.path(name)
        added = {}
        if path.endswith(".json"):
            with open(path, "rb") as f:
                added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(path.removesuffix(".json") + ".tiktoken" if path.endswith(".json") else path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _tokenizers[name] = tiktoken.Encoding("public", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _tokenizers[name]


def encoder(name: str):
    """text -> ids of a vocabulary file, added tokens included, for texts of any length: those with very long runs of white space go through ``tokenizers`` itself."""
    fast = tokenizer(name).encode

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_SPACE and _LONG_SPACE.search(text):
            return _exact(name).encode(text, add_special_tokens=False).ids
        return fast(text, allowed_special="all")

    return encode


def _exact(name: str):
    key = f"exact {name}"
    if key not in _tokenizers:
        import public_tokenizers as P
        from tokenizers import Tokenizer

        _tokenizers[key] = Tokenizer.from_file(name if "/" in name else P.path(name))
    return _tokenizers[key]


class Tree:
    """Segment tree over capacities 0..n: which of them have open bins."""

    def __init__(self, n: int) -> None:
        self.size = 1 << n.bit_length()
        self.open = [0] * (2 * self.size)

    def mark(self, r: int, there: bool) -> None:
        i = r + self.size
        self.open[i] = int(there)
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity of at least ``least``."""
        i = least + self.size
        if self.open[i]:
            return least
        while i > 1:  # up to the first open right neighbour, then down its left edge
            if not i & 1 and self.open[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


class Run(NamedTuple):
    """``count`` pieces of a length, from rank ``rank``, in as many bins from number ``bin``, each at ``offset``."""

    length: int
    rank: int
    count: int
    bin: int
    offset: int


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """The packing of a histogram of lengths, as runs."""
    tree = Tree(capacity)
    open_: dict[int, deque[tuple[int, int]]] = defaultdict(deque)  # by remaining capacity: first bin and number of bins
    runs, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        while left:
            room = tree.tightest(length)
            if room is None:
                n = max(1, left // (capacity // length))
                first, bins, room = bins, bins + n, capacity
            else:
                first, have = open_[room].popleft()
                n = min(have, max(1, left // (room // length)))  # a bin is filled before the next is begun
                if n < have:
                    open_[room].appendleft((first + n, have - n))
                elif not open_[room]:
                    tree.mark(room, False)
            runs.append(Run(length, rank, n, first, capacity - room))
            open_[room - length].append((first, n))
            if room > length:
                tree.mark(room - length, True)
            rank, left = rank + n, left - n
    return runs


def token_pieces(docs: DataFrame, name: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, the task and the piece's rank in it among those of its length; with ``with_ids`` their ids too. No shuffle."""

    def each_partition(batches):
        import pyarrow as pa

        encode, seen, task = encoder(name), [0] * (capacity + 1), TaskContext.get().partitionId()
        for b in slices(batches):
            rows: list[tuple] = []
            ids_col = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text)
                ids.append(end_id)
                raw, n, start, piece = np.array(ids, "<u4").tobytes(), len(ids), 0, 0
                while start < n:
                    k = (n - start - 1) % capacity + 1 if not start else capacity
                    part = raw[4 * start : 4 * (start + k)]
                    rows.append((doc, piece, start, k, zlib.crc32(part), task, seen[k]))
                    if with_ids:
                        ids_col.append(np.frombuffer(part, "<i4"))
                    seen[k] += 1
                    start, piece = start + k, piece + 1
            cols = [pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)] if rows else [pa.array([], f.type) for f in list(arrow)[:7]]
            if with_ids:
                cols.append(pa.array(ids_col, arrow.field(7).type))
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * with_ids
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(each_partition, schema)


def pack(docs: DataFrame, name: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece; with ``with_ids`` its ids as well.

    The pieces are written once. Shuffled are the tasks' counts by length and, where those are too many to broadcast, the
    pieces' short rows. At most ``capacity`` rows come to the driver.
    """
    pieces = written(token_pieces(docs, name, capacity, end_id, with_ids), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    by_length: dict[int, list[Run]] = defaultdict(list)
    for r in best_fit_decreasing(total, capacity):
        by_length[r.length].append(r)
    runs = {k: tuple(np.array(x, "<i8") for x in zip(*((r.rank, r.bin, r.offset) for r in v))) for k, v in by_length.items()}
    shared = docs.sparkSession.sparkContext.broadcast(runs)
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    placed = pieces.join(before, ["task", "length"])

    def each(b):
        length, rank = b.column("length").to_numpy(), b.column("nth").to_numpy() + b.column("before").to_numpy()
        seq, off = np.zeros(len(rank), "<i8"), np.zeros(len(rank), "<i8")
        for k in np.unique(length):
            at = np.flatnonzero(length == k)
            start, first, offset = shared.value[int(k)]
            i = np.searchsorted(start, rank[at], "right") - 1
            seq[at], off[at] = first[i] + rank[at] - start[i], offset[i]
        import pyarrow as pa

        return {c: b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids)} | {"sequence_id": pa.array(seq), "offset": pa.array(off)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(placed, each, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, sequence_id and ids, from ``pack(..., with_ids=True)``. One sequence is one group, of at most the capacity's tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x.ids)).alias("ids"))


def place_of(runs: list[Run], length: int, rank: int) -> tuple[int, int]:
    """Bin and offset of one piece (for checks of small packings)."""
    own = [r for r in runs if r.length == length]
    r = own[bisect_right([x.rank for x in own], rank) - 1]
    return r.bin + rank - r.rank, r.offset
