import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as C
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from engramspark.llm import quality, secrets
from engramspark.llm.packing import tokenizer
from tests.llm import test_mixing, test_simhash

W = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_keep_columns(spark, odd, none):
    for docs in (odd, none):
        for _, stage in C.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            out.collect()
        C.STAGES[-1][1](spark, docs, "").collect()


def test_run_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    good = [r for r in docs if quality.judge(quality.Doc(r.text.encode()), quality.RULES[::-1]) is None]
    f = [test_simhash.brute_fp(r.text) for r in good]
    left, kept = set(range(len(good))), []
    while left:
        todo, group = [left.pop()], []
        while todo:
            i = todo.pop()
            group.append(i)
            near = {j for j in left if bin(f[i] ^ f[j]).count("1") <= 2}
            left -= near
            todo += near
        kept.append(min((good[i] for i in group), key=lambda r: r.doc_id))
    # which of these the second look takes out is tested with the operator
    stay = {r.doc_id for r in C.near_dedup(spark, C.quality_rules(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf), sf).select("doc_id").collect()}
    assert stay <= {r.doc_id for r in kept} and len(stay) > 0.9 * len(kept)
    kept = [r for r in kept if r.doc_id in stay]
    encode = tokenizer("byte_bpe_50k.tiktoken").encode_ordinary
    text = {r.doc_id: secrets.cover(r.text, secrets.spans(r.text, encode), "[secret]") for r in kept}
    size, source = {i: len(W.findall(t)) for i, t in text.items()}, {r.doc_id: r.source for r in kept}
    totals = defaultdict(int)
    for i, n in size.items():
        totals[source[i]] += n
    targets = test_mixing.brute_targets(totals)

    rows = C.run(spark, sf).collect()
    times = Counter(r.doc_id for r in rows if r.start == 0)
    assert set(times) <= set(text) and max(times.values()) <= 2
    taken = defaultdict(int)
    for i, n in times.items():
        taken[source[i]] += n * size[i]
    assert all(abs(taken[s] - targets[s]) <= max(size.values()) for s in totals)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, n in times.items():
        ids, at = t.encode(text[i], add_special_tokens=False).ids + [2], 0
        while at < len(ids):
            k = (len(ids) - at - 1) % 1024 + 1 if not at else 1024
            want[(i, at, k, zlib.crc32(np.array(ids[at : at + k], "<u4").tobytes()))] += n
            at += k
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert len({r.sequence_id for r in rows}) <= 1.05 * sum(r.length for r in rows) / 1024 + 1
