import hashlib
import math
import re
from collections import Counter

import corpus_pipeline

from sentriflow.llm import mixing
from sentriflow.llm.common import materialize
from test_exact_and_mix import water_fill
from test_near import brute


def expected_copies(rows: dict) -> Counter:
    """How often the mix takes each document, by a plain walk in key order; rows: id -> (text, source)."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (t, _) in rows.items()}
    by_source: dict = {}
    for i, (_, s) in rows.items():
        by_source.setdefault(s, []).append(i)
    totals = {s: sum(size[i] for i in ids) for s, ids in by_source.items()}

    def key(i):
        t = rows[i][0]
        u = (int(hashlib.md5(f"{i}:{mixing.SEED}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        clean = sum(c not in mixing.NOISE for c in t) / max(1, len(t))
        return -math.log(u) / (0.1 + 0.9 * clean * clean), i

    out: Counter = Counter()
    for s, target in water_fill(totals).items():
        budget = math.floor(target + 1e-6)
        epochs = budget // totals[s] if totals[s] else 0
        rest, before = budget - epochs * totals[s], 0
        for i in sorted(by_source[s], key=key):
            extra = max(0, min(size[i], rest - before))
            before += size[i]
            out[i] = epochs + (extra > 0 and extra * 2 >= size[i])
    return +out


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    keep = {i for i, r in rows.items() if r["text"] and re.search(r"[^\W\d_]", r["text"])}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]["text"]) for i in keep}
    first = {t: min(i for i in keep if norm[i] == t) for t in set(norm.values())}
    unique = set(first.values())
    components = brute({i: rows[i]["text"] for i in unique}, 5, 80)
    single = {i for i in unique if components[i][1] == i}
    copies = expected_copies({i: (rows[i]["text"], rows[i]["source"]) for i in single})
    want = [Counter(keep), Counter(unique), Counter(single), copies, copies]
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want):
        docs = materialize(stage(spark, docs, sf), name)
        if name != "sentencepiece":
            assert docs.columns == names
        assert Counter(r["doc_id"] for r in docs.collect()) == ids, name
    assert docs.filter("NOT lossless").count() == 0
    assert sorted(corpus_pipeline.run(spark, sf).collect()) == sorted(docs.collect())


def test_stages_take_nothing(nothing, spark, sf):
    docs = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "nothing")
        assert docs.count() == 0
