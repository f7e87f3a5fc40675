import numpy as np
import pytest

from sentriflow.llm import near_dedup
from test_near import brute


@pytest.mark.parametrize("rounds, block, shingles", [(1, 4, 1 << 20), (1, 400, 600), (2, 400, 1 << 20), (5, 400, 1 << 20)])
def test_clusters_in_several_blocks(spark, monkeypatch, rounds, block, shingles):
    """Copies of one text that are near the threshold to each other, and a bucket rest of many blocks."""
    r = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(1, 26):
        words = list(base)
        for at in r.choice(150, 1 + i % 5, replace=False):
            words[at] = f"x{i}-{at}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.near_duplicates(docs, k=3, percent=85).collect()}
    assert got == brute(texts, 3, 85)


def test_tree_of_links_joins_what_is_linked():
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 5, 10, 500, 503, 900)]
    u, v = near_dedup.tree_of_links(sets, 85)
    assert sorted(zip(u.tolist(), v.tolist())) == [(1, 0), (2, 0), (4, 3)]
    assert len(near_dedup.tree_of_links([np.array([7], np.uint64)], 85)[0]) == 0
