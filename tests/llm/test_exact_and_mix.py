import hashlib
import re
from collections import Counter

import pytest

from sentriflow.llm import exact_dedup, mixing


def test_exact_dedup_against_brute_force(odd, texts):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(odd).collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in texts.items()}
    for i, t in norm.items():
        same = [j for j, u in norm.items() if u == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(same), len(same), i == min(same))


def test_exact_dedup_of_nothing_and_of_repeated_rows(odd, nothing):
    assert exact_dedup.exact_dedup(nothing).collect() == []
    twice = exact_dedup.exact_dedup(odd.union(odd)).filter("doc_id = 4").collect()
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in twice] == [(4, 2, True)] * 2


def test_dropping_copies_keeps_columns(odd):
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(1, 17)) - {2, 7}


def test_digest(odd, texts):
    for r in exact_dedup.exact_dedup(odd).collect():
        assert r["text_sha256"] == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", texts[r["doc_id"]] or "").encode()).hexdigest()


def test_dropping_copies_of_clashing_names_null_and_repeated_ids(spark):
    rows = [(1, "a b", 0, 0), (1, "a  b", 0, 1), (1, "c", 0, 2), (2, "a b", 0, 3), (None, "c", 0, 4), (None, "d", 0, 5), (None, "d", 0, 6), (3, None, 0, 7), (4, "", 0, 8), (5, "e", 0, 9), (5, "e", 0, 10)]
    names = "doc_id long, text string, _dropped int, n int, _id string, _row int, _in int, _maybe int, _key int, _gone int, _hit int"
    df = spark.createDataFrame([(*r, "x", 1, 1, 1, 1, 1, 1) for r in rows], names).repartition(3)
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    norm = sorted((str(r["doc_id"]), re.sub(" +", " ", r["text"] or "")) for r in kept.collect())
    assert norm == sorted([("1", "a b"), ("1", "c"), ("None", "d"), ("3", ""), ("5", "e")])


def water_fill(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = {}, set(), sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return target | share
        for s in over:
            target[s], left = most * sizes[s], left - most * sizes[s]
            full.add(s)


def test_targets_and_taken_words(spark, sf, odd, texts):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        rows = mixing.mix(docs).collect()
        source = {r["doc_id"]: r["source"] for r in docs.collect()}
        sizes: dict = {}
        for r in rows:
            sizes[source[r["doc_id"]]] = sizes.get(source[r["doc_id"]], 0) + r["size"]
        want = water_fill(sizes)
        taken: dict = {}
        for r in rows:
            s = source[r["doc_id"]]
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[s] = taken.get(s, 0) + r["taken"]
        for s, t in taken.items():
            assert abs(t - want[s]) <= 1
        assert rows and sorted(rows) == sorted(mixing.mix(docs.repartition(5)).collect())


def test_buckets_do_not_change_the_mix(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = sorted(mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BUCKETS", 3)
    assert sorted(mixing.mix(docs).collect()) == whole


def test_mix_of_nothing_and_repeats(odd, nothing):
    assert mixing.mix(nothing).collect() == []
    mixed = mixing.repeat_to_targets(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0
    assert mixing.repeat_to_targets(nothing).collect() == []


def test_mix_with_clashing_names_null_and_repeated_ids(spark):
    rows = [(None, "a b c", "s", 0), (None, "d e", "s", 1), (1, "f g", "s", 2), (1, "h", "s", 3), (2, "i j", None, 4), (2, "i j", None, 5)]
    names = "doc_id long, text string, source string, n int, _mixed int, _copies int, _copy int, _row int, _in int, _key int, size int, extra int, epochs int"
    df = spark.createDataFrame([(*r, 1, 1, 1, 1, 1, 1, 1, 1, 1) for r in rows], names).repartition(2)
    out = mixing.repeat_to_targets(df)
    assert out.columns == df.columns
    times = Counter(r["n"] for r in out.collect())
    # the sources are 8 and 4 words long; weights 5 and 2 give them targets of 12 * 5 / 7 and 12 * 2 / 7
    assert set(times) >= {0, 1, 2, 3} and times[4] == times[5]
