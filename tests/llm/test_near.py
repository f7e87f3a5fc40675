import numpy as np
import pytest

from sentriflow.llm import near_dedup
from sentriflow.llm.components import connected_components


def sets(texts: dict, k: int) -> dict:
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = {}
    for i, t in texts.items():
        w = [x for x in (t or "").translate(lower).replace("\t", " ").replace("\n", " ").split(" ") if x]
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def brute(texts: dict, k: int, percent: int) -> dict:
    s, root = sets(texts, k), {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s[i]), find(i)) for i in texts}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_components_against_brute_force(odd, texts, k, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(odd, k=k, percent=percent).collect()}
    assert got == brute(texts, k, percent)


def test_chains_of_copies(spark):
    """Neighbours are linked, ends are not: no single centre reaches all."""
    words = [f"w{i}" for i in range(260)]
    texts = {i: " ".join(words[i * 8 : i * 8 + 140]) for i in range(1, 14)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, k=3, percent=85).collect()}
    assert got == brute(texts, 3, 85) and len({c for _, c in got.values()}) == 1


def test_nothing_and_dropping(odd, nothing):
    assert near_dedup.near_duplicates(nothing).collect() == []
    kept = near_dedup.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert {9, 11, 7} & {r["doc_id"] for r in kept.collect()} == set()


def test_null_and_repeated_ids_and_clashing_names(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base, 1), (5, "another text of a few words here", 2), (7, base + " end", 3), (7, "yet another text of a few words", 4), (None, base, 5), (None, base, 6), (9, None, 7), (9, None, 8)]
    names = "doc_id long, text string, n int, _dropped int, _row int, _id int, _in int, _digest int, kept int, node int, component int"
    df = spark.createDataFrame([(*r, 1, 1, 1, 1, 1, 1, 1, 1) for r in rows], names).repartition(3)
    found = near_dedup.near_duplicates(df).collect()
    assert len(found) == len(rows) and {(r["component_id"], r["kept"]) for r in found if r["doc_id"] is None} == {(None, True)}
    kept = near_dedup.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r["n"] for r in kept.collect()) == [1, 2, 5, 6, 7, 8]


def test_sketch_estimates_similarity():
    r = np.random.default_rng(5)
    pool = r.integers(0, 2**63, 3000).astype(np.uint64)
    for size, shared in ((1, 1), (40, 30), (900, 600)):
        a, b = np.unique(pool[:size]), np.unique(np.concatenate((pool[:shared], pool[2000 : 2000 + size - shared])))
        same = np.mean(near_dedup.sketch(a) == near_dedup.sketch(b))
        real = shared / (2 * size - shared)
        assert abs(same - real) < 0.17
        assert near_dedup.sketch(a).max() != np.iinfo(np.uint64).max


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(7, 3), (3, 9), (5, 5)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 131)}, 3: 3, 7: 3, 9: 3}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_that_cheat_polynomial_hashes_stay_apart(spark):
    a = thue_morse(4096)
    b = a.translate(str.maketrans("ab", "ba"))
    texts = {1: a, 2: b, 3: f"x {a} y", 4: f"x {b} y", 5: f"x {a} y", 6: "a" * 16 + " b", 7: "a" * 17 + " b", 8: "a" * 8 + "\0 b", 9: "a" * 8 + " b"}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k=3, percent=85).collect()}
    assert got == brute(texts, 3, 85) and got[5] == (1, 3)


def test_texts_that_share_a_passage_are_not_compared_with_all(spark, monkeypatch):
    """Similarity 0.3 to 0.6 meets in bands without a link; the rarest shingles keep such texts apart."""
    common = " ".join(f"c{i}" for i in range(120))
    texts = {i: f"{common} " + " ".join(f"d{i}x{j}" for j in range(60)) for i in range(1, 400)}
    texts |= {1000 + i: texts[i] + " end" for i in range(1, 400, 40)}
    rest = []
    full = near_dedup._compare_rest
    monkeypatch.setattr(near_dedup, "_compare_rest", lambda rows, *a: rest.append(rows.count()) or full(rows, *a))
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k=3, percent=85).collect()}
    assert got == brute(texts, 3, 85) and sum(rest) == 0
