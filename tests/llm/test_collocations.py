import random
import re
from collections import Counter

import numpy as np
import pytest

from sentriflow.llm import collocations as C
from sentriflow.llm.double_array import DoubleArray

LOWER = {c: c + 32 for c in range(65, 91)}


def pieces(text):
    for p in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", p)


def brute(rows, least, limit):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for w in pieces(text):
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = {(lang, p[i : i + m]) for (lang, p), a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if a >= f[lang, p[i : i + m]]}
    out = []
    for lang in n:
        scored = []
        for (at, p), a in found.items():
            if at == lang and (at, p) not in inside:
                score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:limit], 1)]
    return sorted(out)


def texts(seed=1, n=120):
    r = random.Random(seed)
    words = ["new", "york", "New", "city", "the", "a", "été", "x_y", "San", "Fran"]
    rows = [(r.choice(["en", "fr", None, "und"]), "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(r.randrange(60)))) for _ in range(n)]
    return rows + [("en", None), ("en", ""), ("en", " .,;\n"), (None, "of the of the of the of the of the"), ("en", "ha " * 3000), ("en", "one two three four five six " * 40)]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # several blocks, flushes, tries and passes
        for name, value in (("BLOCK_BYTES", 300), ("FLUSH", 50), ("TRIE_PHRASES", 7), ("TRIE_BYTES", 900), ("SLICE", 3), ("BATCH_ROWS", 10)):
            monkeypatch.setattr(C, name, value)
    rows = texts()
    df = spark.createDataFrame([(lang, t, 1, "x") for lang, t in rows], "lang string, text string, n int, phrase string").repartition(3)
    for least, limit in ((12, 2000), (30, 3)):
        got = sorted(map(tuple, C.collocations(df, least=least, limit=limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
        assert got == brute(rows, least, limit) and len(got) > 3


def test_nothing_frequent(spark):
    df = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    for some in (df, df.filter("false")):
        got = C.collocations(some)
        assert got.collect() == [] and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_words_that_are_no_text(spark):
    df = spark.sql("SELECT 'en' lang, CAST(X'61FF2062206120' AS STRING) text FROM range(150)")
    got = C.collocations(df).selectExpr("hex(phrase)", "a", "n", "score").collect()
    assert [tuple(r) for r in got] == [("61FF20622061", 150, 450, 3000)]


def test_tries_count_overlapping_phrases():
    r = np.random.default_rng(4)
    for size in (1, 30, 900):
        phrases = sorted({tuple(r.integers(1, 40, r.integers(2, 6)).tolist()) for _ in range(size)}, key=lambda p: (p[-1], p))
        numbers = r.integers(0, 40, 5000).astype(np.int32)
        if phrases:
            numbers[100 : 100 + len(phrases[0])] = phrases[0]
        got = DoubleArray.build(phrases).count(numbers, 5, len(phrases))
        flat = numbers.tolist()
        want = Counter(tuple(flat[i : i + m]) for m in range(2, 6) for i in range(len(flat) - m + 1))
        assert got.tolist() == [want[p] for p in phrases]


def test_long_texts_are_cut_between_pieces():
    data = np.frombuffer(b"aa bb cc. dd ee, ff gggggggg hh; ii", np.uint8)
    runs = [bytes(run) for run, _ in C.cut_long(data, np.array([0, len(data)]), 6)]
    assert b"".join(runs) == bytes(data) and runs == [b"aa bb cc.", b" dd ee,", b" ff gggggggg hh;", b" ii"]


def test_phrases_that_share_a_hash(spark, monkeypatch):
    """With hashes of four bits nearly all phrases share one; the counts stay those of the phrases."""

    def short_hashes(numbers, hashes, bits, m):
        at = np.flatnonzero(numbers[: len(numbers) - m + 1])
        at = at[(numbers[at[:, None] + np.arange(m)] > 0).all(1)]
        own = np.concatenate(([0], hashes)).astype(np.uint64)
        return at, own[numbers[at]] & np.uint64(15) | np.uint64(m << 8)

    monkeypatch.setattr(C, "phrase_hashes", short_hashes)
    rows = texts(9, 60)
    got = sorted(map(tuple, C.collocations(spark.createDataFrame(rows, "lang string, text string"), least=12).collect()))
    assert got == brute(rows, 12, 2000) and len(got) > 5


def test_word_hashes_are_those_of_the_jvm(spark):
    import xxhash

    for lang, word in (("en", "a"), ("und", "été"), ("x" * 40, "w" * 77)):
        own = np.array([xxhash.xxh64_intdigest(word.encode(), xxhash.xxh64_intdigest(lang.encode(), 42))], np.uint64).view(np.int64)[0]
        assert spark.sql(f"SELECT xxhash64('{lang}', CAST('{word}' AS BINARY)), xxhash64('{lang}', '{word}')").first()[:] == (own, own)


def shuffled_records(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    done = [store.lastStageAttempt(s) for s in stages]
    return sum(d.shuffleWriteRecords() for d in done if d.status().toString() == "COMPLETE"), out


def test_rare_phrases_of_frequent_words_are_not_shuffled_one_by_one(spark, monkeypatch):
    """Every word is frequent and nearly no pair is, as in a large corpus: what is shuffled must not be a row for each place in the text."""
    monkeypatch.setattr(C, "FLUSH", 4000)
    monkeypatch.setattr(C, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(C, "SKETCH_SLICE", 1 << 13, raising=False)
    r = random.Random(3)
    rows = [("en", " ".join(f"w{r.randrange(300)}" for _ in range(400)) + (". new york" if i < 130 else "")) for i in range(150)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    moved, got = shuffled_records(spark, "rare-phrases", lambda: C.collocations(df, least=100).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert sorted(map(tuple, got)) == brute(rows, 100, 2000) and [g[2] for g in got] == ["new york"]
    assert moved < 60_000 / 3


@pytest.mark.parametrize("flush", [700, 1 << 20])
def test_buckets_that_reach_the_limit(flush):
    r = np.random.default_rng(2)
    h = np.concatenate((r.integers(0, 1 << 63, 30_000), np.repeat(r.integers(0, 1 << 63, 40), 100))).astype(np.uint64)
    r.shuffle(h)
    buckets, width = 1 << 16, 1 << 13
    sent = [C._by_bucket(buckets, width)(h[a : a + flush], None) for a in range(0, len(h), flush)]
    rows = sorted((x for b in sent for x in b.to_pylist()), key=lambda x: x["part"])
    batches = [C.pa.RecordBatch.from_pylist(rows[a : a + 3], sent[0].schema) for a in range(0, len(rows), 3)]
    found = np.zeros(buckets // 8, np.uint8)
    for b in C._reached(100, width)(batches):
        found[b["part"][0].as_py() * width // 8 :][: width // 8] = np.frombuffer(b["bits"][0].as_py(), np.uint8)
    number = (h & np.uint64(buckets - 1)).astype(np.int64)
    want = np.bincount(number, minlength=buckets) >= 100
    assert (np.unpackbits(found, bitorder="little").astype(bool) == want).all() and 1 < want.sum() <= 40
    assert (C._in(found, h) == want[number]).all()


def test_sorted_numbers_are_packed():
    for numbers in ([], [0], [7, 7, 7], [0, 1, 300, 70_000, (1 << 28) - 1]):
        numbers = np.array(numbers, np.uint32)
        assert C.unpack_sorted(C.pack_sorted(numbers), len(numbers)).tolist() == numbers.tolist()


def test_blocks_without_a_candidate(spark):
    rows = [("en", "new york " * 120), ("fr", "rien du tout"), ("de", "nichts")]
    got = C.collocations(spark.createDataFrame(rows, "lang string, text string").coalesce(1))
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == brute(rows, 100, 2000)


def test_hashes_of_block_numbers_are_those_of_the_jvm(spark):
    for block in (0, 5, 3 << 13 | 17, (1 << 40) - 1):
        assert spark.sql(f"SELECT xxhash64(CAST({block} AS BIGINT))").first()[0] == np.array([C.block_hash(block)], np.uint64).view(np.int64)[0]
