import hashlib

import numpy as np
import pytest

from sentriflow.llm import bwt, suffix_dedup


def brute(texts: dict) -> dict:
    raw = {i: (t or "").encode() for i, t in sorted(texts.items())}
    first: dict = {}
    for i, b in raw.items():
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], i)
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = True
        starts = gone & ~np.concatenate(([False], gone[:-1])) if len(b) else gone
        out[i] = (len(b), int(gone.sum()), int(starts.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def found(rows) -> dict:
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows}


@pytest.mark.parametrize("block, busy", [(20_000, 5_000), (2, 1)])
def test_against_brute_force(odd, texts, block, busy):
    assert found(suffix_dedup.remove_repeats(odd, block_segments=block, busy_segments=busy).collect()) == brute(texts)


def test_busy_keys_are_split(spark):
    """Passages of 60 bytes with another number behind: many different segments of one key, whose inner windows are equal."""
    passage = "the quick brown fox jumps over the lazy dog, said the page nr"
    texts = {i: f"{'x' * (i % 3)}{passage}{i * i * 7919} and {i} {passage[:52]}{i % 4}" for i in range(1, 60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(suffix_dedup.remove_repeats(docs, block_segments=3, busy_segments=3).collect()) == brute(texts)


def test_long_texts_in_pieces(spark, monkeypatch):
    text = "".join(chr(97 + (i * i + i // 7) % 23) for i in range(5000))
    texts = {1: text, 2: "x" + text[1000:4000], 3: text[4500:] + "yy" + text[:60], 4: "z" * 49, 5: "z" * 200, 6: "z" * 199}
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 700)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    segments = [x for d in suffix_dedup.chunks(__import__("pyarrow").array([text])) for x in suffix_dedup.segments(d[1], d[2])[0]]
    assert segments and found(suffix_dedup.remove_repeats(docs).collect()) == brute(texts)


def test_nothing_null_ids_and_repeated_rows(odd, nothing, spark):
    assert suffix_dedup.remove_repeats(nothing).collect() == []
    text = "a passage that is long enough to be taken away when it is repeated"
    docs = spark.createDataFrame([(None, text), (3, text), (3, text), (5, text)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["n_removed"]) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == [(0, 0), (3, 0), (3, 0), (5, len(text))]
    other = "what nothing else holds, though its id is that of a row which repeats another one"
    docs = spark.createDataFrame([(1, text), (3, text), (3, other), (4, other + text)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == sorted([(1, len(text), 0), (3, len(text), len(text)), (3, len(other), 0), (4, len(other + text), len(other + text))])


@pytest.mark.parametrize("chunk", [1 << 20, 3])
def test_suffix_order_and_common_prefixes(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(bwt, "CHUNK", chunk)
    r = np.random.default_rng(1)
    for _ in range(40):
        texts = [bytes(r.integers(97, 100, int(r.integers(0, 14))).astype(np.uint8)) for _ in range(int(r.integers(1, 9)))]
        n = np.array([len(t) for t in texts])
        start = np.concatenate(([0], np.cumsum(n)[:-1]))
        flat = np.frombuffer(b"".join(texts), np.uint8)
        last, text, offset, prefixes = bwt.suffix_order(flat, start, n, str(tmp_path))
        want = sorted(((texts[i][k:], i, k) for i in range(len(texts)) for k in range(len(texts[i]) + 1)), key=lambda x: [(c + 1, 0) for c in x[0]] + [(0, x[1])])
        assert [(i, k) for _, i, k in want] == list(zip(text.tolist(), offset.tolist()))
        for a, b, h in zip(want, want[1:], prefixes[1:]):
            same = next((j for j, (x, y) in enumerate(zip(a[0], b[0])) if x != y), min(len(a[0]), len(b[0])))
            assert h == same
        assert list(tmp_path.iterdir()) == []
