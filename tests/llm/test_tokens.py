import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sentriflow.llm import byte_bpe, pieces, wavelet
from sentriflow.llm.text import slices

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(P.path("piece_bpe_32k.model"))


def encoded(vocabulary, texts, dropout, seed=7, keys=None):
    out, e = [], pieces.Encoder(vocabulary, dropout, seed)
    for a, b, data, offsets in slices(pa.array(texts, pa.string())):
        tokens, first = e.encode_slice(data, offsets, np.arange(a, b, dtype=np.int64) if keys is None else keys[a:b])
        out += [tokens[x:y] for x, y in zip(first[:-1], first[1:])]
    return out


def test_without_dropout_it_is_the_librarys_encoding(vocabulary, spark, sf, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    docs = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(100).collect()]
    docs += [t or "" for t in texts.values() if "▁" not in (t or "")]
    assert [x.tolist() for x in encoded(vocabulary, docs, 0.0)] == lib.encode(docs)


def test_dropout_varies_by_seed_and_is_lossless(vocabulary, texts):
    docs = [t or "" for t in texts.values()]
    a, b, again = (encoded(vocabulary, docs, 0.3, s) for s in (1, 2, 1))
    assert [x.tolist() for x in a] == [x.tolist() for x in again]
    assert any(x.tolist() != y.tolist() for x, y in zip(a, b))
    for runs in (a, b, encoded(vocabulary, docs, 1.0)):
        first = np.concatenate(([0], np.cumsum([len(x) for x in runs])))
        assert [t.decode() for t in pieces.decode_slice(vocabulary, np.concatenate(runs), first)] == docs


def test_long_words_follow_the_same_rule(vocabulary, monkeypatch):
    docs = ["unbelievablyinternationalisation" * 1, "x" * 40]
    short = encoded(vocabulary, docs, 0.2)
    monkeypatch.setattr(pieces, "LONG", 3)
    assert [x.tolist() for x in encoded(vocabulary, docs, 0.2)] == [x.tolist() for x in short]


def test_encode_and_decode_tables(odd, nothing, texts):
    rows = {r["doc_id"]: r for r in pieces.summarise(pieces.encode(odd)).collect()}
    assert sorted(pieces.encode_checked(odd).collect()) == sorted(pieces.summarise(pieces.encode(odd)).collect())
    assert len(rows) == len(texts) and all(r["lossless"] for r in rows.values())
    assert [rows[i]["n_tokens"] for i in (1, 2)] == [0, 0] and rows[1]["ids_crc32"] == 0
    assert pieces.encode(nothing).collect() == []


@pytest.mark.parametrize("n", [0, 1, 700, 300_000])
def test_wavelet_shard(n):
    r = np.random.default_rng(n)
    ids = (r.zipf(1.3, n) % 50257).astype("<u4")
    f = io.BytesIO()
    wavelet.write_shard(f, ids, [1], [n])
    f.seek(0)
    s = wavelet.Shard(f)
    assert (s.all_ids() == ids).all()
    assert [s.access(int(i)) for i in range(0, n, max(1, n // 9))] == ids[:: max(1, n // 9)].tolist()
    for t in (0, 1, 5, 50256, 90_000):
        at = np.flatnonzero(ids == t)
        assert s.count(t) == len(at) and s.count(t, n // 4, n // 2) == np.sum((at >= n // 4) & (at < n // 2))
        assert s.occurrence(t, len(at)) == -1 and s.occurrence(t, -1) == -1
        if len(at):
            assert s.occurrence(t, len(at) // 2) == at[len(at) // 2]
    with pytest.raises(IndexError):
        s.access(n)


ODD_TEXTS = ["a  b", " a", "a ", "a \nb", "a\n b", "a\n \nb", "a  b", "don't\t x", "<|endoftext|> y", "b\n", "\n", "x\u00a0 y", "x\u00a0\n z", "x\u2003 y", "\u3000 y", "it's 'tis x''s 5's!'s", "a1b2!c?d,e.f", "caf\u00e9! \u00d7\u00f7x \u0153uvre\u2026 \u201cq\u201d.", "a\u0301b", "x\u00b2 9\u00b2", "\x1c \x00a", "w" * 33 + " " + "v" * 90]


def library_ids(tokenizer, docs):
    return [tokenizer.encode(d, add_special_tokens=False).ids for d in docs]


def piece_ids(encoder, docs):
    return [ids[x:y].tolist() for _, _, ids, first in encoder.encode(pa.array(docs, pa.string())) for x, y in zip(first[:-1], first[1:])]


def test_piece_encoder_is_exact(texts, spark, sf, monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib, mine = Tokenizer.from_file(path), byte_bpe.PieceEncoder(path)
    docs = [t or "" for t in texts.values()] + ODD_TEXTS + [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    want = library_ids(lib, docs)
    assert piece_ids(mine, docs) == want and piece_ids(mine, docs) == want
    monkeypatch.setattr(byte_bpe, "MAX_PIECES", 50)
    monkeypatch.setattr(byte_bpe, "SLICE_BYTES", 300)
    assert piece_ids(mine, docs[:60]) == want[:60]


@given(st.lists(st.text("ab'sZ1!&. \n\t\u00e9\u00d7\u00a0\u2026\u0301<|>", max_size=12), max_size=4))
@settings(max_examples=300, deadline=None)
def test_piece_encoder_on_any_text(docs):
    path = P.path("byte_bpe_50k.json")
    mine = _kept.setdefault(path, byte_bpe.PieceEncoder(path))
    assert piece_ids(mine, docs) == library_ids(mine.tokenizer, docs)


_kept: dict = {}


def test_shards_round_trip(odd, nothing, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in wavelet.read_documents(wavelet.write_shards(odd, shard_ids=200)).collect()}
    at = 0
    for i in sorted(texts):
        ids = np.array([*lib.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], zlib.crc32(got[i]["ids"])) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert wavelet.read_documents(wavelet.write_shards(nothing)).collect() == []


def test_readers_get_a_task_per_shard(odd):
    shards = wavelet.write_shards(odd, shard_ids=200)
    assert shards.count() > 4 and wavelet.read_documents(shards).rdd.getNumPartitions() == shards.count()


def test_decoding_into_a_column_that_is_there_is_refused(spark):
    df = spark.createDataFrame([([1, 2], "x")], "tokens array<int>, Decoded string")
    with pytest.raises(ValueError):
        pieces.decode(df)
