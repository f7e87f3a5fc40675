"""The ten queries on a whole table against plain Python, the libraries, or SQL."""

import hashlib
import math
import struct
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sentriflow.llm import entrypoints, language_id, matroska, pieces, toxicity
from sentriflow.llm.text import slices
from test_files import expected
from test_near import brute as near_brute
from test_suffix import brute as suffix_brute

P = pytest.importorskip("public_tokenizers")
MASK = (1 << 64) - 1


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, sf, name):
    return entrypoints.QUERIES[name](spark, sf).collect()


@pytest.mark.parametrize("name", ["op6_exact_dedup", "op8_mixing"])
def test_queries_with_sql(spark, sf, name):
    from tools.oracle_check import rows

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got, want = entrypoints.QUERIES[name](spark, sf).toPandas(), con.execute(entrypoints.ORACLE_SQL[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_op2(spark, sf, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, sf, "op2_minhash_near_dedup")}
    assert got == near_brute(docs, 3, 85)


def test_op4(spark, sf):
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in run(spark, sf, "op4_warc")}
    assert got == expected(spark.read.parquet(f"{sf}/pages.parquet"))


def test_op5(spark, sf, docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run(spark, sf, "op5_suffix_dedup")}
    assert got == suffix_brute(docs)


def test_op10(spark, sf, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, sf, "op10_token_wavelet")}
    at = 0
    for i in sorted(docs):
        ids = np.array([*lib.encode(docs[i] or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def plain_pieces(model, text, key, dropout, seed):
    """Segmentation of a text by the rule itself: the best open merge of each word, again and again."""
    normal = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    rank = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in normal.values()}, reverse=True))}
    chars = ["▁", *["￾" if c == "▁" else "▁" if c == " " else c for c in text]] if text else []
    starts = [i for i, c in enumerate(chars) if i == 0 or (c == "▁" and chars[i - 1] != "▁") or c not in normal or chars[i - 1] not in normal]
    out = []
    for a, b in zip(starts, [*starts[1:], len(chars)]):
        if chars[a] not in normal:
            out += [model.piece_to_id(f"<0x{x:02X}>") for x in ("▁" if chars[a] == "￾" else chars[a]).encode()]
            continue
        word_key = mix(key ^ mix(a + seed * 1_000_003 & MASK))
        parts, at = list(chars[a:b]), list(range(b - a + 1))
        while True:
            best = None
            for j in range(len(parts) - 1):
                i = normal.get(parts[j] + parts[j + 1])
                h = mix(word_key + at[j] * 0x9E3779B97F4A7C15 + at[j + 1] * 0xC2B2AE3D27D4EB4F + at[j + 2] * 0x165667B19E3779F9 & MASK) >> 11
                if i is not None and h >= int(dropout * (1 << 53)) and (best is None or rank[model.get_score(i)] < best[0]):
                    best = rank[model.get_score(i)], j
            if best is None:
                break
            j = best[1]
            parts[j : j + 2] = [parts[j] + parts[j + 1]]
            del at[j + 1]
        out += [normal[p] for p in parts]
    return out


@pytest.mark.parametrize("dropout", [0.1, 0.5])
def test_op3_by_the_rule_itself(docs, texts, dropout):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    some = [t[:1500] for t in list(docs.values())[:12]] + [(texts[i] or "")[:600] for i in (1, 4, 6, 13, 14, 15)] + ["x" * 120 + " y"]
    encoder = pieces.Encoder(pieces.Vocabulary.load(P.path("piece_bpe_32k.model")), dropout, 7)
    for a, b, data, offsets in slices(pa.array(some, pa.string())):
        tokens, first = encoder.encode_slice(data, offsets, np.arange(a, b, dtype=np.int64) * 7919)
        for i in range(a, b):
            assert tokens[first[i - a] : first[i - a + 1]].tolist() == plain_pieces(model, some[i], i * 7919, dropout, 7)


def plain_languages(model, text):
    """The language set and shares of a text, by plain loops over the same model."""
    raw = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode())
    padded, counts = b" " + raw + b"   ", {}
    for i in range(len(raw)):
        bucket = mix(int.from_bytes(padded[i : i + 4], "big")) >> 49
        counts[bucket] = counts.get(bucket, 0) + 1
    total, p = sum(counts.values()), model.p
    value = lambda s: sum(n * math.log(sum(w * p[k][g] for k, w in s.items())) for g, n in counts.items())

    def em(share):
        for _ in range(40):
            new = dict.fromkeys(share, 0.0)
            for g, n in counts.items():
                whole = sum(w * p[k][g] for k, w in share.items())
                for k, w in share.items():
                    new[k] += n * w * p[k][g] / whole / total
            moved, share = max(abs(new[k] - share[k]) for k in share), new
            if moved < 1e-4:
                break
        return share, value(share)

    single = [value({k: 1.0}) for k in range(len(model.languages))]
    share = {single.index(max(single)): 1.0}
    best, penalty = max(single), language_id.PENALTY * math.log(total + 1)
    while len(share) < len(model.languages):
        tries = [em({**{k: w * 0.9 for k, w in share.items()}, c: 0.1}) for c in range(len(model.languages)) if c not in share]
        found = max(tries, key=lambda t: t[1])
        if found[1] - best <= penalty:
            break
        share, best = found
    return share


def test_op7_by_plain_em(spark, sf, docs):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(table.filter(~language_id.held_out(table["doc_id"])), "text", "lang", "doc_id")
    some = {i: docs[i][:700] for i in sorted(docs)[:10]}
    longest = sorted(docs.values(), key=len)[-6:]
    some |= {1000 + j: longest[j][:400] + longest[j - 1][200:600] for j in range(6)}
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(list(some.items()), "doc_id long, text string"), model).collect()}
    for i, t in some.items():
        want = plain_languages(model, t)
        assert {x["lang"]: x["share"] for x in got[i]["languages"]} == {model.languages[k]: pytest.approx(w, abs=2e-3) for k, w in want.items()}
        assert got[i]["lang_pred"] == model.languages[max(want, key=want.get)]


def test_op1_scores_by_hand(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.train(table, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert len(model.buckets) and labels.count()
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    some = {i: docs[i] for i in sorted(docs)[:40]} | {-1: "You idiot, you stupid IDIOT. worthless", -2: "", -3: None}
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(list(some.items()), "doc_id long, text string"), model).collect()}
    for i, t in some.items():
        _, _, words, _ = next(toxicity.word_buckets(pa.array([t], pa.string())))
        counts: dict = {}
        for w in words.tolist():
            counts[w] = counts.get(w, 0) + 1
        signal = sum(weight[w] * math.log(1 + n) for w, n in counts.items() if w in weight)
        above = [1 / (1 + math.exp(t - signal)) for t in model.thresholds]
        assert got[i]["severity"] == pytest.approx(sum(above)) and got[i]["grade"] == sum(a >= 0.5 for a in above) and got[i]["p_toxic"] == pytest.approx(above[0])
    assert got[-1]["flagged"] and not got[-2]["flagged"] and got[-2]["severity"] == got[-3]["severity"]


def test_op9_values_from_the_text_alone(spark, sf, docs):
    rows = {r["doc_id"]: r for r in run(spark, sf, "op9_media_matroska")}
    for i, t in docs.items():
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r, f = rows[i], dict(x.split("=") for x in rows[i]["feature"].split(";"))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (int(f["packets"]), int(f["clusters"]), int(f["cues"]), int(f["ms"])) == (-(-len(payload) // 1024), -(-len(payload) // 65536), -(-len(payload) // 65536), len(payload) // 8)
        centred = [b - 128 for b in payload]
        assert float(f["mean"]) == pytest.approx(sum(centred) / len(centred), abs=1e-4) and float(f["rms"]) == pytest.approx(math.sqrt(sum(c * c for c in centred) / len(centred)), abs=1e-4)
        assert int(f["crossings"]) == sum((a >= 0) != (b >= 0) for a, b in zip(centred, centred[1:]))


def test_packet_table_of_a_file_built_by_hand(spark):
    track = matroska.element(matroska.TRACKS, matroska.element(matroska.TRACK_ENTRY, matroska.number(matroska.TRACK_NUMBER, 3) + matroska.number(matroska.DEFAULT_DURATION, 20_000_000)))
    block = matroska.vint(3) + struct.pack(">hB", 7, 0x80 | matroska.XIPH << 1) + bytes([2]) + bytes([3]) + bytes([255, 1]) + b"abc" + b"x" * 256 + b"tail"
    cluster = matroska.element(matroska.CLUSTER, matroska.number(matroska.TIMESTAMP, 100) + matroska.element(matroska.SIMPLE_BLOCK, block))
    data = matroska.element(matroska.EBML, b"") + matroska.element(matroska.SEGMENT, track + cluster)
    rows = matroska.packet_table(spark.createDataFrame([(1, bytearray(data))], "doc_id long, media binary")).orderBy("packet").collect()
    assert [(r["track"], r["timestamp_ns"], r["size"], r["keyframe"], r["lacing"], r["cluster"], r["cued"]) for r in rows] == [(3, 107_000_000 + n * 20_000_000, s, True, matroska.XIPH, 0, False) for n, s in enumerate((3, 256, 4))]
    assert [data[r["offset"] : r["offset"] + r["size"]] for r in rows] == [b"abc", b"x" * 256, b"tail"]
