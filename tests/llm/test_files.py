import base64
import gzip
import hashlib
import io
import struct
import zlib

import pytest

from sentriflow.llm import matroska as M
from sentriflow.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i}\n x", t, "z") for i, t in enumerate([None, "", "<p>a</p>", "<p>a</p>", "é" * 9000, "<p>a</p>", "b\r\n\r\nc", "é" * 9000])]
    return spark.createDataFrame(rows, "page_id long, url string, html string, _payload string").repartition(3)


def expected(pages, least=0):
    rows = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    last = {}
    for i, b in rows.items():
        last[b] = max(i, last.get(b, -1))
    out = {}
    for i, b in rows.items():
        again = len(b) >= least and last[b] != i
        out[i] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", last[b] if again else None)
    return out


def test_pages_through_warc(pages):
    archives = warc.normalise(warc.write_monolithic(pages))
    index = warc.read_index(archives)
    got = {r["page_id"]: r for r in warc.read_records(index).collect()}
    want = expected(pages)
    for i, (size, digest, kind, refers) in want.items():
        r = got[i]
        assert (r["stated_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (size, digest, kind, refers)
        assert (r["payload"] is None) == (kind == "revisit")
    assert index.count() == len(want)


def test_members_stand_alone(pages):
    whole = warc.write_monolithic(pages)
    for r in whole.collect():
        with warc.open_read(r["path"]) as f:
            raw = f.read()
        state = zlib.decompressobj(warc.GZIP)
        state.decompress(raw)
        assert state.eof and not state.unused_data  # one stream for the whole file
    for r in warc.read_index(warc.normalise(whole)).collect():
        with warc.open_read(r["path"]) as f:
            f.seek(r["offset"])
            assert gzip.decompress(f.read(r["length"])).startswith(warc.VERSION)


def test_empty_pages_and_least_bytes(pages):
    assert warc.read_records(warc.read_index(warc.normalise(warc.write_monolithic(pages.filter("false"))))).collect() == []
    rows = warc.mark_revisits(pages, min_bytes=100).collect()
    assert {r["_id"] for r in rows if r["_refers_to"] is not None} == {4}


def test_records_over_piece_borders():
    raw = b"".join(warc.record(i, "u", b"p" * i, hashlib.sha1(b"p" * i).hexdigest(), None) for i in range(20))
    for size in (1, 7, 1000):
        pieces = (raw[a : a + size] for a in range(0, len(raw), size))
        assert [warc.read_record(r)["payload"] for r in warc.split_records(pieces)] == [b"p" * i for i in range(20)]
    with pytest.raises(ValueError):
        list(warc.split_records([raw[:-9]]))
    assert b"".join(warc.inflate(io.BytesIO(gzip.compress(raw[:100]) + gzip.compress(raw[100:])))) == raw


def test_media_round_trip(odd, nothing, texts):
    rows = {r["doc_id"]: r for r in M._with_sizes(M.store_texts(odd)).collect()}
    for i, t in texts.items():
        raw = (t or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    assert rows[1]["media_sha256"] == rows[2]["media_sha256"] and M.store_texts(nothing).collect() == []


def test_packets_tell_time_track_and_bytes():
    payload = bytes(range(256)) * 1000
    data = M.mux(payload)
    parsed = M.parse(data)
    assert parsed["doc_type"] == "matroska" and parsed["tracks"][1]["codec"] == "A_PCM/INT/LIT"
    assert b"".join(data[p[2] : p[2] + p[3]] for p in parsed["packets"]) == payload
    assert [p[1] for p in parsed["packets"]] == [n * M.FRAME * 10**9 // M.RATE for n in range(len(parsed["packets"]))]
    assert {p[5] for p in parsed["packets"]} >= {M.XIPH, M.FIXED, M.EBML_LACING} and all(p[7] for p in parsed["packets"])
    assert [c[2] for c in parsed["cues"]] == parsed["clusters"]


@pytest.mark.parametrize("kind", [M.XIPH, M.EBML_LACING])
def test_lacing_of_uneven_frames(kind):
    frames = [b"a" * n for n in (300, 1, 0, 255, 5000, 254)]
    body = M.lace(frames, kind)
    assert [body[a : a + n] for a, n in M.unlace(body, 0, len(body), kind)] == frames


def test_unknown_sizes_and_other_elements():
    track = M.element(M.TRACKS, M.element(M.TRACK_ENTRY, M.number(M.TRACK_NUMBER, 2)))
    cluster = bytes.fromhex("1F43B675") + b"\x01" + b"\xff" * 7 + M.number(M.TIMESTAMP, 5) + M.element(0xEC, b"void") + M.element(M.SIMPLE_BLOCK, M.vint(2) + struct.pack(">hB", -2, 0) + b"xyz")
    data = M.element(M.EBML, b"") + bytes.fromhex("18538067") + b"\x01" + b"\xff" * 7 + track + cluster + cluster
    packets = M.parse(data)["packets"]
    assert [(p[0], p[1], data[p[2] : p[2] + p[3]], p[4], p[7]) for p in packets] == [(2, 3_000_000, b"xyz", False, False)] * 2


def test_packet_table_reports_bad_files(spark):
    files = spark.createDataFrame([(1, bytearray(M.mux(b"q" * 3000))), (2, bytearray(b"\x1a\x45")), (3, None), (4, bytearray())], "doc_id long, media binary")
    rows = M.packet_table(files).collect()
    assert sum(r["doc_id"] == 1 for r in rows) == 3 and [r["error"] is not None for r in rows if r["doc_id"] == 2] == [True]
    assert {r["doc_id"] for r in rows} == {1, 2}
