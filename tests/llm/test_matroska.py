import hashlib
import random
import zlib

import pytest

from recollect.llm import common, matroska


@pytest.mark.parametrize("lacing", [None, matroska.XIPH, matroska.EBML_LACING])
@pytest.mark.parametrize("n", [0, 64, 1024, 5000 * 64, 64 * 3 + 1])
def test_round_trip(lacing, n):
    payload = random.Random(n).randbytes(n)
    data = matroska.mux(payload, frame=300, laced=5, blocks=3, lacing=lacing)
    packets, cues, codecs = matroska.parse(data)
    assert b"".join(data[p.offset : p.offset + p.size] for p in packets) == payload
    assert codecs == {1: "A_PCM/INT/LIT"} and len(cues) == max(1, -(-n // 4500))
    for time, track, at in cues:
        assert track == 1 and data[at : at + 4] == b"\x1f\x43\xb6\x75"
    assert [p.timestamp_ns for p in packets] == sorted(p.timestamp_ns for p in packets)


def test_foreign_forms():
    e = matroska.element
    uneven = [b"a" * 700, b"b" * 3, b"c" * 255, b"d"]
    flags, body = matroska._lace(uneven, matroska.EBML_LACING)
    group = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, b"\x82\x00\x05" + bytes([flags]) + body))
    unknown = b"\x1f\x43\xb6\x75\x01" + b"\xff" * 7 + e(matroska.TIMESTAMP, 7) + group
    segment = b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + e(matroska.INFO, e(matroska.TIMESTAMP_SCALE, 1000)) + unknown + unknown
    data = e(matroska.EBML, e(matroska.DOC_TYPE, "matroska")) + segment
    packets, _, _ = matroska.parse(data)
    assert [data[p.offset : p.offset + p.size] for p in packets] == uneven * 2
    assert {(p.track, p.timestamp_ns, p.keyframe) for p in packets} == {(2, 12000, False)} and {p.cluster for p in packets} == {0, 1}


def test_damaged_files_keep_a_prefix():
    data = matroska.mux(bytes(range(256)) * 40, frame=256)
    whole = matroska.parse(data)[0]
    for cut in range(0, len(data), 97):
        got = matroska.parse(data[:cut])[0]
        assert got == whole[: len(got)]
    noise = random.Random(2)
    for _ in range(200):
        broken = bytearray(data)
        for _ in range(5):
            broken[noise.randrange(len(broken))] = noise.randrange(256)
        matroska.parse(bytes(broken))


def test_column_against_brute_force(spark, sf):
    rows = [tuple(r) for r in common.documents(spark, sf).select("doc_id", "text").collect()] + [(10**6, None), (10**6 + 1, ""), (10**6 + 1, ""), (None, "é" * 99), (10**6 + 2, "x" * 128), (10**6 + 3, "y" * 400_000)]
    docs = spark.createDataFrame([(*r, 1, b"m") for r in rows], "doc_id long, text string, n_bytes int, media binary")
    got = matroska.features(matroska.media(docs)).collect()
    expect = []
    for d, t in rows:
        raw = (t or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        expect.append((d, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expect, key=key)
    table = matroska.packets(matroska.media(docs))
    assert table.agg({"size": "sum"}).first()[0] == sum(e[2] for e in expect)


def test_features_against_brute_force(spark):
    texts = ["", "abc", "é" * 5000, "~" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in matroska.features(matroska.media(docs)).collect()}
    for i, text in enumerate(texts):
        raw = text.encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        data = matroska.mux(payload)
        signed = [b - 128 for b in payload]
        frames = -(-len(payload) // matroska.FRAME)
        clusters = -(-frames // (matroska.LACED * matroska.BLOCKS))
        crossings = sum((a < 0) != (b < 0) for a, b in zip(signed, signed[1:]))
        assert got[i]["feature"] == f"codec=A_PCM/INT/LIT;packets={frames};clusters={clusters};cues={clusters};end_ms={len(payload) * 1000 // matroska.RATE};mean={sum(payload) * 1000 // len(payload)};energy={sum(x * x for x in signed) // len(payload)};crossings={crossings}"
        assert (got[i]["media_bytes"], got[i]["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())


def test_mandatory_elements_and_limits():
    data = matroska.mux(b"x" * 64)
    found = {}
    for ident, a, b in matroska.elements(data, 0, len(data)):
        for inner, c, d in matroska.elements(data, a, b):
            found[inner] = data[c:d]
            found.update({leaf: data[e:f] for leaf, e, f in matroska.elements(data, c, d)} if inner in (matroska.INFO, matroska.TRACKS) else {})
    entry = found[matroska.TRACK_ENTRY]
    assert {i for i, _, _ in matroska.elements(entry, 0, len(entry))} >= {matroska.TRACK_NUMBER, matroska.TRACK_UID, matroska.TRACK_TYPE, matroska.CODEC_ID}
    assert {matroska.DOC_TYPE, matroska.TYPE_VERSION, matroska.MUXING_APP, matroska.WRITING_APP, matroska.TIMESTAMP_SCALE} <= set(found)
    with pytest.raises(ValueError):
        matroska.mux(bytes(400_000), blocks=64)


def test_empty_and_null_media(spark):
    assert matroska.packets(spark.createDataFrame([(1, None)], "doc_id long, media binary")).count() == 0
    assert matroska.features(matroska.media(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
