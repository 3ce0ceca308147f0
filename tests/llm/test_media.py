from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from tests.llm.helpers import ODD, docs_of

from aspectra.llm import media as M


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 192 * 8, 192 * 9, 192 * 128, 192 * 300 + 5])
def test_round_trip(n):
    text = bytes(random.Random(n).randrange(256) for _ in range(n))
    payload = M.padded(text)
    assert len(payload) % 192 == 0 and payload.startswith(text) and len(payload) > 0
    data = M.store(payload)
    found = M.parse(data)
    assert M.payload_of(found, data) == payload
    assert found.duration_ms == len(payload) // 192 * 24
    assert [p[1] for p in found.packets] == [24 * i for i in range(len(payload) // 192)]
    assert found.cues == [(t, place) for place, t in found.clusters]


def block(flags, body, track=b"\x82", when=5):
    return track + when.to_bytes(2, "big") + bytes([flags]) + body


def segment(*blocks, unknown=False):
    content = M.number(M.TIMESTAMP, 100) + b"".join(blocks)
    cluster = M.CLUSTER.to_bytes(4, "big") + (b"\xff" if unknown else M.vint(len(content))) + content
    return M.element(M.EBML, M.element(M.DOC_TYPE, b"webm")) + M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster


@pytest.mark.parametrize("unknown", [False, True])
def test_all_lacings_and_unknown_sizes(unknown):
    frames = [b"a" * 300, b"b" * 20, b"c" * 25]
    joined = b"".join(frames)
    xiph = block(0x02, bytes([2, 255, 45, 20]) + joined)
    step = (20 - 300) + (1 << 13) - 1
    ebml = block(0x06, bytes([2]) + M.vint(300) + M.vint(step, 2) + joined)
    fixed = block(0x84, bytes([1]) + b"x" * 10)
    plain = block(0x80, b"solo")
    data = segment(M.element(M.SIMPLE_BLOCK, xiph), M.element(M.BLOCK_GROUP, M.element(M.BLOCK, ebml)), M.element(M.SIMPLE_BLOCK, fixed), M.element(M.SIMPLE_BLOCK, plain), unknown=unknown)
    found = M.parse(data)
    want = [*frames, *frames, b"x" * 5, b"x" * 5, b"solo"] * 2
    assert [data[a:b] for _, _, _, a, b in found.packets] == want
    assert {t for t, *_ in found.packets} == {2}
    assert {p[1] for p in found.packets} == {105}
    assert found.doc_type == "webm" and len(found.clusters) == 2


def test_damage_is_an_error():
    data = M.store(M.padded(b"some text"))
    for cut in (len(data) - 1, len(data) // 2):
        with pytest.raises(ValueError):
            M.parse(data[:cut])


def test_columns(spark):
    df = docs_of(spark, ODD)
    media = M.store_column(df)
    got = {r.doc_id: r for r in M.media_features(media).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = M.padded(raw)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_sha256 == hashlib.sha256(M.store(payload)).hexdigest()
    assert got[len(ODD) - 1].feature == got[len(ODD) - 2].feature  # equal texts
    packets = M.packet_table(media).collect()
    assert len(packets) == sum(r.payload_bytes // 192 for r in got.values())
    assert M.media_features(media.limit(0)).count() == 0


def test_null_and_damaged_media_are_told(spark):
    whole = M.store(M.padded(b"some text"))
    df = spark.createDataFrame([(1, 9, bytearray(whole)), (2, 9, None), (3, 9, bytearray(whole[:-7])), (4, 0, bytearray(b""))], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in M.media_features(df).collect()}
    assert got[1].payload_bytes == 192
    assert [got[i].feature for i in (2, 3, 4)] == ["none", "damaged", "damaged"]
    assert got[3].payload_sha256 is None
