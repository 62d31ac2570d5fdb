import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import ogg


def slow_checksum(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@given(st.binary(max_size=200))
def test_checksum_bit_by_bit(data):
    assert ogg.checksum(data) == slow_checksum(data)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 254, 255, 256, 510, 765, 70000]), max_size=6), st.integers(1, 255))
def test_packets_of_any_size_round_trip(sizes, segments):
    packets = [(bytes([i + 1]) * n, i) for i, n in enumerate(sizes)]
    pages = [ogg.page(7, 0, ogg.FIRST, 0, b"\x01", b"h"), *ogg.stream_pages(7, packets, 1, segments)]
    stream = ogg.read(b"".join(pages))[7]
    assert stream.packets == [b"h"] + [p for p, _ in packets]


@pytest.mark.parametrize("size", [0, 1, 192, 193, 192 * 255 * 2, 192 * 255 * 2 + 1, 300_000])
def test_payload_round_trip_and_time(size):
    payload = ogg.padded("x" * size)
    found = ogg.decode(ogg.encode(payload, 2**32 - 1))
    assert found.payload == payload and len(payload) % 192 == 0
    assert sum(found.times) == pytest.approx(len(payload) / ogg.RATE)


def test_damage_is_found():
    data = ogg.encode(ogg.padded("some text " * 500), 5)
    for at in (0, 9, 30, len(data) // 2, len(data) - 1):
        with pytest.raises(ogg.OggError):
            ogg.read(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ogg.OggError):
        ogg.read(data[:-1])


def test_query_columns(spark):
    rows = [(1, "héllo", "a"), (2, None, "b"), (2, "", "c"), (None, "y" * 500, None), (1, "héllo", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = ogg.media_features(ogg.text_as_ogg(docs, ["doc_id"]), ["doc_id", "n_bytes", "payload_bytes"]).collect()
    assert len(got) == 5
    for r, (doc_id, text, _) in zip(got, rows):
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (doc_id, len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.error is None
    assert got[0] == got[4] and got[1].media_sha256 == got[2].media_sha256
    assert ogg.text_as_ogg(docs.limit(0), ["doc_id"]).count() == 0


def test_packet_rows(spark):
    media = [(1, bytearray(ogg.encode(ogg.padded("a" * 400), 9))), (2, None), (3, bytearray(b"junk")), (4, bytearray(b""))]
    got = ogg.ogg_packets(spark.createDataFrame(media, "id long, m binary"), "id", "m").collect()
    assert {r.error is None for r in got if r.id == 1} == {True} and {r.serial for r in got if r.id == 1} == {9, 10}
    assert sum(len(r.data) for r in got if r.id == 1 and r.packet > 0) == 576
    assert [r.error for r in got if r.id == 2] == ["no media"] and [r.id for r in got if r.id >= 3] == [3]


def test_packets_within_a_page_have_times(spark):
    raw = ogg.encode(ogg.padded("a" * 192 * 7), 9)
    got = ogg.ogg_packets(spark.createDataFrame([(1, bytearray(raw))], "id long, m binary"), "id", "m").collect()
    ends = {s: [r.granule for r in sorted(got, key=lambda r: r.packet) if r.serial == s] for s in (9, 10)}
    assert ends == {9: [0, 192, 384, 576, 768], 10: [0, 192, 384, 576]}
    assert all(r.seconds == r.granule / ogg.RATE for r in got)


def test_a_page_that_ends_packets_needs_a_granule():
    first = ogg.page(7, 0, ogg.FIRST, 0, b"\x01", b"h")
    with pytest.raises(ogg.OggError, match="without a granule"):
        ogg.read(first + ogg.page(7, 1, ogg.LAST, -1, b"\x03", b"abc"))
    wrong = ogg.STREAM_HEAD.pack(ogg.MAGIC, 1, 1, 8, 8000)
    with pytest.raises(ogg.OggError, match="granule 5 after 3"):
        ogg.decode(ogg.page(7, 0, ogg.FIRST, 0, ogg.lace(len(wrong)), wrong) + ogg.page(7, 1, ogg.LAST, 5, b"\x03", b"abc"))


def test_features_of_broken_null_empty_and_long_containers(spark):
    good = ogg.encode(ogg.padded("some text"), 5)
    rows = [(1, good), (2, None), (3, good[:-1]), (4, b"junk"), (5, b""), (6, ogg.encode(ogg.padded("y" * 3_000_000), 6))]
    frame = spark.createDataFrame([(i, None if x is None else bytearray(x), "z") for i, x in rows], "id long, media binary, feature string")
    got = {r.id: r for r in ogg.media_features(frame, ["id"]).collect()}
    assert [got[i].error is None for i in range(1, 7)] == [True, False, False, False, True, True]
    assert got[3].media_bytes == len(good) - 1 and got[3].payload_sha256 is None and got[2].media_sha256 is None
    assert got[5].feature.startswith("streams=0;") and got[6].payload_sha256 == hashlib.sha256(ogg.padded("y" * 3_000_000)).hexdigest()
