"""Matroska: exact round trips, all kinds of lacing, unknown lengths and damage."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import matroska as m


@given(st.integers(0, 2**55))
def test_numbers(value):
    raw = m.number(value)
    assert m.read_number(raw, 0) == (value, len(raw))


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 576 * 9, 576 * 300 + 5])
def test_round_trip(size):
    payload = m.pad(random.Random(size).randbytes(size))
    media = m.write(payload)
    packets, cues = m.parse(media)
    assert b"".join(media[p[3] : p[3] + p[4]] for p in packets) == payload and len(payload) % m.FRAME == 0 and payload
    assert [p[1] for p in packets] == [i * m.FRAME_MS * 1_000_000 for i in range(len(packets))]
    assert sum(p[7] for p in packets) == len(cues) > 0 and {p[0] for p in packets} == {1}
    assert len({p[5] for p in packets}) == (4 if size > 576 * 40 else len({p[5] for p in packets}))


@pytest.mark.parametrize("lacing", [m.XIPH, m.FIXED, m.EBML_LACING])
def test_lacing(lacing):
    rng = random.Random(lacing)
    for _ in range(50):
        n = rng.randrange(2, 9)
        sizes = [rng.choice([1, 254, 255, 256, 510, 9000])] * n if lacing == m.FIXED else [rng.choice([1, 63, 64, 254, 255, 256, 510, 9000]) for _ in range(n)]
        frames = [rng.randbytes(s) for s in sizes]
        raw = m._block(frames, -5, lacing)
        ((kind, _, body, end),) = m.elements(raw, 0, len(raw))
        track, relative, _, found, ranges = m.frames_of(raw, body, end)
        assert (kind, track, relative, found) == (m.SIMPLE_BLOCK, 1, -5, lacing)
        assert [raw[a : a + s] for a, s in ranges] == frames


def test_unknown_lengths_groups_and_unknown_elements():
    unknown = b"\x01" + b"\xff" * 7
    block = m._block([b"abc", b"de"], 0, m.XIPH)
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block[2:]) + m.element(0xFB, b"\x01"))
    cluster = m.CLUSTER.to_bytes(4, "big") + unknown + m.unsigned(m.TIMESTAMP, 7) + m.element(0xEC, b"void") + group
    data = m.element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + unknown + cluster + cluster
    packets, cues = m.parse(data)
    assert [data[p[3] : p[3] + p[4]] for p in packets] == [b"abc", b"de"] * 2 and cues == [] and packets[0][1] == packets[2][1] == 7_000_000
    assert not any(p[6] for p in packets) and packets[1][1:3] == (7_000_000, None)  # refers to another block; no duration is told


def test_a_foreign_file():
    """Hand-made: its own timestamp scale, two tracks, one with a default duration, groups with durations, cues by place and by time."""
    head = bytes.fromhex("1a45dfa3 8b 4282 88 6d6174726f736b61")  # EBML, DocType matroska
    info = bytes.fromhex("1549a966 87 2ad7b1 83 0186a0")  # 100,000 ns a unit
    sound = bytes.fromhex("ae 8c d7 81 01 83 81 02 23e383 82 2710")  # track 1: 10,000 ns a frame
    picture = bytes.fromhex("ae 86 d7 81 02 83 81 01")  # track 2
    tracks = bytes.fromhex("1654ae6b") + m.number(len(sound + picture)) + sound + picture
    laced = bytes.fromhex("a3 8b 81 0003 02 02 01 02 61 6262 63")  # track 1, 3 units late, Xiph: frames of 1, 2 and the rest
    key = bytes.fromhex("a0 8a a1 85 82 fffe 00 78 9b 81 04")  # track 2, 2 units early, lasts 4 units
    other = bytes.fromhex("a0 8a a1 85 82 0005 00 79 fb 81 07")  # refers to another block
    first = bytes.fromhex("e7 81 64") + laced + key + other
    cluster = bytes.fromhex("1f43b675 ff") + first  # of unknown length
    at = len(info) + len(tracks)
    by_place = bytes.fromhex("bb 8e b3 81 62 b7 89 f7 81 02 f1 81") + bytes([at]) + bytes.fromhex("f0 81") + bytes([3 + len(laced)])
    by_time = bytes.fromhex("bb 8b b3 81 67 b7 86 f7 81 01 f1 81") + bytes([at])
    cues = bytes.fromhex("1c53bb6b") + m.number(len(by_place + by_time)) + by_place + by_time
    data = head + bytes.fromhex("18538067 01ffffffffffffff") + info + tracks + cluster + cues
    packets, told = m.parse(data)
    got = [(p[0], p[1], p[2], data[p[3] : p[3] + p[4]], p[5], p[6], p[7]) for p in packets]
    assert got == [
        (1, 10_300_000, 10_000, b"a", m.XIPH, False, True), (1, 10_310_000, 10_000, b"bb", m.XIPH, False, False), (1, 10_320_000, 10_000, b"c", m.XIPH, False, False),
        (2, 9_800_000, 400_000, b"x", m.NO_LACING, True, True), (2, 10_500_000, None, b"y", m.NO_LACING, False, False),
    ]
    assert told == [(9_800_000, 2, at, 3 + len(laced)), (10_300_000, 1, at, None)]


def test_damage():
    media = m.write(m.pad(b"x" * 2000))
    with pytest.raises(ValueError):
        m.parse(media[:-700])


def test_digests(spark, odd, none):
    got = sorted(m.media_digests(odd).collect(), key=str)
    want = []
    for r in odd.select("doc_id", "text").collect():
        raw = (r["text"] or "").encode()
        payload = m.pad(raw)
        media = m.write(payload)
        want.append((r["doc_id"], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()))
    assert sorted((tuple(r[:7]) for r in got), key=str) == sorted(want, key=str)
    features = {}
    for r in got:
        assert features.setdefault(r["media_sha256"], r["feature"]) == r["feature"]
    assert m.media_digests(none).collect() == []


def test_packet_table(spark, odd):
    media = m.media_column(odd.where("doc_id IS NOT NULL"), "text")
    rows = m.packet_table(media, "media", "doc_id", "text").where("doc_id = 10").orderBy("offset").collect()
    file = m.write(m.pad(rows[0]["text"].encode()))
    assert b"".join(file[r["offset"] : r["offset"] + r["size"]] for r in rows).rstrip(b"\xff").decode() == rows[0]["text"]
    cues = m.cue_table(media, "media", "doc_id").where("doc_id = 10").orderBy("time").collect()
    assert [c["time"] for c in cues] == [r["timestamp"] for r in rows if r["cued"]] and {c["track"] for c in cues} == {1}
    empty = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert m.cue_table(empty, "media", "doc_id").collect() == []
    assert m.packet_table(empty, "media", "doc_id").collect() == []
