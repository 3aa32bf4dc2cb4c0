import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxmill.llm import matroska as M


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000) | st.integers(0, 400_000).map(lambda n: bytes(i * 7 % 256 for i in range(n))))
def test_round_trip(raw):
    payload = M.payload_of(raw)
    data = M.write(payload)
    media = M.parse(data)
    assert len(payload) % 576 == 0 and payload.startswith(raw) and payload
    assert b"".join(data[a : a + n] for _, _, a, n in media.packets) == payload
    assert {c for _, _, c in media.cues} == {a for a, _ in media.clusters}
    times = [t for _, t, _, _ in media.packets]
    assert times == sorted(times) and len(set(times)) == len(times)


def block(kind, frames):
    body = b"".join(frames)
    if kind == 0:
        return body
    out = bytes((len(frames) - 1,))
    if kind == 1:
        out += b"".join(b"\xff" * (len(f) // 255) + bytes((len(f) % 255,)) for f in frames[:-1])
    elif kind == 3:
        sizes = [len(f) for f in frames[:-1]]
        out += M._size(sizes[0]) + b"".join(((b - a) + 8191 | 0x4000).to_bytes(2, "big") for a, b in zip(sizes, sizes[1:]))
    return out + body


@pytest.mark.parametrize("kind, frames", [(0, [b"abc"]), (1, [b"x" * 700, b"", b"y" * 255, b"z"]), (2, [b"ab", b"cd", b"ef"]), (3, [b"a" * 300, b"b" * 10, b"c" * 900, b"d"])])
def test_lacing(kind, frames):
    data = block(kind, frames)
    assert [data[a : a + n] for a, n in M.lace(data, 0, len(data), kind)] == frames


def test_unknown_sizes_and_groups():
    cluster = b"\x1f\x43\xb6\x75\xff" + M._number(M.TIMESTAMP, 5) + M._element(M.BLOCK_GROUP, M._element(M.BLOCK, b"\x81\x00\x01\x00abc"))
    data = M._HEADER + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + M._TRACK + cluster + cluster
    media = M.parse(data)
    assert [(t, ns, data[a : a + n]) for t, ns, a, n in media.packets] == [(1, 6_000_000, b"abc")] * 2


@pytest.mark.parametrize("data", [b"", b"\0", b"junk", M._HEADER[:-3], M.write(b"a" * 576)[:-600]])
def test_broken(data):
    with pytest.raises(M.MatroskaError):
        M.parse(data)


def test_tables(spark, odd_docs):
    rows = M.stored(odd_docs, keep_media=True).collect()
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in odd_docs.collect()]
    assert sorted((r["doc_id"] or -1, r["n_bytes"]) for r in rows) == sorted((i or -1, len(t)) for i, t in texts)
    known = {hashlib.sha256(M.payload_of(t)).hexdigest(): M.payload_of(t) for _, t in texts}
    for r in rows:
        payload = known[r["payload_sha256"]]
        assert (r["payload_bytes"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (len(payload), zlib.crc32(payload[-32:]), len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
    assert M.stored(odd_docs.limit(0)).count() == 0
    media = spark.createDataFrame([(1, bytearray(M.write(b"a" * 1152))), (2, None), (3, bytearray(b"junk"))], "doc_id long, media binary")
    packets = M.packet_table(media, "doc_id", "media").orderBy("doc_id", "packet").collect()
    assert [(p["doc_id"], p["packet"], p["size"], p["error"] is None) for p in packets] == [(1, 0, 576, True), (1, 1, 576, True), (2, None, None, False), (3, None, None, False)]
