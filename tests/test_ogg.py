"""Ogg: pages, packets over page borders, torn pages, lengths, FLAC in Ogg, routing."""

import struct
import sys

import numpy as np
import pytest

from crestline.operators import packets as packet_ops
from crestline.sources import files, ogg, registry


def crc(data):
    """Bit by bit, as the format describes it."""
    state = 0
    for byte in data:
        state ^= byte << 24
        for _ in range(8):
            state = (state << 1 ^ (0x04C11DB7 if state >> 31 else 0)) & 0xFFFFFFFF
    return state


def made(seed, n=60, segments=5, serial=7):
    rng = np.random.default_rng(seed)
    payload = [rng.bytes(int(k)) for k in rng.choice([0, 1, 100, 254, 255, 256, 510, 700, 2000], n)]
    payload[n // 2] = b"xx" + ogg.write_ogg([b"inner"], [1]) + b"OggS" + bytes(40)  # pages within a packet
    head = b"OpusHead" + struct.pack("<BBHIhB", 1, 2, 312, 44100, 0, 0)
    return [head, *payload], ogg.write_ogg([head, *payload], [0, *(312 + 960 * (k + 1) for k in range(n))], serial, segments)


def test_pages_and_checksums():
    payload, data = made(1)
    found = list(ogg.pages(data))
    assert b"".join(data[p.at : p.at + p.length] for p in found) == data and [p.number for p in found] == list(range(len(found)))
    for p in found[:5]:
        page = data[p.at : p.at + p.length]
        assert struct.unpack_from("<I", page, 22)[0] == crc(page[:22] + bytes(4) + page[26:])
    assert found[0].flags == ogg.FIRST and found[-1].flags & ogg.LAST and found[-1].granule == 312 + 960 * 60
    assert ogg.streams(data)[0].packets == payload


def test_two_streams_and_strange_files():
    one, two = made(2, serial=1)[1], made(3, serial=2)[1]
    a, b = list(ogg.pages(one)), list(ogg.pages(two))
    mixed = b"".join(x[p.at : p.at + p.length] for pair in zip(a, b, strict=False) for x, p in zip((one, two), pair, strict=True))
    assert [s.packets[:9] for s in ogg.streams(mixed)] == [made(2)[0][:9], made(3)[0][:9]]
    for data in (b"", b"OggS", b"OggS" * 50, b"x" * 100, one[:20], one[40:70]):
        with pytest.raises(registry.AudioError, match="no stream"):
            ogg.decode_ogg(data)
    with pytest.raises(registry.Routed) as e:
        ogg.decode_ogg(one)
    assert e.value.extension == "opus"
    vorbis = ogg.write_ogg([b"\1vorbis" + struct.pack("<IBIiiiBB", 0, 2, 44100, 0, 0, 0, 0, 1)], [0])
    with pytest.raises(registry.Routed) as e:
        ogg.decode_ogg(vorbis)
    assert e.value.extension == "vorbis"


@pytest.mark.parametrize("share", [700, 5000, 1 << 20])
def test_packets_through_spark(spark, tmp_path, share):
    rng, want = np.random.default_rng(share), {}
    for k in range(6):
        payload, data = made(k, segments=3 + 2 * k)
        found = list(ogg.pages(data))
        if k > 2:  # torn, cut out and repeated pieces
            raw = bytearray(data)
            for p in rng.choice(found[1:], 4, replace=False):
                raw[p.at + p.length - 1] ^= 1
            data = bytes(raw)
        if k == 4:
            data = data[: found[6].at] + data[found[8].at :]
        if k == 5:
            data = data[found[3].at :]  # begins in the middle
        (tmp_path / f"{k}.OGG").write_bytes(data)
        want[f"{k}.OGG"] = max((s.packets for s in ogg.streams(data)), key=len)
        assert (None in want[f"{k}.OGG"]) == (k > 2) and (k > 2 or want[f"{k}.OGG"] == payload)
        assert set(want[f"{k}.OGG"]) - {None} <= set(payload)
    (tmp_path / "none.ogg").write_bytes(b"nothing of that kind")
    table = ogg.page_table(spark, str(tmp_path), share=share).where("serial = 7 OR error IS NOT NULL")  # a page within a torn one is found
    rows = ogg.payloads(ogg.packets(table)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        assert (r["payload"] is None) == r["failed"] and (r["failed"] or len(r["payload"]) == r["length"])
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append(None if r["payload"] is None else bytes(r["payload"]))
    assert got == want
    assert all(sorted(r["seq"] for r in rows if r["path"].endswith(f"/{k}.OGG")) == list(range(len(want[f"{k}.OGG"]))) for k in range(6))
    known = {r["path"].rsplit("/", 1)[1]: (r["codec"], r["sample_rate"], r["channels"], r["sample_count"]) for r in ogg.stream_table(table).collect()}
    assert {k: v for k, v in known.items() if k[0] in "012"} == {f"{k}.OGG": ("Opus", 48000, 2, 960 * 60) for k in range(3)}
    # failed packets count as those of any source do
    rows = ogg.packets(table).selectExpr("path AS track_id", "seq", "CASE WHEN NOT failed THEN array(1.0f) END AS samples")
    failed = {r["track_id"].rsplit("/", 1)[1]: r["skipped_packets"] for r in packet_ops.decode_failures(rows).collect()}
    assert failed == {name: sum(p is None for p in packets) for name, packets in want.items()}


def test_granules_of_packets(spark, tmp_path):
    payload, data = made(9)
    (tmp_path / "a.opus").write_bytes(data)
    table = ogg.page_table(spark, str(tmp_path))
    rows = ogg.packets(table).where("granule IS NOT NULL").collect()
    assert rows and all(r["granule"] == (0 if r["seq"] == 0 else 312 + 960 * r["seq"]) for r in rows)
    assert sorted(r["granule"] for r in rows) == sorted(p.granule for p in ogg.pages(data) if p.granule >= 0)


def test_flac_in_ogg(spark, tmp_path):
    x = np.round(np.random.default_rng(1).normal(0, 3000, (2, 5000))).astype(np.int64)
    data = ogg.write_flac(x, 44100, 16, 512, segments=4)
    (tmp_path / "a.ogg").write_bytes(data)
    page = list(ogg.pages(data))[8]
    (tmp_path / "torn.ogg").write_bytes(data[: page.at + 60] + b"\0\0" + data[page.at + 62 :])
    (tmp_path / "lossy.ogg").write_bytes(made(1)[1])
    (tmp_path / "b.opus").write_bytes(made(1)[1])
    known, blocks = ogg.decode_ogg(data)
    assert np.array_equal(np.concatenate(list(blocks)), (x.T / 32768).astype(np.float32)) and known.sample_count == 5000
    program = "import sys; sys.stdin.buffer.read(); sys.stdout.buffer.write(bytes(8000))"
    for decoders, lossy in ((None, "DecodingError"), ({"opus": registry.process_decoder([sys.executable, "-c", program], 48000, 2)}, None)):
        meta, _ = files.analyse(spark, str(tmp_path), decoders=decoders)
        got = {r["path"].rsplit("/", 1)[1]: r for r in meta.collect()}
        assert got["a.ogg"]["actual_frames"] == 5000 and got["a.ogg"]["codec"] == "FLAC" and not got["a.ogg"]["is_partial"]
        assert 3000 < got["torn.ogg"]["actual_frames"] < 5000 and got["torn.ogg"]["skipped_packets"] >= 1 and got["torn.ogg"]["is_partial"]
        assert got["lossy.ogg"]["error_kind"] == got["b.opus"]["error_kind"] == lossy


def test_short_flac_streams_are_decoded_side_by_side(monkeypatch):
    """Frames of 40 files in as many steps as there are block sizes, with the results of each file by itself."""
    import pyarrow as pa

    from crestline.sources import files, flac, registry

    rng = np.random.default_rng(5)
    tracks = [rng.integers(-9000, 9000, (2, 192 * 2 + 30 * (k % 2))) for k in range(40)]
    made = [ogg.write_flac(x, 300, 16, 192, segments=3) for x in tracks]
    torn = bytearray(made[9])
    torn[len(torn) // 2] ^= 1
    made[9], made[21] = bytes(torn), b"OggS"
    batch = pa.RecordBatch.from_pydict({"path": [f"file:/{k:02d}.ogg" for k in range(40)], "content": made})
    calls, own = [], flac._decode
    monkeypatch.setattr(flac, "_decode", lambda data, frames, room: calls.append(len(frames)) or own(data, frames, room))
    read = files._read_files(registry.known_decoders())
    together = [row for out in read(iter([batch])) for row in out.to_pylist()]
    assert len(calls) <= 2 + 2
    alone = [row for k in range(40) for out in read(iter([batch.slice(k, 1)])) for row in out.to_pylist()]
    order = lambda rows: sorted(map(str, rows))
    assert order(together) == order(alone)
    told = {row["path"]: row for row in together if row["win"] is None}
    assert [p for p, row in told.items() if row["error"]] == ["file:/21.ogg"] and told["file:/09.ogg"]["skipped_packets"] > 0
    assert all(told[f"file:/{k:02d}.ogg"]["actual_frames"] == x.shape[1] for k, x in enumerate(tracks) if k not in (9, 21))
