"""Round trips through AVI motion-JPEG, a general frame, indexes and shots."""

import math
import random
import struct

import numpy as np
import pytest

from voxfield.llm import media

SCHEMA = "doc_id long, text string, media string, id long"


@pytest.mark.parametrize("data", [b"", b"a" * 64, b"\xff" * 65, bytes(range(256)) * 9, random.Random(1).randbytes(70_001)])
def test_round_trip(data):
    avi = media.pack(data)
    payload, frames, fps = media.unpack(avi)
    assert payload == data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data)) and fps == media.FPS
    assert struct.unpack_from("<I", avi, 4)[0] + 8 == len(avi)
    without = bytearray(avi)
    without[avi.rindex(b"idx1") : avi.rindex(b"idx1") + 4] = b"JUNK"  # no index: walk the list
    assert media.read_avi(bytes(without))["frames"] == media.read_avi(avi)["frames"]


def test_general_decoder_agrees(monkeypatch):
    samples = np.frombuffer(random.Random(2).randbytes(128), np.uint8).reshape(1, 128)
    frame = media.encode_frames(samples)[0]
    flat = media.decode_frame(frame)
    monkeypatch.setattr(media, "_FIXED_DC", ())
    full = media.decode_frame(frame)
    assert (np.kron(flat, np.ones((8, 8))) == full).all() and flat.reshape(-1).tolist() == samples[0].tolist()


def test_general_decoder_with_ac_and_subsampling():
    """Two components, one subsampled, with AC coefficients, coded by tables of fixed 8-bit codes."""
    rng = random.Random(3)
    symbols = sorted({*range(8), *(r << 4 | s for r in range(4) for s in range(1, 6))})
    table = lambda k: media._segment(0xC4, bytes([k] + [0] * 7 + [len(symbols)] + [0] * 8 + symbols))
    quant = [rng.randint(1, 9) for _ in range(64)]
    bits = ""

    def put(symbol, value=0):
        nonlocal bits
        bits += format(symbols.index(symbol), "08b")
        n = symbol & 15
        if n:
            bits += format(value if value > 0 else value + (1 << n) - 1, f"0{n}b")

    blocks, last = [], [0, 0]
    for _ in range(4):  # four MCUs of 16x8: two luma blocks, one of the other component
        for c in (0, 0, 1):
            z = [0] * 64
            z[0] = rng.randint(-60, 60)
            for k in (1, 2, 5, 9):  # runs of 0, 0, 2 and 3 zeros
                z[k] = rng.choice([-9, -2, 1, 5, 17])
            d = z[0] - last[c]
            last[c] = z[0]
            put(abs(d).bit_length(), d)
            for run, k in ((0, 1), (0, 2), (2, 5), (3, 9)):
                put(run << 4 | abs(z[k]).bit_length(), z[k])
            put(0)
            blocks.append((c, z))
    bits += "1" * (-len(bits) % 8)
    raw = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    sof = media._segment(0xC0, struct.pack(">BHHB", 8, 16, 32, 2) + bytes([1, 0x21, 0, 2, 0x11, 0]))
    head = b"\xff\xd8" + media._segment(0xDB, bytes([0, *quant])) + sof + table(0x00) + table(0x10) + media._segment(0xDA, bytes([2, 1, 0x00, 2, 0x00, 0, 63, 0]))
    luma = media.decode_frame(head + raw + b"\xff\xd9")
    assert luma.shape == (16, 32)
    assert sorted(media.ZIGZAG.tolist()) == list(range(64)) and media.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2]
    c = np.array([[(math.sqrt(1 / 8) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])
    at = [(0, 0), (0, 8), (0, 16), (0, 24), (8, 0), (8, 8), (8, 16), (8, 24)]
    for (y, x), (_, z) in zip(at, [b for b in blocks if b[0] == 0], strict=True):
        square = np.zeros(64)
        square[media.ZIGZAG] = np.array(z) * np.array(quant)
        assert np.abs(np.clip(c.T @ square.reshape(8, 8) @ c + 128, 0, 255) - luma[y : y + 8, x : x + 8]).max() <= 0.51


def test_shots_and_clips():
    dark, light = np.full(64, 20, np.uint8), np.full(64, 220, np.uint8)
    frames = [dark] * 5 + [light] * 3 + [dark] * 2
    assert media.shots(frames) == [(0, 5), (5, 8), (8, 10)] and media.shots([]) == []
    assert media.clips(frames, 10)[1] == {"clip": 1, "start_frame": 5, "end_frame": 8, "start_s": 0.5, "end_s": 0.8, "mean_luma": 220.0}


def test_operator(spark):
    texts = ["", None, "abc", "abc", "é" * 100, "long " * 30_000]
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in enumerate(texts)] + [(None, "x", "c", 1)], SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in media.store_as_media(df).collect()}
    assert len(got) == len(texts) + 1
    for i, x in enumerate(texts):
        assert got[i]["n_bytes"] == len((x or "").encode()) and bytes(got[i]["payload"]).rstrip(b"\0") == (x or "").encode()
    assert got[2]["media"] == got[3]["media"] and got[0]["media"] == got[1]["media"]
    assert media.store_as_media(df.limit(0)).count() == 0
    files = spark.createDataFrame([(1, got[5]["media"]), (2, None), (3, bytearray(b"junk")), (4, bytearray(damaged(media.pack(b"abc"))))], "id long, media binary")
    rows = media.media_clips(files, "id", "media").collect()
    assert {r["id"] for r in rows if r["error"]} == {2, 3, 4} and sum(r["id"] == 1 for r in rows) == len(got[5]["clips"])


def damaged(avi):
    """Sampling factors of 0, which nothing may divide by."""
    at = avi.index(b"\xff\xc0")
    return avi[: at + 11] + b"\0" + avi[at + 12 :]


def test_damaged_frames_end_early():
    frame = media.encode_frames(np.zeros((1, 64), np.uint8))[0]
    at = frame.index(b"\xff\xc0")
    huge = frame[: at + 5] + b"\xff\xff\xff\xff" + frame[at + 9 :]
    with pytest.raises(ValueError):
        media._general(b"\x12\x34", 65535, 65535, [(1, 1, 1, 0)], {1: 0}, {0: np.ones(64)}, {}, 0)
    with pytest.raises((ValueError, IndexError)):
        media.decode_frame(huge[:200])


def test_standard_tables_stand_in():
    """A frame without tables reads like one that brings the typical ones."""
    tables = media._standard()
    assert {k: len(x) for k, x in tables.items()} == {0x00: 12, 0x01: 12, 0x10: 162, 0x11: 162}
    assert all(sum(2.0**-n for n, _ in x) < 1 for x in tables.values())
    # luma DC category 3 (code 100), value 5 (101); end of block (1010); then category 0 (00) and end of block
    raw = int("100" + "101" + "1010" + "00" + "1010", 2).to_bytes(2, "big")
    out = media._general(raw, 8, 16, [(1, 1, 1, 0)], {1: 0}, {0: np.full(64, 8.0)}, {}, 0)
    assert out.shape == (8, 16) and set(out.reshape(-1).tolist()) == {133}
