"""Media columns: AVI motion-JPEG. Payloads are stored as frames and read back; frames are cut into shots and clips.

Storage unit: one 8x8 block of a grey baseline JPEG for each payload byte. With a DC quantiser of 8 a block that has only a
DC coefficient decodes to 64 equal pixels of exactly that byte, so the lossy codec stores bytes losslessly and any
decoder shows them. The Huffman table gives category s a code of 9-s bits, so that code and magnitude bits make 9
for every difference, and the end of a block is 1 bit: 10 bits a block, which numpy packs and unpacks as a whole.
Reading parses the RIFF chunks and the idx1 index, then decodes each frame; frames by other encoders (any baseline
Huffman tables, or the standard ones where a file leaves them out, subsampled colour, restart intervals) go through a general decoder,
which returns their luma.

Shots: the difference of neighbouring frames is half the sum of absolute differences of their 16-bin luma histograms. A
shot ends where that exceeds both FLOOR and the mean plus 3 deviations of up to 8 differences before it in the shot.

Nulls: a null text is an empty one; its payload is 64 zero bytes. Equal texts give equal media. Rows are independent.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield.llm.common import as_bytes, text_blocks

UNIT = 64  # payloads are padded to a multiple of this
FRAME_UNITS = 16  # at most so many units of 64 blocks in a frame
FPS = 10
FLOOR = 0.15
CLIP = "struct<clip: int, start_frame: int, end_frame: int, start_s: double, end_s: double, mean_luma: double>"

#: Zigzag order of the JPEG standard, built from its diagonals: entry k is the row-major place of coefficient k.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))])
_COS = np.array([[(np.sqrt(1 / 8) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])

_DIFF = np.arange(-255, 256)
_CAT = np.array([int(abs(d)).bit_length() for d in _DIFF.tolist()])
_BITS = np.where(_DIFF > 0, _DIFF, _DIFF + (1 << _CAT) - 1)
_WORD = ((((1 << (8 - _CAT)) - 1) << (_CAT + 1) | _BITS) << 1).astype(np.uint64)  # ones, a zero, the magnitude, end of block
_BACK = np.full(1024, 9999, np.int32)
_BACK[_WORD.astype(np.int64)] = _DIFF


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_DQT = _segment(0xDB, bytes([0] + [8] * 64))
_DHT = _segment(0xC4, bytes([0x00] + [1] * 9 + [0] * 7 + list(range(8, -1, -1)))) + _segment(0xC4, bytes([0x10, 1] + [0] * 15 + [0]))
_SOS = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of frames (n, blocks), 8 blocks wide; blocks a multiple of 64."""
    value = samples.astype(np.int16) - 128
    diff = np.diff(value, axis=1, prepend=np.int16(0))
    word = _WORD[diff + 255].reshape(len(samples), -1, 4)
    packed = (word[:, :, 0] << 30 | word[:, :, 1] << 20 | word[:, :, 2] << 10 | word[:, :, 3]) << np.uint64(24)
    raw = packed.byteswap().view(np.uint8).reshape(len(samples), -1, 8)[:, :, :5].reshape(len(samples), -1)
    high = samples.shape[1]
    head = b"\xff\xd8" + _DQT + _segment(0xC0, struct.pack(">BHHBBBB", 8, high, 64, 1, 1, 0x11, 0)) + _DHT + _SOS
    return [head + x.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for x in raw]


def write_avi(frames: list[bytes], width: int, height: int, payload: int | None = None, fps: int = FPS) -> bytes:
    """A RIFF AVI of JPEG frames with an idx1 index; `payload` goes into a chunk of its own, which players skip."""
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    size = np.array([len(x) for x in frames], np.int64)
    step = 8 + size + size % 2
    index = np.empty((len(frames), 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, 4 + np.cumsum(step) - step, size
    body = b"AVI " + hdrl + (chunk(b"plen", struct.pack("<Q", payload)) if payload is not None else b"")
    body += chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", x) for x in frames)) + chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(data: bytes) -> dict:
    """width, height, fps, payload and the frames' bytes, by the idx1 index or, without one, by walking movi."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"width": 0, "height": 0, "fps": FPS, "payload": None}
    movi, index, walked = None, None, []
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    movi = (body, min(end, body + size))
                else:
                    todo.append((body + 4, min(end, body + size)))
            elif name == b"avih":
                head = struct.unpack_from("<14I", data, body)
                out |= {"width": head[8], "height": head[9], "fps": 1_000_000 / head[0] if head[0] else FPS}
            elif name == b"plen":
                out["payload"] = struct.unpack_from("<Q", data, body)[0]
            elif name == b"idx1":
                index = np.frombuffer(data, "<u4", size // 16 * 4, body).reshape(-1, 4)
            at = body + size + size % 2
    if movi is None:
        raise ValueError("no movi list")
    if index is not None:
        base = movi[0] if not len(index) or index[0, 2] < movi[0] else 0  # offsets count from movi or from the file's start
        walked = [(base + o + 8, n) for k, o, n in index[:, [0, 2, 3]].tolist() if k.to_bytes(4, "little")[2:] in (b"dc", b"db")]
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if data[at + 2 : at + 4] in (b"dc", b"db"):
                walked.append((at + 8, size))
            at += 8 + size + size % 2
    out["frames"] = [data[a : a + n] for a, n in walked]
    return out


def _tables(body: bytes) -> dict[int, tuple[tuple[int, int], ...]]:
    """Class and number of each Huffman table -> its (length, symbol) in code order."""
    out, at = {}, 0
    while at < len(body):
        counts, k = body[at + 1 : at + 17], at + 17
        symbols = []
        for n, c in enumerate(counts, 1):
            symbols += [(n, s) for s in body[k : k + c]]
            k += c
        out[body[at]], at = tuple(symbols), k
    return out


_FIXED_DC, _FIXED_AC = tuple((9 - s, s) for s in range(8, -1, -1)), ((1, 0),)


def decode_frame(data: bytes) -> np.ndarray:
    """The luma of one intra frame: (rows, columns) of blocks' values where all blocks are flat by this module's tables,
    else the pixels."""
    at, quant, huff, frame, restart = 2, {}, {}, None, 0
    while True:
        if data[at] != 0xFF:
            raise ValueError("no marker")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.float64)
                k += 65 + 64 * wide
        elif marker == 0xC4:
            huff |= _tables(body)
        elif marker in (0xC0, 0xC1):
            frame = struct.unpack_from(">BHHB", body), [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, len(body), 3)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline frames can be decoded")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            break
    if frame is None:
        raise ValueError("no frame header")
    (_, height, width, _), parts = frame
    if not parts or any(not 1 <= p[1] <= 4 or not 1 <= p[2] <= 4 for p in parts) or not height or not width:
        raise ValueError("damaged frame header")
    scan = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
    end = data.rfind(b"\xff\xd9")
    coded = data[at : end if end >= 0 else len(data)]
    if len(parts) == 1 and not restart and huff.get(0) == _FIXED_DC and huff.get(16) == _FIXED_AC and quant[parts[0][3]][0] == 8:
        rows, columns = -(-height // 8), -(-width // 8)
        if 10 * rows * columns > 8 * len(coded):
            raise ValueError("frame ends early")
        return _flat(coded.replace(b"\xff\x00", b"\xff"), rows * columns).reshape(rows, columns)
    return _general(coded, height, width, parts, scan, quant, huff, restart)


def _flat(raw: bytes, blocks: int) -> np.ndarray:
    whole = np.zeros((-(-blocks // 4), 8), np.uint8)
    held = np.frombuffer(raw, np.uint8)
    five = np.zeros(len(whole) * 5, np.uint8)
    five[: len(held)] = held[: len(five)]
    whole[:, 3:] = five.reshape(-1, 5)
    packed = whole.view(">u8")[:, 0].astype(np.uint64)
    words = np.stack([packed >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], 1).reshape(-1)[:blocks]
    value = np.cumsum(_BACK[words.astype(np.int64)]) + 128
    if value.size and (value.min() < 0 or value.max() > 255):
        raise ValueError("damaged frame")
    return value.astype(np.uint8)


def _codes(symbols: tuple[tuple[int, int], ...]) -> tuple[list[int], list[int]]:
    """For each 16 bits that may come: the length of the code that they begin with (0: none) and its symbol."""
    sizes, values, at, last = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8), 0, 0
    for n, s in symbols:
        if n < last or at + (1 << (16 - n)) > 1 << 16:
            raise ValueError("damaged Huffman table")
        sizes[at : at + (1 << (16 - n))], values[at : at + (1 << (16 - n))] = n, s
        at, last = at + (1 << (16 - n)), n
    return sizes.tolist(), values.tolist()


def _standard() -> dict[int, tuple[tuple[int, int], ...]]:
    """The typical tables of the JPEG standard (Annex K), which camera files leave out: class and number -> (length, symbol)."""
    # How many codes each length has, and the first AC symbols; the others follow in ascending order.
    counts = {
        0x00: [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0],
        0x01: [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0],
        0x10: [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
        0x11: [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
    }
    luma = bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282")
    chroma = bytes.fromhex("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1")
    every = [0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))]
    symbols = {0x00: list(range(12)), 0x01: list(range(12))}
    for k, head in ((0x10, luma), (0x11, chroma)):
        symbols[k] = [*head, *sorted(set(every) - set(head))]
    return {k: tuple((n, s) for n, s in zip([n for n, c in enumerate(counts[k], 1) for _ in range(c)], symbols[k], strict=True)) for k in counts}


def _general(coded: bytes, height: int, width: int, parts: list, scan: dict, quant: dict, huff: dict, restart: int) -> np.ndarray:
    """Baseline decoding for frames of other encoders: codes are looked up by the next 16 bits."""
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    blocks = sum(p[1] * p[2] for p in parts)
    if across * down * blocks > 4 * len(coded):  # a block takes two bits at least
        raise ValueError("frame ends early")
    huff = _standard() | huff
    lookup = {k: _codes(x) for k, x in huff.items()}
    tables = [(lookup[scan[p[0]] >> 4], lookup[16 | scan[p[0]] & 15]) for p in parts]
    luma = np.zeros((down * parts[0][2] * 8, across * parts[0][1] * 8))
    done = 0
    for piece in re.split(rb"\xff[\xd0-\xd7]", coded):
        raw = piece.replace(b"\xff\x00", b"\xff")
        at, total, raw = 0, 8 * len(raw), raw + b"\0" * 4

        def symbol(table: tuple[list[int], list[int]]) -> int:
            nonlocal at
            k = at >> 3
            bits = (raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) >> (8 - (at & 7)) & 0xFFFF
            n = table[0][bits]
            at += n
            if not n or at > total:
                raise ValueError("frame ends early" if n else "unknown code")
            return table[1][bits]

        def number(s: int) -> int:
            nonlocal at
            if not s:
                return 0
            k = at >> 3
            at += s
            if at > total:
                raise ValueError("frame ends early")
            v = int.from_bytes(raw[k : k + 4], "big") >> (32 - (at - 8 * k)) & ((1 << s) - 1)
            return v if v >> (s - 1) else v - (1 << s) + 1

        before = [0] * len(parts)
        for mcu in range(done, min(across * down, done + restart) if restart else across * down):
            for c, (_, h, v, q) in enumerate(parts):
                dc, ac = tables[c]
                for k in range(h * v):
                    block = np.zeros(64)
                    before[c] += number(symbol(dc))
                    block[0], z = before[c], 1
                    while z < 64:
                        s = symbol(ac)
                        if s == 0:
                            break
                        z += s >> 4
                        if s & 15:
                            block[z] = number(s & 15)
                        z += 1
                    if c == 0:
                        square = np.zeros(64)
                        square[ZIGZAG] = block * quant[q]
                        y, x = (mcu // across * v + k // h) * 8, (mcu % across * h + k % h) * 8
                        luma[y : y + 8, x : x + 8] = _COS.T @ square.reshape(8, 8) @ _COS + 128
        done += restart
    return np.clip(np.rint(luma[:height, :width]), 0, 255).astype(np.uint8)


def shots(frames: list[np.ndarray]) -> list[tuple[int, int]]:
    """First and last+1 frame of each shot."""
    cuts, seen, last = [0], [], None
    for i, x in enumerate(frames):
        h = np.bincount(x.reshape(-1) >> 4, minlength=16) / max(1, x.size)
        if last is not None:
            d = float(np.abs(h - last).sum()) / 2
            window = seen[-8:]
            mean = sum(window) / len(window) if window else 0.0
            spread = (sum((y - mean) ** 2 for y in window) / len(window)) ** 0.5 if window else 0.0
            if d > max(FLOOR, mean + 3 * spread):
                cuts.append(i)
                seen = []
            else:
                seen.append(d)
        last = h
    return list(zip(cuts, [*cuts[1:], len(frames)], strict=True)) if frames else []


def clips(frames: list[np.ndarray], fps: float = FPS) -> list[dict]:
    """Timed clip rows."""
    return [
        {"clip": k, "start_frame": a, "end_frame": b, "start_s": round(a / fps, 3), "end_s": round(b / fps, 3), "mean_luma": round(sum(int(x.sum()) for x in frames[a:b]) / max(1, sum(x.size for x in frames[a:b])), 3)}
        for k, (a, b) in enumerate(shots(frames))
    ]


def pack(data: bytes) -> bytes:
    """The AVI that stores data, padded with zero bytes to a positive multiple of UNIT."""
    units = max(1, -(-len(data) // UNIT))
    n = -(-units // FRAME_UNITS)
    rows = -(-units // n)
    samples = np.zeros((n, rows * UNIT), np.uint8)
    samples.reshape(-1)[: len(data)] = np.frombuffer(data, np.uint8)
    return write_avi(encode_frames(samples), 64, rows * UNIT, units * UNIT)


def unpack(media: bytes) -> tuple[bytes, list[np.ndarray], float]:
    """The payload read back from the stored bytes, its frames and their rate."""
    avi = read_avi(media)
    frames = [decode_frame(x) for x in avi["frames"]]
    return b"".join(x.tobytes() for x in frames)[: avi["payload"]], frames, avi["fps"]


_CLIPS = pa.list_(pa.struct([("clip", pa.int32()), ("start_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("mean_luma", pa.float64())]))


def store_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media (the AVI), payload (read back from it), frames and clips, a row for each document; no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, most=2 << 20):
            texts = as_bytes(block.column("text"))
            media = [pack(x) for x in texts]
            read = [unpack(x) for x in media]
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary()), pa.array([x[0] for x in read], pa.binary()), pa.array([len(x[1]) for x in read], pa.int32()), pa.array([clips(x[1], x[2]) for x in read], _CLIPS)],
                ["id", "n_bytes", "media", "payload", "frames", "clips"],
            )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, media binary, payload binary, frames int, clips array<{CLIP}>").withColumnRenamed("id", id_col)


def media_clips(files: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Clip rows of a column of AVI files: id, error and the columns of a clip. A null or unreadable file gives one row
    with the error; a file without frames gives one without either."""
    rows = files.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for x in batch.column("media").to_pylist():
                try:
                    avi = read_avi(x or b"")
                    found.append(clips([decode_frame(y) for y in avi["frames"]], avi["fps"]))
                    errors.append(None)
                except (ValueError, IndexError, KeyError, ArithmeticError, struct.error) as e:
                    found.append([])
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(errors, pa.string()), pa.array(found, _CLIPS)], ["id", "error", "clips"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, error string, clips array<{CLIP}>")
    return out.select("id", "error", F.explode_outer("clips").alias("c")).select(F.col("id").alias(id_col), "error", "c.*")
