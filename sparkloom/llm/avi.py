"""Media columns: motion-JPEG AVI files held in binary columns.

``encode_payload`` stores bytes losslessly: every byte is one flat 8x8 luminance
block whose DC coefficient, quantised by 8, is exactly the byte less 128. A frame
is 16 x 12 such blocks (128 x 96 pixels, 192 bytes). The frame's Huffman tables
give category s a code of 9 - s bits, so that each block takes 9 bits for the DC
difference and one for the end of block. The files are ordinary baseline JPEG in
ordinary AVI; ``parse_avi`` and ``decode_jpeg`` also read frames with AC terms.

Null or empty text counts as no bytes and is stored as one frame of blanks. Ties
and repeated rows need no care, rows are independent; extra input columns are kept
by ``media_column`` and ``clip_rows``, but for those named like a column they add,
which give way to it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

COLS, ROWS = 16, 12
FRAME = COLS * ROWS
FPS = 25
HIST_BINS = 16

# Fixed values of the JPEG standard: the zigzag order of an 8x8 block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _flat_header() -> bytes:
    dqt = _segment(0xDB, bytes([0]) + bytes([8] * 64))
    sof = _segment(0xC0, struct.pack(">BHHB", 8, ROWS * 8, COLS * 8, 1) + bytes([1, 0x11, 0]))
    dc = _segment(0xC4, bytes([0x00]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    ac = _segment(0xC4, bytes([0x10]) + bytes([1] + [0] * 15) + bytes([0]))
    sos = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    return b"\xff\xd8" + dqt + sof + dc + ac + sos


FLAT_HEADER = _flat_header()


@lru_cache(1)
def _flat_codes() -> tuple[np.ndarray, np.ndarray]:
    """Ten-bit block code by difference + 255, and difference by nine-bit code."""
    codes, back = np.zeros(511, np.uint64), np.zeros(512, np.int32)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = ((1 << (9 - s)) - 2) & 0x1FF  # 8-s ones, then a zero
        code = prefix << s | (d if d >= 0 else d + (1 << s) - 1)
        codes[d + 255], back[code] = code << 1, d
    return codes, back


def frames_of(payload: bytes) -> list[bytes]:
    """JPEG frames for a payload whose length is a positive multiple of 192."""
    v = np.frombuffer(payload, np.uint8).reshape(-1, FRAME).astype(np.int32)
    d = np.diff(v, axis=1, prepend=128)
    x = _flat_codes()[0][d + 255].reshape(-1, 4)
    word = x[:, 0] << np.uint64(30) | x[:, 1] << np.uint64(20) | x[:, 2] << np.uint64(10) | x[:, 3]
    raw = word.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    step = FRAME * 10 // 8
    return [FLAT_HEADER + raw[i : i + step].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(0, len(raw), step)]


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int = COLS * 8, height: int = ROWS * 8, fps: int = FPS) -> bytes:
    """A RIFF AVI with one motion-JPEG stream and an idx1 index."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, fps, 0, len(frames), most, -1, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(c := _chunk(b"00dc", f))
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def encode_payload(payload: bytes) -> bytes:
    return write_avi(frames_of(payload))


def parse_avi(data: bytes) -> tuple[list[bytes], float]:
    """The frames named by idx1 (or, without one, found by walking movi) and the frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI")
    fps, movi, index = float(FPS), None, None
    at, end = 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    while at + 8 <= end:
        tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if tag == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            if (k := data.find(b"avih", at, at + size)) >= 0 and (us := struct.unpack_from("<I", data, k + 8)[0]):
                fps = 1_000_000 / us
        elif tag == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = (at + 8, at + 8 + size)
        elif tag == b"idx1":
            index = (at + 8, size // 16)
        at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no movi list")
    frames = []
    if index:
        table = np.frombuffer(data, "<u4", index[1] * 4, index[0]).reshape(-1, 4)
        kinds = np.frombuffer(data, "S4", index[1] * 4, index[0]).reshape(-1, 4)[:, 0]
        pick = [i for i, k in enumerate(kinds) if k[2:] in (b"dc", b"db")]
        base = 0 if pick and table[pick[0], 2] >= movi[0] else movi[0]  # offsets from the file's start are also seen
        return [data[(o := base + int(table[i, 2]) + 8) : o + int(table[i, 3])] for i in pick], fps
    at = movi[0] + 4
    while at + 8 <= movi[1]:
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at + 2 : at + 4] in (b"dc", b"db"):
            frames.append(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    return frames, fps


def _huffman(body: bytes) -> Iterator[tuple[int, dict[tuple[int, int], int]]]:
    at = 0
    while at < len(body):
        counts, code, k = body[at + 1 : at + 17], 0, at + 17
        table = {}
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                table[length, code] = body[k]
                code, k = code + 1, k + 1
            code <<= 1
        yield body[at], table
        at = k


_DCT = np.array([[(0.5 if u else 8**-0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def decode_jpeg(frame: bytes) -> np.ndarray:
    """Luminance pixels (height, width) of a baseline JPEG of one component, or of the first of several without subsampling."""
    at, quant, huff, comps, restart = 2, {}, {}, [], 0
    height = width = 0
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int64)
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            huff.update(_huffman(body))
        elif marker == 0xC0:
            height, width = struct.unpack_from(">HH", body, 1)
            comps = [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(body[5])]
            if any(c[1] != 0x11 for c in comps):
                raise ValueError("subsampled components are not read")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("only baseline JPEG is read")
        elif marker == 0xDA:
            tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    pieces, start, k = [], at, at
    while True:  # restart markers cut the entropy-coded data
        k = frame.index(b"\xff", k)
        if frame[k + 1] == 0:
            k += 2
        elif 0xD0 <= frame[k + 1] <= 0xD7:
            pieces.append(frame[start:k])
            start = k = k + 2
        else:
            pieces.append(frame[start:k])
            break
    wide, high = -(-width // 8), -(-height // 8)
    out, block = np.zeros((high, 8, wide, 8)), 0
    total = wide * high
    for piece in pieces:
        raw = piece.replace(b"\xff\x00", b"\xff")
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).tolist() + [1] * 16
        pos, pred = 0, [0] * len(comps)

        def symbol(table: dict) -> int:
            nonlocal pos
            code = 0
            for length in range(1, 17):
                code = code << 1 | bits[pos]
                pos += 1
                if (length, code) in table:
                    return table[length, code]
            raise ValueError("bad Huffman code")

        def extra(n: int) -> int:
            nonlocal pos
            v = 0
            for _ in range(n):
                v, pos = v << 1 | bits[pos], pos + 1
            return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1

        for _ in range(min(restart or total, total - block)):
            for c, (ident, _, q) in enumerate(comps):
                coef = np.zeros(64)
                dc, ac = huff[tables[ident] >> 4], huff[0x10 | tables[ident] & 15]
                pred[c] += extra(symbol(dc))
                coef[0], i = pred[c] * quant[q][0], 1
                while i < 64:
                    s = symbol(ac)
                    if s == 0:
                        break
                    i += s >> 4
                    if s & 15:
                        coef[ZIGZAG[i]] = extra(s & 15) * quant[q][i]
                    i += 1
                if c == 0:
                    out[block // wide, :, block % wide] = _DCT.T @ coef.reshape(8, 8) @ _DCT
            block += 1
    return np.clip(np.rint(out + 128), 0, 255).astype(np.uint8).reshape(high * 8, wide * 8)[:height, :width]


def decode_samples(frames: list[bytes]) -> np.ndarray:
    """(frames, 192) bytes: the level of each 8x8 block. Frames with the flat header take a vectorised path."""
    step, n = FRAME * 10 // 8, len(FLAT_HEADER)
    if all(f.startswith(FLAT_HEADER) for f in frames):
        raw = b"".join([f[n:-2].replace(b"\xff\x00", b"\xff") for f in frames])
        if len(raw) == step * len(frames):
            b = np.frombuffer(raw, np.uint8).reshape(-1, 5).astype(np.uint64)
            word = b[:, 0] << np.uint64(32) | b[:, 1] << np.uint64(24) | b[:, 2] << np.uint64(16) | b[:, 3] << np.uint64(8) | b[:, 4]
            code = np.stack([word >> np.uint64(s) & np.uint64(0x3FF) for s in (30, 20, 10, 0)], axis=1).reshape(-1, FRAME)
            return (np.cumsum(_flat_codes()[1][code >> np.uint64(1)], axis=1) + 128).astype(np.uint8)
    return np.stack([decode_jpeg(f)[::8, ::8].reshape(-1) for f in frames])


def shots(samples: np.ndarray, window: int = 8, floor: float = 0.25, sigmas: float = 2.0) -> np.ndarray:
    """First frames of shots: where the histogram difference exceeds the floor and the mean plus so many deviations of the last `window` differences."""
    m = len(samples)
    if m < 2:
        return np.zeros(min(m, 1), np.int64)
    flat = (samples >> 4).astype(np.int64) + np.arange(m)[:, None] * HIST_BINS
    hist = np.bincount(flat.reshape(-1), minlength=m * HIST_BINS).reshape(m, HIST_BINS)
    d = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * samples.shape[1])
    s1, s2 = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    i = np.arange(m - 1)
    lo = np.maximum(0, i - window)
    n = np.maximum(1, i - lo)
    mean = (s1[i] - s1[lo]) / n
    dev = np.sqrt(np.maximum(0, (s2[i] - s2[lo]) / n - mean * mean))
    return np.concatenate([[0], 1 + np.flatnonzero((d > floor) & (d > mean + sigmas * dev))])


def clips_of(media: bytes) -> tuple[np.ndarray, list[tuple[int, float, float, int, float]]]:
    """Decoded samples, and (clip, start second, end second, frames, mean level) of each shot."""
    frames, fps = parse_avi(media)
    if not frames:
        return np.zeros((0, FRAME), np.uint8), []
    samples = decode_samples(frames)
    first = shots(samples)
    last = np.append(first[1:], len(samples))
    level = samples.mean(axis=1)
    return samples, [(k, a / fps, b / fps, int(b - a), float(level[a:b].mean())) for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True))]


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    n = len(raw)
    return raw + b" " * (-n % FRAME if n else FRAME), n


def _without(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() in names])


def media_column(df: DataFrame, text: str = "text") -> DataFrame:
    """The input's rows with a binary column `media`: the AVI of each row's text."""
    df = _without(df, "media")
    schema = StructType([*df.schema.fields, StructField("media", BinaryType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([encode_payload(padded(t)[0]) for t in b.column(text).to_pylist()], pa.binary())], names=[*b.schema.names, "media"])

    return df.mapInArrow(run, schema)


def clip_rows(df: DataFrame, media: str = "media") -> DataFrame:
    """One row for each shot of each row's AVI: the input's other columns and clip, start_s, end_s, frames, level. Null media give no row."""
    df = _without(df, "clip", "start_s", "end_s", "frames", "level")
    rest = df.drop(media)
    clip = StructType([StructField("clip", IntegerType()), StructField("start_s", DoubleType()), StructField("end_s", DoubleType()), StructField("frames", IntegerType()), StructField("level", DoubleType())])
    cells = F.pandas_udf(lambda s: s.map(lambda m: [] if m is None else [dict(zip(clip.names, c, strict=True)) for c in clips_of(bytes(m))[1]]), ArrayType(clip))
    return df.withColumn("__clips", cells(F.col(media))).select(*rest.columns, F.inline("__clips"))


DIGEST = StructType([StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()), StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("feature", StringType())])


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores each text as an AVI, reads the file back and returns its digests; see DIGEST. `feature` names the shots as first-last frame and mean level."""

    def one(ident, text):
        payload, n = padded(text)
        media = encode_payload(payload)
        samples, clips = clips_of(media)
        back = samples.tobytes()
        at, cells = 0, []
        for _, _, _, m, level in clips:
            cells.append(f"{at}-{at + m - 1}:{level:.2f}")
            at += m
        return ident, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), " ".join(cells)

    def run(batches):
        for b in batches:
            rows = [one(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)], names=DIGEST.names)

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)
