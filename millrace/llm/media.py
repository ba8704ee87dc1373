"""AVI motion-JPEG columns: write, index, decode, and cut into shots.

Frames are lossless JPEG (ITU-T T.81 process 14, one 8-bit component, predictor 1). The Huffman table written here gives
category s a code of 9 - s bits, so a code and its s extra bits always take 9 bits together: all 511 differences are
exactly the 511 nine-bit words below all ones. That makes coding and decoding plain array work; `decode_scan` falls back
to a bit-by-bit decoder for files with other tables.

AVI: RIFF('AVI ' LIST(hdrl avih strl(strh strf)) LIST(INFO ISFT) LIST(movi 00dc*) idx1). The true number of payload
bytes stands in ISFT as text, because the last frame is filled up with zero rows.

Null and empty texts become one frame of one zero row. Very long texts become many frames; a file is held whole. Rows that
repeat an id, or have none, are stored each; equal texts give equal files. An empty table gives no rows. Files of others:
frames may be any lossless JPEG with one component of 8 bits and predictor 1. A file that is not an AVI, is cut off, holds no
frames or frames of another kind gives one row that says why, and the others go on; a null file gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.frames import id_text, map_slices

WIDTH = 64
#: Rows in a frame of the stored video. A text of up to 64 rows is one frame of its own height.
MAX_ROWS = 64
FPS = 25
#: A shot begins where the histogram difference exceeds mean + DEVIATIONS * deviation of the shot's last WINDOW differences.
DEVIATIONS = 3.0
WINDOW = 8
FLOOR = 0.15
BINS = 16

SCHEMA = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
    "media_bytes bigint, media_sha256 string, feature string"
)
CLIPS = "doc_id bigint, clip int, first_frame int, end_frame int, start_s double, end_s double, mean_level double, status string"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 255: the 9-bit word. By 9-bit word: the difference."""
    word_of, diff_of = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    code = 0
    for s in range(8, -1, -1):  # shortest code first: category 8 has 1 bit, category 0 has 9
        if s < 8:
            code = (code + 1) << 1
        for extra in range(1 << s):
            diff = 0 if s == 0 else extra if extra >= 1 << (s - 1) else extra - (1 << s) + 1
            word_of[diff + 255] = (code << s) | extra
            diff_of[(code << s) | extra] = diff
    return word_of, diff_of


WORD_OF, DIFF_OF = _tables()
#: DHT: one code of each length 1..9, for the categories 8, 7, ..., 0.
_COUNTS = bytes([1] * 9 + [0] * 7)
_VALUES = bytes(range(8, -1, -1))
_DHT = b"\xff\xc4" + struct.pack(">HB", 2 + 1 + 16 + 9, 0) + _COUNTS + _VALUES
_SOS = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG images of an array (frames, rows, WIDTH) of uint8; rows * WIDTH is a multiple of 8."""
    frames, rows, width = samples.shape
    x = samples.astype(np.int16)
    diff = np.empty_like(x)
    diff[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    diff[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    diff[:, 0, 0] = x[:, 0, 0] - 128
    diff += 255
    words = WORD_OF[diff].reshape(frames, -1, 8)
    packed = np.empty((frames, words.shape[1], 9), np.uint8)
    packed[:, :, 0] = words[:, :, 0] >> 1
    for i in range(1, 8):  # byte i: the last i bits of word i-1, then the first 8-i bits of word i
        packed[:, :, i] = (words[:, :, i - 1] << (8 - i)) | (words[:, :, i] >> (i + 1))
    packed[:, :, 8] = words[:, :, 7]
    sof = b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, rows, width, 1, 1, 0x11, 0)
    head = b"\xff\xd8" + sof + _DHT + _SOS
    return [head + packed[i].tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(frames)]


@dataclass
class _Header:
    rows: int
    width: int
    counts: bytes
    values: bytes
    scan: int


def _parse_jpeg(data: bytes) -> _Header:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at, rows, width, counts, values = 2, 0, 0, b"", b""
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xC3:
            precision, rows, width, parts = struct.unpack_from(">BHHB", body)
            if precision != 8 or parts != 1:
                raise ValueError("one component of 8 bits is supported")
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only lossless JPEG (SOF3) is supported")
        elif marker == 0xC4:
            counts, values = body[1:17], body[17:]
        elif marker == 0xDA:
            if body[3] != 1:
                raise ValueError("only predictor 1 is supported")
            return _Header(rows, width, counts, values, at + 2 + size)
        at += 2 + size


def decode_scan(scan: bytes, n: int, counts: bytes, values: bytes) -> np.ndarray:
    """n differences of an unstuffed entropy-coded segment with any Huffman table."""
    if counts == _COUNTS and values == _VALUES:
        raw = np.frombuffer(scan, np.uint8, count=n // 8 * 9).reshape(-1, 9).astype(np.uint16)
        words = np.empty((raw.shape[0], 8), np.uint16)
        for i in range(8):
            words[:, i] = ((raw[:, i] << (i + 1)) | (raw[:, i + 1] >> (7 - i))) & 511
        return DIFF_OF[words.reshape(-1)]
    lookup, code, k = {}, 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            lookup[(length, code)] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    bits, at, out = np.unpackbits(np.frombuffer(scan, np.uint8)).tolist(), 0, np.zeros(n, np.int16)
    for i in range(n):
        length, code = 0, 0
        while (length, code) not in lookup or length == 0:
            code, length, at = (code << 1) | bits[at], length + 1, at + 1
        s = lookup[(length, code)]
        extra = 0
        for _ in range(s):
            extra, at = (extra << 1) | bits[at], at + 1
        out[i] = extra if s == 0 or extra >= 1 << (s - 1) else extra - (1 << s) + 1
    return out


def decode_frame(data: bytes) -> np.ndarray:
    """The samples (rows, width) of a lossless JPEG image."""
    head = _parse_jpeg(data)
    scan = data[head.scan : data.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")
    diff = decode_scan(scan, head.rows * head.width, head.counts, head.values).reshape(head.rows, head.width).astype(np.int32)
    diff[0, 0] += 128
    diff[:, 0] = np.cumsum(diff[:, 0])
    return (np.cumsum(diff, axis=1) & 0xFFFF).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(name: bytes, *parts: bytes) -> bytes:
    return _chunk(b"LIST", name + b"".join(parts))


def write_avi(payload: bytes) -> bytes:
    """An AVI file whose samples are the payload, a positive multiple of WIDTH bytes."""
    rows = len(payload) // WIDTH
    if rows < 1 or rows * WIDTH != len(payload):
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    height = min(rows, MAX_ROWS)
    count = -(-rows // height)
    samples = np.zeros(count * height * WIDTH, np.uint8)
    samples[: len(payload)] = np.frombuffer(payload, np.uint8)
    frames = encode_frames(samples.reshape(count, height, WIDTH))
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, count, 0, 1, largest, WIDTH, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, count, largest, 0, 0, 0, 0, WIDTH, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 0, 0)
    index, movi, at = [], [], 4
    for f in frames:
        chunk = _chunk(b"00dc", f)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        movi.append(chunk)
        at += len(chunk)
    body = b"AVI " + _list(b"hdrl", _chunk(b"avih", avih), _list(b"strl", _chunk(b"strh", strh), _chunk(b"strf", strf)))
    body += _list(b"INFO", _chunk(b"ISFT", b"payload=%d" % len(payload))) + _list(b"movi", *movi) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


@dataclass
class Avi:
    fps: float
    frames: list[bytes]
    payload_bytes: int | None


def read_avi(data: bytes) -> Avi:
    """Header, indexed frames and payload length; frames come from idx1, or by walking movi where there is none."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index, length = float(FPS), (0, 0), b"", None

    def walk(at: int, end: int) -> None:
        nonlocal fps, movi, index, length
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if name == b"LIST" and data[body : body + 4] == b"movi":
                movi = (body, body + size)
            elif name == b"LIST":
                walk(body + 4, body + size)
            elif name == b"avih":
                fps = 1e6 / max(1, struct.unpack_from("<I", data, body)[0])
            elif name == b"ISFT" and data[body : body + 8] == b"payload=":
                length = int(data[body + 8 : body + size])
            elif name == b"idx1":
                index = data[body : body + size]
            at = body + size + (size & 1)

    walk(12, 8 + struct.unpack_from("<I", data, 4)[0])
    frames = []
    if index:
        for k in range(0, len(index), 16):
            if index[k + 2 : k + 4] in (b"dc", b"db"):
                at, size = struct.unpack_from("<II", index, k + 8)
                begin = movi[0] + at + 8
                frames.append(data[begin : begin + size])
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if data[at + 2 : at + 4] in (b"dc", b"db"):
                frames.append(data[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
    return Avi(fps, frames, length)


def shots(samples: np.ndarray) -> list[tuple[int, int]]:
    """[first, end) frame ranges. A cut is a histogram difference above an adaptive limit: the mean of the last
    WINDOW differences within the shot plus DEVIATIONS deviations, and at least FLOOR; FLOOR * 2 at a shot's start."""
    count = samples.shape[0]
    flat = (samples.reshape(count, -1) >> 4).astype(np.int64) + np.arange(count)[:, None] * BINS
    hist = np.bincount(flat.ravel(), minlength=count * BINS).reshape(count, BINS) / (flat.shape[1] or 1)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    cuts = [0]
    for i, d in enumerate(diff.tolist()):
        past = diff[max(cuts[-1], i - WINDOW) : i]
        limit = max(FLOOR, past.mean() + DEVIATIONS * past.std()) if past.size else 2 * FLOOR
        if d > limit:
            cuts.append(i + 1)
    return [*zip(cuts, [*cuts[1:], count], strict=True)]


def payload_of(text: str | bytes | None) -> tuple[int, bytes]:
    """Number of UTF-8 bytes, and these bytes filled up with zeros to a positive multiple of 64."""
    raw = text.encode() if isinstance(text, str) else (text or b"")
    return len(raw), raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


def decode_avi(media: bytes) -> tuple[Avi, np.ndarray, bytes]:
    """The parsed file, its samples (frames, rows, width) and the payload that they carry."""
    avi = read_avi(media)
    samples = np.stack([decode_frame(f) for f in avi.frames])
    raw = samples.reshape(-1)[: avi.payload_bytes]
    return avi, samples, raw.tobytes()


def digest(doc_id: int | None, text: bytes | None) -> tuple:
    n, payload = payload_of(text)
    media = write_avi(payload)
    avi, samples, back = decode_avi(media)
    cuts = shots(samples)
    level = int(samples.sum(dtype=np.int64))
    feature = f"{len(avi.frames)}x{samples.shape[1]}x{samples.shape[2]};shots={','.join(f'{a}-{b}' for a, b in cuts)};sum={level}"
    return (doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each text as an AVI file. Null and empty texts become one frame of one zero row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        media = [write_avi(payload_of(t)[1]) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        return pa.record_batch([batch.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    return map_slices(id_text(docs, id_col, text_col), run, "doc_id bigint, media binary")


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each shot of each stored file, with frame range, times and the status 'ok'. A null file has no rows; one that
    cannot be decoded has one row, with the reason as its status and nothing else but the id."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    avi, samples, _ = decode_avi(data)
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    rows.append((key, *[None] * 6, f"{type(e).__name__}: {e}"))
                    continue
                rows += [(key, i, a, b, a / avi.fps, b / avi.fps, float(samples[a:b].mean()), "ok") for i, (a, b) in enumerate(shots(samples))]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(_CLIP_NAMES, r, strict=True)) for r in rows], schema=_CLIP_SCHEMA)

    return media.select(id_col, media_col).mapInArrow(run, CLIPS)


_CLIP_NAMES = ["doc_id", "clip", "first_frame", "end_frame", "start_s", "end_s", "mean_level", "status"]
_CLIP_SCHEMA = pa.schema(list(zip(_CLIP_NAMES, [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string()], strict=True)))
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
    + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each text: its stored AVI file and what is read back from that file, as digests. One row for each input row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [digest(k, t) for k, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return map_slices(id_text(docs, id_col, text_col), run, SCHEMA)
