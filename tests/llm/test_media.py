import hashlib
import os
import zlib

import numpy as np
import pytest

from millrace.llm import media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 20000])
def test_round_trip(n):
    raw = os.urandom(n)
    size, payload = media.payload_of(raw)
    assert size == n
    assert len(payload) % 64 == 0 and payload.startswith(raw)
    avi, samples, back = media.decode_avi(media.write_avi(payload))
    assert back == payload
    assert samples.shape[2] == media.WIDTH
    assert len(avi.frames) == samples.shape[0]


def test_extreme_samples_and_stuffing():
    for payload in (b"\xff\x00" * 64, b"\xff" * 4096, bytes(range(256)) * 16):
        assert media.decode_avi(media.write_avi(payload))[2] == payload


def test_other_huffman_table_is_decoded_bit_by_bit():
    counts, values = bytes([0, 1, 5, 1, 1, 1] + [0] * 10), bytes(range(9))
    codes, code, k = {}, 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            codes[values[k]] = format(code, f"0{length}b")
            code, k = code + 1, k + 1
        code <<= 1
    diffs = [0, 1, -1, 5, -5, 127, -128, 255, -255, 3]
    bits = ""
    for d in diffs:
        s = abs(d).bit_length()
        bits += codes[s] + (format(d if d > 0 else d + (1 << s) - 1, f"0{s}b") if s else "")
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big")
    assert media.decode_scan(scan, len(diffs), counts, values).tolist() == diffs


def test_index_is_optional():
    data = media.write_avi(bytes(range(256)) * 40)
    cut = data[: data.index(b"idx1")]
    cut = cut[:4] + (len(cut) - 8).to_bytes(4, "little") + cut[8:]
    assert media.read_avi(cut).frames == media.read_avi(data).frames


def test_shots_follow_histograms():
    dark, light = np.zeros((6, 8, 64), np.uint8), np.full((5, 8, 64), 250, np.uint8)
    assert media.shots(np.concatenate([dark, light, dark])) == [(0, 6), (6, 11), (11, 17)]


def test_digest_of_rows(frame):
    rows = [(1, None), (2, ""), (3, "é" * 100), (3, "é" * 100), (None, "z" * 100_000)]
    got = media.media_digest(frame(rows)).collect()
    assert len(got) == 5
    by = {(r.doc_id, r.n_bytes): r for r in got}
    raw = ("é" * 100).encode()
    payload = raw + b"\0" * 56
    r = by[(3, 200)]
    assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (256, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert by[(1, 0)][1:] == by[(2, 0)][1:]
    assert media.media_digest(frame([])).collect() == []


def test_bad_files_have_a_row_that_says_why(spark):
    good = media.write_avi(bytes(range(256)) * 40)
    baseline = good.replace(b"\xff\xc3", b"\xff\xc0")
    rows = [(1, good), (2, b"not an avi"), (3, good[:-400]), (4, baseline), (5, None), (6, b""), (7, media.write_avi(b"\0" * 64).replace(b"00dc", b"00xx")), (None, good)]
    df = spark.createDataFrame([(k, bytearray(b) if b is not None else None) for k, b in rows], "doc_id bigint, media binary")
    got = {r.doc_id: r.status for r in media.clips(df).collect()}
    assert got.keys() == {1, 2, 3, 4, 6, 7, None}
    assert got[1] == got[None] == "ok"
    assert "not an AVI" in got[2] and "lossless" in got[4]
    assert all(got[k] != "ok" for k in (3, 6, 7))


def test_clips_are_timed(frame):
    text = "\x00" * 64 * 64 * 3 + "~" * 64 * 64 * 2
    got = media.clips(media.store(frame([(1, text), (2, None)]))).orderBy("doc_id", "clip").collect()
    assert [(r.doc_id, r.first_frame, r.end_frame, r.start_s, r.end_s) for r in got] == [(1, 0, 3, 0.0, 0.12), (1, 3, 5, 0.12, 0.2), (2, 0, 1, 0.0, 0.04)]
