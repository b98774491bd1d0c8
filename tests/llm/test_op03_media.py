import hashlib
import zlib

import numpy as np

from affilink.llm import op03_media as media


def test_zigzag():
    assert media.ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(media.ZIGZAG) == list(range(64))


def test_scans_round_trip():
    rng = np.random.default_rng(0)
    samples = np.concatenate([rng.integers(0, 256, (50, media.SAMPLES)), np.tile([0, 255], (1, media.SAMPLES // 2)), np.zeros((1, media.SAMPLES))]).astype(np.uint8)
    assert (media.decoded(media.coded(samples)) == samples).all()


def test_the_plain_decoder_gives_the_same_pixels():
    """Frames are baseline JPEG: a decoder that reads the tables from the file finds each sample in its 8 by 8 block."""
    payload = np.random.default_rng(1).integers(0, 256, 2 * media.SAMPLES, dtype=np.uint8).tobytes()
    (data,) = media.stored([payload])
    frames, rate = media.frames_of(data)
    assert rate == media.FRAMES_A_SECOND
    planes = [media.luminance(f) for f in frames]
    for k, plane in enumerate(planes):
        small = np.frombuffer(payload, np.uint8)[k * media.SAMPLES :][: media.SAMPLES].reshape(media.ROWS, media.COLUMNS)
        assert (plane == np.kron(small, np.ones((8, 8), np.uint8))).all()


def test_files_without_an_index_and_with_foreign_frames():
    payload = bytes(range(media.SAMPLES)) * 3
    (data,) = media.stored([payload])
    assert media.frames_of(data[: data.index(b"idx1")])[0] == media.frames_of(data)[0]
    # a comment before the tables: the frame isn't ours any more, but holds the same picture
    frames = [f[:2] + b"\xff\xfe\x00\x04hi" + f[2:] for f in media.frames_of(data)[0]]
    counts, samples = media.samples_of([media.avi(frames), data])
    assert counts == [3, 3] and samples.tobytes() == payload * 2


def slow_shots(samples):
    out = [0] if len(samples) else []
    h = [np.bincount(s >> 4, minlength=16) for s in samples]
    d = [None] + [int(np.abs(a - b).sum()) for a, b in zip(h[1:], h)]
    for k in range(1, len(d)):
        around = [d[j] for j in range(max(1, k - media.AROUND), min(len(d), k + media.AROUND + 1)) if j != k]
        if around and d[k] >= media.LEAST_DIFFERENCE and d[k] - np.mean(around) > media.DEVIATIONS * np.std(around) + 1e-9:
            out.append(k)
    return out


def test_shots_are_those_of_brute_force():
    rng = np.random.default_rng(2)
    files = []
    for _ in range(60):
        parts = [rng.integers(a, a + 60, (int(rng.integers(1, 15)), media.SAMPLES)) for a in rng.choice([0, 60, 120, 190], int(rng.integers(0, 5)))]
        files.append(np.concatenate([np.zeros((0, media.SAMPLES)), *parts]).astype(np.uint8))
    counts = [len(f) for f in files]
    found = media.shots(counts, np.concatenate(files))
    assert found == [slow_shots(f) for f in files] and max(map(len, found)) > 1


def test_payloads_come_back(spark, odd_docs, no_docs):
    rows = media.read(media.store(odd_docs)).collect()
    for r, given in zip(sorted(rows, key=lambda r: (str(r.doc_id), r.payload_sha256)), sorted(((str(d.doc_id), (d.text or "").encode()) for d in odd_docs.collect()), key=lambda x: (x[0], hashlib.sha256(media.payload_of(x[1])).hexdigest()))):
        payload = given[1] + b" " * (-len(given[1]) % 192 if given[1] else 192)
        assert (str(r.doc_id), r.n_bytes, r.payload_bytes) == (given[0], len(given[1]), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
    assert media.read(media.store(no_docs)).count() == 0
    pieces = media.clips(media.read(media.store(odd_docs))).collect()
    assert sum(p.end_frame - p.first_frame for p in pieces) * 192 == sum(r.payload_bytes for r in rows) and all(p.end_s > p.start_s for p in pieces)


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = media.op3_media(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = media.payload_of((texts[r.doc_id] or "").encode())
        (data,) = media.stored([payload])
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
