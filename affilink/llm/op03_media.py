"""Media columns: AVI files of motion-JPEG, their intra frames, and shots as timed clips.

store() keeps bytes as frames of 16 by 12 samples. A sample is an 8 by 8 block of one grey value, which baseline JPEG
keeps without loss: the quantised DC coefficient is the value less 128, and there are no others. The DC Huffman table has
codes of 1 to 9 bits for differences of 8 to 0 bits, so each block takes 10 bits with its end-of-block code, and whole
files are coded and decoded by numpy. Any baseline motion-JPEG file can be read: frames with other tables go through a
plain decoder that yields the luminance.

shots() compares histograms of neighbouring frames. A cut lies where their difference exceeds a least one and the mean
of the differences around it by a multiple of their deviation; sums are of integers, so equal files give equal cuts
whatever stands beside them.

Payloads are UTF-8 texts (null: empty) with spaces up to a positive multiple of 192 bytes. Repeated rows are stored
each. A null doc_id stays null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affilink.llm.shared import table

COLUMNS, ROWS = 16, 12
SAMPLES = COLUMNS * ROWS
FRAMES_A_SECOND = 25
BINS = 16
#: The least histogram difference of a cut, of 2 * SAMPLES at most.
LEAST_DIFFERENCE = 64
#: Differences on either side that make up the surroundings, and how many deviations a cut lies above their mean.
AROUND, DEVIATIONS = 8, 3
BLOCK_FRAMES = 1 << 14
#: The zigzag order of a block's coefficients.
ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEAD = b"".join(
    [
        b"\xff\xd8",
        _segment(0xDB, bytes([0, 8] + [1] * 63)),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * ROWS, 8 * COLUMNS, 1, 1, 0x11, 0)),
        _segment(0xC4, bytes([0x00] + [1] * 9 + [0] * 7 + list(range(8, -1, -1)))),
        _segment(0xC4, bytes([0x10] + [1] + [0] * 15 + [0])),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ]
)
TAIL = b"\xff\xd9"
SCAN_BYTES = SAMPLES * 10 // 8


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """The 10 bits of each difference from -255 to 255, and the difference of 10 bits (999: none)."""
    forth, back = np.zeros(511, dtype=np.uint64), np.full(1024, 999, dtype=np.int16)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code = (1 << (9 - size)) - 2
        bits = (code << size | (d if d >= 0 else d + (1 << size) - 1)) << 1
        forth[d + 255] = bits
        back[bits] = d
    return forth, back


_FORTH, _BACK = _codes()


def coded(samples: np.ndarray) -> np.ndarray:
    """(frames, SAMPLES) to (frames, SCAN_BYTES): the entropy-coded scans, before byte stuffing."""
    n = len(samples)
    values = samples.astype(np.int16)
    bits = _FORTH[np.diff(values, axis=1, prepend=np.int16(128)) + 255].reshape(n, SAMPLES // 4, 4)
    word = bits[:, :, 0] << np.uint64(30) | bits[:, :, 1] << np.uint64(20) | bits[:, :, 2] << np.uint64(10) | bits[:, :, 3]
    return (word[:, :, None] >> np.array([32, 24, 16, 8, 0], dtype=np.uint64)).astype(np.uint8).reshape(n, SCAN_BYTES)


def decoded(scans: np.ndarray) -> np.ndarray:
    """The reverse of coded()."""
    n = len(scans)
    five = scans.reshape(n, SAMPLES // 4, 5).astype(np.uint64)
    word = five[:, :, 0] << np.uint64(32) | five[:, :, 1] << np.uint64(24) | five[:, :, 2] << np.uint64(16) | five[:, :, 3] << np.uint64(8) | five[:, :, 4]
    bits = (word[:, :, None] >> np.array([30, 20, 10, 0], dtype=np.uint64)) & np.uint64(1023)
    differences = _BACK[bits.astype(np.int64)].reshape(n, SAMPLES)
    if n and differences.max() == 999:
        raise ValueError("not a scan of these tables")
    return (np.cumsum(differences, axis=1, dtype=np.int32) + 128).astype(np.uint8)


def avi(frames: list[bytes], width: int = 8 * COLUMNS, height: int = 8 * ROWS) -> bytes:
    """An AVI file of JPEG frames with an index."""

    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    largest = max(map(len, frames), default=0)
    head = chunk(b"avih", struct.pack("<14I", 1_000_000 // FRAMES_A_SECOND, largest * FRAMES_A_SECOND, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0))
    stream = chunk(b"strh", struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FRAMES_A_SECOND, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height))
    picture = chunk(b"strf", struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, int.from_bytes(b"MJPG", "little"), 3 * width * height, 0, 0, 0, 0))
    header = chunk(b"LIST", b"hdrl" + head + chunk(b"LIST", b"strl" + stream + picture))
    parts, index, at = [b"movi"], [], 4
    for frame in frames:
        parts += [b"00dc", struct.pack("<I", len(frame)), frame, b"\0" * (len(frame) & 1)]
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += 8 + len(frame) + (len(frame) & 1)
    return chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", b"".join(parts)) + chunk(b"idx1", b"".join(index)))


def chunks(data: bytes, first: int, last: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, length) of the chunks from first to last."""
    while first + 8 <= last:
        name, n = data[first : first + 4], struct.unpack_from("<I", data, first + 4)[0]
        yield name, first + 8, n
        first += 8 + n + (n & 1)


def frames_of(data: bytes) -> tuple[list[bytes], float]:
    """The video frames of an AVI file, by its index or, without one, in order; and frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movie, index = float(FRAMES_A_SECOND), None, None
    for name, at, n in chunks(data, 12, len(data)):
        if name == b"LIST" and data[at : at + 4] == b"hdrl":
            for inner, where, _ in chunks(data, at + 4, at + n):
                if inner == b"avih":
                    rate = 1e6 / max(1, struct.unpack_from("<I", data, where)[0])
        elif name == b"LIST" and data[at : at + 4] == b"movi":
            movie = (at, n)
        elif name == b"idx1":
            index = (at, n)
    if movie is None:
        return [], rate
    at, n = movie
    if index is None:
        return [data[a : a + k] for name, a, k in chunks(data, at + 4, at + n) if name[2:] in (b"dc", b"db")], rate
    entries = np.frombuffer(data, dtype="<u4", count=index[1] // 16 * 4, offset=index[0]).reshape(-1, 4)
    names = entries[:, 0] >> 16
    video = entries[(names == int.from_bytes(b"dc", "little")) | (names == int.from_bytes(b"db", "little"))]
    # offsets count from the list's name, or in some files from the file's start
    base = at if len(video) and video[0, 2] < at else 0
    return [data[base + a + 8 : base + a + 8 + k] for a, k in video[:, 2:].tolist()], rate


def jpeg_head(frame: bytes) -> tuple[int, dict]:
    """Where the scan starts, and the tables before it."""
    at, seen = 2, {"quant": {}, "dc": {}, "ac": {}, "restart": 0}
    while True:
        if frame[at] != 0xFF:
            raise ValueError("not a JPEG frame")
        marker, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = struct.unpack(">64H", body[1:129]) if wide else tuple(body[1:65])
                seen["quant"][body[0] & 15] = np.array(values, dtype=np.int64)
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                symbols, code, table_ = body[17 : 17 + sum(counts)], 0, {}
                k = 0
                for length, count in enumerate(counts, 1):
                    for _ in range(count):
                        table_[length, code] = symbols[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                seen["ac" if body[0] >> 4 else "dc"][body[0] & 15] = table_
                body = body[17 + sum(counts) :]
        elif marker in (0xC0, 0xC1):
            seen["height"], seen["width"] = struct.unpack_from(">HH", body, 1)
            seen["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("only baseline frames can be read")
        elif marker == 0xDD:
            seen["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            seen["scan"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            return at, seen


_WAVES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def luminance(frame: bytes) -> np.ndarray:
    """The first component's plane of a baseline frame, (height, width)."""
    at, head = jpeg_head(frame)
    data = frame[at:]
    bits = pos = n_bits = 0

    def read(n: int) -> int:
        nonlocal bits, pos, n_bits
        while n_bits < n:
            byte = data[pos] if pos < len(data) else 0
            pos += 1
            if byte == 0xFF and pos < len(data):
                if data[pos] == 0:
                    pos += 1
                else:
                    byte, pos = 0, pos - 1  # a marker: zeros until it's dealt with
            bits, n_bits = bits << 8 | byte, n_bits + 8
        n_bits -= n
        out = bits >> n_bits
        bits &= (1 << n_bits) - 1
        return out

    def symbol(codes: dict) -> int:
        code = length = 0
        while length < 16:
            code, length = code << 1 | read(1), length + 1
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("a code that no table has")

    def value(size: int) -> int:
        v = read(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    wide, tall = max(h for _, h, _, _ in head["parts"]), max(v for _, _, v, _ in head["parts"])
    if len(head["parts"]) == 1:
        wide = tall = 1
    across, down = -(-head["width"] // (8 * wide)), -(-head["height"] // (8 * tall))
    first = head["parts"][0]
    h1, v1 = (1, 1) if len(head["parts"]) == 1 else first[1:3]
    plane = np.zeros((down * v1 * 8, across * h1 * 8))
    last = dict.fromkeys((c for c, *_ in head["parts"]), 0)
    for unit in range(across * down):
        if head["restart"] and unit and unit % head["restart"] == 0:
            bits = n_bits = 0
            pos = data.index(b"\xff", pos) + 2
            last = dict.fromkeys(last, 0)
        for c, h, v, q in head["parts"]:
            dc, ac = (head[k][t] for k, t in zip(("dc", "ac"), head["scan"][c]))
            for k in range(1 if len(head["parts"]) == 1 else h * v):
                block = np.zeros(64)
                last[c] += value(symbol(dc))
                block[0] = last[c] * head["quant"][q][0]
                i = 1
                while i < 64:
                    s = symbol(ac)
                    if not s & 15:
                        if s != 0xF0:
                            break
                        i += 16
                        continue
                    i += s >> 4
                    block[ZIGZAG[i]] = value(s & 15) * head["quant"][q][i]
                    i += 1
                if c == first[0]:
                    y, x = (unit // across * v1 + k // h1) * 8, (unit % across * h1 + k % h1) * 8
                    plane[y : y + 8, x : x + 8] = _WAVES @ block.reshape(8, 8) @ _WAVES.T + 128
    return np.clip(np.rint(plane[: head["height"], : head["width"]]), 0, 255).astype(np.uint8)


def stored(payloads: list[bytes]) -> list[bytes]:
    """An AVI file of each payload, whose length is a positive multiple of SAMPLES."""
    raw = coded(np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, SAMPLES)).tobytes()
    out, at = [], 0
    for p in payloads:
        frames = []
        for _ in range(len(p) // SAMPLES):
            frames.append(HEAD + raw[at : at + SCAN_BYTES].replace(b"\xff", b"\xff\x00") + TAIL)
            at += SCAN_BYTES
        out.append(avi(frames))
    return out


def samples_of(files: list[bytes]) -> tuple[list[int], np.ndarray]:
    """Frames of each file, and the samples of all: block means, (frames, SAMPLES)."""
    counts, scans, other = [], [], {}
    for data in files:
        frames, _ = frames_of(data)
        counts.append(len(frames))
        for frame in frames:
            if frame.startswith(HEAD) and frame.endswith(TAIL):
                scans.append(frame[len(HEAD) : -len(TAIL)].replace(b"\xff\x00", b"\xff"))
            else:
                other[len(scans)] = frame
                scans.append(b"\xff" * SCAN_BYTES)
    raw = np.frombuffer(b"".join(scans), dtype=np.uint8).reshape(-1, SCAN_BYTES)
    if not other:
        return counts, decoded(raw)
    samples = np.zeros((len(scans), SAMPLES), dtype=np.uint8)
    own = np.array([k not in other for k in range(len(scans))])
    samples[own] = decoded(raw[own])
    for k, frame in other.items():
        plane = luminance(frame)
        rows, columns = (np.linspace(0, n, m + 1).astype(int) for n, m in zip(plane.shape, (ROWS, COLUMNS)))
        samples[k] = [round(float(plane[a:b, c:d].mean())) for a, b in zip(rows, rows[1:]) for c, d in zip(columns, columns[1:])]
    return counts, samples


def shots(counts: list[int], samples: np.ndarray) -> list[list[int]]:
    """The first frames of each file's shots."""
    n = len(samples)
    if not n:
        return [[0] if c else [] for c in counts]
    flat = (np.arange(n, dtype=np.int64)[:, None] * BINS + (samples >> 4)).ravel()
    histograms = np.bincount(flat, minlength=n * BINS).reshape(n, BINS)
    difference = np.zeros(n, dtype=np.int64)
    difference[1:] = np.abs(np.diff(histograms, axis=0)).sum(1)
    ends = np.cumsum(counts)
    file = np.repeat(np.arange(len(counts)), counts)
    first = (ends - counts)[file]
    k = np.arange(n)
    inner = k > first
    low, high = np.maximum(first + 1, k - AROUND), np.minimum(ends[file], k + AROUND + 1)
    sums = np.concatenate([[0], np.cumsum(difference)])
    squares = np.concatenate([[0], np.cumsum(difference**2)])
    m = high - low - 1
    s, q = sums[high] - sums[low] - difference, squares[high] - squares[low] - difference**2
    above = m * difference - s
    cut = inner & (difference >= LEAST_DIFFERENCE) & (m >= 1) & (above > 0) & (above**2 > DEVIATIONS**2 * (m * q - s * s))
    out: list[list[int]] = [[0] if c else [] for c in counts]
    for f, at in zip(file[cut].tolist(), (k - first)[cut].tolist()):
        out[f].append(at)
    return out


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text + b" " * (max(SAMPLES, -(-len(text) // SAMPLES) * SAMPLES) - len(text))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, an AVI file, of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emptied() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(stored(payloads), pa.binary())], ["doc_id", "n_bytes", "media"])

        for batch in batches:
            ids, sizes, payloads, held = [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids.append(doc_id)
                sizes.append(len(text or b""))
                payloads.append(payload_of(text))
                held += len(payloads[-1]) // SAMPLES
                if held >= BLOCK_FRAMES:
                    yield emptied()
                    ids, sizes, payloads, held = [], [], [], 0
            if ids:
                yield emptied()

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("binary")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, what the stored files hold, and shots: the first frames of each file's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [x.as_py() for x in batch.column(2)]
            first = 0
            while first < len(files):
                last, held = first, 0
                while last < len(files) and held < BLOCK_FRAMES:
                    held += len(files[last]) // len(HEAD) + 1
                    last += 1
                part = files[first:last]
                counts, samples = samples_of(part)
                cuts = shots(counts, samples)
                raw, at, payloads = samples.tobytes(), 0, []
                for c in counts:
                    payloads.append(raw[at : at + c * SAMPLES])
                    at += c * SAMPLES
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        batch.column(1).slice(first, last - first),
                        pa.array([len(p) for p in payloads], pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                        pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                        pa.array([len(f) for f in part], pa.int64()),
                        pa.array([hashlib.sha256(f).hexdigest() for f in part], pa.string()),
                        pa.array(cuts, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "shots"],
                )
                first = last

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, shots array<long>")


def clips(files: DataFrame) -> DataFrame:
    """A row for each shot of read(): doc_id, clip, first_frame, end_frame (exclusive), start_s, end_s."""
    ends = F.concat(F.slice("shots", 2, F.size("shots")), F.array((F.col("payload_bytes") / SAMPLES).cast("long")))
    rows = files.select("doc_id", F.posexplode(F.arrays_zip(F.col("shots").alias("first"), ends.alias("last"))).alias("clip", "c"))
    return rows.select("doc_id", "clip", F.col("c.first").alias("first_frame"), F.col("c.last").alias("end_frame"), (F.col("c.first") / FRAMES_A_SECOND).alias("start_s"), (F.col("c.last") / FRAMES_A_SECOND).alias("end_s"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    feature = F.concat(F.lit("shots="), F.size("shots").cast("string"), F.lit(";frames="), F.concat_ws(",", F.col("shots").cast("array<string>")))
    return read(store(table(spark, sf_dir, "documents"))).withColumn("feature", feature).drop("shots")
