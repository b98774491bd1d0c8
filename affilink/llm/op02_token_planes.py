"""Token files: blocks of ids shuffled into bit or byte planes, each plane compressed with zstandard, with a chunk index.

File image: header, blocks, document index, chunk index, footer. A block holds up to BLOCK_IDS ids as unsigned 32-bit
integers, transposed so that one plane has the same bit (or byte) of all its ids; planes of zeros are left out. The chunk
index has each block's number of ids and the place of each plane, so that a reader decodes only the blocks it needs; the
document index has each document's first id. Images are the rows of a Parquet table in the shared folder: Spark's commit
protocol makes each appear once, whatever executor is lost, and any store serves. export_images() turns them into files.

Documents are written in ascending doc_id order (null first, then by a hash of the text) by a range partitioning. Null texts hold the
end id only. Repeated rows are kept. An empty table gives no images. Other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affilink.llm.shared import partitions_for, shared_dir, table
from affilink.llm.tokenizing import encoder

MAGIC = b"BITPLNS1"
BLOCK_IDS = 1 << 16
IMAGE_IDS = 1 << 20
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
ZSTD_LEVEL = 1
PARTITION_BYTES = 64 << 20
_HEADER = struct.Struct("<8sB3xI")
_FOOTER = struct.Struct("<QQQQ8s")
_NO_ID = -(1 << 63)


def shuffled(ids: np.ndarray, bits: bool) -> np.ndarray:
    """The planes of a block, a row each: 4 of bytes, or 32 of bits."""
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    planes = np.ascontiguousarray(rows.T)
    if not bits:
        return planes
    return np.concatenate([np.packbits((p[None, :] >> np.arange(8, dtype=np.uint8)[:, None]) & 1, axis=1) for p in planes])


def unshuffled(planes: np.ndarray, n: int, bits: bool) -> np.ndarray:
    if bits:
        ones = np.unpackbits(planes, axis=1, count=n).reshape(4, 8, n)
        planes = (ones << np.arange(8, dtype=np.uint8)[None, :, None]).sum(axis=1, dtype=np.uint8)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def write_image(doc_ids: list[int | None], docs: list[bytes], bits: bool = False, block_ids: int = BLOCK_IDS) -> bytes:
    import zstandard

    press = zstandard.ZstdCompressor(level=ZSTD_LEVEL)
    ids = np.frombuffer(b"".join(docs), dtype="<u4")
    out = [_HEADER.pack(MAGIC, bits, block_ids)]
    at = len(out[0])
    chunks = []
    for first in range(0, len(ids), block_ids):
        block = ids[first : first + block_ids]
        row = [len(block)]
        for plane in shuffled(block, bits):
            pressed = press.compress(plane.tobytes()) if plane.any() else b""
            row += [at, len(pressed)]
            out.append(pressed)
            at += len(pressed)
        chunks.append(row)
    starts = np.cumsum([0, *(len(d) // 4 for d in docs)])[:-1]
    index = np.array([[_NO_ID if i is None else i for i in doc_ids], starts], dtype="<i8").tobytes()
    table_ = np.array(chunks, dtype="<u8").tobytes()
    tail = [press.compress(index), press.compress(table_)]
    return b"".join([*out, *tail, _FOOTER.pack(at, at + len(tail[0]), len(docs), len(ids), MAGIC)])


def read_image(image: bytes, first: int = 0, last: int | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, each document's first id in the image (and the end), and the ids from first to last."""
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    magic, bits, block_ids = _HEADER.unpack_from(image)
    docs_at, chunks_at, n_docs, n_ids, again = _FOOTER.unpack_from(image, len(image) - _FOOTER.size)
    if magic != MAGIC or again != MAGIC:
        raise ValueError("not a token file")
    index = np.frombuffer(open_.decompress(image[docs_at:chunks_at]) if n_docs else b"", dtype="<i8").reshape(2, n_docs)
    planes_of = 32 if bits else 4
    chunks = np.frombuffer(open_.decompress(image[chunks_at : len(image) - _FOOTER.size]) if n_ids else b"", dtype="<u8").reshape(-1, 1 + 2 * planes_of)
    last = n_ids if last is None else min(last, n_ids)
    parts = []
    for k in range(first // block_ids, -(-last // block_ids)):
        n, width = int(chunks[k, 0]), -(-int(chunks[k, 0]) // 8) if bits else int(chunks[k, 0])
        planes = np.zeros((planes_of, width), dtype=np.uint8)
        for p, (at, size) in enumerate(chunks[k, 1:].reshape(-1, 2).tolist()):
            if size:
                planes[p] = np.frombuffer(open_.decompress(image[at : at + size]), dtype=np.uint8)
        parts.append(unshuffled(planes, n, bits))
    ids = np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
    base = first // block_ids * block_ids
    names = [None if i == _NO_ID else i for i in index[0].tolist()]
    return names, np.append(index[1], n_ids), ids[first - base : last - base]


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, bits: bool = False, image_ids: int = IMAGE_IDS) -> None:
    """Writes the token files of docs (doc_id, text) to path: rows file_no, image_no, n_docs, n_tokens, image."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file_no, image_no = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[bytes] = []
        tokens = 0

        def emptied() -> pa.RecordBatch:
            image = write_image(names, held, bits)
            return pa.RecordBatch.from_pylist([{"file_no": file_no, "image_no": image_no, "n_docs": len(names), "n_tokens": tokens, "image": image}], schema=pa.schema([("file_no", pa.int64()), ("image_no", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("image", pa.binary())]))

        with encoder(vocabulary) as enc:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    names.append(doc_id)
                    held.append(enc.encode(text.as_py()) + end)
                    tokens += len(held[-1]) // 4
                    if tokens >= image_ids:
                        yield emptied()
                        names, held, tokens, image_no = [], [], 0, image_no + 1
        if held:
            yield emptied()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    # an id that many rows share, or null, is split by its texts, and a text by its rows
    order = ["doc_id", "_hash", "_row"]
    rows = rows.repartitionByRange(partitions_for(docs, PARTITION_BYTES), *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(run, "file_no long, image_no long, n_docs long, n_tokens long, image binary").write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of token files: doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit).

    start adds three numbers: the ids of earlier files (a sum over one row a file), of earlier images of its file, and of
    earlier documents of its image.
    """
    images = spark.read.parquet(path)
    heads = images.select("file_no", "image_no", "n_tokens")
    files = heads.groupBy("file_no").agg(F.sum("n_tokens").alias("n")).withColumn("file_start", F.sum("n").over(Window.orderBy("file_no")) - F.col("n"))
    before = Window.partitionBy("file_no").orderBy("image_no")
    starts = heads.withColumn("image_start", F.sum("n_tokens").over(before) - F.col("n_tokens")).join(files, "file_no").select("file_no", "image_no", (F.col("file_start") + F.col("image_start")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, image in zip(batch.column(0).to_pylist(), batch.column(1)):
                names, bounds, ids = read_image(image.as_py())
                raw, at = ids.tobytes(), bounds.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(bounds[:-1] + base, pa.int64()), pa.array([raw[4 * a : 4 * b] for a, b in zip(at, at[1:])], pa.binary())], ["doc_id", "start", "ids"])

    # the images themselves aren't shuffled: an image's start comes to it by its file and number, a few bytes each
    based = images.select("file_no", "image_no", "image").join(F.broadcast(starts) if small(spark, path) else starts, ["file_no", "image_no"])
    return based.select("base", "image").mapInArrow(run, "doc_id long, start long, ids binary")


def small(spark: SparkSession, path: str, rows: int = 100_000) -> bool:
    """Whether the table at path has so few rows that a number for each may be broadcast; counted from the footers."""
    return spark.read.parquet(path).count() <= rows


def export_images(images: DataFrame, folder: str) -> None:
    """Writes each image to a file of its own in a folder that driver and caller share, one at a time."""
    for row in images.toLocalIterator():
        with open(f"{folder}/{row.file_no:06d}-{row.image_no:06d}.bitplanes", "wb") as f:
            f.write(row.image)


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    back = read_tokens(spark, path)
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
