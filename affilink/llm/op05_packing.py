"""Cost-balanced packing of token ids into training sequences.

A piece of n tokens costs linear * n + quadratic * n * n. Documents are taken in bounded groups of one partition, so no
row is shuffled and a task holds one group at a time. Within a group: a document of a whole sequence or more gives its
full slices away as sequences of their own; what is left of it and all shorter documents, longest first, go uncut to the
sequence of lowest cost that still has room. What found no room is cut to fill the gaps, lowest cost first. A group has
as many full sequences as its tokens fill; the rest, under one sequence, fills sequences whose lengths are falling
powers of two, which need no padding. So no sequence is padded, and only the last of what found no room is cut.

Nulls and empty texts hold just the end id. Repeated rows are packed one by one. A null doc_id stays null. Rows of an
empty table: none. Other columns are not read. sequence_id is the partition's number times 2**40 plus a running number:
unique, and the same again when a task is repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from affilink.llm.shared import table
from affilink.llm.tokenizing import encoder

SEQUENCE_TOKENS = 4096
END_ID = 2
GROUP_TOKENS = 1 << 22
VOCABULARY = "word_bpe_49k.json"

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def powers(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_group(lengths: np.ndarray, size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start in it, length, sequence, offset there) of each piece; sequences count from 0."""
    pieces: list[tuple[int, int, int, int, int]] = []
    full = lengths // size
    sequence = 0
    for doc in np.flatnonzero(full):
        for k in range(full[doc]):
            pieces.append((int(doc), k * size, size, sequence, 0))
            sequence += 1
    rest = lengths - full * size
    total = int(rest.sum())
    bins, tail = divmod(total, size)
    free = np.full(bins, size, dtype=np.int64)
    cost = np.zeros(bins)
    order = np.argsort(-rest, kind="stable")
    homeless: list[tuple[int, int, int]] = []

    def put(doc: int, start: int, n: int, at: int) -> None:
        pieces.append((doc, start, n, sequence + at, size - int(free[at])))
        free[at] -= n
        cost[at] += linear * n + quadratic * n * n

    for doc in order[: np.count_nonzero(rest)].tolist():
        n = int(rest[doc])
        room = np.flatnonzero(free >= n)
        if room.size:
            put(doc, int(full[doc]) * size, n, int(room[np.argmin(cost[room])]))
        else:
            homeless.append((doc, int(full[doc]) * size, n))
    gaps = np.flatnonzero(free > 0)
    gaps = gaps[np.argsort(cost[gaps], kind="stable")].tolist()[::-1]
    spare = [[n, 0] for n in powers(tail)][::-1]
    first_spare = sequence + bins + len(spare)
    for doc, start, n in homeless:
        while n:
            if gaps:
                at = gaps[-1]
                k = min(n, int(free[at]))
                put(doc, start, k, at)
                if not free[at]:
                    gaps.pop()
            else:
                k = min(n, spare[-1][0] - spare[-1][1])
                pieces.append((doc, start, k, first_spare - len(spare), spare[-1][1]))
                spare[-1][1] += k
                if spare[-1][0] == spare[-1][1]:
                    spare.pop()
            start, n = start + k, n - k
    return pieces


def pack(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    size: int = SEQUENCE_TOKENS,
    end_id: int = END_ID,
    linear: float = 1.0,
    quadratic: float = 1.0 / SEQUENCE_TOKENS,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """A row for each piece of docs (doc_id, text). Each id lies in one piece; a sequence's pieces follow without gaps."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_sequence = TaskContext.get().partitionId() << 40
        ids: list[int | None] = []
        held: list[bytes] = []
        tokens = 0

        def emptied() -> pa.RecordBatch:
            nonlocal next_sequence, tokens
            lengths = np.array([len(x) // 4 for x in held], dtype=np.int64)
            pieces = pack_group(lengths, size, linear, quadratic)
            doc, start, n, sequence, offset = np.array(pieces, dtype=np.int64).reshape(-1, 5).T
            crc = [zlib.crc32(memoryview(held[d])[4 * s : 4 * (s + k)]) for d, s, k in zip(doc.tolist(), start.tolist(), n.tolist())]
            out = pa.RecordBatch.from_arrays(
                [pa.array([ids[d] for d in doc.tolist()], pa.int64()), *(pa.array(x, pa.int64()) for x in (start, n, crc, lengths[doc], sequence + next_sequence, offset))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            next_sequence += int(sequence.max()) + 1
            ids.clear()
            held.clear()
            tokens = 0
            return out

        with encoder(vocabulary) as enc:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids.append(doc_id)
                    held.append(enc.encode(text.as_py()) + end)
                    tokens += len(held[-1]) // 4
                    if tokens >= group_tokens:
                        yield emptied()
        if held:
            yield emptied()

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
