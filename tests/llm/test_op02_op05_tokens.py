import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from affilink.llm import op02_token_planes as planes
from affilink.llm import op05_packing as packing
from affilink.llm.shared import shared_dir, vocabulary_path
from affilink.llm.tokenizing import RunEncoder

VOCABULARY = "word_bpe_49k.json"


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(VOCABULARY))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


@pytest.mark.parametrize("vocabulary", [VOCABULARY])
def test_plain_runs_give_the_ids_of_the_library(vocabulary):
    rng = random.Random(2)
    plain = [chr(c) for c in [*range(0x21, 0x7F), *range(0xC0, 0x100)]] + ["'s", "'LL", "the", "ing", "Ä", "ß", "×", "÷", "ª", "²"]
    runs = ["".join(rng.choices(plain, k=rng.randrange(1, 14))) for _ in range(4000)]
    enc = RunEncoder(vocabulary)
    assert [np.frombuffer(enc.encode(r), "<u4").tolist() for r in runs] == [x[:-1] for x in library(runs)]
    assert enc.memo.encode == enc.run


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_runs_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    alphabet = "ab'sre.,!1 23\n\t éÉßñ́  \x1d\x85İΣς中🙂<|endoftext|>"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(1500)]
    enc = RunEncoder(VOCABULARY, memo_bytes=10_000)
    assert [np.frombuffer(enc.encode(t), "<u4").tolist() for t in texts] == [x[:-1] for x in library(texts)]


@pytest.mark.parametrize("bits", [False, True])
def test_images_round_trip(bits):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 2**int(rng.integers(1, 33)), n, dtype=np.uint64).astype("<u4").tobytes() for n in (0, 1, 7, 300, 1000, 13)]
    image = planes.write_image([3, None, 5, 6, 6, 9], docs, bits, block_ids=128)
    names, bounds, ids = planes.read_image(image)
    assert names == [3, None, 5, 6, 6, 9] and ids.tobytes() == b"".join(docs)
    assert bounds.tolist() == np.cumsum([0, *(len(d) // 4 for d in docs)]).tolist()
    assert planes.read_image(image, 250, 700)[2].tolist() == ids[250:700].tolist()
    assert planes.read_image(planes.write_image([], [], bits))[2].size == 0


def test_token_files_hold_the_library_ids_in_order(spark, odd_docs, tmp_path):
    path = f"{shared_dir(spark)}/{tmp_path.name}"
    planes.write_tokens(odd_docs, path, image_ids=3000)
    rows = planes.read_tokens(spark, path).select("doc_id", "start", F.crc32("ids").alias("c"), (F.length("ids") / 4).alias("n")).collect()
    given = sorted(odd_docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at = 0
    for row, doc, ids in zip(sorted(rows, key=lambda r: r.start), given, library([d.text for d in given]), strict=True):
        assert (row.doc_id, row.start, row.n, row.c) == (doc.doc_id, at, len(ids), crc(ids))
        at += len(ids)


def test_no_documents_no_rows(spark, no_docs, tmp_path):
    path = f"{shared_dir(spark)}/{tmp_path.name}"
    planes.write_tokens(no_docs, path)
    assert planes.read_tokens(spark, path).count() == 0
    assert packing.pack(no_docs).count() == 0


def check_packed(rows, ids_of, size):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    for r in rows:
        assert r.length > 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == size or at < size and at & (at - 1) == 0
    return by_doc


@pytest.mark.parametrize("size", [64, 4096])
def test_each_id_lies_in_one_piece_and_nothing_is_padded(spark, odd_docs, size):
    docs = odd_docs.dropDuplicates(["doc_id"])
    rows = packing.pack(docs, size=size, group_tokens=5000).collect()
    by_doc = check_packed(rows, None, size)
    given = docs.select("doc_id", "text").collect()
    for doc, ids in zip(given, library([d.text for d in given])):
        at = 0
        for p in sorted(by_doc[doc.doc_id, len(ids)], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)


def test_repeated_rows_are_packed_each(spark, odd_docs):
    rows = packing.pack(odd_docs).collect()
    given = odd_docs.collect()
    assert sum(r.length for r in rows) == sum(map(len, library([d.text for d in given])))
    check_packed(rows, None, 4096)


def test_longest_first_to_the_lowest_cost():
    pieces = packing.pack_group(np.array([40, 30, 20, 10, 60, 40]), 100, 1.0, 0.01)
    assert {(d, s) for d, _, _, s, _ in pieces} == {(4, 0), (0, 1), (5, 1), (1, 0), (2, 1), (3, 0)}
    costs = defaultdict(float)
    for _, _, n, s, _ in packing.pack_group(np.random.default_rng(1).integers(1, 400, 2000), 4096, 1.0, 1 / 4096):
        costs[s] += n + n * n / 4096
    full = [c for c in costs.values() if c > 4096]
    assert max(full) < 1.15 * min(full)
