import random
import zlib

import pytest
from pyspark.sql import functions as F

from affilink.llm import op07_sentencepiece as pieces

TEXTS = ["Hello  world", "a", " a", "ﬁ  ", "The quick brown fox jumps over antidisestablishmentarianism", "Ä ü\n\t中🙂 x▁y", "internationalization of things", "x" * 90 + " y", "    four", "<s> <unk> <0x0A>"]


@pytest.fixture(scope="module")
def library():
    return pieces._processor(pieces.MODEL)


def test_ids_are_those_of_the_library_and_come_back(spark, library):
    rng = random.Random(0)
    bits = ["the", "ing", "tion", " ", " ", "st", "ß", "é", "中", "q", "zx", "\n", "ab", "ough", ".", ","]
    texts = TEXTS + ["".join(rng.choices(bits, k=rng.randrange(1, 25))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pieces.decode(pieces.encode(docs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id]), texts[r.doc_id]
        assert r.text == texts[r.doc_id].replace("▁", " ")


def best_path(text, table, first_byte):
    """Brute force over the whole text, without words or a relation: ids and sum of the best path."""
    text = "▁" + text.replace(" ", "▁") if text else ""
    held = [(0.0, 0, None)]
    for end in range(1, len(text) + 1):
        options = [(held[a][0] + table[text[a:end]][1], -a, table[text[a:end]][0]) for a in range(max(0, end - 16), end) if text[a:end] in table]
        if text[end - 1 : end] not in table:
            options.append((held[end - 1][0] + pieces.UNKNOWN, -(end - 1), None))
        score, a, number = max(options, key=lambda o: o[:2])
        held.append((score, -a, number))
    ids, at = [], len(text)
    while at:
        _, a, number = held[at]
        ids = ([number] if number is not None else [first_byte + b for b in text[a:at].encode()]) + ids
        at = a
    return ids


@pytest.fixture(scope="module")
def known(library):
    own = range(library.get_piece_size())
    return {library.id_to_piece(i): (i, library.get_score(i)) for i in own if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))}, library.piece_to_id("<0x00>")


def test_viterbi_takes_the_best_path(spark, known):
    rng = random.Random(1)
    bits = ["the", "ing", "tion", " ", "  ", "st", "ß", "é", "中", "q", "zx", "\n", "ab", "ough", ".", ",", "12"]
    texts = [*TEXTS, "q" * 300, *("".join(rng.choices(bits, k=rng.randrange(1, 25))) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pieces.decode(pieces.encode(docs, folds=pieces.FOLDS)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == best_path(texts[r.doc_id], *known), texts[r.doc_id]
        assert r.text == texts[r.doc_id].replace("▁", " ")
    own = pieces._processor(pieces.MODEL)
    assert all(r.ids_merges == own.encode(texts[r.doc_id]) for r in rows)


def test_long_words_stay_in_the_lattice(spark, library, known):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdeﬁ", k=700)), "a" * 500, "中q" * 200, "internationalization" * 20]
    rows = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), folds=pieces.FOLDS).collect()
    assert {r.doc_id: r.ids for r in rows} == {k: best_path(t, *known) for k, t in enumerate(texts)}
    assert {r.doc_id: r.ids_merges for r in rows} == {k: library.encode(t) for k, t in enumerate(texts)}


def test_the_texts_are_shuffled_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = pieces.decode(pieces.encode(docs, folds=pieces.FOLDS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_odd_rows(spark, odd_docs, no_docs, library):
    docs = odd_docs.withColumnRenamed("start", "place").withColumn("row", F.lit("clash")).withColumn("n_pieces", F.lit(1))
    rows = pieces.decode(pieces.encode(docs)).collect()
    given = sorted((str(d.doc_id), library.encode(d.text or ""), (d.text or "").replace("▁", " ")) for d in odd_docs.collect())
    assert sorted((str(r.doc_id), r.ids, r.text) for r in rows) == given
    assert pieces.decode(pieces.encode(no_docs)).count() == 0


def test_query_over_the_whole_table(spark, library, known):
    """Ids against brute force and the library, the decoded text against the text itself."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pieces.op7_sentencepiece(spark, sf).collect()
    crc = lambda ids: zlib.crc32(" ".join(map(str, ids)).encode())
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r.doc_id]
        best, merged = best_path(text, *known), library.encode(text)
        assert (r.n_pieces, r.ids_crc32, r.n_merged, r.merged_crc32) == (len(best), crc(best), len(merged), crc(merged))
        assert (r.text_length, r.text_crc32) == (len(text), zlib.crc32(text.replace("▁", " ").encode()))
