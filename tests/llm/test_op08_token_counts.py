import random

import pytest

from affilink.llm import op08_token_counts as counts
from affilink.llm.shared import vocabulary_path

ALPHABET = ["the", "ing", " ", "  ", "\n", "\n\n", "\t", "'s", "'ll", "'", "I'D", ".", "!!", "12", "7", "x", "Ä", "ß", "é", "ñ", "中", "🙂", "²", "́", "İ", " ", " ", "\x85", "\x1d", "<|endoftext|>", "tion", "able", "un", "Ω", "_", "a"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(counts.VOCABULARY))
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return counts.Counter(counts.VOCABULARY)


def texts(seed, n, most):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(most))) for _ in range(n)]


def test_counts_are_those_of_the_library(library, counter):
    for text in [*texts(0, 2500, 40), "a" * 3000, " " * 500, "\n" * 77 + "x", "antidisestablishmentarianism" * 20]:
        assert counter.count(text) == library(text), text


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 20])
def test_chunks_compose_to_the_whole(library, counter, chunk):
    for text in texts(chunk, 300, 40):
        assert counter.count(text, chunk) == library(text), text


def test_composition_is_associative_and_scans_give_all_prefixes(library, counter):
    for text in texts(9, 200, 60):
        text = text.replace("<|endoftext|>", "").replace("\x1d", "")
        maps = [counter.chunk(text[k : k + 5]) for k in range(0, len(text), 5)]
        if len(maps) > 2:
            a, b, c = maps[:3]
            assert counter.composed(counter.composed(a, b), c) == counter.composed(a, counter.composed(b, c))
        for k, m in enumerate(counter.scan(maps)):
            assert counter.total(m) == library(text[: 5 * (k + 1)])


def test_states_recur_and_may_be_forgotten(library, monkeypatch):
    own = counts.Counter(counts.VOCABULARY, memo_runs=10)
    monkeypatch.setattr(counts, "MOST_STATES", 50)
    monkeypatch.setattr(counts, "MOST_PAIRS", 20)
    own.count("abcabcabc" * 50)
    assert len(own.transducer.states) < 200  # a long text needs few
    for text in texts(4, 200, 30):
        assert own.count(text) == library(text)


def test_odd_rows(spark, odd_docs, no_docs, library):
    rows = counts.counted(odd_docs).collect()
    given = sorted((str(d.doc_id), len((d.text or "").encode()), library(d.text or "")) for d in odd_docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == given
    assert counts.counted(no_docs).count() == 0


def test_query_over_the_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = counts.op8_token_counts(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all((r.n_tokens, r.n_bytes) == (library(docs[r.doc_id]), len(docs[r.doc_id].encode())) and r.over_limit == (r.n_tokens > 512) for r in rows)
