import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from affilink.llm import op06_language_id as language
from affilink.llm import op10_quality as quality
from affilink.llm import subwords
from affilink.llm.samples import remainder, sampled

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_the_sum_over_all_labellings():
    rng = np.random.default_rng(0)
    e, t, s = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    p, pairs = language.chain(e, t, s)
    seen = np.zeros((2, 4, 3))
    both = np.zeros((3, 3))
    for q in range(2):
        weights = {y: np.exp(s[y[0]] + sum(e[q, k, y[k]] for k in range(4)) + sum(t[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product(range(3), repeat=4)}
        z = sum(weights.values())
        for y, w in weights.items():
            seen[q, np.arange(4), y] += w / z
            for a, b in zip(y, y[1:]):
                both[a, b] += w / z
    assert np.allclose(p, seen) and np.allclose(pairs, both)


def toy(n=40):
    words = {"xx": ["alpha", "beta", "gamma", "the", "ing"], "yy": ["über", "straße", "und", "der", "ein"]}
    rng = np.random.default_rng(0)
    return [(rng.choice(words[k], 30).tolist(), i) for i, k in enumerate(words) for _ in range(n)]


def test_words_of_a_code_switched_text_are_labelled_each():
    docs = toy()
    model = language.Model(["xx", "yy"], language.lexicon_of(docs, 2)).fit(docs)
    labeller = language.Labeller(model)
    (p,) = labeller.probabilities(["alpha beta gamma 12 the und der straße ein über"])
    assert p.argmax(1).tolist() == [0, 0, 0, 0, 1, 1, 1, 1, 1]
    many = ["alpha beta " * k + "und der " * (5 - k) for k in range(6)] + [None, "", "12 !"]
    alone = [labeller.probabilities([t])[0] for t in many]
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(labeller.probabilities(many), alone))
    e = np.array([model.emissions(many[2].split())], dtype=np.float64)
    assert np.allclose(language.chain(e, model.transitions, model.start)[0][0], alone[2], atol=1e-4)


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    docs = toy()
    model = language.Model(["xx", "yy"], language.lexicon_of(docs, 2)).fit(docs)
    rows = language.identify(odd_docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if not r.text or not r.text.strip()} == {"und"}
    assert {r.lang_pred for r in language.identify(odd_docs, None).collect()} == {"und"}
    assert language.identify(no_docs, model).count() == 0 and language.train(no_docs) is None


def test_held_out_language_accuracy(spark):
    rows = language.op6_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


def test_folds(spark):
    import zlib

    rows = spark.range(50).select("id", remainder(F.col("id"), 3).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 3 for r in rows)
    assert spark.range(1).select(remainder(F.lit(None).cast("long"), 3).alias("m")).first().m is None


def test_samples_are_bounded_and_keep_rare_labels(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), (F.col("id") % 100 == 0).cast("int").alias("y"))
    drawn = sampled(rows, "y", 100)
    assert sum(r.y for r in drawn) == 50 and 60 < sum(1 - r.y for r in drawn) < 150
    assert drawn == sampled(rows, "y", 100)


def test_only_letters_make_words():
    assert language.words_of("½ ² Ⅷ 12 _ !") == [] and language.words_of("½a 漢 Ⅷ ª") == ["½a", "漢", "ª"]


def test_all_characters_of_a_long_word_count():
    model = language.Model(["xx", "yy"], {})
    model.weights[:] = np.random.default_rng(0).normal(size=model.weights.shape)
    a, b = "q" * 60 + "abc" + "q" * 60, "q" * 60 + "xyz" + "q" * 60
    assert not np.allclose(*model.emissions([a, b]))
    own, runs = quality.run_features([a, b])
    assert len({tuple(bs[o == k].tolist()) for bs, o in [tuple(map(np.concatenate, zip(*runs)))] for k in (0, 1)}) == 2


def test_hashes_do_not_depend_on_spans_or_neighbours(monkeypatch):
    words = ["a", "", "longer word", "x" * 1000, "ÄÖ漢😀", "longer word"]
    sums = lambda o: [o.whole(), quality.shapes(o), *(np.bincount(np.concatenate([w for _, w in p]), np.concatenate([h for h, _ in p]) % np.uint64(997), len(words)) for p in (list(o.ngrams(n)) for n in (2, 3, 4)))]
    whole = sums(subwords.Words(words))
    assert whole[0][2] == whole[0][5] and len(set(whole[0].tolist())) == 5
    for span in (1, 7, 64):
        monkeypatch.setattr(subwords, "SPAN", span)
        assert all(np.array_equal(a, b) for a, b in zip(whole, sums(subwords.Words(words))))
    assert all(np.array_equal(w[[3]], a) for w, a in zip(whole[:2], (subwords.Words(words[3:4]).whole(), quality.shapes(subwords.Words(words[3:4])))))


def test_kept_rows_are_bounded_and_the_same_again():
    kept = subwords.Kept(lambda words: [np.array([len(w) for w in words])], most_bytes=5000)
    for k in range(20):
        words = [f"{'w' * (k % 5)}{i}" for i in range(k, k + 30)]
        assert kept.columns == [] or kept.held <= 5000 + 30 * 300
        at = kept.numbers(words)
        assert kept.columns[0][at].tolist() == [len(w) for w in words]


def brute_language(model, text):
    """By sums over all labellings of each text of few words."""
    words = language.words_of(text)
    if not words:
        return "und", 0.0
    p = language.chain(np.array([model.emissions(words)], dtype=np.float64), model.transitions, model.start)[0][0].mean(0)
    return model.labels[int(p.argmax())], float(p.max())


def test_query_against_the_model_alone(spark, monkeypatch):
    """The whole query: held-out fold, prediction and score of every row, from a model learned from the other rows only."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    told = {r.doc_id: r for r in language.op6_language_id(spark, "/root/testdata/sf0.001").collect()}
    model = language.train(docs)
    rows = docs.collect()
    assert len(rows) == len(told)
    for r in rows:
        label, score = brute_language(model, r.text)
        got = told[r.doc_id]
        assert got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and abs(got.score - score) < 1e-4
        assert got.lang_pred == label or abs(sorted(language.chain(np.array([model.emissions(language.words_of(r.text))], dtype=np.float64), model.transitions, model.start)[0][0].mean(0))[-2] - score) < 1e-4


def test_quality_query_against_the_model_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    told = {r.doc_id: r for r in quality.op10_quality(spark, "/root/testdata/sf0.001").collect()}
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    for r in docs.collect():
        buckets, weights = quality.document_features(r.text)
        z = (weights @ model.vectors[buckets]) @ model.output + model.bias
        expected = 1 / (1 + np.exp(z[0] - z[1] - model.shift))
        got = told[r.doc_id]
        assert got.score == pytest.approx(expected, abs=1e-5) and got.predicted == (got.score >= 0.3)
        assert got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


@pytest.mark.parametrize("text", ["plain words of a text", "A|B !! 12", "one", "same same same", "x" * 300 + " y"])
def test_a_worker_scores_as_the_model_does(text):
    model = quality.Model(3)
    model.bias[:] = (0.2, -0.1)
    buckets, weights = quality.document_features(text)
    z = (weights @ model.vectors[buckets]) @ model.output + model.bias
    expected = 1 / (1 + np.exp(z[0] - z[1]))
    scorer = quality.Scorer(model.lines(), model.offset())
    assert scorer.score(text) == pytest.approx(expected, abs=1e-6) and scorer.score(text) == pytest.approx(expected, abs=1e-6)


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scored(odd_docs.withColumn("score", F.lit("clash")), quality.train(odd_docs, labels)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.train(odd_docs, labels.limit(0)) is None and quality.train(no_docs, labels) is None
    assert {r.score for r in quality.scored(odd_docs, None).collect()} == {0.5}
    assert quality.scored(no_docs, quality.Model()).count() == 0


def test_held_out_quality(spark):
    rows = quality.op10_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.quality == r.predicted for r in rows]) > 0.95
