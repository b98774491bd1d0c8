import random

import numpy as np

import corpus_pipeline
from affilink.llm import op06_language_id, op10_quality

from .test_op01_jaccard_join import brute_force
from .test_op02_op05_tokens import check_packed, crc, library

SF = "/root/testdata/sf0.001"


def test_stages_are_named_and_documented():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_duplicates", "packing"]


def test_the_rows_of_a_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = op06_language_id.train(docs)
    labeller = op06_language_id.Labeller(model)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    names, scores = labeller.document([t for _, t in rows])
    kept = [r for r, n, s in zip(rows, names, scores) if n != "und" and s >= corpus_pipeline.LEAST_LANGUAGE]
    first = corpus_pipeline.language_stage(spark, docs, SF)
    assert first.columns == docs.columns and sorted((r.doc_id, r.text) for r in first.collect()) == kept
    own = op10_quality.train(first, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = op10_quality.Scorer(own.lines(), own.offset())
    kept = [r for r in kept if scorer.score(r[1]) >= op10_quality.THRESHOLD]
    assert 0.7 * len(rows) < len(kept) < len(rows)
    groups = {d: c for d, _, c in brute_force(kept, n=5, num=80, den=100)}
    kept = [r for r in kept if groups[r[0]] == r[0]]
    pieces = corpus_pipeline.run(spark, SF).collect()
    by_doc = check_packed(pieces, None, 4096)
    assert sorted(d for d, _ in by_doc) == [d for d, _ in kept]
    for (doc_id, _), ids in zip(kept, library([t for _, t in kept])):
        assert [crc(ids[p.start : p.start + p.length]) == p.ids_crc32 for p in by_doc[doc_id, len(ids)]].count(False) == 0
        assert sum(p.length for p in by_doc[doc_id, len(ids)]) == len(ids)


def test_near_copies_of_five_words_and_four_fifths_go(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(9000)}" for _ in range(rng.randrange(100, 111))]
        # scattered edits, and a text that is longer by 15 %
        edited = list(words)
        for i in (20, 60):
            edited[i] = "edit"
        longer = words + [f"v{rng.randrange(9000)}" for _ in range(len(words) * 15 // 100)]
        for text in (words, edited, longer):
            rows.append((len(rows), " ".join(text)))
    groups = {d: c for d, _, c in brute_force(rows, n=5, num=80, den=100)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect())
    assert kept == [d for d, _ in rows if groups[d] == d]
    assert len(kept) == 12 < len(set(c for _, _, c in brute_force(rows)))


def test_each_group_keeps_one_row_with_or_without_ids(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    near = lambda k: text(k) + " end"
    # groups 0 to 2 have no id, one of 0's rows is a near copy; 3 has ids and none; 4 and 5 share id 7, and 5 has 6 too
    rows = [(None, text(0)), (None, near(0)), (None, text(0)), (None, text(1)), (None, text(2)), (None, text(2))]
    rows += [(None, text(3)), (3, near(3)), (7, text(4)), (7, text(5)), (6, near(5)), (7, text(4)), (None, ""), (None, ""), (8, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()]
    alone = [t for d, t in kept if d is None and t and t.startswith("t0")]
    assert len(alone) == 1 and alone[0] in (text(0), near(0))
    expected = [(None, alone[0]), (None, text(1)), (None, text(2)), (3, near(3)), (7, text(4)), (6, near(5)), (None, ""), (None, ""), (8, "")]
    assert sorted(kept, key=str) == sorted(expected, key=str)


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1").select("doc_id")
    stayed = corpus_pipeline.quality_stage(spark, corpus_pipeline.language_stage(spark, docs, ""), "/root/testdata/sf0.01")
    assert stayed.join(good, "doc_id").count() >= 0.98 * good.count()


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:3]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            docs = out
        assert np.isfinite(corpus_pipeline.packing_stage(spark, docs, SF).count())
    kept = corpus_pipeline.near_duplicate_stage(spark, odd_docs, SF)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [0, 1, 2, 3, 4, 5, 6, 7, 9, None]))


def test_near_duplicates_shuffle_no_whole_texts(spark, tmp_path):
    """No join moves whole texts, and only sets of possible pairs are moved."""

    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        held = spark._jsc.sc().statusStore().executorList(False)
        return sum(held.apply(k).totalShuffleWrite() for k in range(held.size()))

    rng = random.Random(8)
    passage = [f"p{i}" for i in range(30)]
    docs = [(k, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(400)])) for k in range(1500)]
    docs += [(1500 + k, docs[k][1] + " end") for k in range(0, 60, 2)]
    size = sum(len(t) for _, t in docs)
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(path)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        kept = corpus_pipeline.near_duplicate_stage(spark, spark.read.parquet(path), SF)
        kept.write.parquet(f"file://{tmp_path}/kept")
        moved = shuffled() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert spark.read.parquet(f"file://{tmp_path}/kept").count() == 1500
    assert moved < 2 * size
