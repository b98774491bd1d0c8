import random
import re

from affilink.llm import op04_licenses as licenses


def slow_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def slow_base(text):
    words = slow_words(text)
    out = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        out += [(label, i) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(out)


def test_matching_statistics_are_those_of_brute_force():
    rng = random.Random(0)
    templates = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 9))] for _ in range(6)]
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    a = licenses.Automaton(templates)
    for _ in range(200):
        text = [rng.randrange(1, 5) for _ in range(20)]
        state = length = 0
        for i, w in enumerate(text):
            state, length = a.step(state, length, w)
            expected = max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in runs), default=0)
            assert length == expected
            if length:
                ends = {(t, e) for t, ws in enumerate(templates) for e in range(len(ws)) if ws[max(0, e + 1 - length) : e + 1] == text[i + 1 - length : i + 1]}
                assert a.places[state] == ends


def test_base_places_are_those_of_brute_force():
    rng = random.Random(1)
    scanner = licenses.Scanner()
    vocabulary = ["cc", "BY", "by-", "general", "Public", "license", "all", "rights", "reserved.", "licensed under", "x", "the gnu", "Ünder", "nc 4"]
    for _ in range(800):
        text = rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.randrange(25)))
        n, places, _ = scanner.scan(text.encode())
        assert (n, sorted(places)) == slow_base(text)


def test_spans_of_templates_whole_changed_and_torn():
    scanner = licenses.Scanner()
    whole = "Some words first. Licensed under the Apache License, Version 2.0 (and more); then Released under the MIT License!"
    assert [s[:3] for s in scanner.scan(whole.encode())[2]] == [("apache-2.0", 3, 10), ("mit", 14, 18)]
    bsd = dict((label, text) for label, text in licenses.TEMPLATES)["bsd"].split()
    changed = " ".join([*bsd[:8], "oddly", *bsd[8:14], *bsd[15:]])
    ((label, first, last, covered),) = scanner.scan(("x y " + changed).encode())[2]
    assert (label, first, last) == ("bsd", 2, 2 + len(bsd) - 1) and 0.9 < covered < 1
    torn = " ".join(bsd[:8]) + " word" * 40 + " " + " ".join(bsd[8:])
    assert scanner.scan(torn.encode())[2] == []
    assert len(scanner.scan(("released under the mit license " * 2000).encode())[2]) == 2000


def test_odd_rows(spark, odd_docs, no_docs):
    rows = licenses.scanned(odd_docs).collect()
    given = sorted((str(r.doc_id), *slow_base(r.text)) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.n_words, [tuple(b) for b in r.base]) for r in rows) == given
    assert licenses.scanned(no_docs).count() == 0


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: slow_base(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = licenses.op4_licenses(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, base = docs[r.doc_id]
        firsts = [i for _, i in base]
        labels = sorted({b for b, _ in base})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(base), min(firsts, default=None), max(firsts, default=None), ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) and 0 <= r.score <= 1
