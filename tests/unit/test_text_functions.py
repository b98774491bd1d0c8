import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from affilink.functions import abbreviations, normalize, qualifiers, similarity


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(function(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "function, text, expected",
    [
        (normalize.turkish_lower, "İSTANBUL", "istanbul"),
        (normalize.turkish_lower, "TIP", "tıp"),
        (normalize.turkish_lower, "ŞĞÜÖÇ", "şğüöç"),
        (normalize.lower_by_content, "TIP FAKÜLTESİ", "tıp fakültesi"),
        (normalize.lower_by_content, "TECHNICAL UNIVERSITY", "technical university"),
        (normalize.without_accents, "çğıöşü äéß", "cgiosu äéß"),
        (normalize.whitespace, " a  ​ b﻿\n\tc ", "a b c"),
        (normalize.without_punctuation, "fen-edebiyat fakültesi", "fen edebiyat fakültesi"),
        (normalize.without_punctuation, "2. öğretim", "2  öğretim"),
        (normalize.query_text, "gazi üni ANKARA", "gazi ÜNİVERSİTESİ ANKARA"),
        (normalize.legacy_fold, " GAZİ  Üniversitesi, IĞDIR", "gazi universitesi, igdir"),
        (normalize.name_key, "Gazi Üni. İstatistik Böl.", "gazi universitesi istatistik bolumu"),
        (normalize.name_key, "ﬁne ＡＢＣ", "fine abc"),
        (normalize.name_key, None, None),
        (normalize.name_key, "", ""),
    ],
)
def test_texts(spark, function, text, expected):
    assert one(spark, text, function) == expected


def test_truth(spark):
    rows = spark.createDataFrame([("true",), (" TRUE\t",), ("false",), ("",), (None,), ("yes",)], "x string")
    assert [r.y for r in rows.select(normalize.is_true(F.col("x")).alias("y")).collect()] == [True, True, False, False, False, False]


def test_tokens_of_nothing_are_none(spark):
    assert one(spark, "", normalize.tokens) == [] and one(spark, "a b", normalize.tokens) == ["a", "b"]


def test_abbreviations_as_python_has_them(spark):
    rng = random.Random(0)
    bits = ["fak", "fak.", "m.y.o.", "MYO", "abd", "abd.", "a.b.d.", "ünv.", "ün.x", "üni", "UNIV.", "böl.", "bol", "Müh", "sos. bil.", "fen bil.", "yük. okl.", "pr.", "prg.", "dept.", "eng", "inst.", "x", "arş.", "egt", " ", " ", "  ", ".", ","]
    texts = ["".join(rng.choices(bits, k=6)) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", abbreviations.expanded(F.col("x")).alias("y")).collect()
    for r in rows:
        expected = r.x
        for pattern, expansion in abbreviations.ABBREVIATIONS:
            expected = re.sub(pattern, expansion, expected, flags=re.IGNORECASE)
        assert r.y == expected


@pytest.mark.parametrize(
    "text, dimension, expected",
    [
        ("Matematik (DR)", "degree", "phd"),
        ("Dr. Sami Ulus Hastanesi", "degree", None),
        ("İşletme (YL)", "degree", "yl"),
        ("master of arts", "degree", "yl"),
        ("Yüksek Lisans", "degree", "yl"),
        ("Önlisans", "degree", "onlisans"),
        ("Hukuk (İÖ)", "modality", "ikinci_ogretim"),
        ("ikinci öğretim", "modality", "ikinci_ogretim"),
        ("uzaktan öğretim", "modality", "uzaktan"),
        ("MBA WITH THESIS", "thesis", True),
        ("tezsiz", "thesis", False),
        ("TEZLİ", "thesis", True),
        ("non-thesis", "thesis", False),
        ("İngilizce", "language", "en"),
        ("Türkçe", "language", "tr"),
        ("ALMANCA", "language", "de"),
        ("Fransızca", "language", "fr"),
        ("arapça", "language", "ar"),
        ("rusça", "language", "ru"),
        ("spanish", "language", "es"),
        ("Matematik", "language", None),
        ("Disiplinlerarası tam burslu", "extra", ["interdisciplinary", "full_scholarship"]),
        ("ücretli", "extra", ["paid"]),
        ("Matematik", "extra", []),
    ],
)
def test_qualifiers(spark, text, dimension, expected):
    assert one(spark, text, qualifiers.qualifiers)[dimension] == expected


@pytest.mark.parametrize("query, candidate, clash, score", [("tezli", "tezsiz", True, 0.0), ("tezli", "matematik", False, 0.0), ("matematik", "tezli", False, 0.5), ("tezli", "tezli", False, 1.0), ("tezli ingilizce", "tezli", False, 0.5), ("ücretli", "tam burslu", False, 0.5)])
def test_conflict_and_score(spark, query, candidate, clash, score):
    row = spark.createDataFrame([(query, candidate)], "q string, c string").select(qualifiers.qualifiers(F.col("q")).alias("q"), qualifiers.qualifiers(F.col("c")).alias("c"))
    assert tuple(row.select(qualifiers.conflict(F.col("q"), F.col("c")), qualifiers.match_score(F.col("q"), F.col("c"))).first()) == (clash, score)


@pytest.mark.parametrize(
    "function, a, b, expected",
    [
        (similarity.ratio, "department of educational", "department of education", 95.83),
        (similarity.ratio, "hacettepe university", "hacettepe universitesi", 90.48),
        (similarity.ratio, "canakkale 18 mart universitesi", "canakkale onsekiz mart universitesi", 86.15),
        (similarity.ratio, "mart", "smart", 88.89),
        (similarity.ratio, "mart universitesi", "marmara universitesi", 86.49),
        (similarity.ratio, "ghazi university", "gazi university", 96.77),
        (similarity.ratio, "westfälische wilhelm university", "westfälische wilhelms universität munster", 83.33),
        (similarity.ratio, "", "", 100.0),
        (similarity.token_set_ratio, "gazi universitesi istatistik bolumu", "gazi universitesi", 100.0),
        (similarity.token_set_ratio, "gazi universitesi istatistik bolumu", "biruni universitesi", 77.42),
        (similarity.token_set_ratio, "gazi universitesi istatistik bolumu", "selcuk universitesi", 77.42),
        (similarity.token_set_ratio, "gazi universitesi istatistik bolumu", "bogazici universitesi", 72.73),
        (similarity.token_set_ratio, "", "x", 0.0),
        (similarity.edits, "abcd", "abdc", 1),
        (similarity.edits, "kitten", "sitting", 3),
    ],
)
def test_golden_similarities(function, a, b, expected):
    assert function(a, b) == pytest.approx(expected, abs=0.005) and function(b, a) == pytest.approx(expected, abs=0.005)


def test_common_subsequence_is_that_of_the_table():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcç ", k=rng.randrange(90))) for _ in range(2))
        table = [[0] * (len(b) + 1)]
        for c in a:
            row = [0]
            for j, d in enumerate(b):
                row.append(table[-1][j] + 1 if c == d else max(table[-1][j + 1], row[-1]))
            table.append(row)
        assert similarity.common(a, b) == table[-1][-1]


def test_similarity_columns_keep_nulls(spark):
    rows = spark.createDataFrame([("a b", "a"), (None, "a")], "x string, y string")
    got = rows.select(similarity.indel_ratio("x", "y"), similarity.token_set("x", "y"), similarity.edit_distance("x", "y")).collect()
    assert got[0][0] == pytest.approx(50.0) and got[0][1:] == (100.0, 2) and tuple(got[1]) == (None, None, None)


def test_nfkc_of_arrays(spark):
    assert one(spark, ["ﬁ", None, "x"], normalize.nfkc_all, "array<string>") == [unicodedata.normalize("NFKC", "ﬁ"), None, "x"]
