"""Qualifiers of programmes in names: thesis, modality, language, degree, extras. Null: not stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from affilink.functions.normalize import turkish_lower, without_accents

#: Patterns over lower-case text without accents, punctuation kept; the first that matches gives the value.
THESIS = [
    (r"\btezsiz\b", False),
    (r"\bnon[- ]?thesis\b", False),
    (r"\bwithout thesis\b", False),
    (r"\btezli\b", True),
    (r"\bwith thesis\b", True),
]
MODALITY = [
    (r"\bikinci\s*o?g?retim\b", "ikinci_ogretim"),
    (r"\(\s*io\s*\)", "ikinci_ogretim"),
    (r"\buzaktan\s*(egitim|ogretim)\b", "uzaktan"),
    (r"\bdistance\s*education\b", "uzaktan"),
    (r"\bnormal\s*o?g?retim\b", "normal_ogretim"),
    (r"\borgun\b", "normal_ogretim"),
]
LANGUAGE = [
    (r"\bingilizce\b|\benglish\b", "en"),
    (r"\bturkce\b", "tr"),
    (r"\balmanca\b|\bgerman\b", "de"),
    (r"\bfransizca\b|\bfrench\b", "fr"),
    (r"\barapca\b|\barabic\b", "ar"),
    (r"\brusca\b|\brussian\b", "ru"),
    (r"\bispanyolca\b|\bspanish\b", "es"),
    (r"\bitalyanca\b|\bitalian\b", "it"),
]
DEGREE = [
    (r"\bdoktora\b|\bphd\b|\bph\.d\.?\b", "phd"),
    (r"\(\s*dr\s*\)", "phd"),
    (r"\byuksek\s*lisans\b|\(\s*yl\s*\)|\byl\b|\bmaster\b|\bmsc\b", "yl"),
    (r"\blisans\b|\bbachelor\b|\bbsc\b", "lisans"),
    (r"\bonlisans\b|\bassociate degree\b", "onlisans"),
]
#: All that match count.
EXTRA = [
    (r"\bdisiplinlerarasi\b|\binterdisciplinary\b", "interdisciplinary"),
    (r"\btam\s*burslu\b|\bfull\s*scholarship\b", "full_scholarship"),
    (r"\bucretli\b|\bpaid\b", "paid"),
]
DIMENSIONS = ("thesis", "modality", "language", "degree")


def folded(c: Column) -> Column:
    return without_accents(turkish_lower(c))


def _first(text: Column, rules: list, kind: str) -> Column:
    start = F.when(F.lit(False), F.lit(None).cast(kind))
    return reduce(lambda chain, rule: chain.when(text.rlike(f"(?U){rule[0]}"), F.lit(rule[1])), rules, start)


def qualifiers(c: Column) -> Column:
    """struct of thesis (boolean), modality, language, degree and extra (array, never null for a text)."""
    text = folded(c)
    extra = F.filter(F.array(*(F.when(text.rlike(f"(?U){p}"), F.lit(v)) for p, v in EXTRA)), lambda x: x.isNotNull())
    return F.struct(
        _first(text, THESIS, "boolean").alias("thesis"),
        _first(text, MODALITY, "string").alias("modality"),
        _first(text, LANGUAGE, "string").alias("language"),
        _first(text, DEGREE, "string").alias("degree"),
        extra.alias("extra"),
    )


def conflict(query: Column, candidate: Column) -> Column:
    """Whether a dimension is stated by both, and differently."""
    return reduce(lambda a, b: a | b, (F.coalesce(query[d] != candidate[d], F.lit(False)) for d in DIMENSIONS))


def match_score(query: Column, candidate: Column) -> Column:
    """The share of the query's stated dimensions that the candidate has alike; 0.5 if it states none."""
    stated = reduce(lambda a, b: a + b, (query[d].isNotNull().cast("int") for d in DIMENSIONS))
    alike = reduce(lambda a, b: a + b, (F.coalesce(query[d] == candidate[d], F.lit(False)).cast("int") for d in DIMENSIONS))
    return F.when(stated == 0, F.lit(0.5)).otherwise(alike / stated)
