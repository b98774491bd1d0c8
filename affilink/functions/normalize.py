"""Locale-safe normalization of names, as column expressions.

Everything runs in the JVM but NFKC, which Spark lacks: one Arrow UDF, for a column or an array column.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affilink.functions.abbreviations import expanded

#: Characters that read as a space.
INVISIBLE = r"\x{A0}\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{2000}-\x{200A}\x{3000}"
#: Capitals with a lower-case form of their own in Turkish, and letters that show a text is Turkish.
UPPER, LOWER = "İIŞĞÜÖÇ", "iışğüöç"
TURKISH = "çÇğĞıİöÖşŞüÜâÂîÎûÛ"
#: Lower-case letters and what they are without accents.
ACCENTED, PLAIN = "çğıöşüâîû", "cgiosuaiu"
_SPACE = r"(?U)[\s\x1c-\x1f]+"


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfkc_all(lists: pd.Series) -> pd.Series:
    return lists.map(lambda ts: None if ts is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in ts])


def whitespace(c: Column) -> Column:
    """Invisible characters and runs of white space as one space; none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, f"[{INVISIBLE}]", " "), _SPACE, " "))


def turkish_lower(c: Column) -> Column:
    return F.lower(F.translate(c, UPPER, LOWER))


def looks_turkish(c: Column) -> Column:
    return c.rlike(f"[{TURKISH}]")


def lower_by_content(c: Column) -> Column:
    """Turkish rules for texts with a Turkish letter; locale labels aren't trusted."""
    return F.when(looks_turkish(c), turkish_lower(c)).otherwise(F.lower(c))


def without_accents(c: Column) -> Column:
    """Of lower-case text; only the letters of PLAIN change."""
    return F.translate(c, ACCENTED, PLAIN)


def without_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]", " ")


def query_text(c: Column) -> Column:
    """Abbreviations written out, white space cleaned; case and accents stay."""
    return whitespace(expanded(whitespace(nfkc(c))))


def base_of(composed: Column, abbreviations: bool = True) -> Column:
    """The normal form of text that is in NFKC already, accents kept."""
    clean = whitespace(composed)
    return whitespace(without_punctuation(lower_by_content(expanded(clean) if abbreviations else clean)))


def normalized(c: Column, abbreviations: bool = True) -> Column:
    """struct of raw, base and base_no_accent."""
    base = base_of(nfkc(c), abbreviations)
    return F.struct(c.alias("raw"), base.alias("base"), without_accents(base).alias("base_no_accent"))


def name_key(c: Column) -> Column:
    """What names are compared by: the normal form without accents."""
    return without_accents(base_of(nfkc(c)))


def name_keys(c: Column) -> Column:
    """name_key of each element of an array."""
    return F.transform(nfkc_all(c), lambda x: without_accents(base_of(x)))


def tokens(base: Column) -> Column:
    return F.filter(F.split(base, " "), lambda x: x != "")


def legacy_fold(c: Column) -> Column:
    """ASCII letters for Turkish ones, lower case, single spaces; punctuation stays."""
    folded = F.lower(F.translate(c, "İIıĞğÜüŞşÖöÇç", "iiigguussoocc"))
    return F.trim(F.regexp_replace(folded, _SPACE, " "))


def is_true(c: Column) -> Column:
    """Whether a text says true, in any case and amid white space."""
    return F.coalesce(F.lower(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")) == "true", F.lit(False))
