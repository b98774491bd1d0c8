"""Known abbreviations of organisation names, written out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pattern and expansion, applied in this order, whatever the case; letters also without their accents.
ABBREVIATIONS = [
    (r"\bSOS\.?\s*B[İI]L\.", "SOSYAL BİLİMLERİ"),
    (r"\bFEN\s+B[İI]L\.", "FEN BİLİMLERİ"),
    (r"\bSA[ĞG]LIK\s+B[İI]L\.", "SAĞLIK BİLİMLERİ"),
    (r"\bM\.?Y\.?O\.?\b", "MESLEK YÜKSEKOKULU"),
    (r"\bMYO\.?\b", "MESLEK YÜKSEKOKULU"),
    (r"\bA\.?B\.?D\.", "ANABİLİM DALI"),
    (r"\bABD\.", "ANABİLİM DALI"),
    (r"\bY\.?O\.?\b", "YÜKSEKOKULU"),
    (r"\bYO\.?\b", "YÜKSEKOKULU"),
    (r"\bY[ÜU]K\.?\s*OKL\.?\b", "YÜKSEKOKULU"),
    (r"\bPR\.", "PROGRAMI"),
    (r"\bPRG\.", "PROGRAMI"),
    (r"\b[ÜU]N[İI]V?\.?\b", "ÜNİVERSİTESİ"),
    (r"\b[ÜU]NV\.?\b", "ÜNİVERSİTESİ"),
    (r"\b[ÜU]N\.\b", "ÜNİVERSİTESİ"),
    (r"\bFAK\.?\b", "FAKÜLTESİ"),
    (r"\bENST?\.?\b", "ENSTİTÜSÜ"),
    (r"\bB[ÖO]L\.?\b", "BÖLÜMÜ"),
    (r"\bM[ÜU]H\.?\b", "MÜHENDİSLİĞİ"),
    (r"\bMRKS?\.?\b", "MERKEZİ"),
    (r"\bAR[ŞS]T?\.?\b", "ARAŞTIRMA"),
    (r"\bUYG\.?\b", "UYGULAMA"),
    (r"\bE[ĞG]T\.?\b", "EĞİTİMİ"),
    (r"\bY[ÖO]N\.?\b", "YÖNETİMİ"),
    (r"\bHAST\.?\b", "HASTANESİ"),
    (r"\bFAC\.?\b", "FACULTY"),
    (r"\bDEPT\.?\b", "DEPARTMENT"),
    (r"\bINST\.?\b", "INSTITUTE"),
    (r"\bENG\.?\b", "ENGINEERING"),
]


def expanded(c: Column) -> Column:
    return reduce(lambda text, rule: F.regexp_replace(text, f"(?iU){rule[0]}", rule[1]), ABBREVIATIONS, c)
