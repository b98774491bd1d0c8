"""The queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from affilink.llm.op01_jaccard_join import op1_jaccard_join
from affilink.llm.op02_token_planes import op2_token_planes
from affilink.llm.op03_media import op3_media
from affilink.llm.op04_licenses import op4_licenses
from affilink.llm.op05_packing import op5_packing
from affilink.llm.op06_language_id import op6_language_id
from affilink.llm.op07_sentencepiece import op7_sentencepiece
from affilink.llm.op08_token_counts import op8_token_counts
from affilink.llm.op09_topk_search import op9_topk_search
from affilink.llm.op10_quality import op10_quality


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_jaccard_join, op2_token_planes, op3_media, op4_licenses, op5_packing, op6_language_id, op7_sentencepiece, op8_token_counts, op9_topk_search, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {}
