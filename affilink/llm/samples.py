"""Bounded samples of labelled rows for training on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def sampled(rows: DataFrame, label: str, per_label: int) -> list:
    """About per_label rows of each label (all where there are fewer), at most twice as many: those whose id hashes low.

    rows: doc_id, text and the label, none null. The labels' counts come first, from narrow columns, so that the texts of
    the sampled rows alone are read to the driver. A number for each label comes to the driver: a model has a column for each.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return []
    shares = F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_label / n))))
    share = F.element_at(shares, F.col(label))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return sorted(rows.filter(drawn < share).select("doc_id", "text", label).limit(2 * per_label * len(counts)).collect(), key=lambda r: (r[0], r[1]))
