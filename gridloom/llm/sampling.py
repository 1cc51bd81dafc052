"""Held-out folds and bounded training samples that depend on doc_id alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(folds: int, fold: int) -> Column:
    """crc32 of doc_id as text, modulo folds, is fold; false where doc_id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def bounded(rows: DataFrame, label: str, most: int) -> DataFrame:
    """About `most` rows of each value of `label` (all, if there are fewer), by a hash of doc_id.

    One pass counts the labels; the sample is a filter, so it never sorts or gathers the table.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0)
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, most / n))])
    return rows.where(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30) < rate[F.col(label)])
