"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackenspan.llm.common import text_or_empty, train_fold

FOLD, HELD = 3, 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, label of about ``rows`` labelled documents outside the held-out fold.

    An id's label is its largest; null labels and ids teach nothing. The labels that are kept, ``rows``
    at most in expectation, are small enough to broadcast whatever the size of the tables. Of documents that repeat an id
    one takes part, that of the least text hash, so the bound holds.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (train_fold(id_col, FOLD) != HELD)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    n = known.count()
    share = 1 << 32 if n <= rows else int(rows / n * (1 << 32))
    some = known.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 32)) < F.lit(share))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(some), "id")
    return rows.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text", F.lit(19)), "text")).alias("text"), F.first("label").alias("label")).select("id", "text", "label")
