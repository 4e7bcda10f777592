"""Labelled rows and the fold by which learning and holding out are separated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; 0 is held out. A null id is in no fold."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds


def truth(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label 0 or 1): one row per labelled id; null ids and labels are left out, of several labels the larger holds."""
    found = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    return found.where("doc_id is not null and label is not null").groupBy("doc_id").agg((F.max("label") > 0).cast("int").alias("label"))
