"""Interval joins on span tables: an equi-join on the document with a range condition.

Both sides are hash-joined on the document (and type), so spans of different documents never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COLUMNS = ("start", "end", "entity_type")


def _other(spans: DataFrame, *more: str) -> DataFrame:
    return spans.select(F.col("doc_id").alias("r_doc"), *[F.col(c).alias(f"r_{c}") for c in (*_COLUMNS, *more)])


def contained_in() -> Column:
    return (F.col("r_start") <= F.col("start")) & (F.col("end") <= F.col("r_end"))


def overlapping(margin: int = 0) -> Column:
    return (F.col("start") < F.col("r_end") + margin) & (F.col("r_start") < F.col("end") + margin)


def near(gap: int) -> Column:
    return F.greatest("start", "r_start") - F.least("end", "r_end") <= gap


def interval_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner", same_type: bool = False) -> DataFrame:
    """`condition` speaks of the left span's start, end and of the right one's r_start, r_end."""
    r = _other(right)
    on = (F.col("doc_id") == F.col("r_doc")) & condition
    return left.join(r, on & (F.col("entity_type") == F.col("r_entity_type")) if same_type else on, how)


def contained_dropped(spans: DataFrame, rank: str = "rank") -> DataFrame:
    """Without spans that an earlier-ranked one of their type contains."""
    r = _other(spans, rank)
    on = (F.col("doc_id") == F.col("r_doc")) & (F.col("entity_type") == F.col("r_entity_type")) & (F.col(f"r_{rank}") < F.col(rank)) & contained_in()
    return spans.join(r, on, "left_anti")
