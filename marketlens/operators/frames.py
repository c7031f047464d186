"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a single-row table to every row of ``df``.

    ``one_row`` must be a global aggregate (``agg`` without ``groupBy``) or a
    fitted-parameter row, so it has exactly one row: broadcasting it has a
    proven size bound and the join adds columns, never pairs.
    """
    return df.crossJoin(F.broadcast(one_row))
