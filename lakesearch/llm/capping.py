"""At most so many records per contributor, the best kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.operators.ranking import ranked


def cap_of(n_rows: int, share_percent: int) -> int:
    """`share_percent` of the rows, rounded down, at least 1."""
    return max(1, n_rows * share_percent // 100)


def dropped(df: DataFrame, contributor: Column, order: list[Column], cap: int, columns: list[str]) -> DataFrame:
    """The rows beyond the first `cap` of their contributor in `order` (ascending keys); only `columns` of them.

    All rows are ranked by one global range sort (`ranking.ranked`), so a contributor of any size is spread over
    partitions and nothing is broadcast that grows with the data. Rows of a null contributor are never dropped.
    """
    return ranked(df, contributor, order, columns).where(F.col("_rank") >= cap).select(*columns)
