"""Pages of ordered results. Orders must be total, so that a page is always the same set of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAP = 100


def page_size(size: int, default: int = 10, cap: int | None = None) -> int:
    size = default if size <= 0 else size
    return min(size, cap) if cap else size


def cursor_page(df: DataFrame, order: list[Column], cursor: int = 0, size: int = 10, cap: int | None = None) -> DataFrame:
    """Rows from offset ``cursor``; Spark keeps cursor + size rows for each task, not a full sort."""
    return df.orderBy(*order).offset(max(0, cursor)).limit(page_size(size, cap=cap))


def next_cursor(total: int, cursor: int, size: int = 10, cap: int | None = None) -> int:
    """The cursor of the next page, 0 at the end."""
    end = min(max(0, cursor), total) + page_size(size, cap=cap)
    return end if end < total else 0


def numbered_page(df: DataFrame, order: list[Column], page: int = 1, limit: int = 10) -> DataFrame:
    """Pages are numbered from 1."""
    limit = limit if limit >= 1 else 10
    return df.orderBy(*order).offset((max(1, page) - 1) * limit).limit(limit)


def total_pages(total: int, size: int) -> int:
    return -(-total // page_size(size))


def page_for_each(df: DataFrame, keys: list[str], order: list[Column], page: int = 1, limit: int = 10) -> DataFrame:
    """The same page of every key at once."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = (max(1, page) - 1) * limit
    return df.withColumn("_rank", rank).filter((F.col("_rank") > first) & (F.col("_rank") <= first + limit)).drop("_rank")


def window_below(df: DataFrame, column: str, last: int, limit: int = 30) -> DataFrame:
    """The ``limit`` rows with the largest ``column`` up to ``last``, largest first."""
    return df.filter(F.col(column) <= last).orderBy(F.desc(column)).limit(limit)
