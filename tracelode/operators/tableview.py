"""What a table view does to a dataset: facets, search, sort, pages, time ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filtered(rows: DataFrame, facets: dict[str, str] | None = None, search: str = "", within: list[str] | None = None) -> DataFrame:
    """Rows that equal every facet and hold the search text, whatever its case, in one of the columns."""
    for c, v in (facets or {}).items():
        rows = rows.where(F.col(c) == v) if v else rows
    if search:
        has = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(search.lower())) for c in within or rows.columns]
        rows = rows.where(reduce(lambda a, b: a | b, has))
    return rows


def facet_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).where(F.col(column).isNotNull() & (F.col(column) != "")).distinct().orderBy(column)


def static_filter(rows: DataFrame, category: str = "", file: str = "", search: str = "") -> DataFrame:
    """The printed report's filter: part of the category, the whole file name, text in value or details."""
    if category:
        rows = rows.where(F.contains(F.lower("category"), F.lit(category.lower())))
    if file:
        rows = rows.where(F.col("file") == file)
    return filtered(rows, search=search, within=["value", "details"])


def sort_keys(column: str, descending: bool = False) -> list[Column]:
    """Numbers first by value (a leading number counts), then text by its lower case; nulls as empty text."""
    number = F.regexp_extract(F.col(column).cast("string"), r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double")
    text = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return [number.desc_nulls_first(), text.desc()] if descending else [number.asc_nulls_last(), text.asc()]


def sorted_by(rows: DataFrame, column: str, descending: bool = False, *ties: str) -> DataFrame:
    """Rows in the order of `sort_keys`, ties by further columns."""
    return rows.orderBy(*sort_keys(column, descending), *ties)


def page(rows: DataFrame, number: int, size: int = 50) -> DataFrame:
    """One page of sorted rows, from page 1."""
    return rows.offset((number - 1) * size).limit(size)


RANGES = {"1h": "1 hour", "24h": "24 hours", "7d": "7 days"}


def in_range(rows: DataFrame, column: str, span: str, now) -> DataFrame:
    """Rows of the last hour, day or week before `now`; other spans keep all."""
    return rows.where(F.col(column) >= F.lit(now) - F.expr(f"interval {RANGES[span]}")) if span in RANGES else rows


def inbox(messages: DataFrame, search: str = "") -> DataFrame:
    """Messages that hold the text in subject, sender, recipient or body, the newest first (`sent` where it is known)."""
    return filtered(messages, search=search, within=["subject", "from", "to", "body_plain"]).orderBy(F.desc_nulls_last("sent"), "archive", "message_index")
