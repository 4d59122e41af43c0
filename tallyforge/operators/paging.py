"""Pages: per group, by keyset, with totals, by search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_per_group(rows: DataFrame, by: list[str], order: list[Column], first: int, skip: int = 0) -> DataFrame:
    """Rows skip + 1 to skip + first of every group, numbered in `rn`; Spark keeps only that many of a group before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rn", n).where(F.col("rn") <= skip + first).where(F.col("rn") > skip)


def after(keys: list[tuple[str, bool]], cursor: list) -> Column:
    """Rows after the cursor in an order of columns, each ascending or not, nulls last in either direction."""
    steps, equal = [], F.lit(True)
    for (name, up), value in zip(keys, cursor, strict=True):
        c = F.col(name)
        if value is not None:  # nothing comes after a null but what the next columns say
            steps.append(equal & (((c > value) if up else (c < value)) | c.isNull()))
        equal = equal & (c.isNull() if value is None else c == value)
    return F.coalesce(reduce(lambda a, b: a | b, steps, F.lit(False)), F.lit(False))


def keyset_page(rows: DataFrame, keys: list[tuple[str, bool]], first: int, cursor: list | None = None) -> DataFrame:
    rows = rows.where(after(keys, cursor)) if cursor else rows
    return rows.orderBy(*[F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in keys]).limit(min(first, 1000))


def page_with_total(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """A page and, on each of its rows, the total."""
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


def search(rows: DataFrame, columns: list[str], text: str, order: list[Column], first: int) -> DataFrame:
    """Rows with the text in any of the columns, in any case."""
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(text.lower())) for c in columns])
    return rows.where(hit).orderBy(*order).limit(first)


def encode_cursor(*columns: str) -> Column:
    return F.base64(F.to_json(F.struct(*columns)).cast("binary"))


def decode_cursor(text: Column, schema: str) -> Column:
    return F.from_json(F.unbase64(text).cast("string"), schema)
