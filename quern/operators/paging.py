"""Pages and hard limits (R41-R43). Order is always by columns that are unique together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.text import parse_int

#: Fixed values.
DEFAULT_SIZE, MAX_SIZE, MAX_OFFSET = 50, 500, 1_000_000
PACKAGE_SIZE = 100
XREF_LIMIT = 2000


@dataclass(frozen=True)
class Page:
    items: DataFrame
    meta: DataFrame

    def metadata(self) -> dict:
        row = self.meta.first().asDict()
        return {k: v for k, v in row.items() if v is not None}


def clamp(offset: object, limit: object) -> tuple[int, int]:
    """The offset within bounds, the limit within its own; not positive or unreadable: the default."""
    size = parse_int(limit, DEFAULT_SIZE)
    return max(0, min(parse_int(offset, 0), MAX_OFFSET)), DEFAULT_SIZE if size <= 0 else min(size, MAX_SIZE)


def paginate(df: DataFrame, order: list[str | Column], offset: object = 0, limit: object = DEFAULT_SIZE) -> Page:
    """One page by order, and a row of total, offset, limit, count, has_more and next_offset (null on the last page)."""
    start, size = clamp(offset, limit)
    return Page(df.orderBy(*order).offset(start).limit(size), page_meta(df, start, size))


def page_meta(df: DataFrame, start: int, size: int) -> DataFrame:
    end = F.least(F.lit(start + size).cast("long"), F.col("total"))
    count = F.greatest(end - F.least(F.lit(start).cast("long"), F.col("total")), F.lit(0).cast("long"))
    more = end < F.col("total")
    return df.agg(F.count(F.lit(1)).alias("total")).select("total", F.lit(start).cast("long").alias("offset"), F.lit(size).cast("long").alias("limit"), count.alias("count"), more.alias("has_more"), F.when(more, end).alias("next_offset"))


def package_page(df: DataFrame, order: list[str | Column], offset: object = 0, limit: object = None) -> Page:
    """Default size 100 and no cap; what isn't a number or is negative is refused; no next_offset."""
    numbers = []
    for name, value, default in (("offset", offset, 0), ("limit", limit, PACKAGE_SIZE)):
        n = default if value is None else parse_int(value, -1)
        if n < 0:
            raise InvalidArgument(f"{name} must be a number of at least 0")
        numbers.append(n)
    start, size = numbers
    return Page(df.orderBy(*order).offset(start).limit(size), page_meta(df, start, size).drop("next_offset", "count"))


def hard_limit(df: DataFrame, order: list[str | Column], limit: int = XREF_LIMIT) -> tuple[DataFrame, DataFrame]:
    """The first `limit` rows, and one row: total (of what is kept) and is_overflow, whether there was one more."""
    seen = df.orderBy(*order).limit(limit + 1)
    facts = seen.agg(F.count(F.lit(1)).alias("n")).select(F.least(F.col("n"), F.lit(limit).cast("long")).alias("total"), (F.col("n") > limit).alias("is_overflow"))
    return df.orderBy(*order).limit(limit), facts
