"""Results as JSON. Never built by hand, so escapes are right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object per row; nulls are kept out."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(name))


def snippets(df: DataFrame, context: str, code: str) -> DataFrame:
    """What is pushed for each row, as one JSON object of its context and its code; a null code is an empty one."""
    return df.select(F.to_json(F.struct(F.col(context).alias("context"), F.coalesce(F.col(code), F.lit("")).alias("code"))).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)
