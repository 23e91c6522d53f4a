"""Users of a field, method or class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _member_users(edges: DataFrame, kind: str, target: DataFrame, member_ord: str) -> DataFrame:
    """target: class_ord and the member's ordinal."""
    t = target.select(F.col("class_ord").alias("target_class_ord"), F.col(member_ord).alias("target_member_ord"))
    hits = edges.where(F.col("target_kind") == kind).join(t, ["target_class_ord", "target_member_ord"])
    return hits.select(F.lit(0).alias("phase"), "edge_ord", F.concat_ws(" | ", "user_class", "user_sig").alias("reference"))


def field_users(fields: DataFrame, edges: DataFrame, class_ord: int, name: str) -> DataFrame:
    """Phase, edge_ord, reference, for the first field of that name."""
    target = fields.where((F.col("class_ord") == class_ord) & (F.col("name") == name)).groupBy("class_ord").agg(F.min("field_ord").alias("field_ord"))
    return _member_users(edges, "field", target, "field_ord")


def method_users(methods: DataFrame, edges: DataFrame, class_ord: int, name: str, short_id: str | None = None) -> DataFrame:
    """For the first overload of that name, or for the one with the given short id."""
    ok = (F.col("class_ord") == class_ord) & (F.col("name") == name)
    if short_id is not None:
        ok = ok & (F.col("short_id") == short_id)
    target = methods.where(ok).groupBy("class_ord").agg(F.min("method_ord").alias("method_ord"))
    return _member_users(edges, "method", target, "method_ord")


def class_users(edges: DataFrame, class_ord: int) -> DataFrame:
    """Classes first (phase 0), then methods (phase 1); duplicates stay."""
    hits = edges.where((F.col("target_kind") == "class") & (F.col("target_class_ord") == class_ord))
    is_class = F.col("user_kind") == "class"
    text = F.when(is_class, F.col("user_class")).otherwise(F.concat_ws(" | ", "user_class", "user_sig"))
    return hits.select(F.when(is_class, 0).otherwise(1).alias("phase"), "edge_ord", text.alias("reference"))
