"""One nested record per class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_list(order: str, text: Column) -> Column:
    """Aggregate: texts by order, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"])


def class_structure(classes: DataFrame, fields: DataFrame, methods: DataFrame) -> DataFrame:
    """class_ord, class_name, super_class, implements, fields ("type name"), methods (short ids, else names)."""
    f = fields.groupBy("class_ord").agg(ordered_list("field_ord", F.when(F.col("type").isNull(), F.col("name")).otherwise(F.concat_ws(" ", "type", "name"))).alias("fields"))
    m = methods.groupBy("class_ord").agg(ordered_list("method_ord", F.coalesce("short_id", "name")).alias("methods"))
    none = F.array().cast("array<string>")
    out = classes.join(f, "class_ord", "left").join(m, "class_ord", "left")
    return out.select("class_ord", F.col("full_name").alias("class_name"), F.coalesce("super_class", F.lit("java.lang.Object")).alias("super_class"), F.coalesce("interfaces", none).alias("implements"), F.coalesce("fields", none).alias("fields"), F.coalesce("methods", none).alias("methods"))
