"""Datasets: one folder of Parquet tables, or DataFrames given by name. Covers R01-R08 and R13.

Names and text are separate tables, so that name queries never read source text. A table that a
dataset lacks is empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..errors import DatasetUnavailable, InvalidArgument
from .schema import LOWERED, TABLES


@dataclass
class Catalog:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    version: int = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Catalog:
        """The dataset in folder. Raises DatasetUnavailable if it has no classes table."""
        found = {}
        for name, columns in TABLES.items():
            try:
                # a declared schema reads no footer, so the listing is what tells that a table is there
                found[name] = spark.read.schema(columns).parquet(f"{folder}/{name}.parquet")
            except AnalysisException:
                continue
        if "classes" not in found:
            raise DatasetUnavailable(f"no classes in {folder}")
        return cls(spark, found)

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> Catalog:
        if "classes" not in tables:
            raise DatasetUnavailable("no classes")
        return cls(spark, {k: with_lowered(k, v) for k, v in tables.items()})

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise InvalidArgument(f"no table {name}")
        if name not in self.tables:
            return self.spark.createDataFrame([], T.StructType.fromDDL(TABLES[name]))
        return self.tables[name]

    def write(self, folder: str, files: int | None = None) -> None:
        """Writes the tables; class_text by class, so that its uneven sizes spread."""
        for name, df in self.tables.items():
            (df.repartition(files, "class_ord") if files and name == "class_text" else df).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")

    # scans -------------------------------------------------------------------------------------

    def classes(self) -> DataFrame:
        """All classes, inner ones too."""
        return self.table("classes")

    def top_classes(self) -> DataFrame:
        """The narrower list without inner classes."""
        return self.table("classes").where(~F.coalesce("is_inner", F.lit(False)))

    def methods_of(self, classes: DataFrame) -> DataFrame:
        """Members of the given classes by equi-join."""
        return self.table("methods").join(classes.select("class_ord"), "class_ord", "left_semi")

    def fields_of(self, classes: DataFrame) -> DataFrame:
        """R05."""
        return self.table("fields").join(classes.select("class_ord"), "class_ord", "left_semi")

    def variables_of(self, class_ord: int, method_ord: int) -> DataFrame:
        """Local variables of one method. There is nothing to reload, so an empty list is an answer."""
        return self.table("variables").where((F.col("class_ord") == class_ord) & (F.col("method_ord") == method_ord))

    def resources(self) -> DataFrame:
        """R07."""
        return self.table("resources")

    def subfile(self, file_name: str) -> DataFrame:
        """Content of the first packed sub-file with exactly that name, or no row."""
        hits = self.table("resource_subfiles").where(F.col("file_name") == file_name)
        return hits.groupBy("file_name").agg(F.min_by("content", F.struct("res_ord", "sub_ord")).alias("content"))

    def edges(self, kind: str) -> DataFrame:
        """Use edges whose target is a class, method or field."""
        return self.table("use_edges").where(F.col("target_kind") == kind)

    def cached(self, *names: str) -> Catalog:
        """The same dataset with the named tables persisted; clear_cache() drops them."""
        for n in names:
            self.tables[n] = self.table(n).persist()
        return self

    def clear_cache(self) -> int:
        """Drops persisted tables and moves the dataset's version, so that keyed results are not used again."""
        for df in self.tables.values():
            df.unpersist()
        self.version += 1
        return self.version


def with_lowered(name: str, df: DataFrame) -> DataFrame:
    """Adds the lower-cased twins that the schema has and df lacks."""
    for plain, low in LOWERED.get(name, {}).items():
        if low not in df.columns and plain in df.columns:
            df = df.withColumn(low, F.lower(plain))
    return df


def resource_text(*strategies: str) -> Column:
    """The first of several ways to a resource's text that gives one, else a warning as text, not an error."""
    return F.coalesce(*[F.col(c) for c in strategies], F.lit("// [WARNING] This resource could not be read."))
