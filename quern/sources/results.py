"""Results of background work as tables on shared storage, read again where they are wanted."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or the one set on the context. Where neither is, a local master gets a folder of its own and a cluster an error: its machines would not see each other's files."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quern-shared-')}")
        named = context.getCheckpointDir()
    return named.rstrip("/")


def result_folder(spark: SparkSession) -> str:
    """The path of a new folder below the shared one."""
    return f"{shared_folder(spark)}/quern/results-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class TableResult:
    """A written result: path, and how a row of it looks when it is listed. Its rows stay on storage; iterating reads them in order, partition by partition."""

    spark: SparkSession
    path: str
    schema: str
    order: str
    columns: tuple[str, ...]

    @classmethod
    def write(cls, df: DataFrame, order: str) -> TableResult:
        """Keeps df, sorted by the column order, which listed rows don't show."""
        path = result_folder(df.sparkSession)
        df.orderBy(order).write.parquet(path)
        return cls(df.sparkSession, path, df.schema.simpleString().removeprefix("struct<").removesuffix(">"), order, tuple(c for c in df.columns if c != order))

    @property
    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema.replace(":", " ")).parquet(self.path)

    def _listed(self, row: Row) -> object:
        return row[self.columns[0]] if len(self.columns) == 1 else {c: row[c] for c in self.columns}

    def __iter__(self) -> Iterator[object]:
        return map(self._listed, self.table.orderBy(self.order).toLocalIterator())

    def __len__(self) -> int:
        return self.table.count()

    def __eq__(self, other: object) -> bool:
        return (self.path == other.path) if isinstance(other, TableResult) else list(self) == other

    def __hash__(self) -> int:
        return hash(self.path)

    def __str__(self) -> str:
        return self.path
