"""Shared plumbing: the shared folder, written tables, skew-safe lookups."""

from __future__ import annotations

import math
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.results import shared_folder

#: A key counts as heavy when it holds at least 1/HEAVY_PARTS of all rows, so at most HEAVY_PARTS keys can be heavy.
HEAVY_PARTS = 1000
#: Fewer rows than this make no key heavy, whatever their share.
HEAVY_LEAST = 256
#: Bytes of a batch of rows that goes to a Python worker, at most (one row may be larger).
BATCH_BYTES = 8 << 20
#: Rows of a file of a small table, about.
FILE_ROWS = 25_000
#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """df.mapInArrow(f, schema), with batches of BATCH_BYTES at most, which is set for the session where its bound is larger: a batch of long texts must not take a worker's memory."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", conf.get(key) or "", re.I)
    if not now or int(now[1]) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(f, schema)


#: Folders of tables that this driver has written into the shared folder and not deleted.
_WRITTEN: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _WRITTEN.append(f"{shared_folder(spark)}/quern/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def written() -> int:
    """How many folders stand in the shared folder; drop_since() takes it."""
    return len(_WRITTEN)


def drop_since(spark: SparkSession, mark: int, but: int = 0) -> None:
    """Deletes the folders written since written() gave mark, but for the last `but` ones: what a finished step leaves behind. Nothing may read them any more."""
    for folder in _WRITTEN[mark : len(_WRITTEN) - but]:
        _delete(spark, folder)


def write_table(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: the lineage ends here, and a lost executor costs no recomputation. rows: about how many there are, where df is a small table that shuffling has spread over many partitions."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df if rows is None else df.coalesce(max(1, math.ceil(rows / FILE_ROWS)))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table that write_table() made and nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/quern/" in folder:
            _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN[:] = [w for w in _WRITTEN if w.rpartition("/")[2] != folder.rpartition("/")[2]]


def release_memory(spark: SparkSession) -> bool:
    """Has the driver's JVM give native memory that it has freed back to the machine; whether it could. Planning and compiling many queries, over hundreds of threads, leaves much of it in the allocator's arenas, which keep it."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array

    def array(kind, *items):
        out = new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    # by the interface: the platform's own class is closed to reflection
    server, strings = jvm.java.lang.Class.forName("javax.management.MBeanServer"), array(jvm.String)
    name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    invoke = next(m for m in server.getMethods() if m.getName() == "invoke")
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.Object, name, "systemTrimNativeHeap", array(jvm.Object), strings))
    except Py4JJavaError:  # a JVM without this command
        return False
    return True


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def heavy_split(table: DataFrame, weight: str, total: int) -> tuple[DataFrame, DataFrame]:
    """The rows of table whose weight is at least total / HEAVY_PARTS and HEAVY_LEAST, and the rest.

    weight counts the probe rows that a row of table will meet, and the weights add up to total at
    most, so the first part has HEAVY_PARTS rows at most: it may be broadcast.
    """
    is_heavy = (F.col(weight) * HEAVY_PARTS >= F.lit(total)) & (F.col(weight) >= HEAVY_LEAST)
    return table.where(is_heavy), table.where(~is_heavy)


def skew_safe_lookup(probe: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Left join of probe with table (unique by keys, no null in them), without a hot key in any task.

    Heavy keys meet a broadcast of HEAVY_PARTS rows at most. The rows they resolve then pass the
    shuffle join with a marker that matches nothing and spreads them evenly.
    """
    value_cols = [c for c in table.columns if c not in keys]
    heavy, light = heavy_split(table, weight, total)
    heavy = heavy.select(*keys, F.struct(*value_cols).alias("_hv"))
    # zero, but not as a constant: the optimiser would take that out of the join's keys, and the heavy keys would meet in one task
    light = light.select(*keys, F.pmod(F.col(weight).cast("int"), F.lit(1)).alias("_mark"), F.struct(*value_cols).alias("_lv"))
    out = probe.join(F.broadcast(heavy), keys, "left")
    rest = [c for c in probe.columns if c not in keys]
    spread = F.xxhash64(*[F.col(c) for c in (rest or keys)])
    out = out.withColumn("_mark", F.when(F.col("_hv").isNull(), F.lit(0)).otherwise((spread % 1000003).cast("int") * 2 + 1))
    out = out.join(light, [*keys, "_mark"], "left")
    got = F.coalesce(F.col("_hv"), F.col("_lv"))
    return out.select(*probe.columns, *[got[c].alias(c) for c in value_cols])


def skew_safe_join(probe: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of probe with table (written, unique by key), without a hot key in any task.

    As skew_safe_lookup(), but rows of heavy keys are told apart by the keys themselves (HEAVY_PARTS
    at most come to the driver), so that rows without a partner don't pass the broadcast join.
    """
    heavy, light = heavy_split(table, weight, total)
    hot = [r[key] for r in heavy.select(key).collect()]
    if not hot:
        return probe.join(table, key)
    is_hot = F.col(key).isin(hot)
    return probe.where(is_hot).join(F.broadcast(heavy), key).unionByName(probe.where(~is_hot).join(light, key))
