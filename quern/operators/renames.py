"""The rename log: append, last-wins map, apply.

In the log, class_name is the full name that the dataset has, and member the short id of a method, the
name of a field, or method:name#method_ord.var_ord of a variable; so an entry keeps its meaning
whatever was renamed before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schema import TABLES

#: Names of a map that is made into one value, at most.
MAX_MAPPING = 100_000


def rename_event(spark: SparkSession, seq: int, kind: str, class_name: str, member: str | None, old_name: str, new_name: str) -> DataFrame:
    """One row of the log. All kinds are logged."""
    return spark.createDataFrame([(seq, kind, class_name, member, old_name, new_name)], TABLES["renames"])


def rename_map(renames: DataFrame, kind: str | None = None) -> DataFrame:
    """new_name, old_name, seq; the last entry of a new name wins. kind="class" is the narrower map of class renames."""
    rows = renames if kind is None else renames.where(F.col("kind") == kind)
    return rows.groupBy("new_name").agg(F.max_by("old_name", "seq").alias("old_name"), F.max("seq").alias("seq"))


def export_mapping(renames: DataFrame, kind: str | None = None, most: int = MAX_MAPPING) -> DataFrame:
    """One row, mapping: the whole map, by new name. A map of more than `most` names is an error: read rename_map() then."""
    some = rename_map(renames, kind).limit(most + 1)  # no more than that comes to the task that makes the row
    entries = F.array_sort(F.collect_list(F.struct("new_name", "old_name")))
    too_many = F.raise_error(F.lit(f"the map has more than {most} names; read it as a table")).cast("array<struct<new_name:string,old_name:string>>")
    return some.agg(F.count(F.lit(1)).alias("n"), entries.alias("e")).select(F.map_from_entries(F.when(F.col("n") > most, too_many).otherwise(F.col("e"))).alias("mapping"))


def apply_renames(df: DataFrame, renames: DataFrame, name_col: str, key: Column | None = None) -> DataFrame:
    """df with each name that was renamed replaced by its latest new name."""
    latest = renames.groupBy(F.col("old_name").alias("_old")).agg(F.max_by("new_name", "seq").alias("_new"))
    return df.join(latest, (F.col(name_col) if key is None else key) == F.col("_old"), "left").withColumn(name_col, F.coalesce("_new", F.col(name_col))).drop("_old", "_new")


def closed_names(renames: DataFrame) -> DataFrame:
    """old_name, new_name with chains followed to their end (a to b, b to c: a to c), however long.

    Each round follows twice as many steps as all before it, so as many rounds as the number of names has
    bits reach the end of every chain. A cycle has no end: its names stay where those rounds leave them.
    """
    step = renames.groupBy("old_name").agg(F.max_by("new_name", "seq").alias("new_name"))
    out = step
    for _ in range(step.count().bit_length()):
        hop = out.select(F.col("old_name").alias("_from"), F.col("new_name").alias("_to"))
        out = out.join(hop, F.col("new_name") == F.col("_from"), "left").select("old_name", F.coalesce("_to", "new_name").alias("new_name"))
    return out


def _latest(renames: DataFrame, kind: str) -> DataFrame:
    return renames.where(F.col("kind") == kind).groupBy("class_name", "member").agg(F.max_by("new_name", "seq").alias("_new"))


def current_name(name: Column, renamed: Column) -> Column:
    """A full class name with each of its parts that is a renamed class (renamed: map of full name to new short name) replaced."""
    parts = F.split(name, r"\.")
    return F.transform(F.array(parts), lambda p: F.array_join(F.transform(p, lambda x, i: F.coalesce(F.try_element_at(renamed, F.array_join(F.slice(p, F.lit(1), i + 1), ".")), x)), "."))[0]


def shown_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a dataset with its rename log applied to names; members keep the name they had as raw.

    Inner classes follow their outer class; names of users in edges and of super classes follow too.
    Source text stays as it was ingested. The log holds what people typed, so class renames travel as
    one map value (MAX_MAPPING names at most).
    """
    log = tables["renames"]
    entries = _latest(log, "class").select("class_name", "_new").limit(MAX_MAPPING + 1).agg(F.map_from_entries(F.collect_list(F.struct("class_name", "_new"))).alias("m"))
    names = F.col("_names")

    def with_names(df: DataFrame) -> DataFrame:
        return df.withColumn("_names", entries.scalar())

    known = tables["classes"].select("class_ord", F.col("full_name").alias("class_name"))

    def members(kind: str) -> DataFrame:
        return _latest(log, kind).join(known, "class_name").select("class_ord", "member", "_new")

    out = dict(tables)
    full = current_name(F.col("full_name"), names)
    columns = {"full_name": full, "full_name_lc": F.lower(full), "super_class": current_name(F.col("super_class"), names), "short_name": F.coalesce(F.try_element_at(names, F.col("full_name")), F.col("short_name")), "interfaces": F.transform("interfaces", lambda x: current_name(x, names))}
    out["classes"] = with_names(tables["classes"]).withColumns({k: v for k, v in columns.items() if k in tables["classes"].columns}).drop("_names")
    if "methods" in tables:
        m = with_names(tables["methods"]).withColumn("member", F.coalesce("short_id", "name")).join(members("method"), ["class_ord", "member"], "left")
        name = F.coalesce("_new", "name")
        owner = current_name(F.regexp_replace("full_name", r"\.[^.]*$", ""), names)
        renewed = {"raw": F.col("name"), "name": name, "name_lc": F.lower(name), "short_id": F.when(F.col("_new").isNotNull() & F.col("short_id").isNotNull(), F.concat("_new", F.regexp_extract("short_id", r"\(.*$", 0))).otherwise(F.col("short_id")), "full_name": F.concat(owner, F.lit("."), name)}
        out["methods"] = m.withColumns(renewed).select(*tables["methods"].columns, "raw")
    if "fields" in tables:
        f = tables["fields"].withColumn("member", F.col("name")).join(members("field"), ["class_ord", "member"], "left")
        out["fields"] = f.withColumns({"raw": F.col("name"), "name": F.coalesce("_new", "name")}).select(*tables["fields"].columns, "raw")
    if "variables" in tables:
        v = members("variable").select("class_ord", F.regexp_extract("member", r"#(\d+)\.\d+$", 1).cast("int").alias("method_ord"), F.regexp_extract("member", r"#\d+\.(\d+)$", 1).cast("int").alias("var_ord"), "_new")
        out["variables"] = tables["variables"].join(v, ["class_ord", "method_ord", "var_ord"], "left").withColumns({"raw": F.col("name"), "name": F.coalesce("_new", "name")}).select(*tables["variables"].columns, "raw")
    if "use_edges" in tables:
        users = _latest(log, "method").select(F.col("class_name").alias("user_class"), F.col("member").alias("user_sig"), "_new")
        e = with_names(tables["use_edges"]).join(users, ["user_class", "user_sig"], "left")
        out["use_edges"] = e.withColumns({"user_class": current_name(F.col("user_class"), names), "user_sig": F.coalesce(F.concat("_new", F.regexp_extract("user_sig", r"\(.*$", 0)), "user_sig")}).select(*tables["use_edges"].columns)
    return out


def known_as(members: DataFrame, name: str) -> DataFrame:
    """Members that had this name before they were renamed go by it again: a renamed member is found by either name."""
    return members.withColumn("name", F.when(F.col("raw") == name, F.lit(name)).otherwise(F.col("name"))) if "raw" in members.columns else members


def matching_variables(variables: DataFrame, class_ord: int, method_ord: int, name: str, reg: object = None, ssa: object = None) -> DataFrame:
    """Variables by name and, if given, register and version, compared as text."""
    ok = (F.col("class_ord") == class_ord) & (F.col("method_ord") == method_ord) & (F.col("name") == name)
    for col, value in (("reg", reg), ("ssa", ssa)):
        if value is not None and str(value).strip():
            ok = ok & (F.col(col).cast("string") == str(value))
    return variables.where(ok)
