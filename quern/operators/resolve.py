"""Name resolution for whole batches of names.

Each way to resolve a name is an equi-join; the ways are ranked, and the best that succeeds wins.
Where the list order of an engine with hash maps would be undefined, the smallest class_ord wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(name: Column) -> Column:
    """Without a descriptor, $ as dot, trimmed of characters up to U+0020."""
    plain = F.when(F.instr(name, "(") > 1, F.substring_index(name, "(", 1)).otherwise(name)
    return F.btrim(F.translate(plain, "$", "."), F.lit("".join(map(chr, range(33)))))


def last_segment(name: Column) -> Column:
    """What follows the last dot, unless that dot comes first."""
    return F.regexp_replace(name, r"(?s)^.+\.", "")


def before_last_dot(name: Column) -> Column:
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", ""))


def class_keys(classes: DataFrame) -> DataFrame:
    """kind ("key": full and raw name, "short": last segment), key, class_ord; unaggregated, so that a few names are looked up without shuffling all classes."""
    named = classes.where("full_name is not null")
    own = F.struct(F.lit("key").alias("kind"), F.col("full_name").alias("key"))
    raw = F.struct(F.lit("key").alias("kind"), F.col("raw_name").alias("key"))
    short = F.struct(F.lit("short").alias("kind"), last_segment(F.col("full_name")).alias("key"))
    return named.select("class_ord", F.explode(F.array(own, raw, short)).alias("k")).select("class_ord", "k.kind", "k.key").where("key is not null")


def lookup_classes(names: DataFrame, classes: DataFrame, name_col: str = "name") -> DataFrame:
    """R37 for a batch: names with class_ord, by exact full or raw name; on a collision the later class wins."""
    keys = names.select(F.col(name_col).alias("key")).where("key is not null").distinct()
    found = class_keys(classes).where("kind = 'key'").join(keys, "key").groupBy("key").agg(F.max("class_ord").alias("class_ord"))
    return names.join(found, F.col(name_col) == F.col("key")).select(*names.columns, "class_ord")


def resolve_classes(names: DataFrame, classes: DataFrame, name_col: str = "name") -> DataFrame:
    """R44 for a batch: the distinct names that resolve, class_ord, rank.

    Rank 0: the exact key; 1: the exact key of what stands before the last dot; in both the later
    class wins; 2: the class with the smallest class_ord whose last segment equals the name's.
    """
    keys = names.select(F.col(name_col).alias("_name")).where("_name is not null").distinct().withColumn("_norm", normalised(F.col("_name")))
    way = lambda rank, kind, key: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), key.alias("key"))
    ways = F.array(way(0, "key", F.col("_norm")), way(1, "key", before_last_dot(F.col("_norm"))), way(2, "short", last_segment(F.col("_norm"))))
    asked = keys.select("_name", F.explode(ways).alias("w")).select("_name", "w.rank", "w.kind", "w.key").where("key is not null")
    met = class_keys(classes).join(asked, ["kind", "key"])
    order = F.struct("rank", F.when(F.col("rank") < 2, -F.col("class_ord")).otherwise(F.col("class_ord")).alias("at"))
    best = met.groupBy("_name").agg(F.min(order).alias("b"))
    return best.select(F.col("_name").alias(name_col), F.abs("b.at").alias("class_ord"), "b.rank")


def first_method(methods: DataFrame, condition: Column) -> DataFrame:
    """The first method of each class that meets a condition: class_ord, method_ord."""
    return methods.where(condition).groupBy("class_ord").agg(F.min("method_ord").alias("method_ord"))


def method_named(methods: DataFrame, name: str, descriptor: str | None = None) -> DataFrame:
    """Exact name and, if given, a short id that ends with the descriptor; one that can't be read matches."""
    ok = F.col("name") == name
    if descriptor:
        ok = ok & F.coalesce(F.col("short_id").endswith(descriptor), F.lit(True))
    return first_method(methods, ok)


def resolve_code(names: DataFrame, classes: DataFrame, methods: DataFrame, name_col: str = "name") -> DataFrame:
    """R45 for a batch: name, class_ord, method_ord (null: the whole class), branch (1-3).

    1: with a descriptor, the method of that short id; 2: the first method named as the last
    segment; 3: the class. Each way resolves its class by resolve_classes, so an unknown method of
    a known class gives the class, and a method hides an inner class of its name.
    """
    n = names.select(F.col(name_col).alias("_n")).where("_n is not null").distinct()
    sig = n.where(F.instr("_n", "(") > 0)
    head = F.substring_index("_n", "(", 1)
    cut = F.length(before_last_dot(head))
    sig = sig.select("_n", F.lit(1).alias("branch"), before_last_dot(head).alias("_class"), F.substring("_n", cut + 2, F.length("_n")).alias("_member")).where("length(_class) > 0")
    dot = F.length(before_last_dot(F.col("_n")))
    named = n.where(F.col("_n").contains(".")).select("_n", F.lit(2).alias("branch"), before_last_dot(F.col("_n")).alias("_class"), F.substring("_n", dot + 2, F.length("_n")).alias("_member"))
    whole = n.select("_n", F.lit(3).alias("branch"), F.col("_n").alias("_class"), F.lit(None).cast("string").alias("_member"))
    ways = sig.union(named).union(whole)
    owners = resolve_classes(ways, classes, "_class").select("_class", "class_ord")
    ways = ways.join(owners, "_class")
    members = methods.select("class_ord", "method_ord", F.explode(F.array(F.struct(F.lit(1).alias("branch"), F.col("short_id").alias("_member")), F.struct(F.lit(2).alias("branch"), F.col("name").alias("_member")))).alias("m")).select("class_ord", "method_ord", "m.branch", "m._member")
    found = ways.join(members, ["class_ord", "branch", "_member"], "left").where("branch = 3 or method_ord is not null")
    best = found.groupBy("_n").agg(F.min(F.struct("branch", "class_ord", "method_ord")).alias("b"))
    return best.select(F.col("_n").alias(name_col), "b.class_ord", "b.method_ord", "b.branch")
