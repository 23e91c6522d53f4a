"""Assembly text to relations: classes, methods, fields and outgoing references. All with built-ins.

One row of input is one class file. References become use edges once their targets are resolved
within the dataset; they approximate a decompiler's own use lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dotted(descriptor: Column) -> Column:
    """Lcom/app/Main; -> com.app.Main."""
    return F.translate(F.regexp_extract(descriptor, r"^L(.*);$", 1), "/", ".")


def parse_classes(files: DataFrame) -> DataFrame:
    """files (class_ord, smali) -> classes."""
    name = dotted(F.regexp_extract("smali", r"(?m)^\s*\.class[^\n]*?(L[^;\s]+;)", 1))
    parent = dotted(F.regexp_extract("smali", r"(?m)^\s*\.super\s+(L[^;\s]+;)", 1))
    rows = files.select("class_ord", name.alias("raw"), F.when(parent != "", parent).alias("super_class"), F.transform(F.regexp_extract_all("smali", F.lit(r"(?m)^\s*\.implements\s+(L[^;\s]+;)"), F.lit(1)), dotted).alias("interfaces"))
    full = F.translate("raw", "$", ".")
    return rows.select("class_ord", full.alias("full_name"), F.lower(full).alias("full_name_lc"), F.col("raw").alias("raw_name"), F.element_at(F.split(full, r"\."), -1).alias("short_name"), F.col("raw").contains("$").alias("is_inner"), "super_class", "interfaces")


def parse_methods(files: DataFrame) -> DataFrame:
    heads = F.regexp_extract_all("smali", F.lit(r"(?m)^\s*\.method\s+([^\n]*)"), F.lit(1))
    rows = files.select("class_ord", dotted(F.regexp_extract("smali", r"(?m)^\s*\.class[^\n]*?(L[^;\s]+;)", 1)).alias("cls"), F.posexplode(heads).alias("method_ord", "head"))
    short = F.element_at(F.split(F.trim("head"), r"\s+"), -1)
    name = F.substring_index(short, "(", 1)
    return rows.select("class_ord", "method_ord", name.alias("name"), F.lower(name).alias("name_lc"), short.alias("short_id"), F.concat(F.translate("cls", "$", "."), F.lit("."), name).alias("full_name"), F.lit(None).cast("string").alias("code"))


def parse_fields(files: DataFrame) -> DataFrame:
    heads = F.regexp_extract_all("smali", F.lit(r"(?m)^\s*\.field\s+([^\n=]*)"), F.lit(1))
    rows = files.select("class_ord", F.posexplode(heads).alias("field_ord", "head"))
    last = F.element_at(F.split(F.trim("head"), r"\s+"), -1)
    kind = F.substring_index(last, ":", -1)
    return rows.select("class_ord", "field_ord", F.substring_index(last, ":", 1).alias("name"), F.when(kind.startswith("L"), dotted(kind)).otherwise(kind).alias("type"))


def parse_references(files: DataFrame) -> DataFrame:
    """Outgoing references: class_ord, ref_ord, kind, owner, member (a field's name or a method's short id)."""
    found = F.regexp_extract_all("smali", F.lit(r"(L[^;\s]+;->[^\s]+)"), F.lit(1))
    rows = files.select("class_ord", F.posexplode(found).alias("ref_ord", "ref"))
    member = F.substring_index("ref", "->", -1)
    kind = F.when(member.contains("("), "method").otherwise("field")
    return rows.select("class_ord", "ref_ord", kind.alias("kind"), dotted(F.substring_index("ref", "->", 1)).alias("owner"), F.when(kind == "field", F.substring_index(member, ":", 1)).otherwise(member).alias("member"))
