"""Resources and the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import alias_keys, component_blocks, component_name, is_launcher, manifest_package
from .resolve import resolve_classes

MANIFEST = "AndroidManifest.xml"
RESOURCE_TABLE = "resources.arsc"
COMPONENT = r'android:name\s*=\s*"([^"]+)"'


def alias_index(resources: DataFrame) -> DataFrame:
    """Key -> res_ord; the later resource wins. A resource without any name has no key."""
    keys = resources.select("res_ord", F.explode(alias_keys(F.col("original_name"), F.col("deobf_name"))).alias("key"))
    return keys.groupBy("key").agg(F.max("res_ord").alias("res_ord"))


def resource_content(resources: DataFrame, subfiles: DataFrame, name: str) -> DataFrame:
    """One row, content: of the resource with that key, else of the resource table's first sub-file of that name; blank is no row."""
    index = alias_index(resources)
    own = index.where(F.col("key") == name).join(resources.select("res_ord", "content"), "res_ord").select(F.lit(0).alias("way"), F.struct(F.lit(0).cast("long").alias("r"), F.lit(0).alias("s")).alias("at"), "content")
    table = index.where(F.col("key") == RESOURCE_TABLE).select("res_ord")
    packed = subfiles.where(F.col("file_name") == name).join(table, "res_ord", "left_semi").select(F.lit(1).alias("way"), F.struct(F.col("res_ord").alias("r"), F.col("sub_ord").alias("s")).alias("at"), "content")
    best = own.unionByName(packed).agg(F.min_by("content", F.struct("way", "at")).alias("content"))
    return best.where(F.coalesce(F.regexp_like("content", F.lit(r"\S")), F.lit(False)))


def manifest(resources: DataFrame) -> DataFrame:
    """One row, xml: the first resource with the manifest's original name."""
    return resources.where(F.col("original_name") == MANIFEST).groupBy("original_name").agg(F.min_by("content", "res_ord").alias("xml")).select("xml")


def main_classes(classes: DataFrame, resources: DataFrame) -> DataFrame:
    """R33 without its page: package, class_ord, full_name of the classes that start with the manifest's package."""
    package = manifest(resources).select(manifest_package(F.col("xml")).alias("package")).where("package <> ''")
    # one row at most: an equi-join on a constant would gain nothing over this broadcast
    return classes.join(F.broadcast(package), F.col("full_name").startswith(F.col("package"))).select("package", "class_ord", "full_name")


def launchers(manifests: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Pos, name of each launcher component, in order, with the columns of manifests."""
    package = manifest_package(F.col(xml_col), loose=True)
    blocks = manifests.withColumn("_package", package).select("*", F.posexplode(component_blocks(F.col(xml_col))).alias("pos", "_block"))
    named = blocks.where(is_launcher(F.col("_block"))).withColumn("_name", F.regexp_extract("_block", COMPONENT, 1)).where("_name <> ''")
    return named.withColumn("name", component_name(F.col("_name"), F.col("_package"))).drop("_block", "_name", "_package")


def main_activity(classes: DataFrame, class_text: DataFrame, resources: DataFrame) -> DataFrame:
    """One row: name, class_ord, source of the first launcher that resolves to a class with code; no row without one."""
    found = launchers(manifest(resources)).select("pos", "name")
    resolved = found.join(resolve_classes(found, classes), "name").join(class_text.select("class_ord", "code"), "class_ord").where(F.coalesce(F.regexp_like("code", F.lit(r"\S")), F.lit(False)))
    first = resolved.groupBy(F.lit(1).alias("g")).agg(F.min_by(F.struct("name", "class_ord", "code"), "pos").alias("f"))
    return first.select("f.name", "f.class_ord", F.concat(F.lit("// MainActivity: "), "f.name", F.lit("\n\n"), "f.code").alias("source"))
