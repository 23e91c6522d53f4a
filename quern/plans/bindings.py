"""Registered queries of the core operators, bound to stand-in tables.

The driver's tables hold no code, so each operator is bound to a table of the same shape: these are
proxies. The operators run as they are; only their input relations are renamed columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import paging as pg
from ..operators import renames as rn
from ..operators import resolve as rv
from ..operators import resources as rs
from ..operators import search as se
from ..operators import structure as st
from ..operators import xrefs as xr
from ..sources.catalog import Catalog, resource_text, with_lowered
from ..sources.results import result_folder
from ..sources.sinks import as_json, snippets
from .engine import Engine
from .tasks import TaskManager

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def bound(name: str, sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_classes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("class_ord"), F.col("p_name").alias("full_name"), F.lower("p_name").alias("full_name_lc"))


def doc_classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, d, "documents")
    name = F.concat_ws(".", "source", F.col("doc_id").cast("string"))
    return docs.select(F.col("doc_id").alias("class_ord"), name.alias("full_name"), F.lower(name).alias("full_name_lc"), name.alias("raw_name")), docs.select(F.col("doc_id").alias("class_ord"), F.col("text").alias("code"))


def nation_classes(spark: SparkSession, d: str) -> DataFrame:
    nation = read(spark, d, "nation")
    return nation.select(F.col("n_nationkey").cast("long").alias("class_ord"), F.concat(F.lit("app."), "n_name").alias("full_name"), F.concat(F.lit("raw/"), "n_name").alias("raw_name"))


def order_methods(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    return orders.select(F.col("o_custkey").alias("class_ord"), F.col("o_orderkey").cast("int").alias("method_ord"), F.col("o_orderpriority").alias("name"), F.lower("o_orderpriority").alias("name_lc"), F.concat("o_orderpriority", F.lit("(I)"), "o_orderstatus").alias("short_id"))


def customer_classes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("class_ord"), F.col("c_name").alias("full_name"), F.concat(F.lit("raw/"), "c_name").alias("raw_name"))


def line_edges(spark: SparkSession, d: str, kind: str) -> DataFrame:
    line = read(spark, d, "lineitem")
    sig = F.concat_ws("/", F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"))
    return line.select(F.lit(kind).alias("target_kind"), F.col("l_partkey").alias("target_class_ord"), F.lit(0).alias("target_member_ord"), F.lit("method").alias("user_kind"), F.concat(F.lit("order"), F.col("l_orderkey").cast("string")).alias("user_class"), sig.alias("user_sig"), F.col("l_orderkey").alias("edge_ord"))


# listing, paging, search -----------------------------------------------------------------------


@bound("class_list_page", "SELECT p_partkey AS class_ord, p_name AS full_name FROM part WHERE contains(lower(p_name), 'widget') ORDER BY p_partkey LIMIT 50 OFFSET 10")
def class_list_page(spark, d):  # R02, R19, R41
    return pg.paginate(se.list_classes(part_classes(spark, d), " Widget "), ["class_ord"], 10, 50).items


@bound("page_meta", "SELECT count(*) AS total, CAST(10 AS BIGINT) AS \"offset\", CAST(50 AS BIGINT) AS \"limit\", greatest(least(60, count(*)) - least(10, count(*)), 0) AS count, least(60, count(*)) < count(*) AS has_more, CASE WHEN least(60, count(*)) < count(*) THEN least(60, count(*)) END AS next_offset FROM part WHERE contains(lower(p_name), 'widget')")
def page_meta(spark, d):  # R41, R48
    return pg.paginate(se.list_classes(part_classes(spark, d), "widget"), ["class_ord"], "10", " 50 ").meta


@bound("package_page", "SELECT s_suppkey AS class_ord, s_name AS full_name FROM supplier WHERE starts_with(s_name, 'Supplier') ORDER BY s_suppkey LIMIT 100 OFFSET 3")
def package_page(spark, d):  # R42
    rows = read(spark, d, "supplier").where(F.col("s_name").startswith("Supplier")).select(F.col("s_suppkey").alias("class_ord"), F.col("s_name").alias("full_name"))
    return pg.package_page(rows, ["class_ord"], 3).items


@bound("top_classes", "SELECT s_suppkey AS class_ord, s_name AS full_name FROM supplier WHERE s_nationkey % 5 <> 0")
def top_classes(spark, d):  # R03
    rows = read(spark, d, "supplier").select(F.col("s_suppkey").alias("class_ord"), F.col("s_name").alias("full_name"), (F.col("s_nationkey") % 5 == 0).alias("is_inner"))
    return Catalog.of(spark, classes=rows).top_classes().select("class_ord", "full_name")


@bound("class_search_name", "SELECT doc_id AS class_ord, source || '.' || doc_id AS full_name FROM documents WHERE contains(lower(source || '.' || doc_id), 'rc1.1')")
def class_search_name(spark, d):  # R21, R23
    classes, text = doc_classes(spark, d)
    return se.search_classes(classes, text, "RC1.1")


@bound("class_search_code", "SELECT doc_id AS class_ord, source || '.' || doc_id AS full_name FROM documents WHERE contains(lower(text), 'gnu general')")
def class_search_code(spark, d):  # R22, R23
    classes, text = doc_classes(spark, d)
    return se.search_classes(classes, text, "GNU General", search_in="code")


@bound("class_search_or", "SELECT doc_id AS class_ord, source || '.' || doc_id AS full_name FROM documents WHERE starts_with(source || '.' || doc_id, 'src1') AND (contains(lower(source || '.' || doc_id), 'license') OR contains(lower(text), 'license')) ORDER BY doc_id LIMIT 50")
def class_search_or(spark, d):  # R24, R25, R41
    classes, text = doc_classes(spark, d)
    return pg.paginate(se.search_classes(classes, text, "License", "src1", "class_name,code"), ["class_ord"], 0, 50).items


@bound("class_search_exempt", "SELECT doc_id AS class_ord, source || '.' || doc_id AS full_name FROM documents WHERE contains(source || '.' || doc_id, '.7')")
def class_search_exempt(spark, d):  # R26: p001 is no package
    classes, text = doc_classes(spark, d)
    return se.search_classes(classes, text, ".7", "p001")


@bound("string_search", "SELECT doc_id AS class_ord, source || '.' || doc_id AS full_name FROM documents WHERE contains(text, 'License')")
def string_search(spark, d):  # R28
    return se.search_string(*doc_classes(spark, d), "License")


@bound("fingerprint", "SELECT source || '.' || doc_id AS class, 'Contains ' || CASE WHEN contains(text, 'Apache License') THEN 'Apache License' WHEN contains(text, 'MIT License') THEN 'MIT License' WHEN contains(text, 'General Public License') THEN 'General Public License' ELSE 'CC BY-NC' END AS hint FROM documents WHERE contains(text, 'Apache License') OR contains(text, 'MIT License') OR contains(text, 'General Public License') OR contains(text, 'CC BY-NC')")
def fingerprint(spark, d):  # R29, R30
    return se.signature_hints(se.scan_signatures(*doc_classes(spark, d), ["Apache License", "MIT License", "General Public License", "CC BY-NC"]))


@bound("method_search", "SELECT o_custkey AS class_ord, CAST(o_orderkey AS INTEGER) AS method_ord, c_name || ' | ' || o_orderpriority || '(I)' || o_orderstatus AS signature FROM customer JOIN orders ON c_custkey = o_custkey WHERE contains(lower(o_orderpriority), 'urgent')")
def method_search(spark, d):  # R27, R36
    return se.search_methods(customer_classes(spark, d), order_methods(spark, d), "Urgent")


@bound("resource_list_page", "SELECT page_id AS res_ord, url AS name FROM pages WHERE contains(lower(url), '/en/') ORDER BY page_id LIMIT 500")
def resource_list_page(spark, d):  # R07, R20
    rows = read(spark, d, "pages").select(F.col("page_id").alias("res_ord"), F.col("url").alias("deobf_name"))
    return pg.paginate(se.list_resources(rows, " /EN/ "), ["res_ord"], 0, 1000).items


# members ---------------------------------------------------------------------------------------


@bound("methods_of_class", "SELECT o_custkey AS class_ord, CAST(o_orderkey AS INTEGER) AS method_ord, o_orderpriority AS name FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def methods_of_class(spark, d):  # R04, R36
    classes = customer_classes(spark, d)
    return Catalog.of(spark, classes=classes, methods=order_methods(spark, d)).methods_of(classes).select("class_ord", "method_ord", "name")


@bound("fields_of_class", "SELECT l_orderkey AS class_ord, l_linenumber AS field_ord, CAST(l_partkey AS VARCHAR) AS name, l_returnflag AS type FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def fields_of_class(spark, d):  # R05
    classes = read(spark, d, "orders").select(F.col("o_orderkey").alias("class_ord"))
    return Catalog.of(spark, classes=classes, fields=line_fields(spark, d)).fields_of(classes)


def line_fields(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("class_ord"), F.col("l_linenumber").alias("field_ord"), F.col("l_partkey").cast("string").alias("name"), F.col("l_returnflag").alias("type"))


@bound("variables_of_method", "SELECT conv_id AS class_ord, CAST(turn AS INTEGER) AS var_ord, role AS name FROM conversations WHERE conv_id = 3")
def variables_of_method(spark, d):  # R06
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("class_ord"), F.lit(0).alias("method_ord"), F.col("turn").cast("int").alias("var_ord"), F.col("role").alias("name"))
    return Catalog.of(spark, classes=rows, variables=rows).variables_of(3, 0).select("class_ord", "var_ord", "name")


@bound("variable_match", "SELECT conv_id AS class_ord, CAST(turn AS INTEGER) AS reg, role AS name FROM conversations WHERE conv_id = 3 AND role = 'user' AND CAST(CAST(turn AS INTEGER) AS VARCHAR) = '0'")
def variable_match(spark, d):  # R59
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("class_ord"), F.lit(0).alias("method_ord"), F.col("turn").cast("int").alias("reg"), F.col("role").alias("name"))
    return rn.matching_variables(rows, 3, 0, "user", reg=0).select("class_ord", "reg", "name")


@bound("class_structure", """
    WITH f AS (SELECT l_orderkey, string_agg(l_returnflag || ' ' || l_partkey, ';' ORDER BY l_linenumber, l_returnflag || ' ' || l_partkey) AS fields FROM lineitem GROUP BY 1),
         m AS (SELECT o_custkey, string_agg(o_orderpriority || '(I)' || o_orderstatus, ';' ORDER BY o_orderkey) AS methods FROM orders GROUP BY 1)
    SELECT o_orderkey AS class_ord, o_orderstatus AS class_name, coalesce(nullif(o_orderpriority, '5-LOW'), 'java.lang.Object') AS super_class,
           CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'I' || o_orderstatus || ';J' END AS implements, coalesce(fields, '') AS fields, coalesce(methods, '') AS methods
    FROM orders o LEFT JOIN f ON o.o_orderkey = l_orderkey LEFT JOIN m ON m.o_custkey = o.o_orderkey
""")
def class_structure(spark, d):  # R31
    interfaces = F.when(F.col("o_orderstatus") != "F", F.array(F.concat(F.lit("I"), "o_orderstatus"), F.lit("J")))
    classes = read(spark, d, "orders").select(F.col("o_orderkey").alias("class_ord"), F.col("o_orderstatus").alias("full_name"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("super_class"), interfaces.alias("interfaces"))
    out = st.class_structure(classes, line_fields(spark, d), order_methods(spark, d))
    return out.select("class_ord", "class_name", "super_class", *[F.array_join(c, ";").alias(c) for c in ("implements", "fields", "methods")])


@bound("class_source", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 OR doc_id % 7 = 0 THEN '/* Decompile failed */' ELSE text END AS source FROM documents")
def class_source(spark, d):  # R09
    code = F.when(F.col("doc_id") % 10 == 0, None).when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("text"))
    return read(spark, d, "documents").select("doc_id", tx.class_source(code).alias("source"))


@bound("method_source", "SELECT conv_id, turn, '// Method: ' || role || chr(10) || chr(10) || CASE WHEN turn % 2 = 1 THEN '/* Method decompile failed */' ELSE text END AS source FROM conversations")
def method_source(spark, d):  # R10
    code = F.when(F.col("turn") % 2 == 1, F.lit("")).otherwise(F.col("text"))
    return read(spark, d, "conversations").select("conv_id", "turn", tx.method_source(F.col("role"), code).alias("source"))


@bound("bytecode_text", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '# missing' ELSE text END AS smali FROM documents")
def bytecode_text(spark, d):  # R11
    smali = F.when(F.col("doc_id") % 8 == 0, None).when(F.col("doc_id") % 4 == 0, F.lit(" \t\n ")).otherwise(F.col("text"))
    return read(spark, d, "documents").select("doc_id", tx.bytecode(smali, "# missing").alias("smali"))


@bound("resource_text", "SELECT page_id, CASE WHEN page_id % 3 = 0 AND page_id % 5 = 0 THEN '// [WARNING] This resource could not be read.' WHEN page_id % 3 = 0 THEN url ELSE html END AS content FROM pages")
def resource_text_chain(spark, d):  # R12
    rows = read(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 != 0, F.col("html")).alias("first"), F.when(F.col("page_id") % 5 != 0, F.col("url")).alias("second"))
    return rows.select("page_id", resource_text("first", "second").alias("content"))


# names and edges -------------------------------------------------------------------------------


@bound("class_lookup", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'app.' ELSE 'raw/' END || n_name AS name, CAST(n_nationkey AS BIGINT) AS class_ord FROM nation")
def class_lookup(spark, d):  # R37
    names = read(spark, d, "nation").select("n_nationkey", F.concat(F.when(F.col("n_nationkey") % 2 == 0, "app.").otherwise("raw/"), "n_name").alias("name"))
    return rv.lookup_classes(names, nation_classes(spark, d))


@bound("resolve_class", "SELECT 'app.' || n_name AS name, CAST(n_nationkey AS BIGINT) AS class_ord, 0 AS rank FROM nation UNION ALL SELECT 'app.' || n_name || '.m(I)V', n_nationkey, 1 FROM nation UNION ALL SELECT 'zz$' || n_name, n_nationkey, 2 FROM nation")
def resolve_class(spark, d):  # R44
    names = read(spark, d, "nation").select(F.explode(F.array(F.concat(F.lit("app."), "n_name"), F.concat(F.lit("app."), "n_name", F.lit(".m(I)V")), F.concat(F.lit("zz$"), "n_name"), F.concat(F.lit("no.such."), F.col("n_nationkey").cast("string")))).alias("name"))
    return rv.resolve_classes(names, nation_classes(spark, d))


@bound("resolve_code", """
    WITH names AS (SELECT c_custkey, c_name, unnest([c_name || '.1-URGENT(I)F', c_name || '.1-URGENT', c_name || '.nope', c_name]) AS name FROM customer),
         m AS (SELECT o_custkey, min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS sig, min(o_orderkey) AS named FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
    SELECT name, c_custkey AS class_ord,
           CAST(coalesce(CASE WHEN name LIKE '%(I)F' THEN sig WHEN name LIKE '%URGENT' THEN named END, -1) AS INTEGER) AS method_ord,
           CASE WHEN name LIKE '%(I)F' AND sig IS NOT NULL THEN 1 WHEN name LIKE '%URGENT' AND named IS NOT NULL THEN 2 ELSE 3 END AS branch
    FROM names LEFT JOIN m ON o_custkey = c_custkey
""")
def resolve_code(spark, d):  # R45
    classes = customer_classes(spark, d)
    names = classes.select(F.explode(F.array(F.concat("full_name", F.lit(".1-URGENT(I)F")), F.concat("full_name", F.lit(".1-URGENT")), F.concat("full_name", F.lit(".nope")), F.col("full_name"))).alias("name"))
    return rv.resolve_code(names, classes, order_methods(spark, d)).fillna(-1, ["method_ord"])  # -1: the whole class


@bound("method_by_descriptor", "SELECT o_custkey AS class_ord, CAST(min(o_orderkey) AS INTEGER) AS method_ord FROM orders WHERE o_orderpriority = '2-HIGH' AND ends_with(o_orderpriority || '(I)' || o_orderstatus, '(I)O') GROUP BY 1")
def method_by_descriptor(spark, d):  # R47
    return rv.method_named(order_methods(spark, d), "2-HIGH", "(I)O")


@bound("field_xrefs", "SELECT 0 AS phase, l_orderkey AS edge_ord, 'order' || l_orderkey || ' | ' || l_linenumber || '/' || l_suppkey AS reference FROM lineitem WHERE l_partkey = 7")
def field_xrefs(spark, d):  # R13, R38
    fields = read(spark, d, "part").select(F.col("p_partkey").alias("class_ord"), F.lit(0).alias("field_ord"), F.lit("f").alias("name"))
    return xr.field_users(fields, line_edges(spark, d, "field"), 7, "f")


@bound("method_xrefs", "SELECT 0 AS phase, l_orderkey AS edge_ord, 'order' || l_orderkey || ' | ' || l_linenumber || '/' || l_suppkey AS reference FROM lineitem WHERE l_partkey = 5")
def method_xrefs(spark, d):  # R13, R39
    methods = read(spark, d, "part").select(F.col("p_partkey").alias("class_ord"), F.explode(F.array(F.lit(0), F.lit(1))).alias("method_ord"), F.lit("use").alias("name"), F.lit("use()V").alias("short_id"))
    return xr.method_users(methods, line_edges(spark, d, "method"), 5, "use")


def region_edges(spark, d):
    first = read(spark, d, "region").agg(F.min_by("r_regionkey", "r_name").alias("r_regionkey"))
    nations = read(spark, d, "nation").join(first, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    customers = read(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    orders = read(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    by_class = customers.select(F.lit("class").alias("target_kind"), F.lit(0).cast("long").alias("target_class_ord"), F.lit("class").alias("user_kind"), F.col("c_name").alias("user_class"), F.lit(None).cast("string").alias("user_sig"), F.col("c_custkey").alias("edge_ord"))
    by_method = orders.select(F.lit("class"), F.lit(0).cast("long"), F.lit("method"), F.col("c_name"), F.col("o_orderkey").cast("string"), F.col("o_orderkey"))
    return by_class.union(by_method)


_REGION_SQL = """
    WITH c AS (SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region)),
         e AS (SELECT 0 AS phase, c_custkey AS edge_ord, c_name AS reference FROM c UNION ALL SELECT 1, o_orderkey, c_name || ' | ' || o_orderkey FROM c JOIN orders ON o_custkey = c_custkey)
"""


@bound("class_xrefs_cap", _REGION_SQL + "SELECT * FROM e ORDER BY phase, edge_ord LIMIT 2000")
def class_xrefs_cap(spark, d):  # R40, R43
    return pg.hard_limit(xr.class_users(region_edges(spark, d), 0), ["phase", "edge_ord"])[0]


@bound("xrefs_overflow", _REGION_SQL + "SELECT least(count(*), 2000) AS total, count(*) > 2000 AS is_overflow FROM e")
def xrefs_overflow(spark, d):  # R43
    return pg.hard_limit(xr.class_users(region_edges(spark, d), 0), ["phase", "edge_ord"])[1]


# resources -------------------------------------------------------------------------------------


@bound("resource_alias", "WITH k AS (SELECT page_id, unnest([url, replace(url, '\\', '/'), lower(replace(url, '\\', '/')), regexp_extract(url, '^[^?]*')]) AS key FROM pages) SELECT key, max(page_id) AS res_ord FROM k GROUP BY key")
def resource_alias(spark, d):  # R46
    rows = read(spark, d, "pages").select(F.col("page_id").alias("res_ord"), F.regexp_extract("url", r"^[^?]*", 0).alias("original_name"), F.col("url").alias("deobf_name"))
    return rs.alias_index(rows)


@bound("resource_by_name", "SELECT html AS content FROM pages WHERE url = (SELECT min(url) FROM pages) ORDER BY page_id DESC LIMIT 1")
def resource_by_name(spark, d):  # R32
    pages = read(spark, d, "pages")
    name = pages.agg(F.min("url").alias("u")).first()["u"]
    rows = pages.select(F.col("page_id").alias("res_ord"), F.col("url").alias("original_name"), F.lit(None).cast("string").alias("deobf_name"), F.col("html").alias("content"))
    return rs.resource_content(rows, rows.select("res_ord", F.lit(0).alias("sub_ord"), F.lit("none").alias("file_name"), "content").limit(0), name)


@bound("packed_subfile", "SELECT role AS file_name, arg_min(text, conv_id * 1000 + turn) AS content FROM conversations WHERE role = 'user' GROUP BY 1")
def packed_subfile(spark, d):  # R08
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("res_ord"), F.col("turn").alias("sub_ord"), F.col("role").alias("file_name"), F.col("text").alias("content"))
    return Catalog.of(spark, classes=rows, resource_subfiles=rows).subfile("user")


#: A manifest for the stand-in application whose classes are nations.
_MANIFEST = """<manifest xmlns:a="x" package = "app.A" a:v="1"><application>
<activity android:name=".Nowhere"><action android:name="android.intent.action.MAIN"/><category android:name="android.intent.category.LAUNCHER"/></activity>
<activity-alias android:name="zz.BRAZIL"/><activity android:name="zz.CHINA"><action android:name="android.intent.action.MAIN"/><category android:name="android.intent.category.LAUNCHER"/></activity>
<activity android:name="app.EGYPT"><action android:name="android.intent.action.MAIN"/><category android:name="android.intent.category.LAUNCHER"/></activity></application></manifest>"""


def _manifest(spark, text: str = _MANIFEST):
    return spark.range(1).select(F.lit(0).cast("long").alias("res_ord"), F.lit(rs.MANIFEST).alias("original_name"), F.lit(None).cast("string").alias("deobf_name"), F.lit(text).alias("content"))


@bound("main_classes", "SELECT 'app.NATION_1' AS package, CAST(n_nationkey AS BIGINT) AS class_ord, 'app.' || n_name AS full_name FROM nation WHERE starts_with('app.' || n_name, 'app.NATION_1')")
def main_classes(spark, d):  # R33, R50; a prefix within a segment counts
    return rs.main_classes(nation_classes(spark, d), _manifest(spark, _MANIFEST.replace("app.A", "app.NATION_1")))


@bound("main_activity", "SELECT 'zz.NATION_3' AS name, CAST(n_nationkey AS BIGINT) AS class_ord, '// MainActivity: zz.NATION_3' || chr(10) || chr(10) || 'class of ' || n_name AS source FROM nation WHERE n_name = 'NATION_3'")
def main_activity(spark, d):  # R34, R51, R52: the first candidate doesn't resolve
    text = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("class_ord"), F.concat(F.lit("class of "), "n_name").alias("code"))
    return rs.main_activity(nation_classes(spark, d), text, _manifest(spark, _MANIFEST.replace("CHINA", "NATION_3").replace("EGYPT", "NATION_4")))


@bound("regex_attr", "SELECT page_id, regexp_extract(html, '<html[^>]+lang\\s*=\\s*\"([^\"]+)\"', 1) AS lang FROM pages")
def regex_attr(spark, d):  # R50 over another tag
    return read(spark, d, "pages").select("page_id", tx.tag_attribute(F.col("html"), "html", "lang").alias("lang"))


@bound("manifest_package", "SELECT p_partkey, p_brand AS strict, p_brand AS loose, '' AS missing FROM part")
def manifest_package(spark, d):  # R50, R50b
    xml = F.concat(F.lit('<manifest a="1" package = "'), "p_brand", F.lit('">'))
    return read(spark, d, "part").select("p_partkey", tx.manifest_package(xml).alias("strict"), tx.manifest_package(F.concat(F.lit('<x my_package="'), "p_brand", F.lit('"'))  , loose=True).alias("loose"), tx.manifest_package(F.col("p_name")).alias("missing"))


@bound("block_extract", """
    WITH b AS (SELECT page_id, unnest(string_split(html, '<a ')) AS block, generate_subscripts(string_split(html, '<a '), 1) - 1 AS pos, regexp_extract(url, '^[a-z]+://[^/]+') AS host FROM pages),
         h AS (SELECT page_id, pos, host, regexp_extract(block, 'href\\s*=\\s*"([^"]+)"', 1) AS href FROM b)
    SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN starts_with(href, '/') THEN host || href ELSE href END AS target FROM h WHERE href <> ''
""")
def block_extract(spark, d):  # R51, R52 over links
    rows = read(spark, d, "pages").select("page_id", F.posexplode(tx.component_blocks(F.col("html"), "<a ")).alias("pos", "block"), F.regexp_extract("url", r"^[a-z]+://[^/]+", 0).alias("host"))
    href = F.regexp_extract("block", r'href\s*=\s*"([^"]+)"', 1)
    return rows.withColumn("href", href).where("href <> ''").select("page_id", "pos", F.when(F.col("href").startswith("/"), F.concat("host", "href")).otherwise(F.col("href")).alias("target"))


@bound("component_name", "SELECT s_suppkey, 'pkg.' || s_name AS dotted, 'pkg.' || s_name AS bare, 'a.' || s_name AS whole FROM supplier")
def component_name(spark, d):  # R52
    pkg = F.lit("pkg")
    return read(spark, d, "supplier").select("s_suppkey", tx.component_name(F.concat(F.lit("."), "s_name"), pkg).alias("dotted"), tx.component_name(F.col("s_name"), pkg).alias("bare"), tx.component_name(F.concat(F.lit("a."), "s_name"), pkg).alias("whole"))


@bound("line_slice", """
    WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
    SELECT doc_id, '// Lines 2-' || least(4, len(l)) || '/' || len(l) || chr(10) || chr(10) || coalesce(array_to_string(list_transform(l[2:4], lambda x: x || chr(10)), ''), '') AS part FROM s
""")
def line_slice(spark, d):  # R49, R53
    return read(spark, d, "documents").select("doc_id", tx.line_slice(F.col("text"), 2, 4).alias("part"))


@bound("truncate", "SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE text END AS text FROM documents")
def truncate(spark, d):  # R54
    return read(spark, d, "documents").select("doc_id", tx.truncated(F.col("text"), 2000, "...").alias("text"))


@bound("lenient_numbers", "SELECT p_partkey, p_size AS plain, -1 AS words, greatest(1, p_size - 25) AS line FROM part")
def lenient_numbers(spark, d):  # R48, R49
    size = F.col("p_size").cast("string")
    return read(spark, d, "part").select("p_partkey", tx.lenient_int(F.concat(F.lit(" "), size, F.lit(" ")), -1).alias("plain"), tx.lenient_int(F.concat(F.lit("x"), size), -1).alias("words"), tx.lenient_line((F.col("p_size") - 25).cast("string"), 1).alias("line"))


@bound("path_parts", "SELECT s_suppkey, true AS is_method, 'm' || s_nationkey AS member, 'a.b.C' AS owner, s_name AS whole FROM supplier")
def path_parts(spark, d):  # R55
    path = F.concat(F.lit("a.b.C.m"), F.col("s_nationkey").cast("string"), F.lit("(Lx.y;)V"))
    return read(spark, d, "supplier").select("s_suppkey", tx.is_method_name(path).alias("is_method"), tx.method_part(path).alias("member"), tx.class_part(path).alias("owner"), tx.class_part(F.col("s_name")).alias("whole"))


# state and sinks -------------------------------------------------------------------------------


def event_log(spark, d):
    return read(spark, d, "events").select(F.col("event_id").alias("seq"), F.lit("class").alias("kind"), F.col("user_id").cast("string").alias("new_name"), F.col("event_type").alias("old_name"))


@bound("mapping_last_wins", "SELECT CAST(user_id AS VARCHAR) AS new_name, arg_max(event_type, event_id) AS old_name, max(event_id) AS seq FROM events GROUP BY 1")
def mapping_last_wins(spark, d):  # R60
    return rn.rename_map(event_log(spark, d), "class")


@bound("rename_apply", "WITH m AS (SELECT user_id, arg_max(event_type, event_id) AS n FROM events GROUP BY 1) SELECT p_partkey, coalesce(n, p_name) AS p_name FROM part LEFT JOIN m ON user_id = p_partkey")
def rename_apply(spark, d):  # R58
    log = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("old_name"), F.col("event_type").alias("new_name"))
    return rn.apply_renames(read(spark, d, "part").select("p_partkey", "p_name"), log, "p_name", F.col("p_partkey").cast("string"))


@bound("rename_event_append", "SELECT count(*) + 1 AS entries, max(event_id) + 1 AS last FROM events")
def rename_event_append(spark, d):  # R18
    log = event_log(spark, d).select("seq", "kind", "new_name", "old_name")
    top = log.agg(F.max("seq").alias("s")).first()["s"]
    event = rn.rename_event(spark, top + 1, "class", "a.B", None, "B", "C").select("seq", "kind", "new_name", "old_name")
    return log.unionByName(event).agg(F.count(F.lit(1)).alias("entries"), F.max("seq").alias("last"))


@bound("task_snapshot", "SELECT user_id AS task_id, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY 1")
def task_snapshot(spark, d):  # the shape of R62's answer over a log of states; task_poll runs the tasks themselves
    return read(spark, d, "events").groupBy(F.col("user_id").alias("task_id")).agg(F.max_by("event_type", "event_id").alias("status"), F.max("event_id").alias("seq"))


@bound("mapping_export", "WITH m AS (SELECT CAST(user_id AS VARCHAR) AS k, arg_max(event_type, event_id) AS v FROM events GROUP BY 1) SELECT string_agg(k || '=' || v, ';' ORDER BY k) AS mapping FROM m")
def mapping_export(spark, d):  # R60
    entries = F.transform(F.map_entries("mapping"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rn.export_mapping(event_log(spark, d)).select(F.array_join(entries, ";").alias("mapping"))


@bound("task_string_search", "SELECT source || '.' || doc_id AS full_name, 'SUCCESS' AS status FROM documents WHERE contains(text, 'License')")
def task_string_search(spark, d):  # R61-R63: the second task is answered from the cache
    engine = Engine(Catalog.of(spark, **dict(zip(("classes", "class_text"), doc_classes(spark, d), strict=True))))
    engine.tasks.wait(engine.search_string("License")["task_id"], 600)
    done = engine.task_status(engine.search_string("License")["task_id"])
    engine.tasks.close()
    return done["result"].table.select("full_name", F.lit(done["status"]).alias("status"))


@bound("json_rows", "SELECT to_json({'n_nationkey': n_nationkey, 'n_name': n_name})::VARCHAR AS json FROM nation")
def json_rows(spark, d):  # R14, R15
    return as_json(read(spark, d, "nation").select("n_nationkey", "n_name"))


@bound("task_poll", "SELECT r_name AS type, 'SUCCESS' AS status, CAST(count(n_nationkey) AS VARCHAR) AS result FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def task_poll(spark, d):  # R61, R62: a task for each region, polled until it has ended, as the table of tasks
    tasks, nation = TaskManager(spark), read(spark, d, "nation")
    regions = read(spark, d, "region").select("r_name", "r_regionkey").collect()  # a task each, as they were asked for
    ids = [tasks.submit(r["r_name"], lambda key=r["r_regionkey"]: nation.where(F.col("n_regionkey") == key).count())["task_id"] for r in regions]
    for task_id in ids:
        tasks.wait(task_id, 600)
    tasks.close()
    return tasks.table().select("type", "status", "result")


@bound("renamed_classes", "SELECT n_nationkey AS class_ord, CASE WHEN n_nationkey % 2 = 0 THEN 'app.N' || n_nationkey ELSE 'app.' || n_name END AS full_name, CASE WHEN n_nationkey % 2 = 0 THEN 'app.n' || n_nationkey ELSE lower('app.' || n_name) END AS full_name_lc FROM nation")
def renamed_classes(spark, d):  # R58: the last of two renames of every other class
    classes = nation_classes(spark, d)
    some = classes.where("class_ord % 2 = 0").select("class_ord", "full_name", F.explode(F.array(F.lit(1), F.lit(2))).alias("turn"))
    new = F.when(F.col("turn") == 1, F.lit("Passing")).otherwise(F.concat(F.lit("N"), F.col("class_ord").cast("string")))
    log = some.select((F.col("class_ord") * 2 + F.col("turn")).alias("seq"), F.lit("class").alias("kind"), F.col("full_name").alias("class_name"), F.lit(None).cast("string").alias("member"), F.lit("x").alias("old_name"), new.alias("new_name"))
    shown = rn.shown_tables({"classes": with_lowered("classes", classes), "renames": log})
    return shown["classes"].select("class_ord", "full_name", "full_name_lc")


@bound("dataset_open", "SELECT c_custkey AS class_ord, c_name AS full_name, lower(c_name) AS full_name_lc FROM customer")
def dataset_open(spark, d):  # R01: a dataset is written, and opened from its folder
    folder = result_folder(spark)
    Catalog.of(spark, classes=customer_classes(spark, d)).write(folder)
    return Catalog.open(spark, folder).classes().select("class_ord", "full_name", "full_name_lc")


#: Parameters as they come in, and what they say.
_PATHS = ("a.b.C.m(Lx.y;)V", "m", "a.B", "(I)V", ".x", "a.b.", "")
_QUERIES = ("a=1&b&a=2&c=%zz&d=x+y&=e", "", "k=%E4%BD%A0&k2=a%3Db", "&&x==y&")


@bound("split_paths", "SELECT * FROM (VALUES ('a.b.C.m(Lx.y;)V', 'a.b.C', 'm', '(Lx.y;)V', false), ('m', NULL, 'm', NULL, false), ('a.B', 'a', 'B', NULL, false), ('(I)V', NULL, '(I)V', NULL, false), ('.x', '', 'x', NULL, false), ('a.b.', 'a.b', '', NULL, false), ('', NULL, '', NULL, true)) t(path, owner, member, descriptor, blank)")
def split_paths(spark, d):  # R35, R56
    return spark.createDataFrame([(p, *tx.split_descriptor(p), tx.is_blank(p)) for p in _PATHS], "path string, owner string, member string, descriptor string, blank boolean")


@bound("query_params", "SELECT * FROM (VALUES (0, 'a', '2'), (0, 'b', ''), (0, 'c', '%zz'), (0, 'd', 'x y'), (0, '', 'e'), (2, 'k', chr(20320)), (2, 'k2', 'a=b'), (3, 'x', '=y')) t(nr, name, value)")
def query_params(spark, d):  # R57
    return spark.createDataFrame([(i, k, v) for i, q in enumerate(_QUERIES) for k, v in tx.query_params(q).items()], "nr int, name string, value string")


@bound("status_and_caches", "SELECT 503 AS without_dataset, 200 AS status, 'RUNNING' AS health, count(*) AS classes, 1 AS moved, '' AS message FROM part")
def status_and_caches(spark, d):  # R63, R64: clearing the caches moves the version, and a search is made anew
    classes = part_classes(spark, d)
    engine = Engine(Catalog.of(spark, classes=classes, class_text=classes.select("class_ord", F.col("full_name").alias("code"))))
    engine.tasks.wait(engine.search_string("a")["task_id"], 600)
    before, n = engine.status(), engine.list_classes().metadata()["total"]
    engine.clear_cache()
    again = engine.tasks.wait(engine.search_string("a")["task_id"], 600)
    after = engine.status()
    engine.tasks.close()
    row = (Engine(None).status()["status"], after["status"], after["health"], n, after["dataset_version"] - before["dataset_version"], again.get("message", ""))
    return spark.createDataFrame([row], "without_dataset int, status int, health string, classes long, moved int, message string")


@bound("edges_of_kind", "SELECT l_partkey AS target_class_ord, count(*) AS users FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1")
def edges_of_kind(spark, d):  # R13
    odd = F.col("l_linenumber") % 2 == 0
    line = read(spark, d, "lineitem").select(F.when(odd, F.lit("method")).otherwise(F.lit("field")).alias("target_kind"), F.col("l_partkey").alias("target_class_ord"))
    return Catalog.of(spark, classes=part_classes(spark, d), use_edges=line).edges("method").groupBy("target_class_ord").agg(F.count(F.lit(1)).alias("users"))


@bound("snippets_to_push", "SELECT to_json({'context': role, 'code': CASE WHEN turn % 2 = 1 THEN '' ELSE 'x' || turn END})::VARCHAR AS json FROM conversations")
def snippets_to_push(spark, d):  # R17
    rows = read(spark, d, "conversations").select("role", F.when(F.col("turn") % 2 != 1, F.concat(F.lit("x"), F.col("turn").cast("string"))).alias("code"))
    return snippets(rows, "role", "code")
