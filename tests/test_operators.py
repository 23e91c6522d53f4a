import pytest
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import renames as rn
from quern.operators import resolve as rv
from quern.operators.predicates import in_package, search_locations
from quern.sources import smali
from quern.sources.schema import TABLES
from quern.sources.sinks import as_json
from quern.streaming import events

from .corpus import catalog


def one(spark, col, **values):
    row = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])
    return row.select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "start", "end", "want"),
    [
        ("a\nb\nc", 2, 3, "// Lines 2-3/3\n\nb\nc\n"),
        ("a\r\nb c\n\n\n", 1, 99, "// Lines 1-3/3\n\na\nb\nc\n"),
        ("", 1, 5, "// Lines 1-1/1\n\n\n"),
        ("\n\n", 1, 5, "// Lines 1-0/0\n\n"),
        ("\na", 1, 2, "// Lines 1-2/2\n\n\na\n"),
        ("a\nb", 9, 10, "// Lines 9-2/2\n\n"),
        (None, 1, 2, ""),
    ],
)
def test_line_slice(spark, text, start, end, want):
    assert one(spark, tx.line_slice(F.col("t"), start, end), t=text) == want


def test_truncation_order(spark):
    text = "x" * 199_999 + "\n" + "tail"
    sliced = one(spark, tx.resource_view(F.col("t"), 2, 2), t=text)
    assert sliced.endswith("tail\n")
    compat = one(spark, tx.resource_view(F.col("t"), 2, 2, compat=True), t=text)
    assert "tail" not in compat
    assert one(spark, F.length(tx.truncated(F.col("t"), 200_000, "")), t="y" * 200_001) == 200_000


@pytest.mark.parametrize(("value", "want"), [(None, 7), ("", 7), (" 5 ", 5), ("+5", 5), ("-5", -5), ("5.0", 7), ("x", 7), ("99999999999", 7), (3, 3)])
def test_parse_int(spark, value, want):
    assert tx.parse_int(value, 7) == want
    assert one(spark, tx.lenient_int(F.col("v"), 7), v=value) == want
    assert tx.parse_line(value, 7) == max(1, want)


def test_parameters():
    assert tx.split_descriptor("a.b.C.m(Lx.y;)V") == ("a.b.C", "m", "(Lx.y;)V")
    assert tx.split_descriptor("m") == (None, "m", None)
    assert tx.query_params("a=1&b&a=2&c=%zz&d=x+y&=e") == {"a": "2", "b": "", "c": "%zz", "d": "x y", "": "e"}
    assert tx.is_obfuscated_package("p001") and not tx.is_obfuscated_package("p001\n") and not tx.is_obfuscated_package("p0011")
    assert search_locations(None) == {"name"} and search_locations("my_class_name,xcodex") == {"name", "code"}


def test_strict_prefix(spark):
    assert one(spark, in_package(F.col("n"), "com.app", segments=True), n="com.apple.Pie") is False
    assert one(spark, in_package(F.col("n"), "com.app", segments=True), n="com.app.Main") is True


def test_manifest_functions(spark):
    assert one(spark, tx.manifest_package(F.col("x")), x='<manifest a="b" package="p.q">') == "p.q"
    assert one(spark, tx.manifest_package(F.col("x")), x='<x package="p.q">') == ""
    assert one(spark, tx.manifest_package(F.col("x"), loose=True), x='<x sub_package = "p.q">') == "p.q"


def test_path_parts(spark):
    assert one(spark, tx.method_part(F.col("p")), p="a.B.m(La.b;)V") == "m"
    assert one(spark, tx.class_part(F.col("p")), p="a.B.m(La.b;)V") == "a.B"
    assert one(spark, tx.method_part(F.col("p")), p="plain") is None
    assert one(spark, tx.is_method_name(F.col("p")), p="a.") is False


def test_resolution_ranks(spark):
    c = catalog(spark)
    names = ["com.app.Main", "com.app.Main$Run", " com.app.Main ", "com.app.Main.m(I)V", "q.Util", "Util", "Top", "(I)V", "none", None, ""]
    got = {r["name"]: (r["class_ord"], r["rank"]) for r in rv.resolve_classes(spark.createDataFrame([(n,) for n in names], "name string"), c.classes()).collect()}
    assert got == {"com.app.Main": (0, 0), "com.app.Main$Run": (1, 0), " com.app.Main ": (0, 0), "com.app.Main.m(I)V": (0, 1), "q.Util": (4, 2), "Util": (4, 2), "Top": (8, 0)}


def test_method_by_descriptor_matches_what_cannot_be_read(spark):
    c = catalog(spark)
    assert rv.method_named(c.table("methods"), "run", "(I)V").collect()[0]["class_ord"] == 1
    assert rv.method_named(c.table("methods"), "enc", "(Ljava/lang/String;)V").collect()[0]["method_ord"] == 1


def test_rename_log(spark):
    log = spark.createDataFrame([(1, "class", "a", None, "a", "b"), (2, "class", "b", None, "b", "c"), (3, "field", "x", "f", "f", "g")], TABLES["renames"])
    assert {r["new_name"]: r["old_name"] for r in rn.rename_map(log, "class").collect()} == {"b": "a", "c": "b"}
    assert {r["old_name"]: r["new_name"] for r in rn.closed_names(log).collect()} == {"a": "c", "b": "c", "f": "g"}
    df = spark.createDataFrame([("a",), ("z",)], "n string")
    assert sorted(r["n"] for r in rn.apply_renames(df, log, "n").collect()) == ["b", "z"]


def test_long_chains_and_large_maps(spark):
    chain = spark.createDataFrame([(i, "class", "a", None, f"n{i}", f"n{i + 1}") for i in range(200)], TABLES["renames"])
    assert {r["new_name"] for r in rn.closed_names(chain).collect()} == {"n200"}
    ring = spark.createDataFrame([(i, "class", "a", None, f"n{i}", f"n{(i + 1) % 3}") for i in range(3)], TABLES["renames"])
    assert rn.closed_names(ring).count() == 3
    assert rn.export_mapping(chain, most=200).first()["mapping"]["n7"] == "n6"
    with pytest.raises(Exception, match="more than 199 names"):
        rn.export_mapping(chain, most=199).collect()
    assert rn.export_mapping(chain.limit(0)).first()["mapping"] == {}


def test_text_is_split_once(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(tx.line_slice(F.col("t"), 2, 4).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "regexp_replace" not in plan


def test_blank_resource_names(spark):
    from quern.operators.search import list_resources

    rows = spark.createDataFrame([(0, None, "\t"), (1, None, "\u3000 "), (2, None, None), (3, None, " a")], "res_ord long, original_name string, deobf_name string")
    assert [r["res_ord"] for r in list_resources(rows).collect()] == [3]


SMALI = """.class public LHelloWorld;
.super Ljava/lang/Object;
.implements Lx/Y;
.field private n:Ljava/lang/String; = null
.method public static main([Ljava/lang/String;)V
    .registers 2
    sget-object v0, Ljava/lang/System;->out:Ljava/io/PrintStream;
    const-string v1, "Hello, World"
    invoke-virtual {v0, v1}, Ljava/io/PrintStream;->println(Ljava/lang/String;)V
    return-void
.end method
"""


def test_smali(spark):
    files = spark.createDataFrame([(0, SMALI)], "class_ord bigint, smali string")
    c = smali.parse_classes(files).first()
    assert (c["full_name"], c["raw_name"], c["short_name"], c["is_inner"], c["super_class"], c["interfaces"]) == ("HelloWorld", "HelloWorld", "HelloWorld", False, "java.lang.Object", ["x.Y"])
    m = smali.parse_methods(files).first()
    assert (m["method_ord"], m["name"], m["short_id"], m["full_name"]) == (0, "main", "main([Ljava/lang/String;)V", "HelloWorld.main")
    f = smali.parse_fields(files).first()
    assert (f["name"], f["type"]) == ("n", "java.lang.String")
    refs = [(r["kind"], r["owner"], r["member"]) for r in smali.parse_references(files).orderBy("ref_ord").collect()]
    assert refs == [("field", "java.lang.System", "out"), ("method", "java.io.PrintStream", "println(Ljava/lang/String;)V")]


def test_json_escapes(spark):
    df = spark.createDataFrame([('a"b\\c\n', None)], "x string, y string")
    assert as_json(df).first()["json"] == '{"x":"a\\"b\\\\c\\n"}'


def test_event_stream(spark, tmp_path):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    rn.rename_event(spark, 1, "class", "a.B", None, "B", "C").write.parquet(src)
    for _ in range(2):  # a second run adds nothing
        events.append_log(events.read_events(spark, src), log, str(tmp_path / "ck"), once=True).awaitTermination(60)
    assert spark.read.schema(TABLES["renames"]).parquet(log).count() == 1
    seen = []
    events.push(events.read_events(spark, src), lambda df, n: seen.append((n, df.count())), str(tmp_path / "ck2"), once=True).awaitTermination(60)
    assert seen == [(0, 1)]


def test_plans(spark, tmp_path):
    c = catalog(spark)
    c.write(str(tmp_path))
    from quern.operators.search import list_classes
    from quern.sources.catalog import Catalog

    plan = list_classes(Catalog.open(spark, str(tmp_path)).classes(), "main")._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(full_name_lc,main)" in plan and "raw_name" not in plan
