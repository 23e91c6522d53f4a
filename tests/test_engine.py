import time

import pytest

from quern import DatasetUnavailable, InvalidArgument, NotFound
from quern.plans.engine import Engine
from quern.plans.tasks import TaskManager
from quern.sources.catalog import Catalog

from .corpus import catalog


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(catalog(spark))


def names(page):
    return [r["full_name"] for r in page.items.collect()]


def test_no_dataset(spark, tmp_path):
    with pytest.raises(DatasetUnavailable):
        Engine(None).list_classes()
    with pytest.raises(DatasetUnavailable):
        Catalog.open(spark, str(tmp_path))
    assert Engine(None).status()["status"] == 503


def test_round_trip_of_a_dataset(spark, engine, tmp_path):
    engine.catalog.write(str(tmp_path), files=2)
    again = Catalog.open(spark, str(tmp_path))
    assert again.classes().count() == 9 and again.top_classes().count() == 8
    assert "full_name_lc" in again.classes().columns
    assert again.table("tasks").isEmpty()


def test_list_classes_trims_and_ignores_case(engine):
    assert names(engine.list_classes("  UTIL ")) == ["x.Util", "y.Util"]
    meta = engine.list_classes(None, 2, 3).metadata()
    assert meta == {"total": 9, "offset": 2, "limit": 3, "count": 3, "has_more": True, "next_offset": 5}


@pytest.mark.parametrize(("offset", "limit", "want"), [(-1, 0, (0, 50, 9)), ("x", None, (0, 50, 9)), (9, 1, (9, 1, 0)), (1_000_001, 501, (1_000_000, 500, 0)), (0, " 1 ", (0, 1, 1)), ("5.0", -1, (0, 50, 9))])
def test_page_bounds(engine, offset, limit, want):
    meta = engine.list_classes(None, offset, limit).metadata()
    assert (meta["offset"], meta["limit"], meta["count"]) == want
    assert ("next_offset" in meta) == meta["has_more"]


def test_pages_make_up_the_list(engine):
    seen, at = [], 0
    while at is not None:
        page = engine.list_classes(None, at, 2)
        seen += names(page)
        at = page.metadata().get("next_offset")
    assert seen == names(engine.list_classes())


def test_search_classes(engine):
    assert names(engine.search_classes("pie", "com.app")) == ["com.apple.Pie"]  # the prefix ends inside a segment
    assert names(engine.search_classes("a", "p001")) == names(engine.search_classes("a"))  # no package is named p001
    assert names(engine.search_classes("aes", search_in="code")) == ["com.app.Main", "com.app.Main.Run"]
    assert names(engine.search_classes("main", search_in="class_name, code")) == ["com.app.Main", "com.app.Main.Run"]
    assert names(engine.search_classes(" main")) == []  # not trimmed
    assert names(engine.search_classes("util", search_in="nonsense")) == ["x.Util", "y.Util"]
    with pytest.raises(InvalidArgument):
        engine.search_classes(" ")


def test_search_methods(engine):
    got = [r["signature"] for r in engine.search_methods("RUN").items.collect()]
    assert got == ["com.app.Main | Run()V", "com.app.Main.Run | run"]  # a method without a short id shows its name


def test_tasks(engine):
    first = engine.search_string("AES")
    assert first["status"] == "ACCEPTED" and len(first["task_id"]) == 8
    done = engine.tasks.wait(first["task_id"])
    assert done["status"] == "SUCCESS" and done["result"] == ["com.app.Main"]
    again = engine.task_status(engine.search_string("AES")["task_id"])
    assert again["status"] == "SUCCESS" and again["message"] == "Result from cache"
    engine.clear_cache()
    assert "message" not in engine.tasks.wait(engine.search_string("AES")["task_id"])
    scan = engine.tasks.wait(engine.scan_signatures()["task_id"])["result"]
    assert scan == [{"class": "com.app.Main", "hint": "Contains SecretKeySpec"}, {"class": "Top", "hint": "Contains getEncoded"}]  # list order, not text order
    bad = engine.tasks.submit("X", lambda: 1 / 0)
    assert engine.tasks.wait(bad["task_id"])["status"] == "FAILED"
    with pytest.raises(NotFound):
        engine.task_status("nope")
    with pytest.raises(InvalidArgument):
        engine.task_status(" ")
    assert engine.tasks.table().where("status = 'FAILED'").count() == 1


def test_running_task_has_no_result(engine):
    t = engine.tasks.submit("SLEEP", lambda: time.sleep(0.3) or 1)
    assert engine.task_status(t["task_id"])["status"] == "RUNNING"
    assert engine.tasks.wait(t["task_id"])["result"] == 1


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("com.app.Main.enc(Ljava/lang/String;)V", "// Method: com.app.Main.enc\n\nString enc"),
        ("com.app.Main.enc", "// Method: com.app.Main.enc\n\nint enc"),
        ("com.app.Main.Run", "// Method: com.app.Main.Run\n\n/* Method decompile failed */"),  # hides the inner class
        ("com.app.Main$Run", "class Run { aes }"),
        ("com.app.Main.nope", "MessageDigest.x(); SecretKeySpec y; AES"),
        ("com.app.Main.nope(I)V", "MessageDigest.x(); SecretKeySpec y; AES"),
        ("Util", "util"),
        ("z.Null", "/* Decompile failed */"),
        ("z.Empty", "/* Decompile failed */"),
        ("x.Util.help", "// Method: x.Util.help\n\n/* Method decompile failed */"),
    ],
)
def test_code(engine, name, want):
    assert engine.code(name) == want


def test_code_not_found(engine):
    with pytest.raises(NotFound):
        engine.code("no.such.Thing")


def test_bytecode(engine):
    assert engine.bytecode("com.app.Main") == ".class"
    assert engine.bytecode("com.app.Main.Run").startswith("# [WARNING]")


def test_structure(engine):
    row = engine.structure("com.app.Main").first()
    assert row["super_class"] == "android.app.Activity" and row["implements"] == ["java.lang.Runnable"]
    assert row["fields"] == ["java.lang.String key", "n"] and row["methods"] == ["enc(I)V", "enc(Ljava/lang/String;)V", "Run()V"]
    bare = engine.structure("p001.a").first()
    assert bare["super_class"] == "java.lang.Object" and bare["fields"] == [] and bare["implements"] == []


def test_xrefs(engine):
    refs = lambda x: [r["reference"] for r in x[1].items.collect()]
    assert refs(engine.xrefs("com.app.Main")) == ["u.Z", "u.Z", "u.A | a()V", "u.A | a()V"]  # classes first, duplicates stay
    assert refs(engine.xrefs("com.app.Main", method="enc")) == ["u.A | a()V"]  # the first overload
    assert refs(engine.xrefs("com.app.Main", method="enc", short_id="enc(Ljava/lang/String;)V")) == ["u.B | b()V"]
    kind, page, facts = engine.xrefs("com.app.Main", method="enc", field="key")
    assert kind == "field-xrefs" and page.metadata()["total"] == 3 and not facts.first()["is_overflow"]
    for bad in ({"method": "no"}, {"field": "no"}):
        with pytest.raises(NotFound):
            engine.xrefs("com.app.Main", **bad)
    with pytest.raises(NotFound):
        engine.xrefs("nope.Nope")


@pytest.mark.parametrize(("users", "over"), [(0, False), (2000, False), (2001, True)])
def test_xref_limit(spark, users, over):
    _, page, facts = Engine(catalog(spark, users)).xrefs("com.app.Main", field="key")
    row = facts.first()
    assert row["is_overflow"] is over and row["total"] == min(users, 2000) and page.metadata()["total"] == min(users, 2000)


def test_resources(engine):
    assert [r["name"] for r in engine.list_resources(" STRINGS ").items.collect()] == ["res\\values\\Strings.xml"]
    with pytest.raises(NotFound):
        engine.list_resources("nothing like it")
    body = lambda s: s.split("\n\n", 1)[1]
    assert body(engine.resource("res/values/strings.xml")) == "strings\n"
    assert body(engine.resource("res/values/Strings.xml")) == "strings\n"
    with pytest.raises(NotFound):
        engine.resource("RES/VALUES/STRINGS.XML")  # the name asked for isn't lowered
    assert body(engine.resource("shared")) == "second\n"  # the later one wins
    assert body(engine.resource("res/only.xml")) == "early\n"
    for missing in ("blank", "res/none.xml"):
        with pytest.raises(NotFound):
            engine.resource(missing)
    assert engine.resource("AndroidManifest.xml", "2", "2").startswith("// Lines 2-2/4\n\n<application>")


def test_main_classes_and_activity(engine):
    page = engine.main_classes()
    assert names(page) == ["com.app.Main", "com.app.Main.Run", "com.apple.Pie"]
    assert "next_offset" not in page.metadata()
    for bad in ("x", -1):
        with pytest.raises(InvalidArgument):
            engine.main_classes(bad)
    assert engine.main_activity() == "// MainActivity: com.app.Main\n\nMessageDigest.x(); SecretKeySpec y; AES"


def test_main_activity_skips_what_does_not_resolve(spark):
    c = catalog(spark)
    c.tables["classes"] = c.classes().where("class_ord > 1")
    with pytest.raises(NotFound):
        Engine(c).main_activity()


def test_renames(spark):
    e = Engine(catalog(spark))
    e.rename_class("com.app.Main", "Start")
    e.rename_class("x.Util", "Start")
    e.rename_method("com.app.Main.enc(I)V", "encode")
    e.rename_field("com.app.Main", "key", "secret")
    e.rename_variable("com.app.Main", "com.app.Main.enc", "v", "value", reg="2", ssa=1)
    assert e.mapping("class").first()["mapping"] == {"Start": "Util"}
    assert e.mapping().first()["mapping"] == {"Start": "Util", "encode": "enc", "secret": "key", "value": "v"}
    assert [r["seq"] for r in e.catalog.table("renames").orderBy("seq").collect()] == [1, 2, 3, 4, 5]
    for bad in (lambda: e.rename_method("enc", "x"), lambda: e.rename_class("com.app.Main", " ")):
        with pytest.raises(InvalidArgument):
            bad()
    for bad in (lambda: e.rename_method("com.app.Main.no", "x"), lambda: e.rename_field("com.app.Main", "no", "x"), lambda: e.rename_variable("com.app.Main", "com.app.Main.enc", "v", "x", reg=9)):
        with pytest.raises(NotFound):
            bad()


def test_renames_take_effect(spark):
    e = Engine(catalog(spark))
    e.rename_class("com.app.Main", "Start")
    assert names(e.search_classes("start")) == ["com.app.Start", "com.app.Start.Run"]  # the inner class follows
    assert names(e.search_classes("main")) == []
    assert e.code("com.app.Start") == e.code("com.app.Main") == "MessageDigest.x(); SecretKeySpec y; AES"  # the raw name still finds it
    e.rename_class("com.app.Start", "Begin")
    e.rename_class("com.app.Begin.Run", "Go")
    assert names(e.list_classes("com.app."))[:2] == ["com.app.Begin", "com.app.Begin.Go"]
    assert e.structure("com.app.Begin").first()["class_name"] == "com.app.Begin"
    e.rename_method("com.app.Begin.enc(I)V", "encode")
    assert [r["signature"] for r in e.search_methods("encode").items.collect()] == ["com.app.Begin | encode(I)V"]
    assert e.code("com.app.Begin.encode") == "// Method: com.app.Begin.encode\n\nint enc"
    refs = lambda x: [r["reference"] for r in x[1].items.collect()]
    assert refs(e.xrefs("com.app.Begin", method="encode")) == refs(e.xrefs("com.app.Main", method="enc")) == ["u.A | a()V"]
    e.rename_field("com.app.Begin", "key", "secret")
    assert e.structure("com.app.Begin").first()["fields"] == ["java.lang.String secret", "n"]
    assert len(refs(e.xrefs("com.app.Begin", field="secret"))) == len(refs(e.xrefs("com.app.Begin", field="key"))) == 3
    e.rename_variable("com.app.Begin", "com.app.Begin.encode", "v", "value", reg=2)
    e.rename_variable("com.app.Begin", "com.app.Begin.encode", "value", "count", reg=2)
    assert [r["name"] for r in e.shown.variables_of(0, 0).orderBy("var_ord").collect()] == ["v", "count", "w"]
    assert e.catalog.table("variables").where("name = 'v'").count() == 2  # the dataset itself is as it was
    assert e.names("class").count() == 3


def test_names_of_users_follow(spark):
    c = catalog(spark)
    c.tables["classes"] = c.classes().unionByName(spark.createDataFrame([{"class_ord": 20, "full_name": "u.A", "full_name_lc": "u.a", "raw_name": "u.A", "short_name": "A", "is_inner": False, "interfaces": ["x.Util"]}], c.classes().schema))
    c.tables["methods"] = c.table("methods").unionByName(spark.createDataFrame([{"class_ord": 20, "method_ord": 0, "name": "a", "name_lc": "a", "short_id": "a()V", "full_name": "u.A.a"}], c.table("methods").schema))
    e = Engine(c)
    e.rename_class("u.A", "Caller")
    e.rename_method("u.Caller.a", "call")
    e.rename_class("x.Util", "Tool")
    page = e.xrefs("com.app.Main")[1]
    assert [r["reference"] for r in page.items.collect()] == ["u.Z", "u.Z", "u.Caller | call()V", "u.Caller | call()V"]
    assert e.structure("u.Caller").first()["implements"] == ["x.Tool"]


def test_results_stay_on_storage(engine):
    done = engine.tasks.wait(engine.search_string("AES")["task_id"])["result"]
    assert done.table.columns == ["class_ord", "full_name"] and len(done) == 1 and str(done) == done.path


def test_running_tasks_are_never_dropped(spark):
    tasks = TaskManager(spark, workers=1, keep=2)
    slow = tasks.submit("SLOW", lambda: time.sleep(1) or 1)["task_id"]
    for _ in range(5):
        tasks.submit("QUICK", lambda: 2)
    assert tasks.poll(slow)["status"] == "RUNNING"
    assert tasks.wait(slow)["result"] == 1
    tasks.close()


def test_status(engine):
    got = engine.status()
    assert got["status"] == 200 and 0 < got["memory_percent"] <= 100
