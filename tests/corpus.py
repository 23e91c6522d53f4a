"""A small hand-made program that holds every case the operators treat apart."""

from quern.sources.catalog import Catalog
from quern.sources.schema import TABLES

MANIFEST_A = """<manifest xmlns:android="x" package="com.app">
<application><activity android:name=".Gone"><action android:name="android.intent.action.MAIN"/><category android:name="android.intent.category.LAUNCHER"/></activity>
<activity-alias android:name=".Alias"/>
<activity android:name=".Main"><action android:name="android.intent.action.MAIN"/><category android:name="android.intent.category.LAUNCHER"/></activity></application></manifest>"""

CLASSES = [
    (0, "com.app.Main", None, "com.app.Main", "Main", False, "android.app.Activity", ["java.lang.Runnable"]),
    (1, "com.app.Main.Run", None, "com.app.Main$Run", "Run", True, None, None),
    (2, "com.apple.Pie", None, "com.apple.Pie", "Pie", False, None, []),
    (3, "p001.a", None, "p001.a", "a", False, None, None),
    (4, "x.Util", None, "x.Util", "Util", False, None, None),
    (5, "y.Util", None, "y.Util", "Util", False, None, None),
    (6, "z.Null", None, "z.Null", "Null", False, None, None),
    (7, "z.Empty", None, "z.Empty", "Empty", False, None, None),
    (8, "Top", None, "Top", "Top", False, None, None),
]
TEXT = [
    (0, "MessageDigest.x(); SecretKeySpec y; AES", ".class"),
    (1, "class Run { aes }", " \n\t"),
    (2, "pie", None),
    (3, "a code", "x"),
    (4, "util", "x"),
    (5, "Util", "x"),
    (6, None, None),
    (7, "", ""),
    (8, "getEncoded", "x"),
]
METHODS = [
    (0, 0, "enc", None, "enc(I)V", "com.app.Main.enc", "int enc"),
    (0, 1, "enc", None, "enc(Ljava/lang/String;)V", "com.app.Main.enc", "String enc"),
    (0, 2, "Run", None, "Run()V", "com.app.Main.Run", None),
    (1, 0, "run", None, None, "com.app.Main.Run.run", "run"),
    (4, 0, "help", None, "help()V", "x.Util.help", ""),
]
FIELDS = [(0, 0, "key", "java.lang.String"), (0, 1, "n", None), (4, 0, "one", "int")]
VARIABLES = [(0, 0, 0, "v", 1, 0), (0, 0, 1, "v", 2, 1), (0, 0, 2, "w", 1, 1)]
RESOURCES = [
    (0, "AndroidManifest.xml", "AndroidManifest.xml", MANIFEST_A),
    (1, "res/a.xml", "res\\values\\Strings.xml", "strings"),
    (2, "shared", "other", "first"),
    (3, "shared", None, "second"),
    (4, "resources.arsc", "resources.arsc", "table"),
    (5, "blank", " ", "   "),
    (6, None, None, "nameless"),
]
SUBFILES = [(4, 1, "res/only.xml", "late"), (4, 0, "res/only.xml", "early")]


def edges(users: int = 3):
    rows = [("field", 0, 0, "method", f"u.C{i}", f"m{i}()V", i) for i in range(users)]
    rows += [("method", 0, 0, "method", "u.A", "a()V", 10), ("method", 0, 1, "method", "u.B", "b()V", 11)]
    rows += [("class", 0, None, "method", "u.A", "a()V", 0), ("class", 0, None, "class", "u.Z", None, 5), ("class", 0, None, "class", "u.Z", None, 6), ("class", 0, None, "method", "u.A", "a()V", 1)]
    return rows


def catalog(spark, users: int = 3) -> Catalog:
    rows = {"classes": CLASSES, "class_text": TEXT, "methods": METHODS, "fields": FIELDS, "variables": VARIABLES, "resources": RESOURCES, "resource_subfiles": SUBFILES, "use_edges": edges(users)}
    tables = {}
    for name, data in rows.items():
        df = spark.createDataFrame(data, TABLES[name])
        for low in ("full_name_lc", "name_lc"):
            df = df.drop(low)
        tables[name] = df
    return Catalog.of(spark, **tables)
