"""The facade: parameters are checked here, errors raised here, and everything else is a DataFrame."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DatasetUnavailable, InvalidArgument, NotFound
from ..functions.text import bytecode, class_source, is_blank, method_source, parse_line, resource_view, split_descriptor
from ..operators import renames as rn
from ..operators import resources as rs
from ..operators import search as se
from ..operators import xrefs as xr
from ..operators.paging import XREF_LIMIT, Page, hard_limit, package_page, paginate
from ..operators.resolve import method_named, resolve_classes, resolve_code
from ..operators.structure import class_structure
from ..sources.catalog import Catalog
from ..sources.results import TableResult, result_folder
from ..sources.schema import TABLES
from .tasks import TaskManager

#: The last line when no end is given: every line there is.
DEFAULT_LAST_LINE = 2_000_000_000


def _need(**params: str | None) -> None:
    for name, value in params.items():
        if is_blank(value):
            raise InvalidArgument(f"{name} is missing")


class Engine:
    def __init__(self, catalog: Catalog | None) -> None:
        self._catalog = catalog
        self._view: Catalog | None = None
        self._log_folder: str | None = None
        self._seq = 0
        self.started = time.time()
        self.tasks = TaskManager(catalog.spark) if catalog else None

    @property
    def catalog(self) -> Catalog:
        """The dataset as it was opened, with the log of renames."""
        if self._catalog is None:
            raise DatasetUnavailable("no dataset is open")
        return self._catalog

    @property
    def shown(self) -> Catalog:
        """The dataset under its current names: what every question is answered from."""
        c = self.catalog
        if self._view is None or self._view.version != c.version:
            renamed = "renames" in c.tables and not c.tables["renames"].isEmpty()
            self._view = Catalog(c.spark, rn.shown_tables(c.tables) if renamed else dict(c.tables), c.version)
        return self._view

    # code --------------------------------------------------------------------------------------

    def list_classes(self, keyword: str | None = None, offset: object = 0, limit: object = None) -> Page:
        return paginate(se.list_classes(self.shown.classes(), keyword), ["class_ord"], offset, limit)

    def _class(self, name: str) -> int:
        c = self.shown
        names = c.spark.range(1).select(F.lit(name).alias("name"))
        row = resolve_classes(names, c.classes()).first()
        if row is None:
            raise NotFound(f"class not found: {name}")
        return row["class_ord"]

    def code(self, name: str) -> str:
        """Source of a class or a method."""
        _need(code_name=name)
        c = self.shown
        found = resolve_code(c.spark.range(1).select(F.lit(name).alias("name")), c.classes(), c.table("methods"))
        m = c.table("methods").select("class_ord", "method_ord", method_source(F.col("full_name"), F.col("code")).alias("method"))
        t = c.table("class_text").select("class_ord", F.col("code").alias("text"))
        row = found.join(m, ["class_ord", "method_ord"], "left").join(t, "class_ord", "left").select(F.when(F.col("branch") < 3, F.col("method")).otherwise(class_source(F.col("text"))).alias("source")).first()
        if row is None:
            raise NotFound(f"target not found: {name}")
        return row["source"]

    def bytecode(self, class_name: str) -> str:
        """R11."""
        _need(class_name=class_name)
        row = self.shown.table("class_text").where(F.col("class_ord") == self._class(class_name)).select(bytecode(F.col("smali")).alias("s")).first()
        return row["s"] if row else bytecode_missing()

    def structure(self, class_name: str) -> DataFrame:
        _need(class_name=class_name)
        one = self.shown.classes().where(F.col("class_ord") == self._class(class_name))
        return class_structure(one, self.shown.fields_of(one), self.shown.methods_of(one))

    # search ------------------------------------------------------------------------------------

    def search_classes(self, class_name: str, package: str | None = None, search_in: str | None = None, offset: object = 0, limit: object = None) -> Page:
        _need(class_name=class_name)
        c = self.shown
        return paginate(se.search_classes(c.classes(), c.table("class_text"), class_name, package, search_in), ["class_ord"], offset, limit)

    def search_methods(self, method_name: str, offset: object = 0, limit: object = None) -> Page:
        _need(method_name=method_name)
        c = self.shown
        return paginate(se.search_methods(c.classes(), c.table("methods"), method_name), ["class_ord", "method_ord"], offset, limit)

    def search_string(self, query: str) -> dict:
        """A background task whose result is the table of class names, listed by class."""
        _need(query=query)
        c = self.shown
        return self.tasks.submit("STRING_SEARCH", lambda: TableResult.write(se.search_string(c.classes(), c.table("class_text"), query), "class_ord"), (c.version, "string", query))

    def scan_signatures(self) -> dict:
        c = self.shown
        return self.tasks.submit("CRYPTO_SCAN", lambda: TableResult.write(se.scan_signatures(c.classes(), c.table("class_text")).select("class_ord", "class", "hint"), "class_ord"))

    def task_status(self, task_id: str | None) -> dict:
        return self.tasks.poll(task_id)

    def xrefs(self, class_name: str, method: str | None = None, field: str | None = None, offset: object = 0, limit: object = None, short_id: str | None = None) -> tuple[str, Page, DataFrame]:
        """Type, page and overflow facts. A field goes before a method, a method before the class."""
        _need(**{"class": class_name})
        c, target = self.shown, self._class(class_name)
        edges = c.table("use_edges")
        if not is_blank(field):
            fields = rn.known_as(c.table("fields"), field)
            if fields.where((F.col("class_ord") == target) & (F.col("name") == field)).isEmpty():
                raise NotFound(f"field not found: {field}")
            kind, users = "field-xrefs", xr.field_users(fields, edges, target, field)
        elif not is_blank(method):
            methods = rn.known_as(c.table("methods"), method)
            if methods.where((F.col("class_ord") == target) & (F.col("name") == method)).isEmpty():
                raise NotFound(f"method not found: {method}")
            kind, users = "method-xrefs", xr.method_users(methods, edges, target, method, short_id)
        else:
            kind, users = "class-xrefs", xr.class_users(edges, target)
        kept, facts = hard_limit(users, ["phase", "edge_ord"])
        facts = facts.withColumn("warning", F.when(F.col("is_overflow"), F.lit(f"Result truncated to {XREF_LIMIT} entries.")))
        return kind, paginate(kept, ["phase", "edge_ord"], offset, limit), facts

    # resources ---------------------------------------------------------------------------------

    def list_resources(self, keyword: str | None = None, offset: object = 0, limit: object = None) -> Page:
        found = se.list_resources(self.shown.resources(), keyword)
        if found.isEmpty():
            raise NotFound("no resource matches")
        return paginate(found, ["res_ord"], offset, limit)

    def resource(self, file_name: str, start_line: object = None, end_line: object = None, compat: bool = False) -> str:
        """R32, R53, R54."""
        _need(file_name=file_name)
        c = self.shown
        view = resource_view(F.col("content"), parse_line(start_line, 1), parse_line(end_line, DEFAULT_LAST_LINE), compat=compat)
        row = rs.resource_content(c.resources(), c.table("resource_subfiles"), file_name).select(view.alias("v")).first()
        if row is None:
            raise NotFound(f"resource not found: {file_name}")
        return row["v"]

    def main_classes(self, offset: object = None, limit: object = None) -> Page:
        c = self.shown
        if rs.manifest(c.resources()).isEmpty():
            raise NotFound("no manifest")
        return package_page(rs.main_classes(c.classes(), c.resources()), ["class_ord"], offset, limit)

    def main_activity(self) -> str:
        c = self.shown
        row = rs.main_activity(c.classes(), c.table("class_text"), c.resources()).first()
        if row is None:
            raise NotFound("no launcher activity with a class and code")
        return row["source"]

    # renames and state -------------------------------------------------------------------------

    def _log(self, kind: str, class_ord: int, member: str | None, old: str, new: str) -> DataFrame:
        """Appends one entry to the log's folder; from the first entry on, the log is that folder."""
        c = self.catalog
        if self._log_folder is None:
            log = c.table("renames")
            self._seq = log.agg(F.max("seq").alias("s")).first()["s"] or 0
            self._log_folder = result_folder(c.spark)
            log.write.parquet(self._log_folder)
        self._seq += 1
        class_name = c.classes().where(F.col("class_ord") == class_ord).select("full_name").first()["full_name"]
        event = rn.rename_event(c.spark, self._seq, kind, class_name, member, old, new)
        event.coalesce(1).write.mode("append").parquet(self._log_folder)
        c.tables["renames"] = c.spark.read.schema(TABLES["renames"]).parquet(self._log_folder)
        self.clear_cache()
        return event

    def rename_class(self, class_name: str, new_name: str) -> DataFrame:
        _need(class_name=class_name, new_name=new_name)
        target = self._class(class_name)
        row = self.shown.classes().where(F.col("class_ord") == target).select("short_name").first()
        return self._log("class", target, None, row["short_name"], new_name)

    def _method(self, target: int, member: str, descriptor: str | None, shown_as: str):
        methods = rn.known_as(self.shown.table("methods").where(F.col("class_ord") == target), member)
        found = method_named(methods, member, descriptor).first()
        if found is None:
            raise NotFound(f"method not found: {shown_as}")
        own = self.catalog.table("methods").where((F.col("class_ord") == target) & (F.col("method_ord") == found["method_ord"]))
        return own.select("method_ord", F.coalesce("short_id", "name").alias("member")).first()

    def rename_method(self, method_name: str, new_name: str) -> DataFrame:
        _need(method_name=method_name, new_name=new_name)
        owner, member, descriptor = split_descriptor(method_name)
        if owner is None:
            raise InvalidArgument("method_name must be fully qualified")
        target = self._class(owner)
        return self._log("method", target, self._method(target, member, descriptor, method_name)["member"], member, new_name)

    def rename_field(self, class_name: str, field_name: str, new_name: str) -> DataFrame:
        _need(class_name=class_name, field_name=field_name, new_name=new_name)
        target = self._class(class_name)
        fields = rn.known_as(self.shown.table("fields"), field_name).where((F.col("class_ord") == target) & (F.col("name") == field_name))
        first = fields.agg(F.min("field_ord").alias("o")).first()["o"]
        if first is None:
            raise NotFound(f"field not found: {field_name}")
        own = self.catalog.table("fields").where((F.col("class_ord") == target) & (F.col("field_ord") == first)).select("name").first()["name"]
        return self._log("field", target, own, field_name, new_name)

    def rename_variable(self, class_name: str, method_name: str, variable_name: str, new_name: str, reg: object = None, ssa: object = None) -> DataFrame:
        _need(class_name=class_name, method_name=method_name, variable_name=variable_name, new_name=new_name)
        _, member, descriptor = split_descriptor(method_name)
        target = self._class(class_name)
        method = self._method(target, member, descriptor, method_name)
        variables = rn.known_as(self.shown.table("variables"), variable_name)
        found = rn.matching_variables(variables, target, method["method_ord"], variable_name, reg, ssa).agg(F.min("var_ord").alias("o")).first()["o"]
        if found is None:
            raise NotFound(f"variable not found: {variable_name}")
        own = self.catalog.variables_of(target, method["method_ord"]).where(F.col("var_ord") == found).select("name").first()["name"]
        return self._log("variable", target, f"{method['member']}:{own}#{method['method_ord']}.{found}", variable_name, new_name)

    def mapping(self, kind: str | None = None) -> DataFrame:
        """The map in one row; names() is the same as a table, of any size."""
        return rn.export_mapping(self.catalog.table("renames"), kind)

    def names(self, kind: str | None = None) -> DataFrame:
        return rn.rename_map(self.catalog.table("renames"), kind)

    def clear_cache(self) -> int:
        """Persisted tables and keyed results go."""
        self.tasks.forget()
        return self.catalog.clear_cache()

    def status(self) -> dict:
        """Ready unless there is no dataset; memory of the driver's JVM."""
        if self._catalog is None:
            return {"status": 503, "health": "NOT_READY", "uptime_ms": int(1000 * (time.time() - self.started))}
        run = self._catalog.spark._jvm.java.lang.Runtime.getRuntime()
        used = (run.totalMemory() - run.freeMemory()) // 2**20
        most = run.maxMemory() // 2**20
        return {"status": 200, "health": "RUNNING", "uptime_ms": int(1000 * (time.time() - self.started)), "memory_used_mb": used, "memory_max_mb": most, "memory_percent": round(100.0 * used / max(1, most), 2), "dataset_version": self._catalog.version, "spark": self._catalog.spark.version}


def bytecode_missing() -> str:
    from ..functions.text import NO_BYTECODE

    return NO_BYTECODE
