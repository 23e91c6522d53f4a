from collections import Counter
from decimal import Decimal

import pytest

from quern.plans import bindings

DATA = "/root/testdata/sf0.001"


def rows_of(rows):
    return Counter(tuple(int(v) if isinstance(v, Decimal) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", ["resolve_code", "methods_of_class", "fields_of_class", "class_structure", "task_poll", "renamed_classes", "dataset_open", "split_paths", "query_params", "status_and_caches", "line_slice", "task_string_search", "regex_attr", "edges_of_kind", "snippets_to_push"])
def test_whole_tables_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in ("customer", "orders", "lineitem", "nation", "region", "part", "documents", "pages", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = db.execute(bindings.SQL[name])
    columns = [c[0] for c in want.description]
    got = bindings.QUERIES[name](spark, DATA).select(*columns)
    assert rows_of(got.collect()) == rows_of(want.fetchall())


def test_names_of_all_customers(spark):
    customers = spark.read.parquet(f"{DATA}/customer.parquet").count()
    assert bindings.QUERIES["resolve_code"](spark, DATA).select("class_ord").distinct().count() == customers > 40
