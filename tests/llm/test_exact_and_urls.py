import dataclasses
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quern.llm.common import skew_safe_join, skew_safe_lookup
from quern.llm.exact_dedup import build_index, dedup_rows, digest, directory, exact_dedup, lookup, text_hash
from quern.llm.url_filter import bloom_words, judge_urls, might_contain, rules_table

from .helpers import awkward, corpus, documents


def plain(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        g = groups[t or ""]
        out.append((i, max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("rows", [awkward(), corpus(), [(i, "same") for i in range(500)]])
def test_exact_against_plain(spark, rows):
    got = exact_dedup(documents(spark, rows, extra=True), bucket_rows=16)
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == plain(rows)


def test_exact_of_null_ids_and_empty_tables(spark):
    got = exact_dedup(documents(spark, [(None, "a"), (None, "a"), (3, "b"), (None, "b")])).collect()
    assert sorted((r["group_size"], r["keep_id"] or 0, r["kept"]) for r in got) == [(2, 0, True), (2, 0, True), (2, 3, False), (2, 3, True)]
    assert exact_dedup(documents(spark, [])).count() == 0
    assert dedup_rows(documents(spark, [])).count() == 0


def test_dedup_rows_keeps_one_with_all_columns(spark):
    docs = documents(spark, awkward(), extra=True)
    kept = dedup_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14]  # 1, 2 and 12 are empty; 6 stands twice


@pytest.mark.parametrize(("rows", "bits"), [(awkward(), 1), (corpus(), 5)])
def test_chains_of_equal_hashes(spark, rows, bits):
    docs = documents(spark, rows, extra=True)
    got = exact_dedup(docs, bucket_rows=4, hash_bits=bits)
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == plain(rows)
    assert sorted(r["doc_id"] for r in dedup_rows(docs, bucket_rows=4, hash_bits=bits).collect()) == sorted({i: 0 for i, *_, kept, _ in plain(rows) if kept})
    entries = build_index(docs, bucket_rows=4, hash_bits=bits).entries.collect()
    texts = {t or "" for _, t, *_ in rows}
    assert len(entries) == len(texts)
    chains = {}
    for e in entries:
        chains.setdefault(e["h"], []).append(e["chain"])
    assert len(chains) <= 2**bits and all(sorted(c) == list(range(len(c))) for c in chains.values())
    assert bits > 5 or max(map(len, chains.values())) > 1


def test_lookups_go_through_the_directory(spark):
    rows = corpus()
    docs = documents(spark, rows)
    index = build_index(docs, bucket_rows=8)
    probe = docs.select("doc_id", text_hash(docs["text"]).alias("h"), digest(docs["text"]).alias("text_sha256"))
    assert lookup(probe, index).where("keep_id is null").count() == 0
    gone = index.directory.orderBy("slot").first()["slot"]
    torn = dataclasses.replace(index, directory=index.directory.where(F.col("slot") != gone))
    lost = lookup(probe, torn).where("keep_id is null").select("h").collect()
    assert lost and {(r["h"] % 2**64) >> (64 - index.depth) for r in lost} == {gone}
    moved = dataclasses.replace(index, directory=index.directory.withColumn("bucket", F.col("bucket") + 1))
    assert lookup(probe, moved).where("keep_id is not null").count() == 0
    strange = documents(spark, [(1, "not in the index")])
    found = lookup(strange.select("doc_id", text_hash(strange["text"]).alias("h"), digest(strange["text"]).alias("text_sha256")), index)
    assert found.first()["keep_id"] is None


def test_deep_directories_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr("quern.llm.exact_dedup.BROADCAST_SLOTS", 2)
    rows = corpus() + [(5000 + i, "hot") for i in range(200)]
    got = exact_dedup(documents(spark, rows), bucket_rows=8)
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == plain(rows)
    assert sorted(r["doc_id"] for r in dedup_rows(documents(spark, rows), bucket_rows=8).collect()) == sorted(i for i, *_, kept, _ in plain(rows) if kept)


def test_directory_doubles_until_buckets_fit(spark):
    rows = spark.range(4000).select(F.xxhash64("id").alias("h"), F.lit(1).alias("group_size"))
    slots, depth = directory(rows, 4000, bucket_rows=64)
    assert depth > 6  # 64 slots of 62 entries on average: some hold more than 64
    held = rows.withColumn("slot", F.shiftrightunsigned("h", 64 - depth)).join(slots, "slot").groupBy("bucket", "local_depth").count().collect()
    assert sum(r["count"] for r in held) == 4000 and max(r["count"] for r in held) <= 64
    assert min(r["local_depth"] for r in held) >= 5
    uneven = rows.withColumn("h", F.when(F.col("h") > 0, F.shiftrightunsigned("h", 9)).otherwise(F.col("h")))  # half of the keys share their first bits
    slots, depth = directory(uneven, 4000, bucket_rows=100)
    assert depth >= 14 and slots.agg(F.max("local_depth") - F.min("local_depth")).first()[0] >= 3
    same = rows.withColumn("h", F.lit(5).cast("long"))  # one chain, which no depth splits
    assert directory(same, 4000, bucket_rows=100)[0].count() == 1


def test_hot_key_lookup(spark, tmp_path):
    probe = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") + 100).alias("k"))
    sizes = probe.groupBy("k").count().select("k", F.col("count").alias("n"), (F.col("k") * 2).alias("v")).where("k <> 101")
    got = skew_safe_lookup(probe, sizes, ["k"], "n", 3000)
    assert got.where("v is null").count() == 1 and got.where("v <> k * 2").count() == 0 and got.count() == 3000
    for total in (3000, 10**9):  # with and without heavy keys
        sizes.write.mode("overwrite").parquet(str(tmp_path / "sizes"))
        met = skew_safe_join(probe, spark.read.parquet(str(tmp_path / "sizes")), "k", "n", total)
        assert met.where("v <> k * 2").count() == 0 and met.count() == 2999 and sorted(met.columns) == ["id", "k", "n", "v"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = skew_safe_lookup(probe, sizes, ["k"], "n", 3000).where("v is not null")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"SortMergeJoin \[k#\d+L?, _mark#\d+", plan)  # rows of heavy keys are spread by the marker


URLS = ["http://Example.com/en/x?y#z", "https://www.example.com/en/", "http://a.b.example.com/en/x", "http://notexample.com/en/x", "http://x.net/es/1", "http://x.net/ES/1", "http://net/fr/", "http://x.org/", "no url", None, "http://example.com", "http://example.com?x=/en/", "ftp://a.com:80/#q", "://com/", "http:///en/", "http://x.net//es/", "http://a://b.com/en/"]
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def judge(url, rules=RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), a == "block", h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], "allow" if best is None else "block" if best[2] else "allow"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "x", "y") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, key string")


def test_urls_against_plain(spark):
    got = judge_urls(pages(spark, URLS)).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [judge(u) for u in URLS]


def test_url_copies_stay(spark):
    df = pages(spark, URLS[:3])
    got = judge_urls(df.union(df).union(df.limit(1)))
    assert got.count() == 7
    assert judge_urls(df.limit(0)).count() == 0


def test_long_rule_list_and_default(spark):
    rules = [("block" if i % 2 else "allow", f"h{i % 211}.org", f"/{'abcdefg'[: i % 7]}") for i in range(3000)] + [("allow", "dup.org", "/"), ("block", "dup.org", "/")]
    urls = [f"http://s.h{i % 250}.org/{'abcdefg'[: i % 8]}" for i in range(500)] + ["http://dup.org/x"]
    table = spark.createDataFrame(rules, "action string, host string, path string")
    got = judge_urls(pages(spark, urls), table, default="block").orderBy("page_id").collect()
    for r, u in zip(got, urls, strict=True):
        host, path, rule, verdict = judge(u, rules)
        assert (r["rule"], r["verdict"]) == (rule, verdict if rule else "block")
    assert judge_urls(pages(spark, urls), rules_table(spark, [])).where("rule is not null").count() == 0


def test_long_urls_and_null_ids(spark):
    long = "http://a.b.example.com/en/" + "x/" * 20_000 + "?q=" + "y" * 50_000
    deep = "http://" + "s." * 300 + "example.net/fr/"
    rows = [(None, "http://www.example.com/en/x"), (None, None), (None, "http://www.example.com/en/x"), (1, long), (2, deep), (3, "http://" + "h" * 30_000)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert sorted((r["page_id"] or 0, r["rule"] or "", r["verdict"]) for r in got) == [(0, "", "allow"), (0, "www.example.com/en/", "allow"), (0, "www.example.com/en/", "allow"), (1, "example.com/en/", "block"), (2, "net/fr/", "block"), (3, "", "allow")]
    assert next(r for r in got if r["page_id"] == 1)["path"] == "/en/" + "x/" * 20_000


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    words, blocks = bloom_words(keys, 5000)
    probe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"), "id").withColumn("w", words.scalar())
    hit = probe.where(might_contain(F.col("w"), F.col("key"), blocks))
    assert hit.where("id < 5000").count() == 5000
    assert hit.where("id >= 5000").count() < 450  # 3 % of 15,000
