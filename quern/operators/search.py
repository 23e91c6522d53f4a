"""Listing and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .predicates import code_has, first_signature, in_package, keyword_in, search_locations, term_in

#: In order of precedence. Fixed values.
CRYPTO_SIGNATURES = ["javax.crypto.Cipher", "SecretKeySpec", "MessageDigest", "getEncoded"]


def list_classes(classes: DataFrame, keyword: str | None = None) -> DataFrame:
    """R19 without its page."""
    return classes.where(keyword_in(F.col("full_name_lc"), keyword)).select("class_ord", "full_name")


def search_classes(classes: DataFrame, class_text: DataFrame, term: str, package: str | None = None, search_in: str | None = None) -> DataFrame:
    """Each class once, if its package fits and its name or its code holds the term.

    Searching both, source text is only read for classes whose name misses: the hits by name and
    the misses joined to their text are two branches.
    """
    places = search_locations(search_in)
    scope = classes.where(in_package(F.col("full_name"), package)).select("class_ord", "full_name", "full_name_lc")
    by_name = term_in(F.col("full_name_lc"), term)
    hits = scope.where(by_name).select("class_ord", "full_name")
    if "code" not in places:
        return hits
    rest = scope if "name" not in places else scope.where(~F.coalesce(by_name, F.lit(False)))
    found = class_text.where(code_has(F.col("code"), term)).select("class_ord")
    by_code = rest.join(found, "class_ord", "left_semi").select("class_ord", "full_name")
    return by_code if "name" not in places else hits.unionByName(by_code)


def search_methods(classes: DataFrame, methods: DataFrame, term: str) -> DataFrame:
    """class_ord, method_ord, signature."""
    hits = methods.where(term_in(F.col("name_lc"), term))
    text = F.concat_ws(" | ", "full_name", F.coalesce("short_id", "name"))
    return hits.select("class_ord", "method_ord", "short_id", "name").join(classes.select("class_ord", "full_name"), "class_ord").select("class_ord", "method_ord", text.alias("signature"))


def search_string(classes: DataFrame, class_text: DataFrame, query: str) -> DataFrame:
    """Case-sensitive, unpaged."""
    found = class_text.where(F.col("code").contains(query)).select("class_ord")
    return classes.join(found, "class_ord", "left_semi").select("class_ord", "full_name")


def scan_signatures(classes: DataFrame, class_text: DataFrame, signatures: list[str] | None = None, kind: str = "CRYPTO_SENSITIVE") -> DataFrame:
    """class_ord, class, type, hint; at most one row per class."""
    hit = first_signature(F.col("code"), CRYPTO_SIGNATURES if signatures is None else signatures)
    found = class_text.select("class_ord", hit.alias("hit")).where("hit is not null")
    return classes.select("class_ord", F.col("full_name").alias("class")).join(found, "class_ord").select("class_ord", "class", F.lit(kind).alias("type"), F.concat(F.lit("Contains "), "hit").alias("hint"))


def signature_hints(scan: DataFrame) -> DataFrame:
    """R30."""
    return scan.select("class", "hint")


def list_resources(resources: DataFrame, keyword: str | None = None) -> DataFrame:
    """R20 without its page: res_ord, name. An empty result is not found; the facade says so."""
    named = resources.where(F.regexp_like("deobf_name", F.lit(r"\P{javaWhitespace}")))
    return named.where(keyword_in(F.lower("deobf_name"), keyword)).select("res_ord", F.col("deobf_name").alias("name"))
