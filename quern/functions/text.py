"""Scalar functions on columns and on parameters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for what could not be had. Fixed values.
NO_CLASS_CODE = "/* Decompile failed */"
NO_METHOD_CODE = "/* Method decompile failed */"
NO_BYTECODE = "# [WARNING] No bytecode text is available for this class."
MAX_CONTENT = 200_000
TRUNCATED = "\n[TRUNCATED: content too long; ask for a range of lines to read the rest.]"
#: Manifest patterns. Fixed values.
LOOSE_PACKAGE = r'package\s*=\s*"([^"]+)"'
COMPONENT_NAME = r'android:name\s*=\s*"([^"]+)"'
MAIN_ACTION = "android.intent.action.MAIN"
LAUNCHER_CATEGORY = "android.intent.category.LAUNCHER"
OBFUSCATED_PACKAGE = re.compile(r"p[0-9]{3}")
_LOW = "".join(map(chr, range(33)))


# parameters ------------------------------------------------------------------------------------


def is_blank(value: str | None) -> bool:
    """R35."""
    return value is None or not value.strip()


def trimmed(value: str) -> str:
    """Without characters up to U+0020 at both ends."""
    return value.strip(_LOW)


def parse_int(value: object, default: int) -> int:
    """A 32-bit integer in decimal, with an optional sign; anything else is the default."""
    text = trimmed(str(value)) if value is not None else ""
    if not re.fullmatch(r"[+-]?[0-9]+", text):
        return default
    n = int(text)
    return n if -(2**31) <= n < 2**31 else default


def parse_line(value: object, default: int) -> int:
    """R49."""
    return max(1, parse_int(value, default))


def split_descriptor(path: str) -> tuple[str | None, str, str | None]:
    """(class path or None, member, descriptor or None) of a.b.C.m(I)V."""
    at = path.find("(")
    plain, descriptor = (path[:at], path[at:]) if at > 0 else (path, None)
    owner, dot, member = plain.rpartition(".")
    return (owner if dot else None), member, descriptor


def query_params(query: str | None) -> dict[str, str]:
    """name=value pairs of a decoded query; a pair without = has an empty value, the last of a name counts."""
    from urllib.parse import unquote_plus

    out: dict[str, str] = {}
    for pair in (query or "").split("&"):
        if pair:
            name, _, value = pair.partition("=")
            try:
                out[unquote_plus(name, errors="strict")] = unquote_plus(value, errors="strict")
            except UnicodeDecodeError:
                continue
    return out


def is_obfuscated_package(prefix: str | None) -> bool:
    """A whole value such as p001 names no package."""
    return prefix is not None and OBFUSCATED_PACKAGE.fullmatch(prefix) is not None


# columns ---------------------------------------------------------------------------------------


def lenient_int(col: Column, default: int) -> Column:
    """R48 on a column."""
    return F.coalesce(col.try_cast("int"), F.lit(default))


def lenient_line(col: Column, default: int) -> Column:
    """R49 on a column."""
    return F.greatest(F.lit(1), lenient_int(col, default))


def class_source(code: Column) -> Column:
    """R09."""
    return F.when(F.coalesce(code, F.lit("")) == "", F.lit(NO_CLASS_CODE)).otherwise(code)


def method_source(full_name: Column, code: Column) -> Column:
    """R10."""
    return F.concat(F.lit("// Method: "), full_name, F.lit("\n\n"), F.when(F.coalesce(code, F.lit("")) == "", F.lit(NO_METHOD_CODE)).otherwise(code))


def bytecode(smali: Column, missing: str = NO_BYTECODE) -> Column:
    """Blank counts as missing."""
    return F.when(F.btrim(F.coalesce(smali, F.lit("")), F.lit(_LOW)) == "", F.lit(missing)).otherwise(smali)


def tag_attribute(xml: Column, tag: str, attribute: str) -> Column:
    """The first value of an attribute within a tag, empty where there is none."""
    return F.regexp_extract(xml, rf'<{re.escape(tag)}[^>]+{re.escape(attribute)}\s*=\s*"([^"]+)"', 1)


def manifest_package(xml: Column, loose: bool = False) -> Column:
    """The package attribute, empty where there is none."""
    return F.regexp_extract(xml, LOOSE_PACKAGE, 1) if loose else tag_attribute(xml, "manifest", "package")


def component_name(name: Column, package: Column) -> Column:
    """A leading dot or a missing one means within the package."""
    return F.when(name.startswith("."), F.concat(package, name)).when(~name.contains("."), F.concat(package, F.lit("."), name)).otherwise(name)


def component_blocks(xml: Column, tag: str = "<activity") -> Column:
    """The blocks a tag cuts a text into, what stands before the first included."""
    return F.split(xml, re.escape(tag))


def is_launcher(block: Column) -> Column:
    return block.contains(MAIN_ACTION) & block.contains(LAUNCHER_CATEGORY)


def line_slice(text: Column, start: Column | int, end: Column | int) -> Column:
    """A header, then lines start to end, each ended by a line feed. A null text gives an empty string.

    Lines end at any line break, and empty ones at the text's end are dropped. The text is split
    once: lambdas bind the lines, and then their number, to a name.
    """
    first = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(1))
    bound = F.lit(end) if isinstance(end, int) else end

    def counted(lines: Column) -> Column:
        full = F.array_max(F.transform(lines, lambda x, i: F.when(x != "", i + 1).otherwise(F.lit(0))))
        return F.struct(lines.alias("lines"), F.when(F.size(lines) == 1, F.lit(1)).otherwise(full).alias("total"))

    def sliced(x: Column) -> Column:
        last = F.least(bound, x["total"])
        body = F.when(last >= first, F.array_join(F.transform(F.slice(x["lines"], first, last - first + 1), lambda line: F.concat(line, F.lit("\n"))), "")).otherwise(F.lit(""))
        return F.concat(F.lit("// Lines "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("/"), x["total"].cast("string"), F.lit("\n\n"), body)

    found = F.transform(F.transform(F.array(F.split(text, r"\R")), counted), sliced)
    return F.coalesce(found[0], F.lit(""))


def truncated(text: Column, limit: int = MAX_CONTENT, notice: str = TRUNCATED) -> Column:
    """R54, in code points."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(notice))).otherwise(text)


def resource_view(text: Column, start: int, end: int, limit: int = MAX_CONTENT, compat: bool = False) -> Column:
    """Slices, then truncates; compat truncates first, so that lines beyond the limit can't be reached."""
    return line_slice(truncated(text, limit), start, end) if compat else truncated(line_slice(text, start, end), limit)


def alias_keys(original: Column, deobfuscated: Column) -> Column:
    """The names a resource is found by: both its names, the latter with forward slashes, and that lower-cased."""
    slashed = F.translate(F.coalesce(deobfuscated, original), "\\", "/")
    return F.array_distinct(F.array_compact(F.array(original, deobfuscated, slashed, F.lower(slashed))))


def is_method_name(path: Column) -> Column:
    """Has a dot that isn't the last character, before any descriptor."""
    plain = _plain(path)
    return plain.contains(".") & ~plain.endswith(".")


def method_part(path: Column) -> Column:
    return F.when(is_method_name(path), F.substring_index(_plain(path), ".", -1))


def class_part(path: Column) -> Column:
    return F.when(is_method_name(path), F.regexp_replace(_plain(path), r"\.[^.]*$", "")).otherwise(path)


def _plain(path: Column) -> Column:
    return F.when(F.instr(path, "(") > 1, F.substring_index(path, "(", 1)).otherwise(path)
