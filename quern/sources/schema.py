"""The relations. Every list order is a column: *_ord, seq."""

from __future__ import annotations

TABLES = {
    "classes": "class_ord bigint, full_name string, full_name_lc string, raw_name string, short_name string, is_inner boolean, super_class string, interfaces array<string>",
    "class_text": "class_ord bigint, code string, smali string",
    "methods": "class_ord bigint, method_ord int, name string, name_lc string, short_id string, full_name string, code string",
    "fields": "class_ord bigint, field_ord int, name string, type string",
    "variables": "class_ord bigint, method_ord int, var_ord int, name string, reg int, ssa int",
    "resources": "res_ord bigint, original_name string, deobf_name string, content string",
    "resource_subfiles": "res_ord bigint, sub_ord int, file_name string, content string",
    "use_edges": "target_kind string, target_class_ord bigint, target_member_ord int, user_kind string, user_class string, user_sig string, edge_ord bigint",
    "renames": "seq bigint, kind string, class_name string, member string, old_name string, new_name string",
    "tasks": "task_id string, type string, status string, result string, error string, created_ms bigint",
}
#: Lower-cased twins of name columns, made when a dataset is written so that name filters reach the Parquet scan.
LOWERED = {"classes": {"full_name": "full_name_lc"}, "methods": {"name": "name_lc"}}
