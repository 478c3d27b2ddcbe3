"""Schemas of the fact tables and the dimension of symbol kinds.

Locations order by (file_id, line, col); the three stay top-level columns, so that filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOC = ["file_id", "line", "col"]
_LOC = "file_id INT, line INT, col INT"

TABLES: dict[str, str] = {
    "files": "file_id INT, path STRING, is_header BOOLEAN, is_system BOOLEAN, mtime_ms BIGINT, parsed_ms BIGINT",
    "lines": "file_id INT, line INT, text STRING",
    "symbols": f"{_LOC}, symbol_name STRING, usr STRING, type_name STRING, base_classes ARRAY<STRING>, "
    f"arguments ARRAY<STRUCT<{_LOC.replace(' INT', ': INT')}, length: INT>>, "
    "argument_usage STRUCT<index: INT, invocation: STRUCT<file_id: INT, line: INT, col: INT>, invoked: STRUCT<file_id: INT, line: INT, col: INT>>, "
    "symbol_length INT, kind STRING, type STRING, linkage STRING, flags INT, mangled_name STRING, brief_comment STRING, xml_comment STRING, "
    "stack_cost INT, enum_value BIGINT, start_line INT, start_col INT, end_line INT, end_col INT, size INT, field_offset INT, alignment INT",
    "symbol_names": f"name STRING, {_LOC}",
    "usrs": f"usr STRING, {_LOC}",
    "targets": f"usr STRING, {_LOC}",
    "includes": "src_file INT, dst_file INT",
    "tokens": "file_id INT, offset INT, length INT, kind STRING, spelling STRING, line INT, col INT",
    "sources": "file_id INT, build_index INT, compiler STRING, language STRING, directory STRING, output STRING, "
    "defines ARRAY<STRUCT<name: STRING, value: STRING>>, includes ARRAY<STRUCT<type: STRING, path: STRING>>, arguments ARRAY<STRING>",
    "diagnostics": f"diag_id BIGINT, parent_id BIGINT, {_LOC}, length INT, severity STRING, message STRING, source_file_id INT",
    "fixits": f"{_LOC}, length INT, text STRING",
    "buffers": "file_id INT, state STRING",
    "projects": "project_id INT, root STRING, is_current BOOLEAN",
    "project_files": "dir STRING, name STRING",
}

#: Bits of ``symbols.flags``; pure virtual includes virtual.
VIRTUAL, PURE_VIRTUAL, STATIC, CONST = 0x1, 0x3, 0x4, 0x8
IMPLICIT_DESTRUCTION, TEMPLATE_SPECIALIZATION, TEMPLATE_REFERENCE, DEFINITION, FILE_SYMBOL = 0x100, 0x200, 0x400, 0x800, 0x1000

#: kind: (categories, sort rank, target rank). Categories: r reference, f function, n container, c class, s statement,
#: d declaration, e expression, a attribute, p preprocessing.
KINDS: dict[str, tuple[str, int, int]] = {
    "VarDecl": ("d", 2, 6),
    "FieldDecl": ("d", 2, 6),
    "ParmDecl": ("d", 1, 6),
    "FunctionDecl": ("dfn", 5, 4),
    "CXXMethod": ("dfn", 5, 4),
    "CXXConstructor": ("dfn", 5, 3),
    "CXXDestructor": ("dfn", 1, 2),
    "FunctionTemplate": ("dfn", 5, 2),
    "LambdaExpr": ("efn", 1, 2),
    "ClassDecl": ("dcn", 10, 0),
    "StructDecl": ("dcn", 10, 0),
    "ClassTemplate": ("dcn", 10, 0),
    "ClassTemplatePartialSpecialization": ("dcn", 1, 2),
    "UnionDecl": ("dn", 1, 2),
    "Namespace": ("dn", 1, 2),
    "EnumDecl": ("dn", 1, 2),
    "EnumConstantDecl": ("d", 1, 2),
    "TypedefDecl": ("d", 1, 2),
    "UsingDirective": ("d", 1, 2),
    "DeclRefExpr": ("re", 1, 2),
    "MemberRefExpr": ("re", 1, 2),
    "CallExpr": ("re", 1, 2),
    "TypeRef": ("r", 1, 2),
    "TemplateRef": ("r", 1, 0),
    "MemberRef": ("r", 1, 2),
    "OverloadedDeclRef": ("r", 1, 2),
    "NamespaceRef": ("r", 1, 2),
    "BreakStmt": ("s", 1, 2),
    "ReturnStmt": ("s", 1, 2),
    "IfStmt": ("s", 1, 2),
    "StringLiteral": ("e", 1, 2),
    "IntegerLiteral": ("e", 1, 2),
    "MacroDefinition": ("p", 1, 7),
    "MacroExpansion": ("rp", 1, 2),
    "InclusionDirective": ("p", 1, 2),
    "AnnotateAttr": ("a", 1, 2),
}
#: Builtin types by how the parser calls them.
BUILTIN_TYPES: dict[str, str] = {
    "Void": "void", "Bool": "bool", "Char_U": "unsigned char", "UChar": "unsigned char", "Char16": "char16", "Char32": "char32", "UShort": "unsigned short", "UInt": "unsigned int",
    "ULong": "unsigned long", "ULongLong": "unsigned long long", "UInt128": "uint128", "Char_S": "char", "SChar": "schar", "WChar": "wchar", "Short": "short", "Int": "int", "Long": "long",
    "LongLong": "long long", "Int128": "int128", "Float": "float", "Double": "double", "LongDouble": "long double",
}
CATEGORIES = {"reference": "r", "function": "f", "container": "n", "class": "c", "statement": "s", "declaration": "d", "expression": "e", "attribute": "a", "preprocessing": "p"}


def kinds(spark: SparkSession) -> DataFrame:
    """The dimension of kinds: one row a spelling, a boolean a category, both ranks."""
    rows = [(k, *[c in cats for c in CATEGORIES.values()], sort, target) for k, (cats, sort, target) in KINDS.items()]
    flags = ", ".join(f"is_{c} BOOLEAN" for c in CATEGORIES)
    return spark.createDataFrame(rows, f"kind STRING, {flags}, sort_rank INT, target_rank INT")


def in_category(category: str, kind: F.Column | None = None) -> F.Column:
    """Whether a kind belongs to a category; an expression over constants, no join."""
    return (F.col("kind") if kind is None else kind).isin([k for k, (cats, _, _) in KINDS.items() if CATEGORIES[category] in cats])


def is_definition(flags: F.Column | None = None) -> F.Column:
    return (F.col("flags") if flags is None else flags).bitwiseAND(DEFINITION) != 0


def builtin_type_name(kind: F.Column) -> F.Column:
    """The name of a builtin type, null for others."""
    out = F.lit(None).cast("string")
    for k, name in BUILTIN_TYPES.items():
        out = F.when(kind == k, name).otherwise(out)
    return out


def rank_by(which: int, kind: F.Column | None = None, default: int = 1) -> F.Column:
    """CASE over kinds: which 0 is the sort rank, 1 the target rank."""
    kind = F.col("kind") if kind is None else kind
    by: dict[int, list[str]] = {}
    for k, v in KINDS.items():
        by.setdefault(v[1 + which], []).append(k)
    out = F.lit(default)
    for rank, names in by.items():
        if rank != default:
            out = F.when(kind.isin(names), rank).otherwise(out)
    return out
