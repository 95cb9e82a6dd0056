"""Scalar functions over names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reserved words of C#, which are no identifiers.
KEYWORDS = (
    "abstract", "as", "base", "bool", "break", "byte", "case", "catch", "char", "checked", "class", "const",
    "continue", "decimal", "default", "delegate", "do", "double", "else", "enum", "event", "explicit", "extern",
    "false", "finally", "fixed", "float", "for", "foreach", "goto", "if", "implicit", "in", "int", "interface",
    "internal", "is", "lock", "long", "namespace", "new", "null", "object", "operator", "out", "override", "params",
    "private", "protected", "public", "readonly", "ref", "return", "sbyte", "sealed", "short", "sizeof",
    "stackalloc", "static", "string", "struct", "switch", "this", "throw", "true", "try", "typeof", "uint", "ulong",
    "unchecked", "unsafe", "ushort", "using", "virtual", "void", "volatile", "while",
)
IDENTIFIER = r"^[@]?[a-zA-Z_][a-zA-Z0-9_]*$"


def is_identifier(name: Column) -> Column:
    return name.rlike(IDENTIFIER) & ~name.isin(*KEYWORDS)


def camel(name: Column) -> Column:
    return F.concat(F.lower(F.left(name, F.lit(1))), F.substring(name, 2, 1 << 30))


def capitalised(name: Column) -> Column:
    return F.concat(F.upper(F.left(name, F.lit(1))), F.substring(name, 2, 1 << 30))


def last_segment(name: Column, mark: str = ".") -> Column:
    return F.substring_index(name, mark, -1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1)


def same_file(path: Column, other: Column) -> Column:
    """Equal paths or equal file names, whatever the case."""
    return (F.lower(path) == F.lower(other)) | (F.lower(file_name(path)) == F.lower(file_name(other)))


def preview(text: Column, most: int = 100) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def version_in_path(path: Column) -> Column:
    """The last segment of a path that looks like a version, else Unknown."""
    hits = F.filter(F.split(path, r"[/\\\\]"), lambda x: x.rlike(r"^[0-9]+(\.[0-9A-Za-z-]+)+$"))
    return F.coalesce(F.element_at(F.when(F.size(hits) > 0, hits), -1), F.lit("Unknown"))
