"""Import statements found by patterns alone, a ground truth that needs no extractor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _go(text: Column) -> Column:
    """Quoted paths of import blocks, and of single statements outside them."""
    bare = F.regexp_replace(text, r"//[^\n]*", "")
    blocks = F.flatten(F.transform(_all(bare, r"\bimport\s*\(([^)]*+)\)"), lambda b: _all(b, r'"([^"]+)"')))
    rest = F.regexp_replace(bare, r"\bimport\s*\([^)]*+\)", "")
    return F.concat(blocks, _all(rest, r'\bimport\s+(?:[_.]\s+|\w+\s+)?"([^"]+)"'))


def _python(text: Column) -> Column:
    """Modules of ``import a, b as c`` and of ``from a import b``."""
    lists = F.flatten(F.transform(_all(text, r"(?m)^[ \t]*import[ \t]+([\w., \t]+)"), lambda s: F.split(s, ",")))
    plain = F.transform(lists, lambda s: F.regexp_extract(s, r"^\s*([\w.]+)", 1))
    return F.concat(plain, _all(text, r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import\b"))


def _script(text: Column) -> Column:
    quoted = r"""["']([^"']+)["']"""
    clause = r"""[^"';\n]*?\bfrom\s+""" + quoted
    return F.concat(_all(text, r"\bimport\s+" + quoted), _all(text, r"\bimport\s+" + clause), _all(text, r"\bexport\s+" + clause), _all(text, r"\brequire\s*\(\s*" + quoted))


def _lines(pattern: str):
    return lambda text: _all(text, r"(?m)^\s*" + pattern)


_INCLUDE = _lines(r"""#\s*include\s*[<"]([^>"]+)[>"]""")
_DOTTED = _lines(r"import\s+(?:static\s+)?([A-Za-z0-9_$.*]+)")
#: How each format spells imports.
PATTERNS = {
    "golang": _go,
    "python": _python,
    "javascript": _script,
    "typescript": _script,
    "tsx": _script,
    "java": _DOTTED,
    "kotlin": _DOTTED,
    "rust": _lines(r"use\s+([A-Za-z0-9_]+(?:::[A-Za-z0-9_]+)*+)"),
    "csharp": _lines(r"using\s+(?!static\b)(?![\w.]+\s*=)([A-Za-z0-9_.]+)"),
    "ruby": lambda text: _all(text, r"""\brequire(?:_relative)?\s*["']([^"']+)["']"""),
    "php": _lines(r"use\s+(?:function\s+|const\s+)?([A-Za-z0-9_\\]+)"),
    "c": _INCLUDE,
    "cpp": _INCLUDE,
    "swift": _lines(r"(?:@testable\s+)?import\s+([A-Za-z0-9_.]+)"),
}


def lexical_imports(files: DataFrame) -> DataFrame:
    """``(path, format, name)`` of every import statement of files (path, format, text); other formats have none."""
    found = F.lit(None).cast("array<string>")
    for name, of in PATTERNS.items():
        found = F.when(F.col("format") == name, of(F.col("text"))).otherwise(found)
    return files.select("path", "format", F.explode(found).alias("name")).withColumn("name", F.trim("name")).where("name <> ''")
