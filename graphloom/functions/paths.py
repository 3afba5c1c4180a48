"""Path, name and identifier functions as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    """The directory of a path: ``.`` for a bare name, ``/`` for a name below the root."""
    cut = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(~F.contains(path, F.lit("/")), F.lit(".")).when(cut == "", F.lit("/")).otherwise(cut)


def extension(path: Column) -> Column:
    """From the last dot of the base name on, or empty."""
    return F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1)


def clean(path: Column) -> Column:
    """A path without ``.``, empty and resolvable ``..`` segments."""
    rooted = F.startswith(path, F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..",
            F.when((F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1))
            .when(rooted, acc)
            .otherwise(F.concat(acc, F.array(s))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    text = F.array_join(folded, "/")
    return F.when(rooted, F.concat(F.lit("/"), text)).when(text == "", F.lit(".")).otherwise(text)


def join(directory: Column, name: Column) -> Column:
    return clean(F.concat_ws("/", directory, name))


def relative(path: Column, root: Column) -> Column:
    """``path`` below ``root``, or as it is where it does not lie there."""
    under = F.startswith(path, F.concat(root, F.lit("/")))
    return F.when((root == "") | ~under, path).otherwise(F.substring(path, F.char_length(root) + 2, F.char_length(path)))


def suffixes(path: Column) -> Column:
    """Every suffix of a path that begins at a segment, longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def snake_case(name: Column) -> Column:
    """An underscore before every ASCII capital but a first one; ASCII capitals in lower case."""
    marked = F.regexp_replace(name, "(?<!^)([A-Z])", "_$1")
    return F.translate(marked, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def segments(name: Column, delimiters: list[str]) -> Column:
    """The non-empty parts of a name between ``/`` and the delimiters."""
    for d in delimiters:
        name = F.replace(name, F.lit(d), F.lit("/"))
    return F.filter(F.split(name, "/"), lambda s: s != "")


def owner(node_id: Column) -> Column:
    """The document of a node: what stands before the first ``#``."""
    return F.substring_index(node_id, "#", 1)


def package_id(key: Column) -> Column:
    return F.concat(F.lit("package:"), key)


def cluster_id(kind: Column, name: Column) -> Column:
    return F.concat_ws(":", kind, name)


def common_prefix(low: Column, high: Column) -> Column:
    """The longest prefix of whole segments of the least and the greatest of some paths.

    Paths must be compared by segments, so ``low`` and ``high`` are arrays of segments.
    """
    same = F.zip_with(low, high, lambda a, b: F.coalesce(a == b, F.lit(False)))
    n = F.array_position(F.concat(same, F.array(F.lit(False))), F.lit(False)) - 1
    return F.array_join(F.slice(low, F.lit(1), n.cast("int")), "/")


def glob_to_regex(pattern: str) -> str:
    """A shell pattern whose ``*`` and ``?`` do not cross ``/``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a path equals a pattern, lies below it, or matches it whole or by its base name."""
    out = F.lit(False)
    for p in patterns:
        bare = p.rstrip("/")
        out = out | (path == bare) | F.startswith(path, F.lit(bare + "/")) | path.rlike(glob_to_regex(p)) | base_name(path).rlike(glob_to_regex(p))
    return out
