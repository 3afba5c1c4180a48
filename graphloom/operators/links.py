"""Producers of links between documents, entities and packages, each a join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.schema import COCHANGE_FILES, EXTRACTED, INFERRED, REFERENCE_TARGETS


def _link(source: Column, target: Column, kind: str, weight: Column | float, provenance: str | Column, **meta: str | Column) -> list[Column]:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    entries = [c for k, v in meta.items() for c in (F.lit(k), as_col(v))]
    return [
        source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("type"), as_col(weight).cast("double").alias("weight"),
        as_col(provenance).alias("source_type"), (F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")).alias("metadata"),
    ]


def normalized(links: DataFrame) -> DataFrame:
    """Links whose empty provenance reads ``extracted``."""
    return links.withColumn("source_type", F.coalesce(F.nullif("source_type", F.lit("")), F.lit(EXTRACTED)))


def name_registry(entities: DataFrame) -> DataFrame:
    """One entity for each name, the one of the least id."""
    return entities.groupBy("name").agg(F.min(F.struct("entity_id", "type")).alias("e")).select("name", F.col("e.entity_id").alias("entity_id"), F.col("e.type").alias("type"))


def implements(entities: DataFrame) -> DataFrame:
    """A struct implements an interface if its name ends with the interface's.

    Of interfaces of one name, the least id stands for it; entities of other types do not
    hide an interface.  All suffixes of struct names are joined by equality; the interface's length keeps the
    empty name from matching more than once.
    """
    interfaces = name_registry(entities.where("type = 'interface'")).select(F.col("name").alias("suffix"), F.col("entity_id").alias("target_id"))
    n = F.char_length("name")
    structs = entities.where("type = 'struct'").select("entity_id", F.explode(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.expr("name").substr(i, n))).alias("suffix"))
    return structs.join(interfaces, "suffix").select(*_link(F.col("entity_id"), F.col("target_id"), "implements", 0.8, INFERRED, rule="naming_convention_heuristic"))


def documented_by_path(documents: DataFrame, entities: DataFrame) -> DataFrame:
    """Markdown and PDF documents whose path contains an entity's name, in any case.

    Each path gives its substrings of the lengths that names have, which are joined by
    equality: no path is compared with every name.
    """
    names = name_registry(entities).select(F.lower("name").alias("part"), "entity_id").where("part <> ''")
    lengths = names.select(F.char_length("part").alias("n")).distinct()
    lengths = lengths.agg(F.collect_set("n").alias("lengths"))
    docs = documents.where(F.col("format").isin("markdown", "pdf")).select("path", F.lower("path").alias("low")).join(F.broadcast(lengths), F.lit(True))
    size = F.char_length("low")
    fits = F.filter("lengths", lambda n: n <= size)
    pieces = F.flatten(F.transform(fits, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.expr("low").substr(i, n))))
    found = docs.select("path", F.explode(F.array_distinct(pieces)).alias("part")).join(names, "part")
    return found.select(*_link(F.col("path"), F.col("entity_id"), "documents", 0.6, INFERRED, rule="path_keyword_match"))


def package_of(documents: DataFrame, entities: DataFrame) -> DataFrame:
    """``(path, pkg_key, name)`` from the first package entity of each document."""
    first = entities.where("type = 'package'").groupBy("doc_path").agg(F.min(F.struct("ordinal", "name", F.element_at("metadata", "package_path").alias("at"))).alias("p"))
    key = F.coalesce(F.nullif(F.col("p.at"), F.lit("")), paths.dir_name(F.col("path")))
    return documents.join(first, documents.path == first.doc_path).select("path", key.alias("pkg_key"), F.col("p.name").alias("name"), "format")


def part_of(members: DataFrame) -> DataFrame:
    return members.select(*_link(F.col("path"), paths.package_id(F.col("pkg_key")), "part_of", 1.0, EXTRACTED, rule="package_clause"))


def packages(members: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """``(pkg_key, name, import_path, files, imports)``: the name is that of the least path with one.

    imports: links from ``package_imports``; a package imports what its files import, and
    its import path is the least that resolved to it.
    """
    named = F.when(F.col("name") != "", F.struct("path", "name"))
    out = members.groupBy("pkg_key").agg(F.min(named).alias("n"), F.sort_array(F.collect_list("path")).alias("files")).select("pkg_key", F.col("n.name").alias("name"), "files")
    if imports is None:
        return out.select("pkg_key", "name", F.lit(None).cast("string").alias("import_path"), "files", F.array().cast("array<string>").alias("imports"))
    key = F.substring("target_id", len("package:") + 1, 1 << 20)
    asked = imports.select(F.col("source_id").alias("path"), key.alias("to"), F.col("metadata")["import_path"].alias("spelled")).join(members.select("path", "pkg_key"), "path")
    uses = asked.groupBy("pkg_key").agg(F.sort_array(F.collect_set("to")).alias("imports"))
    spelled = asked.groupBy(F.col("to").alias("pkg_key")).agg(F.min("spelled").alias("import_path"))
    both = out.join(uses, "pkg_key", "left").join(spelled, "pkg_key", "left")
    return both.select("pkg_key", "name", "import_path", "files", F.coalesce("imports", F.array().cast("array<string>")).alias("imports"))


def longest_suffix(imports: DataFrame, keys: DataFrame) -> DataFrame:
    """``(import_path, key)``: the equal key, or the one whose spelling is the longest ``/``-suffix.

    imports: distinct ``import_path``; keys: ``(key, spelling)``.  Each import gives its
    suffixes, which are joined by equality; ties go to the least key.
    """
    each = imports.select("import_path", F.explode(paths.suffixes(F.col("import_path"))).alias("spelling"))
    found = each.join(keys, "spelling")
    exact = (F.col("spelling") == F.col("import_path")) & (F.col("key") == F.col("import_path"))
    proper = F.char_length("spelling") < F.char_length("import_path")
    rank = F.struct(~exact, -F.char_length("spelling"), "key")
    return found.where(exact | proper).groupBy("import_path").agg(F.min_by("key", rank).alias("key"))


def package_imports(entities: DataFrame, members: DataFrame, formats: tuple[str, ...] = ("golang",)) -> DataFrame:
    """Import statements resolved to packages, as links from documents to packages."""
    mine = members.where(F.col("format").isin(*formats))
    dirs = mine.select(F.split("pkg_key", "/").alias("s")).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    root = dirs.select(F.coalesce(paths.common_prefix(F.col("lo"), F.col("hi")), F.lit("")).alias("root"))
    known = members.select("pkg_key").distinct().join(F.broadcast(root), F.lit(True))
    spelled = known.select(F.col("pkg_key").alias("key"), F.explode(F.array_distinct(F.array("pkg_key", paths.relative(F.col("pkg_key"), F.col("root"))))).alias("spelling")).where("spelling <> ''")
    asked = entities.where("type = 'import'").join(mine.select(F.col("path").alias("doc_path"), F.col("pkg_key").alias("own")), "doc_path")
    best = longest_suffix(asked.select(F.col("name").alias("import_path")).distinct(), spelled)
    hit = asked.join(best, asked.name == best.import_path).where("key <> own")
    return hit.select(*_link(F.col("doc_path"), paths.package_id(F.col("key")), "imports", 0.8, INFERRED, rule="import_resolution", import_path=F.col("import_path")))


@dataclass(frozen=True)
class Shape:
    """How imports of a format name files."""

    extensions: tuple[str, ...]
    delimiters: tuple[str, ...] = ()
    sigils: tuple[str, ...] = ()
    roots: tuple[str, ...] = ()
    entries: tuple[str, ...] = ()
    drop_last: bool = False
    snake: bool = False


# Extensions in the order of preference, and the separators of names.
_SCRIPT = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts")
_WEB = Shape(_SCRIPT, sigils=("@/", "~/", "#/"), roots=("src",), entries=tuple("index" + e for e in _SCRIPT))
SHAPES = {
    "javascript": _WEB,
    "typescript": _WEB,
    "tsx": _WEB,
    "python": Shape((".py",), (".",)),
    "kotlin": Shape((".kt", ".kts"), (".",)),
    "java": Shape((".java",), (".",)),
    "csharp": Shape((".cs",), (".",)),
    "php": Shape((".php",), ("\\",)),
    "ruby": Shape((".rb",), (".",)),
    "elixir": Shape((".ex", ".exs"), (".",), snake=True),
    "rust": Shape((".rs",), ("::",), drop_last=True),
    "swift": Shape((".swift",), (".",)),
    "c": Shape((".c", ".h")),
    "cpp": Shape((".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".h")),
}


def file_index(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(key, path)`` of whole clean paths, and ``(key, path, ext)`` of every suffix without extension."""
    at = documents.select("path", paths.clean(F.col("path")).alias("clean")).withColumn("ext", paths.extension(F.col("clean")))
    bare = F.expr("clean").substr(F.lit(1), F.char_length("clean") - F.char_length("ext"))
    keyed = at.where((F.col("ext") != "") & (bare != "")).select(F.explode(paths.suffixes(bare)).alias("key"), "path", "ext")
    return at.select(F.col("clean").alias("key"), "path"), keyed


def _probes(name: Column, local: Column, relative: Column, shape: Shape, directory: Column) -> Column:
    """Candidates of one import in the order in which they are tried: ``array<struct<key, suffix, exact>>``.

    ``suffix`` says that a key without extension may match any suffix of a file.
    """

    def tail(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.slice(parts, i, F.size(parts)))

    def tried(parts: Column, snake: bool) -> Column:
        def one(p: Column) -> Column:
            raw = paths.clean(F.array_join(p, "/"))
            forms = F.array(paths.clean(F.array_join(F.transform(p, paths.snake_case), "/")), raw) if snake else F.array(raw)
            return F.transform(forms, lambda k: F.struct(k.alias("key"), F.lit(True).alias("suffix"), F.lit(False).alias("exact")))

        return F.when(F.size(parts) > 0, F.flatten(F.transform(tail(parts), one))).otherwise(F.array().cast("array<struct<key:string,suffix:boolean,exact:boolean>>"))

    base = paths.join(directory, name)
    near = F.array(
        *(F.struct(F.concat(base, F.lit(e)).alias("key"), F.lit(False).alias("suffix"), F.lit(True).alias("exact")) for e in ("", *shape.extensions)),
        *(F.struct(paths.join(base, F.lit(e)).alias("key"), F.lit(False).alias("suffix"), F.lit(True).alias("exact")) for e in shape.entries),
    )
    bare = name
    for s in reversed(shape.sigils):
        bare = F.when(F.startswith(name, F.lit(s)), F.substring(name, len(s) + 1, 1 << 20)).otherwise(bare)
    parts = paths.segments(bare, list(shape.delimiters))
    lists = [tried(F.when(F.size(parts) > 0, F.concat(F.array(F.lit(r)), parts)).otherwise(parts), shape.snake) for r in shape.roots] + [tried(parts, shape.snake)]
    if shape.drop_last:
        lists.append(tried(F.when(F.size(parts) > 1, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<string>")), shape.snake))
    stem = F.regexp_replace(name, r"\.[^./]*$", "")
    quoted = F.concat(tried(paths.segments(stem, list(shape.delimiters)), False), F.array(F.struct(stem.alias("key"), F.lit(True).alias("suffix"), F.lit(False).alias("exact"))))
    return F.when(relative, near).when(local, F.concat(near, quoted)).otherwise(F.concat(*lists))


def file_imports(documents: DataFrame, entities: DataFrame) -> DataFrame:
    """Import entities resolved to files: relative ones exactly, others by the longest matching suffix.

    Every import gives its ranked candidates, which are joined by equality with the index of
    files; the first candidate that exists wins, of several files under one suffix key one
    with an extension of the format, then the least path.
    """
    exact, keyed = file_index(documents)
    out = None
    asked = entities.where("type = 'import' and trim(name) <> ''").join(documents.select(F.col("path").alias("doc_path"), "format"), "doc_path")
    for shape in dict.fromkeys(SHAPES.values()):
        formats = [f for f, s in SHAPES.items() if s is shape or s == shape]
        name = F.trim("name")
        relative = F.startswith(name, F.lit("./")) | F.startswith(name, F.lit("../"))
        local = F.coalesce(F.element_at("metadata", "include_kind") == "local", F.lit(False))
        part = asked.where(F.col("format").isin(*formats)).select(
            "doc_path", "ordinal", F.col("name").alias("import_path"), F.lit(",".join(shape.extensions)).alias("extensions"),
            F.posexplode(_probes(name, local, relative, shape, paths.dir_name(F.col("doc_path")))).alias("rank", "probe"),
        )
        out = part if out is None else out.unionByName(part)
    probes = out.select("doc_path", "ordinal", "import_path", "extensions", "rank", F.col("probe.key").alias("key"), F.col("probe.suffix").alias("suffix"), F.col("probe.exact").alias("exact"))
    direct = probes.join(exact, "key").select("doc_path", "ordinal", "import_path", "rank", F.lit(0).alias("how"), F.lit(False).alias("foreign"), "path", "exact")
    loose = probes.where("suffix").where(paths.extension(F.col("key")) == "").join(keyed, "key").select(
        "doc_path", "ordinal", "import_path", "rank", F.lit(1).alias("how"), (~F.array_contains(F.split("extensions", ","), F.col("ext"))).alias("foreign"), "path", "exact"
    )
    best = direct.unionByName(loose).groupBy("doc_path", "ordinal", "import_path").agg(F.min(F.struct("rank", "how", "foreign", "path", "exact")).alias("b"))
    hit = best.where("b.path <> doc_path")
    sure = F.col("b.exact")
    return hit.select(
        *_link(
            F.col("doc_path"), F.col("b.path"), "imports", F.when(sure, 1.0).otherwise(0.8), F.when(sure, EXTRACTED).otherwise(INFERRED),
            rule="module_resolution", import_path=F.col("import_path"), resolution=F.when(sure, "exact").otherwise("suffix_match"),
        )
    )


def references(entities: DataFrame, imported: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Mentions linked to declarations elsewhere: one in an imported document, else the only one.

    imported: ``(doc_path, target)``, or with ``groups``, which has ``(target, at)``, documents
    that import all those of a group.  Those are never listed by importing document: each
    group gives its two least declarations of a name.  A dotted declaration has two rows in
    the index, and uniqueness counts rows.
    """
    declared = entities.where(F.col("type").isin(*REFERENCE_TARGETS))
    bare = F.element_at(F.split("name", r"\."), -1)
    names = F.when(F.contains(F.col("name"), F.lit(".")), F.array("name", bare)).otherwise(F.array("name"))
    index = declared.select(F.explode(names).alias("name"), F.col("doc_path").alias("at"), F.col("ordinal").alias("nth"), F.col("entity_id").alias("target_id"))
    # One row for each name and document, and one for each name: a common name is never paired with its declarations.
    by_doc = index.groupBy("name", "at").agg(F.count("*").alias("n"), F.min(F.struct("nth", "target_id")).alias("least"))
    place = F.struct("at", "least")
    by_name = by_doc.groupBy("name").agg(F.sum("n").alias("all"), F.min(place).alias("first"))
    others = by_doc.join(by_name.select("name", F.col("first.at").alias("skip")), "name").where("at <> skip").groupBy("name").agg(F.min(place).alias("second"))
    by_name = by_name.join(others, "name", "left")
    asked = entities.where("type = 'reference'").select("doc_path", "ordinal", "entity_id", "name")
    mine = by_doc.select("name", F.col("at").alias("doc_path"), F.col("n").alias("n_own"))
    seen = asked.join(by_name, "name").join(mine, ["name", "doc_path"], "left").withColumn("elsewhere", F.col("all") - F.coalesce("n_own", F.lit(0)))
    only = F.when(F.col("first.at") == F.col("doc_path"), F.col("second")).otherwise(F.col("first"))
    seen = seen.select("doc_path", "ordinal", "entity_id", "name", F.when(F.col("elsewhere") == 1, only["least"]["target_id"]).alias("only_id"))
    known = imported.select("doc_path", "target").distinct()
    if groups is None:
        hits = asked.join(known.withColumnRenamed("target", "at").where("doc_path <> at"), "doc_path").join(by_doc, ["name", "at"]).withColumn("place", place)
    else:
        held = groups.select("target", "at").distinct().join(by_doc, "at").select("target", "name", "at", place.alias("place"))
        first = held.groupBy("target", "name").agg(F.min("place").alias("first"))
        second = held.join(first, ["target", "name"]).where("at <> first.at").groupBy("target", "name").agg(F.min("place").alias("second"))
        least = first.join(second, ["target", "name"], "left")
        # A document that is in a group it imports does not import itself.
        other = F.when(F.col("first.at") == F.col("doc_path"), F.col("second")).otherwise(F.col("first"))
        hits = asked.join(known, "doc_path").join(least, ["target", "name"]).withColumn("place", other)
    near = hits.groupBy("doc_path", "ordinal", "entity_id").agg(F.min("place").alias("near"))
    picked = seen.join(near, ["doc_path", "ordinal", "entity_id"], "left")
    target = F.coalesce(F.col("near")["least"]["target_id"], F.col("only_id"))
    return picked.where(target.isNotNull()).select(*_link(F.col("entity_id"), target, "references", 0.6, INFERRED, rule="global_reference_resolution"))


def cochange(commit_files: DataFrame) -> DataFrame:
    """Files that change together: ``(commit, path)`` rows of present files, commits of 2 to 20 files.

    The bound on a commit's files bounds the pairs of each commit.
    """
    low, high = COCHANGE_FILES
    each = commit_files.distinct()
    # Counts first, so that a huge commit is never gathered.
    sizes = each.groupBy("commit").agg(F.count("*").alias("n")).where(f"n between {low} and {high}").select("commit")
    sized = each.join(sizes, "commit")
    pairs = sized.alias("x").join(sized.alias("y"), "commit").where("x.path < y.path").groupBy(F.col("x.path").alias("a"), F.col("y.path").alias("b")).agg(F.count("*").alias("n"))
    return pairs.select(*_link(F.col("a"), F.col("b"), "co_changed", F.least(F.round(F.lit(0.3) + F.lit(0.1) * F.col("n"), 6), F.lit(1.0)), INFERRED))
