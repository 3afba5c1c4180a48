"""A source tree as a table of files, with language detection, ignore rules and default noise filters."""

from __future__ import annotations

import datetime
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# File names and extensions of each format, and what is never indexed.
BY_NAME = {
    "dockerfile": "dockerfile", "containerfile": "dockerfile", "makefile": "make", "gnumakefile": "make", "gemfile": "ruby", "rakefile": "ruby", "podfile": "ruby",
    "mix.exs": "elixir",
}
EXTENSIONS = {
    "golang": "go", "pdf": "pdf", "markdown": "md markdown", "spreadsheet": "xlsx xls csv", "json": "json", "yaml": "yaml yml", "toml": "toml",
    "javascript": "js jsx mjs cjs", "python": "py pyi pyw", "rust": "rs", "sql": "sql", "bash": "sh bash", "java": "java", "kotlin": "kt kts", "php": "php",
    "csharp": "cs csx", "swift": "swift", "ruby": "rb gemspec", "elixir": "ex exs", "c": "c h", "cpp": "cpp cc cxx hpp hh hxx", "typescript": "ts mts cts",
    "tsx": "tsx", "dockerfile": "dockerfile", "make": "mk make",
}
BY_EXTENSION = {"." + e: f for f, es in EXTENSIONS.items() for e in es.split()}
SKIP_DIRS = frozenset((".git", ".hg", ".svn"))
SKIP_EXTENSIONS = frozenset(
    "." + e
    for e in (
        "png jpg jpeg gif svg webp ico bmp avif tiff woff woff2 ttf otf eot zip tar gz tgz bz2 xz rar 7z dmg pkg mp4 mov mkv avi webm mp3 wav flac ogg aac "
        "exe dll so dylib bin wasm class jar map"
    ).split()
)
SKIP_NAMES = frozenset(
    (
        "package-lock.json yarn.lock pnpm-lock.yaml bun.lockb bun.lock go.sum cargo.lock gemfile.lock composer.lock poetry.lock flake.lock npm-shrinkwrap.json "
        ".ds_store desktop.ini thumbs.db"
    ).split()
)
CHUNK = 256
COLUMNS = "path string, language string, size bigint, updated_at timestamp, content binary"


def detect_language(path: str) -> str:
    """By file name, then by extension in any case, else ``unstructured``."""
    name = path.rsplit("/", 1)[-1].lower()
    return BY_NAME.get(name) or BY_EXTENSION.get("." + name.rpartition(".")[2] if "." in name else "", "unstructured")


def skipped(path: str, is_dir: bool) -> bool:
    """Version control folders, binaries, assets and lock files."""
    name = path.rsplit("/", 1)[-1].lower()
    if is_dir:
        return name in SKIP_DIRS
    return name in SKIP_NAMES or ("." in name and "." + name.rpartition(".")[2] in SKIP_EXTENSIONS)


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    negated: bool
    dirs_only: bool


def compile_rule(line: str) -> Rule | None:
    """One line of an ignore file, or None for blank lines and comments."""
    line = line.rstrip("\n").rstrip("\r")
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line[0] == "#":
        return None
    negated = line[0] == "!"
    line = line[1:] if negated else line
    line = line[1:] if line[:2] in ("\\#", "\\!") else line
    dirs_only = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.+", i + 3
            continue
        if c == "*":
            out += "[^/]*"
            while line.startswith("*", i + 1):
                i += 1
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            body = line[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(line):
            i += 1
            out += re.escape(line[i])
        else:
            out += re.escape(c)
        i += 1
    return Rule(re.compile(("^" if anchored else "^(?:.*/)?") + out + "$"), negated, dirs_only)


@dataclass(frozen=True)
class RuleSet:
    """Rules of one file; they hold below ``base``, a path relative to the root."""

    base: str
    rules: tuple[Rule, ...]

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """Whether the path is ignored, by the last rule that matches; None where none does."""
        if self.base:
            if not path.startswith(self.base + "/"):
                return None
            path = path[len(self.base) + 1 :]
        for rule in reversed(self.rules):
            if rule.dirs_only and not is_dir:
                continue
            if rule.pattern.match(path):
                return not rule.negated
        return None


def rule_set(base: str, lines: list[str]) -> RuleSet:
    return RuleSet(base, tuple(r for r in map(compile_rule, lines) if r))


def _read_lines(path: str) -> list[str]:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read().split("\n")
    except OSError:
        return []


def walk(root: str, exclude: list[str] = (), ignore_files: list[str] = ()) -> Iterator[tuple[str, int, float]]:
    """``(relative path, size, mtime)`` of files that are not ignored, sorted; symbolic links are skipped.

    The first rule set that says anything decides: the user's patterns, then the user's
    ignore files, then ``.gitignore`` files from the deepest up.  Ignored folders are not
    entered.
    """
    given = [rule_set("", list(exclude))] + [rule_set("", _read_lines(p)) for p in ignore_files]

    def ignored(path: str, is_dir: bool, found: tuple[RuleSet, ...]) -> bool:
        for s in (*given, *reversed(found)):
            v = s.verdict(path, is_dir)
            if v is not None:
                return v
        return False

    work: list[tuple[str, tuple[RuleSet, ...]]] = [("", ())]
    while work:
        rel, found = work.pop()
        full = os.path.join(root, rel) if rel else root
        own = _read_lines(os.path.join(full, ".gitignore"))
        found = (*found, rule_set(rel, own)) if own else found
        for entry in sorted(os.scandir(full), key=lambda e: e.name):
            path = f"{rel}/{entry.name}" if rel else entry.name
            if entry.is_symlink() or skipped(path, entry.is_dir()) or ignored(path, entry.is_dir(), found):
                continue
            if entry.is_dir():
                work.append((path, found))
            elif entry.is_file():
                stat = entry.stat()
                yield path, stat.st_size, stat.st_mtime


class _Chunk(InputPartition):
    def __init__(self, rows: list[tuple[str, int, float]]):
        self.rows = rows


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.exclude = [x for x in options.get("exclude", "").split("\n") if x]
        self.ignore_files = [x for x in options.get("ignorefiles", "").split("\n") if x]
        self.output = os.path.abspath(options["output"]) if options.get("output") else None

    def partitions(self) -> list[InputPartition]:
        rows = [r for r in walk(self.root, self.exclude, self.ignore_files) if os.path.join(self.root, r[0]) != self.output]
        return [_Chunk(rows[i : i + CHUNK]) for i in range(0, len(rows), CHUNK)] or [_Chunk([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path, size, mtime in partition.rows:
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    content = f.read()
            except OSError:
                content = None
            yield path, detect_language(path), size, datetime.datetime.fromtimestamp(mtime, datetime.timezone.utc), content


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(root)``; options: exclude, ignorefiles (by line), output.

    Files are listed on the driver, which holds their names only, and read where the tasks
    run, so the tree has to be on a file system that executors share.  Unlike Spark's file
    sources this one sees names that begin with a dot or an underscore.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def read_tree(spark: SparkSession, root: str, exclude: list[str] = (), ignore_files: list[str] = (), output: str | None = None) -> DataFrame:
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("exclude", "\n".join(exclude)).option("ignorefiles", "\n".join(ignore_files))
    if output:
        reader = reader.option("output", output)
    return reader.load(root)
