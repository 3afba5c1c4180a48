"""Operators over source files, each on a fixed tree of small files; the expected rows are written out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import imports
from graphloom.operators import extract, links
from graphloom.sources import tree

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The fixed tree: path and text.
TREE = {
    "app/main.go": 'package main\n\nimport (\n\t"fmt"\n\tlog "proj/internal/log"\n)\n\ntype Server struct {\n\tport int\n}\n\ntype Handler interface {\n\tServe()\n}\n\nfunc (s *Server) Start() {\n\tprepare()\n}\n\nfunc prepare() {\n\tfmt.Println("x")\n}\n',
    "app/tool.py": "import json\nfrom os.path import join\n\nclass Tool:\n    def run(self):\n        helper()\n\ndef helper():\n    return json.dumps({})\n",
    "app/shape.rs": "use crate::base::Unit;\n\nstruct Circle { r: f64 }\n\nenum Kind { A, B }\n\ntrait Area {}\n\nimpl Circle {\n    fn area(&self) -> f64 { square(1.0) }\n}\n\nfn square(x: f64) -> f64 { x * x }\n",
    "app/Order.java": "package shop.core;\n\nimport java.util.List;\n\npublic class Order {\n    void pay() { check(); }\n    void check() { }\n}\n\ninterface Payable { }\n",
    "app/Cart.kt": "package shop.ui\n\nimport shop.core.Order\n\nclass Cart {\n    fun add() { total() }\n    fun total() = 1\n}\n\nobject Registry\n",
    "app/page.php": "<?php\nnamespace Web;\n\nuse Lib\\Tools\\Clock;\n\ninterface Shown { }\n\nclass Page {\n    function show() { render(); }\n}\n\nfunction render() { return 1; }\n",
    "app/Bank.cs": "using System.IO;\n\nnamespace Money.Core {\n    class Bank {\n        int Sum() { return Part(); }\n        int Part() { return 1; }\n    }\n    struct Coin { }\n}\n",
    "app/View.swift": "import UIKit\n\nprotocol Shown { }\n\nclass View {\n    func draw() { fill() }\n    func fill() { }\n}\n",
    "app/job.rb": "require 'json'\nrequire_relative 'base'\n\nmodule Work\n  class Job\n    def run\n      step(1)\n    end\n\n    def step(n)\n    end\n  end\nend\n",
    "app/geo.ex": "defmodule Geo.Area do\n  alias Geo.Unit\n\n  def size(x) do\n    twice(x)\n  end\n\n  defp twice(x) do\n    x * 2\n  end\nend\n",
    "app/sum.c": '#include <stdio.h>\n#include "sum.h"\n\nstruct Point { int x; };\n\nint add(int a, int b) { return a + b; }\n\nint main(void) { return add(1, 2); }\n',
    "app/box.cpp": '#include "box.hpp"\n\nnamespace geo {\nclass Box {\n    double size() { return side(); }\n    double side() { return 1.0; }\n};\n}\n',
    "app/run.sh": "build() {\n  echo b\n}\n\ndeploy() {\n  build\n}\n",
    "app/schema.sql": "CREATE TABLE users (id INT PRIMARY KEY);\nCREATE TABLE orders (id INT, user_id INT REFERENCES users(id));\n",
    "app/ui.js": "import x from './model';\n\nexport function show() { paint(); }\n\nfunction paint() { }\n\nclass Panel {\n  open() { show(); }\n}\n",
    "app/api.ts": "import { Row } from '@/rows';\n\nexport interface Reply { code: number }\n\ntype Id = string;\n\nenum Mode { On, Off }\n\nfunction send(x: Id) { }\n",
    "docs/guide.md": "# Guide\n\nRead [more](more.md) and see ![plan](plan.png).\n\n```\n# not a heading\n```\n\n## Use\n",
    "conf/a.json": '{"name": "x", "tags": ["p"], "deep": {"on": true}}',
    "conf/b.yaml": "name: x\ndeep:\n  on: true\n",
    "conf/c.toml": "name = \"x\"\n\n[deep]\non = true\n",
    "Dockerfile": "FROM alpine:3\nRUN echo x\nCMD [\"sh\"]\n",
    "Makefile": "CC = gcc\n\nall: main\n\t$(CC) main.c\n\n.PHONY: all\n",
    "data/t.csv": "a,b\n1,2\n\n3,4\n",
    "notes": "nothing is read from this\n",
}
#: What each file holds: entities by type and name, and links by type and the names of their ends.
HOLDS = {
    "golang": ("app/main.go", "package main|import fmt|import proj/internal/log|struct Server|interface Handler|method Server.Start|function prepare", "calls Server.Start prepare"),
    "python": ("app/tool.py", "import json|import os.path|class Tool|method Tool.run|function helper", "calls Tool.run helper"),
    "rust": ("app/shape.rs", "import crate::base::Unit|struct Circle|enum Kind|trait Area|method Circle.area|function square", "calls Circle.area square"),
    "java": ("app/Order.java", "package shop.core|import java.util.List|class Order|method Order.pay|method Order.check|interface Payable", "calls Order.pay Order.check"),
    "kotlin": ("app/Cart.kt", "package shop.ui|import shop.core.Order|class Cart|method Cart.add|method Cart.total|object Registry", "calls Cart.add Cart.total"),
    "php": ("app/page.php", "package Web|import Lib\\Tools\\Clock|interface Shown|class Page|method Page.show|function render", "calls Page.show render"),
    "csharp": ("app/Bank.cs", "import System.IO|package Money.Core|class Bank|method Bank.Sum|method Bank.Part|struct Coin", "calls Bank.Sum Bank.Part"),
    "swift": ("app/View.swift", "import UIKit|protocol Shown|class View|method View.draw|method View.fill", "calls View.draw View.fill"),
    "ruby": ("app/job.rb", "import json|import base|module Work|class Work.Job|method Work.Job.run|method Work.Job.step", "calls Work.Job.run Work.Job.step"),
    "elixir": ("app/geo.ex", "module Geo.Area|package Geo|import Geo.Unit|function Geo.Area.size|function Geo.Area.twice", "calls Geo.Area.size Geo.Area.twice"),
    "c": ("app/sum.c", "import stdio.h|import sum.h|struct Point|function add|function main", "calls main add"),
    "cpp": ("app/box.cpp", "import box.hpp|namespace geo|class geo.Box|method geo.Box.size|method geo.Box.side", "calls geo.Box.size geo.Box.side"),
    "bash": ("app/run.sh", "function build|function deploy", "calls deploy build"),
    "sql": ("app/schema.sql", "table users|table orders", "references orders users"),
    "javascript": ("app/ui.js", "import ./model|export show|function show|function paint|class Panel|method Panel.open", "calls show paint|calls Panel.open show|exports show show"),
    "typescript": ("app/api.ts", "import @/rows|interface Reply|type-alias Id|enum Mode|function send", ""),
    "markdown": ("docs/guide.md", "heading Guide|link more|image-asset plan|heading Use", ""),
    "json": ("conf/a.json", "property name|array tags|object deep|property deep.on", ""),
    "yaml": ("conf/b.yaml", "property name|object deep|property deep.on", ""),
    "toml": ("conf/c.toml", "property name|table deep|property deep.on", ""),
    "dockerfile": ("Dockerfile", "instruction FROM|instruction RUN|instruction CMD", ""),
    "make": ("Makefile", "variable CC|target all", ""),
    "spreadsheet": ("data/t.csv", "data-table t.csv", ""),
    "unstructured": ("notes", "", ""),
}


def _values(rows: list[tuple], names: str) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    if not rows:
        return "SELECT " + ", ".join(f"''::VARCHAR AS {n}" for n in names.split(", ")) + " WHERE false"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({names})"


def _files(spark: SparkSession, *paths: str) -> DataFrame:
    rows = [(p, tree.detect_language(p), len(TREE[p].encode()), None, bytearray(TREE[p].encode())) for p in paths or TREE]
    return spark.createDataFrame(rows, "path string, language string, size bigint, updated_at timestamp, content binary")


def _extract_query(path: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        _, entities, found = extract.extract(_files(spark, path))
        name = lambda c: F.regexp_extract(c, r"([^/#]*?)$", 1)
        last = lambda c: F.regexp_replace(name(c), "^[a-z-]+:", "")
        holds = entities.select(F.lit("entity").alias("row"), "type", F.col("name").alias("a"), F.lit("").alias("b"))
        return holds.unionByName(found.select(F.lit("link").alias("row"), "type", last("source_id").alias("a"), last("target_id").alias("b"))).distinct()

    return run


for _name, (_path, _entities, _links) in HOLDS.items():
    _rows = [("entity", *e.split(" ", 1), "") for e in _entities.split("|") if e] + [("link", *x.split(" ")) for x in _links.split("|") if x]
    QUERIES[f"extract_{_name}"] = _extract_query(_path)
    ORACLE_SQL[f"extract_{_name}"] = _values(_rows, "row, type, a, b")


def language_detection(spark: SparkSession, d: str) -> DataFrame:
    """The format of every file of the tree, from its name."""
    return _files(spark).select("path", F.col("language").alias("format"))


QUERIES["language_detection"] = language_detection
ORACLE_SQL["language_detection"] = _values([(path, name) for name, (path, _, _) in HOLDS.items()], "path, format")

#: Files, and imports of them: path, format, import, kind of include, and the file that it means.
KNOWN = {
    "web/a.ts": "typescript", "web/b.ts": "typescript", "lib/index.js": "javascript", "src/util/x.ts": "typescript", "src/com/acme/Repo.kt": "kotlin", "k/C.kt": "kotlin",
    "c/m.c": "c", "c/h.h": "c", "inc/deep/z.h": "c", "r/main.rs": "rust", "r/shapes.rs": "rust", "lib/geometry/shapes.ex": "elixir", "e/a.ex": "elixir",
}
ASKED = [
    ("web/a.ts", "./b", "", "web/b.ts", "exact"), ("web/a.ts", "../lib", "", "lib/index.js", "exact"), ("web/a.ts", "@/util/x", "", "src/util/x.ts", "suffix_match"),
    ("web/a.ts", "react", "", "", ""), ("web/b.ts", "./b", "", "", ""), ("k/C.kt", "com.acme.Repo", "", "src/com/acme/Repo.kt", "suffix_match"),
    ("c/m.c", "h.h", "local", "c/h.h", "exact"), ("c/m.c", "deep/z.h", "local", "inc/deep/z.h", "suffix_match"), ("c/m.c", "stdio.h", "system", "", ""),
    ("r/main.rs", "crate::shapes::Circle", "", "r/shapes.rs", "suffix_match"), ("e/a.ex", "Geometry.Shapes", "", "lib/geometry/shapes.ex", "suffix_match"),
]


def file_imports(spark: SparkSession, d: str) -> DataFrame:
    """Imports resolved to files, exactly or by the longest suffix; bare and own ones to none."""
    docs = spark.createDataFrame(list(KNOWN.items()), "path string, format string")
    asked = [(p, i, f"{p}#{i}", "import", name, {"include_kind": kind} if kind else {}) for i, (p, name, kind, _, _) in enumerate(ASKED)]
    entities = spark.createDataFrame(asked, "doc_path string, ordinal int, entity_id string, type string, name string, metadata map<string,string>")
    found = links.file_imports(docs, entities)
    return found.select("source_id", "target_id", F.col("metadata")["import_path"].alias("import_path"), F.col("metadata")["resolution"].alias("resolution"), "weight", "source_type")


QUERIES["file_imports"] = file_imports
ORACLE_SQL["file_imports"] = _values(
    [(p, t, name, how, 1.0 if how == "exact" else 0.8, "extracted" if how == "exact" else "inferred") for p, name, _, t, how in ASKED if t],
    "source_id, target_id, import_path, resolution, weight, source_type",
).replace("SELECT *", "SELECT * REPLACE (weight::DOUBLE AS weight)")


def lexical_imports(spark: SparkSession, d: str) -> DataFrame:
    """Import statements of the tree's files found by patterns, the ground truth that extraction is measured by."""
    files = _files(spark).select("path", F.col("language").alias("format"), F.col("content").cast("string").alias("text"))
    return imports.lexical_imports(files).select("path", "format", "name")


QUERIES["lexical_imports"] = lexical_imports
ORACLE_SQL["lexical_imports"] = _values(
    [
        ("app/main.go", "golang", "fmt"), ("app/main.go", "golang", "proj/internal/log"), ("app/tool.py", "python", "json"), ("app/tool.py", "python", "os.path"),
        ("app/shape.rs", "rust", "crate::base::Unit"), ("app/Order.java", "java", "java.util.List"), ("app/Cart.kt", "kotlin", "shop.core.Order"), ("app/page.php", "php", "Lib\\Tools\\Clock"),
        ("app/Bank.cs", "csharp", "System.IO"), ("app/View.swift", "swift", "UIKit"), ("app/job.rb", "ruby", "json"), ("app/job.rb", "ruby", "base"), ("app/sum.c", "c", "stdio.h"),
        ("app/sum.c", "c", "sum.h"), ("app/box.cpp", "cpp", "box.hpp"), ("app/ui.js", "javascript", "./model"), ("app/api.ts", "typescript", "@/rows"),
    ],
    "path, format, name",
)


def import_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the lexical imports of each format, how many extraction finds, too."""
    truth = lexical_imports(spark, d)
    _, entities, _ = extract.extract(_files(spark))
    found = entities.where("type = 'import'").select(F.col("doc_path").alias("path"), "name", F.lit(1).alias("hit")).distinct()
    return truth.join(found, ["path", "name"], "left").groupBy("format").agg(F.count("*").alias("n"), F.count("hit").alias("found"))


QUERIES["import_recall"] = import_recall
ORACLE_SQL["import_recall"] = _values([(f, n, n) for f, n in {"golang": 2, "python": 2, "rust": 1, "java": 1, "kotlin": 1, "php": 1, "csharp": 1, "swift": 1, "ruby": 2, "c": 2, "cpp": 1, "javascript": 1, "typescript": 1}.items()], "format, n, found").replace(
    "SELECT *", "SELECT * REPLACE (n::BIGINT AS n, found::BIGINT AS found)"
)
