"""Trees, git, extraction, snapshots and the whole build."""

import io
import json
import os
import random
import subprocess
import zipfile

import pytest

from graphloom import config
from graphloom.__main__ import serve
from graphloom.api import GraphApi
from graphloom.build import BuildOptions, build
from graphloom.operators.extract import TEXT_FORMATS, code, extract_file
from graphloom.plans import report
from graphloom.sources import snapshot, tree

SAMPLES = {
    "golang": 'package main\nimport (\n "fmt"\n)\ntype Dog struct { n int }\nfunc (d *Dog) Bark() { helper() }\nfunc helper() {}\n',
    "python": "import os.path\nclass A:\n    def f(self):\n        g()\ndef g(): pass\n",
    "rust": "use crate::a::B;\nstruct P;\nimpl P { fn new() { helper() } }\nfn helper() {}\n",
    "java": "package a.b;\nimport java.util.List;\nclass Foo { void run(int x) { help(); } void help() { } Bar b; }\n",
    "kotlin": "package a.b\nimport x.Z\nclass C(val r: Repo) {\n fun f() { g() }\n fun g() = 1\n}\n",
    "php": "<?php\nnamespace X;\nuse A\\{B, C};\nclass K { function f() { g(); } }\nfunction g() {}\n",
    "csharp": "using System;\nnamespace N {\n class C {\n  int F() { return G(); }\n  int G() => 1;\n }\n}\n",
    "swift": "import UIKit\nclass A { func f() { g() }\n func g() {} }\n",
    "ruby": "require 'json'\nmodule M\n  class C\n    def f\n      g()\n    end\n    def g; end\n  end\nend\n",
    "elixir": "defmodule Geo.S do\n  alias Geo.U\n  def a(x) do\n    b(x)\n  end\n  defp b(x), do: x\nend\n",
    "c": '#include "my.h"\nstruct S { int a; };\nint add(int a) { return a; }\nint main(void) { return add(1); }\n',
    "cpp": '#include "a.hpp"\nnamespace geo {\nclass Circle {\n double area() { return calc(); }\n double calc() { return 1; }\n};\n}\n',
    "bash": "foo() {\n echo\n}\nbar() {\n foo\n}\n",
    "sql": "CREATE TABLE u (id int);\nCREATE TABLE o (x int REFERENCES u(id));\n",
    "javascript": "import x from './m';\nexport function f() { g(); }\nconst g = () => 1;\nclass A {\n  m() { f(); }\n}\n",
    "typescript": "import {T} from '@/t';\nexport interface I { a: string }\ntype U = I;\nexport const h = (x: number): void => { j(x); };\nfunction j(x: number) {}\n",
    "markdown": "# T\n\n[a](b.md) ![i](p.png) [ref]\n\nSub\n---\n```\n# no\n```\n[ref]: http://x\n",
    "json": '{"a": 1, "b": {"c": [1]}, "": null}',
    "yaml": "a: 1\nb:\n  c:\n    - p\n    - q: 1\n",
    "toml": "x = 1\n[t]\ny = 'a'\n",
    "dockerfile": "FROM alpine:3\nRUN a \\\n && b\n",
    "make": "CC = gcc\nall: a b\n\tgcc\n.PHONY: all\n",
}
WANT = {
    "golang": {("package", "main"), ("import", "fmt"), ("struct", "Dog"), ("method", "Dog.Bark"), ("function", "helper")},
    "python": {("import", "os.path"), ("class", "A"), ("method", "A.f"), ("function", "g")},
    "rust": {("import", "crate::a::B"), ("struct", "P"), ("method", "P.new"), ("function", "helper")},
    "java": {("package", "a.b"), ("import", "java.util.List"), ("class", "Foo"), ("reference", "Bar")},
    "kotlin": {("package", "a.b"), ("import", "x.Z"), ("class", "C"), ("method", "C.f"), ("method", "C.g"), ("reference", "Repo")},
    "php": {("package", "X"), ("import", "A\\B"), ("import", "A\\C"), ("class", "K"), ("method", "K.f"), ("function", "g")},
    "csharp": {("import", "System"), ("package", "N"), ("class", "C"), ("method", "C.F"), ("method", "C.G")},
    "swift": {("import", "UIKit"), ("class", "A"), ("method", "A.f"), ("method", "A.g")},
    "ruby": {("import", "json"), ("module", "M"), ("class", "M.C"), ("method", "M.C.f"), ("method", "M.C.g")},
    "elixir": {("module", "Geo.S"), ("package", "Geo"), ("import", "Geo.U"), ("function", "Geo.S.a"), ("function", "Geo.S.b")},
    "c": {("import", "my.h"), ("struct", "S"), ("function", "add"), ("function", "main")},
    "cpp": {("import", "a.hpp"), ("namespace", "geo"), ("class", "geo.Circle"), ("method", "geo.Circle.area"), ("method", "geo.Circle.calc")},
    "bash": {("function", "foo"), ("function", "bar")},
    "sql": {("table", "u"), ("table", "o")},
    "javascript": {("import", "./m"), ("function", "f"), ("function", "g"), ("class", "A"), ("method", "A.m"), ("export", "f")},
    "typescript": {("import", "@/t"), ("interface", "I"), ("type-alias", "U"), ("function", "h"), ("function", "j"), ("export", "h")},
    "markdown": {("heading", "T"), ("link", "a"), ("image-asset", "i"), ("link", "ref"), ("heading", "Sub"), ("reference", "ref")},
    "json": {("property", "a"), ("object", "b"), ("array", "b.c"), ("property", "(empty)")},
    "yaml": {("property", "a"), ("object", "b"), ("array", "b.c"), ("sequence-item", "p"), ("property", "b.c[1].q")},
    "toml": {("property", "x"), ("table", "t"), ("property", "t.y")},
    "dockerfile": {("instruction", "FROM"), ("instruction", "RUN")},
    "make": {("variable", "CC"), ("target", "all")},
}


@pytest.mark.parametrize("name", SAMPLES)
def test_extract(name):
    found = extract_file("d/x", name, SAMPLES[name].encode())
    assert WANT[name] <= {(e["type"], e["name"]) for e in found.entities}
    if name in ("golang", "python", "rust", "kotlin", "php", "csharp", "swift", "ruby", "elixir", "c", "cpp", "bash", "javascript", "typescript"):
        assert any(x["type"] == "calls" for x in found.links)
    if name == "sql":
        assert [x["type"] for x in found.links] == ["references"]


@pytest.mark.parametrize("name", [*code.LANGUAGES, "python", "sql", *TEXT_FORMATS])
def test_extract_any_text(name):
    r, text = random.Random(1), SAMPLES.get(name, SAMPLES["typescript"])
    for i in range(40):
        s = "".join(r.sample(text, len(text))) if i % 3 == 0 else text[: r.randrange(len(text) + 1)]
        found = extract_file("d/x", name, s.encode())
        assert found == extract_file("d/x", name, s.encode())
        assert all(e["entity_id"] and e["name"] for e in found.entities)
    assert extract_file("d/x", name, b"").entities == [] and extract_file("d/x", name, None).entities == []


def test_tables_and_pages():
    found = extract_file("a.csv", "spreadsheet", b"x,y\n1\n\n2,3,4\n").entities[0]["metadata"]
    assert (found["rows"], found["columns"], found["header"]) == ("3", "3", "x,y")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>h</t></is></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>')
    sheet = extract_file("a.xlsx", "spreadsheet", buffer.getvalue()).entities[0]
    assert sheet["name"] == "S1" and sheet["metadata"]["columns"] == "3"
    assert extract_file("a.xls", "spreadsheet", b"x").entities == [] and extract_file("a.xlsx", "spreadsheet", b"x").entities == []
    page = extract_file("a.pdf", "pdf", b"stream\nBT (Hello \\(you\\)) Tj ET\nendstream stream\nBT ET\nendstream").entities
    assert [(e["name"], e["metadata"]["word_count"], e["metadata"]["excerpt"]) for e in page] == [("page 1", "2", "Hello (you)")]


def test_languages_and_skips():
    want = {"a.go": "golang", "Dockerfile": "dockerfile", "x/Makefile": "make", "A.TSX": "tsx", "b.pyi": "python", "noext": "unstructured", "q.md": "markdown", "Gemfile": "ruby", "s.h": "c"}
    assert {p: tree.detect_language(p) for p in want} == want
    assert tree.skipped("x/.git", True) and tree.skipped("a.PNG", False) and tree.skipped("go.sum", False) and not tree.skipped("png", False)


def make(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


def test_ignore_rules(tmp_path):
    make(tmp_path, {".gitignore": "*.log\n!keep.log\n/only\nbuild/\n", "a.log": "", "keep.log": "", "only/x": "", "sub/only/y": "", "build/z": "", "sub/build": "", "sub/.gitignore": "!a.log\n", "sub/a.log": "", "__init__.py": "", ".github/w.yml": "", "v.tmp": ""})
    os.symlink(tmp_path / "a.log", tmp_path / "link.py")
    seen = {p for p, _, _ in tree.walk(str(tmp_path), ["*.tmp"])}
    assert seen == {".gitignore", "keep.log", "sub/only/y", "sub/build", "sub/.gitignore", "sub/a.log", "__init__.py", ".github/w.yml"}


PROJECT = {
    "main.go": 'package main\nimport "proj/internal/ir"\ntype GraphBuilder struct {\n a int\n}\nfunc main() { run() }\nfunc run() {}\n',
    "internal/ir/types.go": "package ir\ntype Builder interface {\n}\n",
    "web/a.ts": "import {b} from './b';\nexport function f() { return b(); }\n",
    "web/b.ts": "export const b = () => 1;\n",
    "docs/builder.md": "# Builder\n[x](y)\n",
}


def test_build_and_ask(spark, tmp_path):
    make(tmp_path / "p", PROJECT)
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "p"), *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", "one")
    out = str(tmp_path / "out")
    g = build(spark, BuildOptions(str(tmp_path / "p"), out, embed=True, dimensions=64))
    kinds = {(r["source_id"], r["target_id"], r["type"]) for r in g.links.collect()}
    assert ("main.go", "package:internal/ir", "imports") in kinds and ("web/a.ts", "web/b.ts", "imports") in kinds
    assert ("main.go#GraphBuilder", "internal/ir/types.go#Builder", "implements") in kinds and ("main.go", "web/a.ts", "co_changed") in kinds
    api = GraphApi(g)
    assert api.document_details("main.go").first()["degree"] == 1
    assert {r["path"] for r in api.documents_by_format("GoLang").collect()} == {"main.go", "internal/ir/types.go"}
    assert api.entities_by_type("Interface").count() == 1 and api.document_links("web/a.ts").where("type = 'imports'").count() == 1
    assert api.cluster("directory:web").count() == 2 and api.clusters("module").count() == 2
    text = report.markdown(g.documents, g.links, g.metrics, g.clusters)
    assert "| golang | 2 |" in text and "</script" in report.page(g.documents, g.links, g.metrics)
    answers = io.StringIO()
    serve(api, ['{"id": 1, "method": "tools/call", "params": {"name": "list_clusters"}}\n', '{"id": 2, "method": "tools/call", "params": {"name": "nope"}}\n', "not json\n"], answers)
    replies = [json.loads(x) for x in answers.getvalue().splitlines()]
    assert len(replies[0]["result"]["rows"]) > 3 and "error" in replies[1] and "error" in replies[2]
    make(tmp_path / "p", {"web/c.ts": "import './a';\n"})
    os.remove(tmp_path / "p" / "docs/builder.md")
    again = build(spark, BuildOptions(str(tmp_path / "p"), out, changed_only=True))
    assert {r["path"] for r in again.documents.collect()} == {*PROJECT, "web/c.ts"} - {"docs/builder.md"}
    assert {(r["source_id"], r["type"]) for r in again.links.collect()} >= {("main.go#function:main", "calls"), ("web/c.ts", "imports")}
    snapshot.to_json(again.tables(), str(tmp_path / "g.json"))
    back = snapshot.from_json(spark, str(tmp_path / "g.json"))
    assert back["documents"].count() == again.documents.count() and back["entities"].count() == again.entities.count()
    with open(tmp_path / "bad.json", "w") as f:
        json.dump({"documents": {"a": {}}, "links": [], "extra": 1}, f)
    with pytest.raises(snapshot.SnapshotError):
        snapshot.from_json(spark, str(tmp_path / "bad.json"))


def test_config(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("GRAPHLOOM_DIMENSIONS=12\nGRAPHLOOM_DB_ROOT='x'\n")
    (tmp_path / "c.toml").write_text('dimensions = 7\nmodel_path = "m"\n')
    monkeypatch.setenv("GRAPHLOOM_DB_ROOT", "env")
    got = config.resolve({}, str(tmp_path), str(tmp_path / "c.toml"))
    assert (got.dimensions, got.db_root, got.model_path) == (12, "env", "m")
    assert config.resolve({"dimensions": 3}, str(tmp_path)).dimensions == 3
