"""Markup, data and build formats: Markdown, JSON, YAML, TOML, Dockerfiles, makefiles, tables and PDF pages."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
import zlib
from xml.etree import ElementTree

from graphloom.operators.extract.model import Found, Lines


def markdown(path: str, text: str) -> Found:
    """Headings, links, reference definitions and images outside code fences and HTML blocks."""
    out, defined = Found(path), {}
    rows, fence, block = text.split("\n"), None, False
    kept: list[tuple[int, str]] = []
    for i, row in enumerate(rows, 1):
        mark = re.match(r" {0,3}(`{3,}|~{3,})", row)
        if fence:
            if mark and mark[1].startswith(fence) and not row.strip().strip(fence[0]):
                fence = None
            continue
        if mark:
            fence = mark[1]
            continue
        if block:
            block = bool(row.strip())
            continue
        if re.match(r" {0,3}<(?:[a-zA-Z/!?])", row) and not re.match(r" {0,3}<(?:https?:|mailto:)", row):
            block = True
            continue
        kept.append((i, row))
    counts = {"heading": 0, "link": 0, "image": 0, "ref": 0}

    def add(kind: str, short: str, name: str, line: int, **meta: object) -> None:
        counts[short] += 1
        out.entity(kind, name, line, line, f"{short}-{counts[short]}", **meta)

    for i, row in kept:
        if m := re.match(r" {0,3}\[([^\]]+)\]:\s*<?(\S+?)>?(?:\s|$)", row):
            defined[m[1].lower()] = m[2]
    for n, (i, row) in enumerate(kept):
        if m := re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", row):
            if m[2] and m[2].strip():
                add("heading", "heading", m[2].strip(), i, level=len(m[1]))
        elif re.match(r" {0,3}(=+|-+)[ \t]*$", row) and n and kept[n - 1][0] == i - 1 and kept[n - 1][1].strip() and not re.match(r"\s*([#>|*+-]|\d+[.)])", kept[n - 1][1]):
            add("heading", "heading", kept[n - 1][1].strip(), i - 1, level=1 if row.strip()[0] == "=" else 2)
        if m := re.match(r" {0,3}\[([^\]]+)\]:\s*<?(\S+?)>?(?:\s|$)", row):
            add("reference", "ref", m[1], i, target=m[2])
            continue
        bare = re.sub(r"`[^`]*`", lambda m: " " * len(m[0]), row)
        for m in re.finditer(r"(!?)\[([^\]]*)\](?:\(\s*<?([^)\s>]*)>?[^)]*\)|\[([^\]]*)\])?", bare):
            target = m[3] if m[3] is not None else defined.get((m[4] or m[2]).lower())
            if target is None:
                continue
            add("image-asset" if m[1] else "link", "image" if m[1] else "link", m[2] or target, i, target=target)
    return out


def json_text(path: str, text: str) -> Found:
    """Dotted paths of pairs: scalars as properties, containers as objects and arrays."""
    out, lines = Found(path), Lines(text)
    token = re.compile(r'"(?:\\.|[^"\\])*"|[{}\[\]:,]|[^\s{}\[\]:,"]+')
    stack: list[list] = []
    key = None
    pending = None
    for m in token.finditer(text):
        t = m[0]
        if t == ":" and pending is not None:
            key, pending = pending, None
            continue
        top = stack[-1] if stack else None
        if t in "}]":
            if stack:
                done = stack.pop()
                if done[2] is not None:
                    out.entities[done[2]]["end_line"] = lines.of(m.start())
            key = pending = None
            continue
        if t == ",":
            if top and top[0] == "[":
                top[3] += 1
            key = pending = None
            continue
        if t == ":":
            continue
        if top and top[0] == "{" and key is None and t[0] == '"':
            try:
                name = json.loads(t)
            except ValueError:
                name = t[1:-1]
            pending = (name or "(empty)", lines.of(m.start()))
            continue
        prefix = top[1] if top else ""
        at = None
        if top and top[0] == "{" and key:
            name = f"{prefix}.{key[0]}" if prefix else key[0]
            kind = {"{": "object", "[": "array"}.get(t, "property")
            out.entity(kind, name, key[1], lines.of(m.start()))
            at = len(out.entities) - 1
        else:
            name = f"{prefix}[{top[3]}]" if top and top[0] == "[" else prefix
        if t in "{[":
            stack.append([t, name, at, 0])
        key = pending = None
    return out


def yaml(path: str, text: str) -> Found:
    """Dotted paths by indentation; sequences count their items."""
    out = Found(path)
    rows = [(i, r) for i, r in enumerate(text.split("\n"), 1)]
    stack: list[list] = [[-1, "", 0]]  # indent, name, next item
    skip = None
    for n, (i, row) in enumerate(rows):
        body = row.strip()
        indent = len(row) - len(row.lstrip())
        if skip is not None:
            if not body or indent > skip:
                continue
            skip = None
        if not body or body[0] == "#" or body in ("---", "..."):
            continue
        while body.startswith("- ") or body == "-":
            while stack[-1][0] > indent or (stack[-1][0] == indent and stack[-1][1].endswith("]")):
                stack.pop()
            base = stack[-1]
            name = f"{base[1]}[{base[2]}]"
            number = base[2]
            base[2] += 1
            rest = body[1:].lstrip()
            indent += len(body) - len(rest)
            body = rest
            if not body:
                stack.append([indent - 1, name, 0])
                break
            if re.match(r"""("[^"]*"|'[^']*'|[^\s#:'"{\[][^:]*):(\s|$)""", body) or body.startswith("- "):
                stack.append([indent - 1, name, 0])
            else:
                value = re.sub(r"\s+#.*$", "", body).strip("'\"")
                out.entity("sequence-item", value, i, i, f"sequence-item:{number}")
                body = ""
                break
        m = re.match(r"""("[^"]*"|'[^']*'|[^\s#:'"{\[&*!|>%@][^:#]*?)\s*:(?:\s+(.*)|$)""", body)
        if not m:
            continue
        while stack[-1][0] >= indent:
            stack.pop()
        key = m[1].strip("'\"") or "(empty)"
        value = re.sub(r"(^|\s)#.*$", "", m[2] or "").strip()
        prefix = stack[-1][1]
        name = f"{prefix}.{key}" if prefix else key
        if re.match(r"[|>][+-]?\d*$", value):
            skip = indent
        if value and not re.match(r"[&!]\S+$", value):
            kind = "object" if value[0] == "{" else "array" if value[0] == "[" else "property"
        else:
            following = next((r for _, r in rows[n + 1 :] if r.strip() and r.strip()[0] != "#"), "")
            deeper = len(following) - len(following.lstrip())
            kind = "array" if following.strip()[:1] == "-" and deeper >= indent else "object" if deeper > indent else "property"
        out.entity(kind, name, i, i)
        stack.append([indent, name, 0])
    return out


def toml(path: str, text: str) -> Found:
    """Tables, arrays of tables and keys named ``table.key``."""
    out, table = Found(path), ""
    inside = None
    for i, row in enumerate(text.split("\n"), 1):
        body = row.strip()
        if inside:
            inside = None if inside in body else inside
            continue
        if m := re.match(r"\[\[\s*([^\]]+?)\s*\]\]", body):
            table = m[1]
            out.entity("array", table, i, i)
        elif m := re.match(r"\[\s*([^\]]+?)\s*\]", body):
            table = m[1]
            out.entity("table", table, i, i)
        elif m := re.match(r"""((?:"[^"]*"|'[^']*'|[\w-]+)(?:\s*\.\s*(?:"[^"]*"|'[^']*'|[\w-]+))*)\s*=\s*(.*)""", body):
            key = re.sub(r"""\s*\.\s*""", ".", m[1]).strip("'\"")
            if key:
                name = f"{table}.{key}" if table else key
                out.entity("array" if m[2].startswith("[") else "property", name, i, i)
            for q in ('"""', "'''"):
                if m[2].startswith(q) and q not in m[2][3:]:
                    inside = q
            if m[2].startswith("[") and m[2].count("[") > m[2].count("]"):
                inside = "]"
    return out


def dockerfile(path: str, text: str) -> Found:
    """One entity for each instruction; ``FROM`` names its base image."""
    out, more = Found(path), False
    for i, row in enumerate(text.split("\n"), 1):
        body = row.strip()
        if not body or body[0] == "#":
            continue
        if not more and (m := re.match(r"([A-Za-z]+)\s+(.*)", body)):
            word, meta = m[1].upper(), {}
            if word == "FROM":
                image = next((x for x in m[2].split() if not x.startswith("--")), "")
                meta = {"base_image": image}
            out.entity("instruction", word, i, i, word, **meta)
        more = body.endswith("\\")
    return out


def makefile(path: str, text: str) -> Found:
    """Targets with prerequisites and variables with values; targets that begin with a dot are skipped."""
    out = Found(path)
    for i, row in enumerate(re.sub(r"\\\n", "  ", text).split("\n"), 1):
        if row[:1] in ("\t", "#", ""):
            continue
        if m := re.match(r"(?:export\s+|override\s+)?([A-Za-z_][\w.-]*)\s*(?:\?|:{1,3}|\+|!)?=\s*(.*)", row):
            out.entity("variable", m[1], i, i, value=m[2].strip())
        elif m := re.match(r"([^:=#]+?)\s*::?(?!=)\s*([^;#]*)", row):
            for name in m[1].split():
                if not name.startswith("."):
                    out.entity("target", name, i, i, prerequisites=" ".join(m[2].split()))
    return out


def _data_table(out: Found, kind: str, name: str, rows: list[list[str]], sheet: str | None = None) -> None:
    filled = [r for r in rows if any(str(c).strip() for c in r)]
    meta = {"format": kind, "rows": len(filled), "columns": max(map(len, rows), default=0), "header": ",".join(map(str, rows[0])) if rows else ""}
    if sheet is not None:
        meta["sheet"] = sheet
    out.entity("data-table", name, 1, max(1, len(rows)), "table" if sheet is None else f"table:{sheet}", **meta)


def csv_text(path: str, text: str) -> Found:
    out = Found(path)
    try:
        rows = list(csv.reader(io.StringIO(text), delimiter="\t" if path.lower().endswith(".tsv") else ","))
    except csv.Error:
        return out
    if rows:
        _data_table(out, "csv", path.rsplit("/", 1)[-1], rows)
    return out


def xlsx(path: str, data: bytes) -> Found:
    """One table for each sheet; a file that cannot be read gives none."""
    out, ns = Found(path), "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si"):
                    shared.append("".join(t.text or "" for t in si.iter(f"{ns}t")))
            names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{ns}sheet")]
            sheets = sorted((n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
            for name, part in zip(names, sheets):
                rows = []
                for r in ElementTree.fromstring(z.read(part)).iter(f"{ns}row"):
                    row = []
                    for c in r.iter(f"{ns}c"):
                        at = 0
                        for ch in re.match(r"[A-Z]*", c.get("r") or "")[0]:
                            at = at * 26 + ord(ch) - 64
                        v = c.find(f"{ns}v")
                        value = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                        if c.get("t") == "s" and value.isdigit() and int(value) < len(shared):
                            value = shared[int(value)]
                        row.extend([""] * (max(at, len(row) + 1) - len(row) - 1))
                        row.append(value)
                    rows.append(row)
                _data_table(out, "xlsx", name or part, rows, name or part)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error, ValueError):
        pass
    return out


def pdf(path: str, data: bytes) -> Found:
    """The text of each content stream as a page; blank ones are skipped."""
    out, page = Found(path), 0
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        if b"BT" not in body:
            continue
        page += 1
        words = []
        for t in re.finditer(rb"\((?:\\.|[^\\()])*\)|T[*dDm]|'|\"", body, re.S):
            if t[0][:1] == b"(":
                words.append(re.sub(rb"\\([()\\])", rb"\1", t[0][1:-1]).decode("latin-1"))
            else:
                words.append(" ")
        text = " ".join("".join(words).split())
        if text:
            out.entity("page", f"page {page}", page, page, f"page:{page}", page=page, word_count=len(text.split()), excerpt=text.encode()[:200].decode("utf-8", "ignore"))
    return out
