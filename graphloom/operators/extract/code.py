"""A scanner for programming languages, driven by one specification for each.

Comments and strings are blanked, declarations are found by pattern, and their extents by
matching braces or keywords.  That gives scopes, qualified names, callers and references
without a grammar: a text that does not parse still gives what can be seen in it.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from graphloom.operators.extract.model import Found, Lines

_ID = r"[A-Za-z_$][\w$]*"
_KEYWORDS = frozenset(
    "if for while switch catch return new sizeof typeof await match when guard else do try throw function func fn "
    "fun def class using lock foreach elseif unless until and or not in is as defer go select case print super this self".split()
)


@dataclass(frozen=True)
class Declaration:
    """A pattern with a group ``name``; ``scope`` prefixes what stands inside, ``silent`` gives no entity."""

    kind: str
    pattern: str
    scope: bool = False
    silent: bool = False
    function: bool = False


@dataclass(frozen=True)
class Language:
    declarations: tuple[Declaration, ...]
    imports: tuple[str, ...] = ()
    line_comments: tuple[str, ...] = ("//",)
    block_comments: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: tuple[str, ...] = ('"', "'")
    references: bool = False
    construct: bool = False
    method_in_scope: bool = True
    blocks: str = "braces"
    separator: str = "."
    keywords: frozenset = _KEYWORDS


def _d(kind, pattern, **kw):
    return Declaration(kind, pattern, **kw)


_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|open|override|virtual|async|readonly|unsafe|extern|synchronized|native|default|inline|suspend|data|inner|tailrec|operator|infix|fileprivate|mutating|required|convenience|lazy|weak|new|export|declare)\s+)*"
_TYPE = r"[\w$][\w$.:<>,?\[\]*& ]*?"
_C_FUNC = rf"(?m)^[ \t]*(?:[\w:*&<>,~\[\] \t]+?[ \t*&])(?P<name>~?{_ID}(?:::~?{_ID})*)\s*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)\s*(?:const|noexcept|override|final|\s)*(?=\{{)"
_JS = (
    _d("class", rf"\bclass\s+(?P<name>{_ID})", scope=True),
    _d("function", rf"\bfunction\b\s*\*?\s*(?P<name>{_ID})\s*(?:<[^>(]*>)?\s*\(", function=True),
    _d("function", rf"\b(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:function\b|(?:\([^;{{}}]*?\)|{_ID})\s*(?::[^=;{{}}]+)?=>)", function=True),
    _d("method", rf"(?m)^[ \t]*(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract)\s+)*\*?(?P<name>#?{_ID})\s*(?:<[^>(]*>)?\s*\([^;{{}}]*\)\s*(?::[^;{{}}=]+)?(?=\{{)", function=True),
    _d("variable", rf"\b(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=;]+)?(?=[=;\n])"),
)
_JS_IMPORTS = (r"""\bimport\s+(?:[^'";]*?\bfrom\s*)?['"]([^'"]+)['"]""",)
_TS = (*_JS, _d("interface", rf"\binterface\s+(?P<name>{_ID})", scope=False), _d("type-alias", rf"(?m)^[ \t]*(?:export\s+|declare\s+)*type\s+(?P<name>{_ID})\s*(?:<[^=]*>)?\s*="), _d("enum", rf"\benum\s+(?P<name>{_ID})"))

LANGUAGES = {
    "golang": Language(
        (
            _d("struct", rf"\btype\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+struct\b"), _d("interface", rf"\btype\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+interface\b"),
            _d("method", rf"\bfunc\s*\(\s*(?:{_ID}\s+)?\*?(?P<owner>{_ID})[^)]*\)\s*(?P<name>{_ID})\s*(?:\[[^\]]*\])?\(", function=True), _d("function", rf"\bfunc\s+(?P<name>{_ID})\s*(?:\[[^\]]*\])?\(", function=True),
        ),
        (r'(?m)^\s*import\s+(?:[\w.]+\s+)?"([^"\n]+)"', r'(?ms)^\s*import\s*\((.*?)\)'), quotes=('"', "`", "'"),
    ),
    "rust": Language(
        (
            _d("function", rf"\bfn\s+(?P<name>{_ID})", function=True), _d("struct", rf"\bstruct\s+(?P<name>{_ID})"), _d("enum", rf"\benum\s+(?P<name>{_ID})"),
            _d("trait", rf"\btrait\s+(?P<name>{_ID})", scope=True), _d("impl", rf"\bimpl\b(?:\s*<[^>]*>)?\s+(?:[\w:<>, ]+?\s+for\s+)?(?P<name>{_ID})", scope=True, silent=True), _d("module", rf"\bmod\s+(?P<name>{_ID})"),
        ),
        (r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+((?:\w+::)*\w+)",), quotes=('"',), keywords=_KEYWORDS - {"new"},
    ),
    "java": Language(
        (
            _d("package", r"(?m)^\s*package\s+(?P<name>[\w.]+)\s*;"), _d("class", rf"\bclass\s+(?P<name>{_ID})", scope=True), _d("interface", rf"(?<!@)\binterface\s+(?P<name>{_ID})", scope=True),
            _d("enum", rf"\benum\s+(?P<name>{_ID})", scope=True), _d("method", rf"(?m)^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?!return\b|new\b|else\b|throw\b){_MODS}(?:<[^>]+>\s+)?(?!return\b|new\b|else\b|throw\b){_TYPE}\s+(?P<name>{_ID})\s*\([^;{{}}]*\)\s*(?:throws\s+[\w.,\s]+)?(?=[{{;])", function=True),
        ),
        (r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",), references=True, construct=True,
    ),
    "kotlin": Language(
        (
            _d("package", r"(?m)^\s*package\s+(?P<name>[\w.]+)"), _d("enum", rf"\benum\s+class\s+(?P<name>{_ID})", scope=True), _d("interface", rf"\binterface\s+(?P<name>{_ID})", scope=True),
            _d("class", rf"(?<!enum )\bclass\s+(?P<name>{_ID})", scope=True), _d("object", rf"(?<!companion )\bobject\s+(?P<name>{_ID})", scope=True), _d("function", rf"\bfun\s+(?:<[^>]+>\s*)?(?:[\w<>?]+\.)?(?P<name>{_ID})\s*\(", function=True),
        ),
        (r"(?m)^\s*import\s+([\w.]+)",), references=True,
    ),
    "php": Language(
        (
            _d("package", r"\bnamespace\s+(?P<name>[\w\\]+)\s*[;{]"), _d("class", rf"(?<!::)\bclass\s+(?P<name>{_ID})", scope=True), _d("interface", rf"\binterface\s+(?P<name>{_ID})", scope=True), _d("trait", rf"\btrait\s+(?P<name>{_ID})", scope=True),
            _d("function", rf"\bfunction\s+&?(?P<name>{_ID})\s*\(", function=True),
        ),
        (r"(?m)^\s*use\s+(?:function\s+|const\s+)?([\w\\]+(?:\{[^}]*\})?(?:\s*,\s*[\w\\]+)*)",), line_comments=("//", "#"), construct=True,
    ),
    "csharp": Language(
        (
            _d("package", r"\bnamespace\s+(?P<name>[\w.]+)"), _d("record", rf"\brecord\s+(?:struct\s+|class\s+)?(?P<name>{_ID})", scope=True), _d("class", rf"(?<!record )\bclass\s+(?P<name>{_ID})", scope=True), _d("interface", rf"\binterface\s+(?P<name>{_ID})", scope=True),
            _d("struct", rf"(?<!record )\bstruct\s+(?P<name>{_ID})", scope=True), _d("enum", rf"\benum\s+(?P<name>{_ID})", scope=True),
            _d("method", rf"(?m)^[ \t]*(?:\[[^\]]*\]\s*)*(?!return\b|new\b|else\b|throw\b){_MODS}(?!return\b|new\b|else\b|throw\b|using\b){_TYPE}\s+(?P<name>{_ID})\s*(?:<[^>(]*>)?\([^;{{}}]*\)\s*(?:where[^{{;]*)?(?=[{{;]|=>)", function=True),
        ),
        (r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;",), construct=True,
    ),
    "swift": Language(
        (
            _d("class", rf"\bclass\s+(?!func\b|var\b)(?P<name>{_ID})", scope=True), _d("struct", rf"\bstruct\s+(?P<name>{_ID})", scope=True), _d("enum", rf"\benum\s+(?P<name>{_ID})", scope=True),
            _d("protocol", rf"\bprotocol\s+(?P<name>{_ID})", scope=True), _d("actor", rf"\bactor\s+(?P<name>{_ID})", scope=True), _d("function", rf"\bfunc\s+(?P<name>{_ID})", function=True),
        ),
        (r"(?m)^\s*(?:@\w+\s+)*import\s+(?:(?:class|struct|enum|protocol|func)\s+)?([\w.]+)",), quotes=('"',), references=True,
    ),
    "c": Language(
        (
            _d("struct", rf"\bstruct\s+(?P<name>{_ID})\s*(?=\{{)"), _d("union", rf"\bunion\s+(?P<name>{_ID})\s*(?=\{{)"), _d("enum", rf"\benum\s+(?P<name>{_ID})\s*(?=\{{)"),
            _d("typedef", rf"\btypedef\b[^;{{}}]*?(?:\{{[^{{}}]*\}}[^;{{}}]*?)?\b(?P<name>{_ID})\s*(?:\[[^\]]*\])?;"), _d("function", _C_FUNC, function=True),
        ),
        (r'(?m)^[ \t]*#[ \t]*include[ \t]*([<"][^>"\n]+[>"])',), references=True, method_in_scope=False,
    ),
    "cpp": Language(
        (
            _d("namespace", rf"\bnamespace\s+(?P<name>{_ID}(?:::{_ID})*)", scope=True), _d("class", rf"(?<!enum )\bclass\s+(?P<name>{_ID})\s*(?:final\s*)?(?=[:{{])", scope=True), _d("struct", rf"\bstruct\s+(?P<name>{_ID})\s*(?=[:{{])", scope=True),
            _d("enum", rf"\benum\s+(?:class\s+|struct\s+)?(?P<name>{_ID})\s*(?=[:{{])"), _d("typedef", rf"\btypedef\b[^;{{}}]*?\b(?P<name>{_ID})\s*;"), _d("function", _C_FUNC, function=True),
        ),
        (r'(?m)^[ \t]*#[ \t]*include[ \t]*([<"][^>"\n]+[>"])',), references=True,
    ),
    "ruby": Language(
        (_d("module", r"(?m)^[ \t]*module\s+(?P<name>[\w:]+)", scope=True), _d("class", r"(?m)^[ \t]*class\s+(?P<name>[\w:]+)", scope=True), _d("method", r"(?m)^[ \t]*def\s+(?:self\.)?(?P<name>\w+[?!=]?)", function=True)),
        (r"""(?m)^\s*(?:require|require_relative|load)\s*\(?\s*['"]([^'"]+)['"]""",), line_comments=("#",), block_comments=(("=begin", "=end"),), blocks="end",
    ),
    "elixir": Language(
        (
            _d("module", r"(?m)^[ \t]*defmodule\s+(?P<name>[\w.]+)", scope=True),
            _d("function", r"(?m)^[ \t]*(?:def|defp|defmacro|defmacrop|defguard|defguardp|defdelegate|defn)\s+(?P<name>\w+[?!]?)", function=True),
        ),
        (r"(?m)^\s*(?:alias|import|require|use)\s+([\w.]+)",), line_comments=("#",), block_comments=(('"""', '"""'),), quotes=('"',), method_in_scope=False, blocks="end",
    ),
    "bash": Language((_d("function", r"(?m)^[ \t]*(?:function\s+(?P<name>[\w:-]+)\s*(?:\(\s*\))?|(?P<name2>[\w:-]+)\s*\(\s*\))\s*(?=\{|\n)", function=True),), (), line_comments=("#",), block_comments=(), quotes=("'",)),
    "javascript": Language(_JS, _JS_IMPORTS, quotes=('"', "'", "`")),
    "typescript": Language(_TS, _JS_IMPORTS, quotes=('"', "'", "`")),
}
LANGUAGES["tsx"] = LANGUAGES["typescript"]


def blank(text: str, lang: Language) -> tuple[str, str]:
    """The text without comments, and without comments and strings; lengths and line breaks stay."""
    parts = [re.escape(b) + r"[\s\S]*?(?:" + re.escape(e) + r"|\Z)" for b, e in lang.block_comments]
    parts += [r"(?:(?<=\s)|^)#[^\n]*" if c == "#" else re.escape(c) + r"[^\n]*" for c in lang.line_comments]
    strings = [rf"{q}(?:\\[\s\S]|(?!{q})[\s\S])*(?:{q}|\Z)" if q == "`" else rf"{q}(?:\\.|(?!{q})[^\\\n])*(?:{q}|$)" for q in lang.quotes]
    both = re.compile("(?P<c>" + "|".join(parts or ["(?!)"]) + ")|(?P<s>" + "|".join(strings or ["(?!)"]) + ")", re.M)
    hide = lambda s: re.sub(r"[^\n]", " ", s)
    plain = both.sub(lambda m: hide(m[0]) if m["c"] is not None else m[0], text)
    code = both.sub(lambda m: hide(m[0]) if m["c"] is not None else m[0][0] + hide(m[0][1:-1]) + m[0][-1] if len(m[0]) > 1 else m[0], text)
    return plain, code


def _brace_ends(code: str) -> dict[int, int]:
    """Where the brace that opens at an offset closes; an open one closes at the end."""
    out, stack = {}, []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out | dict.fromkeys(stack, len(code))


def _end_of(code: str, at: int, ends: dict[int, int]) -> int:
    """The end of the block or statement of a declaration whose pattern ends at ``at``."""
    depth = 0
    for i in range(at, len(code)):
        c = code[i]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        elif c == "{" and depth == 0:
            return ends.get(i, len(code))
        elif c == ";" and depth == 0:
            return i
        elif c == "\n" and depth == 0:
            following = code[i:].lstrip()[:1] if i + 1 < len(code) else ""
            if following not in ("{", ".", ":", "=") and code[:i].rstrip()[-1:] not in (",", "=", ":", "(", ">", "|", "&"):
                return i
    return len(code)


def _end_keyword(code: str, start: int) -> int:
    """The line of the ``end`` that is indented like the line of ``start``."""
    line_start = code.rfind("\n", 0, start) + 1
    indent = re.match(r"[ \t]*", code[line_start:])[0]
    first = code.find("\n", start)
    head = code[line_start : first if first >= 0 else len(code)]
    if re.search(r",\s*do:|=\s*\S|;\s*end\b", head):
        return first if first >= 0 else len(code)
    m = re.compile(rf"^{indent}end\b", re.M).search(code, first if first >= 0 else len(code))
    return m.end() if m else len(code)


def scan(path: str, text: str, name: str) -> Found:
    """Entities, calls and references of a source text."""
    if name == "python":
        return scan_python(path, text)
    if name == "sql":
        return scan_sql(path, text)
    lang, out = LANGUAGES[name], Found(path)
    plain, code = blank(text, lang)
    lines, ends = Lines(text), _brace_ends(code)
    marks = []
    for d in lang.declarations:
        for m in re.finditer(d.pattern, code):
            label = m.groupdict().get("name") or m.groupdict().get("name2")
            if label and not (d.function and label in lang.keywords):
                end = _end_keyword(code, m.start("name")) if lang.blocks == "end" else _end_of(code, m.end(), ends)
                marks.append([m.start() + len(m[0]) - len(m[0].lstrip()), end, d, label, m.groupdict().get("owner"), m.span("name" if m.groupdict().get("name") else "name2")])
    marks.sort(key=lambda x: (x[0], -x[1]))
    # Of declarations whose names stand at one place, the first pattern counts.
    seen, kept = set(), []
    for m in sorted(marks, key=lambda x: lang.declarations.index(x[2])):
        if m[5] not in seen:
            seen.add(m[5])
            kept.append(m)
    marks = sorted(kept, key=lambda x: (x[0], -x[1]))
    full, nodes, stack, declared = {}, {}, [], {}
    for i, (start, end, d, label, owner, _) in enumerate(marks):
        while stack and marks[stack[-1]][1] < start:
            stack.pop()
        scope = next((full[j] for j in reversed(stack) if marks[j][2].scope), None)
        kind = d.kind
        if d.kind == "variable" and any(marks[j][2].function for j in stack):
            full[i], nodes[i] = None, None
            continue
        if d.kind == "method" and name in ("javascript", "typescript", "tsx") and not scope:
            full[i], nodes[i] = None, None
            continue
        qualified = label.replace("::", ".") if name == "cpp" else label
        if owner:
            qualified = f"{owner}.{label}"
        elif scope and d.kind not in ("package", "interface" if name == "golang" else ""):
            qualified = f"{scope}.{label}"
            if kind == "function" and lang.method_in_scope and not (name == "cpp" and all(marks[j][2].kind == "namespace" for j in stack if marks[j][2].scope)):
                kind = "method"
        elif kind == "function" and "." in qualified and name == "cpp":
            kind = "method"
        full[i] = qualified
        if not d.silent:
            node = qualified if name == "golang" and kind in ("struct", "interface") else "package" if name == "golang" and kind == "package" else None
            nodes[i] = out.entity(kind, qualified, lines.of(start), lines.of(max(start, end - 1) if end >= len(code) else end), node)
            if name == "elixir" and kind == "module" and not scope:
                out.entity("package", qualified.split(".")[0], lines.of(start), lines.of(start), f"package:{qualified.split('.')[0]}", package_path=qualified.split(".")[0])
            if kind == "package":
                out.entities[-1]["metadata"]["package_path"] = qualified.replace("\\", "/")
            declared.setdefault(qualified, nodes[i])
        if d.scope or d.function:
            stack.append(i)
    if name == "golang" and (m := re.search(r"(?m)^\s*package\s+(\w+)", code)):
        line = lines.of(m.start(1))
        out.entities.insert(0, {"entity_id": f"{path}#package", "type": "package", "name": m[1], "start_line": line, "end_line": line, "metadata": {}})
    _imports(out, name, lang, text, plain, lines)
    if name in ("javascript", "typescript", "tsx"):
        for m in re.finditer(rf"(?m)^[ \t]*export\s+(default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\s*\*?|class|const|let|var)\s+({_ID})", code):
            line = lines.of(m.start(2))
            node = out.entity("export", m[2], line, line)
            if m[2] in declared:
                out.link(node, declared[m[2]], "exports")
    _calls(out, lang, code, marks, full, nodes, declared)
    if lang.references:
        names = {x.rpartition(".")[2] for x in declared} | set(declared)
        taken = [m[5] for m in marks]
        spans = [(e["start_line"]) for e in out.entities if e["type"] in ("import", "package")]
        offset = {}
        for m in re.finditer(r"(?<![\w.])[A-Z]\w*", code):
            if m[0] not in names and m.span() not in taken and lines.of(m.start()) not in spans:
                byte = offset.setdefault(m.start(), len(text[: m.start()].encode("utf-8", "replace")))
                line = lines.of(m.start())
                out.entity("reference", m[0], line, line, f"reference:{m[0]}@{byte}")
    return out


def _imports(out: Found, name: str, lang: Language, text: str, plain: str, lines: Lines) -> None:
    for pattern in lang.imports:
        for m in re.finditer(pattern, plain):
            line, found = lines.of(m.start(1)), [m[1]]
            meta = {}
            if name == "golang" and "\n" in m[0]:
                for one in re.finditer(r'"([^"\n]+)"', m[1]):
                    at = lines.of(m.start(1) + one.start())
                    out.entity("import", one[1], at, at, f"import:{one[1]}")
                continue
            if name == "php" and "{" in m[1]:
                head, _, tail = m[1].partition("{")
                found = [head + x.strip().split(" ")[0] for x in tail.rstrip("}").split(",")]
            elif name == "php":
                found = [x.strip() for x in m[1].split(",")]
            elif name in ("c", "cpp"):
                meta = {"include_kind": "local" if m[1][0] == '"' else "system"}
                found = [m[1][1:-1]]
            for one in found:
                out.entity("import", one, line, line, f"import:{one}", **meta)


def _calls(out: Found, lang: Language, code: str, marks: list, full: dict, nodes: dict, declared: dict) -> None:
    functions = [i for i, m in enumerate(marks) if m[2].function and nodes.get(i)]
    taken = {m[5][0] for m in marks}
    pattern = rf"(?<![\w.$:>@])({_ID}[?!]?)(?=\s*\()" if lang is not LANGUAGES["bash"] else r"(?m)(?:^|[;&|(]|\bthen\b|\bdo\b)[ \t]*([\w:-]+)(?=[\s;)&|]|$)"
    for m in re.finditer(pattern, code):
        if m.start(1) in taken:
            continue
        word = m[1]
        new = lang.construct and re.search(r"\bnew\s+$", code[max(0, m.start(1) - 12) : m.start(1)])
        if word in lang.keywords and not new:
            continue
        inside = [i for i in functions if marks[i][0] <= m.start(1) <= marks[i][1]]
        if not inside:
            continue
        caller = inside[-1]
        scope = full[caller].rpartition(".")[0] if full[caller] else ""
        target = declared.get(word) or (declared.get(f"{scope}.{word}") if scope else None)
        if target:
            out.link(nodes[caller], target, "calls")


def scan_python(path: str, text: str) -> Found:
    """By the standard library's parser; what cannot be parsed is scanned by pattern."""
    out = Found(path)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_by_pattern(path, text)
    declared: dict[str, str] = {}
    calls: list[tuple[str, str, str]] = []
    work = [(n, "", False, None) for n in reversed(tree.body)]
    while work:  # depth first, without recursion
        node, scope, in_class, caller = work.pop()
        inner = (scope, in_class, caller)
        if isinstance(node, ast.ClassDef):
            name = f"{scope}.{node.name}" if scope else node.name
            declared.setdefault(name, out.entity("class", name, node.lineno, node.end_lineno or node.lineno))
            inner = (name, True, caller)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            name = f"{scope}.{node.name}" if in_class else node.name
            at = out.entity("method" if in_class else "function", name, node.lineno, node.end_lineno or node.lineno)
            declared.setdefault(name, at)
            inner = (scope, in_class, (at, scope if in_class else ""))
        elif isinstance(node, ast.Import):
            for a in node.names:
                out.entity("import", a.name, node.lineno, node.lineno, f"import:{a.name}")
        elif isinstance(node, ast.ImportFrom):
            name = "." * node.level + (node.module or "")
            out.entity("import", name, node.lineno, node.lineno, f"import:{name}")
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and caller:
            calls.append((caller[0], node.func.id, caller[1]))
        work.extend((n, *inner) for n in reversed(list(ast.iter_child_nodes(node))))
    for source, word, scope in calls:
        target = declared.get(word) or declared.get(f"{scope}.{word}")
        if target:
            out.link(source, target, "calls")
    return out


def _python_by_pattern(path: str, text: str) -> Found:
    out, lines = Found(path), Lines(text)
    scopes: list[tuple[int, str]] = []
    for m in re.finditer(r"(?m)^(?P<in>[ \t]*)(?:(?P<kind>class|def|async def)\s+(?P<name>\w+)|import\s+(?P<mod>[\w.]+)|from\s+(?P<src>[\w.]+)\s+import)", text):
        depth, line = len(m["in"]), lines.of(m.start())
        while scopes and scopes[-1][0] >= depth:
            scopes.pop()
        if m["kind"] == "class":
            name = ".".join([*(s for _, s in scopes), m["name"]])
            out.entity("class", name, line, line)
            scopes.append((depth, m["name"]))
        elif m["kind"]:
            out.entity("method" if scopes else "function", ".".join([*(s for _, s in scopes), m["name"]]), line, line)
        else:
            out.entity("import", m["mod"] or m["src"], line, line, f"import:{m['mod'] or m['src']}")
    return out


def scan_sql(path: str, text: str) -> Found:
    """Tables, views, indexes and functions, and what they refer to in the same file."""
    out, lines = Found(path), Lines(text)
    lang = Language((), line_comments=("--",))
    _, code = blank(text, lang)
    name = r"[\w\"`\[\]]+(?:\.[\w\"`\[\]]+)*"
    bare = lambda s: re.sub(r'["`\[\]]', "", s)
    kinds = {"table": "table", "view": "view", "index": "index", "function": "function"}
    pattern = rf"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|unique\s+|materialized\s+)*(?P<kind>table|view|index|function)\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?(?P<name>{name})"
    found = []
    for m in re.finditer(pattern, code):
        end = code.find(";", m.end())
        end = len(code) if end < 0 else end
        label = bare(m["name"])
        found.append((label, m["kind"].lower(), out.entity(kinds[m["kind"].lower()], label, lines.of(m.start()), lines.of(end)), code[m.end() : end]))
    tables = {label.lower(): node for label, kind, node, _ in found if kind in ("table", "view")}
    for label, kind, node, body in found:
        asked = {"table": rf"(?i)\breferences\s+({name})", "view": r"(\w+(?:\.\w+)*)", "index": rf"(?i)\bon\s+({name})"}.get(kind)
        for word in dict.fromkeys(bare(m[1]).lower() for m in re.finditer(asked, body)) if asked else ():
            if word in tables and word != label.lower():
                out.link(node, tables[word], "references")
    return out
