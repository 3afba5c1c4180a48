"""HTML extraction by layout-aware rendering.

A forgiving reader turns markup into a stream of element openings, closings and text,
supplying the end tags that HTML lets authors leave out.  Visibility rules (elements that
are never shown, ``hidden``, inline styles, simple rules of the page's own style sheets,
closed details and dialogs) silence subtrees.  What is visible is laid out: inline text is
collapsed, blocks start on lines of their own and keep their margins, list items carry
bullets or numbers and are indented by depth, and the cells of a table are aligned in
columns.  All visible text is emitted, navigation and boilerplate included.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
RAW_WITH_ENTITIES = frozenset(("title", "textarea"))
NEVER = frozenset("head title script style template noscript iframe noembed noframes object canvas audio video datalist rp meta link base param map".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset menu dir xmp listing".split())
BLOCK = MARGIN | frozenset(
    "address article aside body caption center col colgroup dd details dialog div dt fieldset figcaption footer form header hgroup hr html legend li main nav "
    "optgroup option search section select summary tbody td tfoot th thead tr textarea".split()
)
CLOSES_P = BLOCK - frozenset("body html col colgroup td th tr tbody thead tfoot caption option optgroup select textarea legend".split())
#: An opening of the key ends open elements of the first set, unless one of the second stands between.
_CELLS, _ROWS = frozenset(("td", "th")), frozenset(("tr",))
_GROUPS, _LISTS = frozenset(("tbody", "thead", "tfoot", "caption", "colgroup")), frozenset("ul ol menu dir table".split())
_TABLE = frozenset(("table",))
IMPLIED_END = {
    "li": (frozenset(("li",)), _LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "td": (_CELLS | {"caption"}, _TABLE),
    "th": (_CELLS | {"caption"}, _TABLE),
    "tr": (_CELLS | _ROWS | {"caption", "colgroup"}, _TABLE),
    "tbody": (_CELLS | _ROWS | _GROUPS, _TABLE),
    "thead": (_CELLS | _ROWS | _GROUPS, _TABLE),
    "tfoot": (_CELLS | _ROWS | _GROUPS, _TABLE),
    "caption": (_GROUPS, _TABLE),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "rt": (frozenset(("rt", "rp")), frozenset(("ruby",))),
    "rp": (frozenset(("rt", "rp")), frozenset(("ruby",))),
    "body": (frozenset(("head",)), frozenset()),
}
_IN_HEAD = frozenset("html head title base link meta script style noscript template".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+|(?=>)))*+)>", re.S)
_BEGIN = re.compile(r"<(?=[a-zA-Z!?]|/[a-zA-Z])")
_ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_PART = re.compile(r"([^{};]*)([{};]|$)")
_DECLARED = re.compile(r"(?:^|;)\s*(display|opacity|content-visibility|visibility)\s*:\s*([^;!]+)(!\s*important)?", re.I)
_ZERO = re.compile(r"0+(?:\.0*)?%?|\.0+%?")
_WIDTH = re.compile(r"\(\s*(min|max)-width\s*:\s*([0-9.]+)(px|r?em)\s*\)")
#: Pixels of the screen for which style sheets are read.
SCREEN = 1280
_SIMPLE = re.compile(r"([a-zA-Z][a-zA-Z0-9]*)?(?:\.([\w-]+)|#([\w-]+))?$")
GAP = " | "


class _Box:
    """Lines under way inside a container."""

    __slots__ = ("lines", "line", "space", "margin", "kind", "rows", "number", "span")

    def __init__(self, kind: str):
        self.kind, self.lines, self.line, self.space, self.margin = kind, [], [], False, 0
        self.rows, self.number, self.span = [], None, 1

    def flush(self, margin: int = 0) -> None:
        if self.line:
            self._put("".join(self.line).rstrip(" "))
            self.line, self.space = [], False
        self.margin = max(self.margin, margin)

    def _put(self, text: str) -> None:
        if self.margin and self.lines and self.lines[-1] != "":
            self.lines.append("")
        self.margin = 0
        self.lines.append(text)

    def put(self, lines: list[str], margin: int) -> None:
        self.flush(margin)
        if lines:
            self._put(lines[0])
            self.lines.extend(lines[1:])
        self.margin = max(self.margin, margin)

    def inline(self, text: str) -> None:
        if self.space and self.line:
            self.line.append(" ")
        self.space = False
        self.line.append(text)


def _declared(body: str) -> list[tuple[str, bool, bool]]:
    """(property, whether it hides, whether it is important) of the declarations that bear on visibility."""
    out = []
    for name, value, important in _DECLARED.findall(body):
        name, value = name.lower(), value.strip().lower()
        hides = _ZERO.fullmatch(value) is not None if name == "opacity" else value in {"display": ("none",), "visibility": ("hidden", "collapse")}.get(name, ("hidden",))
        out.append((name, hides, bool(important)))
    return out


def _on_screen(query: str) -> bool:
    """Whether one of the media queries holds on a screen of ``SCREEN`` pixels; features other than widths do not."""
    for one in query.lower().split(","):
        rest = _WIDTH.sub(lambda m: "" if (float(m[2]) * (1 if m[3] == "px" else 16) <= SCREEN) == (m[1] == "min") or float(m[2]) * (1 if m[3] == "px" else 16) == SCREEN else "(no)", one)
        if set(rest.split()) <= {"only", "screen", "all", "and"}:
            return True
    return False


def _rules(sheet: str) -> list[tuple[tuple, list]]:
    """((tag, class, id), declarations) of simple selectors, in order; blocks of at-rules that do not hold on screen are left out."""
    out: list[tuple[tuple, list]] = []
    #: For each open block: whether it holds, and its selectors if it is a rule.
    blocks: list[tuple[bool, str | None]] = []
    body: list[str] = []
    for text, mark in _PART.findall(re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)):
        text, holds = text.strip(), not blocks or blocks[-1][0]
        if mark == "{":
            at = text.lower()
            if at.startswith("@media"):
                blocks.append((holds and _on_screen(at[6:]), None))
            elif at.startswith("@"):
                blocks.append((holds and at.startswith(("@layer", "@supports")), None))
            else:
                blocks.append((holds, text))
                body = []
        else:
            body.append(text)
            if mark == "}" and blocks:
                holds, selectors = blocks.pop()
                found = _declared(";".join(body)) if holds and selectors is not None else []
                for one in selectors.split(",") if found else ():
                    m = _SIMPLE.match(one.strip())
                    if m and m[0]:
                        out.append(((m[1] and m[1].lower(), m[2], m[3]), found))
                body = []
    return out


class _Page:
    def __init__(self, source: str):
        self.source = source
        self.boxes = [_Box("page")]
        #: Open elements: name, whether it hides, whether it is unseen, whether it opened a box.
        self.open: list[tuple[str, bool, bool, bool]] = []
        self.count: dict[str, int] = {}
        self.gone = self.pre = 0
        self.unseen = False
        #: By selector and property: importance, order, and whether it hides.
        self.rules: dict[tuple, dict[str, tuple[bool, int, bool]]] = {}
        self.order = 0

    # -- structure

    def run(self) -> str:
        src, at, n = self.source, 0, len(self.source)
        while at < n:
            begin = _BEGIN.search(src, at)
            if begin is None:
                self.text(html.unescape(src[at:]))
                break
            if begin.start() > at:
                self.text(html.unescape(src[at : begin.start()]))
            m = _TOKEN.match(src, begin.start())
            if m is None:  # the page ends inside a tag
                break
            at = m.end()
            name = m["name"]
            if name is None:
                if m["cdata"] is not None and self.count.get("svg", 0) + self.count.get("math", 0):
                    self.text(m["cdata"])
            elif m["end"]:
                self.end(name.lower())
            else:
                name = name.lower()
                attrs = m["attrs"]
                self.start(name, attrs)
                if name in RAW or name in RAW_WITH_ENTITIES:
                    close = re.compile(rf"</{name}(?=[\s/>])[^>]*>|</{name}$", re.I).search(src, at)
                    stop = close.start() if close else n
                    inner = src[at:stop]
                    if name == "style":
                        self.learn(inner)
                    elif name in RAW_WITH_ENTITIES:
                        self.text(html.unescape(inner))
                    elif name == "xmp":
                        self.text(inner)
                    self.end(name)
                    at = close.end() if close else n
                elif name == "plaintext":
                    self.text(src[at:])
                    break
        while self.open:
            self.pop()
        box = self.boxes[0]
        box.flush()
        return "\n".join(box.lines).strip("\n")

    def learn(self, sheet: str) -> None:
        for key, found in _rules(sheet):
            held = self.rules.setdefault(key, {})
            for prop, hides, important in found:
                self.order += 1
                held[prop] = max(held.get(prop, (False, 0, False)), (important, self.order, hides))

    def start(self, name: str, raw: str) -> None:
        if self.count.get("head") and name not in _IN_HEAD:
            self.until("head")
        if name in CLOSES_P and self.count.get("p"):
            self.close_within(frozenset(("p",)), frozenset(("td", "th", "table", "caption", "button", "object")))
        rule = IMPLIED_END.get(name)
        if rule:
            self.close_within(*rule)
        attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(raw)} if raw and not raw.isspace() else {}
        gone, unseen = self.hides(name, attrs)
        if name in VOID:
            if not (gone or self.gone or unseen):
                self.void(name, attrs)
            return
        boxed = False
        if not (gone or self.gone):
            boxed = self.enter(name, attrs)
        self.open.append((name, gone, self.unseen, boxed))
        self.count[name] = self.count.get(name, 0) + 1
        self.gone += gone
        self.unseen = unseen
        if name in ("pre", "textarea", "xmp", "listing"):
            self.pre += 1

    def hides(self, name: str, attrs: dict[str, str]) -> tuple[bool, bool]:
        gone = name in NEVER or (name == "input" and attrs.get("type", "").lower() == "hidden")
        if self.open and self.open[-1][0] == "details" and name != "summary":
            gone = gone or self.boxes[-1].kind == "details-closed"
        #: By property, what wins: importance, specificity, order, and whether it hides.
        won = {"display": (False, -1, 0, "hidden" in attrs or (name == "dialog" and "open" not in attrs))}
        if self.rules:
            classes = attrs.get("class", "").split()
            for key in ((name, None, None), (None, None, attrs.get("id")), (name, None, attrs.get("id")), *((t, c, None) for c in classes for t in (None, name))):
                weight = 100 * (key[2] is not None) + 10 * (key[1] is not None) + (key[0] is not None)
                for prop, (important, order, hides) in self.rules.get(key, {}).items():
                    won[prop] = max(won.get(prop, (False, -2, 0, False)), (important, weight, order, hides))
        for order, (prop, hides, important) in enumerate(_declared(attrs.get("style", ""))):
            won[prop] = max(won.get(prop, (False, -2, 0, False)), (important, 1000, order, hides))
        unseen = won.pop("visibility", (False, 0, 0, self.unseen))[3]
        gone = gone or any(w[3] for w in won.values())
        return gone, unseen

    def close_within(self, ends: frozenset, stops: frozenset) -> None:
        """Close the nearest open elements of ``ends`` above the nearest one of ``stops``."""
        if not any(self.count.get(e) for e in ends):
            return
        deepest = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in stops:
                break
            if self.open[i][0] in ends:
                deepest = i
        if deepest is not None:
            while len(self.open) > deepest:
                self.pop()

    def until(self, name: str) -> None:
        while self.open and self.pop() != name:
            pass

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
        elif self.count.get(name):
            if name not in _TABLE and self.count.get("table") and not self.inside_table(name):
                return
            self.until(name)
        elif name == "p":
            self.start("p", "")
            self.end("p")

    def inside_table(self, name: str) -> bool:
        """Whether an open element of this name lies within the innermost table cell or is part of its table."""
        for open_name, *_ in reversed(self.open):
            if open_name == name:
                return True
            if open_name == "table":
                return False
        return True

    def pop(self) -> str:
        name, gone, unseen, boxed = self.open.pop()
        self.count[name] -= 1
        self.unseen = unseen
        if name in ("pre", "textarea", "xmp", "listing"):
            self.pre -= 1
        if gone:
            self.gone -= 1
        elif not self.gone:
            self.leave(name, boxed)
        return name

    # -- layout

    def text(self, text: str) -> None:
        if self.gone or self.unseen or not text:
            return
        if self.open and self.open[-1][0] == "details" and self.boxes[-1].kind == "details-closed":
            return
        box = self.boxes[-1]
        if box.kind in ("table", "row") or (self.open and self.open[-1][0] in ("table", "tbody", "thead", "tfoot", "tr", "select")):
            if not text.strip():
                return
            if box.kind in ("table", "row"):  # stray text of a table stands before it
                box = next(b for b in reversed(self.boxes) if b.kind not in ("table", "row"))
        if self.pre:
            first, *more = text.expandtabs(8).split("\n")
            box.line.append(first)
            for part in more:
                if box.line and box.line != [""] or box.lines:
                    box._put("".join(box.line).rstrip())
                box.line = [part]
            return
        words = _SPACE.sub(" ", text)
        if words.startswith(" "):
            box.space, words = bool(box.line), words[1:]
        if words:
            trail = words.endswith(" ")
            box.inline(words[:-1] if trail else words)
            box.space = trail

    def void(self, name: str, attrs: dict[str, str]) -> None:
        box = self.boxes[-1]
        if name == "br":
            box._put("".join(box.line).rstrip(" "))
            box.line, box.space = [], False
        elif name == "hr":
            box.put(["---"], 1)
        elif name == "wbr":
            pass
        elif name == "input" and attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number") and attrs.get("value"):
            self.text(attrs["value"])

    def enter(self, name: str, attrs: dict[str, str]) -> bool:
        box = self.boxes[-1]
        if name not in BLOCK:
            return False
        if name in ("td", "th") and box.kind == "row":
            new = _Box("cell")
            span = attrs.get("colspan", "1")
            new.span = min(int(span), 1000) if span.isdigit() and int(span) else 1
        elif name in ("td", "th") and box.kind == "table":
            row = _Box("row")  # a cell without its row
            self.boxes.append(row)
            self.open.append(("tr", False, self.unseen, True))
            self.count["tr"] = self.count.get("tr", 0) + 1
            return self.enter(name, attrs)
        elif name == "tr" and box.kind == "table":
            new = _Box("row")
        elif name == "table":
            box.flush(1)
            new = _Box("table")
        elif name == "caption" and box.kind == "table":
            new = _Box("caption")
        elif name in ("ul", "ol", "menu", "dir"):
            nested = box.kind == "item"
            box.flush(0 if nested else 1)
            new = _Box("list")
            new.span = 0 if nested else 1
            if name == "ol":
                first = attrs.get("start", "1")
                new.number = int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1
        elif name == "li":
            box.flush()
            new = _Box("item")
            value = attrs.get("value", "")
            if box.kind == "list" and box.number is not None and re.fullmatch(r"-?\d{1,9}", value):
                box.number = int(value)
        elif name in ("blockquote", "dd"):
            box.flush(1 if name == "blockquote" else 0)
            new = _Box(name)
        elif name == "details" and "open" not in attrs:
            box.flush()
            new = _Box("details-closed")
        elif name == "option":
            box.flush()
            return False
        elif box.kind in ("table", "row"):
            return False
        else:
            box.flush(1 if name in MARGIN else 0)
            return False
        self.boxes.append(new)
        return True

    def leave(self, name: str, boxed: bool) -> None:
        if not boxed:
            if name in BLOCK and self.boxes[-1].kind not in ("table", "row"):
                self.boxes[-1].flush(1 if name in MARGIN else 0)
            return
        box = self.boxes.pop()
        box.flush()
        under = self.boxes[-1]
        lines = box.lines
        while lines and lines[-1] == "":
            lines.pop()
        if box.kind == "cell":
            under.rows.append((lines, box.span))
        elif box.kind == "row":
            under.rows.append(box.rows)
        elif box.kind == "caption":
            under.lines = lines
        elif box.kind == "table":
            under.put(lines + _aligned(box.rows), 1)
        elif box.kind == "list":
            under.put(lines, box.span)
        elif box.kind == "item":
            mark = "- "
            if under.kind == "list" and under.number is not None:
                mark = f"{under.number}. "
                under.number += 1
            if lines:
                under.put([mark + lines[0], *(" " * len(mark) + x if x else "" for x in lines[1:])], 0)
        elif box.kind == "blockquote":
            under.put(["> " + x if x else ">" for x in lines], 1)
        elif box.kind == "dd":
            under.put(["  " + x if x else "" for x in lines], 0)
        else:
            under.put(lines, 0)


def _aligned(rows: list) -> list[str]:
    """Rows of (lines, span) cells as text with one width for each column; wide cells share theirs out to the last."""
    widths: list[int] = []
    for row in rows:
        at = 0
        for lines, span in row:
            widths.extend([0] * (at + span - len(widths)))
            if span == 1 and lines:
                widths[at] = max(widths[at], max(map(len, lines)))
            at += span
    for row in rows:
        at = 0
        for lines, span in row:
            if span > 1 and lines:
                have = sum(widths[at : at + span]) + len(GAP) * (span - 1)
                widths[at + span - 1] += max(0, max(map(len, lines)) - have)
            at += span
    out = []
    for row in rows:
        for i in range(max((len(lines) for lines, _ in row), default=0)):
            at, cells = 0, []
            for lines, span in row:
                width = sum(widths[at : at + span]) + len(GAP) * (span - 1)
                cells.append((lines[i] if i < len(lines) else "").ljust(width))
                at += span
            out.append(GAP.join(cells).rstrip())
    return out


def render(source: str | None) -> str:
    """The visible text of a page; null and empty pages give an empty text."""
    return _Page(source).run() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages`` (page_id, url, html).

    Null html gives an empty text; repeated rows and nulls in other columns keep their rows;
    columns of other names are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    given = pages.select(pages["page_id"].cast("bigint").alias("page_id"), "url", "html")
    return given.mapInArrow(run, "page_id long, url string, text string, n_chars long")
