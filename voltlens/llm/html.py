"""Text of web pages as a reader sees it.

A page is cut into tags and text, a tree is built with the end tags that HTML implies, and the tree
is walked once: invisible parts are skipped, white space collapses, blocks stand on lines of their own
(paragraph-like ones with a blank line between), list items get markers and indentation, and the
cells of a table row stand side by side in aligned columns, right of cells that reach down from rows above.

Invisible are: head, script, style, template, noscript and fallback content of embedded media, meters and bars;
what ``hidden``, ``display:none`` or ``visibility:hidden`` (but for ``visible`` parts inside) hides, in ``style`` attributes or in style sheets
of the page; closed dialogs; closed details but for their summary; hidden inputs; options that are not chosen
in a closed choice (list boxes show all).  Texts in drawings and formulas are visible.

Of style sheets, rules for a tag, class or id count that hold on a screen without conditions; for each of display
and visibility the most specific rule decides, then the later one, and a ``style`` attribute before both.

Work and memory are linear in the page: no recursion, at most ``OPEN`` elements are open, column widths beyond ``WIDEST`` and indents
beyond ``DEEPEST`` levels are not padded, and cells do not reach down beyond ``REACHING`` columns (their texts stay).  Cases: null pages give null, empty pages an empty text; broken
markup (open quotes, stray end tags, misnesting) never fails; text outside cells of a table comes
before the table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from voltlens.llm.common import add_columns

WIDEST = 40
DEEPEST = 20
#: Elements open at once; deeper ones become siblings.
OPEN = 512
#: Columns in which a cell can reach down over further rows.
REACHING = 1000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head script style template noscript iframe noembed noframes object audio video canvas datalist "
    "title meter progress desc defs metadata annotation annotation-xml".split()
)
SPACED = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure hr fieldset form xmp".split()
)
BLOCK = SPACED | frozenset(
    "html body div section article aside nav header footer main address li dt dd center summary figcaption legend details "
    "dialog hgroup search caption optgroup".split()
)
CLOSES_P = BLOCK - {"html", "body", "optgroup", "caption", "legend"}
CELLS = ("td", "th")
ROWS = ("thead", "tbody", "tfoot")

#: A start tag ends open elements of these names, up to the nearest of the fences.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (CELLS, ("tr", "table")),
    "th": (CELLS, ("tr", "table")),
    "tr": (("tr", *CELLS, "caption"), (*ROWS, "table")),
    "thead": (("tr", *CELLS, *ROWS, "caption"), ("table",)),
    "tbody": (("tr", *CELLS, *ROWS, "caption"), ("table",)),
    "tfoot": (("tr", *CELLS, *ROWS, "caption"), ("table",)),
    "body": (("head",), ()),
}
#: Start tags that may stand in a head; any other one ends it.
IN_HEAD = frozenset("base link meta title style script noscript template basefont bgsound".split())
#: An end tag of another element does not reach beyond these.
WALLS = frozenset(("table", "caption", "template", *CELLS))
INLINE = frozenset(
    "a abbr b bdi bdo big cite code dfn em font i kbd label mark nobr q s samp small span strike strong sub sup time "
    "tt u var".split()
)

MARKUP = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?|=)")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
SELECTOR = re.compile(r"([a-z][a-z0-9]*)?([.#][\w-]+)?")
COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
SETS = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
SCREEN = re.compile(r"@media\s+(?:only\s+)?(?:all|screen)\s*", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Element:
    __slots__ = ("tag", "attributes", "kids")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.kids = tag, attributes, []


def attributes_at(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on and the place after the tag."""
    found: dict[str, str] = {}
    while (m := ATTRIBUTE.match(page, at)) and m.end() > at:
        if m[1]:
            value = next((v for v in m.groups()[1:] if v is not None), "")
            found.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
        at = m.end()
    end = page.find(">", at)
    return found, len(page) if end < 0 else end + 1


def tree(page: str) -> Element:
    """The element tree of a page below one unnamed root; texts are plain strings."""
    root = Element("", {})
    open_ = [root]
    at, size = 0, len(page)
    while at < size:
        m = MARKUP.search(page, at)
        if m is None:
            add_text(open_, page[at:])
            break
        if m.start() > at:
            add_text(open_, page[at : m.start()])
        if m[1]:
            end = page.find("-->", m.start() + 2)
            at = size if end < 0 else end + 3
        elif m[2]:
            end = page.find(">", m.end())
            at = size if end < 0 else end + 1
        else:
            tag = m[4].lower()
            attributes, at = attributes_at(page, m.end())
            if m[3]:
                close(open_, tag)
                continue
            start(open_, tag, attributes)
            if tag in RAW:
                end = ENDS[tag].search(page, at)
                raw = page[at : end.start() if end else size]
                if raw:
                    open_[-1].kids.append(unescape(raw) if tag in ("title", "textarea") else raw)
                at = end.start() if end else size
            elif tag == "plaintext":
                open_[-1].kids.append(page[at:])
                break
    return root


def add_text(open_: list[Element], text: str) -> None:
    if open_[-1].tag == "head" and text.strip():
        open_.pop()
    open_[-1].kids.append(unescape(text) if "&" in text else text)


def start(open_: list[Element], tag: str, attributes: dict[str, str]) -> None:
    if open_[-1].tag == "head" and tag not in IN_HEAD:
        open_.pop()
    if tag in CLOSES_P:
        end_implied(open_, ("p",), ())
    if tag in IMPLIED:
        end_implied(open_, *IMPLIED[tag])
    made = Element(tag, attributes)
    open_[-1].kids.append(made)
    if tag not in VOID:
        if len(open_) > OPEN:
            open_.pop()
        open_.append(made)


def end_implied(open_: list[Element], names: Sequence[str], fences: Sequence[str]) -> None:
    """Close the outermost open element of ``names`` that no fence shields."""
    cut = None
    for i in range(len(open_) - 1, 0, -1):
        tag = open_[i].tag
        if tag in names:
            cut = i
        elif tag in fences or tag in WALLS:
            break
    if cut is not None:
        del open_[cut:]


def close(open_: list[Element], tag: str) -> None:
    if tag in ("br", "p") and (tag == "br" or all(e.tag != "p" for e in open_)):
        open_[-1].kids.append(Element(tag, {}))
        return
    for i in range(len(open_) - 1, 0, -1):
        here = open_[i].tag
        if here == tag:
            if tag in INLINE and any(e.tag not in INLINE for e in open_[i + 1 :]):
                del open_[i]  # misnested: the blocks inside stay open
            else:
                del open_[i:]
            return
        if here in WALLS and tag not in ("table", "tr", *ROWS, *CELLS, "body", "html"):
            return


def sheet_rules(sheet: str) -> list[tuple[str, str]]:
    """Selectors and bodies of the rules of a style sheet that hold on a screen without conditions."""
    found: list[tuple[str, str]] = []
    held: list[bool] = []
    start = 0
    sheet = COMMENT.sub(" ", sheet)
    for at in (m.start() for m in re.finditer("[{};]", sheet)):
        if sheet[at] == ";":
            start = start if held else at + 1
            continue
        head = sheet[start:at].strip()
        if sheet[at] == "{":
            if head.startswith("@"):
                held.append(bool(SCREEN.fullmatch(head + " ")) and all(held))
                start = at + 1
            else:
                end = sheet.find("}", at)
                body = sheet[at + 1 : end if end >= 0 else len(sheet)]
                if all(held) and "{" not in body:
                    found.append((head, body))
                held.append(False)
                start = at + 1
        else:
            if held:
                held.pop()
            start = at + 1
    return found


def style_rules(root: Element) -> dict[str, list[tuple[tuple[int, int], str, str]]]:
    """Per selector (``tag``, ``.class``, ``#id``, ``tag.class``) what style sheets of the page set, with its weight."""
    found: dict[str, list] = {}
    number = 0
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "style":
            for selectors, body in sheet_rules("".join(k for k in node.kids if isinstance(k, str))):
                sets = [(p.lower(), v.lower()) for p, v in SETS.findall(body)]
                for name in (s.strip().lower() for s in selectors.split(",")) if sets else ():
                    if name and SELECTOR.fullmatch(name):
                        number += 1
                        weight = (100 * ("#" in name) + 10 * ("." in name) + (name[0] not in ".#"), number)
                        found.setdefault(name, []).extend((weight, p, v) for p, v in sets)
        todo.extend(k for k in reversed(node.kids) if not isinstance(k, str))
    return found


def unseen(node: Element, rules: dict[str, list], dark: bool) -> bool | None:
    """None if neither the element nor anything in it is shown, else whether its own texts are invisible (``dark``: its parent's are)."""
    a, tag = node.attributes, node.tag
    if tag in UNSEEN or "hidden" in a and a["hidden"].lower() != "until-found":
        return None
    if tag == "dialog" and "open" not in a or tag == "input" and a.get("type", "").lower() == "hidden":
        return None
    last: dict[str, str] = {}
    if rules:
        marks = ["." + c.lower() for c in a.get("class", "").split()]
        if "id" in a:
            marks.append("#" + a["id"].lower())
        names = {tag, *marks, *(tag + m for m in marks)}
        for _, p, v in sorted(r for n in names if n in rules for r in rules[n]):
            last[p] = v
    if "style" in a:
        last.update((p.lower(), v.lower()) for p, v in SETS.findall(a["style"]))
    if last.get("display") == "none":
        return None
    return {"visible": False, "initial": False, "hidden": True, "collapse": True}.get(last.get("visibility"), dark)


class Flow:
    """Lines under construction: collapsing text, pending gaps, margin and list marker."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = 0
        self.margin: list[int] = []
        self.marker = ""
        self.space = False

    def text(self, s: str) -> None:
        pieces = BLANKS.split(s)
        if not pieces[0] and len(pieces) > 1:
            self.space = True
        words = [p for p in pieces if p]
        if words:
            if self.space and self.parts:
                self.parts.append(" ")
            self.parts.append(" ".join(words))
            self.space = not pieces[-1]

    def verbatim(self, s: str) -> None:
        first, *rest = s.split("\n")
        self.parts.append(first)
        for line in rest:
            self.end_line(keep=True)
            self.parts.append(line)

    def end_line(self, keep: bool = False) -> None:
        line = "".join(self.parts).replace("\xa0", " ").rstrip()
        self.parts, self.space = [], False
        if line or keep:
            self.line(line)

    def line(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.extend([""] * (self.gap - 1))
        self.gap = 0
        left = " " * (sum(self.margin) - len(self.marker))
        self.lines.append((left + self.marker + line).rstrip())
        self.marker = ""

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def finish(self) -> list[str]:
        self.end_line()
        return self.lines


class Table:
    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []

    def placed(self) -> list[list[tuple[int, int, list[str]]]]:
        """Cells with their first column, right of what cells of earlier rows reach down to."""
        taken: dict[int, tuple[int, int]] = {}  # first column -> row it ends before, columns
        out = []
        for number, row in enumerate(self.rows):
            column, cells = 0, []
            for span, down, lines in row:
                while taken.get(column, (0, 0))[0] > number:
                    column += taken[column][1]
                cells.append((column, span, lines))
                if down != 1 and column < REACHING:
                    taken[column] = (number + down if down else len(self.rows), span)
                column += span
            out.append(cells)
        return out

    def lines(self) -> list[str]:
        """Rows with their cells side by side; a cell spans its columns and stands in the first of its rows."""
        rows = self.placed()
        widths: dict[int, int] = {}
        for column, span, lines in (cell for row in rows for cell in row):
            wide = max(map(len, lines), default=0)
            if span == 1 and wide <= WIDEST:
                widths[column] = max(widths.get(column, 0), wide)

        def room(column: int, span: int) -> int:
            return min(sum(widths.get(c, 0) + 2 for c in range(column, column + span)) - 2, WIDEST * span)

        out: list[str] = []
        for row in rows:
            for at in range(max((len(lines) for _, _, lines in row), default=0)):
                parts, end = [], 0
                for column, span, lines in row:
                    if column > end:
                        parts.append(" " * room(end, column - end))
                    parts.append((lines[at] if at < len(lines) else "").ljust(room(column, span)))
                    end = column + span
                out.append("  ".join(parts).rstrip())
        return out


def spans(node: Element, name: str, least: int, most: int) -> int:
    value = node.attributes.get(name, "1").strip()
    return min(int(value), most) if value.isdecimal() and len(value) < 10 and int(value) >= least else 1


def marker(node: Element, lists: list[list]) -> str:
    if not lists or not lists[-1][0]:
        return "- "
    value = node.attributes.get("value", "").strip()
    if value.lstrip("-").isdecimal() and len(value) < 10:
        lists[-1][1] = int(value)
    number = lists[-1][1]
    lists[-1][1] += 1
    return f"{number}. "


def chosen(node: Element) -> list:
    """What a choice shows: a list box all options, each on a line, a closed one its selected option, else the first."""
    options, todo = [], [node]
    while todo:
        e = todo.pop()
        if e.tag == "option":
            options.append(e)
        else:
            todo.extend(k for k in reversed(e.kids) if not isinstance(k, str) and k.tag in ("option", "optgroup"))
    if "multiple" in node.attributes or node.attributes.get("size", "").strip().lstrip("0") not in ("", "1"):
        boxes = []
        for option in options:
            box = Element("div", {})
            box.kids.append(option)
            boxes.append(box)
        return boxes
    marked = [o for o in options if "selected" in o.attributes]
    return (marked or options)[:1]


def render(page: str) -> str:
    """The visible text of a page."""
    root = tree(page)
    rules = style_rules(root)
    flow = Flow()
    flows, tables, lists = [flow], [], []
    pre = 0
    todo: list = [(root, False, False)]
    while todo:
        node, leaving, dark = todo.pop()
        if isinstance(node, str):
            if not dark:
                (flow.verbatim if pre else flow.text)(node)
            continue
        tag = node.tag
        if not leaving:
            dark = unseen(node, rules, dark)
            if dark is None:
                continue
            kids = node.kids
            if tag == "br":
                flow.end_line(keep=bool(flow.parts) or flow.gap == 0)
            elif tag == "input":
                if not dark and node.attributes.get("type", "text").lower() in ("text", "search", "submit", "button", "reset"):
                    flow.text(" " + node.attributes.get("value", "") + " ")
            elif tag == "wbr":
                pass
            elif tag in CELLS and tables and tables[-1].rows:
                flow = Flow()
                flows.append(flow)
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif tag in BLOCK:
                flow.block(2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 1)
            if tag == "table":
                tables.append(Table())
            elif tag in ("ul", "ol", "menu"):
                first = node.attributes.get("start", "1").strip()
                lists.append([tag == "ol", int(first) if first.lstrip("-").isdecimal() and len(first) < 10 else 1])
            elif tag == "li":
                flow.marker = marker(node, lists)
                flow.margin.append(len(flow.marker) if len(flow.margin) < DEEPEST else 0)
                if dark or not flow.margin[-1]:
                    flow.marker = ""
            elif tag == "dd":
                flow.margin.append(2 if len(flow.margin) < DEEPEST else 0)
            elif tag in ("pre", "textarea", "xmp"):
                pre += 1
                if kids and isinstance(kids[0], str) and kids[0].startswith("\n"):
                    kids = [kids[0][1:], *kids[1:]]
            elif tag == "select":
                kids = chosen(node)
            elif tag == "details" and "open" not in node.attributes:
                kids = [k for k in kids if not isinstance(k, str) and k.tag == "summary"][:1]
            todo.append((node, True, dark))
            todo.extend((k, False, dark) for k in reversed(kids))
            continue
        if tag in CELLS and tables and tables[-1].rows and len(flows) > 1:
            lines = flows.pop().finish()
            flow = flows[-1]
            tables[-1].rows[-1].append((spans(node, "colspan", 1, 1000), spans(node, "rowspan", 0, 65_534), lines))
            continue
        if tag == "li" or tag == "dd":
            flow.end_line()
            flow.margin.pop()
            flow.marker = ""
        elif tag in ("pre", "textarea", "xmp"):
            pre -= 1
        elif tag in ("ul", "ol", "menu"):
            flow.end_line()
            lists.pop()
        elif tag == "table":
            flow.end_line()
            for line in tables.pop().lines():
                flow.line(line)
        if tag in BLOCK:
            flow.block(2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 1)
        elif tag in CELLS:
            flow.text(" ")
    return "\n".join(flow.finish()).strip("\n")


def title_of(page: str) -> str | None:
    """Text of the first title element."""
    m = re.search(r"<title(?:\s[^>]*)?>(.*?)(?:</title|$)", page, re.I | re.S)
    return " ".join(unescape(m[1]).split()) if m else None


def extract(pages: DataFrame, *, html_col: str = "html", keep: Sequence[str] | None = None) -> DataFrame:
    """``pages`` with ``title`` and ``text``."""

    def start_task():
        def work(pages_):
            texts = [p if p is None else p.decode("utf-8", "replace") for p in pages_]
            return [[t and title_of(t) for t in texts], [t if t is None else render(t) for t in texts]]

        return work

    fields = [T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]
    return add_columns(pages, [html_col], fields, start_task, keep)
