"""Visible text of HTML pages, laid out as a reader would see it.

Tags become a tree with the usual implied ends and starts (a block ends a paragraph, a list
item ends the one before, cells and rows end and begin each other, what cannot stand in the
head ends it). Hidden parts are left
out: scripts, styles, templates, the head, closed details, and what hidden attributes, inline
styles or the page's own style sheets take away. Of style sheets, the properties display and
visibility are read, in the order of the cascade: !important, then specificity, then place. Selectors
may have combinators, attributes, escapes and the pseudo-classes of structure, :not, :is and :where;
those with others (of a pointer, a state, or a pseudo-element) meet nothing on a page at rest. Rules
in @media count if they hold for a screen SCREEN pixels wide. A visible part of a parent whose
visibility is hidden shows. All else is kept, menus and footers too.

Blocks (by tag, or by a display that says so) stand on lines of their own with blank lines around paragraphs, headings, lists and
tables; list items get marks (value, start and reversed count) and indents; table cells are
padded to columns, spans over rows and columns included, with East Asian wide characters
counted as two columns; preformatted text keeps its spaces. Tree and layout use explicit
stacks, so deep nesting and very long pages are fine.

A page that ends within a tag's attributes ends before that tag. Null pages give null, empty ones and ones without visible text the empty string, an empty
table an empty result. Each row stands for itself, repeated ones too; ids may be null or
repeat; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

_TOKEN = re.compile(
    r"(?P<skip><!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z))"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"""|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>"']|"[^"<]*"|'[^'<]*')*+|[^<>]*)>"""
    r"|(?P<text>[^<]+|<)",
    re.DOTALL,
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_DECLARED = re.compile(r"(?:^|[;\s{])(display|visibility)\s*:\s*([\w-]+)\s*(!\s*important)?", re.IGNORECASE)
_IDENT = r"(?:[\w-]|[^\x00-\x7F]|\\[0-9a-fA-F]{1,6}[ \t\n]?|\\[^\n])+"
_SIMPLE = re.compile(
    rf"(?P<tag>\*|{_IDENT})|(?P<mark>[.#])(?P<name>{_IDENT})|\[\s*(?P<attr>{_IDENT})\s*(?:(?P<how>[~|^$*]?=)\s*(?:\"(?P<v1>[^\"]*)\"|'(?P<v2>[^']*)'|(?P<v3>{_IDENT}))\s*(?P<case>[iIsS])?\s*)?\]"
    r"|:(?P<pseudo>[a-zA-Z-]+)(?P<paren>\()?"
)
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})[ \t\n]?|(.))", re.DOTALL)
_FEATURE = re.compile(r"\(\s*([\w-]+)\s*(?::\s*([\d.]+)\s*(px|r?em)?\s*|:\s*([\w-]+)\s*)?\)")
SCREEN = 1280
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noframes noscript xmp".split())
NEVER = frozenset("rp script style template head title noscript iframe noframes object svg math audio video canvas datalist".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure xmp".split())
BLOCKS = SPACED | frozenset("html body div section article header footer nav aside main address form fieldset legend li dt dd tr details summary dialog figcaption hr center menu hgroup search caption option textarea".split())
#: Opening the first ends the nearest of the second, looking no further out than the third.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    **{t: (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)) for t in ("thead", "tbody", "tfoot")},
}
CLOSES_P = (BLOCKS | {"table"}) - {"html", "body", "option", "textarea", "tr", "caption", "legend", "summary"}
#: What may stand in the head; any other start tag, and text, ends an open head.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
SPACE, BREAK = "\x00", "\x01"  # kept space and line break; neither may stand in a page


#: Values of display that make a block, and those that make none.
MAKES_BLOCK = frozenset("block flex grid table list-item flow-root".split())
MAKES_INLINE = frozenset("inline inline-block inline-flex inline-grid inline-table contents".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def siblings(self) -> list[Node]:
        """The elements among the parent's children, this one included."""
        return [k for k in self.parent.children if not isinstance(k, str)] if self.parent else [self]


def _plain(name: str) -> str:
    """A name of a style sheet without its escapes."""
    return _ESCAPE.sub(lambda m: (chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else "�") if m[1] else m[2], name) if "\\" in name else name


def _parts(text: str, sign: str) -> list[str]:
    """A text cut at a sign that stands outside of brackets and quotes."""
    out, depth, quote, last = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == sign and not depth and (not i or text[i - 1] != "\\"):
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


class Unread(Exception):
    """A selector that no element of a still page meets, or that is not read."""


class Compound:
    """What one element must be: a tag, ids, classes, attributes and pseudo-classes."""

    def __init__(self) -> None:
        self.tag, self.names, self.tests, self.rank = "*", set(), [], (0, 0, 0)

    def need(self, test, rank: tuple[int, int, int]) -> None:
        self.tests.append(test)
        self.more(rank)

    def more(self, rank: tuple[int, int, int]) -> None:
        self.rank = tuple(a + b for a, b in zip(self.rank, rank))

    def holds(self, node: Node, own: set[str]) -> bool:
        return self.tag in ("*", node.tag) and self.names <= own and all(t(node) for t in self.tests)


def names_of(node: Node) -> set[str]:
    own = {f".{c}" for c in node.attrs.get("class", "").split()}
    if node.attrs.get("id"):
        own.add("#" + node.attrs["id"])
    return own


def _attribute(name: str, how: str | None, value: str, fold: bool):
    low = (lambda x: x.lower()) if fold else (lambda x: x)
    value = low(value)

    def test(node: Node) -> bool:
        if name not in node.attrs or how is None:
            return name in node.attrs
        held = low(node.attrs[name])
        if how == "=":
            return held == value
        if how == "~=":
            return value in held.split()
        if how == "|=":
            return held == value or held.startswith(value + "-")
        return bool(value) and {"^=": held.startswith, "$=": held.endswith, "*=": held.__contains__}[how](value)

    return test


def _nth(argument: str):
    """Whether a number from 1 is one of an+b."""
    argument = {"odd": "2n+1", "even": "2n"}.get(argument.strip().lower(), argument.replace(" ", "").lower())
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", argument)
    if not m:
        raise Unread
    a, b = (0, int(m[3])) if m[3] else (int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1]), int(m[2] or 0))
    return lambda n: n == b if not a else (n - b) % a == 0 and (n - b) // a >= 0


def _pseudo(name: str, argument: str | None, into: Compound) -> None:
    first = lambda n: n.siblings()[0] is n
    last = lambda n: n.siblings()[-1] is n
    one = lambda n, tag: [k for k in n.siblings() if k.tag == tag]
    place = lambda ks, n: next(i for i, k in enumerate(ks, 1) if k is n)
    plain = {
        "first-child": first,
        "last-child": last,
        "only-child": lambda n: first(n) and last(n),
        "first-of-type": lambda n: one(n, n.tag)[0] is n,
        "last-of-type": lambda n: one(n, n.tag)[-1] is n,
        "only-of-type": lambda n: len(one(n, n.tag)) == 1,
        "root": lambda n: n.parent is None,
        "empty": lambda n: not n.children,
        "link": lambda n: n.tag == "a" and "href" in n.attrs,
        "any-link": lambda n: n.tag == "a" and "href" in n.attrs,
        "checked": lambda n: "checked" in n.attrs or (n.tag == "option" and "selected" in n.attrs),
        "disabled": lambda n: "disabled" in n.attrs,
        "enabled": lambda n: n.tag in ("button", "input", "select", "textarea", "option") and "disabled" not in n.attrs,
    }
    if argument is None and name in plain:
        into.need(plain[name], (0, 1, 0))
    elif argument is not None and name in ("not", "is", "where", "matches"):
        inner = [Selector(x.strip()) for x in _parts(argument, ",")]
        into.need((lambda n: not any(s.matches(n) for s in inner)) if name == "not" else (lambda n: any(s.matches(n) for s in inner)), (0, 0, 0))
        if name != "where":
            into.more(max(s.rank for s in inner))
    elif argument is not None and name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
        good = _nth(argument)
        among = (lambda n: one(n, n.tag)) if "type" in name else (lambda n: n.siblings())
        into.need(lambda n: good(place(among(n)[::-1] if "last" in name else among(n), n)), (0, 1, 0))
    else:
        raise Unread


class Selector:
    """Compounds with what stands between them, as read from a style sheet."""

    def __init__(self, text: str):
        self.compounds, self.between = [Compound()], []
        at, fresh = 0, True
        while at < len(text):
            gap = re.compile(r"\s*([>+~])\s*|\s+").match(text, at)
            if gap:
                if fresh:
                    raise Unread
                self.between.append(gap[1] or " ")
                self.compounds.append(Compound())
                at, fresh = gap.end(), True
                continue
            m = _SIMPLE.match(text, at)
            if not m or (m["tag"] and not fresh):
                raise Unread
            at, now, fresh = m.end(), self.compounds[-1], False
            if m["tag"]:
                now.tag = _plain(m["tag"]).lower()
                now.more((0, 0, now.tag != "*"))
            elif m["mark"]:
                now.names.add(m["mark"] + _plain(m["name"]))
                now.more((1, 0, 0) if m["mark"] == "#" else (0, 1, 0))
            elif m["attr"]:
                value = next((v for v in (m["v1"], m["v2"], m["v3"]) if v is not None), "")
                now.need(_attribute(_plain(m["attr"]).lower(), m["how"], _plain(value), (m["case"] or "").lower() == "i"), (0, 1, 0))
            else:
                argument = None
                if m["paren"]:
                    argument = self._inner(text, at)
                    at += len(argument) + 1
                _pseudo(m["pseudo"].lower(), argument, now)
        if fresh:
            raise Unread
        self.rank = tuple(sum(c.rank[i] for c in self.compounds) for i in range(3))

    @staticmethod
    def _inner(text: str, at: int) -> str:
        depth = 1
        for i in range(at, len(text)):
            depth += (text[i] == "(") - (text[i] == ")")
            if not depth:
                return text[at:i]
        raise Unread

    def key(self) -> str:
        """A name or tag that every element that it meets has."""
        names = sorted(self.compounds[-1].names)
        return names[0] if names else self.compounds[-1].tag

    def matches(self, node: Node, own: set[str] | None = None) -> bool:
        return self.compounds[-1].holds(node, names_of(node) if own is None else own) and self._before(node, len(self.between) - 1)

    def _before(self, node: Node, i: int) -> bool:
        if i < 0:
            return True
        sign, want = self.between[i], self.compounds[i]
        if sign in "+~":
            kin = node.siblings()
            kin = kin[: next(k for k, x in enumerate(kin) if x is node)]
            kin = kin[-1:] if sign == "+" else kin[::-1]
        else:
            kin, up = [], node.parent
            while up is not None:
                kin.append(up)
                up = None if sign == ">" else up.parent
        return any(want.holds(k, names_of(k)) and self._before(k, i - 1) for k in kin)


def on_screen(media: str) -> bool:
    """Whether one of a list of media queries holds for a landscape screen SCREEN pixels wide."""

    def feature(name: str, number: str | None, unit: str | None, word: str | None) -> bool:
        if number is not None:
            size = float(number) * (16 if unit in ("em", "rem") else 1)
            return {"min-width": SCREEN >= size, "max-width": SCREEN <= size, "width": SCREEN == size}.get(name, False)
        return (name, word) in {("orientation", "landscape"), ("color", None), ("hover", "hover"), ("prefers-color-scheme", "light")}

    def holds(query: str) -> bool:
        words = re.findall(r"[\w-]+", re.sub(r"\([^)]*\)", " ", query))
        kinds = [w for w in words if w not in ("and", "only", "not")]
        found = _FEATURE.findall(query)
        yes = all(k in ("screen", "all") for k in kinds) and all(feature(n, x or None, u or None, w or None) for n, x, u, w in found) and len(found) == query.count("(")
        return yes != ("not" in words)

    return not media.strip() or any(holds(q) for q in media.lower().split(","))


def _declared(body: str) -> list[tuple[str, str, bool]]:
    return [(name.lower(), value.lower(), bool(important)) for name, value, important in _DECLARED.findall(body)]


class Styles:
    """Display and visibility of elements by the page's style sheets."""

    def __init__(self):
        self.rules: dict[str, list] = {}  # by id, class or tag: selectors, their rank, and what they declare
        self.count = 0

    def read(self, sheet: str) -> None:
        sheet = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.DOTALL)
        at, use, closing = 0, True, []  # closing: what held outside each open block of rules
        for m in re.finditer(r"([^{};]*)([{};])", sheet):
            if m.start() < at:
                continue
            head, sign = m[1].strip(), m[2]
            if sign == "}":
                use = closing.pop() if closing else True
            elif sign == "{":
                kind = re.match(r"@([\w-]*)", head)
                if kind and kind[1].lower() in ("media", "supports", "layer", "container"):
                    closing.append(use)
                    use = use and (kind[1].lower() != "media" or on_screen(head[6:]))
                    continue
                depth, at = 1, m.end()  # the body ends where its braces do
                for brace in re.finditer(r"[{}]", sheet[at:]):
                    depth += 1 if brace[0] == "{" else -1
                    if not depth:
                        body, at = sheet[at : at + brace.start()], at + brace.end()
                        break
                else:
                    body, at = sheet[at:], len(sheet)
                if use and not kind and (said := _declared(body)):
                    for select in _parts(head, ","):
                        self._add(select.strip(), said)

    def _add(self, select: str, said: list[tuple[str, str, bool]]) -> None:
        try:
            read = Selector(select)
        except (Unread, RecursionError):
            return
        self.count += 1
        self.rules.setdefault(read.key(), []).append((read, (*read.rank, self.count), said))

    def of(self, node: Node) -> dict[str, str]:
        """The values of display and visibility that an element is given itself."""
        best: dict[str, tuple] = {}

        def give(name: str, value: str, rank: tuple) -> None:
            if name not in best or rank >= best[name][0]:
                best[name] = (rank, value)

        if "hidden" in node.attrs or (node.tag == "dialog" and "open" not in node.attrs):
            give("display", "none", (False, -1))
        if self.rules:
            own = names_of(node)
            for key in (*own, node.tag, "*"):
                for selector, rank, said in self.rules.get(key, ()):
                    if selector.matches(node, own):
                        for name, value, important in said:
                            give(name, value, (important, 0, *rank))
        if "style" in node.attrs:
            for name, value, important in _declared(node.attrs["style"]):
                give(name, value, (important, 1))
        return {name: value for name, (_, value) in best.items()}


def parse(page: str) -> tuple[Node, Styles]:
    """The tree of a page (nodes, with texts as strings) and its styles."""
    page = page.replace("\x00", "�").replace("\x01", "�")
    root = Node("html", {})
    stack, opened = [root], {"html": 1}  # opened: how many of each tag are open
    styles = Styles()

    def pop() -> None:
        opened[stack.pop().tag] -= 1

    def end(tags, limit) -> None:
        """Closes the outermost open tag of tags that lies within the limit."""
        cut = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in limit:
                break
            if stack[i].tag in tags:
                cut = i
        while cut is not None and len(stack) > cut:
            pop()

    def push(tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs, stack[-1])
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1

    def say(text: str) -> None:
        text = html.unescape(text)
        if stack[-1].tag == "head" and text.strip(" \t\n\r\f"):
            pop()
        stack[-1].children.append(text)

    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        if m is None:  # a tag that never ends
            say(page[at])
            at += 1
            continue
        if m["text"] == "<" and re.compile(r"</?[a-zA-Z][^\s>]*\s").match(page, at) and page.find(">", at) < 0 and page.find("<", at + 1) < 0:
            break  # the page ends within a tag's attributes
        at = m.end()
        kind = m.lastgroup
        if kind == "text":
            if stack[-1].tag not in ("table", "thead", "tbody", "tfoot", "tr") or not m["text"].isspace():
                say(m["text"])
        elif kind == "close":
            tag = m["close"].lower()
            if opened.get(tag) and tag != "html":
                # an end tag inside a cell does not close what lies outside the table
                limit = () if tag in ("table", "body") else ("td", "th", "caption", "table") if tag not in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else ("table",)
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i].tag in limit:
                        break
            elif tag == "br":
                if stack[-1].tag == "head":
                    pop()
                push("br", {})
        elif kind in ("open", "attrs"):
            tag = m["open"].lower()
            attrs: dict[str, str] = {}
            for a in _ATTR.finditer(m["attrs"]) if m["attrs"] else ():
                attrs.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
            if tag in ("html", "body") and opened.get(tag):
                continue
            if tag == "body" and opened.get("head"):
                end(("head",), ())
            if stack[-1].tag == "head" and tag not in IN_HEAD:
                pop()
            if opened.get("p") and tag in CLOSES_P:
                end(("p",), ("td", "th", "caption", "button", "object", "table"))
            if tag in ENDS:
                tags, limit = ENDS[tag]
                if any(opened.get(t) for t in tags):
                    end(tags, limit)
            if tag in ("td", "th") and opened.get("table") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                push("tr", {})
            push(tag, attrs)
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
                raw, at = (page[at : stop.start()], stop.end()) if stop else (page[at:], len(page))
                if tag == "style":
                    if on_screen(attrs.get("media", "")):
                        styles.read(raw)
                stack[-1].children.append(html.unescape(raw) if tag in ("textarea", "title") else raw)
                pop()
    return root, styles


def width(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for marks."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _lines(items: list) -> list[str]:
    """Inline texts (strings) and blocks (gap, lines) as lines; spaces collapsed, blank lines where a gap is asked for."""
    out: list[str] = []
    inline: list[str] = []
    gap = False

    def flush() -> None:
        nonlocal gap
        if not inline:
            return
        text = re.sub(r"[ \t\n\r\f]+", " ", "".join(inline))
        inline.clear()
        rows = [r.strip(" ") for r in text.split(BREAK)]
        if any(r.strip(SPACE) for r in rows):
            if rows[-1] == "":
                rows.pop()
            if gap and out:
                out.append("")
            gap = False
            out.extend(rows)

    for item in items:
        if isinstance(item, str):
            inline.append(item)
            continue
        flush()
        if item[1]:
            if out and (gap or item[0]):
                out.append("")
            out.extend(item[1])
            gap = item[0]
    flush()
    return out


def _table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns and rows spanned), padded to columns."""
    busy: dict[int, int] = {}  # rows for which a column is still taken from above
    placed: list[list[tuple[int, int, list[str]]]] = []  # first column, end column, lines
    for k, row in enumerate(rows):
        at, cells, taken = 0, [], {c for c, n in busy.items() if n > 0}
        for lines, across, down in row:
            while at in taken:
                at += 1
            cells.append((at, at + across, lines))
            if down != 1:
                for c in range(at, at + across):
                    busy[c] = down or len(rows) - k
            at += across
        busy = {c: n - 1 for c, n in busy.items() if n > 1}
        placed.append(cells)
    # columns in which no cell starts take no room
    number = {c: i for i, c in enumerate(sorted({c for cells in placed for c, _, _ in cells}))}
    starts = sorted(number)
    widths = [0] * len(starts)
    spans = []
    for cells in placed:
        for i, (c, end, lines) in enumerate(cells):
            a, b = number[c], bisect.bisect_left(starts, end)
            cells[i] = (a, b, lines)
            need = max([0, *map(width, lines)])
            if b == a + 1:
                widths[a] = max(widths[a], need)
            else:
                spans.append((b - a, a, b, need))
    for _, a, b, need in sorted(spans):
        room = sum(widths[a:b]) + 2 * (b - a - 1)
        widths[b - 1] += max(0, need - room)
    left = [0]
    for w in widths:
        left.append(left[-1] + w + 2)
    out = []
    for cells in placed:
        for k in range(max([1, *(len(lines) for _, _, lines in cells)])):
            line, at = [], 0
            for a, _, lines in cells:
                if k < len(lines) and lines[k]:
                    line.append(" " * (left[a] - at) + lines[k])
                    at = left[a] + width(lines[k])
            if line or any(lines for _, _, lines in cells):
                out.append("".join(line).rstrip(" "))
    return out


def _whole(node: Node, name: str, default: int, most: int) -> int:
    value = node.attrs.get(name, "").strip()
    return min(int(value), most) if re.fullmatch(r"\d{1,9}", value) else default


def render(root: Node, styles: Styles) -> str:
    """The laid out text of a tree."""

    def finish(node: Node, items: list, mark: str, display: str) -> list:
        """What a node gives to its parent, from what its children gave."""
        tag = node.tag
        if tag == "br":
            return [BREAK]
        if tag in ("td", "th"):
            lines = [s for s in _lines(items) if s]
            return [("cell", (lines, max(1, _whole(node, "colspan", 1, 1000)), _whole(node, "rowspan", 1, 65534)))]
        if tag == "tr":
            cells = [i[1] for i in items if i[0] == "cell"]
            rest = _lines([i for i in items if i[0] != "cell"])
            return ([(False, rest)] if rest else []) + ([("row", cells)] if cells else [])
        if tag == "table":
            rows = [i[1] for i in items if i[0] == "row"]
            rest = _lines([i for i in items if i[0] not in ("row", "cell")])
            return [(True, rest + _table(rows))]
        if tag in ("thead", "tbody", "tfoot", "colgroup"):
            return items
        # rows and cells outside a table are lines and texts
        items = [(False, ["  ".join(" ".join(c[0]) for c in i[1])]) if i[0] == "row" else " " + " ".join(i[1][0]) + " " if i[0] == "cell" else i for i in items]
        if tag == "li":
            lines = _lines(items)
            return [(False, [mark + lines[0], *(" " * len(mark) + s if s else s for s in lines[1:])])] if lines else []
        if tag == "dd":
            return [(False, ["  " + s if s else s for s in _lines(items)])]
        if tag == "blockquote":
            return [(True, ["  " + s if s else s for s in _lines(items)])]
        if tag in ("ul", "ol", "menu"):
            nested = [s if isinstance(s, str) else (False, s[1]) for s in items]
            return [(tag != "menu", _lines(nested))]
        if tag in BLOCKS and display not in MAKES_INLINE:
            return [(tag in SPACED, _lines(items))]
        return [(False, _lines(items))] if display in MAKES_BLOCK else items

    def shown(node: Node) -> bool:
        return node.tag not in NEVER and styles.of(node).get("display") != "none"

    result: list = []
    stack: list = [(root, iter(root.children), [], False, "", True, "")]
    count: list[list[int]] = []  # the next number and the step of each open list
    while stack:
        node, children, items, pre, mark, seen, display = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if node.tag in ("ol", "ul", "menu"):
                count.pop()
            given = finish(node, items, mark, display)
            if stack:
                parent, into = stack[-1][0], stack[-1][2]
                # a list within an item stands right below it
                if node.tag in ("ul", "ol") and parent.tag == "li":
                    given = [(False, g[1]) if not isinstance(g, str) else g for g in given]
                into.extend(given)
            else:
                result = given
        elif isinstance(child, str):
            if seen:
                items.append(child.replace("\r\n", "\n").replace(" ", SPACE).replace("\t", SPACE * 4).replace("\n", BREAK) if pre else child)
        elif child.tag not in NEVER:
            style = styles.of(child)
            if style.get("display") == "none" or (node.tag == "details" and "open" not in node.attrs and child.tag != "summary"):
                continue
            visible = {"visible": True, "hidden": False, "collapse": False}.get(style.get("visibility", ""), seen)
            own = ""
            if child.tag == "ol":
                items_in = sum(not isinstance(k, str) and k.tag == "li" and shown(k) for k in child.children) if "reversed" in child.attrs else 1
                start = child.attrs.get("start", "").strip()
                count.append([int(start) if re.fullmatch(r"-?\d{1,9}", start) else items_in, -1 if "reversed" in child.attrs else 1])
            elif child.tag in ("ul", "menu"):
                count.append([0, 0])
            elif child.tag == "li":
                own = "- "
                if node.tag == "ol":
                    value = child.attrs.get("value", "").strip()
                    if re.fullmatch(r"-?\d{1,9}", value):
                        count[-1][0] = int(value)
                    own = f"{count[-1][0]}. "
                    count[-1][0] += count[-1][1]
                own = own if visible else ""
            elif child.tag == "input" and visible and child.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                items.append(f" {child.attrs.get('value', '')} ")
            if child.tag == "br" and not visible:
                continue
            kids = child.children
            if child.tag == "details" and "open" not in child.attrs:
                kids = [k for k in kids if not isinstance(k, str)]
            stack.append((child, iter(kids), [], pre or child.tag in ("pre", "textarea", "xmp"), own, visible, style.get("display", "")))
    return "\n".join(_lines(result)).replace(SPACE, " ").replace(BREAK, "\n").strip("\n")


def page_text(page: str | None) -> str | None:
    return None if page is None else render(*parse(page))


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text of every page."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts = pa.array([page_text(p) for p in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], names=["page_id", "text"])

    source = pages.selectExpr(f"CAST(`{id_col}` AS long) AS page_id", f"`{html_col}` AS html")
    return source.mapInArrow(run, "page_id long, text string")
