"""HTML to text as a browser lays it out: a tree with implied tags, visibility, block spacing, lists and aligned tables."""

from __future__ import annotations

import html
import re
from collections import Counter

# Element classes of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes textarea title noscript".split())
DECODED = {"textarea", "title"}
HIDDEN = set("head script style title meta link base template noscript noembed noframes iframe datalist audio video canvas object area param source track rp".split())
#: Parts of drawings and formulas that aren't shown, and those of drawings whose text is.
UNDRAWN = set("defs symbol clippath mask pattern marker desc metadata title style script".split())
DRAWN, UNREAD = {"text", "foreignobject"}, {"annotation", "annotation-xml"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend "
    "li listing main menu nav ol optgroup p plaintext pre search section summary table caption colgroup tbody tfoot thead tr td th ul xmp".split()
)
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre listing xmp table figure fieldset hr".split())
CLOSES_P = BLOCK - set("body dd dt html legend li optgroup tbody thead tfoot tr td th caption colgroup".split()) | {"dd", "dt", "li"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SCOPE = set("applet caption html table td th marquee object template".split())
TABLE_PARTS = set("table tbody thead tfoot tr".split())
SPECIAL_LISTS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}}

#: Browsers stop nesting here: deeper elements become siblings, and no text is lost.
DEPTH = 512
#: A column of a table is padded to its widest line, up to this width.
WIDTH = 80
#: Columns that cells of several rows or columns are tracked in; cells further right stand side by side.
COLUMNS = 256

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_SPACES = re.compile(r"[ \t\n\f\r]+")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_SIMPLE = re.compile(r"[A-Za-z][A-Za-z0-9-]*|(?:[A-Za-z][A-Za-z0-9-]*)?[.#][A-Za-z_-][\w-]*")


class Node:
    __slots__ = ("name", "attrs", "children", "before")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs = name, attrs or {}
        self.children: list[Node | str] = []
        self.before: list[Node | str] = []  # of a table: what stood inside it outside of cells, shown before it


def tokens(text: str):
    """("start", name, attributes), ("end", name), ("text", string), ("raw", string) in order. Takes any string."""
    at, n = 0, len(text)
    while at < n:
        low = text.find("<", at)
        if low < 0:
            yield "text", text[at:]
            return
        if low > at:
            yield "text", text[at:low]
        if text.startswith("<!--", low):
            if text.startswith(">", low + 4) or text.startswith("->", low + 4):
                at = text.index(">", low) + 1
                continue
            end = text.find("-->", low + 4)
            at = n if end < 0 else end + 3
            continue
        close = text.startswith("</", low)
        m = _NAME.match(text, low + 1 + close)
        if not m:
            if text[low + 1 : low + 2] in ("!", "?", "/") and low + 2 < n:
                end = text.find(">", low)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<"
                at = low + 1
            continue
        name, at, attrs = m[0].lower(), m.end(), {}
        while at < n and text[at] != ">":
            a = _ATTRIBUTE.match(text, at)
            if not a or a.end() == at:
                at += 1
                continue
            at = a.end()
            key = a[1].lower()
            if key not in attrs:
                value = a[2] or ""
                attrs[key] = html.unescape(value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value)
        if at >= n:
            return  # a tag that isn't closed is no text
        at += 1
        if close:
            yield "end", name
            continue
        yield "start", name, attrs
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(text, at)
            stop = end.start() if end else n
            yield "raw", html.unescape(text[at:stop]) if name in DECODED else text[at:stop]
            yield "end", name
            at = n if end is None else (text.find(">", end.end()) + 1 or n)
        elif name == "plaintext":
            yield "raw", text[at:]
            return


def hidden_selectors(sheets: list[str]) -> dict[str, tuple[bool, str | None]]:
    """What styled() says of the simple selectors (tag, .class, #id, tag.class) of style sheets; rules inside at-rules don't count."""
    out: dict[str, tuple[bool, str | None]] = {}
    for sheet in sheets:
        plain = _COMMENT.sub("", sheet)
        plain = re.sub(r"@[^{};]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}", "", plain)
        for selectors, body in _RULE.findall(plain):
            gone, seen = styled(body)
            if gone or seen:
                for own in (s.strip() for s in selectors.split(",")):
                    if _SIMPLE.fullmatch(own):
                        old = out.get(own, (False, None))
                        out[own] = gone or old[0], seen or old[1]
    return out


def styled(style: str) -> tuple[bool, str | None]:
    """Whether a style takes an element away with all that is inside, and its visibility, which what is inside may overrule."""
    gone, seen = False, None
    for d in re.sub(r"\s|!important", "", style.lower()).split(";"):
        gone |= d == "display:none"
        if d in ("visibility:hidden", "visibility:collapse", "visibility:visible"):
            seen = d[11:]
    return gone, seen


class Tree:
    """Builds the element tree: missing tags are implied, crossed and stray ones mended."""

    def __init__(self) -> None:
        self.root = Node("body")
        self.stack = [self.root]
        self.open: Counter = Counter()
        self.sheets: list[str] = []

    def push(self, node: Node) -> None:
        self.add(node)
        if len(self.stack) < DEPTH:
            self.stack.append(node)
            self.open[node.name] += 1

    def pop(self) -> Node:
        node = self.stack.pop()
        self.open[node.name] -= 1
        return node

    def add(self, item: Node | str) -> None:
        """Into the open element; what doesn't belong between the parts of a table goes before the table."""
        top = self.stack[-1]
        if top.name in TABLE_PARTS and not (isinstance(item, Node) and item.name in ("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup", "col", "script", "style", "template")):
            if isinstance(item, str) and not item.strip(" \t\n\f\r"):
                return
            for node in reversed(self.stack):
                if node.name == "table":
                    node.before.append(item)
                    return
        top.children.append(item)

    def find(self, names: set[str], stop: set[str]) -> bool:
        """Whether one of ``names`` is open and no element of ``stop`` stands in between."""
        if not any(self.open[x] for x in names):
            return False
        for node in reversed(self.stack):
            if node.name in names:
                return True
            if node.name in stop:
                return False
        return False

    def close(self, names: set[str], stop: set[str]) -> None:
        if self.find(names, stop):
            while self.pop().name not in names:
                pass

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if name in ("html", "head", "body"):
            if name == "body":
                self.root.attrs = attrs | self.root.attrs
            return
        if name in CLOSES_P:
            self.close({"p"}, SCOPE | {"button"})
        if name in HEADINGS and self.stack[-1].name in HEADINGS:
            self.pop()
        elif name in SPECIAL_LISTS:
            self.close({"li"} if name == "li" else {"dt", "dd"}, SCOPE | SPECIAL_LISTS[name])
        elif name in ("option", "optgroup"):
            self.close({"option"}, SCOPE | {"select"})
            if name == "optgroup":
                self.close({"optgroup"}, SCOPE | {"select"})
        elif name in ("rt", "rp"):
            self.close({"rt", "rp"}, SCOPE | {"ruby"})
        elif name in ("button", "a") and self.open[name]:
            self.close({name}, SCOPE)
        elif name in ("td", "th"):
            self.close({"td", "th", "caption"}, {"table"})
            if self.open["table"] and self.stack[-1].name in ("table", "tbody", "thead", "tfoot"):
                self.start("tr", {})
        elif name == "tr":
            self.close({"tr", "caption"}, {"table"})
            if self.stack[-1].name == "table":
                self.push(Node("tbody"))
        elif name in ("tbody", "thead", "tfoot", "caption", "colgroup"):
            self.close({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"})
        if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "col", "colgroup") and not self.open["table"]:
            return  # cells without a table are no elements; their text is
        if name == "table" and self.stack[-1].name in TABLE_PARTS:
            self.close({"table"}, {"td", "th", "caption"})
        node = Node(name, attrs)
        if name in VOID:
            self.add(node)
        else:
            self.push(node)

    def end(self, name: str) -> None:
        if name == "br":
            self.add(Node("br"))
        elif name == "p" and not self.find({"p"}, SCOPE | {"button"}):
            self.add(Node("p"))
        elif name in HEADINGS:
            self.close(HEADINGS, SCOPE)
        elif name in ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
            self.close({name}, {"table"} - {name} | ({"td", "th"} if name == "tr" and self.stack[-1].name == "table" else set()))
        elif name == "li":
            self.close({"li"}, SCOPE | SPECIAL_LISTS["li"])
        elif name not in ("html", "body", "head") and self.open[name]:
            self.close({name}, SCOPE | {"li"} if name not in BLOCK else SCOPE)

    def build(self, text: str) -> Tree:
        for token in tokens(text):
            if token[0] == "start":
                self.start(token[1], token[2])
            elif token[0] == "end":
                self.end(token[1])
            elif token[0] == "text":
                self.add(html.unescape(token[1]))
            else:
                top = self.stack[-1]
                top.children.append(token[1])
                if top.name == "style":
                    self.sheets.append(token[1])
        return self


class Page:
    """Lines of text under construction: breaks are asked for and made when text follows."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.margin, self.first = "", None
        self.blank, self.space = 0, False

    def text(self, s: str) -> None:
        """Inline text with white space collapsed, across elements too."""
        words = _SPACES.sub(" ", s)
        if not words:
            return
        if words[0] == " ":
            self.space, words = True, words[1:]
        if not words:
            return
        trail = words[-1] == " "
        if trail:
            words = words[:-1]
        if self.line and self.space:
            self.line.append(" ")
        self.line.append(words)
        self.space = trail

    def verbatim(self, s: str) -> None:
        for i, part in enumerate(s.replace("\r\n", "\n").split("\n")):
            if i:
                self.newline()
            if part:
                self.line.append(part.expandtabs(8))

    def newline(self) -> None:
        """Ends the line, empty or not."""
        own = "".join(self.line)
        start = self.margin
        if own and self.first is not None:
            start, self.first = self.first, None
        if own:
            if self.lines and self.blank:
                self.lines.extend([""] * self.blank)
            self.blank = 0
            self.lines.append((start + own).rstrip(" \t"))
        elif self.lines:
            self.blank = min(self.blank + 1, 2)
        self.line, self.space = [], False

    def block(self, blanks: int = 0) -> None:
        """Text that follows begins a line, after ``blanks`` empty lines at least."""
        if self.line:
            self.newline()
        self.space = False
        if self.lines:
            self.blank = max(self.blank, blanks)

    def result(self) -> list[str]:
        self.block()
        return self.lines


def _number(x: str | None, default: int, low: int = 1) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", x or "")
    return max(low, int(m[1])) if m else default


def ordinal(n: int, kind: str) -> str:
    """n as the marker of an ordered list: 1, a, A, i or I."""
    if kind in ("a", "A") and n > 0:
        out = ""
        while n > 0:
            n, r = divmod(n - 1, 26)
            out = chr(97 + r) + out
        return out.upper() if kind == "A" else out
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, digits in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out += digits * (n // value)
            n %= value
        return out.upper() if kind == "I" else out
    return str(n)


class Layout:
    def __init__(self, selectors: dict[str, tuple[bool, str | None]]):
        self.selectors = selectors

    def style(self, node: Node) -> tuple[bool, str | None]:
        """styled() of a node by the rules for its tag, class and id and by its own style, the later ones before the earlier."""
        a = node.attrs
        gone, seen = False, None
        if self.selectors:
            keys = [node.name]
            for c in a.get("class", "").split():
                keys += [f".{c}", f"{node.name}.{c}"]
            if "id" in a:
                keys += [f"#{a['id']}", f"{node.name}#{a['id']}"]
            for k in keys:
                if k in self.selectors:
                    gone, seen = gone or self.selectors[k][0], self.selectors[k][1] or seen
        if "style" in a:
            own = styled(a["style"])
            gone, seen = gone or own[0], own[1] or seen
        return gone, seen

    def hidden(self, node: Node) -> bool:
        return node.name in HIDDEN or "hidden" in node.attrs or (node.name == "dialog" and "open" not in node.attrs) or self.style(node)[0]

    def unveil(self, root: Node) -> None:
        """Takes out text whose visibility is hidden. Elements left empty by it go, but for cells, which keep their columns."""
        order: list[tuple[Node, bool]] = []
        left = [(root, True)]
        while left:
            node, seen = left.pop()
            own = self.style(node)[1]
            seen = seen if own is None else own == "visible"
            order.append((node, seen))
            left += [(x, seen) for x in (*node.children, *node.before) if isinstance(x, Node)]
        gone: set[int] = set()
        for node, seen in reversed(order):
            node.children, node.before = ([x for x in own if (id(x) not in gone if isinstance(x, Node) else seen)] for own in (node.children, node.before))
            if not seen and not node.children and not node.before and node.name not in ("td", "th", "tr"):
                gone.add(id(node))

    def _drawn(self, svg: Node) -> list:
        """The shown texts of a drawing, with spaces round them; shapes and their groups have none of their own."""
        out: list = []
        left = list(reversed(svg.children))
        while left:
            x = left.pop()
            if isinstance(x, Node) and x.name not in UNDRAWN and not self.hidden(x):
                if x.name in DRAWN:
                    out += [" ", x, " "]
                else:
                    left += reversed(x.children)
        return out

    def render(self, nodes: list, page: Page) -> None:
        """Walks the tree with a stack of its own: (node, entered) and functions to call on the way out."""
        stack: list = [(x, False) for x in reversed(nodes)]
        while stack:
            item, pre = stack.pop()
            if callable(item):
                item()
                continue
            if isinstance(item, str):
                item = item.replace("\xa0", " ") if pre else item
                if pre:
                    page.verbatim(item)
                else:
                    for i, part in enumerate(item.split("\xa0")):  # a hard space doesn't collapse
                        if i:
                            if page.space and page.line:
                                page.line.append(" ")
                            page.line.append(" ")
                            page.space = False
                        page.text(part.replace("\xad", "").replace("​", ""))
                continue
            if self.hidden(item):
                continue
            name = item.name
            if name == "br":
                page.newline()
            elif name == "hr":
                page.block(1)
            elif name == "input":
                kind = item.attrs.get("type", "text").lower()
                if kind not in ("hidden", "checkbox", "radio", "file", "image", "password", "color", "range"):
                    page.text(f" {item.attrs.get('value', '')} ")
            elif name == "select":
                chosen = [o for o in self._options(item) if "selected" in o.attrs] or self._options(item)[:1]
                stack += [(x, pre) for o in reversed(chosen) for x in reversed(o.children)]
            elif name == "table":
                self.render(item.before, page)
                self.table(item, page)
            elif name in ("ul", "ol", "menu", "dir"):
                self.list(item, page, stack, pre)
            elif name == "svg":
                stack += [(x, pre) for x in reversed(self._drawn(item))]
            elif name in UNREAD:
                continue
            elif name == "details" and "open" not in item.attrs:
                page.block()
                stack.append((page.block, pre))
                stack += [(x, pre) for x in [x for x in item.children if isinstance(x, Node) and x.name == "summary"][:1]]
            elif name == "q":
                stack += [("”", pre), *((x, pre) for x in reversed(item.children)), ("“", pre)]
            else:
                block, gap = name in BLOCK, 1 if name in SPACED else 0
                inner = pre or name in ("pre", "listing", "xmp", "textarea", "plaintext")
                children = item.children
                if inner and not pre and children and isinstance(children[0], str):
                    children = [re.sub(r"^\r?\n", "", children[0]), *children[1:]]
                if block:
                    page.block(gap)
                    stack.append((lambda g=gap: page.block(g), pre))
                    if name in ("blockquote", "dd"):
                        old = page.margin
                        page.margin += "  "
                        stack.append((self._restore(page, old), pre))
                stack += [(x, inner) for x in reversed(children)]

    @staticmethod
    def _options(select: Node) -> list[Node]:
        out, left = [], list(reversed(select.children))
        while left:
            x = left.pop()
            if isinstance(x, Node):
                if x.name == "option":
                    out.append(x)
                else:
                    left += reversed(x.children)
        return out

    @staticmethod
    def _restore(page: Page, margin: str):
        def leave() -> None:
            page.block()
            page.margin, page.first = margin, None

        return leave

    def list(self, item: Node, page: Page, stack: list, pre: bool) -> None:
        ordered = item.name == "ol"
        own = [x for x in item.children if isinstance(x, Node) and x.name == "li"]
        step = -1 if "reversed" in item.attrs else 1
        number = _number(item.attrs.get("start"), len(own) if step < 0 else 1, -(10**9))
        gap = 0 if page.margin or page.first is not None else 1
        todo: list = [(lambda: page.block(gap), pre)]

        def enter(marker: str):
            def call() -> None:
                page.block()
                page.first = (page.margin if page.first is None else page.first) + marker
                page.margin += " " * len(marker)

            return call

        for x in item.children:
            if isinstance(x, Node) and x.name == "li":
                if self.hidden(x):
                    continue
                if "value" in x.attrs:
                    number = _number(x.attrs["value"], number, -(10**9))
                marker = f"{ordinal(number, item.attrs.get('type', '1'))}. " if ordered else "- "
                number += step
                outer: dict = {}

                def keep(outer=outer) -> None:
                    page.block()
                    outer["m"] = page.margin

                def leave(outer=outer) -> None:
                    page.block()
                    page.margin, page.first = outer["m"], None

                todo += [(keep, pre), (enter(marker), pre), *((c, pre) for c in x.children), (leave, pre)]
            else:
                todo.append((x, pre))
        todo.append((lambda: page.block(gap), pre))
        stack += reversed(todo)

    def table(self, item: Node, page: Page) -> None:
        captions, rows = [], []
        heads, bodies, feet = [], [], []
        for part in item.children:
            if not isinstance(part, Node) or self.hidden(part):
                continue
            if part.name == "caption":
                captions.append(part)
            elif part.name == "tr":
                bodies.append(part)
            elif part.name in ("thead", "tbody", "tfoot"):
                own = [x for x in part.children if isinstance(x, Node) and x.name == "tr" and not self.hidden(x)]
                {"thead": heads, "tbody": bodies, "tfoot": feet}[part.name].extend(own)
        for tr in heads + bodies + feet:
            rows.append([x for x in tr.children if isinstance(x, Node) and x.name in ("td", "th") and not self.hidden(x)])
        page.block(1)
        for c in captions:
            self.render(c.children, page)
            page.block()
        most = max((len(r) for r in rows), default=0)
        if most <= 1 or item.attrs.get("role") in ("presentation", "none") or any(self._nested(c) for r in rows for c in r):
            for r in rows:  # a table for layout: its cells are blocks
                for c in r:
                    page.block()
                    self.render(c.children, page)
                    page.block()
            page.block(1)
            return
        grid: list[list[tuple[int, int, list[str]]]] = []  # column, span, lines
        taken: dict[int, int] = {}  # column -> first row that is free again
        for i, r in enumerate(rows):
            at, own = 0, []
            for c in r:
                while taken.get(at, 0) > i:
                    at += 1
                cell = Page()
                self.render(c.children, cell)
                # a span matters to the alignment alone: past COLUMNS a cell takes one
                span = min(_number(c.attrs.get("colspan"), 1), most) if at < COLUMNS else 1
                down = _number(c.attrs.get("rowspan"), 1, 0) or len(rows)
                own.append((at, span, cell.result()))
                if down > 1:
                    taken |= dict.fromkeys(range(at, at + span), i + down) if at < COLUMNS else {}
                at += span
            grid.append(own)
        width: dict[int, int] = {}
        for own in grid:
            for at, span, lines in own:
                if span == 1:
                    width[at] = max(width.get(at, 0), min(WIDTH, max(map(len, lines), default=0)))
        used = sorted({at for own in grid for at, _, _ in own})
        start, x = {}, 0
        for at in used:
            start[at] = x
            x += width.get(at, 0) + 2
        for own in grid:
            for i in range(max((len(lines) for _, _, lines in own), default=0)):
                line = ""
                for at, _, lines in own:
                    if i < len(lines) and lines[i]:
                        line = line.ljust(start[at])
                        if line and not line.endswith("  "):  # a cell wider than its column
                            line += "  "
                        line += lines[i]
                if line:
                    page.block()
                    page.line.append(line)
                    page.newline()
        page.block(1)

    def _nested(self, cell: Node) -> bool:
        left = list(cell.children)
        while left:
            x = left.pop()
            if isinstance(x, Node):
                if x.name == "table":
                    return True
                left += x.children
        return False


def title_of(root: Node) -> str | None:
    """Text of the first title element."""
    left: list = [root]
    while left:
        x = left.pop()
        if isinstance(x, Node):
            if x.name == "title":
                return _SPACES.sub(" ", "".join(c for c in x.children if isinstance(c, str))).strip(" ")
            left += reversed(x.children)
    return None


def extract(text: str | None) -> tuple[str | None, str]:
    """(title, visible text) of a page."""
    tree = Tree().build(text or "")
    layout, page = Layout(hidden_selectors(tree.sheets)), Page()
    if not layout.hidden(tree.root):
        if "visibility" in (text or "").lower():
            layout.unveil(tree.root)
        layout.render(tree.root.children, page)
    return title_of(tree.root), "\n".join(page.result())
