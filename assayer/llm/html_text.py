"""Text of HTML pages as a reader sees it: a tree with implied tags, visibility rules, and layout.

A page is split into tags and text, built into a tree in which missing end tags are implied, and laid
out: blocks stand apart by line breaks or blank lines, list items carry their marker and depth, table
cells are padded so that columns align (row and column spans included), and what stands in a table
outside its cells comes before it.  What no reader sees is left out: scripts, styles, templates,
comments, ``hidden`` and ``aria-hidden`` elements, closed dialogs, options that are not chosen, drawings'
definitions, and what ``display:none`` or ``visibility:hidden`` conceals, said in a style attribute or by a
plain rule (tag, ``.class``, ``tag.class`` or ``#id``) of a style element.  ``visibility:visible`` shows
again what stands in a hidden parent.  All that is visible is kept, navigation and footers too, labels of
buttons, formulas, and the texts of drawings.  The content of ``details`` is kept, open or not.

Every step reads on from where the last one ended, open elements are counted by tag, and a table that would
take blanks out of proportion to its cells and text is not aligned, so time and output grow in proportion to
the page whatever it holds.  A table with a table inside is not aligned either; cells with lists or
preformatted text take several lines.

Defined cases: null html gives null, empty html an empty text; bytes after an unclosed ``<script>``,
comment or tag are hidden, stray end tags are ignored, ``<`` before a space is text; very long and deeply
nested
pages are laid out without recursion (lists deeper than DEEPEST share an indent); character references of
any length are read, those beyond Unicode as U+FFFD; numbers of lists beyond 32 bits count as not given;
lines of cells beyond WIDEST characters stand whole but do not widen their column; other columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard: element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "head script style template noscript iframe object canvas audio video datalist colgroup annotation annotation-xml rp".split()
)
#: Not shown inside a drawing.
UNDRAWN = frozenset("title desc metadata defs symbol clippath mask marker pattern".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot"
    " th thead title tr ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure article section main fieldset".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption title legend li dd dt".split())
#: Opening the key ends an open element of the values, if none of the bounds lies between.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
P_BOUNDS = frozenset({"td", "th", "table", "button", "caption", "li", "object"})
#: Opening one of these ends a drawing or formula, unless inside one of INTEGRATION.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr"
    " ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
FOREIGN = frozenset({"svg", "math"})
#: What gives a table's cell lines of its own, and what a table that is not aligned has inside.
LINED, NESTED = frozenset("ul ol menu dl pre".split()), frozenset({"table"})
ROMAN = tuple(zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "M CM D CD C XC L XL X IX V IV I".split()))
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: Labels of buttons that carry none.
BUTTONS = {"submit": "Submit", "reset": "Reset", "button": "", "image": ""}
UNSEEN_INPUTS = frozenset("hidden checkbox radio file password range color".split())

NEXT_TAG = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z]|/)")
TAG_NAME = re.compile(r"[^ \t\n\r\f/>]+")
COMMENT_END = re.compile(r"--!?>")
GAP = re.compile(r"[ \t\n\r\f/]*")
NAME = re.compile(r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*")
EQUALS = re.compile(r"[ \t\n\r\f]*=[ \t\n\r\f]*")
BARE = re.compile(r"[^ \t\n\r\f>]*")
DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*([a-z-]+)", re.I)
VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*([a-z]+)", re.I)
SELECTOR = re.compile(r"([a-zA-Z][\w-]*)?([.#][\w-]+)?")
SPACES = re.compile(r"[ \t\n\r\f]+")
LONG_REFERENCE = re.compile(r"&#([0-9]{12,});?")
INTEGER = re.compile(r"[ \t\n\r\f]*([+-]?)([0-9]+)")
#: A longer line of a cell stands whole, but does not widen its column: one long remark leaves the other rows readable.
WIDEST = 500
#: A table is aligned if that takes no more blanks than these for each cell and each character of its text; so
#: output grows in proportion to the page whatever its spans are.
BLANKS_PER_CELL, BLANKS_PER_CHARACTER = 40, 10
#: Levels of lists that are indented.
DEEPEST = 40


def unescape(text: str) -> str:
    """Character references read as the standard says; numbers of any length, those beyond Unicode as U+FFFD."""

    def short(m: re.Match) -> str:
        digits = m[1].lstrip("0")
        return "\ufffd" if len(digits) > 7 else html.unescape(f"&#{digits or 0};")

    return html.unescape(LONG_REFERENCE.sub(short, text) if "&#" in text else text)


def integer(text: str, default: int) -> int:
    """The number that an attribute begins with; ``default`` if it has none, or one beyond 32 bits."""
    found = INTEGER.match(text)
    digits = found[2].lstrip("0") if found else ""
    if not found or len(digits) > 10:
        return default
    value = int(found[1] + (digits or "0"))
    return value if -(1 << 31) <= value < 1 << 31 else default


@dataclass(slots=True)
class Element:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


def _rest_of_tag(source: str, at: int) -> tuple[dict[str, str], bool, int] | None:
    """Attributes, whether the tag closes itself, and where it ends; none if it never does."""
    found: dict[str, str] = {}
    while True:
        begin, at = at, GAP.match(source, at).end()
        if at >= len(source):
            return None
        if source[at] == ">":
            return found, at > begin and source[at - 1] == "/", at + 1
        name = NAME.match(source, at)
        at, value = name.end(), ""
        if given := EQUALS.match(source, at):
            at = given.end()
            quote = source[at : at + 1]
            if quote in ("'", '"'):
                close = source.find(quote, at + 1)
                if close < 0:
                    return None
                value, at = source[at + 1 : close], close + 1
            else:
                bare = BARE.match(source, at)
                value, at = bare[0], bare.end()
        found.setdefault(name[0].lower(), unescape(value))


class _Builder:
    """The tree being built, with the places of open elements by tag."""

    def __init__(self):
        self.root = Element("#root")
        self.stack = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)

    def add(self, child) -> None:
        self.stack[-1].children.append(child)

    def open(self, e: Element) -> None:
        self.places[e.tag].append(len(self.stack))
        self.stack.append(e)

    def innermost(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def end(self, targets, bounds) -> bool:
        """End the innermost open element of ``targets`` and all in it, if none of ``bounds`` lies inside it."""
        at = self.innermost(targets)
        if not at or self.innermost(bounds) > at:
            return False
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()
        return True


_RAW_END = {tag: re.compile(rf"</{tag}(?=[ \t\n\r\f/>])", re.I) for tag in RAW}


def parse(source: str) -> tuple[Element, dict[str, dict[str, str]]]:
    """The tree of a page, and what its style elements say of display and visibility, by selector.

    End tags that the standard lets authors leave out are implied.
    """
    tree, rules, at = _Builder(), {}, 0

    def text(piece: str) -> None:
        if piece:
            tree.add(unescape(piece))

    while m := NEXT_TAG.search(source, at):
        text(source[at : m.start()])
        kind, at = m[0], m.end()
        if kind == "<!--":
            if source.startswith((">", "->"), at):
                at = source.index(">", at) + 1
            else:
                close = COMMENT_END.search(source, at)
                at = close.end() if close else len(source)
            continue
        if not kind[-1].isalpha():  # declarations and bogus comments
            close = source.find(">", at)
            at = close + 1 if close >= 0 else len(source)
            continue
        name = TAG_NAME.match(source, at - 1)
        tag = name[0].lower()
        rest = _rest_of_tag(source, name.end())
        if rest is None:
            at = len(source)
            break
        attributes, closes, at = rest
        if kind[1] == "/":
            if tag == "br":  # "</br>" is a line break
                tree.add(Element("br"))
            elif tag not in VOID:
                tree.end({tag}, {"table"} - {tag} if tag not in ("body", "html") else set())
            continue
        if tag in BREAKOUT and tree.innermost(FOREIGN):
            tree.end(FOREIGN, INTEGRATION)
        foreign = tree.innermost(FOREIGN) > tree.innermost(INTEGRATION)
        if tag in CLOSES_P and not foreign:
            tree.end({"p"}, P_BOUNDS)
        while tag in IMPLIED_END and tree.end(*IMPLIED_END[tag]):
            pass
        made = Element(tag, attributes)
        tree.add(made)
        if tag in VOID or closes and (foreign or tag in FOREIGN):
            continue
        if tag in RAW and not (foreign and tag not in ("script", "style")):
            close = _RAW_END[tag].search(source, at)
            inside = source[at : close.start()] if close else source[at:]
            at = len(source)
            if close:
                rest = _rest_of_tag(source, close.end())
                at = rest[2] if rest else len(source)
            if tag == "style":
                _read_rules(inside, rules)
            made.children.append(unescape(inside) if tag in ("textarea", "title") else inside)
            continue
        tree.open(made)
    text(source[at:])
    return tree.root, rules


def _declared(css: str) -> dict[str, str]:
    found = {}
    for name, pattern in (("display", DISPLAY), ("visibility", VISIBILITY)):
        for m in pattern.finditer(css):
            found[name] = m[1].lower()
    return found


def _read_rules(css: str, rules: dict[str, dict[str, str]]) -> None:
    """Add the plain rules of a style sheet; rules inside others (of media and the like) are left out."""
    kept, at = [], 0
    while (begin := css.find("/*", at)) >= 0:
        kept.append(css[at:begin])
        close = css.find("*/", begin + 2)
        at = close + 2 if close >= 0 else len(css)
    depth = 0
    for piece in "".join([*kept, css[at:]]).split("}"):
        opened = piece.count("{")
        if depth == 0 and opened == 1:
            selectors, _, declarations = piece.partition("{")
            said = _declared(declarations)
            for selector in selectors.split(",") if said else ():
                m = SELECTOR.fullmatch(selector.strip())
                if m and m[0]:
                    rules.setdefault((m[1] or "").lower() + (m[2] or ""), {}).update(said)
        depth = max(0, depth + opened - 1)


def _said(e: Element, rules: dict[str, dict[str, str]]) -> dict[str, str]:
    """What rules and the style attribute say of an element, the more specific ones last."""
    a, said = e.attributes, {}
    if rules:
        said |= rules.get(e.tag, {})
        classes = a.get("class", "").split()
        for prefix in ("", e.tag):
            for c in classes:
                said |= rules.get(f"{prefix}.{c}", {})
        if "id" in a:
            said |= rules.get(f"#{a['id']}", {})
    if a.get("style"):
        said |= _declared(a["style"])
    return said


def displayed(e: Element, rules: dict[str, dict[str, str]]) -> bool:
    """Whether an element is laid out at all."""
    a = e.attributes
    if e.tag in HIDDEN or a.get("aria-hidden", "").lower() == "true" or e.tag == "dialog" and "open" not in a:
        return False
    return _said(e, rules).get("display", "none" if "hidden" in a else "") != "none"


def shown(e: Element, rules: dict[str, dict[str, str]], parent: bool) -> bool:
    """Whether the text of an element is seen, given whether its parent's is."""
    said = _said(e, rules).get("visibility")
    return said == "visible" if said in ("visible", "hidden", "collapse") else parent


def chosen(select: Element, rules: dict[str, dict[str, str]]) -> list[Element]:
    """The options that a select shows: all of a list box, else the chosen one or the first."""
    options, todo = [], list(reversed(select.children))
    while todo:
        e = todo.pop()
        if isinstance(e, str) or not displayed(e, rules):
            continue
        if e.tag == "option":
            options.append(e)
        else:
            todo += reversed(e.children)
    if "multiple" in select.attributes or integer(select.attributes.get("size", ""), 0) > 1:
        return options
    picked = [o for o in options if "selected" in o.attributes]
    return picked[-1:] or [o for o in options if "disabled" not in o.attributes][:1]


class Page:
    """Lines being laid out.  Pending breaks are written only before more text, so none double up."""

    def __init__(self):
        self.out: list[str] = []
        self.breaks, self.space, self.mark = 0, False, ""

    def gap(self, lines: int) -> None:
        if self.out:
            self.breaks = max(self.breaks, lines)
        self.space = False

    def write(self, text: str, keep: bool = False) -> None:
        if keep:
            parts = [text]
        else:
            folded = SPACES.sub(" ", text)
            if folded == " " or not folded:
                self.space = self.space or bool(folded)
                return
            if folded[0] == " ":
                self.space = True
            parts = [folded.strip(" ")]
        if self.breaks:
            self.out.append("\n" * self.breaks)
        elif self.space and self.out and not self.mark:
            self.out.append(" ")
        self.out.append(self.mark + parts[0])
        self.breaks, self.mark = 0, ""
        self.space = not keep and folded[-1] == " "

    def text(self) -> str:
        return "".join(self.out)


def _parts(table: Element, rules: dict[str, dict[str, str]]) -> tuple[list[list[Element]], list[Element], list]:
    """Cells by row, captions, and what else is displayed in a table, in order.

    Rows and cells may lie under any other element; a cell outside a row makes a row.  An element without
    a row or a cell below it is no part of the grid and stays whole.
    """
    holds, todo = set(), [(table, False)]
    while todo:
        e, after = todo.pop()
        if after:
            if any(isinstance(c, Element) and (c.tag in ("tr", "td", "th") or id(c) in holds) for c in e.children):
                holds.add(id(e))
        elif displayed(e, rules) or e is table:
            todo.append((e, True))
            todo += [(c, False) for c in e.children if isinstance(c, Element) and c.tag not in ("td", "th", "caption")]
    rows, captions, stray, todo = [], [], [], [(iter(table.children), None)]
    while todo:
        children, row = todo[-1]
        child = next(children, None)
        if child is None:
            todo.pop()
        elif isinstance(child, str):
            stray.append(child)
        elif not displayed(child, rules):
            continue
        elif child.tag in ("td", "th"):
            if row is None:
                rows.append([child])
            else:
                row.append(child)
        elif child.tag == "tr":
            rows.append([])
            todo.append((iter(child.children), rows[-1]))
        elif id(child) in holds or child.tag in ("tbody", "thead", "tfoot"):
            todo.append((iter(child.children), row))
        elif child.tag == "caption":
            captions.append(child)
        else:
            stray.append(child)
    if all(isinstance(c, str) and not SPACES.sub("", c) for c in stray):
        stray = []
    return [r for r in rows if r], captions, stray


def _holds(root: Element, tags: frozenset[str]) -> bool:
    """Whether an element of ``tags`` lies inside."""
    todo = list(root.children)
    while todo:
        child = todo.pop()
        if isinstance(child, Element):
            if child.tag in tags:
                return True
            todo += child.children
    return False


def _cell_lines(cell: Element, rules: dict[str, dict[str, str]], seen: bool) -> list[str]:
    """The lines of a cell: those of its lists and preformatted text, else one."""
    text = render(cell, rules, shown(cell, rules, seen))
    if _holds(cell, LINED):
        return [line.rstrip() for line in text.split("\n") if line.strip()]
    return [x for x in [SPACES.sub(" ", text).strip()] if x]


def _span(cell: Element, name: str, most: int) -> int:
    """A span as the standard reads it: 1 unless a number, and ``most`` at most."""
    digits = cell.attributes.get(name, "").strip()
    if not (digits.isascii() and digits.isdecimal()):
        return 1
    digits = digits.lstrip("0")
    return most if len(digits) > 9 else min(int(digits or 0), most) or 1


def columns(rows: list[list[Element]]) -> list[list[tuple[int, int]]]:
    """The first column of each cell and the one behind its last; cells of rows above may reach down between."""
    free, edge, ends, out = [], 0, defaultdict(list), []  # free: gaps (from, to) left of the edge
    for r, row in enumerate(rows):
        for gap in ends.pop(r, ()):
            heapq.heappush(free, gap)
        after, places = [], []
        for cell in row:
            wide, deep = _span(cell, "colspan", 1000), _span(cell, "rowspan", len(rows) - r)
            if free:
                begin, end = heapq.heappop(free)
                while end - begin < wide and free and free[0][0] == end:
                    end = heapq.heappop(free)[1]
                if end == edge:
                    edge = max(edge, begin + wide)
                    end = edge
            else:
                begin, edge = edge, edge + wide
                end = edge
            if end > begin + wide:
                heapq.heappush(free, (begin + wide, end))
                end = begin + wide
            places.append((begin, end))
            (ends[r + deep] if deep > 1 else after).append((begin, end))
        for gap in after:
            heapq.heappush(free, gap)
        out.append(places)
    return out


def _table_lines(rows: list[list[Element]], rules: dict[str, dict[str, str]], seen: bool) -> list[str]:
    """The lines of a table; a row has as many as its longest cell.  Columns in which no text begins take no room."""
    cells = [[_cell_lines(c, rules, seen) for c in row] for row in rows]
    places = columns(rows)
    starts = sorted({begin for row, at in zip(cells, places) for x, (begin, _) in zip(row, at) if x})
    index = {c: i for i, c in enumerate(starts)}
    width = [0] * len(index)
    spanning = []
    for row, at in zip(cells, places):
        for x, (begin, end) in zip(row, at):
            n = max((len(line) for line in x if len(line) <= WIDEST), default=0)
            if n:
                first, behind = index[begin], bisect.bisect_left(starts, end)
                if behind - first > 1:
                    spanning.append((first, behind, n))
                else:
                    width[first] = max(width[first], n)
    for first, behind, n in spanning:
        width[behind - 1] += max(0, n - sum(width[first:behind]) - 2 * (behind - first - 1))
    before = [0]
    for w in width:
        before.append(before[-1] + w + 2)

    def placed(aligned: bool) -> list[list[tuple[int, str]]]:
        """For each line its texts, each with the blanks before it."""
        lines = []
        for row, at in zip(cells, places):
            filled = [(x, index[begin]) for x, (begin, _) in zip(row, at) if x]
            for k in range(max((len(x) for x, _ in filled), default=0)):
                parts, used = [], 0
                for x, place in filled:
                    # A column begins where it does in all rows, or behind a longer cell before it.
                    if k < len(x):
                        blank = max(before[place] - used if aligned else 0, 2 if parts else 0)
                        parts.append((blank, x[k]))
                        used += blank + len(x[k])
                lines.append(parts)
                filled = [f for f in filled if k + 1 < len(f[0])]
        return lines

    lines = placed(aligned=True)
    blanks, text = (sum(size(p) for parts in lines for p in parts) for size in (lambda p: p[0], lambda p: len(p[1])))
    if blanks > BLANKS_PER_CELL * sum(map(len, rows)) + BLANKS_PER_CHARACTER * text:
        lines = placed(aligned=False)
    return ["".join(" " * blank + x for blank, x in parts) for parts in lines]


def marker(number: int, kind: str) -> str:
    """The number of a list item as its list's type writes it."""
    if kind in ("a", "A") and number > 0:
        letters = ""
        while number:
            number, k = divmod(number - 1, 26)
            letters = chr(ord(kind) + k) + letters
        return letters
    if kind in ("i", "I") and 0 < number < 4000:
        roman = ""
        for value, sign in ROMAN:
            roman += sign * (number // value)
            number %= value
        return roman if kind == "I" else roman.lower()
    return str(number)


def render(root: Element, rules: dict[str, dict[str, str]], seen: bool = True) -> str:
    """The text of an element, laid out; an explicit stack, so depth is no limit.

    ``seen`` says whether text that stands in the element itself is.
    """
    page, todo, lists, pre = Page(), [("open", root)], [], 0
    state = [(seen, False)]  # whether text is seen, and whether it stands in a drawing outside its texts
    while todo:
        step, e = todo.pop()
        if step == "grid":
            rows, captions, seen = e
            page.gap(2)
            for line in [t for c in captions if (t := render(c, rules, shown(c, rules, seen)))] + _table_lines(rows, rules, seen):
                page.write(line, keep=True)
                page.gap(1)
            page.gap(2)
            continue
        if step == "leave":
            state.pop()
            continue
        if step == "close":
            state.pop()
            if e.tag == "pre":
                pre -= 1
            if e.tag in ("ul", "ol", "menu"):
                lists.pop()
            if e.tag in BLOCK:
                page.mark = "" if e.tag == "li" else page.mark
                page.gap(2 if e.tag in SPACED and not (e.tag in ("ul", "ol") and lists) else 1)
            elif e.tag in ("option", "button", "text"):
                page.space = True
            continue
        seen, drawn = state[-1]
        if isinstance(e, str):
            if not seen or drawn:
                continue
            if pre:
                lines = e.split("\n")
                for i, line in enumerate(lines):
                    if i:
                        page.out.append("\n" * page.breaks + "\n") if page.out else None
                        page.breaks = 0
                    if line:
                        page.write(line, keep=True)
            else:
                page.write(e)
            continue
        if e is not root:
            if not displayed(e, rules) or drawn and e.tag in UNDRAWN:
                continue
            seen = shown(e, rules, seen)
        if e.tag == "svg":
            drawn = True
        elif e.tag in ("text", "foreignobject"):
            page.space = page.space or drawn
            drawn = False
        if e.tag == "br":
            page.breaks = min(2, page.breaks + 1) if page.out else 0
            page.space = False
            continue
        if e.tag == "img":
            if seen and e.attributes.get("alt", "").strip():
                page.write(f" {e.attributes['alt']} ")
            continue
        if e.tag == "input":
            kind = e.attributes.get("type", "text").lower()
            label = e.attributes.get("alt" if kind == "image" else "value", BUTTONS.get(kind, ""))
            if seen and kind not in UNSEEN_INPUTS and label.strip():
                page.write(f" {label} ")
            continue
        if e.tag == "table" and e is not root and not _holds(e, NESTED):
            rows, captions, stray = _parts(e, rules)
            state.append((seen, drawn))
            todo += [("leave", None), ("grid", (rows, captions, seen))]
            todo += [("open", c) for c in reversed(stray)]
            continue
        if e.tag in BLOCK:
            page.gap(2 if e.tag in SPACED and not (e.tag in ("ul", "ol") and lists) else 1)
        if e.tag == "pre":
            pre += 1
        if e.tag in ("ul", "ol", "menu"):
            down = e.tag == "ol" and "reversed" in e.attributes
            items = sum(isinstance(c, Element) and c.tag == "li" and displayed(c, rules) for c in e.children) if down else 1
            lists.append([e.tag == "ol", integer(e.attributes.get("start", ""), items), -1 if down else 1, e.attributes.get("type", "1")])
        if e.tag == "li":
            ordered, number, step, kind = lists[-1] if lists else (False, 1, 1, "1")
            if ordered:
                number = integer(e.attributes.get("value", ""), number)
                lists[-1][1] = number + step
            page.mark = "  " * max(0, min(len(lists), DEEPEST) - 1) + (f"{marker(number, kind)}. " if ordered else "- ")
        state.append((seen, drawn))
        todo.append(("close", e))
        inner = e.children
        if e.tag == "select":
            inner = chosen(e, rules)
            page.space = True
        todo += [("open", c) for c in reversed(inner)]
    return page.text()


def to_text(source: str) -> str:
    return render(*parse(source))


def visible_text(page: Column) -> Column:
    """The laid-out text of a column of pages."""

    def lay_out(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else to_text(p) for p in pages.to_pylist()], pa.string())

    return F.arrow_udf(lay_out, "string")(page)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, text`` for every row."""
    return pages.select(F.col(id_col).alias("id"), visible_text(F.col(html_col).cast("string")).alias("text"))


def line_count(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.size(F.split(text, "\n", -1))).otherwise(0)
