"""Main text of web pages by tree scoring.

Every paragraph passes points for its length and its commas to the elements around it, fewer
the further away; an element's points are discounted by the share of its text inside links.
The best container is kept with those siblings that hold a container of a fifth of its worth, and
with the headings and paragraphs beside it; inside an article the same holds on every level up to it.

What is named or marked as menu, header, footer, sidebar, notice, advert, form or reader comment
goes with all that stands in it, however much that is, before points are given.  Two things guard
against names of wrappers: a form, widget or header around the page's only article or main part is none,
and where no paragraph at all would be left, the names that may be wrappers (forms, widgets, headers first, then
sidebars and boxes) give way one after the other until there is one.  Menus, footers, adverts, comments and
notices of consent never do.

Null and empty pages give an empty text.  Pages may be cut off anywhere: an open tag or comment
at the end is dropped, an open element ends with the page.  A page is a unit of any length: its tree is
held in memory, and work grows with its blocks times their depth.  Equal rows give equal results; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wattframe.llm.common import small

# Elements by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript template iframe svg math".split())
DROPPED = frozenset("head button select option label menu object audio video canvas".split())
#: Elements that are dropped unless the page's article stands in them, or too much of its text.
MARKED = frozenset("nav footer aside header form fieldset dialog".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var img wbr".split()
)
#: Elements whose text counts for the one around them; any other block's counts for itself.
PARAGRAPH = frozenset("p pre blockquote td th li dt dd figcaption caption summary address".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLING_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"),
}
SCOPE = frozenset("ul ol table dl body html".split())
NEVER = frozenset("html body main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adbox|adslot|adunit|adsense|advert|adverts|advertisement|advertising|sponsor|sponsored|"
    r"promo|promotion|banner|nav|navbar|navigation|subnav|topnav|sidenav|menu|menus|submenu|breadcrumb|breadcrumbs|"
    r"sidebar|aside|footer|masthead|topbar|comment|comments|commentlist|commentform|commenter|disqus|respond|reply|"
    r"replies|notice|notices|alert|cookie|cookies|consent|gdpr|popup|modal|overlay|form|"
    r"newsletter|subscribe|subscription|share|sharing|social|related|recommended|widget|login|signup|pagination|"
    r"pager|toolbar|skip)(?:$|[\s_-])",
    re.I,
)
HEADER = re.compile(r"(?:^|[\s_-])(?:header|head)(?:$|[\s_-])", re.I)
#: Names that say what else is on the page.
NEUTRAL = re.compile(r"(?<![^\s])(?:\S*[_-])?(?:has|with|without|no|is)[_-]\S*", re.I)
#: Where names are written in one: the parts of commentSection are two words.
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: The only names that speak against an article itself.
NO_ARTICLE = frozenset(
    "comment comments commentlist commenter reply replies respond related recommended ad ads advert adverts "
    "advertisement sponsored sponsor".split()
)
#: Marks that may belong to a wrapper of the whole page, and marks that may be wrong about a part of it.
WRAPPERS = frozenset("<form> <fieldset> <header> form header widget banner masthead topbar overlay".split()) | {
    "role form", "role banner"
}
BOXES = frozenset(
    "<aside> aside sidebar promo promotion popup modal related recommended notice notices".split()
) | {"role complementary"}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(>|\Z)|<(?=[/a-zA-Z])[^>]*(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    __slots__ = ("tag", "parent", "dropped", "mark", "text", "linked", "points", "most", "children")

    def __init__(self, tag: str, parent: "Node | None", dropped: bool):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.mark = ""
        self.text = self.linked = 0
        self.points = 0.0
        self.most = 0.0  # the best worth of it and what it holds
        self.children: list[Node] = []


class Page:
    """Blocks of text in page order and the elements they stand in."""

    def __init__(self, source: str):
        self.root = Node("#root", None, False)
        self.blocks: list[tuple[Node, str, int]] = []
        self._at, self._inline, self._links = self.root, [], 0
        self._said: list[str] = []
        self._linked = 0
        self._marked = False
        self._articles: list[Node] = []
        self._read(source)
        self._settle()

    def _read(self, source: str) -> None:
        last, end = 0, len(source)
        while last < end:
            found = _TOKEN.search(source, last)
            self._say(source[last : found.start() if found else end])
            if not found:
                break
            last = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                self._close(tag)
            elif tag in RAW:
                if not found[3].endswith("/") or tag not in ("svg", "math"):
                    last = _raw_end(source, tag, last)
            else:
                self._open(tag, found[3])
        self._flush()

    def _say(self, text: str) -> None:
        if text and not self._at.dropped:
            self._said.append(text)
            if self._links:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._said:
            text = " ".join(html.unescape("".join(self._said)).split())
            if text:
                self.blocks.append((self._at, text, min(self._linked, len(text))))
            self._said, self._linked = [], 0

    def _open(self, tag: str, rest: str) -> None:
        if tag == "br":
            self._say("\n")
        if tag in VOID:
            if tag == "hr":
                self._flush()
            return
        if tag in INLINE:
            self._links += tag == "a"
            if tag != "a" and _hidden(rest):
                self._flush()
                self._push(tag, True)
            return
        self._flush()
        self._links = 0
        if tag in CLOSES_P:
            self._end(("p",), SCOPE | {"article", "section", "div", "td", "th", "li", "blockquote"})
        if tag in SIBLING_ENDS:
            self._end(SIBLING_ENDS[tag], SCOPE - {"body", "html"} if tag in ("li", "dt", "dd") else {"table"})
        self._push(tag, self._at.dropped or tag in DROPPED or _hidden(rest))
        node = self._at
        if node.dropped:
            return
        node.mark = self._mark(tag, rest)
        if node.mark:
            self._marked = True
        elif tag in ("article", "main"):
            self._articles.append(node)

    def _push(self, tag: str, dropped: bool) -> None:
        node = Node(tag, self._at, dropped)
        self._at.children.append(node)
        self._at = node

    def _end(self, tags: tuple[str, ...], scope: frozenset | set) -> None:
        node = self._at
        while node.parent and node.tag not in tags:
            if node.tag in scope:
                return
            node = node.parent
        if node.parent:
            self._at = node.parent

    def _close(self, tag: str) -> None:
        if tag == "a":
            self._links = max(0, self._links - 1)
        if tag == "br":
            self._say("\n")
        if tag in INLINE and self._at.tag != tag:
            return
        node = self._at
        while node.parent and node.tag != tag:
            node = node.parent
        if tag == "p" and not node.parent:
            self._flush()
        if node.parent:
            self._flush()
            self._links = 0
            self._at = node.parent

    def _within(self, tags: tuple[str, ...]) -> bool:
        node = self._at.parent
        while node:
            if node.tag in tags:
                return True
            node = node.parent
        return False

    def _mark(self, tag: str, rest: str) -> str:
        """What an element is named or marked as; empty if nothing speaks against it."""
        if tag in NEVER:
            return ""
        if tag in MARKED and tag != "header":
            return f"<{tag}>"
        if tag == "header":
            return "" if self._within(("article", "main")) else "<header>"
        if not rest.strip():
            return ""
        named = dict((m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest))
        if named.get("role", "").lower() in ROLES:
            return f"role {named['role'].lower()}"
        names = NEUTRAL.sub(" ", HUMP.sub(" ", f"{named.get('class', '')} {named.get('id', '')}"))
        # names share their separators, so each search starts at the last one's end
        at = 0
        while found := NAMES.search(names, at):
            name = found[0].strip(" \t\r\n\f_-").lower()
            if tag != "article" or name in NO_ARTICLE:
                return name
            at = max(found.end() - 1, at + 1)
        return "header" if tag != "article" and HEADER.search(names) and not self._within(("article", "main")) else ""

    def _settle(self) -> None:
        """Leaves the blocks outside marked elements.  ``above`` of a block: the marks it stands in."""
        if not self._marked:
            return
        wraps = self._wrappers()
        above: dict[int, frozenset] = {id(self.root): frozenset()}
        listed = []
        for block in self.blocks:
            chain, at = [], block[0]
            while id(at) not in above:
                chain.append(at)
                at = at.parent
            for at in reversed(chain):
                outer = above[id(at.parent)]
                above[id(at)] = outer | {at.mark} if at.mark and id(at) not in wraps else outer
            listed.append((block, above[id(block[0])]))
        free: frozenset = frozenset()
        for tier in (WRAPPERS, WRAPPERS | BOXES):
            tier = set(tier) - free
            while tier and not any(marks <= free and is_paragraph(block) for block, marks in listed):
                # the mark that alone hides most of the page
                hidden = {m: 0.0 for m in tier}
                for block, marks in listed:
                    rest = marks - free
                    if len(rest) == 1 and rest <= tier and is_paragraph(block):
                        hidden[next(iter(rest))] += points(block[1]) * (1 - block[2] / len(block[1]))
                most = max(sorted(hidden), key=hidden.__getitem__)
                if not hidden[most]:
                    # or marks in one another, which only give way together
                    inner = [m for block, marks in listed for m in sorted(marks & tier) if marks - free <= tier]
                    if not inner:
                        break
                    most = inner[0]
                free |= {most}
                tier.discard(most)
        self.blocks = [block for block, marks in listed if marks <= free]

    def _wrappers(self) -> set[int]:
        """Elements with a wrapper's mark around articles, if all of the page's articles stand in marked
        ones.  Beside an article that does not, those are teasers."""
        around: set[int] = set()
        for node in self._articles:
            at, chain, others = node.parent, [], False
            while at:
                if at.mark:
                    chain.append(id(at))
                    others = others or at.mark not in WRAPPERS
                at = at.parent
            if not chain:
                return set()
            if not others:
                around.update(chain)
        return around


def _hidden(rest: str) -> bool:
    low = rest.lower()
    if "hidden" not in low and "none" not in low:
        return False
    named = dict((m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(low))
    style = named.get("style", "").replace(" ", "")
    return "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in style


def _raw_end(source: str, tag: str, start: int) -> int:
    """Where an element ends whose content is not markup; the end of the page if it never does."""
    close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, start)
    return close.end() if close else len(source)


def points(text: str) -> float:
    return 1 + text.count(",") + min(len(text) / 100, 3)


def is_paragraph(block: tuple[Node, str, int]) -> bool:
    """Whether a block gives points to what is around it."""
    return block[0].tag not in HEADING and block[2] < len(block[1])


def best(page: Page) -> Node | None:
    """The element with most points per share of text outside links.  Headings count only on a
    page without any other text."""
    found: dict[int, Node] = {}
    for node, text, linked in page.blocks:
        up: Node | None = node
        while up:
            up.text += len(text)
            up.linked += linked
            up = up.parent
    scored = [b for b in page.blocks if is_paragraph(b)] or page.blocks
    for node, text, linked in scored:
        level = 0
        given = points(text) * (1 - linked / len(text))
        up = node.parent if node.tag in PARAGRAPH or node.tag in HEADING else node
        up = up or page.root
        while up:
            up.points += given / (1, 2, 3, 6, 9, 12)[min(level, 5)]
            found[id(up)] = up
            level += 1
            up = up.parent
    top, most = None, 0.0
    for node in found.values():
        worth = node.points * (1 - node.linked / max(node.text, 1))
        if worth > most:
            top, most = node, worth
        up = node
        while up and up.most < worth:
            up.most = worth
            up = up.parent
    return top


#: Part of the best container's worth that a sibling holds to be kept, and share of links in a line.
SIBLING, LINKED = 0.2, 0.25


def kept(page: Page) -> set[int]:
    """Elements whose blocks are the main text."""
    top = best(page)
    if top is None:
        return set()
    least = SIBLING * top.points * (1 - top.linked / max(top.text, 1))
    out, at = {id(top)}, top
    inside, up = False, top
    while up := up.parent:
        inside = inside or up.tag == "article"
    while at.parent and at.tag not in ("article", "body", "html", "main", "#root"):
        for near in at.parent.children:
            line = near.tag == "p" or near.tag in HEADING or (near.tag in ("header", "hgroup") and inside)
            if near.most >= least or (line and near.text and near.linked < LINKED * near.text):
                out.add(id(near))
        at = at.parent
        if not inside:
            break
    return out


def main_text(source: str | None) -> str:
    """The main text of a page, blocks parted by an empty line."""
    if not source:
        return ""
    page = Page(source)
    roots = kept(page)
    inside: dict[int, bool] = {}

    def within(node: Node) -> bool:
        chain, at = [], node
        while at and id(at) not in inside:
            chain.append(id(at))
            if id(at) in roots:
                inside[id(at)] = True
                break
            at = at.parent
        answer = inside[id(at)] if at else False
        inside.update(dict.fromkeys(chain, answer))
        return answer

    return "\n\n".join(text for node, text, _ in page.blocks if within(node))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id").cast(pa.int64()),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    schema = "page_id long, url string, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
