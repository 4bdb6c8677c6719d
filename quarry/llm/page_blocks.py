"""Blocks of a page's text with what its markup says of them.

A small reader of tag soup: raw elements, comments, end tags that HTML lets one
leave out, unclosed tags at the end.  One pass, linear in the page's length.
"""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass, field

#: HTML's block-level, void, raw-text elements, and those whose content is no text of the page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
SILENT = frozenset("audio button canvas datalist head map noscript object select svg template video".split()) | RAW
CELLS = frozenset("caption table td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends, and where the search for it stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:"[^"]*"|'[^']*')|[^>])*+)>""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|style|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
_TOKEN = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

#: Words of a class, id or role that tell what an element holds.
SIDE_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising advertorial adverts alert alerts aside banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus discussion feedback foot footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification notifications outbrain overlay pager pagination paging paywall popular popup promo promoted promotion rail recommended recommendations register related replies reply respond responses search share sharing shoutbox sidebar signin signup skip social sponsor sponsored sponsors submenu subscribe subscription taboola tagcloud teaser teasers toolbar topbar trending widget widgets".split()
)
#: Of these, the ones that no wrapper of an article is named after.
FIRM_WORDS = frozenset("comment commentlist comments discussion disqus foot footer menu nav navigation replies reply respond responses".split())
#: The same where words are written as one.
_RUN_ON = re.compile(r"cookie|sidebar|newsletter|sponsor|advert|breadcrumb|navigation|masthead|^ad(?:s|box|slot|unit|space|zone|wrap|wrapper|container|block)s?$|^(?:nav|menu)|(?:nav|menu)$")
_RUN_ON_FIRM = re.compile(r"^comments?(?:$|area|box|form|list|section|thread|wrap|block|container)|comments?$|^footer|footer$")
MAIN_WORDS = frozenset("article articlebody blogpost body content entry main post prose story text".split())
SIDE_TAGS = frozenset("aside dialog footer form menu nav search".split())
MAIN_TAGS = frozenset("article main".split())


@dataclass
class Element:
    """side: 2 if its tag, its role or a firm word says boilerplate, 1 if another word does; main: 2 if tag or role say article, 1 if a word does."""

    tag: str
    parent: int
    side: int = 0
    main: int = 0
    chars: int = 0
    children: int = 0


@dataclass
class Block:
    """A run of text between two block boundaries, white space made one space."""

    text: str
    element: int
    linked: float = 0.0


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _hints(tag: str, attributes: str, in_main: bool) -> tuple[int, int]:
    side, main = (2 if tag in SIDE_TAGS or tag == "header" and not in_main else 0), (2 if tag in MAIN_TAGS else 0)
    if not attributes:
        return side, main
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "style":
            side = 2 if re.search(r"display\s*:\s*none", value, re.I) else side
        elif name == "hidden":
            side = 2
        else:
            words = {w.lower() for w in _TOKEN.findall(value)}
            firm = words & FIRM_WORDS or any(_RUN_ON_FIRM.search(w) for w in words)
            found = words & SIDE_WORDS | {w for w in words if _RUN_ON.search(w)} | ({"firm"} if firm else set())
            if found == {"header"} and (in_main or words & MAIN_WORDS):
                found = set()
            if found:
                side = max(side, 2 if firm or name == "role" else 1)
            if words & MAIN_WORDS:
                main = max(main, 2 if name == "role" else 1)
    return side, (0 if side else main)


def read_page(source: str) -> Page:
    """Elements (block-level ones, in the order they start) and blocks of a page."""
    page = Page([Element("", -1)])
    stack: list[tuple[str, int]] = []  # (tag, its element, or the one it lies in)
    counts: dict[str, int] = {}
    silent = mains = links = side_inline = 0
    words: list[str] = []
    sizes = [0, 0, 0]  # characters, in links, in inline elements that say boilerplate

    def at() -> int:
        return stack[-1][1] if stack else 0

    def flush() -> None:
        if words:
            text = " ".join("".join(words).split())
            if text:
                where = at()
                if sizes[2] > 0.8 * sizes[0]:  # such an inline element holds the block
                    page.elements.append(Element("span", where, side=1))
                    page.elements[where].children += 1
                    where = len(page.elements) - 1
                page.blocks.append(Block(text, where, min(1.0, sizes[1] / max(1, sizes[0]))))
            words.clear()
            sizes[:] = [0, 0, 0]

    def pop() -> None:
        nonlocal silent, mains, links, side_inline
        tag, where = stack.pop()
        counts[tag] -= 1
        silent -= tag in SILENT
        links -= tag == "a"
        if tag in BLOCKS:
            mains -= page.elements[where].main > 0
        elif tag.startswith("~"):
            side_inline -= 1

    def close(names: tuple[str, ...], stops: frozenset[str] | tuple[str, ...]) -> None:
        """Ends the innermost open element of these names, unless a stop comes first."""
        if not any(counts.get(n) for n in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                flush()
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in stops:
                return

    def say(chunk: str) -> None:
        if silent or not chunk:
            return
        chunk = references.unescape(chunk) if "&" in chunk else chunk
        words.append(chunk)
        n = len(chunk.strip())
        sizes[0] += n
        if links:
            sizes[1] += n
        if side_inline:
            sizes[2] += n

    pos, n, last = 0, len(source), source.rfind(">")
    while pos < n:
        lt = source.find("<", pos)
        if lt < 0:
            say(source[pos:])
            break
        mark = source[lt + 1 : lt + 2]
        if not (mark.isascii() and mark.isalpha()) and mark not in ("/", "!", "?"):
            say(source[pos : lt + 1])
            pos = lt + 1
            continue
        say(source[pos:lt])
        if source.startswith("<!--", lt):
            end = lt + 4 if source.startswith((">", "->"), lt + 4) else source.find("-->", lt + 4)
            pos = n if end < 0 else source.find(">", end) + 1
            continue
        if lt > last:
            break  # a tag that the page's end cuts
        m = _TAG.match(source, lt)
        if not m:
            pos = source.find(">", lt) + 1
            continue
        pos, tag = m.end(), m[2].lower()
        if tag in ("html", "body"):
            if not m[1]:
                close(("head",), ())
            continue
        if m[1]:
            if tag == "br":
                say(" ")
            elif tag in SILENT:
                close((tag,), ())
            elif tag in BLOCKS:
                flush()
                if tag in HEADINGS:
                    close(tuple(HEADINGS), CELLS)
                else:
                    close((tag,), () if tag in CELLS or tag in ENDS else CELLS)
            elif counts.get(tag) or counts.get("~" + tag):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in (tag, "~" + tag):
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i][0] in BLOCKS:
                        break
            continue
        if tag in VOID:
            if tag == "br":
                say(" ")
            elif tag == "hr":
                flush()
                close(("p",), CELLS)
            continue
        if tag == "svg" and m[3].endswith("/"):
            continue
        block = tag in BLOCKS
        if block:
            flush()
            close(("head",), ())
            if tag in ENDS:
                close(*ENDS[tag])
            close(("p",), CELLS)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, pos)
            if not end:
                break
            gt = source.find(">", end.end())
            pos = n if gt < 0 else gt + 1
            continue
        if block:
            side, main = _hints(tag, m[3], mains > 0)
            page.elements.append(Element(tag, at(), side, main))
            page.elements[at()].children += 1
            stack.append((tag, len(page.elements) - 1))
            mains += main > 0
        else:
            if tag not in SILENT and m[3] and tag not in ("a", "br") and _hints(tag, m[3], True)[0]:
                tag = "~" + tag
                side_inline += 1
            stack.append((tag, at()))
            silent += tag in SILENT
            links += tag == "a"
        counts[tag] = counts.get(tag, 0) + 1
    flush()
    for b in page.blocks:
        page.elements[b.element].chars += len(b.text)
        page.elements[b.element].children += 1
    for e in reversed(page.elements[1:]):
        page.elements[e.parent].chars += e.chars
    return page
