"""Main text of web pages by minimum-cut labelling.

A page's blocks and the elements that hold them are the vertices of a graph.  A
classifier's log-odds that a block is article text are its capacity to the
source or the sink; neighbouring blocks, and blocks and the elements they lie
in, are tied by edges, weaker where the markup changes its mind.  The minimum
cut separates content from boilerplate: an unsure block goes with what it
stands among, and only a sure one stands alone.

The classifier is a logistic regression over what ``features`` says, fitted on
pages that ``sample_pages`` makes from its own layouts (no table has labels),
with tests on pages written by hand.  Pages are independent: one pass, no
shuffle, a page at a time in memory.

Defined results: a null or empty html has an empty text; a page without markup
is one block; entities are decoded, white space in a block (also what ``<br>``
stands for) is one space; cells, items and paragraphs are blocks of their own;
a page's end may cut anything; repeated pages are rows of their own; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow
from .page_blocks import HEADINGS, Page, read_page

#: Units of capacity in one unit of log-odds; ties between neighbours, a block and its element, an element and its parent, in log-odds.
UNIT = 1000
NEXT_TIE, ELEMENT_TIE, PARENT_TIE = 0.6, 0.5, 0.4
#: Share of a tie that is left where one side's markup says boilerplate or article and the other's does not.
BROKEN = 0.05
#: Pages made for the fit.
FIT_PAGES = 400
#: Words of boilerplate, in the languages of the tables (fixed values).
SMALL_PRINT = ("©", "copyright", "all rights", "cookie", "newsletter", "subscribe", "sign in", "log in", "advert", "sponsor", "share", "follow us", "privacy", "datenschutz", "impressum", "anmelden", "werbung", "publicité", "connexion", "mentions légales", "s'abonner", "publicidad", "iniciar sesión", "aviso legal", "suscribirse")
_SMALL_PRINT = re.compile("|".join(rf"(?<!\\w){re.escape(w)}(?!\\w)" for w in SMALL_PRINT), re.I)
FEATURES = 18


def states(page: Page) -> tuple[list[int], list[int]]:
    """(side, main) of each element as its blocks have it: what the nearest element that says something says.

    A word that says boilerplate is not believed of an element that holds both
    an article and most of the page's text (a wrapper named after its sidebar).
    """
    elements, total = page.elements, max(1, page.elements[0].chars)
    holds = [False] * len(elements)
    for i in range(len(elements) - 1, 0, -1):
        if elements[i].main or holds[i]:
            holds[elements[i].parent] = True
    side, main = [0] * len(elements), [0] * len(elements)
    for i in range(1, len(elements)):
        e, up = elements[i], elements[i].parent
        wraps = e.side and holds[i] and 2 * e.chars > total and (e.side == 1 or e.tag in ("form", "header"))
        if e.side and not wraps:
            side[i], main[i] = max(e.side, side[up]), 0
        elif side[up]:
            side[i] = side[up]
        else:
            main[i] = max(e.main, main[up])
    return side, main


def features(page: Page, side: list[int], main: list[int]) -> np.ndarray:
    """A row for each block."""
    n, elements, blocks = len(page.blocks), page.elements, page.blocks
    linked = [0.0] * len(elements)
    for b in blocks:
        linked[b.element] += b.linked * len(b.text)
    for i in range(len(elements) - 1, 0, -1):
        linked[elements[i].parent] += linked[i]
    any_main = any(main)
    lengths = [len(b.text) for b in blocks]
    title = next((i for i, b in enumerate(blocks) if elements[b.element].tag == "h1" and not side[b.element]), 0)
    out = np.zeros((n, FEATURES))
    for i, b in enumerate(blocks):
        e, size = elements[b.element], lengths[i]
        up = elements[e.parent] if e.parent >= 0 else e
        sure = main[b.element] == 2  # the markup says article: what its words look like counts less
        near = (lengths[i - 1] if i else 0) + (lengths[i + 1] if i + 1 < n else 0)
        out[i] = (
            1, side[b.element] == 2, side[b.element] == 1, main[b.element] == 2, main[b.element] == 1, any_main and not main[b.element],
            math.log1p(size) / 6, b.linked, b.text[-4:].rstrip("\"')»”’ ").endswith((".", "!", "?", "…", ":", "。")), e.tag in ("p", "blockquote", "pre"), e.tag in HEADINGS, e.tag == "li", e.tag in ("td", "th"),
            linked[e.parent] / max(1, up.chars) if e.parent >= 0 and not sure else 0, size < 25 and e.tag not in HEADINGS, size < 300 and not sure and _SMALL_PRINT.search(b.text) is not None, math.log1p(near) / 6, i < title,
        )
    return out


def sample_pages(n: int = FIT_PAGES, seed: int = 11) -> list[tuple[str, list[tuple[str, bool]]]]:
    """Pages of many layouts, each with its blocks' texts and whether they belong to the article."""
    rng = np.random.default_rng(seed)
    syllables = ["la", "ter", "in", "mo", "che", "über", "ción", "ry", "and", "est", "qu", "ö", "ven", "st"]

    def word() -> str:
        return "".join(rng.choice(syllables, int(rng.integers(1, 4))))

    def phrase(a: int, b: int) -> str:
        return " ".join(word() for _ in range(int(rng.integers(a, b)))).capitalize()

    def sentences(k: int) -> str:
        return " ".join(phrase(3, 16) + str(rng.choice([".", ".", ".", "!", "?", "***", " ###"])) for _ in range(k))

    def pick(*of: str) -> str:
        return str(rng.choice(of))

    made = []
    for _ in range(n):
        style, truth, parts = pick("tags", "words", "words", "plain"), [], []

        def block(tag: str, text: str, keep: bool, inner: str = "{}") -> str:
            truth.append((" ".join(text.split()), keep))
            return f"<{tag}>{inner.format(text)}</{tag}>" if tag else text

        def group(tags: str, names: str, body: str) -> str:
            if style == "plain":
                return f"<div>{body}</div>"
            if style == "tags" and tags:
                return f"<{tags}>{body}</{tags}>"
            return f'<div class="{pick(*names.split())} {word()}">{body}</div>'

        def links(k: int) -> str:
            return "<ul>" + "".join(block("li", phrase(1, 4), False, '<a href="/x">{}</a>') for _ in range(k)) + "</ul>"

        def small(lo: int = 1) -> str:
            return block(pick("p", "div", "p"), phrase(2, 9) + " " + pick(*SMALL_PRINT) + " " + phrase(1, 6) + pick("", "."), False)

        if rng.random() < 0.6:
            parts.append(group("header", "header masthead site-header", block(pick("div", "p", "h2"), phrase(1, 5), False) + (small() if rng.random() < 0.3 else "")))
        if rng.random() < 0.9:
            parts.append(group("nav", "nav menu main-nav breadcrumbs", links(int(rng.integers(2, 9)))))
        if rng.random() < 0.3:
            parts.append(group("", "cookie-notice notice alert consent", small() + block("p", sentences(2), False) if style != "plain" else small()))
        ads = [group("", "ad ads advert sponsored promo", block(pick("", "p"), sentences(int(rng.integers(1, 4))), style == "plain")) for _ in range(2)]
        # The blocks of an advert that is not used are taken off the list again.
        shown = rng.random() < 0.5
        truth[len(truth) - 2 :] = truth[len(truth) - 2 : len(truth) - 1] if shown else []
        parts += ads[:1] * shown
        body = [block("h1", phrase(2, 10), True)]
        for _ in range(int(rng.integers(1, 12))):
            kind = rng.random()
            if kind < 0.66:
                body.append(block("p", sentences(int(rng.integers(1, 7))), True))
            elif kind < 0.7:
                body.append(block("p", f"{sentences(3)} {pick(*SMALL_PRINT)} {phrase(1, 9)}.", True))
            elif kind < 0.78:
                body.append(block(pick("h2", "h3"), phrase(1, 7), True))
            elif kind < 0.84:
                body.append("<ul>" + "".join(block("li", phrase(2, 14), True) for _ in range(3)) + "</ul>")
            elif kind < 0.88:
                body.append("<table>" + "".join("<tr>" + block("td", phrase(1, 3), True) + block("td", phrase(1, 3), True) + "</tr>" for _ in range(2)) + "</table>")
            elif kind < 0.92:
                body.append(block("p", phrase(1, 3), True))
            elif kind < 0.96 or style == "plain":
                body.append(block("blockquote", sentences(2), True))
            else:
                body.append(group("aside", "ad related promo share", block("p", sentences(1), False)))
        parts.append(group(pick("article", "main"), "article content post entry story main-content", "".join(body)))
        if rng.random() < 0.4:
            parts.append(group("aside", "sidebar widget related", block("h3", phrase(1, 4), False) + links(4) + (block("p", sentences(1), False) if style != "plain" else "")))
        if rng.random() < 0.3 and style != "plain":
            parts.append(f'<{pick("section", "div")} {pick("class", "id")}="{pick("comments", "comment-list", "replies")}">' + "".join(block("p", sentences(int(rng.integers(1, 4))), False) for _ in range(int(rng.integers(1, 12)))) + "</div></section>")
        if rng.random() < 0.3:
            parts.append(group("form", "newsletter login subscribe search-box", small()))
        if rng.random() < 0.9:
            parts.append(group("footer", "footer copyright", small() + (links(3) if rng.random() < 0.4 else "")))
        made.append(("<html><body>" + "".join(parts) + "</body></html>", truth))
    bare = sentences(3)
    return [*made, *([(bare, [(" ".join(bare.split()), True)])] * 20)]


@lru_cache(maxsize=1)
def fitted() -> tuple[float, ...]:
    """Weights of the features, by Newton steps with a small ridge."""
    rows, wanted = [], []
    for source, truth in sample_pages():
        page = read_page(source)
        if [b.text for b in page.blocks] != [t for t, _ in truth]:
            raise ValueError("a made page is not read as it was written")
        rows.append(features(page, *states(page)))
        wanted += [keep for _, keep in truth]
    x, y = np.vstack(rows), np.array(wanted, dtype=float)
    w = np.zeros(FEATURES)
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(FEATURES), x.T @ (y - p) - 0.5 * w)
    return tuple(w.tolist())


def minimum_cut(lean: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels that cost least, where vertex v costs lean[v] if it is not True (its negative if it is) and an edge (u, v, c) costs c if u and v differ.

    Of several least labellings the one with most True.  A vertex that leans
    more than its edges can bear is settled first; augmenting paths (breadth
    first levels, then blocking flows) cut the rest.
    """
    n = len(lean)
    lean, label = list(lean), [None] * n
    ties: list[dict[int, int]] = [{} for _ in range(n)]
    for u, v, c in edges:
        if u != v and c > 0:
            ties[u][v] = ties[u].get(v, 0) + c
            ties[v][u] = ties[v].get(u, 0) + c
    bears = [sum(t.values()) for t in ties]
    settled = deque(v for v in range(n) if abs(lean[v]) > bears[v])
    while settled:
        v = settled.popleft()
        if label[v] is not None:
            continue
        label[v] = lean[v] > 0
        for u, c in ties[v].items():
            if label[u] is None:
                lean[u] += c if label[v] else -c
                bears[u] -= c
                if abs(lean[u]) > bears[u]:
                    settled.append(u)
    open_ = [v for v in range(n) if label[v] is None]
    if not open_:
        return label
    place = {v: i for i, v in enumerate(open_)}
    s, t = len(open_), len(open_) + 1
    heads, room, out = [], [], [[] for _ in range(t + 1)]

    def add(u: int, v: int, there: int, back: int) -> None:
        out[u].append(len(heads))
        out[v].append(len(heads) + 1)
        heads.extend((v, u))
        room.extend((there, back))

    for v in open_:
        if lean[v] > 0:
            add(s, place[v], lean[v], 0)
        elif lean[v] < 0:
            add(place[v], t, -lean[v], 0)
        for u, c in ties[v].items():
            if v < u and label[u] is None:
                add(place[v], place[u], c, c)
    while True:
        level = [-1] * (t + 1)
        level[s], queue = 0, deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] and level[heads[e]] < 0:
                    level[heads[e]] = level[u] + 1
                    queue.append(heads[e])
        if level[t] < 0:
            break
        upto, path, u = [0] * (t + 1), [], s
        while True:
            if u == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if not room[e])
                u = heads[path[cut] ^ 1]
                del path[cut:]
            while upto[u] < len(out[u]) and not (room[out[u][upto[u]]] and level[heads[out[u][upto[u]]]] == level[u] + 1):
                upto[u] += 1
            if upto[u] < len(out[u]):
                path.append(out[u][upto[u]])
                u = heads[path[-1]]
            elif path:
                u = heads[path.pop() ^ 1]
                upto[u] += 1
            else:
                break
    reaches = [False] * (t + 1)  # the sink, through what is left
    reaches[t], queue = True, deque([t])
    while queue:
        v = queue.popleft()
        for e in out[v]:
            if room[e ^ 1] and not reaches[heads[e]]:
                reaches[heads[e]] = True
                queue.append(heads[e])
    for v in open_:
        label[v] = not reaches[place[v]]
    return label


def main_text(source: str | None, weights: tuple[float, ...]) -> str:
    """The article's blocks, a line each."""
    page = read_page(source or "")
    n = len(page.blocks)
    if not n:
        return ""
    side, main = states(page)
    odds = features(page, side, main) @ np.array(weights)
    lean = [int(x) for x in np.rint(odds * UNIT)] + [0] * len(page.elements)
    says = lambda e: (side[e] > 0, main[e] > 0)
    edges = []
    for i, b in enumerate(page.blocks):
        edges.append((i, n + b.element, int(ELEMENT_TIE * UNIT)))
        if i:
            a = page.blocks[i - 1].element
            edges.append((i - 1, i, int(NEXT_TIE * UNIT * (1 if says(a) == says(b.element) else BROKEN))))
    for i, e in enumerate(page.elements[1:], 1):
        edges.append((n + i, n + e.parent, int(PARENT_TIE * UNIT * (1 if says(i) == says(e.parent) else BROKEN))))
    kept = minimum_cut(lean, edges)
    return "\n".join(b.text for i, b in enumerate(page.blocks) if kept[i])


def extract_main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns to keep, text and n_chars of each page."""
    if {"text", "n_chars"} & {c.lower() for c in keep}:
        raise ValueError("text and n_chars are columns of the result")
    weights = fitted()
    read = pages.select(*keep, pages[html].cast("string").alias("html") if "html" not in keep else pages[html])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x, weights) for x in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[: len(keep)])
    return map_arrow(read, run, f"{kinds}, text string, n_chars long")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
