"""HTML extraction by a tree-structured graphical model.

A page's DOM elements are nodes with two states, content and boilerplate. Node potentials come from a logistic model
of the element's own features, edge potentials from counted parent-child transitions. Sum-product messages pass
upward to the root and down again; the marginals decide which elements' text is content. Both are trained on
labelled pages that the module composes from site layouts (there are no labels in the tables).
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements whose text is never shown, elements without an end, and elements that start a block.
HIDDEN = frozenset("script style template noscript title head meta link iframe svg math canvas object select option textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body main article section div nav header footer aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hr dialog menu center".split())
#: An open element of the left is closed by a start tag of the right.
CLOSES = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Words in class, id or role by which sites name parts of a page.
NAMES = {
    "good": ("article", "content", "entry", "post-body", "story", "main", "prose"),
    "ads": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner"),
    "menu": ("nav", "navbar", "menu", "breadcrumb", "breadcrumbs", "pagination", "navigation", "toc"),
    "edge": ("header", "footer", "masthead", "copyright", "site-info"),
    "side": ("sidebar", "aside", "widget", "related", "recommended", "complementary", "share", "social"),
    "notice": ("cookie", "cookies", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "gdpr", "alert"),
    "talk": ("comment", "comments", "reply", "replies", "disqus", "respond", "discussion"),
}
NAME_OF = {w: k for k, ws in NAMES.items() for w in ws}
TAGS = ("html", "body", "main", "article", "section", "div", "nav", "header", "footer", "aside", "form", "p", "h", "list", "li", "table", "cell", "quote", "inline", "hidden")
TAG_OF = {t: t for t in TAGS} | {f"h{i}": "h" for i in range(1, 7)} | dict.fromkeys(("ul", "ol", "dl", "menu"), "list") | dict.fromkeys(("dt", "dd"), "li") | dict.fromkeys(("thead", "tbody", "tfoot", "tr"), "table") | dict.fromkeys(("td", "th", "caption"), "cell") | {"blockquote": "quote", "pre": "quote", "figure": "quote", "figcaption": "quote", "fieldset": "form", "dialog": "aside", "address": "footer"} | dict.fromkeys(HIDDEN, "hidden")
#: The rest of a tag behind its name: quotes count only behind an equals sign, and nothing is tried twice. The second is for pages whose quotes don't close.
REST, REST_PLAIN = re.compile(r"(?:[^>=]|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>"), re.compile(r"[^>]*+>")
TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACES = re.compile(r"\s+")


def scan(page: str) -> Iterator[tuple[str, int, int, re.Match | None, str]]:
    """(kind, start, end, name, attributes) of tags, comments and declarations in one forward pass; the caller may send a later place to go on from. A tag that never ends takes the rest of the page with it."""
    at, rest = 0, REST
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = len(page) if end < 0 else end + 3
            at = (yield "comment", start, end, None, "") or end
            continue
        name = TAG_NAME.match(page, start + 1)
        if not name and page[start + 1 : start + 2] not in ("!", "?"):
            at = start + 1
            continue
        m = rest.match(page, name.end() if name else start + 2)
        if not m and rest is REST:
            # Quotes that never close: from here on they are not looked at.
            rest = REST_PLAIN
            m = rest.match(page, name.end() if name else start + 2)
        end = m.end() if m else len(page)
        at = (yield "tag" if name and m else "comment", start, end, name, page[name.end() : end - 1] if name and m else "") or end


class Tree:
    """Elements in page order: parent, tag, name kinds; and the text runs (element, text or None for a block edge)."""

    def __init__(self, page: str):
        self.parent, self.tag, self.names, self.runs = [-1], ["html"], [frozenset()], []
        self.text_len, self.link_len = [0], [0]
        #: Open elements, the places of those that are blocks, and how many of each name are open.
        stack, blocks, opened, at = [0], [], Counter(), 0

        def text(piece: str) -> None:
            if piece:
                self.runs.append((stack[-1], piece))
                n = len(piece.strip())
                self.text_len[stack[-1]] += n
                if any(self.tag[i] == "a" for i in stack[-3:]):
                    self.link_len[stack[-1]] += n

        def edge() -> None:
            if self.runs and self.runs[-1][1] is not None:
                self.runs.append((stack[-1], None))

        def close_down_to(depth: int) -> None:
            while len(stack) > depth:
                opened[self.tag[stack.pop()]] -= 1
            while blocks and blocks[-1] >= len(stack):
                blocks.pop()

        tags = scan(page)
        found = next(tags, None)
        while found:
            kind, start, end, match, attributes = found
            text(page[at:start])
            at, go = end, None
            if kind == "tag":
                name = match[2].lower()
                if match[1]:
                    if opened[name] > 0:
                        depth = len(stack) - 1
                        while self.tag[stack[depth]] != name:
                            depth -= 1
                        close_down_to(depth)
                    if name in BLOCK:
                        edge()
                else:
                    go = self._start(name, attributes, page, at, stack, blocks, opened, edge, close_down_to)
                    at = go or at
            try:
                found = tags.send(go)
            except StopIteration:
                found = None
        text(page[at:])

    def _start(self, name: str, attributes: str, page: str, at: int, stack: list, blocks: list, opened: Counter, edge, close_down_to) -> int | None:
        """A start tag; where to go on, if the element's text is skipped."""
        if name in BLOCK:
            # Formatting elements do not keep a block open: the block below them closes, and they with it.
            if blocks and name in CLOSES.get(self.tag[stack[blocks[-1]]], ()):
                close_down_to(blocks[-1])
            edge()
        if name == "br":
            self.runs.append((stack[-1], " "))
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            return None
        kinds = frozenset(NAME_OF[w] for v in NAMED.finditer(attributes) for w in re.split(r"[^a-z]+|(?<=\w)--?", (v[1] or v[2] or v[3] or "").lower()) if w in NAME_OF) if attributes else frozenset()
        if name == "html" and len(self.parent) == 1:
            return None
        self.parent.append(stack[-1])
        self.tag.append(name)
        # Content that is named for something else too, as content-ad, is that.
        self.names.append(kinds - {"good"} if len(kinds) > 1 else kinds)
        self.text_len.append(0)
        self.link_len.append(0)
        if name in ("script", "style", "textarea", "title", "noscript", "template", "iframe"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            return end.end() if end else len(page)
        if name in BLOCK:
            blocks.append(len(stack))
        stack.append(len(self.parent) - 1)
        opened[name] += 1
        return None

    def features(self) -> np.ndarray:
        """A row an element: tag, named kinds, text and link measures, and what the nearest container that tells is: itself or an element around it."""
        rows = np.zeros((len(self.tag), WIDTH))
        tells = [0] * len(self.tag)
        for i, tag in enumerate(self.tag):
            r = rows[i]
            kinds = self.names[i]
            tells[i] = 1 if kinds == {"good"} else -1 if kinds else 1 if tag in ("article", "main") else -1 if tag in ("nav", "header", "footer", "aside", "form") else tells[self.parent[i]] if i else 0
            r[-6], r[-5] = tells[i] > 0, tells[i] < 0
            r[0] = 1
            r[1 + TAGS.index(TAG_OF.get(tag, "inline"))] = 1
            for k in self.names[i]:
                r[KIND_AT[k]] = 1
            n = self.text_len[i]
            r[-4] = min(n, 400) / 400
            r[-3] = n > 0
            r[-2] = self.link_len[i] / n if n else 0
            r[-1] = tag == "a"
        return rows


KIND_AT = {k: 1 + len(TAGS) + i for i, k in enumerate(NAMES)}
WIDTH = 1 + len(TAGS) + len(NAMES) + 6


def composed_pages(n: int = 240, seed: int = 5) -> list[tuple[str, set[str]]]:
    """Labelled pages: html and the marks (text of the form zN) of content; all other marks are boilerplate."""
    r = random.Random(seed)
    pages = []
    for _ in range(n):
        count, content = 0, set()

        def words(k: int, good: bool) -> str:
            nonlocal count
            count += 1
            if good:
                content.add(f"z{count}")
            return f"z{count} " + " ".join(r.choice(("lorem", "ipsum", "dolor", "sit", "amet")) for _ in range(k))

        link = lambda good: f'<a href="/x">{words(r.randint(1, 3), good)}</a>'
        pick = lambda kind: r.choice(NAMES[kind])
        wrap = lambda tags, kind, inner: f'<{(t := r.choice(tags))} {r.choice(("class", "id"))}="{pick(kind)}">{inner}</{t}>'
        menu = "<ul>" + "".join(f"<li>{link(False)}</li>" for _ in range(r.randint(3, 8))) + "</ul>"
        parts = [r.choice((f"<nav>{menu}</nav>", wrap(("div", "nav"), "menu", menu)))]
        if r.random() < 0.5:
            parts.append(r.choice((f"<header>{words(3, False)}</header>", wrap(("div", "header"), "edge", words(4, False)))))
        if r.random() < 0.6:
            parts.append(wrap(("div", "section", "aside"), "ads", r.choice(("{}", "<p>{}</p>")).format(words(r.randint(3, 20), False))))
        if r.random() < 0.3:
            parts.append(wrap(("div", "section"), "notice", f"<p>{words(r.randint(5, 25), False)}</p><button>{words(1, False)}</button>"))
        body = [f"<h1>{words(r.randint(3, 10), True)}</h1>"]
        for _ in range(r.randint(1, 9)):
            k = r.random()
            inner = words(r.randint(1, 60), True) + (f" {link(True)} {words(8, True)}" if r.random() < 0.2 else "")
            if r.random() < 0.12:
                short = [words(r.randint(0, 2), True) for _ in range(r.randint(2, 5))]
                linked = " and ".join(link(True) for _ in range(r.randint(1, 3)))
                body.append(r.choice(("<ul>" + "".join(f"<li>{x}</li>" for x in short) + "</ul>", "<ol>" + "".join(f"<li>{x}" for x in short) + "</ol>", "<table><tr>" + "".join(f"<td>{x}" for x in short) + "</table>", "<dl>" + "".join(f"<dt>{x}<dd>{words(3, True)}" for x in short) + "</dl>", f"<p>{linked}</p>", f"<p>{words(1, True)} {linked}.</p>")))
            body.append(f"<p>{inner}</p>" if k < 0.7 else f"<p><b>{words(6, True)}<br><p>{inner}</p>" if k < 0.78 else f"<ul><li>{inner}</li><li>{words(9, True)}</li></ul>" if k < 0.84 else f"<h2>{inner}</h2>" if k < 0.9 else f"<blockquote><p>{inner}</p></blockquote>" if k < 0.95 else f"<table><tr><td>{inner}</td><td>{words(4, True)}</td></tr></table>")
            if r.random() < 0.08:
                body.append(wrap(("div", "aside"), r.choice(("ads", "side", "notice")), f"<p>{words(r.randint(4, 20), False)}</p>"))
            if r.random() < 0.04:
                body.append(f"<form><label>{words(2, False)}</label><input>{words(1, False)}</form>")
        inner = "".join(body)
        if r.random() < 0.12:  # a page that is nothing but its text
            pages.append((r.choice(("<html><body>{}</body></html>", "<body>{}</body>", "{}")).format(inner if r.random() < 0.5 else f"<p>{words(r.randint(1, 20), True)}</p>"), content))
            continue
        parts.append(r.choice((f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main><article>{inner}</article></main>", f"<main>{inner}</main>", wrap(("div", "section"), "good", inner))))
        if r.random() < 0.4:
            parts.append(wrap(("div", "section"), "talk", "".join(r.choice(("<p>{}</p>", "<div><p>{}</p></div>", "<ul><li>{}</li></ul>")).format(words(r.randint(3, 40), False)) for _ in range(r.randint(1, 4)))))
        if r.random() < 0.4:
            side = r.choice((menu, f"<p>{words(r.randint(3, 25), False)}</p>", f"<h3>{words(2, False)}</h3>{menu}"))
            parts.append(r.choice((f"<aside>{side}</aside>", wrap(("div", "aside"), "side", side))))
        if r.random() < 0.3:
            parts.append(f"<form><label>{words(2, False)}</label><input><button>{words(1, False)}</button></form>")
        parts.append(r.choice((f"<footer>{words(r.randint(2, 12), False)}</footer>", wrap(("div", "footer"), "edge", f"<p>{words(8, False)}</p>"))))
        pages.append((f"<!DOCTYPE html><html><head><title>{words(4, False)}</title></head><body>{''.join(parts)}</body></html>", content))
    return pages


def labels_of(tree: Tree, content: set[str]) -> np.ndarray:
    """1 for an element of whose subtree's marks at least half are content; 0 for html and body, which hold all. Elements without marks follow their parent."""
    good, all_ = np.zeros(len(tree.tag)), np.zeros(len(tree.tag))
    for i, run in tree.runs:
        for mark in re.findall(r"z\d+", run or ""):
            while i >= 0:
                good[i] += mark in content
                all_[i] += 1
                i = tree.parent[i]
            i = 0
    label = np.where(all_ > 0, 2 * good >= all_, -1)
    label[[i for i, t in enumerate(tree.tag) if t in ("html", "body")]] = 0
    for i in range(1, len(label)):
        if label[i] < 0:
            label[i] = 0 if TAG_OF.get(tree.tag[i], "inline") == "hidden" else max(label[tree.parent[i]], 0)
    return label


@lru_cache(maxsize=1)
def trained() -> tuple[np.ndarray, np.ndarray]:
    """Weights of the logistic node model and the log transition matrix [parent state, child state]."""
    xs, ys, moves = [], [], np.ones((2, 2))
    for page, content in composed_pages():
        tree = Tree(page)
        y = labels_of(tree, content)
        xs.append(tree.features())
        ys.append(y)
        for i in range(1, len(y)):
            moves[int(y[tree.parent[i]]), int(y[i])] += 1
    x, y = np.concatenate(xs), np.concatenate(ys).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + 0.5 * w)
    # The node model has each child's own prior in it already, so transitions enter as lift over it.
    joint = moves / moves.sum()
    return w, np.log(joint / np.outer(joint.sum(1), joint.sum(0)))


def marginals(tree: Tree, weights: np.ndarray, edges: np.ndarray) -> list[float]:
    """P(content) of every element: messages go up from the leaves, then down from the root."""
    logit = (tree.features() @ weights).tolist()
    e = [[exp(v) for v in row] for row in edges.tolist()]
    n, parent = len(logit), tree.parent
    own = [(1 / (1 + exp(min(z, 500))), 1 / (1 + exp(-max(z, -500)))) for z in logit]
    up, below = [(1.0, 1.0)] * n, [list(o) for o in own]
    for i in range(n - 1, 0, -1):
        b0, b1 = below[i]
        m0, m1 = e[0][0] * b0 + e[0][1] * b1, e[1][0] * b0 + e[1][1] * b1
        s = m0 + m1
        up[i] = (m0 / s, m1 / s)
        q = below[parent[i]]
        q[0] *= up[i][0]
        q[1] *= up[i][1]
        s = q[0] + q[1]
        q[0] /= s
        q[1] /= s
    belief = [below[0]] + [None] * (n - 1)
    out = [belief[0][1] / sum(belief[0])] + [0.0] * (n - 1)
    for i in range(1, n):
        p0, p1 = belief[parent[i]]
        c0, c1 = p0 / max(up[i][0], 1e-300), p1 / max(up[i][1], 1e-300)
        d0, d1 = c0 * e[0][0] + c1 * e[1][0], c0 * e[0][1] + c1 * e[1][1]
        b0, b1 = below[i][0] * d0, below[i][1] * d1
        s = b0 + b1
        belief[i] = (b0 / s, b1 / s)
        out[i] = b1 / s
    return out


def extract(page: str | None, weights: np.ndarray | None = None, edges: np.ndarray | None = None) -> str:
    """The main text of a page: a block is a line, white space inside it one blank."""
    if not page:
        return ""
    if weights is None:
        weights, edges = trained()
    tree = Tree(page)
    p = marginals(tree, weights, edges)
    hidden = [TAG_OF.get(t, "inline") == "hidden" for t in tree.tag]
    for i in range(1, len(hidden)):
        hidden[i] = hidden[i] or hidden[tree.parent[i]]
    # An inline element is content where the block around it is.
    block = list(range(len(p)))
    for i in range(1, len(p)):
        if tree.tag[i] not in BLOCK:
            block[i] = block[tree.parent[i]]
    out, now = [], []

    def close() -> None:
        line = SPACES.sub(" ", "".join(now)).strip()
        if line:
            out.append(line)
        now.clear()

    for i, run in tree.runs:
        if run is None:
            close()
        elif p[block[i]] > 0.5 and not hidden[i]:
            now.append(html.unescape(run))
    close()
    return "\n".join(out)


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    A null or empty page has an empty text, and an empty table gives an empty one. Broken markup is read as far as it goes, whole pages of any length in time proportional to it. Repeated rows give equal results; extra columns, also of the names of the results, are left out.
    """
    weights, edges = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p, weights, edges) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
