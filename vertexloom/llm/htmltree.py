"""Operator 8: main-text extraction with a tree-structured graphical model over the DOM.

A page becomes a tree of block elements; a node is content or not. Node potentials come from tags,
class and id words, link density and text lengths; parent-child potentials tie labels along edges.
Sum-product messages go up and then down the tree, which gives exact marginals, and a text run stays
where its node's marginal is at least a half. Weights maximise the likelihood of labelled pages by
stochastic gradients with the same messages; the tables have no labelled pages, so `labelled_pages`
generates layouts (menus, headers, footers, sidebars, notices, adverts, forms, reader comments
around an article) with known labels.

Text: character references decoded, white space inside a block one space, blocks joined by one space
in page order; scripts, styles, form fields, frames, templates, comments and markup are gone; formulas, drawings' text and what
stands in for missing scripts or objects are part of the block that holds them. Rows: one for each page; null or empty
html gives an empty text; unclosed and stray tags are closed or ignored as browsers do, roughly;
page_id and url pass through, null or repeated. An empty table gives no rows.
"""

from __future__ import annotations

import collections
import functools
import html as entities
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED, PAGES, EPOCHS, RATE = 8, 600, 12, 0.3

_TAG = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I | re.S)
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
#: Elements without text of the page: code, form fields, the window's title, other pages, unused parts.
_RAW = frozenset("script style textarea title iframe template select".split())
_VOID = frozenset("area base col embed hr img input link meta param source track wbr br".split())
_BLOCK = frozenset(
    "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset legend table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary button dialog center hgroup menu search label noscript".split()
)
_CLOSES_P = _BLOCK - {"html", "head", "body", "button", "label", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPE = frozenset("ul ol dl table article section div body nav aside form td".split())
#: Words of class, id and role values, by what they tell.
_HINTS = {
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar tabs toc skip",
    "comment": "comment comments reply replies respond disqus discussion commentlist responses",
    "side": "sidebar side widget widgets related recommended complementary rail trending popular",
    "foot": "footer foot copyright contentinfo colophon legal",
    "head": "header masthead topbar head logo branding",
    "notice": "cookie cookies consent notice alert popup modal newsletter subscribe signup gdpr overlay disclaimer warning message",
    "share": "share sharing social tags meta byline follow",
    "form": "form search login contact input",
    "main": "content article post entry main story text body blog page maincontent articlebody",
    "hidden": "hidden none",
}
_HINT_OF = {w: kind for kind, words in _HINTS.items() for w in words.split()}


class Node:
    __slots__ = ("parent", "tag", "hints", "own", "links", "kids")

    def __init__(self, parent: int, tag: str, hints: frozenset):
        self.parent, self.tag, self.hints = parent, tag, hints
        self.own = self.links = self.kids = 0


def _tag_end(page: str, at: int, last: dict[str, int]) -> tuple[int, int]:
    """Where a tag's attributes, which begin at at, and the tag itself end.

    A quote counts where a value begins and is closed somewhere; a tag that is never closed takes the rest of the page.
    """
    spot = at
    while stop := _STOP.search(page, spot):
        c, place, spot = stop[0], stop.start(), stop.end()
        if c == ">":
            return place, spot
        before = place - 1
        while before >= at and page[before].isspace():
            before -= 1
        if before >= at and page[before] == "=" and last[c] >= spot:
            spot = page.find(c, spot) + 1
    return len(page), len(page)


def next_markup(page: str, at: int, last: dict[str, int]) -> tuple[int, int, str, bool, str] | None:
    """(start, end, name, closes, attributes) of the first markup from at on; comments and declarations have no name.

    last: the last places of quotes and closing brackets, so that nothing is looked for that is not there.
    """
    while (start := page.find("<", at)) >= 0:
        closes = page.startswith("/", start + 1)
        if page.startswith("<!--", start):
            found = page.find("-->", start + 4)
            return start, found + 3 if found >= 0 else len(page), "", False, ""
        if m := _TAG.match(page, start + 1):
            inner, end = _tag_end(page, m.end(), last)
            return start, end, m[1].lower(), closes, page[m.end() : inner]
        if closes or page.startswith(("!", "?"), start + 1):
            return start, page.find(">", start) + 1 if last[">"] > start else len(page), "", False, ""
        at = start + 1
    return None


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements of a page, parents first, and its text runs (node, text) in page order."""
    nodes, runs = [Node(-1, "root", frozenset())], []
    stack, current, link, open_ = [0], [], 0, collections.Counter()

    def flush() -> None:
        text = " ".join("".join(current).split())
        current.clear()
        if text:
            runs.append((stack[-1], text))
            nodes[stack[-1]].own += len(text)

    def add(text: str) -> None:
        if text:
            text = entities.unescape(text) if "&" in text else text
            current.append(text)
            if link:
                nodes[stack[-1]].links += len(text.strip())

    def close(names: frozenset | set, stop: frozenset = frozenset()) -> None:
        if not any(open_[name] for name in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in names:
                flush()
                open_.subtract(nodes[j].tag for j in stack[k:])
                del stack[k:]
                return
            if tag in stop:
                return

    at, last = 0, {c: page.rfind(c) for c in ">\"'"}
    while step := next_markup(page, at, last):
        start, after, name, end, attributes = step
        add(page[at:start])
        at = after
        if name == "a":
            link = 0 if end else 1
        elif name == "br" or name == "hr":
            current.append(" ")
        elif name in _RAW and not end:
            stop = re.compile(rf"</{name}(?=[\s/>]|$)[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else len(page)
        elif name in _BLOCK:
            if end:
                close({name})
                continue
            flush()
            if name in _CLOSES_P:
                close({"p"}, _SCOPE)
            if name in _SAME:
                close(_SAME[name], _SCOPE - _SAME[name])
            hints = set()
            for key, value in _NAMES.findall(attributes):
                key = key.lower()
                if key == "hidden" or key == "aria-hidden" and "true" in value:
                    hints.add("hidden")
                elif key == "style":
                    hints |= {"hidden"} if re.search(r"display\s*:\s*none", value) else set()
                else:
                    hints |= {_HINT_OF[w] for x in _WORD.findall(value) if (w := x.lower()) in _HINT_OF}
            nodes.append(Node(stack[-1], name, frozenset(hints)))
            nodes[stack[-1]].kids += 1
            stack.append(len(nodes) - 1)
            open_[name] += 1
    add(page[at:])
    flush()
    return nodes, runs


def features(nodes: list[Node]) -> list[list[str]]:
    """Names of the features that hold for each node."""
    total, links = [n.own for n in nodes], [n.links for n in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        total[nodes[k].parent] += total[k]
        links[nodes[k].parent] += links[k]
    out = []
    for n, size, linked in zip(nodes, total, links, strict=True):
        own = ["bias", "tag " + n.tag, f"size {min(4, len(str(size)) if size else 0)}", f"links {int(4 * linked / size) if size else 0}"]
        own += ["hint " + h for h in n.hints]
        if n.own:
            own.append("own text")
        out.append(own)
    return out


def _soft(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def marginals(parents: list[int], theta: list[float], pair: list[float]) -> tuple[list[float], list[float]]:
    """Log odds of each node by sum-product, and those without its parent's message.

    pair: potentials of (parent, child) labels 00, 01, 10, 11; parents come before children.
    """
    p00, p01, p10, p11 = pair
    up, sent = theta[:], [0.0] * len(theta)
    for k in range(len(theta) - 1, 0, -1):
        sent[k] = _soft(p10, p11 + up[k]) - _soft(p00, p01 + up[k])
        up[parents[k]] += sent[k]
    belief = up[:]
    for k in range(1, len(theta)):
        rest = belief[parents[k]] - sent[k]
        belief[k] = up[k] + _soft(p01, p11 + rest) - _soft(p00, p10 + rest)
    return belief, up


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def fit(pages: list[tuple[list[int], list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = RATE) -> tuple[dict[str, float], list[float]]:
    """Weights and pair potentials from (parents, features, labels), by stochastic gradients of the exact likelihood."""
    weights: dict[str, float] = {}
    pair = [0.5, 0.0, 0.0, 0.5]
    rng = random.Random(SEED)
    for epoch in range(epochs):
        step = rate / (1 + epoch / 4)
        rng.shuffle(pages)
        for parents, feats, labels in pages:
            theta = [sum(weights.get(f, 0.0) for f in own) for own in feats]
            belief, up = marginals(parents, theta, pair)
            odds = [_sigmoid(b) for b in belief]
            for own, y, p in zip(feats, labels, odds, strict=True):
                if abs(y - p) > 1e-4:
                    for f in own:
                        weights[f] = weights.get(f, 0.0) * (1 - 1e-4) + step * (y - p)
            for k in range(1, len(labels)):
                # P(parent, child): the child's odds given each parent label, times the parent's marginal.
                on1, on0 = _sigmoid(up[k] + pair[3] - pair[2]), _sigmoid(up[k] + pair[1] - pair[0])
                p = odds[parents[k]]
                expected = ((1 - p) * (1 - on0), (1 - p) * on0, p * (1 - on1), p * on1)
                seen = 2 * labels[parents[k]] + labels[k]
                for j in range(4):
                    pair[j] += step / 10 * ((seen == j) - expected[j])
    return weights, pair


def labelled_pages(count: int = PAGES, seed: int = SEED) -> list[str]:
    """Generated pages in which NUL marks stand around content; layouts vary, words are arbitrary."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("aeiounrstlmd") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(n))

    def wrap(tag: str, names: list[str], inner: str) -> str:
        name = rng.choice(names)
        return f"<{tag} {rng.choice(['class', 'id'])}=\"{name}\">{inner}</{tag}>" if name else f"<{tag}>{inner}</{tag}>"

    def prose(low: int, high: int) -> str:
        return "".join(f"<p>{words(3, 60)}</p>" for _ in range(rng.randint(low, high)))

    def clutter(kind: str) -> str:
        if kind == "menu":
            return wrap("nav", ["", "menu", "main-nav"], f"<ul>{links(rng.randint(2, 8))}</ul>") if rng.random() < 0.6 else wrap("div", ["menu", "navbar", "breadcrumb"], f"<ul>{links(rng.randint(2, 6))}</ul>")
        if kind == "header":
            return rng.choice([wrap("header", ["", "site-header"], f"<h1>{words(1, 4)}</h1><p>{words(3, 9)}</p>"), wrap("div", ["header", "masthead"], f"<p>{words(2, 8)}</p>")])
        if kind == "footer":
            return rng.choice([wrap("footer", ["", "footer"], rng.choice([words(3, 30), prose(1, 2)])), wrap("div", ["footer", "copyright"], f"<p>{words(4, 20)}</p>")])
        if kind == "side":
            return rng.choice([wrap("aside", ["", "sidebar"], f"<h3>{words(1, 3)}</h3>{prose(1, 3)}"), wrap("div", ["sidebar", "related", "widget"], f"<h3>{words(1, 3)}</h3><ul>{links(3)}</ul>{prose(0, 2)}")])
        if kind == "ad":
            return wrap("div", ["ad", "ads", "advert", "sponsored", "ad-banner", "promo"], rng.choice([words(3, 40), prose(1, 2)]))
        if kind == "notice":
            return wrap(rng.choice(["div", "section", "dialog"]), ["cookie-notice", "notice", "consent", "newsletter", "popup", "alert"], rng.choice([words(4, 30), f"<p>{words(5, 30)}</p><button>ok</button>"]))
        if kind == "form":
            return rng.choice([f"<form><label>{words(1, 3)}</label><input><button>{words(1, 2)}</button></form>", wrap("form", ["", "search", "login"], f"<p>{words(3, 12)}</p><input><button>{words(1, 1)}</button>")])
        inner = "".join(wrap(rng.choice(["div", "li", "article"]), ["comment", "reply"], rng.choice([words(5, 40), f"<h4>{words(1, 2)}</h4>{prose(1, 2)}"])) for _ in range(rng.randint(1, 4)))
        return wrap(rng.choice(["section", "div", "ol"]), ["comments", "comment-list", "respond"], f"<h3>{words(1, 3)}</h3>" + inner)

    pages = []
    for _ in range(count):
        blocks = [f"<{h}>{words(2, 9)}</{h}>" for h in ["h1"] * (rng.random() < 0.8)]
        for _ in range(rng.randint(0, 9)):
            kind = rng.random()
            blocks.append(
                f"<p>{words(1, 90)}</p>" if kind < 0.7 else f"<h2>{words(1, 6)}</h2>" if kind < 0.8 else f"<ul><li>{words(2, 15)}</li><li>{words(2, 15)}</li></ul>" if kind < 0.86
                else f"<blockquote><p>{words(4, 30)}</p></blockquote>" if kind < 0.9 else f"<table><tr><td>{words(1, 6)}</td><td>{words(1, 6)}</td></tr></table>" if kind < 0.93
                else f"<p><a href=x>{words(1, 6)}</a> {words(5, 30)}</p>" if kind < 0.97 else f"<div>{words(5, 40)}</div>"
            )
        inner = "".join(blocks) or f"<p>{words(3, 40)}</p>"
        inside = rng.choice(["ad", "notice", "side", "form", "menu", "comment"]) if rng.random() < 0.3 else None
        mark = "\x00"
        body = "".join(f"{mark}{b}{mark}" for b in ["".join(blocks[: len(blocks) // 2]), "".join(blocks[len(blocks) // 2 :])] if b) if blocks else mark + inner + mark
        if inside and blocks:
            body = body.replace(mark * 2, mark + clutter(inside) + mark, 1) if mark * 2 in body else body + clutter(inside)
        shell = rng.random()
        if shell < 0.4:
            body = f"<article>{body}</article>"
        elif shell < 0.55:
            body = f"<main>{body}</main>"
        elif shell < 0.75:
            body = wrap("div", ["content", "post-body", "entry-content", "main", "article-body"], body)
        elif shell < 0.85:
            body = f"<main><article>{body}</article></main>"
        elif shell < 0.93:
            body = f"<div>{body}</div>"
        before = "".join(clutter(k) for k in ["notice", "header", "menu", "ad", "form"] if rng.random() < 0.5)
        after = "".join(clutter(k) for k in ["comment", "side", "ad", "notice", "form", "menu", "footer"] if rng.random() < 0.45)
        pages.append(f"<html><head><title>{words(1, 5)}</title></head><body>{before}{body}{after}</body></html>")
    return pages


@functools.cache
def model() -> tuple[dict[str, float], list[float]]:
    """Trained on the generated pages; deterministic, under a few seconds."""
    data = []
    for page in labelled_pages():
        # The marks around content toggle as runs are met: rebuild the labels from them.
        nodes, runs = parse(page)
        labels, own, inside = [0] * len(nodes), [None] * len(nodes), False
        for node, text in runs:
            flag = None
            for c in text:
                if c == "\x00":
                    inside = not inside
                elif c != " ":
                    flag = inside
            if flag is not None:
                own[node] = max(own[node] or 0, int(flag))
        kept = [0] * len(nodes)
        for k in range(len(nodes) - 1, -1, -1):
            if own[k] is not None:
                labels[k] = own[k]
            elif kept[k] > 0:
                labels[k] = 1
            if k and (labels[k] or kept[k]):
                kept[nodes[k].parent] += 1
        # A mark is no text of its own.
        for node, text in runs:
            nodes[node].own -= text.count("\x00")
        data.append(([n.parent for n in nodes], features(nodes), labels))
    return fit(data)


def extract(page: str | None, trained: tuple[dict[str, float], list[float]]) -> str:
    if not page:
        return ""
    weights, pair = trained
    nodes, runs = parse(page)
    theta = [sum(weights.get(f, 0.0) for f in own) for own in features(nodes)]
    belief, _ = marginals([n.parent for n in nodes], theta, pair)
    return " ".join(text for node, text in runs if belief[node] >= 0)


def main_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text, n_chars), a row for each row of pages."""
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [extract(page.as_py(), shared.value) for page in some.column(2)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
