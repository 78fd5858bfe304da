"""Operator 10: main-text extraction by gradient-boosted trees over DOM nodes.

Each block-level node is described by its subtree's text, link and tag density, its tokens (its tag
and the words of class, id and role) and those of the nodes above it, its depth, and how it stands
among its siblings.  Tokens are hashed, and what each is worth is learned with the rest: the log odds
that a node with it holds article text.  Boosted trees, trained here on pages made by a seeded
generator, of which some have class names without a meaning, give a node's log odds.  Decoding
is hierarchical: of all labelings in which no node is kept whose ancestor is not, the one with the
greatest sum is taken, so ancestors and descendants never contradict each other.

Defined results: a null or empty page, and a page without article text, gives an empty text;
unclosed and misnested markup is read as browsers do as far as blocks go; repeated rows each keep
their row; a null page_id stays null; other columns pass as named in keep; an empty table gives
an empty result.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roadwell.llm.dom import Node, read
from roadwell.llm.shared import ship

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TOKENS = 1 << 14
#: Nodes with a token that weigh as much as the belief that it says nothing.
DOUBT = 5.0
TREES, DEPTH, BINS, SHRINK = 60, 4, 32, 0.25


def tokens(x: Node) -> list[int]:
    """The hashed tokens of a node."""
    return [crc32(t.encode()) % TOKENS for t in {f"<{x.tag}", *x.words}]


def token_weights(pages: list[tuple[list[Node], np.ndarray]]) -> np.ndarray:
    """What each token is worth: pages are nodes with whether they hold article text."""
    good, all_ = np.zeros(TOKENS), np.zeros(TOKENS)
    for nodes, label in pages:
        for x, y in zip(nodes, label.tolist()):
            for t in tokens(x):
                good[t] += y
                all_[t] += 1
    share = sum(float(y.sum()) for _, y in pages) / max(1, sum(len(y) for _, y in pages))
    odds = np.log((good + DOUBT * share) / (all_ - good + DOUBT * (1 - share)))
    return (odds - np.log(share / (1 - share))).astype(np.float32)


def features(nodes: list[Node], blocks: list[tuple[int, str]], weights: np.ndarray) -> np.ndarray:
    """One row for each node."""
    n = len(nodes)
    texts = [x.texts for x in nodes]
    links = [x.links for x in nodes]
    tags = [x.tags for x in nodes]
    paragraphs = [int(x.tag == "p") for x in nodes]
    items = [int(x.tag == "li") for x in nodes]
    marks = [0] * n
    first = [0] * n
    seen = 0
    for k, text in blocks:
        marks[k] += text.count(",") + text.count(".")
    for k, x in enumerate(nodes):
        first[k] = seen
        seen += x.texts
    for k in range(n - 1, 0, -1):
        p = nodes[k].parent
        texts[p] += texts[k]
        links[p] += links[k]
        tags[p] += tags[k]
        paragraphs[p] += paragraphs[k]
        items[p] += items[k]
        marks[p] += marks[k]
    # how often each tag stands among the children of a node
    alike = [Counter(nodes[s].tag for s in x.children) for x in nodes]
    whole = max(1, texts[0])
    rows = np.zeros((n, 22), np.float32)
    worst, best, total = [0.0] * n, [0.0] * n, [0.0] * n
    for k, x in enumerate(nodes):
        own = weights[tokens(x)].tolist()
        low, high = min(own), max(own)
        p = x.parent if k else 0
        # of the nodes above and this one: the worst and the best token, and all together
        if k:
            worst[k], best[k], total[k] = min(worst[p], low), max(best[p], high), total[p] + sum(own)
        length = texts[k]
        rows[k] = (
            x.depth, length, links[k] / max(1, length), length / max(1, tags[k] + 1), marks[k] / max(1, length), paragraphs[k],
            items[k], x.texts / max(1, length), length / whole, first[k] / whole, len(nodes[p].children), alike[p][x.tag] if k else 0,
            length / max(1, texts[p]), links[p] / max(1, texts[p]), int(x.tag in HEADINGS), low, high, sum(own),
            worst[p] if k else 0, best[p] if k else 0, total[p] if k else 0, len(own),
        )
    return rows


class Trees:
    """Gradient-boosted regression trees for the logistic loss, on histograms of binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None):
        self.weights = weights
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._binned(x)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(len(y), self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._walk(tree, binned)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    @staticmethod
    def _grow(b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A full tree: feature and bin of each inner node, value of each leaf."""
        inner = (1 << DEPTH) - 1
        feature, cut = np.zeros(inner, np.int16), np.full(inner, BINS, np.int16)
        at = np.zeros(len(b), np.int64)
        for level in range(DEPTH):
            first, many = (1 << level) - 1, 1 << level
            local = at - first
            best, where = np.full(many, 1e-9), [(0, BINS)] * many
            total_g, total_h = np.bincount(local, g, many), np.bincount(local, h, many)
            for j in range(b.shape[1]):
                key = local * (BINS + 1) + b[:, j]
                left_g = np.bincount(key, g, many * (BINS + 1)).reshape(many, -1).cumsum(1)
                left_h = np.bincount(key, h, many * (BINS + 1)).reshape(many, -1).cumsum(1)
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - (total_g**2 / (total_h + 1))[:, None]
                gain[(left_h < 1) | (right_h < 1)] = 0
                k = gain.argmax(1)
                for m in np.flatnonzero(gain[np.arange(many), k] > best):
                    best[m], where[m] = gain[m, k[m]], (j, k[m])
            for m, (j, c) in enumerate(where):
                feature[first + m], cut[first + m] = j, c
            at = 2 * at + 1 + (b[np.arange(len(b)), feature[at]] > cut[at])
        leaf = at - inner
        value = SHRINK * np.bincount(leaf, g, 1 << DEPTH) / (np.bincount(leaf, h, 1 << DEPTH) + 1)
        return feature, cut, value

    @staticmethod
    def _walk(tree, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
        return value[at - ((1 << DEPTH) - 1)]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.base + sum(self._walk(t, b) for t in self.trees)


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Which nodes to keep: never one below a node that is not kept."""
    worth = odds.tolist()
    for k in range(len(nodes) - 1, 0, -1):
        if worth[k] > 0:
            worth[nodes[k].parent] += worth[k]
    kept = [True] * len(nodes)
    for k in range(1, len(nodes)):
        kept[k] = kept[nodes[k].parent] and worth[k] > 0
    return kept


class Generator:
    """Pages with known article text, to train on: (html, texts of the article's blocks)."""

    def __init__(self, seed: int, nameless: float = 0.15):
        """nameless: the share of pages whose class names and ids have no meaning."""
        self.r = random.Random(seed)
        self.nameless = nameless

    def words(self, low: int, high: int) -> str:
        r = self.r
        made = ["".join(r.choice(("an", "er", "le", "ti", "ou", "re", "sch", "ón", "th", "é", "ing", "a")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        for k in range(len(made)):
            if r.random() < 0.12:
                made[k] += r.choice((".", ",", ".", "!", "?"))
        if r.random() < 0.08:
            made = [w + r.choice(("***", "###", "$$$", "|")) for w in made]
        return " ".join(made).capitalize()

    def links(self, low: int, high: int) -> str:
        r = self.r
        inner = [f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' for _ in range(r.randint(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in inner) + "</ul>" if r.random() < 0.7 else r.choice((" ", " | ")).join(inner)

    def around(self) -> str:
        """A part that is no article: with a telling tag, or a telling class, or both."""
        r = self.r
        kind = r.choice(("nav", "header", "footer", "aside", "ad", "cookie", "form", "comments", "related", "share", "notice", "crumbs"))
        text, many = self.words(2, 40), self.links(2, 9)
        name = lambda *n: f' {r.choice(("class", "class", "id"))}="{r.choice(n)}"'
        say = lambda *n: name(*n) if r.random() < 0.5 else ""
        if kind == "nav":
            return r.choice((f"<nav{say('menu', 'navbar')}>{many}</nav>", f"<div{name('menu', 'main-nav', 'navigation')}>{many}</div>"))
        if kind == "header":
            inner = r.choice((f"<p>{self.words(1, 8)}</p>", f"<h1>{self.words(1, 4)}</h1>", self.words(1, 6), many))
            return r.choice((f"<header{say('site-header', 'top')}>{inner}</header>", f"<div{name('header', 'site-header', 'masthead')}>{inner}</div>"))
        if kind == "footer":
            inner = r.choice((f"&copy; site.example.com &middot; {text}", f"<p>&copy; {text}</p>", many + f"<p>{text}</p>"))
            return r.choice((f"<footer{say('footer')}>{inner}</footer>", f"<div{name('footer', 'site-footer')}>{inner}</div>"))
        if kind == "aside":
            inner = f"<h3>{self.words(1, 4)}</h3>" + r.choice((many, f"<p>{text}</p>", f"<p>{self.words(30, 90)}</p>"))
            return r.choice((f"<aside{say('sidebar')}>{inner}</aside>", f"<div{name('sidebar', 'widget', 'sidebar-right')}>{inner}</div>"))
        if kind == "ad":
            return f"<div{name('ad', 'ads', 'advert', 'ad-banner', 'sponsored', 'promo')}>{r.choice((text, f'<p>{text}</p>', f'<a href=/x>{text}</a>'))}</div>"
        if kind in ("cookie", "notice"):
            inner = f"<p>{text}</p>" + r.choice(("", f"<button>{self.words(1, 2)}</button>"))
            return f"<{(t := r.choice(('div', 'section', 'div')))}{name('cookie-notice', 'cookie-banner', 'notice', 'consent', 'alert-notice', 'popup', 'warning')}>{r.choice((inner, text))}</{t}>"
        if kind == "form":
            return f"<form{say('search', 'newsletter', 'login')}><label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>{r.choice(('', f'<p>{text}</p>'))}</form>"
        if kind == "comments":
            each = "".join(r.choice(("<div class=comment><p>{}</p></div>", "<li class=comment>{}</li>", "<p>{}</p>", "<article class=comment><p>{}</p></article>")).format(self.words(5, 60)) for _ in range(r.randint(1, 6)))
            tag = r.choice(("div", "section", "ol"))
            return f"<{tag}{name('comments', 'comment-list', 'discussion', 'replies')}><h2>{self.words(1, 3)}</h2>{each}</{tag}>"
        if kind == "related":
            return f"<{(t := r.choice(('div', 'section', 'aside')))}{name('related', 'related-posts', 'recommended', 'trending')}><h3>{self.words(1, 4)}</h3>{many}</{t}>"
        if kind == "share":
            return f"<div{name('share', 'social', 'share-buttons', 'tags')}>{many}</div>"
        return f"<div{name('breadcrumb', 'breadcrumbs', 'pagination')}>{many}</div>"

    def block(self) -> tuple[str, list[str]]:
        r, roll = self.r, self.r.random()
        text = self.words(1, 12) if r.random() < 0.25 else self.words(10, 140)
        if roll < 0.6:
            return f"<p{r.choice(('', '', ' class=text'))}>{text}" + r.choice(("</p>", "</p>", "</p>", "")), [text]
        if roll < 0.68:
            return f"<p><b>{text}<br>", [text]
        if roll < 0.76:
            return f"<h{(k := r.randint(2, 4))}>{(short := self.words(1, 9))}</h{k}>", [short]
        if roll < 0.86:
            items = [self.words(2, 20) for _ in range(r.randint(2, 6))]
            shown = [f'<a href="/x">{x}</a>' if r.random() < 0.15 else x for x in items]
            return "<ul>" + "".join(f"<li>{x}</li>" for x in shown) + "</ul>", items
        if roll < 0.92:
            return f"<blockquote><p>{text}</p></blockquote>", [text]
        if roll < 0.96:
            cells = [self.words(1, 5) for _ in range(4)]
            return "<table><tr><td>{}</td><td>{}</td></tr><tr><td>{}</td><td>{}</td></tr></table>".format(*cells), cells
        return f"<div>{text}</div>", [text]

    def page(self) -> tuple[str, list[str]]:
        r = self.r
        title = self.words(2, 9)
        parts, truth = [f"<h1>{title}</h1>"], [title]
        if r.random() < 0.2:
            parts = [f"<header><h1>{title}</h1></header>"]
        for _ in range(r.randint(30, 600) if r.random() < 0.03 else r.choice((1, 1, 2, 4, 6, 9, 14))):
            html, texts = self.block()
            parts.append(html)
            truth += texts
            if r.random() < 0.06:
                parts.append(self.around())
        tag, name = r.choice((("article", ""), ("article", ""), ("main", ""), ("div", ' class="content"'), ("div", ' id="main-content"'), ("div", ' class="post-body"'), ("section", ' class="article"'), ("div", ' class="entry story"')))
        body = f"<{tag}{name}>{''.join(parts)}</{tag}>"
        if r.random() < 0.3:
            body = f"<{(t := r.choice(('main', 'div', 'div')))}>{body}{self.around() if r.random() < 0.4 else ''}</{t}>"
        before = "".join(self.around() for _ in range(r.randint(0, 4)))
        after = "".join(self.around() for _ in range(r.randint(0, 4)))
        end = r.choice(("</body></html>", ""))
        if r.random() < self.nameless:
            # tags alone tell what a part is for: what stood there by its name gets a tag for it
            before, after = (re.sub(r"<(/?)(?:div|section|ol)\b(?! class=comment>)", r"<\1aside", x) for x in (before, after))
            hide = lambda m: f'{m[1]}="{"".join(r.choice("bcdfghjkmnpqrtvwxz0123456789") for _ in range(6))}"'
            before, body, after = (re.sub(r"\b(class|id)=(?:\"[^\"]*\"|\w+)", hide, x) for x in (before, body, after))
        head = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        return head + before + "<!-- x -->" + body + after + end, truth


@cache
def trained(pages: int = 1200, seed: int = 11) -> Trees:
    """Trees trained on the generator's pages; the same for each run."""
    made, read_pages = Generator(seed), []
    for _ in range(pages):
        html, truth = made.page()
        nodes, blocks = read(html)
        left = [" ".join(t.split()) for t in truth]
        good = np.zeros(len(nodes))
        for k, text in blocks:
            if left and text == left[0]:
                left.pop(0)
                good[k] = 1
        for k in range(len(nodes) - 1, 0, -1):
            good[nodes[k].parent] = max(good[nodes[k].parent], good[k])
        read_pages.append((nodes, blocks, good))
    weights = token_weights([(nodes, good) for nodes, _, good in read_pages])
    xs, ys = [], []
    for nodes, blocks, good in read_pages:
        shown = np.array([x.texts > 0 or bool(x.children) for x in nodes])
        xs.append(features(nodes, blocks, weights)[shown])
        ys.append(good[shown])
    return Trees(np.concatenate(xs), np.concatenate(ys), weights)


def main_texts(pages: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page."""
    parsed = [read(p or "") for p in pages]
    rows = [features(*x, trees.weights) for x in parsed]
    odds = trees.log_odds(np.concatenate(rows)) if rows else np.empty(0)
    out, at = [], 0
    for (nodes, blocks), own in zip(parsed, rows):
        kept = decode(nodes, odds[at : at + len(own)])
        at += len(own)
        out.append("\n\n".join(text for k, text in blocks if kept[k]))
    return out


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep with text and n_chars for each whole page."""
    spark = pages.sparkSession
    ship(spark)
    trees = spark.sparkContext.broadcast(trained())

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 50):
                some = batch.slice(lo, 50)
                texts = main_texts(some.column(some.num_columns - 1).to_pylist(), trees.value)
                own = [some.column(k) for k in range(some.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"]
                )

    schema = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)
    return pages.select(*keep, "html").mapInArrow(run, f"{schema}text string, n_chars long")
