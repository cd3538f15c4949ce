"""Operator 9: main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements. Each element carries a hidden label, content or not, with a
potential from its own features (tag, words of its class and id, density of links, amount of text) and one for
the pair with its parent. Sum-product messages go up the tree and down again and give each element's marginal;
text stays where the marginal of its element is above one half. Head, script, style and other elements that a
browser does not show hold no text at all.

The potentials are trained by maximum likelihood on labelled pages: pages composed here from stated templates
with known main text, and a bounded sample of the table's own pages that mark their article, whose marks are the
labels. The tag ``article`` is a feature among others.

Null, empty and text-free pages give an empty text. Broken markup is read as browsers do in the common cases:
unclosed paragraphs, list items and cells end where the next begins, stray end tags are ignored. Every page is
read to its end, in time linear in its length; repeated rows are handled alike. An empty table gives no rows. Columns other
than key, address and page are not read.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import ship

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>\x00]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Any attribute with its value, quoted or not.
_NAMED = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
_WORD = re.compile(r"[a-z]+")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
#: Elements whose contents a page does not show as text.
_UNSEEN = {"head", "script", "style", "template", "title", "noscript", "textarea", "select", "option", "button", "iframe", "object", "svg", "canvas", "audio", "video", "noembed", "noframes", "xmp", "datalist"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"html", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: What an opening tag ends, if it is open, and what it does not look beyond.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}
_SPACE = re.compile(r"\s+")

TAGS = ("body", "div", "p", "article", "main", "section", "nav", "aside", "header", "footer", "form", "ul", "li", "h1", "h2", "h3", "blockquote", "pre", "table", "td", "figure", "dl")
#: Words of class and id attributes that the model may learn from, as features without a preset sign.
CUES = ("content", "article", "post", "entry", "story", "main", "text", "body", "nav", "menu", "sidebar", "side", "footer", "header", "ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner", "cookie", "consent", "notice", "popup", "newsletter", "subscribe", "comment", "comments", "reply", "related", "share", "social", "breadcrumb", "breadcrumbs", "copyright", "search", "login", "widget", "tags", "meta", "author", "pagination", "disqus", "respond", "teaser")
FEATURES = ("bias", *(f"tag:{t}" for t in TAGS), "tag:other", *(f"cue:{c}" for c in CUES), "text", "long_text", "links", "stop", "deep")
_TAG_AT = {t: 1 + i for i, t in enumerate(TAGS)}
_CUE_AT = {c: 2 + len(TAGS) + i for i, c in enumerate(CUES)}
_OWN = 2 + len(TAGS) + len(CUES)


@dataclass
class Page:
    """Block elements in page order: parents, features, and texts with the element each belongs to."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    cues: list[tuple[int, ...]] = field(default_factory=list)
    mark: list[bool] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


def _hidden(attrs: str) -> bool:
    """Whether one of the attributes is named ``hidden``; class names and values do not count."""
    return "hidden" in attrs.lower() and any(m[1].lower() == "hidden" for m in _NAMED.finditer(attrs))


def parse(source: str | None, marker: str = "data-main") -> Page:
    """Read a page. ``marker``: an attribute that labels main elements in composed pages."""
    page = Page()
    source = source or ""
    stack: list[tuple[str, int, bool]] = []  # tag, block element around its text, unseen
    opened: Counter[str] = Counter()  # tags in the stack
    run: list[str] = []
    run_of, in_link, link_chars = -1, 0, 0

    def add(tag: str, attrs: str, up: int) -> int:
        cues, mark = (), False
        if attrs:
            words = set()
            for m in _ATTR.finditer(attrs):
                if m[1].lower() in ("class", "id", "role"):
                    words.update(_WORD.findall((m[2] or m[3] or m[4] or "").lower()))
            cues = tuple(_CUE_AT[w] for w in sorted(words) if w in _CUE_AT)
            mark = marker in attrs
        page.parent.append(up)
        page.tag.append(tag)
        page.cues.append(cues)
        page.mark.append(mark)
        page.chars.append(0)
        page.linked.append(0)
        return len(page.parent) - 1

    def flush() -> None:
        nonlocal link_chars
        if run:
            text = _SPACE.sub(" ", "".join(run)).strip()
            if text:
                page.blocks.append((run_of, text))
                page.chars[run_of] += len(text)
                page.linked[run_of] += min(link_chars, len(text))
            run.clear()
        link_chars = 0

    def write(s: str) -> None:
        nonlocal run_of, link_chars
        if not s or (stack and stack[-1][2]):
            return
        at = stack[-1][1] if stack else root
        if at != run_of:
            flush()
            run_of = at
        run.append(html.unescape(s))
        if in_link:
            link_chars += len(s.strip())

    def pop(k: int) -> None:
        nonlocal in_link
        while len(stack) > k:
            t = stack.pop()[0]
            opened[t] -= 1
            if t in _BLOCK:
                flush()
            elif t == "a":
                in_link -= 1

    root = add("body", "", -1)
    at = 0
    n = len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            write(source[at:])
            break
        write(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, close, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if close:
            if tag == "br":
                write(" ")
            elif not opened[tag]:  # nothing to look for, however deep the page is
                if tag == "p":
                    flush()
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        pop(k)
                        break
                    if tag not in _BLOCK and stack[k][0] in _BLOCK:
                        break
            continue
        if tag in ("br", "wbr", "img", "input"):
            if tag == "br":
                write(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(source, at)
            inner = source[at : end.start() if end else n]
            at = end.end() if end else n
            if tag not in _UNSEEN:
                write(inner)
            continue
        if tag in _CLOSES:
            ends, wall = _CLOSES[tag]
            for k in range(len(stack) - 1, -1, -1) if any(opened[t] for t in ends) else ():
                if stack[k][0] in ends:
                    pop(k)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif stack[k][0] in wall:
                    break
        elif tag in _BLOCK and tag not in ("html", "body"):
            for k in range(len(stack) - 1, -1, -1) if opened["p"] else ():
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in _BLOCK and stack[k][0] != "p":
                    break
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                pop(len(stack) - 1)
        up, unseen = (stack[-1][1], stack[-1][2]) if stack else (root, False)
        if tag == "body":
            page.cues[root] = page.cues[add("body", attrs, root)]
            unseen = False
        elif tag == "article" and unseen:
            unseen = False
        if tag in _BLOCK and not unseen:
            flush()
            own = up if tag in ("html", "body") else add(tag, attrs, up)
        else:
            own = up
        if tag == "a":
            in_link += 1
        if attrs.rstrip().endswith("/") and tag not in _BLOCK:
            if tag == "a":
                in_link -= 1
            continue
        opened[tag] += 1
        stack.append((tag, own, unseen or tag in _UNSEEN or tag in _BLOCK and _hidden(attrs)))
    pop(0)
    flush()
    return page


def features(page: Page) -> np.ndarray:
    n = len(page.parent)
    x = np.zeros((n, len(FEATURES)))
    x[:, 0] = 1
    chars, linked = np.array(page.chars, float), np.array(page.linked, float)
    depth = np.zeros(n)
    for i in range(n):
        if page.parent[i] >= 0:
            depth[i] = depth[page.parent[i]] + 1
        x[i, _TAG_AT.get(page.tag[i], 1 + len(TAGS))] = 1
        for c in page.cues[i]:
            x[i, c] = 1
    for i in range(n - 1, 0, -1):
        chars[page.parent[i]] += chars[i]
        linked[page.parent[i]] += linked[i]
    stop = np.zeros(n)
    for e, t in page.blocks:
        stop[e] = max(stop[e], t[-1] in ".!?…:\"”")
    x[:, _OWN] = np.minimum(1, np.log1p(chars) / 8)
    x[:, _OWN + 1] = chars > 200
    x[:, _OWN + 2] = linked / np.maximum(1, chars)
    x[:, _OWN + 3] = stop
    x[:, _OWN + 4] = np.minimum(1, depth / 10)
    return x


def _lse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


class TreeModel:
    """Pairwise log-potentials over (parent, child) and a linear log-potential for content at each element."""

    def __init__(self, weight: np.ndarray, pair: np.ndarray):
        self.weight, self.pair = weight, pair

    def beliefs(self, x: np.ndarray, parent: np.ndarray, want_pairs: bool = False):
        """Marginal of content at each element of a forest in which parents come before children; messages go
        up and down one depth at a time, for all pages at once."""
        n = len(parent)
        depth = np.zeros(n, np.int64)
        order = np.arange(n)
        live = parent >= 0
        d, up = live.astype(np.int64), np.where(live, parent, 0)
        while live.any():
            depth += d
            live = live & (parent[up] >= 0)
            d, up = live.astype(np.int64), np.where(live, parent[up], up)
        e = np.stack((np.zeros(n), x @ self.weight), axis=1)
        inward, sent = e.copy(), np.zeros((n, 2))
        levels = [order[depth == k] for k in range(int(depth.max()) + 1)] if n else []
        for ids in reversed(levels[1:]):
            b = inward[ids]
            m = _lse(b[:, :1] + self.pair[:, 0], b[:, 1:] + self.pair[:, 1])
            m -= m.max(axis=1, keepdims=True)
            sent[ids] = m
            np.add.at(inward, parent[ids], m)
        outward = np.zeros((n, 2))
        for ids in levels[1:]:
            up = parent[ids]
            rest = inward[up] + outward[up] - sent[ids]
            m = _lse(rest[:, :1] + self.pair[0], rest[:, 1:] + self.pair[1])
            outward[ids] = m - m.max(axis=1, keepdims=True)
        total = inward + outward
        p = np.exp(total - _lse(total[:, 0], total[:, 1])[:, None])
        if not want_pairs:
            return p[:, 1]
        ids = order[parent >= 0]
        up = parent[ids]
        rest = inward[up] + outward[up] - sent[ids]
        two = rest[:, :, None] + self.pair[None] + inward[ids][:, None, :]
        two = np.exp(two - two.max(axis=(1, 2), keepdims=True))
        return p[:, 1], two / two.sum(axis=(1, 2), keepdims=True), ids

    @classmethod
    def train(cls, pages: list[tuple[Page, np.ndarray]], steps: int = 150, rate: float = 0.15, decay: float = 1e-3) -> TreeModel:
        xs, parents, ys, at = [], [], [], 0
        for page, y in pages:
            p = np.array(page.parent)
            xs.append(features(page))
            parents.append(np.where(p >= 0, p + at, -1))
            ys.append(y)
            at += len(p)
        x, parent, y = np.concatenate(xs), np.concatenate(parents), np.concatenate(ys).astype(int)
        size = np.concatenate([np.full(len(v), 1 / len(v)) for v in ys])  # every page weighs the same
        model = cls(np.zeros(len(FEATURES)), np.zeros((2, 2)))
        m, v = np.zeros(len(FEATURES) + 4), np.zeros(len(FEATURES) + 4)
        for step in range(1, steps + 1):
            p, two, ids = model.beliefs(x, parent, True)
            gold = np.zeros((len(ids), 2, 2))
            gold[np.arange(len(ids)), y[parent[ids]], y[ids]] = 1
            g = np.concatenate((x.T @ ((y - p) * size) / len(pages), (((gold - two) * size[ids, None, None]).sum(axis=0) / len(pages)).ravel()))
            g -= decay * np.concatenate((model.weight, model.pair.ravel())) / 10
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            model = cls(model.weight + move[: len(FEATURES)], model.pair + move[len(FEATURES) :].reshape(2, 2))
        return model

    def texts(self, pages: list[Page]) -> list[str]:
        if not pages:
            return []
        at, parents, xs, starts = 0, [], [], []
        for page in pages:
            p = np.array(page.parent)
            starts.append(at)
            parents.append(np.where(p >= 0, p + at, -1))
            xs.append(features(page))
            at += len(p)
        good = self.beliefs(np.concatenate(xs), np.concatenate(parents)) > 0.5
        return ["\n\n".join(t for e, t in page.blocks if good[s + e]) for s, page in zip(starts, pages, strict=True)]


def composed_pages(count: int = 240, seed: int = 7) -> list[str]:
    """Labelled pages from a few templates; ``data-main`` marks the elements that hold main text."""
    rng = random.Random(seed)
    syllables = "an the or re tion ing ent is of to le la de ver sch ung que os ado er".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize()
    prose = lambda: " ".join(say(4, 25) + rng.choice([".", ".", "?"]) for _ in range(rng.randint(1, 6)))
    links = lambda: "".join(f"<li><a href='/{word()}'>{say(1, 3)}</a></li>" for _ in range(rng.randint(3, 9)))
    pick = rng.choice
    out = []
    for _ in range(count):
        par = lambda mark: f"<p{mark}>{pick(['', '<b>', '<em>'])}{prose()}</p>" if rng.random() < 0.9 else f"<p{mark}>{say(1, 4)}."
        body = [f"<{h} data-main>{say(2, 9)}{pick(['', '.'])}</{h}>" for h in [pick(["h1", "h2"])]]
        for _ in range(rng.randint(1, 14)):
            body.append(pick([par(" data-main")] * 6 + [f"<ul data-main>{''.join(f'<li data-main>{say(3, 14)}</li>' for _ in range(rng.randint(2, 5)))}</ul>", f"<blockquote data-main>{par(' data-main')}</blockquote>", f"<h2 data-main>{say(1, 6)}</h2>", f"<table data-main><tr data-main><td data-main>{say(1, 3)}</td><td data-main>{say(1, 9)}</td></tr></table>", f"<pre data-main>{say(5, 20)}</pre>"]))
        if rng.random() < 0.3:
            body.insert(rng.randint(1, len(body)), pick([f'<div class="ad">{prose()}</div>', f'<div class="share social"><a href="#">{say(1, 2)}</a></div>', f'<aside class="related"><ul>{links()}</ul></aside>', f'<form class="newsletter subscribe"><p>{say(3, 9)}.</p><button>{word()}</button></form>']))
        inside = "".join(body)
        main = pick([f"<article data-main>{inside}</article>"] * 3 + [f'<main data-main><article data-main class="post">{inside}</article></main>', f'<div data-main class="content">{inside}</div>', f'<div data-main id="main-content"><div data-main class="entry text">{inside}</div></div>', f"<main data-main>{inside}</main>", f'<section data-main class="story">{inside}</section>', f"<div data-main>{inside}</div>"])
        before = [pick([f"<nav><ul>{links()}</ul></nav>", f'<div class="menu"><ul>{links()}</ul></div>', f'<header><h2>{say(1, 3)}</h2><nav><ul>{links()}</ul></nav></header>', f'<div id="header"><p>{say(1, 5)}</p></div>'])]
        extra = [f'<div class="ad">{prose()}</div>', f'<div class="ad banner"><p>{say(2, 9)}.</p></div>', f'<div class="cookie notice"><p>{prose()}</p><button>OK</button></div>', f'<div id="cookie-consent">{prose()}</div>', f'<aside class="sidebar"><h3>{say(1, 3)}</h3><ul>{links()}</ul></aside>', f'<aside>{par("")}</aside>', f'<div class="sidebar"><p>{prose()}</p></div>', f'<form><p>{say(1, 4)}</p><input></form>', f'<form class="login search"><label>{say(1, 2)}</label></form>', f'<div class="promo sponsor">{par("")}</div>', f'<div class="breadcrumb"><a href="/">{word()}</a> &gt; {word()}</div>', f'<div class="advertisement"><p>{prose()}</p></div>', f'<div role="banner"><p>{say(2, 8)}</p></div>']
        after = [pick([f"<footer>{say(1, 9)}.</footer>", f"<footer><p>&copy; {say(2, 8)}</p><ul>{links()}</ul></footer>", f'<div class="footer copyright">{say(2, 9)}</div>'])]
        comments = "".join(f'<div class="comment"><p>{prose()}</p></div>' for _ in range(rng.randint(1, 6)))
        some = rng.sample(extra, rng.randint(0, 3))
        if rng.random() < 0.5:
            block = pick([f'<section class="comments"><h3>{say(1, 2)}</h3>{comments}</section>', f'<div id="comments"><ol>{"".join(f"<li class=comment><p>{prose()}</p></li>" for _ in range(rng.randint(1, 5)))}</ol></div>', comments])
            if rng.random() < 0.3 and main.endswith("</article>"):
                main = main[: -len("</article>")] + block + "</article>"
            else:
                some.append(block)
        rng.shuffle(some)
        cut = rng.randint(0, len(some))
        out.append(f"<html><head><title>{say(1, 5)}</title></head><body>{''.join(before + some[:cut])}{main}{''.join(some[cut:] + after)}</body></html>")
    return out


def train_model(pages: DataFrame | None = None, html_column: str = "html", sample: int = 120, composed: int = 240, longest: int = 200_000) -> TreeModel:
    """Fit on ``composed`` template pages and at most ``sample`` pages of the table that mark exactly one article
    and hold at most ``longest`` characters, which bounds what comes to the driver; those pages are used whole."""
    gold: list[tuple[Page, np.ndarray]] = []
    for source in composed_pages(composed):
        page = parse(source)
        gold.append((page, np.array(page.mark)))
    if pages is not None:
        marked = pages.where(F.col(html_column).rlike("(?i)<article[\\s>]") & (F.length(html_column) <= longest)).select(F.col(html_column).alias("h")).withColumn("k", F.xxhash64("h"))
        # names first, so that no task sends texts it does not have to; copies of a page are one page
        names = [r.k for r in marked.select("k").distinct().orderBy("k").limit(sample).collect()]
        rows = marked.where(F.col("k").isin(names)).groupBy("k").agg(F.min("h").alias("h")).orderBy("k").collect() if names else []
        for r in rows:
            page = parse(r.h)
            if page.tag.count("article") == 1:
                inside = np.zeros(len(page.parent), bool)
                for i, up in enumerate(page.parent):
                    inside[i] = page.tag[i] == "article" or (up >= 0 and inside[up] and page.tag[i] not in ("nav", "aside", "form", "footer"))
                gold.append((page, inside))
    return TreeModel.train(gold)


def extract(pages: DataFrame, model: TreeModel, key: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: ``key``, ``url``, ``text`` and ``n_chars``."""
    ship(pages.sparkSession)
    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                texts = model.texts([parse(h) for h in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[key, url, "text", "n_chars"])

    return pages.select(key, url, html_column).mapInArrow(run, f"`{key}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_chars long")
