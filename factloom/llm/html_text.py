"""HTML extraction (7): a recurrent labeller of blocks.

A page becomes its sequence of leaf blocks: runs of text between block-level tags, each with the path of
open elements. A bidirectional LSTM in numpy reads a hashed vector of each block's path (tags, classes,
ids, roles) and one of its words, and labels every block as main text or not, so each decision sees the
whole page. It is trained here on generated pages (templates of menus, notices, adverts, articles,
comments and so on in random word soup) whose labels are known.

Character references are decoded, white space in a block becomes one space, main blocks are joined in
page order by a newline. Null and empty pages give an empty text; pages of any length are read whole
(pages run together up to BLOCKS_AT_ONCE blocks; a longer page goes through the network in slabs, forward
and then backward, with only a number kept for each block); unclosed and wrongly nested tags are closed as browsers
do in the main; repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame

from .common import load, map_rows

TAGS = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|noscript|template|svg)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
ATTRS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
#: Fixed values of HTML: elements that run within a block, and elements without content.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new element of these kinds closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

PATH_CELLS, WORD_CELLS, HIDDEN = 160, 24, 16
INPUT = PATH_CELLS + WORD_CELLS + 6
PAGES, EPOCHS, BATCH, RATE = 360, 14, 24, 0.01
BLOCKS_AT_ONCE = 4096


def blocks(html: str | None) -> list[tuple[tuple, str, float]]:
    """(path, text, share of the text in links) of every leaf block that has text."""
    out: list = []
    if not html:
        return out
    stack: list[tuple] = []
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((tuple(stack), text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    links, last = 0, 0
    for m in TAGS.finditer(html):
        if m.start() > last:
            piece = html[last : m.start()]
            parts.append(piece)
            if links:
                linked += len(piece)
        last = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = 0 if m["end"] else 1
            continue
        flush()
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
        while stack and stack[-1][0] in CLOSES.get(tag, ()):
            stack.pop()
        if tag not in VOID:
            names = tuple(v for a in ATTRS.findall(m["attrs"]) for v in SPLIT.split("".join(a).lower()) if v) if m["attrs"] else ()
            stack.append((tag, *names))
    if last < len(html):
        parts.append(html[last:])
    flush()
    return out


def forget() -> None:
    path_vector.cache_clear()


@lru_cache(maxsize=20_000)
def path_vector(path: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Cells and weights of a path: each element's tag and names, the nearest and the outermost marked."""
    cells: dict[int, float] = {}
    for depth, element in enumerate(path):
        for n, name in enumerate(element):
            cells[zlib.crc32(f"{'t' if n == 0 else 'n'}:{name}".encode()) % PATH_CELLS] = 1.0
        if depth == len(path) - 1:
            cells[zlib.crc32(f"last:{element[0]}".encode()) % PATH_CELLS] = 1.0
    return np.array(list(cells), np.int64), np.array(list(cells.values()), np.float32)


def vectors(found: list) -> np.ndarray:
    """Input rows [block, INPUT] of a page."""
    x = np.zeros((len(found), INPUT), np.float32)
    for i, (path, text, links) in enumerate(found):
        cells, weights = path_vector(path)
        x[i, cells] = weights
        words = text.split()
        hashed = np.bincount([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_CELLS for w in words], minlength=WORD_CELLS)
        x[i, PATH_CELLS : PATH_CELLS + WORD_CELLS] = hashed / np.sqrt(np.dot(hashed, hashed))
        x[i, -6:] = (links, min(len(words), 40) / 40, np.log1p(len(text)) / 8, text[-1] in ".!?:", len(path) / 10, 1.0)
    return x


# The network: two LSTMs, one from each end, and a logistic layer over both.


def new_weights(seed: int) -> dict:
    rng = np.random.default_rng(seed)
    own = {}
    for side in ("fore", "back"):
        own[f"{side}_x"] = rng.normal(0, 0.15, (INPUT, 4 * HIDDEN)).astype(np.float32)
        own[f"{side}_h"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        own[f"{side}_b"] = bias
    own["out"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
    own["skip"] = np.zeros(INPUT, np.float32)
    own["base"] = np.zeros(1, np.float32)
    return own


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def run_lstm(weights: dict, side: str, x: np.ndarray, live: np.ndarray, keep: bool = False, state: list | None = None):
    """States [t, page, HIDDEN] of x [t, page, INPUT]; states stop changing behind a page's end.

    state: the hidden and cell states to begin with, replaced by the last ones.
    """
    steps, n, _ = x.shape
    z_x = (x.reshape(-1, INPUT) @ weights[f"{side}_x"] + weights[f"{side}_b"]).reshape(steps, n, 4 * HIDDEN)
    h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
    out, tape = np.zeros((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        z = z_x[t] + h @ weights[f"{side}_h"]
        gates = sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        c_new = f * c + i * g
        wide = np.tanh(c_new)
        m = live[t][:, None]
        if keep:
            tape.append((h, c, i, f, o, g, wide))
        h, c = np.where(m, o * wide, h), np.where(m, c_new, c)
        out[t] = h
    if state is not None:
        state[:] = h, c
    return (out, tape) if keep else out


def lstm_gradients(weights: dict, side: str, x: np.ndarray, live: np.ndarray, tape: list, pull: np.ndarray) -> dict:
    steps, n, _ = x.shape
    d_h, d_c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    d_z = np.zeros((steps, n, 4 * HIDDEN), np.float32)
    d_w = np.zeros_like(weights[f"{side}_h"])
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, wide = tape[t]
        m = live[t][:, None]
        d = (d_h + pull[t]) * m
        d_cell = d * o * (1 - wide * wide) + d_c * m
        z = d_z[t]
        z[:, :HIDDEN] = d_cell * g * i * (1 - i)
        z[:, HIDDEN : 2 * HIDDEN] = d_cell * c * f * (1 - f)
        z[:, 2 * HIDDEN : 3 * HIDDEN] = d * wide * o * (1 - o)
        z[:, 3 * HIDDEN :] = d_cell * i * (1 - g * g)
        d_w += h.T @ z
        d_h = z @ weights[f"{side}_h"].T + np.where(m, 0, d_h + pull[t])
        d_c = np.where(m, d_cell * f, d_c)
    flat = d_z.reshape(-1, 4 * HIDDEN)
    return {f"{side}_x": x.reshape(-1, INPUT).T @ flat, f"{side}_h": d_w, f"{side}_b": flat.sum(axis=0)}


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x [t, page, INPUT], the same with each page reversed, which steps are live, and the reversing places."""
    lengths = np.array([len(p) for p in pages])
    steps = int(lengths.max())
    x = np.zeros((steps, len(pages), INPUT), np.float32)
    for n, p in enumerate(pages):
        x[: len(p), n] = p
    t = np.arange(steps)[:, None]
    live = t < lengths
    turn = np.where(live, lengths - 1 - t, t)
    return x, np.take_along_axis(x, turn[..., None], axis=0), live, turn


def logits(weights: dict, pages: list[np.ndarray], keep: bool = False):
    x, x_back, live, turn = padded(pages)
    fore = run_lstm(weights, "fore", x, live, keep)
    back = run_lstm(weights, "back", x_back, live, keep)
    h = np.concatenate([fore[0] if keep else fore, np.take_along_axis(back[0] if keep else back, turn[..., None], axis=0)], axis=2)
    z = h @ weights["out"] + x @ weights["skip"] + weights["base"]
    return (z, h, x, x_back, live, turn, fore, back) if keep else (z, live)


def main_blocks(weights: dict, pages: list[np.ndarray]) -> list[np.ndarray]:
    """For each page which of its blocks are main text; pages of like length run together, bounded by blocks."""
    out: list = [np.zeros(0, bool)] * len(pages)
    order = sorted((n for n in range(len(pages)) if len(pages[n])), key=lambda n: len(pages[n]))
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and (end - begin + 1) * len(pages[order[end]]) <= BLOCKS_AT_ONCE:
            end += 1
        z, _ = logits(weights, [pages[n] for n in order[begin:end]])
        for k, n in enumerate(order[begin:end]):
            out[n] = z[: len(pages[n]), k] > 0
        begin = end
    return out


def main_blocks_of_long(weights: dict, found: list) -> np.ndarray:
    """Which blocks of one long page are main text: both directions slab by slab, the state handed on."""
    z = np.zeros(len(found), np.float32)
    begins = range(0, len(found), BLOCKS_AT_ONCE)
    for side, slabs, out in (("fore", begins, weights["out"][:HIDDEN]), ("back", reversed(begins), weights["out"][HIDDEN:])):
        state = [np.zeros((1, HIDDEN), np.float32) for _ in range(2)]
        for i in slabs:
            x = vectors(found[i : i + BLOCKS_AT_ONCE])
            own = x if side == "fore" else x[::-1]
            h = run_lstm(weights, side, own[:, None], np.ones((len(x), 1), bool), state=state)[:, 0] @ out
            z[i : i + len(x)] += (h + x @ weights["skip"] + weights["base"]) if side == "fore" else h[::-1]
    return z > 0


def label_pages(weights: dict, found: list[list]) -> list[np.ndarray]:
    """For each page's blocks which are main text; no more than BLOCKS_AT_ONCE blocks have their vectors at a time."""
    out: list = [np.zeros(0, bool)] * len(found)
    group: list[int] = []
    held = 0

    def settle():
        for n, mark in zip(group, main_blocks(weights, [vectors(found[n]) for n in group]), strict=True):
            out[n] = mark
        group.clear()

    for n, own in enumerate(found):
        if len(own) > BLOCKS_AT_ONCE:
            out[n] = main_blocks_of_long(weights, own)
        elif own:
            if held + len(own) > BLOCKS_AT_ONCE:
                settle()
                held = 0
            group.append(n)
            held += len(own)
    settle()
    return out


# Generated training pages.

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ent ung sch keit ver que ment eau ción os la el é ü ñ".split()


class PageWriter:
    """Random pages with known labels: each part is written with the mark of its blocks."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def word(self) -> str:
        return "".join(self.pick(SYLLABLES) for _ in range(int(self.rng.integers(1, 5))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(int(self.rng.integers(low, high + 1))))

    def sentence(self, low: int = 3, high: int = 22) -> str:
        return self.words(low, high).capitalize() + self.pick([".", ".", ".", "!", "?", ""])

    def paragraph(self) -> str:
        return " ".join(self.sentence() for _ in range(int(self.rng.integers(1, 6))))

    def wrap(self, tag: str, names: list[str], inner: str) -> str:
        kind = self.pick(["class", "class", "id"])
        attrs = f' {kind}="{self.pick(names)}"' if names and (tag == "div" or self.rng.random() < 0.5) else ""
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def links(self) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(int(self.rng.integers(2, 9)))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.rng.random() < 0.7 else " | ".join(items)

    def boiler(self) -> str:
        kind = int(self.rng.integers(10))
        some = self.pick([self.sentence(2, 14), self.paragraph(), f"<p>{self.sentence(2, 16)}</p>", f"<p>{self.paragraph()}</p><p>{self.sentence()}</p>"])
        if kind == 0:
            return self.wrap(self.pick(["nav", "nav", "div"]), ["nav", "menu", "navbar", "main-nav", "breadcrumb", "topmenu", "navigation"], self.links())
        if kind == 1:
            return self.wrap(self.pick(["header", "div"]), ["header", "site-header", "masthead", "banner", "topbar"], self.pick([f"<h1>{self.words(1, 4)}</h1>", some, self.links()]))
        if kind in (2, 3):
            return self.wrap(self.pick(["div", "div", "aside", "section"]), ["ad", "ads", "advert", "sponsor", "sponsored", "promo", "banner-ad", "advertisement", "ad-slot"], some)
        if kind == 4:
            return self.wrap(self.pick(["aside", "div"]), ["sidebar", "side", "widget", "related", "related-posts", "recommended", "popular", "trending"], f"<h3>{self.words(1, 4)}</h3>" + self.pick([self.links(), some]))
        if kind == 5:
            return self.wrap("div", ["cookie", "cookie-notice", "consent", "notice", "gdpr", "alert", "cookie-banner", "modal", "popup"], some + self.pick(["", "<button>OK</button>"]))
        if kind == 6:
            return self.wrap("form", ["search", "newsletter", "subscribe", "login", "signup"], f"<label>{self.words(1, 4)}</label><input type='text'><button>{self.word()}</button>" + self.pick(["", f"<p>{self.sentence()}</p>"]))
        if kind == 7:
            said = "".join(self.wrap(self.pick(["div", "li", "article", "p"]), ["comment", "comment-body", "reply"], self.pick([self.paragraph(), f"<p>{self.paragraph()}</p>"])) for _ in range(int(self.rng.integers(1, 5))))
            return self.wrap(self.pick(["div", "section", "ol"]), ["comments", "comment-list", "discussion", "disqus", "responses"], f"<h3>{self.words(1, 3)}</h3>" + said) if self.rng.random() < 0.9 else f'<section class="comments">{said}</section>'
        if kind == 8:
            return self.wrap("div", ["share", "social", "share-buttons", "tags", "meta", "byline", "pagination", "pager"], self.pick([self.links(), self.words(1, 6)]))
        return self.wrap(self.pick(["footer", "footer", "div"]), ["footer", "site-footer", "copyright", "legal", "bottom"], self.pick([f"&copy; {self.word()} &middot; {self.sentence()}", self.links(), some]))

    def article(self) -> list[tuple[str, int]]:
        parts: list[tuple[str, int]] = []
        if self.rng.random() < 0.85:
            parts.append((f"<{(t := self.pick(['h1', 'h1', 'h2']))}>{self.words(1, 12).capitalize()}</{t}>", 1))
        for _ in range(int(self.rng.integers(1, 14))):
            kind = self.rng.random()
            if kind < 0.62:
                parts.append((f"<p>{self.paragraph()}</p>", 1))
            elif kind < 0.72:
                parts.append((f"<p><b>{self.sentence()}<br>", 1))
            elif kind < 0.78:
                parts.append((f"<h2>{self.words(1, 8)}</h2>", 1))
            elif kind < 0.84:
                parts.append(("<ul>" + "".join(f"<li>{self.sentence(1, 10)}</li>" for _ in range(3)) + "</ul>", 1))
            elif kind < 0.88:
                parts.append((f"<blockquote>{self.paragraph()}</blockquote>", 1))
            elif kind < 0.91:
                parts.append((f"<pre>{self.words(2, 9)}</pre>", 1))
            elif kind < 0.94:
                parts.append((f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table>", 1))
            elif kind < 0.97:
                parts.append((f"<p>{self.sentence(1, 4)} <a href='/x'>{self.words(1, 3)}</a> {self.sentence(1, 5)}</p>", 1))
            else:
                parts.append((self.boiler(), 0))
        return parts

    def page(self) -> tuple[list, list[int]]:
        """Blocks and labels. Parts are parsed one by one inside their containers, which gives each block its label."""
        holder = self.pick(['<article>', '<article>', '<article class="post">', '<main>', '<div id="content">', '<div class="post-content">', '<div class="entry-content">', '<section class="article-body">', '<main><article>', '<div class="story">'])
        before = [self.boiler() for _ in range(int(self.rng.integers(0, 4)))]
        after = [self.boiler() for _ in range(int(self.rng.integers(0, 4)))]
        found, labels = [], []
        outer = "<html><body>" + self.pick(["", "", '<div class="wrapper">', '<div id="page">', '<div class="container">'])
        for parts, prefix in (([(b, 0) for b in before], outer), (self.article(), outer + holder), ([(b, 0) for b in after], outer)):
            for html, label in parts:
                own = blocks(prefix + html)
                found += own
                labels += [label] * len(own)
        return found, labels


@lru_cache(maxsize=1)
def train(pages: int = PAGES, seed: int = 11) -> dict:
    """Weights learned from generated pages by back-propagation through time (Adam); the same each time."""
    writer, rng = PageWriter(seed), np.random.default_rng(seed)
    made = [p for p in (writer.page() for _ in range(pages)) if p[0]]
    x, y = [vectors(b) for b, _ in made], [np.array(l, np.float32) for _, l in made]
    weights = new_weights(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for begin in range(0, len(order), BATCH):
            own = order[begin : begin + BATCH]
            z, h, xs, xb, live, turn, fore, back = logits(weights, [x[n] for n in own], keep=True)
            target = np.zeros_like(z)
            for k, n in enumerate(own):
                target[: len(y[n]), k] = y[n]
            err = ((sigmoid(z) - target) * live / live.sum()).astype(np.float32)
            pull = err[..., None] * weights["out"]
            gradients = {"out": np.einsum("tn,tnh->h", err, h), "skip": np.einsum("tn,tni->i", err, xs), "base": err.sum(keepdims=True).reshape(1)}
            gradients |= lstm_gradients(weights, "fore", xs, live, fore[1], pull[..., :HIDDEN])
            gradients |= lstm_gradients(weights, "back", xb, live, back[1], np.take_along_axis(pull[..., HIDDEN:], turn[..., None], axis=0))
            step += 1
            for k, g in gradients.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                weights[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weights


def extract(df: DataFrame, html: str = "html", key: str = "page_id", url: str = "url", weights: dict | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row per input row."""
    sent = df.sparkSession.sparkContext.broadcast(weights or train())
    kinds = [df.schema[c].dataType.simpleString() for c in (key, url)]

    def run(keys, urls, pages):
        found = [blocks(p) for p in pages]
        chosen = label_pages(sent.value, found)
        texts = ["\n".join(b[1] for b, m in zip(own, mark, strict=True) if m) for own, mark in zip(found, chosen, strict=True)]
        return [keys, urls, texts, [len(t) for t in texts]]

    return map_rows(df, [key, url, html], f"`{key}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_chars long", run)


def op7_html_text(spark, sf_dir):
    return extract(load(spark, sf_dir, "pages"))
