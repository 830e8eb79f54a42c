"""Main text of web pages by a recurrent block labeller."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text of the page.
SILENT = "script|style|title|noscript|template|textarea|select|svg|iframe|object|canvas|audio|video"
#: A quoted value ends at its quote, within so many characters and tags' length of sight; an unclosed quote is a character like any other.
QUOTED = 4096
ATTRIBUTES = rf"(?:[^>\"'<]|\"[^\"<]{{0,{QUOTED}}}\"|'[^'<]{{0,{QUOTED}}}'|\"(?=[^\"]{{0,{QUOTED}}}\")[^\"]*\"|'(?=[^']{{0,{QUOTED}}}')[^']*'|[\"'])*+"
#: Comments, self-closed svg (the only silent element that can be), silent elements whole, tags (as far as a page that breaks off has them) and declarations.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<svg(?=[\s/])(?:{ATTRIBUTES})(?<=/)>|<({SILENT})(?=[\s/>])(?:{ATTRIBUTES})>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>]*)({ATTRIBUTES})>|<[/!?a-z][^<>]*(?:>|\Z)",
    re.S | re.I,
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes if it is the innermost open block; any block closes p.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
LABEL = re.compile(r'\bdata-label="(\d)"')

PATH, WORDS, NUMBERS = 192, 32, 7
WIDTH = PATH + WORDS + NUMBERS
#: Leaves that one pass of the network holds; a longer page is read in parts of so many, with the state carried on.
LEAVES = 20_000


@dataclass(eq=False)
class Element:
    """An open element: what it is in, its tag and names, the label it carries or is in, how many links it is in, and its path's vector once asked for."""

    parent: Element | None
    tag: str
    names: tuple[str, ...]
    label: str = ""
    links: int = 0
    vector: np.ndarray | None = None


PAGE = Element(None, "", ())
Leaf = tuple[Element, str, float]


def leaves(page: str) -> list[Leaf]:
    """(innermost element, text, share of it in links) of each block of text in page order; blanks of a text are single."""
    out: list[Leaf] = []
    stack: list[Element] = []
    opened: dict[str, int] = {}
    at_path = PAGE
    held: list[str] = []
    blank = True
    linked, at = 0, 0

    def flush() -> None:
        nonlocal linked, blank
        raw = "".join(held)
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if text:
            out.append((at_path, text, min(1.0, linked / max(len(raw), 1))))
        held.clear()
        linked, blank = 0, True

    def data(text: str) -> None:
        nonlocal at_path, linked, blank
        if text:
            inner = stack[-1] if stack else PAGE
            if blank:
                at_path, blank = inner, not text.strip()
            held.append(text)
            if inner.links:
                linked += len(text)

    def close(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    for m in TOKEN.finditer(page):
        data(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCK:
            flush()
        if m[2]:
            if opened.get(name):
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == name))
            continue
        if name in BLOCK:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag in BLOCK), None)
            if k is not None and (stack[k].tag == "p" or stack[k].tag in CLOSES.get(name, ())):
                close(k)
        if name not in VOID:
            names = " ".join(a or b or c for a, b, c in NAMED.findall(m[4])) if m[4] else ""
            label = LABEL.search(m[4]) if m[4] else None
            inner = stack[-1] if stack else PAGE
            stack.append(Element(inner, name, tuple(w.lower() for w in PART.findall(names)), label[1] if label else inner.label, inner.links + (name == "a")))
            opened[name] = opened.get(name, 0) + 1
    data(page[at:])
    flush()
    return out


def spot(text: str, of: int, salt: int = 0) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"), salt) % of


@lru_cache(100_000)
def spots(token: str) -> tuple[int, int]:
    return spot(token, PATH), spot(token, PATH, 1)


def path_vector(element: Element) -> np.ndarray:
    """Marks for the tags and names of an element and all it is in; each element's is made once, from that of its parent."""
    missing = []
    while element.vector is None and element.parent is not None:
        missing.append(element)
        element = element.parent
    x = element.vector if element.vector is not None else np.zeros(PATH, np.float32)
    for e in reversed(missing):
        x = x.copy()
        for token in (f"<{e.tag}>", *e.names):
            x[list(spots(token))] = 1
        e.vector = x
    return x


class Vectors:
    """Vectors of leaves: hashed tag path, hashed words, and a few numbers."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}

    def of(self, blocks: list[Leaf]) -> np.ndarray:
        x = np.zeros((len(blocks), WIDTH), np.float32)
        if len(self.words) > 500_000:
            self.words.clear()
        for i, (path, text, linked) in enumerate(blocks):
            x[i, :PATH] = path_vector(path)
            words = text.split(" ")
            places = []
            for w in words:
                k = self.words.get(w)
                if k is None:
                    k = self.words[w] = spot(w.lower().strip(".,;:!?()"), WORDS)
                places.append(k)
            x[i, PATH : PATH + WORDS] = np.minimum(np.bincount(places, minlength=WORDS) / np.sqrt(len(words)), 2)
            ends = text.count(".") + text.count("!") + text.count("?")
            x[i, PATH + WORDS :] = (
                np.log1p(len(text)) / 8, np.log1p(len(words)) / 6, linked, min(ends / len(words), 1),
                text[0].isupper(), text[-1] in ".!?", i / max(len(blocks) - 1, 1),
            )
        return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """A bidirectional LSTM with a logistic output for each leaf; per direction: input, recurrent weights and bias."""

    weights: list[np.ndarray]

    @property
    def hidden(self) -> int:
        return self.weights[1].shape[0]

    @staticmethod
    def fresh(hidden: int, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        out = []
        for _ in range(2):
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1
            out += [rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 4 * hidden)), rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)), bias]
        return Labeller([w.astype(np.float32) for w in [*out, rng.normal(0, 0.2, 2 * hidden), np.zeros(1)]])

    def scan(self, x: np.ndarray, mask: np.ndarray, side: int, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """Hidden states (time, batch, hidden) of one direction over x (time, batch, width), and what training needs."""
        wx, wh, bias = self.weights[3 * side : 3 * side + 3]
        n = self.hidden
        put = x @ wx + bias
        h, c = state or (np.zeros((x.shape[1], n), wx.dtype),) * 2
        states, tape = np.zeros((*x.shape[:2], n), wx.dtype), []
        for t in range(len(x)) if side == 0 else range(len(x) - 1, -1, -1):
            z = put[t] + h @ wh
            i, f, o, g = sigmoid(z[:, :n]), sigmoid(z[:, n : 2 * n]), sigmoid(z[:, 2 * n : 3 * n]), np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            before, old = h, c
            c = np.where(m, f * c + i * g, c)
            h = np.where(m, o * np.tanh(c), h)
            states[t] = h
            tape.append((t, i, f, o, g, before, old, c))
        return states, tape

    def margins(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        n = self.hidden
        return self.scan(x, mask, 0)[0] @ self.weights[6][:n] + self.scan(x, mask, 1)[0] @ self.weights[6][n:] + self.weights[7]

    def margins_in_parts(self, x: np.ndarray) -> np.ndarray:
        """Margins of one page's leaves, as of one pass, in parts of LEAVES."""
        n, out = self.hidden, np.repeat(self.weights[7], len(x))
        starts = range(0, len(x), LEAVES)
        for side in (0, 1):
            state = None
            for s in starts if side == 0 else reversed(starts):
                part = x[s : s + LEAVES, None]
                states, tape = self.scan(part, np.ones(part.shape[:2], bool), side, state)
                state = states[-1 if side == 0 else 0], tape[-1][-1]
                out[s : s + LEAVES] += states[:, 0] @ self.weights[6][side * n : side * n + n]
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss over the leaves."""
        n = self.hidden
        sides = [self.scan(x, mask, side) for side in (0, 1)]
        margin = sum(s @ self.weights[6][k * n : k * n + n] for k, (s, _) in enumerate(sides)) + self.weights[7]
        d = np.where(mask, sigmoid(margin) - y, 0) / max(mask.sum(), 1)
        grads = [np.zeros_like(w) for w in self.weights]
        grads[7][0] = d.sum()
        for side, (states, tape) in enumerate(sides):
            wh, out = self.weights[3 * side + 1], self.weights[6][side * n : side * n + n]
            grads[6][side * n : side * n + n] = np.einsum("tb,tbh->h", d, states)
            dh, dc = np.zeros_like(states[0]), np.zeros_like(states[0])
            dz_all = np.zeros((*x.shape[:2], 4 * n), wh.dtype)
            for t, i, f, o, g, before, old, c in reversed(tape):
                m = mask[t][:, None]
                dh = dh + d[t][:, None] * out
                tc = np.tanh(c)
                dcell = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate((dcell * g * i * (1 - i), dcell * old * f * (1 - f), dh * tc * o * (1 - o), dcell * i * (1 - g * g)), axis=1)
                dz = np.where(m, dz, 0)
                grads[3 * side + 1] += before.T @ dz
                dz_all[t] = dz
                dh = np.where(m, dz @ wh.T, dh)
                dc = np.where(m, dcell * f, dc)
            grads[3 * side] += x.reshape(-1, WIDTH).T @ dz_all.reshape(-1, 4 * n)
            grads[3 * side + 2] += dz_all.sum(axis=(0, 1))
        return grads

    def predict(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each leaf of each page is main text; pages of like length go through together."""
        out = [self.margins_in_parts(x) > 0 if len(x) > LEAVES else np.zeros(0, bool) for x in pages]
        rest = sorted((k for k, x in enumerate(pages) if 0 < len(x) <= LEAVES), key=lambda k: (len(pages[k]), k))
        while rest:
            most = max(1, LEAVES // len(pages[rest[-1]]))
            batch, rest = rest[-most:], rest[:-most]
            x, mask = padded([pages[k] for k in batch])
            margin = self.margins(x, mask)
            for j, k in enumerate(batch):
                out[k] = margin[: len(pages[k]), j] > 0
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), WIDTH), np.float32)
    mask = np.zeros(x.shape[:2], bool)
    for j, page in enumerate(pages):
        x[: len(page), j], mask[: len(page), j] = page, True
    return x, mask


class Layouts:
    """Made-up pages whose blocks are known to be main text (data-label 1) or not (0), in many layouts."""

    MAIN = ("<article{}>", "<main{}>", '<div class="content"{}>', '<div class="post-body"{}>', '<div class="entry-content"{}>', '<div id="main"{}>', '<div class="story text"{}>', '<section class="article"{}>')
    #: Kinds of blocks that are not main text: opening tags, phrases that such blocks often hold, form.
    OTHER = (
        (("<nav{}>", '<div class="menu"{}>', '<ul class="nav navbar"{}>', '<div class="breadcrumbs"{}>', '<div id="topnav" role="navigation"{}>'), "home about contact more", "links"),
        (("<header{}>", '<div class="header"{}>', '<div id="masthead" role="banner"{}>', '<div class="site-title logo"{}>'), "welcome search login", "short"),
        (("<footer{}>", '<div class="footer"{}>', '<div id="footer" role="contentinfo"{}>', '<div class="copyright"{}>'), "&copy; copyright rights reserved privacy terms", "short"),
        (("<aside{}>", '<div class="sidebar"{}>', '<div id="sidebar" role="complementary"{}>', '<div class="related"{}>', '<div class="widget recommended"{}>'), "related popular latest tags", "mixed"),
        (('<div class="notice"{}>', '<div class="cookie-banner"{}>', '<div id="consent"{}>', '<div class="alert message"{}>', '<div class="popup modal"{}>'), "cookies accept we use notice", "text"),
        (('<div class="ad"{}>', '<div class="advert"{}>', '<div class="ads sponsored"{}>', '<ins class="adsbygoogle"{}>', '<div class="promo banner"{}>', '<div id="advertisement"{}>'), "advertisement sponsored buy now", "text"),
        (("<form{}>", '<form class="search"{}>', '<div class="newsletter subscribe"{}>', '<form id="login"{}>', "<fieldset{}>"), "email subscribe sign up name password", "form"),
        (('<section class="comments"{}>', '<div id="comments"{}>', '<div class="comment-list"{}>', '<ol class="commentlist replies"{}>', '<div class="reader-comments discussion"{}>'), "reply comment says", "comments"),
        (('<div class="share social"{}>', '<ul class="share-buttons"{}>', '<div class="meta byline"{}>', '<div class="pagination pager"{}>'), "share tweet print next previous", "links"),
    )

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, of: tuple | str) -> object:
        return of[int(self.rng.integers(len(of)))]

    def word(self) -> str:
        return "".join(self.pick("bcdfghklmnprstvz") + self.pick("aeiouéüñ") for _ in range(int(self.rng.integers(1, 5))))

    def words(self, low: int, high: int, phrases: str = "") -> str:
        n = int(self.rng.integers(low, high + 1))
        return " ".join(self.pick(phrases.split()) if phrases and self.rng.random() < 0.3 else self.word() for _ in range(n))

    def prose(self, low: int = 3, high: int = 60, phrases: str = "") -> str:
        return " ".join(self.words(low, max(low, high // 3), phrases).capitalize() + self.pick(("." if self.rng.random() < 0.8 else ".###", "", "!", "?")) for _ in range(int(self.rng.integers(1, 4))))

    def other(self, k: int) -> str:
        tags, phrases, form = self.OTHER[k]
        opening = self.pick(tags)
        if form in ("comments", "links", "mixed") and self.rng.random() < 0.12:
            opening = self.unnamed()
        tag = re.match(r"<(\w+)", opening)[1]
        links = "".join(f'<li><a href="/{self.word()}">{self.words(1, 3, phrases)}</a></li>' for _ in range(int(self.rng.integers(2, 9))))
        links = links if tag in ("ul", "ol") else f"<ul>{links}</ul>"
        text = self.prose(2, 30, phrases)
        text = text if self.rng.random() < 0.5 else f"<p>{text}</p>"
        body = {
            "links": links,
            "short": text + (links if self.rng.random() < 0.3 else ""),
            "text": text,
            "mixed": f"<h3>{self.words(1, 4, phrases)}</h3>" + (links if self.rng.random() < 0.6 else text),
            "form": f"<label>{self.words(1, 4, phrases)}</label><input name=q><button>{self.words(1, 2, phrases)}</button>" + text * int(self.rng.integers(2)),
            "comments": f"<h3>{self.words(1, 3, phrases)}</h3>" + "".join(f'<div class="comment"><b>{self.word()}</b> {self.words(1, 2, phrases)}<p>{self.prose()}</p></div>' for _ in range(int(self.rng.integers(1, 5)))),
        }[form]
        return opening.format(' data-label="0"') + body + f"</{tag}>"

    def unnamed(self) -> str:
        """An opening tag that tells nothing of what is in it."""
        return self.pick(("<div{}>", '<div class="' + self.word() + '"{}>', '<section id="' + self.word() + str(self.rng.integers(10)) + '"{}>', '<div class="' + self.word() + " " + self.word() + '"{}>'))

    def main(self) -> str:
        opening = self.unnamed() if self.rng.random() < 0.2 else self.pick(self.MAIN)
        out = [f"<{h}>{self.words(2, 10)}</{h}>" if (h := self.pick(("h1", "h1", "h2"))) and self.rng.random() < 0.9 else ""]
        for _ in range(int(self.rng.integers(0, 12))):
            kind = self.rng.random()
            text = self.prose(1, int(self.pick((6, 30, 90, 200))))
            if kind < 0.6:
                out.append(f"<p>{text}</p>")
            elif kind < 0.72:
                out.append(f"<p><b>{text}<br>")
            elif kind < 0.78:
                out.append(f"<h2>{self.words(1, 6)}</h2>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.prose(2, 20)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}<td>{self.words(1, 3)}</tr>" for _ in range(3)) + "</table>")
            elif kind < 0.94:
                out.append(f'<p>{text} <a href="/x">{self.words(1, 3)}</a> {text}</p>')
            elif kind < 0.96:
                out.append(f"<pre>{text}</pre><div>{self.prose()}</div>")
            else:
                out.append(self.other(int(self.pick((5, 5, 8, 3, 6, 0, 4, 7)))))
        if self.rng.random() < 0.25:  # parts of the page's frame may stand inside the article, at its end as a rule
            out += [self.other(k) for k in (7, 8, 4, 2) if self.rng.random() < 0.5]
        if self.rng.random() < 0.1:
            out.insert(0, self.other(int(self.pick((1, 0, 8, 4)))))
        return opening.format(' data-label="1"') + "".join(out) + f"</{re.match(r'<(\w+)', opening)[1]}>"

    def page(self) -> str:
        before = [self.other(k) for k in (0, 1, 4, 5, 8, 6) if self.rng.random() < 0.45]
        after = [self.other(k) for k in (3, 7, 5, 8, 6, 2) if self.rng.random() < 0.45]
        self.rng.shuffle(before)
        body = "".join([*before, self.main(), *after])
        wrap = self.pick(("{}", "{}", '<div class="page">{}</div>', '<div id="wrapper"><div class="container">{}</div></div>'))
        return "<html><body>" + wrap.format(body) + "</body></html>"


@lru_cache(2)
def train(pages: int = 1800, hidden: int = 20, epochs: int = 6, batch: int = 24, rate: float = 0.012, seed: int = 3) -> Labeller:
    """Fit the network on made-up pages (`pages` of them: the bound of the sample), by Adam; the same in every run."""
    rng, layouts, vectors = np.random.default_rng(seed), Layouts(seed), Vectors()
    known = []
    for _ in range(pages):
        blocks = leaves(layouts.page())
        if blocks:
            y = np.array([e.label == "1" for e, *_ in blocks], np.float32)
            known.append((vectors.of(blocks), y))
    known.sort(key=lambda p: len(p[1]))
    batches = [known[i : i + batch] for i in range(0, len(known), batch)]
    net = Labeller.fresh(hidden, seed)
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    step = 0
    for epoch in range(epochs):
        for k in rng.permutation(len(batches)):
            x, mask = padded([p[0] for p in batches[k]])
            x *= rng.random((1, 1, WIDTH), np.float32) > 0.05  # no single feature may decide alone
            y = np.zeros(mask.shape, np.float32)
            for j, (_, labels) in enumerate(batches[k]):
                y[: len(labels), j] = labels
            step += 1
            pace = rate * (1 - step / (epochs * len(batches) + 1))
            for w, grad, m, v in zip(net.weights, net.gradients(x, mask, y), first, second):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """The main text of every page.

    pages: page_id, url, html and others, which are ignored. Returns page_id, url, text and n_chars (its code points),
    one row per input row, repeated rows included; a null or empty html, and a page without main text, has the empty
    text. page_id and url may be null. A page is cut into blocks of text at block-level tags (line breaks are white
    space of a block), character references are decoded, white space is made single, and the blocks that the labeller
    takes for main text are joined by \\n in page order. Scripts, styles, comments and other silent elements never are
    blocks. Pages are read whole in one pass without a shuffle; a page of more than LEAVES blocks goes through the
    network in parts of so many, with its state carried from part to part.

    The labeller is trained by train() on the driver, on made-up pages, where none is given.
    """
    sent = pages.sparkSession.sparkContext.broadcast(labeller or train())

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = Vectors()
        for frame in frames:
            for i in range(0, len(frame), 256):
                part = frame.iloc[i : i + 256]
                blocks = [leaves(page or "") for page in part["html"]]
                keep = sent.value.predict([vectors.of(b) for b in blocks])
                texts = ["\n".join(block[1] for block, k in zip(b, ks) if k) for b, ks in zip(blocks, keep)]
                yield pd.DataFrame({"page_id": part["page_id"].astype("Int64"), "url": part["url"], "text": texts, "n_chars": list(map(len, texts))})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(of, "page_id long, url string, text string, n_chars long")
