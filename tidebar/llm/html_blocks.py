"""Main text of web pages by a recurrent block labeller.

A page is split into blocks, the texts between the tags of block elements. A bidirectional LSTM (numpy) reads the sequence of blocks,
each as the mean vector of its hashed tag path (elements with class, id and role), the mean vector of its hashed words and some
measures (length, share of links, punctuation, place, and of the containers around it their shares of the page's words and of links,
and how many were left and entered since the block before), and says of every block, knowing the whole page, whether it belongs to the
article. The labeller is trained here, on pages made by `training_page`: articles among menus, headers, footers, sidebars, notices,
adverts, forms and reader comments, with varied element names and mostly the same words as the articles, so that markup, place and
neighbours decide; training takes a quarter of a minute in a task and is the same each time.

Null, empty and tag-less html have no main text, or their one block if it reads as one. Broken markup never fails: unclosed elements
end with their parents, a `<` that begins no tag is text, an unfinished tag or comment at the end is dropped. Only the content of
scripts and styles is no text; one that never ends goes on to the page's end. Pages of any length and depth are read whole.
Repeated rows get equal results; ties do not arise. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import html
import io
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, rows_of, table

# fixed values: elements that begin and end a block of their own, elements without content, elements whose content is not text
BLOCKS = frozenset("address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style"
#: Elements that a new one of the same name ends.
ENDS_ITSELF = frozenset("p li dt dd option tr td th".split())
_TOKEN = re.compile(rf"<!--(?:.*?-->|.*\Z)|<({RAW})(?=[\s/>])(?>[^<>\"']|\"[^\"]*\"|'[^']*')*>(?:.*?</\1\s*>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S | re.I)
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

PATHS, WORDS, WIDTH, HIDDEN, MEASURES = 1 << 12, 1 << 13, 16, 24, 17
#: Blocks whose input is multiplied at once when labelling.
STEPS = 4096


@lru_cache(maxsize=50_000)
def _path_ids(name: str, attributes: str) -> tuple[int, ...]:
    marks = [name]
    for kind, *values in _MARKS.findall(attributes):
        for x in re.split(r"[\s_-]+|(?<=[a-z])(?=[A-Z])", "".join(values)):
            x = re.sub(r"\d+", "", x).lower()
            if x:
                marks.append(x)
    return tuple(zlib.crc32(m.encode("utf-8", "surrogatepass")) % PATHS for m in dict.fromkeys(marks))


class Block:
    __slots__ = ("text", "path", "links", "name", "node", "depth", "left", "place")

    def __init__(self, text: str, path: list[int], links: int, name: str, node: int, depth: int, left: int):
        self.text, self.path, self.links, self.name = text, path, links, name
        #: number of the element it is in, how many are open, how many were left since the block before, and its containers' measures
        self.node, self.depth, self.left, self.place = node, depth, left, (0.0,) * 9


def blocks(page: str | None) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    parts: list[str] = []
    links, anchor, at = 0, False, 0
    # how often each id and name is on the stack, so that deep pages take no longer
    held: Counter[int] = Counter()
    opened: Counter[str] = Counter()
    # the elements in the order they begin: the number of the one around each (0 is the page); how few were open since the last block
    around, inside, low, deep = [0], [0], 0, 0

    def pop() -> str:
        nonlocal low
        name, ids = stack.pop()
        inside.pop()
        low = min(low, len(stack))
        opened[name] -= 1
        for i in ids:
            held[i] -= 1
            if not held[i]:
                del held[i]
        return name

    def flush() -> None:
        nonlocal links, low, deep
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, sorted(held), min(links, len(text)), stack[-1][0] if stack else "", inside[-1], len(stack) - low, deep - low))
            low = deep = len(stack)
        parts.clear()
        links = 0

    def take(text: str) -> None:
        nonlocal links
        parts.append(text)
        if anchor:
            links += len(text.strip())

    page = page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        end, name, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
        elif name == "a":
            anchor = not end
        if name not in BLOCKS:
            continue
        flush()
        if end:
            if opened[name]:
                while pop() != name:
                    pass
        elif name not in VOID:
            if name in ENDS_ITSELF and stack and stack[-1][0] == name:
                pop()
            stack.append((name, _path_ids(name, attributes or "")))
            around.append(inside[-1])
            inside.append(len(around) - 1)
            opened[name] += 1
            held.update(stack[-1][1])
        anchor = False
    if at < len(page):
        take(page[at:])
    flush()
    _placed(out, around)
    return out


def _placed(found: list[Block], around: list[int]) -> None:
    """The measures of each block's containers: the share of the page's words in the one around it, in the next one, in the outermost
    below the body and in the one below that, the share of links in the first two, how deep it is, and how many containers were left and
    entered since the block before."""
    words, chars, links = np.zeros(len(around)), np.zeros(len(around)), np.zeros(len(around))
    for b in found:
        words[b.node] += len(b.text.split())
        chars[b.node] += len(b.text)
        links[b.node] += b.links
    level = [0] * len(around)
    for n in range(1, len(around)):
        level[n] = level[around[n]] + 1
    for n in range(len(around) - 1, 0, -1):
        for v in (words, chars, links):
            v[around[n]] += v[n]
    total = max(1.0, words[0])
    # containers that hold nearly all words, from the page inwards, are frames: what is below them counts as outermost
    frame = [True] * len(around)
    outer, second = [0] * len(around), [0] * len(around)
    for n in range(1, len(around)):
        up = around[n]
        frame[n] = frame[up] and words[n] >= 0.9 * total and level[n] < 12
        outer[n] = n if frame[up] else outer[up]
        second[n] = n if outer[up] == up and not frame[up] else second[up] if second[up] else outer[n]
    for b in found:
        a = around[b.node]
        near = [words[n] / total for n in (a, around[a], outer[b.node], second[b.node])]
        linked = [links[n] / max(1.0, chars[n]) for n in (a, around[a])]
        b.place = (*near, *linked, min(level[b.node], 20) / 20, min(b.left, 5) / 5, min(b.depth, 5) / 5)


def inputs(found: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    words, measures = [], np.zeros((len(found), MEASURES))
    for i, b in enumerate(found):
        w = b.text.lower().split()
        words.append(sorted({zlib.crc32(x.strip(".,:;!?()").encode("utf-8", "surrogatepass")) % WORDS for x in set(w)}))
        n = len(b.text)
        measures[i] = (min(np.log1p(len(w)) / 6, 2), b.links / n, min(sum(map(b.text.count, ".,;")) / len(w), 1), b.name == "p", b.name[:1] == "h" and len(b.name) == 2, b.name in ("li", "td", "dd"), i / max(1, len(found) - 1), 1.0, *b.place)
    return [b.path for b in found], words, measures


class Labeller:
    """A bidirectional LSTM over block vectors with a logistic output."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        d, h = 2 * WIDTH + MEASURES, HIDDEN
        self.p = {"path": r.normal(0, 0.3, (PATHS, WIDTH)), "word": r.normal(0, 0.05, (WORDS, WIDTH)), "out": r.normal(0, 0.2, 2 * h), "bias": np.zeros(1)}
        for way in "fb":
            self.p |= {f"x{way}": r.normal(0, d**-0.5, (d, 4 * h)), f"h{way}": r.normal(0, h**-0.5, (h, 4 * h)), f"c{way}": np.concatenate([np.ones(h), np.zeros(3 * h)])}

    def _vectors(self, pages) -> tuple[np.ndarray, np.ndarray]:
        t = max(len(m) for *_, m in pages)
        x, mask = np.zeros((len(pages), t, 2 * WIDTH + MEASURES)), np.zeros((len(pages), t))
        for k, (paths, words, measures) in enumerate(pages):
            n = len(measures)
            for at, ids, name in ((0, paths, "path"), (WIDTH, words, "word")):
                size = np.array([len(i) for i in ids])
                flat = self.p[name][np.concatenate([np.asarray(i, np.int64) for i in ids])] if size.sum() else np.zeros((0, WIDTH))
                sums = np.zeros((n, WIDTH))
                if size.all():
                    sums = np.add.reduceat(flat, np.cumsum(size) - size, axis=0)
                else:
                    np.add.at(sums, np.repeat(np.arange(n), size), flat)
                x[k, :n, at : at + WIDTH] = sums / np.maximum(size, 1)[:, None]
            x[k, :n, 2 * WIDTH :] = measures
            mask[k, :n] = 1
        return x, mask

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool = True):
        """Hidden states in the order of the page, and what the way back needs (only for training: it grows with the page)."""
        n, t, _ = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out, kept, begin = np.zeros((n, t, HIDDEN)), [], -1
        for i in range(t) if way == "f" else range(t - 1, -1, -1):
            if i // STEPS != begin:
                begin = i // STEPS
                pre = x[:, begin * STEPS : (begin + 1) * STEPS] @ self.p[f"x{way}"] + self.p[f"c{way}"]
            z = pre[:, i % STEPS] + h @ self.p[f"h{way}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            f, g, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            u = np.tanh(z[:, 3 * HIDDEN :])
            c_new = f * c + g * u
            s = np.tanh(c_new)
            m = mask[:, i, None]
            if keep:
                kept.append((i, h, c, f, g, o, u, s, m))
            h, c = m * (o * s) + (1 - m) * h, m * c_new + (1 - m) * c
            out[:, i] = h
        return out, kept

    def predict(self, pages) -> list[np.ndarray]:
        x, mask = self._vectors(pages)
        z = sum(self._run(x, mask, w, False)[0] @ self.p["out"][k * HIDDEN : (k + 1) * HIDDEN] for k, w in enumerate("fb")) + self.p["bias"]
        return [1 / (1 + np.exp(-z[k, : len(m)])) for k, (*_, m) in enumerate(pages)]

    def gradients(self, pages, labels) -> dict[str, np.ndarray]:
        x, mask = self._vectors(pages)
        runs = {w: self._run(x, mask, w) for w in "fb"}
        hidden = np.concatenate([runs[w][0] for w in "fb"], axis=2)
        y = np.zeros(mask.shape)
        for k, v in enumerate(labels):
            y[k, : len(v)] = v
        dz = mask * (1 / (1 + np.exp(-(hidden @ self.p["out"] + self.p["bias"]))) - y) / mask.sum()
        g = {"out": np.einsum("nt,nth->h", dz, hidden), "bias": np.array([dz.sum()])}
        dx = np.zeros_like(x)
        for k, w in enumerate("fb"):
            dout = dz[:, :, None] * self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
            wx, wh = self.p[f"x{w}"], self.p[f"h{w}"]
            gx, gh, gc = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * HIDDEN)
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            for i, h, c, f, gate, o, u, s, m in reversed(runs[w][1]):
                dh = dh + dout[:, i]
                dho = dh * m
                dcn = dc * m + dho * o * (1 - s * s)
                d = np.concatenate([dcn * c * f * (1 - f), dcn * u * gate * (1 - gate), dho * s * o * (1 - o), dcn * gate * (1 - u * u)], axis=1)
                gx += x[:, i].T @ d
                gh += h.T @ d
                gc += d.sum(axis=0)
                dx[:, i] += d @ wx.T
                dh, dc = (1 - m) * dh + d @ wh.T, (1 - m) * dc + dcn * f
            g |= {f"x{w}": gx, f"h{w}": gh, f"c{w}": gc}
        for name, at in (("path", 0), ("word", WIDTH)):
            g[name] = np.zeros_like(self.p[name])
            for k, page in enumerate(pages):
                for i, ids in enumerate(page[0] if name == "path" else page[1]):
                    if len(ids):
                        g[name][ids] += dx[k, i, at : at + WIDTH] / len(ids)
        return g

    def fit(self, pages, labels, rounds: int = 8, size: int = 24, rate: float = 0.02, seed: int = 1) -> Labeller:
        r = random.Random(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for n in range(rounds):
            order = sorted(range(len(pages)), key=lambda i: (len(labels[i]) // 8, r.random()))
            batches = [order[i : i + size] for i in range(0, len(order), size)]
            r.shuffle(batches)
            for batch in batches:
                step += 1
                for k, g in self.gradients([pages[i] for i in batch], [labels[i] for i in batch]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (1 - n / rounds) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


# fixed values: words that training pages use in their side matter
_SIDE = {
    "menu": "home about contact news sports login search archive topics start help shop",
    "header": "welcome site logo tagline menu skip to content today edition",
    "footer": "copyright all rights reserved imprint privacy terms contact sitemap newsletter",
    "notice": "we use cookies accept decline settings notice privacy policy consent subscribe now",
    "advert": "advertisement sponsored buy now offer discount sale click here free shipping",
    "side": "related popular most read trending tags archive follow us share latest posts",
    "form": "name email password submit send search sign up subscribe your message",
    "comment": "reply posted by reader comment says ago like report great thanks agree wrong",
}
_HOLDERS = {
    "menu": ["<nav>", '<nav class="menu">', '<div class="navbar">', '<ul class="nav-menu">', '<div id="menu">', '<div class="breadcrumb">', '<div role="navigation">'],
    "header": ["<header>", '<div class="header">', '<div id="site-header">', '<header class="masthead">', '<div class="topbar">', '<div role="banner">'],
    "footer": ["<footer>", '<div class="footer">', '<div id="footer">', '<footer class="site-footer">', '<div role="contentinfo">'],
    "notice": ['<div class="cookie-banner">', '<div class="notice">', '<div id="consent">', '<div class="newsletter">', '<div role="alert">', '<div class="popup">', '<section class="notice">'],
    "advert": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<aside class="ad">', '<div class="sponsored">', '<div class="promo">', '<div id="ad-top">', '<section class="advertisement">'],
    "side": ["<aside>", '<div class="sidebar">', '<aside class="sidebar">', '<div class="related">', '<section class="related">', '<div class="share">', '<div class="widget">', '<div role="complementary">'],
    "form": ["<form>", '<form class="search">', '<div class="login"><form>', '<form id="subscribe">'],
    "comment": ['<div class="comments">', '<section id="comments">', '<div class="comment">', '<section class="comments">', '<ol class="commentlist">', '<div id="disqus">', '<div class="replies">'],
}
_MAIN = ["<article>", "<main>", '<div class="article">', '<div class="content">', '<div id="content">', '<article class="post">', '<main role="main">', '<div class="post-body">', '<div class="entry-content">', '<section class="article-body">', "<main><article>"]


def training_page(r: random.Random) -> tuple[str, list[int]]:
    """A page and the label of each of its blocks."""
    out: list[str] = ["<!DOCTYPE html><html><head>"]
    labels: list[int] = []
    letters = "abcdefghijklmnopqrstuvwxyzéüñ"
    # on most pages side matter uses any words: its markup and place tell, and one list has as many forms as the article's
    telling = r.choice([0.0, 0.0, 0.0, 0.1, 0.5])
    common = ["".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(60)]
    word = lambda: r.choice(common) if r.random() < 0.5 else "".join(r.choice(letters) for _ in range(r.randint(1, 12)))

    def sentence(n: int, own: str = "") -> str:
        w = [r.choice(own.split()) if own and r.random() < telling else word() for _ in range(n)]
        noise = r.choice(["", "", "", "!!", "&amp;", "%%%", "***"])
        text = " ".join(x + ("," if r.random() < 0.1 else "") + noise for x in w) + r.choice(["", ".", "."])
        return text.upper() if r.random() < 0.1 else text.capitalize()

    def put(markup: str, label: int) -> None:
        out.append(markup)
        labels.append(label)

    def close(markup: str) -> str:
        return "".join(f"</{n}>" for n in reversed(re.findall(r"<(\w+)", markup)))

    def side(kind: str) -> None:
        # a container may have any name
        holder = r.choice(_HOLDERS[kind]) if r.random() < 0.85 else f'<div class="{word()} {word()}">'
        out.append(holder)
        form = r.random()
        if kind == "menu" or form < 0.3 and kind != "comment":
            out.append("<ul>" if "<ul" not in holder else "")
            linked = r.random() < 0.8
            for _ in range(r.randint(1, 9)):
                text = sentence(r.choice([1, 1, 1, 2, 3]), _SIDE[kind])
                put((f'<li><a href="/x">{text}</a>' if linked else f"<li>{text}") + r.choice(["</li>", "</li>", ""]), 0)
            out.append("</ul>" if "<ul" not in holder else "")
        elif form < 0.6:
            put(sentence(r.randint(1, 20), _SIDE[kind]) + (r.choice(["", "\n"]) + sentence(r.randint(1, 15), _SIDE[kind]) if r.random() < 0.4 else ""), 0)
        else:
            for _ in range(r.randint(1, 4)):
                put(f"<{(t := r.choice(['p', 'div', 'h3', 'p']))}>{sentence(r.randint(1, 25), _SIDE[kind])}</{t}>", 0)
        out.append(close(holder))

    put(f"<title>{sentence(r.randint(1, 9))}</title>", 0)
    out.append("<style>p{margin:0}</style><script>var a='</p>';</script></head><body>")
    for kind in r.sample(["header", "menu", "notice", "advert", "menu", "form", "side"], r.randint(0, 5)):
        side(kind)
    main = r.choice(_MAIN) if r.random() < 0.8 else f'<div class="{word()}-{word()}">'
    out.append(main)
    if r.random() < 0.85:
        put(f"<{(t := r.choice(['h1', 'h1', 'h2']))}>{sentence(r.randint(1, 12))}</{t}>", 1)
    if r.random() < 0.12:  # one short line over and over
        text = sentence(r.choice([1, 2, 3, 6]))
        for _ in range(r.randint(3, 25)):
            put(f"<p>{text}</p>", 1)
    for _ in range(r.choice([r.randint(1, 14), r.randint(1, 14), r.randint(10, 30)])):
        if r.random() < 0.06:
            side(r.choice(["advert", "side", "notice", "form"]))
        kind = r.random()
        text = sentence(r.choice([1, 1, 2, r.randint(3, 90), r.randint(10, 60), r.randint(10, 60)]))
        if kind < 0.55:
            if r.random() < 0.35:  # links within the text
                text += f' <a href="/w">{sentence(r.randint(1, 4))}</a> {sentence(r.randint(1, 30))}'
            put(f"<p>{text}" + r.choice(["</p>", "</p>", ""]), 1)
        elif kind < 0.7:
            put(f"<p><b>{text}<br>", 1)
        elif kind < 0.8:
            out.append("<ul>")
            for _ in range(r.randint(1, 6)):
                text = sentence(r.choice([1, 2, r.randint(1, 20)]))
                put(f"<li><a href='/z'>{text}</a></li>" if r.random() < 0.2 else f"<li>{text}</li>", 1)
            out.append("</ul>")
        elif kind < 0.88:
            put(f"<{(t := r.choice(['h2', 'h3', 'blockquote', 'pre', 'figcaption', 'td']))}>{text}</{t}>", 1)
        else:
            put(f"<div>{text}</div>" if r.random() < 0.5 else f"<p>{word()} <a href='/y'>{text}</a> {word()}</p>", 1)
    out.append(close(main))
    for kind in r.sample(["comment", "side", "advert", "form", "footer", "footer", "menu", "notice"], r.randint(0, 5)):
        side(kind)
    out.append(r.choice(["</body></html>", ""]))
    return "".join(out), labels


@lru_cache(maxsize=1)
def trained(pages: int = 1600, seed: int = 12, rounds: int = 5) -> Labeller:
    r = random.Random(seed)
    made = [training_page(r) for _ in range(pages)]
    return Labeller().fit([inputs(blocks(p)) for p, _ in made], [y for _, y in made], rounds=rounds)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _ in range(batch.num_rows):
            held = io.BytesIO()
            np.savez(held, **trained().p)
            yield pa.RecordBatch.from_pydict({"weights": pa.array([held.getvalue()], pa.binary())})


_models: dict[str, Labeller] = {}


def trained_by_task(spark) -> Labeller:
    """The labeller, fitted in a task and written to the shared folder; its weights, under two megabytes, come to the driver. Once an
    application."""
    app = spark.sparkContext.applicationId
    if app not in _models:
        row = cut(spark.range(1).mapInArrow(_train, "weights binary")).first()
        _models[app] = Labeller()
        _models[app].p = dict(np.load(io.BytesIO(bytes(row["weights"]))))
    return _models[app]


def main_texts(model: Labeller, pages: list[str | None]) -> list[str]:
    """Pages of like length are labelled together, in slices of bounded size."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
    while order:
        part, size = [], 0
        while order and (not part or (len(part) + 1) * len(found[order[0]]) <= 4096):
            part.append(order.pop(0))
        for i, p in zip(part, model.predict([inputs(found[i]) for i in part])):
            out[i] = "\n".join(b.text for b, x in zip(found[i], p) if x >= 0.5)
    return out


def _extract(model):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            texts = main_texts(model.value, batch.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained_by_task(pages.sparkSession))  # a few hundred thousand weights
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract(shared), "page_id long, url string, text string, n_chars long").withColumnsRenamed({"page_id": id_col, "url": url_col})


def op7_block_labeller(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
