"""Main text of web pages by a recurrent labeller of blocks.

Every block is a vector: hashed tags and names on its path, hashed words, a few
measures of its shape.  A bidirectional LSTM reads the blocks of the page in
order, so each is judged in the light of the whole page, and marks those of the
article.  The network is small and plain numpy; pages of like length are run
together.

It learns from pages put together here: layouts drawn at random (menus, notices,
adverts, sidebars, comments, forms around and inside an article) filled with
sentences of at most ``SAMPLE`` pages of the table, so their marks are known.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoband.llm.htmlblocks import Block, Open, blocks

SAMPLE = 200
SLOTS_PATH, SLOTS_WORDS, MEASURES, HIDDEN = 192, 48, 6, 24
INPUTS = SLOTS_PATH + SLOTS_WORDS + MEASURES
TRAINING_PAGES, EPOCHS, BATCH = 900, 12, 20
TOGETHER = 128
KNOWN = 200_000
MARK = "\ue000"  # stands in made pages before text that is not article


class _Hashes(dict):
    def __init__(self, slots: int):
        super().__init__()
        self.slots = slots

    def __missing__(self, name: str) -> int:
        if len(self) > KNOWN:
            self.clear()
        value = self[name] = zlib.crc32(name.encode("utf-8", "surrogatepass")) % self.slots
        return value


_WORDS = _Hashes(SLOTS_WORDS)
_PATHS: dict[int, np.ndarray] = {}


@lru_cache(maxsize=KNOWN)
def _slots(name: str) -> int:
    """The two slots of a name as bits of an integer."""
    raw = name.encode("utf-8", "surrogatepass")
    return 1 << zlib.crc32(raw) % SLOTS_PATH | 1 << zlib.crc32(b"again " + raw) % SLOTS_PATH


def _path_bits(node: Open | None) -> int:
    """Slots of all names above; an element adds its own to those of the element around it, so each is visited once."""
    todo = []
    while node is not None and node.bits is None:
        todo.append(node)
        node = node.around
    bits = node.bits if node is not None else 0
    for node in reversed(todo):
        for name in node.parts:
            bits |= _slots(name)
        node.bits = bits
    return bits


def _path_row(block: Block) -> np.ndarray:
    key = _path_bits(block.node) | _slots("leaf " + block.leaf)
    row = _PATHS.get(key)
    if row is None:
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        bits = np.frombuffer(key.to_bytes(-(-SLOTS_PATH // 8), "little"), np.uint8)
        row = _PATHS[key] = np.unpackbits(bits, bitorder="little")[:SLOTS_PATH].astype(np.float32)
    return row


def vectors(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), INPUTS), dtype=np.float32)
    for k, block in enumerate(page):
        out[k, :SLOTS_PATH] = _path_row(block)
        words = block.text.lower().split()
        counts = np.bincount(np.fromiter(map(_WORDS.__getitem__, words), dtype=np.int64, count=len(words)), minlength=SLOTS_WORDS)
        out[k, SLOTS_PATH:SLOTS_PATH + SLOTS_WORDS] = counts / np.sqrt(len(words) ** 2 / 16 + len(words) + 1)
        n = len(block.text)
        out[k, -MEASURES:] = (np.log1p(n) / 6, block.linked / n, np.log1p(len(words)) / 4, block.text[-1] in ".!?:;\"'",
                              k / len(page), np.log1p(len(page)) / 5)
    return out


class Network:
    """Two LSTMs and a logistic layer over both their states."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {}
        for side in "fb":
            self.p["x" + side] = rng.normal(0, 0.08, (INPUTS, 4 * HIDDEN)).astype(np.float32)
            self.p["h" + side] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, dtype=np.float32)
            bias[HIDDEN:2 * HIDDEN] = 1  # remember at first
            self.p["c" + side] = bias
        self.p["w"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        self.p["v"] = np.zeros(1, dtype=np.float32)

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States of one direction; x: (time, pages, inputs)."""
        steps, pages = x.shape[:2]
        inputs = (x.reshape(steps * pages, -1) @ self.p["x" + side] + self.p["c" + side]).reshape(steps, pages, -1)
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        states, tape = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + h @ self.p["h" + side]
            gates = 1 / (1 + np.exp(-z[:, :3 * HIDDEN]))
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:], np.tanh(z[:, 3 * HIDDEN:])
            on = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                tape.append((t, h, c, i, f, o, g, tanh, on))
            c = np.where(on, new, c)
            h = np.where(on, o * tanh, h)
            states[t] = h
        return states, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, tape_f = self._run("f", x, mask, keep)
        b, tape_b = self._run("b", x, mask, keep)
        both = np.concatenate((f, b), axis=2)
        logit = both @ self.p["w"] + self.p["v"][0]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), both, {"f": tape_f, "b": tape_b}

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, both, tapes = self.forward(x, mask, keep=True)
        error = ((p - y) * mask / max(1, mask.sum())).astype(np.float32)
        out = {"w": (both * error[:, :, None]).sum((0, 1)), "v": np.array([error.sum()], np.float32)}
        back = error[:, :, None] * self.p["w"]
        for side, part in (("f", back[:, :, :HIDDEN]), ("b", back[:, :, HIDDEN:])):
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            weights, dh, dc = self.p["h" + side], np.zeros(part.shape[1:], np.float32), np.zeros(part.shape[1:], np.float32)
            d_weights = np.zeros_like(weights)
            for t, h, c, i, f, o, g, tanh, on in reversed(tapes[side]):
                dh = dh + part[t]
                d_new = (dc + dh * o * (1 - tanh**2)) * on
                dz = np.concatenate((d_new * g * i * (1 - i), d_new * c * f * (1 - f), dh * on * tanh * o * (1 - o), d_new * i * (1 - g**2)), axis=1)
                dz_all[t] = dz
                d_weights += h.T @ dz
                dh = np.where(on, 0, dh) + dz @ weights.T
                dc = np.where(on, 0, dc) + d_new * f
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            out["x" + side], out["h" + side], out["c" + side] = x.reshape(-1, INPUTS).T @ flat, d_weights, flat.sum(0)
        return out


def _together(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), INPUTS), np.float32), np.zeros((steps, len(pages)), bool)
    for k, page in enumerate(pages):
        x[:len(page), k] = page
        mask[:len(page), k] = True
    return x, mask


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 3) -> Network:
    network, rng = Network(seed), np.random.default_rng(seed)
    pages = sorted(pages, key=lambda p: len(p[0]))
    starts = list(range(0, len(pages), BATCH))
    first, second, step = {k: np.zeros_like(v) for k, v in network.p.items()}, {k: np.zeros_like(v) for k, v in network.p.items()}, 0
    for epoch in range(epochs):
        for a in rng.permutation(starts):
            few = pages[a:a + BATCH]
            x, mask = _together([v for v, _ in few])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, labels) in enumerate(few):
                y[:len(labels), k] = labels
            step += 1
            for k, g in network.gradients(x, mask, y).items():  # Adam
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                now = rate * (1 - epoch / epochs)
                network.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return network


#: names layouts are drawn from: what a part of a page is called
PARTS = {
    "menu": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toolbar", "tabs", "links", "skip"],
    "header": ["header", "masthead", "topbar", "top", "site header", "branding", "logo", "banner", "page header", "search"],
    "notice": ["cookie", "notice", "consent", "gdpr", "alert", "popup", "modal", "cookie banner", "overlay", "message", "warning", "paywall"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "banner ad", "adsense", "ad slot"],
    "sidebar": ["sidebar", "aside", "related", "widget", "recommended", "popular", "trending", "more stories", "side", "tags", "archive"],
    "comments": ["comments", "comment list", "comment", "discussion", "replies", "responses", "disqus", "reader comments", "respond"],
    "form": ["form", "newsletter", "subscribe", "signup", "login", "search form", "contact", "register", "poll", "subscription"],
    "share": ["share", "social", "sharing", "follow", "share buttons", "author", "byline", "meta", "tools"],
    "footer": ["footer", "copyright", "legal", "bottom", "site footer", "colophon", "imprint", "disclaimer", "page footer"],
}
TAGS = {"menu": ["nav", "ul", "div", "nav", "menu"], "header": ["header", "div", "header"], "footer": ["footer", "div", "footer"],
        "sidebar": ["aside", "div", "aside", "section"], "form": ["form", "form", "div"], "comments": ["section", "div", "ol", "div"],
        "notice": ["div", "div", "dialog", "section"], "advert": ["div", "div", "aside", "section", "p"], "share": ["div", "ul", "div"]}
ARTICLE = ["article", "content", "post", "entry", "story", "body", "text", "main", "article body", "post content", "entry content", "page content"]
SAID = ["Menu", "Home", "About us", "Contact", "Share this", "Subscribe to our newsletter", "We use cookies to improve this site.",
        "Accept all", "All rights reserved.", "© 2024", "Privacy policy", "Terms of use", "Related articles", "Leave a reply", "Log in",
        "Your email", "Advertisement", "Sponsored", "Read more", "Reply", "Posted by", "Search", "Follow us", "Next", "Previous"]


class _Maker:
    """Pages with known marks, from random layouts and given sentences."""

    def __init__(self, sentences: list[str], seed: int = 11):
        self.rng, self.sentences = random.Random(seed), sentences or ["Some words stand here.", "And others."]

    def _name(self, choices: list[str]) -> str:
        rng = self.rng
        if rng.random() < 0.06:
            return rng.choice(["", f' class="x{rng.randrange(99)}"', ' class="row"'])
        name = rng.choice(choices).replace(" ", rng.choice(["-", "_", " "]))
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(["", "", "c-", "site-"])}{name}{rng.choice(["", "", "-1", " col"])}"'

    def _said(self) -> str:
        rng = self.rng
        if rng.random() < 0.6:
            text = rng.choice(self.sentences)
            return text if rng.random() < 0.8 else " ".join(text.split()[:3])
        return rng.choice(SAID)

    def _part(self, kind: str) -> str:
        rng, tag = self.rng, self.rng.choice(TAGS[kind])
        own = tag not in ("div", "section", "ul", "ol", "p")
        name = "" if own and rng.random() < 0.6 else self._name(PARTS[kind])
        said = lambda: MARK + self._said()
        many = rng.choice([1, 1, 2, 3, 6]) if kind != "comments" else rng.randrange(1, 9)
        if tag in ("ul", "menu") or kind == "menu":
            items = "".join(f'<li><a href="/x">{said()}</a></li>' for _ in range(rng.randrange(1, 9)))
            inner = items if tag in ("ul", "menu") else f"<ul>{items}</ul>" if rng.random() < 0.8 else items.replace("li>", "span>")
        elif tag == "p":
            inner = said()
        elif kind == "comments":
            item = "li" if tag == "ol" else "div"
            inner = (f"<h3>{said()}</h3>" if tag != "ol" and rng.random() < 0.6 else "") + "".join(
                f'<{item}{self._name(["comment", "reply", "comment body"])}><p>{said()} {rng.choice(self.sentences)}</p></{item}>' for _ in range(many))
        elif kind == "form":
            inner = f"<label>{said()}</label><input name=q><p>{said()}</p><button>Go</button>"
        else:
            shape = rng.choice(["{}", "<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<h4>{}</h4>", '<a href="/y">{}</a>', "<ul><li>{}</li></ul>"])
            inner = "".join(shape.format(said()) for _ in range(many if shape != "{}" else 1))
        return f"<{tag}{name}>{inner}</{tag}>"

    def _article(self) -> str:
        rng, out = self.rng, []
        text = lambda: " ".join(rng.choices(self.sentences, k=rng.choice([1, 1, 2, 4])))
        if rng.random() < 0.85:
            out.append(f"<h1>{' '.join(text().split()[:9])}</h1>")
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 20, 45])):
            roll = rng.random()
            if roll < 0.55:
                out.append(f"<p>{text()}</p>")
            elif roll < 0.7:
                out.append(f"<p>{' '.join(text().split()[:rng.choice([1, 1, 2, 3])])}</p>")
            elif roll < 0.78:
                out.append(f"<p><b>{text()}<br>")
            elif roll < 0.82:
                out.append(f'<p>{text()} <a href="/z">{" ".join(text().split()[:3])}</a></p>')
            elif roll < 0.86:
                out.append(f"<h2>{' '.join(text().split()[:5])}</h2>")
            elif roll < 0.9:
                out.append("<ul>" + "".join(f"<li>{text()}</li>" for _ in range(3)) + "</ul>")
            elif roll < 0.93:
                out.append(f"<blockquote><p>{text()}</p></blockquote>")
            elif roll < 0.95:
                out.append(f"<table><tr><td>{text()}</td><td>{text()}</td></tr></table>")
            else:
                out.append(self._part(rng.choice(["advert", "advert", "share", "form", "sidebar"])))
        if len(out) < 2:
            out.append(f"<p>{text()}</p>")
        return "".join(out)

    def page(self) -> str:
        rng = self.rng
        def parts(kinds, share):
            return "".join(self._part(k) for k in kinds if rng.random() < share)
        before = parts(rng.sample(["notice", "header", "menu", "advert", "menu"], 5), 0.5)
        after = parts(rng.sample(["sidebar", "comments", "form", "advert", "share"], 5), 0.45) + parts(["footer"], 0.85)
        tag = rng.choice(["article", "article", "main", "div", "section"])
        name = "" if tag in ("article", "main") and rng.random() < 0.6 else self._name(ARTICLE)
        article = self._article()
        body = f"<{tag}{name}>{article}</{tag}>" if rng.random() < 0.93 else article
        if rng.random() < 0.4:
            body = f'<div{self._name(["wrapper", "container", "page", "content", "main", "site"])}>{body if rng.random() < 0.6 else before + body}</div>'
        return f"<html><head><title>t</title></head><body>{before}{body}{after}</body></html>"


def made_pages(sentences: list[str], n: int = TRAINING_PAGES, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    maker, out = _Maker(sentences, seed), []
    while len(out) < n:
        page = blocks(maker.page())
        labels = np.array([MARK not in b.text for b in page], dtype=np.float32)
        for b in page:
            b.text = " ".join(b.text.replace(MARK, "").split()) or "-"
        out.append((vectors(page), labels))
    return out


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few beginnings of blocks of each page, for the made pages."""
    for batch in batches:
        found = [b.text[:300] for h in batch.column(1).to_pylist() for b in [b for b in blocks(h) if b.linked < len(b.text)][:12]]
        yield pa.RecordBatch.from_pydict({"text": pa.array(found, pa.string())})


def fit(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> Network:
    """Train on made pages with sentences of at most ``sample`` pages, those with the smallest hashes."""
    some = pages.where(F.col(html).isNotNull()).select(F.xxhash64(html).alias("rank"), F.col(html).cast("string").alias("html"))
    ranks = [r.rank for r in some.select("rank").orderBy("rank").limit(sample).collect()]
    found: list[str] = []
    if ranks:
        chosen = some.where(F.col("rank") <= ranks[-1]).limit(sample).mapInArrow(_sentences, "text string")
        found = [r.text for r in chosen.collect()]
    return train(made_pages(sorted(set(found))))


def _label(network: Network, pages: list[list[Block]]) -> list[np.ndarray]:
    """Marks of the blocks of many pages; pages of like length run together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    while order:
        longest = len(pages[order[-1]])
        few = order[-max(1, min(TOGETHER, 40_000 // longest)):]
        del order[-len(few):]
        x, mask = _together([vectors(pages[k]) for k in few])
        p = network.forward(x, mask)[0]
        for j, k in enumerate(few):
            out[k] = p[:len(pages[k]), j] >= 0.5
    return out


def _extract(network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = network.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                few = batch.slice(lo, 256)
                pages = [blocks(h) for h in few.column(2).to_pylist()]
                texts = ["\n".join(b.text for b, on in zip(page, marks, strict=True) if on)
                         for page, marks in zip(pages, _label(net, pages), strict=True)]
                yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()),
                                                  pa.array(list(map(len, pages)), pa.int64())], names=["id", "url", "text", "n_chars", "n_blocks"])
    return run


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", network: Network | None = None) -> DataFrame:
    """Per row: key, url, text (blocks of the article joined by line feeds), n_chars, n_blocks of the page.

    Null or empty html, and pages without any text, give an empty text.  Repeated
    rows are each returned; a null key or url is passed on.
    """
    network = network or fit(pages, html)
    kinds = dict(pages.dtypes)
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(network)
    found = rows.mapInArrow(_extract(shared), f"id {kinds[key]}, url {kinds[url]}, text string, n_chars bigint, n_blocks bigint")
    return found.withColumnRenamed("id", key).withColumnRenamed("url", url)
