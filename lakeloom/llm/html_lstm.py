"""Main text of web pages (operator 7): a recurrent block labeller.

A page is cut into leaf blocks. Each block is a vector: hashed tag path, hashed words and a few
measures. A bidirectional LSTM in numpy reads all blocks of the page in order, both ways, so
that every block is labelled in the context of the whole page; blocks labelled as main text are joined.

The labeller is trained here, on pages that this module generates: articles among menus, headers,
footers, sidebars, notices, adverts, forms and comments, in many layouts and made-up words. The
number of pages is the documented bound ``PAGES``; the same seed gives the same weights.

Defined cases: null and empty html give the empty text, as does a page without main text. Broken
markup is read as far as it goes. Pages of any length are read whole, repeated rows get equal
rows, and extra columns are ignored.
"""

from __future__ import annotations

import functools
import html
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm.common import map_arrow, read
from lakeloom.llm.html_blocks import PATH_BINS, Block, blocks

WORD_BINS, MEASURES = 16, 6
HIDDEN = 16
#: Generated pages that the labeller is trained on, and rounds over them.
PAGES, ROUNDS = 1200, 8
#: Share of the training blocks whose text is hidden, so that odd texts don't outweigh their place.
BLIND = 0.4
#: Blocks that share a pass of the labeller, padding included; a longer page has a pass of its own.
PASS = 8192


def vector(block: Block) -> np.ndarray:
    v = np.zeros(PATH_BINS + WORD_BINS + MEASURES, np.float32)
    v[:PATH_BINS] = block.cells
    h = np.fromiter(map(zlib.crc32, block.text.lower().encode().split()), np.int64)
    hashed = np.bincount(h % WORD_BINS, 1.0 - (h >> 15 & 2), WORD_BINS)
    v[PATH_BINS : PATH_BINS + WORD_BINS] = hashed / max(1.0, np.linalg.norm(hashed))
    n = len(block.text)
    v[-6:] = np.log1p(n) / 4, np.log1p(n / max(1, len(h))) / 2, block.link_chars / max(1, n), block.text[-1] in ".!?:…\"»”", n > 120, 1
    return v


class Labeller:
    """Bidirectional LSTM and a logistic output over both states and the block's own vector."""

    def __init__(self, seed: int = 7, width: int = PATH_BINS + WORD_BINS + MEASURES, hidden: int = HIDDEN):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p = {f"{k}{d}": (r.standard_normal(s) * s[0] ** -0.5).astype(np.float32) for d in "fb" for k, s in (("w", (width, 4 * hidden)), ("u", (hidden, 4 * hidden)))}
        self.p |= {f"b{d}": np.zeros(4 * hidden, np.float32) for d in "fb"}
        for d in "fb":
            self.p[f"b{d}"][hidden : 2 * hidden] = 1  # remember at first
        self.p |= {"o": (r.standard_normal(2 * hidden + width) * 0.1).astype(np.float32), "c": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction; x is (time, page, width), mask (time, page, 1)."""
        n, h = x.shape[1], self.h
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        inner, out, kept = x @ self.p[f"w{d}"] + self.p[f"b{d}"], np.zeros((len(x), n, h), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = inner[t] + state @ self.p[f"u{d}"]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            new = f * cell + i * g
            squashed = np.tanh(new)
            if keep:
                kept.append((t, i, f, o, g, cell, squashed, state))
            m = mask[t]
            cell = np.where(m, new, cell)
            state = np.where(m, o * squashed, state)
            out[t] = state
        return out, kept

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probability of main text, (time, page). Both directions take their steps together."""
        time, n, h = len(x), x.shape[1], self.h
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        forth, back = (x @ self.p[f"w{d}"] + self.p[f"b{d}"] for d in "fb")
        u = np.stack([self.p["uf"], self.p["ub"]])
        logit = x @ self.p["o"][2 * h :] + self.p["c"]
        out = self.p["o"][: 2 * h].reshape(2, h, 1)
        z, m = np.empty((2, n, 4 * h), np.float32), np.empty((2, n, 1), bool)
        whole = bool(mask.all())
        for t in range(time):
            z[0], z[1] = forth[t], back[-1 - t]
            z += state @ u
            gates = 1 / (1 + np.exp(-np.clip(z[:, :, : 3 * h], -30, 30)))
            new = gates[:, :, h : 2 * h] * cell + gates[:, :, :h] * np.tanh(z[:, :, 3 * h :])
            now = gates[:, :, 2 * h :] * np.tanh(new)
            if whole:
                cell, state = new, now
            else:
                m[0], m[1] = mask[t], mask[-1 - t]
                cell, state = np.where(m, new, cell), np.where(m, now, state)
            said = (state @ out)[:, :, 0]
            logit[t] += said[0]
            logit[-1 - t] += said[1]
        return 1 / (1 + np.exp(-logit))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss over the blocks, and its gradient for every weight."""
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0], x], 2)
        p = 1 / (1 + np.exp(-(both @ self.p["o"] + self.p["c"])))
        m, h = mask[:, :, 0], self.h
        n = m.sum()
        loss = -(np.log(np.where(y > 0, p, 1 - p) + 1e-7) * m).sum() / n
        err = ((p - y) * m / n).astype(np.float32)
        g = {"o": np.einsum("tp,tpk->k", err, both), "c": err.sum(keepdims=True).reshape(1)}
        for j, d in enumerate("fb"):
            down = err[:, :, None] * self.p["o"][j * h : (j + 1) * h]
            dz_all, du = np.zeros((*x.shape[:2], 4 * h), np.float32), np.zeros_like(self.p[f"u{d}"])
            dstate, dcell = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
            for t, i, f, o, c, cell, squashed, state in reversed(runs[d][1]):
                dstate = dstate + down[t]
                on = mask[t]
                dnew = dcell + dstate * o * (1 - squashed**2)
                dz = np.concatenate([dnew * c * i * (1 - i), dnew * cell * f * (1 - f), dstate * squashed * o * (1 - o), dnew * i * (1 - c**2)], 1) * on
                dz_all[t] = dz
                du += state.T @ dz
                dstate = np.where(on, dz @ self.p[f"u{d}"].T, dstate)
                dcell = np.where(on, dnew * f, dcell)
            flat = dz_all.reshape(-1, 4 * h)
            g |= {f"w{d}": x.reshape(-1, x.shape[2]).T @ flat, f"u{d}": du, f"b{d}": flat.sum(0)}
        return float(loss), g


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((longest, len(pages), 1), bool)
    for k, v in enumerate(pages):
        x[: len(v), k], mask[: len(v), k] = v, True
    return x, mask


#: Scripts that made-up words take their letters from, and signs that noise is made of.
_LETTERS = ["abcdefghijklmnopqrstuvwxyz", "aeioubcdfglmnprstv", "abdeghiklmnorstuzäöüß", "abcdeilmnoprstuvàéèêç", "абвгдежзиклмнопрстуфхцчшыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "的一是不了人我在有他这为之大来以个中上们"]
_SIGNS = list("!?.,;:-_=+*/|~^°§@()[]{}'") + ["&amp;", "&lt;", "&gt;", "&quot;", "$", "%", "#"]
_NOTES = {
    "menu": ["Home", "About", "Contact", "News", "Login", "Search"],
    "footer": ["© {w}", "Copyright {w}", "All rights reserved.", "Privacy policy", "Terms of use"],
    "notice": ["We use cookies. {s}", "Accept all", "This site uses cookies.", "Subscribe to continue reading."],
    "form": ["Sign up for our newsletter", "Your email", "Send", "Log in", "Password"],
    "comment": ["{w} says:", "Reply", "Leave a comment", "{s}"],
    "aside": ["Related", "Most read", "Popular posts", "Share", "Tags: {w}"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "{s}"],
}


#: Layout families of training pages: what an article stands in.
FAMILIES = {
    "article": ["article"],
    "main": ["main"],
    "content": ['div class="content"', 'section id="content"', 'div class="entry-content"', 'div class="article-body"'],
    "post": ['div class="post"', 'div id="story"', 'section class="entry"'],
    "itemprop": ['div itemprop="articleBody"'],
    "plain": ["div", "section", 'div class="{w}"', 'div id="{w}"', 'section class="{w} {w}"', "{w}"],
}


def training_page(seed: int, families: tuple[str, ...] = tuple(FAMILIES)) -> tuple[str, set[str]]:
    """A made-up page, and the texts of its main blocks. Every block of it has a text of its own."""
    r = random.Random(seed)
    letters = r.choice(_LETTERS)
    main: set[str] = set()
    serial = 0
    noisy, gap = r.random() < 0.15, r.choice([" "] * 9 + [f" {r.choice(_SIGNS)} "])

    def word() -> str:
        return "".join(r.choices(letters, k=r.randint(1, 9)))

    def noise() -> str:
        return r.choice(_SIGNS) * r.randint(1, 4)

    def sentence(n: int) -> str:
        noised = noisy or r.random() < 0.05
        return gap.join(word() + (noise() if noised else "") for _ in range(n)).capitalize() + "."

    def text(low: int, high: int, keep: bool) -> str:
        nonlocal serial
        serial += 1
        if r.random() < 0.15:  # a few words, with or without an end
            t = " ".join(word() for _ in range(r.randint(1, 4))).capitalize() + r.choice(["", ".", noise()])
            t = f"{t} {serial}" if r.random() < 0.3 else f"{serial}{word()} {t}"
        elif r.random() < 0.06:  # one word again and again
            t = " ".join([word()] * r.randint(5, 300)) + f" {serial}"
        else:
            t = r.choice([" ", " ", " ", " ", gap]).join(sentence(r.randint(1, 18)) for _ in range(r.randint(low, high))) + (f" {word()}{serial}" if not keep or r.random() < 0.3 else f" {word()}{serial}.")
        if keep:
            main.add(" ".join(html.unescape(t).split()))
        return t

    def note(kind: str) -> str:
        nonlocal serial
        serial += 1
        t = r.choice(_NOTES[kind]).replace("{w}", word()).replace("{s}", sentence(r.randint(3, 25)))
        return f"{t} {serial}" if r.random() < 0.7 else f"{' '.join(word() for _ in range(r.randint(1, 3)))} {serial}"

    def wrap(options: list[str], inner: str) -> str:
        tag = r.choice(options)
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def items(kind: str, link: bool = True) -> str:
        rows = [f'<a href="/{word()}">{note(kind)}</a>' if link else note(kind) for _ in range(r.randint(2, 8))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in rows) + "</ul>" if r.random() < 0.7 else " ".join(f"<div>{x}</div>" for x in rows)

    def named(*names: str) -> list[str]:
        return [f'{r.choice(["div", "section", "div"])} {r.choice(["class", "id"])}="{x}"' for x in names]

    def junk(kind: str) -> str:
        if kind == "menu":
            return wrap(["nav", "nav", *named("nav", "menu", "navbar", "main-menu", "breadcrumb", "topbar")], items("menu"))
        if kind == "header":
            return wrap(["header", *named("header", "site-header", "masthead", "branding")], f"<h1>{note('menu')}</h1>" * r.randint(0, 1) + f"<p>{text(1, 1, False)}</p>" * r.randint(0, 1) + items("menu"))
        if kind == "footer":
            return wrap(["footer", "footer", *named("footer", "site-footer", "copyright", "bottom")], r.choice([items("footer"), note("footer") + " &middot; " + sentence(r.randint(3, 12)), f"<p>{note('footer')}</p><p>{text(1, 2, False)}</p>"]))
        if kind == "aside":
            return wrap(["aside", *named("sidebar", "widget", "related", "share", "social", "recommended", "side")], f"<h3>{note('aside')}</h3>" * r.randint(0, 1) + r.choice([items("aside"), f"<p>{text(1, 3, False)}</p>"]))
        if kind == "notice":
            return wrap(named("cookie", "cookie-banner", "notice", "consent", "gdpr", "alert", "popup", "modal", "newsletter"), r.choice([f"<p>{note('notice')}</p>", note("notice"), text(1, 2, False)]) + f"<button>{note('notice')}</button>" * r.randint(0, 1))
        if kind == "form":
            return wrap(['form action="/x"', "form", 'form class="search"'], f"<label>{note('form')}</label><input name=q><button>{note('form')}</button>" + f"<p>{text(1, 1, False)}</p>" * r.randint(0, 1))
        if kind == "comment":
            rows = "".join(wrap(["div class=comment", "li", "article class=comment", "p"], f"<b>{word()}</b> {text(1, 3, False)}") for _ in range(r.randint(1, 5)))
            return wrap(named("comments", "comment-list", "discussion", "respond", "disqus"), f"<h3>{note('comment')}</h3>" * r.randint(0, 1) + rows)
        return wrap([*named("ad", "ad", "ads", "advert", "sponsored", "promo", "banner", "ad-slot"), 'p class="ad"', 'aside class="ad"'], r.choice([note("ad"), text(1, 3, False), f"<p>{text(1, 2, False)}</p>"]))

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.7:
            t = text(1, 9, True)
            if r.random() < 0.2:
                return f"<p><b>{t}<br>"
            if r.random() < 0.15:
                return f"<p><em>{t}</em></p>"
            return f"<p>{t}</p>" if r.random() < 0.9 else f"<p>{t}"
        if kind < 0.78:
            return f"<h{r.randint(2, 4)}>{(t := text(1, 1, True))}</h2>" if r.random() < 0.3 else f"<h2>{text(1, 1, True)}</h2>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{text(1, 2, True)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote>{text(1, 3, True)}</blockquote>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{text(1, 1, True)}</td><td>{text(1, 1, True)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>"
        return f"<{(x := r.choice(['pre', 'figcaption', 'div']))}>{text(1, 2, True)}</{x}>"

    body = [f"<h1>{text(1, 1, True)}</h1>"] * (r.random() < 0.85)
    for _ in range(r.choice([1, 2, 4, 8, 16, 30])):
        body.append(paragraph())
        if r.random() < 0.06:
            body.append(junk(r.choice(["ad", "aside", "form", "notice"])))
    unknown = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9)))
    article = wrap([x.replace("{w}", unknown) for x in FAMILIES[r.choice(families)]], "".join(body))
    if r.random() < 0.15 and "main" in families:
        article = f"<main>{article}</main>"
    kinds = ["header", "menu", "notice", "ad", "aside", "form"]
    before = [junk(k) for k in r.sample(kinds, r.randint(0, 4))]
    after = [junk(k) for k in r.sample(["aside", "ad", "comment", "form", "notice", "menu"], r.randint(0, 4))] + [junk("footer")] * (r.random() < 0.85)
    if r.random() < 0.3:
        before, after = before[:1], after[-1:]
    head = f"<title>{' '.join(list(main)[:1]) if r.random() < 0.3 else note('menu')}</title>"
    page = f"<!DOCTYPE html><html><head>{head}<style>p{{}}</style></head><body>{''.join(before)}{article}{''.join(after)}"
    return page + "</body></html>" * (r.random() < 0.9), main


def training_rows(pages: int, first: int = 0, families: tuple[str, ...] = tuple(FAMILIES)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for seed in range(first, first + pages):
        page, main = training_page(seed, families)
        found = blocks(page)
        x = np.stack([vector(b) for b in found])
        x[np.random.default_rng(seed).random(len(x)) < BLIND, PATH_BINS:] = 0
        yield x, np.array([b.text in main and "head" not in b.path for b in found], np.float32)


@functools.lru_cache(2)
def trained(pages: int = PAGES, rounds: int = ROUNDS, seed: int = 7, families: tuple[str, ...] = tuple(FAMILIES)) -> Labeller:
    """Labeller fitted by Adam; once in a process."""
    rows = sorted(training_rows(pages, 0, families), key=lambda r: len(r[0]))
    groups = [rows[i : i + 30] for i in range(0, len(rows), 30)]
    data = []
    for g in groups:
        x, mask = padded([v for v, _ in g])
        y = np.zeros(mask.shape[:2], np.float32)
        for k, (_, own) in enumerate(g):
            y[: len(own), k] = own
        data.append((x, mask, y))
    model, order = Labeller(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    mean = {k: np.zeros_like(v) for k, v in model.p.items()}  # of the weights of the last rounds
    step = taken = 0
    for epoch in range(rounds):
        for at in order.permutation(len(data)):
            _, g = model.gradients(*data[at])
            step += 1
            rate = 0.02 * (1 - epoch / (rounds + 1))
            for k, v in model.p.items():
                d = np.clip(g[k], -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                v -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            if epoch >= rounds // 2:
                taken += 1
                for k, v in model.p.items():
                    mean[k] += (v - mean[k]) / taken
    model.p = mean
    return model


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    """Main text of each page; pages of like length share a pass of PASS blocks at most, unless one alone has more."""
    cut = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(cut) if b), key=lambda i: len(cut[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(cut[order[to]]) <= PASS:
            to += 1
        part, at = order[at:to], to
        x, mask = padded([np.stack([vector(b) for b in cut[i]]) for i in part])
        scores = model.scores(x, mask)
        for k, i in enumerate(part):
            out[i] = " ".join(b.text for b, s in zip(cut[i], scores[:, k], strict=False) if s > 0.5)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    model = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = main_texts(model.value, [x or "" for x in batch.column(2).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op7_recurrent_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
