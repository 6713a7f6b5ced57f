"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks.  Each block becomes a vector: its tag path (tags and the words of
their classes and ids, hashed), its words (hashed), and a few measures.  A bidirectional LSTM in NumPy
reads the whole sequence, so that every block is labelled in the context of the entire page, and the
blocks labelled as content are the text.

The labeller is trained here, on pages made from a grammar of page layouts with known labels: element
names and class words of menus, headers, footers, sidebars, notices, adverts, forms, comments and
articles, in nested, flat and table layouts, sound and broken markup.  ``TRAIN_PAGES`` bounds them.

Defined results: null or empty html, and html without text: empty text.  Equal pages get equal text.
Pages are read whole, whatever their length; nothing within a content block is dropped.
"""

from __future__ import annotations

import functools
import itertools
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankweave.llm.html_blocks import Block, blocks
from rankweave.llm.textbatch import column, slices

PATH, WORDS, MEASURES = 64, 24, 12
WIDTH = PATH + WORDS + MEASURES
HIDDEN = 16
TRAIN_PAGES, EPOCHS, BATCH = 2000, 22, 50
STEP_CAP = 80  #: training pages are at most about so long; labelling has no such bound
BATCH_CHARS, BATCH_BLOCKS = 3_000_000, 60_000


@functools.lru_cache(maxsize=50_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Words of the path hashed, nearer tags weighing more, the block's own tag and the outer ones apart."""
    out = np.zeros(PATH, np.float32)
    for up, label in enumerate(reversed(path)):
        for k, word in enumerate(label.split(" ")):
            h = zlib.crc32(f"{word}:{k > 0}".encode())
            out[h % (PATH - 20)] += (1 if h >> 16 & 1 else -1) * max(0.5, 1.0 - 0.1 * up)
            if up == 0 and k == 0:
                out[PATH - 20 + h % 20] += 1
    return np.clip(out, -2, 2)


class _Slots(dict):
    """The slot of each word; the second half of the slots counts negatively."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        slot = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"), 77) % (2 * WORDS)
        return slot


_SLOTS = _Slots()


def features(page: list[Block]) -> np.ndarray:
    """A vector of each block of a page."""
    n = len(page)
    out = np.zeros((n, WIDTH), np.float32)
    if not n:
        return out
    split = [b.text.split(" ") for b in page]
    counts = np.array([len(w) for w in split])
    slots = np.fromiter(map(_SLOTS.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(counts.sum()))
    tally = np.bincount(np.repeat(np.arange(n) * 2 * WORDS, counts) + slots, minlength=n * 2 * WORDS).reshape(n, 2, WORDS)
    out[:, PATH : PATH + WORDS] = (tally[:, 0] - tally[:, 1]) / counts[:, None]
    for i, b in enumerate(page):
        row, text = out[i], b.text
        row[:PATH] = _path_vector(b.path)
        size, count = len(text), len(split[i])
        row[PATH + WORDS :] = (
            min(size, 2000) ** 0.5 / 20, min(count, 400) ** 0.5 / 10, b.linked / size, min(1.0, (text.count(".") + text.count("!") + text.count("?")) * 4 / (count + 4)), min(1.0, text.count(",") * 4 / (count + 4)),
            text[-1] in ".!?:;\"'", text[:1].isupper(), min(2.0, size / count / 10), i / n, (n - i) / n, len(b.path) / 10, 1.0 if "©" in text or "|" in text else 0.0,
        )
    return out


class Lstm:
    """Weights of one direction; gates in the order input, forget, output, candidate."""

    def __init__(self, rng: np.random.Generator, width: int, hidden: int) -> None:
        self.w = (rng.normal(size=(width, 4 * hidden)) / np.sqrt(width)).astype(np.float32)
        self.u = (rng.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden : 2 * hidden] = 1

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states by step (x: step, page, feature); where the mask is 0 a page's state stays."""
        steps, pages, _ = x.shape
        h = len(self.u)
        pre = x.reshape(-1, x.shape[2]) @ self.w + self.b
        pre = pre.reshape(steps, pages, 4 * h)
        state, cell = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
        out, trace = np.empty((steps, pages, h), np.float32), []
        for t in range(steps):
            z = pre[t] + state @ self.u
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            m = mask[t][:, None]
            new = f * cell + i * g
            squashed = np.tanh(new)
            if keep:
                trace.append((state, cell, i, f, o, g, squashed, m))
            cell = np.where(m > 0, new, cell)
            state = np.where(m > 0, o * squashed, state)
            out[t] = state
        return out, trace

    def backward(self, x: np.ndarray, grad: np.ndarray, trace: list) -> list[np.ndarray]:
        h = len(self.u)
        dz_all = np.zeros((*grad.shape[:2], 4 * h), np.float32)
        du = np.zeros_like(self.u)
        dstate, dcell = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        for t in range(len(grad) - 1, -1, -1):
            state, cell, i, f, o, g, squashed, m = trace[t]
            d = (dstate + grad[t]) * m
            dc = dcell * m + d * o * (1 - squashed * squashed)
            dz = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), d * squashed * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            du += state.T @ dz
            dstate = dz @ self.u.T + (dstate + grad[t]) * (1 - m)
            dcell = dc * f + dcell * (1 - m)
        flat = dz_all.reshape(-1, 4 * h)
        return [x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)]


class Labeller:
    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(rng, WIDTH, HIDDEN), Lstm(rng, WIDTH, HIDDEN)
        self.out = (rng.normal(size=2 * HIDDEN + WIDTH) * 0.1).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def _weights(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.ahead.b, self.back.w, self.back.u, self.back.b, self.out, self.bias]

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """The probability of content of each step and page."""
        a, ta = self.ahead.forward(x, mask, keep)
        b, tb = self.back.forward(x[::-1], mask[::-1], keep)
        seen = np.concatenate([a, b[::-1], x], axis=2)
        return 1 / (1 + np.exp(-np.clip(seen @ self.out + self.bias, -30, 30))), (seen, ta, tb)

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 5) -> float:
        """Adam on the mean cross entropy; gives the last epoch's loss."""
        rng = np.random.default_rng(seed)
        first = [np.zeros_like(w) for w in self._weights()]
        second = [np.zeros_like(w) for w in self._weights()]
        step, loss = 0, 0.0
        for epoch in range(epochs):
            loss, batches = 0.0, 0
            order = sorted(rng.permutation(len(pages)).tolist(), key=lambda i: len(pages[i][1]) // 8)
            groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
            for k in rng.permutation(len(groups)).tolist():
                x, mask = _stacked([pages[i][0] for i in groups[k]])
                y, _ = _stacked([pages[i][1][:, None] for i in groups[k]])
                p, (seen, ta, tb) = self.run(x, mask, keep=True)
                n = mask.sum()
                loss += float(-(mask * np.log(np.where(y[:, :, 0] > 0.5, p, 1 - p) + 1e-7)).sum() / n)
                batches += 1
                d = ((p - y[:, :, 0]) * mask / n).astype(np.float32)
                dseen = d[:, :, None] * self.out[: 2 * HIDDEN]
                ga = self.ahead.backward(x, dseen[:, :, :HIDDEN], ta)
                gb = self.back.backward(x[::-1], dseen[::-1, :, HIDDEN:], tb)
                grads = [*ga, *gb, np.einsum("tp,tpf->f", d, seen), np.array([d.sum()], np.float32)]
                step += 1
                rate = 0.02 * (1 - 0.8 * epoch / epochs)
                for w, g, m, v in zip(self._weights(), grads, first, second, strict=True):
                    g = np.clip(g, -1, 1) + 1e-5 * w
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            loss /= max(1, batches)
        return loss

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is content; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: (len(pages[i]), i))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < 256 and len(pages[order[hi]]) * (hi + 1 - lo) <= 4096:
                hi += 1
            x, mask = _stacked([pages[i] for i in order[lo:hi]])
            p, _ = self.run(x, mask)
            for k, i in enumerate(order[lo:hi]):
                out[i] = p[: len(pages[i]), k] > 0.5
            lo = hi
        return out


def _stacked(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = 1
    return x, mask


#: Words of class and id attributes by a region's kind.
REGIONS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topbar submenu tabs toc pagination pager",
    "header": "header masthead banner logo branding site-header top site-title tagline",
    "footer": "footer site-footer copyright bottom colophon foot legal credits",
    "sidebar": "sidebar aside widget related recommended secondary popular trending rail more-stories tags",
    "notice": "notice cookie consent alert gdpr popup modal message warning toast subscribe paywall",
    "advert": "ad ads advert advertisement sponsored promo sponsor adbox banner-ad dfp promoted",
    "form": "form search newsletter signup login contact-form subscribe-form searchbox comment-form",
    "comment": "comments comment reply respond discussion comment-list comment-body disqus replies thread",
    "share": "share social sharing follow buttons meta byline author-box tools",
}
CONTENT = "content article post entry story main article-body post-content entry-content text body maincontent page-content prose single"
SEMANTIC = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}
PHRASES = {
    "menu": "Home|About|Contact|News|Sport|Products|Services|Blog|Login|Help|Archive|Inicio|Accueil|Startseite|Kontakt",
    "header": "Daily News|Welcome|The Site|Search|Sign in|Subscribe now|Menu",
    "footer": "Copyright 2023 All rights reserved.|Privacy Policy|Terms of use|Impressum|© Example Inc.|Contact us|Mentions légales",
    "sidebar": "Related articles|Most read|Popular posts|Tags|Archives|Recent posts|You may also like",
    "notice": "We use cookies to improve your experience.|Accept all|This site uses cookies.|Please enable scripts.|Accept",
    "advert": "Advertisement|Buy now|Sponsored|Special offer! Click here|50% off today|Anzeige",
    "form": "Your email|Name|Send|Search|Subscribe|Password|Submit",
    "comment": "Great post, thanks!|I disagree.|Reply|Posted by|Leave a comment|3 comments|Nice article",
    "share": "Share on|Tweet|Print|Email this|Follow us|By",
}


def r_close(r: random.Random) -> str:
    return r.choice(("</b>", "", "<br>"))


class PageMaker:
    """Pages with known labels; a block's label is whether it belongs to the article."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        parts = ["".join(self.r.choice("bcdfghjklmnprstvwz") + self.r.choice("aeiouéöñ") for _ in range(self.r.randint(1, 3))) for _ in range(300)]
        self.words = parts + ["the", "of", "and", "a", "in", "la", "de", "der", "die", "que", "et", "un"] * 6

    def sentence(self, n: int) -> str:
        words = [self.r.choice(self.words) for _ in range(max(1, n))]
        if self.r.random() < 0.7:
            words[0] = words[0].capitalize()
        if n > 6 and self.r.random() < 0.6:
            words[n // 2] += ","
        style = self.r.random()
        text = " ".join(words)
        if style < 0.04:
            return text.upper()
        if style < 0.07:
            return " | ".join(words)
        return text + self.r.choice((".", ".", ".", "!", "?", ""))

    def prose(self) -> str:
        return " ".join(self.sentence(self.r.randint(1, 18)) for _ in range(self.r.choice((1, 1, 2, 3, 4, 6))))

    def inline(self, text: str) -> str:
        x = self.r.random()
        if x < 0.06:
            return f"<b>{text}" + r_close(self.r)
        if x < 0.15:
            return text.replace(" ", " <b>", 1) + ("</b>" if self.r.random() < 0.6 else "")
        if x < 0.3:
            words = text.split(" ")
            k = self.r.randrange(len(words))
            words[k] = f'<a href="/{k}">{words[k]}</a>'
            return " ".join(words)
        return text.replace(" ", "<br>", 1) if x < 0.36 else text

    def article(self) -> list[str]:
        r = self.r
        out = [f"<h{r.choice('112')}>{self.sentence(r.randint(1, 12))}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 2, 3, 4, 6, 8, 12, 20, 30))):
            x = r.random()
            if r.random() < 0.06:  # a streak of short paragraphs, perhaps all the same
                short = self.sentence(r.randint(1, 3))
                same = r.random() < 0.5
                out += [f"<p>{short if same else self.sentence(r.randint(1, 4))}</p>" for _ in range(r.randint(1, 12))]
                continue
            if x < 0.74:
                out.append(f"<p>{self.inline(self.prose())}" + ("</p>" if r.random() < 0.85 else ""))
            elif x < 0.8:
                out.append(f"<h{r.choice('2234')}>{self.sentence(r.randint(1, 7))}</h2>")
            elif x < 0.86:
                kind = r.choice(("ul", "ol"))
                out.append(f"<{kind}>" + "".join(f"<li>{self.sentence(r.randint(1, 14))}</li>" for _ in range(r.randint(2, 6))) + f"</{kind}>")
            elif x < 0.9:
                out.append(f"<blockquote><p>{self.prose()}</p></blockquote>")
            elif x < 0.93:
                out.append(f"<figure><img src=x><figcaption>{self.sentence(r.randint(2, 9))}</figcaption></figure>")
            elif x < 0.95:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.sentence(r.randint(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif x < 0.97:
                out.append(f"<pre>{self.sentence(9)}</pre>")
            else:
                out.append(f"<div>{self.inline(self.prose())}</div>")
        return out

    def filler(self, kind: str) -> str:
        r = self.r
        typical = PHRASES[kind].split("|") if r.random() < 0.5 else None
        long = 0.75 if kind == "comment" else 0.45 if kind in ("advert", "notice", "footer", "sidebar") else 0.1

        def text() -> str:
            if typical and r.random() < 0.7:
                return r.choice(typical)
            return self.prose() if r.random() < long else self.sentence(r.randint(1, 4))

        x = r.random()
        if kind in ("menu", "sidebar", "share") and x < 0.75:
            return "<ul>" + "".join(f'<li><a href="/{i}">{text()}</a></li>' for i in range(r.randint(2, 8))) + "</ul>"
        if kind == "form":
            return f'<label>{text()}</label><input name=q><button>{text()}</button><select><option>{text()}<option>{text()}</select>'
        if kind == "comment":
            tag = r.choice(("div", "li", "article", "p"))
            return f"<h3>{text()}</h3>" * (x < 0.5) + "".join(f"<{tag} class='comment'>{r.choice(('<b>%s</b>', '<h4>%s</h4>', '%s')) % self.sentence(2)}<p>{text()}</p></{tag}>" for _ in range(r.randint(1, 5)))
        if x < 0.35:
            return text()
        return "".join(f"<{t}>{text()}</{t}>" for t in (r.choice(("p", "p", "div", "h3", "a", "span")) for _ in range(r.randint(1, 3))))

    def region(self, kind: str, semantic: bool) -> str:
        r = self.r
        names = REGIONS[kind].split()
        name = r.choice(names)
        tag = SEMANTIC.get(kind, "div") if semantic and r.random() < 0.85 else r.choice(("div", "div", "section", "aside", "ul") if kind != "form" else ("form",))
        plain = tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6
        attribute = "" if plain else f' {r.choice(("class", "class", "id"))}="{name}{r.choice(("", "", " box", "-1", " clearfix", "-wrapper"))}"'
        return f"<{tag}{attribute}>{self.filler(kind)}</{tag}>"

    def page(self) -> str:
        """Html, with each content piece between two marks that ``labelled`` looks for."""
        r = self.r
        semantic = r.random() < 0.6
        pieces = [f"\x01{p}\x02" for p in self.article()]
        for kind, chance in (("advert", 0.3), ("share", 0.2), ("form", 0.1), ("sidebar", 0.1), ("notice", 0.06)):
            if r.random() < chance:
                pieces.insert(r.randint(0, len(pieces)), self.region(kind, semantic))
        if r.random() < 0.15:
            pieces.append(self.region("comment", semantic))
        body = "".join(pieces)
        if semantic and r.random() < 0.8:
            body = r.choice(("<article>%s</article>", "<main>%s</main>", "<main><article>%s</article></main>", "<article class='post'>%s</article>", "<div class='wrap'><article>%s</article></div>")) % body
        else:
            body = f'<{r.choice(("div", "div", "section", "td"))} {r.choice(("class", "id"))}="{r.choice(CONTENT.split())}{r.choice(("", " clearfix", "-1"))}">{body}' + r.choice(("</div>", "</section></div></td>"))
        before = [self.region(k, semantic) for k, c in (("notice", 0.3), ("header", 0.6), ("menu", 0.85), ("form", 0.2), ("advert", 0.5), ("sidebar", 0.15)) if r.random() < c]
        after = [self.region(k, semantic) for k, c in (("share", 0.2), ("comment", 0.35), ("sidebar", 0.4), ("advert", 0.3), ("form", 0.15), ("footer", 0.85), ("notice", 0.15)) if r.random() < c]
        if r.random() < 0.3:
            r.shuffle(before)
        outer = r.choice(("%s", "%s", "<div id=page>%s</div>", "<div class='container'><div class='row'>%s</div></div>", "<table><tr><td>%s</table>"))
        return "<html><head><title>x</title></head><body>" + outer % ("".join(before) + body + "".join(after)) + r.choice(("</body></html>", ""))


def labelled(html: str) -> tuple[list[Block], np.ndarray]:
    """Blocks of a made page and whether each is content.

    The tags of marked pieces get an id, which shows in their blocks' paths and then goes again.
    """
    marked = ""
    for k, piece in enumerate(re.split("[\x01\x02]", html)):
        marked += re.sub(r"<([a-z0-9]+)(?=[ >])", r'<\1 id="zzcontent"', piece) if k % 2 else piece
    found = blocks(marked)
    labels = np.array([any("zzcontent" in p for p in b.path) for b in found], np.float32)
    for b in found:
        b.path = tuple(p.replace(" zzcontent", "") for p in b.path)
    return found, labels


def made_pages(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    maker = PageMaker(seed)
    out: list[tuple[list[Block], np.ndarray]] = []
    while len(out) < n:
        found = labelled(maker.page())
        if 0 < len(found[0]) <= STEP_CAP:
            out.append(found)
    return out


@functools.lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS) -> Labeller:
    out = Labeller()
    out.train([(features(b), y) for b, y in made_pages(pages, 11)], epochs)
    return out


def extract_texts(htmls: list[str | None], labeller: Labeller) -> list[str]:
    pages = [blocks(h) if h else [] for h in htmls]
    content = labeller.label([features(p) for p in pages])
    return ["\n\n".join(b.text for b, c in zip(p, y, strict=True) if c) for p, y in zip(pages, content, strict=True)]


def extract(df: DataFrame, html: str = "html", text: str = "text", labeller: Labeller | None = None) -> DataFrame:
    """``df`` with the main text of its html; a column of that name is replaced."""
    model = labeller or trained()
    base = df.drop(text)
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            htmls = column(whole, html)
            for lo, hi in slices([len(h or "") for h in htmls], BATCH_CHARS):
                part = whole.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(extract_texts(htmls[lo:hi], model), pa.string())], names=[*names, text])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{fields}, `{text}` string")
