"""HTML extraction with a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between block-level tags, each with its
tag path (names, class and id words) and its words. A bidirectional LSTM in numpy reads hashed
tag-path and word vectors of the whole sequence and marks each block as main text or not, so a
block is judged by what stands around it too. Training pages come from a generator of labelled
layouts (seeded, of fixed size); nothing is learned from the pages that are extracted.

Defined cases: null or empty html, and pages without main blocks, give an empty text; unclosed,
stray and nested tags are taken as browsers do in outline (a block tag ends an open p; an end
tag closes what is open inside); a quote opens an attribute's value only after an equals sign and
if it is closed somewhere; a tag that never ends is text; scripts, styles, text areas, comments
and titles are never blocks, and formulas, graphics and what stands in for media are read as text; very long pages are read whole, in time that grows in proportion, and
labelled in parts that hand their state on; a block whose score is exactly one half is main text;
repeated rows are extracted each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import map_rows, table

PATH_DIM, WORD_DIM, SCALARS, HIDDEN = 96, 256, 6, 16
DIM = PATH_DIM + WORD_DIM + SCALARS
TRAIN_PAGES, EPOCHS, BATCH, RATE = 1500, 14, 32, 0.01
#: Pages that are labelled together, and blocks that one such batch holds at most.
TOGETHER, TOGETHER_BLOCKS = 64, 50_000
#: Blocks of a longer page that are labelled at a time.
PART = 4096

_OPEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?]")
_BODY = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')?|["'])*+""")
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
#: Elements whose content is no text, elements that run on inside a block, and void elements.
_RAW = {"script", "style", "textarea", "title"}
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr object canvas iframe picture audio video map".split())
_INLINE |= set("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover semantics annotation".split())
_INLINE |= set("svg g path circle ellipse line polyline polygon rect text tspan use defs symbol desc lineargradient radialgradient stop clippath mask".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_END_RAW = {t: re.compile(rf"</{t}\s*>|</{t}\b|\Z", re.I) for t in _RAW}


#: Hashed names of all open elements, as bits, and the innermost names.
Path = tuple[int, tuple[str, ...]]


class _Open:
    """The open elements; a path costs the same at any depth."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.names: dict[str, int] = {}
        self.buckets = [0] * PATH_DIM
        self.bits = 0

    def push(self, name: str, words: tuple[str, ...]) -> None:
        self.stack.append((name, words))
        self.names[name] = self.names.get(name, 0) + 1
        for w in words:
            k = _bucket(w, PATH_DIM)
            self.buckets[k] += 1
            self.bits |= 1 << k

    def pop(self) -> str:
        name, words = self.stack.pop()
        self.names[name] -= 1
        for w in words:
            k = _bucket(w, PATH_DIM)
            self.buckets[k] -= 1
            if not self.buckets[k]:
                self.bits &= ~(1 << k)
        return name

    def close(self, name: str) -> None:
        """Closes the innermost element of a name and what is open inside; a stray end closes nothing."""
        if self.names.get(name):
            while self.pop() != name:
                pass

    def path(self) -> Path:
        return self.bits, tuple(w for _, words in self.stack[-3:] for w in words)[-3:]


def tags(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, name, whether it ends an element, attributes) of each tag; no name for comments and the like.

    After a tag the caller may send the place to go on from. The scan never goes back, and
    a tag that does not end by the last > is none.
    """
    at, n, last, quotes = 0, len(page), page.rfind(">"), True
    while (m := _OPEN.search(page, at)) is not None:
        start, name, attrs = m.start(), None, ""
        if m[0] == "<!--":
            end = page.find("-->", start + 2) + 3
            end = n if end < 3 else end
        elif start > last:
            at = page.find("<!--", start)
            if at < 0:
                return
            continue
        else:
            end = page.find(">", m.end())
            if m[2] is not None:
                if quotes and (page.find('"', m.end(), end) >= 0 or page.find("'", m.end(), end) >= 0):
                    whole = _BODY.match(page, m.end()).end()
                    quotes = whole < n  # else no tag from here on ends outside quotes, and quotes mean nothing
                    end = whole if quotes else end
                name, attrs = m[2].lower(), page[m.end() : end]
            end += 1
        at = (yield start, end, name, bool(m[1]), attrs) or end


def blocks(page: str | None) -> list[tuple[str, Path, float]]:
    """(text, tag path, share of the text inside links) of each leaf block, in page order."""
    out: list[tuple[str, Path, float]] = []
    page = page or ""
    elements = _Open()
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((text, elements.path(), min(1.0, linked / max(1, len(text)))))
            parts.clear()
        linked = 0

    def add(end: int) -> None:
        nonlocal linked
        if end > at:
            parts.append(page[at:end])
            if in_link:
                linked += len(parts[-1].strip())

    found = tags(page)
    tag = next(found, None)
    while tag is not None:
        start, end, name, ends, attrs = tag
        add(start)
        at, skip = end, None
        if name == "br":
            parts.append(" ")
        elif name == "a":
            in_link = not ends
        elif name in _RAW and not ends:
            if name != "title":
                flush()
            if not attrs.endswith("/"):
                at = _END_RAW[name].search(page, at).end()
                if page[at - 1 : at] != ">" and at < len(page):
                    at = (page.find(">", at) + 1) or len(page)
                skip = at
        elif name is not None and name not in _INLINE:
            flush()
            in_link = False
            if ends:
                elements.close(name)
            else:
                if elements.stack and (elements.stack[-1][0] == "p" or elements.stack[-1][0] == name == "li"):
                    elements.pop()
                if name not in _VOID and not attrs.endswith("/"):
                    words = [name]
                    for a in _ATTR.finditer(attrs):
                        words += [f".{w}" for w in _SPLIT.split((a[2] or a[3] or a[4] or "").lower()) if w]
                    elements.push(name, tuple(words))
        try:
            tag = found.send(skip)
        except StopIteration:
            tag = None
    add(len(page))
    flush()
    return out


@lru_cache(1 << 16)
def _bucket(word: str, size: int) -> int:
    return xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"), size) % size


@lru_cache(1 << 14)
def _path_vector(path: Path) -> np.ndarray:
    """Hashed tag-path vector: every name counts, the innermost ones again."""
    bits, inner = path
    v = np.array([bits >> k & 1 for k in range(PATH_DIM)], np.float32)
    for w in inner:
        v[_bucket(w + "<", PATH_DIM)] = 1
    return v


_MARKS = ".,;:!?…\"“”'()|"


@lru_cache(1 << 17)
def _word(token: str) -> int:
    return _bucket(token.strip(_MARKS), WORD_DIM)


_SENTENCE_END = tuple(".!?…。\"”»")


def features(found: list[tuple[str, Path, float]], start: int = 0, stop: int | None = None) -> np.ndarray:
    """Vectors of a page's blocks from start to stop; words count by the log of their number, as a unit vector."""
    total, some = len(found), found[start:stop]
    x = np.zeros((len(some), DIM), np.float32)
    x[:, :PATH_DIM] = [_path_vector(path) for _, path, _ in some]
    tail, at = [], []
    for i, (text, _, linked) in enumerate(some):
        own = list(map(_word, text.lower().split(" ")))
        words = len(own)
        at.append(np.array(own) + i * WORD_DIM)
        tail.append((math.log1p(words) / 4, linked, (start + i) / total, text.endswith(_SENTENCE_END), words > 8, math.log1p(total) / 5))
    said = np.log1p(np.bincount(np.concatenate(at), minlength=len(some) * WORD_DIM).reshape(-1, WORD_DIM))
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] = said / np.maximum(np.linalg.norm(said, axis=1, keepdims=True), 1e-9)
    x[:, PATH_DIM + WORD_DIM :] = tail
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = r.normal(0, 0.1, (DIM, 4 * h))
            self.p[f"u{d}"] = r.normal(0, 0.1, (h, 4 * h))
            bias = np.zeros(4 * h)
            bias[h : 2 * h] = 1
            self.p[f"b{d}"] = bias
        self.p["v"], self.p["c"] = r.normal(0, 0.1, 2 * h), np.zeros(())

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, state: list[np.ndarray] | None = None) -> tuple[np.ndarray, list]:
        """Hidden states (time, batch, h); x is (time, batch, dim), mask (time, batch).

        With a state the run starts there, leaves the state it ends in, and records no steps.
        """
        p, hid = self.p, HIDDEN
        t, n, _ = x.shape
        pre = x @ p[f"w{d}"] + p[f"b{d}"]
        h, c = state or [np.zeros((n, hid), pre.dtype)] * 2
        out, steps = np.zeros((t, n, hid), pre.dtype), [None] * t
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[k] + h @ p[f"u{d}"]
            g = _sigmoid(z[:, : 3 * hid])
            i, f, o, a = g[:, :hid], g[:, hid : 2 * hid], g[:, 2 * hid :], np.tanh(z[:, 3 * hid :])
            m = mask[k][:, None]
            new = f * c + i * a
            th = np.tanh(new)
            if state is None:
                steps[k] = (h, c, i, f, o, a, th, m)
            c = np.where(m, new, c)
            h = np.where(m, o * th, h)
            out[k] = h
        if state is not None:
            state[:] = h, c
        return out, steps

    def _back(self, x: np.ndarray, steps: list, grad: np.ndarray, d: str, grads: dict) -> None:
        p, hid = self.p, HIDDEN
        t, n, _ = x.shape
        dz = np.zeros((t, n, 4 * hid))
        dh = dc = np.zeros((n, hid))
        du = np.zeros_like(p[f"u{d}"])
        for k in range(t - 1, -1, -1) if d == "f" else range(t):
            h, c, i, f, o, a, th, m = steps[k]
            dh = dh + grad[k]
            own, keep = np.where(m, dh, 0), np.where(m, 0, dh)
            dn = np.where(m, dc, 0) + own * o * (1 - th**2)
            dz[k] = np.concatenate([dn * a * i * (1 - i), dn * c * f * (1 - f), own * th * o * (1 - o), dn * i * (1 - a**2)], axis=1)
            dc = dn * f + np.where(m, 0, dc)
            du += h.T @ dz[k]
            dh = dz[k] @ p[f"u{d}"].T + keep
        grads[f"w{d}"] = np.einsum("tnd,tng->dg", x, dz, optimize=True)
        grads[f"u{d}"], grads[f"b{d}"] = du, dz.sum((0, 1))

    def _start(self, n: int) -> list[np.ndarray]:
        return [np.zeros((n, HIDDEN), self.p["v"].dtype)] * 2

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, _ = self._run(x, mask, "f", self._start(x.shape[1]))
        b, _ = self._run(x, mask, "b", self._start(x.shape[1]))
        return _sigmoid(np.concatenate([f, b], 2) @ self.p["v"] + self.p["c"])

    def long_scores(self, found: list[tuple[str, Path, float]], part: int = PART) -> np.ndarray:
        """Scores of one page of any length, read in parts from both ends."""
        n = len(found)
        z, starts = np.full(n, float(self.p["c"])), list(range(0, n, part))
        for d, order, own in (("f", starts, self.p["v"][:HIDDEN]), ("b", starts[::-1], self.p["v"][HIDDEN:])):
            state = self._start(1)
            for s in order:
                x = features(found, s, s + part)[:, None]
                z[s : s + part] += self._run(x, np.ones(x.shape[:2], bool), d, state)[0][:, 0] @ own
        return _sigmoid(z)

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 4) -> None:
        r = np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        pages = sorted(pages, key=lambda q: len(q[1]))  # pages of like length share a batch
        starts = list(range(0, len(pages), BATCH))
        for _ in range(epochs):
            for s in r.permutation(starts):
                x, mask, y = _padded(pages[s : s + BATCH])
                f, fs = self._run(x, mask, "f")
                b, bs = self._run(x, mask, "b")
                both = np.concatenate([f, b], 2)
                d = np.where(mask, _sigmoid(both @ self.p["v"] + self.p["c"]) - y, 0) / mask.sum()
                grads = {"v": np.einsum("tn,tnh->h", d, both), "c": d.sum()}
                up = d[..., None] * self.p["v"]
                self._back(x, fs, up[..., :HIDDEN], "f", grads)
                self._back(x, bs, up[..., HIDDEN:], "b", grads)
                t += 1
                rate = RATE * (1 - 0.95 * t / (epochs * len(starts)))  # falls to a twentieth
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        x, mask, _ = _padded([(p, np.zeros(len(p))) for p in pages])
        s = self.scores(x, mask)
        return [s[: len(p), i] >= 0.5 for i, p in enumerate(pages)]


def _padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, n = max(len(y) for _, y in pages), len(pages)
    x, mask, y = np.zeros((t, n, DIM), np.float32), np.zeros((t, n), bool), np.zeros((t, n))
    for i, (f, own) in enumerate(pages):
        x[: len(own), i], mask[: len(own), i], y[: len(own), i] = f, True, own
    return x, mask, y


#: Wording of training pages: the prose of half of them and half of the boilerplate; the rest is of invented words.
PROSE = "the a of and to in was were had by from with that which this his her their its on at for as but not after before while when years people city river government war research team study found water country history world several early later across century science law school north village company said officials report according region built became during between although number small large different form part often known system music art language".split()
COOKIE = ("we use cookies to improve your experience on our website", "by continuing to browse this site you accept our use of cookies", "manage your cookie preferences and privacy settings here", "this site uses cookies and similar technologies for analytics", "accept all cookies or reject optional tracking", "we and our partners store personal data with your consent", "read our privacy policy to learn how we process data")
ADVERT = ("buy now and save on your first order", "limited time offer shop the sale today", "get free shipping with our best deals and discounts", "sponsored by our advertising partners", "sign up today for a free trial", "click here for a special offer at the lowest price", "subscribe now and get a discount on premium")
REPLY = ("great post thanks for sharing i really liked it", "i totally agree with you lol", "reply to this comment or log in to like", "thanks i think you are wrong about this imho", "posted by a guest user reply report", "awesome article keep it up please write more", "first comment here i love this blog")
SIDE = ("follow us on facebook and twitter and share this page", "related posts you may also like", "subscribe to our newsletter and enter your email", "most popular stories read more recent posts", "share this on social media", "sign up for our weekly newsletter")
FOOT = ("all rights reserved copyright terms of use and privacy policy", "contact us about us careers help sitemap", "powered by our company all trademarks belong to their owners")


def training_page(r: np.random.Generator) -> tuple[str, list[str]]:
    """A page of a random layout and the main blocks it was made with."""
    letters = "aeiounrstlmd"

    real = r.random() < 0.5

    def words(a: int, b: int) -> str:
        if real:
            return " ".join(map(str, r.choice(PROSE, int(r.integers(a, b)))))
        return " ".join("".join(r.choice(list(letters), int(r.integers(2, 10)))) for _ in range(int(r.integers(a, b))))

    def sentence(a: int = 1, b: int = 40) -> str:
        x = r.random()
        if b > 20 and x < 0.04:  # prose that goes wrong: a few words over and over, or shouted with marks
            return " ".join(f"{w} " * int(r.integers(3, 60)) for w in words(1, 6).split()).strip()
        if b > 20 and x < 0.07:
            return " ".join(w.upper() + str(r.choice(["!!", "###", "%%%", "$$$"])) for w in words(a, b).split())
        return words(a, b).capitalize() + str(r.choice([".", ".", ".", "!", "?", "%%%", "&amp;", " |", ""]))

    def attr(names: list[str]) -> str:
        return f' {r.choice(["class", "id"])}="{r.choice(names)}"' if r.random() < 0.9 else ""

    def links(n: int, tag: str) -> str:
        return f"<{tag}>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(n)) + f"</{tag}>"

    main: list[str] = []

    def own(text: str) -> str:
        if clean := _SPACE.sub(" ", html.unescape(re.sub(r"<[^>]*>", " ", text))).strip():
            main.append(_SPACE.sub(" ", html.unescape(re.sub(r"</?(?:b|i|em|a|span|strong)\b[^>]*>", "", text.replace("<br>", " ")))).strip() or clean)
        return text

    def menu() -> str:
        kind = int(r.integers(4))
        body = links(int(r.integers(2, 9)), "ul") if kind < 3 else " ".join(f'<a href="/{i}">{words(1, 3)}</a>' for i in range(5))
        return f"<nav>{body}</nav>" if r.random() < 0.6 else f"<div{attr(['menu', 'navbar', 'nav-main', 'breadcrumb', 'topnav'])[:] or ' class=menu'}>{body}</div>"

    def told(phrases: tuple[str, ...]) -> str:
        return ". ".join(str(x).capitalize() for x in r.choice(phrases, int(r.integers(1, 4)), replace=False)) + str(r.choice([".", ".", "!", ""]))

    def boxed(tags: list[str], names: list[str], a: int, b: int, phrases: tuple[str, ...] = ()) -> str:
        tag = str(r.choice(tags))
        if phrases and r.random() < 0.5:
            if r.random() < 0.4:  # only the words tell
                return str(r.choice([f"<div><p>{told(phrases)}</p></div>", f"<p>{told(phrases)}</p>", f"<div>{told(phrases)}</div>"]))
            return f'<{tag} {r.choice(["class", "id"])}="{r.choice(names)}">{told(phrases)}</{tag}>'
        cls = f' {r.choice(["class", "id"])}="{r.choice(names)}"'
        if tag in ("aside", "footer", "header", "form") and r.random() < 0.5:
            cls = ""
        inner = "".join(str(r.choice([f"<p>{sentence(a, b)}</p>", sentence(a, b), f"<h3>{words(1, 4)}</h3>", f'<a href="/x">{words(1, 4)}</a>'])) for _ in range(int(r.integers(1, 4))))
        return f"<{tag}{cls}>{inner}</{tag}>"

    advert = lambda: boxed(["div", "div", "section", "p"], ["ad", "ads", "advert", "banner ad", "sponsored", "promo", "ad-box", "advertisement"], 2, 30, ADVERT)
    side = lambda: boxed(["aside", "div"], ["sidebar", "side", "related", "widget", "share", "social", "newsletter"], 1, 25, SIDE)
    note = lambda: boxed(["div", "section"], ["cookie", "cookie-notice", "notice", "consent", "gdpr banner", "alert", "popup"], 4, 30, COOKIE)
    form = lambda: f'<form action="/f"><label>{words(1, 4)}</label><input name="q"><button>{words(1, 2)}</button>{"<select><option>" + words(1, 2) + "</option></select>" if r.random() < 0.3 else ""}<p>{sentence(2, 12)}</p></form>'
    foot = lambda: f"<footer{attr(['footer'])}>&copy; {words(1, 5)}{links(3, 'ul') if r.random() < 0.3 else ''}</footer>" if r.random() < 0.75 else boxed(["div"], ["footer", "copyright", "site-footer"], 2, 12, FOOT)

    def replies() -> str:
        tag, name = str(r.choice(["div", "section", "ul", "ol"])), str(r.choice(["comments", "comment-list", "reader-comments", "discussion comments"]))
        item = "li" if tag in ("ul", "ol") else "div"
        worded = r.random() < 0.5
        if worded and r.random() < 0.4:
            return "<div>" + "".join(f"<p>{told(REPLY)}</p>" for _ in range(int(r.integers(1, 4)))) + "</div>"
        if worded:
            return f'<{tag} class="{name}">' + "".join(f'<{item} class="comment">{told(REPLY)}</{item}>' for _ in range(int(r.integers(1, 5)))) + f"</{tag}>"
        return f'<{tag} {r.choice(["class", "id"])}="{name}">' + (f"<h2>{words(1, 3)}</h2>" if r.random() < 0.5 and item == "div" else "") + "".join(f'<{item} class="comment">{f"<p>{sentence(3, 30)}</p>" if r.random() < 0.7 else sentence(3, 30)}</{item}>' for _ in range(int(r.integers(1, 5)))) + f"</{tag}>"

    def article() -> str:
        body = ""
        if r.random() < 0.8:
            body += f"<h1>{own(sentence(1, 12))}</h1>"
        for _ in range(int(r.integers(1, 14))):
            x = r.random()
            if x < 0.5:
                again = int(r.integers(3, 25)) if r.random() < 0.05 else 1  # now and then a line stands there over and over
                said, ended = sentence(1, 6) if again > 1 else sentence(), "</p>" if r.random() < 0.8 else ""
                for _ in range(again):
                    body += f"<p>{own(said)}{ended}"
            elif x < 0.72:
                body += f"<p><b>{own(sentence())}<br>"
            elif x < 0.8:
                t = str(r.choice(["h2", "h3"]))
                body += f"<{t}>{own(words(1, 8))}</{t}>"
            elif x < 0.86:
                body += "<ul>" + "".join(f"<li>{own(sentence(2, 15))}</li>" for _ in range(int(r.integers(2, 5)))) + "</ul>"
            elif x < 0.9:
                body += f"<blockquote>{own(sentence())}</blockquote>"
            elif x < 0.93:
                body += f"<table><tr><td>{own(words(1, 4))}</td><td>{own(words(1, 4))}</td></tr></table>"
            elif x < 0.95:
                body += f"<pre>{own(words(2, 12))}</pre>"
            elif x < 0.97:
                body += f'<p>{own(words(2, 8) + " <a href=/y>" + words(1, 3) + "</a> " + sentence(2, 9))}</p>'
            else:
                body += advert() if r.random() < 0.5 else str(r.choice([side, form, note])())
        x = r.random()
        if x < 0.6:
            return f"<article{attr(['post', 'entry']) if r.random() < 0.3 else ''}>{body}</article>"
        if x < 0.75:
            return f"<main>{body}</main>"
        if x < 0.85:
            return f"<main><article>{body}</article></main>"
        return f'<div {r.choice(["class", "id"])}="{r.choice(["content", "article", "post-body", "entry-content", "main", "story"])}">{body}</div>'

    pieces = [f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>"]
    if r.random() < 0.3:
        pieces.append(f"<header{attr(['header', 'masthead'])}><h1>{words(1, 3)}</h1>" + (f"<p>{words(2, 7)}</p>" if r.random() < 0.5 else "") + (menu() if r.random() < 0.5 else "") + "</header>")
    elif r.random() < 0.1:
        pieces.append(boxed(["div"], ["header", "site-header", "masthead"], 1, 6))
    if r.random() < 0.85:
        pieces.append(menu())
    pieces += [str(f()) for f, share in ((note, 0.2), (advert, 0.55), (side, 0.15), (form, 0.15)) if r.random() < share]
    pieces.append(article())
    pieces += [str(f()) for f, share in ((advert, 0.15), (replies, 0.3), (side, 0.25), (form, 0.12), (note, 0.12)) if r.random() < share]
    if r.random() < 0.85:
        pieces.append(foot())
    if r.random() < 0.9:
        pieces.append("</body></html>")
    return "".join(pieces), main


def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 11) -> Labeller:
    """A labeller fitted on generated pages."""
    r, found = np.random.default_rng(seed), []
    while len(found) < pages:
        page, main = training_page(r)
        own = blocks(page)
        left, y = list(main), []
        for text, _, _ in own:
            hit = text in left
            if hit:
                left.remove(text)
            y.append(hit)
        if own and not left:
            found.append((features(own), np.array(y, float)))
    model = Labeller()
    model.fit(found, epochs)
    model.p = {k: v.astype(np.float32) for k, v in model.p.items()}
    return model


def extract_many(model: Labeller, pages: list[str | None]) -> list[str]:
    found = [blocks(p) for p in pages]
    kept: dict[int, np.ndarray] = {i: model.long_scores(b) >= 0.5 for i, b in enumerate(found) if len(b) > PART}
    some = [i for i, b in enumerate(found) if b and i not in kept]
    some.sort(key=lambda i: len(found[i]))  # pages of like length share a batch
    for at in range(0, len(some), TOGETHER):
        part = some[at : at + TOGETHER]
        kept |= zip(part, model.label([features(found[i]) for i in part]), strict=True)
    return ["\n".join(text for (text, _, _), k in zip(b, kept.get(i, ()), strict=True) if k) for i, b in enumerate(found)]


def extract(pages: DataFrame, model: Labeller, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, url, text."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        kept: list[tuple] = []
        size = 0
        for row in rows:
            # Padding makes a batch as long as its longest page, so a long page closes it.
            size = max(size, (row[2] or "").count("<"))
            if kept and (len(kept) >= 4 * TOGETHER or size * (len(kept) + 1) > TOGETHER_BLOCKS):
                yield from ((i, u, t) for (i, u, _), t in zip(kept, extract_many(shared.value, [k[2] for k in kept]), strict=True))
                kept, size = [], (row[2] or "").count("<")
            kept.append(row)
        if kept:
            yield from ((i, u, t) for (i, u, _), t in zip(kept, extract_many(shared.value, [k[2] for k in kept]), strict=True))

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("i"), F.col(url_col).cast("string").alias("u"), F.col(html_col).alias("h"))
    return map_rows(rows, ["i", "u", "h"], run, f"page_id {kind}, url string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"), train())
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
