"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks, each with the tags that are open around it. A bidirectional LSTM in numpy
reads hashed tag-path and word vectors block by block, in both directions, so that every label depends on the whole
page; blocks labelled as content make the text.

The network is trained on pages put together here from the grammar below (layouts, wrappers, boilerplate of all kinds),
whose labels are known; no text of the corpus is needed for the fit. Its weights are stored beside this module.
Prediction reads every block of every page, at any depth and length.

Null and empty pages give the empty text.
"""

from __future__ import annotations

import html
import os
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cuelake.llm.common import map_texts

TAG_COLS, WORD_COLS, PLAIN_COLS = 160, 48, 8
COLS = TAG_COLS + WORD_COLS + PLAIN_COLS
HIDDEN = 16
#: Fixed by HTML: elements without an end tag, elements whose content is no text, and elements inside a line.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Fixed by HTML: elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Fixed by HTML: elements through which an end of a paragraph does not reach.
SCOPES = frozenset("button caption html marquee object table td th template".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[A-Za-z](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^<]+|<", re.S)
NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Path:
    """The open elements. Each knows what its whole path holds, so a block's path costs the same at any depth."""

    def __init__(self):
        self.names, self.bits, self.marks, self.last, self.open = [], [0], [0], [""], {}

    def push(self, name: str, marks: list[str]) -> None:
        bits = self.bits[-1]
        for mark in marks:
            bits |= 1 << _col(mark, TAG_COLS)
            if mark[:6] == "class:" or mark[:3] == "id:":
                bits |= 1 << _col("any:" + mark.split(":")[1], TAG_COLS)
        self.open.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.bits.append(bits)
        self.marks.append(self.marks[-1] + len(marks))
        self.last.append(marks[-1])

    def close(self, name: str) -> None:
        """Closes the innermost element of this name and all within it; without one, nothing."""
        if self.open.get(name):
            for _ in range(len(self.names) - self.open[name][-1]):
                self.open[self.names.pop()].pop()
                self.bits.pop(), self.marks.pop(), self.last.pop()

    def in_paragraph(self) -> bool:
        p = self.open.get("p")
        return bool(p) and all(not self.open.get(s) or self.open[s][-1] < p[-1] for s in SCOPES)

    def seen(self) -> tuple[int, int]:
        """Columns of the whole path as bits, and its number of marks."""
        last = 1 << _col("last:" + self.last[-1], TAG_COLS) if self.names else 0
        return self.bits[-1] | last, self.marks[-1]


def blocks(page: str | None) -> list[tuple[str, tuple[int, int], float]]:
    """(text, what the path of open elements holds, share of the text in links) of each block with text."""
    out, path, parts, linked = [], Path(), [], 0
    in_link = 0
    skip_to = 0

    def flush():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, path.seen(), min(1.0, linked / len(text))))
        parts, linked = [], 0

    page = page or ""
    for m in TOKEN.finditer(page):
        if m.start() < skip_to:
            continue
        t = m.group()
        if t[0] != "<" or t == "<":
            text = html.unescape(t)
            parts.append(text)
            linked += len(text) if in_link else 0
            continue
        name = NAME.match(t)
        if not name:
            continue
        name = name.group(1).lower()
        if t[1] == "/":
            if name in INLINE:
                in_link = max(0, in_link - (name == "a"))
                continue
            flush()
            in_link = 0
            path.close(name)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, m.end())
            skip_to = end.end() if end else len(page)
            continue
        if name in INLINE:
            in_link += name == "a"
            continue
        if name == "br" or name == "wbr":
            parts.append(" " if name == "br" else "")
            continue
        flush()
        in_link = 0
        if name in VOID:
            continue
        if name in ENDS_P and path.in_paragraph():
            path.close("p")
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and path.names and path.names[-1] == name:
            path.close(name)
        marks = [name]
        for kind, *values in ATTR.findall(t):
            marks += [f"{kind.lower()}:{w}" for v in values for w in re.split(r"[^a-z]+", v.lower()) if w]
        path.push(name, marks)
    flush()
    return out


@lru_cache(maxsize=100_000)
def _col(token: str, n: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % n


def vectors(found: list[tuple[str, tuple[int, int], float]]) -> np.ndarray:
    """Rows of hashed features, one per block."""
    x = np.zeros((len(found), COLS), np.float32)
    for i, (text, (bits, marks), linked) in enumerate(found):
        row = x[i]
        row[:TAG_COLS] = np.unpackbits(np.frombuffer(bits.to_bytes(TAG_COLS // 8, "little"), np.uint8), bitorder="little")
        words = text.lower().split()
        cols = np.fromiter((_col(w, WORD_COLS) for w in words), np.int64, len(words))
        row[TAG_COLS : TAG_COLS + WORD_COLS] = np.bincount(cols, minlength=WORD_COLS) * (0.2 / np.sqrt(len(words)))
        n = len(text)
        row[-PLAIN_COLS:] = (linked, n < 25, 25 <= n < 80, n >= 80, n >= 300, text[-1] in ".!?", np.log1p(marks) / 3, "©" in text)
    return x


def _grammar(rng) -> tuple[list[tuple[str, bool]], str]:
    """A random page with known labels: pieces of markup are built together with what they say."""
    syllables = "an ba ce do el fi gu ha in jo ka lu me no or pa qui re sa ti un ve wa xi yo zu ä é ñ ß".split()

    def word():
        return "".join(rng.choice(syllables, int(rng.integers(1, 4))))

    style = int(rng.integers(0, 9))  # one look for all of a page's own text

    def say(a, b):
        words = [word() for _ in range(int(rng.integers(a, b)))]
        if style == 0:
            words = [w.upper() + "!!" for w in words]
        elif style == 1:
            words = [w + str(rng.choice(["***", "%%%", "&amp;&amp;&amp;", "$$$", "###"])) for w in words]
        elif style == 2:
            words = " | ".join(words).split(" ")
        elif style == 3:
            words = [w for w in words for _ in range(4)]
        s = " ".join(words)
        return s[:1].upper() + s[1:] + ("." if rng.random() < 0.8 else "")

    pick = lambda *xs: xs[int(rng.integers(len(xs)))]

    def wrap(names, inner):
        kind = pick("class", "id") if rng.random() < 0.9 else "role"
        own = pick(*names)
        extra = pick("", " box", "-inner", " wrap", "-1")
        return f'<div {kind}="{own}{extra}">{inner}</div>'

    links = lambda: "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(int(rng.integers(2, 8))))

    def junk():
        s = say(2, 14)
        return pick(
            lambda: f"<nav><ul>{links()}</ul></nav>", lambda: wrap(("menu", "navbar", "breadcrumb", "nav", "navigation", "toolbar"), f"<ul>{links()}</ul>"),
            lambda: f"<header><a href='/'>{say(1, 4)}</a><p>{s}</p></header>", lambda: wrap(("header", "masthead", "banner", "topbar"), f"<p>{s}</p>"),
            lambda: f"<footer><p>&copy; {s}</p></footer>", lambda: f"<footer>&copy; {word()}.example.com &middot; {s}</footer>", lambda: wrap(("footer", "copyright", "legal", "colophon"), s),
            lambda: f"<aside><h3>{say(1, 4)}</h3><ul>{links()}</ul></aside>", lambda: f"<aside><p>{say(5, 40)}</p></aside>", lambda: wrap(("sidebar", "widget", "related", "recommended", "promo", "share", "social", "tags"), f"<h4>{say(1, 4)}</h4><p>{s}</p>"),
            lambda: wrap(("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "banner-ad"), pick(s, f"<p>{say(5, 40)}</p>")),
            lambda: wrap(("cookie", "notice", "consent", "alert", "popup", "modal", "newsletter", "subscribe", "disclaimer", "cookie-notice", "cookie-banner", "gdpr", "announcement"), f"<p>{say(4, 30)}</p><button>{word()}</button>"),
            lambda: f"<form action='/s'><label>{word()}</label><input name='q'><select><option>{word()}<option>{word()}</select><button>{word()}</button></form>",
            lambda: wrap(("comments", "comment", "comment-list", "replies", "discussion", "disqus"), "".join(f"<div class='comment'><b>{word()}</b><p>{say(5, 50)}</p></div>" for _ in range(int(rng.integers(1, 5))))),
            lambda: f"<section id='{pick('comments', 'newsletter', 'related', 'sponsored')}'><h2>{say(1, 3)}</h2><p>{say(5, 40)}</p></section>", lambda: f"<dialog open><p>{say(4, 30)}</p></dialog>",
            lambda: f"<form class='{word()}'><p>{say(3, 20)}</p><textarea></textarea></form>", lambda: f"<div role='{pick('banner', 'navigation', 'complementary', 'contentinfo', 'alert', 'search')}'><p>{say(3, 30)}</p></div>",
            lambda: f"<section class='comments'><h2>{say(1, 3)}</h2><ol><li><p>{say(5, 50)}</p></li></ol></section>",
        )()

    def body():
        p = []
        if rng.random() < 0.8:
            p.append(f"<h1>{say(1, 12)}</h1>")
        for _ in range(int(rng.integers(1, 9) if rng.random() < 0.8 else rng.integers(9, 60))):
            s = say(*pick((1, 6), (4, 30), (10, 90)))
            p.append(pick(lambda: f"<p>{s}</p>", lambda: f"<p>{s}", lambda: f"<p><b>{s}<br>", lambda: f"<p>{s}</p>", lambda: f"<h2>{say(2, 8)}</h2><p>{s}</p>", lambda: f"<ul><li>{say(3, 20)}</li><li>{say(3, 20)}</li></ul>", lambda: f"<blockquote>{s}</blockquote>", lambda: f"<p class='{word()}'>{s}</p>", lambda: f"<pre>{s}</pre>", lambda: f"<table><tr><td>{say(2, 9)}</td><td>{say(1, 5)}</td></tr></table>", lambda: f"<div>{s}</div>", lambda: f"<figure><figcaption>{say(3, 12)}</figcaption></figure>")())
        return p

    outer = pick(("", ""), ("", ""), ('<div id="page">', "</div>"), ('<div class="wrapper"><div class="container">', "</div></div>"), (f'<div class="{word()}">', "</div>"))
    content = body()
    marked, mix = [], []
    for x in content:
        marked.append((x, True))
        if rng.random() < 0.12:
            marked.append((junk(), False))
    opening, closing = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="article">', "</div>"), ('<div class="post-body">', "</div>"), ('<div class="entry-content">', "</div>"), ('<div role="main">', "</div>"), ("<section>", "</section>"), ("<div>", "</div>"), (f'<div class="{word()}">', "</div>"), (f'<div id="{word()}-{word()}">', "</div>"), ('<div class="story text">', "</div>"), ('<section class="post"><div class="body">', "</div></section>"))
    if rng.random() < 0.15:
        closing = ""  # left open
    for _ in range(int(rng.integers(1, 4))):
        mix.append((junk(), False))
    mix += [(opening, None), *marked, (closing, None)]
    for _ in range(int(rng.integers(1, 4))):
        mix.append((junk(), False))
    mix = [(outer[0], None), *mix, (outer[1], None)]
    return mix, "<html><head><title>x</title></head><body>" + "".join(x for x, _ in mix) + "</body></html>"


def _example(rng) -> tuple[np.ndarray, np.ndarray]:
    """A page's vectors and labels. A marker word in the content pieces tells their blocks apart and is then removed."""
    mix, _ = _grammar(rng)
    mark = "\ue000"
    page = "".join(re.sub(r"(^|>)([^<>\s][^<>]*)", lambda m: m.group(1) + mark + m.group(2), x) if good else x for x, good in mix)
    found = blocks(f"<html><body>{page}</body></html>")
    y = np.array([mark in t for t, _, _ in found], np.float32)
    return vectors([(t.replace(mark, ""), p, s) for t, p, s in found if t.replace(mark, "")]), y[[bool(t.replace(mark, "")) for t, _, _ in found]]


def _pad(rows: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, rows))
    out, mask = np.zeros((n, len(rows), width), np.float32), np.zeros((n, len(rows)), np.float32)
    for i, r in enumerate(rows):
        out[: len(r), i], mask[: len(r), i] = r.reshape(len(r), width), 1
    return out, mask


sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    def __init__(self, seed: int = 5):
        rng, h = np.random.default_rng(seed), HIDDEN
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.15, (COLS, 4 * h)).astype(np.float32)
            self.p["h" + d] = rng.normal(0, 0.25, (h, 4 * h)).astype(np.float32)
            self.p["c" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        self.p["o"], self.p["s"] = rng.normal(0, 0.2, 2 * h).astype(np.float32), np.zeros(1, np.float32)

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: str):
        """x: steps, pages, columns. Padding leaves the state as it is."""
        h, steps, n = HIDDEN, *mask.shape
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        pre = x @ self.p["x" + d] + self.p["c" + d]
        hs, cs = np.zeros((steps, n, h), np.float32), np.zeros((steps, n, h), np.float32)
        gates = np.zeros((steps, n, 4 * h), np.float32)
        hp, cp = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for t in order:
            z = pre[t] + hp @ self.p["h" + d]
            g = np.concatenate([sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])], 1)
            c = g[:, h : 2 * h] * cp + g[:, :h] * g[:, 3 * h :]
            m = mask[t][:, None]
            cp = m * c + (1 - m) * cp
            hp = m * (g[:, 2 * h : 3 * h] * np.tanh(c)) + (1 - m) * hp
            hs[t], cs[t], gates[t] = hp, cp, g
        return hs, cs, gates

    def predict(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of content for every block of every page; pages of alike length go together."""
        out: list = [np.zeros(0, np.float32)] * len(rows)
        order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: len(rows[i]))
        for k in range(0, len(order), 64):
            part = order[k : k + 64]
            x, mask = _pad([rows[i] for i in part], COLS)
            both = np.concatenate([self._direction(x, mask, d)[0] for d in "fb"], 2)
            p = sigmoid(both @ self.p["o"] + self.p["s"])
            for j, i in enumerate(part):
                out[i] = p[: len(rows[i]), j]
        return out

    def train(self, pages: int = 4000, epochs: int = 8, batch: int = 30, rate: float = 0.012, seed: int = 11) -> None:
        rng, h = np.random.default_rng(seed), HIDDEN
        data = [e for e in (_example(rng) for _ in range(pages)) if len(e[0])]
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        steps_all, t_all = epochs * -(-len(data) // batch), 0
        for _ in range(epochs):
            perm = rng.permutation(len(data))
            for b in range(0, len(perm), batch):
                part = [data[i] for i in perm[b : b + batch]]
                x, mask = _pad([e[0] for e in part], COLS)
                y = _pad([e[1] for e in part], 1)[0][:, :, 0]
                states = {d: self._direction(x, mask, d) for d in "fb"}
                both = np.concatenate([states[d][0] for d in "fb"], 2)
                e = (sigmoid(both @ self.p["o"] + self.p["s"]) - y) * mask / mask.sum()
                g = {"o": np.einsum("tn,tnk->k", e, both), "s": np.array([e.sum()], np.float32)}
                for k, d in enumerate("fb"):
                    hs, cs, gates = states[d]
                    steps = len(x)
                    order = list(range(steps)) if d == "f" else list(range(steps - 1, -1, -1))
                    dz_all = np.zeros_like(gates)
                    dh_next, dc_next = np.zeros_like(hs[0]), np.zeros_like(cs[0])
                    gh = np.zeros_like(self.p["h" + d])
                    zero = np.zeros_like(hs[0])
                    for n in range(steps - 1, -1, -1):
                        t = order[n]
                        hp, cp = (hs[order[n - 1]], cs[order[n - 1]]) if n else (zero, zero)
                        m, gt = mask[t][:, None], gates[t]
                        dh = dh_next + e[t][:, None] * self.p["o"][k * h : (k + 1) * h]
                        i, f, o, c = gt[:, :h], gt[:, h : 2 * h], gt[:, 2 * h : 3 * h], gt[:, 3 * h :]
                        tc = np.tanh(f * cp + i * c)
                        dhm = dh * m
                        dc = dc_next * m + dhm * o * (1 - tc**2)
                        dz = np.concatenate([dc * c * i * (1 - i), dc * cp * f * (1 - f), dhm * tc * o * (1 - o), dc * i * (1 - c**2)], 1)
                        dz_all[t] = dz
                        gh += hp.T @ dz
                        dh_next = dz @ self.p["h" + d].T + dh * (1 - m)
                        dc_next = dc * f + dc_next * (1 - m)
                    g["x" + d], g["h" + d], g["c" + d] = np.einsum("tnc,tnk->ck", x, dz_all, optimize=True), gh, dz_all.sum((0, 1))
                t_all += 1
                for k, v in self.p.items():
                    m1, m2 = moments[k]
                    step = np.clip(g[k], -1, 1)
                    m1 += 0.1 * (step - m1)
                    m2 += 0.01 * (step**2 - m2)
                    v -= (rate * (1 - t_all / (steps_all + 1)) * (m1 / (1 - 0.9**t_all)) / (np.sqrt(m2 / (1 - 0.99**t_all)) + 1e-7)).astype(np.float32)


#: The trained network. `python -m cuelake.llm.html_text` trains it anew and writes it.
WEIGHTS = os.path.join(os.path.dirname(__file__), "html_weights.npz")


@lru_cache(maxsize=1)
def fit() -> BiLstm:
    """The stored network; the driver reads it and sends it along."""
    net = BiLstm()
    with np.load(WEIGHTS) as held:
        net.p = {k: held[k] for k in net.p}
    return net


def main_text(pages: list[str | None], net: BiLstm, threshold: float = 0.5) -> list[str]:
    found = [blocks(p) for p in pages]
    scores = net.predict([vectors(f) for f in found])
    return [" ".join(t for (t, _, _), s in zip(f, p) if s >= threshold) for f, p in zip(found, scores)]


def extract(df: DataFrame, net: BiLstm | None = None, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds `text`, the main text."""
    net = net or fit()

    def task():
        return lambda pages: {"text": [t for i in range(0, len(pages), 256) for t in main_text(pages[i : i + 256], net)]}

    return map_texts(df, html_col, task, [T.StructField("text", T.StringType())], keep)


if __name__ == "__main__":
    trained = BiLstm()
    trained.train()
    np.savez_compressed(WEIGHTS, **trained.p)
