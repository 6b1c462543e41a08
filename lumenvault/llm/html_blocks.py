"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: text between block-level tags,
each with the path of open tags (names, and words of class, id and role) and
counts of hashed words. A bidirectional LSTM in numpy reads the whole sequence
both ways and labels every block, so a block's label rests on all that stands
before and after it.

The network is trained here, in a few seconds, from a bounded sample of the pages
themselves (blocks in an ``article`` or ``main`` element without a name of page
furniture on their path are text) and from made-up pages that dress the words of
that sample in many other layouts. The sample, the made-up pages and the start
weights are fixed by parameters and seeds.

A null page is an empty one, with empty text. Repeated rows are read one by one;
extra columns are left out. A page of any length is one sequence. Script, style and other raw
elements end at their own end tag, whatever they hold; one without an end tag, like an
open comment, hides the rest of its page. The sample depends on keys and pages alone, so
null and repeated keys change nothing from run to run. Without any page the network learns from
the made-up pages alone. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenvault.llm.common import arrow_map, chunks, word_hashes

#: Pages of the table to learn from, at most: those with the smallest hashes of their keys; and blocks of each, from its start.
TRAIN_PAGES, TRAIN_BLOCKS = 200, 200
#: Made-up pages.
MADE_PAGES = 800
PATH_DIM, WORD_DIM, PLAIN_DIM, HIDDEN = 160, 32, 6, 16
#: Blocks of pages that are run through the network together, padding included.
RUN_BLOCKS = 16_384

# Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text of the page.
HIDDEN_TAGS = frozenset("head title script style template noscript iframe svg canvas audio video select textarea button option datalist".split())
# Elements whose content is read as it is up to their end tag.
RAW = frozenset("script style textarea title iframe noscript".split())
# Elements that a new one of the second group closes.
CLOSES = {"p": BLOCKS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "head": frozenset({"body"})}
# Names of page furniture.
FURNITURE = frozenset("nav aside footer header form menu navbar navigation breadcrumb breadcrumbs topbar sidebar side related widget trending cookie cookies notice consent alert popup modal newsletter subscribe signup ad ads advert adverts advertisement banner sponsored sponsor promo share social comments comment reply respond disqus copyright legal masthead pager pagination login search tags".split())

# What the furniture of pages says, and classes that say nothing.
SAID = ("Home", "About us", "Contact", "News", "Sign in", "Log in", "Register", "Accept all", "Accept all to continue", "Manage cookies", "Privacy policy", "Terms of use", "All rights reserved", "© 2021", "Imprint", "Subscribe now", "Share this", "Read more", "Related stories", "Most read", "Follow us", "Search", "Menu", "Skip to content", "Advertisement", "Next page", "Back to top", "Leave a reply", "Print")
NEUTRAL = ("a", "b", "box", "block", "inner", "outer", "row", "col", "left", "right", "middle", "bottom", "top", "wrap", "cell", "section", "grid", "item", "x", "unit")

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|<[/!?a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_LETTERS = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in its order."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    path: tuple[str, ...] = ()
    hidden = links = linked = at = 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, path, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal hidden, links
        while len(stack) > upto:
            name, _ = stack.pop()
            if name in BLOCKS:
                flush()
            hidden -= name in HIDDEN_TAGS
            links -= name == "a"

    while token := _TOKEN.match(page, at):
        t, at = token[0], token.end()
        if t[0] != "<" or t == "<":
            if not hidden:
                if not parts:
                    path = tuple(x for _, names in stack for x in names)
                t = html.unescape(t)
                parts.append(t)
                if links:
                    linked += len(t)
            continue
        named = _NAME.match(t)
        if named is None:
            continue
        name = named[1].lower()
        if t[1] == "/":
            opened = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if opened is not None:
                close(opened)
            elif name in BLOCKS:
                flush()
            continue
        for k in range(len(stack) - 1, -1, -1):
            closing = CLOSES.get(stack[k][0])
            if closing and name in closing:
                close(k)
            elif stack[k][0] in BLOCKS and stack[k][0] not in CLOSES:
                break
        if name in BLOCKS:
            flush()
        if name == "br":
            parts.append(" ")
        if name in VOID or t.endswith("/>"):
            continue
        words = (w for m in _NAMED.finditer(t) for w in _LETTERS.findall((m[1] or m[2] or m[3] or "").lower()))
        stack.append((name, (name, *words)))
        hidden += name in HIDDEN_TAGS
        links += name == "a"
        if name in RAW:
            # What looks like a tag or a comment in a raw element is none.
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
    close(0)
    flush()
    return found


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """One row for each block: hashed path names, shares of hashed words, and a few sizes."""
    blocks = [b for p in pages for b in p]
    out = np.zeros((len(blocks), PATH_DIM + WORD_DIM + PLAIN_DIM), np.float32)
    if not blocks:
        return out
    seen: dict[tuple[str, ...], list[int]] = {}
    for row, b in enumerate(blocks):
        dims = seen.get(b.path)
        if dims is None:
            dims = seen[b.path] = [zlib.crc32(x.encode()) % PATH_DIM for x in set(b.path)]
        out[row, dims] = 1
    words, offsets = word_hashes([b.text.lower().encode("utf-8", "surrogatepass").split() for b in blocks])
    owner = np.repeat(np.arange(len(blocks)), np.diff(offsets))
    counts = np.bincount(owner * WORD_DIM + (words >> np.uint64(40)).astype(np.int64) % WORD_DIM, minlength=len(blocks) * WORD_DIM).reshape(-1, WORD_DIM)
    n = np.maximum(np.diff(offsets), 1)
    out[:, PATH_DIM : PATH_DIM + WORD_DIM] = counts / n[:, None]
    size = np.array([len(b.text) for b in blocks])
    at = np.concatenate([np.arange(len(p)) / max(len(p), 1) for p in pages])
    out[:, -PLAIN_DIM:] = np.stack([np.log1p(n) / 5, np.log1p(size) / 7, np.array([b.linked for b in blocks]) / size, at, np.array([b.text[-1] in ".!?:\"'" for b in blocks]), np.array([len(b.path) for b in blocks]) / 10], axis=1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """A bidirectional LSTM with one logistic output for each step."""

    def __init__(self, seed: int = 7, hidden: int = HIDDEN):
        rng, inputs = np.random.default_rng(seed), PATH_DIM + WORD_DIM + PLAIN_DIM
        self.hidden = hidden
        self.weights = {}
        for way in "fb":
            self.weights[way + "x"] = rng.normal(0, 0.15, (inputs, 4 * hidden)).astype(np.float32)
            self.weights[way + "h"] = rng.normal(0, 0.15, (hidden, 4 * hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # gates remember at first
            self.weights[way + "b"] = bias
        self.weights["out"] = rng.normal(0, 0.15, (2 * hidden, 1)).astype(np.float32)
        self.weights["bias"] = np.zeros(1, np.float32)

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states of (pages, steps); where mask is 0 the state stays."""
        n, steps, _ = x.shape
        k = self.hidden
        drive = x @ self.weights[way + "x"] + self.weights[way + "b"]
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        states = np.zeros((n, steps, k), np.float32)
        for s in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = drive[:, s] + h @ self.weights[way + "h"]
            gates, new = _sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            c_new = f * c + i * new
            t = np.tanh(c_new)
            m = mask[:, s, None]
            if keep is not None:
                keep.append((s, h, c, i, f, o, new, t))
            c, h = m * c_new + (1 - m) * c, m * (o * t) + (1 - m) * h
            states[:, s] = h
        return states

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The probability that a block is text, (pages, steps)."""
        both = np.concatenate([self._run("f", x, mask), self._run("b", x, mask)], axis=2)
        return _sigmoid((both @ self.weights["out"])[:, :, 0] + self.weights["bias"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss of the blocks and its gradients."""
        k, kept = self.hidden, {"f": [], "b": []}
        both = np.concatenate([self._run(way, x, mask, kept[way]) for way in "fb"], axis=2)
        p = _sigmoid((both @ self.weights["out"])[:, :, 0] + self.weights["bias"])
        total = max(mask.sum(), 1)
        loss = -float((mask * (labels * np.log(p + 1e-7) + (1 - labels) * np.log(1 - p + 1e-7))).sum() / total)
        d = (mask * (p - labels) / total)[:, :, None].astype(np.float32)
        out = {"out": np.einsum("nsk,nso->ko", both, d), "bias": d.sum(axis=(0, 1))}
        d_both = d @ self.weights["out"].T
        for way, own in (("f", d_both[:, :, :k]), ("b", d_both[:, :, k:])):
            d_drive = np.zeros((*x.shape[:2], 4 * k), np.float32)
            d_h, d_c = np.zeros((x.shape[0], k), np.float32), np.zeros((x.shape[0], k), np.float32)
            recurrent = np.zeros_like(self.weights[way + "h"])
            for s, h, c, i, f, o, new, t in reversed(kept[way]):
                m = mask[:, s, None]
                d_h = d_h + own[:, s]
                into_h, into_c = m * d_h, m * d_c
                dc = into_c + into_h * o * (1 - t * t)
                z = np.concatenate([dc * new * i * (1 - i), dc * c * f * (1 - f), into_h * t * o * (1 - o), dc * i * (1 - new * new)], axis=1)
                d_drive[:, s] = z
                recurrent += h.T @ z
                d_h = z @ self.weights[way + "h"].T + (1 - m) * d_h
                d_c = dc * f + (1 - m) * d_c
            out[way + "h"] = recurrent
            out[way + "x"] = np.tensordot(x, d_drive, axes=([0, 1], [0, 1]))
            out[way + "b"] = d_drive.sum(axis=(0, 1))
        return loss, out

    def fit(self, pages: list[list[Block]], labels: list[list[int]], epochs: int = 14, batch: int = 24, rate: float = 0.02, seed: int = 11) -> float:
        """Adam over batches of pages; returns the last epoch's loss."""
        rng = np.random.default_rng(seed)
        data = [(vectors([p]), np.array(y, np.float32)) for p, y in zip(pages, labels) if p]
        first = {n: np.zeros_like(w) for n, w in self.weights.items()}
        second = {n: np.zeros_like(w) for n, w in self.weights.items()}
        step, loss = 0, 0.0
        for epoch in range(epochs):
            order, losses = rng.permutation(len(data)), []
            for a in range(0, len(order), batch):
                chosen = [data[k] for k in order[a : a + batch]]
                x, mask, y = padded([c[0] for c in chosen], [c[1] for c in chosen])
                loss, grads = self.gradients(x, mask, y)
                losses.append(loss)
                step += 1
                for n, g in grads.items():
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.99 * second[n] + 0.01 * g * g
                    rise = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-7)
                    self.weights[n] = self.weights[n] - (rate * (0.85**epoch) * rise).astype(np.float32)
            loss = float(np.mean(losses))
        return loss

    def label(self, pages: list[list[Block]]) -> list[list[bool]]:
        """Whether each block is text."""
        out: list[list[bool]] = [[] for _ in pages]
        order = [k for k in sorted(range(len(pages)), key=lambda k: len(pages[k])) if pages[k]]
        while order:
            # The longest first, with as many others as fit beside it.
            steps = len(pages[order[-1]])
            some = [order.pop() for _ in range(min(len(order), max(1, RUN_BLOCKS // steps)))]
            x, mask, _ = padded([vectors([pages[k]]) for k in some], None)
            for row, (k, p) in enumerate(zip(some, self.scores(x, mask))):
                out[k] = (p[: len(pages[k])] > 0.5).tolist()
        return out


def padded(rows: list[np.ndarray], labels: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(r) for r in rows)
    x, mask, y = np.zeros((len(rows), steps, rows[0].shape[1]), np.float32), np.zeros((len(rows), steps), np.float32), np.zeros((len(rows), steps), np.float32)
    for k, r in enumerate(rows):
        x[k, : len(r)], mask[k, : len(r)] = r, 1
        if labels is not None:
            y[k, : len(r)] = labels[k]
    return x, mask, y


def weak_labels(blocks: list[Block]) -> list[int] | None:
    """1 for blocks in an article or main element without furniture inside it; None if a page has neither."""
    main = {"article", "main"}
    if not any(main & set(b.path) for b in blocks):
        return None
    out = []
    for b in blocks:
        at = next((k for k, x in enumerate(b.path) if x in main), None)
        out.append(int(at is not None and not FURNITURE & set(b.path[at:])))
    return out


def made_pages(n: int, words: list[str], seed: int = 3) -> list[tuple[list[Block], list[int]]]:
    """Pages of many layouts with words drawn from ``words``; a private mark in the text carries each block's label."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    maybe = lambda p: rng.random() < p
    words = words or ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "magna"]

    def line(low: int, high: int, label: int) -> str:
        text = " ".join(pick(words) for _ in range(int(rng.integers(low, high + 1))))
        return f"{'\ue001' if label else '\ue000'}{text}{pick(['.', '.', '!', '', ''])}"

    def said() -> str:
        return "\ue000" + " ".join(pick(SAID) for _ in range(int(rng.integers(1, 4)))) + pick(["", ".", f" {line(1, 4, 0)[1:]}"])

    def code() -> str:
        return f"\ue001{pick(words)}({pick(words)}) = {int(rng.integers(99))};\n  {pick(words)} {pick(words)}\n{pick(words)}.{pick(words)}()"

    def plain() -> str:
        """A class that says nothing, or none."""
        return f' class="{pick(NEUTRAL)}{pick(["", "", int(rng.integers(30))])}"' if maybe(0.7) else ""

    def links(count: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{line(1, 3, 0)}</a></li>' for _ in range(count)) + "</ul>"

    def furniture(place: str) -> str:
        kinds = {
            "top": [
                lambda: f"<nav>{links(int(rng.integers(2, 9)))}</nav>",
                lambda: f"<header><h1>{line(1, 5, 0)}</h1>{links(3) if maybe(0.5) else ''}<p>{line(2, 9, 0)}</p></header>",
                lambda: f'<div class="{pick(["menu", "navbar", "main-menu", "breadcrumb", "topbar", "masthead", "navigation"])}">{links(4)}</div>',
                lambda: f'<div id="{pick(["nav", "menu", "header", "top-bar"])}">{line(2, 6, 0)} <a href="/">{line(1, 2, 0)[1:]}</a></div>',
            ],
            "any": [
                lambda: f'<div class="{pick(["ad", "ads", "advert", "advertisement", "banner", "ad-banner", "sponsored", "promo"])}">{line(3, 30, 0)}</div>',
                lambda: f'<div class="{pick(["cookie", "cookie-notice", "notice", "consent", "alert", "popup", "newsletter", "subscribe"])}"><p>{line(4, 25, 0)}</p></div>',
                lambda: f'<aside class="{pick(["sidebar", "related", "widget", "trending", "side"])}"><h3>{line(1, 4, 0)}</h3>{links(4)}<p>{line(4, 30, 0)}</p></aside>',
                lambda: f'<aside>{pick(["<p>", "<div>"])}{line(4, 40, 0)}</aside>',
                lambda: f'<div class="{pick(["sidebar", "related", "widget", "side-bar"])}"><p>{line(4, 40, 0)}</p></div>',
                lambda: f'<form action="/s"><label>{line(1, 4, 0)}</label><input name="q"><p>{line(2, 12, 0)}</p></form>',
                lambda: f'<div class="{pick(["share", "social", "social-share", "tags"])}">{links(3)}</div>',
            ],
            "end": [
                lambda: f'<{(e := pick(["section", "div"]))} {pick(["class", "id"])}="{pick(["comments", "comment-list", "comments-area", "reader-comments", "respond", "disqus"])}"><h2>{line(1, 3, 0)}</h2>' + "".join(f'<div class="comment"><p>{line(4, 45, 0)}</p></div>' for _ in range(int(rng.integers(1, 6)))) + f"</{e}>",
                lambda: "".join(f'<div class="comment">{line(4, 45, 0)}</div>' for _ in range(int(rng.integers(1, 5)))),
                lambda: f"<footer>{pick(['<p>', ''])}{line(3, 25, 0)}</footer>",
                lambda: f'<div class="{pick(["footer", "copyright", "legal", "site-footer"])}">{line(3, 20, 0)}</div>',
            ],
        }
        # Some of it is told by its words alone.
        bare = [lambda: f"<div{plain()}>{said()}</div>", lambda: f"<div{plain()}>" + " ".join(f'<a href="/x">{said()}</a>' for _ in range(int(rng.integers(1, 5)))) + "</div>", lambda: f"<div{plain()}><p>{said()}</p></div>"]
        return pick(bare if maybe(0.16) else kinds[place])()

    def content() -> str:
        out = [f"<{h}>{line(2, 12, 1)}</{h}>" for h in (["h1"] if maybe(0.7) else [])]
        for _ in range(int(rng.integers(1, 14))):
            kind = rng.random()
            if kind < 0.05:
                out.append(f"<pre>{code() if maybe(0.6) else line(6, 40, 1)}</pre>")
            elif kind < 0.08:
                out.append("<dl>" + "".join(f"<dt>{line(1, 4, 1)}</dt><dd>{line(3, 25, 1)}</dd>" for _ in range(2)) + "</dl>")
            elif kind < 0.12:
                out.append(f"<div{plain()}>{pick(['<p>', ''])}{line(4, 60, 1)}</div>")
            elif kind < 0.14:
                out.append(f"<div{plain()}>" + "".join(f"<div{plain()}>{line(4, 60, 1)}</div>" for _ in range(2)) + "</div>")
            elif kind < 0.62:
                out.append(f"<p>{line(2, 90, 1)}{pick(['</p>', '</p>', ''])}")
            elif kind < 0.72:
                out.append(f"<p><b>{line(2, 60, 1)}<br>")
            elif kind < 0.78:
                out.append(f"<h2>{line(1, 8, 1)}</h2>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{line(2, 25, 1)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{line(4, 50, 1)}</p></blockquote>")
            elif kind < 0.92:
                row = lambda cell: f"<tr><{cell}>{line(1, 4, 1)}</{cell}><{cell}>{line(1, 4, 1)}</{cell}></tr>"
                out.append(f"<table>{row('th') if maybe(0.6) else ''}{''.join(row('td') for _ in range(int(rng.integers(1, 4))))}</table>")
            else:
                out.append(furniture("any"))
        return "".join(out)

    def in_table() -> str:
        """The layout of old pages: cells beside and below the one that holds the text."""
        side = lambda: f"<td{plain()}>" + pick([lambda: links(int(rng.integers(2, 6))), said, lambda: f'<a href="/">{said()}</a>', lambda: f"<p>{said()}</p>"])() + "</td>"
        cells = [side() if maybe(0.8) else "", f"<td{plain()}>{content()}</td>", side() if maybe(0.4) else ""]
        top, end = (f"<tr><td>{said()}</td></tr>" if maybe(p) else "" for p in (0.5, 0.5))
        return f"<table{plain()}>{top}<tr>{''.join(cells)}</tr>{end}</table>"

    pages = []
    for _ in range(n):
        opening, closing = pick([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="content">', "</div>"), ('<div class="post-content">', "</div>"), ('<div class="entry">', "</div>"), ('<div class="article-body">', "</div>"), ('<section class="story">', "</section>"), ('<div id="main">', "</div>"), ('<article class="post">', "</article>"), (f"<div{plain()}>", "</div>"), (f"<div{plain()}>", "</div>")])
        inner = content() + (furniture("end") if maybe(0.2) else "")
        if maybe(0.12):
            opening, inner, closing = "", in_table(), ""
        elif maybe(0.35):
            depth = int(rng.integers(1, 4))
            opening, closing = "".join(f"<div{plain()}>" for _ in range(depth)) + opening, closing + "</div>" * depth
        elif maybe(0.15):
            opening = opening if "id=" in opening else opening.replace(">", f' id="{pick(NEUTRAL)}">', 1)
        body = "".join(furniture(pick(["top", "top", "any"])) for _ in range(int(rng.integers(0, 4)))) + opening + inner + closing
        if maybe(0.1):
            body = f'<a href="#x">{said()}</a>' + body
        body += "".join(furniture(pick(["end", "end", "any"])) for _ in range(int(rng.integers(0, 4))))
        if maybe(0.3):
            body = f'<div class="{pick(["wrapper", "container", "page", "layout", "site"])}">{body}</div>'
        blocks = blocks_of(f"<html><head><title>x</title></head><body>{body}</body></html>")
        # A block's first mark says what it is.
        marked = [(b, next((c for c in b.text if c in "\ue000\ue001"), "\ue000")) for b in blocks]
        strip = str.maketrans("", "", "\ue000\ue001")
        pages.append(([Block(b.text.translate(strip).strip() or "x", b.path, b.linked) for b, _ in marked], [int(m == "\ue001") for _, m in marked]))
    return pages


def train(pages: DataFrame, column: str = "html", key: str = "page_id", most: int = TRAIN_PAGES, made: int = MADE_PAGES) -> BlockLabeller:
    """A labeller from at most ``most`` pages of the table and ``made`` made-up ones."""
    order = F.xxhash64(F.col(key))
    # Only keys are sorted; then the few pages are read. Pages that share a key are told apart by what they hold.
    last = pages.select(order.alias("o")).orderBy("o").limit(most).agg(F.max("o")).first()[0]
    page = F.col(column).cast("string")
    rows = pages.where(order <= last).select(order.alias("o"), F.xxhash64(page).alias("h"), page.alias("p")).orderBy("o", "h").limit(most).collect() if last is not None else []
    seen = sorted((blocks_of(r[2])[:TRAIN_BLOCKS] for r in rows), key=lambda p: [b.text for b in p])
    real = [(p, y) for p in seen if (y := weak_labels(p)) is not None]
    words = sorted({w for p, _ in real for b in p for w in b.text.split()})
    sample = real + made_pages(made, words)
    model = BlockLabeller()
    model.fit([p for p, _ in sample], [y for _, y in sample])
    return model


def extract(pages: DataFrame, model: BlockLabeller | None = None, column: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """key, url, text (blocks labelled as text, one on each line) and n_chars of every row."""
    model = model or train(pages, column, key)
    source = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(column).cast("string").alias("html"))
    kinds = dict(source.dtypes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "html"):
            found = [blocks_of(p) for p in part.column("html").to_pylist()]
            texts = ["\n".join(b.text for b, y in zip(p, labels) if y) for p, labels in zip(found, model.label(found))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_key", "_url", "text", "n_chars"])

    found = arrow_map(source, read, f"_key {kinds['_key']}, _url {kinds['_url']}, text string, n_chars long")
    return found.select(F.col("_key").alias(key), F.col("_url").alias(url), "text", "n_chars")
