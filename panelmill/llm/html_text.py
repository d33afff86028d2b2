"""Main text of web pages by a recurrent block labeller.

A tolerant reader cuts a page into leaf blocks: text between block-level tags, with the path of open
elements. A bidirectional LSTM in numpy reads the page's whole block sequence, each block as hashed
tag-path and hashed-word vectors with a few measures, and labels every block as main text or not. It is
trained from pages that a seeded generator builds with known labels, in many layouts and spellings.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from panelmill.llm import bilstm
from panelmill.llm.common import map_batches, slices, table, texts_of
from panelmill.llm.wordhash import Words

PATH_DIMS, WORD_DIMS, MEASURES = 96, 24, 8
DIMS = PATH_DIMS + WORD_DIMS + MEASURES
HIDDEN = 12
BATCH = 256
SLICE = 2_000_000
#: HTML element classes.
RAW = frozenset("script style template iframe select textarea title".split())
FOREIGN = frozenset("math svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big br button canvas cite code data del dfn em font i img ins kbd label mark math nobr object q rp rt ruby s samp small span strike strong sub sup svg time tt u var video wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Opening the key closes these open siblings.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_MARKUP = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'<]|\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>])|[\"'])*+)>", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"[\s\xa0]+")
_PIECES = re.compile(r"[a-z]+")


class Path:
    """The open elements of a block, as a chain; equal chains of a task are one object while ``_CHAINS`` holds them."""

    __slots__ = ("depth", "names", "own", "sums", "up")

    def __init__(self, up: Path | None, tag: str, marks: str):
        self.up, self.depth = up, up.depth + 1 if up else 0
        self.names = [f"t:{tag}", *(f"c:{p}" for p in set(_PIECES.findall(marks)))]
        self.sums = self.own = None

    def _sum(self) -> np.ndarray:
        """Hashed names of the whole chain. Every 16th element keeps its sum, so no block climbs further."""
        chain = []
        node = self
        while node is not None and node.sums is None:
            chain.append(node)
            node = node.up
        total = np.zeros(PATH_DIMS, np.float32) if node is None else node.sums
        for node in reversed(chain):
            total = total + _hashed(node.names)
            if node.depth % 16 == 0 or node is self:
                node.sums = total
        return total

    def vector(self) -> np.ndarray:
        if self.own is None:
            self.own = np.clip(self._sum() + _hashed([f"last:{n}" for n in self.names]), -2, 2)
        return self.own


def _hashed(names: list[str]) -> np.ndarray:
    v = np.zeros(PATH_DIMS, np.float32)
    for n in names:
        h = zlib.crc32(n.encode("utf-8", "surrogatepass"))
        v[h % PATH_DIMS] += 1.0 if h >> 20 & 1 else -1.0
    return v


_CHAINS: dict[tuple[Path | None, str, str], Path] = {}
_MOST_CHAINS = 50_000
_ENDS = {name: re.compile(rf"</{name}", re.I) for name in RAW}


def blocks(page: str) -> list[tuple[Path, str, int]]:
    """(path, text, characters inside links) of every leaf block with text, in page order, in linear time.

    Character references are decoded, white space becomes single spaces, and the ends are trimmed. Scripts,
    styles, templates, frames, titles and the choices and contents of form controls have no text; formulas,
    drawings and the text inside media are part of the block that they stand in.
    """
    if len(_CHAINS) > _MOST_CHAINS:
        _CHAINS.clear()

    def link(up: Path | None, tag: str, marks: str) -> Path:
        key = (up, tag, marks)
        node = _CHAINS.get(key)
        if node is None:
            node = _CHAINS[key] = Path(up, tag, marks)
        return node

    out: list[tuple[Path, str, int]] = []
    stack: list[tuple[str, Path]] = []
    open_: Counter[str] = Counter()
    parts: list[str] = []
    links = anchors = foreign = 0
    root = path = link(None, "", "")
    last_end = page.rfind(">")

    def flush() -> None:
        nonlocal links
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((path, text, min(links, len(text))))
            parts.clear()
        links = 0

    def add(piece: str) -> None:
        nonlocal links
        if piece:
            parts.append(piece)
            if anchors:
                links += len(piece)

    at, search = 0, _MARKUP.search
    while m := search(page, at):
        name = m[2]
        if name is None:
            if m[0] != "<!--" and m.end() > last_end:
                break  # no tag ends any more: the rest is text
            add(page[at : m.start()])
            end = page.find("-->", m.end()) + 2 if m[0] == "<!--" else page.find(">", m.end())
            at = len(page) if end < m.end() else end + 1
            continue
        add(page[at : m.start()])
        at = m.end()
        name, closing = name.lower(), bool(m[1])
        if name in RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                end = _ENDS[name].search(page, at)
                at = page.find(">", end.end()) + 1 if end and end.end() <= last_end else len(page)
            continue
        if name in FOREIGN:
            foreign = max(0, foreign + (-1 if closing else 0 if m[3].rstrip().endswith("/") else 1))
            continue
        if name in CLOSES_P:
            foreign = 0
        if foreign or name in INLINE:
            if name == "a":
                anchors = max(0, anchors + (-1 if closing else 1))
            if name == "br":
                parts.append(" ")
            continue
        flush()
        anchors = 0
        if closing:
            while open_[name]:
                tag = stack.pop()[0]
                open_[tag] -= 1
                if tag == name:
                    break
        elif name not in VOID:
            closes = SIBLINGS.get(name, ())
            if name in CLOSES_P and stack and stack[-1][0] == "p" or stack and stack[-1][0] in closes:
                open_[stack.pop()[0]] -= 1
            marks = " ".join(x.lower() for n in _NAMES.findall(m[3]) for x in n if x) if m[3] else ""
            stack.append((name, link(stack[-1][1] if stack else None, name, marks)))
            open_[name] += 1
        path = stack[-1][1] if stack else root
    add(page[at:])
    flush()
    return out


def vectors(pages: list[list[tuple[Path, str, int]]]) -> list[np.ndarray]:
    """(blocks, DIMS) of each page."""
    flat = [b for page in pages for b in page]
    if not flat:
        return [np.zeros((0, DIMS), np.float32) for _ in pages]
    x = np.zeros((len(flat), DIMS), np.float32)
    x[:, :PATH_DIMS] = np.stack([p.vector() for p, _, _ in flat])
    w = Words([t for _, t, _ in flat], lower=True)
    owner = np.repeat(np.arange(len(flat)), w.counts)
    bucket = (w.hashes % np.uint64(WORD_DIMS)).astype(np.int64)
    counts = np.bincount(owner * WORD_DIMS + bucket, minlength=len(flat) * WORD_DIMS).reshape(-1, WORD_DIMS)
    n = np.maximum(w.counts, 1)[:, None]
    x[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts / n
    chars = np.array([len(t) for _, t, _ in flat], float)
    linked = np.array([k for _, _, k in flat], float)
    sizes = np.array([len(p) for p in pages])
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    rank = np.arange(len(flat)) - first
    m = x[:, PATH_DIMS + WORD_DIMS :]
    m[:, 0] = np.log1p(chars) / 6
    m[:, 1] = linked / np.maximum(chars, 1)
    m[:, 2] = w.counts > 20
    m[:, 3] = np.log1p(w.counts) / 5
    m[:, 4] = rank / np.maximum(np.repeat(sizes, sizes) - 1, 1)
    m[:, 5] = [t[-1] in ".!?…\"”" for _, t, _ in flat]
    m[:, 6] = ["©" in t or "copyright" in t.lower() for _, t, _ in flat]
    m[:, 7] = rank == 0
    return np.split(x, np.cumsum(sizes)[:-1])


class Labeller:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    def scores(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        """Main-text margin of each block; sequences are batched by length."""
        order = sorted((i for i in range(len(xs)) if len(xs[i])), key=lambda i: len(xs[i]))
        out = [np.zeros(0, np.float32)] * len(xs)
        at = 0
        while at < len(order):
            # pages with very many blocks go in smaller batches
            n = max(1, min(BATCH, 60_000 // len(xs[order[min(at + BATCH, len(order)) - 1]])))
            some = order[at : at + n]
            at += n
            e, _, _, _, lengths = project(self.p, [xs[i] for i in some])
            for k, i in enumerate(some):
                out[i] = e[: lengths[k], 1, k] - e[: lengths[k], 0, k]
        return out


def project(p: dict, xs: list[np.ndarray]) -> tuple:
    lengths = np.array([len(x) for x in xs])
    t = int(lengths.max())
    x = np.zeros((t, DIMS + 1, len(xs)), np.float32)
    for k, own in enumerate(xs):
        x[: len(own), :DIMS, k] = own
        x[: len(own), DIMS, k] = 1
    index = bilstm.reversal(lengths, t)
    back = bilstm.reordered(x, index)
    e, kept = bilstm.emissions(p, np.matmul(p["wf"], x), np.matmul(p["wb"], back), index)
    return e, kept, (x, back), index, lengths


#: Class words of parts that belong to an article, also beside words that name adverts, menus or notices.
_INNER = "note info tip intro lead lede summary abstract quote pullquote callout caption credit byline dateline text body para paragraph block row col column inner wrap section part chapter step recipe ingredients method result figure media photo gallery image table data list item answer question definition term example code listing warning important highlight box panel card content main-text rich-text entry story-part post-part promo-code".split()
_OUTER = "header footer nav menu sidebar aside notice cookie cookies consent advert ad promo banner sponsored form newsletter subscribe login search share social related widget comments".split()
_SYLLABLES = "er an th in on re at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra".split()


def _sentence(rng, low: int, high: int) -> str:
    words = ["".join(_SYLLABLES[int(k)] for k in rng.integers(0, len(_SYLLABLES), rng.integers(1, 4))) for _ in range(int(rng.integers(low, high)))]
    if rng.random() < 0.1:
        mark = ("%%%", "***", "###", "!!", "&amp;&amp;")[int(rng.integers(0, 5))]
        words = [w + mark for w in words]
    r = rng.random()
    if r < 0.04:
        words = words[:1] * len(words)
    text = " ".join(words).upper() if r > 0.97 else " ".join(words).capitalize()
    return text + (".", ".", ".", "", " |", "!")[int(rng.integers(0, 6))]


def labelled_page(rng) -> tuple[str, list[int]]:
    """One page and the label of each of its blocks, in order."""
    parts: list[str] = []
    labels: list[int] = []

    def pick(*options: str) -> str:
        return options[int(rng.integers(0, len(options)))]

    def put(label: int, markup: str, close: str = "") -> None:
        parts.append(markup + close)
        labels.append(label)

    def menu(open_: str, close: str) -> None:
        parts.append(open_)
        if rng.random() < 0.75:
            parts.append("<ul>")
            for _ in range(int(rng.integers(2, 8))):
                put(0, f'<li><a href="/x">{_sentence(rng, 1, 3)}</a>', pick("</li>", "</li>", ""))
            parts.append("</ul>")
        else:
            put(0, " ".join(f'<a href="/x">{_sentence(rng, 1, 3)}</a>' for _ in range(4)))
        parts.append(close)

    def aside_like(names: tuple[str, ...]) -> None:
        name = pick(*names)
        tag = pick("div", "div", "section", "aside", "p") if name not in ("aside", "footer", "nav", "form") else name
        attr = pick("class", "class", "id") + f'="{name}{pick("", "-box", " wide", "-" + str(rng.integers(1, 9)))}"' if tag != name or rng.random() < 0.3 else ""
        parts.append(f"<{tag} {attr}>")
        if tag == "p":
            put(0, _sentence(rng, 3, 25))
        else:
            for _ in range(int(rng.integers(1, 4))):
                put(0, f"<{pick('p', 'div', 'p', 'h3')}>{_sentence(rng, 2, 40)}", "")
        parts.append(f"</{tag}>")

    def made_up() -> str:
        return "-".join("".join(_SYLLABLES[int(k)] for k in rng.integers(0, len(_SYLLABLES), rng.integers(1, 4))) for _ in range(int(rng.integers(1, 3))))

    def attributes() -> str:
        """Sometimes a class or id of an article's part or one that no page has."""
        r = rng.random()
        if r < 0.4:
            return ""
        odd = pick("", "", ' title="a < b"', " data-x='<i>'")
        return f' {pick("class", "class", "id")}="{pick(*_INNER) if r < 0.8 else made_up()}"{odd}'

    def line(low: int, high: int) -> str:
        text = _sentence(rng, low, high)
        r = rng.random()
        if r < 0.06:
            return pick("&copy; ", "© ", "Copyright ") + text
        if r < 0.12:
            return f'<a href="/y">{text}</a>'
        return f'{text} <img alt="x < y" src="z"> {_sentence(rng, 1, 4)}' if r < 0.15 else text

    def inner_part() -> None:
        """One of the flow elements that an article may hold."""
        kind = int(rng.integers(0, 11))
        if kind == 0:
            put(1, f"<{(h := pick('h2', 'h3', 'h4', 'h5', 'h6'))}{attributes()}>{line(1, 9)}", f"</{h}>")
        elif kind == 1:
            parts.append(f'<figure{attributes()}><img src="x" alt="a > b">')
            put(1, f"<figcaption{attributes()}>{line(2, 20)}", "</figcaption></figure>")
        elif kind == 2:
            parts.append(f"<dl{attributes()}>")
            for _ in range(int(rng.integers(1, 4))):
                put(1, f"<dt>{line(1, 4)}", pick("</dt>", ""))
                put(1, f"<dd>{line(2, 20)}", pick("</dd>", ""))
            parts.append("</dl>")
        elif kind in (3, 4):
            put(1, f"<div{attributes()}>{line(1, 40)}", "</div>")
        elif kind in (5, 6):
            tag = pick("section", "div", "div", "details")
            parts.append(f"<{tag}{attributes()}>")
            if tag == "details":
                put(1, f"<summary>{line(1, 6)}", "</summary>")
            for _ in range(int(rng.integers(1, 4))):
                put(1, f"<{(t := pick('p', 'p', 'h3', 'div'))}{attributes()}>{line(2, 40)}", f"</{t}>")
            parts.append(f"</{tag}>")
        elif kind in (7, 8):
            put(1, f"<p{attributes()}>{line(1, 40)}", "</p>")
        elif kind == 9:
            put(1, f"<{(t := pick('pre', 'address', 'blockquote'))}{attributes()}>{line(2, 25)}", f"</{t}>")
        else:
            tag = pick("ol", "ul")
            parts.append(f"<{tag}{attributes()}>")
            for _ in range(int(rng.integers(1, 5))):
                put(1, f"<li{attributes()}>{line(1, 25)}", pick("</li>", ""))
            parts.append(f"</{tag}>")

    def outer_part() -> None:
        """The same elements where they are no article: a part named as one of those that go."""
        name = pick(*_OUTER)
        tag = pick("div", "div", "section", name if name in ("header", "footer", "nav", "aside", "form") else "div")
        attr = "" if tag == name else f' {pick("class", "class", "id")}="{name}{pick("", "", "-area", "-" + made_up(), " " + made_up())}"'
        parts.append(f"<{tag}{attr}>")
        if rng.random() < 0.3:
            put(0, f"<{(t := pick('h2', 'h3', 'h4', 'p'))}>{line(1, 5)}", f"</{t}>")
            parts.append("<ul>")
            for _ in range(int(rng.integers(1, 5))):
                put(0, f'<li><a href="/z">{_sentence(rng, 1, 8)}</a>', pick("</li>", ""))
            parts.append(f"</ul></{tag}>")
            return
        for _ in range(int(rng.integers(1, 4))):
            t = pick("p", "p", "div", "h3", "h4", "li", "dd", "span", "address", "figcaption", "section")
            own = f' class="{pick(*_INNER[:40]) if rng.random() < 0.5 else made_up()}"' if rng.random() < 0.3 else ""
            put(0, f"<{t}{own}>{line(1, 30)}", f"</{t}>" + ("<hr>" if t == "span" else ""))
        parts.append(f"</{tag}>")

    def advert() -> None:
        if rng.random() < 0.5:
            put(0, f'<div class="{pick("ad", "ads", "advert", "banner", "sponsored", "promo")}">{_sentence(rng, 3, 30)}</div>')
        else:
            aside_like(("ad", "advert", "sponsor", "promo", "banner"))

    parts.append(f"<!DOCTYPE html><html><head><title>{_sentence(rng, 3, 9)}</title><style>p{{}}</style></head><body>")
    if rng.random() < 0.3:
        aside_like(("cookie", "cookie-notice", "notice", "consent", "gdpr"))
    if rng.random() < 0.4:
        parts.append("<header>")
        put(0, f"<{pick('div', 'h1', 'p')}>{_sentence(rng, 1, 6)}", "")
        parts.append("</header>")
    if rng.random() < 0.85:
        menu(*pick_pair(rng, ("<nav>", "</nav>"), ("<nav>", "</nav>"), ('<div class="menu">', "</div>"), ('<div id="navbar">', "</div>"), ('<ul class="nav">', "</ul>")))
    if rng.random() < 0.5:
        advert()
    if rng.random() < 0.3:
        outer_part()
    if rng.random() < 0.1:
        put(0, f"<noscript>{pick('', '<p>')}{_sentence(rng, 3, 15)}", "</noscript>")
    if rng.random() < 0.25:
        aside_like(("sidebar", "aside", "widget", "related"))
    wrap = rng.random() < 0.3
    if wrap:
        parts.append(pick('<div class="wrapper">', '<div id="page">', "<main>", '<div class="container">'))
    open_, close = pick_pair(rng, ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div class="article-body">', "</div>"), ('<div id="post">', "</div>"), ('<section class="story entry-content">', "</section>"), ('<article class="post">', "</article>"), ('<div class="post-content">', "</div>"), ('<div role="main">', "</div>"), ('<main id="content"><div class="text">', "</div></main>"), ('<div class="entry">', "</div>"), ('<div id="main"><div class="story">', "</div></div>"), (f"<article{attributes()}>", "</article>"))
    parts.append(open_)
    varied = rng.random() < 0.6
    if rng.random() < 0.8:
        put(1, f"<h1>{_sentence(rng, 2, 12)}", "</h1>")
    for _ in range(int(rng.integers(1, 12))):
        if varied and rng.random() < 0.5:
            inner_part()
            continue
        if varied and rng.random() < 0.2:
            outer_part()
            continue
        r = rng.random()
        if r < 0.01:
            # a run of short paragraphs
            same = _sentence(rng, 1, 6)
            for _ in range(int(rng.integers(5, 60))):
                put(1, f"<p>{same}", "</p>")
        elif r < 0.72:
            formula = "<math><mi>x</mi><mo>=</mo><mn>2</mn></math> " if rng.random() < 0.05 else ""
            put(1, f"<p>{formula}{_sentence(rng, 1, 70)}", pick("</p>", "</p>", "</p>", "", "<br>"))
        elif r < 0.78:
            put(1, f"<p><b>{_sentence(rng, 2, 30)}<br>", "")
        elif r < 0.84:
            put(1, f"<h2>{_sentence(rng, 2, 8)}", "</h2>")
        elif r < 0.88:
            parts.append("<ul>")
            for _ in range(int(rng.integers(2, 5))):
                put(1, f"<li>{_sentence(rng, 2, 12)}", "</li>")
            parts.append("</ul>")
        elif r < 0.91:
            put(1, f"<blockquote>{_sentence(rng, 5, 30)}", "</blockquote>")
        elif r < 0.915:
            put(1, f"<noscript><p>{_sentence(rng, 5, 30)}", "</p></noscript>")
        elif r < 0.93:
            parts.append("<table><tr>")
            for _ in range(3):
                put(1, f"<td>{_sentence(rng, 1, 5)}", "</td>")
            parts.append("</tr></table>")
        elif r < 0.96:
            advert()
        elif r < 0.98:
            aside_like(("share", "social", "newsletter", "related", "subscribe"))
        else:
            parts.append("<form>")
            put(0, f"<p>{_sentence(rng, 2, 9)}", "</p>")
            parts.append("</form>")
    inner = rng.random() < 0.15
    if not inner:
        parts.append(close)
    if rng.random() < 0.35:
        parts.append(pick('<section id="comments">', '<div class="comments">', '<div class="comment-list">', '<ol class="comments">', '<div id="comments">', '<div id="responses">', '<section class="discussion">'))
        for _ in range(int(rng.integers(1, 5))):
            put(0, f'<{pick("p", "div", "li")}{pick(" class=comment", " class=comment", "", attributes())}>{_sentence(rng, 2, 50)}', "")
        parts.append("</section></div></ol>")
    if inner:
        parts.append(close)
    if wrap:
        parts.append("</div></main>")
    if rng.random() < 0.2:
        aside_like(("form", "newsletter", "subscribe", "login", "search"))
    if rng.random() < 0.25:
        aside_like(("sidebar", "aside", "related", "widget"))
    for _ in range(int(rng.integers(0, 3))):
        outer_part()
    if rng.random() < 0.85:
        tag = pick("footer", "footer", "footer", 'div class="footer"', 'div id="footer"')
        parts.append(f"<{tag}>")
        put(0, pick("", "<p>", "<div>") + pick("&copy; site.example &middot; ", "Copyright ", "") + _sentence(rng, 2, 30))
        if rng.random() < 0.3:
            put(0, f'<p><a href="/">{_sentence(rng, 1, 4)}</a>', "</p>")
        parts.append(f"</{tag.split()[0]}></body></html>")
    return "".join(parts), labels


def pick_pair(rng, *options: tuple[str, str]) -> tuple[str, str]:
    return options[int(rng.integers(0, len(options)))]


@functools.lru_cache(maxsize=1)
def trained(n_pages: int = 1500, steps: int = 700, batch: int = 32) -> dict[str, np.ndarray]:
    """Parameters after Adam steps on the block labels; the same on every run."""
    rng = np.random.default_rng(7)
    made = [labelled_page(rng) for _ in range(n_pages)]
    read = [(blocks(page), np.array(labels)) for page, labels in made]
    read = [(b, y) for b, y in read if len(b) == len(y)]
    xs, ys = vectors([b for b, _ in read]), [y for _, y in read]
    p = bilstm.new_params(rng, DIMS, HIDDEN, 2)
    p["wf"][:, :-1] *= 0.5
    p["wb"][:, :-1] *= 0.5
    adam = bilstm.Adam(p)
    for step in range(steps):
        some = rng.integers(0, len(xs), batch).tolist()
        e, kept, (x, back), index, lengths = project(p, [xs[i] for i in some])
        q = np.exp(e - e.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        for k, i in enumerate(some):
            q[np.arange(lengths[k]), ys[i], k] -= 1
            q[lengths[k] :, :, k] = 0
        g, dzf, dzb = bilstm.emission_grads(p, q / lengths.sum(), kept, index)
        g["trans"] = np.zeros_like(p["trans"])
        g["wf"] = np.einsum("tzb,tdb->zd", dzf, x)
        g["wb"] = np.einsum("tzb,tdb->zd", dzb, back)
        adam.update(g, 0.02 if step < steps * 0.7 else 0.005)
    return p


def main_texts(pages: list[str], labeller: Labeller) -> list[str]:
    read = [blocks(p) for p in pages]
    return ["\n".join(t for (_, t, _), s in zip(own, margin, strict=True) if s > 0) for own, margin in zip(read, labeller.scores(vectors(read)), strict=True)]


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    Null and empty html and pages without main text give an empty text. Repeated rows give repeated
    results; null page_ids and urls stay null; extra columns are ignored.
    """
    params = trained()

    def run(batch, labeller):
        sources = texts_of(batch, "html")
        texts = [t for a, b in slices(sources, SLICE) for t in main_texts(sources[a:b], labeller)]
        yield batch.column("page_id"), batch.column("url"), texts, [len(t) for t in texts]

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long", lambda: Labeller(params))


def op9_block_bilstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages", "page_id", "url", "html"))


QUERIES = {"op9_block_bilstm": op9_block_bilstm}
