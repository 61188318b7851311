"""Main text of HTML pages: a linear-chain conditional random field over the leaf blocks of the document tree."""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Hashed features, labelled pages, passes over them, step length and weight decay of training.
FEATURES, PAGES, PASSES, RATE, DECAY = 1 << 14, 500, 8, 0.2, 1e-4

# Names of HTML elements by their part in the tree.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle semantics".split()
)
MATH = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle semantics".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol "
    "p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
SVG = re.compile(r"<(/?)svg(?=[\s/>])((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.I)
#: Features that the open elements of a block have at most; elements further in add none beyond them.
AROUND = 512
LISTS = ("ul", "ol", "dl", "table", "select")
WORDS = re.compile(r"[a-z]+")
NAME = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Place:
    """An open block element: its tag, the way of tags that leads to it, and what is known of all elements around.

    Elements share what their parents know, so depth costs nothing that a page's length does not.
    """

    __slots__ = ("around", "features", "tag", "way")

    def __init__(self, tag: str, way: int, around: frozenset[str]) -> None:
        self.tag, self.way, self.around = tag, way, around
        self.features: tuple[int, ...] | None = None


@dataclass
class Block:
    """A leaf block: its text, the part of it in links, and the element it stands in."""

    text: str
    linked: int
    place: Place


class Tree:
    """The open elements while a page is read: where each tag is open, and the place of the innermost block element."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, Place]] = []
        self.open: dict[str, list[int]] = {}
        self.ways: dict[tuple[int, str], int] = {}
        self.root = Place("", 0, frozenset())
        self.known: dict[tuple[int, str], tuple[int, ...]] = {}

    def place(self) -> Place:
        return self.stack[-1][1] if self.stack else self.root

    def push(self, tag: str, names: str) -> None:
        outer = self.place()
        inner = outer
        if tag not in INLINE:
            way = self.ways.setdefault((outer.way, tag), len(self.ways) + 1)
            new = {f"in {tag}", *(f"named {w}" for w in WORDS.findall(names))} - outer.around
            inner = Place(tag, way, outer.around | new if new and len(outer.around) < AROUND else outer.around)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, inner))

    def last(self, tags) -> int:
        """Where the innermost open element of these tags is, -1 without any."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def pop(self) -> str:
        tag, _ = self.stack.pop()
        self.open[tag].pop()
        return tag


def drawings(source: str) -> dict[int, int]:
    """Where svg elements end, by the end of their start tags; those that never end are left out."""
    ends, inside = {}, []
    for match in SVG.finditer(source):
        if not match[1]:
            if not match[2].endswith("/"):
                inside.append(match.end())
        elif inside:
            ends[inside.pop()] = match.end()
    return ends


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order: runs of text between the borders of block elements.

    Character references are decoded, white space inside a block (line breaks too) becomes one space, empty blocks
    are left out. Scripts, styles, drawings, comments, titles and other markup hold no blocks; formulas are part of theirs. Paragraphs, list items and cells
    end where HTML lets them; stray end tags are ignored, and what is open at the end is closed.
    """
    out: list[Block] = []
    tree = Tree()
    held: list[str] = []
    linked = 0
    links = 0
    source = page or ""
    svg_ends: dict[int, int] | None = None

    def flush() -> None:
        nonlocal linked
        if held:
            text = "".join(held)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(text, min(linked, len(text)), tree.place()))
            held.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal links
        while len(tree.stack) > upto:
            if tree.stack[-1][0] not in INLINE:
                flush()
            links -= tree.pop() == "a"

    at, end = 0, len(source)
    while at < end:
        match = PART.search(source, at)
        text = source[at : match.start() if match else end]
        if text:
            held.append(text)
            if links:
                linked += len(text)
        if not match:
            break
        at = match.end()
        tag = match[2]
        if tag is None:
            continue
        tag = tag.lower()
        if match[1]:
            if tree.open.get(tag):
                close(tree.open[tag][-1])
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(source, at)
            at = stop.end() if stop else end
            continue
        if tag == "svg":
            if svg_ends is None:
                svg_ends = drawings(source)
            at = at if match[3].endswith("/") else svg_ends.get(at, at)
            continue
        if tag in MATH and match[3].endswith("/"):
            continue
        if tag in VOID:
            if tag in INLINE:
                held.append(" " if tag == "br" else "")
            else:
                flush()
            continue
        if tag in ENDS_PARAGRAPH:
            if tree.open.get("p"):
                close(tree.open["p"][-1])
        elif tag in SIBLINGS:
            before = tree.last(SIBLINGS[tag])
            if before > tree.last(LISTS):
                close(before)
        if tag not in INLINE:
            flush()
        elif tag == "a":
            links += 1
        attributes = match[3]
        names = " ".join(x[1] or x[2] or x[3] for x in NAME.findall(attributes)) if "=" in attributes else ""
        tree.push(tag, names.lower())
    flush()
    for place in (b.place for b in out):
        if place.features is None:
            key = (id(place.around), place.tag)
            if key not in tree.known:
                tree.known[key] = placed(place)
            place.features = tree.known[key]
    return out


#: Words in short blocks that tell the furniture of pages from prose.
TELLING = re.compile(
    r"©|\(c\)|copyright|cookie|privacy|subscribe|newsletter|sign ?up|log ?in|share|read more|related|comment|repl(?:y|ies)|advert"
    r"|sponsor|all rights|menu|search|terms"
)


@functools.lru_cache(1 << 16)
def hashed(key: str) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) % FEATURES


def placed(place: Place) -> tuple[int, ...]:
    """Features of the open elements: each tag, each word of a class, id or role, and the innermost tag."""
    return tuple(sorted(map(hashed, place.around | {"bias", f"leaf {place.tag}"})))


@functools.lru_cache(1 << 14)
def shaped(leaf: str, size: int, dense: int, ends: str, place: int, same: bool) -> tuple[int, ...]:
    """Features of a block's shape: words, share of links, last character, and its place."""
    keys = [f"size{size}", f"links{dense}", f"ends{ends}", f"leaf {leaf} {size}", f"links{dense} {size}", f"place{place}"]
    return tuple(map(hashed, keys + ["same as before"] * same))


def features(found: list[Block]) -> list[list[int]]:
    """Hashed features of each block: ancestors and their names, shape of the text, and the place in the page."""
    rows = []
    last = max(len(found) - 1, 1)
    before = -1
    for i, b in enumerate(found):
        words = b.text.count(" ") + 1
        end = b.text[-1]
        ends = end if end in ".!?:;,…" else "a" if end.isalnum() else "o"
        row = [*b.place.features, *shaped(b.place.tag, min(words.bit_length(), 9), int(4 * b.linked / len(b.text)), ends, int(4 * i / last), b.place.way == before)]
        if words < 60:
            row += [hashed(f"says {w}") for w in set(TELLING.findall(b.text.lower()))]
        rows.append(row)
        before = b.place.way
    return rows


@dataclass
class Field:
    """State weights (feature by label) and transition weights of a chain of labels, 1 for main text."""

    state: np.ndarray
    move: np.ndarray

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        ends = np.cumsum([0, *map(len, rows[:-1])])
        return np.add.reduceat(self.state[[x for r in rows for x in r]], ends, axis=0)

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The most likely labels (Viterbi); label 0 wins ties."""
        if not rows:
            return []
        (best0, best1), *rest = self.scores(rows).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        back = []
        for s0, s1 in rest:
            a, b, c, d = best0 + m00, best1 + m10, best0 + m01, best1 + m11
            back.append((int(b > a), int(d > c)))
            best0, best1 = max(a, b) + s0, max(c, d) + s1
        label = int(best1 > best0)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def expected(scores: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of labels and of neighbouring labels, summed, by forward and backward sums."""
    n = len(scores)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = scores[0]
    for i in range(1, n):
        ahead[i] = scores[i] + np.logaddexp.reduce(ahead[i - 1][:, None] + move, axis=0)
    for i in range(n - 2, -1, -1):
        behind[i] = np.logaddexp.reduce(move + scores[i + 1] + behind[i + 1], axis=1)
    whole = np.logaddexp(*ahead[-1])
    both = ahead[:-1, :, None] + move[None] + (scores[1:] + behind[1:])[:, None, :] - whole
    return np.exp(ahead + behind - whole), np.exp(both).sum(axis=0)


def train(pages: list[tuple[str, list[int]]], passes: int = PASSES) -> Field:
    """Maximum likelihood by stochastic gradient steps over labelled pages (html and the label of each block)."""
    field = Field(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    ready = [(features(blocks(page)), labels) for page, labels in pages]
    squares, move_squares = np.full((FEATURES, 2), 1e-2), np.full((2, 2), 1e-2)
    order = random.Random(1)
    for _ in range(passes):
        order.shuffle(ready)
        for rows, labels in ready:
            if not rows:
                continue
            marginal, moves = expected(field.scores(rows), field.move)
            wanted = np.eye(2)[labels]
            step = wanted - marginal
            seen = np.array([x for r in rows for x in r])
            own = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            gradient = np.zeros((FEATURES, 2))
            np.add.at(gradient, seen, step[own])
            touched = np.unique(seen)
            g = gradient[touched] - DECAY * field.state[touched]
            squares[touched] += g * g
            field.state[touched] += RATE * g / np.sqrt(squares[touched])
            true = np.zeros((2, 2))
            np.add.at(true, (labels[:-1], labels[1:]), 1)
            move_squares += (true - moves) ** 2
            field.move += RATE * (true - moves) / np.sqrt(move_squares)
    return field


# --- labelled pages ------------------------------------------------------------------


class PageMaker:
    """Labelled pages: an article among the furniture of web pages, in the layouts and names that sites use.

    Words are random syllables, so that nothing is learnt from any language's vocabulary; layouts range from plain
    semantic elements to nested ``div`` elements with class names only.
    """

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice("an er on st re in th or be ou la qu ti de ñe üb é".split()) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def prose(self) -> str:
        out = []
        for _ in range(self.r.choice((1, 1, 2, 3, 6))):
            s = self.words(1, 22).capitalize()
            if self.r.random() < 0.08:
                s = " ".join(w + self.r.choice(("###", "&amp;&amp;", "$$$", "%%%")) for w in s.split())
            if self.r.random() < 0.1:
                s = s.replace(" ", f' <a href="/{self.word()}">{self.word()}</a> ', 1)
            if self.r.random() < 0.1:
                s = f"<b>{s}</b>" if self.r.random() < 0.5 else f"<b>{s}"
            if self.r.random() < 0.05:
                s = s.upper()
            if self.r.random() < 0.05:
                s += self.r.choice((' <svg class="icon" viewBox="0 0 9 9"/>', " <svg><svg><path d='M0'/></svg></svg>", f" <math><mi>{self.word()}</mi><mo/></math>"))
            out.append(s + self.r.choice((".", ".", ".", "!", "?", "")))
        return self.r.choice((" ", " ", "<br>")).join(out)

    def article(self) -> list[tuple[str, int]]:
        if self.r.random() < 0.1:
            # A short notice of news: sentences in boxes, nothing else.
            long = lambda: " ".join(self.words(6, 22).capitalize() + "." for _ in range(self.r.randint(2, 4)))
            return [(f"<div>{long()}</div>", 1) for _ in range(self.r.randint(1, 3))]
        parts = [(f"<h1>{self.words(1, 9)}</h1>", 1)] if self.r.random() < 0.85 else []
        for _ in range(self.r.choice((1, 2, 3, 5, 9, 16))):
            kind = self.r.random()
            if kind < 0.78:
                parts.append((f"<p>{self.prose()}" + self.r.choice(("</p>", "</p>", "")), 1))
            elif kind < 0.86:
                parts.append((f"<h{self.r.choice('234')}>{self.words(1, 6)}</h2>", 1))
            elif kind < 0.93:
                items = [(f"<li>{self.prose()}</li>", 1) for _ in range(self.r.randint(2, 5))]
                parts += [("<ul>", -1), *items, ("</ul>", -1)]
            elif kind < 0.95:
                parts.append((f"<blockquote>{self.prose()}</blockquote>", 1))
            elif kind < 0.96:
                parts += [("<figure><img src=x>", -1), (f"<figcaption>{self.words(2, 12)}</figcaption>", 1), ("</figure>", -1)]
            elif kind < 0.97:
                rows = [(f"<tr><td>{self.words(1, 4)}</td>", 1) for _ in range(self.r.randint(2, 4))]
                parts += [("<table>", -1), *rows, ("</table>", -1)] if self.r.random() < 0.5 else [(f"<pre>{self.words(3, 30)}</pre>", 1)]
            else:
                tag = self.r.choice(("noscript", "object"))
                parts.append((f"<{tag}><p>{self.prose()}</p></{tag}>", 1))
        return self.arranged(parts)

    def arranged(self, parts: list[tuple[str, int]]) -> list[tuple[str, int]]:
        """The article as it is, with a header of its own, in sections, or with paragraphs that are boxes only."""
        r = self.r
        style = r.random()
        if style < 0.2 and not any(x == -1 for _, x in parts):
            box = r.choice(("div", "div", "span")) if len(parts) == 1 else "div"
            parts = [(re.sub(r"^<p>(.*?)(?:</p>)?$", rf"<{box}>\1</{box}>", t, flags=re.S) if t.startswith("<p>") else t, x) for t, x in parts]
        elif style < 0.35 and parts[0][0].startswith("<h1"):
            lead = [(f"<p>{self.words(2, 12)}</p>", 1)] if r.random() < 0.7 else []
            parts = [("<header>", -1), parts[0], *lead, ("</header>", -1), *parts[1:]]
        if r.random() < 0.2 and len(parts) > 2:
            at = 1
            name = r.choice(("", f' class="{self.word()}"', ' class="section"'))
            head = [(f"<h2>{self.words(1, 6)}</h2>", 1)] if r.random() < 0.5 else []
            depth = [i for i in range(1, len(parts)) if sum((t[1] != "/") * 2 - 1 for t, x in parts[:i] if x == -1 and not t.startswith("<figure><")) == 0]
            at = r.choice(depth) if depth else 0
            tag = r.choice(("section", "section", "div"))
            parts = [*parts[:at], (f"<{tag}{name}>", -1), *head, *parts[at:], (f"</{tag}>", -1)]
        return parts

    def boxed(self, tag: str, names: str, inner: list[tuple[str, int]], unknown: float = 0.0) -> list[tuple[str, int]]:
        """``inner`` in an element with one of the names, or with none that means anything."""
        name = self.word() if self.r.random() < unknown else self.r.choice(names.split())
        given = self.r.choice((f' class="{name}"', f' id="{name}"', f' class="{name} {self.word()}"'))
        return [(f"<{tag}{given}>", -1), *inner, (f"</{tag}>", -1)]

    def links(self) -> list[tuple[str, int]]:
        items = [(f'<li><a href="/{self.word()}">{self.words(1, 3)}</a></li>', 0) for _ in range(self.r.randint(2, 8))]
        return [("<ul>", -1), *items, ("</ul>", -1)]

    def furniture(self, kind: str) -> list[tuple[str, int]]:
        r, p = self.r, lambda text: (f"<p>{text}</p>", 0)
        plain = r.random() < 0.45
        if kind == "nav":
            return [("<nav>", -1), *self.links(), ("</nav>", -1)] if plain else self.boxed(r.choice(("div", "nav")), "menu nav navigation topnav breadcrumb navbar", self.links(), 0.3)
        if kind == "header":
            inner = [(f"<div>{self.words(1, 5)}</div>", 0), p(self.words(2, 8))]
            return [("<header>", -1), *inner, ("</header>", -1)] if plain else self.boxed("div", "header masthead banner site-header top", inner)
        if kind == "ad":
            text = self.prose()
            return self.boxed(r.choice(("div", "aside", "section")), "ad ads advert advertisement sponsored promo banner-ad", [(text, 0) if r.random() < 0.6 else p(text)])
        if kind == "aside":
            inner = [(f"<h3>{self.words(1, 4)}</h3>", 0), *(self.links() if r.random() < 0.6 else [p(self.prose())])]
            return [("<aside>", -1), *inner, ("</aside>", -1)] if plain else self.boxed("div", "sidebar related widget recommended side-column more-stories", inner, 0.3 if any("<a " in t for t, _ in inner) else 0.0)
        if kind == "notice":
            return self.boxed(r.choice(("div", "section", "aside")), "cookie cookie-notice notice consent gdpr alert subscribe newsletter popup", [p(self.prose())])
        if kind == "form":
            inner = [(f"<label>{self.words(1, 3)}</label><input>", 0), (f"<button>{self.words(1, 2)}</button>", 0)]
            return [("<form>", -1), *inner, ("</form>", -1)] if plain else self.boxed("form", "search login signup contact", inner)
        if kind == "comments":
            inner = [(f"<h2>{self.words(1, 3)}</h2>", 0)] if r.random() < 0.5 else []
            for _ in range(r.randint(1, 5)):
                inner += self.boxed(r.choice(("div", "li", "article")), "comment reply user-comment comment-body", [p(self.prose())])
            return self.boxed(r.choice(("section", "div", "ol")), "comments comment-list discussion replies responses", inner)
        text = r.choice((f"&copy; {self.words(1, 4)}", f"© 2024 {self.words(1, 3)}", self.prose(), self.words(2, 9)))
        return [("<footer>", -1), (text, 0) if r.random() < 0.5 else p(text), ("</footer>", -1)] if plain else self.boxed("div", "footer site-footer bottom colophon copyright", [p(text)])

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        before = [k for k, s in (("header", 0.5), ("nav", 0.9), ("notice", 0.3), ("form", 0.2), ("ad", 0.5), ("aside", 0.2)) if r.random() < s]
        after = [k for k, s in (("ad", 0.3), ("aside", 0.4), ("comments", 0.4), ("form", 0.2), ("footer", 0.9), ("notice", 0.2)) if r.random() < s]
        body = self.article()
        for kind in ("ad", "aside", "form"):
            if r.random() < 0.15 and len(body) > 3 and not any(x == -1 for _, x in body):
                at = r.randint(2, len(body) - 1)
                body[at:at] = self.furniture(kind)
        style = r.random()
        if style < 0.45:
            body = [("<article>", -1), *body, ("</article>", -1)]
        elif style < 0.6:
            body = [("<main>", -1), *body, ("</main>", -1)]
        elif style < 0.9:
            body = self.boxed("div", "content article post entry main article-body story text post-content", body, 0.3)
        if r.random() < 0.3:
            body = self.boxed("div", "container wrapper page layout row site", body, 0.3)
        parts = [x for k in before for x in self.furniture(k)] + body + [x for k in after for x in self.furniture(k)]
        head = f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><style>p{{margin:0}}</style></head><body>"
        page = head + self.r.choice(("", "\n")).join(t for t, _ in parts) + "</body></html>"
        return page, self.labels(parts)

    def labels(self, parts: list[tuple[str, int]]) -> list[int]:
        """The label of each block: that of the part whose text it begins with."""
        return [label for text, label in parts if label >= 0 for _ in blocks(text)]


def labelled_pages(count: int = PAGES, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages whose blocks are those of their parts, so that every block has its label."""
    maker, out = PageMaker(seed), []
    while len(out) < count:
        page, labels = maker.page()
        if len(blocks(page)) == len(labels):
            out.append((page, labels))
    return out


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, field.decode(features(found)), strict=True) if label)


def extracted(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of the main text of every row of ``pages`` (page_id, url, html).

    The field is trained on PAGES labelled pages unless one is given, and sent to all tasks: FEATURES by 2 weights.
    Null, empty and text-free pages give empty texts; rows without page_id and repeated rows are read like others.
    """
    sent = pages.sparkSession.sparkContext.broadcast(field or train(labelled_pages()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts = [main_text(t.as_py(), sent.value) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    columns = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return columns.mapInArrow(run, "page_id long, url string, text string, n_chars long")
