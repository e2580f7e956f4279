"""Main text of web pages: a linear-chain conditional random field over the
leaf blocks of the DOM.

A page becomes the sequence of its leaf blocks, the runs of text between two
block-level tags. A block's features are its ancestors' tags and classes and its
text: length, words, share of link text, closing punctuation, digits, place.
Ancestors are kept as a tree of open elements, each with the features that it
adds to those of its parent, so that time and memory are linear in a page however
deep its markup is nested.
The field has two labels, content and boilerplate, with a weight for each
feature and label and for each pair of neighbouring labels; it is trained by
stochastic gradient ascent on the conditional likelihood (forward-backward) and
decoded by Viterbi.

Labelled pages are those whose authors marked the content with the landmark
elements article or main: blocks inside are content, others are not. Landmarks
are no features, so the field learns what content looks like and applies to
pages without them. At most `train_pages` pages are used, drawn by a hash of
page_id, each whole.

Defined results: null, empty and textless html gives an empty text and 0 blocks;
malformed markup is read as far as it goes (an unclosed comment, script or tag
hides the rest; an inline element closed out of order counts until what it holds
is closed); very long pages are read whole; a null page_id is carried through,
repeated rows are rows; of equally likely labels boilerplate is taken; with no
labelled page, as in an empty table, there is no model and no block is content;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 400
EPOCHS = 8
RATE = 0.3
DECAY = 1e-4
EXTRACTED = "text string, blocks int, kept int"
LANDMARKS = frozenset(("article", "main"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<", re.S)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo br cite code data dfn em font i img kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
_RAW = frozenset(("script", "style", "noscript", "template", "textarea", "svg"))
#: An opening tag of these closes an open p; li, dt, dd, tr, td, th and option close their like.
_CLOSES_P = frozenset("address article aside blockquote center div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    """An open element: what it adds to its ancestors' features."""

    parent: int
    tag: str  # of the nearest element that is neither inline nor a landmark
    adds: tuple[str, ...]
    inside: bool


@dataclass
class Block:
    text: str
    node: int
    link_chars: int


@dataclass
class Page:
    """Leaf blocks in their order, and the elements around them; a parent comes before its children."""

    blocks: list[Block]
    nodes: list[Node]

    def inside(self) -> list[int]:
        """1 for each block within a landmark."""
        return [int(self.nodes[b.node].inside) for b in self.blocks]


class _Reader:
    def __init__(self) -> None:
        self.page = Page([], [Node(-1, "", (), False)])
        self.stack: list[tuple[str, int, tuple[str, ...]]] = []  # tag, node, features that it added
        self.open: Counter[str] = Counter()
        self.shut: Counter[str] = Counter()  # inline elements closed while others in them are open
        self.active: set[str] = set()
        self.pieces: list[str] = []
        self.linked = 0

    @property
    def node(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(self.pieces))).strip()
        if text:
            self.page.blocks.append(Block(text, self.node, min(self.linked, len(text))))
        self.pieces.clear()
        self.linked = 0

    def push(self, tag: str, marks: list[str]) -> None:
        above = self.page.nodes[self.node]
        block = tag not in _INLINE and tag not in LANDMARKS
        adds = tuple(f for f in dict.fromkeys(([f"under:{tag}"] if block else []) + [f"mark:{m}" for m in marks]) if f not in self.active)
        self.page.nodes.append(Node(self.node, tag if block else above.tag, adds, above.inside or tag in LANDMARKS))
        self.stack.append((tag, len(self.page.nodes) - 1, adds))
        self.active.update(adds)
        self.open[tag] += 1

    def pop(self) -> str:
        tag, _, adds = self.stack.pop()
        self.active.difference_update(adds)
        if self.shut[tag]:
            self.shut[tag] -= 1
        else:
            self.open[tag] -= 1
        return tag

    def pop_to(self, names: tuple[str, ...]) -> None:
        if any(self.open[t] for t in names):
            self.flush()
            while self.pop() not in names:
                pass

    def close_inline(self, tag: str) -> None:
        if self.open[tag]:
            if self.stack[-1][0] == tag:
                self.pop()
            else:
                self.open[tag] -= 1
                self.shut[tag] += 1


def parse(page: str | None) -> Page:
    """The leaf blocks of a page."""
    r = _Reader()
    page = page or ""
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if page[m.start()] != "<" or at == m.start() + 1:
                r.pieces.append(m.group())
                if r.open["a"]:
                    r.linked += len(m.group().strip())
            continue
        tag = tag.lower()
        if m.group(1):
            r.close_inline(tag) if tag in _INLINE else r.pop_to((tag,))
            continue
        if tag in _RAW:
            close = re.compile(f"</{tag}", re.I).search(page, at)
            at = end if close is None else (page.find(">", close.end()) + 1 or end)
            continue
        if tag in _CLOSES_P:
            r.pop_to(("p",))
        if tag in _CLOSES_LIKE:
            r.pop_to(_CLOSES_LIKE[tag])
        if tag == "br":
            r.pieces.append("\n")
        elif tag not in _INLINE:
            r.flush()
        if tag not in _VOID:
            r.push(tag, [w.lower() for _, a, b, c in _NAMED.findall(m.group(3)) for w in (a or b or c).split()] if m.group(3) else [])
    r.flush()
    return r.page


def _size(n: int) -> int:
    return n.bit_length()


def features(page: Page) -> list[list[str]]:
    """Names of the features of each block, without those that its ancestors add."""
    out, last = [], len(page.blocks) - 1
    for i, b in enumerate(page.blocks):
        words = b.text.split()
        letters = max(1, len(b.text))
        f = ["one", f"len{_size(letters)}", f"words{_size(len(words))}", f"link{round(4 * b.link_chars / letters)}"]
        f += [f"tag:{page.nodes[b.node].tag}", f"digits{min(3, round(10 * sum(map(str.isdigit, b.text)) / letters))}"]
        f.append("ends:" + (b.text[-1] if b.text[-1] in ".!?:;,|" else "other"))
        f.append("upper" if b.text[:1].isupper() else "lower")
        if b.text[:1] in "©®" or "copyright" in b.text[:40].lower():
            f.append("copyright")
        f.append("first" if i == 0 else "last" if i == last else "middle")
        out.append(f)
    return out


@dataclass
class Model:
    names: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def coded(self, found: list[list[str]]) -> list[list[int]]:
        return [[self.names[n] for n in f if n in self.names] for f in found]

    def emissions(self, page: Page) -> np.ndarray:
        return self.scores(page, self.coded(features(page)), self.coded([n.adds for n in page.nodes]))

    def scores(self, page: Page, own: list[list[int]], added: list[list[int]]) -> np.ndarray:
        """A score for each block and label: its own features' weights and those that its ancestors add."""
        inherited = np.zeros((len(added), 2))
        for i, k in enumerate(added):
            inherited[i] = (inherited[page.nodes[i].parent] if i else 0.0) + (self.weights[k].sum(axis=0) if k else 0.0)
        return np.array([inherited[b.node] + self.weights[k].sum(axis=0) for b, k in zip(page.blocks, own)]).reshape(len(own), 2)

    def decode(self, page: Page) -> list[int]:
        """The likeliest labels, 1 for content."""
        if not page.blocks or not self.names:
            return [0] * len(page.blocks)
        e, m = self.emissions(page).tolist(), self.moves.tolist()
        best, back = e[0], []
        for now in e[1:]:
            step, new = [], []
            for y in (0, 1):
                a, b = best[0] + m[0][y], best[1] + m[1][y]
                step.append(int(b > a))
                new.append(max(a, b) + now[y])
            back.append(step)
            best = new
        labels = [int(best[1] > best[0])]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def marginals(e: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each block's label, and expected label moves over the page."""
    n = len(e)
    forward, backward = np.empty((n, 2)), np.zeros((n, 2))
    forward[0] = e[0]
    for i in range(1, n):
        forward[i] = e[i] + _log_sum(forward[i - 1][:, None] + moves, 0)
    for i in range(n - 2, -1, -1):
        backward[i] = _log_sum(moves + (e[i + 1] + backward[i + 1])[None, :], 1)
    total = _log_sum(forward[-1], 0)
    single = np.exp(forward + backward - total)
    pairs = np.zeros((2, 2))
    for i in range(1, n):
        pairs += np.exp(forward[i - 1][:, None] + moves + (e[i] + backward[i])[None, :] - total)
    return single, pairs


def fit(pages: list[str], epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> Model:
    """A model from pages with landmarks."""
    sequences = [p for p in map(parse, sorted(pages)) if any(p.inside())]
    if not sequences:
        return Model()
    names: dict[str, int] = {}
    number = lambda found: [[names.setdefault(n, len(names)) for n in f] for f in found]
    coded = [(p, number(features(p)), number(n.adds for n in p.nodes), np.array(p.inside())) for p in sequences]
    model = Model(names, np.zeros((len(names), 2)), np.zeros((2, 2)))
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        for i in rng.permutation(len(coded)):
            page, own, added, y = coded[i]
            lr = rate / (1 + step / (2 * len(coded)))
            step += 1
            single, pairs = marginals(model.scores(page, own, added), model.moves)
            gap = -single
            gap[np.arange(len(y)), y] += 1
            model.weights *= 1 - lr * DECAY
            gap *= lr / len(y) ** 0.5
            below = np.zeros((len(added), 2))  # of all blocks below an element
            for b, k, g in zip(page.blocks, own, gap):
                model.weights[k] += g
                below[b.node] += g
            for n in range(len(added) - 1, 0, -1):
                below[page.nodes[n].parent] += below[n]
                if added[n]:
                    model.weights[added[n]] += below[n]
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:-1], y[1:]), 1)
            model.moves += lr * (seen - pairs) / len(y)
    return model


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Model:
    """A model from at most about train_pages pages that have a landmark."""
    marked = pages.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    n = marked.count()
    u = F.pmod(F.xxhash64(F.lit("page sample"), F.col("page_id"), F.length("html")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return fit([r[0] for r in marked.where(u < train_pages / max(1, n)).select("html").collect()])


def extract(html: Column, model: Model) -> Column:
    """Column EXTRACTED for each page."""

    @F.pandas_udf(EXTRACTED)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            out = []
            for page in pages:
                found = parse(page)
                kept = [b.text for b, y in zip(found.blocks, model.decode(found)) if y]
                out.append(("\n".join(kept), len(found.blocks), len(kept)))
            yield pd.DataFrame(out, columns=["text", "blocks", "kept"])

    return of(html)


def extracted(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, text, blocks, kept) for each row of pages."""
    return pages.select("page_id", extract(F.col("html"), model).alias("x")).select("page_id", "x.*")
