"""Main content of pages by a tree-structured graphical model over their blocks and the elements around them.

Every node of a page's tree is content or not. A node's own evidence is a logistic model over what it looks like; parents
and children are tied by potentials, learnt as the pointwise mutual information of their labels. Sum-product messages go up the tree
and down again; they give each node's exact marginal under the model. Pages whose markup names the main part (<main>) are the
labelled ones: a bounded sample of them trains the model, which never looks at those names itself.
"""

from __future__ import annotations

import math
import re
import struct
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from zlib import crc32

import numpy as np

from weft.llm.pages import Node, parse, site_name, title_of
from weft.llm.prose import Measures, Yardstick, fit_yardstick

DIM = 1 << 14
#: Sites on which a phrase stands, and sentences beside it, on average, from which a standing phrase of main parts is an invitation.
SITES, BESIDE = 3, 2
#: Weight of a standing phrase beside the features of words and shape, whose values are at most 1.
STANDING = 8.0

_WORD = re.compile(r"\w+")
_DIGITS = re.compile(r"\d+")
#: Blanks for all ASCII that is in no word.
_BLANKS = "".join(chr(c) if _WORD.match(chr(c)) else " " for c in range(128))
#: Marks that end a sentence, and what may close it after them.
_ENDS, _CLOSERS = (".", "!", "?", "…", "。", "！", "？"), "\"'”’»)]"


def _h(s: str) -> int:
    return crc32(s.encode()) % DIM


class _Hashes(dict):
    """The features of words. Short ones are held, as far as there is room."""

    def __missing__(self, word: str) -> int:
        h = _h("_" + word)
        if len(word) < 24 and len(self) < 100_000:
            self[word] = h
        return h


_HASHES = _Hashes()


def masked(text: str, site: str) -> str:
    """The text with numbers and the site's name made alike."""
    t = _DIGITS.sub("0", text.lower())
    return t.replace(site, "§") if len(site) > 2 else t


@lru_cache(4096)
def _bucket(x: float) -> int:
    return int(math.log2(x + 1) * 2)


def _share(a: float, b: float) -> int:
    return -1 if b <= 0 else 0 if a <= 0 else 1 if a < 0.34 * b else 2 if a < 0.67 * b else 3 if a < 0.95 * b else 4


class Page:
    """A parsed page and the evidence of its nodes."""

    __slots__ = ("nodes", "site", "title", "leaves", "below", "_masked", "_around")

    def __init__(self, page: str, url: str | None):
        self._fill(parse(page), site_name(url), title_of(page))
        # Parents come before their children, so sums over subtrees run backwards.
        self.below = below = [[0, 0, 0, 0, 0, 0, 0] for _ in self.nodes]  # leaves, chars, linked, sentences, titles, site, words
        title, site = self.title.lower(), self.site if len(self.site) > 2 else ""
        for i in range(len(self.nodes) - 1, 0, -1):
            n = self.nodes[i]
            if n.block >= 0:
                text, low, chars = n.text, n.text.lower(), len(n.text)
                words = text.count(" ") + 1
                below[i] = [1, chars, min(n.linked, chars), int(words > 3 and text.rstrip(_CLOSERS).endswith(_ENDS)), int(title != "" and low == title), int(site != "" and site in low), words]
            b, p = below[i], below[n.parent]
            p[0] += b[0]
            p[1] += b[1]
            p[2] += b[2]
            p[3] += b[3]
            p[4] += b[4]
            p[5] += b[5]
            p[6] += b[6]

    def _fill(self, nodes: list[Node], site: str, title: str) -> None:
        self.nodes, self.site, self.title = nodes, site, title
        self.leaves = [i for i, n in enumerate(nodes) if n.block >= 0]
        self._masked, self._around = {}, {}

    def __reduce__(self):
        """In columns, as pickling node by node takes as long as parsing. Texts have no line ends and tags no blanks."""
        n = self.nodes
        columns = "\n".join(x.text for x in n), " ".join(x.tag for x in n), "\n".join(" ".join(x.zones) for x in n), [x.parent for x in n], [x.linked for x in n]
        return _unpacked, (self.site, self.title, *columns, [x for b in self.below for x in b])

    def surface(self, i: int) -> tuple:
        """A node's shape and place in a few steps each, so that like nodes are equal."""
        n, b, total = self.nodes[i], self.below[i], len(self.leaves)
        if n.block < 0:
            first = next((c for c in n.children if self.nodes[c].block >= 0), None)
            head = first is not None and self.nodes[first].tag[0] == "h" and self.below[first][2] == 0
            return ("C", _bucket(b[0]), _share(b[2], b[1]), _share(b[3], b[0]), min(b[4], 1), _share(b[5], b[0]), _bucket(b[6] / max(1, b[0])), head, n.parent < 0 or self.nodes[n.parent].parent < 0)
        p = self.below[n.parent]
        around = self._around.get(n.parent)
        if around is None:
            around = self._around[n.parent] = _bucket(p[0]), _share(p[2], p[1]), _share(p[3], p[0]), min(p[4], 1)
        crumb = 2 if ">" not in n.text and "»" not in n.text else int(bool(self.title) and not b[4] and n.text.endswith(self.title))
        return ("L", n.tag, _bucket(b[6]), b[3], _share(b[2], b[1]), b[5], b[4], crumb, 4 * n.block // total, *around, min(12, p[3] - b[3]))

    def masked(self, i: int) -> str:
        """The block's text, masked."""
        m = self._masked.get(i)
        if m is None:
            m = self._masked[i] = masked(self.nodes[i].text, self.site)
        return m

    def phrase(self, i: int) -> str:
        """What makes the block's text alike on other sites: the masked text, or for path lines their form."""
        text = self.nodes[i].text
        if ">" in text or "»" in text:
            return f"> {bool(self.title) and text.endswith(self.title)} {text.split()[0].lower()}"
        return self.masked(i)

    def wording(self, i: int) -> list[int]:
        """Features of all of a block's words."""
        m = self.masked(i).replace("§", " sitename ")
        words = m.translate(_BLANKS).split() if m.isascii() else _WORD.findall(m)
        return [*map(_HASHES.__getitem__, sorted({*words}))]


def _unpacked(site: str, title: str, texts: str, tags: str, zones: str, parents: list[int], linked: list[int], below: list[int]) -> Page:
    """What ``Page.__reduce__`` has packed."""
    nodes, own, blocks = [], {"": ()}, 0
    for tag, parent, text, n, zone in zip(tags.split(" "), parents, texts.split("\n"), linked, zones.split("\n")):
        if zone not in own:
            own[zone] = tuple(zone.split(" "))
        if parent >= 0:
            nodes[parent].children.append(len(nodes))
        nodes.append(Node(tag, parent, blocks if text else -1, text, n, own[zone]))
        blocks += bool(text)
    page = Page.__new__(Page)
    page._fill(nodes, site, title)
    page.below = [below[k : k + 7] for k in range(0, len(below), 7)]
    return page


def surface_features(key: tuple) -> list[int]:
    """The hashed features of a node's surface: its steps one by one, and some of them together."""
    if key[0] == "C":
        _, leaves, links, sentences, title, site, words, head, top = key
        names = ["C", f"Cl{leaves}", f"Ck{links}", f"Cs{sentences}", f"Ct{title}", f"Cn{site}", f"Cw{words}", f"Ch{head}{title}", f"Cks{links}{sentences}", f"Cr{top}", f"Cls{leaves}{links}"]
    else:
        _, tag, words, sentence, links, site, title, crumb, at, p_leaves, p_links, p_sentences, p_title, others = key
        names = [
            "L", f"g{tag}", f"w{words}", f"e{sentence}", f"k{links}", f"s{site}", f"t{title}", f"c{crumb}", f"p{at}", f"wk{words}{links}", f"ek{sentence}{links}", f"pl{p_leaves}", f"pk{p_links}", f"ps{p_sentences}",
            f"pt{p_title}", f"kpk{links}{p_links}{p_sentences}", f"tg{title}{tag}", f"pq{_bucket(others)}", f"pqt{min(2, others)}{p_title}", f"plk{p_leaves}{links}", f"sp{site}{at}{links}",
        ]
    return [_h(x) for x in names]


class NoLabels(ValueError):
    """There is nothing to learn from."""


@dataclass
class Model:
    """Weights of the nodes' evidence, and the potentials that tie a parent's label to a block's and to an element's."""

    weights: np.ndarray
    standing: frozenset[str]
    block_tie: tuple[tuple[float, float], tuple[float, float]]
    element_tie: tuple[tuple[float, float], tuple[float, float]]
    #: What honest prose compresses to, by language.
    prose: Yardstick = field(default_factory=Yardstick)

    def __post_init__(self) -> None:
        self.lists = self.weights.tolist()

    def evidence(self, page: Page, memo: dict) -> list[float]:
        w, out = self.lists, []
        weight = w.__getitem__
        for i, n in enumerate(page.nodes):
            key = page.surface(i)
            s = memo.get(key)
            if s is None:
                s = memo[key] = float(sum(map(weight, surface_features(key))))
            if n.block >= 0:
                key = (n.text, page.site) if len(n.text) < 60 else None
                t = memo.get(key) if key else None
                if t is None:
                    m = page.phrase(i)
                    # Texts are alike on several sites; the form of a path says too little to go by.
                    alike = m if len(m) < 200 and m[0] != ">" else None
                    t = memo.get(alike) if alike else None
                    if t is None:
                        f = page.wording(i)
                        t = sum(map(weight, f)) / math.sqrt(len(f)) if f else 0.0
                        if m in self.standing:
                            t += STANDING * w[_h("=" + m)]
                        if alike and len(memo) < 100_000:
                            memo[alike] = t
                    if key and len(memo) < 100_000:
                        memo[key] = t
                s = s + t
            out.append(s)
        return out

    def marginals(self, page: Page, memo: dict | None = None) -> list[float]:
        """P(content) of every node, by one pass of messages from the leaves to the root and one back."""
        nodes = page.nodes
        own = self.evidence(page, {} if memo is None else memo)
        # In log odds: a message over an edge with potentials t from a node with odds exp(s) is lse(t[1][0], t[1][1] + s) - lse(t[0][0], t[0][1] + s), lse the log of the sum of exps.
        up, inside = [0.0] * len(nodes), own[:]
        exp, log1p = math.exp, math.log1p
        ties = [self.block_tie if n.block >= 0 else self.element_tie for n in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            (a, b), (c, d) = ties[i]
            s = inside[i]
            b += s
            d += s
            up[i] = m = ((c if c > d else d) + log1p(exp(-abs(c - d)))) - ((a if a > b else b) + log1p(exp(-abs(a - b))))
            inside[nodes[i].parent] += m
        full = inside[:]
        for i in range(1, len(nodes)):
            (a, c), (b, d) = ties[i]
            s = full[nodes[i].parent] - up[i]
            b += s
            d += s
            full[i] = inside[i] + (((c if c > d else d) + log1p(exp(-abs(c - d)))) - ((a if a > b else b) + log1p(exp(-abs(a - b)))))
        return [1 / (1 + exp(-max(-60.0, min(60.0, s)))) for s in full]


def main_texts(p: Page) -> list[tuple[int, str]]:
    """(node, masked text) of the blocks within the main part that can be standing phrases: four words or more."""
    texts = ((i, p.masked(i)) for i in p.leaves if "main" in p.nodes[i].zones)
    return [(i, t) for i, t in texts if t.count(" ") >= 3]


def labels(p: Page, inviting: frozenset[str] | set[str]) -> list[int]:
    """Labels of a page's nodes: its blocks within the main part are content, but for ``inviting`` texts; elements follow the greater part of their characters."""
    out = {i for i, t in main_texts(p) if t in inviting}
    content = {i for i in p.leaves if "main" in p.nodes[i].zones and i not in out}
    y = [0] * len(p.nodes)
    chars = [[0, 0] for _ in p.nodes]
    for i in range(len(p.nodes) - 1, -1, -1):
        n = p.nodes[i]
        if n.block >= 0:
            y[i] = int(i in content)
            chars[i][y[i]] = len(n.text)
        else:
            y[i] = int(chars[i][1] > chars[i][0])
        if n.parent >= 0:
            chars[n.parent][0] += chars[i][0]
            chars[n.parent][1] += chars[i][1]
    return y


def labels_of(pages: list[Page]) -> list[list[int]]:
    """Labels of every node of pages whose markup names the main part.

    Blocks outside it are no content. Blocks inside are, but for standing phrases: texts of four words or more that, site names
    and numbers aside, occur on three sites or more within the main part. Such a phrase is content where it is the message of an otherwise nearly
    empty page, that is where on average fewer than two sentences stand beside it; else it is an invitation.
    """
    sites, beside = defaultdict(set), defaultdict(list)
    texts = [main_texts(p) for p in pages]
    for p, own in zip(pages, texts):
        for _, t in own:
            sites[t].add(p.site)
    standing = {t for t, s in sites.items() if len(s) >= SITES}
    for p, own in zip(pages, texts):
        rare = sum(p.below[i][3] for i, t in own if t not in standing)
        for _, t in own:
            if t in standing:
                beside[t].append(rare)
    inviting = {t for t, n in beside.items() if sum(n) / len(n) >= BESIDE}
    return [labels(p, inviting) for p in pages]


def named(p: Page) -> bool:
    """Whether the page's markup names its main part."""
    return any("main" in p.nodes[i].zones for i in p.leaves)


def likes(pages: Iterable[tuple[Page, list[int]]], standing: frozenset[str] | set[str]) -> dict[bytes, list[int]]:
    """How often like nodes (menus, notices) occur with label 0 and 1. The keys hold their features: the number of those of the surface, these, the standing phrase's + 1 or 0, the words'."""
    out: dict[bytes, list[int]] = {}
    fronts: dict[tuple, bytes] = {}
    backs: dict[tuple, bytes] = {}
    none = _packed([0])
    for p, y in pages:
        for i, n in enumerate(p.nodes):
            surface = p.surface(i)
            front = fronts.get(surface)
            if front is None:
                f = surface_features(surface)
                front = fronts[surface] = _packed([len(f), *f])
            back = none
            if n.block >= 0:
                key = (n.text, p.site, p.title if ">" in n.text or "»" in n.text else "")
                back = backs.get(key)
                if back is None:
                    m = p.phrase(i)
                    back = _packed([_h("=" + m) + 1 if m in standing else 0, *p.wording(i)])
                    if len(n.text) < 60 and len(backs) < 100_000:
                        backs[key] = back
            like = front + back
            own = out.get(like)
            if own is None:
                own = out[like] = [0, 0]
            own[y[i]] += 1
    return out


def _packed(features: list[int]) -> bytes:
    return struct.pack(f"<{len(features)}H", *features)


class Rows:
    """Like nodes in arrays: the features of their surfaces and of their words, held once each, those of their phrases, their number and the share of content."""

    def __init__(self, like: Iterable[tuple[bytes, int, int]]):
        surfaces: dict[bytes, int] = {}
        words: dict[bytes, int] = {}
        of, said, phrases, counts = [], [], [], []
        for key, zeros, ones in like:
            at = 2 * int.from_bytes(key[:2], "little") + 2
            of.append(surfaces.setdefault(key[2:at], len(surfaces)))
            phrases.append(int.from_bytes(key[at : at + 2], "little") - 1)
            said.append(words.setdefault(key[at + 2 :], len(words)))
            counts.append((zeros, ones))
        self.of, self.said, self.phrases = np.array(of, "int32"), np.array(said, "int32"), np.array(phrases, "int32")
        self.words, self.lengths = np.frombuffer(b"".join(words), "<u2"), np.array([len(w) // 2 for w in words], "int32")
        self.surfaces, self.sizes = np.frombuffer(b"".join(surfaces), "<u2"), np.array([len(f) // 2 for f in surfaces], "int32")
        self.counts = np.array(counts, "float64").reshape(-1, 2)

    @cached_property
    def places(self) -> tuple:
        """What is the same in every round: indices as numpy counts by them, and rows with a standing phrase."""
        return *(x.astype("intp") for x in (self.of, self.said, self.surfaces, self.words)), np.flatnonzero(self.phrases >= 0), self.counts.sum(1)

    def gradient(self, w: np.ndarray) -> np.ndarray:
        """Of the logistic loss, summed over all nodes."""
        of, said, surfaces, words, standing, often = self.places
        phrases, scale = self.phrases[standing], 1 / np.sqrt(np.maximum(1, self.lengths))
        s = _sums(w.take(surfaces, mode="clip"), self.sizes)[of] + (scale * _sums(w.take(words, mode="clip"), self.lengths))[said]
        s[standing] += STANDING * w[phrases]
        d = often / (1 + np.exp(-np.clip(s, -50, 50))) - self.counts[:, 1]
        g = np.bincount(surfaces, np.repeat(np.bincount(of, d, len(self.sizes)), self.sizes), DIM) + np.bincount(words, np.repeat(scale * np.bincount(said, d, len(scale)), self.lengths), DIM)
        return g + np.bincount(phrases, STANDING * d[standing], DIM)


def _sums(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over successive stretches of these lengths."""
    out, some = np.zeros(len(lengths)), lengths > 0
    if len(x):
        out[some] = np.add.reduceat(x, (np.cumsum(lengths) - lengths)[some])
    return out


def descend(gradient: Callable[[np.ndarray], np.ndarray], total: float, rounds: int = 400, ridge: float = 1e-6) -> np.ndarray:
    """The weights by ``rounds`` steps of Adam, from a ``gradient`` that is summed over ``total`` nodes."""
    w, first, second = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM)
    for k in range(1, rounds + 1):
        g = gradient(w) / total + ridge * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w - 0.15 * (1 - k / (rounds + 1)) * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-9)
    return w


def ties_of(pages: Iterable[tuple[Page, list[int]]]) -> Counter:
    """How often (whether a block, label of its parent, its label) occurs."""
    return Counter((n.block >= 0, y[n.parent], y[i]) for p, y in pages for i, n in enumerate(p.nodes[1:], 1))


def tie(k: Counter, block: bool) -> tuple[tuple[float, float], tuple[float, float]]:
    """The pointwise mutual information of a parent's label and that of a block or an element."""
    joint = np.array([[k[block, a, b] + 1.0 for b in (0, 1)] for a in (0, 1)])
    joint /= joint.sum()
    return tuple(tuple(float(x) for x in q) for q in np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True)))


def content_measures(p: Page, y: list[int]) -> Measures:
    """Of a labelled page's content without headings."""
    own = [n for i in p.leaves if y[i] and (n := p.nodes[i]).tag[0] != "h"]
    return Measures([(n.tag, n.text, 2 * n.linked > len(n.text)) for n in own])


def train(sample: list[tuple[str, str | None]], rounds: int = 400, ridge: float = 1e-6) -> Model:
    """The model from (html, url) of labelled pages; pages without a label are passed over, and at least one must have one."""
    pages = [p for p in (Page(h, u) for h, u in sample) if named(p)]
    if not pages:
        raise NoLabels("no page has its main part named: train on other pages, and hand the model over")
    both = list(zip(pages, labels_of(pages)))
    sites = defaultdict(set)
    for p in pages:
        for i in p.leaves:
            sites[p.phrase(i)].add(p.site)
    standing = frozenset(t for t, s in sites.items() if len(s) >= SITES)
    rows = Rows((k, *n) for k, n in sorted(likes(both, standing).items()))
    ties = ties_of(both)
    w = descend(rows.gradient, rows.counts.sum(), rounds, ridge)
    return Model(w, standing, tie(ties, True), tie(ties, False), fit_yardstick(content_measures(p, y) for p, y in both))
