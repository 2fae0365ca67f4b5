"""What texts compress to, set against what prose of their length and language does.

Three measures, each the compressed size over a length: blocks with their markup (lists repeat tags and words), the shape of the text (each word one sign for its
length and case, so a list of ever different words is the same sign again and again, while in sentences short and long words alternate), and each sentence by itself (a keyword
repeated within it). A Yardstick holds what honest pages have, fitted on labelled pages. No list of words is used: languages are told apart by the short words that
are commonest in the labelled pages.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

# Letters of scripts without blanks between words are words by themselves.
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_]+(?:['’][^\W_]+)*")
_SIGN = re.compile(_WORD.pattern + r"|[^\w\s]|\n")
# The same for ASCII, where they are faster.
_ASCII_WORD = re.compile(r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)*")
_BLANKS = "".join(chr(c) if chr(c).isalnum() else " " for c in range(128))
_ASCII_SIGN = re.compile(_ASCII_WORD.pattern + r"|[^A-Za-z0-9_\s]|\n")
_STOP = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)|[。！？]+[”’」』）]*")
_CUT = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])|\n")

#: Kinds of measures, in this order in all tuples.
MARKUP, SHAPE, SENTENCE = range(3)
#: Labelled pages that a language needs for a fit of its own, and short words that may mark one.
LEAST_PAGES, MARKERS, SHORT = 100, 40, 4
#: Words from which a stretch that ends with a mark is a sentence; share of the expected size below which it is redundant in itself.
SENTENCE_WORDS, LIVE = 4, 0.85
#: What counts for a fit: words of a page and characters of a sentence, at least. A fit is made TRIMS times, of what lies between these multiples of the last one.
LEAST_WORDS, LEAST_CHARS, TRIMS, TRIM = 8, 12, 5, (0.85, 1.25)
#: Ratios to what prose has below which a page is extremely redundant: with markup, in shape, sentence by sentence.
REDUNDANT = (0.8, 0.8, 0.92)
#: Share of words in live sentences from which a page is one of sentences.
SENTENCES = 0.65


def squeezed(text: str) -> bytes:
    """One byte a character, so that scripts compare by characters and not by the length of their encoding."""
    return text.encode() if text.isascii() else bytes(c if c < 128 else 128 + c % 128 for c in map(ord, text))


def packed_size(raw: bytes) -> int:
    """The compressed size, without the fixed cost of an empty text."""
    return max(0, len(zlib.compress(raw, 6)) - 8)


def words_of(text: str) -> list[str]:
    if not text.isascii():
        return _WORD.findall(text)
    return _ASCII_WORD.findall(text) if "'" in text else text.translate(_BLANKS).split()


class _Signs(dict):
    """The signs of words. Short ones are held, as far as there is room."""

    def __missing__(self, w: str) -> str:
        sign = w if not w[0].isalnum() else "0" if w.isdigit() else ("A" if len(w) < 4 else "B") if w[0].isupper() else "a" if len(w) < 4 else "b"
        if len(w) < 24 and len(self) < 100_000:
            self[w] = sign
        return sign


_SIGNS = _Signs()


def shape(text: str) -> str:
    """One sign a word: its case and whether it has more than three letters, or that it is a number; other signs and line ends stay."""
    return "".join(map(_SIGNS.__getitem__, (_ASCII_SIGN if text.isascii() else _SIGN).findall(text)))


class Measures:
    """Of the blocks (tag, text, mostly linked) of one page. What needs compression is done when it is asked for."""

    def __init__(self, blocks: Sequence[tuple[str, str, bool]]):
        self.blocks, self.text = blocks, "\n".join(t for _, t, _ in blocks)
        words = words_of(self.text)
        self.words = len(words)
        #: Its commonest short words, of equally common ones the first.
        times = Counter([x.lower() for x in words if len(x) <= SHORT and not x.isdigit()])
        self.common = sorted(times, key=times.__getitem__, reverse=True)[:8]

    @cached_property
    def whole(self) -> tuple[tuple[int, int], tuple[int, int]]:
        """(length, compressed size) of the markup and of the shape."""
        markup = squeezed("\n".join(f"<{tag}><a>{t}</a>" if linked else f"<{tag}>{t}" for tag, t, linked in self.blocks))
        return (len(markup), packed_size(markup)), (self.words, packed_size(shape(self.text).encode()))

    def sentences(self, least: int = 0) -> Iterator[tuple[int, int, int, bool]]:
        """(length, compressed size, words, whether a mark ends it) of each stretch between marks or line ends; with ``least``, of those only that a mark ends and that have so many words."""
        for s in _CUT.split(self.text):
            if s and not s.isspace():
                ended = s[-1] in ".!?…。！？" or bool(_STOP.search(s))
                if (ended or not least) and (words := len(words_of(s))) >= least:
                    yield len(s), packed_size(squeezed(s)), words, ended

    def points(self) -> Iterator[tuple[int, int, int]]:
        """(kind, length, compressed size) of what a fit is made of: markup, shape, and the sentences that a mark ends."""
        for kind, (n, z) in zip((MARKUP, SHAPE), self.whole):
            yield kind, n, z
        for n, z, _, ended in self.sentences():
            if ended and n >= LEAST_CHARS:
                yield SENTENCE, n, z


@dataclass
class Measured:
    """Measures that were taken before, for ``Yardstick``."""

    common: Sequence[str]
    whole: tuple[tuple[int, int], tuple[int, int]]
    of_sentences: Sequence[tuple[int, int, int, bool]]

    @property
    def words(self) -> int:
        return self.whole[1][0]

    def sentences(self, least: int = 0) -> Iterator[tuple[int, int, int, bool]]:
        return (s for s in self.of_sentences if not least or s[3] and s[2] >= least)


Fit = tuple[tuple[float, ...], float, float]

#: What English prose has, used where too few pages are labelled; made by ``fit_yardstick`` from pages of invented test data. Coefficients of a polynomial
#: in ln(length), and the lengths between which it holds; beyond them the border's value is taken.
EXPECTED: tuple[Fit, Fit, Fit] = (((0.0222, -0.4033, 2.2161), 44, 2679), ((-0.011, -0.1049, 1.273), 8, 362), ((-0.1008, 0.6152, 0.0846), 12, 112))


def _expected(f: Fit, length: float) -> float:
    (a, b, c), least, most = f
    x = math.log(min(max(length, least), most))
    return max(0.02, (a * x + b) * x + c)


@dataclass
class Yardstick:
    """Fits of the three measures by language marker, and under '' for all together."""

    fits: dict[str, tuple[Fit, Fit, Fit]] = field(default_factory=lambda: {"": EXPECTED})
    markers: list[str] = field(default_factory=list)

    def language(self, common: Sequence[str]) -> str:
        """The marker that is commonest in a text, if it has a fit of its own; else ''."""
        return next((w for w in common if w in self.markers and w in self.fits), "")

    def ratios(self, m: Measures | Measured) -> tuple[float, float, float]:
        """The three measures over what prose has; 1 is usual. A text without words has 1."""
        if not m.words:
            return 1.0, 1.0, 1.0
        f = self.fits[self.language(m.common)]
        markup, form = (z / n / _expected(f[k], n) for k, (n, z) in zip((MARKUP, SHAPE), m.whole))
        sizes = [(z, n * _expected(f[SENTENCE], n)) for n, z, _, _ in m.sentences()]
        return markup, form, sum(z for z, _ in sizes) / sum(e for _, e in sizes)

    def has_sentences(self, m: Measures | Measured, share: float) -> bool:
        """Whether ``share`` of a text's words stand in sentences: ended by a mark, long enough, and not redundant by themselves."""
        f, live = self.fits[self.language(m.common)][SENTENCE], 0
        for n, z, w, _ in m.sentences(SENTENCE_WORDS):
            if z >= LIVE * n * _expected(f, n):
                live += w
                if live >= share * m.words:
                    return True
        return False

    def stuffed(self, m: Measures | Measured) -> bool:
        """Whether a text is extremely redundant in one of the measures, and few of its words stand in sentences."""
        # Either test alone can acquit; that of sentences ends sooner for honest pages.
        return m.words > 0 and not self.has_sentences(m, SENTENCES) and any(r < most for r, most in zip(self.ratios(m), REDUNDANT))


def _quantile(length: np.ndarray, times: np.ndarray, q: float) -> float:
    """As numpy's of all lengths, each as often as it occurs."""
    order = np.argsort(length, kind="stable")
    upto, at = np.cumsum(times[order]), q * (times.sum() - 1)
    low, high = (length[order][np.searchsorted(upto, k, "right")] for k in (math.floor(at), math.ceil(at)))
    return float(low + (high - low) * (at - math.floor(at)))


def fitted(length: np.ndarray, size: np.ndarray, times: np.ndarray) -> Fit | None:
    """A parabola through (length, size / length); what lies far from it is left out and the rest fitted again, for some labelled pages are stuffed."""
    x, y, keep = np.log(length), size / length, np.ones(len(length), bool)
    for _ in range(TRIMS):
        if times[keep].sum() < LEAST_PAGES or np.ptp(x[keep]) < 0.5:
            return None
        c = np.polyfit(x[keep], y[keep], 2, w=np.sqrt(times[keep]))
        r = y / np.maximum(np.polyval(c, x), 0.02)
        keep = (r > TRIM[0]) & (r < TRIM[1])
    if not keep.any():
        return None
    return tuple(float(v) for v in c), _quantile(length[keep], times[keep], 0.005), _quantile(length[keep], times[keep], 0.995)


def fit_yardstick(pages: Iterable[Measures]) -> Yardstick:
    """From the main content of labelled pages; measures with too few points keep EXPECTED.

    Pages that are stuffed by the fit of all together make no language: of many pages even one kind of stuffing has enough to pass for one, and would be what is usual in it.
    """
    pages = [m for m in pages if m.words >= LEAST_WORDS]

    def fits(of: list[Measures], other: tuple) -> tuple:
        points = Counter(p for m in of for p in m.points())
        table = np.array([(*p, t) for p, t in sorted(points.items())], "int64").reshape(-1, 4)
        return tuple(fitted(*table[table[:, 0] == k, 1:].T) or other[k] for k in (MARKUP, SHAPE, SENTENCE))

    pooled = fits(pages, EXPECTED)
    whole = Yardstick({"": pooled})
    honest = [m for m in pages if not whole.stuffed(m)]
    often = Counter(w for m in honest for w in set(m.common[:3]))
    markers = sorted(often, key=lambda w: (-often[w], w))[:MARKERS]
    groups: dict[str, list[Measures]] = {}
    for m in honest:
        if own := next((w for w in m.common if w in markers), ""):
            groups.setdefault(own, []).append(m)
    return Yardstick({"": pooled} | {k: fits(g, pooled) for k, g in groups.items() if len(g) >= LEAST_PAGES}, markers)
