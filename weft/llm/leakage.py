"""Evaluation texts in documents: seeds of both joined by running Karp-Rabin hashes, and greedy string tiling over letters and digits of the pairs that share some."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.hashing import batches_by_chars, codes_of, gram_hashes, sliding_min
from weft.session import spread, staged

#: Letters of a seed, and bits of the sieve that keeps seeds of no item from being shuffled. The sieve has this size whatever the number of items; a full one passes all.
GRAM = 16
SIEVE_BITS = 1 << 27
#: Parts into which the items of one document are split at most, so that a document with very many of them is many rows.
PARTS = 64

_LOWER = bytes(range(256)).lower()
_DROP = bytes(b for b in range(256) if not (b < 128 and chr(b).isalnum()))
_SIGNS = re.compile(r"[\W_]+")


def letters(text: str | None) -> str:
    """The letters and digits of a text in order: without case, accents, compatible forms, entities, signs and blanks."""
    if not text:
        return ""
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return text.encode().translate(_LOWER, _DROP).decode()
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return _SIGNS.sub("", text)


def measures(text: str | None, words: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """An item's words as letters, their starts and ends in its line of letters, and the letters of each window of ``words`` words that has any."""
    parts = [letters(w) for w in (text or "").split()]
    sizes = np.array([len(p) for p in parts], "int64")
    end = np.cumsum(sizes)
    start = end - sizes
    windows = end[words - 1 :] - start[: len(parts) - words + 1] if len(parts) >= words else end[:0]
    return parts, start, end, windows[windows > 0]


def winnowed(codes: np.ndarray, gram: int, window: int) -> np.ndarray:
    """For each window of so many grams the least hash: equal stretches of gram + window - 1 letters have an equal one, wherever they stand."""
    return sliding_min(gram_hashes(codes, gram), window) if len(codes) >= gram + window - 1 else np.zeros(0, "uint64")


def _item_seeds(words: int, least: int, coverage: float):
    """(kind, seed, item_id, weight, need) of items: see leaked_items."""
    gram = min(GRAM, least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for item, text in zip(b["item_id"].tolist(), b["text"].tolist()):
                parts, _, _, windows = measures(text, words)
                line = codes_of("".join(parts))
                long, short = windows[windows >= least], windows[windows < least]
                need = max(1, min([math.ceil(coverage * len(line) / least - 1e-9), *(long - least + 1).tolist()])) if not len(short) else 1
                kinds = [(0, gram, least - gram + 1)] if len(line) >= least else []
                kinds += [(k, 1 << (k - 1), 1) for k in sorted({int(n).bit_length() for n in short})]
                for kind, q, w in kinds:
                    seeds, weights = np.unique(winnowed(line, q, w), return_counts=True)
                    out.append(pd.DataFrame({"kind": kind, "seed": seeds.view("int64"), "item_id": item, "weight": weights, "need": need}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


def sieve_of(seeds: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the seeds with two places each, put together by the executors; what comes to the driver is at most bits / 64 words."""
    at = seeds.select(F.explode(F.array(F.col("seed").bitwiseAND(bits - 1), F.shiftrightunsigned("seed", 32).bitwiseAND(bits - 1))).alias("p"))
    rows = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")).toArrow()
    words = np.zeros(bits >> 6, "uint64")
    words[rows["w"].to_numpy()] = rows["b"].to_numpy().view("uint64")
    return words


def passes(sieve: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Which seeds may belong to an item."""
    mask, ok = np.uint64(len(sieve) * 64 - 1), np.ones(len(seeds), bool)
    for p in (seeds & mask, (seeds >> np.uint64(32)) & mask):
        ok &= (sieve[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) > 0
    return ok


def _suspects(shared, kinds: list[int], least: int):
    """The documents that have a seed of an item, with these seeds."""
    gram = min(GRAM, least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sieve = shared.value
        for b in batches:
            ids, raw, texts = b["doc_id"].tolist(), b["text"].tolist(), [letters(t) for t in b["text"].tolist()]
            out = []
            for lo, hi in batches_by_chars(texts):
                sizes = np.array([len(t) for t in texts[lo:hi]], "int64")
                begins = np.cumsum(sizes) - sizes
                codes, found = codes_of("".join(texts[lo:hi])), []
                for kind in kinds:
                    q, w = (gram, least - gram + 1) if kind == 0 else (1 << (kind - 1), 1)
                    m = winnowed(codes, q, w)
                    at = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]])) if len(m) else np.zeros(0, "int64")
                    # Windows across two documents add a seed to one of them at most, which costs a look and no more.
                    at = np.concatenate([at, begins[begins < len(m)]])
                    at = at[passes(sieve, m[at])]
                    found.append(np.stack([np.searchsorted(begins, at, "right") - 1, m[at].view("int64")]))
                doc, seed = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), "int64")
                cuts = np.flatnonzero(np.diff(doc, prepend=-1))
                for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)], strict=False):
                    out.append((ids[lo + doc[x]], raw[lo + doc[x]], seed[x:y]))
            yield pd.DataFrame(out, columns=["doc_id", "text", "seeds"])

    return run


class Items:
    """Some items prepared for matching: their letters in one line, word ends, and tables of grams.

    The first table holds every gram of ``least`` letters, so it finds every match that can be a tile, and with it every window of ``words`` words that is
    as long. Shorter windows get tables of their own, by length class. Items that can have neither tile nor window are left out."""

    def __init__(self, rows: list[tuple[int, str]], words: int, least: int):
        self.ids, self.sizes, texts, starts, ends = [], [], [], [], []
        classes: dict[int, dict[int, int]] = {}
        at = 1
        for item, raw in rows:
            parts, start, end, windows = measures(raw, words)
            size = int(end[-1]) if parts else 0
            if size < least and not len(windows):
                continue
            k = len(self.ids)
            for n in windows[windows < least].tolist():
                # Windows of like length share a table: classes by doubling.
                own = classes.setdefault(n.bit_length(), {})
                own[k] = min(own.get(k, n), n)
            self.ids.append(item)
            self.sizes.append(size)
            texts.append("".join(parts))
            starts.append(start + at)
            ends.append(end + at)
            at += size + 1
        # A sign that no letters hold stands before, between and after the items, so that no match goes on beyond one.
        self.codes = codes_of("\x01" + "".join(t + "\x01" for t in texts))
        self.sizes = np.array(self.sizes, "int64")
        self.begins = 1 + np.cumsum(self.sizes + 1) - self.sizes - 1
        self.starts, self.ends = (np.concatenate([np.zeros(0, "int64"), *x]) for x in (starts, ends))
        self.tables = [self._table(least, range(len(self.ids))), *(self._table(min(own.values()), sorted(own)) for own in classes.values())]

    def _table(self, q: int, of) -> tuple[int, np.ndarray, np.ndarray]:
        """All grams of ``q`` letters of some items: q, hashes in order, their places."""
        at = np.concatenate([np.zeros(0, "int64"), *(np.arange(self.begins[k], self.begins[k] + self.sizes[k] - q + 1) for k in of)])
        hashes = gram_hashes(self.codes, q)[at]
        order = np.argsort(hashes, kind="stable")
        return q, hashes[order], at[order]

    def run_words(self, a: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Whole successive words within the letters a to e, places in the line."""
        return np.searchsorted(self.ends, e, "right") - np.searchsorted(self.starts, a, "left")

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in codes, places in the line, lengths) of all maximal equal runs of a table's gram length or more.

        ``codes`` begins and ends with a sign that no item holds. A pair of equal grams begins a run if the letters before differ and ends one if those behind
        do; along a diagonal the n-th beginning belongs to the n-th end."""
        found = [self._runs(codes, *table) for table in self.tables if len(codes) > table[0]]
        return tuple(np.concatenate([np.zeros(0, "int64"), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, "int64"),) * 3

    def _runs(self, codes: np.ndarray, q: int, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = gram_hashes(codes, q)
        first = np.searchsorted(hashes, h, "left")
        count = np.searchsorted(hashes, h, "right") - first
        where = np.flatnonzero(count)
        first, count = first[where], count[where]
        sides: tuple[list, list] = ([], [])
        for lo, hi in _slices(count):
            n = count[lo:hi]
            w = np.repeat(where[lo:hi], n)
            a = at[np.arange(len(w)) + np.repeat(first[lo:hi] - np.cumsum(n) + n, n)]
            for side, step in zip(sides, (-1, q), strict=True):
                edge = codes[w + step] != self.codes[a + step]
                side.append(self._equal(codes, w[edge], a[edge], q))
        (w, a), (v, b) = (self._ordered(side) for side in sides)
        return w, a, v + q - w

    def _equal(self, codes: np.ndarray, w: np.ndarray, a: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose grams are equal letter by letter, not by hash only."""
        same = np.ones(len(w), bool)
        for i in range(q):
            same &= codes[w + i] == self.codes[a + i]
        return w[same], a[same]

    @staticmethod
    def _ordered(side: list) -> tuple[np.ndarray, np.ndarray]:
        w, a = (np.concatenate([np.zeros(0, "int64"), *x]) for x in (zip(*side, strict=True) if side else ((), ())))
        order = np.lexsort((w, w - a))
        return w[order], a[order]


def _slices(count: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges whose counts add up to about ``most``, at least one index each."""
    total, lo = np.cumsum(count), 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def tile(matches: list[tuple[int, int, int]], least: int, size: int | None = None, words_in: Callable[[int, int], int] = lambda i, n: 0, words: int = 1) -> list[tuple[int, int, int]]:
    """Greedy string tiling: the longest match first; what it covers on either side is cut off the others, until none of ``least`` letters or ``words`` words is left.

    Length is that in whole words of the item (``words_in`` place and letters), then in letters: so the first tile holds as many successive words as any match.
    With ``size``, the item's letters, it ends as soon as too few of them are free. There are never more tiles than size / least, so each match is
    held against few, and a repetitive text with a million matches takes no more than a sort."""
    tiles: list[tuple[int, int, int]] = []
    heap = [(-words_in(i, n), -n, p, i) for p, i, n in set(matches)]
    heapify(heap)
    free, shortest = size, min([least, *(m[2] for m in matches)])
    while heap:
        _, n, p, i = heappop(heap)
        n = -n
        parts = [(0, n)]
        for a, b, m in tiles:
            # The parts of the match outside the tile, seen from both sides.
            for lo in (a - p, b - i):
                if lo < n and lo + m > 0:
                    parts = [(x, y) for s, e in parts for x, y in ((s, min(e, lo)), (max(s, lo + m), e)) if y > x]
        if parts == [(0, n)]:
            tiles.append((p, i, n))
            if free is not None:
                free -= n
                if free < shortest:
                    break
        else:
            for s, e in parts:
                w = words_in(i + s, e - s)
                if e - s >= least or w >= words:
                    heappush(heap, (-w, s - e, p + s, i + s))
    return tiles


def _tiled(words: int, least_tile: int, coverage: float):
    """Each document against its items: maximal matches by Karp-Rabin hashes, tiles, and what they cover."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, own in zip(b["doc_id"].tolist(), b["text"].tolist(), b["items"].tolist()):
                items = Items([(r["item_id"], r["text"]) for r in own], words, least_tile)
                p, i, n = items.matches(codes_of("\x00" + letters(text) + "\x00"))
                runs = items.run_words(i, i + n)
                fit = (n >= least_tile) | (runs >= words)
                p, i, n, runs = p[fit], i[fit], n[fit], runs[fit]
                item = np.searchsorted(items.begins, i, "right") - 1
                order = np.argsort(item, kind="stable")
                p, i, n, runs, item = (x[order] for x in (p, i, n, runs, item))
                first = np.flatnonzero(np.diff(item, prepend=-1))
                for x, y in zip(first.tolist(), [*first[1:].tolist(), len(item)], strict=False):
                    k = int(item[x])
                    size = int(items.sizes[k])
                    # Tiles cover no more than all matches together.
                    if int(runs[x:y].max()) < words and n[x:y].sum() / size < coverage:
                        continue
                    count = lambda a, m: int(items.run_words(a, a + m))
                    tiles = tile(list(zip(p[x:y].tolist(), i[x:y].tolist(), n[x:y].tolist(), strict=True)), least_tile, size, count, words)
                    out.append((doc, items.ids[k], max(count(a, m) for _, a, m in tiles), len(tiles), sum(t[2] for t in tiles) / size))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "run_words", "tiles", "coverage"])

    return run


LEAKS = "doc_id bigint, item_id bigint, run_words int, tiles int, coverage double"


def leaked_items(documents: DataFrame, items: DataFrame, words: int = 12, least_tile: int = 24, coverage: float = 0.6) -> DataFrame:
    """Pairs of a document and an item of which passages occur in it.

    Columns: doc_id, item_id, run_words (whole successive words of the item under the longest tile), tiles (matches that do not
    overlap, longest first), coverage (share of the item's letters under tiles). Matches are all maximal equal runs of at least
    ``least_tile`` letters or ``words`` whole words, wherever they stand. A pair is given if a tile has at least ``words`` words, or if
    coverage is at least ``coverage``, which catches items whose passages stand in another order, however short the item.

    Seeds of both sides are joined by their hash. They are winnowed: every stretch of ``least_tile`` letters that two texts share gives both a seed in common. An item
    whose windows of ``words`` words are shorter than that has all grams of the windows' length class as seeds besides. An item's seed
    weighs as many of its stretches as have it; a pair goes on if the shared seeds weigh what the coverage or the item's shortest window needs at least, so
    nothing is lost. Only then texts meet: each document that shares a seed with any item is kept once, and its items are brought to it, split over at most
    PARTS rows. Nothing is built on the driver but a sieve of fixed size. Every document is matched whole, and read once whatever the number of items.

    Items with fewer than ``words`` words and fewer than ``least_tile`` letters, or without letters, match nothing; null texts and ids match nothing. Repeated rows count
    once. Empty tables give no rows.
    """
    spark = documents.sparkSession
    rows = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    seeds = staged(spread(rows).mapInPandas(_item_seeds(words, least_tile, coverage), "kind int, seed bigint, item_id bigint, weight bigint, need bigint"), "item_seeds")
    kinds = sorted(r["kind"] for r in seeds.select("kind").distinct().collect())
    if not kinds:
        return spark.createDataFrame([], LEAKS)
    sieve = spark.sparkContext.broadcast(sieve_of(seeds, SIEVE_BITS))
    found = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    suspects = staged(found.mapInPandas(_suspects(sieve, kinds, least_tile), "doc_id bigint, text string, seeds array<bigint>"), "suspects")
    asked = suspects.select("doc_id", F.explode("seeds").alias("seed"))
    # An item has one row a seed and kind; texts that stand under one item_id twice may have more.
    own = seeds.groupBy("seed", "item_id").agg(F.sum("weight").alias("weight"), F.min("need").alias("need"))
    pairs = asked.distinct().join(own, "seed").groupBy("doc_id", "item_id").agg(F.sum("weight").alias("w"), F.max("need").alias("need")).where("w >= need")
    per_doc = pairs.select("doc_id", "item_id").join(rows, "item_id").groupBy("doc_id", F.pmod(F.xxhash64("item_id"), F.lit(PARTS)).alias("part")).agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    matched = suspects.select("doc_id", "text").join(per_doc, "doc_id").select("doc_id", "text", "items").mapInPandas(_tiled(words, least_tile, coverage), LEAKS)
    return matched.where((F.col("run_words") >= words) | (F.col("coverage") >= coverage)).groupBy("doc_id", "item_id").agg(F.max("run_words").alias("run_words"), F.max("tiles").alias("tiles"), F.max("coverage").alias("coverage"))
