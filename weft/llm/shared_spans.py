"""Long exact spans shared between records: suffix automata of reference shards, matching statistics of streamed text.

Sending the automaton of every shard to every document would be work in proportion to the square of the corpus. So documents
meet only the shard that can hold their match. Each window of ``least`` characters is keyed by the least hash of the grams
of half that length inside it. Equal windows have equal keys, so they meet in the same shard, and windows that follow each
other mostly share a key and travel as one slice. Keys that occur in a single document are dropped before any text moves.
In a shard the distinct slices are the reference text: their suffix automaton is built, each slice is streamed
through it, and the longest suffix known from another document is the matching statistic at each character.

A shard that is too large for one automaton is split by a second key. All its windows hold the gram of the first key; they are told apart by where it stands in
the window, in classes of a few offsets, and by the text that all windows of a class hold in common. Equal windows meet again, in smaller shards of shorter
slices; what is still too large is split into narrower classes, and in the last each window stands for itself, so that its slices are all equal.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.hashing import batches_by_chars, codes_of, gram_hashes, sliding_min
from weft.session import staged

#: A shard with more distinct slices, or more characters, is split by the next width of offset classes.
SHARD_SLICES = 1_000
SHARD_CHARS = 400_000
WIDTHS = (16, 4, 1)
#: Windows of one slice at most: a text that repeats one gram for ever is cut into several slices.
RUN = 50_000
#: Below every doc_id.
ALL = -(1 << 63)


class SuffixAutomaton:
    """Of several texts, each owned by the documents from ``lo`` to ``hi`` (equal for a single one)."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.lo: list[int | None] = [None]
        self.hi: list[int | None] = [None]

    def _new(self, length: int, link: int, moves: dict[str, int]) -> int:
        self.next.append(moves)
        self.len.append(length)
        self.link.append(link)
        self.lo.append(None)
        self.hi.append(None)
        return len(self.len) - 1

    def _split(self, p: int, c: str, q: int) -> int:
        clone = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, text: str, lo: int, hi: int) -> None:
        """Adds a text and marks the state of every prefix with its owners."""
        nxt, link, length = self.next, self.link, self.len
        last, ends = 0, []
        for c in text:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
            else:
                new, p = self._new(length[last] + 1, 0, {}), last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
                last = new
            ends.append(last)
        for s in ends:
            self._own(s, lo, hi)

    def _own(self, s: int, lo: int, hi: int) -> None:
        if self.lo[s] is None or lo < self.lo[s]:
            self.lo[s] = lo
        if self.hi[s] is None or hi > self.hi[s]:
            self.hi[s] = hi

    def close(self) -> None:
        """Hands owners on to all suffixes; to be called once, after the last text."""
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[s] > 0 and self.lo[s] is not None:
                self._own(self.link[s], self.lo[s], self.hi[s])

    def covered(self, text: str, owner: int, least: int, earlier: bool = False) -> list[tuple[int, int]]:
        """The stretches of an added ``text`` of ``owner`` in which every character lies in a match of ``least`` with another owner, or with a smaller one."""
        out: list[list[int]] = []
        state, nxt, link, length, lo, hi = 0, self.next, self.link, self.len, self.lo, self.hi
        for j, c in enumerate(text, 1):
            state = nxt[state][c]
            s, matched = state, j
            while s > 0 and lo[s] >= owner and (earlier or hi[s] == owner):
                s = link[s]
                matched = length[s]
            if matched >= least and s > 0:
                if out and j - matched <= out[-1][1]:
                    out[-1][0], out[-1][1] = min(out[-1][0], j - matched), j
                else:
                    out.append([j - matched, j])
        return [tuple(x) for x in out]


def _keys(least: int, longest: int):
    """Runs of windows with one key: (key, doc_id, text_id, span_start, span_end)."""
    gram = least // 2
    width = least - gram + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, text_ids, texts = b["doc_id"].to_numpy("int64"), b["text_id"].to_numpy("int64"), b["text"].tolist()
            for lo, hi in batches_by_chars(texts):
                codes = [codes_of(t) for t in texts[lo:hi]]
                sizes = np.array([len(c) for c in codes], "int64")
                whole = np.concatenate(codes)
                if len(whole) < least:
                    continue
                key = sliding_min(gram_hashes(whole, gram), width)
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes - least + 1, 0))
                if not len(doc):
                    continue
                first = np.concatenate([[0], np.cumsum(np.maximum(sizes - least + 1, 0))[:-1]])
                within = np.arange(len(doc)) - first[doc]
                key = key[starts[doc] + within]
                new = within % longest == 0
                new[1:] |= (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                end = np.concatenate([at[1:], [len(doc)]]) - 1
                yield pd.DataFrame({"key": key[at].view("int64"), "doc_id": ids[lo:hi][doc[at]], "text_id": text_ids[lo:hi][doc[at]], "span_start": within[at], "span_end": within[end] + least})

    return run


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [(k, d, i, s, t[s:e]) for d, i, t, runs in zip(b["doc_id"], b["text_id"], b["text"], b["runs"]) for k, s, e in ((r["key"], r["span_start"], r["span_end"]) for r in runs)]
        yield pd.DataFrame(out, columns=["key", "doc_id", "text_id", "span_start", "slice"])


FOUND = "key bigint, slice_id binary, a bigint, e bigint, since bigint"


def _match(least: int, earlier: bool):
    """Per shard (rows of one key follow each other): the covered stretches of each slice, and the smallest doc_id for which they are."""

    def shard(key: int, rows: list[tuple]) -> Iterator[tuple]:
        asked = rows if earlier else [r for r in rows if r[2] == r[3]]
        yield from ((key, m, 0, len(t), lo + 1 if earlier else ALL) for m, t, lo, hi in rows if lo != hi)
        if not asked or len(rows) == 1:
            return
        automaton = SuffixAutomaton()
        for _, t, lo, hi in rows:
            automaton.add(t, lo, hi)
        automaton.close()
        for m, t, lo, _ in asked:
            for a, e in automaton.covered(t, lo, least, earlier):
                yield key, m, a, e, lo if earlier else ALL

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows, out = None, [], []
        for b in batches:
            for key, m, t, lo, hi in zip(b["key"].tolist(), b["slice_id"].tolist(), b["slice"].tolist(), b["lo"].tolist(), b["hi"].tolist()):
                if key != at:
                    out += shard(at, rows) if rows else ()
                    at, rows = key, []
                rows.append((m, t, lo, hi))
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["key", "slice_id", "a", "e", "since"])
                out = []
        out += shard(at, rows) if rows else ()
        yield pd.DataFrame(out, columns=["key", "slice_id", "a", "e", "since"])

    return run


PART = "key bigint, anchor bigint, of_key bigint, of_slice binary, at bigint, slice string, slice_id binary, lo bigint, hi bigint"


def _parts(least: int, width: int):
    """The windows of a slice by class of offsets of the anchor gram, and by what all windows of the class hold in common.

    A window's offset is that of the first anchor in it, so equal windows have equal offsets. In classes of a single offset a window is known by its digest,
    and its text isn't handed on."""
    gram = least // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for of_key, anchor, of_slice, t, lo, hi in zip(*(b[c].tolist() for c in ("key", "anchor", "slice_id", "slice", "lo", "hi"))):
                places = np.flatnonzero(gram_hashes(codes_of(t), gram).view("int64") == anchor)
                w = np.arange(len(t) - least + 1)
                place = places[np.searchsorted(places, w)]
                kind = (place - w) // width
                first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (kind[1:] != kind[:-1])]))
                for x, y in zip(first.tolist(), [*first[1:].tolist(), len(w)]):
                    p, k = int(place[x]), int(kind[x])
                    # All windows of the class hold what stands between the last one's start and the first one's end.
                    common = t[p - k * width : p - (k + 1) * width + 1 + least]
                    digest = md5(common.encode("utf-8", "surrogatepass")).digest()
                    key = int.from_bytes(digest[:8], "little", signed=True) ^ k
                    piece = t[x : y - 1 + least]
                    own = digest if width == 1 else md5(piece.encode("utf-8", "surrogatepass")).digest()
                    out.append((key, anchor, of_key, of_slice, x, None if width == 1 else piece, own, lo, hi))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["key", "anchor", "of_key", "of_slice", "at", "slice", "slice_id", "lo", "hi"])
                    out = []
            yield pd.DataFrame(out, columns=["key", "anchor", "of_key", "of_slice", "at", "slice", "slice_id", "lo", "hi"])

    return run


def _solved(distinct: DataFrame, least: int, earlier: bool, slices: int, chars: int, widths: Sequence[int]) -> DataFrame:
    """FOUND for the distinct slices (key, anchor, slice_id, slice, lo, hi) of all shards, the large ones split by ``widths``."""
    large = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("slice")).alias("chars")).where((F.col("n") > slices) | (F.col("chars") > chars) & (F.col("n") > 1)).select("key")
    large = staged(large, "large")
    split = not large.isEmpty()
    small = distinct.join(large, "key", "left_anti") if split else distinct
    matched = small.select("key", "slice_id", "slice", "lo", "hi").repartition("key").sortWithinPartitions("key").mapInPandas(_match(least, earlier), FOUND)
    if not split:
        return matched
    parts = staged(distinct.join(large, "key", "left_semi").select("key", "anchor", "slice_id", "slice", "lo", "hi").mapInPandas(_parts(least, widths[0]), PART), "parts")
    inner = parts.groupBy("key", "slice_id").agg(F.any_value("anchor").alias("anchor"), F.any_value("slice").alias("slice"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    if widths[0] == 1:
        since = F.col("lo") + 1 if earlier else F.lit(ALL)
        inside = inner.where("lo <> hi").select("key", "slice_id", F.lit(0).cast("bigint").alias("a"), F.lit(least).cast("bigint").alias("e"), since.cast("bigint").alias("since"))
    else:
        inside = _solved(staged(inner, "inner"), least, earlier, slices, chars, widths[1:])
    back = parts.select("key", "slice_id", "of_key", "of_slice", "at").join(inside, ["key", "slice_id"])
    return matched.unionByName(back.select(F.col("of_key").alias("key"), F.col("of_slice").alias("slice_id"), (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("e")).alias("e"), "since"))


def merge_spans(spans: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(*by, span_start, span_end) with overlapping and touching spans of a document made one."""
    order = Window.partitionBy(*by).orderBy("span_start", "span_end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce((F.col("span_start") > F.max("span_end").over(before)).cast("int"), F.lit(1))
    marked = spans.withColumn("_new", new).withColumn("_k", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*by, "_k").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")).drop("_k")


def _spans(documents: DataFrame, least: int, earlier: bool, shard_slices: int, shard_chars: int, run: int) -> DataFrame:
    """(doc_id, text_id, span_start, span_end); text_id tells different texts under one doc_id apart."""
    docs = documents.select("doc_id", "text").where((F.length("text") >= least) & F.col("doc_id").isNotNull())
    docs = docs.withColumn("_m", F.unhex(F.md5("text"))).withColumn("text_id", F.xxhash64("text"))
    repeated = docs.groupBy("_m").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    tagged = docs.join(repeated, "_m", "left")
    whole = tagged.where("doc_id > _lo" if earlier else "_lo <> _hi").select("doc_id", "text_id", F.lit(0).cast("bigint").alias("span_start"), F.length("text").cast("bigint").alias("span_end"))
    # Each text once: copies under the smallest id, of which only rows that are repeated under it have to be brought together.
    one = ["doc_id", "text_id", "text"]
    work = tagged.where("_n is null").select(one).unionByName(tagged.where("doc_id = _lo").dropDuplicates(["_m"]).select(one))

    keys = staged(work.mapInPandas(_keys(least, run), "key bigint, doc_id bigint, text_id bigint, span_start bigint, span_end bigint"), "keys")
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).where("_lo <> _hi").select("key")
    runs = keys.join(shared, "key").groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("key", "span_start", "span_end")).alias("runs"))
    text = docs.select("doc_id", "text_id", "text").join(runs, ["doc_id", "text_id"])
    slices = staged(text.mapInPandas(_slices, "key bigint, doc_id bigint, text_id bigint, span_start bigint, slice string").withColumn("slice_id", F.unhex(F.md5("slice"))), "slices")

    distinct = staged(slices.groupBy("key", "slice_id").agg(F.any_value("slice").alias("slice"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).withColumn("anchor", F.col("key")), "distinct")
    found = _solved(distinct, least, earlier, shard_slices, shard_chars, WIDTHS)
    where = slices.select("key", "slice_id", "doc_id", "text_id", "span_start").join(found, ["key", "slice_id"]).where("doc_id >= since")
    spans = where.select("doc_id", "text_id", (F.col("span_start") + F.col("a")).alias("span_start"), (F.col("span_start") + F.col("e")).alias("span_end"))
    return merge_spans(spans.unionByName(whole), ["doc_id", "text_id"])


def shared_spans(documents: DataFrame, least: int = 300, shard_slices: int = SHARD_SLICES, shard_chars: int = SHARD_CHARS, run: int = RUN) -> DataFrame:
    """(doc_id, span_start, span_end): the maximal stretches in which every character lies in a run of at least ``least``
    characters (at least 4) that also occurs in a document of another doc_id.

    Exact for texts of any length and for stretches of any number of documents. Positions count code points. Null and short texts have no spans; copies of a text
    are wholly shared and take part once; rows repeated under one doc_id are one document; different texts under one doc_id are looked at one by one,
    and each gives its own stretches. An empty table gives no rows.
    """
    return _spans(documents, least, False, shard_slices, shard_chars, run).select("doc_id", "span_start", "span_end").distinct()


def remove_spans(documents: DataFrame, least: int = 300, shard_slices: int = SHARD_SLICES, shard_chars: int = SHARD_CHARS, run: int = RUN) -> DataFrame:
    """(doc_id, text, removed): each text without the maximal stretches of at least ``least`` characters that also occur in a document of smaller doc_id.

    So every stretch stays where it stands first, and no document holds one of an earlier document any more, but for what closes up anew where a piece was taken out.
    ``removed`` counts characters. Copies of a text but the first become empty. Null texts stay null. All rows come out, repeated ones too.
    """
    spans = _spans(documents, least, True, shard_slices, shard_chars, run).groupBy("doc_id", "text_id").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias("_cut"))
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("text_id")).join(spans, ["doc_id", "text_id"], "left")
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.col("_cut.span_end"))
    ends = F.concat(F.col("_cut.span_start"), F.array(F.length("text").cast("bigint")))
    kept = F.array_join(F.zip_with(begins, ends, lambda b, e: F.substring(F.col("text"), (b + 1).cast("int"), (e - b).cast("int"))), "")
    gone = F.aggregate("_cut", F.lit(0).cast("bigint"), lambda n, x: n + x["span_end"] - x["span_start"])
    return rows.select("doc_id", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(gone, F.lit(0).cast("bigint")).alias("removed"))


def shared_amounts(documents: DataFrame, least: int = 300) -> DataFrame:
    """(doc_id, n_chars, n_spans, shared_chars, shared_share) for every document; texts without a shared span have 0."""
    spans = shared_spans(documents, least).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    docs = documents.groupBy("doc_id").agg(F.coalesce(F.max(F.length("text")), F.lit(0)).cast("bigint").alias("n_chars"))
    out = docs.join(spans, "doc_id", "left").na.fill(0, ["n_spans", "shared_chars"])
    return out.withColumn("shared_share", F.coalesce(F.try_divide(F.col("shared_chars").cast("double"), F.col("n_chars").cast("double")), F.lit(0.0)))
