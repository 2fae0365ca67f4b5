"""Items of varying length into containers of fixed capacity: hierarchical residual packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.tokens import VOCABULARY, count_tokens
from weft.session import staged

#: A bin with no more than this share of its room empty leaves the packing at once.
SLACK = 0.01
#: How many partitions are merged into one from round to round, and how many items or underfull bins a task packs at a time.
FAN_IN = 8
TASK_BINS = 400_000
#: A round that leaves more than this share of the underfull bins underfull has found nothing to merge.
PROGRESS = 0.98

BIN = "size bigint, items array<struct<doc_id:bigint,piece:int,start:bigint,size:bigint>>, done boolean"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of ``sizes`` (each from 1 to ``capacity``) grouped into bins, largest first, each into the fullest bin that holds it.

    The residual capacities that occur are kept as bits of one number, so the least that suffices is found in one step.
    """
    by_room: dict[int, list[int]] = {}
    rooms, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = by_room[room]
            b = own.pop()
            if not own:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins


def _round(capacity: int, slack: float, most: int):
    """Packs a partition's bins, as whole items, into fuller bins, ``most`` of them at a time."""
    enough = capacity - int(capacity * slack)

    def packed(sizes: list[int], items: list) -> Iterator[pd.DataFrame]:
        bins = best_fit(sizes, capacity)
        for at in range(0, len(bins), 20_000):
            part = bins[at : at + 20_000]
            totals = [sum(sizes[i] for i in p) for p in part]
            yield pd.DataFrame({"size": totals, "items": [[dict(x) if isinstance(x, dict) else x.asDict() for i in p for x in items[i]] for p in part], "done": [t >= enough for t in totals]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, items = [], []
        for b in batches:
            sizes += b["size"].tolist()
            items += b["items"].tolist()
            if len(sizes) >= most:
                yield from packed(sizes, items)
                sizes, items = [], []
        yield from packed(sizes, items)

    return run


def _pieces(capacity: int, vocabulary: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            doc, piece, start, size = [], [], [], []
            for d, t in zip(b["doc_id"].tolist(), b["text"].tolist()):
                n = count_tokens(t, vocabulary)
                for k in range(max(1, -(-n // capacity))):
                    doc.append(d)
                    piece.append(k)
                    start.append(k * capacity)
                    size.append(min(capacity, n - k * capacity))
            yield pd.DataFrame({"doc_id": doc, "piece": piece, "start": start, "size": size})

    return run


def pieces(documents: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, size): each document as one item, or, longer than ``capacity`` tokens, cut into full ones and a rest."""
    return documents.select("doc_id", "text").mapInPandas(_pieces(capacity, vocabulary), "doc_id bigint, piece int, start bigint, size bigint")


def pack(items: DataFrame, capacity: int = 2048, slack: float = SLACK, fan_in: int = FAN_IN, task_bins: int = TASK_BINS) -> DataFrame:
    """Assigns every item (doc_id, piece, start, size) to a bin of ``capacity``; no item is split.

    First each partition packs its own items best-fit and lets nearly full bins go. What stays underfull is an item of
    the next round, in which ``fan_in`` partitions are merged into one. While one partition would have more than ``task_bins`` of them, they are shared out over so many more,
    mixed anew in each round, until all are in one partition or a round merges (almost) nothing, as with bins that are all more than half full. So every underfull
    bin meets others in every round, at any size. A bin holds at most ``capacity`` items, so nothing grows with the data.

    Columns: doc_id, piece, start, size, bin_id, bin_size. Items of size 0 or less need no room: their bin_id is null. Items larger
    than the capacity are an error of the caller and raise. Of rows with equal doc_id and piece one is packed, the largest. Rows without doc_id or piece can't be told
    apart and are left out.
    """
    items = items.where("doc_id is not null and piece is not null").groupBy("doc_id", "piece").agg(F.max(F.struct("size", "start")).alias("x")).select("doc_id", "piece", "x.start", "x.size")
    sized = items.where("size > 0").withColumn("size", F.when(F.col("size") <= capacity, F.col("size")).otherwise(F.raise_error(F.lit("an item exceeds the capacity")).cast("bigint")))
    full = sized.where(F.col("size") == capacity)
    one = F.array(F.struct("doc_id", "piece", "start", "size")).alias("items")
    step = _round(capacity, slack, task_bins)
    state = staged(sized.where(F.col("size") < capacity).select("size", one).mapInPandas(step, BIN), "packing")
    parts = [full.select("size", one), state.where("done").select("size", "items")]
    n = max(1, state.rdd.getNumPartitions())
    left = state.where("not done")
    count = left.count()
    while count > 1:
        fewer = max(-(-n // fan_in), -(-count // task_bins))
        before, n, last = count, fewer, n
        state = staged(left.select("size", "items").repartition(n).mapInPandas(step, BIN), "packing")
        parts.append(state.where("done").select("size", "items"))
        left = state.where("not done")
        count = left.count()
        if n == 1 or n >= last and count > PROGRESS * before:
            break
    parts.append(left.select("size", "items"))
    bins = parts[0]
    for p in parts[1:]:
        bins = bins.unionByName(p)
    first = F.col("items")[0]
    # A bin is known by its first item: that item is in no other bin.
    bin_id = F.concat_ws("-", first["doc_id"].cast("string"), first["piece"].cast("string"))
    placed = bins.select(bin_id.alias("bin_id"), F.col("size").alias("bin_size"), F.explode("items").alias("x")).select("x.*", "bin_id", "bin_size")
    empty = items.where("size <= 0 or size is null").select("doc_id", "piece", "start", "size", F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("bigint").alias("bin_size"))
    return placed.unionByName(empty)


def pack_documents(documents: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents, in tokens of ``vocabulary``, assigned to containers; only texts longer than a container are cut."""
    return pack(staged(pieces(documents, capacity, vocabulary), "pieces"), capacity)
