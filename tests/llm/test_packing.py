import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.llm.packing import best_fit, pack, pack_documents
from weft.llm.tokens import count_tokens, encoder


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit(sizes):
    bins = best_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    fill = [sum(sizes[i] for i in b) for b in bins]
    assert all(f <= 50 for f in fill) and sum(f <= 25 for f in fill) <= 1
    # The same by looking at every bin.
    rooms: list[int] = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in range(len(rooms)) if rooms[r] >= s]
        if fits:
            rooms[min(fits, key=lambda r: rooms[r])] -= s
        else:
            rooms.append(50 - s)
    assert sorted(50 - r for r in rooms) == sorted(fill)


def items(spark, sizes, parts=16):
    rows = [(i, 0, 0, s, "x") for i, s in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, size bigint, bin_id string").repartition(parts)


@pytest.mark.parametrize("task_bins", [400_000, 60])
def test_every_item_in_one_bin(spark, task_bins):
    sizes = [(i * 7919) % 2048 + 1 for i in range(1500)] + [2048, 0, -1]
    got = pack(items(spark, sizes), 2048, task_bins=task_bins).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(sizes)))
    fill = {}
    for r in got:
        if r.bin_id is None:
            assert r.size <= 0
        else:
            fill.setdefault(r.bin_id, []).append(r)
    assert all(sum(r.size for r in b) == b[0].bin_size <= 2048 for b in fill.values())
    least = sum(max(s, 0) for s in sizes) / 2048
    assert len(fill) <= 1.02 * least + 1


def test_bins_that_cannot_be_merged(spark):
    """All more than half full: every item is a bin, and the rounds end."""
    got = pack(items(spark, [1100 + i % 100 for i in range(300)]), 2048, task_bins=20).collect()
    assert len(got) == 300 == len({r.bin_id for r in got})


def test_rows_without_an_id(spark):
    rows = [(None, 0, 0, 5), (None, 0, 0, 6), (1, 0, 0, 5), (2, None, 0, 5)]
    got = pack(spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, size bigint"), 10).collect()
    assert [r.doc_id for r in got] == [1]


def test_repeated_and_oversized_items(spark):
    df = items(spark, [5, 6])
    assert pack(df.unionByName(df), 10).count() == 2
    with pytest.raises(Exception, match="exceeds"):
        pack(items(spark, [5]), 4).collect()
    assert pack(df.limit(0), 10).count() == 0


def test_documents(spark):
    long = "word " * 5000
    df = spark.createDataFrame([(1, "a b c", 9), (2, None, 9), (3, "", 9), (4, long, 9), (5, "a b c", 9)], "doc_id bigint, text string, size int")
    got = {(r.doc_id, r.piece): r for r in pack_documents(df).collect()}
    n = count_tokens(long)
    assert sum(r.size for (d, _), r in got.items() if d == 4) == n > 2048 * 2
    assert all(r.size == 2048 for (d, p), r in got.items() if d == 4 and p < n // 2048)
    assert got[2, 0].bin_id is None and got[3, 0].size == 0 and got[1, 0].bin_id == got[5, 0].bin_id
    assert got[1, 0].size == len(encoder().encode_ordinary("a b c")) and count_tokens(None) == 0
    assert pack_documents(df.where(F.lit(False))).count() == 0
