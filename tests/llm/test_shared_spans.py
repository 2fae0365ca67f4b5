import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm.hashing import codes_of, gram_hashes, sliding_min
from weft.llm.shared_spans import SuffixAutomaton, merge_spans, remove_spans, shared_amounts, shared_spans


def brute(rows, least, earlier=False):
    where = {}
    for d, t in rows:
        for i in range(len(t or "") - least + 1):
            where.setdefault(t[i : i + least], set()).add(d)
    out = set()
    for d, t in rows:
        spans = []
        for i in range(len(t or "") - least + 1):
            if min(where[t[i : i + least]]) < d if earlier else len(where[t[i : i + least]]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + least
                else:
                    spans.append([i, i + least])
        out |= {(d, a, b) for a, b in spans}
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=14), min_size=1, max_size=5), st.integers(1, 5))
def test_automaton(texts, least):
    m = SuffixAutomaton()
    for i, t in enumerate(texts):
        m.add(t, i, i)
    m.close()
    want = brute(list(enumerate(texts)), least)
    assert {(i, a, b) for i, t in enumerate(texts) for a, b in m.covered(t, i, least)} == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 12))
def test_sliding_min(xs, width):
    import numpy as np

    if width <= len(xs):
        assert sliding_min(np.array(xs, "uint64"), width).tolist() == [min(xs[i : i + width]) for i in range(len(xs) - width + 1)]


def test_gram_hashes_do_not_depend_on_the_place():
    h = gram_hashes(codes_of("xyzabcdefg-abcdefg😀"), 7)
    assert h[3] == h[11] and len(set(h.tolist())) == len(h) - 1


def corpus(rng, n, letters, size):
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(size))) for _ in range(n)]
    for _ in range(n):
        a, b = rng.randrange(n), rng.randrange(n)
        i, j, k = rng.randrange(len(texts[a]) + 1), rng.randrange(len(texts[b]) + 1), rng.randrange(5, 60)
        texts[b] = texts[b][:j] + texts[a][i : i + k] + texts[b][j:]
    return texts


SCHEMA = "doc_id bigint, text string, key string, lo int, span_start int"


@pytest.mark.parametrize(("letters", "kw"), [("abcdefghij äß😀", {}), ("abcdefghij äß😀", {"shard_slices": 1}), ("ab", {}), ("ab", {"shard_chars": 200}), ("abcd", {"shard_slices": 1, "run": 7})])
def test_against_brute_force(spark, letters, kw):
    rng = random.Random(len(letters))
    texts = corpus(rng, 60, letters, 200)
    rows = [(i, t, "k", 1, 2) for i, t in enumerate(texts)] + [(100, texts[3], "k", 1, 2), (101, texts[3], "k", 1, 2), (102, None, None, None, None), (103, "", "k", 1, 2), (104, "a" * 3000, "k", 1, 2), (105, "a" * 2000 + "b", "k", 1, 2), (3, texts[3], "k", 1, 2)]
    got = [tuple(r) for r in shared_spans(spark.createDataFrame(rows, SCHEMA).repartition(5), 20, **kw).collect()]
    assert len(got) == len(set(got)) and set(got) == brute([r[:2] for r in rows], 20)
    later = brute([r[:2] for r in rows], 20, True)
    texts = dict((r[0], r[1]) for r in rows)
    want = {}
    for d, t in texts.items():
        cut = sorted((a, b) for x, a, b in later if x == d)
        want[d] = t and "".join(t[a:b] for a, b in zip([0, *(b for _, b in cut)], [*(a for a, _ in cut), len(t)]))
    kept = remove_spans(spark.createDataFrame(rows, SCHEMA).repartition(5), 20, **kw).collect()
    assert len(kept) == len(rows) and {r.doc_id: r.text for r in kept} == want
    assert all(r.removed == len(texts[r.doc_id] or "") - len(r.text or "") for r in kept)


def test_different_texts_under_one_id(spark):
    x, y = "a quick brown fox and a lazy dog", "ten green bottles on a tall wall"
    rows = [(1, "....." + x, "", 0, 0), (1, y + "!", "", 0, 0), (2, x, "", 0, 0), (3, "<" + y, "", 0, 0), (1, x[:25] + y[:25], "", 0, 0)]
    got = {tuple(r) for r in shared_spans(spark.createDataFrame(rows, SCHEMA), 20).collect()}
    assert got == {(1, 5, 5 + len(x)), (1, 0, len(y)), (2, 0, len(x)), (3, 1, 1 + len(y)), (1, 0, 50)}


def test_a_hot_stretch_in_a_third_of_the_documents(spark):
    rng = random.Random(1)
    phrase = "".join(rng.choice("abcdefgh") for _ in range(25))
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(60)) + (phrase if i % 3 == 0 else "") + "".join(rng.choice("abcdefgh") for _ in range(60)), "", 0, 0) for i in range(150)]
    want = brute([r[:2] for r in rows], 20)
    assert len(want) >= 50
    for kw in ({}, {"shard_slices": 5}, {"shard_slices": 1}, {"shard_chars": 100}):
        assert {tuple(r) for r in shared_spans(spark.createDataFrame(rows, SCHEMA), 20, **kw).collect()} == want


def test_nothing_shared_and_amounts(spark):
    df = spark.createDataFrame([(1, "abc" * 20, "", 0, 0), (2, "xyz" * 20 + "abcabcabcabcabc", "", 0, 0), (3, None, "", 0, 0)], SCHEMA)
    got = {r.doc_id: r for r in shared_amounts(df, 12).collect()}
    assert got[1].shared_chars == 60 and got[2].shared_chars == 15 and got[3].shared_share == 0 and got[2].n_spans == 1
    assert shared_spans(df.limit(0), 12).count() == 0 and shared_spans(df.where("doc_id <> 1"), 12).count() == 0
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 12), (1, 10, 11), (2, 3, 4)], "doc_id bigint, span_start bigint, span_end bigint")
    assert sorted(map(tuple, merge_spans(spans).collect())) == [(1, 0, 7), (1, 9, 12), (2, 3, 4)]
