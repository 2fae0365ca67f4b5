import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import leakage
from weft.llm.leakage import leaked_items, letters, tile


def maximal_matches(doc, item, seeds, q):
    """(doc start, item start, length) of the maximal equal runs through the seeds (doc, item), each run once."""
    done, out = {}, []
    for p, i in sorted(seeds):
        if done.get(p - i, -1) >= p + q or doc[p : p + q] != item[i : i + q]:
            continue
        a, b = p, p + q
        while a > 0 and a - (p - i) > 0 and doc[a - 1] == item[a - 1 - (p - i)]:
            a -= 1
        while b < len(doc) and b - (p - i) < len(item) and doc[b] == item[b - (p - i)]:
            b += 1
        done[p - i] = b
        out.append((a, a - (p - i), b - a))
    return out


def test_letters():
    assert letters("Über&nbsp;ﬁne ②&eacute; á​b­c ＡＢ STRASSE Straße &amp; _x") == "uberfine2eabcabstrassestrassex"
    assert letters("It's 3-fold\r\n") == "its3fold" and letters(None) == "" and letters("—…") == ""
    assert letters("ДОМ дом") == "домдом" and letters("AT&T") == "att"


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=30), st.text("abc", max_size=30), st.integers(1, 4))
def test_tiles_do_not_overlap(a, b, q):
    seeds = [(i, j) for i in range(len(a) - q + 1) for j in range(len(b) - q + 1) if a[i : i + q] == b[j : j + q]]
    matches = maximal_matches(a, b, seeds, q)
    for p, i, n in matches:
        assert a[p : p + n] == b[i : i + n] and (p == 0 or i == 0 or a[p - 1] != b[i - 1])
        assert p + n == len(a) or i + n == len(b) or a[p + n] != b[i + n]
    tiles = tile(matches, q)
    for side in (0, 1):
        cells = [x for t in tiles for x in range(t[side], t[side] + t[2])]
        assert len(cells) == len(set(cells))
    assert not tiles or tiles[0][2] == max(m[2] for m in matches)


def brute(docs, items, words):
    out = set()
    for item, text in items:
        w = [letters(x) for x in (text or "").split()]
        for i in range(len(w) - words + 1):
            s = "".join(w[i : i + words])
            out |= {(d, item) for d, t in docs if s and s in letters(t)}
    return out


WORDS = "the mill and a harbor near old town reads seven books über straße ② again - while I".split()


def make(rng, n, m):
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([5, 12, 13, 20, 40])))) for i in range(m)] + [(m, None), (m + 1, ""), (m + 2, "- " * 20), (m + 3, "a " * 14)]
    docs = []
    for d in range(n):
        t = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(60)))
        if rng.random() < 0.6:
            w = rng.choice(items[:m])[1].split()
            k = rng.randrange(len(w))
            t += rng.choice([" ", "(", "&quot;"]) + rng.choice([" ", " ** ", "​", "&nbsp;"]).join(w[k : k + rng.choice([8, 11, 12, 30])]).upper() + " " + rng.choice(WORDS)
        docs.append((d, t))
    return [*docs, (n, None), (n + 1, ""), (n + 2, "A-" * 400)], items


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, item_id int"), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, coverage int")


@pytest.mark.parametrize("bits", [1 << 27, 64])
def test_against_brute_force(spark, monkeypatch, bits):
    """Also with a sieve that is full and so keeps nothing back."""
    monkeypatch.setattr(leakage, "SIEVE_BITS", bits)
    docs, items = make(random.Random(bits), 120, 25)
    d, i = frames(spark, docs, items + items[:3])
    got = [(r.doc_id, r.item_id) for r in leaked_items(d, i).where("run_words >= 12").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items, 12) and len(got) > 5


def test_reordered_passages_are_covered(spark):
    a = [f"first{i}" for i in range(13)]
    b = [f"second{i}" for i in range(11)]
    docs = [(1, "x " + " ".join(b) + " y " + " ".join(a) + " z"), (2, " ".join(a))]
    d, i = frames(spark, docs, [(7, " ".join(a + b))])
    got = {r.doc_id: r for r in leaked_items(d, i).collect()}
    assert got[1].run_words == 13 and got[2].coverage < 0.6 and got[2].tiles == 1


def test_shuffled_short_pieces_are_covered(spark):
    """No piece of the item has 12 words; wherever the pieces stand, all of them are tiles."""
    rng = random.Random(5)
    pieces = [[f"{w}{k}x{i}" for i in range(rng.randrange(5, 9))] for k, w in enumerate(["first", "second", "third", "fourth", "fifth"])]
    item, short = " ".join(w for p in pieces for w in p), "a brief but telling question of nine words only"
    docs = [(n, "z" * n + " " + " y ".join(" ".join(p) for p in (pieces[3], pieces[0], pieces[4], pieces[2], pieces[1])) + " q " + short) for n in range(30)]
    d, i = frames(spark, docs, [(7, item), (8, short)])
    got = {(r.doc_id, r.item_id): (r.run_words, r.tiles, r.coverage) for r in leaked_items(d, i).collect()}
    assert got == {(n, k): x for n in range(30) for k, x in ((7, (max(map(len, pieces)), 5, 1.0)), (8, (9, 1, 1.0)))}


def test_recall_on_planted_reorderings(spark):
    """Items cut into pieces of 4 to 8 words, some left out, the rest shuffled into other text: every pair is found whose pieces of 24 letters cover enough."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9)))
    items, docs, want = [], [], set()
    for k in range(60):
        pieces = [[word() for _ in range(rng.randrange(4, 9))] for _ in range(rng.randrange(4, 9))]
        items.append((k, " ".join(w for p in pieces for w in p)))
        kept = [p for p in pieces if rng.random() < 0.85]
        rng.shuffle(kept)
        docs.append((k, " ".join(" ".join([word(), *p, word()]) for p in kept)))
        if sum(n for p in kept if (n := len("".join(p))) >= 24) >= 0.6 * len(letters(items[-1][1])):
            want.add((k, k))
    d, i = frames(spark, docs, items)
    got = {(r.doc_id, r.item_id) for r in leaked_items(d, i).collect()}
    assert want <= got and len(want) > 30 and all(a == b for a, b in got)


def test_the_first_tile_has_the_most_words(spark):
    """A match of twelve short words is not cut up by a match of more letters but fewer words."""
    short, long = [f"w{i}" for i in range(12)], [f"unusuallylongword{i}" for i in range(4)]
    docs = [(1, " ".join(short) + " x " + " ".join(short[9:] + long))]
    d, i = frames(spark, docs, [(7, " ".join(short + long))])
    got = leaked_items(d, i).collect()
    assert [r.run_words for r in got] == [12] and got[0].tiles == 2 and got[0].coverage == 1.0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=25), max_size=4), st.lists(st.text("ab ", max_size=25), max_size=4), st.integers(2, 5))
def test_all_maximal_matches_are_found(docs, texts, least):
    items = leakage.Items(list(enumerate(texts)), 12, least)
    w, a, n = items.matches(leakage.codes_of("\x00" + "".join(t + "\x00" for t in docs)))
    begins = [1 + sum(len(t) + 1 for t in docs[:k]) for k in range(len(docs))]
    want = set()
    for begin, doc in zip(begins, docs, strict=True):
        for k, own in ((k, letters(texts[item])) for k, item in enumerate(items.ids)):
            seeds = [(x, y) for x in range(len(doc) - least + 1) for y in range(len(own) - least + 1) if doc[x : x + least] == own[y : y + least]]
            want |= {(begin + x, int(items.begins[k]) + y, m) for x, y, m in maximal_matches(doc, own, seeds, least)}
    assert {m for m in zip(w.tolist(), a.tolist(), n.tolist(), strict=True) if m[2] >= least} == want


def test_empty(spark):
    d, i = frames(spark, [(1, "x")], [(1, "y")])
    assert leaked_items(d.limit(0), i).count() == 0 and leaked_items(d, i.limit(0)).count() == 0
