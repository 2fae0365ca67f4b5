"""Properties of retrieval on random corpora."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weft.operators import index, search

WORDS = [f"word{i}" for i in range(15)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    docs = {f"d{i:02}": [rng.choice(WORDS) for _ in range(rng.randrange(25))] for i in range(40)}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id string, text string")
    build = lambda x: index.term_weights(index.document_postings(x, "text"), 50).persist()
    return docs, build(df), build(df.orderBy(F.rand(1)).repartition(7))


def model(docs, query, phrase=()):
    freq = {d: {t: w.count(t) for t in set(w)} for d, w in docs.items()}
    df = {t: sum(t in f for f in freq.values()) for t in WORDS}
    weight = {d: {t: n / max(f.values()) * math.log2(50 / df[t]) for t, n in f.items()} for d, f in freq.items()}
    out = {}
    for d, w in docs.items():
        own = weight[d]
        s = [own[t] for t in query if t in own]
        if phrase and any(w[i : i + len(phrase)] == list(phrase) for i in range(len(w))):
            s.append(sum(own[t] for t in phrase))
        if s:
            out[d] = 29 * sum(s) / (math.sqrt(sum(x * x for x in own.values())) * math.sqrt(len(query) + len(phrase)))
    return out


def ask(weighted, text, **kw):
    return {r.doc_id: (r.final_rank, r.body_rank) for r in search.search(weighted, index.magnitudes(weighted), text, k=1000, **kw).collect()}


@pytest.mark.parametrize(("query", "phrase"), [(["word1"], []), (["word1", "word2", "word1"], []), ([], ["word3", "word4"]), (["word5"], ["word1", "word2"]), (["word0", "word9"], ["word7"]), (["none"], [])])
def test_scores_equal_the_model(corpus, query, phrase):
    docs, weighted, other = corpus
    text = " ".join(query) + (f' "{" ".join(phrase)}"' if phrase else "")
    got, want = ask(weighted, text), model(docs, query, phrase)
    assert got.keys() == want.keys()
    for d, s in want.items():
        assert got[d][0] == pytest.approx(s, rel=1e-5)
    assert {d: round(s[0], 6) for d, s in ask(other, text).items()} == {d: round(s[0], 6) for d, s in got.items()}
    if len(set(query + phrase)) == len(query + phrase):
        assert all(0 <= b <= 1 + 1e-6 for _, b in got.values())


def test_a_phrase_needs_all_its_terms(corpus):
    docs, weighted, _ = corpus
    found = ask(weighted, '"word1 word2 word3"')
    assert all({"word1", "word2", "word3"} <= set(docs[d]) for d in found)
    assert set(ask(weighted, 'word5 "word1 word2"', require_phrase=True)) == set(ask(weighted, '"word1 word2"'))
