from fractions import Fraction
from math import comb, exp, log

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm.distinctive import enrichment, log_factorial, log_upper_tail, words_entries


def exact(k, n, K, N):
    return sum(Fraction(comb(K, i) * comb(N - K, n - i), comb(N, n)) for i in range(max(k, 0, n + K - N), min(n, K) + 1))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 300).flatmap(lambda N: st.tuples(st.integers(0, 40), st.integers(0, N), st.integers(0, N), st.just(N))))
def test_tail_is_exact(x):
    k, n, K, N = x
    p = exact(k, n, K, N)
    got = log_upper_tail(*[np.array([v]) for v in x])[0]
    if p == 0:
        assert got == -np.inf
    else:
        assert got == pytest.approx(log(p), rel=1e-7, abs=1e-10)


def test_large_counts_stay_finite():
    got = log_upper_tail(np.array([1.0, 50.0, 3.0]), np.array([200.0, 200.0, 1000.0]), np.array([3e7, 3e7, 3.0]), np.array([1e9] * 3))
    assert np.isfinite(got).all() and (got <= 0).all() and got[1] < got[0]
    assert log_factorial(np.array([0, 1, 5, 100])) == pytest.approx([0, 0, log(120), 363.73937555556347])


def brute(rows):
    per = {}
    for f, t, d, occ, _ in rows:
        if None not in (f, t, d):
            per[f, t, d] = max(per.get((f, t, d), 0), occ or 0, 0)
    out = {}
    for (f, t, d), k in per.items():
        n = sum(v for (a, _, c), v in per.items() if (a, c) == (f, d))
        K = sum(v for (a, b, _), v in per.items() if (a, b) == (f, t))
        N = sum(v for (a, _, _), v in per.items() if a == f)
        out[f, t, d] = float(exact(k, n, K, N)) if k > 0 else 1.0
    score = {}
    for f, d in {(a, c) for a, _, c in out}:
        own = sorted((p, t) for (a, t, c), p in out.items() if (a, c) == (f, d))
        q = 1.0
        for rank in range(len(own), 0, -1):
            q = min(q, own[rank - 1][0] * len(own) / rank)
            score[f, own[rank - 1][1], d] = max(0.0, -log(q))
    return score


SCHEMA = "field string, term string, doc_id string, occ bigint, tf float, x int, score string"


def test_scores_against_brute_force(spark):
    rng = np.random.default_rng(3)
    ids = ["0" * 31 + "a", "plain id", "", "F" * 32, "0123456789abcdef"]
    rows = [(str(rng.choice(["title", "body"])), f"t{rng.integers(12)}", str(rng.choice(ids)), int(rng.integers(1, 6)), 0.5, 1, "s") for _ in range(90)]
    rows += [rows[0], (None, "t", "d", 1, 0.1, 1, "s"), ("body", None, "d", 1, 0.1, 1, "s"), ("body", "t0", None, 1, 0.1, 1, "s"), ("body", "zero", "plain id", None, None, 1, "s"), ("body", "neg", "plain id", -1, None, 1, "s")]
    got = {(r.field, r.term, r.doc_id): r.score for r in enrichment(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute([r[:5] for r in rows])
    assert got.keys() == want.keys()
    for key, s in want.items():
        assert got[key] == pytest.approx(s, rel=1e-6, abs=1e-8), key


def test_empty_and_common_terms(spark):
    assert enrichment(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("body", t, f"d{i}", 3, 1.0, 1, "") for i in range(40) for t in ("common", f"own{i}")]
    got = {(r.term, r.doc_id): r.score for r in enrichment(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["own1", "d1"] > 5 and got["common", "d1"] < 0.7 and exp(-got["common", "d1"]) <= 1


def test_records_may_span_batches(spark):
    rng = np.random.default_rng(8)
    rows = [("body", f"t{i}", f"d{int(rng.integers(6))}", int(rng.integers(1, 5)), 0.5, 1, "s") for i in range(30) for _ in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(r.term, r.doc_id): r.score for r in enrichment(df).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {(r.term, r.doc_id): r.score for r in enrichment(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 60


def test_words_of_the_last_version(spark):
    docs = spark.createDataFrame([(1, 1, "a", {"t": 1}), (2, 2, "a", {"t": 4, "s": 2}), (3, 1, "b", None), (4, 1, None, {"t": 1}), (5, 1, "c", {})], "seq bigint, w int, doc_id string, words map<string,bigint>").selectExpr("*", "timestamp_seconds(w) AS written_at")
    assert sorted((r.term, r.doc_id, r.occ, r.tf) for r in words_entries(docs).collect()) == [("s", "a", 2, 0.5), ("t", "a", 4, 1.0)]
