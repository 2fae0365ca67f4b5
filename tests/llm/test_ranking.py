import random

from weft.llm.ranking import SCORES, ideal_point_ranking

SCHEMA = "result_id bigint, query_id bigint, doc_id string, page_rank double, title_rank double, body_rank double, n int, closeness string"


def make(rng, n, queries):
    v = lambda s: rng.choice([None, float("nan"), 0.0, s * round(rng.random(), 2)])
    return [(i, rng.choice(queries), f"d{rng.randrange(n // 2)}", v(1e-4), v(1.0), v(900.0), 1, "x") for i in range(n)]


def high(rows):
    first = {}
    for r in sorted(rows):
        if r[1] is not None:
            first.setdefault((r[1], r[2]), r[3:6])
    ok = lambda x: x is not None and x == x
    out = set()
    for (q, d), s in first.items():
        own = [t for (p, _), t in first.items() if p == q]
        if all(ok(s[j]) and 10 * sum(ok(t[j]) and t[j] > s[j] for t in own) < len(own) for j in range(3)):
            out.add((q, d))
    return out, first


def test_standing_is_exact_with_ties_and_a_hot_query(spark):
    rng = random.Random(2)
    rows = make(rng, 600, [1, 1, 1, 2, 3, None])
    want, first = high(rows)
    got = ideal_point_ranking(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.query_id, r.doc_id) for r in got} == set(first) and len(got) == len(first)
    assert {(r.query_id, r.doc_id) for r in got if r.stands_high} == want
    assert all(r.closeness >= r.bar - 1e-9 for r in got if r.stands_high) and any(r.closeness < r.bar for r in got)
    for q in (1, 2, 3):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert all((-a.closeness, a.doc_id) <= (-b.closeness, b.doc_id) for a, b in zip(own, own[1:]))
        assert all(0 <= r.closeness <= 1 for r in own)


def test_no_score_dominates_by_its_range(spark):
    rows = [(i, 1, f"d{i}", 1e-6 * i, 0.5, 1.0, 0, "") for i in range(50)] + [(99, 1, "z", 0.0, 0.5, 1e6, 0, "")]
    got = {r.doc_id: r["rank"] for r in ideal_point_ranking(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["d49"] < got["z"]


def test_a_scale_changes_nothing(spark):
    rows = make(random.Random(4), 80, [1])
    scaled = [(*r[:3], None if r[3] is None else r[3] * 1024, *r[4:]) for r in rows]
    a, b = ({r.doc_id: r["rank"] for r in ideal_point_ranking(spark.createDataFrame(x, SCHEMA)).collect()} for x in (rows, scaled))
    assert a == b


def test_edge_cases(spark):
    assert ideal_point_ranking(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 1, "a", None, None, None, 0, ""), (2, 1, "b", None, None, None, 0, ""), (3, 2, "a", 1.0, 1.0, 1.0, 0, ""), (4, 2, "a", 9.0, 9.0, 9.0, 0, ""), (5, 3, None, 1.0, 1.0, 1.0, 0, "")]
    got = {(r.query_id, r.doc_id): r for r in ideal_point_ranking(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "a")}
    assert got[1, "a"].closeness == 0.5 and got[1, "a"]["rank"] == 1 and not got[1, "a"].stands_high
    assert got[2, "a"].stands_high and got[2, "a"].page_rank == 1.0 and len(SCORES) == 3


def test_bounds_are_exact_in_a_large_query(spark):
    n = 60_000
    rows = spark.range(n, numPartitions=7).selectExpr("id as result_id", "1L as query_id", "cast(id as string) as doc_id", "cast(pow((id * 7919) % 60000, 3) as double) as page_rank")
    got = ideal_point_ranking(rows, ["page_rank"])
    # All values differ: 5 in 100 are drawn in to the lower bound, which is one of them, and 5 in 100 to the upper bound, beside it.
    assert (got.where("closeness = 0").count(), got.where("closeness = 1").count()) == (n // 20, n // 20 + 1)
