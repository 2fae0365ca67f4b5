"""One ranking per query from scores on unlike scales: closeness to an ideal point (TOPSIS) of winsorised scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.order import running_total
from weft.operators.skew import balanced_join
from weft.session import staged

SCORES = ("page_rank", "title_rank", "body_rank")


def answers_of(results: DataFrame, scores: Sequence[str] = SCORES) -> DataFrame:
    """One row per (query_id, doc_id): the scores of the answer with the smallest result_id; NaN becomes null."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in scores]
    rows = results.where("query_id is not null and doc_id is not null").select("query_id", "doc_id", "result_id", *clean)
    first = rows.groupBy("query_id", "doc_id").agg(F.min_by(F.struct(*scores), "result_id").alias("s"))
    return first.select("query_id", "doc_id", "s.*")


def marks_of(answers: DataFrame, scores: Sequence[str], trim: float, share: int) -> DataFrame:
    """(query_id, n, high_<score> ..., low_bound_<score>, high_bound_<score> ...): the query's answers; the least value of each score that fewer than n / share
    answers exceed; and the ``trim`` and 1 - ``trim`` quantiles of the score's values, each the least value that so large a part doesn't exceed.

    Exact, also with ties, for queries of any size: equal values are counted together, then counted on in order.
    """
    size = answers.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"_n_{c}") for c in scores])
    long = answers.select("query_id", F.explode(F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).alias("value")) for c in scores])).alias("x"))
    counts = long.select("query_id", "x.*").where("value is not null").groupBy("query_id", "score", "value").agg(F.count(F.lit(1)).alias("w"))
    above = running_total(counts, ["query_id", "score"], [F.desc("value")], F.col("w"), "above")
    values = balanced_join(above, size, "query_id", "inner")
    least = lambda c, ok: F.min(F.when((F.col("score") == c) & ok, F.col("value")))
    # Rounded first, so that 0.05 * 60 is 3 whatever the floating point makes of it.
    within = lambda c, part: F.col(f"_n_{c}") - F.col("above") >= F.ceil(F.round(F.col(f"_n_{c}") * part, 6))
    marks = values.groupBy("query_id").agg(*[x for c in scores for x in (
        least(c, F.col("above") * share < F.col("n")).alias(f"high_{c}"), least(c, within(c, trim)).alias(f"low_bound_{c}"), least(c, within(c, 1 - trim)).alias(f"high_bound_{c}"),
    )])
    return size.select("query_id", "n").join(marks, "query_id", "left")


def ideal_point_ranking(results: DataFrame, scores: Sequence[str] = SCORES, weights: Sequence[float] | None = None, trim: float = 0.05, share: int = 10) -> DataFrame:
    """Ranks each query's answers by relative closeness to the ideal point.

    Per query and score: values are drawn in to the ``trim`` and 1 - ``trim`` quantiles, divided by their vector norm and
    weighted. The ideal point has the greatest, the anti-ideal the least value of every score; closeness is the distance
    to the anti-ideal over the sum of both distances. No score dominates by its range or by a few extreme values.

    Columns: query_id, doc_id, the scores, n (answers of the query), closeness (0 to 1), rank (from 1; ties by doc_id), bar, and
    stands_high: every score is present and fewer than n / ``share`` of the answers have a greater one. bar is the closeness of the point that just
    stands high on every score; closeness grows with each score, so no answer that stands high is below it.
    Repeated answers count once. Null and NaN scores count as the least of the query. Where all answers are equal, closeness
    is 0.5. A negative score is allowed. An empty table gives no rows.
    """
    weights = list(weights or [1.0 / len(scores)] * len(scores))
    answers = staged(answers_of(results, scores), "answers")  # read by every step below
    bounds = marks_of(answers, scores, trim, share)
    a = balanced_join(answers, bounds, "query_id", "inner")
    for c in scores:  # an absent score takes the lower bound; a query that lacks a score altogether has 0 for all
        low, high = F.col(f"low_bound_{c}"), F.col(f"high_bound_{c}")
        a = a.withColumn(f"_v_{c}", F.coalesce(F.least(F.greatest(F.coalesce(F.col(c), low), low), high), F.lit(0.0)))
    v = [f"_v_{c}" for c in scores]
    frame = a.groupBy("query_id").agg(*[f(x).alias(f"_{k}{x}") for x in v for k, f in (("s", lambda y: F.sqrt(F.sum(F.col(y) * F.col(y)))), ("hi", F.max), ("lo", F.min))])
    a = balanced_join(a, frame, "query_id", "inner")

    def closeness(values: list[Column]) -> Column:
        def distance(to: str) -> Column:
            total = F.lit(0.0)
            for value, x, w in zip(values, v, weights):
                d = F.coalesce(F.try_divide(value - F.col(f"_{to}{x}"), F.col(f"_s{x}")), F.lit(0.0)) * w
                total = total + d * d
            return F.sqrt(total)

        best, worst = distance("hi"), distance("lo")
        return F.coalesce(F.try_divide(worst, best + worst), F.lit(0.5))

    marks = [F.coalesce(F.least(F.greatest(F.col(f"high_{c}"), F.col(f"low_bound_{c}")), F.col(f"high_bound_{c}")), F.lit(0.0)) for c in scores]
    high = F.lit(True)
    for c in scores:
        high = high & F.coalesce(F.col(c) >= F.col(f"high_{c}"), F.lit(False))
    scored = a.select("query_id", "doc_id", *scores, "n", closeness([F.col(x) for x in v]).alias("closeness"), closeness(marks).alias("bar"), high.alias("stands_high"))
    ranked = running_total(scored, ["query_id"], [F.desc("closeness"), F.asc("doc_id")], F.lit(1), "_before")
    return ranked.withColumn("rank", (F.col("_before") + 1).cast("bigint")).drop("_before")
