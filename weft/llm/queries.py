"""Queries of the problems on texts and rankings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.distinctive import enrichment, postings_entries, words_entries
from weft.llm.leakage import leaked_items
from weft.llm.main_content import clean_summaries, judge_pages, main_blocks
from weft.llm.packing import pack_documents
from weft.llm.ranking import ideal_point_ranking
from weft.llm.shared_spans import remove_spans, shared_amounts, shared_spans
from weft.session import read, spread, staged

#: Least score of a term that marks its record: a false-discovery rate below one half.
MARKS = math.log(2)


def p3_term_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all terms of all records, from postings and from docs.words."""
    scored = enrichment(postings_entries(read(spark, d, "postings")), words_entries(read(spark, d, "docs")))
    return scored.select("field", "term", "doc_id", "occ", "df", F.round("score", 3).alias("score"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms of 2 to 8 records that are frequent in this one and mark it: by their score they are more likely no chance than chance."""
    scored = enrichment(postings_entries(read(spark, d, "postings")))
    return scored.where((F.col("score") > MARKS) & F.expr("df between 2 and 8 and tf >= 0.5")).select("field", "term", "doc_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages of keywords, link lists or tags."""
    return judge_pages(spread(read(spark, d, "pages"))).where("spam").select("doc_id").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of main content, and results whose summary was made of it."""
    judged = staged(judge_pages(spread(read(spark, d, "pages"))).where("not spam").drop("spam"), "judged")
    blocks = main_blocks(judged, read(spark, d, "page_blocks")).select(F.lit("block").alias("place"), "doc_id", F.col("block_no").cast("bigint").alias("item_no"))
    summaries = clean_summaries(judged, read(spark, d, "results"))
    return blocks.unionByName(summaries.select(F.lit("summary").alias("place"), "doc_id", F.col("result_id").alias("item_no")))


def p7_ranking(spark: SparkSession, d: str) -> DataFrame:
    """All answers by closeness to their query's ideal point."""
    ranked = ideal_point_ranking(read(spark, d, "results"))
    return ranked.select("query_id", "doc_id", "n", F.round("closeness", 6).alias("closeness"), "rank", "stands_high")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Answers as close to the ideal point as one that just stands high on each of the three scores, and that do so score by score."""
    return ideal_point_ranking(read(spark, d, "results")).where("closeness >= bar - 1e-9 and stands_high").select("query_id", "doc_id")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """Documents assigned to containers of 2,048 tokens."""
    return pack_documents(read(spark, d, "documents"))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the packing, by document: placed once and whole, not cut needlessly, in containers that are not too full and as full as they say; and of all: few more containers than the tokens need."""
    placed = staged(p8_pack(spark, d), "placed")
    bins = placed.where("bin_id is not null").groupBy("bin_id").agg(F.sum("size").alias("held"), F.max("bin_size").alias("said"))
    all_ = bins.agg(F.count(F.lit(1)).alias("n"), F.sum("held").alias("held")).first()
    tight = all_["n"] <= 1.02 * (all_["held"] or 0) / 2048 + 1
    rows = placed.join(bins, "bin_id", "left").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("piece").alias("pieces"), F.sum("size").alias("size"), F.max(F.col("start") + F.col("size")).alias("end"),
        F.coalesce(F.max("held"), F.lit(0)).alias("fullest"), F.coalesce(F.bool_and(F.col("held") == F.col("said")), F.lit(True)).alias("as_said"),
    )
    return rows.select("doc_id", F.expr("n = pieces and size = end").alias("whole"), F.expr("pieces > 1 and size <= 2048").alias("cut_needlessly"), F.expr("fullest > 2048").alias("too_full"), "as_said", F.lit(tight).alias("tight"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items of which they hold passages, with the items' coverage."""
    return leaked_items(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least 12 successive words of an item: its longest tile has them."""
    return p9_leaks(spark, d).where("run_words >= 12").select("doc_id", "item_id")


def p10_shared_amounts(spark: SparkSession, d: str) -> DataFrame:
    """For each document how much of it occurs elsewhere."""
    return shared_amounts(read(spark, d, "documents"))


def p10_removed(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each document without the stretches that an earlier one has."""
    left = remove_spans(read(spark, d, "documents"))
    return left.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_left"), "removed")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The maximal shared stretches of each document."""
    return shared_spans(read(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_term_scores, p3_found, p4_found, p5_found, p7_ranking, p7_found, p8_pack, p8_invariants, p9_leaks, p9_found, p10_shared_amounts, p10_removed, p10_found)}

_SPANS = """
        d AS (SELECT DISTINCT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 300),
        w AS (SELECT doc_id, i, md5(substring(text, i + 1, 300)) AS h FROM d, LATERAL (SELECT unnest(range(n - 299)) AS i)),
        s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
        m AS (SELECT DISTINCT doc_id, i FROM w WHERE h IN (SELECT h FROM s)),
        g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 300 THEN 0 ELSE 1 END AS new FROM m),
        k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
        sp AS (SELECT doc_id, min(i) AS span_start, max(i) + 300 AS span_end FROM k GROUP BY doc_id, k)"""

ORACLE = {
    "p3_term_scores": """
        WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY written_at DESC, seq DESC) AS k FROM docs WHERE doc_id IS NOT NULL) WHERE k = 1),
        e AS (SELECT field, term, doc_id, CAST(len(positions) AS BIGINT) AS occ FROM postings
              UNION ALL SELECT 'words', x.key, doc_id, x.value FROM (SELECT doc_id, unnest(map_entries(words)) AS x FROM last)),
        b AS (SELECT field, term, doc_id, max(occ) AS occ FROM e GROUP BY ALL),
        t AS (SELECT field, term, count(*) AS df, sum(occ)::DOUBLE AS kk FROM b GROUP BY ALL), r AS (SELECT field, doc_id, sum(occ)::DOUBLE AS n FROM b GROUP BY ALL), f AS (SELECT field, sum(occ)::DOUBLE AS nn FROM b GROUP BY ALL),
        j AS (SELECT b.*, df, kk, n, nn FROM b JOIN t USING (field, term) JOIN r USING (field, doc_id) JOIN f USING (field)),
        u AS (SELECT DISTINCT occ, kk, n, nn FROM j),
        p AS (SELECT occ, kk, n, nn, ln(least(1.0, sum(exp(lgamma(kk + 1) - lgamma(i + 1) - lgamma(kk - i + 1) + lgamma(nn - kk + 1) - lgamma(n - i + 1) - lgamma(nn - kk - n + i + 1) - lgamma(nn + 1) + lgamma(n + 1) + lgamma(nn - n + 1))))) AS log_p
              FROM u, LATERAL (SELECT unnest(range(occ, CAST(least(kk, n) AS BIGINT) + 1)) AS i) GROUP BY ALL),
        s AS (SELECT j.field, j.term, j.doc_id, j.occ, j.df, log_p, log_p + ln(count(*) OVER (PARTITION BY j.field, j.doc_id)) - ln(count(*) OVER (PARTITION BY j.field, j.doc_id ORDER BY log_p RANGE UNBOUNDED PRECEDING)) AS q
              FROM j JOIN p USING (occ, kk, n, nn))
        SELECT field, term, doc_id, occ, df, round(greatest(0.0, -min(q) OVER (PARTITION BY field, doc_id ORDER BY log_p DESC RANGE UNBOUNDED PRECEDING)), 3) AS score FROM s""",
    "p3_found": """
        WITH b AS (SELECT field, term, doc_id, max(tf) AS tf FROM postings GROUP BY ALL),
        n AS (SELECT field, term FROM b GROUP BY ALL HAVING count(*) BETWEEN 2 AND 8)
        SELECT b.field, b.term, b.doc_id FROM b JOIN n USING (field, term) WHERE tf >= 0.5""",
    "p7_found": """
        WITH f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY result_id) AS k FROM results),
        a AS (SELECT query_id, doc_id, CASE WHEN isnan(page_rank) THEN NULL ELSE page_rank END AS p,
                     CASE WHEN isnan(title_rank) THEN NULL ELSE title_rank END AS t,
                     CASE WHEN isnan(body_rank) THEN NULL ELSE body_rank END AS b FROM f WHERE k = 1),
        n AS (SELECT query_id, count(*) AS n FROM a GROUP BY query_id)
        SELECT query_id, doc_id FROM a JOIN n USING (query_id) WHERE p IS NOT NULL AND t IS NOT NULL AND b IS NOT NULL
          AND (SELECT count(*) FROM a x WHERE x.query_id = a.query_id AND x.p > a.p) * 10 < n
          AND (SELECT count(*) FROM a x WHERE x.query_id = a.query_id AND x.t > a.t) * 10 < n
          AND (SELECT count(*) FROM a x WHERE x.query_id = a.query_id AND x.b > a.b) * 10 < n""",
    "p7_ranking": """
        WITH f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY result_id) AS k FROM results),
        a AS (SELECT query_id, doc_id, CASE WHEN isnan(page_rank) THEN NULL ELSE page_rank END AS p,
                     CASE WHEN isnan(title_rank) THEN NULL ELSE title_rank END AS t,
                     CASE WHEN isnan(body_rank) THEN NULL ELSE body_rank END AS b FROM f WHERE k = 1),
        q AS (SELECT query_id, count(*) AS n, quantile_disc(p, [0.05, 0.95]) AS qp, quantile_disc(t, [0.05, 0.95]) AS qt, quantile_disc(b, [0.05, 0.95]) AS qb FROM a GROUP BY query_id),
        v AS (SELECT a.*, n, coalesce(least(greatest(coalesce(p, qp[1]), qp[1]), qp[2]), 0) AS vp, coalesce(least(greatest(coalesce(t, qt[1]), qt[1]), qt[2]), 0) AS vt,
                     coalesce(least(greatest(coalesce(b, qb[1]), qb[1]), qb[2]), 0) AS vb FROM a JOIN q USING (query_id)),
        s AS (SELECT query_id, nullif(sqrt(sum(vp * vp)), 0) AS sp, nullif(sqrt(sum(vt * vt)), 0) AS st, nullif(sqrt(sum(vb * vb)), 0) AS sb,
                     max(vp) AS hp, max(vt) AS ht, max(vb) AS hb, min(vp) AS lp, min(vt) AS lt, min(vb) AS lb FROM v GROUP BY query_id),
        z AS (SELECT v.*, sqrt(coalesce(((vp - hp) / sp) ** 2, 0) + coalesce(((vt - ht) / st) ** 2, 0) + coalesce(((vb - hb) / sb) ** 2, 0)) AS best,
                     sqrt(coalesce(((vp - lp) / sp) ** 2, 0) + coalesce(((vt - lt) / st) ** 2, 0) + coalesce(((vb - lb) / sb) ** 2, 0)) AS worst FROM v JOIN s USING (query_id)),
        c AS (SELECT *, coalesce(worst / nullif(best + worst, 0), 0.5) AS c FROM z)
        SELECT query_id, doc_id, n, round(c, 6) AS closeness, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) AS rank,
               p IS NOT NULL AND t IS NOT NULL AND b IS NOT NULL
               AND (SELECT count(*) FROM a x WHERE x.query_id = c.query_id AND x.p > c.p) * 10 < n
               AND (SELECT count(*) FROM a x WHERE x.query_id = c.query_id AND x.t > c.t) * 10 < n
               AND (SELECT count(*) FROM a x WHERE x.query_id = c.query_id AND x.b > c.b) * 10 < n AS stands_high FROM c""",
    "p8_invariants": "SELECT DISTINCT doc_id, true AS whole, false AS cut_needlessly, false AS too_full, true AS as_said, true AS tight FROM documents WHERE doc_id IS NOT NULL",
    "p10_found": f"WITH {_SPANS} SELECT doc_id, span_start, span_end FROM sp",
    "p10_removed": f"""
        WITH {_SPANS.replace("HAVING count(DISTINCT doc_id) > 1", "").replace("SELECT h FROM w GROUP BY h", "SELECT h, min(doc_id) AS first FROM w GROUP BY h").replace("SELECT DISTINCT doc_id, i FROM w WHERE h IN (SELECT h FROM s)", "SELECT DISTINCT doc_id, i FROM w JOIN s USING (h) WHERE doc_id > first")},
        t AS (SELECT doc_id, CAST(sum(span_end - span_start) AS BIGINT) AS removed FROM sp GROUP BY doc_id)
        SELECT doc_id, coalesce(length(text), 0) - coalesce(removed, 0) AS n_left, coalesce(removed, 0) AS removed FROM documents LEFT JOIN t USING (doc_id)""",
    "p10_shared_amounts": f"""
        WITH {_SPANS}, t AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(span_end - span_start) AS BIGINT) AS shared_chars FROM sp GROUP BY doc_id),
        a AS (SELECT doc_id, coalesce(max(length(text)), 0) AS n_chars FROM documents GROUP BY doc_id)
        SELECT doc_id, n_chars, coalesce(n_spans, 0) AS n_spans, coalesce(shared_chars, 0) AS shared_chars,
               coalesce(coalesce(shared_chars, 0)::DOUBLE / nullif(n_chars, 0), 0) AS shared_share FROM a LEFT JOIN t USING (doc_id)""",
}
