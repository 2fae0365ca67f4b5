"""Queries of the general problems: skewed keys (p1), new records (p2), orphan references (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.orphans import track_orphans
from weft.operators.skew import key_profile
from weft.operators.versions import VersionedTable, publish_runs, replay_runs
from weft.session import read, scratch_path


def p1_key_profile(spark: SparkSession, d: str) -> DataFrame:
    """Results per term and per parent, heavy or not."""
    return key_profile(read(spark, d, "docs"), read(spark, d, "terms")).drop("heavy")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms in at least 85 in 100, parents in at least 4 in 100 of the rows that have such a map."""
    share = F.when(F.col("map_name") == "words", 85).otherwise(4)
    return key_profile(read(spark, d, "docs"), read(spark, d, "terms")).where(F.col("n_rows") * 100 >= share * F.col("rows_with_map")).select("map_name", "map_key")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The page versions that each ok run must process: a job over the versions of the table of whole records, its processed version saved with its output."""
    source, sink = VersionedTable(spark, scratch_path(spark, "docs")), VersionedTable(spark, scratch_path(spark, "page_versions"))
    log = publish_runs(read(spark, d, "docs"), read(spark, d, "index_runs"), source)
    return replay_runs(source, sink, log).select("run_id", "seq")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """References to missing, later and removed pages, after the tracker took in the whole log."""
    return track_orphans(read(spark, d, "docs"), read(spark, d, "removals"), read(spark, d, "portals")).orphans()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Open references per field and month, as the tracker's last snapshot counts them."""
    return track_orphans(read(spark, d, "docs"), read(spark, d, "removals"), read(spark, d, "portals")).snapshot()


QUERIES = {f.__name__: f for f in (p1_key_profile, p1_found, p2_found, p6_found, p6_report)}

_ORPHANS = """
        WITH refs AS (
            SELECT DISTINCT 'children' AS ref_field, seq, written_at, unnest(children) AS target FROM docs
            UNION SELECT DISTINCT 'parents', seq, written_at, unnest(map_keys(parents)) FROM docs),
        live AS (SELECT * FROM refs WHERE target IS NOT NULL AND target <> '' AND target NOT IN (SELECT doc_id FROM portals)),
        f AS (SELECT doc_id, min(written_at) AS first_written FROM docs GROUP BY doc_id),
        k AS (SELECT l.*, 'missing' AS kind FROM live l WHERE target NOT IN (SELECT doc_id FROM docs)
              UNION ALL SELECT l.*, 'later' FROM live l JOIN f ON f.doc_id = l.target WHERE f.first_written > l.written_at
              UNION ALL SELECT l.*, 'removed' FROM live l JOIN removals x ON x.doc_id = l.target
              WHERE x.removed_at <= l.written_at AND NOT EXISTS (
                SELECT 1 FROM docs b WHERE b.doc_id = l.target AND b.written_at > x.removed_at AND b.written_at <= l.written_at))"""

ORACLE = {
    "p1_key_profile": """
        WITH e AS (SELECT 'words' AS map_name, unnest(map_entries(words)) AS x, doc_id FROM docs),
        w AS (SELECT map_name, x.key AS map_key, x.value AS v, doc_id FROM e),
        q AS (SELECT 'parents' AS map_name, unnest(map_entries(parents)) AS x, doc_id FROM docs),
        p AS (SELECT map_name, x.key AS map_key, coalesce(len(x.value), 0) AS v, doc_id FROM q),
        a AS (SELECT * FROM w UNION ALL SELECT * FROM p),
        urls AS (SELECT doc_id, min(url) AS label FROM docs WHERE url IS NOT NULL GROUP BY doc_id),
        g AS (SELECT map_name, map_key, count(*) AS n_rows, CAST(sum(v) AS BIGINT) AS total,
                     max(v) AS top FROM a GROUP BY ALL)
        SELECT g.map_name, g.map_key, CASE WHEN g.map_name = 'words' THEN t.term ELSE u.label END AS label, n_rows, total,
               (SELECT min(doc_id) FROM a WHERE a.map_name = g.map_name AND a.map_key = g.map_key AND a.v = g.top) AS top_doc,
               CASE WHEN g.map_name = 'words' THEN (SELECT count(*) FROM docs WHERE cardinality(words) > 0)
                    ELSE (SELECT count(*) FROM docs WHERE cardinality(parents) > 0) END AS rows_with_map
        FROM g LEFT JOIN terms t ON t.term_hash = g.map_key LEFT JOIN urls u ON u.doc_id = g.map_key""",
    "p1_found": """
        WITH a AS (SELECT 'words' AS map_name, unnest(map_keys(words)) AS map_key FROM docs
                   UNION ALL SELECT 'parents', unnest(map_keys(parents)) FROM docs),
        n AS (SELECT count(*) FILTER (cardinality(words) > 0) AS w, count(*) FILTER (cardinality(parents) > 0) AS p FROM docs)
        SELECT map_name, map_key FROM a, n GROUP BY map_name, map_key, w, p
        HAVING count(*) * 100 >= CASE WHEN map_name = 'words' THEN 85 * w ELSE 4 * p END""",
    "p2_found": """
        WITH r AS (SELECT run_id, started_at, row_number() OVER (ORDER BY started_at, run_id) AS v
                   FROM index_runs WHERE status = 'ok' AND started_at IS NOT NULL),
        s AS (SELECT d.seq, d.doc_id, d.mod_date, (SELECT min(v) FROM r WHERE r.started_at >= d.written_at) AS v
              FROM docs d WHERE d.mod_date IS NOT NULL AND d.doc_id IS NOT NULL),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, v ORDER BY mod_date DESC, seq) AS k FROM s WHERE v IS NOT NULL),
        n AS (SELECT *, max(mod_date) OVER (PARTITION BY doc_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past
              FROM b WHERE k = 1)
        SELECT r.run_id, n.seq FROM n JOIN r USING (v) WHERE past IS NULL OR mod_date > past""",
    "p6_found": f"{_ORPHANS} SELECT ref_field, strftime(written_at, '%Y-%m') AS period, seq, target, kind FROM k",
    "p6_report": f"{_ORPHANS} SELECT ref_field, strftime(written_at, '%Y-%m') AS period, kind, count(*) AS n_refs, count(DISTINCT target) AS n_targets FROM k GROUP BY ALL",
}
