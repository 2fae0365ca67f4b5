"""Which pages have to be indexed again, and the purge of what they leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def freshness(pages: DataFrame, indexed: DataFrame) -> DataFrame:
    """Pages (doc_id, last_modified) with ``action``: 'new' if not indexed or only linked to (null mod_date), 'update' if modified
    later than indexed (doc_id, mod_date), else 'keep'. A page without last_modified is kept if indexed."""
    rows = pages.join(indexed.select("doc_id", F.col("mod_date").alias("_mod_date"), F.lit(True).alias("_known")), "doc_id", "left")
    action = F.when(F.col("_known").isNull() | F.col("_mod_date").isNull(), "new").when(F.col("last_modified") > F.col("_mod_date"), "update").otherwise("keep")
    return rows.withColumn("action", action).drop("_mod_date", "_known")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, changed): whether the content (column html) of pages in ``new`` differs from that in ``old`` by digest; pages not in old are changed."""
    a = old.select("doc_id", F.md5("html").alias("_old"))
    b = new.select("doc_id", F.md5("html").alias("_new"))
    return b.join(a, "doc_id", "left").select("doc_id", (~F.col("_new").eqNullSafe(F.col("_old"))).alias("changed"))


def purge(postings: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Postings without those of ``doc_ids``."""
    return postings.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def merge_postings(postings: DataFrame, new: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Postings after the pages ``doc_ids`` were indexed again as ``new``."""
    return purge(postings, doc_ids).unionByName(new, allowMissingColumns=True)
