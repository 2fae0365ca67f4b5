"""Pages that arrive as files are indexed as they come; the latest version of a page wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.html import extract_fields, page_size
from weft.sources.store import SCHEMAS, KeyedTable


def latest(pages: DataFrame, *columns: str) -> DataFrame:
    """One row per doc_id: the one modified last, of equals that with the greatest digest of html; null dates come first.

    Only ``columns`` come out beside doc_id (default: all of the table), and only they move; html is compared by its digest, made where it is read."""
    rest = list(columns) or ["url", "html", "last_modified", "content_length"]
    order = F.struct(F.col("last_modified"), F.md5("html"))
    return pages.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct(*rest), order).alias("p")).select("doc_id", "p.*")


def latest_fields(pages: DataFrame) -> DataFrame:
    """The extracted fields of each page's latest row, with mod_date and page_size. Pages are parsed where they are read, and fields move instead of html."""
    sized = page_size(pages.where("doc_id is not null")).withColumn("_digest", F.md5("html")).withColumnRenamed("last_modified", "mod_date")
    rows = extract_fields(sized, "mod_date", "page_size", "_digest")
    rest = [c for c in rows.columns if c not in ("doc_id", "_digest")]
    return rows.groupBy("doc_id").agg(F.max_by(F.struct(*rest), F.struct("mod_date", "_digest")).alias("p")).select("doc_id", "p.*")


def stream_pages(spark: SparkSession, folder: str, table: KeyedTable, checkpoint: str, then: Callable[[DataFrame], None] | None = None, once: bool = True):
    """Starts a query that takes each new file of ``folder`` into ``table``; ``then`` gets the pages that changed in each batch.

    A batch that is run again after a failure writes the same rows: upserts of older or equal versions change nothing.
    """

    def take(batch: DataFrame, _: int) -> None:
        new = latest(batch)
        known = table.get_many(new, "last_modified", "html").select("doc_id", F.col("last_modified").alias("_seen"), F.md5("html").alias("_digest"))
        fresh = new.join(known, "doc_id", "left").where("_digest is null or ((_seen is null or last_modified > _seen) and md5(html) <> _digest)").drop("_seen", "_digest").persist()
        try:
            if not fresh.isEmpty():
                if then:
                    then(fresh)
                table.set(fresh)
        finally:
            fresh.unpersist()

    query = spark.readStream.schema(SCHEMAS["pages"]).parquet(folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()
