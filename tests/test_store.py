import pytest
from pyspark.sql import functions as F

from weft.sources.store import KEYS, SCHEMAS, KeyedTable, SchemaMismatch, open_index
from weft.streaming.reindex import stream_pages


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "terms"), SCHEMAS["terms"], KEYS["terms"])


def terms(spark, *rows):
    return spark.createDataFrame(list(rows), "term_hash string, term string")


def test_lookups_and_upserts(spark, table):
    assert table.scan().count() == 0 and table.get("h1") is None
    table.set(terms(spark, ("h1", "one"), ("h2", "two"), ("h2", "two")))
    table.set(terms(spark, ("h1", "uno")))
    assert table.get("h1") == {"term_hash": "h1", "term": "uno"} and table.has("h2") and not table.has("h9")
    table.delete(terms(spark, ("h2", None), ("h9", None)))
    assert [tuple(r) for r in table.scan().collect()] == [("h1", "uno")]
    assert table.get("h2") is None
    table.set(terms(spark, ("h2", "again")))
    assert sorted(r.term for r in table.scan_prefix("h").collect()) == ["again", "uno"]
    assert table.get_many(terms(spark, ("h1", None), ("h7", None))).count() == 1
    table.compact()
    assert sorted(map(tuple, table.scan().collect())) == [("h1", "uno"), ("h2", "again")]
    assert sorted(map(tuple, table.scan(1).collect())) == [("h1", "one"), ("h2", "two")]
    table.drop()
    assert table.scan().count() == 0


def test_batches(spark, table):
    b = table.batch()
    b.put(terms(spark, ("a", "1")))
    b.put(terms(spark, ("a", "2"), ("b", "3")))
    assert table.scan().count() == 0
    b.flush()
    assert sorted(map(tuple, table.scan().collect())) == [("a", "2"), ("b", "3")]
    b.put(terms(spark, ("c", "4")))
    b.cancel()
    b.flush()
    assert table.scan().count() == 2


def test_schema_is_checked(spark, table):
    with pytest.raises(SchemaMismatch):
        table.set(spark.createDataFrame([("x",)], "term string"))
    with pytest.raises(SchemaMismatch):
        table.set(spark.createDataFrame([("x", 1)], "term_hash string, term int"))


def test_all_tables_open(spark, tmp_path):
    index = open_index(spark, str(tmp_path))
    index["docs"].set(spark.range(3).select(F.col("id").cast("string").alias("doc_id"), F.lit("u").alias("url"), F.array(F.lit("t")).alias("title")))
    assert index["docs"].scan().where("size(title) = 1").count() == 3 and index["links"].scan().count() == 0


def test_streamed_pages(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "pages"), SCHEMAS["pages"], KEYS["pages"])
    folder, seen = str(tmp_path / "in"), []

    def arrive(*rows):
        spark.createDataFrame(list(rows), "doc_id string, url string, html string, s int, content_length bigint").withColumn("last_modified", F.timestamp_seconds("s")).drop("s").write.mode("append").parquet(folder)
        stream_pages(spark, folder, table, str(tmp_path / "cp"), lambda df: seen.append(sorted(r.doc_id for r in df.collect()))).awaitTermination()

    arrive(("a", "u", "<p>1", 10, None), ("b", "v", "<p>1", 10, None), ("a", "u", "<p>1", 10, None))
    arrive(("a", "u", "<p>2", 9, None), ("b", "v", "<p>2", 11, None), (None, "x", "<p>", 1, None))
    assert seen == [["a", "b"], ["b"]]
    assert sorted((r.doc_id, r.html) for r in table.scan().collect()) == [("a", "<p>1"), ("b", "<p>2")]
