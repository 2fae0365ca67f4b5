"""Keyed tables: point and set lookups, upserts, deletes, prefix scans and batches, over a versioned table.

Writes append rows with the number of their version; a read takes the last row of each key; compaction rewrites the table
without what is superseded. So a write costs what it writes, and readers of older versions are not disturbed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.versions import Conflict, VersionedTable

# The tables of the index, with their key first.
SCHEMAS = {
    "docs": "doc_id string, url string, title array<string>, mod_date timestamp, page_size bigint, children array<string>, parents map<string,array<string>>, words map<string,bigint>",
    "postings": "term string, field string, doc_id string, tf float, weight float, positions array<float>",
    "terms": "term_hash string, term string",
    "links": "src string, dst string, ord int",
    "page_rank": "doc_id string, topic string, rank double",
    "magnitudes": "doc_id string, title double, body double",
    "topics": "topic string, num_pages double, word_count double",
    "topic_terms": "term string, topic string, freq bigint",
    "pages": "doc_id string, url string, html string, last_modified timestamp, content_length bigint",
}
KEYS = {"docs": ["doc_id"], "postings": ["term", "field", "doc_id"], "terms": ["term_hash"], "links": ["src", "ord"], "page_rank": ["doc_id", "topic"], "magnitudes": ["doc_id"], "topics": ["topic"], "topic_terms": ["term", "topic"], "pages": ["doc_id"]}


class SchemaMismatch(TypeError):
    """Columns or types that the table does not have."""


class KeyedTable:
    """One table of the index below ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: list[str]):
        self.spark, self.key = spark, key
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.log = VersionedTable(spark, path, T.StructType([*self.schema.fields, T.StructField("_seq", T.LongType()), T.StructField("_gone", T.BooleanType())]))

    def _checked(self, df: DataFrame) -> DataFrame:
        want = {f.name: f.dataType for f in self.schema.fields}
        have = {f.name: f.dataType for f in df.schema.fields}
        if missing := [c for c in self.key if c not in have]:
            raise SchemaMismatch(f"key column missing: {missing}")
        if other := [c for c, t in have.items() if c in want and t.simpleString() != want[c].simpleString()]:
            raise SchemaMismatch(f"type differs: {other}")
        return df.select(*[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in want.items()])

    def _append(self, df: DataFrame, gone: bool) -> None:
        rows = self._checked(df).withColumn("_gone", F.lit(gone))
        while True:
            # Rows carry the number of the version they make, so a writer that was second writes them anew.
            base = self.log.manifest()
            try:
                self.log.append(rows.withColumn("_seq", F.lit(base.version + 1).cast("bigint")).select(self.log.schema.names), base=base)
                return
            except Conflict:
                continue

    def _last(self, rows: DataFrame) -> DataFrame:
        """The last row of each key, unless that is a deletion."""
        rest = [c for c in self.schema.names if c not in self.key]
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest, "_gone"), "_seq").alias("r"))
        return last.where("not r._gone").select(*self.key, *[F.col(f"r.{c}") for c in rest]).select(*self.schema.names)

    def set(self, df: DataFrame) -> None:
        """Upserts rows; of rows with one key in a batch the last stays, in the order in which the frame hands them on."""
        rest = [c for c in self.schema.names if c not in self.key]
        numbered = self._checked(df).withColumn("_n", F.monotonically_increasing_id())
        self._append(numbered.groupBy(*self.key).agg(F.max_by(F.struct(*rest), "_n").alias("r")).select(*self.key, "r.*"), False)

    def delete(self, keys: DataFrame) -> None:
        """Takes out the rows with these keys; keys that the table lacks change nothing."""
        self._append(keys.select(*self.key).distinct(), True)

    def drop(self) -> None:
        """Empties the table; older versions stay readable."""
        self.log.clear()

    def scan(self, version: int | None = None) -> DataFrame:
        """All rows, in no order."""
        return self._last(self.log.read(version))

    def get(self, *key) -> dict | None:
        """The row with this key, or None. The key reaches the scan; for many keys use get_many."""
        rows = self.log.read()
        for c, v in zip(self.key, key):
            rows = rows.where(F.col(c) == F.lit(v))
        last = rows.orderBy(F.desc("_seq")).limit(1).collect()
        return {c: last[0][c] for c in self.schema.names} if last and not last[0]["_gone"] else None

    def has(self, *key) -> bool:
        return self.get(*key) is not None

    def get_many(self, keys: DataFrame, *columns: str) -> DataFrame:
        """The rows with any of these keys, or only ``columns`` of them beside the key. Only rows of the keys are compared, and only those columns are read."""
        wanted = keys.select(*self.key).distinct()
        rows = self.log.read().join(wanted, self.key, "left_semi")
        if not columns:
            return self._last(rows)
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*columns, "_gone"), "_seq").alias("r"))
        return last.where("not r._gone").select(*self.key, *[F.col(f"r.{c}") for c in columns])

    def scan_prefix(self, prefix: str) -> DataFrame:
        """Rows whose first key column begins with ``prefix``; it reaches the scan."""
        return self._last(self.log.read().where(F.col(self.key[0]).startswith(prefix)))

    def compact(self, vacuum: bool = False) -> None:
        """Rewrites the table without superseded and deleted rows; with ``vacuum`` the files that only older versions need are deleted."""
        base = self.log.manifest()
        rows = self.scan().withColumn("_seq", F.lit(base.version + 1).cast("bigint")).withColumn("_gone", F.lit(False))
        new = self.log.commit(base, dict.fromkeys(p for ps in self.log.write_files(rows).values() for p in ps), op="rewrite")
        if vacuum:
            self.log.vacuum(new.version)

    def batch(self) -> "Batch":
        return Batch(self)


class Batch:
    """Buffered puts: nothing is visible before flush, the last put of a key counts, cancel drops them."""

    def __init__(self, table: KeyedTable):
        self.table, self.parts = table, []

    def put(self, df: DataFrame) -> None:
        self.parts.append(self.table._checked(df).withColumn("_n", F.lit(len(self.parts))))

    def flush(self) -> None:
        if self.parts:
            df = self.parts[0]
            for p in self.parts[1:]:
                df = df.unionByName(p)
            names = [c for c in self.table.schema.names if c not in self.table.key]
            self.table._append(df.groupBy(*self.table.key).agg(F.max_by(F.struct(*names), "_n").alias("r")).select(*self.table.key, "r.*"), False)
        self.parts = []

    def cancel(self) -> None:
        self.parts = []


def open_index(spark: SparkSession, path: str) -> dict[str, KeyedTable]:
    """All tables of an index below ``path``."""
    return {name: KeyedTable(spark, f"{path}/{name}", SCHEMAS[name], KEYS[name]) for name in SCHEMAS}
