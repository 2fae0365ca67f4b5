"""References to records that do not exist, kept up to date as references, records and removals arrive.

The keyed state has four parts, each in buckets by hash of the target: the references and the writes that came so far, the parent index with one row per
target, and the open orphans. A step takes a batch of each kind, in any order of arrival, and reads only buckets that the batch
touches: new references probe the index; the index rows of written and removed pages are merged; where that changes what is known of a page, its
waiting references are looked at again, so that arriving pages resolve orphans and removals reopen them. A page that is merely written again
changes nothing. All parts are files of one versioned table, so a step is one commit: it happens wholly or not at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.skew import balanced_join
from weft.operators.versions import Manifest, VersionedTable
from weft.session import scratch_path, staged

REF = ["ref_field", "seq", "target", "written_at"]
#: Buckets of the state. More make a small batch touch less, and give more files.
BUCKETS = 16

# The parts of the state.
PARTS = {
    "refs": "ref_field string, seq bigint, target string, written_at timestamp",
    "writes": "target string, written_at timestamp",
    "index": "target string, first_written timestamp, removed_at timestamp, revived_at timestamp",
    "open": "ref_field string, seq bigint, target string, written_at timestamp, kind string",
    "counts": "step int, ref_field string, period string, kind string, n_refs bigint, n_targets bigint",
}


def references(docs: DataFrame) -> DataFrame:
    """Distinct references of each row: elements of children and keys of parents, without null and ''.

    Columns ref_field, seq, target, written_at. Null arrays and maps give none; an element that is repeated in a row counts once.
    """
    children = docs.select(F.lit("children").alias("ref_field"), "seq", F.explode(F.array_distinct("children")).alias("target"), "written_at")
    parents = docs.select(F.lit("parents").alias("ref_field"), "seq", F.explode(F.map_keys("parents")).alias("target"), "written_at")
    return children.unionByName(parents).where("target is not null and target <> ''")


def parent_index(writes: DataFrame, removals: DataFrame) -> DataFrame:
    """(target, first_written, removed_at, revived_at) for every page written or removed.

    revived_at is the first write after the removal. Combines partially, so a page with a third of all rows is no burden.
    """
    first = writes.where("doc_id is not null").groupBy(F.col("doc_id").alias("target")).agg(F.min("written_at").alias("first_written"))
    gone = removals.where("doc_id is not null and removed_at is not null").groupBy(F.col("doc_id").alias("target")).agg(F.max("removed_at").alias("removed_at"))
    back = balanced_join(writes.select(F.col("doc_id").alias("target"), "written_at"), gone, "target", "inner").where("written_at > removed_at").groupBy("target").agg(F.min("written_at").alias("revived_at"))
    return first.join(gone.join(back, "target", "left"), "target", "full_outer")


def kinds_of() -> Column:
    """The kinds of a reference beside its target's index row, as an array column."""
    at = F.col("written_at")
    return F.array_compact(F.array(
        F.when(F.col("first_written").isNull(), F.lit("missing")),
        F.when(F.col("first_written") > at, F.lit("later")),
        F.when((F.col("removed_at") <= at) & (F.col("revived_at").isNull() | (F.col("revived_at") > at)), F.lit("removed")),
    ))


def classify(refs: DataFrame, index: DataFrame) -> DataFrame:
    """The orphans among ``refs``, with ``kind``: 'missing', 'later' or 'removed'; a reference may be of two kinds.

    missing: the target was never written. later: its first write is after the referring row. removed: it was taken
    out at or before the referring row and not written again until then. A null written_at is neither later nor removed.
    """
    found = balanced_join(refs.select(*REF), index, "target")
    return found.select(*REF, F.explode(kinds_of()).alias("kind"))


def at_once(*jobs: Callable) -> list:
    """The results of independent jobs, which Spark runs side by side."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


class OrphanTracker:
    """The state and its steps. ``known`` (doc_id): pages outside the collection that may be referred to. A tracker opened on an old ``path`` goes on from its last step."""

    def __init__(self, spark: SparkSession, known: DataFrame | None = None, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.table = spark, VersionedTable(spark, path or scratch_path(spark, "orphans"))
        self.buckets = int(self.table.manifest().extra.get("buckets", buckets))
        self.known = None if known is None else known.select(F.col("doc_id").alias("target")).where("target is not null").distinct()

    # -- the parts -----------------------------------------------------------------------------------------

    def _bucket(self):
        return F.pmod(F.xxhash64("target"), F.lit(self.buckets)).cast("int")

    @staticmethod
    def _place(file: str) -> tuple[str, int]:
        part, _, folder, *_ = file.split("/")
        return part, int(folder.partition("=")[2])

    def _files(self, base: Manifest, part: str, of: Iterable[int] | None = None) -> list[str]:
        """The files of a part, in all buckets or in some."""
        return [f for f in base.files if (p := self._place(f))[0] == part and (of is None or p[1] in of)]

    def _read(self, files: list[str], part: str) -> DataFrame:
        schema = T._parse_datatype_string(PARTS[part])
        return self.spark.read.schema(schema).parquet(*[f"{self.table.path}/{f}" for f in files]) if files else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, part: str) -> list[str]:
        """New files of a part. A bucket with very many rows is cut into several files."""
        names = [f.name for f in T._parse_datatype_string(PARTS[part]).fields]
        rows = df.select(*names, self._bucket().alias("_bucket")).hint("rebalance", "_bucket")
        return [p for ps in self.table.write_files(rows, "_bucket", part).values() for p in ps]

    @staticmethod
    def _touched(files: list[str]) -> set[int]:
        return {OrphanTracker._place(f)[1] for f in files}

    # -- steps ---------------------------------------------------------------------------------------------

    @property
    def step_no(self) -> int:
        return int(self.table.manifest().extra.get("step", 0))

    def _merged(self, base: Manifest, new: DataFrame, removals: DataFrame, buckets: set[int]) -> DataFrame:
        """Index rows of the pages written or removed by the batch, with ``_changed``: whether a reference may stand otherwise now."""
        first = new.groupBy("target").agg(F.min("written_at").alias("_first"))
        gone = removals.groupBy("target").agg(F.max("removed_at").alias("_gone"))
        rows = first.join(gone, "target", "full_outer")
        old_files, history = self._files(base, "index", buckets), new
        if old_files:
            rows = rows.join(self._read(old_files, "index"), "target", "left")
        else:
            rows = rows.withColumns({c: F.lit(None).cast("timestamp") for c in ("first_written", "removed_at", "revived_at")})
        written, removed = F.least("first_written", "_first"), F.greatest("removed_at", "_gone")
        rows = rows.select(
            "target", written.alias("first_written"), removed.alias("removed_at"), F.when(F.col("_gone").isNull() | (F.col("_gone") <= F.col("removed_at")), F.col("revived_at")).alias("revived_at"),
            (~F.col("first_written").eqNullSafe(written)).alias("_arrived"), (~F.col("removed_at").eqNullSafe(removed)).alias("_removed"),
        )
        # The first write after a removal: for a removal that is new, from all writes so far; else from the batch.
        if seen := self._files(base, "writes", buckets):
            history = self._read(seen, "writes").join(rows.where("_removed").select("target"), "target", "left_semi").unionByName(new)
        back = history.join(rows.where("removed_at is not null").select("target", "removed_at"), "target").where("written_at > removed_at").groupBy("target").agg(F.min("written_at").alias("_back"))
        revived = F.least("revived_at", "_back")
        changed = F.col("_arrived") | F.col("_removed") | ~F.col("revived_at").eqNullSafe(revived)
        return rows.join(back, "target", "left").select("target", "first_written", "removed_at", revived.alias("revived_at"), changed.alias("_changed"), self._bucket().alias("_bucket"))

    def advance(self, refs: DataFrame, writes: DataFrame, removals: DataFrame) -> None:
        """One step; a step that fails leaves the state before it in place and can be repeated."""
        base, t = self.table.manifest(), self.table
        if self.known is not None:
            refs = refs.join(self.known, "target", "left_anti")
        gone = removals.where("doc_id is not null and removed_at is not null").select(F.col("doc_id").alias("target"), "removed_at")
        # A page's writes matter as instants only; equal ones are kept once.
        instants = writes.where("doc_id is not null").select(F.col("doc_id").alias("target"), "written_at").distinct()
        gone_in = lambda: {r["b"] for r in gone.select(self._bucket().alias("b")).distinct().collect()} if base.version else set()
        new_refs, new_writes, gone_buckets = at_once(lambda: self._write(refs, "refs"), lambda: self._write(instants, "writes"), gone_in)
        pages = self._touched(new_writes) | gone_buckets
        merged = staged(self._merged(base, self._read(new_writes, "writes"), gone, pages), "index")
        changed, again = merged.where("_changed").select("target"), set()
        if base.version:
            again = {r["_bucket"] for r in merged.where("_changed").select("_bucket").distinct().collect()}

        keep = set(base.files)
        replaced, old_index = merged.drop("_changed", "_bucket"), self._files(base, "index", pages)
        if old_index:
            replaced = self._read(old_index, "index").join(merged.select("target"), "target", "left_anti").unionByName(replaced)
            keep -= set(old_index)
        current, untouched = replaced, self._files(base, "index", (self._touched(new_refs) | again) - pages)
        if untouched:
            current = current.unionByName(self._read(untouched, "index"))
        probing = self._read(new_refs, "refs")
        # One row a target on the right, and references to a page without bound on the left: a skewed partition of the left is split at run time.
        if waiting := self._files(base, "refs", again):
            probing = probing.unionByName(self._read(waiting, "refs").join(changed, "target", "left_semi"))
        closed = self._files(base, "open", again)
        keep -= set(closed)

        def now_open() -> list[str]:
            found = classify(probing, current)
            if closed:
                found = found.unionByName(self._read(closed, "open").join(changed, "target", "left_anti"))
            return self._write(found, "open")

        new_index, new_open = at_once(lambda: self._write(replaced, "index"), now_open)
        step = int(base.extra.get("step", 0)) + 1
        still = self._read([*[f for f in keep if self._place(f)[0] == "open"], *new_open], "open")
        counts = self._counted(still).select(F.lit(step).alias("step"), "ref_field", "period", "kind", "n_refs", "n_targets", F.lit(0).alias("_bucket"))
        new_counts = [f for fs in t.write_files(counts.coalesce(1), "_bucket", "counts").values() for f in fs]
        files = [*new_refs, *new_writes, *new_index, *new_open, *new_counts]
        t.commit(base, {f: None for f in base.files if f in keep} | dict.fromkeys(files), {"step": step, "buckets": self.buckets})

    # -- results -------------------------------------------------------------------------------------------

    def _all(self, part: str) -> DataFrame:
        return self._read(self._files(self.table.manifest(), part), part)

    @staticmethod
    def _counted(orphans: DataFrame) -> DataFrame:
        """Exact counts of references and of different targets. Counted in two steps, first by target, so that no period has to fit one task."""
        period = F.date_format("written_at", "yyyy-MM").alias("period")
        per_target = orphans.groupBy("ref_field", period, "kind", "target").agg(F.count(F.lit(1)).alias("n"))
        return per_target.groupBy("ref_field", "period", "kind").agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_targets"))

    def orphans(self) -> DataFrame:
        """The open orphans: ref_field, period ('YYYY-MM' of the referring row), seq, target, kind."""
        return self._all("open").select("ref_field", F.date_format("written_at", "yyyy-MM").alias("period"), "seq", "target", "kind")

    def snapshots(self) -> DataFrame:
        """What was open after each step: step, ref_field, period, kind, n_refs, n_targets."""
        return self._all("counts")

    def snapshot(self) -> DataFrame:
        """The counts after the last step."""
        return self.snapshots().where(F.col("step") == self.step_no).drop("step")


def track_orphans(docs: DataFrame, removals: DataFrame, known: DataFrame | None = None, steps: int = 2) -> OrphanTracker:
    """The tracker after ``docs`` and ``removals`` came in as ``steps`` batches in order of time.

    Whatever ``steps`` is, the open orphans at the end are the same. Rows without a time come with the first batch.
    """
    tracker = OrphanTracker(docs.sparkSession, known)
    at = F.unix_micros("written_at")
    cuts = docs.agg(F.percentile_approx(at, F.array(*[F.lit(i / steps) for i in range(1, steps)])).alias("c")).first()["c"] if steps > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]

    def between(df: DataFrame, t, lo, hi) -> DataFrame:
        c = F.lit(True)
        c = c & (t > lo) if lo is not None else c
        c = c & (t <= hi) if hi is not None else c
        return df.where(c | t.isNull() if lo is None else c)

    for lo, hi in zip(bounds, bounds[1:]):
        part = between(docs, at, lo, hi)
        tracker.advance(references(part), part, between(removals, F.unix_micros("removed_at"), lo, hi))
    return tracker
