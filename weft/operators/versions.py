"""An append-friendly table of immutable files with a manifest per version, and jobs that see only what is new.

A version is a set of data files, each with the deletion vector that holds for it (or none), what kind of operation made it, and what the
writers want kept with the table. Manifests hold the difference to the version before, and every so often the whole set. Files never
change. So the difference of two versions is found from manifests alone: files added, files removed, deletion vectors that grew.
Manifests are created exclusively; a version exists from the moment its manifest does, and never partly.

A job keeps the source version it has processed inside the commit of its output, and every later commit of the
output hands it on. A run that fails before the commit leaves only files that no manifest names; the next run starts from the same
source version, so no record is skipped or seen twice.

Exclusive creation needs a file system that links or renames without overwriting in one step: a local disk, HDFS, and stores with a
hierarchical namespace do. On a plain object store one writer at a time must be seen to.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Every so many versions a manifest names all files.
WHOLE_EVERY = 16
VECTOR = "file string, pos bigint"


@dataclass
class Manifest:
    """files: data file -> deletion vector or None, both relative to the table. extra: what the table carries besides. op: what made the version."""

    version: int
    files: dict[str, str | None] = field(default_factory=dict)
    extra: dict = field(default_factory=dict)
    op: str = "append"


@dataclass
class Diff:
    """What lies between two versions: whole files, and files whose deletion vector changed (old, new)."""

    added: dict[str, str | None]
    removed: dict[str, str | None]
    masked: dict[str, tuple[str | None, str | None]]


def difference(a: dict[str, str | None], b: dict[str, str | None]) -> Diff:
    """From two sets of files."""
    return Diff(
        {f: v for f, v in b.items() if f not in a},
        {f: v for f, v in a.items() if f not in b},
        {f: (a[f], v) for f, v in b.items() if f in a and a[f] != v},
    )


class Conflict(Exception):
    """Another writer has made this version already."""


def union_all(parts: Iterable[DataFrame]) -> DataFrame | None:
    df = None
    for p in parts:
        df = p if df is None else df.unionByName(p)
    return df


class VersionedTable:
    """A table below ``path`` on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.schema = schema
        self._known: dict[int, Manifest] = {}

    # -- manifests --------------------------------------------------------------------------------------

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/{version:010d}.json"

    def versions(self) -> list[int]:
        """All versions that exist, in order; a table without a commit has none."""
        at = self._fs_path(f"{self.path}/manifests")
        names = (s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else ()
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def newest(self) -> int:
        """The latest version; 0 is the empty table before the first commit."""
        top = max(self._known, default=0)
        while self._fs.exists(self._fs_path(self._manifest_path(top + 1))):
            top += 1
        return top if top else max(self.versions(), default=0)

    def _body(self, version: int) -> dict:
        stream = self._fs.open(self._fs_path(self._manifest_path(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version (default: the latest); version 0 is the empty table. Manifests never change, so each is read once."""
        version = self.newest() if version is None else version
        if not version:
            return Manifest(0)
        steps, at = [], version
        while at and at not in self._known:
            steps.append((at, self._body(at)))
            if "files" in steps[-1][1]:
                break
            at -= 1
        for v, body in reversed(steps):
            if "files" in body:
                files = body["files"]
            else:
                files = {f: m for f, m in self.manifest(v - 1).files.items() if f not in body["removed"]} | body["set"]
            self.schema = self.schema or (T.StructType.fromJson(body["schema"]) if body["schema"] else None)
            self._known[v] = Manifest(v, files, body["extra"], body["op"])
        return self._known[version]

    def commit(self, base: Manifest, files: dict[str, str | None], extra: dict | None = None, op: str = "append") -> Manifest:
        """Makes the version after ``base``; raises Conflict if another writer was first. What ``base`` carries is handed on, ``extra`` comes on top."""
        new = Manifest(base.version + 1, files, base.extra | (extra or {}), op)
        body = {"op": op, "extra": new.extra, "schema": self.schema.jsonValue() if self.schema else None}
        if base.version % WHOLE_EVERY == 0:
            body["files"] = files
        else:
            d = difference(base.files, files)
            body |= {"removed": list(d.removed), "set": d.added | {f: v for f, (_, v) in d.masked.items()}}
        part = f"{self.path}/manifests/.{uuid.uuid4().hex}"
        out = self._fs.create(self._fs_path(part), False)
        try:
            out.write(bytearray(json.dumps(body).encode()))
        finally:
            out.close()
        if not self._place(part, self._manifest_path(new.version)):
            self._fs.delete(self._fs_path(part), False)
            raise Conflict(f"version {new.version} of {self.path} exists")
        self._known[new.version] = new
        return new

    def _place(self, part: str, final: str) -> bool:
        """Gives a finished file its name, unless that is taken, in one step."""
        if self._fs.getScheme() == "file":
            local = lambda p: self._fs_path(p).toUri().getPath()
            try:
                os.link(local(part), local(final))
            except FileExistsError:
                return False
            os.remove(local(part))
            return True
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._fs_path(part), self._fs_path(final), keep)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or self._fs.exists(self._fs_path(final)):
                return False
            raise
        return True

    # -- writing ----------------------------------------------------------------------------------------

    def write_files(self, df: DataFrame, partition_by: str | None = None, label: str = "data") -> dict[str, list[str]]:
        """Writes data files that no version names yet; returns them, relative to the table, by the value of ``partition_by`` ('' without).

        Values of ``partition_by`` must be whole numbers; the files lie below a folder of this write's own."""
        if self.schema is None:
            self.schema = T.StructType([f for f in df.schema.fields if f.name != partition_by])
        own = f"{label}/{uuid.uuid4().hex}"
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(f"{self.path}/{own}")
        found: dict[str, list[str]] = {}
        it = self._fs.listFiles(self._fs_path(f"{self.path}/{own}"), True)
        while it.hasNext():
            p = it.next().getPath()
            if p.getName().endswith(".parquet"):
                folder = p.getParent().getName()
                value = folder.partition("=")[2] if partition_by else ""
                found.setdefault(value, []).append(f"{own}/{folder}/{p.getName()}" if partition_by else f"{own}/{p.getName()}")
        return found

    def append(self, df: DataFrame, extra: dict | None = None, base: Manifest | None = None) -> Manifest:
        """A version with the rows of ``df`` added. With ``base`` it must be the one right after it."""
        base = base or self.manifest()
        new = [p for ps in self.write_files(df).values() for p in ps]
        return self.commit(base, base.files | dict.fromkeys(new), extra)

    def delete(self, condition) -> Manifest:
        """A version without the rows for which ``condition`` holds; data files stay, deletion vectors are written."""
        base = self.manifest()
        gone = self._rows(base.files).where(condition).select(F.col("_file").alias("file"), F.col("_pos").alias("pos"))
        touched = [r["file"] for r in gone.select("file").distinct().toLocalIterator()]
        if not touched:
            return self.commit(base, base.files, op="delete")
        old = self._vectors({f: base.files[f] for f in touched})
        whole = (gone.unionByName(old) if old is not None else gone).distinct()
        own = f"vectors/{uuid.uuid4().hex}"
        whole.withColumn("h", F.md5("file")).repartition("file").write.partitionBy("h").parquet(f"{self.path}/{own}")
        import hashlib

        return self.commit(base, base.files | {f: f"{own}/h={hashlib.md5(f.encode()).hexdigest()}" for f in touched}, op="delete")

    def compact(self) -> Manifest:
        """A version with the same rows in new files and without deletion vectors."""
        base = self.manifest()
        return self.commit(base, dict.fromkeys(p for ps in self.write_files(self.read()).values() for p in ps), op="rewrite")

    def clear(self) -> Manifest:
        """A version without rows; older versions stay readable."""
        return self.commit(self.manifest(), {}, op="delete")

    def vacuum(self, keep_from: int) -> list[str]:
        """Deletes data files and vectors that no version from ``keep_from`` on names, and returns them. Older versions can't be read any more.

        Files of a write that has not been committed yet look the same as left-overs of a failed one: not to be run beside a writer. Jobs must
        have processed version ``keep_from``."""
        keep = set()
        for v in range(max(1, keep_from), self.newest() + 1):
            files = self.manifest(v).files
            keep |= set(files) | {x for x in files.values() if x}
        gone, root = [], self._fs_path(self.path).toUri().getPath()
        it = self._fs.listFiles(self._fs_path(self.path), True)
        while it.hasNext():
            p = it.next().getPath()
            name = p.toUri().getPath()[len(root) + 1 :]
            if name.endswith(".parquet") and not name.startswith("manifests/") and name not in keep and name.rpartition("/")[0] not in keep:
                gone.append((name, p))
        for _, p in gone:
            self._fs.delete(p, False)
        return [n for n, _ in gone]

    # -- reading ----------------------------------------------------------------------------------------

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema or T.StructType())

    def _vectors(self, files: dict[str, str | None]) -> DataFrame | None:
        """The deleted rows (file, pos) of these files, by one read of all their vectors."""
        held = sorted({v for v in files.values() if v})
        return self.spark.read.schema(VECTOR).parquet(*[f"{self.path}/{v}" for v in held]) if held else None

    def scan_files(self, files: Iterable[str], schema: T.StructType | None = None) -> DataFrame:
        """The rows of data files with ``_file`` (relative to the table) and ``_pos``, deleted ones too."""
        schema = schema or self.schema
        df = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in files])
        # Names below the table hold no sign that a URI writes in another way, so the end of the path is the name.
        name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[0-9a-f]{32}/(?:[^/=]+=[^/]+/)?[^/]+)$", 1)
        return df.select(*[F.col(f"`{c}`") for c in schema.names], name.alias("_file"), F.col("_metadata.row_index").alias("_pos"))

    def _rows(self, files: dict[str, str | None]) -> DataFrame:
        if not files:
            return self._empty().withColumn("_file", F.lit("")).withColumn("_pos", F.lit(0).cast("bigint"))
        df = self.scan_files(files)
        gone = self._vectors(files)
        return df if gone is None else df.join(gone, [df._file == gone.file, df._pos == gone.pos], "left_anti")

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it was at a version."""
        files = self.manifest(version).files
        if not files or any(files.values()):
            return self._rows(files).drop("_file", "_pos")
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in files])

    def diff(self, since: int, until: int | None = None) -> Diff:
        """From the two manifests alone."""
        return difference(self.manifest(since).files, self.manifest(until).files)

    def _stretches(self, since: int, until: int) -> list[Diff]:
        """The differences from ``since`` to ``until``, without the rewrites in between: those change files, but no content."""
        out, start = [], since
        for v in range(since + 1, until + 1):
            if self.manifest(v).op == "rewrite":
                out.append(self.diff(start, v - 1))
                start = v
        return [d for d in [*out, self.diff(start, until)] if d.added or d.removed or d.masked]

    def _gone(self, d: Diff) -> list[DataFrame]:
        """The rows that a difference took out: those of removed files, and those that vectors hide since."""
        parts = [self._rows(d.removed)] if d.removed else []
        if d.masked:
            new, old = self._vectors({f: v[1] for f, v in d.masked.items()}), self._vectors({f: v[0] for f, v in d.masked.items()})
            grown = new if old is None else new.join(old, ["file", "pos"], "left_anti")
            rows = self.scan_files(d.masked)
            parts.append(rows.join(grown, [rows._file == grown.file, rows._pos == grown.pos], "left_semi"))
        return parts

    def changes(self, since: int, marks: Sequence[int] | int | None = None) -> DataFrame:
        """Rows that came ('insert') or went ('delete', column ``_change``) after version ``since``, for one later version or for several at once.

        With several, in ascending order, ``_version`` is the mark up to which a row's change belongs: what came between the mark before and this one.
        Only the files that manifests differ in are read, the added ones of all marks in one scan. A rewrite (compact) is no change of
        content and costs nothing. Rows that come and go between two marks cancel out.
        """
        marks = [self.newest()] if marks is None else [marks] if isinstance(marks, int) else list(marks)
        came, parts, mixed = {}, [], False
        for a, b in zip([since, *marks], marks):
            stretches = self._stretches(a, b)
            mixed |= len(stretches) > 1 and any(d.removed or d.masked for d in stretches) or any(d.added and d.removed for d in stretches)
            for d in stretches:
                came |= {f: (v, b) for f, v in d.added.items()}
                parts += [p.drop("_file", "_pos").withColumns({"_change": F.lit("delete"), "_version": F.lit(b)}) for p in self._gone(d)]
        if came:
            rows = self._rows({f: v for f, (v, _) in came.items()})
            if len(marks) == 1:
                rows = rows.withColumn("_version", F.lit(marks[0]))
            else:
                import pyarrow as pa

                # A local table of known size, so that Spark broadcasts it only if it is small enough.
                at = pa.table({"_file": pa.array(list(came), pa.string()), "_version": pa.array([m for _, m in came.values()], pa.int32())})
                rows = rows.join(self.spark.createDataFrame(at), "_file")
            parts.append(rows.drop("_file", "_pos").withColumn("_change", F.lit("insert")).select(*self.schema.names, "_change", "_version"))
        df = union_all(parts)
        if df is None:
            return self._empty().withColumns({"_change": F.lit("insert"), "_version": F.lit(None).cast("int")})
        return self._net(df) if mixed else df

    def _net(self, df: DataFrame) -> DataFrame:
        """Equal rows on both sides are a move, not a change."""
        sign = F.when(F.col("_change") == "insert", 1).otherwise(-1)
        whole = F.to_json(F.struct(*self.schema.names), {"ignoreNullFields": "false"})
        df = df.groupBy(whole.alias("_row"), "_version").agg(F.sum(sign).alias("_net"), F.first(F.struct(*self.schema.names)).alias("_r"))
        kind = F.when(F.col("_net") > 0, "insert").otherwise("delete")
        return df.where("_net <> 0").select("_r.*", F.explode(F.array_repeat(kind, F.abs("_net").cast("int"))).alias("_change"), "_version")


class IncrementalJob:
    """Feeds each change of ``source`` to ``process`` once and commits its output to ``sink``.

    ``process(changes, sink_before) -> DataFrame`` gets the changed rows with ``_change`` and ``_version`` and the sink's rows (None before the first commit);
    what it returns is appended.
    """

    KEY = "source_version"

    def __init__(self, source: VersionedTable, sink: VersionedTable, process: Callable[[DataFrame, DataFrame | None], DataFrame]):
        self.source, self.sink, self.process = source, sink, process

    def processed(self) -> int:
        """The source version behind the sink's last commit; 0 before the first."""
        return int(self.sink.manifest().extra.get(self.KEY, 0))

    def run(self, marks: Sequence[int] | None = None) -> int | None:
        """One run; returns the sink's new version, or None when nothing is new. May be repeated after any failure.

        ``marks`` are source versions, ascending, whose changes are to be told apart; all up to the last are processed by one plan and saved by one commit.
        Those that are processed already are passed over. The default is the newest version alone.
        """
        base = self.sink.manifest()
        done = int(base.extra.get(self.KEY, 0))
        todo = [m for m in (marks or [self.source.newest()]) if m > done]
        if not todo:
            return None
        out = self.process(self.source.changes(done, todo), self.sink.read(base.version) if base.version else None)
        files = dict.fromkeys(p for ps in self.sink.write_files(out).values() for p in ps)
        while True:
            try:
                return self.sink.commit(base, base.files | files, {self.KEY: todo[-1]}).version
            except Conflict:
                # Maintenance of the sink came between: the output still fits, unless another run was first.
                base = self.sink.manifest()
                if int(base.extra.get(self.KEY, 0)) != done:
                    raise


# -- page versions that are new to each run ----------------------------------------------------------------

#: Run starts are compared as a literal array up to this many runs, beyond it by binary search in Arrow batches. The results are equal.
MAX_LITERAL_RUNS = 512
#: Runs whose versions one commit of a job catches up with.
RUNS_PER_COMMIT = 50


def run_log(runs: DataFrame) -> list[tuple[int, int, bool]]:
    """(run_id, started_at in microseconds, ended well) of all runs that have started, in order; of runs that start together those of smaller run_id come first.

    The table is a log of jobs, one row per run of the pipeline: it fits the driver at any size of the data."""
    rows = runs.where("started_at is not null").orderBy("started_at", "run_id").select("run_id", F.unix_micros("started_at").alias("t"), F.coalesce(F.col("status") == "ok", F.lit(False)).alias("ok"))
    return [(r["run_id"], r["t"], r["ok"]) for r in rows.collect()]


def first_run_that_sees(docs: DataFrame, times: Sequence[int]) -> DataFrame:
    """``docs`` with ``_v``: the number (from 1) of the first of ``times`` at or after written_at. Rows later than all, or without written_at, are left out."""
    at = F.unix_micros("written_at")
    if len(times) <= MAX_LITERAL_RUNS:
        # The starts are sorted, so the number of starts before written_at is the index of the first at or after it.
        literal = F.array(*[F.lit(t).cast("bigint") for t in times]) if times else F.array().cast("array<bigint>")
        v = F.size(F.filter(literal, lambda t: t < at)) + 1
        return docs.where("written_at is not null").withColumn("_v", v).where(F.col("_v") <= len(times))

    @F.pandas_udf("int")
    def number(micros: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(times, "int64"), micros.to_numpy("int64"), side="left") + 1, dtype="int32")

    return docs.where("written_at is not null").withColumn("_v", number(at)).where(F.col("_v") <= len(times))


def publish_runs(docs: DataFrame, runs: DataFrame, table: VersionedTable) -> list[tuple[int, bool]]:
    """Ingests ``docs``, whole records, as the versioned table in which the log had grown when each run started, whatever became of the run.

    Version i is what run i sees. Each task writes its rows once, by the version that first holds them; whole records are not shuffled. A log that is stored about in order
    of time gives few files a task; one in no order gives a file per task and version at most, and a version with most of the rows comes from all tasks. Each
    manifest names the files that came. Returns (run_id, ended well) of the runs, in order of their versions.
    """
    log = run_log(runs)
    files = table.write_files(first_run_that_sees(docs, [t for _, t, _ in log]), "_v")
    base = table.manifest()
    for i in range(len(log)):
        base = table.commit(base, base.files | dict.fromkeys(files.get(str(i + 1), [])))
    return [(run, ok) for run, _, ok in log]


PAGE_VERSION = "source_version int, seq bigint, doc_id string, mod_date timestamp"


def new_page_versions(changes: DataFrame, before: DataFrame | None) -> DataFrame:
    """(source_version, seq, doc_id, mod_date): the page versions that are new up to each source version; the process of an IncrementalJob.

    ``changes`` are inserted rows with doc_id, seq, mod_date and _version; what was deleted since is passed over, for a page version that was handed on stays so.
    ``before`` is what the job has put out so far, which tells how far each page had come. Rows with null mod_date never count, nor do rows with null doc_id. Within
    a page's new rows of a version the greatest mod_date wins, of equals the smallest seq; it is handed on if the page had no counted
    row before, or none as late. Repeated rows (equal but for seq) therefore come out once. A page that holds many rows
    is combined to one row per version before the window, so a window is never larger than the number of versions at once.
    """
    best = F.max(F.struct(F.col("mod_date").alias("m"), (-F.col("seq")).alias("s"))).alias("b")
    counted = changes.where("_change = 'insert' and mod_date is not null and doc_id is not null")
    found = counted.groupBy("doc_id", F.col("_version").alias("_v")).agg(best)
    if before is not None:
        past = before.groupBy("doc_id").agg(F.max("mod_date").alias("m"))
        known = past.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
        found = found.unionByName(known.select("doc_id", F.lit(0).alias("_v"), F.struct("m", F.lit(0).cast("bigint").alias("s")).alias("b")))
    earlier = Window.partitionBy("doc_id").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    new = found.withColumn("_past", F.max("b.m").over(earlier)).where("_v > 0 and (_past is null or b.m > _past)")
    return new.select(F.col("_v").cast("int").alias("source_version"), (-F.col("b.s")).alias("seq"), "doc_id", F.col("b.m").alias("mod_date"))


def replay_runs(source: VersionedTable, sink: VersionedTable, log: Sequence[tuple[int, bool]], at_once: int = RUNS_PER_COMMIT) -> DataFrame:
    """(run_id, seq, doc_id, mod_date): what each run that ended well had to process, by a job over the versions of ``source`` (from publish_runs).

    Runs that failed commit nothing, so the next good run's difference reaches back over the versions they saw. ``at_once`` good runs are caught up with
    by one plan and one commit, from the processed version and the rows that the commit before has saved.
    """
    job = IncrementalJob(source, sink, new_page_versions)
    good = [i for i, (_, ok) in enumerate(log, 1) if ok]
    for k in range(0, len(good), at_once):
        job.run(good[k : k + at_once])
    if not good:
        return source.spark.createDataFrame([], "run_id bigint, seq bigint, doc_id string, mod_date timestamp")
    import pyarrow as pa

    ids = pa.table({"source_version": pa.array(good, pa.int32()), "run_id": pa.array([log[i - 1][0] for i in good], pa.int64())})
    return sink.read().join(source.spark.createDataFrame(ids), "source_version").select("run_id", "seq", "doc_id", "mod_date")
