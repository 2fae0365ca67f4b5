import datetime as dt

import pytest
from pyspark.sql import functions as F

from weft.operators.versions import MAX_LITERAL_RUNS, Conflict, IncrementalJob, VersionedTable, first_run_that_sees, publish_runs, replay_runs, run_log


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


@pytest.fixture
def table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.append(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    return t


def test_versions_and_changes(spark, table):
    table.append(spark.createDataFrame([(3, "c")], "id int, v string"))
    table.delete(F.col("id") == 1)
    assert rows(table.read(), "id") == [(2,), (3,)]
    assert rows(table.read(1), "id") == [(1,), (2,)]
    assert rows(table.changes(1), "id", "_change") == [(1, "delete"), (3, "insert")]
    table.delete(F.col("id") == 2)
    assert rows(table.changes(3), "id", "_change") == [(2, "delete")]
    before = table.manifest().version
    table.compact()
    assert rows(table.changes(before), "id") == []
    assert rows(table.read(), "id") == [(3,)]
    assert "file:" not in str(table.manifest())
    d = table.diff(1, 2)
    assert len(d.added) >= 1 and not d.removed and not d.masked


def test_two_writers_cannot_make_one_version(spark, table):
    base = table.manifest()
    table.commit(base, base.files)
    with pytest.raises(Conflict):
        table.commit(base, base.files)


def test_a_failed_run_neither_skips_nor_repeats(spark, table, tmp_path):
    sink = VersionedTable(spark, str(tmp_path / "sink"))
    seen = []

    def process(changes, before):
        seen.append(rows(changes, "id"))
        if len(seen) == 1:
            raise RuntimeError("lost")
        return changes.select("id")

    job = IncrementalJob(table, sink, process)
    with pytest.raises(RuntimeError):
        job.run()
    assert job.processed() == 0 and job.run() == 1 and job.run() is None
    table.append(spark.createDataFrame([(9, "z")], "id int, v string"))
    # Files are written, but the commit is lost: the next run starts from the same place.
    commit = sink.commit
    sink.commit = lambda *a: (_ for _ in ()).throw(OSError("no commit"))
    with pytest.raises(OSError):
        job.run()
    sink.commit = commit
    job.run()
    assert rows(sink.read(), "id") == [(1,), (2,), (9,)]


def t(day, hour=0):
    return dt.datetime(2024, 1, day, hour, tzinfo=dt.timezone.utc)


DOCS = "seq bigint, written_at timestamp, doc_id string, mod_date timestamp, run_id int"
RUNS = "run_id bigint, started_at timestamp, status string"


def found(spark, tmp_path, docs, runs, at_once=2):
    source, sink = VersionedTable(spark, str(tmp_path / "docs")), VersionedTable(spark, str(tmp_path / "sink"))
    log = publish_runs(spark.createDataFrame(docs, DOCS), spark.createDataFrame(runs, RUNS), source)
    return rows(replay_runs(source, sink, log, at_once), "run_id", "seq")


def ten(spark, start=0):
    return spark.range(start, start + 10).select(F.col("id").cast("int").alias("id"), F.lit("x").alias("v"))


def copied(changes, before):
    return changes.where("_change = 'insert'").select("id")


def test_maintenance_of_the_sink_repeats_nothing(spark, tmp_path):
    source, sink = VersionedTable(spark, str(tmp_path / "a b")), VersionedTable(spark, str(tmp_path / "s"))
    source.append(ten(spark))
    job = IncrementalJob(source, sink, copied)
    job.run()
    for keep in (sink.compact, lambda: sink.delete(F.col("id") == 3), sink.clear):
        keep()
        assert job.processed() == 1 and job.run() is None
    assert sink.read().count() == 0
    source.append(ten(spark, 10))
    assert job.run() and sink.read().count() == 10 and job.processed() == 2


def test_maintenance_beside_a_run(spark, tmp_path):
    source, sink = VersionedTable(spark, str(tmp_path / "a")), VersionedTable(spark, str(tmp_path / "s"))
    source.append(ten(spark))
    job = IncrementalJob(source, sink, copied)
    job.run()
    source.append(ten(spark, 10))

    def process(changes, before):
        sink.delete(F.col("id") == 3)
        return copied(changes, before)

    IncrementalJob(source, sink, process).run()
    assert rows(sink.read(), "id") == [(i,) for i in range(20) if i != 3]

    def twice(changes, before):
        job.run()
        return copied(changes, before)

    source.append(ten(spark, 20))
    with pytest.raises(Conflict):
        IncrementalJob(source, sink, twice).run()
    assert sink.read().count() == 29


def test_removed_files_vectors_and_rewrites_in_one_difference(spark, tmp_path):
    source = VersionedTable(spark, str(tmp_path / "with space" / "t"))
    source.append(ten(spark))
    source.delete(F.col("id") < 2)
    source.append(ten(spark, 10))
    source.delete(F.col("id") == 11)
    source.compact()
    source.delete(F.col("id") == 5)
    source.append(ten(spark, 20))
    assert rows(source.read(), "id") == [(i,) for i in range(30) if i not in (0, 1, 5, 11)]
    inserts = [(i, "insert") for i in range(10, 30) if i != 11]
    assert rows(source.changes(1), "id", "_change") == sorted([(0, "delete"), (1, "delete"), (5, "delete"), *inserts])
    got = rows(source.changes(1, [2, 4, 7]), "id", "_change", "_version")
    assert got == sorted([(0, "delete", 2), (1, "delete", 2), (5, "delete", 7), *((i, "insert", 4) for i in range(10, 20) if i != 11), *((i, "insert", 7) for i in range(20, 30))])
    # What comes and goes across a rewrite cancels out.
    source.append(ten(spark, 40))
    source.compact()
    source.delete(F.col("id") >= 40)
    assert rows(source.changes(7), "id") == []
    source.clear()
    assert source.read().count() == 0 and source.changes(7).where("_change = 'delete'").count() == 26


def test_a_compaction_reads_nothing(spark, tmp_path):
    source = VersionedTable(spark, str(tmp_path / "t"))
    source.append(ten(spark))
    source.compact()
    assert "FileScan" not in source.changes(1)._jdf.queryExecution().toString()


def test_many_versions_and_vacuum(spark, tmp_path):
    source = VersionedTable(spark, str(tmp_path / "t"))
    for i in range(20):
        source.append(spark.createDataFrame([(i,)], "id int"))
    source.delete(F.col("id") == 4)
    source.compact()
    again = VersionedTable(spark, str(tmp_path / "t"))
    assert again.newest() == 22 and again.versions() == list(range(1, 23))
    assert rows(again.read(17), "id") == [(i,) for i in range(17)] and rows(again.read(), "id") == [(i,) for i in range(20) if i != 4]
    gone = again.vacuum(22)
    assert len(gone) > 20 and again.read().count() == 19 and again.vacuum(22) == []


def test_a_run_killed_between_write_and_commit(spark, tmp_path):
    source, sink = VersionedTable(spark, str(tmp_path / "docs")), VersionedTable(spark, str(tmp_path / "sink"))
    docs = [(i, t(1 + i % 9), f"p{i % 7}", t(1 + i * 5 % 11), 0) for i in range(60)]
    runs = [(i, t(i + 1), "ok" if i % 3 else "failed") for i in range(9)]
    log = publish_runs(spark.createDataFrame(docs, DOCS), spark.createDataFrame(runs, RUNS), source)
    commit, n = sink.commit, []

    def dying(*a, **k):
        n.append(1)
        if len(n) == 2:
            raise OSError("killed")
        return commit(*a, **k)

    sink.commit = dying
    with pytest.raises(OSError):
        replay_runs(source, sink, log, 2)
    sink.commit = commit
    sink.compact()
    got = rows(replay_runs(source, sink, log, 2), "run_id", "seq")
    assert got == found(spark, tmp_path / "other", docs, runs, 50) == brute_versions(docs, runs)


def brute_versions(docs, runs):
    out, seen = [], []
    for run, at, _ in sorted((r for r in runs if r[2] == "ok"), key=lambda r: r[1]):
        now = [d for d in docs if d[1] <= at and d[3] is not None]
        for page in {d[2] for d in now}:
            new = [d for d in now if d[2] == page and d not in seen]
            past = [d[3] for d in seen if d[2] == page]
            if new:
                best = min(new, key=lambda d: (-d[3].timestamp(), d[0]))
                if not past or best[3] > max(past):
                    out.append((run, best[0]))
        seen = now
    return sorted(out)


def test_new_page_versions(spark, tmp_path):
    docs = [
        (1, t(1), "a", t(1), 0), (2, t(1), "a", t(1), 0), (3, t(1), "b", None, 0), (4, t(3), "a", t(1), 0), (5, t(3), "a", t(2), 0), (6, t(3), "b", t(1), 0),
        (7, t(5), "a", t(1), 0), (8, t(5), None, t(1), 0), (9, None, "c", t(1), 0), (10, t(9), "d", t(1), 0), (11, t(2), "e", t(1), 0),
    ]
    runs = [(10, t(2), "ok"), (11, t(3), "failed"), (12, t(4), "ok"), (13, t(4), "ok"), (14, t(6), "ok"), (15, None, "ok"), (16, t(7), "aborted")]
    assert found(spark, tmp_path, docs, runs) == [(10, 1), (10, 11), (12, 5), (12, 6)]


def test_no_runs_and_no_rows(spark, tmp_path):
    assert found(spark, tmp_path / "x", [(1, t(1), "a", t(1), 0)], []) == []
    assert found(spark, tmp_path / "y", [], [(1, t(1), "ok")]) == []


def test_many_runs_take_the_other_path(spark):
    runs = spark.range(MAX_LITERAL_RUNS + 40).select(F.col("id").alias("run_id"), F.timestamp_seconds(F.col("id") * 1000).alias("started_at"), F.lit("ok").alias("status"))
    docs = spark.range(50).select(F.timestamp_seconds(F.col("id") * 11_111).alias("written_at"), "id")
    got = {r.id: r._v for r in first_run_that_sees(docs, [t for _, t, _ in run_log(runs)]).collect()}
    assert got == {i: -(-i * 11_111 // 1000) + 1 for i in range(50) if -(-i * 11_111 // 1000) < MAX_LITERAL_RUNS + 40}
