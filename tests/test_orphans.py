import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weft.operators.orphans import OrphanTracker, classify, parent_index, references, track_orphans

DOCS = "seq bigint, written_at timestamp, doc_id string, children array<string>, parents map<string,array<string>>, kind string, target string"


def t(h):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=h)


def brute(docs, removals, known):
    out = set()
    for seq, at, _, children, parents, *_ in docs:
        refs = {("children", c) for c in children or [] if c} | {("parents", p) for p in parents or {} if p}
        for field, x in refs:
            if x in known:
                continue
            writes = [d[1] for d in docs if d[2] == x]
            if not writes:
                out.add((field, at.strftime("%Y-%m"), seq, x, "missing"))
            elif min(writes) > at:
                out.add((field, at.strftime("%Y-%m"), seq, x, "later"))
            gone = dict(removals).get(x)
            if gone and gone <= at and not any(gone < w <= at for w in writes):
                out.add((field, at.strftime("%Y-%m"), seq, x, "removed"))
    return out


def make(rng, n):
    ids = [f"p{i}" for i in range(12)]
    docs = [(i, t(rng.randrange(2000)), rng.choice(ids[:9]), rng.choice([None, [], [rng.choice(ids), None, "", ids[0], ids[0]]]), rng.choice([None, {}, {rng.choice(ids): None, "": []}]), "x", "y") for i in range(n)]
    return docs, [(x, t(rng.randrange(2000))) for x in rng.sample(ids, 5)]


def test_against_brute_force_and_any_number_of_steps(spark):
    rng = random.Random(5)
    docs, removals = make(rng, 150)
    df, rem = spark.createDataFrame(docs, DOCS), spark.createDataFrame(removals, "doc_id string, removed_at timestamp")
    known = spark.createDataFrame([("p11",)], "doc_id string")
    want = brute(docs, removals, {"p11"})
    for steps in (1, 3, 7):
        got = list(map(tuple, track_orphans(df, rem, known, steps).orphans().collect()))
        assert len(got) == len(set(got)) and set(got) == want


def test_arrival_in_any_order(spark):
    rng = random.Random(7)
    docs, removals = make(rng, 80)
    df, rem = spark.createDataFrame(docs, DOCS), spark.createDataFrame(removals, "doc_id string, removed_at timestamp")
    tracker = OrphanTracker(spark)
    for k in (2, 0, 1):
        part = df.where(f"seq % 3 = {k}")
        tracker.advance(references(part), part, rem if k == 1 else rem.limit(0))
    assert set(map(tuple, tracker.orphans().collect())) == brute(docs, removals, set())
    assert sum(r.n_refs for r in tracker.snapshot().collect()) == tracker.orphans().count()
    assert {r.step for r in tracker.snapshots().collect()} == {1, 2, 3} and tracker.step_no == 3
    counts = {(r.ref_field, r.period, r.kind): (r.n_refs, r.n_targets) for r in tracker.snapshot().collect()}
    seen = {}
    for field, period, _, target, kind in brute(docs, removals, set()):
        seen.setdefault((field, period, kind), []).append(target)
    assert counts == {k: (len(v), len(set(v))) for k, v in seen.items()}


def test_a_step_reads_what_its_batch_touches(spark, tmp_path):
    tracker = OrphanTracker(spark, path=str(tmp_path / "state"))
    docs = [(i, t(i), f"p{i}", [f"p{i + 1}", f"q{i}"], None, "", "") for i in range(600)]
    df, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "doc_id string, removed_at timestamp")
    tracker.advance(references(df), df, none)
    assert tracker.orphans().where("kind = 'missing'").count() == 601
    asked, read = [], tracker._read
    tracker._read = lambda files, part: (asked.extend((part, *tracker._place(f)) for f in files), read(files, part))[1]
    one = spark.createDataFrame([(9_000, t(9_000), "q7", [], None, "", "")], DOCS)
    tracker.advance(references(one), one, none)
    assert {b for part, _, b in asked if part in ("refs", "writes", "index")} == {one.select(F.pmod(F.xxhash64(F.lit("q7")), F.lit(tracker.buckets))).first()[0]}
    again = OrphanTracker(spark, path=str(tmp_path / "state"))
    assert again.step_no == 2 and again.orphans().where("target = 'q7'").select("kind").collect() == [("later",)]
    # A page that is written again touches no reference.
    asked.clear()
    tracker.advance(references(one), one.withColumn("written_at", F.lit(t(9_500))), none)
    assert not [a for a in asked if a[0] == "refs"]
    gone = spark.createDataFrame([("p5", t(2))], "doc_id string, removed_at timestamp")
    tracker.advance(references(one), one.limit(0), gone)
    assert tracker.orphans().where("target = 'p5' and kind = 'removed'").count() == 1


def test_a_step_that_fails_is_repeated(spark, tmp_path):
    rng = random.Random(9)
    docs, removals = make(rng, 60)
    df, rem = spark.createDataFrame(docs, DOCS), spark.createDataFrame(removals, "doc_id string, removed_at timestamp")
    tracker = OrphanTracker(spark, path=str(tmp_path / "state"), buckets=3)
    tracker.advance(references(df.where("seq < 30")), df.where("seq < 30"), rem)
    commit = tracker.table.commit
    tracker.table.commit = lambda *a, **k: (_ for _ in ()).throw(OSError("lost"))
    rest = df.where("seq >= 30")
    with pytest.raises(OSError):
        tracker.advance(references(rest), rest, rem.limit(0))
    tracker.table.commit = commit
    tracker.advance(references(rest), rest, rem.limit(0))
    assert set(map(tuple, tracker.orphans().collect())) == brute(docs, removals, set())


def test_empty(spark):
    df, rem = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id string, removed_at timestamp")
    assert track_orphans(df, rem).orphans().count() == 0
    assert classify(references(df), parent_index(df, rem)).count() == 0
