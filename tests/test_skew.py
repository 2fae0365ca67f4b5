from pyspark.sql import functions as F

from weft.operators.order import running_total
from weft.operators.skew import balanced_join, heavy_hitters, key_profile, per_key


def hot(spark, n=3000):
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k"), "id", F.lit(7).alias("label"))


def test_heavy_hitters_find_the_hot_key(spark):
    assert "hot" in heavy_hitters(hot(spark), "k", 0.05)
    assert heavy_hitters(hot(spark).limit(0), "k") == []


def test_balanced_join_equals_plain_join(spark):
    facts, dim = hot(spark), spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), (None, 4)], "k string, v int").withColumn("label", F.lit("clash"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        a = balanced_join(facts, dim, "k", how, heavy=["hot"])
        b = facts.join(dim.drop("label"), "k", how)
        assert sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(a.columns)).collect())), how


def test_per_key_is_the_same_whatever_is_heavy(spark):
    dim = spark.createDataFrame([("hot", "H"), ("k1", "K"), ("k1", "K")], "k string, label string")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("id").alias("s")]
    rows = [sorted(map(tuple, per_key(hot(spark).drop("label"), dim, "k", aggs, ["label"], share).drop("heavy").collect()), key=repr) for share in (0.9, 0.0005)]
    assert rows[0] == rows[1] and any(r[0] == "hot" and r[1] == 1000 for r in map(lambda r: (r[0], r[1]), rows[0]))


def test_key_profile_edge_cases(spark):
    schema = "seq bigint, doc_id string, url string, words map<string,bigint>, parents map<string,array<string>>, n_rows int, map_key string"
    rows = [(1, "a", None, {"t": 3}, {"p": None, "q": ["x", "y"]}, 0, "z"), (2, "a", "u", {"t": 3}, {}, 0, "z"), (3, "b", "v", None, None, 0, None), (4, None, None, {"t": 3, "s": 1}, {"a": []}, 0, None)]
    got = {(r.map_name, r.map_key): r for r in key_profile(spark.createDataFrame(rows, schema), spark.createDataFrame([("t", "tide")], "term_hash string, term string")).collect()}
    assert got["words", "t"].n_rows == 3 and got["words", "t"].total == 9 and got["words", "t"].label == "tide" and got["words", "t"].rows_with_map == 3
    assert got["parents", "p"].total == 0 and got["parents", "q"].total == 2 and got["parents", "a"].label == "u" and got["parents", "a"].rows_with_map == 2
    assert key_profile(spark.createDataFrame([], schema), spark.createDataFrame([], "term_hash string, term string")).count() == 0


def test_running_total_over_many_parts(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 < 7, F.lit("big")).when(F.col("id") % 10 == 7, F.lit(None)).otherwise(F.lit("small")).alias("g"), F.xxhash64("id").alias("o"), F.lit(2).alias("w"))
    got = running_total(df, ["g"], [F.desc("o")], F.col("w"), "before", partitions=7).collect()
    assert len(got) == 1000
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.o, r.before))
    for rows in by.values():
        assert [b for _, b in sorted(rows, reverse=True)] == list(range(0, 2 * len(rows), 2))
    assert running_total(df.limit(0), ["g"], [F.desc("o")], F.col("w"), "before").count() == 0
