"""The page model from all labelled pages of a table: pages are read once, counted by Spark, and the weights descend over blocks of like nodes."""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.boilerplate import BESIDE, SITES, Model, NoLabels, Page, Rows, content_measures, descend, labels, likes, main_texts, named, tie, ties_of
from weft.llm.prose import EXPECTED, LEAST_CHARS, LEAST_PAGES, LEAST_WORDS, MARKERS, MARKUP, SENTENCE, SHAPE, Fit, Measured, Yardstick, fitted
from weft.session import drop_path, scratch_path

#: Bytes of the keys of like nodes that one task, or the driver, holds while the weights descend.
BLOCK = 1 << 24

READ = "doc_id string, site string, phrases array<string>, texts array<string>, sentences array<int>, page binary"
LEARNT = "key binary, zeros bigint, ones bigint, block boolean, above int, own int, common array<string>, whole array<bigint>, lengths array<bigint>, sizes array<bigint>, words array<bigint>, ended array<boolean>"
#: What is known of a page's measures: its commonest short words, length and size of markup and shape, and of each sentence length, size, words and whether a mark ends it.
MEASURED = LEARNT[LEARNT.index("common") :]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for d, u, h in zip(b["doc_id"].tolist(), b["url"].tolist(), b["html"].tolist()):
            p = Page(h, u)
            if named(p):
                own = main_texts(p)
                out.append((d, p.site, [*{p.phrase(i): 0 for i in p.leaves}], [t for _, t in own], [p.below[i][3] for i, _ in own], pickle.dumps(p, 5)))
        yield pd.DataFrame(out, columns=["doc_id", "site", "phrases", "texts", "sentences", "page"])


def _learn(inviting, standing):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in LEARNT.split(", ")]
        for b in batches:
            ties, out = Counter(), []

            def walk(pages):
                for raw in pages:
                    p = pickle.loads(raw)
                    y = labels(p, inviting.value)
                    ties.update(ties_of([(p, y)]))
                    m = content_measures(p, y)
                    if m.words >= LEAST_WORDS:
                        sentences = list(m.sentences())
                        out.append((*[None] * 6, m.common, [x for q in m.whole for x in q], *([s[k] for s in sentences] for k in range(4))))
                    yield p, y

            like = likes(walk(b["page"].tolist()), standing.value)
            out += [(k, *n, *[None] * 9) for k, n in like.items()]
            out += [(None, n, None, *k, *[None] * 6) for k, n in ties.items()]
            yield pd.DataFrame(out, columns=names, dtype=object)

    return run


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = [r for b in batches for r in zip(b["key"].tolist(), b["zeros"].tolist(), b["ones"].tolist())]
    if rows:
        yield pd.DataFrame({"key": [rows[0][0]], "rows": [pickle.dumps(Rows(rows), 5)], "total": [sum(a + c for _, a, c in rows)]})


def _gradient(w, block: tuple[bytes, bytes]) -> tuple[bytes, np.ndarray]:
    return block[0], pickle.loads(block[1]).gradient(w.value)


def _weights(like: DataFrame, path: str) -> np.ndarray:
    """The weights from (key, zeros, ones) of like nodes. What one block holds descends on the driver; more blocks stay with the executors, which give each round's sums."""
    spark = like.sparkSession
    like.write.parquet(path + "/like")
    like = spark.read.parquet(path + "/like")
    n = max(1, math.ceil((like.agg(F.sum(F.length("key"))).first()[0] or 0) / BLOCK))
    if n == 1:
        rows = Rows(like.orderBy("key").collect())
        return descend(rows.gradient, rows.counts.sum())
    sc = spark.sparkContext
    # By hash and in order, so that blocks, and with them the order of all sums, depend on the rows alone.
    like.repartition(n, "key").sortWithinPartitions("key").mapInPandas(_pack, "key binary, rows binary, total bigint").write.parquet(path + "/blocks")
    packed = spark.read.parquet(path + "/blocks")
    total = packed.agg(F.sum("total")).first()[0]
    blocks = packed.select("key", "rows").rdd.map(lambda r: (bytes(r[0]), bytes(r[1]))).persist(StorageLevel.MEMORY_AND_DISK)

    def gradient(w: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(w)
        parts = blocks.map(partial(_gradient, shared)).collect()
        shared.destroy()
        return sum(g for _, g in sorted(parts, key=lambda p: p[0]))

    try:
        return descend(gradient, total)
    finally:
        blocks.unpersist()


def _fit_points(points: pd.DataFrame) -> pd.DataFrame:
    """The fit of one language and kind. A task holds each length and size once, however many pages have them."""
    points = points.sort_values(["n", "z"])
    f = fitted(*(points[c].to_numpy("int64") for c in ("n", "z", "times")))
    return pd.DataFrame([(points["language"].iloc[0], int(points["kind"].iloc[0]), *f[0], *f[1:])] if f else [], columns=["language", "kind", "a", "b", "c", "least", "most"])


def _honest(pooled: tuple):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yard = Yardstick({"": pooled})
        for b in batches:
            lists = ([x.tolist() for x in b[c]] for c in ("common", "whole", "lengths", "sizes", "words", "ended"))
            yield b[[not yard.stuffed(Measured(c, ((w[0], w[1]), (w[2], w[3])), list(zip(*s)))) for c, w, *s in zip(*lists)]]

    return run


def _fits(pages: DataFrame, language: Column) -> dict[tuple[str, int], Fit]:
    """The fits of measured pages by language and kind."""
    ended = F.filter(F.arrays_zip("lengths", "sizes", "ended"), lambda s: s.ended & (s.lengths >= LEAST_CHARS))

    def point(kind: int, n: Column, z: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), n.alias("n"), z.alias("z"))

    whole = F.array(*(point(k, F.col("whole")[2 * k], F.col("whole")[2 * k + 1]) for k in (MARKUP, SHAPE)))
    points = pages.select(language.alias("language"), F.inline(F.concat(whole, F.transform(ended, lambda s: point(SENTENCE, s.lengths, s.sizes)))))
    points = points.groupBy("language", "kind", "n", "z").agg(F.count("*").alias("times"))
    fits = points.groupBy("language", "kind").applyInPandas(_fit_points, "language string, kind int, a double, b double, c double, least double, most double")
    return {(r.language, r.kind): ((r.a, r.b, r.c), r.least, r.most) for r in fits.collect()}


def _yardstick(pages: DataFrame, path: str) -> Yardstick:
    """What ``prose.fit_yardstick`` gives, from measured pages."""
    kinds = (MARKUP, SHAPE, SENTENCE)
    fits = _fits(pages, F.lit(""))
    pooled = tuple(fits.get(("", k)) or EXPECTED[k] for k in kinds)
    pages.mapInPandas(_honest(pooled), MEASURED).write.parquet(path + "/honest")
    honest = pages.sparkSession.read.schema(MEASURED).parquet(path + "/honest")
    often = honest.select(F.explode(F.slice("common", 1, 3)).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(MARKERS).collect()
    markers = [r.w for r in often]
    honest = honest.withColumn("own", F.get(F.filter("common", lambda w: w.isin(markers)), F.lit(0)))
    own = [r.own for r in honest.where("own is not null").groupBy("own").count().where(F.col("count") >= LEAST_PAGES).collect()]
    fits = _fits(honest.where(F.col("own").isin(own)), F.col("own"))
    return Yardstick({"": pooled} | {g: tuple(fits.get((g, k)) or pooled[k] for k in kinds) for g in sorted(own)}, markers)


def _one_each(labelled: DataFrame) -> DataFrame:
    """One row a doc_id, that of the greatest url. The partitions are asked for, as few bytes of pages are much work."""
    spark = labelled.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return labelled.repartition(n, "doc_id").groupBy("doc_id").agg(F.max(F.struct("url", "html")).alias("p")).select("doc_id", "p.url", "p.html")


def fit(pages: DataFrame, most: int | None = None) -> Model:
    """The model of all labelled pages, one a doc_id; of ``most`` of them, chosen by a hash of doc_id, only if that is given. Without any it raises NoLabels."""
    labelled = pages.where(F.col("html").rlike("(?i)<main[\\s>]")).select("doc_id", "url", "html")
    if most is not None:
        labelled = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "url").limit(most)
    path = scratch_path(pages.sparkSession, "training")
    try:
        return _fit(labelled, path)
    finally:
        drop_path(pages.sparkSession, path)


def _fit(labelled: DataFrame, path: str) -> Model:
    spark: SparkSession = labelled.sparkSession
    _one_each(labelled).mapInPandas(_read, READ).write.parquet(path + "/read")
    read = spark.read.schema(READ).parquet(path + "/read")
    if read.isEmpty():
        raise NoLabels("no page has its main part named: train on other pages, and hand the model over")

    def on_sites(texts: DataFrame) -> DataFrame:
        return texts.select("t", "site").distinct().groupBy("t").count().where(F.col("count") >= SITES).select("t")

    standing = frozenset(r.t for r in on_sites(read.select("site", F.explode("phrases").alias("t"))).collect())
    inside = read.select("doc_id", "site", F.explode(F.arrays_zip("texts", "sentences")).alias("o")).select("doc_id", "site", F.col("o.texts").alias("t"), F.col("o.sentences").alias("sentence"))
    inside = inside.join(on_sites(inside).withColumn("stands", F.lit(True)), "t", "left")
    beside = inside.withColumn("rare", F.sum(F.when(F.col("stands").isNull(), F.col("sentence")).otherwise(0)).over(Window.partitionBy("doc_id")))
    inviting = frozenset(r.t for r in beside.where("stands").groupBy("t").agg(F.sum("rare").alias("rare"), F.count("*").alias("times")).where(F.col("rare") >= BESIDE * F.col("times")).collect())
    sc = spark.sparkContext
    read.select("page").mapInPandas(_learn(sc.broadcast(inviting), sc.broadcast(standing)), LEARNT).write.parquet(path + "/learnt")
    learnt = spark.read.schema(LEARNT).parquet(path + "/learnt")
    like = learnt.where("key is not null").groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    ties = Counter({(r.block, r.above, r.own): r.n for r in learnt.where("block is not null").groupBy("block", "above", "own").agg(F.sum("zeros").alias("n")).collect()})
    yard = _yardstick(learnt.where("common is not null").select(*(c.split()[0] for c in MEASURED.split(", "))), path)
    return Model(_weights(like, path), standing, tie(ties, True), tie(ties, False), yard)
