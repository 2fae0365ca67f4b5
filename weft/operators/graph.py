"""The web graph: nodes, degrees, parents, PageRank and levels."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.session import staged


def distinct_edges(links: DataFrame) -> DataFrame:
    """(src, dst) once each; nulls on either side are no edge."""
    return links.where("src is not null and dst is not null").select("src", "dst").distinct()


def nodes(links: DataFrame, crawled: DataFrame | None = None) -> DataFrame:
    """(doc_id): all sources and targets, and pages crawled without any link."""
    all_ = links.select(F.col("src").alias("doc_id")).union(links.select("dst"))
    all_ = all_ if crawled is None else all_.union(crawled.select("doc_id"))
    return all_.where("doc_id is not null").distinct()


def out_degrees(links: DataFrame) -> DataFrame:
    return distinct_edges(links).groupBy(F.col("src").alias("doc_id")).agg(F.count(F.lit(1)).alias("out_degree"))


def in_degrees(links: DataFrame) -> DataFrame:
    return distinct_edges(links).groupBy(F.col("dst").alias("doc_id")).agg(F.count(F.lit(1)).alias("in_degree"))


def first_children(links: DataFrame, k: int = 5) -> DataFrame:
    """(src, dst, n): the first ``k`` different targets of each page, in page order."""
    firsts = links.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("ord").alias("ord"))
    order = Window.partitionBy("src").orderBy("ord", "dst")
    return firsts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("src", "dst", "n")


def first_parents(links: DataFrame, k: int = 5) -> DataFrame:
    """(dst, src, n): the ``k`` parents of smallest id of each page.

    Each task keeps its own ``k`` smallest before anything moves, so a page to which a third of all links point is no burden."""
    edges = links.where("src is not null and dst is not null").select("dst", "src").distinct()
    salted = edges.withColumn("_salt", F.pmod(F.xxhash64("src"), F.lit(64)))
    local = Window.partitionBy("dst", "_salt").orderBy("src")
    few = salted.withColumn("_n", F.row_number().over(local)).where(F.col("_n") <= k)
    order = Window.partitionBy("dst").orderBy("src")
    return few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("dst", "src", "n")


def pagerank(node_ids: DataFrame, links: DataFrame, n: float | None = None, d: float = 0.75, max_iter: int = 100, tol: float = 1e-12, topic_sizes: dict[str, float] | None = None, bias: DataFrame | None = None) -> DataFrame:
    """(doc_id, [topic,] rank) by power iteration; stops when the ranks change by no more than ``tol`` in sum, or after ``max_iter`` rounds.

    Each round hands d * rank / out-degree to every target, adds 1 - d to every node and divides by what was passed on, counted once per
    parent, plus (1 - d) times the number of nodes. Nodes without targets keep nothing back. All start from 1 / n, and the first round's sums do, too.
    With ``bias`` (doc_id, with topics also topic) the same sum of teleports goes to these nodes only, in equal shares.
    With ``topic_sizes`` (topic -> n) all topics run together as one more column. Only two numbers per round (and topic) reach the driver.
    The ranks are written to the shared folder each round; the edges stay hashed by source, so a round shuffles ranks and partial sums only.
    """
    spark = node_ids.sparkSession
    ids = staged(node_ids.select("doc_id").distinct(), "nodes")
    count = ids.count()
    key = ["doc_id", "topic"] if topic_sizes else ["doc_id"]
    schema_n = spark.createDataFrame(list(topic_sizes.items()), "topic string, _n double") if topic_sizes else None
    start = ids.select("doc_id", F.explode(F.array(*[F.lit(t) for t in topic_sizes])).alias("topic")).join(F.broadcast(schema_n), "topic").select("doc_id", "topic", (1 / F.col("_n")).alias("rank")) if topic_sizes else ids.withColumn("rank", F.lit(1.0 / float(n or count or 1)))
    if not count:
        return start
    edges = distinct_edges(links)
    degree = edges.groupBy(F.col("src").alias("doc_id")).agg(F.count(F.lit(1)).alias("deg"))
    edges = edges.repartition("src").persist()
    by = key[1:]
    # Every row carries its out-degree, so that one aggregate a round tells both what is passed on next and how much has changed.
    rank = staged(start.join(degree, "doc_id", "left"), "rank")
    share = d * F.col("rank") / F.col("deg")
    sums = lambda df, *more: df.groupBy(*by).agg(F.sum(share).alias("passed"), *more).collect()
    if bias is not None:
        own = bias.join(ids, "doc_id", "left_semi").select(*key).distinct()
        sizes = own.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
        shares_of = own.join(sizes, "topic") if topic_sizes else own.withColumn("_size", F.lit(own.count()))
        bias = staged(shares_of.select(*key, (F.lit((1 - d) * count) / F.col("_size")).alias("_teleport")), "bias")
    try:
        passed = sums(rank)
        for k in range(max_iter):
            totals = {r["topic"] if by else None: (r["passed"] or 0.0) + (1 - d) * count for r in passed}
            total = F.lit(totals[None]) if not by else F.element_at(F.create_map(*[x for t in totals for x in (F.lit(t), F.lit(totals[t]))]), F.col("topic"))
            inflow = edges.join(rank.withColumnRenamed("doc_id", "src"), "src").groupBy(F.col("dst").alias("doc_id"), *by).agg(F.sum(share).alias("_in"))
            base = F.col("rank") if k == 0 else F.lit(0.0)
            both = rank.join(inflow, key, "left")
            both = both.withColumn("_teleport", F.lit(1 - d)) if bias is None else both.join(bias, key, "left")
            new = both.select(*key, "deg", ((base + F.coalesce("_in", F.lit(0.0)) + F.coalesce("_teleport", F.lit(0.0))) / total).alias("rank"), F.col("rank").alias("_old"))
            new = staged(new, "rank")
            passed = sums(new, F.sum(F.abs(F.col("rank") - F.col("_old"))).alias("delta"))
            rank = new.drop("_old")
            if sum(r["delta"] or 0.0 for r in passed) <= tol:
                break
    finally:
        edges.unpersist()
    return rank.drop("deg")


def levels(links: DataFrame, seeds: DataFrame, max_depth: int | None = None, budget: int | None = None, domain: str | None = None, urls: DataFrame | None = None) -> DataFrame:
    """(doc_id, depth): pages reached from ``seeds`` (doc_id), level by level, none twice, until a level is empty or ``max_depth`` is reached.

    With ``budget`` the crawl stops at that many pages, nearest first, then by id. With ``domain`` and ``urls`` (doc_id, host) only
    hosts that end in it are entered. Each level is written once; only counts reach the driver.
    """
    edges = distinct_edges(links).persist()
    seen = staged(seeds.select("doc_id").distinct().withColumn("depth", F.lit(0)), "level")
    front, total = seen, seen.count()
    allowed = None if domain is None or urls is None else urls.where(F.col("host").endswith(domain)).select("doc_id").distinct()
    try:
        for depth in itertools.count(1):
            if (budget is not None and total >= budget) or (max_depth is not None and depth > max_depth):
                break
            found = edges.join(front.select(F.col("doc_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("doc_id")).distinct()
            found = found.join(seen, "doc_id", "left_anti")
            found = found if allowed is None else found.join(allowed, "doc_id", "left_semi")
            if budget is not None:
                found = found.orderBy("doc_id").limit(budget - total)
            front = staged(found.withColumn("depth", F.lit(depth)), "level")
            n = front.count()
            if not n:
                break
            total += n
            # Now and then the levels become one table again, or a deep graph's plan would grow with its depth.
            seen = seen.unionByName(front) if depth % 16 else staged(seen.unionByName(front), "seen")
    finally:
        edges.unpersist()
    return seen


def parents_map(anchors: DataFrame, links: DataFrame) -> DataFrame:
    """(dst, src, tokens): for every edge the anchor tokens in it, an empty array if there are none."""
    texts = anchors.groupBy("dst", "src").agg(F.sort_array(F.collect_list("term")).alias("tokens"))
    return distinct_edges(links).join(texts, ["src", "dst"], "left").select("dst", "src", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def topic_column(ranks: DataFrame, topics: Sequence[str]) -> DataFrame:
    """(doc_id, ranks map<topic, rank>)."""
    return ranks.where(F.col("topic").isin(list(topics))).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("topic", "rank"))).alias("ranks"))
