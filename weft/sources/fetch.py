"""Pages from the network, and a crawl that goes level by level."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.html import extract_fields
from weft.functions.links import host_of, page_links
from weft.operators.topics import directory_step, topic_name
from weft.session import staged
from weft.sources.codec import parse_rfc1123

FETCHED = "url string, html string, modified string, content_length bigint, status int"


def _get(url: str, timeout: float) -> tuple:
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers={"User-Agent": "weft"}), timeout=timeout) as r:  # noqa: S310
            body = r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
            length = r.headers.get("Content-Length")
            return url, body, r.headers.get("Last-Modified"), int(length) if length and length.isdigit() else None, r.status
    except Exception as e:  # whatever a server does, the page is one that could not be fetched
        return url, None, None, None, int(getattr(e, "code", 0) or 0)


def fetch(urls: DataFrame, timeout: float = 15.0, threads: int = 16) -> DataFrame:
    """Pages (doc_id, url, html, last_modified, content_length, status) of ``urls`` (url).

    Each task fetches with ``threads`` threads. A page that can't be fetched has null html and its status, 0 without one. Without a Last-Modified header the
    time of the fetch counts; one that can't be read gives null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                yield pd.DataFrame(list(pool.map(lambda u: _get(u, timeout), b["url"].tolist())), columns=["url", "html", "modified", "content_length", "status"])

    rows = urls.select("url").where("url is not null").distinct().mapInPandas(run, FETCHED)
    when = F.when(F.col("modified").isNull(), F.current_timestamp()).otherwise(parse_rfc1123(F.col("modified")))
    return rows.select(F.md5("url").alias("doc_id"), "url", "html", when.alias("last_modified"), "content_length", "status")


def crawl(seeds: DataFrame, budget: int = 500, domain: str | None = None, fetcher: Callable[[DataFrame], DataFrame] = fetch, max_depth: int | None = None) -> DataFrame:
    """The pages reached from ``seeds`` (url) with the level at which they were found (depth), each URL once.

    A level is fetched as a whole, then its links make the next, until one is empty or ``max_depth`` is reached. At most ``budget`` pages are fetched with success, nearest first and in order of URL within
    a level; pages that fail don't count. With ``domain`` only hosts that end in it are entered. Only counts reach the driver.
    """
    front = seeds.select("url").where("url is not null").distinct()
    pages, done, seen = None, 0, None
    for depth in itertools.count() if max_depth is None else range(max_depth + 1):
        if domain is not None:
            front = front.where(host_of(F.col("url")).endswith(domain))
        if seen is not None:
            front = front.join(seen, "url", "left_anti")
        # If pages fail, the rest of the level takes their place.
        while True:
            part = staged(front.orderBy("url").limit(budget - done), "front")
            if part.isEmpty():
                break
            got = staged(fetcher(part).withColumn("depth", F.lit(depth)), "fetched")
            done += got.where("html is not null").count()
            pages = got if pages is None else pages.unionByName(got)
            seen = part if seen is None else seen.unionByName(part)
            front = front.join(part, "url", "left_anti")
            if done >= budget:
                return pages
        if pages is None:
            break
        level = pages.where(F.col("depth") == depth)
        if level.isEmpty():
            break
        front = page_links(extract_fields(level.where("html is not null"))).select(F.col("dst_url").alias("url")).distinct()
    return pages if pages is not None else fetcher(front.limit(0)).withColumn("depth", F.lit(0))


def crawl_directory(topics: DataFrame, fetcher: Callable[[DataFrame], DataFrame] = fetch, max_depth: int | None = None) -> DataFrame:
    """The pages of a topic directory: (topic, doc_id, url, html, listed) from the topics' start pages ``topics`` (url).

    Pages of the directory are followed within the host and below the path of their topic, level by level, each once a topic; links from them to other hosts are the
    topic's listed pages, which are fetched but not followed. Every fetched page counts for its topic, directory pages too (see operators.topics.topic_pages, which takes the
    rows as they are); terms come from the listed ones alone. Only whether a level is empty reaches the driver.
    """
    front = topics.select(F.col("url").alias("topic_url"), "url").where("url is not null").distinct()
    seen = pages = listed = None
    for _ in itertools.count() if max_depth is None else range(max_depth + 1):
        front = staged(front if seen is None else front.join(seen, ["topic_url", "url"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = front if seen is None else seen.unionByName(front)
        got = staged(front.join(fetcher(front.select("url").distinct()), "url").select("topic_url", "doc_id", "url", "html"), "directory")
        pages = got if pages is None else pages.unionByName(got)
        fields = extract_fields(got.where("html is not null"), "topic_url").withColumn("doc_id", F.struct("doc_id", "topic_url"))
        steps = page_links(fields).select(F.col("src.topic_url").alias("topic_url"), F.col("dst_url").alias("url"))
        steps = staged(steps.withColumn("step", directory_step(F.col("topic_url"), F.col("url"))).where("step is not null").distinct(), "steps")
        found = steps.where("step = 'listed'").select("topic_url", "url")
        listed = found if listed is None else listed.unionByName(found)
        front = steps.where("step = 'category'").select("topic_url", "url")
    if pages is None:
        return fetcher(topics.select("url").limit(0)).select(F.lit("").alias("topic"), "doc_id", "url", "html", F.lit(False).alias("listed"))
    asked = staged(listed.distinct(), "listed")
    out = asked.join(fetcher(asked.select("url").distinct()), "url").select("topic_url", "doc_id", "url", "html")
    both = pages.withColumn("listed", F.lit(False)).unionByName(out.withColumn("listed", F.lit(True)))
    return both.select(topic_name(F.col("topic_url")).alias("topic"), "doc_id", "url", "html", "listed")
