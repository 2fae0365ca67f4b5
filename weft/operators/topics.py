"""Topic statistics and the topics of a query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.index import title_hits


def topic_name(url: Column) -> Column:
    """The topic that a directory page's URL names: its path without slashes, '' if there is none."""
    return F.replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("/"), F.lit(""))


def directory_step(topic_url: Column, url: Column) -> Column:
    """What a link found on a topic's directory page leads to: 'category' on the directory's host and below the topic's path, 'listed' on another host, else null."""
    host = lambda u: F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = lambda u: F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(host(url) == "", F.lit(None)).when(host(url) != host(topic_url), "listed").when(F.startswith(path(url), path(topic_url)), "category")


def topic_term_freq(hits: DataFrame) -> DataFrame:
    """(topic, term, freq) of hits (topic, term); rows without a topic don't count."""
    return hits.where("topic is not null and term is not null").groupBy("topic", "term").agg(F.count(F.lit(1)).alias("freq"))


def directory_hits(fields: DataFrame, topics: DataFrame, stops: Sequence[str] | None = None, stemming: bool = False) -> DataFrame:
    """(topic, doc_id, term): title and meta hits of extracted pages by the topics (doc_id, topic) they are listed under, as often as they occur."""
    return title_hits(fields, stops, stemming).select("doc_id", "term").join(topics.where("topic is not null").select("doc_id", "topic").distinct(), "doc_id")


def topic_pages(pages: DataFrame) -> DataFrame:
    """(topic, num_pages): the different pages (topic, doc_id) of each topic."""
    return pages.where("topic is not null").groupBy("topic").agg(F.countDistinct("doc_id").alias("num_pages"))


def topic_metadata(freqs: DataFrame, pages: DataFrame) -> DataFrame:
    """(topic, num_pages, word_count): pages (topic, doc_id) and different words of each topic."""
    words = freqs.groupBy("topic").agg(F.count(F.lit(1)).alias("word_count"))
    return topic_pages(pages).join(words, "topic", "full_outer").na.fill(0, ["num_pages", "word_count"])


def term_topics(freqs: DataFrame) -> DataFrame:
    """(term, topics map<topic, freq>); a term has at most one entry per topic."""
    return freqs.groupBy("term").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", "freq")))).alias("topics"))


def topic_posterior(freqs: DataFrame, meta: DataFrame, terms: DataFrame, n_topics: int) -> DataFrame:
    """(topic, prob): one over the number of topics, times freq / word_count for each query term that the topic has; 0 where none matches."""
    hits = freqs.join(F.broadcast(terms.select("term")), "term").join(meta.select("topic", "word_count"), "topic")
    share = F.col("freq").cast("double") / F.col("word_count")
    probs = hits.groupBy("topic").agg((F.lit(1.0 / max(1, n_topics)) * F.product(share)).alias("prob"))
    return meta.select("topic").join(probs, "topic", "left").na.fill(0.0, ["prob"])
