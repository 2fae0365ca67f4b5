"""The search engine as one object: built from pages, asked with queries, kept up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.html import extract_fields, page_size
from weft.functions.links import page_links
from weft.operators.graph import first_parents, nodes, pagerank
from weft.operators.index import anchor_hits, document_postings, magnitudes, own_title_postings, term_weights, title_postings
from weft.operators.reindex import purge
from weft.operators.search import search, snippet, split_query, word_list
from weft.session import staged

POSTING = ["field", "term", "doc_id", "freq", "tf", "positions"]
#: Children, parents and keywords that a result shows.
SHOWN = 5


class Engine:
    """An index: weighted postings, magnitudes, links, anchor hits and the fields of the pages."""

    def __init__(self, postings: DataFrame, lengths: DataFrame, fields: DataFrame | None = None, links: DataFrame | None = None, ranks: DataFrame | None = None, stops: Sequence[str] | None = None, stemming: bool = True, anchors: DataFrame | None = None):
        self.postings, self.magnitudes, self.fields, self.links, self.ranks, self.stops, self.stemming, self.anchors = postings, lengths, fields, links, ranks, stops, stemming, anchors

    def best(self, query: str, k: int = 50, topic_probs: dict[str, float] | None = None, require_phrase: bool = False) -> DataFrame:
        """The best pages with their scores alone."""
        return search(self.postings, self.magnitudes, query, k, self.stops, self.stemming, require_phrase, self.ranks, topic_probs)

    def search(self, query: str, k: int = 50, topic_probs: dict[str, float] | None = None, require_phrase: bool = False) -> DataFrame:
        """The best pages as full results: scores, url, page_title, mod_date, page_size, first children and parents as URLs, keywords (most frequent first, with counts), summary.

        '-' in a query counts as a blank, as in all signs. Only the winners are looked up."""
        best = self.best(query, k, topic_probs, require_phrase)
        if self.fields is None:
            return best
        best = staged(best, "best")
        ids = best.select("doc_id")
        words, phrases = split_query(query)
        text = F.filter(F.split(F.trim("snippet_text"), r"\s+"), lambda w: w != "")
        pages = self.fields.join(ids, "doc_id", "left_semi").select("doc_id", "url", F.col("title").alias("page_title"), "mod_date", "page_size", snippet(text, words, phrases).alias("summary"))
        rows = best.join(pages, "doc_id", "left").join(self._keywords(ids), "doc_id", "left")
        if self.links is not None:
            # Pages that are only linked to have no fields; their URL is that of the links.
            linked = self.links.join(ids.select(F.col("doc_id").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("doc_id")).agg(F.min("dst_url").alias("_url"))
            rows = rows.join(linked, "doc_id", "left").withColumn("url", F.coalesce("url", "_url")).drop("_url")
            rows = rows.join(self._children(ids), "doc_id", "left").join(self._parents(ids), "doc_id", "left")
        return rows.orderBy(F.desc(F.round("final_rank", 9)), "doc_id")

    def _keywords(self, ids: DataFrame) -> DataFrame:
        own = self.postings.where("field = 'body'").join(ids, "doc_id", "left_semi").select("doc_id", "term", "freq")
        order = Window.partitionBy("doc_id").orderBy(F.desc("freq"), "term")
        top = own.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SHOWN)
        entries = F.array_sort(F.collect_list(F.struct("_n", F.col("term").alias("word"), F.col("freq").alias("n"))))
        return top.groupBy("doc_id").agg(F.transform(entries, lambda x: F.struct(x["word"].alias("word"), x["n"].alias("n"))).alias("keywords"))

    def _children(self, ids: DataFrame) -> DataFrame:
        own = self.links.join(ids.select(F.col("doc_id").alias("src")), "src", "left_semi").groupBy("src", "dst").agg(F.min(F.struct("ord", "dst_url")).alias("x"))
        order = Window.partitionBy("src").orderBy("x.ord", "dst")
        top = own.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SHOWN)
        return top.groupBy(F.col("src").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "x.dst_url"))), lambda x: x["dst_url"]).alias("children"))

    def _parents(self, ids: DataFrame) -> DataFrame:
        top = first_parents(self.links.join(ids.select(F.col("doc_id").alias("dst")), "dst", "left_semi"), SHOWN)
        named = self.fields.select(F.col("doc_id").alias("src"), "url").join(top, "src")
        return named.groupBy(F.col("dst").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "url"))), lambda x: x["url"]).alias("parents"))

    def word_list(self, prefix: str) -> DataFrame:
        return word_list(self.postings, prefix)


def page_fields(pages: DataFrame) -> DataFrame:
    """The fields of ``pages`` with mod_date and page_size, as far as the pages have last_modified and content_length."""
    if "content_length" not in pages.columns:
        pages = pages.withColumn("content_length", F.lit(None).cast("bigint"))
    if "last_modified" not in pages.columns:
        pages = pages.withColumn("last_modified", F.lit(None).cast("timestamp"))
    return extract_fields(page_size(pages).withColumnRenamed("last_modified", "mod_date"), "mod_date", "page_size")


def _weighted(counted: DataFrame, links: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    # Written before they are weighted: frequencies and weights both read them, and making them twice would cost more.
    weighted = staged(term_weights(staged(counted, "counted"), nodes(links, fields).count()), "postings")
    return weighted, staged(magnitudes(weighted), "magnitudes")


def update_index(engine: Engine, pages: DataFrame) -> Engine:
    """The index after ``pages`` (doc_id, url, html; one row per page) came in, new or changed.

    Pages whose content is the same as before should be left out by the caller (see operators.reindex). Body postings of the pages are purged and made anew. Title
    postings are made anew for the pages and for those they point to or pointed to before, since anchor texts count there; all others stay. Weights are computed for
    all, since the number of nodes and so every inverse frequency may have changed.
    """
    new = staged(page_fields(pages), "fields")
    gone = new.select("doc_id")
    fields = staged(engine.fields.join(gone, "doc_id", "left_anti").unionByName(new), "fields")
    of = gone.select(F.col("doc_id").alias("src"))
    links = staged(engine.links.join(of, "src", "left_anti").unionByName(page_links(new)), "links")
    fresh = staged(anchor_hits(new, engine.stops, engine.stemming), "anchors")
    anchors = staged(engine.anchors.join(of, "src", "left_anti").unionByName(fresh), "anchors")
    before = engine.anchors.join(of, "src", "left_semi").select(F.col("dst").alias("doc_id"))
    touched = staged(gone.union(before).union(fresh.select("dst")).distinct(), "touched")
    title = title_postings(own_title_postings(fields.join(touched, "doc_id", "left_semi"), engine.stops, engine.stemming), anchors.join(touched.select(F.col("doc_id").alias("dst")), "dst", "left_semi"))
    body = document_postings(new, "body", "body", engine.stops, engine.stemming)
    old = engine.postings.select(POSTING)
    kept = purge(old.where("field = 'body'"), gone).unionByName(purge(old.where("field = 'title'"), touched))
    weighted, lengths = _weighted(kept.unionByName(body).unionByName(title), links, fields)
    return Engine(weighted, lengths, fields, links, engine.ranks, engine.stops, engine.stemming, anchors)


def index_fields(fields: DataFrame, links: DataFrame | None = None, topic_sizes: dict[str, float] | None = None, stops: Sequence[str] | None = None, stemming: bool = True, with_ranks: bool = False) -> Engine:
    """An index of extracted fields (from page_fields or streaming.latest_fields; one row per page). ``links`` default to those on the pages.

    Fields are written once to the shared folder; every later step is a plan over them.
    """
    fields = staged(fields, "fields")
    links = staged(page_links(fields), "links") if links is None else links
    anchors = staged(anchor_hits(fields, stops, stemming), "anchors")
    body = document_postings(fields, "body", "body", stops, stemming)
    title = title_postings(own_title_postings(fields, stops, stemming), anchors)
    weighted, lengths = _weighted(body.unionByName(title), links, fields)
    ranks = pagerank(nodes(links, fields), links, topic_sizes=topic_sizes) if with_ranks else None
    return Engine(weighted, lengths, fields, links, ranks, stops, stemming, anchors)


def build_index(pages: DataFrame, links: DataFrame | None = None, topic_sizes: dict[str, float] | None = None, stops: Sequence[str] | None = None, stemming: bool = True, with_ranks: bool = False) -> Engine:
    """An index of ``pages`` (doc_id, url, html, and if at hand last_modified and content_length; one row per page), stemmed unless ``stemming`` is off."""
    return index_fields(page_fields(pages), links, topic_sizes, stops, stemming, with_ranks)
