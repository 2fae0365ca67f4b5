"""Queries of the search engine's operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import arrays
from weft.functions.html import page_size
from weft.functions.links import accepted, host_of, page_links
from weft.functions.text import laundry, phrases_of, split_words, stemmed, stop_words, without_phrases
from weft.operators import graph, index, reindex, search, topics
from weft.plans.engine import Engine, build_index, index_fields, update_index
from weft.plans.stem_sql import stem_steps
from weft.session import read, scratch_path, spread, staged
from weft.sources import codec, sinks
from weft.sources.store import KEYS, SCHEMAS, KeyedTable
from weft.streaming.reindex import latest, latest_fields, stream_pages

STOPS = stop_words()
KEYWORDS = "harbor mill tide harbor reservoir"
PHRASE = '"opened for the captain"'
MIXED = 'harbor "opened for the captain" mill'
TWO_PHRASES = '"opened for" tide "the captain"'
PAGE_QUERY = 'ladder "moved to the home page" tide'
PREFIX = "re"


def _six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _docs_freqs(spark: SparkSession, d: str) -> DataFrame:
    return index.document_postings(spread(read(spark, d, "documents")), "text")


def _kept(make: Callable) -> Callable:
    """What ``make`` has written for a folder of tables is used again by later queries of the same application."""
    made: dict = {}

    def get(spark: SparkSession, d: str):
        key = spark.sparkContext.applicationId, d
        if key not in made:
            made[key] = make(spark, d)
        return made[key]

    return get


@_kept
def _docs_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The stored index of the documents."""
    counted = staged(_docs_freqs(spark, d), "counted")
    return staged(index.term_weights(counted, read(spark, d, "documents").count()), "weighted")


@_kept
def _docs_lengths(spark: SparkSession, d: str) -> DataFrame:
    return staged(index.magnitudes(_docs_weighted(spark, d)), "magnitudes")


@_kept
def _fields(spark: SparkSession, d: str) -> DataFrame:
    return staged(latest_fields(spread(read(spark, d, "pages"))), "fields")


@_kept
def _engine(spark: SparkSession, d: str) -> Engine:
    """The stored index of the pages, unstemmed, as its SQL is."""
    return index_fields(_fields(spark, d), stemming=False)


@_kept
def _stemmed_engine(spark: SparkSession, d: str) -> Engine:
    return index_fields(_fields(spark, d))


def tokenize_documents(spark, d):
    return index.token_positions(read(spark, d, "documents"), split_words(F.col("text")), "doc_id")


def stopword_filter(spark, d):
    return index.token_positions(read(spark, d, "documents"), laundry(F.col("text")), "doc_id")


def term_freq_documents(spark, d):
    return _docs_freqs(spark, d).select("doc_id", "term", "freq")


def term_positions(spark, d):
    return _docs_freqs(spark, d).select("doc_id", "term", F.array_join(F.transform("positions", lambda p: p.cast("int").cast("string")), " ").alias("positions"))


def doc_max_freq(spark, d):
    return index.max_frequencies(_docs_freqs(spark, d)).select("doc_id", "max_freq")


def doc_freq(spark, d):
    return index.document_frequencies(_docs_freqs(spark, d)).select("term", "df")


def idf(spark, d):
    out = index.inverse_frequencies(index.document_frequencies(_docs_freqs(spark, d)), read(spark, d, "documents").count())
    return out.select("term", "df", F.round(F.col("idf").cast("double"), 5).alias("idf"))


def tfidf_weights(spark, d):
    return _docs_weighted(spark, d).select("doc_id", "term", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("tf", "weight")])


def doc_magnitude(spark, d):
    return _docs_lengths(spark, d).select("doc_id", F.round("body", 4).alias("body"))


def _search_docs(spark, d, query, **kw):
    return search.search(_docs_weighted(spark, d), _docs_lengths(spark, d), query, **kw).select("doc_id", *[F.round(c, 4).alias(c) for c in ("body_rank", "final_rank")])


def keyword_search_top50(spark, d):
    return _search_docs(spark, d, KEYWORDS)


def phrase_match(spark, d):
    tokens = search.parse_query(spark, PHRASE)
    n = tokens.where("kind = 'phrase'").count()
    return search.phrase_hits(_docs_weighted(spark, d), tokens.where("kind = 'phrase'"), n).select("doc_id", F.round("w", 4).alias("w"))


def phrase_and_keyword_search(spark, d):
    return _search_docs(spark, d, MIXED, k=1_000_000)


def multi_phrase_concat(spark, d):
    return _search_docs(spark, d, TWO_PHRASES, k=1_000_000)


def require_phrase_search(spark, d):
    return _search_docs(spark, d, MIXED, k=1_000_000, require_phrase=True)


def query_parse(spark, d):
    """The phrases and words of every query that was asked."""
    q = read(spark, d, "results").select("query_text").where("query_text is not null").distinct()
    return q.select("query_text", F.array_join(laundry(without_phrases(F.col("query_text"))), " ").alias("words"), F.array_join(laundry(F.array_join(phrases_of(F.col("query_text")), " ")), " ").alias("phrase"))


def stored_weights(spark, d):
    """Weights of the stored postings, computed anew: the stored ones may be old."""
    p = index.clean_postings(read(spark, d, "postings"))
    n = graph.nodes(read(spark, d, "links"), read(spark, d, "pages")).count()
    return index.term_weights(p, n).select("field", "term", "doc_id", F.round(F.col("weight").cast("double"), 5).alias("weight"))


def stored_magnitudes(spark, d):
    p = index.clean_postings(read(spark, d, "postings"))
    n = graph.nodes(read(spark, d, "links"), read(spark, d, "pages")).count()
    return index.magnitudes(index.term_weights(p, n)).select("doc_id", F.round("title", 4).alias("title"), F.round("body", 4).alias("body"))


def term_hashes(spark, d):
    return read(spark, d, "terms").select("term", F.md5("term").alias("computed"), (F.md5("term") == F.col("term_hash")).alias("same"))


def page_titles(spark, d):
    return _fields(spark, d).select("doc_id", "title")


def page_links_query(spark, d):
    return page_links(_fields(spark, d)).select("src", "ord", "dst_url", "dst")


def link_filter(spark, d):
    rows = _fields(spark, d).select("doc_id", F.posexplode("hrefs").alias("ord", "href"))
    return rows.withColumn("accepted", accepted(F.col("href")))


def web_nodes(spark, d):
    return graph.nodes(read(spark, d, "links"), read(spark, d, "pages"))


def out_degree(spark, d):
    return graph.out_degrees(read(spark, d, "links"))


def in_degree(spark, d):
    return graph.in_degrees(read(spark, d, "links"))


def children_top5(spark, d):
    return graph.first_children(read(spark, d, "links"))


def parents_of(spark, d):
    return graph.first_parents(read(spark, d, "links"))


def page_body_terms(spark, d):
    return index.document_postings(_fields(spark, d), "body").select("doc_id", "term", "freq")


def page_title_terms(spark, d):
    return index.own_title_postings(_fields(spark, d)).select("doc_id", "term", "freq")


def anchor_terms(spark, d):
    return index.anchor_hits(_fields(spark, d)).groupBy("dst", "term").agg(F.count(F.lit(1)).alias("freq"))


def page_title_postings(spark, d):
    f = _fields(spark, d)
    p = index.title_postings(index.own_title_postings(f), index.anchor_hits(f))
    return p.select("term", "doc_id", F.round(F.col("tf").cast("double"), 5).alias("tf"), F.col("freq").alias("hits"))


def parents_anchor_map(spark, d):
    f = _fields(spark, d)
    return graph.parents_map(index.anchor_hits(f), page_links(f)).select("dst", "src", F.array_join("tokens", " ").alias("tokens"))


def page_search(spark, d):
    """The flagship: a query of words and a phrase, asked of the stored index of pages with titles, anchor texts and bodies."""
    return _engine(spark, d).best(PAGE_QUERY).select("doc_id", *[F.round(c, 4).alias(c) for c in ("title_rank", "body_rank", "final_rank")])


def page_index(spark, d):
    """The index itself, built anew: weighted postings of titles and bodies."""
    built = index_fields(latest_fields(spread(read(spark, d, "pages"))), stemming=False)
    return built.postings.select("field", "term", "doc_id", "freq", F.round(F.col("weight").cast("double"), 5).alias("weight"))


def index_update(spark, d):
    """The same index, made of a half of the pages first and brought up to date with the others, of which some were there in an older form."""
    pages = latest(read(spark, d, "pages"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    first = pages.where(half < 3).withColumn("html", F.when(half == 2, F.concat(F.lit("<title>old</title><a href='http://old.example/x'>old</a> old ladder "), F.coalesce("html", F.lit("")))).otherwise(F.col("html")))
    built = update_index(build_index(spread(first), stemming=False), spread(pages.where(half >= 2)))
    return built.postings.select("field", "term", "doc_id", "freq", F.round(F.col("weight").cast("double"), 5).alias("weight"))


def page_search_snippets(spark, d):
    """The same with title, URL and snippet of each page."""
    return _engine(spark, d).search(PAGE_QUERY).select("doc_id", "url", "page_title", "summary")


def page_search_cards(spark, d):
    """The full results of the query: details, first children and parents, keywords in order."""
    r = _engine(spark, d).search(PAGE_QUERY)
    keywords = F.array_join(F.transform("keywords", lambda x: F.concat(x["word"], F.lit(":"), x["n"].cast("string"))), " ")
    return r.select("doc_id", F.round("final_rank", 4).alias("final_rank"), "url", "page_title", "mod_date", "page_size", keywords.alias("keywords"), F.array_join("children", " ").alias("children"), F.array_join("parents", " ").alias("parents"))


def page_search_stemmed(spark, d):
    """The query asked of the stemmed index, which is the engine's default."""
    return _stemmed_engine(spark, d).best("ladders moving").select("doc_id", F.round("final_rank", 4).alias("final_rank"))


def _edges_of_orders(spark, d):
    return read(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))


def _pagerank(k):
    def run(spark, d):
        links = read(spark, d, "links")
        return graph.pagerank(graph.nodes(links, read(spark, d, "pages")), links, max_iter=k, tol=0.0).select("doc_id", F.round("rank", 9).alias("rank"))

    return run


def pagerank_synthetic_edges(spark, d):
    e = _edges_of_orders(spark, d)
    return graph.pagerank(graph.nodes(e), e, max_iter=3, tol=0.0).select("doc_id", F.round("rank", 9).alias("rank"))


def pagerank_topics_all(spark, d):
    """Every topic of page_rank, with its number of pages, until the ranks don't change any more."""
    links = read(spark, d, "links")
    sizes = {r["topic"]: float(r["num_pages"]) for r in topics.topic_pages(read(spark, d, "page_rank")).where("num_pages > 0").collect()}
    return graph.pagerank(graph.nodes(links), links, max_iter=1000, topic_sizes=sizes).select("doc_id", "topic", F.round("rank", 9).alias("rank"))


def _seed(spark, d):
    """The page with the most different links, of equals the smallest id."""
    return graph.out_degrees(read(spark, d, "links")).agg(F.min_by("doc_id", F.struct(-F.col("out_degree"), "doc_id")).alias("doc_id"))


def bfs_depth_all(spark, d):
    """All pages that can be reached, until a level is empty."""
    return graph.levels(read(spark, d, "links"), _seed(spark, d))


def crawl_budget(spark, d):
    return graph.levels(read(spark, d, "links"), _seed(spark, d), budget=100)


def domain_filter(spark, d):
    return latest(read(spark, d, "pages"), "url").select("doc_id", host_of(F.col("url")).alias("host")).where(F.col("host").endswith(".example"))


def word_list_prefix(spark, d):
    return search.word_list(read(spark, d, "postings"), PREFIX)


def word_list_page(spark, d):
    return search.page_of(search.word_list(read(spark, d, "postings"), ""), 2)


def top5_words_per_doc(spark, d):
    docs = search.last_versions(read(spark, d, "docs"))
    named = docs.select("doc_id", F.explode(F.map_entries(search.top_words(F.col("words")))).alias("e")).select("doc_id", F.col("e.key").alias("term_hash"), F.col("e.value").alias("freq"))
    return named.join(read(spark, d, "terms"), "term_hash").select("doc_id", "term", "freq")


def _topic_hits(spark, d):
    """Title hits by topic, as often as they stand there."""
    p = index.clean_postings(read(spark, d, "postings").where("field = 'title'"))
    t = read(spark, d, "page_rank").select("doc_id", "topic").where("topic is not null").distinct()
    return p.select("doc_id", "term", F.explode("positions")).join(t, "doc_id").select("topic", "term")


def _topic_meta(spark, d):
    return topics.topic_metadata(topics.topic_term_freq(_topic_hits(spark, d)), read(spark, d, "page_rank"))


def topic_names(spark, d):
    return read(spark, d, "portals").select("doc_id", topics.topic_name(F.col("url")).alias("name"))


def topic_term_freq(spark, d):
    return topics.topic_term_freq(_topic_hits(spark, d))


def topic_metadata(spark, d):
    return _topic_meta(spark, d)


def term_topics(spark, d):
    t = topics.term_topics(topics.topic_term_freq(_topic_hits(spark, d)))
    return t.select("term", F.array_join(F.transform(F.array_sort(F.map_entries("topics")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), " ").alias("topics"))


def topic_posterior(spark, d):
    freqs, meta = topics.topic_term_freq(_topic_hits(spark, d)), _topic_meta(spark, d)
    terms = spark.createDataFrame([("harbor",), ("tide",)], "term string")
    return topics.topic_posterior(freqs, meta, terms, meta.count()).select("topic", F.round("prob", 9).alias("prob"))


def reindex_purge(spark, d):
    return reindex.purge(index.clean_postings(read(spark, d, "postings")), read(spark, d, "removals")).select("field", "term", "doc_id")


def freshness_filter(spark, d):
    indexed = search.last_versions(read(spark, d, "docs"))
    return reindex.freshness(latest(read(spark, d, "pages"), "last_modified"), indexed).select("doc_id", "action")


def change_detection_md5(spark, d):
    pages = latest(read(spark, d, "pages"), "html")
    newer = pages.withColumn("html", F.when(F.col("html").contains("Privacy menu"), F.col("html")).otherwise(F.replace("html", F.lit("cookies"), F.lit("biscuits"))))
    return reindex.changed(pages, newer)


def docs_last_version(spark, d):
    return search.last_versions(read(spark, d, "docs")).select("doc_id", "seq", "url", "page_size")


def upsert_and_delete(spark, d):
    """The docs log replayed into a keyed table, then the removals taken out of it."""
    t = KeyedTable(spark, scratch_path(spark, "table"), SCHEMAS["docs"], KEYS["docs"])
    docs = search.last_versions(read(spark, d, "docs"))
    t.set(docs.where("mod_date is null").drop("seq", "written_at"))
    t.set(docs.where("mod_date is not null").drop("seq", "written_at"))
    t.delete(read(spark, d, "removals"))
    return t.scan().select("doc_id", "url", "page_size")


def page_sizes(spark, d):
    return page_size(latest(read(spark, d, "pages"))).select("doc_id", "page_size")


def doc_json(spark, d):
    """Dates of records as text and back."""
    docs = search.last_versions(read(spark, d, "docs"))
    back = codec.from_json(codec.to_json(docs))
    return back.join(docs.select("doc_id", codec.rfc1123(F.col("mod_date")).alias("written")), "doc_id").select("doc_id", "written", "url", F.date_format("mod_date", "yyyy-MM-dd HH:mm:ss").alias("read_back"), F.size("parents").alias("n_parents"))


def results_json(spark, d):
    return sinks.as_json(read(spark, d, "results").select("result_id", "query_id", "doc_id", "url"))


def results_json_fields(spark, d):
    """Every field of the results after the way to JSON and back; maps and lists as text, the scores to six places."""
    r = read(spark, d, "results")
    back = sinks.as_json(r).select(F.from_json("value", r.schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"}).alias("r")).select("r.*")
    words = F.array_join(F.array_sort(F.transform(F.map_entries("words_mapping"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ";")
    scores = [F.when(~F.isnan(c), F.round(c, 6)).alias(c) for c in ("page_rank", "title_rank", "body_rank", "final_rank")]
    lists = [F.array_join(c, "|", "~").alias(c) for c in ("children", "parents")]
    return back.select("result_id", "query_id", "query_text", "doc_id", "url", "page_title", F.date_format("mod_date", "yyyy-MM-dd HH:mm:ss").alias("mod_date"), "page_size", *lists, words.alias("words_mapping"), "summary", *scores)


def snippet_highlighted(spark, d):
    """Snippets in which the first occurrence of each query word is marked."""
    words = ["harbor", "tide"]
    return _snippets(spark, d, words).select("doc_id", sinks.highlighted(F.col("summary"), words).alias("summary"))


def portal_links(spark, d):
    """What each link found on the pages is to the directory of one topic: a category of its own, a listed page, or neither."""
    start = read(spark, d, "portals").where("topic = 'science'").agg(F.min("url")).first()[0]
    links = page_links(_fields(spark, d)).select("dst_url").distinct()
    return links.select(F.lit(start).alias("topic_url"), "dst_url", topics.directory_step(F.lit(start), F.col("dst_url")).alias("step"))


def index_dump(spark, d):
    """Every row of two tables of an index."""
    index_ = {n: KeyedTable(spark, scratch_path(spark, n), SCHEMAS[n], KEYS[n]) for n in ("terms", "links")}
    index_["terms"].set(read(spark, d, "terms"))
    index_["links"].set(read(spark, d, "links").where("src is not null and ord is not null").dropDuplicates(["src", "ord"]))
    return sinks.dump({n: t.scan() for n, t in index_.items()}).groupBy("table").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first"))


def document_report(spark, d):
    """The report of every document, whole."""
    return sinks.report(search.last_versions(read(spark, d, "docs"))).select("doc_id", "value")


def doc_json_fields(spark, d):
    """Every field of the records after the way to JSON and back; maps and lists as text."""
    back = codec.from_json(codec.to_json(search.last_versions(read(spark, d, "docs"))))
    nulls = lambda c: F.array_join(c, "|", "~")
    pairs = lambda c, text: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), text(e["value"])))), ";")
    return back.select(
        "doc_id", "url", nulls("title").alias("title"), F.date_format("mod_date", "yyyy-MM-dd HH:mm:ss").alias("mod_date"), "page_size", nulls("children").alias("children"),
        pairs("parents", lambda v: F.array_join(v, ",", "~")).alias("parents"), pairs("words", lambda v: v.cast("string")).alias("words"),
    )


def topic_search(spark, d):
    """Stored postings asked with the topics' probabilities, so that PageRank counts in the score."""
    p = index.clean_postings(read(spark, d, "postings"))
    n = graph.nodes(read(spark, d, "links"), read(spark, d, "pages")).count()
    w = staged(index.term_weights(p, n), "weighted")
    ranks = read(spark, d, "page_rank").where("topic is not null and rank is not null").groupBy("doc_id", "topic").agg(F.max("rank").alias("rank"))
    found = search.search(w, index.magnitudes(w), "harbor tide", k=1_000_000, ranks=ranks, topic_probs={"science": 0.6, "arts": 0.4})
    return found.select("doc_id", *[F.round(c, 4).alias(c) for c in ("page_rank", "title_rank", "body_rank", "final_rank")])


def pagerank_converged(spark, d):
    """Until the ranks change by no more than the tolerance in sum."""
    links = read(spark, d, "links")
    return graph.pagerank(graph.nodes(links, read(spark, d, "pages")), links, max_iter=1000, tol=1e-11).select("doc_id", F.round("rank", 9).alias("rank"))


def domain_crawl(spark, d):
    """The crawl that enters hosts of one domain only."""
    hosts = latest(read(spark, d, "pages"), "url").select("doc_id", host_of(F.col("url")).alias("host"))
    return graph.levels(read(spark, d, "links"), _seed(spark, d), domain=".example", urls=hosts)


def streamed_pages(spark, d):
    """Page files taken in one by one as a stream; each page's latest version is in the table at the end."""
    folder = scratch_path(spark, "arriving")
    spread(read(spark, d, "pages")).repartition(3, "url").write.parquet(folder)
    t = KeyedTable(spark, scratch_path(spark, "table"), SCHEMAS["pages"], KEYS["pages"])
    stream_pages(spark, folder, t, scratch_path(spark, "progress")).awaitTermination()
    return t.scan().select("doc_id", "last_modified", F.md5("html").alias("digest"))


def keyed_lookups(spark, d):
    """Terms put in batches, some of them cancelled and some deleted; then those of the most frequent words of all records are looked up."""
    terms, t = read(spark, d, "terms"), KeyedTable(spark, scratch_path(spark, "terms"), SCHEMAS["terms"], KEYS["terms"])
    batch = t.batch()
    batch.put(terms.withColumn("term", F.upper("term")))
    batch.cancel()
    batch.put(terms.withColumn("term", F.concat("term", F.lit("?"))))
    batch.put(terms)
    batch.flush()
    t.delete(terms.where("term like 'a%'"))
    t.compact(vacuum=True)
    top = search.last_versions(read(spark, d, "docs")).select(F.explode(F.map_keys(search.top_words(F.col("words")))).alias("term_hash"))
    return t.get_many(top)


def position_intersections(spark, d):
    """Places that the title of a record has for a term, and those that its body has, and both as often as both have them."""
    p = index.clean_postings(read(spark, d, "postings")).groupBy("term", "doc_id").agg(*[F.max(F.when(F.col("field") == f, F.col("positions"))).alias(f"_{f}") for f in ("title", "body")])
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), " ")
    both = arrays.multiset_intersect(F.col("_title"), F.col("_body"))
    return p.where("_title is not null and _body is not null").select("term", "doc_id", text(arrays.sort_floats(F.col("_body"))).alias("body"), text(both).alias("both"))


def result_cards(spark, d):
    r = sinks.cards(read(spark, d, "results").where("final_rank is not null and not isnan(final_rank)"))
    return r.select("result_id", "mod_day", F.round("final_rank", 0).alias("points"))


def results_hydrated_all(spark, d):
    """All answers with the details of their pages."""
    docs = staged(search.last_versions(read(spark, d, "docs")), "docs")
    out = search.hydrate(read(spark, d, "results").select("doc_id", "result_id"), docs, read(spark, d, "terms"))
    return out.select("result_id", "doc_id", "url", "page_title", F.array_join("children", " ").alias("children"), F.array_join("parents", " ").alias("parents"), "mod_date", "page_size", F.array_join(F.transform(F.array_sort(F.map_entries("words_mapping")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), " ").alias("words"))


def final_rank(spark, d):
    """The blend of the stored scores."""
    z = lambda c: F.when(F.isnan(c) | F.col(c).isNull(), F.lit(0.0)).otherwise(F.col(c))
    return read(spark, d, "results").select("result_id", F.round(search.final_rank(z("page_rank"), z("title_rank"), z("body_rank")), 4).alias("blend"))


def _snippets(spark, d, words):
    text = F.filter(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), lambda w: w != "")
    return read(spark, d, "documents").select("doc_id", search.snippet(text, words).alias("summary"))


def snippet_dynamic(spark, d):
    return _snippets(spark, d, ["harbor", "tide", "fluss"])


def snippet_static(spark, d):
    return _snippets(spark, d, ["zzzz"])


def snippet_phrase(spark, d):
    text = F.filter(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), lambda w: w != "")
    return read(spark, d, "documents").select("doc_id", search.snippet(text, ["harbor"], [["opened", "for"]]).alias("summary"))


def stem_terms(spark, d):
    t = read(spark, d, "terms").groupBy(F.spark_partition_id()).agg(F.sort_array(F.collect_list("term")).alias("w"))
    return t.select(F.explode(F.arrays_zip("w", stemmed(F.col("w")).alias("s"))).alias("x")).select(F.col("x.w").alias("term"), F.col("x.s").alias("stem"))


def stemmed_search(spark, d):
    counted = index.document_postings(spread(read(spark, d, "documents")), "text", stemming=True)
    w = staged(index.term_weights(counted, read(spark, d, "documents").count()), "weighted")
    return search.search(w, index.magnitudes(w), "harbors measuring", stemming=True).select("doc_id", F.round("final_rank", 4).alias("final_rank"))


QUERIES = {
    **{f.__name__: f for f in (
        tokenize_documents, stopword_filter, term_freq_documents, term_positions, doc_max_freq, doc_freq, idf, tfidf_weights, doc_magnitude, keyword_search_top50, phrase_match, phrase_and_keyword_search,
        multi_phrase_concat, require_phrase_search, query_parse, stored_weights, stored_magnitudes, term_hashes, page_titles, link_filter, web_nodes, out_degree, in_degree, children_top5, parents_of,
        page_body_terms, page_title_terms, anchor_terms, page_title_postings, parents_anchor_map, page_search, page_index, index_update, page_search_snippets, page_search_cards, page_search_stemmed, pagerank_synthetic_edges, pagerank_topics_all, bfs_depth_all, crawl_budget, domain_filter,
        word_list_prefix, word_list_page, top5_words_per_doc, topic_names, topic_term_freq, topic_metadata, term_topics, topic_posterior, reindex_purge, freshness_filter, change_detection_md5, docs_last_version,
        upsert_and_delete, page_sizes, doc_json, doc_json_fields, results_json, results_json_fields, snippet_highlighted, portal_links, index_dump, document_report, topic_search, pagerank_converged, domain_crawl, streamed_pages, keyed_lookups, position_intersections, result_cards, results_hydrated_all, final_rank, snippet_dynamic, snippet_static, snippet_phrase, stem_terms, stemmed_search,
    )},
    "page_links": page_links_query,
    "pagerank_1_iter": _pagerank(1),
    "pagerank_5_iter": _pagerank(5),
    "pagerank_10_iter": _pagerank(10),
}


# -- the same in SQL ------------------------------------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPS) + "]"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(lower(regexp_replace(coalesce({text}, ''), '[^a-zA-Z0-9]', ' ', 'g')), '\\s+'), lambda x: x <> '')"


def _laundry(text: str) -> str:
    return f"list_filter({_words(text)}, lambda x: NOT list_contains({_STOP}, x))"


_TOK = f"""
    lists AS (SELECT doc_id, {_laundry('text')} AS toks FROM documents),
    tok AS (SELECT doc_id, t.term, t.pos - 1 AS pos FROM lists, unnest(toks) WITH ORDINALITY AS t(term, pos)),
    freq AS (SELECT doc_id, term, count(*) AS freq FROM tok GROUP BY ALL)"""
_WEIGHTED = f"""{_TOK},
    tf AS (SELECT doc_id, term, CAST(CAST(freq AS FLOAT) / CAST(max(freq) OVER (PARTITION BY doc_id) AS FLOAT) AS FLOAT) AS tf FROM freq),
    dfs AS (SELECT term, count(*) AS df FROM freq GROUP BY term),
    idfs AS (SELECT term, df, CAST(log2((SELECT count(*) FROM documents)::DOUBLE / df) AS FLOAT) AS idf FROM dfs),
    wt AS (SELECT doc_id, term, tf, CAST(tf * idf AS FLOAT) AS weight FROM tf JOIN idfs USING (term)),
    mag AS (SELECT doc_id, sqrt(sum(CAST(CAST(weight * weight AS FLOAT) AS DOUBLE))) AS body FROM wt GROUP BY doc_id)"""


def _search_sql(words: list[str], phrase: list[str], limit: int | None, require: bool = False) -> str:
    kw = ", ".join(f"('{w}')" for w in words) or "(NULL)"
    ph = ", ".join(f"({i}, '{w}')" for i, w in enumerate(phrase)) or "(0, NULL)"
    n, q = max(1, len(phrase)), len(words) + len(phrase)
    return f"""WITH {_WEIGHTED},
        kw(term) AS (VALUES {kw}), ph(k, term) AS (VALUES {ph}),
        st AS (SELECT t.doc_id, t.pos - k AS s FROM tok t JOIN ph USING (term) GROUP BY ALL HAVING count(DISTINCT k) = {n}),
        pw AS (SELECT doc_id, sum(CAST(weight AS DOUBLE)) AS w FROM (SELECT DISTINCT doc_id FROM st) JOIN wt USING (doc_id) JOIN ph USING (term) GROUP BY doc_id),
        hits AS (SELECT doc_id, CAST(weight AS DOUBLE) AS w FROM wt JOIN kw USING (term) {'WHERE doc_id IN (SELECT doc_id FROM pw)' if require else ''} UNION ALL SELECT doc_id, w FROM pw),
        sc AS (SELECT doc_id, sum(w) / (any_value(body) * sqrt({q})) AS b FROM hits JOIN mag USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, round(coalesce(b, 0), 4) AS body_rank, round(29 * coalesce(b, 0), 4) AS final_rank FROM sc
        ORDER BY round(29 * b, 9) DESC, doc_id {f'LIMIT {limit}' if limit else ''}"""


def _tokens(text: str) -> list[str]:
    import re

    return [w for w in re.sub("[^a-zA-Z0-9]", " ", text).lower().split() if w not in STOPS]


_PAGES = "pg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY last_modified DESC NULLS LAST, html DESC NULLS LAST) AS k FROM pages) WHERE k = 1)"
_BODY = "regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style|title)[^>]*>.*?</(script|style|title)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&(amp|gt|lt|quot|nbsp);?', ' ', 'g')"
_TITLE = "coalesce(trim(regexp_extract(html, '<title>(.*?)</title>', 1)), '')"
_META = "coalesce(array_to_string(regexp_extract_all(html, '<meta name=\"(?:description|keywords|author)\" content=\"([^\"]*)\"', 1), ' '), '')"
_HREFS = "hr AS (SELECT doc_id, url, h.href, h.ord - 1 AS ord FROM pg, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) WITH ORDINALITY AS h(href, ord))"
_OK = "(href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript') AND NOT starts_with(href, 'mailto') AND regexp_replace(href, '/$', '') <> '' AND NOT regexp_matches(lower(regexp_replace(href, '/$', '')), '\\.(mp3|pdf|png|jpg|mp4|avi|zip|pptx|ppt|rar|doc|docx|tar|gz|xz|bz|7z)$'))"
_TO = "CASE WHEN starts_with(t, 'http') OR starts_with(t, 'www.') THEN t WHEN starts_with(t, '/') THEN regexp_extract(url, '^([a-z]+)://', 1) || '://' || regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) || t ELSE url || '/' || t END"
_LINKS = f"{_HREFS}, lk AS (SELECT doc_id AS src, ord, {_TO} AS dst_url FROM (SELECT *, regexp_replace(href, '/$', '') AS t FROM hr WHERE {_OK}) WHERE t <> url)"
_ANCHORS = f"""an AS (SELECT doc_id, url, regexp_replace(a.href, '/$', '') AS t, a.href, tx.text FROM pg, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)<', 1)) WITH ORDINALITY AS a(href, ord),
        unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)<', 2)) WITH ORDINALITY AS tx(text, o2) WHERE a.ord = tx.o2),
    ah AS (SELECT md5({_TO}) AS dst, doc_id AS src, unnest({_laundry("regexp_replace(text, '&(amp|gt|lt|quot|nbsp);?', ' ', 'g')")}) AS term FROM an WHERE {_OK} AND t <> url)"""
_TITLE_HITS = f"""th AS (SELECT doc_id, t.term, t.pos - 1 AS pos FROM (SELECT doc_id, {_laundry(_TITLE)} AS toks FROM pg), unnest(toks) WITH ORDINALITY AS t(term, pos)
        UNION ALL SELECT doc_id, unnest({_laundry(_META)}), -100 FROM pg)"""
_TITLE_POSTINGS = f"""{_PAGES}, {_ANCHORS}, {_TITLE_HITS},
    own AS (SELECT doc_id, term, count(*) AS n FROM th GROUP BY ALL), anc AS (SELECT dst AS doc_id, term, count(*) AS n FROM ah GROUP BY ALL),
    tp AS (SELECT doc_id, term, n, CAST(CAST(n AS FLOAT) / CAST(max(n) OVER (PARTITION BY doc_id) AS FLOAT) AS FLOAT) AS tf, 1 AS own FROM own
           UNION ALL SELECT doc_id, term, n, CAST(CAST(n AS FLOAT) / CAST(max(n) OVER (PARTITION BY doc_id) AS FLOAT) AS FLOAT), 0 FROM anc),
    tb AS (SELECT doc_id, term, n, tf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY own DESC) AS k FROM tp) WHERE k = 1)"""
_PAGE_POSTINGS = f"""{_TITLE_POSTINGS}, {_LINKS},
    nd AS (SELECT src AS doc_id FROM lk UNION SELECT md5(dst_url) FROM lk UNION SELECT doc_id FROM pg),
    bf AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_laundry(_BODY)}) AS term FROM pg) GROUP BY ALL),
    post AS (SELECT 'title' AS field, term, doc_id, n, tf FROM tb UNION ALL
             SELECT 'body', term, doc_id, n, CAST(CAST(n AS FLOAT) / CAST(max(n) OVER (PARTITION BY doc_id) AS FLOAT) AS FLOAT) FROM bf),
    idf AS (SELECT field, term, CAST(log2((SELECT count(*) FROM nd)::DOUBLE / count(*)) AS FLOAT) AS idf FROM post GROUP BY ALL)"""
_NODES = "nd AS (SELECT src AS doc_id FROM links WHERE src IS NOT NULL UNION SELECT dst FROM links WHERE dst IS NOT NULL UNION SELECT doc_id FROM pages)"
_EDGES = "e AS (SELECT DISTINCT src, dst FROM links WHERE src IS NOT NULL AND dst IS NOT NULL), deg AS (SELECT src, count(*) AS deg FROM e GROUP BY src)"
_LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(mod_date, TIMESTAMPTZ '1970-01-01 00:00:00+00') DESC, written_at DESC, seq DESC) AS k FROM docs WHERE doc_id IS NOT NULL) WHERE k = 1)"
_CLEAN = "cp AS (SELECT field, term, doc_id, max(tf) AS tf, max(positions) AS positions FROM postings GROUP BY ALL)"
_CLEAN_WEIGHTED = f"""{_NODES}, {_CLEAN}, df AS (SELECT field, term, CAST(log2((SELECT count(*) FROM nd)::DOUBLE / count(*)) AS FLOAT) AS idf FROM cp GROUP BY ALL),
    cw AS (SELECT field, term, doc_id, CAST(tf * idf AS FLOAT) AS weight FROM cp JOIN df USING (field, term))"""
_TOPIC = f"""{_CLEAN}, pt AS (SELECT DISTINCT doc_id, topic FROM page_rank WHERE topic IS NOT NULL),
    tt AS (SELECT topic, term, CAST(sum(len(positions)) AS BIGINT) AS freq FROM cp JOIN pt USING (doc_id) WHERE field = 'title' GROUP BY ALL),
    tm AS (SELECT topic, (SELECT count(DISTINCT doc_id) FROM page_rank r WHERE r.topic = x.topic) AS num_pages, count(*) AS word_count FROM tt x GROUP BY topic)"""


def _pagerank_sql(k: int, nodes: str, edges: str, n: str = "(SELECT count(*) FROM nd)::DOUBLE") -> str:
    parts = [nodes, edges, f"r0 AS MATERIALIZED (SELECT doc_id, 1.0::DOUBLE / {n} AS rank FROM nd)"]
    for i in range(1, k + 1):
        p = f"r{i - 1}"
        parts.append(f"t{i} AS (SELECT sum(0.75::DOUBLE * rank / deg) + 0.25 * (SELECT count(*) FROM nd) AS total FROM {p} JOIN deg ON doc_id = src)")
        parts.append(f"i{i} AS (SELECT dst, sum(0.75::DOUBLE * rank / deg) AS s FROM e JOIN deg USING (src) JOIN {p} ON doc_id = src GROUP BY dst)")
        parts.append(f"r{i} AS MATERIALIZED (SELECT doc_id, ({'rank' if i == 1 else '0'} + coalesce(s, 0) + 0.25::DOUBLE) / total AS rank FROM {p} LEFT JOIN i{i} ON dst = doc_id, t{i})")
    return "WITH " + ", ".join(parts) + f" SELECT doc_id, round(rank, 9) AS rank FROM r{k}"


def _pagerank_topics_sql(k: int) -> str:
    """All topics of page_rank by ``k`` rounds, so many that they don't change any more."""
    parts = ["nd AS (SELECT src AS doc_id FROM links WHERE src IS NOT NULL UNION SELECT dst FROM links WHERE dst IS NOT NULL)", _EDGES, "sz AS (SELECT topic, count(DISTINCT doc_id)::DOUBLE AS n FROM page_rank WHERE topic IS NOT NULL GROUP BY topic HAVING count(DISTINCT doc_id) > 0)"]
    parts.append("r0 AS MATERIALIZED (SELECT doc_id, topic, 1.0::DOUBLE / n AS rank FROM nd, sz)")
    for i in range(1, k + 1):
        p = f"r{i - 1}"
        parts.append(f"t{i} AS (SELECT topic, coalesce(sum(0.75::DOUBLE * rank / deg), 0) + 0.25 * (SELECT count(*) FROM nd) AS total FROM {p} LEFT JOIN deg ON doc_id = src GROUP BY topic)")
        parts.append(f"i{i} AS (SELECT dst, topic, sum(0.75::DOUBLE * rank / deg) AS s FROM e JOIN deg USING (src) JOIN {p} ON doc_id = src GROUP BY ALL)")
        parts.append(f"r{i} AS MATERIALIZED (SELECT doc_id, {p}.topic, ({'rank' if i == 1 else '0'} + coalesce(s, 0) + 0.25::DOUBLE) / total AS rank FROM {p} LEFT JOIN i{i} ON dst = doc_id AND i{i}.topic = {p}.topic JOIN t{i} ON t{i}.topic = {p}.topic)")
    return "WITH " + ", ".join(parts) + f" SELECT doc_id, topic, round(rank, 9) AS rank FROM r{k}"


def _snippet_sql(words: list[str], phrase: list[str] = ()) -> str:
    plain = "list_transform(w, lambda x: regexp_replace(lower(x), '[^a-zA-Z0-9]+', '', 'g'))"
    at = f"coalesce((SELECT min(i) FROM range(1, len(w)) t(i) WHERE {' AND '.join(f'pl[i + {j}] = {chr(39)}{x}{chr(39)}' for j, x in enumerate(phrase))}), " if phrase else "("
    listed = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    return f"""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
        p AS (SELECT *, {plain} AS pl FROM w),
        m AS (SELECT *, len(w) AS n, {at}coalesce(list_position(list_transform(pl, lambda x: list_contains({listed}, x)), true), 0)) AS hit, CAST(ceil(len(w) / 2.0) AS INT) AS c FROM p)
        SELECT doc_id, CASE WHEN w IS NULL OR n = 0 THEN ''
            WHEN hit = 0 AND n > 21 THEN '...' || array_to_string(list_slice(w, c - 9, c + 11), ' ') || '...'
            WHEN hit = 0 THEN array_to_string(w, ' ') || '...'
            WHEN hit > 10 THEN '...' || array_to_string(list_slice(w, hit - 10, hit - 1), ' ') || ' ' || array_to_string(list_slice(w, hit, least(hit + 9, n)), ' ') || CASE WHEN hit + 9 <= n THEN '...' ELSE '' END
            WHEN n >= 20 THEN array_to_string(list_slice(w, 1, 20), ' ') || '...' ELSE array_to_string(w, ' ') END AS summary FROM m"""


_PAGE_SEARCH_SQL = f"""WITH {_TITLE_POSTINGS}, {_LINKS},
        nd AS (SELECT src AS doc_id FROM lk UNION SELECT md5(dst_url) FROM lk UNION SELECT doc_id FROM pg),
        bt AS (SELECT doc_id, t.term, t.pos - 1 AS pos FROM (SELECT doc_id, {_laundry(_BODY)} AS toks FROM pg), unnest(toks) WITH ORDINALITY AS t(term, pos)),
        bf AS (SELECT doc_id, term, count(*) AS n FROM bt GROUP BY ALL),
        post AS (SELECT 'title' AS field, term, doc_id, tf FROM tb UNION ALL
                 SELECT 'body', term, doc_id, CAST(CAST(n AS FLOAT) / CAST(max(n) OVER (PARTITION BY doc_id) AS FLOAT) AS FLOAT) FROM bf),
        idf AS (SELECT field, term, CAST(log2((SELECT count(*) FROM nd)::DOUBLE / count(*)) AS FLOAT) AS idf FROM post GROUP BY ALL),
        wt AS (SELECT field, term, doc_id, CAST(tf * idf AS FLOAT) AS weight FROM post JOIN idf USING (field, term)),
        mag AS (SELECT doc_id, sqrt(coalesce(sum(CAST(CAST(weight * weight AS FLOAT) AS DOUBLE)) FILTER (field = 'title'), 0)) AS mt,
                       sqrt(coalesce(sum(CAST(CAST(weight * weight AS FLOAT) AS DOUBLE)) FILTER (field = 'body'), 0)) AS mb FROM wt GROUP BY doc_id),
        pos AS (SELECT 'body' AS field, doc_id, term, pos FROM bt UNION ALL SELECT 'title', doc_id, term, pos FROM th WHERE pos >= 0),
        ph(k, term) AS (VALUES {', '.join(f"({i}, '{w}')" for i, w in enumerate(_tokens('moved to the home page')))}),
        st AS (SELECT DISTINCT field, doc_id FROM (SELECT field, doc_id, p.pos - k AS s FROM pos p JOIN ph USING (term) GROUP BY ALL HAVING count(DISTINCT k) = {len(_tokens('moved to the home page'))})),
        hits AS (SELECT doc_id, field, CAST(weight AS DOUBLE) AS w FROM wt WHERE term IN ('ladder', 'tide')
                 UNION ALL SELECT doc_id, field, sum(CAST(weight AS DOUBLE)) FROM st JOIN wt USING (field, doc_id) JOIN ph USING (term) GROUP BY ALL),
        sc AS (SELECT doc_id, coalesce(sum(w) FILTER (field = 'title'), 0) / nullif(any_value(mt) * sqrt({2 + len(_tokens('moved to the home page'))}), 0) AS t,
                      coalesce(sum(w) FILTER (field = 'body'), 0) / nullif(any_value(mb) * sqrt({2 + len(_tokens('moved to the home page'))}), 0) AS b FROM hits JOIN mag USING (doc_id) GROUP BY doc_id),
        fin AS (SELECT doc_id, coalesce(t, 0) AS t, coalesce(b, 0) AS b, (0.38 * coalesce(t, 0) + 0.29 * coalesce(b, 0)) * 100 AS f FROM sc)"""

_STEM_TOK = f"""w0 AS (SELECT doc_id, t.term, t.pos FROM (SELECT doc_id, {_words('text')} AS toks FROM documents), unnest(toks) WITH ORDINALITY AS t(term, pos)), {stem_steps('w0')},
    freq AS (SELECT doc_id, stem AS term, count(*) AS freq FROM w0 JOIN stems USING (term) WHERE NOT list_contains({_STOP}, stem) GROUP BY ALL)"""
_STEMMED_SEARCH = _search_sql(["harbor", "measur"], [], 50).replace(_TOK, _STEM_TOK).replace("FROM tok t JOIN", "FROM (SELECT doc_id, term, 0 AS pos FROM freq) t JOIN").replace("round(coalesce(b, 0), 4) AS body_rank, ", "")
_PAGE_SEARCH_STEMMED = f"""WITH {_PAGES}, {_LINKS}, {_ANCHORS.replace(_laundry("regexp_replace(text, '&(amp|gt|lt|quot|nbsp);?', ' ', 'g')"), _words("regexp_replace(text, '&(amp|gt|lt|quot|nbsp);?', ' ', 'g')"))},
    raw AS (SELECT 'body' AS field, doc_id, unnest({_words(_BODY)}) AS term FROM pg UNION ALL SELECT 'title', doc_id, unnest({_words(_TITLE)}) FROM pg UNION ALL SELECT 'title', doc_id, unnest({_words(_META)}) FROM pg UNION ALL SELECT 'anchor', dst, term FROM ah),
    {stem_steps('raw')},
    st AS (SELECT field, doc_id, stem AS term, count(*) AS n FROM raw JOIN stems USING (term) WHERE NOT list_contains({_STOP}, stem) GROUP BY ALL),
    tf AS (SELECT field, doc_id, term, CAST(CAST(n AS FLOAT) / CAST(max(n) OVER (PARTITION BY field, doc_id) AS FLOAT) AS FLOAT) AS tf FROM st),
    post AS (SELECT field, doc_id, term, tf FROM tf WHERE field <> 'anchor' UNION ALL SELECT 'title', doc_id, term, tf FROM tf a WHERE field = 'anchor' AND NOT EXISTS (SELECT 1 FROM tf o WHERE o.field = 'title' AND o.doc_id = a.doc_id AND o.term = a.term)),
    nd AS (SELECT src AS doc_id FROM lk UNION SELECT md5(dst_url) FROM lk UNION SELECT doc_id FROM pg),
    idf AS (SELECT field, term, CAST(log2((SELECT count(*) FROM nd)::DOUBLE / count(*)) AS FLOAT) AS idf FROM post GROUP BY ALL),
    wt AS (SELECT field, term, doc_id, CAST(tf * idf AS FLOAT) AS weight FROM post JOIN idf USING (field, term)),
    mag AS (SELECT doc_id, sqrt(coalesce(sum(CAST(CAST(weight * weight AS FLOAT) AS DOUBLE)) FILTER (field = 'title'), 0)) AS mt, sqrt(coalesce(sum(CAST(CAST(weight * weight AS FLOAT) AS DOUBLE)) FILTER (field = 'body'), 0)) AS mb FROM wt GROUP BY doc_id),
    sc AS (SELECT doc_id, coalesce(sum(CAST(weight AS DOUBLE)) FILTER (field = 'title'), 0) / nullif(any_value(mt) * sqrt(2), 0) AS t, coalesce(sum(CAST(weight AS DOUBLE)) FILTER (field = 'body'), 0) / nullif(any_value(mb) * sqrt(2), 0) AS b
           FROM wt JOIN mag USING (doc_id) WHERE term IN ('ladder', 'move') GROUP BY doc_id),
    fin AS (SELECT doc_id, (0.38 * coalesce(t, 0) + 0.29 * coalesce(b, 0)) * 100 AS f FROM sc)
    SELECT doc_id, round(f, 4) AS final_rank FROM fin ORDER BY round(f, 9) DESC, doc_id LIMIT 50"""

ORACLE = {
    "tokenize_documents": f"WITH l AS (SELECT doc_id, {_words('text')} AS toks FROM documents) SELECT doc_id, t.term, t.pos - 1 AS pos FROM l, unnest(toks) WITH ORDINALITY AS t(term, pos)",
    "stopword_filter": f"WITH {_TOK} SELECT doc_id, term, pos FROM tok",
    "term_freq_documents": f"WITH {_TOK} SELECT doc_id, term, freq FROM freq",
    "term_positions": f"WITH {_TOK} SELECT doc_id, term, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions FROM tok GROUP BY ALL",
    "doc_max_freq": f"WITH {_TOK} SELECT doc_id, max(freq) AS max_freq FROM freq GROUP BY ALL",
    "doc_freq": f"WITH {_TOK} SELECT term, count(*) AS df FROM freq GROUP BY ALL",
    "idf": f"WITH {_WEIGHTED} SELECT term, df, round(CAST(idf AS DOUBLE), 5) AS idf FROM idfs",
    "tfidf_weights": f"WITH {_WEIGHTED} SELECT doc_id, term, round(CAST(tf AS DOUBLE), 5) AS tf, round(CAST(weight AS DOUBLE), 5) AS weight FROM wt",
    "doc_magnitude": f"WITH {_WEIGHTED} SELECT doc_id, round(body, 4) AS body FROM mag",
    "keyword_search_top50": _search_sql(_tokens(KEYWORDS), [], 50),
    "phrase_match": _search_sql([], _tokens(PHRASE), None).partition("hits AS")[0].rstrip().rstrip(",") + " SELECT doc_id, round(w, 4) AS w FROM pw",
    "phrase_and_keyword_search": _search_sql(["harbor", "mill"], _tokens(PHRASE), None),
    "multi_phrase_concat": _search_sql(["tide"], _tokens("opened for the captain"), None),
    "require_phrase_search": _search_sql(["harbor", "mill"], _tokens(PHRASE), None, True),
    "query_parse": f"""WITH q AS (SELECT DISTINCT query_text FROM results WHERE query_text IS NOT NULL)
        SELECT query_text, array_to_string({_laundry("regexp_replace(query_text, '\"[^\\n]*?\"', '', 'g')")}, ' ') AS words,
               array_to_string({_laundry("array_to_string(regexp_extract_all(query_text, '\"([^\\n]*?)\"', 1), ' ')")}, ' ') AS phrase FROM q""",
    "stored_weights": f"WITH {_CLEAN_WEIGHTED} SELECT field, term, doc_id, round(CAST(weight AS DOUBLE), 5) AS weight FROM cw",
    "stored_magnitudes": f"""WITH {_CLEAN_WEIGHTED}, s AS (SELECT doc_id, field, CAST(CAST(weight * weight AS FLOAT) AS DOUBLE) AS q FROM cw)
        SELECT doc_id, round(sqrt(coalesce(sum(q) FILTER (field = 'title'), 0)), 4) AS title, round(sqrt(coalesce(sum(q) FILTER (field = 'body'), 0)), 4) AS body FROM s GROUP BY doc_id""",
    "term_hashes": "SELECT term, md5(term) AS computed, md5(term) = term_hash AS same FROM terms",
    "page_titles": f"WITH {_PAGES} SELECT doc_id, {_TITLE} AS title FROM pg",
    "page_links": f"WITH {_PAGES}, {_LINKS} SELECT src, ord, dst_url, md5(dst_url) AS dst FROM lk",
    "link_filter": f"WITH {_PAGES}, {_HREFS} SELECT doc_id, ord, href, {_OK} AS accepted FROM hr",
    "web_nodes": f"WITH {_NODES} SELECT doc_id FROM nd",
    "out_degree": "SELECT src AS doc_id, count(DISTINCT dst) AS out_degree FROM links GROUP BY src",
    "in_degree": "SELECT dst AS doc_id, count(DISTINCT src) AS in_degree FROM links GROUP BY dst",
    "children_top5": "WITH f AS (SELECT src, dst, min(ord) AS o FROM links GROUP BY ALL), r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY o, dst) AS n FROM f) SELECT * FROM r WHERE n <= 5",
    "parents_of": "WITH f AS (SELECT DISTINCT dst, src FROM links), r AS (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS n FROM f) SELECT * FROM r WHERE n <= 5",
    "page_body_terms": f"WITH {_PAGES}, t AS (SELECT doc_id, unnest({_laundry(_BODY)}) AS term FROM pg) SELECT doc_id, term, count(*) AS freq FROM t GROUP BY ALL",
    "page_title_terms": f"WITH {_PAGES}, {_TITLE_HITS} SELECT doc_id, term, count(*) AS freq FROM th GROUP BY ALL",
    "anchor_terms": f"WITH {_PAGES}, {_ANCHORS} SELECT dst, term, count(*) AS freq FROM ah GROUP BY ALL",
    "page_title_postings": f"WITH {_TITLE_POSTINGS} SELECT term, doc_id, round(CAST(tf AS DOUBLE), 5) AS tf, n AS hits FROM tb",
    "parents_anchor_map": f"""WITH {_PAGES}, {_LINKS}, {_ANCHORS}, ed AS (SELECT DISTINCT src, md5(dst_url) AS dst FROM lk), g AS (SELECT dst, src, string_agg(term, ' ' ORDER BY term) AS tokens FROM ah GROUP BY ALL)
        SELECT ed.dst, ed.src, coalesce(tokens, '') AS tokens FROM ed LEFT JOIN g ON g.src = ed.src AND g.dst = ed.dst""",
    **dict.fromkeys(("page_index", "index_update"), f"""WITH {_PAGE_POSTINGS}
        SELECT field, term, doc_id, n AS freq, round(CAST(tf * idf AS FLOAT)::DOUBLE, 5) AS weight FROM post JOIN idf USING (field, term)"""),
    "page_search": f"""{_PAGE_SEARCH_SQL} SELECT doc_id, round(t, 4) AS title_rank, round(b, 4) AS body_rank, round(f, 4) AS final_rank FROM fin ORDER BY round(f, 9) DESC, doc_id LIMIT 50""",
    **{f"pagerank_{k}_iter": _pagerank_sql(k, _NODES, _EDGES) for k in (1, 5, 10)},
    "pagerank_synthetic_edges": _pagerank_sql(
        3,
        "x AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), nd AS (SELECT src AS doc_id FROM x UNION SELECT dst FROM x)",
        "e AS (SELECT * FROM x), deg AS (SELECT src, count(*) AS deg FROM e GROUP BY src)",
    ),
    "pagerank_topics_all": _pagerank_topics_sql(15),
    "bfs_depth_all": """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM links WHERE src IS NOT NULL AND dst IS NOT NULL), b(doc_id, depth) USING KEY (doc_id) AS (
        (SELECT src, 0 FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 1) UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.doc_id WHERE e.dst NOT IN (SELECT doc_id FROM recurring.b)) SELECT doc_id, depth FROM b""",
    "crawl_budget": """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM links), b(doc_id, depth) AS (
        (SELECT src, 0 FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 1) UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.doc_id WHERE b.depth < 6) SELECT doc_id, min(depth) AS depth FROM b GROUP BY doc_id ORDER BY depth, doc_id LIMIT 100""",
    "domain_filter": f"WITH {_PAGES} SELECT doc_id, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS host FROM pg WHERE host LIKE '%.example'",
    "word_list_prefix": f"SELECT DISTINCT term FROM postings WHERE starts_with(term, '{PREFIX}')",
    "word_list_page": "SELECT DISTINCT term FROM postings ORDER BY term LIMIT 75 OFFSET 75",
    "top5_words_per_doc": f"""WITH {_LAST}, w AS (SELECT doc_id, unnest(map_entries(words)) AS x FROM last), r AS (SELECT doc_id, x.key AS h, x.value AS freq, row_number() OVER (PARTITION BY doc_id ORDER BY x.value DESC, x.key) AS n FROM w)
        SELECT doc_id, term, freq FROM r JOIN terms ON term_hash = h WHERE n <= 5""",
    "topic_names": "SELECT doc_id, replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/', '') AS name FROM portals",
    "topic_term_freq": f"WITH {_TOPIC} SELECT topic, term, freq FROM tt",
    "topic_metadata": f"WITH {_TOPIC} SELECT topic, num_pages, word_count FROM tm",
    "term_topics": f"WITH {_TOPIC} SELECT term, string_agg(topic || ':' || freq, ' ' ORDER BY topic) AS topics FROM tt GROUP BY term",
    "topic_posterior": f"""WITH {_TOPIC}, h AS (SELECT topic, product(freq::DOUBLE / word_count) AS p FROM tt JOIN tm USING (topic) WHERE term IN ('harbor', 'tide') GROUP BY topic)
        SELECT topic, round(coalesce(p / (SELECT count(*) FROM tm), 0), 9) AS prob FROM tm LEFT JOIN h USING (topic)""",
    "reindex_purge": f"WITH {_CLEAN} SELECT field, term, doc_id FROM cp WHERE doc_id NOT IN (SELECT doc_id FROM removals)",
    "freshness_filter": f"""WITH {_PAGES}, {_LAST} SELECT pg.doc_id, CASE WHEN last.doc_id IS NULL OR mod_date IS NULL THEN 'new' WHEN last_modified > mod_date THEN 'update' ELSE 'keep' END AS action
        FROM pg LEFT JOIN last ON last.doc_id = pg.doc_id""",
    "change_detection_md5": f"WITH {_PAGES} SELECT doc_id, coalesce(md5(html) <> md5(CASE WHEN contains(html, 'Privacy menu') THEN html ELSE replace(html, 'cookies', 'biscuits') END), false) AS changed FROM pg",
    "docs_last_version": f"WITH {_LAST} SELECT doc_id, seq, url, page_size FROM last",
    "upsert_and_delete": f"WITH {_LAST} SELECT doc_id, url, page_size FROM last WHERE doc_id NOT IN (SELECT doc_id FROM removals)",
    "page_sizes": f"WITH {_PAGES} SELECT doc_id, coalesce(content_length, strlen(html), 0) AS page_size FROM pg",
    "doc_json": f"""WITH {_LAST} SELECT doc_id, strftime(mod_date, '%a, %d %b %Y %H:%M:%S UTC') AS written, url, strftime(mod_date, '%Y-%m-%d %H:%M:%S') AS read_back, cardinality(parents) AS n_parents FROM last""",
    "results_json": """SELECT '{"result_id":' || result_id || coalesce(',"query_id":' || query_id, '') || coalesce(',"doc_id":"' || doc_id || '"', '') || coalesce(',"url":"' || url || '"', '') || '}' AS value FROM results""",
    "result_cards": "SELECT result_id, strftime(mod_date, '%Y-%m-%d') AS mod_day, round(final_rank, 0) AS points FROM results WHERE final_rank IS NOT NULL AND NOT isnan(final_rank) AND url <> ''",
    "results_hydrated_all": f"""WITH {_LAST},
        j AS (SELECT r.result_id, r.doc_id, last.url, CASE WHEN len(title) > 0 THEN array_to_string(title, ' ') ELSE regexp_extract(last.url, '^[a-z]+://([^/]*)', 1) END AS page_title, last.mod_date, last.page_size, last.words,
                     list_slice(list_filter(last.children, lambda c: c IS NOT NULL AND c <> ''), 1, 5) AS c, list_slice(list_sort(map_keys(last.parents)), 1, 5) AS p FROM results r LEFT JOIN last ON last.doc_id = r.doc_id),
        cu AS (SELECT result_id, string_agg(last.url, ' ' ORDER BY o) AS children FROM (SELECT result_id, t.id, t.o FROM j, unnest(c) WITH ORDINALITY AS t(id, o)) JOIN last ON doc_id = id GROUP BY result_id),
        pu AS (SELECT result_id, string_agg(last.url, ' ' ORDER BY o) AS parents FROM (SELECT result_id, t.id, t.o FROM j, unnest(p) WITH ORDINALITY AS t(id, o)) JOIN last ON doc_id = id GROUP BY result_id),
        w AS (SELECT result_id, x.key AS h, x.value AS n, row_number() OVER (PARTITION BY result_id ORDER BY x.value DESC, x.key) AS k FROM (SELECT result_id, unnest(map_entries(words)) AS x FROM j)),
        wm AS (SELECT result_id, string_agg(term || ':' || n, ' ' ORDER BY term) AS words FROM w JOIN terms ON term_hash = h WHERE k <= 5 GROUP BY result_id)
        SELECT result_id, doc_id, url, page_title, children, parents, mod_date, page_size, wm.words AS words FROM j LEFT JOIN cu USING (result_id) LEFT JOIN pu USING (result_id) LEFT JOIN wm USING (result_id)""",
    "stem_terms": f"WITH {stem_steps('terms')} SELECT term, stem FROM terms JOIN stems USING (term)",
    "stemmed_search": _STEMMED_SEARCH,
    "page_search_stemmed": _PAGE_SEARCH_STEMMED,
    "final_rank": """SELECT result_id, round((0.33 * CASE WHEN page_rank IS NULL OR isnan(page_rank) THEN 0 ELSE page_rank END + 0.38 * CASE WHEN title_rank IS NULL OR isnan(title_rank) THEN 0 ELSE title_rank END
        + 0.29 * CASE WHEN body_rank IS NULL OR isnan(body_rank) THEN 0 ELSE body_rank END) * 100, 4) AS blend FROM results""",
    "snippet_dynamic": _snippet_sql(["harbor", "tide", "fluss"]),
    "snippet_static": _snippet_sql(["zzzz"]),
    "results_json_fields": """WITH w AS (SELECT result_id, string_agg(x.key || '=' || x.value, ';' ORDER BY x.key || '=' || x.value) AS words FROM (SELECT result_id, unnest(map_entries(words_mapping)) AS x FROM results) GROUP BY result_id)
        SELECT result_id, query_id, query_text, doc_id, url, page_title, strftime(mod_date, '%Y-%m-%d %H:%M:%S') AS mod_date, page_size, array_to_string(list_transform(children, lambda v: coalesce(v, '~')), '|') AS children,
               array_to_string(list_transform(parents, lambda v: coalesce(v, '~')), '|') AS parents, CASE WHEN words_mapping IS NULL THEN NULL ELSE coalesce(w.words, '') END AS words_mapping, summary,
               round(CASE WHEN NOT isnan(page_rank) THEN page_rank END, 6) AS page_rank, round(CASE WHEN NOT isnan(title_rank) THEN title_rank END, 6) AS title_rank,
               round(CASE WHEN NOT isnan(body_rank) THEN body_rank END, 6) AS body_rank, round(CASE WHEN NOT isnan(final_rank) THEN final_rank END, 6) AS final_rank FROM results LEFT JOIN w USING (result_id)""",
    "snippet_highlighted": f"""WITH s AS ({_snippet_sql(["harbor", "tide"])}), i AS (SELECT *, instr(lower(summary), 'harbor') AS a, instr(lower(summary), 'tide') AS b FROM s),
        j AS (SELECT doc_id, summary, CASE WHEN a > 0 AND (b = 0 OR a < b) THEN a ELSE b END AS x, CASE WHEN a > 0 AND (b = 0 OR a < b) THEN 6 ELSE 4 END AS nx, CASE WHEN a > 0 AND b > 0 THEN greatest(a, b) ELSE 0 END AS y, CASE WHEN a > b THEN 6 ELSE 4 END AS ny FROM i)
        SELECT doc_id, CASE WHEN x = 0 THEN summary WHEN y = 0 THEN left(summary, x - 1) || '<b>' || substr(summary, x, nx) || '</b>' || substr(summary, x + nx)
               ELSE left(summary, x - 1) || '<b>' || substr(summary, x, nx) || '</b>' || substr(summary, x + nx, y - x - nx) || '<b>' || substr(summary, y, ny) || '</b>' || substr(summary, y + ny) END AS summary FROM j""",
    "portal_links": f"""WITH {_PAGES}, {_LINKS}, t AS (SELECT min(url) AS topic_url FROM portals WHERE topic = 'science')
        SELECT topic_url, dst_url, CASE WHEN regexp_extract(dst_url, '^[a-z]+://([^/?#]*)', 1) = '' THEN NULL WHEN regexp_extract(dst_url, '^[a-z]+://([^/?#]*)', 1) <> regexp_extract(topic_url, '^[a-z]+://([^/?#]*)', 1) THEN 'listed'
               WHEN starts_with(regexp_extract(dst_url, '^[a-z]+://[^/?#]*([^?#]*)', 1), regexp_extract(topic_url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) THEN 'category' END AS step FROM (SELECT DISTINCT dst_url FROM lk), t""",
    "index_dump": """SELECT 'terms' AS "table", count(*) AS n, min('{"term_hash":"' || term_hash || '","term":"' || term || '"}') AS "first" FROM terms
        UNION ALL SELECT 'links', count(*), min('{"src":"' || src || '","dst":"' || dst || '","ord":' || ord || '}') FROM (SELECT DISTINCT src, ord, dst FROM links WHERE src IS NOT NULL AND ord IS NOT NULL)""",
    "snippet_phrase": _snippet_sql(["harbor"], ["opened", "for"]),
    "document_report": f"""WITH {_LAST}, w AS (SELECT doc_id, string_agg(x.key || ' ' || x.value, '; ' ORDER BY x.key) AS words FROM (SELECT doc_id, unnest(map_entries(words)) AS x FROM last) GROUP BY doc_id)
        SELECT doc_id, concat_ws(chr(10), array_to_string(title, ' '), url, strftime(mod_date, '%a, %d %b %Y %H:%M:%S UTC') || ', ' || page_size,
               CASE WHEN words.words IS NULL THEN NULL ELSE coalesce(w.words, '') END, coalesce(array_to_string(children, chr(10)), '')) AS value
        FROM (SELECT * FROM last WHERE page_size > 0) words LEFT JOIN w USING (doc_id)""",
    "doc_json_fields": f"""WITH {_LAST}, p AS (SELECT doc_id, string_agg(x.key || '=' || array_to_string(list_transform(coalesce(x.value, []), lambda v: coalesce(v, '~')), ','), ';' ORDER BY x.key || '=' || array_to_string(list_transform(coalesce(x.value, []), lambda v: coalesce(v, '~')), ',')) AS parents FROM (SELECT doc_id, unnest(map_entries(parents)) AS x FROM last) GROUP BY doc_id),
        w AS (SELECT doc_id, string_agg(x.key || '=' || x.value, ';' ORDER BY x.key || '=' || x.value) AS words FROM (SELECT doc_id, unnest(map_entries(words)) AS x FROM last) GROUP BY doc_id)
        SELECT doc_id, url, array_to_string(list_transform(title, lambda v: coalesce(v, '~')), '|') AS title, strftime(mod_date, '%Y-%m-%d %H:%M:%S') AS mod_date, page_size, array_to_string(list_transform(children, lambda v: coalesce(v, '~')), '|') AS children,
               CASE WHEN last.parents IS NULL THEN NULL ELSE coalesce(p.parents, '') END AS parents, CASE WHEN last.words IS NULL THEN NULL ELSE coalesce(w.words, '') END AS words
        FROM last LEFT JOIN p USING (doc_id) LEFT JOIN w USING (doc_id)""",
    "topic_search": f"""WITH {_CLEAN_WEIGHTED}, mag AS (SELECT doc_id, sqrt(coalesce(sum(CAST(CAST(weight * weight AS FLOAT) AS DOUBLE)) FILTER (field = 'title'), 0)) AS mt, sqrt(coalesce(sum(CAST(CAST(weight * weight AS FLOAT) AS DOUBLE)) FILTER (field = 'body'), 0)) AS mb FROM cw GROUP BY doc_id),
        rk AS (SELECT doc_id, sum(CASE topic WHEN 'science' THEN 0.6 WHEN 'arts' THEN 0.4 END::DOUBLE * rank) AS pr FROM (SELECT doc_id, topic, max(rank) AS rank FROM page_rank WHERE rank IS NOT NULL GROUP BY ALL) WHERE topic IN ('science', 'arts') GROUP BY doc_id),
        sc AS (SELECT doc_id, coalesce(sum(CAST(weight AS DOUBLE)) FILTER (field = 'title'), 0) / nullif(any_value(mt) * sqrt(2), 0) AS t, coalesce(sum(CAST(weight AS DOUBLE)) FILTER (field = 'body'), 0) / nullif(any_value(mb) * sqrt(2), 0) AS b
               FROM cw JOIN mag USING (doc_id) WHERE term IN ('harbor', 'tide') GROUP BY doc_id),
        f AS (SELECT doc_id, coalesce(pr, 0) AS p, coalesce(t, 0) AS t, coalesce(b, 0) AS b FROM sc LEFT JOIN rk USING (doc_id))
        SELECT doc_id, round(p, 4) AS page_rank, round(t, 4) AS title_rank, round(b, 4) AS body_rank, round((0.33 * p + 0.38 * t + 0.29 * b) * 100, 4) AS final_rank FROM f""",
    "pagerank_converged": _pagerank_sql(60, _NODES, _EDGES),
    "domain_crawl": f"""WITH RECURSIVE {_PAGES}, ok AS (SELECT doc_id FROM pg WHERE regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) LIKE '%.example'), e AS (SELECT DISTINCT src, dst FROM links WHERE src IS NOT NULL AND dst IS NOT NULL), b(doc_id, depth) USING KEY (doc_id) AS (
        (SELECT src, 0 FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 1) UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.doc_id WHERE e.dst IN (SELECT doc_id FROM ok) AND e.dst NOT IN (SELECT doc_id FROM recurring.b)) SELECT doc_id, depth FROM b""",
    "streamed_pages": f"WITH {_PAGES} SELECT doc_id, last_modified, md5(html) AS digest FROM pg",
    "keyed_lookups": f"""WITH {_LAST}, w AS (SELECT doc_id, unnest(map_entries(words)) AS x FROM last), r AS (SELECT x.key AS h, row_number() OVER (PARTITION BY doc_id ORDER BY x.value DESC, x.key) AS n FROM w)
        SELECT term_hash, term FROM terms WHERE term NOT LIKE 'a%' AND term_hash IN (SELECT h FROM r WHERE n <= 5)""",
    "position_intersections": f"""WITH {_CLEAN}, j AS (SELECT t.term, t.doc_id, t.positions AS tp, b.positions AS bp FROM cp t JOIN cp b USING (term, doc_id) WHERE t.field = 'title' AND b.field = 'body'),
        a AS (SELECT term, doc_id, CAST(unnest(tp) AS INT) AS x FROM j), c AS (SELECT term, doc_id, CAST(unnest(bp) AS INT) AS x FROM j),
        na AS (SELECT term, doc_id, x, count(*) AS n FROM a GROUP BY ALL), nc AS (SELECT term, doc_id, x, count(*) AS n FROM c GROUP BY ALL),
        i AS (SELECT term, doc_id, string_agg(trim(repeat(x || ' ', CAST(least(na.n, nc.n) AS INT))), ' ' ORDER BY x) AS s FROM na JOIN nc USING (term, doc_id, x) GROUP BY ALL)
        SELECT term, doc_id, (SELECT string_agg(CAST(y AS VARCHAR), ' ' ORDER BY y) FROM (SELECT CAST(unnest(bp) AS INT) AS y)) AS body, coalesce(s, '') AS "both" FROM j LEFT JOIN i USING (term, doc_id)""",
    "page_search_cards": f"""{_PAGE_SEARCH_SQL},
        kw AS (SELECT doc_id, term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS k FROM bf), kj AS (SELECT doc_id, string_agg(term || ':' || n, ' ' ORDER BY k) AS keywords FROM kw WHERE k <= 5 GROUP BY doc_id),
        ch AS (SELECT src, dst, min(ord) AS o, min_by(dst_url, ord) AS u FROM (SELECT *, md5(dst_url) AS dst FROM lk) GROUP BY ALL), cr AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY o, dst) AS k FROM ch), cj AS (SELECT src AS doc_id, string_agg(u, ' ' ORDER BY k) AS children FROM cr WHERE k <= 5 GROUP BY src),
        pe AS (SELECT DISTINCT md5(dst_url) AS dst, src FROM lk), pr AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM pe), pj AS (SELECT dst AS doc_id, string_agg(pg.url, ' ' ORDER BY pr.k) AS parents FROM pr JOIN pg ON pg.doc_id = pr.src WHERE pr.k <= 5 GROUP BY dst),
        un AS (SELECT md5(dst_url) AS doc_id, min(dst_url) AS dst_url FROM lk GROUP BY ALL)
        SELECT fin.doc_id, round(f, 4) AS final_rank, coalesce(url, dst_url) AS url, CASE WHEN pg.doc_id IS NOT NULL THEN {_TITLE} END AS page_title, last_modified AS mod_date, CASE WHEN pg.doc_id IS NOT NULL THEN coalesce(content_length, strlen(html), 0) END AS page_size, keywords, children, parents
        FROM fin LEFT JOIN pg ON pg.doc_id = fin.doc_id LEFT JOIN un ON un.doc_id = fin.doc_id LEFT JOIN kj ON kj.doc_id = fin.doc_id LEFT JOIN cj ON cj.doc_id = fin.doc_id LEFT JOIN pj ON pj.doc_id = fin.doc_id ORDER BY round(f, 9) DESC, fin.doc_id LIMIT 50""",
}
