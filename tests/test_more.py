"""Arrays, topics of a directory, and an index that is brought up to date."""

import pytest
from pyspark.sql import functions as F

from weft.functions.arrays import multiset_intersect, sort_floats
from weft.functions.html import extract_fields
from weft.operators.topics import directory_hits, term_topics, topic_metadata, topic_name, topic_posterior, topic_term_freq
from weft.plans.engine import build_index, update_index


def test_arrays(spark):
    df = spark.createDataFrame([([3.0, 1.0, 1.0, 2.0], [1.0, 1.0, 1.0, 3.0, 5.0]), (None, [1.0]), ([], [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(multiset_intersect(F.col("a"), F.col("b"))).collect()] == [[1.0, 1.0, 3.0], None, []]
    assert df.select(sort_floats(F.col("a"))).first()[0] == [1.0, 1.0, 2.0, 3.0]


def test_topics(spark):
    pages = spark.createDataFrame([("a", "u", "<title>tide tide mill</title>"), ("b", "u", "<title>tide</title>"), ("c", "u", None)], "doc_id string, url string, html string")
    listed = spark.createDataFrame([("a", "arts"), ("b", "arts"), ("b", "news"), ("c", "news"), ("a", None), ("b", "news")], "doc_id string, topic string")
    freqs = topic_term_freq(directory_hits(extract_fields(pages), listed))
    assert sorted(map(tuple, freqs.collect())) == [("arts", "mill", 1), ("arts", "tide", 3), ("news", "tide", 1)]
    meta = topic_metadata(freqs, listed)
    assert sorted(map(tuple, meta.select("topic", "num_pages", "word_count").collect())) == [("arts", 2, 2), ("news", 2, 1)]
    assert {r.term: r.topics for r in term_topics(freqs).collect()} == {"mill": {"arts": 1}, "tide": {"arts": 3, "news": 1}}
    query = spark.createDataFrame([("tide",), ("mill",)], "term string")
    assert {r.topic: r.prob for r in topic_posterior(freqs, meta, query, 2).collect()} == {"arts": pytest.approx(0.375), "news": pytest.approx(0.5)}
    assert spark.range(1).select(topic_name(F.lit("http://h.test:8/a/b/?q")), topic_name(F.lit("http://h.test"))).first()[:] == ("ab", "")


def test_an_updated_index_equals_a_new_one(spark):
    schema = "doc_id string, url string, html string"
    old = [("a", "http://x/a", "<title>one</title><p>alpha beta <a href='/b'>gamma</a>"), ("b", "http://x/b", "<title>two</title><p>beta delta"), ("d", "http://x/d", "<p>kappa")]
    changed = [("a", "http://x/a", "<title>uno</title><p>alpha omega <a href='/c'>sigma</a>"), ("e", "http://x/e", "<p>beta beta")]
    both = [*changed, *[r for r in old if r[0] not in "ae"]]
    got = update_index(build_index(spark.createDataFrame(old, schema)), spark.createDataFrame(changed, schema))
    want = build_index(spark.createDataFrame(both, schema))
    rows = lambda e: sorted((r.field, r.term, r.doc_id, r.tf, r.weight, r.positions) for r in e.postings.collect())
    assert rows(got) == rows(want) and len(rows(got)) > 8
    assert list(map(tuple, got.search("beta sigma").drop("summary").collect())) == list(map(tuple, want.search("beta sigma").drop("summary").collect()))


def test_phrases_one_by_one(spark):
    pages = spark.createDataFrame([("a", "u", "<p>alpha beta gamma delta"), ("b", "u", "<p>alpha beta"), ("c", "u", "<p>alpha beta delta gamma delta")], "doc_id string, url string, html string")
    e = build_index(pages)
    from weft.operators.search import search

    ask = lambda **kw: sorted(r.doc_id for r in search(e.postings, e.magnitudes, '"alpha beta" "gamma delta"', **kw).collect())
    assert ask() == ["a"] and ask(separate=True) == ["a", "b", "c"] and ask(separate=True, require_phrase=True) == ["a", "c"]


def test_biased_pagerank(spark):
    from weft.operators import graph

    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c")], "src string, dst string")
    bias = spark.createDataFrame([("a",), ("x",), ("a",)], "doc_id string")
    plain = {r.doc_id: r["rank"] for r in graph.pagerank(graph.nodes(links), links).collect()}
    got = {r.doc_id: r["rank"] for r in graph.pagerank(graph.nodes(links), links, bias=bias).collect()}
    assert got["d"] == 0 and got["a"] > plain["a"] and got["b"] > 0
    both = graph.pagerank(graph.nodes(links), links, topic_sizes={"x": 4.0, "y": 4.0}, bias=spark.createDataFrame([("a", "x"), ("d", "y")], "doc_id string, topic string")).collect()
    rank = {(r.doc_id, r.topic): r["rank"] for r in both}
    assert rank["d", "x"] == 0 and rank["a", "y"] == 0 and rank["a", "x"] == pytest.approx(got["a"])


SITE = {"/": "<title>t</title><a href='/b'>b</a><a href='/c'>c</a><a href='/gone'>x</a>", "/b": "<a href='/d'>d</a><a href='/b'>self</a>", "/c": "<a href='http://elsewhere.invalid/q'>q</a>", "/d": "end"}


def test_crawl_of_a_table(spark):
    from weft.sources.fetch import crawl

    site = spark.createDataFrame([("http://h.test" + k, v) for k, v in SITE.items()], "url string, html string")
    offline = lambda urls: urls.join(site, "url", "left").selectExpr("md5(url) AS doc_id", "url", "html", "current_timestamp() AS last_modified", "CAST(NULL AS BIGINT) AS content_length", "200 AS status")
    seeds = spark.createDataFrame([("http://h.test/",), (None,)], "url string")
    ask = lambda **kw: {r.url.partition("test")[2] or r.url: (r.depth, r.html is not None) for r in crawl(seeds, fetcher=offline, **kw).collect()}
    assert ask(domain="h.test") == {"/": (0, True), "/b": (1, True), "/c": (1, True), "/gone": (1, False), "/d": (2, True)}
    assert ask(domain="h.test", budget=2) == {"/": (0, True), "/b": (1, True)}
    assert "http://elsewhere.invalid/q" in ask() and ask(domain="other") == {}


def test_fetch(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from weft.sources.fetch import fetch

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            body = SITE.get(self.path, "").encode()
            self.send_response(200 if body else 404)
            self.send_header("Content-Length", str(len(body)))
            if self.path == "/b":
                self.send_header("Last-Modified", "Tue, 14 Nov 2023 22:13:20 GMT")
            if self.path == "/c":
                self.send_header("Last-Modified", "yesterday")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    urls = spark.createDataFrame([(base + p,) for p in ("/", "/b", "/c", "/none")] + [("no url",), (None,)], "url string")
    got = {r.url.removeprefix(base): r for r in fetch(urls).collect()}
    server.shutdown()
    assert got["/"].html == SITE["/"] and got["/"].content_length == len(SITE["/"]) and got["/"].last_modified is not None
    assert got["/b"].last_modified.year == 2023 and got["/c"].last_modified is None and got["/none"].status == 404 and got["/none"].html is None
    assert got["no url"].status == 0 and len(got) == 5


def test_all_results_are_hydrated(spark):
    import __spark_entry__ as entry

    root = "/root/testdata/sf0.001"
    answers, docs = spark.read.parquet(f"{root}/results.parquet"), spark.read.parquet(f"{root}/docs.parquet")
    got = entry.queries()["results_hydrated_all"](spark, root)
    assert sorted(r.result_id for r in got.collect()) == sorted(r.result_id for r in answers.collect()) and answers.count() > 50
    assert got.where("url is not null").count() == answers.join(docs.where("url is not null"), "doc_id", "left_semi").count() > 50


def test_every_topic_is_ranked_to_convergence(spark):
    import __spark_entry__ as entry
    from weft.operators import graph

    root = "/root/testdata/sf0.001"
    links = spark.read.parquet(f"{root}/links.parquet")
    want = {r.doc_id: r["rank"] for r in graph.pagerank(graph.nodes(links), links, max_iter=1000, tol=1e-15).collect()}
    got = entry.queries()["pagerank_topics_all"](spark, root).collect()
    names = {r.topic for r in spark.read.parquet(f"{root}/page_rank.parquet").where("topic is not null").collect()}
    # Converged, the ranks no longer depend on where a topic began.
    assert {(r.doc_id, r.topic) for r in got} == {(i, t) for i in want for t in names} and len(got) == len(want) * len(names) and len(names) == 8
    assert all(abs(r["rank"] - want[r.doc_id]) < 1e-9 for r in got)
