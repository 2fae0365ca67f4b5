import json
import threading
from urllib.request import Request, urlopen

from pyspark.sql import functions as F

from weft.operators.topics import directory_step
from weft.plans.engine import build_index
from weft.sources.fetch import crawl, crawl_directory
from weft.sources.serve import server
from weft.sources.sinks import dump, highlighted

SITE = {
    "http://dir.test/arts/": '<a href="http://dir.test/arts/music">m</a><a href="http://dir.test/science/x">s</a><a href="http://a.test/1">one</a>',
    "http://dir.test/arts/music": '<a href="http://dir.test/arts/">up</a><a href="http://b.test/2">two</a><a href="http://a.test/1">one</a>',
    "http://dir.test/science/": '<a href="http://c.test/3">three</a><a href="/arts/music">other</a>',
    "http://a.test/1": '<a href="http://z.test/no">not followed</a>',
    "http://b.test/2": "b",
}


def fetcher(spark):
    rows = spark.createDataFrame([(u, h) for u, h in SITE.items()], "url string, html string")
    return lambda urls: urls.join(rows, "url", "left").select(F.md5("url").alias("doc_id"), "url", "html", F.lit(None).cast("timestamp").alias("last_modified"), F.lit(None).cast("bigint").alias("content_length"), F.lit(200).alias("status"))


def test_directory(spark):
    topics = spark.createDataFrame([("http://dir.test/arts/",), ("http://dir.test/science/",), (None,)], "url string")
    got = {(r.topic, r.url, r.listed) for r in crawl_directory(topics, fetcher(spark)).collect()}
    assert got == {
        ("arts", "http://dir.test/arts/", False), ("arts", "http://dir.test/arts/music", False), ("arts", "http://a.test/1", True), ("arts", "http://b.test/2", True),
        ("science", "http://dir.test/science/", False), ("science", "http://c.test/3", True),
    }
    assert crawl_directory(topics.where("url is null"), fetcher(spark)).count() == 0
    row = spark.range(1).select(*[directory_step(F.lit("http://d.x/arts"), F.lit(u)) for u in ("http://d.x/arts/a", "http://D.x/other", "https://e.x/arts", "nothing")]).first()
    assert tuple(row) == ("category", None, "listed", None)


def test_crawl_ends_by_itself(spark):
    """A chain longer than any fixed depth is followed to its end."""
    rows = spark.createDataFrame([(f"http://s.test/{i}", f'<a href="http://s.test/{i + 1}">x</a>' if i < 6 else "end") for i in range(7)], "url string, html string")
    fetch = lambda urls: urls.join(rows, "url", "left").select(F.md5("url").alias("doc_id"), "url", "html")
    got = crawl(spark.createDataFrame([("http://s.test/0",)], "url string"), fetcher=fetch)
    assert sorted((r.url[-1], r.depth) for r in got.collect()) == [(str(i), i) for i in range(7)]
    assert crawl(spark.createDataFrame([("http://s.test/0",)], "url string"), fetcher=fetch, max_depth=2).count() == 3


def test_highlighted(spark):
    text = "The Harbor at low tide, harbor again"
    cases = {("harbor", "tide"): "The <b>Harbor</b> at low <b>tide</b>, harbor again", ("bor", "harbor"): "The <b>Harbor</b> at low tide, harbor again", ("zzz",): text, (): text, ("",): text, ("again", "AGAIN"): "The Harbor at low tide, harbor <b>again</b>"}
    row = spark.range(1).select(*[highlighted(F.lit(text), list(t)) for t in cases], highlighted(F.lit(None).cast("string"), ["x"])).first()
    assert list(row) == [*cases.values(), None]


def test_dump(spark):
    a, b = spark.createDataFrame([(1, None)], "x int, y string"), spark.createDataFrame([("q",)], "z string")
    assert sorted(map(tuple, dump({"a": a, "b": b}).collect())) == [("a", '{"x":1}'), ("b", '{"z":"q"}')]


def test_server(spark):
    pages = spark.createDataFrame([("a", "http://x.test/a", "<title>Mills</title><body>a mill by the harbor <a href='/b'>b</a>"), ("b", "http://x.test/b", "<body>harbor harbor")], "doc_id string, url string, html string")
    http = server(build_index(pages), 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{http.server_address[1]}"
    try:
        got = json.load(urlopen(Request(f"{at}/query", json.dumps({"query": "harbors"}).encode(), {"Content-Type": "application/json"})))
        assert {r["url"] for r in got} == {"http://x.test/a", "http://x.test/b"} and got[0]["keywords"]
        assert json.load(urlopen(f"{at}/wordlist/har")) == ["harbor"] and urlopen(Request(f"{at}/query", method="OPTIONS")).status == 200
        for bad in (Request(f"{at}/query", b"{}"), Request(f"{at}/nothing")):
            try:
                assert urlopen(bad).status >= 400
            except OSError as e:
                assert e.code in (400, 404)
    finally:
        http.shutdown()
