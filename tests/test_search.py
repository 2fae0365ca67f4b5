"""The engine on a corpus small enough to work by hand."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from weft.functions.html import fields_of
from weft.functions.links import accepted, page_links, resolved
from weft.functions.stem import stem
from weft.functions.text import laundry, load_stop_words, phrases_of, split_words
from weft.operators import graph, index, reindex, search
from weft.plans.engine import build_index

A = ("http://x.test/a", '<title>alpha beta</title><body>alpha beta gamma alpha <a href="/b">delta omega</a> <a href="/c">sigma</a></body>')
B = ("http://x.test/b", '<title>beta</title><body>gamma beta <a href="/c">kappa</a></body>')
ID = {k: hashlib.md5(f"http://x.test/{k}".encode()).hexdigest() for k in "abc"}
NAME = {v: k for k, v in ID.items()}


@pytest.fixture(scope="module")
def engine(spark):
    pages = spark.createDataFrame([(ID["a"], *A), (ID["b"], *B)], "doc_id string, url string, html string")
    return build_index(pages)


def best(engine, query, **kw):
    return [(NAME[r.doc_id], round(r.final_rank, 5)) for r in engine.search(query, **kw).collect()]


def near(got, want):
    assert [x for x, _ in got] == [x for x, _ in want]
    for (_, g), (_, w) in zip(got, want):
        assert g == pytest.approx(w, rel=2e-5)


def test_magnitudes_and_weights(engine):
    m = {NAME[r.doc_id]: r for r in engine.magnitudes.collect()}
    assert (m["a"].body, m["b"].body, m["c"].body) == (pytest.approx(2.137119, abs=1e-5), pytest.approx(1.787867, abs=1e-5), 0)
    assert (m["a"].title, m["b"].title, m["c"].title) == (pytest.approx(1.689464, abs=1e-5), pytest.approx(2.316548, abs=1e-5), pytest.approx(2.241475, abs=1e-5))
    w = {(r.term, NAME[r.doc_id]): r.weight for r in engine.postings.where("field = 'body'").collect()}
    assert w["alpha", "a"] == pytest.approx(1.584962, abs=1e-5) and w["beta", "a"] == pytest.approx(0.292481, abs=1e-5) and w["beta", "b"] == pytest.approx(0.584962, abs=1e-5)


def test_queries(engine):
    near(best(engine, "beta"), [("b", 19.083913), ("a", 17.126053)])
    near(best(engine, "alpha kappa"), [("a", 40.416064), ("c", 19.0), ("b", 18.178866)])
    near(best(engine, '"beta gamma"'), [("a", 5.612836)])
    assert [x for x, _ in best(engine, '"delta omega"')] == ["a"]
    assert best(engine, "the of") == [] and best(engine, "") == [] and best(engine, '"') == []
    assert [r.term for r in engine.word_list("a").collect()] == ["alpha"] and engine.word_list("zz").count() == 0
    assert best(engine, "beta", k=1)[0][0] == "b"
    assert [x for x, _ in best(engine, 'kappa "beta gamma"', require_phrase=True)] == ["a"]
    assert engine.search("beta").where(F.col("url") == A[0]).first().summary == "alpha beta gamma alpha"


def test_weights_do_not_change_when_computed_again(engine):
    again = index.term_weights(engine.postings, 3).select(*engine.postings.columns)
    key = lambda df: sorted((r.field, r.term, r.doc_id, r.weight) for r in df.collect())
    assert key(again) == key(engine.postings)


def rank(spark, edges, n, k):
    links = spark.createDataFrame(edges, "src string, dst string")
    return {r.doc_id: r.rank for r in graph.pagerank(graph.nodes(links), links, n=n, max_iter=k).collect()}


@pytest.mark.parametrize(
    ("extra", "n", "k", "want"),
    [
        ([], 3, 1, (0.518518519, 0.629629630, 0.851851852)), ([], 3, 2, (0.176470588, 0.313725490, 0.647058824)), ([], 3, 60, (0.232961830, 0.314368651, 0.534076340)),
        ([], 10, 1, (0.405797101, 0.449275362, 0.536231884)), ([("C", "A")], 3, 1, (0.606060606, 0.515151515, 0.696969697)), ([("C", "A")], 3, 2, (0.409638554, 0.253012048, 0.457831325)),
    ],
)
def test_pagerank(spark, extra, n, k, want):
    got = rank(spark, [("A", "B"), ("A", "C"), ("B", "C"), ("B", "C"), (None, "A"), *extra], n, k)
    assert (got["A"], got["B"], got["C"]) == pytest.approx(want, abs=1e-8)


def test_pagerank_of_nothing(spark):
    links = spark.createDataFrame([], "src string, dst string")
    assert graph.pagerank(graph.nodes(links), links).count() == 0


def test_stems_as_sql():
    """The SQL that holds the stemmer in the checks, on made-up words with all endings."""
    import random

    import duckdb
    import pandas as pd

    from weft.functions.stem import _KEPT, _SPECIAL, _STEP2, _STEP3, _STEP4
    from weft.plans.stem_sql import stem_steps

    rng = random.Random(1)
    endings = [*(e for e, _ in _STEP2 + _STEP3), *_STEP4, *"s es ed ing eed eedly ingly edly ly y ies ied sses us ss e ll".split(), ""]
    words = {*_SPECIAL, *_KEPT, "yyy", "ayy", "generously", "communism", "hopping", "hoping", "gas", "ties"}
    words |= {w for _ in range(8000) if (w := "".join(rng.choice("aeiouybcdlgnrstmp") for _ in range(rng.randrange(7))) + rng.choice(endings) + rng.choice(["", rng.choice(endings)]))}
    con = duckdb.connect()
    con.register("words", pd.DataFrame({"term": sorted(words)}))
    got = dict(con.execute(f"WITH {stem_steps('words')} SELECT term, stem FROM stems").fetchall())
    assert {w: stem(w) for w in words} == got


def test_stems():
    pairs = "consign consign consigned consign consistency consist knackeries knackeri knightly knight skies sky dying die generously generous communication communic relational relat hopping hop hoping hope flies fli cries cri by by say say happy happi news news proceed proceed national nation argument argument running run ties tie gas gas this this controlling control sensibilities sensibl very veri only onli becomes becom".split()
    for word, want in zip(pairs[::2], pairs[1::2]):
        assert stem(word) == want, word
    assert stem("") == "" and stem("at") == "at"


def test_tokens(spark, tmp_path):
    df = spark.createDataFrame([("",), (None,), ("...",), ("the of and",), ("für Ünal 42 x2",), ("Don't STOP",)], "t string")
    assert [r[0] for r in df.select(split_words(F.col("t"))).collect()] == [[], [], [], ["the", "of", "and"], ["f", "r", "nal", "42", "x2"], ["don", "t", "stop"]]
    assert [r[0] for r in df.select(laundry(F.col("t"))).collect()] == [[], [], [], [], ["nal", "42", "x2"], ["don", "stop"]]
    (tmp_path / "w").write_text("stop\n\nstop\n")
    assert df.select(laundry(F.col("t"), load_stop_words(spark, str(tmp_path / "w")))).collect()[5][0] == ["don", "t"]
    q = spark.createDataFrame([('a "b c" d "" "e',)], "q string")
    assert q.select(phrases_of(F.col("q"))).first()[0] == ["b c", ""]


def test_page_fields():
    p = fields_of('<title> One </title><meta name="description" content="m1"><meta name="Author" content="no"><script>if(a<b){"</p>"}</script><!-- x <b>y</b> --><p>t1 &amp t2<li>t3 <a href="/u"><b>bold</b> link</a><noscript>n</noscript><nav>menu</nav><title>Two<b>x</b></title>')
    assert p.title == "Two" and p.meta == ["m1"] and p.hrefs == ["/u"]
    assert p.body == ["t1 & t2", "t3", "bold", "link", "menu", "x"] and p.anchors == [("/u", "link")]
    assert "menu" not in p.snippet and "link" not in p.snippet and "t3" in p.snippet
    assert fields_of("").body == [] and fields_of("<").body == ["<"] and fields_of("a <b").body[0] == "a"


def test_links(spark):
    hrefs = ["#x", "javascript:f()", "mailto:a@b", "/", "a/", "x.PDF", "www.h/p", "HTTP://h/p", "/q", "a b\n", "", None, "http://o.test:8080/z", "http://h.test:99/page", "?q"]
    df = spark.createDataFrame([("d", "http://h.test:99/page", hrefs)], "doc_id string, url string, hrefs array<string>")
    got = {r.href: r.dst_url for r in page_links(df).collect()}
    assert got == {"a/": "http://h.test:99/page/a", "www.h/p": "www.h/p", "HTTP://h/p": "http://h.test:99/page/HTTP://h/p", "/q": "http://h.test/q", "a b\n": "http://h.test:99/page/ab", "http://o.test:8080/z": "http://o.test:8080/z", "?q": "http://h.test:99/page/?q"}
    assert spark.range(1).select(accepted(F.lit(None).cast("string")), resolved(F.lit("x"), F.lit("http://h"))).first()[:] == (False, "http://h/x")


def test_snippets(spark):
    def cut(n, at, words=("hit",), phrases=()):
        ws = [f"w{i}" for i in range(n)]
        if at is not None:
            ws[at] = "Hit!"
        return spark.createDataFrame([(ws,)], "w array<string>").select(search.snippet(F.col("w"), words, phrases)).first()[0]

    assert cut(19, 0) == "Hit! " + " ".join(f"w{i}" for i in range(1, 19))
    assert cut(20, 9).endswith("w19...") and cut(30, 9).endswith("w19...")
    assert cut(30, 10).startswith("...w0 ") and cut(30, 10).endswith("w19...")
    assert cut(25, 24) == "..." + " ".join(f"w{i}" for i in range(14, 24)) + " Hit!"
    assert cut(21, None) == " ".join(f"w{i}" for i in range(21)) + "..." and cut(22, None).startswith("...w1 ")
    assert cut(30, 20, phrases=[["w2", "w3"]]) == " ".join(f"w{i}" for i in range(20)) + "..."
    assert cut(5, None, phrases=[[]]) == "w0 w1 w2 w3 w4" and cut(0, None) == ""


def test_json_and_reports(spark):
    from weft.sources import codec, sinks

    schema = "doc_id string, url string, title array<string>, mod_date timestamp, page_size bigint, children array<string>, parents map<string,array<string>>, words map<string,bigint>"
    docs = spark.createDataFrame([("d", "http://u", ["A", "b"], None, 5, None, {"p": None}, {"w": 2}), ("e", None, None, None, 0, [], None, None)], schema)
    docs = docs.withColumn("mod_date", F.when(F.col("doc_id") == "d", F.timestamp_seconds(F.lit(1_700_000_000.7))))
    rows = {r.doc_id: r for r in codec.from_json(codec.to_json(docs)).collect()}
    assert rows["d"].parents == {"p": []} and rows["d"].mod_date.second == 20 and rows["e"].mod_date is None
    assert json.loads(codec.to_json(docs).where("doc_id = 'd'").first().json)["mod_date"] == "Tue, 14 Nov 2023 22:13:20 UTC"
    assert codec.from_json(spark.createDataFrame([("x", "no json")], "doc_id string, json string")).first().url is None
    assert [r.doc_id for r in sinks.report(docs).collect()] == ["d"]
    cards = sinks.cards(spark.createDataFrame([("u", 1.005, None), ("", 2.0, None), (None, 3.0, None)], "url string, final_rank double, mod_date timestamp"))
    assert cards.count() == 1


def test_freshness_and_changes(spark):
    pages = spark.createDataFrame([("a", 5, "x"), ("b", 5, "x"), ("c", 5, None), ("d", None, "x"), ("e", 1, "x")], "doc_id string, s int, html string").withColumn("last_modified", F.timestamp_seconds("s")).withColumn("mod_date", F.lit("clash"))
    known = spark.createDataFrame([("a", 4), ("b", None), ("d", 4), ("e", 4)], "doc_id string, s int").withColumn("mod_date", F.timestamp_seconds("s"))
    assert {r.doc_id: r.action for r in reindex.freshness(pages, known).collect()} == {"a": "update", "b": "new", "c": "new", "d": "keep", "e": "keep"}
    new = spark.createDataFrame([("a", "y"), ("b", "x"), ("c", None), ("z", "x")], "doc_id string, html string")
    assert {r.doc_id: r.changed for r in reindex.changed(pages, new).collect()} == {"a": True, "b": False, "c": False, "z": True}


def test_levels_stay_in_budget_and_domain(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "a"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "doc_id string")
    assert sorted(map(tuple, graph.levels(links, seeds).collect())) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert sorted(map(tuple, graph.levels(links, seeds, budget=2).collect())) == [("a", 0), ("b", 1)]
    hosts = spark.createDataFrame([("b", "evilx.org"), ("c", "y.net"), ("d", "x.org")], "doc_id string, host string")
    assert sorted(map(tuple, graph.levels(links, seeds, domain="x.org", urls=hosts).collect())) == [("a", 0), ("b", 1), ("d", 2)]


def test_levels_go_on_until_one_is_empty(spark):
    """A chain longer than any bound that there was, with a way back; ``max_depth`` still cuts it where it is asked for."""
    links = spark.createDataFrame([(f"{n:02}", f"{n + 1:02}") for n in range(34)] + [("34", "00")], "src string, dst string")
    seeds = spark.createDataFrame([("00",)], "doc_id string")
    assert sorted(map(tuple, graph.levels(links, seeds).collect())) == [(f"{n:02}", n) for n in range(35)]
    assert graph.levels(links, seeds, max_depth=3).count() == 4
