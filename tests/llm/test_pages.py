import random

import pytest

from weft.llm.boilerplate import NoLabels, Page, labels_of, train
from weft.llm.main_content import clean_summaries, fit, judge_pages, main_blocks
from weft.llm.pages import parse, site_name, title_of
from weft.llm.prose import EXPECTED, MARKUP, Measures, Yardstick, fit_yardstick, shape
from weft.llm.spam import is_spam, stuffed

NOUNS = "harbor mill tide bridge garden tower river market forest engine lamp valley".split()
SIDE = ["Home", "Contact", "Privacy", "Search this site", "About us"]


def sentence(rng):
    a, b, c = (rng.choice(NOUNS) for _ in range(3))
    return rng.choice([f"The {a} near the {b} was opened for the {c} in {rng.randrange(1900, 2020)}.", f"Nobody who saw the {a} had known that a {b} keeps the {c}.", f"It took {rng.randrange(40)} days until the {a} and the {b} met the {c}."])


def page(rng, site, main, named):
    menu = "".join(f'<li><a href="/">{x}</a>' for x in rng.sample(SIDE, 4))
    a, b = ("<main>", "</main>") if named else (f'<div class="{site}">', "</div>")
    notice = "<div><p>This site uses cookies on every page. Read our privacy policy.<button>Accept</button></div>"
    side = "<div><h3>Latest news</h3>" + "".join(f'<li><a href="/x">{sentence(rng)}</a>' for _ in range(3)) + "</div>"
    foot = f"<div><p>Copyright {rng.randrange(1990, 2020)} {site.title()}. All rights reserved.</div>"
    return f"<html><head><title>T</title><script>x('</p>')</script></head><body><div>{menu}</div>{notice}{a}{main}{b}{side}{foot}</body></html>"


def prose(rng):
    body = "".join(f"<p>{sentence(rng)} {sentence(rng)}</p>" for _ in range(rng.randrange(2, 6)))
    invite = "<p>Sign up for the newsletter of this site and get stories every week.</p>" if rng.random() < 0.4 else ""
    return f"<h1>{rng.choice(NOUNS).title()}</h1>{invite}{body}"


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        site = f"site{i % 12}"
        kind = rng.random()
        main = prose(rng) if kind < 0.8 else "<p>The page was moved to the home page of this site.</p>" if kind < 0.9 else f"<p>{', '.join('cheap ' + rng.choice(NOUNS[:2]) for _ in range(60))}</p>"
        out.append((f"d{i:03}", f"http://www.{site}.test/p{i}", page(rng, site, main, i % 2 == 0)))
    return out


@pytest.fixture(scope="module")
def model():
    return train([(h, u) for _, u, h in corpus()])


def test_parse():
    nodes = parse("<title>no</title><div>a <b>b</b>\n c<p>d<li>e<a href=x>f</a><table><tr><td>g<td>h &amp; i</table><!-- z --></div>tail")
    assert [(n.tag, n.text) for n in nodes if n.block >= 0] == [("div", "a b c"), ("p", "d"), ("li", "ef"), ("td", "g"), ("td", "h & i"), ("#root", "tail")]
    assert [n.block for n in nodes if n.block >= 0] == list(range(6)) and [n.linked for n in nodes if n.text == "ef"] == [1]
    assert len(parse("")) == 1 and len(parse("<p></p>")) == 1 and parse("<<<")[1].text == "<<<"
    assert all(n.parent < i for i, n in enumerate(nodes)) and site_name("http://www.Foo.test:80/x") == "foo" and site_name(None) == "" and title_of("<title> a\nb </title>") == "a b"
    deep = parse("<div>" * 5000 + "x" + "</div>" * 5000)
    assert deep[-1].text == "x" and len(deep) < 10


def test_marginals_are_exact_on_a_small_tree(model):
    import itertools
    import math

    p = Page("<div><p>One thing is here.<p>Home<div><p>x y z.<p>Sign up today.</div></div>", "http://a.b/")
    own = model.evidence(p, {})
    weight = [0.0] * len(p.nodes)
    total = 0.0
    for y in itertools.product((0, 1), repeat=len(p.nodes)):
        s = sum(own[i] * y[i] for i in range(len(y)))
        for i, n in enumerate(p.nodes[1:], 1):
            s += (model.block_tie if n.block >= 0 else model.element_tie)[y[n.parent]][y[i]]
        total += math.exp(s)
        for i in range(len(y)):
            weight[i] += y[i] * math.exp(s)
    assert model.marginals(p) == pytest.approx([w / total for w in weight], abs=1e-9)


def test_held_out_sites():
    rows = corpus(240, 3)
    own = train([(h, u) for _, u, h in rows if site_name(u) not in ("site0", "site2", "site4")])
    pages = [Page(h, u) for _, u, h in rows if "<main>" in h]
    wrong = total = 0
    for p, y in zip(pages, labels_of(pages)):
        if p.site in ("site0", "site2", "site4"):
            q = own.marginals(p)
            total += len(p.leaves)
            wrong += sum((q[i] > 0.5) != bool(y[i]) for i in p.leaves)
    assert total > 200 and wrong <= 0.02 * total


def test_without_labels_nothing_is_learnt(spark):
    with pytest.raises(NoLabels):
        train([("<p>This sentence stays here.<li><a href=x>Menu</a>", None)])
    pages = spark.createDataFrame([("a", None, "<p>x")], "doc_id string, url string, html string")
    with pytest.raises(NoLabels):
        judge_pages(pages)
    assert judge_pages(pages.where("html is null")).count() == 0
    assert judge_pages(pages, train([(h, u) for _, u, h in corpus(40)])).count() == 1


def one(text):
    return stuffed([("p", text, False)])


def test_stuffed():
    assert one("bargain lottery, bargain lottery, bargain routers, bargain lottery")
    assert one("fast movers. original bracelets. fast movers. original bracelets. fast movers.")
    assert one("Looking for ladders? trusted ladders, top ladders, white ladders and ladders tents ladders top here.")
    assert one("silver wheel | navy trail | black trail | blue district | white trail")
    assert one("poker bikes wholesale cruises affordable watches movers ladders hotels locksmiths instant outlet kayaks kettles slots laptops gloves lottery mattresses parkas")
    assert stuffed([("li", f"{a} {b}", True) for a, b in zip(NOUNS, NOUNS[3:])])
    assert not one("Notebook: Because the magnet was distant, the pilot moved 22 of the wheel records to the county.")
    assert not one("No sailor forgets the pagesupen of Nojenebol. In 1997 a pagesupen stood in the town. The farmer reaches every pagesupen twice.")
    assert not stuffed([("li", "The harbor near the mill was opened for the tide.", False)] * 30)
    assert not one("cheap lamps") and not one("") and not one("...") and not stuffed([])
    rng = random.Random(4)
    assert not stuffed([("p", " ".join(sentence(rng) for _ in range(3)), False), *[("td", f"{n} {i}", False) for i, n in enumerate(NOUNS[:5])]])


# Honest prose in languages and scripts that no labelled page is in.
PROSE = [
    "Старый мост у реки был построен в прошлом веке, и с тех пор его ремонтировали всего два раза. Жители города часто гуляют здесь вечером, потому что отсюда хорошо видно закат. Весной вода поднимается почти до самых перил, но сторож говорит, что бояться нечего.",
    "Stary most nad rzeką zbudowano w ubiegłym wieku i od tego czasu remontowano go tylko dwa razy. Mieszkańcy często spacerują tu wieczorem, bo dobrze widać stąd zachód słońca. Wiosną woda sięga prawie do poręczy, ale strażnik mówi, że nie ma się czego bać.",
    "Nehrin kıyısındaki eski köprü geçen yüzyılda yapıldı ve o zamandan beri yalnızca iki kez onarıldı. Kasaba halkı akşamları sık sık burada yürür, çünkü gün batımı buradan çok güzel görünür. İlkbaharda su neredeyse korkuluğa kadar yükselir, ama bekçi korkacak bir şey olmadığını söyler.",
    "河边的老桥建于上个世纪，从那时起只修过两次。镇上的居民傍晚常到这里散步，因为从这里看日落非常漂亮。春天的时候，河水几乎涨到栏杆，但看守的人说没有什么可怕的。",
    "川のそばの古い橋は前の世紀に建てられ、それから二度しか直されていない。町の人々は夕方によくここを散歩する。ここからは夕日がとてもきれいに見えるからだ。",
    "Wir haben 23 Wege geprüft, doch nur der tiefe Speicher ordnet den Spiegel für die Gäste. Niemand im Dorf hatte je eine so alte Brücke gesehen.",
    "Il vecchio ponte sul fiume fu costruito nel secolo scorso e da allora è stato riparato solo due volte. Gli abitanti vi passeggiano spesso la sera, perché da qui si vede bene il tramonto.",
    "Vanha silta joen yli rakennettiin viime vuosisadalla, ja sen jälkeen sitä on korjattu vain kahdesti. Asukkaat kävelevät täällä usein iltaisin, koska auringonlasku näkyy täältä hyvin.",
]


@pytest.mark.parametrize("text", PROSE)
def test_prose_in_other_languages_is_honest(text, model):
    for yard in (Yardstick(), model.prose):
        assert not stuffed([("p", text, False)], yard)
        assert not stuffed([("p", s.strip() + ".", False) for s in text.split(". ")], yard)


def test_stuffing_in_other_languages():
    assert one("купить дешево телефон, телефон купить недорого, телефон цена купить, купить телефон скидка, телефон дешево купить сейчас, купить телефон")
    assert one("günstige Uhren, Uhren billig, Uhren kaufen, billige Uhren Angebote, Uhren Sale, beste Uhren günstig, Uhren online kaufen, Uhren Rabatt")


def test_without_compression_there_is_no_spam(monkeypatch):
    """Redundancy is required: with a compressor that sees none, punctuation alone makes no case."""
    from weft.llm import prose

    monkeypatch.setattr(prose, "packed_size", lambda raw: 10 * len(raw))
    assert not one("bargain lottery, bargain lottery, bargain routers, bargain lottery") and not one("silver wheel | navy trail | black trail | blue district | white trail")


def test_yardstick():
    rng = random.Random(2)
    pages = [Measures([("p", " ".join(sentence(rng) for _ in range(rng.randrange(1, 9))), False)]) for _ in range(400)]
    stuffing = [Measures([("p", "cheap lamps, best lamps; " * rng.randrange(5, 40), False)]) for _ in range(40)]
    yard = fit_yardstick(pages + stuffing)
    assert yard.fits[""][MARKUP] != EXPECTED[MARKUP] and {"the"} & set(yard.fits)
    ratios = sorted(yard.ratios(m)[MARKUP] for m in pages)
    assert 0.95 < ratios[200] < 1.05 and all(yard.ratios(m)[MARKUP] < 0.6 for m in stuffing)
    assert fit_yardstick([]).fits == {"": EXPECTED} and Yardstick().ratios(Measures([])) == (1.0, 1.0, 1.0)
    assert shape("The 3 mills, Ünal's oak\nx") == "A0b,Ba\na"


def test_refrains_and_short_pages_are_honest(model):
    refrain = "<p>The harbor near the mill was opened for the tide.</p>" * 30
    for main, want in ((refrain, False), ("<p>cheap lamps</p>", False), ("<p>" + "cheap lamps, best lamps; " * 30 + "</p>", True)):
        p = Page(page(random.Random(1), "site1", main, False), "http://www.site1.test/")
        assert is_spam(p, model.marginals(p)) is want


SCHEMA = "doc_id string, url string, html string, spam int, blocks string"


def test_tables_of_pages(spark):
    rows = [(d, u, h, 1, "x") for d, u, h in corpus()]
    rows += [rows[0], ("null", "http://a.b", None, 1, "x"), (None, "u", "<p>x", 1, "x"), ("empty", None, "", 1, "x"), ("long", "http://l.test/", page(random.Random(1), "l", "<p>" + "The mill was opened for the harbor. " * 20_000 + "</p>", False), 1, "x")]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(4)
    judged = judge_pages(pages).cache()
    got = {r.doc_id: r for r in judged.collect()}
    assert "null" not in got and None not in got and got["empty"].blocks == [] and "opened for the harbor" in got["long"].main_text
    for d, _, h in corpus():
        assert got[d].spam == ("cheap" in h), d
        assert "cookies" not in got[d].main_text and "Copyright" not in got[d].main_text
    blocks = spark.createDataFrame([("d000", i, "p") for i in range(100)] + [(None, 1, "p")], "doc_id string, block_no int, tag string")
    assert sorted(r.block_no for r in main_blocks(judged, blocks).collect()) == sorted(got["d000"].blocks)
    text = next(r.main_text for r in got.values() if len(r.main_text.split()) > 30 and r.doc_id.startswith("d"))
    doc = next(r.doc_id for r in got.values() if r.main_text == text)
    w = text.split()
    results = spark.createDataFrame(
        [(1, doc, "..." + " ".join(w[3:20]) + "...", 1), (2, doc, " ".join(w[3:9]) + " Home Contact", 1), (3, doc, None, 1), (4, doc, "", 1), (5, doc, "...", 1), (6, "nowhere", w[0], 1), (7, doc, text, 1), (8, None, w[0], 1), (1, doc, "..." + " ".join(w[3:20]) + "...", 1)],
        "result_id bigint, doc_id string, summary string, _main int",
    )
    assert sorted(r.result_id for r in clean_summaries(judged, results).collect()) == [1, 7]
    assert judge_pages(pages.limit(0)).count() == 0


def test_the_sample_is_bounded(spark):
    pages = spark.createDataFrame([(d, u, h, 1, "x") for d, u, h in corpus()], SCHEMA)
    assert fit(pages, 10).standing is not None


def test_all_words_of_a_block_are_evidence():
    start = " ".join(f"w{chr(97 + n // 26)}{chr(97 + n % 26)}" for n in range(70))
    plain, ended = (Page(f"<p>{start}{end}</p>", "http://a.b/") for end in ("", " copyright reserved"))
    (i,), (j,) = plain.leaves, ended.leaves
    assert len(ended.wording(j)) == len(plain.wording(i)) + 2 == 72 and set(plain.wording(i)) < set(ended.wording(j))


def same(a, b):
    assert a.standing == b.standing and a.weights == pytest.approx(b.weights, abs=1e-9)
    assert [*a.block_tie, *a.element_tie] == [pytest.approx(t) for t in (*b.block_tie, *b.element_tie)]
    assert a.prose.markers == b.prose.markers and a.prose.fits.keys() == b.prose.fits.keys()
    for k, fits in a.prose.fits.items():
        for f, g in zip(fits, b.prose.fits[k]):
            assert [*f[0], *f[1:]] == pytest.approx([*g[0], *g[1:]], rel=1e-6)


def test_the_model_is_of_all_labelled_pages(spark):
    """Of more than 1,500, and of those of more than 50,000 characters; a page that is there twice counts once."""
    rows = corpus(3200, 5)
    rng = random.Random(6)
    rows += [(f"long{i}", f"http://www.site{i}.test/long", page(rng, f"site{i}", "<h1>Tides</h1>" + "".join(f"<p>{sentence(rng)} {sentence(rng)}</p>" for _ in range(500)) + "<p>These words stand on long pages alone.</p>", True)) for i in range(3)]
    assert all(len(h) > 50_000 for _, _, h in rows[-3:])
    model = fit(spark.createDataFrame([*rows, rows[0], rows[-1]], "doc_id string, url string, html string"))
    assert "these words stand on long pages alone." in model.standing
    same(model, train([(h, u) for _, u, h in rows]))


def test_labels_on_long_pages_alone(spark):
    rng = random.Random(7)
    html = page(rng, "site1", "".join(f"<p>{sentence(rng)}</p>" for _ in range(1200)), True)
    assert len(html) > 50_000
    pages = spark.createDataFrame([("a", "http://www.site1.test/", html)], "doc_id string, url string, html string")
    assert len(judge_pages(pages).first().blocks) > 1000


def test_weights_descend_over_many_blocks(spark, monkeypatch):
    from functools import partial

    from weft.llm import boilerplate, training

    pages = spark.createDataFrame(corpus(60), "doc_id string, url string, html string")
    monkeypatch.setattr(training, "descend", partial(boilerplate.descend, rounds=15))
    one = fit(pages)
    monkeypatch.setattr(training, "BLOCK", 4096)
    same(fit(pages), one)
    same(one, train([(h, u) for _, u, h in corpus(60)], rounds=15))


def test_many_stuffed_pages_make_no_language():
    """However many labelled pages are of one kind of stuffing, it does not become what is usual."""
    rng = random.Random(8)
    pages = [Measures([("p", " ".join(sentence(rng) for _ in range(rng.randrange(1, 9))), False)]) for _ in range(500)]
    wares = [[("li", f"red {rng.choice(NOUNS)}, size {rng.randrange(30)}, cheap", False) for _ in range(rng.randrange(8, 40))] for _ in range(150)]
    yard = fit_yardstick(pages + [Measures(w) for w in wares])
    assert "the" in yard.fits and not {"red", "size"} & set(yard.fits)
    pooled = Yardstick({"": yard.fits[""]})
    assert [stuffed(w, yard) for w in wares] == [stuffed(w, pooled) for w in wares] and sum(stuffed(w, yard) for w in wares) > 120


def test_work_on_a_page_is_done_once(monkeypatch):
    """A block's text is masked once, only sentences that can acquit are compressed, and words are held once for all surfaces on which they stand."""
    from weft.llm import boilerplate, prose

    p = Page("<main><p>The mill by the tide was opened again.</p><p>Cheap lamps, 20 best lamps</p></main>", "http://www.site1.test/")
    seen = []
    monkeypatch.setattr(boilerplate, "masked", lambda text, site, old=boilerplate.masked: seen.append(text) or old(text, site))
    for _ in range(2):
        boilerplate.main_texts(p)
        for i in p.leaves:
            p.phrase(i)
            p.wording(i)
    assert sorted(seen) == sorted(p.nodes[i].text for i in p.leaves)
    packed = []
    monkeypatch.setattr(prose, "packed_size", lambda raw, old=prose.packed_size: packed.append(raw) or old(raw))
    Yardstick().has_sentences(Measures([("p", p.nodes[i].text, False) for i in p.leaves]), 0.95)
    assert packed == [b"The mill by the tide was opened again."]
    like = boilerplate.likes([(q, labels_of([q])[0]) for q in (Page(f"<main>{a}</main>", None) for a in ("<p>Old mill here", "<li>Old mill here", "<div><h1>Old mill here</h1><p>x"))], set())
    rows = boilerplate.Rows((k, *n) for k, n in sorted(like.items()))
    assert len(rows.of) > len(rows.lengths) == 3


def test_gradient():
    """As summed node by node."""
    import numpy as np

    from weft.llm import boilerplate
    from weft.llm.boilerplate import DIM, STANDING, Rows, descend, likes

    pages = [Page(h, u) for _, u, h in corpus(12) if "<main>" in h]
    both = list(zip(pages, labels_of(pages)))
    standing = {pages[0].phrase(pages[0].leaves[0]), pages[0].phrase(pages[0].leaves[-1])}
    rows = Rows((k, *n) for k, n in sorted(likes(both, standing).items()))
    w, want = np.random.default_rng(1).normal(size=DIM), np.zeros(DIM)
    for p, y in both:
        for i, n in enumerate(p.nodes):
            f = [(x, 1.0) for x in boilerplate.surface_features(p.surface(i))]
            if n.block >= 0:
                words = p.wording(i)
                f += [(x, 1 / len(words) ** 0.5) for x in words] + [(boilerplate._h("=" + p.phrase(i)), STANDING)] * (p.phrase(i) in standing)
            d = 1 / (1 + np.exp(-sum(w[x] * v for x, v in f))) - y[i]
            for x, v in f:
                want[x] += d * v
    assert rows.gradient(w) == pytest.approx(want, abs=1e-9) and rows.counts.sum() == sum(len(p.nodes) for p in pages)
    assert not Rows([]).gradient(w).any() and len(descend(rows.gradient, rows.counts.sum(), 2)) == DIM


def test_pages_survive_pickling():
    import pickle

    for h in ("", "<p>x", "<<<", "<main><h1>A b</h1><div><p>c <a href=x>d</a></p><li>e</li></div></main>tail", *(h for _, _, h in corpus(8))):
        p = Page(h, "http://www.site1.test/")
        q = pickle.loads(pickle.dumps(p, 5))
        assert (q.nodes, q.site, q.title, q.leaves, q.below) == (p.nodes, p.site, p.title, p.leaves, p.below)


def test_stray_signs_of_markup():
    text = [(n.tag, n.text, n.linked, n.zones) for n in parse("<DIV>a < b<!x <p> y>c<a href=q>1 < 2 &amp; 3</a></div ><table><td>g<tr><td>h<br>i<th>&lt;p&gt;</table></b></p>z <p") if n.block >= 0]
    assert text == [("div", "a < b y>c1 < 2 & 3", 7, ("div",)), ("td", "g", 0, ("table", "td")), ("td", "h i", 0, ("table", "td", "tr", "td")), ("th", "<p>", 0, ("table", "td", "tr", "td", "th")), ("#root", "z <p", 0, ())]


def test_words_and_shapes_do_not_depend_on_the_script():
    """ASCII is read by a pattern of its own."""
    from weft.llm.prose import _SIGN, _WORD, words_of

    for s in ("It's 3_a _b 'x' don''t a'b'c\tq\x1f-(Z9)\nOK!", "3_a _b\tq\x1f-(Z9)\nOK!", "", "_", "'"):
        assert words_of(s) == _WORD.findall(s) and shape(s) + "b" == shape(s + " älter") and len(shape(s)) == len(_SIGN.findall(s))
