"""Keyword and phrase retrieval with blended cosine ranking."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.text import laundry, phrases_of, without_phrases
from weft.session import ratio

#: A query may have this many tokens, so that it can be broadcast whatever it is; a longer one is refused.
MAX_QUERY_TOKENS = 10_000
# The blend of page rank, title and body.
BLEND = (0.33, 0.38, 0.29)
TOP = 50


def parse_query(spark: SparkSession, query: str, stops: Sequence[str] | None = None, stemming: bool = False, separate: bool = False) -> DataFrame:
    """(kind 'word' or 'phrase', n, k, term): the query's tokens by the same definition as indexed text.

    All quoted phrases make one phrase, in order, or, if ``separate``, one each, numbered by n from 0; k is the place within words or phrase. A query of more than MAX_QUERY_TOKENS tokens raises ValueError."""
    if len(re.findall("[a-zA-Z0-9]+", query)) > MAX_QUERY_TOKENS:
        raise ValueError(f"a query has at most {MAX_QUERY_TOKENS} tokens")
    row = spark.range(1).select(F.lit(query).alias("q"))
    words = row.select(F.lit("word").alias("kind"), F.lit(0).alias("n"), F.posexplode(laundry(without_phrases(F.col("q")), stops, stemming)).alias("k", "term"))
    quoted = phrases_of(F.col("q")) if separate else F.array(F.array_join(phrases_of(F.col("q")), " "))
    phrase = row.select(F.posexplode(quoted).alias("n", "p")).select(F.lit("phrase").alias("kind"), "n", F.posexplode(laundry(F.col("p"), stops, stemming)).alias("k", "term"))
    return words.unionByName(phrase)


def keyword_hits(weighted: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, field, w): one row per posting and query token, repeated tokens repeat it."""
    return weighted.join(F.broadcast(words.select("term")), "term").select("doc_id", "field", F.col("weight").cast("double").alias("w"))


def phrase_hits(weighted: DataFrame, phrase: DataFrame, n: int) -> DataFrame:
    """(doc_id, field, w): fields in which the phrase's ``n`` terms follow each other, with the sum of its terms' weights in phrase order.

    A record must have all terms in title or body; in each field some position p must hold term k at p + k for all k. However often the phrase occurs,
    a field counts once. Hits without a position stand at -100 and match a phrase of one term only. Records that lack a term are left out
    before any position is looked at; those of the others are intersected as arrays, term by term, without being exploded.
    """
    joined = weighted.join(F.broadcast(phrase.select("term", "k")), "term")
    # At most n rows a record and field, each once: postings are unique.
    per = joined.groupBy("doc_id", "field").agg(F.collect_set(F.struct("k", "weight", "positions")).alias("ks")).where(F.size("ks") == n)
    starts = F.transform(F.array_sort("ks"), lambda x: F.struct(x["weight"].alias("weight"), F.transform(x["positions"], lambda p: p - x["k"]).alias("starts")))
    common = F.aggregate(F.slice("_s", 2, n), F.col("_s")[0]["starts"], lambda a, x: F.array_intersect(a, x["starts"]))
    total = F.aggregate("_s", F.lit(0.0).cast("float"), lambda a, x: (a + x["weight"]).cast("float"))
    return per.withColumn("_s", starts).where(F.size(common) > 0).select("doc_id", "field", total.cast("double").alias("w"))


def final_rank(pr: Column, title: Column, body: Column) -> Column:
    """The blended rank on a scale of 100."""
    return (F.lit(BLEND[0]) * pr + F.lit(BLEND[1]) * title + F.lit(BLEND[2]) * body) * 100


def score(hits: DataFrame, magnitudes: DataFrame, query_length: int, ranks: DataFrame | None = None, topic_probs: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, page_rank, title_rank, body_rank, final_rank) of hits (doc_id, field, w).

    Fields are cosines: summed weights over magnitude times the root of the query's length; 0 where that is undefined. PageRank counts only
    with ``topic_probs``: then it is the sum of the probabilities times the page's ranks (doc_id, topic, rank).
    """
    part = lambda f: F.coalesce(F.sum(F.when(F.col("field") == f, F.col("w"))), F.lit(0.0))
    sums = hits.groupBy("doc_id").agg(part("title").alias("_t"), part("body").alias("_b"))
    rows = sums.join(magnitudes, "doc_id", "left")
    root = F.sqrt(F.lit(float(query_length)))
    rows = rows.withColumn("title_rank", ratio(F.col("_t"), F.col("title") * root)).withColumn("body_rank", ratio(F.col("_b"), F.col("body") * root))
    if topic_probs and ranks is not None:
        prob = F.element_at(F.create_map(*[x for t, p in topic_probs.items() for x in (F.lit(t), F.lit(float(p)))]), F.col("topic"))
        blended = ranks.where(F.col("topic").isin(list(topic_probs))).groupBy("doc_id").agg(F.sum(prob * F.col("rank")).alias("page_rank"))
        rows = rows.join(blended, "doc_id", "left").withColumn("page_rank", F.coalesce("page_rank", F.lit(0.0)))
    else:
        rows = rows.withColumn("page_rank", F.lit(0.0))
    return rows.select("doc_id", "page_rank", "title_rank", "body_rank", final_rank(F.col("page_rank"), F.col("title_rank"), F.col("body_rank")).alias("final_rank"))


def search(weighted: DataFrame, magnitudes: DataFrame, query: str, k: int = TOP, stops: Sequence[str] | None = None, stemming: bool = False, require_phrase: bool = False, ranks: DataFrame | None = None, topic_probs: dict[str, float] | None = None, separate: bool = False) -> DataFrame:
    """The ``k`` best records for a query, best first, ties by doc_id.

    Words and the phrase add up: a record needs only one of them, or, with ``require_phrase``, must have the phrase. Several phrases are joined into one, or, if
    ``separate``, looked for one by one; ``require_phrase`` then asks for each. Postings are filtered by the
    query's terms in the scan; details are joined to the winners only. A query without tokens gives no rows.
    """
    spark = weighted.sparkSession
    tokens = parse_query(spark, query, stops, stemming, separate)
    rows = tokens.collect()
    words, phrases = [r for r in rows if r["kind"] == "word"], {}
    for r in rows:
        if r["kind"] == "phrase":
            phrases[r["n"]] = phrases.get(r["n"], 0) + 1
    wanted = weighted.where(F.col("term").isin(sorted({r["term"] for r in rows}))) if rows else weighted.limit(0)
    hits = keyword_hits(wanted, tokens.where("kind = 'word'"))
    found = [phrase_hits(wanted, tokens.where((F.col("kind") == "phrase") & (F.col("n") == i)), size) for i, size in sorted(phrases.items())]
    for matched in found:
        hits = hits.unionByName(matched)
    if require_phrase:
        for matched in found:
            hits = hits.join(matched.select("doc_id").distinct(), "doc_id", "left_semi")
    scored = score(hits, magnitudes, len(words) + sum(phrases.values()), ranks, topic_probs)
    return scored.orderBy(F.desc(F.round("final_rank", 9)), "doc_id").limit(k)


def top_words(words: Column, k: int = 5) -> Column:
    """The ``k`` most frequent entries of a map of counts, ties by key; null if there are none."""
    best = F.slice(F.array_sort(F.transform(F.map_entries(words), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("w")))), 1, k)
    return F.when(F.size(words) > 0, F.map_from_entries(F.transform(best, lambda e: F.struct(e["w"], -e["n"]))))


def top_word_list(words: Column, k: int = 5) -> Column:
    """The ``k`` most frequent entries of a map of counts as an array of (word, n), most frequent first, ties by key."""
    return F.slice(F.array_sort(F.transform(F.map_entries(words), lambda e: F.struct((-e["value"]).alias("_n"), e["key"].alias("word"), e["value"].alias("n")))), 1, k)


def hydrate(winners: DataFrame, docs: DataFrame, terms: DataFrame | None = None, k: int = 5) -> DataFrame:
    """The winners with url, page title (else the host), date, size, first children and parents as URLs, and most frequent words.

    ``docs`` has one row per doc_id. Winners may be a query's top or a whole table of answers: each page's details are made once, however many answers
    name it, and no side of a join needs to be small."""
    winners = winners.select("doc_id", *[c for c in winners.columns if c not in ("doc_id", "url", "title", "mod_date", "page_size", "children", "parents", "words", "page_title", "words_mapping")])
    d = docs.join(winners.select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", "url", "mod_date", "page_size",
        F.when(F.size(F.coalesce("title", F.array().cast("array<string>"))) > 0, F.array_join("title", " ")).otherwise(F.regexp_extract("url", r"^[a-z]+://([^/]*)", 1)).alias("page_title"),
        F.slice(F.filter("children", lambda c: c.isNotNull() & (c != "")), 1, k).alias("_children"), F.slice(F.array_sort(F.map_keys("parents")), 1, k).alias("_parents"), top_words(F.col("words"), k).alias("_words"),
    )
    tagged = lambda name: F.coalesce(F.transform(f"_{name}", lambda x, i: F.struct(F.lit(name).alias("of"), i.alias("n"), x.alias("id"))), F.array().cast("array<struct<of:string,n:int,id:string>>"))
    named = d.select("doc_id", F.explode(F.concat(tagged("children"), tagged("parents"))).alias("_x")).select("doc_id", F.col("_x.of").alias("_of"), F.col("_x.n").alias("_n"), F.col("_x.id").alias("_id"))
    named = named.join(docs.select(F.col("doc_id").alias("_id"), F.col("url").alias("_url")), "_id")
    lists = lambda name: F.collect_list(F.when(F.col("_of") == name, F.struct("_n", "_url")))
    urls = lambda name: F.when(F.size(f"_{name}_urls") > 0, F.transform(F.array_sort(f"_{name}_urls"), lambda x: x["_url"])).alias(name)
    found = named.groupBy("doc_id").agg(lists("children").alias("_children_urls"), lists("parents").alias("_parents_urls")).select("doc_id", urls("children"), urls("parents"))
    details = d.join(found, "doc_id", "left")
    if terms is not None:
        spelled = d.select("doc_id", F.explode("_words").alias("term_hash", "_count")).join(terms, "term_hash").groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "_count")))).alias("_spelled"))
        details = details.drop("_words").join(spelled, "doc_id", "left").withColumnRenamed("_spelled", "_words")
    return winners.join(details, "doc_id", "left").select(*winners.columns, "url", "page_title", "mod_date", "page_size", "children", "parents", F.col("_words").alias("words_mapping"))


def split_query(query: str) -> tuple[list[str], list[list[str]]]:
    """Words outside quotes and the words of each phrase, in the form in which snippets compare them."""
    plain = lambda t: [re.sub("[^a-zA-Z0-9]+", "", w.lower()) for w in t.split()]
    phrases = re.findall('"([^\n]*?)"', query)
    return plain(re.sub('"[^\n]*?"', "", query).replace('"', "")), [plain(p) for p in phrases]


def snippet(words: Column, query_words: Sequence[str], phrases: Sequence[Sequence[str]] = ()) -> Column:
    """The part of a text (array of words) around the first match of a query word, or 20 words of its start or middle.

    Words compare in lower case without anything but letters and digits, unstemmed; ``query_words`` and ``phrases`` are in that form. The first place where a
    phrase begins wins over words; an empty phrase begins at once. From the match on 10 words are shown, and 10 before it; a match among the first
    10 shows the first 20. Without a match the middle 21 words are shown, or all of 21 or fewer. Null and empty texts give ''.
    """
    sep = "\x1f"
    n = F.size(words)
    # The compared words as one string: a phrase is found in it by one search, and the separators before the place are counted.
    line = F.concat(F.lit(sep), F.array_join(F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[^a-zA-Z0-9]+", "")), sep), F.lit(sep))

    def first(tokens: Sequence[str]) -> Column:
        if not tokens:
            return F.lit(1)
        at = F.instr(line, F.lit(sep + sep.join(tokens) + sep))
        before = F.substring(line, F.lit(1), at)
        return F.when(at > 0, F.length(before) - F.length(F.replace(before, F.lit(sep), F.lit(""))))

    def least(columns: list[Column]) -> Column:
        return F.lit(None).cast("int") if not columns else columns[0] if len(columns) == 1 else F.least(*columns)

    at = F.coalesce(least([first(p) for p in phrases]), least([first([w]) for w in query_words if w]), F.lit(0))
    i = at - 1
    text = lambda a, length: F.array_join(F.slice(words, F.greatest(a + 1, F.lit(1)), F.greatest(length, F.lit(0))), " ")
    dots = F.lit("...")
    far = F.concat(dots, text(i - 10, F.lit(10)), F.lit(" "), text(i, F.lit(10)), F.when(i + 10 <= n, dots).otherwise(F.lit("")))
    near = F.when(n >= 20, F.concat(text(F.lit(0), F.lit(20)), dots)).otherwise(text(F.lit(0), n))
    c = F.ceil(n / F.lit(2)).cast("int")
    none = F.when(n > 21, F.concat(dots, text(c - 10, F.lit(21)), dots)).otherwise(F.concat(text(F.lit(0), n), dots))
    return F.when(words.isNull() | (n == 0), F.lit("")).otherwise(F.when(at == 0, none).when(i >= 10, far).otherwise(near))


def word_list(postings: DataFrame, prefix: str) -> DataFrame:
    """(term): the different words of title and body that begin with ``prefix``, in order; the prefix reaches the scan."""
    return postings.where(F.col("term").startswith(prefix)).select("term").distinct().orderBy("term")


def page_of(words: DataFrame, page: int, size: int = 75) -> DataFrame:
    """One page of an ordered word list, from 1."""
    return words.orderBy("term").offset((page - 1) * size).limit(size)


def last_versions(docs: DataFrame) -> DataFrame:
    """One row per doc_id of a log of docs: the version with the latest mod_date, of equals the one written last, then the greatest seq."""
    order = F.struct(F.coalesce(F.col("mod_date"), F.lit("1970-01-01").cast("timestamp")), "written_at", "seq")
    rest = [c for c in docs.columns if c != "doc_id"]
    return docs.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct(*rest), order).alias("d")).select("doc_id", "d.*")


def rank_within(df: DataFrame, group: str, by: Column, k: int) -> DataFrame:
    """The ``k`` first rows of each group, in order ``by``."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(by))).where(F.col("n") <= k)

