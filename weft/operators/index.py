"""Positional postings, float32 TF-IDF weights and magnitudes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.links import page_links
from weft.functions.stem import stem
from weft.functions.text import laundry, stop_words

#: The position of a hit that has none: meta terms and anchor texts.
NO_POSITION = -100.0


def token_positions(df: DataFrame, tokens: Column, *keep: str) -> DataFrame:
    """(*keep, term, pos): each token of the array with its place from 0, counted after stop words are gone."""
    return df.select(*keep, F.posexplode(tokens).alias("pos", "term"))


def term_frequencies(hits: DataFrame) -> DataFrame:
    """(field, term, doc_id, freq, positions) of hits (field, doc_id, term, pos). Positions ascend."""
    return hits.groupBy("doc_id", "field", "term").agg(F.count(F.lit(1)).alias("freq"), F.sort_array(F.collect_list(F.col("pos").cast("float"))).alias("positions"))


def max_frequencies(freqs: DataFrame) -> DataFrame:
    """(doc_id, field, max_freq)."""
    return freqs.groupBy("doc_id", "field").agg(F.max("freq").alias("max_freq"))


def with_tf(freqs: DataFrame) -> DataFrame:
    """Adds tf: frequency over the greatest frequency of the record's field, as float32."""
    top = F.max("freq").over(Window.partitionBy("doc_id", "field"))
    return freqs.withColumn("tf", (F.col("freq").cast("float") / top.cast("float")).cast("float"))


def _counting(field: str, positioned: str, loose: str | None, stops: frozenset[str], stemming: bool):
    """Postings of one row each, by Arrow batches: tokens are counted within the row, so no token moves."""
    import re

    import numpy as np
    import pyarrow as pa

    word = re.compile("[a-zA-Z0-9]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: dict[str, str] = {}

        def tokens(text: str | None) -> list[str]:
            found = word.findall(text.lower() if text.isascii() else re.sub("[^a-zA-Z0-9]", " ", text).lower()) if text else []
            if stemming:
                for w in found:
                    if w not in stems:
                        stems[w] = stem(w)
                found = [stems[w] for w in found]
                if len(stems) > 500_000:
                    stems.clear()
            return [w for w in found if w not in stops]

        for b in batches:
            rows, terms, freqs, tops, places = [], [], [], [], []
            texts = b.column(b.schema.get_field_index(positioned)).to_pylist()
            others = b.column(b.schema.get_field_index(loose)).to_pylist() if loose else [None] * len(texts)
            for i, (text, other) in enumerate(zip(texts, others)):
                at: dict[str, list[float]] = {}
                for w in tokens(other):
                    at.setdefault(w, []).append(NO_POSITION)
                for k, w in enumerate(tokens(text)):
                    at.setdefault(w, []).append(k)
                if at:
                    top = max(map(len, at.values()))
                    for w, p in at.items():
                        rows.append(i)
                        terms.append(w)
                        freqs.append(len(p))
                        tops.append(top)
                        places += p
            freq = np.array(freqs, "int64")
            tf = freq.astype("float32") / np.array(tops, "float32")
            positions = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(freq)]).astype("int32")), pa.array(np.array(places, "float32")))
            ids = b.column(b.schema.get_field_index("doc_id")).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([field] * len(rows), pa.string()), pa.array(terms, pa.string()), ids, pa.array(freq), pa.array(tf, pa.float32()), positions], ["field", "term", "doc_id", "freq", "tf", "positions"])

    return run


def document_postings(docs: DataFrame, text: str, field: str = "body", stops: Sequence[str] | None = None, stemming: bool = False, loose: str | None = None) -> DataFrame:
    """Postings (field, term, doc_id, freq, tf, positions) of the column ``text``; ``docs`` has one row per doc_id.

    A record is one row, so its tokens are counted where it is read: nothing is shuffled. Tokens of the column ``loose`` count too, but have no position. Null and empty texts give no postings.
    """
    stop = frozenset(stop_words() if stops is None else stops)
    rows = docs.select("doc_id", text, *([loose] if loose else []))
    out = f"field string, term string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, freq bigint, tf float, positions array<float>"
    return rows.mapInArrow(_counting(field, text, loose, stop, stemming), out)


def body_hits(docs: DataFrame, text: Column, stops: Sequence[str] | None = None, stemming: bool = False) -> DataFrame:
    """Body hits of docs with doc_id."""
    return token_positions(docs, laundry(text, stops, stemming), "doc_id").withColumn("field", F.lit("body"))


def own_title_postings(fields: DataFrame, stops: Sequence[str] | None = None, stemming: bool = False) -> DataFrame:
    """Postings of pages' own titles, and of meta terms without a position, of extracted fields."""
    return document_postings(fields.select("doc_id", "title", F.array_join("meta", " ").alias("meta")), "title", "title", stops, stemming, "meta")


def title_hits(fields: DataFrame, stops: Sequence[str] | None = None, stemming: bool = False) -> DataFrame:
    """Own title hits, and hits of meta terms without a position, of extracted fields."""
    own = token_positions(fields, laundry(F.col("title"), stops, stemming), "doc_id")
    meta = fields.select("doc_id", F.explode(laundry(F.array_join("meta", " "), stops, stemming)).alias("term")).withColumn("pos", F.lit(NO_POSITION))
    return own.withColumn("pos", F.col("pos").cast("double")).unionByName(meta).withColumn("field", F.lit("title"))


def anchor_hits(fields: DataFrame, stops: Sequence[str] | None = None, stemming: bool = False) -> DataFrame:
    """(dst, src, term): tokens of anchor texts by the page they point to, as often as they occur."""
    rows = fields.select("doc_id", "url", F.posexplode("anchors").alias("ord", "a")).select("doc_id", "url", "ord", F.array(F.col("a.href")).alias("hrefs"), F.col("a.text").alias("text"))
    links = page_links(rows.withColumn("doc_id", F.struct("doc_id", "text")))
    return links.select("dst", F.col("src.doc_id").alias("src"), F.explode(laundry(F.col("src.text"), stops, stemming)).alias("term"))


def title_postings(own: DataFrame, anchors: DataFrame) -> DataFrame:
    """Title postings (field, term, doc_id, freq, tf, positions): a page's own (from own_title_postings), and for terms it lacks there the anchor texts that point to it.

    The tf of own terms is relative to own terms, that of anchor terms to all anchor terms of the page. Anchor hits are counted before they move, and have the one place
    that stands for none, so that a home page with a third of all links is a few rows. Both halves meet in one aggregation by page and term, so no join is needed.
    """
    theirs = with_tf(anchors.groupBy(F.col("dst").alias("doc_id"), "term").agg(F.count(F.lit(1)).alias("freq")).withColumn("field", F.lit("title")))
    theirs = theirs.select("field", "term", "doc_id", "freq", "tf", F.array(F.lit(NO_POSITION).cast("float")).alias("positions"))
    both = own.withColumn("_own", F.lit(1)).unionByName(theirs.withColumn("_own", F.lit(0)))
    best = both.groupBy("doc_id", "term").agg(F.max_by(F.struct("freq", "tf", "positions"), "_own").alias("p"))
    return best.select(F.lit("title").alias("field"), "term", "doc_id", "p.freq", "p.tf", "p.positions")


def document_frequencies(postings: DataFrame) -> DataFrame:
    """(field, term, df) of distinct postings."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def inverse_frequencies(dfs: DataFrame, n: int) -> DataFrame:
    """Adds idf = log2(n / df) as float32."""
    return dfs.withColumn("idf", F.log2(F.lit(float(n)) / F.col("df").cast("double")).cast("float"))


def term_weights(postings: DataFrame, n: int) -> DataFrame:
    """Postings with weight = tf * idf in float32; n is the number of nodes of the web graph. Running it again changes nothing.

    Frequencies are counted with map-side combining; their table is far smaller than the postings, so Spark broadcasts it if it fits,
    and else splits a skewed term's postings."""
    idf = inverse_frequencies(document_frequencies(postings), n)
    return postings.drop("weight").join(idf.select("field", "term", F.col("idf").alias("_idf")), ["field", "term"]).withColumn("weight", (F.col("tf") * F.col("_idf")).cast("float")).drop("_idf")


def magnitudes(weighted: DataFrame) -> DataFrame:
    """(doc_id, title, body): the Euclidean length of each field's weights, 0 for a field without postings."""
    square = (F.col("weight") * F.col("weight")).cast("float").cast("double")
    part = lambda f: F.sqrt(F.coalesce(F.sum(F.when(F.col("field") == f, square)), F.lit(0.0)))
    return weighted.groupBy("doc_id").agg(part("title").alias("title"), part("body").alias("body"))


def clean_postings(postings: DataFrame) -> DataFrame:
    """Stored postings without repeated rows; the stored weight is dropped."""
    return postings.groupBy("field", "term", "doc_id").agg(F.max("tf").alias("tf"), F.max("positions").alias("positions"))
