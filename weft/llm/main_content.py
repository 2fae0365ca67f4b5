"""Main content and spam over whole tables of pages: the page model trained once, then one pass over the pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.boilerplate import Model, NoLabels, Page
from weft.llm.spam import is_spam
from weft.llm.training import fit
from weft.operators.skew import balanced_join, heavy_hitters


def _judge(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, memo = shared.value, {}
        for b in batches:
            out = []
            for d, u, h in zip(b["doc_id"].tolist(), b["url"].tolist(), b["html"].tolist()):
                page = Page(h, u)
                marginals = model.marginals(page, memo)
                spam = is_spam(page, marginals, model.prose)
                keep = [] if spam else [i for i in page.leaves if marginals[i] > 0.5]
                out.append((d, spam, [page.nodes[i].block for i in keep], " ".join(page.nodes[i].text for i in keep)))
            yield pd.DataFrame(out, columns=["doc_id", "spam", "blocks", "main_text"])

    return run


JUDGED = "doc_id string, spam boolean, blocks array<int>, main_text string"


def judge_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, spam, blocks array<int>, main_text) for each row of ``pages``; the blocks of main content and their text.

    Spam pages have no main content. Rows without doc_id or html are left out; an empty page has no blocks. Rows repeated under one
    doc_id give repeated rows. Without ``model`` one is trained on all of the pages that are labelled; if none is, and there are pages, NoLabels is raised.
    """
    rows = pages.where("doc_id is not null and html is not null").select("doc_id", "url", "html")
    try:
        model = model or fit(pages)
    except NoLabels:
        if not rows.isEmpty():
            raise
        return pages.sparkSession.createDataFrame([], JUDGED)
    return rows.mapInPandas(_judge(pages.sparkSession.sparkContext.broadcast(model)), JUDGED)


def main_blocks(judged: DataFrame, page_blocks: DataFrame) -> DataFrame:
    """(doc_id, block_no) of the blocks of main content, as far as ``page_blocks`` has them."""
    kept = judged.select("doc_id", F.explode("blocks").alias("block_no")).distinct()
    return kept.join(page_blocks.select("doc_id", "block_no"), ["doc_id", "block_no"], "left_semi")


def clean_summaries(judged: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_id, result_id) of the ``results`` whose summary, apart from dots at its ends, stands word for word in its page's main text.

    Null, empty and merely dotted summaries are left out; blanks compare as one.
    """
    mains = judged.where("main_text <> ''").groupBy("doc_id").agg(F.concat(F.lit(" "), F.min("main_text"), F.lit(" ")).alias("_main"))
    s = F.regexp_replace(F.regexp_replace("summary", r"\s+", " "), r"^[. …]+|[. …]+$", "")
    asked = results.where("summary is not null and doc_id is not null").select("doc_id", "result_id", s.alias("_s")).where("_s <> ''")
    # Texts are wide: at most 50 pages, those that hold a fiftieth of all results each, are broadcast.
    both = balanced_join(asked, mains, "doc_id", "inner", heavy_hitters(asked, "doc_id", 0.02))
    begins = F.concat(F.lit(" "), F.col("_s"))
    hit = F.contains("_main", F.concat(begins, F.lit(" "))) | F.contains("_main", F.concat(begins, F.lit("."))) | F.contains("_main", F.concat(begins, F.lit("…")))
    return both.where(hit).select("doc_id", "result_id").distinct()
