"""Per-key results and joins when a few keys hold most of the rows.

Heavy keys are found with a mergeable top-k sketch (every partition sends a sketch of fixed size), never
by counting all keys. Rows of heavy keys meet their side of the join by broadcast, which is bounded by
the number of heavy keys; all other rows go through an ordinary shuffle; the two halves are united.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sketch size, and the share of all rows from which a key counts as heavy.
TRACKED = 10_000
MIN_SHARE = 0.002
#: No more keys than this are ever broadcast; with MIN_SHARE they can't be more than 1 / MIN_SHARE anyway.
MAX_HEAVY = 500


def heavy_hitters(df: DataFrame, key: str, min_share: float = MIN_SHARE, tracked: int = TRACKED) -> list:
    """Keys that hold about ``min_share`` or more of the rows of ``df``; nulls never count.

    An empty table gives an empty list. The result has at most ``MAX_HEAVY`` keys. It is a hint for the plan:
    a key missed or named needlessly changes no result, only the way its rows take.
    """
    k = min(MAX_HEAVY, max(1, int(1 / min_share)))
    row = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {k}, {max(tracked, k)})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    least = max(2.0, row["n"] * min_share)
    return [x["item"] for x in row["top"] or [] if x["count"] >= least]


def _split(df: DataFrame, key: str, heavy: Sequence) -> tuple[DataFrame, DataFrame]:
    hot = F.coalesce(F.col(key).isin(list(heavy)), F.lit(False))
    return df.where(hot), df.where(~hot)


def balanced_join(facts: DataFrame, dim: DataFrame, key: str, how: str = "left", heavy: Sequence | None = None) -> DataFrame:
    """``facts`` joined with ``dim`` on ``key``; ``how`` is 'inner', 'left', 'left_semi' or 'left_anti'.

    ``dim`` must have few rows for any one key (normally one), ``facts`` may have any number. Null keys match
    nothing. Columns other than ``key`` that occur on both sides keep the fact's name and lose the dim's.
    """
    heavy = heavy_hitters(facts, key) if heavy is None else heavy
    dim = dim.select(key, *[c for c in dim.columns if c not in facts.columns])
    if not heavy:
        return facts.join(dim, key, how)
    hot, rest = _split(facts, key, heavy)
    hot_dim = dim.where(F.col(key).isin(list(heavy)))
    # An ordinary hash join of the rest can't be skewed: no key of it holds more than MIN_SHARE of the rows.
    return hot.join(F.broadcast(hot_dim), key, how).unionByName(rest.join(dim, key, how))


def per_key(facts: DataFrame, dim: DataFrame, key: str, aggs: Sequence[Column], carry: Sequence[str] = (), min_share: float = MIN_SHARE) -> DataFrame:
    """One row per key of ``facts``: ``aggs`` over its rows, the ``carry`` columns of ``dim`` and ``heavy``.

    ``aggs`` must be aggregates that combine partially (count, sum, min, max, max_by ...): heavy keys are combined
    within each task before anything moves, so a key that holds a third of all rows sends one row per task.
    Null keys are left out; a key without a row in ``dim`` gets nulls; an empty table gives no rows.
    """
    heavy = heavy_hitters(facts, key, min_share)
    facts = facts.where(F.col(key).isNotNull())
    dim = dim.select(key, *carry).dropDuplicates([key])
    hot, rest = _split(facts, key, heavy)
    cold = rest.groupBy(key).agg(*aggs).join(dim, key, "left").withColumn("heavy", F.lit(False))
    if not heavy:
        return cold
    warm = hot.join(F.broadcast(dim.where(F.col(key).isin(list(heavy)))), key, "left").groupBy(key, *carry).agg(*aggs)
    return warm.withColumn("heavy", F.lit(True)).select(cold.columns).unionByName(cold)


def map_entries_of(docs: DataFrame, name: str, *keep: str) -> DataFrame:
    """(map_key, map_value, *keep) for every entry of the map column ``name``; null and empty maps give none."""
    return docs.select(*keep, F.explode(name).alias("map_key", "map_value"))


def key_profile(docs: DataFrame, terms: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """Results per term of ``docs.words`` and per parent of ``docs.parents``.

    Columns: map_name, map_key, label (the word, or a URL of the parent page), n_rows (rows of docs with
    the key), total (sum of frequencies, or of anchor tokens), top_doc (the row with the greatest value,
    of equals the smallest doc_id), rows_with_map (rows of docs whose map is not empty), heavy.
    All rows count, repeated ones too. Null anchor lists count as no tokens.
    """
    words = map_entries_of(docs, "words", "doc_id")
    parents = map_entries_of(docs, "parents", "doc_id").withColumn("map_value", F.coalesce(F.size("map_value"), F.lit(0)).cast("bigint")).withColumn("map_value", F.greatest("map_value", F.lit(0)))
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.sum("map_value").alias("total"), F.min(F.struct((-F.col("map_value")).alias("v"), F.col("doc_id").alias("d"))).alias("_top")]
    word_dim = terms.select(F.col("term_hash").alias("map_key"), F.col("term").alias("label"))
    page_dim = docs.where("url is not null").groupBy(F.col("doc_id").alias("map_key")).agg(F.min("url").alias("label"))
    rows = docs.agg(F.count_if(F.size("words") > 0).alias("words"), F.count_if(F.size("parents") > 0).alias("parents")).first()
    parts = [
        per_key(facts, dim, "map_key", aggs, ["label"], min_share).select(F.lit(name).alias("map_name"), "map_key", "label", "n_rows", "total", F.col("_top.d").alias("top_doc"), F.lit(rows[name]).cast("bigint").alias("rows_with_map"), "heavy")
        for name, facts, dim in (("words", words, word_dim), ("parents", parents, page_dim))
    ]
    return parts[0].unionByName(parts[1])
