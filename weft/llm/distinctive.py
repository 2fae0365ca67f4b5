"""How characteristic a term is of a record: hypergeometric enrichment with false-discovery adjustment."""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SMALL = np.array([lgamma(i + 1.0) for i in range(64)])


def log_factorial(x: np.ndarray) -> np.ndarray:
    """log(x!) of whole numbers: a table below 64, Stirling's series from there (relative error under 1e-15)."""
    x = np.asarray(x, "float64")
    z = np.maximum(x, 63.0) + 1.0
    series = (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return np.where(x < 64, _SMALL[np.clip(x, 0, 63).astype("int64")], series)


def log_upper_tail(k: np.ndarray, n: np.ndarray, K: np.ndarray, N: np.ndarray) -> np.ndarray:
    """log P(X >= k), X hypergeometric: n draws of N of which K are marked. All arguments are whole.

    The point probability comes from log-gamma sums; the rest of the tail from ratios of successive terms, added until no
    term counts any more in double precision. Below the mean the lower tail is summed instead. k <= 0 gives 0.
    """
    k, n, K, N = (np.asarray(v, "float64") for v in (k, n, K, N))

    out = np.zeros(len(k))
    most, least = np.minimum(K, n), np.maximum(0.0, n + K - N)
    out[k > most] = -np.inf
    todo = (k > least) & (k <= most)
    up = todo & (k >= n * K / np.maximum(N, 1))
    for upper, lanes in ((True, np.flatnonzero(up)), (False, np.flatnonzero(todo & ~up))):
        if not len(lanes):
            continue
        i = k[lanes].copy() if upper else k[lanes] - 1
        with np.errstate(divide="ignore", invalid="ignore"):
            first = log_pmf_at(i, n[lanes], K[lanes], N[lanes])
        total, term, live = np.ones(len(lanes)), np.ones(len(lanes)), np.arange(len(lanes))
        while len(live):
            a, nn, kk, big = i[live], n[lanes[live]], K[lanes[live]], N[lanes[live]]
            ratio = (kk - a) * (nn - a) / ((a + 1) * (big - kk - nn + a + 1)) if upper else a * (big - kk - nn + a) / ((kk - a + 1) * (nn - a + 1))
            term[live] *= np.maximum(ratio, 0)
            total[live] += term[live]
            i[live] += 1 if upper else -1
            live = live[term[live] > total[live] * 1e-17]
        tail = np.log(total) + first
        out[lanes] = tail if upper else np.log1p(-np.minimum(np.exp(tail), 1 - 1e-16))
    return np.minimum(out, 0.0)


def log_pmf_at(i: np.ndarray, n: np.ndarray, K: np.ndarray, N: np.ndarray) -> np.ndarray:
    """log P(X = i)."""
    choose = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(np.maximum(a - b, 0))
    return choose(K, i) + choose(N - K, n - i) - choose(N, n)


SCORED = "field string, term string, doc_id binary, tf float, occ bigint, df bigint, log_p double, score double"


def _score_rows(df: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    """Scores whole records, which begin at ``starts``."""
    occ = df["occ"].to_numpy("float64")
    sizes = np.diff([*starts, len(df)])
    record = np.repeat(np.arange(len(starts)), sizes)
    log_p = log_upper_tail(occ, np.add.reduceat(occ, starts)[record], df["_of_term"].to_numpy("float64"), df["_of_all"].to_numpy("float64"))
    order = np.lexsort((log_p, record))
    rank = np.arange(len(df)) - starts[record] + 1
    q = log_p[order] + np.log(sizes[record]) - np.log(rank)
    for a, n in zip(starts.tolist(), sizes.tolist()):
        q[a : a + n] = np.minimum.accumulate(q[a : a + n][::-1])[::-1]
    score = np.empty(len(df))
    score[order] = np.maximum(-q, 0.0) + 0.0
    return df[["field", "term", "doc_id", "tf", "occ", "df"]].assign(log_p=log_p, score=score)


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one record follow each other; a record that goes on into the next batch waits for it."""
    waiting: list[pd.DataFrame] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        f, d = b["field"].to_numpy(), b["doc_id"].to_numpy()
        new = np.ones(len(b), bool)
        new[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
        new[0] = last != (f[0], d[0])
        starts = np.flatnonzero(new)
        last = (f[-1], d[-1])
        if not len(starts):
            waiting.append(b)
            continue
        cut = int(starts[-1])
        whole = pd.concat([*waiting, b.iloc[:cut]], ignore_index=True) if waiting else b.iloc[:cut]
        if len(whole):
            shift = sum(map(len, waiting))
            yield _score_rows(whole, np.array([*([0] if waiting else []), *(starts[:-1] + shift)], "int64"))
        waiting = [b.iloc[cut:]]
    if waiting:
        whole = pd.concat(waiting, ignore_index=True)
        yield _score_rows(whole, np.zeros(1, "int64"))


def packed_id(doc_id: Column) -> Column:
    """An id as bytes: a hash of 32 hexadecimal digits takes half the room, any other text stays as it is; the first byte tells which."""
    return F.when(doc_id.rlike("^[0-9a-f]{32}$"), F.concat(F.lit(bytearray(b"\x01")), F.unhex(doc_id))).otherwise(F.concat(F.lit(bytearray(b"\x00")), F.encode(doc_id, "UTF-8")))


def unpacked_id(packed: Column) -> Column:
    """The id behind packed_id."""
    rest = F.substring(packed, 2, 2_147_483_647)
    return F.when(F.substring(packed, 1, 1) == F.lit(bytearray(b"\x01")), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def enrichment(entries: DataFrame, single: DataFrame | None = None) -> DataFrame:
    """Scores every (field, term, doc_id) of ``entries`` (field, term, doc_id, occ bigint, tf float), and of ``single``, entries of other fields that are known to
    stand there once each, so that they need no shuffle to be made so.

    Within a field the collection is an urn of all occurrences. For a term with K occurrences in a collection of N, a
    record of n occurrences holds k of them by chance with a hypergeometric probability; p is that of k or more. The
    p-values of a record's terms are adjusted together by Benjamini and Hochberg's rule; score = -ln(adjusted p).

    Columns: field, term, doc_id, tf, occ, df (records with the term), log_p, score. Repeated rows count once (of unequal
    ones that with the greatest occ, then tf). Rows with null field, term or doc_id are left out; null or negative occ counts as 0
    and scores 0. Equal p-values get equal scores. An empty table gives no rows.
    """
    key = ["field", "term", "doc_id"]
    count = F.coalesce(F.greatest("occ", F.lit(0)), F.lit(0)).cast("bigint").alias("occ")
    clean = lambda df: df.where("field is not null and term is not null and doc_id is not null").select("field", "term", packed_id(F.col("doc_id")).alias("doc_id"), count, "tf")
    # One aggregate that both uses below need whole: so they share its shuffle.
    base = clean(entries).groupBy(*key).agg(F.max(F.struct("occ", "tf")).alias("x")).select(*key, "x.occ", "x.tf")
    if single is not None:
        base = base.unionByName(clean(single))
    per_term = base.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("occ").alias("_of_term"))
    totals = per_term.groupBy("field").agg(F.sum("_of_term").alias("_of_all"))
    # The dictionary is small beside the postings; Spark broadcasts it only when its measured size allows.
    joined = base.join(per_term.join(totals, "field"), ["field", "term"])
    # Chance and adjustment both need the whole record: one shuffle brings it together, one pass of Arrow batches does both.
    scored = joined.select(*key, "tf", "occ", "df", "_of_term", "_of_all").repartition("field", "doc_id").sortWithinPartitions("field", "doc_id").mapInPandas(_score, SCORED)
    return scored.select("field", "term", unpacked_id(F.col("doc_id")).alias("doc_id"), "tf", "occ", "df", "log_p", "score")


def postings_entries(postings: DataFrame) -> DataFrame:
    """Postings as entries; a posting's occurrences are its positions."""
    return postings.select("field", "term", "doc_id", F.size("positions").cast("bigint").alias("occ"), "tf")


def words_entries(docs: DataFrame) -> DataFrame:
    """docs.words as entries with field 'words'; of a page's rows the one written last counts, of equals the greatest seq."""
    last = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max_by("words", F.struct("written_at", "seq")).alias("words"))
    top = F.array_max(F.map_values("words")).cast("double")
    rows = last.select("doc_id", top.alias("_top"), F.explode("words").alias("term", "occ"))
    return rows.select(F.lit("words").alias("field"), "term", "doc_id", "occ", F.try_divide(F.col("occ").cast("double"), F.col("_top")).cast("float").alias("tf"))
