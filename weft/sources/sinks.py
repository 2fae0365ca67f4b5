"""Results as JSON lines, and a plain report of documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.sources.codec import rfc1123


def as_json(results: DataFrame) -> DataFrame:
    """(value): one JSON object per row; nulls are left out."""
    return results.select(F.to_json(F.struct(*results.columns)).alias("value"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, value): per document its title, URL, date and size, words with counts and children; documents of size 0 or unknown size are left out."""
    words = F.array_join(F.transform(F.array_sort(F.map_entries("words")), lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string"))), "; ")
    lines = F.concat_ws("\n", F.array_join("title", " "), "url", F.concat(rfc1123(F.col("mod_date")), F.lit(", "), F.col("page_size").cast("string")), words, F.array_join(F.coalesce("children", F.array().cast("array<string>")), "\n"))
    return docs.where("page_size > 0").select("doc_id", lines.alias("value"))


def cards(results: DataFrame) -> DataFrame:
    """Results as shown: the date only, the score to two places; rows without a URL are left out."""
    return results.where("url is not null and url <> ''").withColumn("mod_day", F.date_format("mod_date", "yyyy-MM-dd")).withColumn("shown_rank", F.round("final_rank", 2))


def highlighted(text: Column, terms: Sequence[str], begin: str = "<b>", end: str = "</b>") -> Column:
    """``text`` with the first occurrence of each term, whatever its case, between ``begin`` and ``end``. Of occurrences that overlap the first is marked. Null stays null."""
    found = F.array(*[F.struct(F.instr(F.lower(text), F.lit(t.lower())).alias("at"), F.lit(len(t)).alias("n")) for t in dict.fromkeys(t.lower() for t in terms) if t])
    places = F.array_sort(F.filter(found, lambda x: x["at"] > 0)) if any(terms) else F.array().cast("array<struct<at:int,n:int>>")

    def mark(state: Column, x: Column) -> Column:
        more = F.concat(state["out"], F.substring(text, state["next"], x["at"] - state["next"]), F.lit(begin), F.substring(text, x["at"], x["n"]), F.lit(end))
        free = x["at"] >= state["next"]
        return F.struct(F.when(free, more).otherwise(state["out"]).alias("out"), F.when(free, x["at"] + x["n"]).otherwise(state["next"]).alias("next"))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
    return F.aggregate(places, start, mark, lambda s: F.concat(s["out"], F.substring(text, s["next"], F.length(text))))


def dump(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, value): every row of every table as one JSON object, for looking at an index as a whole; nulls are left out."""
    df = None
    for name, t in tables.items():
        one = as_json(t).select(F.lit(name).alias("table"), "value")
        df = one if df is None else df.unionByName(one)
    return df
