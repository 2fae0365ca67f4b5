"""Document records as JSON: RFC 1123 dates, links as text, tolerant reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOC = "url string, title array<string>, mod_date string, page_size bigint, children array<string>, parents map<string,array<string>>, words map<string,bigint>"
_RFC1123 = "EEE, dd MMM yyyy HH:mm:ss"


def rfc1123(ts: Column) -> Column:
    """A UTC instant in whole seconds, as 'Mon, 02 Jan 2006 15:04:05 UTC'; the session's time zone must be UTC."""
    return F.concat(F.date_format(ts, _RFC1123), F.lit(" UTC"))


def parse_rfc1123(text: Column) -> Column:
    """The instant of an RFC 1123 date in UTC or GMT; null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(text, r"^\w{3},\s*|\s*(UTC|GMT)\s*$", ""), F.lit("dd MMM yyyy HH:mm:ss"))


def to_json(docs: DataFrame) -> DataFrame:
    """(doc_id, json) of records."""
    fields = [c.split()[0] for c in DOC.replace("map<string,", "map<string;").split(", ")]
    row = F.struct(*[rfc1123(F.col("mod_date")).alias("mod_date") if c == "mod_date" else F.col(c) for c in fields])
    return docs.select("doc_id", F.to_json(row).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """Records of (doc_id, json). Unknown keys are passed over, missing ones are null, null parent lists become empty; text that is no JSON gives nulls."""
    r = rows.select("doc_id", F.from_json("json", DOC).alias("d")).select("doc_id", "d.*")
    return r.withColumn("mod_date", parse_rfc1123(F.col("mod_date"))).withColumn("parents", F.transform_values("parents", lambda k, v: F.coalesce(v, F.array().cast("array<string>"))))
