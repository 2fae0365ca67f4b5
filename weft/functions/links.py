"""Which links count, and where they lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings of links to media files.
MEDIA = [".mp3", ".pdf", ".png", ".jpg", ".mp4", ".avi", ".zip", ".pptx", ".ppt", ".rar", ".doc", ".docx", ".tar", ".gz", ".xz", ".bz", ".7z"]


def trimmed(href: Column) -> Column:
    """Without one slash at the end."""
    return F.regexp_replace(href, "/$", "")


def accepted(href: Column) -> Column:
    """Whether a link counts: not empty, no place within the page, no script or mail address, no media file, not '/' alone."""
    t = trimmed(href)
    media = F.lit(False)
    for m in MEDIA:
        media = media | F.endswith(F.lower(t), F.lit(m))
    no = (href == "") | href.startswith("#") | href.startswith("javascript") | href.startswith("mailto") | media | (t == "")
    return F.coalesce(~no, F.lit(False))


def host_of(url: Column) -> Column:
    """The host without the port."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)


def scheme_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)


def resolved(href: Column, base: Column) -> Column:
    """The target of an accepted link on the page ``base``: as it is if it begins with http or www., below the host if it begins with a slash,
    else below the page. Line ends and blanks are taken out; the port is dropped for links below the host; '..' stays."""
    t = trimmed(href)
    full = F.when(t.startswith("http") | t.startswith("www."), t).when(t.startswith("/"), F.concat(scheme_of(base), F.lit("://"), host_of(base), t)).otherwise(F.concat(base, F.lit("/"), t))
    return F.regexp_replace(F.regexp_replace(full, "\r?\n", ""), " ", "")


def page_links(fields: DataFrame) -> DataFrame:
    """(src, ord, href, dst_url, dst) for every accepted link in page order; ord counts all links of the page from 0.

    A link that names its own page in full is no link. Links are repeated as often as they occur."""
    rows = fields.select(F.col("doc_id").alias("src"), "url", F.posexplode("hrefs").alias("ord", "href")).where(accepted(F.col("href")))
    out = rows.withColumn("dst_url", resolved(F.col("href"), F.col("url"))).where(~(F.coalesce(trimmed(F.col("href")) == F.col("url"), F.lit(False))))
    return out.select("src", "ord", "href", "dst_url", F.md5("dst_url").alias("dst"))
