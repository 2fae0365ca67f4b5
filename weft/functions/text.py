"""Tokens: the one definition that indexed text and queries share."""

from __future__ import annotations

import string
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from weft.functions.stem import stem

# Function words of English that are no search terms. A longer list is a parameter (see load_stop_words).
STOP_WORDS = [
    "about", "above", "across", "after", "again", "against", "all", "almost", "alone", "along", "also", "although", "always", "am", "among", "an", "and", "another", "any", "anything",
    "are", "as", "at", "away", "be", "because", "been", "before", "behind", "being", "below", "between", "both", "but", "by", "can", "cannot", "could", "did", "do",
    "does", "done", "down", "during", "each", "either", "else", "enough", "even", "ever", "every", "everything", "few", "for", "from", "further", "had", "has", "have", "having",
    "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "however", "if", "in", "into", "is", "it", "its", "itself", "just", "least", "less",
    "like", "many", "may", "me", "might", "mine", "more", "most", "much", "must", "my", "myself", "neither", "never", "no", "nobody", "none", "nor", "not", "nothing",
    "now", "of", "off", "often", "on", "once", "one", "only", "or", "other", "others", "our", "ours", "out", "over", "own", "per", "quite", "rather", "same",
    "shall", "she", "should", "since", "so", "some", "something", "still", "such", "than", "that", "the", "their", "theirs", "them", "then", "there", "these", "they", "this",
    "those", "though", "through", "thus", "to", "too", "toward", "under", "until", "up", "upon", "us", "very", "was", "we", "were", "what", "when", "where", "whether",
    "which", "while", "who", "whom", "whose", "why", "will", "with", "within", "without", "would", "yet", "you", "your", "yours",
]


def stop_words(extra: Sequence[str] = ()) -> list[str]:
    """The default list: function words, all single letters, and ``extra``."""
    return [*dict.fromkeys([*string.ascii_lowercase, *STOP_WORDS, *extra])]


def load_stop_words(spark: SparkSession, path: str) -> list[str]:
    """A list of the user's own, one word per line; blank lines and repetitions don't count."""
    return [*dict.fromkeys(w for r in spark.read.text(path).collect() if (w := r["value"].strip()))]


def _stem_lists(lists: pd.Series) -> pd.Series:
    memo: dict[str, str] = {}

    def one(w: str) -> str:
        s = memo.get(w)
        if s is None:
            s = memo[w] = stem(w)
        return s

    return lists.map(lambda ws: None if ws is None else [one(w) for w in ws])


def stemmed(tokens: Column) -> Column:
    """The English stems of an array of lower-case tokens, by Arrow batches; each distinct token is stemmed once per batch."""
    return F.pandas_udf(_stem_lists, "array<string>")(tokens)


def split_words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order; everything else separates. Null gives an empty array."""
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^a-zA-Z0-9]", " "))
    return F.filter(F.split(plain, r"\s+"), lambda w: w != "")


def laundry(text: Column, stops: Sequence[str] | None = None, stemming: bool = False) -> Column:
    """Index tokens of a text: words, stemmed if wanted, then without stop words. The stop list meets the stems, as it must stay comparable between both sides."""
    words = split_words(text)
    words = stemmed(words) if stemming else words
    stop = stop_words() if stops is None else list(stops)
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def phrases_of(query: Column) -> Column:
    """The quoted phrases of a query, quotes stripped; an unmatched quote is none, and a phrase does not cross a line end."""
    return F.regexp_extract_all(query, F.lit('"([^\\n]*?)"'), 1)


def without_phrases(query: Column) -> Column:
    return F.regexp_replace(query, '"[^\\n]*?"', "")


def term_hash(term: Column) -> Column:
    return F.md5(term)
