"""Text expressions, inside the JVM but for token_counter()."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern, the words of embeddings and shingles, and the stop words of the sparse index.
TOKEN = r"(?i)\d+(?:[./]\d+)*(?:\(\d+\))*[a-z]?|[a-z]+(?:[-'][a-z]+)*"
WORD = r"(?U)\w+"
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this",
    "to", "was", "were", "which", "with", "what", "does", "do", "should", "shall", "may", "can", "how", "when", "where", "who", "whom", "whose", "why",
]
# Page-number lines, and lines that begin a block of their own.
PAGE_NUMBER = r"(?i)^\s*(page\s*)?\d{1,4}(\s*(/|of)\s*\d{1,4})?\s*$"
BLOCK_START = r"^([•\-–▪*]|\(?[a-z0-9]{1,3}[.)]|\d+(\.\d+)*\s)"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often a lambda inside use reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squash(text: Column) -> Column:
    """Stripped, with one space for each run of white space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sparse_tokens(text: Column) -> Column:
    """Lower-case index terms with multiplicity: identifiers such as 13(1), 2015/849 and 18a stay whole."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)
    return F.filter(found, lambda t: ~t.isin(STOPWORDS))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """White-space tokens, the default tokenizer."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def token_counter(count: Callable[[list[str]], list[int]]) -> Callable[[Column], Column]:
    """token_count() by a tokenizer of one's own, such as a BPE: count gives the number of tokens of each of some texts."""
    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        known = texts.notna().tolist()
        counts = iter(count(texts[texts.notna()].tolist()))
        return pd.Series([next(counts) if k else None for k in known], dtype="Int32")

    return run


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct word n-grams; a text of fewer words has its whole sequence, even if empty, as its one shingle."""
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1))
    return let(words(text), lambda w: F.array_distinct(F.transform(starts(w), lambda i: F.array_join(F.slice(w, i, n), " "))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def text_hash(text: Column) -> Column:
    return F.sha1(squash(F.lower(text)))


def line_key(line: Column) -> Column:
    """Digits masked, so that running heads with page numbers compare equal."""
    return F.regexp_replace(F.lower(strip(line)), r"\d+", "#")


def index_text(text: Column, section: Column, title: Column | None = None, authority: Column | None = None) -> Column:
    """What is indexed of a chunk: with a title and an authority, a header that names its origin."""
    if title is None:
        return F.concat(text, F.lit(" "), F.coalesce(section, F.lit("")))
    return F.concat(authority, F.lit(" — "), title, F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" — "), section)).otherwise(""), F.lit("\n"), text)


def point_id(chunk_id: Column) -> Column:
    """UUID version 5 of a chunk id in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), chunk_id.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def chunk_id(document_id: Column, strategy: Column, position: Column) -> Column:
    return F.format_string("%s:%s:%05d", document_id, strategy, position)


def cache_key(model: Column, text: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("\x00"), text), 256)
