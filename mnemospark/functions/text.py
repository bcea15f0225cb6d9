"""Scalar text functions: normal forms, hashes, tokens and set similarity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII = "^[\\x00-\\x7F]*$"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).rstrip())


@F.pandas_udf(T.StringType())
def _canonical(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).casefold())


def normalize_content(text: Column) -> Column:
    """NFC without trailing white space; ASCII stays in the JVM."""
    return F.when(text.rlike(ASCII), F.regexp_replace(text, "[\\s\\x1C-\\x1F]+$", "")).otherwise(_nfc(text))


def canonical_text(text: Column) -> Column:
    """NFKC, single spaces, case folded; ASCII stays in the JVM."""
    plain = F.lower(F.trim(F.regexp_replace(text, "[\\s\\x1C-\\x1F]+", " ")))
    return F.when(text.rlike(ASCII), plain).otherwise(_canonical(text))


def content_hash(text: Column) -> Column:
    """SHA-256 hex; null counts as the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def hash_parts(*parts: Column) -> Column:
    """SHA-256 hex of the parts joined by U+001F; a null part is the empty text, unlike in concat_ws."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def tokens(text: Column) -> Column:
    """Distinct lower-cased [A-Za-z0-9_]+; null has none."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 if both are empty, 0 if one is."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(any_ == 0, F.lit(1.0)).otherwise(both / any_)


def coverage(cue: Column, doc: Column) -> Column:
    """Share of the cue's tokens that the document has; 0 where either has none."""
    return F.when((F.size(cue) == 0) | (F.size(doc) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(cue, doc)) / F.size(cue))


def token_f1(a: Column, b: Column) -> Column:
    hit = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (hit == 0), F.lit(0.0)).otherwise(2.0 * hit / total)


def same(a: Column, b: Column) -> Column:
    """1 if equal in canonical form, two nulls included, else 0."""
    return F.when(canonical_text(a).eqNullSafe(canonical_text(b)), F.lit(1.0)).otherwise(F.lit(0.0))


def _plain(x: Column) -> Column:
    """Like canonical_text, within arrays, where Python functions can't be; compatibility forms stay as they are."""
    return F.lower(F.trim(F.regexp_replace(x, "[\\s\\x1C-\\x1F]+", " ")))


def qualifier_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two maps' canonical pairs."""
    return jaccard(qualifier_pairs(a), qualifier_pairs(b))


def qualifier_pairs(q: Column) -> Column:
    """The canonical key=value strings of a map, sorted."""
    entries = F.map_entries(F.coalesce(q, F.create_map().cast("map<string,string>")))
    return F.array_sort(F.transform(entries, lambda e: F.concat(_plain(e["key"]), F.lit("="), _plain(e["value"]))))


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up, 1 at least; 0 for the empty text."""
    n = F.octet_length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.ceil(n / 4)))
