"""Text expressions: scoring text, HTML clean-up, word sets, Jaccard."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voicelode import values


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    """Remove leading and trailing white space, Unicode spaces included."""
    edge = f"^[{values.SPACE_CLASS}]+|[{values.SPACE_CLASS}]+$"
    return F.regexp_replace(col, edge, "")


def scoring_text(title: Column, body: Column) -> Column:
    """Lower-cased title and body with one space between, even when one is empty."""
    return F.lower(F.concat(text_or_empty(title), F.lit(" "), text_or_empty(body)))


def count_terms(text: Column, terms) -> Column:
    """How many of `terms` occur in `text` as substrings, each counted at most once.

    One `contains` per term in one projection: no shuffle, no Python, inside
    whole-stage codegen.
    """
    total = F.lit(0)
    for term in terms:
        total = total + F.contains(text, F.lit(term)).cast("int")
    return total


def _entity_decoder():
    # a local function travels to the executors by value, so they need no copy of this package
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return F.pandas_udf(decode, T.StringType())


def decode_entities(col: Column) -> Column:
    """Decode HTML entities.

    Texts that only hold the common entities stay in the JVM.  The Arrow function
    receives a null for those, so only texts with a rare entity cross to Python.
    """
    names = "|".join(entity[1:-1] for entity, _ in values.COMMON_ENTITIES)
    rare = F.when(col.rlike(f"&(?!(?:{names});)"), col)
    common = col
    for entity, char in values.COMMON_ENTITIES:
        common = F.replace(common, F.lit(entity), F.lit(char))
    return F.coalesce(_entity_decoder()(rare), common)


def clean_html(col: Column) -> Column:
    """Plain text of an HTML fragment: entities, then `<p>`, then every other tag, then strip."""
    text = decode_entities(text_or_empty(col))
    text = F.regexp_replace(text, "<p>", "\n")
    text = F.regexp_replace(text, "<[^>]+>", "")
    return strip(text)


def word_set(col: Column) -> Column:
    """Distinct lower-cased words, sorted, so that equal sets are equal arrays."""
    words = F.split(F.lower(text_or_empty(col)), f"[{values.SPACE_CLASS}]+")
    return F.sort_array(F.array_remove(F.array_distinct(words), ""))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two word sets; 0.0 when either is empty."""
    shared = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right) - shared
    either_empty = (F.size(left) == 0) | (F.size(right) == 0)
    return F.when(either_empty, F.lit(0.0)).otherwise(shared / total)


def truthy(col: Column) -> Column:
    """True for a text that is neither null nor empty."""
    return F.coalesce(col != "", F.lit(False))
