"""Topic expressions: words, phrases and stems of a topic, slugs, relevance of a text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from voicelode import values


def topic_words(topic: Column, stop_words=None) -> Column:
    stop_words = list(stop_words or values.STOP_WORDS)
    found = F.regexp_extract_all(F.lower(topic), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= 2) & ~w.isin(stop_words))


def adjacent_pairs(words: Column) -> Column:
    """Two-word phrases, in order."""
    firsts = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.transform(firsts, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))


def word_variants(words: Column) -> Column:
    """Each word and its other number: a long word in -s loses it, any other gains it."""
    other_number = F.transform(
        words,
        lambda w: F.when(
            F.endswith(w, F.lit("s")) & (F.length(w) > 3), F.left(w, F.length(w) - 1)
        ).otherwise(F.concat(w, F.lit("s"))),
    )
    return F.sort_array(F.array_union(words, other_number))


def topic_terms(topic: Column) -> dict[str, Column]:
    words = topic_words(topic)
    return {
        "words": words,
        "phrases": adjacent_pairs(words),
        "stems": word_variants(words),
    }


def topic_slugs(topic: Column, slugs=None, default=None) -> Column:
    """Launch-site slugs of a topic, sorted; the default slugs when no word is known."""
    slugs = slugs or values.TOPIC_SLUGS
    default = default or values.DEFAULT_SLUGS
    lookup = F.create_map(
        *[part for word, names in slugs.items()
          for part in (F.lit(word), F.array(*map(F.lit, names)))]
    )
    words = F.array_distinct(F.regexp_extract_all(F.lower(topic), F.lit("[a-z]+"), F.lit(0)))
    known = F.flatten(F.array_compact(F.transform(words, lambda w: F.try_element_at(lookup, w))))
    fallback = F.array(*map(F.lit, default))
    return F.sort_array(F.array_distinct(F.when(F.size(known) > 0, known).otherwise(fallback)))


@dataclass(frozen=True)
class TopicTerms:
    """Terms of one topic as plain values, ready to be written into expressions."""

    words: list[str]
    phrases: list[str]
    stems: list[str]

    @staticmethod
    def of(spark: SparkSession, topic: str) -> "TopicTerms":
        row = spark.range(1).select(
            *[expr.alias(name) for name, expr in topic_terms(F.lit(topic)).items()]
        ).first()
        return TopicTerms(row["words"], row["phrases"], row["stems"])


def _graded(phrase_hits: Column, stem_hits: Column, n_words: Column) -> Column:
    # fixed values: 0.6 + 0.2 per phrase up to 1; single stem 0.1; all words 0.4; some 0.15
    by_phrase = F.least(F.lit(1.0), F.lit(0.6) + F.lit(0.2) * phrase_hits)
    return (
        F.when(phrase_hits >= 1, by_phrase)
        .when(stem_hits == 0, F.lit(0.0))
        .when((stem_hits == 1) & (n_words > 1), F.lit(0.1))
        .when(stem_hits >= n_words, F.lit(0.4))
        .otherwise(F.lit(0.15))
    )


def topic_relevance(text: Column, terms: TopicTerms | None) -> Column:
    """Relevance of a text to one topic; 1.0 without a topic."""
    if terms is None:
        return F.lit(1.0)

    def hits(needles):
        found = [F.contains(text, F.lit(n)).cast("int") for n in needles]
        return reduce(lambda a, b: a + b, found, F.lit(0))

    return _graded(hits(terms.phrases), hits(terms.stems), F.lit(len(terms.words)))


def topic_relevance_by_row(text: Column, words: Column, phrases: Column, stems: Column) -> Column:
    """Relevance of a text to the topic whose terms stand in the same row."""

    def hits(needles):
        return F.size(F.filter(needles, lambda n: F.contains(text, n)))

    return _graded(hits(phrases), hits(stems), F.size(words))


def topic_keywords(topic: str) -> list[str]:
    """Lower-case letter runs of two letters or more, for the any-of keyword filter."""
    letters = "".join(c if "a" <= c <= "z" else " " for c in topic.lower())
    return [w for w in letters.split() if len(w) >= 2]
