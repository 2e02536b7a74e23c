"""URL expressions: tracking-parameter removal and platform recognition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voicelode import values


def clean_url(url: Column) -> Column:
    """Drop query parameters whose name starts with `utm_` and write the others anew.

    The fragment begins at the first `#`, the query at the first `?` before it.  Empty parts go,
    a name without value gets an empty one, and a repeated name keeps its values together at its
    first place.  An empty query or fragment is left out with its mark.
    """
    cut = F.instr(url, "#")
    head = F.when(cut > 0, F.left(url, cut - 1)).otherwise(url)
    fragment = F.when(cut > 0, F.substring(url, cut + 1, F.length(url))).otherwise(F.lit(""))
    mark = F.instr(head, "?")
    base = F.when(mark > 0, F.left(head, mark - 1)).otherwise(head)
    query = F.when(mark > 0, F.substring(head, mark + 1, F.length(head))).otherwise(F.lit(""))

    def decoded(part: Column) -> Column:
        return F.coalesce(F.try_url_decode(part), part)

    def encoded(part: Column) -> Column:
        # the marks that form encoding and URL encoding treat differently
        return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    def pair(part: Column) -> Column:
        at = F.instr(part, "=")
        return F.struct(
            decoded(F.when(at > 0, F.left(part, at - 1)).otherwise(part)).alias("name"),
            decoded(F.when(at > 0, F.substring(part, at + 1, F.length(part))).otherwise(F.lit(""))).alias("value"),
        )

    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)
    pairs = F.filter(pairs, lambda p: ~F.startswith(p["name"], F.lit("utm_")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    together = F.flatten(F.transform(names, lambda n: F.filter(pairs, lambda p: p["name"] == n)))
    kept = F.array_join(
        F.transform(together, lambda p: F.concat(encoded(p["name"]), F.lit("="), encoded(p["value"]))), "&"
    )
    return F.concat(
        base,
        F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


def platform_of_url(url: Column, mode: str = "substring", marks=None) -> Column:
    """Platform a URL belongs to, or null.

    `substring` looks for the marks anywhere in the URL.  `host` compares the host
    name only, so `foox.com` is no longer taken for `x.com`.
    """
    marks = marks or values.PLATFORM_URL_MARKS
    if mode == "substring":
        subject = F.lower(url)

        def hit(mark):
            return F.contains(subject, F.lit(mark))

    elif mode == "host":
        subject = F.lower(F.try_parse_url(url, F.lit("HOST")))

        def hit(mark):
            return (subject == mark) | F.endswith(subject, F.lit("." + mark))

    else:
        raise ValueError(f"unknown mode: {mode}")

    chain = None
    for platform, needles in marks:
        found = F.lit(False)
        for needle in needles:
            found = found | hit(needle)
        chain = F.when(found, platform) if chain is None else chain.when(found, platform)
    return chain


def platforms_of_urls(urls: Column, mode: str = "substring") -> Column:
    """Sorted distinct platforms of an array of URLs."""
    names = F.transform(
        F.coalesce(urls, F.array().cast("array<string>")), lambda u: platform_of_url(u, mode)
    )
    return F.sort_array(F.array_distinct(F.array_compact(names)))
