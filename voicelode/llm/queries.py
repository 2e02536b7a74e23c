"""Registered queries of this package and their SQL twins."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelode.llm import (
    bfd_pack,
    decontaminate,
    exact_dedup,
    jaccard_join,
    langid,
    lemp,
    license_join,
    maxent_lm,
    mixture_pack,
    nn_descent,
    periodic,
    pieces,
    pii,
)
from voicelode.llm.common import table_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "documents"))


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, and the words that reveal it."""
    return pii.span_table(_documents(spark, sf_dir))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document by word counts and by the maximum-entropy model."""
    return maxent_lm.score_documents(_documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in matrices of 2048 columns."""
    return bfd_pack.pieces(bfd_pack.pack(_documents(spark, sf_dir)))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its shingle set and the number of similar classes."""
    return jaccard_join.link_counts(_documents(spark, sf_dir))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    return langid.identify(_documents(spark, sf_dir))


def op6_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, mixed by source."""
    return mixture_pack.pack(_documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, phrases and license labels of every document."""
    return license_join.scan(_documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays of it."""
    return exact_dedup.copy_groups(_documents(spark, sf_dir))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one, among all."""
    vectors = spark.read.parquet(table_path(sf_dir, "embeddings"))
    return nn_descent.nearest(vectors, F.col("vec_id") % 100 == 0)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by a merge-type vocabulary, and decoded again."""
    return pieces.encode_documents(_documents(spark, sf_dir))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "benchmark"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words and items of the benchmark that it repeats."""
    found = decontaminate.contaminated_places(_documents(spark, sf_dir), _benchmark(spark, sf_dir))
    hit = F.aggregate("places", F.lit(0).cast("long"), lambda n, p: n + p["last"] - p["first"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("places") > 0).alias("contaminated"),
    )


def repeated_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The order of words that the contract of op12 sets for a tenth of the documents; no id is an empty one."""
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document's words, and what is left of it without their repeats."""
    found = periodic.find_runs(_documents(spark, sf_dir), repeated_order)
    by_exponent = lambda a, b: (
        F.when(b["length"] * a["period"] != a["length"] * b["period"], b["length"] * a["period"] - a["length"] * b["period"])
        .when(a["start"] != b["start"], a["start"] - b["start"])
        .otherwise(a["period"] - b["period"])
    )
    best = F.try_element_at(F.array_sort("runs", lambda a, b: F.signum(by_exponent(a, b)).cast("int")), F.lit(1))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))))
    written = F.array_join(F.transform(lines, lambda s: F.concat(s, F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.try_divide(F.col("best.length") * 1000, F.col("best.period"))).cast("long").alias("exponent_milli"),
        F.sha2(written.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty documents with the highest scores for each item of the benchmark."""
    return lemp.search(_documents(spark, sf_dir), _benchmark(spark, sf_dir))


QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op2_lm_scores": op2_lm_scores,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_language": op5_language,
    "op6_mixture_packing": op6_mixture_packing,
    "op7_license_scan": op7_license_scan,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_pieces": op10_pieces,
    "op11_decontamination": op11_decontamination,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_ranked_search": op13_ranked_search,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TEMPLATES = ", ".join(
    f"('{label}', {words!r}, {block})" for label, words, block in license_join.paragraphs(license_join.TEMPLATES)
)
_PLACES = "\n".join(
    f"""select doc_id, '{label}' as label, i - 1 as place from w, unnest(range(1, len(words) + 1)) t(i)
        where words[i:i + {len(phrase.split()) - 1}] = {phrase.split()!r}
        union all"""
    for phrase, label in license_join.PHRASES.items()
).removesuffix("union all")

ORACLES = {
    "op7_license_scan": rf"""
        with w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
        p as ({_PLACES}),
        base as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word,
                        list_distinct(list(label)) as labels
                 from p group by doc_id),
        t(label, words, block) as (values {_TEMPLATES}),
        likely as (select doc_id, label, w.words, t.words as template, block,
                          ceil({license_join.THRESHOLD} * len(t.words) - 1e-9) as need
                   from w, t where len(list_intersect(t.words, w.words)) >= need),
        m as (select doc_id, label, len(list_intersect(template, words[i:i + block - 1])) as shared, need,
                     shared / len(template) as contained
              from likely, unnest(range(1, len(words) + 1)) u(i) where list_contains(template, words[i]) and shared >= need),
        method as (select doc_id, list_distinct(list(label)) as labels, max(contained) as contained
                   from m group by doc_id)
        select w.doc_id, len(words) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
               coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []),
                                                                   coalesce(method.labels, [])))), ',') as labels,
               case when n_base > 0 then 1.0::double else coalesce(contained, 0.0) end as score
        from w left join base using (doc_id) left join method using (doc_id)""",
    "op11_decontamination": rf"""
        with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
              from benchmark where item_id is not null),
        s as (select item, w, least(len(w), {decontaminate.SIZE}) as n from b where len(w) > 0),
        win as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as phrase
                from s, unnest(range(1, len(w) - n + 2)) t(i)),
        sizes as (select distinct n from win),
        g as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as phrase
              from d, sizes, unnest(range(1, len(w) - n + 2)) t(i)),
        hit as (select doc_id, i, n, item from g join win using (n, phrase)),
        places as (select doc_id, count(distinct k) as n_hit from hit, unnest(range(i, i + n)) u(k) group by doc_id),
        items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
                  from (select distinct doc_id, item from hit) group by doc_id)
        select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join places using (doc_id) left join items using (doc_id)""",
    "op13_ranked_search": rf"""
        with t as (select doc_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
                   from documents),
        tf as (select doc_id, term, count(*) as tf from t group by doc_id, term),
        len as (select doc_id, cast(sum(tf) as bigint) as n from tf group by doc_id),
        total as (select count(*) as docs, cast(sum(n) as bigint) as terms from len),
        df as (select term, count(*) as df from tf group by term),
        q as (select distinct item_id,
                     unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
        w as (select item_id, term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as w
              from q join df using (term), total),
        scored as (select item_id, doc_id,
                          cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) as bigint) as score
                   from w join tf using (term) join len using (doc_id), total group by item_id, doc_id),
        ranked as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank,
                          doc_id, score from scored where score > 0)
        select item_id, rank, doc_id, score from ranked where rank <= {lemp.BEST}""",
    "op8_exact_dedup": r"""
        with d as (select doc_id, length(coalesce(text, '')) as n,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
                   from documents)
        select doc_id,
               first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
               count(*) over (partition by text_sha256) as group_size,
               row_number() over (partition by text_sha256 order by n desc, doc_id) = 1 as kept,
               text_sha256
        from d""",
}
