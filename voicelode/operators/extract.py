"""Extraction of findings: prompts per batch, the model call, parsing of responses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelode import schemas, values
from voicelode.functions.text import strip
from voicelode.operators.ranking import PAYLOAD_FIELDS, analysis_payload, number_rows
from voicelode.operators.scoring import compute_once
from voicelode.scratch import materialize
from voicelode.settings import Settings

PROMPT = """You are given community posts on the topic "{topic}" as a JSON array.
List the separate problems that users describe. Put posts with the same problem together.

Answer with a JSON array only. Each element is an object with these fields:
- description: the problem in one sentence
- category: one of {categories}
- emotional_intensity: from 1 (mild) to 5 (extreme)
- payment_signal: true if someone says they would pay, otherwise false
- payment_quote: the words that show it, or null
- current_workaround: what users do today, or null
- unique_users: how many different users report it; one user counts once
- representative_quotes: up to 3 quotes
- source_urls: the URLs of all posts behind it

A wish for something that does not exist weighs more than an annoyance. Workarounds with
several tools or manual steps deserve attention. Leave out complaints about the site that
hosts the post.

Posts:
{posts_json}"""


def build_prompts(
    batched: DataFrame, settings: Settings = Settings(), template: str = PROMPT
) -> DataFrame:
    """One prompt per topic and batch; a batch has at most `batch_size` posts."""
    payload = analysis_payload(batched, settings, keep=["topic", "batch", "rank"])
    posts = F.sort_array(F.collect_list(F.struct("rank", F.struct(*PAYLOAD_FIELDS).alias("post"))))
    grouped = payload.groupBy("topic", "batch").agg(
        F.to_json(F.transform(posts, lambda p: p["post"]), {"pretty": "true"}).alias("posts_json")
    )
    filled = F.lit(template.replace("{categories}", ", ".join(values.PAIN_CATEGORIES)))
    prompt = F.replace(filled, F.lit("{topic}"), F.col("topic"))
    prompt = F.replace(prompt, F.lit("{posts_json}"), F.col("posts_json"))
    return grouped.select("topic", "batch", prompt.alias("prompt"))


def call_model(prompts: DataFrame, fn: Callable[[str], str]) -> DataFrame:
    """(topic, batch, response, error): one call per prompt, a failing call is kept as error.

    Prompts are spread over the executors, and the responses are written down, so that no
    later step or retry of a later step calls the model again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers, errors = [], []
            for prompt in frame["prompt"]:
                try:
                    answers.append(fn(prompt))
                    errors.append(None)
                except Exception as problem:  # any failure of the model skips its batch
                    answers.append(None)
                    errors.append(str(problem))
            yield frame[["topic", "batch"]].assign(response=answers, error=errors)

    # a fixed number of partitions, which adaptive execution leaves apart
    cores = prompts.sparkSession.sparkContext.defaultParallelism
    spread = prompts.repartition(cores, "topic", "batch")
    schema = "topic string, batch int, response string, error string"
    return materialize(spread.mapInPandas(run, schema), "responses")


def response_text(response: Column) -> Column:
    """The JSON part of a response: without code fence, language mark and outer spaces."""
    text = strip(response)
    opened = F.when(
        F.startswith(text, F.lit("```")),
        F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise(
            F.regexp_replace(text, "^```", "")
        ),
    ).otherwise(text)
    closed = F.regexp_replace(opened, r"```\z", "")
    return strip(F.regexp_replace(closed, r"^json", ""))


def _with_items(responses: DataFrame) -> DataFrame:
    """Add `items`, the array of a readable response; its text is cut out and parsed once per row."""
    cut = compute_once(responses, {"_text": response_text(F.col("response"))})
    text = F.col("_text")
    # A bare object would also parse as one item, so the outer brackets are required.  The parser stops
    # behind the first value; as a field in front of another one the array must be the whole text.
    is_array = F.startswith(text, F.lit("[")) & F.endswith(text, F.lit("]"))
    framed = F.concat(F.lit('{"items":'), text, F.lit(',"whole":true}'))
    parsed = F.from_json(framed, f"items {schemas.RESPONSE_ITEMS}, whole boolean")
    read = compute_once(cut, {"_read": F.when(is_array, parsed)})
    items = F.when(F.coalesce(F.col("_read.whole"), F.lit(False)), F.col("_read.items"))
    return read.withColumn("items", items).drop("_text", "_read")


def parse_responses(responses: DataFrame) -> DataFrame:
    """Findings of all readable responses, in batch order, with `ord` as their number.

    An unreadable response contributes nothing; see `rejected_responses`.
    """
    item = F.col("item")

    def whole(name):
        return item[name].try_cast("double").try_cast("int").alias(name)

    quotes = F.transform(
        item["representative_quotes"],
        lambda q: F.coalesce(F.get_json_object(q, "$.text"), q),
    )
    parsed = (
        _with_items(responses)
        .select("topic", "batch", F.posexplode_outer("items").alias("pos", "item"))
        .filter("item is not null")
        .select(
            "topic", "batch", "pos",
            item["description"].alias("description"),
            item["category"].alias("category"),
            whole("emotional_intensity"),
            F.lower(item["payment_signal"]).isin("true", "yes", "1").alias("payment_signal"),
            item["payment_quote"].alias("payment_quote"),
            item["current_workaround"].alias("current_workaround"),
            whole("unique_users"),
            quotes.alias("representative_quotes"),
            item["source_urls"].alias("source_urls"),
        )
    )
    return number_rows(parsed, [F.col("topic"), F.col("batch"), F.col("pos")], "ord")


def rejected_responses(responses: DataFrame) -> DataFrame:
    """Batches without a readable response, with the reason."""
    reason = F.when(F.col("response").isNull(), F.coalesce("error", F.lit("no response"))).when(
        F.col("items").isNull(), F.lit("not a JSON array")
    )
    return _with_items(responses).withColumn("reason", reason).filter("reason is not null").select(
        "topic", "batch", "reason", "response"
    )


def extract_points(
    batched: DataFrame, fn: Callable[[str], str], settings: Settings = Settings()
) -> DataFrame:
    """Findings of batched posts, by the caller's model function."""
    return parse_responses(call_model(build_prompts(batched, settings), fn))
