"""Raw log fields to contract columns, and the string tokens built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import CATEGORICAL, GROUP, PERSON, TOPICS, TRAINER

STRINGS = "array<string>"
UNKNOWN = "UNKNOWN"
MISSING = "__NA__"


def parse_date(raw: Column) -> Column:
    """Date of a text field; anything unreadable becomes NULL."""
    return F.try_to_timestamp(raw).cast("date")


def _listing(raw: Column) -> Column:
    # Single-quoted list literals are valid input of the lenient JSON reader.
    return F.from_json(raw, STRINGS, {"mode": "PERMISSIVE"})


def trainer_name(raw: Column) -> Column:
    """One trainer string per row: plain ids stay, list literals are joined by commas."""
    text = F.trim(raw)
    parsed = _listing(text)
    joined = F.array_join(F.transform(parsed, lambda t: F.trim(t)), ",")
    return (F.when(raw.isNull(), UNKNOWN)
            .when(text.startswith("TRA_"), text)
            .when(text.startswith("[") & parsed.isNotNull(), joined)
            .otherwise(text))


def topic_array(raw: Column) -> Column:
    """Flat or nested list literal to a sorted array of distinct trimmed topics."""
    outer = _listing(F.trim(raw))
    nested = F.transform(
        outer,
        lambda item: F.when(item.startswith("["), _listing(item)).otherwise(F.array(item)))
    flat = F.transform(F.flatten(nested), lambda t: F.trim(t))
    return F.coalesce(F.array_sort(F.array_distinct(flat)), F.array().cast(STRINGS))


def topic_count(topics: Column) -> Column:
    return F.coalesce(F.size(topics), F.lit(0))


def has_topic(topics: Column) -> Column:
    return (topic_count(topics) > 0).cast("int")


def keyword_flags(topics: Column, keywords: dict[str, list[str]]) -> dict[str, Column]:
    """Per category: 1 when any topic holds any keyword, ignoring case."""
    text = F.lower(F.array_join(topics, "\n"))

    def flag(words: list[str]) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        return F.coalesce(hit, F.lit(False)).cast("int")

    return {f"topic_cat_{name}": flag(words) for name, words in keywords.items()}


def topic_text(topics: Column) -> Column:
    return F.array_join(topics, " ")


def flag(value: Column) -> Column:
    """1 or 0 from 0/1 or true/false in any case; NULL for anything else."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("1", "true"), 1).when(text.isin("0", "false"), 0).cast("int")


def known(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(UNKNOWN))


def safe_text(value: Column) -> Column:
    text = F.trim(value.cast("string"))
    return F.when(text.isNull() | (text == ""), MISSING).otherwise(text)


def entity(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), safe_text(value))


def topic_tokens(topics: Column) -> Column:
    """Topic tokens: spaces become underscores, the whole topic is kept, blanks are dropped."""
    named = F.filter(F.transform(topics, safe_text), lambda t: t != MISSING)
    cut = F.transform(named, lambda t: F.concat(
        F.lit("topic_"), F.replace(t, F.lit(" "), F.lit("_"))))
    return F.coalesce(cut, F.array().cast(STRINGS))


def entity_tokens() -> dict[str, Column]:
    return {"trainer": entity("trainer", F.col(TRAINER)), "group": entity("group", F.col(GROUP)),
            "county": entity("county", F.col("county")),
            "subcounty": entity("subcounty", F.col("subcounty")),
            "ward": entity("ward", F.col("ward"))}


def person_token() -> Column:
    return safe_text(F.col(PERSON))

