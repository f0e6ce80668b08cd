"""The feature matrix: lookup tables are fitted and written once, then joined to any rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.config import (BINARY, CATEGORICAL, DATE, DAY, ID, LABELS, PERSON, PROFILE_KEYS,
                             TOPICS, TRAINER, VETTED, FeatureGroups)
from tidemark.functions import fields
from tidemark.functions.calendar import date_parts
from tidemark.operators import encoding, lookback, profiles
from tidemark.operators.folds import Fold
from tidemark.operators.interactions import interactions
from tidemark.sources.workspace import Parts, materialise

_CARRIED = [ID, DAY, *LABELS.values()]
# Column metadata that names the blocks a feature belongs to.
_BLOCKS = "blocks"


@dataclass(frozen=True)
class FittedTables:
    """Lookup tables of one history and training set, stored by column or key. The planner sizes
    each on its own, so a small lookup is broadcast however large another one is."""

    history: DataFrame
    codes: Parts
    people: DataFrame | None
    keys: Parts | None


def fit(history: DataFrame, train: DataFrame, groups: FeatureGroups = VETTED, folds: list[Fold] | None = None) -> FittedTables:
    """With ``folds``, codes are fitted on the training rows of each fold; the history must be one that all of them see."""
    names = CATEGORICAL + [TRAINER]
    codes = Parts(encoding.category_codes([train, history], names) if folds is None else encoding.fold_codes(train, history, names, folds), "codes", "col")
    people = keys = None
    if groups.person_history:
        people = materialise(profiles.person_profile(history), "people")
    if groups.aggregates or groups.confidence:
        counts = materialise(profiles.key_counts(history, list(PROFILE_KEYS)), "keycounts")
        make = (profiles.full_profile if groups.aggregates and groups.confidence else
                profiles.key_profile if groups.aggregates else profiles.confidence_profile)
        keys = Parts(make(counts), "keys", "key_name")
    return FittedTables(history, codes, people, keys)


def transform(rows: DataFrame, fitted: FittedTables, groups: FeatureGroups = VETTED) -> DataFrame:
    """The matrix of ``rows``: row id, day, labels if present, and numeric features (NULL -> 0).

    Category columns hold their codes under their own names, those of all folds if they were fitted by fold (``of_fold`` takes out one's).
    """
    carried = [c for c in _CARRIED if c in rows.columns]
    x, made = rows, {}

    def add(columns: dict, block: str) -> None:
        nonlocal x
        x = x.withColumns(columns)
        made.update({c: (block,) for c in columns})

    def extend(wider: DataFrame, block: str) -> None:
        nonlocal x
        before = set(x.columns)
        x = wider
        made.update({c: (block,) for c in wider.columns if c not in before})

    # Joins on the person and on the row come first: they shuffle the rows, which are still narrow then.
    early = {}
    for block, on, attach in (("person_history", groups.person_history, lambda: x.join(fitted.people.withColumn("has_prior_history", F.lit(1)), PERSON, "left")),
                              ("recency", groups.recency, lambda: lookback.recency_intensity(x, fitted.history)),
                              ("quality", groups.quality, lambda: lookback.topic_novelty(x, fitted.history))):
        before, made = made, {}
        if on:
            extend(attach(), block)
        early[block], made = made, before
    if groups.direct:
        extend(encoding.attach_codes(x, fitted.codes, CATEGORICAL), "direct")
        add({c: F.col(c).cast("int") for c in BINARY}, "direct")
    if groups.dates:
        add(date_parts(F.col(DATE)), "dates")
    if groups.topics:
        add({"topic_count": fields.topic_count(F.col(TOPICS)),
             **fields.keyword_flags(F.col(TOPICS), groups.keywords)}, "topics")
        if "has_topic_trained_on" in made:
            made["has_topic_trained_on"] += ("topics",)
        else:
            add({"has_topic_trained_on": fields.has_topic(F.col(TOPICS))}, "topics")
    if groups.trainer:
        extend(encoding.attach_codes(x, fitted.codes, [TRAINER], {TRAINER: "trainer_encoded"}), "trainer")
        add({"has_multiple_trainers": F.coalesce(F.col(TRAINER).contains(",").cast("int"),
                                                 F.lit(0))}, "trainer")
    made.update(early["person_history"])
    if groups.aggregates or groups.confidence:
        before = set(x.columns)
        x = profiles.attach_all(x, fitted.keys)
        made.update({c: profiles.blocks_of(c) for c in x.columns if c not in before})
    if groups.interactions:
        extend(interactions(x), "interactions")
    made.update(early["recency"] | early["quality"])
    kinds = {f.name: f.dataType for f in x.schema.fields}
    return x.select(*carried, *[(F.col(c) if isinstance(kinds[c], StructType) else F.coalesce(F.col(c), F.lit(0))).alias(
        c.removesuffix("_code"), metadata={_BLOCKS: list(blocks)}) for c, blocks in made.items()])


def of_fold(whole: DataFrame, number: int, groups: FeatureGroups) -> DataFrame:
    """One fold's matrix out of one whose codes were fitted by fold. That one has no interactions, as some take codes: they are made here,
    in their place among the columns."""
    x = whole.select(*[F.col(f.name)[encoding.fold_code(number)].alias(f.name, metadata=f.metadata) if isinstance(f.dataType, StructType)
                       else F.col(f.name) for f in whole.schema.fields])
    if not groups.interactions:
        return x
    wider = interactions(x)
    last = [f.name for f in x.schema.fields if {"recency", "quality"} & set(f.metadata.get(_BLOCKS, ()))]
    return wider.select(*[c for c in x.columns if c not in last],
                        *[F.coalesce(F.col(c), F.lit(0)).alias(c, metadata={_BLOCKS: ["interactions"]}) for c in wider.columns if c not in x.columns], *last)


def feature_names(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if c not in _CARRIED and c not in ("fold", "role", "weight")]


def columns_by_block(matrix: DataFrame) -> dict[str, list[str]]:
    """Feature columns of each block, as ``transform`` recorded them; files keep the record."""
    out: dict[str, list[str]] = {}
    for field in matrix.schema.fields:
        for block in field.metadata.get(_BLOCKS, ()):
            out.setdefault(block, []).append(field.name)
    return out


def block_columns(matrix: DataFrame, groups: FeatureGroups) -> list[str]:
    """The columns of a wide matrix that the given blocks would have produced."""
    on = {c for block, columns in columns_by_block(matrix).items() if getattr(groups, block) for c in columns}
    return [c for c in matrix.columns if c in on]
