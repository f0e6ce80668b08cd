"""Category codes and (entity, topic) pair encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.config import (CATEGORICAL, DAY, GROUP, ID, LABELS, PAIR_MIN_SUPPORT, PAIR_SHRINK,
                             TOPICS, TRAINER)
from tidemark.functions.fields import entity, topic_tokens
from tidemark.functions.probability import smoothed
from tidemark.operators.folds import Fold, first_training_fold
from tidemark.operators.ranking import ordered_position
from tidemark.sources.workspace import Parts, part

PAIR_KINDS = {"trainer": TRAINER, "group": GROUP, "ward": "ward"}


def category_codes(tables: list[DataFrame], columns: list[str], missing: str = "UNKNOWN"
                   ) -> DataFrame:
    """Codes 0..k-1 of the sorted distinct values of each column over all tables.

    One distinct over (column, value) pairs and one distributed sort serve all columns.
    """
    values = None
    for table in tables:
        cells = table.select(F.inline(_cells(columns, missing)))
        values = cells if values is None else values.unionByName(cells)
    placed = ordered_position(values.distinct(), ["col"], [F.col("value")], "_pos")
    return placed.select("col", "value", (F.col("_pos") - 1).cast("int").alias("code"))


def _cells(columns: list[str], missing: str):
    return F.array(*[F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("value"))
                     for c in columns])


def fold_code(number: int) -> str:
    return f"fold_{number}"


def fold_codes(train: DataFrame, history: DataFrame | None, columns: list[str], folds: list[Fold], missing: str = "UNKNOWN") -> DataFrame:
    """``category_codes`` of every fold's training rows, and of a history that all folds see: ``code`` holds a field per fold.

    Training sets are nested, so a value is listed once with the first fold that sees it; in earlier folds its code is -1.
    """
    values = train.select(first_training_fold(folds, F.col(DAY)).alias("first"), F.inline(_cells(columns, missing))).where("first is not null")
    if history is not None:
        first = min(folds, key=lambda f: f.cutoff).number
        values = values.unionByName(history.select(F.lit(first).alias("first"), F.inline(_cells(columns, missing))))
    seen = values.groupBy("col", "value").agg(F.min("first").alias("first"))
    later = F.array(*[F.lit(f.number) for f in folds])
    spread = seen.select("col", "value", F.explode(F.filter(later, lambda f: f >= F.col("first"))).alias("fold"))
    placed = ordered_position(spread, ["fold", "col"], [F.col("value")], "_pos")
    own = [F.coalesce(F.max(F.when(F.col("fold") == f.number, F.col("_pos") - 1)), F.lit(-1)).cast("int").alias(fold_code(f.number)) for f in folds]
    return placed.groupBy("col", "value").agg(F.struct(*own).alias("code"))


def attach_codes(rows: DataFrame, codes: DataFrame | Parts, columns: list[str],
                 names: dict[str, str] | None = None, missing: str = "UNKNOWN") -> DataFrame:
    """Add one code column per category column; unseen values get -1, in every fold where codes are by fold."""
    for c in columns:
        name = (names or {}).get(c, f"{c}_code")
        side = part(codes, "col", c).select(F.col("value").alias("_value"), F.col("code").alias(name))
        value = F.coalesce(F.col(c).cast("string"), F.lit(missing))
        kind = side.schema[name].dataType
        unseen = F.struct(*[F.lit(-1).alias(f) for f in kind.names]) if isinstance(kind, StructType) else F.lit(-1)
        rows = (rows.withColumn("_value", value).join(side, "_value", "left").drop("_value")
                .withColumn(name, F.coalesce(name, unseen)))
    return rows


def _pairs(rows: DataFrame, *extra) -> DataFrame:
    kinds = [F.struct(F.lit(kind).alias("kind"), entity(kind, F.col(col)).alias("key"))
             for kind, col in PAIR_KINDS.items()]
    topics = rows.select(*extra, F.array(*kinds).alias("_kinds"),
                         F.explode(topic_tokens(F.col(TOPICS))).alias("topic"))
    return topics.select("*", F.inline("_kinds")).drop("_kinds")


def pair_encoding(train: DataFrame, folds: list[Fold] | None = None,
                  shrink: float = PAIR_SHRINK) -> DataFrame:
    """Shrunken label rate per (kind, entity, topic) on training rows, per fold if given."""
    hits = [F.sum(y).alias(f"s{h}") for h, y in LABELS.items()]
    first = F.lit(0) if folds is None else first_training_fold(folds, F.col(DAY))
    tagged = train.withColumn("_part", first).where(F.col("_part").isNotNull())
    counts = (_pairs(tagged, "_part", *LABELS.values())
              .groupBy("_part", "kind", "key", "topic").agg(F.count(F.lit(1)).alias("n"), *hits))
    totals = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), *hits)
    sums = [F.sum("n").alias("n"), *[F.sum(f"s{h}").alias(f"s{h}") for h in LABELS]]
    later = F.array(*[F.lit(f.number) for f in folds or [Fold(0, 0.0, 0.0)]])

    def spread(df: DataFrame, *keys: str) -> DataFrame:
        if folds is None:
            return df.withColumnRenamed("_part", "fold")
        wide = df.withColumn("fold", F.explode(F.filter(later, lambda f: f >= F.col("_part"))))
        return wide.groupBy("fold", *keys).agg(*sums)

    rates = spread(totals).select("fold", *[(F.col(f"s{h}") / F.col("n")).alias(f"g{h}")
                                            for h in LABELS])
    # The rate side holds one row per fold.
    out = spread(counts, "kind", "key", "topic").join(F.broadcast(rates), "fold")
    out = out.select("fold", "kind", "key", "topic", "n", *[f"g{h}" for h in LABELS], *[
        smoothed(F.col(f"s{h}"), F.col("n"), F.col(f"g{h}"), shrink).alias(f"rate{h}")
        for h in LABELS])
    return out if folds is not None else out.drop("fold")


def pair_features(rows: DataFrame, encoding: DataFrame, overall: dict[str, float],
                  min_support: int = PAIR_MIN_SUPPORT, row_id: str = ID) -> DataFrame:
    """Per row and kind: mean pair rate over its topics, the overall rate for thin or unseen pairs.

    ``encoding`` is the pair table of one training set, ``overall`` its label rates.
    """
    enough = encoding.where(F.col("n") >= min_support).drop("n", *[f"g{h}" for h in LABELS])
    means = [F.avg(F.when(F.col("kind") == kind, F.coalesce(f"rate{h}", F.lit(overall[h]))))
             .alias(f"{kind}_topic_mean_p{h}") for kind in PAIR_KINDS for h in LABELS]
    found = (_pairs(rows, row_id).join(enough, ["kind", "key", "topic"], "left")
             .groupBy(row_id).agg(*means))
    out = rows.join(found, row_id, "left")
    return out.withColumns({f"{kind}_topic_mean_p{h}": F.coalesce(
        f"{kind}_topic_mean_p{h}", F.lit(overall[h])) for kind in PAIR_KINDS for h in LABELS})


def label_rates(rows: DataFrame) -> dict[str, float]:
    """Overall label rates as three driver scalars."""
    row = rows.agg(*[F.avg(y).alias(h) for h, y in LABELS.items()]).first()
    return {h: float(row[h]) for h in LABELS}
