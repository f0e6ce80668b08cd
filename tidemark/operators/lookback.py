"""Range look-backs: what happened strictly before a row's day, for its key.

Counts are aggregated to (key, day) before any window runs. The window of one key then holds at
most one row per calendar day, so a key that owns a third of all rows costs no more than any
other; the result joins back on (key, day), which spreads such a key over its days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DAY, GROUP, ID, LOOKBACK_DAYS, NO_HISTORY_DAYS, PERSON, TOPICS
from tidemark.sources.workspace import materialise

_COUNT = "_events"


def day_grid(probe: DataFrame, history: DataFrame, key: str | None, day: str = DAY) -> DataFrame:
    """Every (key, day) of the probe or the history with its number of history events."""
    keys = [key] if key else []
    seen = history.select(*keys, day, F.lit(1).alias(_COUNT))
    asked = probe.select(*keys, day, F.lit(0).alias(_COUNT))
    grid = seen.unionByName(asked).where(F.col(day).isNotNull())
    if key:
        grid = grid.where(F.col(key).isNotNull())
    return grid.groupBy(*keys, day).agg(F.sum(_COUNT).alias(_COUNT))


def _frames(key: str | None, day: str):
    base = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy(day)

    def count(first: int, last: int) -> Column:
        return F.coalesce(F.sum(_COUNT).over(base.rangeBetween(first, last)), F.lit(0))

    earlier = base.rangeBetween(Window.unboundedPreceding, -1)
    last_day = F.max(F.when(F.col(_COUNT) > 0, F.col(day))).over(earlier)
    return count, last_day


def _attach(probe: DataFrame, side: DataFrame, key: str | None, day: str) -> DataFrame:
    if key is None:
        # The calendar side is written first: its true size lets the planner broadcast it, so the
        # rows need not be shuffled by day.
        return probe.join(materialise(side, "calendar"), [day], "left")
    return probe.join(side, [key, day], "left")


def recency_intensity(probe: DataFrame, history: DataFrame, key: str = PERSON,
                      day: str = DAY) -> DataFrame:
    """Days since the last event, counts of 30 and 90 days, and 30-day momentum."""
    count, last_day = _frames(key, day)
    c30, before30 = count(-30, -1), count(-60, -31)
    momentum = F.when(before30 > 0, (c30 - before30) / before30).otherwise(c30.cast("double"))
    side = day_grid(probe, history, key, day).select(
        key, day,
        F.coalesce(F.col(day) - last_day, F.lit(NO_HISTORY_DAYS)).alias("days_since_last_training"),
        c30.alias("trainings_last_30d"), count(-90, -1).alias("trainings_last_90d"),
        momentum.alias("recent_training_momentum"))
    fill = {"days_since_last_training": NO_HISTORY_DAYS, "trainings_last_30d": 0,
            "trainings_last_90d": 0, "recent_training_momentum": 0.0}
    out = _attach(probe, side, key, day)
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()})


def rolling_counts(probe: DataFrame, history: DataFrame, days: list[int] = LOOKBACK_DAYS,
                   day: str = DAY) -> DataFrame:
    """Events of the last N days: overall, of the person, of the group."""
    out = probe
    for key, label in ((None, ""), (PERSON, "farmer_"), (GROUP, "group_")):
        count, _ = _frames(key, day)
        names = {n: f"rolling_{label}training_count_{n}d" for n in days}
        side = day_grid(probe, history, key, day).select(
            *([key] if key else []), day, *[count(-n, -1).alias(c) for n, c in names.items()])
        out = _attach(out, side, key, day)
        out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in names.values()})
    return out


def lag_days(probe: DataFrame, history: DataFrame, lags: list[int] = LOOKBACK_DAYS,
             day: str = DAY) -> DataFrame:
    """Days since the previous event (overall, of the person): 0 inside the lag, 999 for none."""
    out = probe
    for key, label in ((None, "last_training"), (PERSON, "farmer_last_training")):
        _, last_day = _frames(key, day)
        gap = F.col(day) - F.col("_last")
        names = {n: f"days_since_{label}_{n}d" for n in lags}
        side = (day_grid(probe, history, key, day)
                .select(*([key] if key else []), day, last_day.alias("_last"))
                .select(*([key] if key else []), day,
                        *[F.when(gap <= n, 0).otherwise(gap).alias(c) for n, c in names.items()]))
        out = _attach(out, side, key, day)
        out = out.withColumns({c: F.coalesce(c, F.lit(NO_HISTORY_DAYS)) for c in names.values()})
    return out


def first_seen_topics(history: DataFrame, key: str = PERSON, day: str = DAY) -> DataFrame:
    """First day each person met each lower-cased topic."""
    return (history.where(F.col(key).isNotNull() & F.col(day).isNotNull())
            .select(key, day, F.explode(TOPICS).alias("_topic"))
            .groupBy(key, F.lower("_topic").alias("_topic")).agg(F.min(day).alias("_seen")))


def topic_novelty(probe: DataFrame, history: DataFrame, key: str = PERSON,
                  day: str = DAY, row_id: str = ID) -> DataFrame:
    """Diversity, novelty and repeat share of a row's topics against the person's past topics.

    A topic is a repeat when its first day lies before the row's day, so the past is looked up by
    an equi-join on (person, topic) instead of gathering a person's topics into one array.
    """
    lowered = F.transform(TOPICS, F.lower)
    current = probe.select(row_id, key, day, F.explode(F.array_distinct(lowered)).alias("_topic"))
    met = (current.join(first_seen_topics(history, key, day), [key, "_topic"], "left")
           .groupBy(row_id).agg(F.count(F.lit(1)).alias("_distinct"),
                                F.sum((F.coalesce(F.col("_seen") < F.col(day), F.lit(False)))
                                      .cast("int")).alias("_repeats")))
    # A person has a past at a row's day when the person's first event lies before it.
    first = (history.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(day).alias("_first")))
    out = probe.join(met, row_id, "left").join(first, key, "left")
    past = F.coalesce(F.col("_first") < F.col(day), F.lit(False))
    empty = F.coalesce(F.size(TOPICS), F.lit(0)) == 0
    unique = F.col("_distinct")
    return out.withColumns({
        "topic_diversity": F.when(empty, 0.0).when(~past, 1.0)
        .otherwise(unique / F.size(TOPICS)),
        "topic_novelty": F.when(empty, 0.0).when(~past, 1.0)
        .otherwise((unique - F.col("_repeats")) / unique),
        "repeat_topic_ratio": F.when(empty | ~past, 0.0).otherwise(F.col("_repeats") / unique),
    }).drop("_distinct", "_repeats", "_first")
