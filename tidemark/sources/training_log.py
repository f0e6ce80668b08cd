"""The training log: one row per person and dated event, with three nested adoption labels.

The log is derived from the order tables (FIXTURES.md, section 3). Every join key is either a
unique key of a large table (shuffled by Spark, skew split by adaptive execution) or a small
dimension whose file size lets the planner broadcast it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import DATE, DAY, GROUP, HORIZONS, ID, LABELS, PERSON, TOPICS, TRAINER
from tidemark.sources import workspace

HISTORY_SHARE = 0.4
LABEL_SPAN = max(HORIZONS.values())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_day(ts: Column) -> Column:
    return F.unix_date(ts.cast("date"))


def order_topics(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Per order: distinct sorted part names and the supplier of its first line.

    Both aggregates combine on the map side, so an order that owns a large share of all lines
    shrinks to its distinct names before the shuffle.
    """
    lines = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
    named = lines.join(part.select("p_partkey", "p_name"),
                       F.col("l_partkey") == F.col("p_partkey"), "left")
    supplier = F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey"))
    return named.groupBy("l_orderkey").agg(
        F.concat(F.lit("TRA_"), supplier).alias(TRAINER),
        F.sort_array(F.collect_set("p_name")).alias(TOPICS),
    )


def next_event_day(events: DataFrame, key: str, day: str = DAY) -> DataFrame:
    """Per (key, day): the next later day with an event of the same key.

    Works on distinct days, so the window of one key never exceeds the calendar, however many
    events that key owns.
    """
    days = events.select(key, day).where(F.col(key).isNotNull()).distinct()
    order = Window.partitionBy(key).orderBy(day)
    return days.withColumn("next_day", F.lead(day).over(order))


def horizon_labels(next_day: Column, day: Column) -> dict[str, Column]:
    """Label per horizon: the next event lies within that many days (nested by construction)."""
    return {LABELS[h]: F.coalesce((next_day - day <= n).cast("int"), F.lit(0))
            for h, n in HORIZONS.items()}


def age_band(balance: Column) -> Column:
    return (F.when(balance < 0, "A0").when(balance < 2500, "A1").when(balance < 5000, "A2")
            .when(balance < 7500, "A3").otherwise("A4"))


def build_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(ID), "o_custkey", "o_orderstatus", "o_orderpriority",
        F.col("o_orderdate").cast("date").alias(DATE), epoch_day(F.col("o_orderdate")).alias(DAY))
    lo, hi = orders.agg(F.min(DAY), F.max(DAY)).first()
    train_from = lo + int(HISTORY_SHARE * (hi - lo))
    train_to = hi - LABEL_SPAN

    places = (table(spark, sf_dir, "nation")
              .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
              .select("n_nationkey", "n_name", "r_name"))
    people = (table(spark, sf_dir, "customer")
              .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
              .select("c_custkey", "c_acctbal", "c_mktsegment", "n_name", "r_name"))
    # Person attributes travel on the (person, day) calendar: orders are then shuffled by both
    # columns, which spreads a person that owns a large share of all orders.
    calendar = (next_event_day(orders, "o_custkey")
                .join(people, F.col("o_custkey") == F.col("c_custkey"), "left"))
    topics = order_topics(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"))

    rows = (orders.join(calendar, ["o_custkey", DAY], "left")
            .join(topics, F.col(ID) == F.col("l_orderkey"), "left"))
    labels = horizon_labels(F.col("next_day"), F.col(DAY))
    return rows.select(
        ID,
        F.concat(F.lit("F"), F.col("o_custkey")).alias(PERSON),
        DATE, DAY,
        F.coalesce(TRAINER, F.lit("UNKNOWN")).alias(TRAINER),
        F.coalesce(TOPICS, F.array().cast("array<string>")).alias(TOPICS),
        F.col("c_mktsegment").alias("gender"),
        F.col("o_orderstatus").alias("registration"),
        age_band(F.col("c_acctbal")).alias("age"),
        F.col("r_name").alias("county"),
        F.col("n_name").alias("subcounty"),
        F.concat_ws("_", "n_name", "c_mktsegment").alias("ward"),
        F.concat_ws("_", "c_mktsegment", "o_orderpriority").alias(GROUP),
        (F.col("c_acctbal") >= 5000).cast("int").alias("belong_to_cooperative"),
        (F.size(F.coalesce(TOPICS, F.array())) > 0).cast("int").alias("has_topic_trained_on"),
        *[expr.alias(name) for name, expr in labels.items()],
        F.when(F.col(DAY) < train_from, "prior").when(F.col(DAY) <= train_to, "train")
        .otherwise("test").alias("period"),
    )


class TrainingLog:
    """Accessor over the written log of one table folder: all rows, or one period."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def rows(self) -> DataFrame:
        return workspace.shared(self.spark, f"log:{self.sf_dir}",
                                lambda: build_log(self.spark, self.sf_dir), ["period"])

    def _period(self, name: str) -> DataFrame:
        return self.rows().where(F.col("period") == name).drop("period")

    @property
    def prior(self) -> DataFrame:
        return self._period("prior")

    @property
    def train(self) -> DataFrame:
        return self._period("train")

    @property
    def test(self) -> DataFrame:
        return self._period("test").drop(*LABELS.values())
