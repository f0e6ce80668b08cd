"""Registered queries: log, direct features, folds, profiles, encodings, look-backs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import (CATEGORICAL, DATE, DAY, ENCODED_KEYS, GATING_KEYS, GROUP, ID, LABELS,
                             LOOKBACK_DAYS, PART_KEYWORDS, PERSON, PROFILE_KEYS, TOPICS, TRAINER)
from tidemark.functions import fields
from tidemark.functions.calendar import date_parts
from tidemark.operators import encoding, folds, lookback, profiles
from tidemark.plans.oracle import DAY_OF, labels, sql
from tidemark.plans.scores import log_folds
from tidemark.sources import workspace
from tidemark.sources.training_log import TrainingLog, build_log, epoch_day, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def history_and_train(log: TrainingLog) -> DataFrame:
    return log.prior.unionByName(log.train)


# ---------------------------------------------------------------- log and direct features

@query
def labels_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second domain: does the user purchase within 1, 3 or 7 days after the event's day?"""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type",
                                               epoch_day(F.col("ts")).alias("day"))
    days = ev.groupBy("user_id", "day").agg(
        F.max((F.col("event_type") == "purchase").cast("int")).alias("bought"))
    later = (Window.partitionBy("user_id").orderBy("day")
             .rangeBetween(1, Window.unboundedFollowing))
    days = days.withColumn("next", F.min(F.when(F.col("bought") == 1, F.col("day"))).over(later))
    gap = F.col("next") - F.col("day")
    return ev.join(days, ["user_id", "day"]).select("event_id", "user_id", "day", *[
        F.coalesce((gap <= n).cast("int"), F.lit(0)).alias(f"buys_within_{n}d") for n in (1, 3, 7)])


ORACLES["labels_from_events"] = f"""
WITH ev AS (SELECT event_id, user_id, event_type, {DAY_OF.format('ts')} AS day FROM events),
nxt AS (SELECT a.user_id, a.day, min(b.day) AS next FROM (SELECT DISTINCT user_id, day FROM ev) a
  LEFT JOIN (SELECT DISTINCT user_id, day FROM ev WHERE event_type = 'purchase') b
  ON a.user_id = b.user_id AND b.day > a.day GROUP BY 1, 2)
SELECT event_id, ev.user_id, CAST(ev.day AS INT) AS day,
  CAST(coalesce(next - ev.day <= 1, FALSE) AS INT) AS buys_within_1d,
  CAST(coalesce(next - ev.day <= 3, FALSE) AS INT) AS buys_within_3d,
  CAST(coalesce(next - ev.day <= 7, FALSE) AS INT) AS buys_within_7d
FROM ev JOIN nxt ON ev.user_id = nxt.user_id AND ev.day = nxt.day"""


@query
def training_log(spark, sf_dir):
    """The whole log, rebuilt from the tables (not the written copy)."""
    rows = build_log(spark, sf_dir)
    return rows.withColumn("topics", F.array_join(TOPICS, "|")).drop(DATE, TOPICS)


ORACLES["training_log"] = sql(f"""SELECT row_id, farmer_name, CAST(day AS INT) AS day, trainer,
  array_to_string(topics, '|') AS topics, gender, registration, age, county, subcounty, ward,
  group_name, belong_to_cooperative, has_topic_trained_on, {labels('{y}')}, period FROM log""")


def _quoted(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", ")


@query
def normalize_trainer(spark, sf_dir):
    """Trainers rendered as raw text (plain id, list literal, NULL) and read back."""
    suppliers = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_set(F.concat(F.lit("TRA_"), F.col("l_suppkey")))).alias("ids")))
    rows = TrainingLog(spark, sf_dir).rows().select(ID, TRAINER, "period")
    rows = rows.join(suppliers, F.col(ID) == F.col("l_orderkey"), "left")
    raw = (F.when(F.col("ids").isNull(), F.lit(None).cast("string"))
           .when(F.col("period") == "prior", F.col(TRAINER))
           .otherwise(F.concat(F.lit("["), _quoted(F.col("ids")), F.lit("]"))))
    return rows.select(ID, fields.trainer_name(raw).alias(TRAINER))


ORACLES["normalize_trainer"] = sql("""SELECT row_id, CASE WHEN ids IS NULL THEN 'UNKNOWN'
  WHEN period = 'prior' THEN trainer ELSE array_to_string(ids, ',') END AS trainer
FROM log LEFT JOIN (SELECT l_orderkey AS k,
    list_sort(list_distinct(list('TRA_' || l_suppkey))) AS ids
  FROM lineitem GROUP BY 1) ON k = row_id""")


@query
def normalize_topics(spark, sf_dir):
    """Topics rendered as flat or nested list literals and read back."""
    rows = TrainingLog(spark, sf_dir).rows().select(ID, TOPICS, "period")
    flat = F.concat(F.lit("["), _quoted(F.col(TOPICS)), F.lit("]"))
    nested = F.concat(F.lit("["), flat, F.lit(", "), flat, F.lit("]"))
    raw = F.when(F.col("period") == "prior", flat).otherwise(nested)
    return rows.select(ID, F.array_join(fields.topic_array(raw), "|").alias("topics"))


ORACLES["normalize_topics"] = sql(
    "SELECT row_id, array_to_string(topics, '|') AS topics FROM log")


@query
def category_codes(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    return encoding.category_codes([log.train, log.prior], CATEGORICAL + [TRAINER])


_CODE_CTE = {
    "seen": "SELECT * FROM prior UNION ALL SELECT * FROM train",
    "cells": " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS col, coalesce({c}, 'UNKNOWN') AS value FROM seen"
        for c in CATEGORICAL + [TRAINER]),
    "codes": """SELECT col, value, CAST(row_number() OVER (PARTITION BY col ORDER BY value) - 1
        AS INT) AS code FROM cells""",
}
ORACLES["category_codes"] = sql("SELECT col, value, code FROM codes", _CODE_CTE)


def code_of(col: str, name: str, table_name: str = "codes", missing: str = "UNKNOWN") -> str:
    return (f"coalesce((SELECT code FROM {table_name} c WHERE c.col = '{col}' "
            f"AND c.value = coalesce(t.{col}, '{missing}')), -1) AS {name}")


@query
def binary_flags(spark, sf_dir):
    return TrainingLog(spark, sf_dir).rows().select(
        ID, F.col("belong_to_cooperative").cast("int"), F.col("has_topic_trained_on").cast("int"))


ORACLES["binary_flags"] = sql(
    "SELECT row_id, belong_to_cooperative, has_topic_trained_on FROM log")

DATE_PARTS_SQL = """CAST(month(training_day) AS INT) AS month,
  CAST(isodow(training_day) - 1 AS INT) AS day_of_week,
  CAST(dayofyear(training_day) AS INT) AS day_of_year, CAST(quarter(training_day) AS INT) AS quarter,
  CAST(weekofyear(training_day) AS INT) AS week_of_year,
  CAST(isodow(training_day) >= 6 AS INT) AS is_weekend,
  CAST(day(training_day) <= 7 AS INT) AS is_month_start,
  CAST(day(training_day) >= 25 AS INT) AS is_month_end"""


@query
def date_parts_of_orders(spark, sf_dir):
    date = fields.parse_date(F.col("o_orderdate").cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(ID), date.alias(DATE))
    return rows.select(ID, *[c.alias(n) for n, c in date_parts(F.col(DATE)).items()])


QUERIES["date_parts"] = QUERIES.pop("date_parts_of_orders")
ORACLES["date_parts"] = sql(f"SELECT row_id, {DATE_PARTS_SQL} FROM ord")


def keyword_sql(keywords: dict) -> str:
    return ", ".join(
        "CAST(" + " OR ".join(f"contains(lower(array_to_string(topics, chr(10))), '{w}')"
                              for w in words) + f" AS INT) AS topic_cat_{name}"
        for name, words in keywords.items())


@query
def topic_flags(spark, sf_dir):
    rows = TrainingLog(spark, sf_dir).rows()
    flags = fields.keyword_flags(F.col(TOPICS), PART_KEYWORDS)
    return rows.select(ID, fields.topic_count(F.col(TOPICS)).alias("topic_count"),
                       fields.has_topic(F.col(TOPICS)).alias("has_topic"),
                       *[c.alias(n) for n, c in flags.items()])


ORACLES["topic_flags"] = sql(f"""SELECT row_id, CAST(len(topics) AS INT) AS topic_count,
  CAST(len(topics) > 0 AS INT) AS has_topic, {keyword_sql(PART_KEYWORDS)} FROM log""")


@query
def trainer_features(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    codes = workspace.materialise(encoding.category_codes([log.train, log.prior], [TRAINER]),
                                  "codes")
    rows = encoding.attach_codes(log.rows().select(ID, TRAINER), codes, [TRAINER],
                                 {TRAINER: "trainer_encoded"})
    return rows.select(ID, "trainer_encoded", F.coalesce(F.col(TRAINER).contains(",").cast("int"),
                                                         F.lit(0)).alias("has_multiple_trainers"))


ORACLES["trainer_features"] = sql(f"""SELECT row_id, {code_of('trainer', 'trainer_encoded')},
  CAST(contains(trainer, ',') AS INT) AS has_multiple_trainers FROM log t LEFT JOIN codes
  ON FALSE""", _CODE_CTE)


@query
def entity_tokens(spark, sf_dir):
    rows = TrainingLog(spark, sf_dir).rows()
    return rows.select(ID, fields.person_token().alias("person"),
                       *[c.alias(n) for n, c in fields.entity_tokens().items()],
                       F.array_join(fields.topic_tokens(F.col(TOPICS)), "|").alias("topics"))


ORACLES["entity_tokens"] = sql("""SELECT row_id, farmer_name AS person,
  'trainer_' || trainer AS trainer, 'group_' || group_name AS "group",
  'county_' || county AS county, 'subcounty_' || subcounty AS subcounty, 'ward_' || ward AS ward,
  array_to_string(list_transform(topics, lambda x: 'topic_' || replace(x, ' ', '_')), '|')
    AS topics FROM log""")


# ---------------------------------------------------------------- folds

def _fold_table(log: TrainingLog, made: list[folds.Fold]) -> DataFrame:
    edges = F.array(*[F.struct(F.lit(f.number).alias("fold"), F.lit(f.cutoff).alias("cutoff"),
                               F.lit(f.end).alias("until")) for f in made])
    days = log.train.groupBy(DAY).agg(F.count(F.lit(1)).alias("n"))
    counts = folds.fold_roles(days, made).groupBy("fold").agg(*[
        F.sum(F.when(F.col("role") == role, F.col("n"))).alias(f"n_{role}")
        for role in ("train", "val")])
    match = F.element_at(F.filter(edges, lambda e: e.fold == F.col("fold")), 1)
    return counts.select("fold", r6(match.cutoff).alias("cutoff"), r6(match.until).alias("until"),
                         "n_train", "n_val")


@query
def forward_folds(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    return _fold_table(log, folds.forward_folds(log.train))


@query
def cutoff_folds(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    return _fold_table(log, folds.cutoff_folds(log.train))


_FOLD_COUNT = """SELECT fold, round(cutoff, 6) AS cutoff, round(until, 6) AS until,
  count(*) FILTER (WHERE day < cutoff) AS n_train,
  count(*) FILTER (WHERE day >= cutoff AND day < until) AS n_val
FROM {folds} CROSS JOIN train GROUP BY fold, cutoff, until"""
ORACLES["forward_folds"] = sql(_FOLD_COUNT.format(folds="folds"))
ORACLES["cutoff_folds"] = sql(_FOLD_COUNT.format(folds="cuts"), {
    "cuts": """SELECT CAST(i + 1 AS INT) AS fold,
        lo + (hi - lo) * (0.3e0 + i * 1e0 / (5 + 1) * (1 - 0.3e0)) AS cutoff,
        lo + (hi - lo) * (0.3e0 + (i + 1) * 1e0 / (5 + 1) * (1 - 0.3e0)) AS until
        FROM range(5) t(i) CROSS JOIN span"""})


@query
def time_holdout(spark, sf_dir):
    rows = TrainingLog(spark, sf_dir).train
    return rows.select(ID, folds.holdout_role(F.col(DATE), F.lit("2000-01-01").cast("date"))
                       .alias("role"))


ORACLES["time_holdout"] = sql("""SELECT row_id, CASE WHEN training_day < DATE '2000-01-01'
  THEN 'train' ELSE 'val' END AS role FROM train""")


@query
def stratified_folds(spark, sf_dir):
    y = LABELS["07"]
    rows = TrainingLog(spark, sf_dir).train.select(ID, y)
    return folds.stratified_folds(rows, y)


ORACLES["stratified_folds"] = sql(f"""SELECT row_id, {LABELS['07']}, CAST((row_number() OVER (
  PARTITION BY {LABELS['07']} ORDER BY md5('42_' || row_id)) - 1) % 5 + 1 AS INT) AS fold
FROM train""")


@query
def asof_prior(spark, sf_dir):
    """History rows and persons each fold may see, and their label sums."""
    log = TrainingLog(spark, sf_dir)
    made = log_folds(log)
    # Each row is counted once, in the first fold that sees it; later folds add these counts up.
    parts = history_and_train(log).groupBy(
        folds.first_training_fold(made, F.col(DAY)).alias("first"), PERSON).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in LABELS.values()])
    later = F.filter(F.array(*[F.lit(f.number) for f in made]), lambda f: f >= F.col("first"))
    people = parts.withColumn("fold", F.explode(later)).groupBy("fold", PERSON).agg(
        *[F.sum(c).alias(c) for c in ("n", *LABELS.values())])
    return people.groupBy("fold").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_persons"),
        *[F.sum(y).alias(f"sum_{h}") for h, y in LABELS.items()])


ORACLES["asof_prior"] = sql(f"""SELECT fold, count(*) AS n_rows,
  count(DISTINCT farmer_name) AS n_persons, {labels('CAST(sum({y}) AS BIGINT) AS sum_{h}')}
FROM log JOIN folds ON day < cutoff WHERE period <> 'test' GROUP BY fold""")


@query
def window_buckets(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    fold = folds.validation_fold(log_folds(log), F.col(DAY))
    rows = log.train.select(fold.alias("fold")).where(F.col("fold").isNotNull())
    return rows.groupBy(folds.window_bucket(F.col("fold")).alias("window")).agg(
        F.count(F.lit(1)).alias("n"))


ORACLES["window_buckets"] = sql(
    'SELECT least(fold, 4) AS "window", count(*) AS n FROM fold_val GROUP BY 1')


# ---------------------------------------------------------------- profiles and encodings

@query
def person_profile(spark, sf_dir):
    """Profile of every person of the history, joined to the training rows."""
    log = TrainingLog(spark, sf_dir)
    people = workspace.materialise(profiles.person_profile(log.prior), "people")
    names = [c for c in people.columns if c != PERSON]
    rows = log.train.select(ID, PERSON).join(people, PERSON, "left")
    return rows.select(ID, *[r6(F.coalesce(c, F.lit(0)).cast("double")).alias(c) for c in names])


PERSON_CTE = {
    "people": f"""SELECT farmer_name, {labels('avg({y}) AS prior_{y}_rate')},
        count(*) AS prior_training_count, max(day) - min(day) AS prior_span_days,
        avg(belong_to_cooperative) AS prior_coop_rate,
        len(list_distinct(flatten(list(topics)))) AS prior_topic_diversity
        FROM prior GROUP BY farmer_name"""}
PERSON_COLUMNS = [*[f"prior_{y}_rate" for y in LABELS.values()], "prior_training_count",
                  "prior_span_days", "prior_coop_rate", "prior_topic_diversity"]
ORACLES["person_profile"] = sql(
    "SELECT row_id, " + ", ".join(
        f"round(CAST(coalesce({c}, 0) AS DOUBLE), 6) AS {c}" for c in PERSON_COLUMNS)
    + " FROM train LEFT JOIN people USING (farmer_name)", PERSON_CTE)


def _history_counts(log: TrainingLog) -> DataFrame:
    return workspace.shared(log.spark, f"history_counts:{log.sf_dir}",
                            lambda: profiles.key_counts(log.prior, list(PROFILE_KEYS)))


@query
def key_profile(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    rows = profiles.attach_all(log.train.select(ID, *PROFILE_KEYS),
                               profiles.key_profile(_history_counts(log)))
    names = [c for c in rows.columns if c not in (ID, *PROFILE_KEYS)]
    return rows.select(ID, *[r6(F.coalesce(c, F.lit(0)).cast("double")).alias(c) for c in names])


@query
def confidence_profile(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    profile = workspace.materialise(profiles.confidence_profile(_history_counts(log)), "conf")
    rows = profiles.attach_all(log.train.select(ID, *PROFILE_KEYS), profile)
    names = [c for c in rows.columns if c not in (ID, *PROFILE_KEYS)]
    return rows.select(ID, *[r6(F.coalesce(c, F.lit(0)).cast("double")).alias(c) for c in names])


def smoothed_sql(y: str, n: str = "count(*)", strength: str = "10e0") -> str:
    return f"((sum({y}) + {strength} * any_value(g_{y})) / ({n} + {strength}))"


def _confidence_columns(prefix: str, y: str) -> str:
    p = smoothed_sql(y)
    se = f"sqrt({p} * (1 - {p}) / (count(*) + 10e0))"
    return (f"{p} AS {prefix}_{y}_rate_smoothed, {se} AS {prefix}_{y}_rate_se, "
            f"greatest(0e0, {p} - 1.96e0 * {se}) AS {prefix}_{y}_rate_lower95")


KEY_CTE: dict[str, str] = {
    "overall": f"SELECT {labels('avg({y}) AS g_{y}')} FROM prior"}
for _key, _prefix in PROFILE_KEYS.items():
    KEY_CTE[f"stat_{_prefix}"] = (
        f"SELECT {_key}, count(*) AS {_prefix}_count, "
        + labels("avg({y}) AS %s_{y}_rate" % _prefix) + ", "
        + ", ".join(_confidence_columns(_prefix, y) for y in LABELS.values())
        + f" FROM prior CROSS JOIN overall WHERE {_key} IS NOT NULL GROUP BY {_key}")
KEY_JOINS = " ".join(f"LEFT JOIN stat_{p} USING ({k})" for k, p in PROFILE_KEYS.items())
RATE_COLUMNS = [f"{p}_{y}_rate" for p in PROFILE_KEYS.values() for y in LABELS.values()]
COUNT_COLUMNS = [f"{p}_count" for p in PROFILE_KEYS.values()]
CONFIDENCE_COLUMNS = [f"{p}_{y}_rate_{s}" for p in PROFILE_KEYS.values() for y in LABELS.values()
                      for s in ("smoothed", "se", "lower95")]


def filled(columns: list[str]) -> str:
    return ", ".join(f"round(CAST(coalesce({c}, 0) AS DOUBLE), 6) AS {c}" for c in columns)


ORACLES["key_profile"] = sql(
    f"SELECT row_id, {filled(COUNT_COLUMNS + RATE_COLUMNS)} FROM train {KEY_JOINS}", KEY_CTE)
ORACLES["confidence_profile"] = sql(
    f"SELECT row_id, {filled(COUNT_COLUMNS + CONFIDENCE_COLUMNS)} FROM train {KEY_JOINS}", KEY_CTE)


@query
def asof_target_encoding(spark, sf_dir):
    """Encodings fitted on each fold's training rows, joined to its validation rows."""
    log = TrainingLog(spark, sf_dir)
    made = log_folds(log)
    counts = workspace.materialise(profiles.key_counts(log.train, ENCODED_KEYS, made), "counts")
    encodings = workspace.materialise(profiles.target_encoding(counts), "encodings")
    rows = log.train.select(ID, *ENCODED_KEYS, folds.validation_fold(made, F.col(DAY)).alias("fold"))
    rows = profiles.attach_encodings(rows.where(F.col("fold").isNotNull()), encodings, ENCODED_KEYS)
    names = [c for c in rows.columns if c.startswith("te_")]
    return rows.select(ID, "fold", *[r6(F.col(c).cast("double")).alias(c) for c in names])


def _te_cte(key: str) -> str:
    cols = []
    for h, y in LABELS.items():
        p = f"((sum({y}) + 10e0 * any_value(g{h})) / (count(*) + 10e0))"
        rate = f"(CASE WHEN count(*) < 10 THEN any_value(g{h}) ELSE {p} END)"
        se = f"(CASE WHEN count(*) < 10 THEN 1e0 ELSE sqrt({p} * (1 - {p}) / (count(*) + 10e0)) END)"
        cols.append(f"{rate} AS te_{key}_{y}_rate_smoothed, {se} AS te_{key}_{y}_rate_se, "
                    f"greatest(0e0, {rate} - 1.96e0 * {se}) AS te_{key}_{y}_rate_lower95")
    return (f"SELECT fold, {key}, count(*) AS te_{key}_count, {', '.join(cols)} "
            f"FROM fold_train JOIN fold_rate USING (fold) GROUP BY fold, {key}")


_TE_COLUMNS = [f"te_{k}_{c}" for k in ENCODED_KEYS for c in
               ["count", *[f"{y}_rate_{s}" for y in LABELS.values()
                           for s in ("smoothed", "se", "lower95")]]]
ORACLES["asof_target_encoding"] = sql(
    "SELECT row_id, fold, " + ", ".join(
        f"round(CAST(coalesce({c}, 0.5e0) AS DOUBLE), 6) AS {c}" for c in _TE_COLUMNS)
    + " FROM fold_val " + " ".join(f"LEFT JOIN te_{k} USING (fold, {k})" for k in ENCODED_KEYS),
    {f"te_{k}": _te_cte(k) for k in ENCODED_KEYS})


@query
def asof_day_encoding(spark, sf_dir):
    """Encodings of every training row from strictly earlier days, as a fit takes them."""
    log = TrainingLog(spark, sf_dir)
    encodings = workspace.materialise(profiles.daily_encoding(log.train, ENCODED_KEYS), "encodings")
    rows = profiles.attach_encodings(log.train.select(ID, DAY, *ENCODED_KEYS), encodings, ENCODED_KEYS)
    return rows.select(ID, *[r6(F.col(c).cast("double")).alias(c) for c in rows.columns if c.startswith("te_")])


def _te_day(key: str) -> str:
    """Encoded columns of a row by windows over all rows of earlier days."""
    cols = [f"coalesce(n_{key}, 0.5e0) AS te_{key}_count"]
    for h, y in LABELS.items():
        p = f"((s{h}_{key} + 10e0 * g{h}) / (n_{key} + 10e0))"
        rate = f"(CASE WHEN n_{key} < 10 THEN g{h} ELSE {p} END)"
        se = f"(CASE WHEN n_{key} < 10 THEN 1e0 ELSE sqrt({p} * (1 - {p}) / (n_{key} + 10e0)) END)"
        cols += [f"CASE WHEN n_{key} > 0 THEN {c} ELSE 0.5e0 END AS te_{key}_{y}_rate_{s}" for s, c in
                 (("smoothed", rate), ("se", se), ("lower95", f"greatest(0e0, {rate} - 1.96e0 * {se})"))]
    return ", ".join(cols)


_EARLIER = "ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
ORACLES["asof_day_encoding"] = sql(
    "SELECT row_id, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in _TE_COLUMNS)
    + " FROM (SELECT row_id, " + ", ".join(_te_day(k) for k in ENCODED_KEYS) + " FROM earlier)",
    {"earlier": "SELECT row_id, " + ", ".join(
        [f"avg({y}) OVER ({_EARLIER}) AS g{h}" for h, y in LABELS.items()]
        + [f"nullif(count(*) OVER (PARTITION BY {k} {_EARLIER}), 0) AS n_{k}" for k in ENCODED_KEYS]
        + [f"sum({y}) OVER (PARTITION BY {k} {_EARLIER}) AS s{h}_{k}" for k in ENCODED_KEYS for h, y in LABELS.items()])
     + " FROM train"})


@query
def interaction_target_encoding(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    pairs = encoding.pair_encoding(log.train, log_folds(log))
    return pairs.select("fold", "kind", "key", "topic", "n",
                        *[r6(f"rate{h}").alias(f"rate{h}") for h in LABELS])


def _pair_rows(source: str) -> str:
    """(kind, key, topic) rows of a log CTE."""
    kinds = (("trainer", "trainer"), ("group", "group_name"), ("ward", "ward"))
    topic = "'topic_' || replace(t.x, ' ', '_')"
    return " UNION ALL ".join(
        f"SELECT s.*, '{kind}' AS kind, '{kind}_' || s.{col} AS key, {topic} AS topic "
        f"FROM {source} s CROSS JOIN unnest(s.topics) t(x)" for kind, col in kinds)


ORACLES["interaction_target_encoding"] = sql(f"""SELECT fold, kind, key, topic, count(*) AS n,
  {labels('round((sum({y}) + 10e0 * any_value(g{h})) / (count(*) + 10e0), 6) AS rate{h}')}
FROM pairs JOIN fold_rate USING (fold) GROUP BY fold, kind, key, topic""",
    {"pairs": _pair_rows("fold_train")})


@query
def interaction_te_features(spark, sf_dir):
    """Pair encodings of the history, averaged over the topics of each training row."""
    log = TrainingLog(spark, sf_dir)
    pairs = workspace.materialise(encoding.pair_encoding(log.prior), "pairs")
    rows = encoding.pair_features(log.train.select(ID, TRAINER, GROUP, "ward", TOPICS), pairs,
                                  encoding.label_rates(log.prior))
    names = [c for c in rows.columns if "_topic_mean_" in c]
    return rows.select(ID, *[r6(c).alias(c) for c in names])


ORACLES["interaction_te_features"] = sql(
    "SELECT row_id, " + ", ".join(
        f"round(coalesce(avg(CASE WHEN kind = '{k}' THEN coalesce(r{h}, g{h}) END), "
        f"any_value(g{h})), 6) AS {k}_topic_mean_p{h}"
        for k in encoding.PAIR_KINDS for h in LABELS)
    + """ FROM (SELECT t.row_id, p.kind, e.*, o.* FROM train t CROSS JOIN o
      LEFT JOIN train_pairs p ON p.row_id = t.row_id
      LEFT JOIN enc e ON e.ekind = p.kind AND e.ekey = p.key AND e.etopic = p.topic)
    GROUP BY row_id""", {
        "o": f"SELECT {labels('avg({y}) AS g{h}')} FROM prior",
        "prior_pairs": _pair_rows("prior"), "train_pairs": _pair_rows("train"),
        "enc": f"""SELECT kind AS ekind, key AS ekey, topic AS etopic,
          {labels('(sum({y}) + 10e0 * any_value(g{h})) / (count(*) + 10e0) AS r{h}')}
          FROM prior_pairs CROSS JOIN o GROUP BY 1, 2, 3 HAVING count(*) >= 5"""})


# ---------------------------------------------------------------- look-backs

@query
def recency_intensity(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    rows = lookback.recency_intensity(log.train.select(ID, PERSON, DAY), log.rows())
    return rows.select(ID, "days_since_last_training", "trainings_last_30d", "trainings_last_90d",
                       r6("recent_training_momentum").alias("recent_training_momentum"))


def recency_sql(probe: str, history: str) -> str:
    return f"""SELECT t.row_id, coalesce(t.day - max(h.day), 999) AS days_since_last_training,
      count(h.day) FILTER (WHERE h.day >= t.day - 30) AS trainings_last_30d,
      count(h.day) FILTER (WHERE h.day >= t.day - 90) AS trainings_last_90d,
      CASE WHEN count(h.day) FILTER (WHERE h.day >= t.day - 60 AND h.day < t.day - 30) > 0
        THEN (count(h.day) FILTER (WHERE h.day >= t.day - 30)
          - count(h.day) FILTER (WHERE h.day >= t.day - 60 AND h.day < t.day - 30)) * 1e0
          / count(h.day) FILTER (WHERE h.day >= t.day - 60 AND h.day < t.day - 30)
        ELSE count(h.day) FILTER (WHERE h.day >= t.day - 30) END AS recent_training_momentum
    FROM {probe} t LEFT JOIN {history} h ON h.farmer_name = t.farmer_name AND h.day < t.day
    GROUP BY t.row_id, t.day"""


ORACLES["recency_intensity"] = sql("""SELECT row_id,
  CAST(days_since_last_training AS INT) AS days_since_last_training, trainings_last_30d,
  trainings_last_90d, round(recent_training_momentum, 6) AS recent_training_momentum
FROM recency""", {"recency": recency_sql("train", "log")})


@query
def rolling_counts(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    rows = lookback.rolling_counts(log.train.select(ID, PERSON, GROUP, DAY), history_and_train(log))
    return rows.select(ID, *[F.col(c).cast("long") for c in rows.columns
                             if c.startswith("rolling_")])


def _rolling(keys: str, label: str) -> str:
    on = " AND ".join(f"h.{k} = t.{k}" for k in keys.split()) or "TRUE"
    cols = ", ".join(f"CAST(coalesce(sum(h.n) FILTER (WHERE h.day >= t.day - {n}), 0) AS BIGINT) "
                     f"AS rolling_{label}training_count_{n}d" for n in LOOKBACK_DAYS)
    by = ", ".join([*keys.split(), "day"])
    tby = ", ".join(f"t.{k}" for k in [*keys.split(), "day"])
    return (f"SELECT {tby}, {cols} FROM (SELECT DISTINCT {by} FROM train) t LEFT JOIN "
            f"(SELECT {by}, count(*) AS n FROM seen GROUP BY {by}) h "
            f"ON {on} AND h.day < t.day AND h.day >= t.day - 90 GROUP BY {tby}")


_SEEN = {"seen": _CODE_CTE["seen"]}
ORACLES["rolling_counts"] = sql(
    "SELECT row_id, " + ", ".join(
        f"rolling_{p}training_count_{n}d" for p in ("", "farmer_", "group_") for n in LOOKBACK_DAYS)
    + """ FROM train JOIN roll_all USING (day) JOIN roll_person USING (farmer_name, day)
    JOIN roll_group USING (group_name, day)""",
    {**_SEEN, "roll_all": _rolling("", ""), "roll_person": _rolling("farmer_name", "farmer_"),
     "roll_group": _rolling("group_name", "group_")})


@query
def lag_features(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    rows = lookback.lag_days(log.train.select(ID, PERSON, DAY), history_and_train(log))
    return rows.select(ID, *[F.col(c).cast("int") for c in rows.columns
                             if c.startswith("days_since_")])


def _lags(gap: str, label: str) -> str:
    return ", ".join(f"CAST(CASE WHEN {gap} IS NULL THEN 999 WHEN {gap} <= {n} THEN 0 ELSE {gap} "
                     f"END AS INT) AS days_since_{label}_{n}d" for n in LOOKBACK_DAYS)


ORACLES["lag_features"] = sql(
    f"""SELECT row_id, {_lags('gap_all', 'last_training')},
    {_lags('gap_own', 'farmer_last_training')} FROM (
      SELECT t.row_id, t.day - (SELECT max(d.day) FROM days d WHERE d.day < t.day) AS gap_all,
        t.day - (SELECT max(s.day) FROM seen s WHERE s.farmer_name = t.farmer_name
                 AND s.day < t.day) AS gap_own FROM train t LEFT JOIN days ON FALSE)""",
    {**_SEEN, "days": "SELECT DISTINCT day FROM seen"})


@query
def topic_novelty(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    rows = lookback.topic_novelty(log.train.select(ID, PERSON, DAY, TOPICS), log.rows())
    return rows.select(ID, *[r6(c).alias(c) for c in
                             ("topic_diversity", "topic_novelty", "repeat_topic_ratio")])


ORACLES["topic_novelty"] = sql("""SELECT row_id,
  round(CASE WHEN n = 0 THEN 0 WHEN NOT past THEN 1 ELSE len(cur) * 1e0 / n END, 6)
    AS topic_diversity,
  round(CASE WHEN n = 0 THEN 0 WHEN NOT past THEN 1
    ELSE len(list_filter(cur, lambda x: NOT list_contains(old, x))) * 1e0 / len(cur) END, 6)
    AS topic_novelty,
  round(CASE WHEN n = 0 OR NOT past THEN 0
    ELSE len(list_filter(cur, lambda x: list_contains(old, x))) * 1e0 / len(cur) END, 6)
    AS repeat_topic_ratio
FROM (SELECT t.row_id, len(t.topics) AS n,
    list_distinct(list_transform(t.topics, lambda x: lower(x))) AS cur,
    list_transform(flatten(list(h.topics) FILTER (WHERE h.topics IS NOT NULL)), lambda x: lower(x))
      AS old, count(h.day) > 0 AS past
  FROM train t LEFT JOIN log h ON h.farmer_name = t.farmer_name AND h.day < t.day
  GROUP BY t.row_id, t.topics)""")


@query
def prior_flag_cohort(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    rows = profiles.known_person(log.train.select(ID, PERSON, "has_topic_trained_on"), log.prior)
    return rows.select(ID, "has_prior_history", "has_topic_trained_on",
                       (2 * F.col("has_prior_history") + F.col("has_topic_trained_on"))
                       .alias("cohort"))


ORACLES["prior_flag_cohort"] = sql("""SELECT row_id, CAST(known AS INT) AS has_prior_history,
  has_topic_trained_on, CAST(2 * CAST(known AS INT) + has_topic_trained_on AS INT) AS cohort
FROM (SELECT t.*, EXISTS (SELECT 1 FROM prior p WHERE p.farmer_name = t.farmer_name) AS known
  FROM train t LEFT JOIN prior ON FALSE)""")


@query
def gating_matrix(spark, sf_dir):
    """Gating features of the unlabelled rows; codes are fitted on the training rows only."""
    log = TrainingLog(spark, sf_dir)
    codes = workspace.materialise(
        encoding.category_codes([log.train], GATING_KEYS, missing=fields.MISSING), "codes")
    rows = profiles.known_person(log.test, log.prior)
    rows = encoding.attach_codes(rows, codes, GATING_KEYS, missing=fields.MISSING)
    return rows.select(ID, "has_prior_history", fields.has_topic(F.col(TOPICS)).alias("has_topic"),
                       fields.topic_count(F.col(TOPICS)).alias("topic_count"),
                       *[f"{c}_code" for c in GATING_KEYS])


ORACLES["gating_matrix"] = sql(
    "SELECT t.row_id, CAST(EXISTS (SELECT 1 FROM prior p WHERE p.farmer_name = t.farmer_name) AS INT)"
    " AS has_prior_history, CAST(len(t.topics) > 0 AS INT) AS has_topic,"
    " CAST(len(t.topics) AS INT) AS topic_count, "
    + ", ".join(code_of(c, f"{c}_code", "gcodes", "__NA__") for c in GATING_KEYS)
    + " FROM test t LEFT JOIN gcodes ON FALSE LEFT JOIN (SELECT 1 FROM prior) ON FALSE", {
        "gcodes": "SELECT col, value, CAST(row_number() OVER (PARTITION BY col ORDER BY value) - 1 "
                  "AS INT) AS code FROM (" + " UNION ALL ".join(
                      f"SELECT DISTINCT '{c}' AS col, coalesce({c}, '__NA__') AS value FROM train"
                      for c in GATING_KEYS) + ")"})
