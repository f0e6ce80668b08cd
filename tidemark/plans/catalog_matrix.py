"""Registered queries: feature matrices, interactions, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import (BINARY, CATEGORICAL, DATE, DAY, ID, LABELS, MINIMAL, PART_KEYWORDS,
                             TOPICS, VETTED)
from tidemark.functions import fields
from tidemark.functions.calendar import date_parts
from tidemark.operators import metrics, weights
from tidemark.operators.interactions import linear_interactions
from tidemark.plans import matrix
from tidemark.plans.catalog_log import (_CODE_CTE, COUNT_COLUMNS, CONFIDENCE_COLUMNS,
                                        DATE_PARTS_SQL, KEY_CTE, KEY_JOINS, PERSON_COLUMNS,
                                        PERSON_CTE, RATE_COLUMNS, code_of, keyword_sql, r6,
                                        recency_sql)
from tidemark.plans.oracle import labels, sql
from tidemark.sources import workspace
from tidemark.sources.training_log import TrainingLog

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def train_matrix(spark, sf_dir, groups, name):
    """Matrix of the training rows fitted on the history, written once per application."""
    log = TrainingLog(spark, sf_dir)

    def build():
        return matrix.transform(log.train, matrix.fit(log.prior, log.train, groups), groups)
    return workspace.shared(spark, f"matrix-{name}:{sf_dir}", build)


def _doubles(df, names):
    return df.select(ID, *[r6(F.col(c).cast("double")).alias(c) for c in names])


@query
def feature_matrix_minimal(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    x = matrix.transform(log.train, matrix.fit(log.prior, log.train, MINIMAL), MINIMAL)
    return _doubles(x, matrix.feature_names(x))


@query
def feature_matrix_vetted(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    x = matrix.transform(log.train, matrix.fit(log.prior, log.train, VETTED), VETTED)
    return _doubles(x, matrix.feature_names(x))


CATEGORY_FLAGS = [f"topic_cat_{k}" for k in PART_KEYWORDS]
DIRECT = [*CATEGORICAL, *BINARY, "topic_count", *CATEGORY_FLAGS]
DATES = ["month", "day_of_week", "day_of_year", "quarter", "week_of_year", "is_weekend",
         "is_month_start", "is_month_end"]
RECENCY = ["days_since_last_training", "trainings_last_30d", "trainings_last_90d",
           "recent_training_momentum"]
DIRECT_SQL = ", ".join([
    "t.row_id", *[code_of(c, c) for c in CATEGORICAL], *BINARY,
    "CAST(len(topics) AS INT) AS topic_count", keyword_sql(PART_KEYWORDS)])
MATRIX_CTE = {
    **_CODE_CTE, **KEY_CTE, **PERSON_CTE, "recency": recency_sql("train", "prior"),
    "direct": f"SELECT {DIRECT_SQL} FROM train t LEFT JOIN codes ON FALSE",
    "more": f"""SELECT t.row_id, {DATE_PARTS_SQL}, {code_of('trainer', 'trainer_encoded')},
        CAST(contains(trainer, ',') AS INT) AS has_multiple_trainers
        FROM train t LEFT JOIN codes ON FALSE""",
    "vetted": f"""SELECT * EXCLUDE (day, trainer, topics, training_day, period),
        CAST(prior_training_count IS NOT NULL AS INT) AS has_prior_history
        FROM (SELECT row_id, farmer_name, day, training_day, trainer, topics, period, county AS
            county_name, county, subcounty, ward, group_name, {labels('{y}')} FROM train) t
        LEFT JOIN people USING (farmer_name) {KEY_JOINS}""",
    "wide": """SELECT * FROM direct JOIN more USING (row_id)
        JOIN (SELECT * EXCLUDE (county, subcounty, ward) FROM vetted) USING (row_id)
        JOIN recency USING (row_id)""",
}
VETTED_COLUMNS = [*DIRECT, *DATES, "trainer_encoded", "has_multiple_trainers", *PERSON_COLUMNS,
                  "has_prior_history", *COUNT_COLUMNS, *RATE_COLUMNS, *CONFIDENCE_COLUMNS, *RECENCY]


def _filled(columns):
    return ", ".join(f"round(CAST(coalesce({c}, 0) AS DOUBLE), 6) AS {c}" for c in columns)


ORACLES["feature_matrix_minimal"] = sql(f"SELECT row_id, {_filled(DIRECT)} FROM direct", MATRIX_CTE)
ORACLES["feature_matrix_vetted"] = sql(
    f"SELECT row_id, {_filled(VETTED_COLUMNS)} FROM wide", MATRIX_CTE)


@query
def feature_correlation(spark, sf_dir):
    """Every feature of the matrix against each of the three labels; NULL for a constant feature."""
    x = train_matrix(spark, sf_dir, VETTED, "vetted")
    out = metrics.feature_correlations(x, matrix.feature_names(x), list(LABELS.values()))
    return out.withColumn("correlation", r6("correlation"))


ORACLES["feature_correlation"] = sql(" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, '{y}' AS label, CASE WHEN stddev_pop({c}) > 0 AND stddev_pop({y}) > 0
    THEN round(corr({c}, {y}), 6) END AS correlation FROM filled""" for c in VETTED_COLUMNS for y in LABELS.values()), {
        **MATRIX_CTE, "filled": f"""SELECT {labels('{y}')}, {', '.join(
            f'CAST(coalesce({c}, 0) AS DOUBLE) AS {c}' for c in VETTED_COLUMNS)} FROM wide"""})


@query
def feature_subset(spark, sf_dir):
    """The matrix without its topic and place columns (one ablation step)."""
    x = train_matrix(spark, sf_dir, MINIMAL, "minimal")
    dropped = ["topic_count", *CATEGORY_FLAGS, "county", "subcounty", "ward"]
    return _doubles(x, matrix.feature_names(x.drop(*dropped)))


ORACLES["feature_subset"] = sql(
    f"SELECT row_id, {_filled(['gender', 'registration', 'age', *BINARY])} FROM direct", MATRIX_CTE)


@query
def interactions(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    groups = VETTED.but(interactions=True, recency=False, dates=False)
    x = matrix.transform(log.train, matrix.fit(log.prior, log.train, groups), groups)
    return _doubles(x, [c for c in x.columns if "_x_" in c])


ORACLES["interactions"] = sql("SELECT row_id, " + ", ".join(
    [f"round(coalesce(has_topic_trained_on * group_{y}_rate, 0), 6) AS has_topic_x_group_{y}_rate"
     for y in LABELS.values()]
    + [f"round(coalesce(topic_count * prior_{y}_rate, 0), 6) AS topic_count_x_prior_{y}_rate"
       for y in LABELS.values()]
    + [f"round(CAST(trainer_encoded * topic_cat_{k} AS DOUBLE), 6) AS trainer_x_topic_{k}"
       for k in PART_KEYWORDS]) + " FROM wide", MATRIX_CTE)


@query
def linear_features(spark, sf_dir):
    x = linear_interactions(train_matrix(spark, sf_dir, VETTED, "vetted"))
    return _doubles(x, [c for c in x.columns if "_x_" in c or "_vs_" in c])


QUERIES["linear_interactions"] = QUERIES.pop("linear_features")


def _linear_sql() -> str:
    cols = []
    for y in LABELS.values():
        r, span = f"prior_{y}_rate", y.removeprefix("adopted_within_")
        cols += [(f"topic_x_{r}", f"has_topic_trained_on * coalesce({r}, 0)"),
                 (f"count_x_{r}", f"coalesce(prior_training_count, 0) * coalesce({r}, 0)"),
                 (f"farmer_vs_county_{span}",
                  f"coalesce({r}, 0) / (coalesce(county_{y}_rate, 0) + 1e-6)")]
    for c in RATE_COLUMNS + CONFIDENCE_COLUMNS:
        if c.startswith("group_"):
            cols.append((f"coop_x_{c}", f"belong_to_cooperative * coalesce({c}, 0)"))
    return ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in cols)


ORACLES["linear_interactions"] = sql(f"SELECT row_id, {_linear_sql()} FROM wide", MATRIX_CTE)


@query
def standardize(spark, sf_dir):
    """Scaled with the moments of the rows before the hold-out date; 'one' has no variance."""
    parts = date_parts(F.col(DATE))
    x = TrainingLog(spark, sf_dir).train.select(
        ID, DATE, fields.topic_count(F.col(TOPICS)).alias("topic_count"),
        parts["day_of_year"].alias("day_of_year"), "belong_to_cooperative", F.lit(1).alias("one"))
    names = ["topic_count", "day_of_year", "belong_to_cooperative", "one"]
    stats = weights.moments(x.where(F.col(DATE) < F.lit("2000-01-01").cast("date")), names)
    return _doubles(weights.standardise(x, stats), names)


_SCALED = ["topic_count", "day_of_year", "belong_to_cooperative", "one"]
ORACLES["standardize"] = sql(
    "SELECT row_id, " + ", ".join(
        f"round(({c} - m_{c}) / CASE WHEN d_{c} = 0 THEN 1e0 ELSE d_{c} END, 6) AS {c}"
        for c in _SCALED) + " FROM x CROSS JOIN stats", {
        "x": """SELECT row_id, training_day, len(topics) AS topic_count,
            dayofyear(training_day) AS day_of_year, belong_to_cooperative, 1 AS one FROM train""",
        "stats": "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}"
                                       for c in _SCALED)
                 + " FROM x WHERE training_day < DATE '2000-01-01'"})


@query
def source_weighted_union(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    rows = weights.source_weighted(log.train, log.prior)
    return rows.select(ID, DAY, "source_is_prior", "weight", *LABELS.values())


ORACLES["source_weighted_union"] = sql(f"""SELECT row_id, CAST(day AS INT) AS day,
  CAST(period = 'prior' AS INT) AS source_is_prior,
  CASE period WHEN 'prior' THEN 0.5e0 ELSE 1e0 END AS weight, {labels('{y}')}
FROM log WHERE period <> 'test'""")


@query
def recency_weights(spark, sf_dir):
    rows = weights.recency_weight(TrainingLog(spark, sf_dir).train.select(ID, DAY))
    return rows.select(ID, r6("weight").alias("weight"))


ORACLES["recency_weights"] = sql("""SELECT row_id,
  round(w / (SELECT avg(w) FROM weighted), 6) AS weight FROM weighted""", {
    "weighted": "SELECT row_id, 1 + (day - lo) / (hi - lo) AS w FROM train CROSS JOIN span"})


@query
def class_weights(spark, sf_dir):
    rows = weights.class_weights(TrainingLog(spark, sf_dir).train)
    return rows.select("horizon", r6("raw_weight").alias("raw_weight"),
                       r6("capped_weight").alias("capped_weight"))


_Z = {"07": LABELS["07"], "90": f"({LABELS['90']} - {LABELS['07']})",
      "120": f"({LABELS['120']} - {LABELS['90']})"}
ORACLES["class_weights"] = sql(" UNION ALL ".join(
    f"""SELECT '{h}' AS horizon, round(sum(1 - {y}) * 1e0 / sum({y}), 6) AS raw_weight,
    round(least(25e0, greatest(1e0, sum(1 - {_Z[h]}) * 1e0 / sum({_Z[h]}))), 6) AS capped_weight
    FROM train""" for h, y in LABELS.items()))
