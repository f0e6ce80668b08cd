"""Registered queries: metrics, reports, score algebra, blends, gates and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import (BINARY, CATEGORICAL, DATE, DAY, EXPECTED_RATES, GROUP, ID, LABELS, PERSON,
                             SCORES, TOPICS, TRAINER)
from tidemark.functions import fields, probability
from tidemark.operators import blending, folds, gates, metrics, profiles, reports
from tidemark.operators.ranking import exact_percentiles
from tidemark.plans.catalog_log import r6
from tidemark.plans.oracle import labels, metric_cte, score_expr, sql
from tidemark.plans.scores import RATE_MODELS, log_folds, rate_oof
from tidemark.sources import sinks, workspace
from tidemark.sources.training_log import TrainingLog, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MODELS = list(RATE_MODELS)
BASE = MODELS[0]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def long_oof(spark, sf_dir):
    return metrics.long_scores(rate_oof(spark, sf_dir), ["model", ID, "fold"])


def per_fold(spark, sf_dir):
    keys = ["model", "fold", "horizon"]
    return metrics.metrics(metrics.score_histogram(long_oof(spark, sf_dir), keys), keys)


def summaries(spark, sf_dir):
    """Run summary of every rate model, written once per application."""
    def build():
        oof = rate_oof(spark, sf_dir)
        return metrics.run_summary(oof, ["model"]).join(metrics.monotone(oof, ["model"]), "model")
    return workspace.shared(spark, f"summaries:{sf_dir}", build)


# ---------------------------------------------------------------- metrics

@query
def log_loss(spark, sf_dir):
    keys = ["model", "fold", "horizon"]
    hist = metrics.score_histogram(long_oof(spark, sf_dir), keys)
    return metrics.log_loss(hist, keys).withColumn("log_loss", r6("log_loss"))


ORACLES["log_loss"] = sql(
    "SELECT model, fold, horizon, round(log_loss, 6) AS log_loss FROM fold_metric")


@query
def roc_auc(spark, sf_dir):
    keys = ["model", "fold", "horizon"]
    return metrics.roc_auc(long_oof(spark, sf_dir), keys).withColumn("roc_auc", r6("roc_auc"))


ORACLES["roc_auc"] = sql(
    "SELECT model, fold, horizon, round(roc_auc, 6) AS roc_auc FROM fold_metric")


@query
def weighted_score(spark, sf_dir):
    """Scores joined to the labels of the log on row id, then scored per model and fold."""
    scores = rate_oof(spark, sf_dir).select("model", ID, "fold", *SCORES.values())
    truth = TrainingLog(spark, sf_dir).train.select(ID, *LABELS.values())
    keys = ["model", "fold", "horizon"]
    long = metrics.long_scores(scores.join(truth, ID), ["model", ID, "fold"])
    scored = metrics.metrics(metrics.score_histogram(long, keys), keys)
    share = metrics.score_share(F.col("horizon"), F.col("log_loss"), F.col("roc_auc"))
    return scored.groupBy("model", "fold").agg(r6(F.sum(share)).alias("score"),
                                               F.max("n").alias("n_rows"))


ORACLES["weighted_score"] = sql(f"""SELECT model, fold,
  round(sum({score_expr('log_loss', 'roc_auc')}), 6) AS score, max(n) AS n_rows
FROM fold_metric GROUP BY model, fold""")


@query
def combined_loss(spark, sf_dir):
    c = metrics.combined_loss(per_fold(spark, sf_dir))
    return c.select("model", "fold", "horizon", r6("combined_loss").alias("combined_loss"))


ORACLES["combined_loss"] = sql("""SELECT model, fold, horizon,
  round(0.75e0 * log_loss + 0.25e0 * (1 - roc_auc), 6) AS combined_loss FROM fold_metric""")


@query
def cv_summary(spark, sf_dir):
    c = metrics.cv_summary(per_fold(spark, sf_dir), ["model", "horizon"])
    return c.select("model", "horizon", *[r6(x).alias(x) for x in c.columns[2:]])


ORACLES["cv_summary"] = sql("""SELECT model, horizon, round(avg(log_loss), 6) AS mean_log_loss,
  round(stddev_pop(log_loss), 6) AS std_log_loss, round(avg(roc_auc), 6) AS mean_roc_auc,
  round(stddev_pop(roc_auc), 6) AS std_roc_auc,
  round(avg(0.75e0 * log_loss + 0.25e0 * (1 - roc_auc)), 6) AS mean_combined
FROM fold_metric GROUP BY model, horizon""")

_STATS = ["mean_score", "fold_std", "worst_fold", "last_fold"]


@query
def fold_stats(spark, sf_dir):
    scored = metrics.weighted_score(per_fold(spark, sf_dir), ["model", "fold"])
    out = metrics.fold_stats(scored, ["model"])
    return out.select("model", *[r6(c).alias(c) for c in _STATS])


ORACLES["fold_stats"] = sql("SELECT model, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in _STATS) + " FROM fold_stat")

_RECALLS = {5: 0.05, 10: 0.10, 20: 0.20}


@query
def avg_precision_recall_at_k(spark, sf_dir):
    keys = ["model", "horizon"]
    long = workspace.materialise(long_oof(spark, sf_dir).drop("fold"), "long")
    recall = metrics.recall_at(long, keys, list(_RECALLS.values()))
    wide = recall.groupBy(*keys).agg(*[
        r6(F.max(F.when(F.col("share") == s, F.col("recall")))).alias(f"recall_{k}")
        for k, s in _RECALLS.items()])
    ap = metrics.average_precision(long, keys)
    return ap.join(wide, keys).select(*keys, r6("avg_precision").alias("avg_precision"),
                                      r6("prevalence").alias("prevalence"), "n_rows",
                                      *[f"recall_{k}" for k in _RECALLS])


ORACLES["avg_precision_recall_at_k"] = sql(
    """SELECT model, horizon, round(ap, 6) AS avg_precision, round(pos * 1e0 / n, 6) AS prevalence,
    n AS n_rows, """ + ", ".join(f"round(hit_{k} * 1e0 / pos, 6) AS recall_{k}" for k in _RECALLS)
    + " FROM ap JOIN top USING (model, horizon)", {
        "ap": """SELECT model, horizon, sum(pos * cum_pos / cum_n) / sum(pos) AS ap FROM (
            SELECT *, sum(pos) OVER w AS cum_pos, sum(n) OVER w AS cum_n FROM hist_all
            WINDOW w AS (PARTITION BY model, horizon ORDER BY p DESC)) GROUP BY 1, 2""",
        "top": "SELECT model, horizon, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos, " + ", ".join(
            f"CAST(sum(y) FILTER (WHERE rn <= ceil(cnt * {s}e0)) AS BIGINT) AS hit_{k}"
            for k, s in _RECALLS.items())
        + """ FROM (SELECT *, row_number() OVER (PARTITION BY model, horizon ORDER BY p DESC, row_id)
             AS rn, count(*) OVER (PARTITION BY model, horizon) AS cnt FROM long) GROUP BY 1, 2"""})


@query
def top_scores(spark, sf_dir):
    """The 100 best rows of one model by 7-day score."""
    rows = rate_oof(spark, sf_dir).where(F.col("model") == BASE)
    return metrics.top_k(rows.select(ID, "p07", LABELS["07"]), "p07", 100)


ORACLES["top_scores"] = sql(f"""SELECT row_id, p07, {LABELS['07']} FROM oof
  WHERE model = '{BASE}' ORDER BY p07 DESC, row_id LIMIT 100""")


@query
def prediction_profile(spark, sf_dir):
    """Distribution of the loss column (one model) and the ranking column (another model)."""
    long = long_oof(spark, sf_dir)
    loss, rank = MODELS[0], MODELS[2]
    picked = long.where(F.col("model").isin(loss, rank))
    keys = ["model", "horizon"]
    pct = exact_percentiles(picked, keys, "p", {"median": 0.5, "p95": 0.95})
    base = picked.groupBy(*keys).agg(F.avg("p").alias("mean"), F.max("p").alias("max"),
                                     F.min("p").alias("min"))
    stats = base.join(pct, keys)
    per_row = picked.groupBy(ID, "horizon").agg(
        F.abs(F.max(F.when(F.col("model") == loss, F.col("p")))
              - F.max(F.when(F.col("model") == rank, F.col("p")))).alias("d"))
    gap = per_row.groupBy("horizon").agg(r6(F.avg("d")).alias("mean_abs_diff"))
    out = stats.groupBy("horizon").agg(*[
        r6(F.max(F.when(F.col("model") == m, F.col(c)))).alias(f"{c}_{side}")
        for m, side in ((loss, "ll"), (rank, "auc")) for c in ("mean", "median", "p95", "max", "min")])
    return out.join(gap, "horizon")


_PROFILE = {"mean": "avg(p)", "median": "quantile_cont(p, 0.5)", "p95": "quantile_cont(p, 0.95)",
            "max": "max(p)", "min": "min(p)"}
ORACLES["prediction_profile"] = sql("SELECT horizon, " + ", ".join(
    f"round({e.replace('(p', f'(p{side}')}, 6) AS {c}_{side}"
    for side in ("ll", "auc") for c, e in _PROFILE.items())
    + f""", round(avg(abs(pll - pauc)), 6) AS mean_abs_diff
    FROM (SELECT row_id, horizon, max(CASE WHEN model = '{MODELS[0]}' THEN p END) AS pll,
          max(CASE WHEN model = '{MODELS[2]}' THEN p END) AS pauc FROM long GROUP BY 1, 2)
    GROUP BY horizon""")


@query
def expected_logloss(spark, sf_dir):
    long = long_oof(spark, sf_dir)
    aggs = [F.when(F.first("horizon") == h, metrics.expected_log_loss(F.col("p"), rate))
            for h, rate in EXPECTED_RATES.items()]
    return long.groupBy("model", "horizon").agg(r6(F.coalesce(*aggs)).alias("expected_log_loss"))


_RATE_CASE = "CASE horizon " + " ".join(
    f"WHEN '{h}' THEN {r}e0" for h, r in EXPECTED_RATES.items()) + " END"
ORACLES["expected_logloss"] = sql(f"""SELECT model, horizon,
  round(-(1 - {_RATE_CASE}) * avg(ln(1 - p)) - {_RATE_CASE} * avg(ln(p)), 6) AS expected_log_loss
FROM long GROUP BY model, horizon""")


@query
def heuristic_auc(spark, sf_dir):
    out = metrics.separation_auc(long_oof(spark, sf_dir), ["model", "horizon"], EXPECTED_RATES)
    return out.withColumn("est_auc", r6("est_auc"))


ORACLES["heuristic_auc"] = sql(f"""SELECT model, horizon,
  round(CASE WHEN k > 0 THEN least(greatest(0.5e0 + 0.5e0 * (hi - lo), 0.5e0), 1e0)
        ELSE 0.5e0 END, 6) AS est_auc
FROM (SELECT model, horizon, max(k) AS k, avg(p) FILTER (WHERE up <= k) AS lo,
    avg(p) FILTER (WHERE down <= k) AS hi
  FROM (SELECT *, floor(count(*) OVER (PARTITION BY model, horizon) * {_RATE_CASE}) AS k,
      row_number() OVER (PARTITION BY model, horizon ORDER BY p) AS up,
      row_number() OVER (PARTITION BY model, horizon ORDER BY p DESC) AS down FROM long)
  GROUP BY model, horizon)""")


# ---------------------------------------------------------------- reports

@query
def table_profile(spark, sf_dir):
    out = reports.column_profile(TrainingLog(spark, sf_dir).rows())
    return out.select("column_name", "column_type", "missing", r6("missing_pct").alias("missing_pct"), "n_unique")


_PROFILED = {**dict.fromkeys([PERSON, TRAINER, *CATEGORICAL, "group_name", "period"], "string"), ID: "bigint", DATE: "date",
             **dict.fromkeys([DAY, "belong_to_cooperative", "has_topic_trained_on", *LABELS.values()], "int"),
             TOPICS: "array<string>"}
ORACLES["table_profile"] = sql(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{kind}' AS column_type, count(*) - count({v}) AS missing,
    round((count(*) - count({v})) * 100e0 / count(*), 6) AS missing_pct,
    count(DISTINCT {v}) AS n_unique FROM log"""
    for c, kind in _PROFILED.items() for v in ["topics" if c == TOPICS else c]))


@query
def table_duplicates(spark, sf_dir):
    return reports.row_count_and_duplicates(table(spark, sf_dir, "lineitem"))


ORACLES["table_duplicates"] = """SELECT CAST(sum(n) AS BIGINT) AS n_rows,
  CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)"""

_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query
def table_describe(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    numeric = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType)]
    out = reports.describe_numeric(rows, numeric)
    return out.select("column_name", "n", *[F.round(c, 4).alias(c)
                                            for c in ("mean", "std", "min", "max")])


ORACLES["table_describe"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean,
    round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS "min",
    round(CAST(max({c}) AS DOUBLE), 4) AS "max" FROM lineitem"""
    for c in _NUMERIC)


@query
def table_top_values(spark, sf_dir):
    out = reports.top_values(TrainingLog(spark, sf_dir).rows(), TRAINER)
    return out.withColumn("pct", r6("pct"))


ORACLES["table_top_values"] = sql("""SELECT trainer AS value, count(*) AS n,
  round(count(*) * 100e0 / (SELECT count(*) FROM log), 6) AS pct FROM log
GROUP BY trainer ORDER BY n DESC, value LIMIT 10""")


@query
def table_dates(spark, sf_dir):
    out = reports.date_profile(TrainingLog(spark, sf_dir).rows(), DAY)
    return out.select("first", "last", "n_unique", "missing")


ORACLES["table_dates"] = sql("""SELECT CAST(min(day) AS INT) AS first, CAST(max(day) AS INT) AS last,
  count(DISTINCT day) AS n_unique, count(*) - count(day) AS missing FROM log""")


@query
def class_balance(spark, sf_dir):
    out = reports.class_balance(TrainingLog(spark, sf_dir).train, list(LABELS.values()))
    return out.select("target", "value", "n", r6("pct").alias("pct"),
                      r6("imbalance").alias("imbalance"))


ORACLES["class_balance"] = sql("""SELECT target, value, n,
  round(n * 100e0 / sum(n) OVER (PARTITION BY target), 6) AS pct,
  round(min(n) OVER (PARTITION BY target) * 1e0 / max(n) OVER (PARTITION BY target), 6) AS imbalance
FROM (""" + " UNION ALL ".join(
    f"SELECT '{y}' AS target, {y} AS value, count(*) AS n FROM train GROUP BY {y}"
    for y in LABELS.values()) + ")")


@query
def monotone_check(spark, sf_dir):
    return metrics.monotone(rate_oof(spark, sf_dir), ["model", "fold"])


ORACLES["monotone_check"] = sql("""SELECT model, fold,
  CAST(bool_and(p07 <= p90 AND p90 <= p120) AS INT) AS monotone FROM oof GROUP BY model, fold""")


@query
def id_overlap(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    return reports.id_overlap(log.prior, log.train, PERSON)


ORACLES["id_overlap"] = sql("""SELECT (SELECT count(DISTINCT farmer_name) FROM prior) AS n_left,
  (SELECT count(DISTINCT farmer_name) FROM train) AS n_right,
  (SELECT count(*) FROM (SELECT farmer_name FROM prior INTERSECT SELECT farmer_name FROM train))
  AS n_shared""")


@query
def ranked_runs(spark, sf_dir):
    """Runs by true score, then by the score estimated without labels."""
    long = long_oof(spark, sf_dir)
    est = metrics.separation_auc(long, ["model", "horizon"], EXPECTED_RATES).join(
        expected_logloss(spark, sf_dir), ["model", "horizon"])
    share = metrics.score_share(F.col("horizon"), F.col("expected_log_loss"), r6("est_auc"))
    est = est.groupBy("model").agg(r6(F.sum(share)).alias("estimated_score"))
    runs = summaries(spark, sf_dir).select("model", r6("score").alias("train_score"))
    return runs.join(est, "model").orderBy(F.desc_nulls_last("train_score"),
                                           F.desc_nulls_last("estimated_score"))


ORACLES["ranked_runs"] = sql(f"""SELECT model, round(score, 6) AS train_score, estimated_score
FROM summary JOIN (SELECT model,
    round(sum({score_expr('expected_log_loss', 'est_auc')}), 6) AS estimated_score
    FROM exp_ll JOIN heur USING (model, horizon) GROUP BY model) e USING (model)
ORDER BY train_score DESC, estimated_score DESC""", {
    "exp_ll": ORACLES["expected_logloss"][ORACLES["expected_logloss"].rindex("SELECT model, horizon,"):],
    "heur": ORACLES["heuristic_auc"][ORACLES["heuristic_auc"].rindex("SELECT model, horizon,\n"):]})


# ---------------------------------------------------------------- score algebra

@query
def clip_scores(spark, sf_dir):
    rows = rate_oof(spark, sf_dir)
    return rows.select("model", ID, *[probability.clip(F.col(p), 0.02, 0.3).alias(p)
                                      for p in SCORES.values()])


ORACLES["clip_scores"] = sql(
    f"SELECT model, row_id, {labels('least(greatest(p{h}, 0.02e0), 0.3e0) AS p{h}')} FROM oof")


@query
def enforce_hierarchy(spark, sf_dir):
    """Scores of three models crossed so that they break the order, then repaired."""
    wide = blending.side_by_side(rate_oof(spark, sf_dir), MODELS)
    fixed = probability.ordered(F.col("p90_2"), F.col("p120_0"), F.col("p90_1"))
    return wide.select(ID, *[c.alias(p) for c, p in zip(fixed, SCORES.values())])


def _pick(model: str, p: str) -> str:
    return f"max(CASE WHEN model = '{model}' THEN {p} END)"


ORACLES["enforce_hierarchy"] = sql(f"""SELECT row_id, least(a, least(b, c)) AS p07,
  least(b, c) AS p90, c AS p120 FROM (SELECT row_id, {_pick(MODELS[2], 'p90')} AS a,
  {_pick(MODELS[0], 'p120')} AS b, {_pick(MODELS[1], 'p90')} AS c FROM oof GROUP BY row_id)""")


@query
def interval_labels(spark, sf_dir):
    z = probability.intervals(*[F.col(y) for y in LABELS.values()])
    return TrainingLog(spark, sf_dir).train.select(ID, *[c.alias(f"z{i + 1}")
                                                         for i, c in enumerate(z)])


ORACLES["interval_labels"] = sql(f"""SELECT row_id, {LABELS['07']} AS z1,
  {LABELS['90']} - {LABELS['07']} AS z2, {LABELS['120']} - {LABELS['90']} AS z3 FROM train""")


@query
def hazard_to_cumulative(spark, sf_dir):
    p = probability.cumulative(*[F.col(p) for p in SCORES.values()])
    return rate_oof(spark, sf_dir).select("model", ID, *[r6(c).alias(n)
                                                         for c, n in zip(p, SCORES.values())])


ORACLES["hazard_to_cumulative"] = sql("""SELECT model, row_id, round(1 - (1 - p07), 6) AS p07,
  round(1 - (1 - p07) * (1 - p90), 6) AS p90,
  round(1 - (1 - p07) * (1 - p90) * (1 - p120), 6) AS p120 FROM oof""")


@query
def fold_mean_scores(spark, sf_dir):
    """Unlabelled rows scored with every fold's ward rates, averaged over folds."""
    log = TrainingLog(spark, sf_dir)
    made = log_folds(log)
    counts = workspace.materialise(profiles.key_counts(log.train, ["ward"], made), "counts")
    rates = profiles.with_overall(counts).select("fold", F.col("key_value").alias("ward"), *[
        probability.smoothed(F.col(f"s{h}"), F.col("n"), F.col(f"g{h}")).alias(f"r{h}")
        for h in LABELS])
    # Every row is scored by every fold; wards a fold has not seen get its overall rate.
    numbers = F.array(*[F.lit(f.number) for f in made])
    rows = log.test.select(ID, "ward", F.explode(numbers).alias("fold"))
    scored = (rows.join(workspace.materialise(rates, "rates"), ["fold", "ward"], "left")
              .join(F.broadcast(profiles.overall_rates(counts)), "fold")
              .select(ID, *[F.coalesce(f"r{h}", f"g{h}").alias(p) for h, p in SCORES.items()]))
    out = blending.mean_scores(scored, [ID])
    return out.select(ID, *[r6(p).alias(p) for p in SCORES.values()])


ORACLES["fold_mean_scores"] = sql(
    f"SELECT row_id, {labels('round(avg(coalesce(r{h}, g{h})), 6) AS p{h}')} FROM test "
    "CROSS JOIN (SELECT * FROM fold_rate) f LEFT JOIN w ON w.fold = f.fold AND w.ward = test.ward "
    "GROUP BY row_id", {"w": f"""SELECT fold, ward,
        {labels('(sum({y}) + 10e0 * any_value(g{h})) / (count(*) + 10e0) AS r{h}')}
        FROM fold_train JOIN fold_rate USING (fold) GROUP BY fold, ward"""})

_WEIGHTS = {MODELS[0]: 0.6, MODELS[1]: 1.4, MODELS[2]: 0.5}


@query
def weighted_blend(spark, sf_dir):
    """Weights are clipped to [0, 1] and normalised."""
    out = blending.weighted_blend(rate_oof(spark, sf_dir), _WEIGHTS, [ID, "fold"])
    return out.select(ID, "fold", *[r6(p).alias(p) for p in SCORES.values()])


ORACLES["weighted_blend"] = sql("SELECT row_id, fold, " + labels(
    "round(sum(CASE model WHEN '%s' THEN 0.6e0 WHEN '%s' THEN 1e0 ELSE 0.5e0 END / 2.1e0 * p{h}), "
    "6) AS p{h}" % (MODELS[0], MODELS[1])) + " FROM oof GROUP BY row_id, fold")


@query
def blend_coverage(spark, sf_dir):
    return blending.coverage(rate_oof(spark, sf_dir))


ORACLES["blend_coverage"] = sql("""SELECT model, covered,
  CAST(min(covered) OVER () = max(covered) OVER () AS INT) AS equal_coverage
FROM (SELECT model, count(DISTINCT row_id) AS covered FROM oof GROUP BY model)""")


@query
def fixed_stack(spark, sf_dir):
    oof = rate_oof(spark, sf_dir)
    out = blending.stacked_mean(oof.where(F.col("model") == MODELS[0]),
                                oof.where(F.col("model") == MODELS[1]))
    return out.select(ID, *[F.round(p, 9).alias(p) for p in SCORES.values()])


ORACLES["fixed_stack"] = sql(f"""SELECT row_id, round(least(a, least(b, c)), 9) AS p07,
  round(least(b, c), 9) AS p90, round(c, 9) AS p120
FROM (SELECT row_id, avg(p07) AS a, avg(p90) AS b, avg(p120) AS c FROM oof
  WHERE model IN ('{MODELS[0]}', '{MODELS[1]}') GROUP BY row_id)""")

_STEPS = 4


def _best(spark, sf_dir, penalty):
    scored = blending.blend_scores(rate_oof(spark, sf_dir), MODELS,
                                   blending.simplex_grid(MODELS, _STEPS))
    base = summaries(spark, sf_dir).where(F.col("model") == BASE).select("worst_fold").first()[0]
    # Equal scores must not fall below the floor by rounding of the last digit.
    best = blending.best_blend(scored, base - 1e-9, penalty)
    return best.select(*[F.col(f"w_{m}") for m in MODELS], "feasible",
                       *[F.round(c, 5).alias(c) for c in ("objective", "score", "fold_std",
                                                          "worst_fold")])


@query
def constrained_blend(spark, sf_dir):
    """Best weights on the simplex whose worst fold is not below the first model's."""
    return _best(spark, sf_dir, 0.0)


@query
def penalised_blend(spark, sf_dir):
    """As the constrained blend, with half the fold spread taken off the score."""
    return _best(spark, sf_dir, 0.5)


def _blend_ctes() -> dict[str, str]:
    mixed = labels("0e0 + w0 * p{h}_0 + w1 * p{h}_1 + w2 * p{h}_2 AS p{h}")
    wide = ", ".join(f"{_pick(m, f'p{h}')} AS p{h}_{i}" for i, m in enumerate(MODELS)
                     for h in LABELS)
    return {
        "grid": f"""SELECT row_number() OVER (ORDER BY a, b) - 1 AS w_id, a / {_STEPS}e0 AS w0,
            b / {_STEPS}e0 AS w1, ({_STEPS} - a - b) / {_STEPS}e0 AS w2
            FROM range({_STEPS + 1}) t(a) CROSS JOIN range({_STEPS + 1}) u(b)
            WHERE a + b <= {_STEPS}""",
        "sides": f"SELECT row_id, fold, {labels('{y}')}, {wide} FROM oof "
                 f"GROUP BY row_id, fold, {labels('{y}')}",
        "mixed": f"SELECT w_id, fold, {labels('{y}')}, {mixed} FROM sides CROSS JOIN grid",
        "mixed_long": " UNION ALL ".join(
            f"SELECT w_id, fold, '{h}' AS horizon, p{h} AS p, {y} AS y FROM mixed"
            for h, y in LABELS.items()),
        "mixed_hist": """SELECT w_id, fold, horizon, p, CAST(count(*) AS DOUBLE) AS n,
            CAST(sum(y) AS DOUBLE) AS pos FROM mixed_long GROUP BY 1, 2, 3, 4""",
        "mixed_hist_all": """SELECT w_id, horizon, p, sum(n) AS n, sum(pos) AS pos
            FROM mixed_hist GROUP BY 1, 2, 3""",
        "mixed_fold": metric_cte("mixed_hist", "w_id, fold, horizon"),
        "mixed_all": metric_cte("mixed_hist_all", "w_id, horizon"),
        "mixed_stat": f"""SELECT w_id, stddev_pop(s) AS fold_std, min(s) AS worst_fold FROM (
            SELECT w_id, fold, sum({score_expr('log_loss', 'roc_auc')}) AS s
            FROM mixed_fold GROUP BY 1, 2) GROUP BY w_id""",
        "mixed_score": f"""SELECT w_id, sum({score_expr('log_loss', 'roc_auc')}) AS score
            FROM mixed_all GROUP BY w_id""",
    }


def _blend_sql(penalty: str) -> str:
    return sql(f"""SELECT w0 AS w_{MODELS[0]}, w1 AS w_{MODELS[1]}, w2 AS w_{MODELS[2]}, feasible,
      round(objective, 5) AS objective, round(score, 5) AS score, round(fold_std, 5) AS fold_std,
      round(worst, 5) AS worst_fold FROM (
      SELECT g.*, score, m.fold_std, m.worst_fold AS worst, score - {penalty} * m.fold_std AS objective,
        CAST(m.worst_fold >= b.worst_fold - 1e-9 AS INT) AS feasible
      FROM grid g JOIN mixed_score USING (w_id) JOIN mixed_stat m USING (w_id)
      JOIN fold_stat b ON b.model = '{BASE}')
    ORDER BY feasible DESC, round(objective, 9) DESC, w_id LIMIT 1""", _blend_ctes())


ORACLES["constrained_blend"] = _blend_sql("0e0")
ORACLES["penalised_blend"] = _blend_sql("0.5e0")


# ---------------------------------------------------------------- gates

@query
def gate_eval(spark, sf_dir):
    runs = summaries(spark, sf_dir)
    out = gates.evaluate_gates(runs.where(F.col("model") != BASE),
                               runs.where(F.col("model") == BASE))
    return out.select("model", "gate", "passed", "calibration_shift",
                      r6("d_score").alias("d_score"), r6("d_ll07").alias("d_ll07"))


def _gate_sql(g: gates.Gate) -> str:
    tests = []
    if g.score is not None:
        tests.append(f"d_score >= {g.score!r}")
    if g.ll07 is not None:
        tests.append(f"d_ll07 <= {g.ll07!r}")
    if g.auc_drop is not None:
        tests += [f"d_auc{h} >= -{g.auc_drop!r}" for h in LABELS]
    if g.auc07_drop is not None:
        tests.append(f"d_auc07 >= -{g.auc07_drop!r}")
    if g.last_fold is not None:
        tests.append(f"d_last >= {g.last_fold!r}")
    if g.fold_std is not None:
        tests.append(f"d_std <= {g.fold_std!r}")
    if g.worst_fold:
        tests.append("d_worst >= 0")
    return (f"SELECT model, '{g.name}' AS gate, CAST({' AND '.join(tests)} AS INT) AS passed, "
            "calibration_shift, d_score, d_ll07 FROM d")


ORACLES["gate_eval"] = sql(f"""SELECT model, gate, passed, calibration_shift,
  round(d_score, 6) AS d_score, round(d_ll07, 6) AS d_ll07 FROM (
  {' UNION ALL '.join(_gate_sql(g) for g in gates.GATES)})""", {
    "d": f"""SELECT c.model, c.score - b.score AS d_score, c.ll07 - b.ll07 AS d_ll07,
      {labels('c.auc{h} - b.auc{h} AS d_auc{h}')}, c.fold_std - b.fold_std AS d_std,
      c.worst_fold - b.worst_fold AS d_worst, c.last_fold - b.last_fold AS d_last,
      CAST(c.score <= b.score AND c.auc07 > b.auc07 AND c.ll07 > b.ll07 AS INT) AS calibration_shift
      FROM summary c JOIN summary b ON b.model = '{BASE}' AND c.model <> b.model"""})


@query
def reproducibility_check(spark, sf_dir):
    """The score computed twice, the second time on reshuffled rows."""
    oof = rate_oof(spark, sf_dir)
    keys = ["model", "horizon"]
    runs = None
    for rows in (oof, oof.repartition(7, ID)):
        hist = metrics.score_histogram(metrics.long_scores(rows, ["model", ID]), keys)
        run = metrics.weighted_score(metrics.metrics(hist, keys), ["model"])
        runs = run if runs is None else runs.unionByName(run)
    out = gates.reproducible(runs)
    return out.select("model", F.round(F.col("spread") + 0.0, 6).alias("spread"), "reproducible")


ORACLES["reproducibility_check"] = sql(
    "SELECT model, 0e0 AS spread, 1 AS reproducible FROM summary")


@query
def keep_rule(spark, sf_dir):
    """Each later model as a feature-group candidate, each fold as a probe against the first."""
    scored = per_fold(spark, sf_dir)
    folds_ = metrics.weighted_score(scored, ["model", "fold"])
    loss = scored.where(F.col("horizon") == "07").select("model", "fold", "log_loss")
    std = metrics.fold_stats(folds_, ["model"]).select("model", "fold_std")
    rows = workspace.materialise(folds_.join(loss, ["model", "fold"]).join(std, "model"), "probes")
    base = rows.where(F.col("model") == BASE).select(
        "fold", *[F.col(c).alias(f"b_{c}") for c in ("score", "log_loss", "fold_std")])
    changes = rows.where(F.col("model") != BASE).join(base, "fold").select(
        F.col("model").alias("feature_group"), (F.col("score") - F.col("b_score")).alias("d_score"),
        (F.col("log_loss") - F.col("b_log_loss")).alias("d_ll07"),
        (F.col("fold_std") - F.col("b_fold_std")).alias("d_std"))
    return gates.keep_rule(changes)


ORACLES["keep_rule"] = sql(f"""SELECT feature_group, CAST(NOT bool_or(d_score < -1e-4 OR d_ll07 > 5e-4
    OR d_std > 2e-3) AND bool_or(d_score > 1e-4) AS INT) AS keep
FROM (SELECT c.model AS feature_group, c.score - b.score AS d_score, c.ll - b.ll AS d_ll07,
    c.fold_std - b.fold_std AS d_std FROM probe c JOIN probe b
    ON b.model = '{BASE}' AND c.model <> b.model AND c.fold = b.fold) GROUP BY feature_group""", {
    "probe": """SELECT s.model, s.fold, s.score, m.log_loss AS ll, f.fold_std FROM fold_score s
      JOIN fold_metric m ON m.model = s.model AND m.fold = s.fold AND m.horizon = '07'
      JOIN fold_stat f ON f.model = s.model"""})


@query
def window_selection(spark, sf_dir):
    keys = ["model", "window", "horizon"]
    long = long_oof(spark, sf_dir).withColumn("window", folds.window_bucket(F.col("fold")))
    scored = metrics.weighted_score(metrics.metrics(metrics.score_histogram(long, keys), keys),
                                    ["model", "window"])
    out = gates.select_model(scored)
    return out.select("model", *[r6(c).alias(c) for c in ("mean_score", "std_score", "criterion")],
                      "top2", "place", "accepted")


ORACLES["window_selection"] = sql(f"""SELECT model, round(mean_score, 6) AS mean_score,
  round(std_score, 6) AS std_score, round(criterion, 6) AS criterion, top2, place,
  CAST(place = 1 AND top2 >= 3 AS INT) AS accepted FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY round(criterion, 9) DESC, model) AS INT) AS place
  FROM (SELECT model, avg(score) AS mean_score, stddev_pop(score) AS std_score,
    avg(score) - stddev_pop(score) AS criterion, CAST(sum(CAST(rk <= 2 AS INT)) AS INT) AS top2
    FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY round(score, 9) DESC, model) AS rk
      FROM win_score) GROUP BY model))""", {
    "win_hist": """SELECT model, least(fold, 4) AS win, horizon, p, sum(n) AS n, sum(pos) AS pos
        FROM hist GROUP BY 1, 2, 3, 4""",
    "win_metric": metric_cte("win_hist", "model, win, horizon"),
    "win_score": f"""SELECT model, win, sum({score_expr('log_loss', 'roc_auc')}) AS score
        FROM win_metric GROUP BY model, win"""})


# ---------------------------------------------------------------- sinks

_SUB_SQL = ", ".join(f"{{auc}}.p{h} AS \"Target_{h}_AUC\", {{ll}}.p{h} AS \"Target_{h}_LogLoss\""
                     for h in LABELS)


@query
def submission_roundtrip(spark, sf_dir):
    """Score file with ranking columns of a second model, written as CSV and read back."""
    oof = rate_oof(spark, sf_dir)
    made = sinks.submission(oof.where(F.col("model") == MODELS[0]),
                            oof.where(F.col("model") == MODELS[2]))
    path = workspace.fresh_path(spark, "submission")
    sinks.write_csv(made, path)
    return spark.read.schema(sinks.submission_schema()).csv(path, header=True)


ORACLES["submission_roundtrip"] = sql(
    f"""SELECT a.row_id AS "ID", {_SUB_SQL.format(ll='a', auc='b')} FROM oof a JOIN oof b
    ON a.row_id = b.row_id AND a.model = '{MODELS[0]}' AND b.model = '{MODELS[2]}'""")


@query
def score_cache(spark, sf_dir):
    """Scores cached under a version; a stale read (other row count) is refused."""
    oof = rate_oof(spark, sf_dir)
    cache = sinks.ScoreCache(spark, workspace.fresh_path(spark, "cache"))
    cache.save(oof, "v1")
    n = oof.count()
    assert cache.load("v2") is None and cache.load("v1", n + 1) is None
    return cache.load("v1", n).select("model", ID, "fold", *SCORES.values())


ORACLES["score_cache"] = sql("SELECT model, row_id, fold, p07, p90, p120 FROM oof")

_LEDGER = T.StructType([T.StructField("model", T.StringType()),
                        *[T.StructField(c, T.DoubleType()) for c in
                          ["score", *[f"ll{h}" for h in LABELS], *[f"auc{h}" for h in LABELS],
                           "fold_std", "worst_fold"]]])


@query
def metric_ledger(spark, sf_dir):
    path = workspace.fresh_path(spark, "ledger")
    sinks.write_ledger(summaries(spark, sf_dir).select(*_LEDGER.names), path)
    back = sinks.read_ledger(spark, path, _LEDGER)
    return back.select("model", *[r6(c).alias(c) for c in _LEDGER.names[1:]])


ORACLES["metric_ledger"] = sql("SELECT model, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in _LEDGER.names[1:]) + " FROM summary")


@query
def multi_file_scan(spark, sf_dir):
    """One score file per model, scanned with one glob and summarised per file."""
    oof = rate_oof(spark, sf_dir)
    folder = workspace.fresh_path(spark, "runs")
    for m in MODELS:
        sinks.write_csv(sinks.oof_submission(oof.where(F.col("model") == m)), f"{folder}/{m}")
    rows = sinks.read_submissions(spark, f"{folder}/*")
    return rows.groupBy("run").agg(F.count(F.lit(1)).alias("n_rows"), *[
        r6(F.avg(sinks.LOSS_COLUMN.format(h))).alias(f"mean_{h}") for h in LABELS])


ORACLES["multi_file_scan"] = sql(f"""SELECT model AS run, count(*) AS n_rows,
  {labels('round(avg(p{h}), 6) AS mean_{h}')} FROM oof GROUP BY model""")


@query
def raw_log_roundtrip(spark, sf_dir):
    """Raw CSV log (list literals, text dates) written, read and normalised in one projection."""
    rows = TrainingLog(spark, sf_dir).rows()
    topic = F.transform(TOPICS, lambda t: F.concat(F.lit("'"), t, F.lit("'")))
    raw = rows.select(
        F.col(ID).cast("string"), PERSON, F.date_format(DATE, "yyyy-MM-dd").alias(DATE),
        F.concat(F.lit("['"), F.col(TRAINER), F.lit("']")).alias(TRAINER),
        F.concat(F.lit("[["), F.array_join(topic, ", "), F.lit("]]")).alias(TOPICS), GROUP, *CATEGORICAL,
        *[F.col(c).cast("string").alias(c) for c in BINARY],
        *[F.when(F.col(y) == 1, "True").otherwise("False").alias(y) for y in LABELS.values()])
    path = workspace.fresh_path(spark, "rawlog")
    sinks.write_csv(raw, path)
    back = sinks.read_raw_log(spark, path)
    return back.select(ID, PERSON, DAY, TRAINER, F.array_join(TOPICS, "|").alias("topics"), GROUP, *CATEGORICAL, *BINARY,
                       *LABELS.values())


ORACLES["raw_log_roundtrip"] = sql(f"""SELECT row_id, farmer_name, CAST(day AS INT) AS day, trainer,
  array_to_string(topics, '|') AS topics, group_name, {', '.join([*CATEGORICAL, *BINARY])}, {labels('{y}')} FROM log""")


@query
def score_label_match(spark, sf_dir):
    """Rows scored and labelled, scored only, labelled only."""
    scores = rate_oof(spark, sf_dir).where(F.col("model") == BASE)
    return sinks.match_counts(scores, TrainingLog(spark, sf_dir).train, ID)


ORACLES["score_label_match"] = sql("""SELECT (SELECT count(*) FROM fold_val) AS matched, 0::BIGINT AS left_only,
  count(*) - (SELECT count(*) FROM fold_val) AS right_only FROM train""")
