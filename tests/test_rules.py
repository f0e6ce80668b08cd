"""Hand-made inputs with expected values (FIXTURES.md, section 5)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.config import FARM_KEYWORDS, LABELS
from tidemark.functions import fields, probability
from tidemark.functions.calendar import date_parts
from tidemark.operators import (blending, encoding, folds, gates, graph, lookback, metrics,
                                profiles, weights)


def one(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("raw, expected", [
    ("['TRA_a']", "TRA_a"), ("TRA_b", "TRA_b"), ("['TRA_a', 'TRA_b']", "TRA_a,TRA_b"),
    (None, "UNKNOWN"), ("weird", "weird"), ("['TRA_10', 'TRA_21 ']", "TRA_10,TRA_21")])
def test_trainer(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "x string")
    assert one(df.select(fields.trainer_name(F.col("x")))) == [(expected,)]


@pytest.mark.parametrize("raw, expected", [
    ("[['B','A'],['C','A']]", ["A", "B", "C"]), ("['B ',\"Farmer's\"]", ["B", "Farmer's"]),
    ("['x',['y','x']]", ["x", "y"]), ("[]", []), ("[[]]", []), (None, []), ("garbage", []),
    ("['a0', 'b1']", ["a0", "b1"])])
def test_topics(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "x string")
    assert one(df.select(fields.topic_array(F.col("x")))) == [(expected,)]


def test_keyword_flags_ignore_case_and_null(spark):
    df = spark.createDataFrame([(["Dairy COW"],), ([],), (None,)], "t array<string>")
    flag = fields.keyword_flags(F.col("t"), {"d": ["cow", "calf"]})["topic_cat_d"]
    assert one(df.select(flag)) == [(1,), (0,), (0,)]


def test_topic_tokens_are_whole_and_drop_blanks(spark):
    df = spark.createDataFrame([(["a b", " ", "x" * 60],)], "t array<string>")
    assert one(df.select(fields.topic_tokens(F.col("t")))) == [(["topic_a_b", "topic_" + "x" * 60],)]


def test_bad_date_is_null(spark):
    df = spark.createDataFrame([("2024-02-30",), ("nope",), ("2024-03-09",)], "x string")
    assert [r[0] for r in one(df.select(fields.parse_date(F.col("x"))))] == [
        None, None, dt.date(2024, 3, 9)]


def test_date_parts(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30),)], "d date")  # a Monday of ISO week 1
    assert one(df.select(*date_parts(F.col("d")).values())) == [(12, 0, 365, 4, 1, 0, 0, 1)]


@pytest.mark.parametrize("p, expected", [((.5, .3, .2), (.2, .2, .2)), ((.1, .4, .3), (.1, .3, .3))])
def test_hierarchy(spark, p, expected):
    df = spark.createDataFrame([p], "a double, b double, c double")
    assert one(df.select(*probability.ordered(F.col("a"), F.col("b"), F.col("c")))) == [expected]


def test_hazard(spark):
    df = spark.createDataFrame([(.1, .2, .5)], "a double, b double, c double")
    got = one(df.select(*probability.cumulative(F.col("a"), F.col("b"), F.col("c"))))[0]
    assert got == pytest.approx((.1, .28, .64))


@pytest.mark.parametrize("y, z", [((0, 1, 1), (0, 1, 0)), ((0, 0, 1), (0, 0, 1)), ((1, 1, 1), (1, 0, 0))])
def test_intervals(spark, y, z):
    df = spark.createDataFrame([y], "a int, b int, c int")
    assert one(df.select(*probability.intervals(F.col("a"), F.col("b"), F.col("c")))) == [z]


def test_confidence_and_support(spark):
    df = spark.createDataFrame([(10, 2, .1), (9, 5, .1)], "n int, s int, g double")
    plain = one(df.select(*probability.confidence(F.col("s"), F.col("n"), F.col("g"))))[0]
    assert plain == pytest.approx((.15, math.sqrt(.15 * .85 / 20), 0.0), abs=1e-6)
    thin = one(df.select(*probability.confidence(F.col("s"), F.col("n"), F.col("g"), 10)))[1]
    assert thin == pytest.approx((.1, 1.0, 0.0))


def history(spark, days, person="P"):
    return spark.createDataFrame([(person, d) for d in days], "farmer_name string, day int")


def probe(spark, *rows):
    return spark.createDataFrame(list(rows), "row_id long, farmer_name string, day int")


RECENCY = ["days_since_last_training", "trainings_last_30d", "trainings_last_90d",
           "recent_training_momentum"]


@pytest.mark.parametrize("days, day, expected", [
    ([0, 40, 69, 70], 70, (1, 2, 3, 2.0)), ([], 70, (999, 0, 0, 0.0)),
    ([5, 20, 35], 60, (25, 1, 3, -.5)), ([70, 71], 70, (999, 0, 0, 0.0))])
def test_recency(spark, days, day, expected):
    out = lookback.recency_intensity(probe(spark, (1, "P", day)), history(spark, days))
    assert one(out.select(*RECENCY)) == [expected]


def test_recency_without_person(spark):
    out = lookback.recency_intensity(probe(spark, (1, None, 50)), history(spark, [1, 2], None))
    assert one(out.select(*RECENCY)) == [(999, 0, 0, 0.0)]


def test_two_level_cutoff(spark):
    past = history(spark, range(0, 100)).where(F.col("day") < 60)
    out = lookback.recency_intensity(probe(spark, (1, "P", 100)), past)
    assert one(out.select(*RECENCY))[0][:2] == (41, 0)


def test_novelty(spark):
    rows = spark.createDataFrame([
        (1, "P", 10, ["a", "b", "c"]), (2, "P", 10, []), (3, "Q", 10, ["a"]), (4, "P", 5, ["b"]),
        (5, "P", 10, ["B", "b"])], "row_id long, farmer_name string, day int, topics_list array<string>")
    past = spark.createDataFrame([("P", 5, ["B"])],
                                 "farmer_name string, day int, topics_list array<string>")
    out = lookback.topic_novelty(rows, past).select(
        "row_id", "topic_diversity", "topic_novelty", "repeat_topic_ratio").orderBy("row_id")
    got = one(out)
    assert got[0] == pytest.approx((1, 1.0, 2 / 3, 1 / 3))
    assert got[1:] == [(2, 0.0, 0.0, 0.0), (3, 1.0, 1.0, 0.0), (4, 1.0, 1.0, 0.0), (5, .5, 0.0, 1.0)]


def test_lag_inside_and_outside(spark):
    out = lookback.lag_days(probe(spark, (1, "P", 20)), history(spark, [1]), [7, 30])
    row = out.first()
    assert row["days_since_last_training_7d"] == 19 and row["days_since_last_training_30d"] == 0
    assert row["days_since_farmer_last_training_7d"] == 19


def test_fold_fractions(spark):
    rows = spark.createDataFrame([(d,) for d in range(0, 1201)], "day int")
    made = folds.forward_folds(rows)
    assert [f.cutoff / 1200 for f in made] == pytest.approx([.416667, .533333, .65, .766667, .883333], abs=1e-6)
    assert made[-1].end == pytest.approx(1200)  # exclusive: the last day is never validated
    first = folds.cutoff_folds(rows)[0]
    assert first.cutoff == pytest.approx(360)


def test_embargo_only_shortens_training(spark):
    rows = spark.createDataFrame([(d,) for d in range(0, 1201)], "day int")
    plain, gapped = folds.forward_folds(rows), folds.forward_folds(rows, embargo_days=100)
    assert [(f.cutoff, f.end) for f in plain] == [(f.cutoff, f.end) for f in gapped]
    counts = [folds.fold_roles(rows, f).groupBy("fold", "role").count().collect() for f in (plain, gapped)]
    size = [{(r["fold"], r["role"]): r["count"] for r in c} for c in counts]
    assert all(size[1][k] == n - (100 if k[1] == "train" else 0) for k, n in size[0].items())


def test_farm_keywords(spark):
    df = spark.createDataFrame([(["Calf feeding", "PPE use"],)], "t array<string>")
    flags = fields.keyword_flags(F.col("t"), FARM_KEYWORDS)
    assert one(df.select(*flags.values())) == [(1, 0, 0, 1)]


def test_holdout_null_goes_to_validation(spark):
    df = spark.createDataFrame([(1,), (9,), (None,)], "day int")
    assert one(df.select(folds.holdout_role(F.col("day"), F.lit(5)))) == [("train",), ("val",), ("val",)]


def scores(spark, rows):
    return spark.createDataFrame(rows, "k string, p double, y int")


def test_auc_ties_and_one_class(spark):
    tied = scores(spark, [("a", .2, 0), ("a", .2, 1), ("a", .8, 1), ("a", .1, 0)])
    assert one(metrics.roc_auc(tied, ["k"])) == [("a", .875)]
    single = scores(spark, [("a", .2, 1), ("a", .8, 1)])
    assert one(metrics.roc_auc(single, ["k"])) == [("a", .5)]


def test_weighted_score_of_published_metrics(spark):
    df = spark.createDataFrame([
        ("m", "07", .0620089539140557, .9012055756636176), ("m", "90", .06859651540827774, .8816411542042603),
        ("m", "120", .07618833257581831, .8742021309526757)],
        "model string, horizon string, log_loss double, roc_auc double")
    assert one(metrics.weighted_score(df, ["model"]))[0][1] == pytest.approx(.8894521798166416)


def test_published_fold_spread(spark):
    df = spark.createDataFrame([("m", i + 1, s) for i, s in enumerate(
        [.9260042497954609, .8968285464255026, .8580484369504973, .8516773452753997, .8817285852605995])],
        "model string, fold int, score double")
    row = metrics.fold_stats(df, ["model"]).first()
    assert row["fold_std"] == pytest.approx(.02700295636646509)
    assert (row["worst_fold"], row["last_fold"]) == (.8516773452753997, .8817285852605995)


def test_pair_encoding_shrinks(spark):
    y = ", ".join(f"{c} int" for c in LABELS.values())
    rows = spark.createDataFrame(
        [("T", "G", "W", ["a"], int(i < 3), 1, 1) for i in range(5)]
        + [("U", "G", "W", [], 0, 1, 1) for _ in range(10)],
        f"trainer string, group_name string, ward string, topics_list array<string>, {y}")
    got = encoding.pair_encoding(rows).where("kind = 'trainer'").first()
    assert (got["n"], got["rate07"]) == (5, pytest.approx((3 + 10 * .2) / 15))


def test_ppmi_small(spark):
    counts = spark.createDataFrame([("p", "a", 1), ("q", "b", 1)], "person string, entity string, cnt long")
    assert [r["ppmi"] for r in graph.ppmi(counts).collect()] == [0.0, 0.0]


def test_blend_with_one_hot_weight_is_the_model(spark, sf_dir):
    from tidemark.plans.scores import rate_oof
    oof = rate_oof(spark, sf_dir)
    mixed = blending.weighted_blend(oof, {"ward_rate": 1.0, "group_rate": 0.0}, ["row_id"])
    own = oof.where("model = 'ward_rate'").select("row_id", "p07", "p90", "p120")
    assert mixed.exceptAll(own).count() == 0 and own.count() == mixed.count()


def test_grid_and_refinement():
    grid = blending.simplex_grid(["a", "b", "c"], 20)
    assert len(grid) == 231 and all(abs(sum(g.values()) - 1) < 1e-9 for g in grid)
    near = blending.around({"a": .5, "b": .5, "c": 0.0}, 4, 5)
    assert all(abs(g["a"] - .5) <= .25 + 1e-9 for g in near) and {"a": .5, "b": .5, "c": 0.0} in near


def test_gates_reject_and_accept(spark):
    cols = "model string, score double, ll07 double, auc07 double, auc90 double, auc120 double, " \
           "fold_std double, worst_fold double, last_fold double, monotone int"
    base = spark.createDataFrame([("b", .8, .07, .8, .8, .8, .03, .7, .75, 1)], cols)
    cand = spark.createDataFrame([("c", .81, .06, .79, .79, .79, .02, .71, .77, 1),
                                  ("d", .79, .08, .9, .8, .8, .03, .69, .75, 1)], cols)
    got = {(r["model"], r["gate"]): r["passed"] for r in gates.evaluate_gates(cand, base).collect()}
    assert all(got["c", g.name] == 1 for g in gates.GATES if g.name != "E3")
    assert got["c", "E3"] == 0 and not any(got["d", g.name] for g in gates.GATES)
    shift = {r["model"]: r["calibration_shift"] for r in gates.evaluate_gates(cand, base).collect()}
    assert shift == {"c": 0, "d": 1}


def test_keep_rule(spark):
    rows = [("a", .01, 0.0, 0.0), ("a", 0.0, 0.0, 0.0), ("b", .01, .001, 0.0), ("c", 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "feature_group string, d_score double, d_ll07 double, d_std double")
    assert {r[0]: r[1] for r in gates.keep_rule(df).collect()} == {"a": 1, "b": 0, "c": 0}


def test_weights_have_mean_one(spark):
    df = spark.createDataFrame([(d,) for d in (0, 10, 30, 60)], "day int")
    got = [r["weight"] for r in weights.recency_weight(df).orderBy("day").collect()]
    assert sum(got) / 4 == pytest.approx(1.0) and got[-1] / got[0] == pytest.approx(2.0)


def test_unseen_key_gets_half_in_every_encoding_column(spark):
    y = ", ".join(f"{c} int" for c in LABELS.values())
    train = spark.createDataFrame([("A", 0, 1, 1)] * 12, f"trainer string, {y}")
    table = profiles.target_encoding(profiles.key_counts(train, ["trainer"]))
    row = profiles.attach_encodings(spark.createDataFrame([("Z",)], "trainer string"), table,
                                    ["trainer"]).first()
    assert {v for k, v in row.asDict().items() if k.startswith("te_")} == {.5}
