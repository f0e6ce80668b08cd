"""Leakage, skew, shuffle settings and agreement with brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import LABELS
from tidemark.operators import calibration, factor, folds, graph, lookback, metrics, ranking
from tidemark.plans.scores import rate_oof
from tidemark.sources import sinks, workspace
from tidemark.sources.training_log import TrainingLog


@pytest.fixture(scope="module")
def skewed(spark):
    """Events where one person owns a third of all rows and one day of that person most of them."""
    rng = np.random.default_rng(7)
    n = 3000
    person = np.where(rng.random(n) < .34, "HOT", np.char.add("P", rng.integers(0, 60, n).astype(str)))
    day = rng.integers(0, 200, n)
    day = np.where((person == "HOT") & (rng.random(n) < .7), 77, day)
    pdf = pd.DataFrame({"row_id": np.arange(n), "farmer_name": person, "group_name": "G",
                        "day": day.astype("int32")})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_lookback_equals_brute_force_under_skew(skewed):
    pdf, df = skewed
    got = lookback.rolling_counts(df, df, [7, 30]).toPandas().set_index("row_id")
    for r in pdf.sample(200, random_state=1).itertuples():
        past = pdf[(pdf.day < r.day) & (pdf.day >= r.day - 30)]
        assert got.loc[r.row_id, "rolling_training_count_30d"] == len(past)
        assert got.loc[r.row_id, "rolling_farmer_training_count_30d"] == (
            past.farmer_name == r.farmer_name).sum()
        week = past[past.day >= r.day - 7]
        assert got.loc[r.row_id, "rolling_group_training_count_7d"] == len(week)


def test_window_holds_days_not_rows(skewed):
    pdf, df = skewed
    grid = lookback.day_grid(df, df, "farmer_name")
    hot = grid.where("farmer_name = 'HOT'")
    assert hot.count() <= 200 < (pdf.farmer_name == "HOT").sum()
    assert grid.agg(F.sum("_events")).first()[0] == len(pdf)


def test_no_leakage(spark, sf_dir):
    """Dropping all events at or after a cut-off leaves earlier rows' look-backs unchanged."""
    rows = TrainingLog(spark, sf_dir).rows()
    cut = 11000
    probe = rows.where(F.col("day") <= cut).select("row_id", "farmer_name", "day", "topics_list")
    full = lookback.topic_novelty(lookback.recency_intensity(probe, rows), rows)
    past = rows.where(F.col("day") < cut)
    cutoff = lookback.topic_novelty(lookback.recency_intensity(probe, past), past)
    assert full.exceptAll(cutoff).count() == 0


@pytest.mark.parametrize("partitions", ["1", "17"])
def test_results_do_not_depend_on_shuffle_partitions(spark, sf_dir, partitions):
    def run():
        long = metrics.long_scores(rate_oof(spark, sf_dir), ["model", "fold"])
        keys = ["model", "fold", "horizon"]
        out = metrics.metrics(metrics.score_histogram(long, keys), keys)
        return {tuple(r)[:3]: r for r in out.collect()}
    before = run()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        after = run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert before.keys() == after.keys()
    for k, r in before.items():
        assert after[k]["roc_auc"] == pytest.approx(r["roc_auc"], abs=1e-12)
        assert after[k]["log_loss"] == pytest.approx(r["log_loss"], abs=1e-12)


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    p = np.clip(np.round(rng.beta(2, 20, 4000), 4), .001, .999)
    p[:1300] = .05  # a third of all rows tie
    pdf = pd.DataFrame({"row_id": np.arange(4000), "k": "m", "horizon": "07", "p": p,
                        "y": (rng.random(4000) < p).astype("int32")})
    return pdf, spark.createDataFrame(pdf).repartition(6)


def brute_auc(pdf):
    rank = pdf.p.rank()
    pos = pdf.y.sum()
    return (rank[pdf.y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(pdf) - pos))


def test_auc_equals_rank_statistic_and_ignores_monotone_maps(scored):
    pdf, df = scored
    got = metrics.roc_auc(df, ["k"]).first()["roc_auc"]
    assert got == pytest.approx(brute_auc(pdf), abs=1e-12)
    squared = df.withColumn("p", F.col("p") * F.col("p"))
    assert metrics.roc_auc(squared, ["k"]).first()["roc_auc"] == pytest.approx(got, abs=1e-12)


def test_percentiles_equal_numpy(scored):
    pdf, df = scored
    row = ranking.exact_percentiles(df, ["k"], "p", {"m": .5, "q": .95, "e": 0.0, "z": 1.0}).first()
    assert [row[c] for c in "mqez"] == pytest.approx(list(np.quantile(pdf.p, [.5, .95, 0, 1])))
    whole = ranking.exact_percentiles(df, [], "p", {"m": .5}).first()
    assert whole["m"] == pytest.approx(np.quantile(pdf.p, .5))


def test_recall_cuts_a_large_tie_by_id(scored):
    pdf, df = scored
    order = pdf.sort_values(["p", "row_id"], ascending=[False, True])
    for share in (.05, .5, 1.0):
        got = metrics.recall_at(df, ["k"], [share]).first()["recall"]
        assert got == pytest.approx(order.head(int(np.ceil(4000 * share))).y.sum() / pdf.y.sum())


def test_positions_are_dense_for_a_key_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("string").alias("k"),
                                  F.md5(F.col("id").cast("string")).alias("h"))
    out = ranking.ordered_position(df, ["k"], [F.col("h")], "pos").toPandas()
    for _, part in out.groupby("k"):
        assert list(part.sort_values("h").pos) == list(range(1, len(part) + 1))


def test_stratified_folds_are_balanced(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") < 50).cast("int").alias("y"))
    out = folds.stratified_folds(df, "y").groupBy("y", "fold").count().toPandas()
    assert set(out[out.y == 1]["count"]) == {10} and set(out[out.y == 0]["count"]) == {190}


def test_calibrators(scored):
    pdf, df = scored
    bent = df.withColumn("p", F.col("p") / 2 + 0.3)
    hist = workspace.materialise(metrics.score_histogram(bent, []), "hist")
    losses, prevalence = {}, pdf.y.mean()
    for m in calibration.FITTERS:
        out = calibration.fit(m, hist)(bent, "p", "q").toPandas()
        assert out.q.between(.001, .999).all()
        losses[m] = -(out.y * np.log(out.q) + (1 - out.y) * np.log(1 - out.q)).mean()
        ordered = out.sort_values("p")
        if m in ("isotonic", "platt", "beta"):
            assert ordered.q.is_monotonic_increasing
    flat = -(prevalence * np.log(prevalence) + (1 - prevalence) * np.log(1 - prevalence))
    assert losses["isotonic"] <= min(losses.values()) + 1e-9 and losses["isotonic"] < flat
    assert losses["beta"] < losses["none"] and losses["platt"] < losses["none"]


def test_beta_parts():
    x = np.array([.1, .5, .9])
    assert calibration.beta_cdf(x, 1, 1) == pytest.approx(x)
    assert calibration.beta_cdf(x, 2, 1) == pytest.approx(x ** 2)
    assert calibration.beta_cdf(x, 1, 3) == pytest.approx(1 - (1 - x) ** 3)
    rng = np.random.default_rng(0)
    s = rng.beta(2.0, 9.0, 200_000)
    a, b = calibration.beta_shape(np.log(s).mean(), np.log1p(-s).mean(), s.mean(), s.var())
    assert (a, b) == (pytest.approx(2.0, rel=.02), pytest.approx(9.0, rel=.02))


def test_beta_density_with_one_positive_gives_prevalence(spark):
    hist = spark.createDataFrame([(.2, 9, 0), (.7, 1, 1)], "p double, n long, pos long")
    out = calibration.fit("beta_density", hist)(spark.createDataFrame([(.3,)], "p double"), "p", "q")
    assert out.first()["q"] == pytest.approx(.1)


def test_svd_equals_numpy(spark):
    rng = np.random.default_rng(5)
    u, _ = np.linalg.qr(rng.normal(size=(60, 6)))
    v, _ = np.linalg.qr(rng.normal(size=(25, 6)))
    a = u @ np.diag([40, 20, 10, 5, 2, 1]) @ v.T
    cells = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i in range(60) for j in range(25)],
                                  "row long, col long, value double")
    right, values = factor.truncated_svd(cells, 4, oversample=2, tolerance=1e-6)
    assert values[:4] == pytest.approx([40, 20, 10, 5], rel=1e-3)
    rows = factor.project(cells, right, 4).toPandas().sort_values("row")
    norms = np.sqrt((rows[[f"f{i}" for i in range(4)]] ** 2).sum())
    assert list(norms) == pytest.approx([40, 20, 10, 5], rel=1e-2)


def test_walks_follow_edges(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    edge = workspace.materialise(graph.edges(log.test), "edges")
    known = {(r["src"], r["dst"]) for r in edge.collect()}
    paths = [r["path"] for r in graph.walks(edge, 2, 6).collect()]
    nodes = {s for s, _ in known}
    assert len(paths) == 2 * len(nodes)
    assert all(len(p) == 6 and all(step in known for step in zip(p, p[1:])) for p in paths)


def test_score_cache_refuses_wrong_count(spark):
    cache = sinks.ScoreCache(spark, workspace.fresh_path(spark, "cache"))
    cache.save(spark.range(3), "v1")
    assert cache.load("v0") is None and cache.load("v1", 4) is None
    assert cache.load("v1", 3).count() == 3


def test_labels_are_nested(spark, sf_dir):
    y07, y90, y120 = (F.col(y) for y in LABELS.values())
    assert TrainingLog(spark, sf_dir).train.where((y07 > y90) | (y90 > y120)).count() == 0


def test_walk_contexts_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    paths = [[f"n{x}" for x in rng.integers(0, 9, 20)] for _ in range(30)]
    df = spark.createDataFrame([(p,) for p in paths], "path array<string>")
    for window in (1, 3, 10, 30):
        want: dict = {}
        for p in paths:
            for i, a in enumerate(p):
                for j, b in enumerate(p):
                    if i != j and abs(i - j) <= window:
                        want[a, b] = want.get((a, b), 0) + 1
        got = {(r["row"], r["col"]): r["cnt"] for r in graph.walk_contexts(df, window).collect()}
        assert got == want


def test_score_buckets_are_monotone_and_fine_near_zero(spark):
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.normal(size=3000) * 3, rng.uniform(0.001, 0.02, 5000), [0.0, 1.0, -1.0]])
    rows = spark.createDataFrame([(float(x),) for x in p], "p double").withColumn(
        "b", ranking.score_bucket(F.col("p"))).orderBy("p").toPandas()
    assert (np.diff(rows.b) >= 0).all()
    small = rows[(rows.p >= 0.001) & (rows.p <= 0.02)]
    assert small.b.nunique() > 2500 and small.groupby("b").size().max() <= 12


def test_small_lookups_are_broadcast_beside_a_large_one(spark):
    from tidemark.config import CATEGORICAL, TRAINER
    from tidemark.operators import encoding
    wide = ", ".join(f"'v' || id % 5 AS {c}" for c in CATEGORICAL)
    rows = spark.range(30000).selectExpr(f"'T' || id AS {TRAINER}", *wide.split(", "))
    codes = workspace.Parts(encoding.category_codes([rows], [*CATEGORICAL, TRAINER]), "codes", "col")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000")
    try:
        out = encoding.attach_codes(rows, codes, [*CATEGORICAL, TRAINER])
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("BroadcastHashJoin") == len(CATEGORICAL) and plan.count("SortMergeJoin") == 1


def test_shared_table_is_rebuilt_when_sources_change(spark, tmp_path):
    source = str(tmp_path / "t.parquet")
    made = []

    def build():
        made.append(1)
        return spark.read.parquet(source)
    spark.range(3).write.parquet(source)
    assert workspace.shared(spark, f"probe:{tmp_path}", build).count() == 3
    assert workspace.shared(spark, f"probe:{tmp_path}", build).count() == 3 and len(made) == 1
    spark.range(5).write.mode("append").parquet(source)
    assert workspace.shared(spark, f"probe:{tmp_path}", build).count() == 8
