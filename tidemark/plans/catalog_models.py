"""Registered queries that fit models.

Fitted values have no SQL. What must hold for every row of a run has: each ``<run>_invariants`` query puts the run's rows
beside SQL that derives them from the tables, so that coverage, folds, labels, range and promised order are checked exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.config import CLIP_HIGH, CLIP_LOW, ID, LABELS, SCORES, SEED
from tidemark.functions.probability import clip, ordered
from tidemark.operators import blending, calibration, metrics
from tidemark.plans import oof, search
from tidemark.plans.oracle import labels, sql
from tidemark.sources import sinks, workspace

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _gbt(spark, sf_dir):
    return oof.saved(spark, sf_dir, "gbt", lambda: oof.gbt(spark, sf_dir))


@query
def gbt_oof(spark, sf_dir):
    return _gbt(spark, sf_dir)


@query
def boosting_stages(spark, sf_dir):
    """Per fold and label of the boosted run: rounds grown until patience ran out, the kept stage and its validation loss."""
    return oof.fold_models(spark, sf_dir).groupBy("fold", "label").agg(
        F.max("grown").alias("rounds"), F.max("stage").alias("stage"), F.max("loss").alias("log_loss"))


@query
def fold_averaged_scores(spark, sf_dir):
    """Test rows under the stored trees of every fold, averaged."""
    return oof.fold_averaged(spark, sf_dir)


def _dual(spark, sf_dir):
    return oof.saved(spark, sf_dir, "dual_head", lambda: oof.dual_head(spark, sf_dir))


@query
def dual_head_oof(spark, sf_dir):
    return _dual(spark, sf_dir)


@query
def dual_head_metrics(spark, sf_dir):
    """Log-loss of the loss head and AUC of the ranking head, judged together by horizon."""
    return oof.dual_metrics(_dual(spark, sf_dir))


@query
def source_weighted_oof(spark, sf_dir):
    return oof.saved(spark, sf_dir, "source_weighted", lambda: oof.source_weighted(spark, sf_dir))


@query
def stacking_oof(spark, sf_dir):
    return oof.saved(spark, sf_dir, "stacking", lambda: oof.stacking(spark, sf_dir))


@query
def encoded_oof(spark, sf_dir):
    return oof.saved(spark, sf_dir, "encoded", lambda: oof.encoded(spark, sf_dir))


@query
def encoded_by_day_oof(spark, sf_dir):
    return oof.saved(spark, sf_dir, "encoded-by-day", lambda: oof.encoded(spark, sf_dir, by_day=True))


@query
def encoding_gate(spark, sf_dir):
    """Gate of the encodings, as published and by day, against the plain trees."""
    return search.gated({"encoded": encoded_oof(spark, sf_dir), "encoded_by_day": encoded_by_day_oof(spark, sf_dir)}, _gbt(spark, sf_dir), "E5")


@query
def elastic_net_oof(spark, sf_dir):
    return oof.saved(spark, sf_dir, "elastic_net", lambda: oof.elastic_net(spark, sf_dir))


@query
def drift_weighted_oof(spark, sf_dir):
    return oof.saved(spark, sf_dir, "drift_weighted", lambda: oof.drift_weighted(spark, sf_dir))


@query
def hazard_oof(spark, sf_dir):
    return oof.saved(spark, sf_dir, "hazard", lambda: oof.hazard(spark, sf_dir))


@query
def interval_mlp_oof(spark, sf_dir):
    return oof.saved(spark, sf_dir, "interval_network", lambda: oof.interval_network(spark, sf_dir))


def _warm_cold(spark, sf_dir):
    return oof.saved(spark, sf_dir, "warm_cold", lambda: oof.warm_cold(spark, sf_dir))


@query
def warm_cold_oof(spark, sf_dir):
    return _warm_cold(spark, sf_dir)


@query
def cohort_calibration(spark, sf_dir):
    return oof.saved(spark, sf_dir, "cohort", lambda: oof.cohort_calibrated(
        _warm_cold(spark, sf_dir), min_rows=oof.COHORT_MIN_ROWS))


@query
def text_view_oof(spark, sf_dir):
    return oof.saved(spark, sf_dir, "text", lambda: oof.text_view(spark, sf_dir))


@query
def graph_view_oof(spark, sf_dir):
    return oof.saved(spark, sf_dir, "graph", lambda: oof.graph_view(spark, sf_dir))


@query
def walk_view_oof(spark, sf_dir):
    return oof.saved(spark, sf_dir, "walk", lambda: oof.walk_view(spark, sf_dir))


@query
def onehot_lr(spark, sf_dir):
    return oof.one_hot_baseline(spark, sf_dir)


@query
def full_scoring_run(spark, sf_dir):
    """Calibrated, ordered test scores in score-file form, written and read back."""
    path = workspace.fresh_path(spark, "submission")
    sinks.write_csv(sinks.submission(oof.full_run(spark, sf_dir)), path)
    return spark.read.schema(sinks.submission_schema()).csv(path, header=True)


@query
def calibrators(spark, sf_dir):
    """Run summary of the boosted scores under each calibrator, both beta forms included."""
    long = oof.calibrated(_gbt(spark, sf_dir), [*calibration.METHODS, "beta_density"])
    return metrics.run_summary(workspace.materialise(long, "calibrated"), ["model"])


def _calibrated(spark, sf_dir):
    return oof.saved(spark, sf_dir, "calibrated", lambda: oof.calibrated(_gbt(spark, sf_dir)))


@query
def calibrator_search(spark, sf_dir):
    return search.calibrator_search(_calibrated(spark, sf_dir))


@query
def calibrator_blend(spark, sf_dir):
    return blending.calibrator_blend(_calibrated(spark, sf_dir), calibration.METHODS, steps=10)


def _systems(spark, sf_dir):
    """Six out-of-fold systems under one roof: plain, calibrated, ranking, hazard, history-weighted and drift-weighted trees."""
    rank = _dual(spark, sf_dir).drop(*SCORES.values()).withColumnsRenamed({p.replace("p", "a"): p for p in SCORES.values()})
    parts = {"gbt": _gbt(spark, sf_dir), "isotonic": _calibrated(spark, sf_dir).where(F.col("model") == "isotonic"), "rank": rank,
             "hazard": oof.saved(spark, sf_dir, "hazard", lambda: oof.hazard(spark, sf_dir)),
             "source": source_weighted_oof(spark, sf_dir), "drift": drift_weighted_oof(spark, sf_dir)}
    long = None
    for name, rows in parts.items():
        part = rows.select(F.lit(name).alias("model"), ID, "fold", *SCORES.values(), *LABELS.values())
        long = part if long is None else long.unionByName(part)
    return list(parts), long


def _described(spark, found):
    return spark.createDataFrame([(*map(float, found["weights"].values()), *(float(found[c]) for c in ("score", "fold_std", "worst_fold")), int(found["feasible"]), found["passes"])],
                                 ", ".join(f"w_{m} double" for m in found["weights"]) + ", score double, fold_std double, worst_fold double, feasible int, passes int")


@query
def model_blend(spark, sf_dir):
    """Six systems blended by descent on the simplex, the worst fold not below the plain trees'; coverage must be equal."""
    names, long = _systems(spark, sf_dir)
    table = blending.sides(workspace.materialise(long, "systems"), names)
    folds = sorted(r["fold"] for r in table.select("fold").distinct().collect())
    plain = blending.judged(table, np.eye(len(names))[:1], folds)[0]
    return _described(spark, blending.descend(table, names, floor=plain["worst_fold"] - 1e-9))


@query
def multi_view_blend(spark, sf_dir):
    """Tabular, text and graph views: the blend with the best score less half its fold spread,
    clipped and ordered."""
    names = [ID, "fold", *SCORES.values(), *LABELS.values()]
    views = {"tabular": _calibrated(spark, sf_dir).where(F.col("model") == "isotonic"),
             "text": text_view_oof(spark, sf_dir), "graph": graph_view_oof(spark, sf_dir)}
    long = None
    for view, rows in views.items():
        part = rows.select(F.lit(view).alias("model"), *names)
        long = part if long is None else long.unionByName(part)
    long = workspace.materialise(long, "views")
    best = blending.descend(blending.sides(long, list(views)), list(views), penalty=0.5)
    mixed = blending.weighted_blend(long, best["weights"],
                                    [ID, "fold", *LABELS.values()])
    fixed = [clip(p) for p in ordered(*[clip(F.col(p)) for p in SCORES.values()])]
    return mixed.select(ID, "fold", *[c.alias(p) for c, p in zip(fixed, SCORES.values())],
                        *LABELS.values())


@query
def importance(spark, sf_dir):
    return search.importance(spark, sf_dir, LABELS["07"], top=20)


@query
def group_ablation(spark, sf_dir):
    return search.group_ablation(spark, sf_dir)


@query
def category_ablation(spark, sf_dir):
    return search.category_ablation(spark, sf_dir)


@query
def param_search(spark, sf_dir):
    return search.param_search(spark, sf_dir, trials=30)


@query
def refit_reproducibility(spark, sf_dir):
    """Three refits under one seed must agree, refits under two seeds must not."""
    found = search.refits(spark, sf_dir, {"one_seed": [SEED] * 3, "two_seeds": [SEED, SEED + 1]})
    return found.select("model", "reproducible")


ORACLES["refit_reproducibility"] = "SELECT 'one_seed' AS model, CAST(1 AS INT) AS reproducible UNION ALL SELECT 'two_seeds', 0"


# ---------------------------------------------------------------- invariants of the runs

#: Runs over all validation windows, and whether their horizons must be ordered.
_RUNS = {"gbt_oof": False, "dual_head_oof": False, "source_weighted_oof": False, "stacking_oof": False, "elastic_net_oof": False,
         "encoded_oof": False, "encoded_by_day_oof": False,
         "drift_weighted_oof": False, "hazard_oof": True, "interval_mlp_oof": True, "warm_cold_oof": False, "cohort_calibration": True,
         "text_view_oof": False, "graph_view_oof": False, "walk_view_oof": False, "multi_view_blend": True}


def _invariants(name: str, nested: bool):
    def run(spark, sf_dir):
        rows = QUERIES[name](spark, sf_dir)
        inside = [F.col(p).between(CLIP_LOW, CLIP_HIGH) for p in SCORES.values()]
        kept = inside[0] & inside[1] & inside[2]
        order = (F.col("p07") <= F.col("p90") + 1e-12) & (F.col("p90") <= F.col("p120") + 1e-12)
        return rows.select(ID, F.col("fold").cast("int").alias("fold"), *[F.col(y).cast("int").alias(y) for y in LABELS.values()],
                           kept.cast("int").alias("in_range"), (order if nested else F.lit(True)).cast("int").alias("in_order"))
    return run


for _name, _nested in _RUNS.items():
    QUERIES[f"{_name}_invariants"] = _invariants(_name, _nested)
    ORACLES[f"{_name}_invariants"] = sql(f"SELECT row_id, fold, {labels('{y}')}, 1 AS in_range, 1 AS in_order FROM fold_val")
