"""Spark ML learners and the fold-wise out-of-fold harness.

A learner is anything that makes a ``pyspark.ml`` estimator for a label column. Fits of one
harness run are independent Spark jobs, started from a small pool of driver threads.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import ID, LABELS, SCORES, SEED
from tidemark.functions.probability import clip
from tidemark.operators import boosting, logistic
from tidemark.operators.boosting import Booster

# Published rates, node sizes and sampling shares of the two heads, and of the probes.
LOSS_HEAD = {"rate": 0.03, "depth": 5, "least": 30, "columns": 0.8, "rows": 0.8, "ridge": 1.0}
RANK_HEAD = {"rate": 0.03, "depth": 6, "least": 20, "columns": 0.9, "rows": 0.9, "ridge": 0.5, "by_auc": True}
VIEW_HEAD = {"rate": 0.05, "depth": 5, "least": 20, "rounds": 500}
PROBE_HEAD = {"rate": 0.05, "depth": 5, "least": 20, "rounds": 700}
FIT_THREADS = 8


def in_parallel(tasks: list[Callable], threads: int = FIT_THREADS) -> list:
    """Run independent driver-side tasks concurrently, results in order."""
    wrap = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(tasks)))) as pool:
        return [f.result() for f in [pool.submit(wrap(t)) for t in tasks]]


@dataclass(frozen=True)
class Learner:
    """A named estimator factory; ``make(label)`` returns an unfitted estimator."""

    name: str
    make: Callable[[str], Estimator]
    weight: str | None = None
    #: Of a logistic model without weights: its penalty, which share of it is on absolute values, whether columns are scaled, and steps.
    logistic: tuple[float, float, bool, int] | None = None


def boosted(name: str = "gbt", weight: str | None = None, **options) -> Booster:
    """Boosted trees of a loss head with other options."""
    return Booster(name, weight, **{**LOSS_HEAD, **options})


def forest(name: str = "forest", trees: int = 50, depth: int = 10) -> Learner:
    return Learner(name, lambda label: RandomForestClassifier(
        labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=20, featureSubsetStrategy="sqrt", seed=SEED, maxBins=64))


def linear(name: str = "logistic", strength: float = 1.0, l1_share: float = 0.0, rows: int = 1,
           standardised: bool = False, weight: str | None = None,
           iterations: int = 100) -> Learner:
    """Logistic regression; ``strength`` is the inverse penalty on the summed loss of ``rows``."""
    def make(label: str) -> Estimator:
        est = LogisticRegression(labelCol=label, featuresCol="features", maxIter=iterations,
                                 tol=1e-5, regParam=1.0 / (strength * rows), elasticNetParam=l1_share,
                                 standardization=not standardised)
        return est.setWeightCol(weight) if weight else est
    return Learner(name, make, weight, None if weight else (1.0 / (strength * rows), l1_share, not standardised, iterations))


def vectors(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features",
                           handleInvalid="keep").transform(rows)


def score_with(model: Model, rows: DataFrame, out: str) -> DataFrame:
    """Add the positive-class probability of a fitted classifier as one column."""
    scored = (model.copy().setProbabilityCol("_prob").setRawPredictionCol("_raw")
              .setPredictionCol("_pred").transform(rows))
    return scored.withColumn(out, clip(vector_to_array("_prob")[1])).drop("_prob", "_raw", "_pred")


def fit_targets(rows: DataFrame, features: list[str], learner: Learner,
                labels: dict[str, str]) -> list[Callable[[], Model]]:
    """One fitting task per label."""
    kept = [*labels.values(), *([learner.weight] if learner.weight else [])]
    ready = vectors(rows, features).select("features", *kept)
    return [lambda y=y: learner.make(y).fit(ready) for y in labels.values()]


@dataclass(frozen=True)
class FoldFrame:
    """Matrix of one fold; column ``role`` tells training from validation rows. ``size``: its training rows, where they are counted."""

    number: int
    rows: DataFrame
    features: list[str]
    size: int | None = None

    def train(self) -> DataFrame:
        return self.rows.where(F.col("role") == "train")

    def val(self) -> DataFrame:
        return self.rows.where(F.col("role") == "val")

    def change(self, edit: Callable[[DataFrame], DataFrame],
               features: list[str] | None = None) -> "FoldFrame":
        return FoldFrame(self.number, edit(self.rows), features or self.features)


def boosting_rows(frames: list[FoldFrame], booster: Booster, labels: dict[str, str] = LABELS, keep: list[str] | None = None,
                  roles: list[str] | None = None, sample: bool = False) -> DataFrame:
    """The rows of all folds in the form that boosting takes, written once; with ``sample``, of the training rows those that a fit draws."""
    kept = [c for c in dict.fromkeys([ID, *LABELS.values(), *(keep or [])]) if c != "role"]
    return boosting.table([(f.number, f.rows) for f in frames], {f.number: f.features for f in frames}, list(labels.values()), kept, booster.weight,
                          roles, booster if sample else None, {f.number: f.size for f in frames if f.size is not None})


def boosted_scores(rows: DataFrame, fitted: boosting.Fitted, labels: dict[str, str] = LABELS, scores: dict[str, str] = SCORES,
                   keep: list[str] | None = None, roles: tuple[str, ...] = ("val",)) -> DataFrame:
    """Row id, fold, scores, labels and ``keep`` of the validation rows, or of the rows in other roles."""
    kept = list(dict.fromkeys([ID, *LABELS.values(), *(keep or [])]))
    out = boosting.score(rows.where(F.col("role").isin(*roles)), fitted, {y: scores[h] for h, y in labels.items()}, kept)
    return out.select(ID, "fold", *[scores[h] for h in labels], *kept[1:])


def out_of_fold(frames: list[FoldFrame], learner: Booster | Learner | Callable[[FoldFrame], Learner],
                labels: dict[str, str] = LABELS, scores: dict[str, str] = SCORES,
                keep: list[str] | None = None, roles: tuple[str, ...] = ("val",)) -> DataFrame:
    """Fit per fold and label, score the fold's validation rows.

    Returns row id, fold, scores, labels and ``keep``; rows outside all validation windows are
    absent. The three label models of a fold score the same rows in turn, so nothing is joined.
    With other ``roles`` the fold's rows in these roles are scored; a row in role ``test`` has a
    score under each fold (``keep`` may name ``role``).
    """
    if isinstance(learner, Booster):
        rows = boosting_rows(frames, learner, labels, keep, ["train", "val", *roles], sample="train" not in roles)
        return boosted_scores(rows, boosting.fit(rows, list(labels.values()), learner), labels, scores, keep, roles)

    def learner_of(frame: FoldFrame) -> Learner:
        return learner if isinstance(learner, Learner) else learner(frame)

    learners = [learner_of(f) for f in frames]
    if all(one.logistic for one in learners) and len({(*one.logistic[1:], *f.features) for one, f in zip(learners, frames)}) == 1:
        return _linear_out_of_fold(frames, learners, labels, scores, keep, roles)
    tasks = []
    for frame, one in zip(frames, learners):
        tasks += fit_targets(frame.train(), frame.features, one, labels)
    models = in_parallel(tasks)
    out = None
    for i, frame in enumerate(frames):
        scored = vectors(frame.rows.where(F.col("role").isin(*roles)), frame.features)
        for j, h in enumerate(labels):
            scored = score_with(models[i * len(labels) + j], scored, scores[h])
        part = scored.select(ID, F.lit(frame.number).alias("fold"), *[scores[h] for h in labels],
                             *LABELS.values(), *(keep or []))
        out = part if out is None else out.unionByName(part)
    return out


def _linear_out_of_fold(frames: list[FoldFrame], learners: list[Learner], labels: dict[str, str], scores: dict[str, str],
                        keep: list[str] | None, roles: tuple[str, ...]) -> DataFrame:
    """Logistic models of all folds and labels: fitted together, a pass over the rows per step."""
    features, (_, l1_share, scaled, iterations) = frames[0].features, learners[0].logistic
    fitted = logistic.fit_frames([(f.number, f.train()) for f in frames], features, list(labels.values()),
                                 {f.number: one.logistic[0] for f, one in zip(frames, learners)}, l1_share, scaled, iterations)
    out = None
    for f in frames:
        rows = f.rows.where(F.col("role").isin(*roles))
        part = rows.select(ID, F.lit(f.number).alias("fold"), *[logistic.probability(features, *fitted[f.number, y]).alias(scores[h]) for h, y in labels.items()],
                           *LABELS.values(), *(keep or []))
        out = part if out is None else out.unionByName(part)
    return out
