"""Out-of-fold runs: one function per modelling plan, all on the shared fold matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import (CATEGORICAL, COLD, DAY, ENCODED_KEYS, GATING_KEYS, HISTORY_WEIGHT, ID, LABELS,
                             MINIMAL, PERSON, SCORES, TOPICS, TRAINER, VETTED, WARM,
                             FeatureGroups)
from tidemark.functions import fields
from tidemark.functions.probability import clip, cumulative, intervals, ordered
from tidemark.operators import (blending, boosting, calibration, encoding, factor, graph, metrics, models,
                                network, profiles, text, weights)
from tidemark.operators.folds import Fold, in_training, in_validation
from tidemark.operators.interactions import linear_interactions
from tidemark.operators.models import FoldFrame
from tidemark.plans import matrix
from tidemark.plans.scores import log_folds
from tidemark.sources import workspace
from tidemark.sources.training_log import TrainingLog

# Blocks of the wide matrix that every larger feature set is read from.
EVERYTHING = VETTED.but(interactions=True, quality=True)
GROUP_SETS: dict[str, FeatureGroups] = {"minimal": MINIMAL, "vetted": VETTED, "warm": WARM,
                                        "cold": COLD}
# Published embedding width and vocabulary size of the text view.
TEXT_WIDTH, TEXT_TERMS = 64, 500


# ---------------------------------------------------------------- fold matrices

def _roles(rows: DataFrame, fold: Fold) -> DataFrame:
    day = F.col(DAY)
    role = F.when(in_training(fold, day), "train").when(in_validation(fold, day), "val")
    return rows.withColumn("role", role).where(F.col("role").isNotNull())


def _covered(log: TrainingLog, folds: list[Fold]) -> tuple[DataFrame, DataFrame]:
    """The history, and the rows that take part in any fold. The history ends before the first training row, so every fold sees the same."""
    return log.prior.where(in_training(min(folds, key=lambda f: f.cutoff), F.col(DAY))), log.train.where(F.col(DAY) < max(f.end for f in folds))


def _whole(log: TrainingLog, name: str, groups: FeatureGroups, made: list[Fold]) -> DataFrame:
    """The matrix of all folds: lookup tables see history and training rows before each cut-off only. Folds differ in their codes
    alone, so the rows are joined and written once, with the codes of every fold."""
    def build() -> DataFrame:
        history, rows = _covered(log, made)
        own = groups.but(interactions=False)
        return matrix.transform(rows, matrix.fit(history, rows, own, made), own)
    return workspace.shared(log.spark, f"folds-{name}:{log.sf_dir}", build)


def _written(spark: SparkSession, sf_dir: str, name: str, groups: FeatureGroups) -> list[FoldFrame]:
    """Matrices of all folds, read from the one that is written."""
    log = TrainingLog(spark, sf_dir)
    made = log_folds(log)
    whole = _whole(log, name, groups, made)
    frames = [_roles(matrix.of_fold(whole, f.number, groups), f) for f in made]
    return [FoldFrame(f.number, x, matrix.feature_names(x)) for f, x in zip(made, frames)]


def fold_frames(spark: SparkSession, sf_dir: str,
                groups: FeatureGroups = MINIMAL) -> list[FoldFrame]:
    """Fold matrices of a feature set. The minimal set and one wide matrix are written once per
    application; every other set is a column subset of the wide one, pruned by the file scan."""
    if groups == MINIMAL:
        return _written(spark, sf_dir, "minimal", MINIMAL)
    wide = _written(spark, sf_dir, "everything", EVERYTHING)
    return [FoldFrame(f.number, f.rows.select(
        *[c for c in f.rows.columns if c not in f.features],
        *matrix.block_columns(f.rows, groups)), matrix.block_columns(f.rows, groups))
        for f in wide]


def saved(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """An out-of-fold score set, written once per application."""
    return workspace.shared(spark, f"oof-{name}:{sf_dir}", build)


# ---------------------------------------------------------------- boosted trees

def gbt(spark, sf_dir, **options) -> DataFrame:
    """Trees on the minimal matrix; without options, those of the stored fold models."""
    if options:
        return models.out_of_fold(fold_frames(spark, sf_dir), models.boosted(**options))
    rows = models.boosting_rows(fold_frames(spark, sf_dir), models.boosted(), roles=["val"])
    return models.boosted_scores(rows, boosting.load(fold_models(spark, sf_dir)))


def fold_models(spark, sf_dir) -> DataFrame:
    """The kept trees of the boosted run, one row per fold, label and stage, fitted and written once per application."""
    def build() -> DataFrame:
        booster = models.boosted()
        rows = models.boosting_rows(fold_frames(spark, sf_dir), booster, roles=["train", "val"], sample=True)
        return boosting.stored(spark, boosting.fit(rows, list(LABELS.values()), booster))
    return saved(spark, sf_dir, "fold-models", build)


def test_matrices(log: TrainingLog) -> dict[int, DataFrame]:
    """The test rows' minimal matrix under the lookup tables of every fold."""
    made = log_folds(log)
    history, rows = _covered(log, made)
    whole = workspace.materialise(matrix.transform(log.test, matrix.fit(history, rows, MINIMAL, made), MINIMAL), "test")
    return {f.number: matrix.of_fold(whole, f.number, MINIMAL) for f in made}


def fold_averaged(spark, sf_dir) -> DataFrame:
    """Test rows scored by the stored trees of every fold, with that fold's lookup tables, and averaged. They are joined once, with the
    codes of every fold."""
    rows = None
    for number, x in test_matrices(TrainingLog(spark, sf_dir)).items():
        part = x.select(ID, F.lit(number).alias("fold"), boosting.vector(matrix.feature_names(x)).alias("x"))
        rows = part if rows is None else rows.unionByName(part)
    scored = boosting.score(rows, boosting.load(fold_models(spark, sf_dir)), dict(zip(LABELS.values(), SCORES.values())), [ID])
    return blending.mean_scores(scored, [ID])


def dual_head(spark, sf_dir) -> DataFrame:
    """Loss head in p07.., ranking head (more capacity) in a07..; same rows, one output."""
    frames = fold_frames(spark, sf_dir)
    loss = saved(spark, sf_dir, "gbt", lambda: gbt(spark, sf_dir))
    rank = models.out_of_fold(frames, models.boosted("rank", **models.RANK_HEAD))
    rank = rank.select(ID, *[F.col(p).alias(p.replace("p", "a")) for p in SCORES.values()])
    return loss.join(rank, ID)


def dual_metrics(oof: DataFrame) -> DataFrame:
    """Weighted score with log-loss from the loss columns and AUC from the ranking columns."""
    keys = ["horizon"]
    loss = metrics.metrics(metrics.score_histogram(metrics.long_scores(oof, [ID]), keys), keys)
    swapped = oof.drop(*SCORES.values()).withColumnsRenamed(
        {p.replace("p", "a"): p for p in SCORES.values()})
    rank = metrics.metrics(metrics.score_histogram(metrics.long_scores(swapped, [ID]), keys), keys)
    return loss.drop("roc_auc").join(rank.select("horizon", "roc_auc"), "horizon")


def source_weighted(spark, sf_dir) -> DataFrame:
    """Trees on history and training rows, history at half weight, with a source flag."""
    log = TrainingLog(spark, sf_dir)
    frames = []
    for fold, frame in zip(log_folds(log), fold_frames(spark, sf_dir)):
        history = log.prior.where(in_training(fold, F.col(DAY)))
        train = log.train.where(in_training(fold, F.col(DAY)))
        fitted = matrix.fit(history, train, MINIMAL)
        old = (matrix.transform(history, fitted, MINIMAL)
               .withColumns({"role": F.lit("train"), "source_is_prior": F.lit(1),
                             "weight": F.lit(HISTORY_WEIGHT)}))
        own = frame.rows.withColumns({"source_is_prior": F.lit(0), "weight": F.lit(1.0)})
        rows = workspace.materialise(own.unionByName(old), "stacked")
        frames.append(FoldFrame(frame.number, rows, [*frame.features, "source_is_prior"]))
    return models.out_of_fold(frames, models.boosted("source", weight="weight"))


def hazard(spark, sf_dir) -> DataFrame:
    """One tree model per disjoint interval; hazards multiply up to cumulative scores."""
    z = dict(zip(LABELS, ("z1", "z2", "z3")))

    def label(rows: DataFrame) -> DataFrame:
        made = intervals(*[F.col(y) for y in LABELS.values()])
        return rows.withColumns({n: c.cast("double") for n, c in zip(z.values(), made)})
    frames = [f.change(label) for f in fold_frames(spark, sf_dir)]
    raw = models.out_of_fold(frames, models.boosted("hazard"), z,
                             dict(zip(LABELS, ("h1", "h2", "h3"))))
    total = cumulative(F.col("h1"), F.col("h2"), F.col("h3"))
    return raw.select(ID, "fold", *[clip(c).alias(p) for c, p in zip(total, SCORES.values())],
                      *LABELS.values())


def drift_weighted(spark, sf_dir, alpha: float = 1.0, strength: float = 1.0) -> DataFrame:
    """Training rows weighted by recency and by likeness to the validation window."""
    def weigh(frame: FoldFrame) -> FoldFrame:
        train = weights.recency_weight(frame.train(), alpha)
        both = models.vectors(frame.rows.withColumn("is_val", (F.col("role") == "val").cast("int")),
                              frame.features).select("features", "is_val")
        n = frame.rows.count()
        guess = LogisticRegression(labelCol="is_val", regParam=1.0 / n).fit(both)
        train = models.score_with(guess, models.vectors(train, frame.features), "likeness")
        train = weights.normalised(train.withColumn("adv", 1.0 + strength * F.col("likeness")),
                                   "adv")
        train = train.withColumn("weight", F.col("weight") * F.col("adv"))
        train = weights.normalised(train, "weight").select(*frame.rows.columns, "weight")
        rows = train.unionByName(frame.val().withColumn("weight", F.lit(1.0)))
        return FoldFrame(frame.number, workspace.materialise(rows, "weighted"), frame.features)

    frames = models.in_parallel([lambda f=f: weigh(f) for f in fold_frames(spark, sf_dir)])
    return models.out_of_fold(frames, models.boosted("drift", weight="weight"))


# ---------------------------------------------------------------- linear and neural models

def scaled_frames(frames: list[FoldFrame], edit: Callable[[DataFrame], DataFrame] = lambda r: r
                  ) -> list[FoldFrame]:
    """Columns standardised with the moments of each fold's training rows."""
    def scale(frame: FoldFrame) -> FoldFrame:
        rows = edit(frame.rows)
        names = matrix.feature_names(rows)
        stats = weights.moments(rows.where(F.col("role") == "train"), names)
        return FoldFrame(frame.number, weights.standardise(rows, stats), names)
    return models.in_parallel([lambda f=f: scale(f) for f in frames])


def elastic_net(spark, sf_dir, strength: float = 0.5, l1_share: float = 0.3) -> DataFrame:
    frames = scaled_frames(fold_frames(spark, sf_dir, VETTED), linear_interactions)
    return models.out_of_fold(frames, lambda f: models.linear(
        "elastic", strength, l1_share, f.train().count(), standardised=True))


def interval_rows(spark, sf_dir) -> DataFrame:
    """Scaled rows of all folds in the form that the network takes, written once."""
    out = None
    for frame in scaled_frames(fold_frames(spark, sf_dir)):
        x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in frame.features])
        y = F.array(*[F.col(c).cast("double") for c in LABELS.values()])
        part = frame.rows.select(F.lit(frame.number).alias("fold"), (F.col("role") == "train").alias("train"), x.alias("x"), y.alias("y"), ID, *LABELS.values())
        out = part if out is None else out.unionByName(part)
    return workspace.materialise(out, "network")


def interval_network(spark, sf_dir, hidden: tuple[int, ...] = network.HIDDEN, **settings) -> DataFrame:
    """One network per fold with a hazard head for each interval (0-7, 8-90, 91-120 days); hazards multiply up to nested scores."""
    rows = interval_rows(spark, sf_dir)
    nets, _ = network.fit(rows, hidden, **settings)
    scored = network.score(rows.where("not train"), nets, list(SCORES.values()), [ID, *LABELS.values()])
    return scored.select(ID, "fold", *SCORES.values(), *LABELS.values())


def stacking(spark, sf_dir) -> DataFrame:
    """Base learners out of fold, then a logistic meta model on the covered rows."""
    frames = fold_frames(spark, sf_dir)
    scaled = scaled_frames(frames)
    base = {
        "gbt": lambda: saved(spark, sf_dir, "gbt", lambda: gbt(spark, sf_dir)),
        "wide": lambda: models.out_of_fold(frames, models.boosted("wide", depth=3, rate=0.05)),
        "forest": lambda: models.out_of_fold(frames, models.forest(trees=30)),
        "logistic": lambda: models.out_of_fold(scaled, lambda f: models.linear(
            rows=f.train().count(), standardised=True)),
    }
    long = None
    for name, run in base.items():
        part = run().select(F.lit(name).alias("model"), ID, "fold", *SCORES.values(),
                            *LABELS.values())
        long = part if long is None else long.unionByName(part)
    wide = workspace.materialise(blending.side_by_side(long, list(base)), "stack")
    n = wide.count()

    def meta(h: str):
        inputs = [f"{SCORES[h]}_{i}" for i in range(len(base))]
        ready = models.vectors(wide, inputs)
        return models.linear("meta", rows=n, standardised=True).make(LABELS[h]).fit(ready), inputs

    out = wide
    for h, (model, inputs) in zip(LABELS, models.in_parallel([lambda h=h: meta(h) for h in LABELS])):
        out = models.score_with(model, models.vectors(out, inputs), SCORES[h]).drop("features")
    return out.select(ID, "fold", *SCORES.values(), *LABELS.values())


# ---------------------------------------------------------------- label encodings in a fit

def encoded_frames(spark, sf_dir, by_day: bool = False) -> list[FoldFrame]:
    """Minimal matrix with label encodings of trainer, group and county.

    As published, all rows of a fold take encodings of its training rows, in which a training row's own label is
    contained. With ``by_day`` a training row takes those of strictly earlier days instead; validation rows do not change.
    """
    log = TrainingLog(spark, sf_dir)
    made = log_folds(log)
    own, given = ({k: name.format(k) for k in (DAY, *ENCODED_KEYS)} for name in ("_{}", "{}_given"))
    plain = _whole(log, "minimal", MINIMAL, made)

    def attached(rows: DataFrame, encodings: workspace.Parts) -> DataFrame:
        # The matrix has codes under the names of the keys; these step aside.
        rows = rows.withColumnsRenamed(given).withColumnsRenamed({c: k for k, c in own.items()})
        rows = profiles.attach_encodings(rows, encodings, ENCODED_KEYS)
        return rows.withColumnsRenamed(own).withColumnsRenamed({c: k for k, c in given.items()})
    # Rows meet their keys by id once; encodings, a folder per key, then meet the keys, so that those of few values are broadcast.
    # Encodings by day are the same in all folds and are attached once.
    whole = workspace.shared(spark, f"encoded-keys:{sf_dir}", lambda: plain.join(log.train.select(ID, *[F.col(k).alias(c) for k, c in own.items()]), ID))
    counts = workspace.materialise(profiles.key_counts(log.train, ENCODED_KEYS, made), "counts")
    encodings = workspace.Parts(profiles.target_encoding(counts), "encodings", "key_name")
    early = workspace.shared(spark, f"encoded-day:{sf_dir}", lambda: attached(
        whole, workspace.Parts(profiles.daily_encoding(log.train, ENCODED_KEYS), "encodings", "key_name"))) if by_day else None

    def known(fold: Fold) -> Column:
        return in_training(fold, F.col(own[DAY])) | in_validation(fold, F.col(own[DAY]))
    # A key has its encodings once, so they change no count.
    train = [F.count_if(in_training(f, F.col(DAY)) & (F.lit(True) if by_day else known(f))).alias(f"n{f.number}") for f in made]
    sizes = whole.agg(*train).first()

    def attach(fold: Fold) -> FoldFrame:
        rows = attached(_roles(matrix.of_fold(whole, fold.number, MINIMAL), fold).where(known(fold)).withColumn("fold", F.lit(fold.number)), encodings).drop("fold")
        if early is not None:
            rows = _roles(matrix.of_fold(early, fold.number, MINIMAL), fold).where("role = 'train'").unionByName(rows.where("role = 'val'"))
        names = [c for c in rows.columns if c.startswith("te_")]
        return FoldFrame(fold.number, rows.drop(DAY, *own.values()), [*matrix.feature_names(plain), *names], sizes[f"n{fold.number}"])
    return [attach(f) for f in made]


def encoded(spark, sf_dir, by_day: bool = False, **options) -> DataFrame:
    """Trees on the minimal matrix with label encodings."""
    return models.out_of_fold(encoded_frames(spark, sf_dir, by_day), models.boosted("encoded", **options))


# ---------------------------------------------------------------- cohorts

def gate_frames(spark, sf_dir) -> list[FoldFrame]:
    """Gating features per fold: known person, topics, and codes fitted on its training rows."""
    log = TrainingLog(spark, sf_dir)
    made = log_folds(log)
    history, rows = _covered(log, made)
    codes = workspace.Parts(encoding.fold_codes(rows, None, GATING_KEYS, made, missing=fields.MISSING), "codes", "col")
    # Topics are counted before the join, which shuffles the rows.
    rows = rows.select(ID, DAY, PERSON, *GATING_KEYS, *LABELS.values(), fields.has_topic(F.col(TOPICS)).alias("topic_flag"),
                       fields.topic_count(F.col(TOPICS)).alias("topic_count"))
    coded = [f"{c}_code" for c in GATING_KEYS]
    rows = encoding.attach_codes(profiles.known_person(rows, history), codes, GATING_KEYS, missing=fields.MISSING)
    carried = [*LABELS.values(), "has_prior_history", "topic_flag", "topic_count"]
    rows = workspace.materialise(rows.select(ID, DAY, *carried, *coded), "gate")
    return [FoldFrame(f.number, _roles(rows, f).select(ID, "role", *carried, *[F.col(c)[encoding.fold_code(f.number)].alias(c) for c in coded]),
                      ["has_prior_history", "topic_flag", "topic_count", *coded]) for f in made]


def warm_cold(spark, sf_dir, **options) -> DataFrame:
    """Warm and cold experts mixed by the gate's probability of a known person; with cohort."""
    settings = {**options}
    gates = gate_frames(spark, sf_dir)
    experts = [models.out_of_fold(fold_frames(spark, sf_dir, GROUP_SETS[name]),
                                  models.boosted(name, **settings)) for name in ("warm", "cold")]
    labels, scores = {"gate": "has_prior_history"}, {"gate": "w"}
    gate = models.out_of_fold(gates, models.boosted("gate", **settings), labels, scores,
                              keep=["has_prior_history", "topic_flag"])
    warm, cold = (e.select(ID, *[F.col(p).alias(f"{p}_{i}") for p in SCORES.values()])
                  for i, e in enumerate(experts))
    w = F.col("w")
    mix = [clip(w * F.col(f"{p}_0") + (1 - w) * F.col(f"{p}_1")).alias(p) for p in SCORES.values()]
    cohort = (2 * F.col("has_prior_history") + F.col("topic_flag")).alias("cohort")
    return gate.join(warm, ID).join(cold, ID).select(ID, "fold", *mix, *LABELS.values(), cohort)


COHORT_METHODS = ["none", "platt", "isotonic"]
# Fixed value: published least rows of a calibrated cohort.
COHORT_MIN_ROWS = 10


def cohort_calibrated(oof: DataFrame, min_rows: int = 0) -> DataFrame:
    """Per cohort the calibrator with the least summed log-loss; cohorts under ``min_rows`` stay as they are."""
    oof = workspace.materialise(oof, "cohorts")
    keys = ["cohort", "horizon"]
    hist = workspace.materialise(
        metrics.score_histogram(metrics.long_scores(oof, ["cohort"]), keys), "hist")
    sizes = {r["cohort"]: r["n"] for r in oof.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    names = {(m, h): f"{SCORES[h]}_{m}" for m in COHORT_METHODS for h in LABELS}

    def calibrate(cohort: int) -> DataFrame:
        rows = oof.where(F.col("cohort") == cohort)
        methods = COHORT_METHODS if sizes[cohort] >= min_rows else ["none"]
        for m in methods:
            for h in LABELS:
                own = hist.where((F.col("cohort") == cohort) & (F.col("horizon") == h))
                rows = calibration.fit(m, own)(rows, SCORES[h], names[m, h])
        losses = []
        for m in methods:
            fixed = ordered(*[F.col(names[m, h]) for h in LABELS])
            losses.append(sum((F.avg(metrics.log_loss_term(p, F.col(y)))
                               for p, y in zip(fixed, LABELS.values())), F.lit(0.0)).alias(m))
        scored = rows.agg(*losses).first()
        best = min(methods, key=lambda m: scored[m])
        fixed = [clip(p) for p in ordered(*[F.col(names[best, h]) for h in LABELS])]
        return rows.select(ID, "fold", "cohort", F.lit(best).alias("method"),
                           *[p.alias(n) for p, n in zip(fixed, SCORES.values())], *LABELS.values())

    parts = models.in_parallel([lambda c=c: calibrate(c) for c in sorted(sizes)])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---------------------------------------------------------------- text and graph views

def _embedded(frame: FoldFrame, parts: DataFrame, names: list[str]) -> FoldFrame:
    return FoldFrame(frame.number, workspace.materialise(parts, "view"), names)


def text_view(spark, sf_dir, k: int = TEXT_WIDTH) -> DataFrame:
    """Trees on the truncated SVD of topic-text TF-IDF, vocabulary fitted on training rows."""
    log = TrainingLog(spark, sf_dir)

    def build(fold: Fold) -> FoldFrame:
        rows = _roles(log.train, fold).select(ID, "role", *LABELS.values(),
                                              fields.topic_text(F.col(TOPICS)).alias("text"))
        train = rows.where(F.col("role") == "train")
        keys = [ID, "role"]
        counts = workspace.materialise(text.term_counts(rows, keys, "text"), "terms")
        words = workspace.materialise(text.fit_vocabulary(
            counts.where(F.col("role") == "train"), train.select(F.count(F.lit(1))).scalar(), TEXT_TERMS),
            "vocabulary")
        cells = workspace.materialise(text.tfidf(counts, words, keys).select(
            F.col(ID).alias("row"), "role", F.col("term").alias("col"),
            F.col("weight").alias("value")), "cells")
        fitted = cells.where(F.col("role") == "train")
        right, _ = factor.truncated_svd(fitted, k)
        out = factor.attach_embedding(rows.drop("text"), factor.project(cells, right, k), ID, k,
                                      "text")
        return _embedded(FoldFrame(fold.number, rows, []), out, [f"text_{i}" for i in range(k)])

    frames = models.in_parallel([lambda f=f: build(f) for f in log_folds(log)])
    return models.out_of_fold(frames, models.boosted("text", **models.VIEW_HEAD))


def _graph_frame(log: TrainingLog, fold: Fold, embed: Callable[[DataFrame], DataFrame], k: int,
                 pairs: bool) -> FoldFrame:
    rows = _roles(log.train, fold)
    people = embed(rows)
    out = rows.withColumn("_person", fields.person_token())
    out = factor.attach_embedding(out, workspace.materialise(people, "people"), "_person", k, "node")
    names = [f"node_{i}" for i in range(k)]
    if pairs:
        train = rows.where(F.col("role") == "train")
        table = workspace.materialise(encoding.pair_encoding(train), "pairs")
        out = encoding.pair_features(out, table, encoding.label_rates(train))
        names += [c for c in out.columns if "_topic_mean_" in c]
    return _embedded(FoldFrame(fold.number, out, []),
                     out.select(ID, "role", *LABELS.values(), *names), names)


def graph_view(spark, sf_dir, k: int = TEXT_WIDTH) -> DataFrame:
    """Trees on PPMI-SVD person embeddings and topic pair encodings."""
    log = TrainingLog(spark, sf_dir)
    frames = models.in_parallel([
        lambda f=f: _graph_frame(log, f, lambda r: graph.ppmi_embedding(r, k), k, True)
        for f in log_folds(log)])
    return models.out_of_fold(frames, models.boosted("graph", **models.VIEW_HEAD))


def walk_view(spark, sf_dir, k: int = TEXT_WIDTH, per_node: int = 10, length: int = 20) -> DataFrame:
    """Trees on random-walk person embeddings."""
    log = TrainingLog(spark, sf_dir)
    frames = models.in_parallel([
        lambda f=f: _graph_frame(log, f, lambda r: graph.walk_embedding(r, k, per_node, length), k,
                                 False) for f in log_folds(log)])
    return models.out_of_fold(frames, models.boosted("walk", **models.VIEW_HEAD))


# ---------------------------------------------------------------- calibration of a score set

def calibrated(oof: DataFrame, methods: list[str] = calibration.METHODS) -> DataFrame:
    """The score set under every calibrator (``model`` holds its name), fitted in sample on all
    out-of-fold rows as the gates expect."""
    hist = workspace.materialise(metrics.score_histogram(metrics.long_scores(oof, []), ["horizon"]),
                                 "hist")
    jobs = [(m, h) for m in methods for h in LABELS]
    fits = models.in_parallel([lambda m=m, h=h: calibration.fit(
        m, hist.where(F.col("horizon") == h)) for m, h in jobs])
    by = dict(zip(jobs, fits))
    out = None
    for m in methods:
        rows = oof
        for h in LABELS:
            rows = by[m, h](rows, SCORES[h], f"_{h}")
        part = rows.select(F.lit(m).alias("model"), ID, "fold",
                           *[F.col(f"_{h}").alias(SCORES[h]) for h in LABELS], *LABELS.values())
        out = part if out is None else out.unionByName(part)
    return out


def test_scores(spark, sf_dir) -> DataFrame:
    """Trees on all training rows, with the mean number of rounds that the folds kept, score the unlabelled rows."""
    log = TrainingLog(spark, sf_dir)
    fitted = matrix.fit(log.prior, log.train, MINIMAL)
    train = workspace.materialise(matrix.transform(log.train, fitted, MINIMAL).withColumn("role", F.lit("train")), "full")
    names = matrix.feature_names(train.drop("role"))
    kept = fold_models(spark, sf_dir).groupBy("label", "fold").agg(F.max("stage").alias("n")).groupBy("label").agg(F.avg("n").alias("n")).collect()
    booster = models.boosted()
    rows = boosting.table([(0, train)], {0: names}, list(LABELS.values()), [], None)
    made = boosting.fit(rows, list(LABELS.values()), booster, validate=False, rounds={(0, r["label"]): max(1, round(r["n"])) for r in kept})
    test = matrix.transform(log.test, fitted, MINIMAL).select(ID, F.lit(0).alias("fold"), boosting.vector(names).alias("x"))
    return boosting.score(test, made, dict(zip(LABELS.values(), SCORES.values())), [ID]).drop("fold")


def full_run(spark, sf_dir) -> DataFrame:
    """Load, features, out-of-fold fit, calibration, full fit, ordering: scores of the test rows."""
    oof = saved(spark, sf_dir, "gbt", lambda: gbt(spark, sf_dir))
    hist = metrics.score_histogram(metrics.long_scores(oof, []), ["horizon"])
    hist = workspace.materialise(hist, "hist")
    rows = test_scores(spark, sf_dir)
    for h, p in SCORES.items():
        rows = calibration.fit("isotonic", hist.where(F.col("horizon") == h))(rows, p, f"_{p}")
    fixed = ordered(*[F.col(f"_{p}") for p in SCORES.values()])
    return rows.select(ID, *[c.alias(p) for c, p in zip(fixed, SCORES.values())])


# ---------------------------------------------------------------- one-hot baseline

def one_hot_baseline(spark, sf_dir, cutoff: str = "2000-01-01") -> DataFrame:
    """Most-frequent imputation, one-hot codes, balanced logistic regression on a time hold-out.

    Rows without a date go to the validation side, as no training window holds them.
    """
    log = TrainingLog(spark, sf_dir)
    names = [*CATEGORICAL, "belong_to_cooperative", TRAINER]
    split = F.coalesce(F.col("training_day") < F.lit(cutoff).cast("date"), F.lit(False))
    rows = log.train.withColumn("belong_to_cooperative", F.col("belong_to_cooperative").cast("string"))
    train, val = rows.where(split), rows.where(~split)
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in names])
    counts = train.select(F.inline(cells)).where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("c").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
    common = {r["c"]: r["v"] for r in most.collect()}
    train, val = train.fillna(common), val.fillna(common)
    # Codes come from a distributed sort and reach the rows by joins; 0 stands for values that training has not seen.
    codes = workspace.Parts(encoding.category_codes([train], names), "codes", "col")

    def coded(rows: DataFrame) -> DataFrame:
        rows = encoding.attach_codes(rows, codes, names, {c: f"{c}_i" for c in names})
        return rows.withColumns({f"{c}_i": F.col(f"{c}_i") + 1 for c in names})
    train, val = workspace.materialise(coded(train), "coded"), workspace.materialise(coded(val), "coded")
    hot = OneHotEncoder(inputCols=[f"{c}_i" for c in names], outputCols=[f"{c}_v" for c in names], dropLast=False,
                        handleInvalid="keep").fit(train)  # sizes are the largest codes

    def ready(rows: DataFrame) -> DataFrame:
        return models.vectors(hot.transform(rows), [f"{c}_v" for c in names])

    n = train.count()
    out = ready(val)
    for h, y in LABELS.items():
        fit = models.linear("onehot", rows=n, weight="weight", standardised=True).make(y).fit(
            ready(weights.balanced_weight(train, y)))
        out = models.score_with(fit, out, SCORES[h])
    return out.select(ID, *SCORES.values(), *LABELS.values())
