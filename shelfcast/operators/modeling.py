"""Two-stage demand model: a demand/no-demand classifier and three regressors.

Stage 1 fits a gradient-boosted classifier on every training row (label:
quantity > 0). Stage 2 fits two L1 gradient-boosted regressors (:mod:`boosting`) and a random
forest on the positive rows, raw quantity as target. Scoring gates the blend
of the three regressors by the classifier (see :func:`ensemble.gated_blend`).

With a period column the latest periods of the training rows are held out, and the three boosted
learners stop when more rounds no longer help there; their round numbers are ceilings.
The rounds used are in the model's metadata.

The features are assembled once; the training set of vectors is persisted (memory
and disk) and read by the four fits, which run side by side on binned features (:mod:`histograms`). Each member is a
``PipelineModel`` (vector assembly + fitted MLlib model) with its own output column, so
the members are saved, loaded and applied independently. Boosting over more rows than one task takes
checkpoints its scores every ``checkpoint_interval`` rounds if the session
names a checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import ClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.boosting import Forest, L1Boosting, LogisticBoosting, gathered
from shelfcast.operators.dataset import assembler, positive_rows, with_labels
from shelfcast.operators.ensemble import DEFAULT_BLEND_WEIGHTS, gated_blend, blend_shares

CLASSIFIER = "classifier"
FEATURES = "features"
HELD_OUT = "held_out"
PERIOD = "_period"
# Blend slots, in blend order. Slot names carry the weight keys of DEFAULT_BLEND_WEIGHTS.
REGRESSOR_SLOTS = ("xgb_regressor", "lgbm_regressor", "rf_regressor")


@dataclass(frozen=True)
class TwoStageConfig:
    """Model sizes, one set for everyone: catalogue queries and jobs use the defaults, the reference's sizes.

    Up to 300 rounds of a classifier at 0.05, up to 1000 rounds at 0.03 of two L1 regressors of
    depth 8 and 6 with 0.9 of the rows and features per tree, a forest of 100 trees of depth 10.

    ``holdout`` is the share of the training rows, the latest by period, that boosting is stopped by (0: all rounds, on all rows).
    The classifier stops at the first round that lowers the hold-out's loss by less than the share ``classifier_tol``, as
    MLlib's does; a regressor when ``patience`` rounds together lower its mean absolute error by less than the share ``validation_tol``."""

    classifier_iters: int = 300
    classifier_step: float = 0.05
    classifier_depth: int = 5
    regressor_iters: int = 1000
    regressor_step: float = 0.03
    regressor_a_depth: int = 8
    regressor_b_depth: int = 6
    subsample: float = 0.9
    feature_fraction: float = 0.9
    forest_trees: int = 100
    forest_depth: int = 10
    max_bins: int = 32
    holdout: float = 0.1
    classifier_tol: float = 0.001
    validation_tol: float = 0.01
    patience: int = 5
    checkpoint_interval: int = 10
    # Without effect since the trees are no longer grown by MLlib: a node is found from the binned row. Kept for callers that name it.
    cache_node_ids: bool = False
    seed: int = 42
    weights: dict = field(default_factory=lambda: dict(DEFAULT_BLEND_WEIGHTS))


def build_estimators(cfg: TwoStageConfig) -> dict[str, LogisticBoosting | L1Boosting | Forest]:
    common = dict(max_bins=cfg.max_bins, seed=cfg.seed, features_col=FEATURES)
    clf = LogisticBoosting(
        rounds=cfg.classifier_iters,
        step=cfg.classifier_step,
        depth=cfg.classifier_depth,
        tol=cfg.classifier_tol,
        checkpoint_interval=cfg.checkpoint_interval,
        label_col="demand",
        prediction_col="demand_class",
        raw_prediction_col="demand_raw",
        probability_col="demand_probability",
        **common,
    )
    boosted = L1Boosting(rounds=cfg.regressor_iters, step=cfg.regressor_step, subsample=cfg.subsample, feature_fraction=cfg.feature_fraction,
                         patience=cfg.patience, tol=cfg.validation_tol, checkpoint_interval=cfg.checkpoint_interval, **common)
    return {
        CLASSIFIER: clf,
        "xgb_regressor": replace(boosted, depth=cfg.regressor_a_depth, prediction_col="score_xgb_regressor"),
        "lgbm_regressor": replace(boosted, depth=cfg.regressor_b_depth, prediction_col="score_lgbm_regressor", seed=cfg.seed + 1),
        "rf_regressor": Forest(trees=cfg.forest_trees, depth=cfg.forest_depth, prediction_col="score_rf_regressor", **common),
    }


# Names by which a member without a type of its own counts as the classifier.
CLASSIFIER_NAMES = ("clf", "class_model")


def gates(name: str, member: PipelineModel) -> bool:
    """Whether a member decides if there is demand at all, and so takes no part in the blend.

    That is what its last stage is: MLlib's classification models do, its regression models do not. A member
    whose last stage is neither is told by its name.
    """
    last = member
    while getattr(last, "stages", None):
        last = last.stages[-1]
    if isinstance(last, ClassificationModel):
        return True
    return not isinstance(last, RegressionModel) and (name.lower() in CLASSIFIER_NAMES or CLASSIFIER in name.lower())


def flat_stages(model) -> Iterator:
    """The stages of a fitted pipeline in order, those of pipelines within it in their place."""
    for stage in getattr(model, "stages", ()):
        if isinstance(stage, PipelineModel):
            yield from flat_stages(stage)
        else:
            yield stage


def model_inputs(model) -> list[str]:
    """The columns a fitted pipeline reads, in the order of its assemblers; what an earlier stage makes is not one of them."""
    made: set[str] = set()
    read: list[str] = []
    for stage in flat_stages(model):
        if isinstance(stage, VectorAssembler):
            read += [c for c in stage.getInputCols() if c not in made and c not in read]
        for name in ("outputCol", "predictionCol"):
            if stage.hasParam(name) and stage.isDefined(name):
                made.add(stage.getOrDefault(name))
        if stage.hasParam("outputCols") and stage.isDefined("outputCols"):
            made.update(stage.getOrDefault("outputCols"))
    return read


@dataclass
class TwoStageModel:
    members: dict[str, PipelineModel]
    feature_columns: list[str]
    weights: dict[str, float]
    date_column: str | None = None
    log_target: bool = False
    rounds: dict[str, int] = field(default_factory=dict)

    @property
    def regressors(self) -> list[str]:
        return [s for s in REGRESSOR_SLOTS if s in self.members] or [s for s, m in self.members.items() if not gates(s, m)]

    @property
    def classifier(self) -> PipelineModel | None:
        return next((m for name, m in self.members.items() if gates(name, m)), None)

    def transform(self, df: DataFrame) -> DataFrame:
        """Append ``demand_class`` (when a classifier exists) and one ``score_<slot>``
        column per regressor; intermediate vectors are dropped."""
        out, keep = df, list(df.columns)
        for slot, model in self.members.items():
            keep.append("demand_class" if gates(slot, model) else f"score_{slot}")
            # Members bring vectors of their own, perhaps under one name.
            out = model.transform(out).select(*keep)
        return out

    def metadata(self) -> dict:
        return {
            "feature_columns": list(self.feature_columns),
            "weights": dict(self.weights),
            "date_column": self.date_column,
            "log_target": self.log_target,
            "members": list(self.members),
            "rounds": dict(self.rounds),
        }


def last_periods(rows: DataFrame, period: str, share: float) -> Column:
    """True for rows of the latest periods, about ``share`` of all rows: those behind the period up to which the others reach."""
    days = F.unix_date(F.col(period).cast("date"))
    cut = rows.agg(F.percentile_approx(days, 1 - share, 100_000)).first()[0]
    return F.coalesce(days > F.lit(cut), F.lit(False))


def train_two_stage(
    train: DataFrame,
    feature_cols: list[str],
    cfg: TwoStageConfig = TwoStageConfig(),
    date_column: str | None = None,
    target: str = "quantity",
) -> TwoStageModel:
    """Fit the classifier on all rows and the regressors on rows with positive target.

    Boosting is stopped by the latest periods, if ``date_column`` names the period and both the rows before and
    behind the cut hold a sale; else it runs all its rounds. The forest learns from all rows."""
    vector = assembler(feature_cols, FEATURES)
    dated = date_column in train.columns and cfg.holdout > 0
    kept = vector.transform(with_labels(train, target).withColumn(PERIOD, F.col(date_column).cast("date") if dated else F.lit(None).cast("date")))
    kept = kept.select(FEATURES, "label", "demand", PERIOD).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # The training rows are made once, for the cut between the periods too.
        data = kept.withColumn(HELD_OUT, last_periods(kept, PERIOD, cfg.holdout) if dated else F.lit(False)).drop(PERIOD)
        sale, back = F.col("label") > 0, F.col(HELD_OUT)
        sales, later_sales = data.agg(F.count_if(sale), F.count_if(sale & back)).first()
        if not sales:
            raise ValueError("the training rows hold no sale: nothing to fit the regressors on")
        by = HELD_OUT if 0 < later_sales < sales else None
        positive = gathered(positive_rows(data, "label"), sales).persist(StorageLevel.MEMORY_AND_DISK)  # read by three fits
        est = build_estimators(cfg)

        def fit(slot: str):
            if slot == CLASSIFIER:
                return est[slot].fit(data, by)
            return est[slot].fit(positive, by) if isinstance(est[slot], L1Boosting) else est[slot].fit(positive)

        # The fits don't depend on each other: Spark runs their jobs side by side.
        try:
            with ThreadPoolExecutor(len(est)) as pool:
                fits = dict(zip(est, pool.map(fit, est), strict=True))
        finally:
            positive.unpersist()
    finally:
        kept.unpersist()
    # A boosted regressor's first tree is the median alone.
    rounds = {slot: m.getNumTrees - isinstance(est[slot], L1Boosting) for slot, m in fits.items()}
    weights = blend_shares(list(REGRESSOR_SLOTS), cfg.weights)
    return TwoStageModel({slot: PipelineModel([vector, m]) for slot, m in fits.items()}, list(feature_cols), weights, date_column, rounds=rounds)


def predict_two_stage(model: TwoStageModel, df: DataFrame) -> DataFrame:
    """Gated blend of the regressors: rows the classifier marks 0 get 0; others the
    weighted sum of the three scores, clipped at 0, rounded half-even (INT)."""
    scored = model.transform(df)
    scores = [F.col(f"score_{s}") for s in model.regressors]
    weights = [model.weights.get(s, 0.0) for s in model.regressors]
    demand = F.col("demand_class") if model.classifier is not None else F.lit(1)
    return scored.withColumn("predicted_quantity", gated_blend(demand, scores, weights))


def prediction_table(scored: DataFrame, period_col: str, target: str = "quantity") -> DataFrame:
    """Prediction table (T4): date, ids, actual and predicted quantity."""
    return scored.select(
        F.col(period_col).alias("date"),
        "product_id",
        "product_name",
        "category",
        F.col(target).cast("double").alias("actual_quantity"),
        "predicted_quantity",
    )
