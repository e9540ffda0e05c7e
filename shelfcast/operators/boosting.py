"""Gradient boosting and a forest of binned trees (:mod:`histograms`), as MLlib models.

L1 boosting: trees on the signs of the residuals, leaves at their median residual. MLlib's absolute loss leaves the mean sign
(between -1 and 1) in every leaf, so a round at a small step hardly moves a score in the target's own unit. Here a tree only gives the leaves;
each leaf's value is then the median residual of its rows, which is the constant that lowers their absolute error most. The first score is
the median of the target. Each tree is fitted to a seeded sample of the rows and a seeded subset of the features. Medians are exact:
what a task keeps and the driver gets is bounded by leaves and ranges, whatever the rows.

With a hold-out column the rounds end when ``patience`` of them together have not lowered the hold-out's
mean absolute error by the share ``tol``; the model keeps the trees up to the best round.

:class:`LogisticBoosting` and :class:`Forest` follow MLlib's ``GBTClassifier`` and ``RandomForestRegressor``.
The trees become MLlib models, so the ensembles are saved, loaded and applied like any other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.histograms import ROWS, Block, Forge, Local, Spread, Tree, binned, gathered, grow, grow_forest, run_fit

__all__ = ["ROWS", "Forest", "L1Boosting", "LogisticBoosting", "gathered", "medians"]

#: Ranges that a leaf's residuals are counted in at once, and residuals of a leaf that are sorted.
BINS, FEW = 64, 10_000

def medians(rows: DataFrame, ranges: dict[int, tuple[int, float, float]]) -> dict[int, float]:
    """The median of each group: the smallest of its values that half of them do not pass. ``rows`` has the columns ``leaf`` (0 to a few hundred)
    and ``value`` (null: none); ``ranges`` a group's number of values, the smallest and the largest."""
    left = {leaf: ((n + 1) // 2, n, low, high) for leaf, (n, low, high) in ranges.items() if n}  # of the values from low to high, the rank sought

    def within(some: dict[int, tuple]) -> tuple[DataFrame, list[Column]]:
        ends = [some.get(leaf, (None,) * 4) for leaf in range(max(some) + 1)]
        rank, low, high = (F.get(F.lit([e[k] for e in ends]).cast(kind), F.col("leaf")) for k, kind in ((0, "array<int>"), (2, "array<double>"), (3, "array<double>")))
        return rows.where((F.col("value") >= low) & (F.col("value") <= high)), [rank, low, high]

    while many := {leaf: r for leaf, r in left.items() if r[1] > FEW and r[2] < r[3]}:
        inside, (_, low, high) = within(many)
        # Halves, as the difference of two doubles may pass the largest. The highest value is a range of its own, so that each pass has less left.
        share = F.coalesce(F.try_divide(F.col("value") / 2 - low / 2, high / 2 - low / 2), F.lit(0.0))
        place = F.when(F.col("value") == high, F.lit(BINS)).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        counts: dict[int, list[tuple]] = {}
        for r in inside.groupBy("leaf", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect():
            counts.setdefault(r["leaf"], []).append((r["bin"], r["n"], r["low"], r["high"]))
        for leaf, found in counts.items():
            rank = many[leaf][0]
            for _, n, least, most in sorted(found):
                if rank <= n:
                    left[leaf] = (rank, n, least, most)
                    break
                rank -= n
    done = {leaf: low for leaf, (_, _, low, high) in left.items() if low == high}
    if few := {leaf: r for leaf, r in left.items() if leaf not in done}:
        inside, (rank, *_) = within(few)
        listed = inside.groupBy("leaf").agg(F.sort_array(F.collect_list("value")).alias("values"))
        done |= {r["leaf"]: r["value"] for r in listed.select("leaf", F.get("values", rank - 1).alias("value")).collect()}
    return done


@dataclass(frozen=True)
class L1Boosting:
    rounds: int = 1000
    step: float = 0.03
    depth: int = 8
    subsample: float = 0.9
    feature_fraction: float = 0.9
    max_bins: int = 32
    patience: int = 5
    tol: float = 0.01
    seed: int = 42
    checkpoint_interval: int = 10
    features_col: str = "features"
    label_col: str = "label"
    prediction_col: str = "prediction"

    def tree_features(self, round_: int, width: int) -> list[int]:
        """Features that the tree of a round may use."""
        some = max(1, round(self.feature_fraction * width))
        return sorted(np.random.default_rng([self.seed, round_]).choice(width, some, replace=False).tolist())

    def fit(self, data: DataFrame, held_out: str | None = None) -> GBTRegressionModel:
        """Fit on the rows that ``held_out`` (a boolean column) does not mark; without the column, or without marked rows, on all, for all rounds."""
        held, label = F.col(held_out) if held_out else F.lit(False), F.col(self.label_col).cast("double")
        seen = data.where(~F.coalesce(held, F.lit(False))).select(F.lit(0).alias("leaf"), label.alias("value"))
        n, low, high = seen.agg(F.count("value"), F.min("value"), F.max("value")).first()
        if not n:
            raise ValueError("no row to fit on")
        first = medians(seen, {0: (n, low, high)})[0]
        rows = binned(data, self.features_col, label, held, self.max_bins, self.seed)
        try:
            width = rows.width
            trees = run_fit(rows, lambda r: self.boosted(r, first, width), self.checkpoint_interval)
        finally:
            rows.release()
        model = GBTRegressionModel(Forge(data.sparkSession, rows.cuts).boosted_regressor([_constant(first), *trees], [1.0, *[self.step] * len(trees)]))
        return model.setFeaturesCol(self.features_col).setPredictionCol(self.prediction_col)._set(labelCol=self.label_col)

    def boosted(self, rows: Local | Spread, first: float, width: int) -> list[Tree]:
        """The trees behind the first score, their leaves at medians."""
        seed, share = self.seed, self.subsample

        def signs(b: Block, t: int) -> tuple:
            seen = ~b.held
            if share < 1:
                seen &= np.random.default_rng([seed, t, b.number]).random(len(seen)) < share
            fitted = np.flatnonzero(seen)
            return fitted, None, np.sign(b.label - b.score)[fitted]

        def error(b: Block, score: np.ndarray) -> tuple:
            return np.nansum(np.abs(b.label - score)[b.held]), b.held.sum()

        trees: list[Tree] = []
        errors: list[float] = []  # errors[k] is that of the first k trees
        mark, marked, stopped = None, 0, False
        wrong, n = rows.scored(lambda b: (score := np.full(len(b.label), first), error(b, score)))
        for t in range(self.rounds):
            if n:
                errors.append(wrong / n)
                if mark is None or errors[-1] < mark * (1 - self.tol):
                    mark, marked = errors[-1], t
                elif t - marked >= self.patience:
                    stopped = True
                    break
            tree = grow(rows, t, signs, self.tree_features(t, width), self.depth)
            value = rows.medians(tree)
            for leaf in tree.leaves().tolist():
                tree.value[leaf] = value.get(leaf, 0.0)
            trees.append(tree)
            wrong, n = rows.scored(_step(rows, tree, self.step, error))
        return trees[:max(1, int(np.argmin(errors)))] if stopped else trees


def _step(rows: Local | Spread, tree: Tree, share: float, error: Callable[[Block, np.ndarray], tuple]) -> Callable[[Block], tuple]:
    """A block's scores with a share of the tree's values added, and their error."""

    def stepped(b: Block) -> tuple:
        score = b.score + share * np.array(tree.value)[rows.at(b, tree)]
        return score, error(b, score)

    return stepped


def _constant(value: float) -> Tree:
    return Tree(value=[float(value)])


@dataclass(frozen=True)
class LogisticBoosting:
    """MLlib's ``GBTClassifier`` (logistic loss, mean leaves, the first tree unshrunk, the validated stop) on binned trees."""

    rounds: int = 300
    step: float = 0.05
    depth: int = 5
    max_bins: int = 32
    tol: float = 0.001
    seed: int = 42
    checkpoint_interval: int = 10
    features_col: str = "features"
    label_col: str = "label"
    prediction_col: str = "prediction"
    raw_prediction_col: str = "rawPrediction"
    probability_col: str = "probability"

    def fit(self, data: DataFrame, held_out: str | None = None) -> GBTClassificationModel:
        """Fit on the rows that ``held_out`` does not mark, until a round lowers the marked rows' loss by less than the share ``tol``; without the column for all rounds."""
        held = F.col(held_out) if held_out else F.lit(False)
        rows = binned(data, self.features_col, F.col(self.label_col), held, self.max_bins, self.seed)
        try:
            width = rows.width
            trees = run_fit(rows, lambda r: self.boosted(r, width), self.checkpoint_interval)
        finally:
            rows.release()
        model = GBTClassificationModel(Forge(data.sparkSession, rows.cuts).boosted_classifier(trees, [1.0, *[self.step] * (len(trees) - 1)]))
        model.setFeaturesCol(self.features_col).setPredictionCol(self.prediction_col)._set(labelCol=self.label_col)
        return model.setRawPredictionCol(self.raw_prediction_col).setProbabilityCol(self.probability_col)

    def boosted(self, rows: Local | Spread, width: int) -> list[Tree]:
        def gradient(b: Block, t: int) -> tuple:
            fitted = np.flatnonzero(~b.held)
            side = 2 * b.label[fitted] - 1
            return fitted, None, 4 * side / (1 + np.exp(2 * side * b.score[fitted])) if t else side

        def loss(b: Block, score: np.ndarray) -> tuple:
            return 2 * np.logaddexp(0, -2 * (2 * b.label[b.held] - 1) * score[b.held]).sum(), b.held.sum()

        trees: list[Tree] = []
        best, kept = None, 0
        rows.scored(lambda b: (np.zeros(len(b.label)), (0, 0)))
        for t in range(max(1, self.rounds)):
            trees.append(grow(rows, t, gradient, range(width), self.depth))
            wrong, n = rows.scored(_step(rows, trees[-1], self.step if t else 1.0, loss))
            if not n:
                continue
            now = wrong / n
            if best is not None and best - now < self.tol * max(now, 0.01):
                break
            if best is None or now < best:
                best, kept = now, t + 1
        return trees[:kept or len(trees)]


#: Of 2 ** 16 equal parts of the unit, the value of a Poisson variable of mean 1.
_POISSON = np.searchsorted(np.cumsum([np.exp(-1) / float(np.prod(np.arange(1, k + 1))) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass(frozen=True)
class Forest:
    """MLlib's ``RandomForestRegressor`` with all features for each tree, on binned trees."""

    trees: int = 100
    depth: int = 10
    max_bins: int = 32
    seed: int = 42
    features_col: str = "features"
    label_col: str = "label"
    prediction_col: str = "prediction"

    def fit(self, data: DataFrame) -> RandomForestRegressionModel:
        rows = binned(data, self.features_col, F.col(self.label_col), F.lit(False), self.max_bins, self.seed)
        seed = self.seed

        def drawn(b: Block, t: int) -> tuple:
            weight = _POISSON[np.random.default_rng([seed, t, b.number]).integers(0, 1 << 16, len(b.label), np.uint16)]
            fitted = np.flatnonzero(weight)
            return fitted, weight[fitted].astype(float), b.label[fitted]

        try:
            trees = grow_forest(rows, self.trees, drawn, self.depth)
        finally:
            rows.release()
        model = RandomForestRegressionModel(Forge(data.sparkSession, rows.cuts).forest(trees))
        return model.setFeaturesCol(self.features_col).setPredictionCol(self.prediction_col)._set(labelCol=self.label_col, numTrees=len(trees))
