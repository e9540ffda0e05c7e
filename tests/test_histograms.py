"""Binned trees against MLlib's own learners, one task against many, jobs of a fit."""

from __future__ import annotations

import uuid

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from shelfcast.operators import histograms as h
from shelfcast.operators.boosting import Forest, L1Boosting, LogisticBoosting


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    a, b, c = rng.random(1500) * 10, rng.integers(0, 5, 1500), rng.normal(size=1500)
    label = np.where(a > 5, 30, 2) + 3 * b + rng.integers(0, 9, 1500)
    demand = (a + c > 6) ^ (rng.random(1500) > 0.9)
    data = [(*map(float, x), k % 6 == 0) for k, x in enumerate(zip(a, b, c, label, demand))]
    df = spark.createDataFrame(data, "a double, b double, c double, label double, demand double, later boolean").repartition(3)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).cache()


def predicted(model, rows, column="prediction"):
    return np.array([r[0] for r in model.transform(rows).orderBy("a").select(column).collect()])


@pytest.fixture(params=["one task", "many"])
def mode(request, monkeypatch):
    if request.param == "many":
        for name, value in {"LOCAL": 10, "COUNTS": 4000}.items():
            monkeypatch.setattr(h, name, value)


def test_a_tree_is_that_of_mllib(rows, mode):
    ours = Forest(trees=1, depth=5, max_bins=16)
    kept = h.binned(rows, "features", F.col("label"), F.lit(False), 16, 1)
    whole = lambda b, t: (np.arange(len(b.label)), None, b.label)
    trees = h.grow_forest(kept, 1, whole, ours.depth)
    alone = h.run_fit(kept, lambda r: h.grow(r, 0, whole, range(3), 5), 10)
    theirs = DecisionTreeRegressor(maxDepth=5, maxBins=16).fit(rows)
    for tree in (trees[0], alone):
        made = h.Forge(rows.sparkSession, kept.cuts).tree(tree)
        assert made.toDebugString().split("\n", 1)[1] == theirs.toDebugString.split("\n", 1)[1]


def test_the_classifier_is_that_of_mllib(rows, mode):
    # Shallow trees: in nodes of a few rows two splits may gain the same but for rounding.
    ours = LogisticBoosting(rounds=20, step=0.3, depth=2, label_col="demand", tol=0.02).fit(rows, "later")
    theirs = GBTClassifier(labelCol="demand", maxIter=20, stepSize=0.3, maxDepth=2, validationIndicatorCol="later", validationTol=0.02, seed=42).fit(rows)
    assert 1 < ours.getNumTrees == theirs.getNumTrees < 20
    assert np.allclose([list(v) for v in predicted(ours, rows, "probability")], [list(v) for v in predicted(theirs, rows, "probability")])
    whole = LogisticBoosting(rounds=4, depth=2, label_col="demand").fit(rows)
    assert whole.getNumTrees == 4 and np.allclose(whole.featureImportances.toArray(), GBTClassifier(labelCol="demand", maxIter=4, stepSize=0.05, maxDepth=2, seed=42).fit(rows).featureImportances.toArray())


def test_the_forest_is_as_good_as_that_of_mllib(rows, tmp_dir):
    from pyspark.ml.regression import RandomForestRegressionModel

    train, test = rows.where("NOT later"), rows.where("later")
    ours = Forest(trees=25, depth=6).fit(train)
    theirs = RandomForestRegressor(numTrees=25, maxDepth=6, featureSubsetStrategy="all", seed=1).fit(train)
    label = np.array([r[0] for r in test.orderBy("a").select("label").collect()])
    errors = [np.abs(predicted(m, test) - label).mean() for m in (ours, theirs)]
    assert ours.getNumTrees == 25 and errors[0] < 1.05 * errors[1]
    ours.write().save(f"{tmp_dir}/forest")
    assert (predicted(RandomForestRegressionModel.load(f"{tmp_dir}/forest"), test) == predicted(ours, test)).all()


def test_one_task_and_many_give_the_same_models(rows, monkeypatch):
    fits = [lambda: L1Boosting(rounds=5, depth=3, step=0.3, checkpoint_interval=2, patience=20).fit(rows, "later"), lambda: Forest(trees=3, depth=4).fit(rows)]
    alone = [predicted(f(), rows) for f in fits]
    for name, value in {"LOCAL": 10, "GATHER": 50, "RANGES": 8, "COUNTS": 20_000}.items():
        monkeypatch.setattr(h, name, value)
    for one, f in zip(alone, fits, strict=True):
        assert np.allclose(one, predicted(f(), rows))


def test_rounds_of_few_rows_are_no_jobs(spark, rows):
    """A job for each level of each tree is what a fit of hundreds of rounds took its time for."""
    sc = spark.sparkContext

    def jobs(fit) -> int:
        group = f"jobs-{uuid.uuid4()}"
        sc.setJobGroup(group, "")
        try:
            fit()
            return len(sc.statusTracker().getJobIdsForGroup(group))
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)

    for learner in (L1Boosting, LogisticBoosting):
        label = {} if learner is L1Boosting else {"label_col": "demand"}
        few, more = (jobs(lambda k=k: learner(rounds=k, depth=3, **label).fit(rows)) for k in (2, 12))
        assert more <= few < 20


def test_labels_must_be_there(rows):
    with pytest.raises(ValueError, match="no label"):
        L1Boosting(rounds=1).fit(rows.withColumn("label", F.when(F.col("a") > 1, F.col("label"))))


def test_equal_values_share_a_bin():
    assert h.thresholds(np.array([0.0, -0.0, 1.0, 1.0, 4.0]), 32).tolist() == [0.5, 2.5]
    assert h.thresholds(np.full(9, 3.0), 32).tolist() == []
    cuts = h.thresholds(np.repeat(np.arange(100.0), 5), 8)
    assert len(cuts) <= 7 and (np.diff(cuts) > 0).all()
