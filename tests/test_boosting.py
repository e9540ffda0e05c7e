"""L1 boosting: leaf medians, feature subsets, the validated stop, against MLlib's own L1 learner."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import functions as F

from shelfcast.operators.boosting import L1Boosting


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.random(900) * 10, rng.integers(0, 5, 900), rng.random(900)
    label = np.where(a > 5, 300.0, 20.0) + 30 * b + np.where(rng.random(900) > 0.95, 5000, 0) + rng.normal(size=900)  # now and then a bulk order that no feature tells
    data = [(float(x), float(y), float(z), float(t), k % 5 == 0) for k, (x, y, z, t) in enumerate(zip(a, b, c, label))]
    df = spark.createDataFrame(data, "a double, b double, c double, label double, later boolean").repartition(2)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).cache()


def mae(model, rows):
    return model.transform(rows).agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0]


def test_one_tree_holds_the_median_of_each_leaf(rows):
    model = L1Boosting(rounds=1, step=1.0, depth=2, subsample=1.0, feature_fraction=1.0).fit(rows)
    table = model.transform(rows).select("label", "prediction").toPandas()
    assert model.getNumTrees == 2 and table["prediction"].nunique() > 2
    for value, own in table.groupby("prediction")["label"]:
        below, above = (own < value).sum(), (own > value).sum()
        assert max(below, above) <= len(own) / 2  # a median


def test_lower_error_than_sign_leaves_at_equal_rounds(rows):
    train, test = rows.where("NOT later"), rows.where("later")
    ours = L1Boosting(rounds=7, step=0.5, depth=3, feature_fraction=1.0).fit(train)
    theirs = GBTRegressor(lossType="absolute", maxIter=8, stepSize=0.5, maxDepth=3, seed=1).fit(train)
    assert mae(ours, test) < mae(theirs, test)


def test_each_tree_uses_its_own_features_only(rows):
    learner = L1Boosting(rounds=4, depth=3, feature_fraction=0.67)
    model = learner.fit(rows)
    subsets = [learner.tree_features(t, 3) for t in range(4)]
    assert len({tuple(s) for s in subsets}) > 1 and all(len(s) == 2 for s in subsets)
    for tree, some in zip(model.trees[1:], subsets, strict=True):
        used = {int(x) for x in tree.featureImportances.indices}
        assert used <= set(some)


def test_rounds_stop_when_the_hold_out_gains_no_more(rows):
    noise = rows.withColumn("label", (F.xxhash64("a", "b", "c") % 1000).cast("double"))
    model = L1Boosting(rounds=50, depth=2, patience=2).fit(noise, "later")
    assert model.getNumTrees < 8
    whole = L1Boosting(rounds=3, depth=2, patience=2).fit(noise)
    assert whole.getNumTrees == 4  # no hold-out, all rounds


def test_scores_carry_on_over_a_cut_and_reload(rows, tmp_dir):
    learner = L1Boosting(rounds=5, depth=2, step=0.5, subsample=1.0)
    model, cut = learner.fit(rows), replace(learner, checkpoint_interval=2).fit(rows)
    model.write().save(f"{tmp_dir}/m")
    again = GBTRegressionModel.load(f"{tmp_dir}/m")
    values = [sorted(r[0] for r in m.transform(rows).select("prediction").collect()) for m in (model, cut, again)]
    assert np.allclose(values[0], values[1]) and values[0] == values[2]


def test_nothing_to_fit_on(rows):
    with pytest.raises(ValueError, match="no row"):
        L1Boosting(rounds=1).fit(rows.where("a < 0"))


@pytest.mark.parametrize("few", [10_000, 5])
def test_medians_are_exact_in_bounded_passes(spark, monkeypatch, few):
    from shelfcast.operators import boosting

    monkeypatch.setattr(boosting, "FEW", few)
    rng = np.random.default_rng(1)
    values = [(0, float(x)) for x in rng.normal(size=501)] + [(1, float(x)) for x in rng.integers(0, 4, 400)] + [(3, 5.0)] * 30 + [(5, None)] * 3
    values += [(4, x) for x in (-1.7e308, 1.7e308, 0.0, 5e-324)] * 9 + [(6, 1e9 * float(x) ** 9) for x in rng.normal(size=778)]
    rows = spark.createDataFrame(values, "leaf int, value double").repartition(3)
    want, ranges = {}, {}
    for leaf in range(7):
        if own := sorted(x for k, x in values if k == leaf and x is not None):
            want[leaf], ranges[leaf] = own[(len(own) - 1) // 2], (len(own), own[0], own[-1])
    assert boosting.medians(rows, ranges) == want


def test_trees_are_fitted_to_few_partitions(spark, rows):
    from shelfcast.operators.boosting import ROWS, gathered

    cores = spark.sparkContext.defaultParallelism
    many = rows.repartition(3 * cores)
    assert gathered(many, 900).rdd.getNumPartitions() == cores
    assert gathered(many, ROWS * 2 * cores).rdd.getNumPartitions() == 2 * cores


def test_daily_rows_are_made_once(spark):
    from shelfcast.operators.scoring import train_request_model

    made = spark.sparkContext.accumulator(0)
    day = F.udf(lambda k: made.add(1) or float(k % 7), "double").asNondeterministic()
    daily = spark.range(60).select(day("id").alias("lag_7"), (F.col("id") % 5).alias("lag_14"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("sale_date"),
                                   (F.col("id") % 9 + 1).alias("quantity"))
    train_request_model(daily, ["lag_7", "lag_14"], iters=1, depth=2)
    assert made.value == 60
