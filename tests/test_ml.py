"""Model sanity: persistence, quality band, scaler invariant, search."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.operators import features, metrics, models, prep, segments, split
from orderlens.operators import orders
from orderlens.sources import sinks
from orderlens.sources.derived import derived_catalog
from tests.conftest import SF_MID

NUM, CAT = features.NUMERIC_FEATURES, features.CATEGORICAL_FEATURES


@pytest.fixture(scope="module")
def xy(spark):
    md = orders.model_dataset(derived_catalog(spark, SF_MID)).dropna(how="any")
    return features.supervised_xy(md).cache()


def test_save_load_same_predictions(spark, xy, tmp_dir):
    tr, te = split.train_test_split(xy)
    m = models.train_classifier(tr, "logistic", NUM, CAT)
    p = os.path.join(tmp_dir, "m")
    sinks.save_model(m, p)
    a = models.predict(m, te, keep=["order_id"]).orderBy("order_id").collect()
    b = models.predict(sinks.load_model(p), te, keep=["order_id"]).orderBy("order_id").collect()
    assert [r.prediction for r in a] == [r.prediction for r in b]


def test_gaussian_nb_persists(spark, xy, tmp_dir):
    tr, te = split.train_test_split(xy)
    m = models.train_classifier(tr, "naive_bayes", NUM, CAT)
    p = os.path.join(tmp_dir, "nb")
    sinks.save_model(m, p)
    a = models.predict(m, te, keep=["order_id"]).orderBy("order_id").collect()
    b = models.predict(sinks.load_model(p), te, keep=["order_id"]).orderBy("order_id").collect()
    assert [r.prediction for r in a] == [r.prediction for r in b]


def test_weighted_model_finds_bad_reviews(spark, xy):
    """The derived score depends on lateness: a balanced model must recall
    class 0 far better than the majority rule (recall 0)."""
    tr, te = split.train_test_split(xy)
    m = models.train_classifier(tr, "logistic", NUM, CAT)
    met = metrics.metrics_dict(metrics.confusion_counts(models.predict(m, te, keep=["label"])))
    assert met["recall_0"] > 0.5


def test_assign_requires_scaler(spark, xy):
    from pyspark.ml import PipelineModel
    with pytest.raises(ValueError):
        segments.assign_clusters(PipelineModel(stages=[]), xy)


def test_kmeans_renumbered_by_spend(spark):
    md = orders.model_dataset(derived_catalog(spark, SF_MID))
    cf = features.cluster_features(md)
    model, cost = segments.kmeans_fit(cf, k=3, n_init=2)
    mapping = segments.spend_order(model, cf)
    lab = segments.assign_clusters(model, cf, mapping=mapping)
    means = {r.cluster: r.m for r in lab.join(cf, "order_id").groupBy("cluster")
             .agg(F.avg("total_items_price").alias("m")).collect()}
    assert means[0] >= means[1] >= means[2]
    assert lab.count() == cf.count()


def test_sample_grid_deterministic():
    a = models.sample_grid(models.RF_GRID, 10, 42)
    b = models.sample_grid(models.RF_GRID, 10, 42)
    assert a == b and len(a) == 10


def test_worst_categories_threshold_exercised(spark):
    """With a threshold that removes categories, the SQL slice still agrees."""
    from orderlens.operators import drivers
    c = derived_catalog(spark, SF_MID)
    top = drivers.worst_categories(c["order_reviews"], c["order_items"], c["products"], min_count=2200)
    rows = top.collect()
    assert 0 < len(rows) <= 10 and all(r.n_reviews >= 2200 for r in rows)
    pct = [r.pct_bad for r in rows]
    assert pct == sorted(pct, reverse=True)


def test_search_bounds_rows_not_statistics(spark):
    """A level and a value that only one row has are known, however few rows the classifier sees."""
    rows = [(i, float(i % 50), "rare" if i == 777 else f"c{i % 3}", float(i % 2)) for i in range(1, 1001)]
    train = spark.createDataFrame([(i, 1e6 if i == 778 else x, c, y) for i, x, c, y in rows],
                                  "order_id long, x double, c string, label double")
    assert not models.bounded_rows(train, 60).where("order_id IN (777, 778)").count()
    best, res = models.random_search(train, "random_forest", ["x"], ["c"], {"n_estimators": [2], "max_depth": [2]},
                                     n_iter=1, fit_rows=60)
    whole = prep.preprocessor(["x"], ["c"]).fit(train).transform(train).orderBy("order_id")
    found = best.transform(train).orderBy("order_id")
    assert res.count() == 1
    assert [r.features for r in found.select("features").collect()] == [r.features for r in whole.select("features").collect()]


def searched(spark, n, parts=3):
    rows = [(i, float(i % 50), "rare" if i == 777 else f"c{i % 3}", float((i % 50 > 20) != (i % 7 == 0))) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "order_id long, x double, c string, label double").repartition(parts)


@pytest.mark.parametrize("name,grid", [("random_forest", {"n_estimators": [3], "max_depth": [4], "class_weight": ["balanced", {0: 2, 1: 1}]}),
                                       ("gbt", {"n_estimators": [2], "max_depth": [2], "subsample": [0.8]})])
def test_search_compares_draws_on_all_rows(spark, monkeypatch, name, grid):
    """No row is left out by default, and it makes no difference whether a draw is fitted in one task or a job a level."""
    from orderlens.operators import trees
    monkeypatch.setattr(trees, "BLOCK_ROWS", 150)
    monkeypatch.setattr(models, "sample_n", lambda *_, **__: pytest.fail("rows are sampled"))
    of, seen = models.hits_of, []
    monkeypatch.setattr(models, "hits_of", lambda *a: seen.append((list(of(*a)), a)) or seen[-1][0])
    _, table = models.random_search(searched(spark, 400), name, ["x"], ["c"], grid, n_iter=2, k=2)
    (found, (_, params, blocks, layouts)), = seen
    assert [sum(n for i, _, n in found if i == draw) for draw in range(len(params))] == [400] * table.count()
    if name == "gbt":
        monkeypatch.setattr(trees, "ONE_TASK_ROWS", 0)
        assert sorted(of(name, params, blocks, layouts)) == sorted(found)
    # the plain way: a draw's model over one block of the other fold's rows
    for f, layout in enumerate(layouts):
        held = blocks[f].collect()
        whole = trees.Block(*(np.concatenate([getattr(b, c) for b in held]) for c in ("codes", "y", "w", "key", "fold")))
        for draw, own in enumerate(params):
            rows, test = whole.rows(whole.fold != f), whole.rows(whole.fold == f)
            weights = models.weights_of(own.get("class_weight"), {y: int((rows.y == y).sum()) for y in (0.0, 1.0)})
            rows.w = np.array([weights[y] for y in rows.y.tolist()])
            if name == "gbt":
                grown, start = trees.boost_rows(rows, layout, models.boost_of(own))
                positive = trees.margins(test, grown, start) > 0
            else:
                positive = sum(t.value[t.nodes(test.codes)] for t in trees.forest_rows(rows, layout, models.forest_of(own))) > 1.5
            assert (draw, int((positive == (test.y == 1)).sum()), len(test.y)) in found
