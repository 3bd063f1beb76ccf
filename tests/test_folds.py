"""Statistics of fold complements equal those fitted on the complements."""
import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from orderlens.operators import prep

NUM, CAT = ["a", "b", "c", "empty"], ["s", "t"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    data = [(i, r.choice([None, r.gauss(0, 9), float(r.randrange(4))]), float("nan") if r.random() < 0.6 else r.random(), 2.0, None,
             r.choice(["x", "y", None, f"v{i % 7}"]), r.choice(["m", "n"]) if i % 5 else None, r.choice([0, 0, 0, 1, 2])) for i in range(300)]
    return spark.createDataFrame(data, "id long, a double, b double, c double, empty double, s string, t string, fold int").repartition(4).cache()


def vectors(model, df):
    out = model.transform(df).select("id", vector_to_array("features").alias("v")).collect()
    return {r["id"]: [round(x, 9) for x in r["v"]] for r in out}


def test_each_model_equals_the_one_fitted_on_its_rows(spark, rows):
    rows = rows.drop("empty")
    numeric = [c for c in NUM if c != "empty"]
    clean = rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numeric})
    models = prep.fit_preprocessors(rows, numeric, CAT, "fold", 3)
    assert len(models) == 4
    for f, model in enumerate(models):
        train = clean.where(F.col("fold") != f)  # no row has fold 3: the last one has all
        assert vectors(model, clean) == vectors(prep.preprocessor(numeric, CAT).fit(train), clean)
    alone = prep.fit_preprocessors(rows, numeric, CAT)
    assert len(alone) == 1 and vectors(alone[0], clean) == vectors(models[3], clean)
    assert prep.feature_names(models[0].transform(clean))[0] == "num__a"


def test_held_out_rows_do_not_shape_their_features(spark):
    base = [(i, float(i), "x", i % 3) for i in range(30)]
    other = [(i, v * 1e6 if f == 1 else v, "only" if f == 1 else s, f) for i, v, s, f in base]
    a, b = (spark.createDataFrame(d, "id long, a double, s string, fold int") for d in (base, other))
    one, two = (prep.fit_preprocessors(d, ["a"], ["s"], "fold", 3) for d in (a, b))
    probe = a.where("fold = 0")
    assert vectors(one[1], probe) == vectors(two[1], probe) and vectors(one[0], probe) != vectors(two[0], probe)


def test_columns_without_values(spark, rows):
    model, = prep.fit_preprocessors(rows.where("id < 0"), ["a"], ["s"])
    assert model.stages[0].getOrDefault("medians")[0] != model.stages[0].getOrDefault("medians")[0]
    models = prep.fit_preprocessors(rows, ["empty", "c"], [], "fold", 3)
    got = vectors(models[3], rows.where("id < 3"))
    assert all(v[1] == 0.0 for v in got.values())


@pytest.mark.parametrize("missing", [0, 1, 5, 40])
def test_bounds_after_imputation(missing):
    import numpy as np
    r = random.Random(missing)
    for n in (1, 2, 3, 10, 57):
        x = sorted(float(r.randrange(6)) for _ in range(n))
        at = {k: x[k] for k in prep.imputed_ranks(n, missing, (0.01, 0.99))}
        median, bounds = prep.imputed_bounds(n, missing, at, (0.01, 0.99))
        filled = x + [float(np.median(x))] * missing
        assert median == np.median(x) and np.allclose(bounds, np.percentile(filled, [1, 99]))
