"""Cases in which results could depend on size, seed, partitioning or missing input."""

import os

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from orderlens import session
from orderlens.functions import hash_bucket
from orderlens.operators import features, models, profile, quantiles, reshape, segments, split
from orderlens.sources import catalog, schemas


def test_ranks_keep_rows_with_null_keys(spark):
    rows = [(None, i % 50, i) for i in range(300)] + [(1, i % 7, i) for i in range(250)] + [(k, 0, k) for k in range(2, 40)]
    df = spark.createDataFrame(rows, "k long, a long, b long").repartition(5)
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("a", "b")))
    for hot in (10**6, 100, 20):
        got = reshape.rank_within_key(df, "k", ["a", "b"], "r", hot_threshold=hot, chunk_rows=30)
        assert sorted(map(str, got.select("k", "a", "b", "r").collect())) == sorted(map(str, want.collect()))


def test_every_hot_key_is_split(spark):
    df = spark.range(80 * 30).selectExpr("id % 80 AS k", "id AS a")
    got = reshape.rank_within_key(df, "k", ["a"], "r", hot_threshold=20, chunk_rows=10)
    assert got.groupBy("k").agg(F.countDistinct("r").alias("n"), F.max("r").alias("m")).where("n = 30 AND m = 30").count() == 80


@pytest.mark.parametrize("values", [
    [i / 1000 for i in range(1000)] + [1e6 + i / 1000 for i in range(1000)],
    [-1.7e308, 1.7e308, *range(500)],
    [1.0, np.nextafter(1.0, 2), *[1.0] * 60, *[float(np.nextafter(1.0, 2))] * 60],
    [5e-324, 0.0, *[5e-324] * 70, *[0.0] * 71],
    [0.0] * 300 + [1.0] * 301 + list(range(2, 200)),
])
def test_selection_ends_and_is_exact(spark, values):
    values = [float(v) for v in values]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    qs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = quantiles.global_quantiles(df, ["x"], qs)["x"]
    ordered = sorted(values)
    for q, g in zip(qs, got):
        h = q * (len(ordered) - 1)
        lo, hi = ordered[int(np.floor(h))], ordered[int(np.ceil(h))]
        assert lo <= g <= hi and (lo != hi or g == lo)


def test_selection_skips_nan(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(200)] + [(float("nan"), 0), (float("inf"), 1)], "x double, g int")
    assert quantiles.global_quantiles(df, ["x"], [0.5])["x"] == [99.5]
    assert sorted(map(tuple, quantiles.grouped_quantiles(df, ["g"], ["x"], [0.5]).collect())) == [(0, 99.0), (1, 100.0)]


def test_seeds_give_unrelated_buckets(spark):
    df = spark.range(-500, 20_000).select("id", *(hash_bucket("id", s, 10).alias(f"b{s}") for s in (7, 42, 43)))
    same = df.agg(*(F.avg((F.col(a) == F.col(b)).cast("int")) for a, b in (("b42", "b43"), ("b7", "b43")))).first()
    assert all(0.08 < x < 0.12 for x in same)
    assert df.where("b7 < 0 OR b7 > 9").count() == 0
    sizes = [r["count"] for r in df.groupBy("b42").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1.1 * min(sizes)
    md = spark.range(3000).withColumnRenamed("id", "order_id")
    a, b = ({r.order_id for r in split.sample_n(md, 500, seed=s).collect()} for s in (42, 43))
    assert len(a) == len(b) == 500 and len(a & b) < 200


def test_stratified_split_and_folds_are_exact(spark):
    df = spark.range(5003).selectExpr("id AS order_id", "CASE WHEN id % 11 = 0 THEN 0 WHEN id % 997 = 1 THEN NULL ELSE 1 END AS label")
    n = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    s = split.with_stratified_split(df)
    assert s.count() == 5003 and s.select("order_id").distinct().count() == 5003
    test = {r.label: r["count"] for r in s.where("is_test").groupBy("label").count().collect()}
    assert test == {k: int(0.2 * v + 0.5) for k, v in n.items() if int(0.2 * v + 0.5)}
    folds = {}
    for r in split.with_stratified_folds(df, 3).groupBy("label", "fold").count().collect():
        folds.setdefault(r.label, []).append(r["count"])
    assert all(max(f) - min(f) <= 1 and sum(f) == n[k] for k, f in folds.items())
    tr, te = split.stratified_split(df)
    assert tr.count() + te.count() == 5003 and tr.join(te, "order_id").count() == 0


def test_bootstrap_doesnt_depend_on_partitions(spark):
    df = spark.range(3000).selectExpr("id % 3 AS g", "CAST(1 + id % 5 AS DOUBLE) AS v")
    aqe, parts = (spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions"))
    out = []
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in ("4", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(sorted((r.g, round(r.ci_low, 10), round(r.ci_high, 10))
                              for r in profile.mean_ci_bootstrap(df, "v", ["g"], n_boot=200).collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert out[0] == out[1]
    half = 1.96 * np.sqrt(2 / 1000)  # normal theory
    for _, lo, hi in out[0]:
        assert abs((hi - lo) / 2 / half - 1) < 0.25


def test_bootstrap_weights_have_poisson_moments(spark):
    """A group of two values, one of them rare: the interval reflects the rare count's spread."""
    rows = [(0, 0.0)] * 400 + [(0, 100.0)] * 4
    r = profile.mean_ci_bootstrap(spark.createDataFrame(rows, "g int, v double"), "v", ["g"], n_boot=2000).first()
    assert 0.0 <= r.ci_low < 0.5 and 1.7 < r.ci_high < 2.3


def test_csv_without_a_needed_column_raises(spark, tmp_path):
    path = str(tmp_path / "payments.csv")
    with open(path, "w") as f:
        f.write("order_id,payment_sequential,payment_type,payment_installments\na,1,x,2\n")
    with pytest.raises(catalog.MissingColumnError, match="payment_value"):
        catalog.read_csv(spark, path, schemas.PAYMENTS)
    assert catalog.read_csv(spark, path, schemas.PAYMENTS, optional=("payment_value",)).first().payment_value is None


def test_csv_nan_becomes_null(spark, tmp_path):
    path = str(tmp_path / "payments.csv")
    with open(path, "w") as f:
        f.write("order_id,payment_sequential,payment_type,payment_installments,payment_value\na,1,x,2,NaN\nb,1,x,2,inf\nc,1,x,2,3.5\n")
    rows = {r.order_id: r.payment_value for r in catalog.read_csv(spark, path, schemas.PAYMENTS, multi_line=False).collect()}
    assert rows == {"a": None, "b": None, "c": 3.5}


def test_feature_defaults_list_all_categories(spark):
    df = spark.range(300).selectExpr("CAST(id AS DOUBLE) AS x", "concat('c', id % 80) AS c")
    assert features.feature_defaults(df, ["x"], ["c"]).where("feature = 'c'").count() == 80
    assert features.feature_defaults(df, ["x"], ["c"], max_values=50).where("feature = 'c'").count() == 50


def test_one_cluster_has_n_times_d_inertia(spark):
    df = spark.range(200).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(id * id % 17 AS DOUBLE) AS b")
    out = {r.k: r.inertia for r in segments.elbow(df, ["a", "b"], max_k=3).collect()}
    assert abs(out[1] - 400) < 1e-6 and out[1] > out[2] > 0


def test_importances_name_every_slot(spark):
    df = spark.range(300).selectExpr("id AS order_id", "CAST(id % 10 AS DOUBLE) AS x", "CAST(id % 7 AS DOUBLE) AS y",
                                     "concat('c', id % 3) AS c", "CAST(id % 10 >= 5 AS INT) AS label")
    for name in ("logistic", "linear_svm", "random_forest", "naive_bayes"):
        m = models.train_classifier(df, name, ["x", "y"], ["c"], **({"n_estimators": 5, "max_depth": 3} if "forest" in name else {}))
        rows = {r.feature: r.importance for r in models.feature_importance(m, m.transform(df.limit(1))).collect()}
        assert len(rows) == (0 if name == "naive_bayes" else 5)
        assert not rows or max(rows, key=rows.get).endswith("x")


def test_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master = "spark://elsewhere:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default=None: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session)


def test_checkpoint_folder_is_set_once(spark):
    session.checkpoint_dir(spark)
    before = spark.sparkContext.getCheckpointDir()
    session.materialize(spark.range(3))
    assert spark.sparkContext.getCheckpointDir() == before and os.path.basename(before)
