"""Small operators without an SQL oracle: dtypes, presence check,
stabiliser, feature names, bootstrap interval, arg-best ties, rest-after-top."""
from pyspark.sql import functions as F

from orderlens.operators import features, prep, profile, reshape


def test_dtypes_frame(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "a int, b string, c double")
    assert [tuple(r) for r in profile.dtypes_frame(df).collect()] == [("a", "int"), ("b", "string"), ("c", "double")]


def test_missing_columns_warning_list(spark):
    df = spark.createDataFrame([(1, 2)], "x int, y int")
    assert profile.missing_columns(df, ["x", "z", "y", "w"]) == ["z", "w"]


def test_stabilizer_nan_inf_clip(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-30.0,), (3.0,), (None,)], "x double")
    out = [r.x for r in prep.Stabilizer(inputCols=["x"], bound=15.0).transform(df).collect()]
    assert out == [0.0, 0.0, -15.0, 3.0, None]


def test_feature_names_from_metadata(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, None)], "n double, c string")
    m = prep.preprocessor(["n"], ["c"]).fit(df)
    names = prep.feature_names(m.transform(df))
    assert names == ["num__n", "cat__c_a", "cat__c_b"]
    shorts = [r.s for r in spark.createDataFrame([(x,) for x in names], "f string")
              .select(features.short_feature_name("f").alias("s")).collect()]
    assert shorts == ["n", "cat_c_a", "cat_c_b"]


def test_bootstrap_interval_brackets_mean(spark):
    rows = [(i % 2, float(1 + (i * 7) % 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, v double")
    out = {r.g: r for r in profile.mean_ci_bootstrap(df, "v", ["g"], n_boot=100).collect()}
    for r in out.values():
        assert r.ci_low < r.mean < r.ci_high and r.ci_high - r.ci_low < 0.5


def test_arg_best_first_wins_ties(spark):
    df = spark.createDataFrame([("a", 0, 0.8), ("b", 1, 0.9), ("c", 2, 0.9)], "model string, ordinal int, accuracy double")
    assert reshape.arg_best(df, "accuracy").first().model == "b"
    assert reshape.arg_best(df, "accuracy", higher_is_better=False).first().model == "a"


def test_rest_after_top(spark):
    df = spark.createDataFrame([(f"f{i}", float(i)) for i in range(15)], "feature string, importance double")
    rest = reshape.rest_after_top(df, [F.desc("importance")], 10)
    assert sorted(r.feature for r in rest.collect()) == ["f0", "f1", "f2", "f3", "f4"]


def test_coerce_numeric_and_timestamps(spark):
    df = spark.createDataFrame([("1.5", "2018-01-01 10:00:00"), ("x", "bad")], "a string, t string")
    out = reshape.coerce_timestamps(reshape.coerce_numeric(df, ["a"]), ["t"]).collect()
    assert out[0].a == 1.5 and out[1].a is None and out[1].t is None and out[0].t.hour == 10


def test_rank_within_key_survives_hot_key(spark):
    from pyspark.sql import Window
    # one key holds ~half of the rows; the rank must equal a plain window's
    rows = [(0 if i % 2 == 0 else i, (i * 37) % 1001, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, a long, b long")
    got = reshape.rank_within_key(df, "k", ["a", "b"], "r", hot_threshold=500, chunk_rows=300)
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("a", "b")))
    assert sorted(map(tuple, got.select("k", "a", "b", "r").collect())) == \
        sorted(map(tuple, want.select("k", "a", "b", "r").collect()))
    # the plan numbers the hot key per (key, chunk): several chunks exist
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_chunk" in plan


def test_rank_within_key_without_hot_keys_is_plain_window(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (2, 5)], "k long, a long")
    got = sorted(map(tuple, reshape.rank_within_key(df, "k", ["a"], "r").collect()))
    assert got == [(1, 1, 1), (1, 2, 2), (2, 5, 1)]


def test_dedup_first_values_from_one_row_even_with_ties(spark):
    from orderlens.operators import drivers
    rows = [(k, o, float(k * 100 + i), k * 1000 + i) for k in range(20) for i, o in enumerate([3, 1, 1, 2, 1])]
    df = spark.createDataFrame(rows, "k long, o long, a double, b long").repartition(7)
    got = drivers.dedup_first(df, "k", "o").collect()
    pairs = {(r[0], r[2], r[3]) for r in rows if r[1] == 1}
    assert len(got) == 20 and all((g.k, g.a, g.b) in pairs for g in got)
    assert all(g.o == 1 for g in got)
