"""Hand-made edge rows for each pandas-vs-Spark semantic the library encodes."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from orderlens.functions import clip, day_diff, late_flag, score_bucket, strict_binary_target, weekday_mon0
from orderlens.operators import features, orders, prep


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_negative_sub_day_delay_floors(spark):
    df = spark.createDataFrame([(ts("2018-01-01 23:00:00"), ts("2018-01-02 01:00:00"))],
                               "d timestamp_ntz, e timestamp_ntz")
    assert df.select(day_diff("d", "e").alias("x")).first().x == -1.0


def test_two_hours_over_midnight_is_zero_days(spark):
    df = spark.createDataFrame([(ts("2018-01-02 01:00:00"), ts("2018-01-01 23:00:00"))],
                               "d timestamp_ntz, e timestamp_ntz")
    assert df.select(day_diff("d", "e").alias("x")).first().x == 0.0


def test_weekday_monday_zero(spark):
    df = spark.createDataFrame([(ts("2024-01-01 10:00:00"),)], "t timestamp_ntz")  # a Monday
    assert df.select(weekday_mon0("t").alias("w")).first().w == 0


def test_drop_canceled_keeps_null_status(spark):
    df = spark.createDataFrame([("a", "canceled"), ("b", None), ("c", "delivered")], "order_id string, order_status string")
    assert sorted(r.order_id for r in orders.drop_canceled(df).collect()) == ["b", "c"]


def test_undelivered_not_late(spark):
    df = spark.createDataFrame([(None,), (2.0,), (-1.0,)], "d double")
    assert [r.x for r in df.select(late_flag("d").alias("x")).collect()] == [False, True, False]


def test_two_reviews_mean_is_neutral(spark):
    rv = spark.createDataFrame([("r1", "o1", 2), ("r2", "o1", 3)], "review_id string, order_id string, review_score bigint")
    agg = orders.reviews_agg(rv).transform(orders.add_targets).first()
    assert agg.review_score == 2.5 and agg.review_count == 2
    assert agg.review_binary is None and agg.review_positive == 0 and agg.review_negative == 0


def _catalog(spark, items_rows):
    o = spark.createDataFrame([("o1", "c1", "delivered", ts("2018-01-01 10:00:00"), None, ts("2018-01-05 10:00:00"),
                                ts("2018-01-06 10:00:00"))],
                              "order_id string, customer_id string, order_status string, order_purchase_timestamp "
                              "timestamp_ntz, order_approved_at timestamp_ntz, order_delivered_customer_date "
                              "timestamp_ntz, order_estimated_delivery_date timestamp_ntz")
    it = spark.createDataFrame(items_rows, "order_id string, order_item_id bigint, product_id string, "
                                           "seller_id string, price double, freight_value double")
    rv = spark.createDataFrame([("r1", "o1", 5)], "review_id string, order_id string, review_score bigint")
    cu = spark.createDataFrame([("c1", "SP", "x")], "customer_id string, customer_state string, customer_city string")
    pr = spark.createDataFrame([("p1", "cat1"), ("p2", "cat2")], "product_id string, product_category_name string")
    pa = spark.createDataFrame([("o1", 2, "voucher", 1, 5.0), ("o1", 1, None, 3, 7.0)],
                               "order_id string, payment_sequential bigint, payment_type string, "
                               "payment_installments bigint, payment_value double")
    return {"orders": o, "order_items": it, "order_reviews": rv, "customers": cu, "products": pr, "payments": pa}


def test_order_without_items_kept_with_null_count(spark):
    c = _catalog(spark, [("zz", 1, "p1", "s", 1.0, 1.0)])
    row = orders.base_orders(c).first()
    assert row.n_items is None and row.total_items_price is None and row.order_id == "o1"


def test_null_prices_sum_to_zero(spark):
    c = _catalog(spark, [("o1", 1, "p1", "s", None, None)])
    row = orders.base_orders(c).first()
    assert row.n_items == 1 and row.total_items_price == 0.0 and row.total_freight_value == 0.0


def test_first_non_null_product_and_ordered_lists(spark):
    c = _catalog(spark, [("o1", 2, "p2", "s2", 1.0, 0.1), ("o1", 1, None, "s1", 1.0, 0.1), ("o1", 3, "p1", "s3", 1.0, 0.1)])
    row = orders.base_orders(c, item_lists=True).first()
    assert row.product_category_name == "cat2"
    assert row.product_ids == [None, "p2", "p1"] and row.sellers_ids == ["s1", "s2", "s3"]


def test_first_payment_type_by_sequential_even_if_null(spark):
    c = _catalog(spark, [("o1", 1, "p1", "s", 1.0, 1.0)])
    row = orders.base_orders(c).first()
    assert row.payment_type is None and row.payment_sequential == 2 and row.payment_installments == 3
    assert row.payment_value == 12.0


def test_unseen_and_null_category_all_zero(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    train = spark.createDataFrame([("x",), ("y",), ("z",)], "c string")
    m = Pipeline(stages=prep.one_hot_stages(["c"])).fit(train)
    test = spark.createDataFrame([("q",), (None,), ("y",)], "c string")
    out = [r.a for r in m.transform(test).select(vector_to_array("c__oh").alias("a")).collect()]
    assert out == [[0.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.0, 1.0, 0.0]]


def test_constant_column_minmax_is_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    out = prep.MinMaxScaler(inputCols=["x"]).fit(df).transform(df)
    assert [r.x for r in out.collect()] == [0.0, 0.0]


def test_even_count_median_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double")
    out = prep.MedianImputer(inputCols=["x"]).fit(df).transform(df)
    assert sorted(r.x for r in out.collect()) == [1.0, 1.5, 2.0]


def test_mode_imputer_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    out = prep.ModeImputer(inputCols=["c"]).fit(df).transform(df)
    assert sorted(r.c for r in out.collect()) == ["a", "a", "b"]


def test_residual_bin_edges_right_closed(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.25), (1.0, 1.2500001), (2.0, 1.3), (3.0, 1.1)],
                               "label double, prediction double")
    bins = {r.bin: r for r in features.residual_bins(df).collect()}
    assert set(bins) == {1, 2}  # 1.0, 1.25 and 1.1 in bin 1; 1.2500001 and 1.3 in bin 2
    assert bins[1].n == 3 and bins[2].n == 2
    assert abs(bins[1].bin_center - 1.1245) < 1e-12


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (0.2,), (7.0,)], "x double")
    assert [r.b for r in df.select(score_bucket("x").alias("b")).collect()] == [2, 4, 1, 5]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (0.5,)], "x double")
    assert [r.c for r in df.select(clip("x", 1.0, 5.0).alias("c")).collect()] == [None, 1.0]


def test_strict_binary_target(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "s double")
    assert [r.t for r in df.select(strict_binary_target("s").alias("t")).collect()] == [0.0, 0.0, None, 1.0, None]


def test_quantiles_interpolate_linearly(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "x double")
    assert features.quantile_bounds(df, ["x"], 0.25, 0.75)["x"] == (1.75, 5.0)


def test_distributed_selection_equals_percentile(spark):
    from orderlens.operators.quantiles import global_quantiles
    rows = [(float((i * 7919) % 1000) / 7.0,) for i in range(3000)] + [(None,)]
    df = spark.createDataFrame(rows, "x double")
    qs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    sel = global_quantiles(df, ["x"], qs)["x"]
    ref = list(df.agg(F.percentile("x", qs)).first()[0])
    assert sel == ref


def test_nan_never_reaches_late_flag(spark):
    df = spark.createDataFrame([(float("nan"),)], "d double")
    from orderlens.functions import finite_or_null
    assert df.select(late_flag(finite_or_null("d")).alias("x")).first().x is False


@pytest.mark.parametrize("lo,hi", [(1, 5)])
def test_stars(spark, lo, hi):
    from orderlens.functions import stars
    df = spark.createDataFrame([(4.6,), (0.0,)], "p double")
    assert [r.s for r in df.select(stars("p").alias("s")).collect()] == ["★★★★★", "★☆☆☆☆"]


def test_class_label(spark):
    from orderlens.functions import class_label
    df = spark.createDataFrame([(1.0,), (0.0,)], "p double")
    assert [r.s for r in df.select(class_label("p").alias("s")).collect()] == ["Bom (1)", "Ruim (0)"]


def test_grouped_selection_equals_percentile(spark):
    from orderlens.operators.quantiles import grouped_quantiles
    rows = [(i % 3, float((i * 7919) % 1000) / 7.0) for i in range(3000)] + [(1, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    qs = [0.01, 0.25, 0.5, 0.99]
    sel = grouped_quantiles(df, ["g"], ["x"], qs)
    ref = {r.g: list(r.q) for r in df.groupBy("g").agg(F.percentile("x", qs).alias("q")).collect()}
    assert {r[0]: list(r[1:]) for r in sel.collect()} == ref


def test_clip_scaler_equals_clipper_then_minmax(spark):
    rows = [(float(i % 97) if i % 11 else None, 5.0) for i in range(500)] + [(1000.0, 5.0), (-50.0, 5.0)]
    df = spark.createDataFrame(rows, "x double, k double")
    a = prep.QuantileClipper(inputCols=["x", "k"]).fit(df).transform(df)
    a = prep.MinMaxScaler(inputCols=["x", "k"]).fit(a).transform(a)
    b = prep.ClipScaler(inputCols=["x", "k"]).fit(df).transform(df)
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
