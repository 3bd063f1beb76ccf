"""Registered queries: one per operator of the inventory.

Each query takes ``(spark, sf_dir)``, derives the marketplace tables from
the driver tables under ``sf_dir`` (whole tables, lazily) and returns a
DataFrame whose columns are aliased exactly like its SQL oracle.
Non-integral doubles are rounded to ``DIGITS`` places so engines that sum
in a different order agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import score_bucket as _score_bucket
from ..functions import stars as _stars
from ..operators import drivers, orders, profile, reshape, split
from ..operators import features as feat
from ..operators import metrics as met
from ..operators import models as mdl
from ..operators import prep, segments
from ..session import materialize
from ..sources.derived import derived_catalog
from . import rules

DIGITS = 6
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def rnd(df: DataFrame, *cols: str, digits: int = DIGITS) -> DataFrame:
    """Round the named double columns (all doubles when none named)."""
    names = cols or tuple(f.name for f in df.schema.fields if f.dataType.typeName() == "double")
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns])


def cat(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return derived_catalog(spark, sf_dir)


def model_df(spark, sf_dir) -> DataFrame:
    return orders.model_dataset(cat(spark, sf_dir))


# ---------------------------------------------------------------- sources
@query("load_catalog")
def q_load_catalog(spark, sf_dir):
    return cat(spark, sf_dir)["orders"]


@query("load_catalog_csv")
def q_load_catalog_csv(spark, sf_dir):
    """The orders of the catalogue written as CSV files under their public names and loaded back by header name,
    without the optional translation file."""
    import os
    import uuid

    from ..session import scratch_path
    from ..sources import catalog, schemas, sinks
    place = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    tables = cat(spark, sf_dir)
    for name, (file, schema) in schemas.FILES.items():
        have = tables[name]
        columns = [F.col(f.name) if f.name in have.columns else F.lit(None).cast("string").alias(f.name) for f in schema.fields]
        sinks.export_csv(have.select(*columns), os.path.join(place, file))
    loaded = catalog.load_catalog(spark, place)
    reviews = loaded["order_reviews"].groupBy("order_id").agg(F.count("review_id").alias("n_reviews"), F.sum("review_score").alias("sum_score"))
    return loaded["orders"].select(
        F.col("order_id").cast("long").alias("order_id"), F.col("customer_id").cast("long").alias("customer_id"), "order_status",
        "order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date").join(
        reviews.withColumn("order_id", F.col("order_id").cast("long")), "order_id", "left")


DATE_COLS = ["order_purchase_timestamp", "order_approved_at", "order_delivered_customer_date",
             "order_estimated_delivery_date"]


@query("parse_dates")
def q_parse_dates(spark, sf_dir):
    o = cat(spark, sf_dir)["orders"]
    as_text = o.select("order_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in DATE_COLS])
    return reshape.coerce_timestamps(as_text, DATE_COLS)


@query("table_shapes")
def q_table_shapes(spark, sf_dir):
    return profile.table_shapes(cat(spark, sf_dir))


@query("missing_profile")
def q_missing_profile(spark, sf_dir):
    return profile.missing_profile_catalog(cat(spark, sf_dir))


@query("preview")
def q_preview(spark, sf_dir):
    return profile.preview(cat(spark, sf_dir)["orders"],
                           ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "not_there"],
                           n=5, order_by=["order_id"])


# ---------------------------------------------------------------- filters / scalar
@query("drop_canceled")
def q_drop_canceled(spark, sf_dir):
    return orders.drop_canceled(cat(spark, sf_dir)["orders"])


@query("require_score")
def q_require_score(spark, sf_dir):
    return orders.require_score(cat(spark, sf_dir)["order_reviews"])


@query("dropna_any")
def q_dropna_any(spark, sf_dir):
    return rnd(model_df(spark, sf_dir).dropna(how="any"))


@query("time_features")
def q_time_features(spark, sf_dir):
    b = orders.base_orders(cat(spark, sf_dir)).transform(orders.add_time_features)
    return b.select("order_id", "delivery_time_days", "estimated_delivery_days", "delivery_delay_days",
                    "purchase_year", "purchase_month", "purchase_dayofweek")


@query("targets")
def q_targets(spark, sf_dir):
    return model_df(spark, sf_dir).select("order_id", "review_score", "review_positive", "review_negative",
                                          "review_binary")


# ---------------------------------------------------------------- aggregates + joins
@query("reviews_agg")
def q_reviews_agg(spark, sf_dir):
    return rnd(orders.reviews_agg(cat(spark, sf_dir)["order_reviews"]))


@query("items_agg")
def q_items_agg(spark, sf_dir):
    return rnd(orders.items_agg(cat(spark, sf_dir)["order_items"], lists=True))


@query("payments_agg")
def q_payments_agg(spark, sf_dir):
    return rnd(orders.payments_agg(cat(spark, sf_dir)["payments"]))


@query("first_item")
def q_first_item(spark, sf_dir):
    return orders.first_item(cat(spark, sf_dir)["order_items"])


@query("translate_category")
def q_translate_category(spark, sf_dir):
    c = cat(spark, sf_dir)
    return reshape.translate(c["products"], c["product_translation"], "product_category_name")


@query("base_orders")
def q_base_orders(spark, sf_dir):
    return rnd(orders.base_orders(cat(spark, sf_dir)))


@query("model_dataset")
def q_model_dataset(spark, sf_dir):
    return rnd(orders.model_dataset(cat(spark, sf_dir), item_lists=True))


# ---------------------------------------------------------------- EDA
@query("score_distribution")
def q_score_distribution(spark, sf_dir):
    return rnd(profile.score_distribution(cat(spark, sf_dir)["order_reviews"]))


@query("target_distribution")
def q_target_distribution(spark, sf_dir):
    return profile.value_counts_long(model_df(spark, sf_dir),
                                     ["review_score", "review_positive", "review_negative", "review_binary"])


@query("orders_per_month")
def q_orders_per_month(spark, sf_dir):
    return profile.orders_per_month(cat(spark, sf_dir)["orders"])


@query("period_covered")
def q_period_covered(spark, sf_dir):
    return profile.period_covered(cat(spark, sf_dir)["orders"])


@query("delay_by_score")
def q_delay_by_score(spark, sf_dir):
    c = cat(spark, sf_dir)
    rows = drivers.delay_by_score_rows(c["order_reviews"], c["orders"])
    return profile.describe(rows, "delivery_delay_days", by=["review_score"])


@query("dedup_reviews")
def q_dedup_reviews(spark, sf_dir):
    r = cat(spark, sf_dir)["order_reviews"].select("order_id", "review_id", "review_score")
    return drivers.dedup_first(r, "order_id", "review_id")


@query("score_describe")
def q_score_describe(spark, sf_dir):
    return profile.describe(model_df(spark, sf_dir), "review_score")


@query("corr_delay_score")
def q_corr_delay_score(spark, sf_dir):
    c = cat(spark, sf_dir)
    return rnd(drivers.corr_delay_score(c["order_reviews"], c["orders"]))


@query("review_by_late_flag")
def q_review_by_late_flag(spark, sf_dir):
    c = cat(spark, sf_dir)
    return rnd(drivers.review_by_late_flag(c["order_reviews"], c["orders"]))


@query("worst_categories")
def q_worst_categories(spark, sf_dir):
    c = cat(spark, sf_dir)
    return rnd(drivers.worst_categories(c["order_reviews"], c["order_items"], c["products"],
                                        min_count=50, top_n=10))


@query("worst_states")
def q_worst_states(spark, sf_dir):
    c = cat(spark, sf_dir)
    return rnd(drivers.worst_states(c["order_reviews"], c["orders"], c["customers"], min_count=100, top_n=10))


@query("overall_bad_rate")
def q_overall_bad_rate(spark, sf_dir):
    c = cat(spark, sf_dir)
    a = drivers.overall_bad_rate_categories(c["order_reviews"], c["order_items"]).select(
        F.lit("categories").alias("scope"), "pct_bad", "n_rows")
    b = drivers.overall_bad_rate_states(c["order_reviews"], c["orders"], c["customers"]).select(
        F.lit("states").alias("scope"), "pct_bad", "n_rows")
    return rnd(a.unionByName(b))


# ================================================================ batch 2: features, prep, metrics

NUM = feat.NUMERIC_FEATURES
CAT = feat.CATEGORICAL_FEATURES


def sup(spark, sf_dir, target="review_binary"):
    return feat.supervised_xy(model_df(spark, sf_dir), target)


def train_part(df):
    return split.with_split(df).filter(~F.col("is_test")).drop("is_test")


@query("supervised_xy")
def q_supervised_xy(spark, sf_dir):
    return rnd(sup(spark, sf_dir))


@query("class_counts")
def q_class_counts(spark, sf_dir):
    from ..operators.profile import class_counts
    return class_counts(sup(spark, sf_dir), "label")


@query("cluster_features")
def q_cluster_features(spark, sf_dir):
    return rnd(feat.cluster_features(model_df(spark, sf_dir)))


@query("winsorize")
def q_winsorize(spark, sf_dir):
    md = materialize(model_df(spark, sf_dir).select("order_id", *[F.col(c).cast("double").alias(c) for c in NUM]))
    return rnd(feat.winsorize(md, NUM))


@query("standardize")
def q_standardize(spark, sf_dir):
    cf = feat.cluster_features(model_df(spark, sf_dir))
    cols = feat.CLUSTER_FEATURES
    return rnd(prep.StandardScaler(inputCols=cols).fit(cf).transform(cf))


@query("impute_median")
def q_impute_median(spark, sf_dir):
    md = materialize(model_df(spark, sf_dir).select("order_id", *[F.col(c).cast("double").alias(c) for c in NUM]))
    m = prep.MedianImputer(inputCols=NUM).fit(train_part(md))
    return rnd(m.transform(md))


@query("impute_mode")
def q_impute_mode(spark, sf_dir):
    md = materialize(model_df(spark, sf_dir).select("order_id", *CAT))
    return prep.ModeImputer(inputCols=CAT).fit(train_part(md)).transform(md)


@query("minmax_scale")
def q_minmax_scale(spark, sf_dir):
    md = materialize(model_df(spark, sf_dir).select("order_id", *[F.col(c).cast("double").alias(c) for c in NUM]))
    return rnd(prep.MinMaxScaler(inputCols=NUM).fit(train_part(md)).transform(md))


@query("one_hot")
def q_one_hot(spark, sf_dir):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    md = materialize(model_df(spark, sf_dir).select("order_id", *CAT))
    m = Pipeline(stages=prep.one_hot_stages(CAT)).fit(train_part(md))
    t = m.transform(md)
    slots = []
    for c in CAT:  # one scan: a (feature, slot) struct per categorical, exploded
        pos = F.array_position(vector_to_array(F.col(f"{c}__oh")), 1.0)
        slots.append(F.struct(F.lit(c).alias("feature"), F.when(pos > 0, pos - 1).cast("int").alias("slot")))
    return t.select("order_id", F.explode(F.array(*slots)).alias("s")).select("order_id", "s.feature", "s.slot")


@query("variance_filter")
def q_variance_filter(spark, sf_dir):
    x = sup(spark, sf_dir).select(*[F.col(c).cast("double").alias(c) for c in NUM])
    v = prep.population_variances(prep.MinMaxScaler(inputCols=NUM).fit(x).transform(x), NUM)
    return rnd(v.withColumn("kept", F.col("variance") > 1e-4))


@query("train_test_split")
def q_train_test_split(spark, sf_dir):
    return split.with_split(sup(spark, sf_dir)).select("order_id", "is_test")


@query("cv_folds")
def q_cv_folds(spark, sf_dir):
    return split.with_folds(train_part(sup(spark, sf_dir)), 3).select("order_id", "fold")


@query("base_orders_lists")
def q_base_orders_lists(spark, sf_dir):
    """The list columns of the consolidated table."""
    out = orders.base_orders(cat(spark, sf_dir), item_lists=True)
    return out.select("order_id", "product_ids", "sellers_ids")


@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    return split.with_stratified_split(sup(spark, sf_dir)).select("order_id", "is_test")


@query("stratified_folds")
def q_stratified_folds(spark, sf_dir):
    return split.with_stratified_folds(sup(spark, sf_dir), 3).select("order_id", "fold")


@query("sample_n")
def q_sample_n(spark, sf_dir):
    return split.sample_n(model_df(spark, sf_dir), 1000).select("order_id", "review_score")


@query("class_weights")
def q_class_weights(spark, sf_dir):
    return rnd(split.class_weights(train_part(sup(spark, sf_dir)), "label"))


@query("gaussian_nb")
def q_gaussian_nb(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler
    from ..operators.models import GaussianNB
    x = sup(spark, sf_dir).dropna(subset=NUM)
    x = materialize(x.select("order_id", "label", *[F.col(c).cast("double").alias(c) for c in NUM]))
    x = VectorAssembler(inputCols=NUM, outputCol="features").transform(x)
    s = split.with_split(x)
    m = GaussianNB().fit(s.filter(~F.col("is_test")))
    return m.transform(s.filter(F.col("is_test"))).select("order_id", "label", "prediction")


# ---------------------------------------------------------------- metrics on rule predictions
def rule_cls(spark, sf_dir, model=None):
    r = rules.rule_classifications(model_df(spark, sf_dir))
    return r.filter(F.col("model") == model) if model else r


@query("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    return rnd(met.confusion_matrix(rule_cls(spark, sf_dir, "late")))


@query("classification_report")
def q_classification_report(spark, sf_dir):
    return rnd(met.classification_report(rule_cls(spark, sf_dir, "late")))


@query("report_long")
def q_report_long(spark, sf_dir):
    return rnd(met.report_long(met.classification_report(rule_cls(spark, sf_dir, "late"))))


def rule_metric_rows(spark, sf_dir):
    """Metrics of every rule model from one aggregate over all predictions."""
    counts = met.confusion_counts_by(rule_cls(spark, sf_dir), "model")
    rows = [(name, i, *met.metrics_dict(counts[name]).values()) for i, name in enumerate(rules.RULE_CLASSIFIERS)]
    return spark.createDataFrame(rows, "model string, ordinal int, " + met.METRICS_SCHEMA)


@query("classification_metrics")
def q_classification_metrics(spark, sf_dir):
    return rnd(rule_metric_rows(spark, sf_dir).drop("ordinal"))


@query("metric_matrix")
def q_metric_matrix(spark, sf_dir):
    cols = ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted"]
    long = rule_metric_rows(spark, sf_dir).unpivot(["model"], cols, "metric", "value")
    return rnd(reshape.metric_matrix(long, "model", "metric", "value", cols))


@query("best_model")
def q_best_model(spark, sf_dir):
    rows = rule_metric_rows(spark, sf_dir)
    a = reshape.arg_best(rows, "accuracy").select(F.lit("accuracy").alias("criterion"), "model",
                                                  F.col("accuracy").alias("value"))
    b = reshape.arg_best(rows, "recall_0").select(F.lit("recall_0").alias("criterion"), "model",
                                                  F.col("recall_0").alias("value"))
    return rnd(a.unionByName(b))


def rule_reg(spark, sf_dir):
    return rules.rule_regression(model_df(spark, sf_dir))


@query("regression_metrics")
def q_regression_metrics(spark, sf_dir):
    return rnd(met.regression_metrics(rule_reg(spark, sf_dir)))


@query("parity_metrics")
def q_parity_metrics(spark, sf_dir):
    return rnd(met.parity_metrics(rule_reg(spark, sf_dir)))


@query("clip_pred")
def q_clip_pred(spark, sf_dir):
    return rnd(feat.clip_pred(rule_reg(spark, sf_dir)).select("order_id", "prediction", "prediction_clipped"))


@query("residual_bins")
def q_residual_bins(spark, sf_dir):
    return rnd(feat.residual_bins(rule_reg(spark, sf_dir)))


@query("residuals_by_score")
def q_residuals_by_score(spark, sf_dir):
    return rnd(feat.residuals_by_score(rule_reg(spark, sf_dir)))


@query("density_2d")
def q_density_2d(spark, sf_dir):
    r = feat.residual_frame(rule_reg(spark, sf_dir))
    return rnd(feat.hexagons(r, "y_true", "y_pred"))


@query("density_residual")
def q_density_residual(spark, sf_dir):
    r = feat.residual_frame(rule_reg(spark, sf_dir))
    return rnd(feat.hexagons(r, "y_pred", "residual", gridsize=35))


@query("pred_density")
def q_pred_density(spark, sf_dir):
    return rnd(feat.pred_density(rule_reg(spark, sf_dir)))


@query("pred_histogram")
def q_pred_histogram(spark, sf_dir):
    return rnd(feat.pred_histogram(rule_reg(spark, sf_dir)))


@query("stabilize")
def q_stabilize(spark, sf_dir):
    return rnd(feat.stabilize(model_df(spark, sf_dir).select("order_id", *NUM), NUM))


@query("pred_distribution")
def q_pred_distribution(spark, sf_dir):
    return rnd(feat.pred_distribution(rule_reg(spark, sf_dir)))


@query("stars")
def q_stars(spark, sf_dir):
    r = rule_reg(spark, sf_dir)
    return rnd(r.select("order_id", "prediction", _score_bucket("prediction").alias("stars_n"),
                        _stars("prediction").alias("stars")))


# ---------------------------------------------------------------- descriptive
@query("mean_ci")
def q_mean_ci(spark, sf_dir):
    from ..functions import late_flag
    c = cat(spark, sf_dir)
    ro = drivers.reviews_with_delay(c["order_reviews"], c["orders"]).withColumn(
        "delayed", late_flag("delivery_delay_days"))
    return rnd(profile.mean_ci(ro, "review_score", ["delayed"]))


@query("box_stats")
def q_box_stats(spark, sf_dir):
    c = cat(spark, sf_dir)
    rows = drivers.delay_by_score_rows(c["order_reviews"], c["orders"])
    return rnd(profile.box_stats(rows, "delivery_delay_days", ["review_score"]))


@query("feature_defaults")
def q_feature_defaults(spark, sf_dir):
    return rnd(feat.feature_defaults(model_df(spark, sf_dir), NUM, CAT))


@query("short_feature_name")
def q_short_feature_name(spark, sf_dir):
    md = model_df(spark, sf_dir)
    # every feature label of the modelling table (numeric names + one per
    # seen category), from one scan
    labels = F.array(*[F.lit(f"num__{c}") for c in NUM],
                     *[F.concat(F.lit(f"cat__{c}_"), F.col(c).cast("string")) for c in CAT])
    names = md.select(F.explode(labels).alias("feature")).filter(F.col("feature").isNotNull()).distinct()
    return names.select("feature", feat.short_feature_name("feature").alias("feature_short"))


@query("cluster_names")
def q_cluster_names(spark, sf_dir):
    return feat.cluster_names(rules.rule_clusters(model_df(spark, sf_dir))).select("order_id", "cluster",
                                                                                    "cluster_name")


@query("cluster_summary")
def q_cluster_summary(spark, sf_dir):
    return rnd(segments.cluster_summary(rules.rule_clusters(model_df(spark, sf_dir))))


@query("cluster_ranking")
def q_cluster_ranking(spark, sf_dir):
    return rnd(segments.cluster_ranking(rules.rule_clusters(model_df(spark, sf_dir))))


# ================================================================ batch 3: fitted models (rows-only checks)


def cls_frame(spark, sf_dir):
    """Classification input: complete rows only (as the reference), then X/y;
    materialised once because training and scoring both read it."""
    return materialize(feat.supervised_xy(model_df(spark, sf_dir).dropna(how="any"), "review_binary"))


def reg_frame(spark, sf_dir):
    return materialize(feat.supervised_xy(model_df(spark, sf_dir), "review_score", target_type="double"))


def _fit_predict(spark, sf_dir, name, **params):
    x = cls_frame(spark, sf_dir)
    tr, te = split.train_test_split(x)
    m = mdl.train_classifier(tr, name, NUM, CAT, **params)
    return mdl.predict(m, te, keep=["order_id", "label"])


@query("preprocess_vector")
def q_preprocess_vector(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    x = cls_frame(spark, sf_dir)
    tr, _ = split.train_test_split(x)
    m = prep.fit_preprocessors(tr, NUM, CAT)[-1]
    return m.transform(x).select("order_id", "label", F.transform(vector_to_array("features"),
                                                                  lambda v: F.round(v, 6)).alias("features"))


@query("naive_bayes")
def q_naive_bayes(spark, sf_dir):
    p = _fit_predict(spark, sf_dir, "naive_bayes")
    return p.withColumn("probability", F.transform("probability", lambda v: F.round(v, 6)))


@query("logistic")
def q_logistic(spark, sf_dir):
    return _fit_predict(spark, sf_dir, "logistic")


@query("linear_svm")
def q_linear_svm(spark, sf_dir):
    return _fit_predict(spark, sf_dir, "linear_svm")


@query("random_forest")
def q_random_forest(spark, sf_dir):
    return _fit_predict(spark, sf_dir, "random_forest", n_estimators=200)


@query("gbt")
def q_gbt(spark, sf_dir):
    # the reference's boosted-tree defaults: 300 rounds, rate 0.1, depth 6, row / column sample 0.8
    return _fit_predict(spark, sf_dir, "gbt", n_estimators=300, learning_rate=0.1, max_depth=6, subsample=0.8,
                        colsample_bytree=0.8)


@query("cross_validate")
def q_cross_validate(spark, sf_dir):
    tr, _ = split.stratified_split(cls_frame(spark, sf_dir))
    folds = mdl.folded(tr, NUM, CAT)
    return segments.union_all([mdl.cross_validate(tr, n, NUM, CAT, folds=folds) for n in
                               ("naive_bayes", "logistic", "random_forest", "linear_svm")])


@query("random_search")
def q_random_search(spark, sf_dir):
    tr, te = split.stratified_split(cls_frame(spark, sf_dir))
    return mdl.random_search(tr, "random_forest", NUM, CAT, mdl.RF_GRID, n_iter=10)[1]


@query("batch_score_champions")
def q_batch_score_champions(spark, sf_dir):
    """The classifiers with the best accuracy and the best recall of class 0 on held-out orders, and the better
    regression, stored, loaded and applied to every order."""
    import os
    import uuid

    from ..session import scratch_path
    from ..sources import sinks
    from .jobs import score_champions
    tr, te = split.stratified_split(cls_frame(spark, sf_dir))
    pre = prep.fit_preprocessors(tr, NUM, CAT)[-1]
    fitted = {n: mdl.train_classifier(tr, n, NUM, CAT, pre=pre) for n in ("naive_bayes", "logistic", "linear_svm")}
    found = {n: met.metrics_dict(met.confusion_counts(mdl.predict(m, te, keep=["label"]))) for n, m in fitted.items()}
    place = scratch_path(spark, f"models/champions-{uuid.uuid4().hex}")
    for name, metric in (("best_accuracy", "accuracy"), ("best_recall_0", "recall_0")):
        sinks.save_model(fitted[max(found, key=lambda n: (found[n][metric], n))], os.path.join(place, name))  # noqa: B023
    rt, rh = split.train_test_split(reg_frame(spark, sf_dir))
    regs = {n: mdl.train_regression(rt, NUM, CAT, ridge=n == "ridge_regression") for n in ("linear_regression", "ridge_regression")}
    rmse = {n: met.regression_metrics(m.transform(rh).select("label", "prediction")).first()["rmse"] for n, m in regs.items()}
    best = min(rmse, key=lambda n: (rmse[n], n))
    sinks.save_model(regs[best], os.path.join(place, best))
    return score_champions(place, best, model_df(spark, sf_dir))


@query("random_search_gbt")
def q_random_search_gbt(spark, sf_dir):
    tr, _ = split.stratified_split(cls_frame(spark, sf_dir))
    return mdl.random_search(tr, "gbt", NUM, CAT, mdl.GBT_GRID, n_iter=12)[1]


@query("holdout_metrics")
def q_holdout_metrics(spark, sf_dir):
    x = cls_frame(spark, sf_dir)
    tr, te = split.stratified_split(x)
    rows, pre = [], prep.fit_preprocessors(tr, NUM, CAT)[-1]
    for i, n in enumerate(("naive_bayes", "logistic", "linear_svm", "random_forest")):
        p = mdl.predict(mdl.train_classifier(tr, n, NUM, CAT, pre=pre), te, keep=["label"])
        rows.append(met.classification_metrics(p).select(F.lit(n).alias("model"), F.lit(i).alias("ordinal"), "*"))
    return segments.union_all(rows)


@query("batch_score")
def q_batch_score(spark, sf_dir):
    """Fit on the training split, persist, reload, score every order."""
    import os
    from ..session import scratch_path
    from ..sources import sinks
    x = cls_frame(spark, sf_dir)
    tr, _ = split.train_test_split(x)
    m = mdl.train_classifier(tr, "logistic", NUM, CAT)
    path = scratch_path(spark, f"models/logistic-{os.getpid()}")
    sinks.save_model(m, path)
    return mdl.predict(sinks.load_model(path), model_df(spark, sf_dir), keep=["order_id"])


def _fit_reg(spark, sf_dir, ridge):
    from pyspark import StorageLevel
    x = reg_frame(spark, sf_dir)
    tr, te = split.train_test_split(x)
    tr = tr.persist(StorageLevel.MEMORY_AND_DISK)  # every estimator stage scans it
    m = mdl.train_regression(tr, NUM, CAT, ridge=ridge)
    tr.unpersist()
    return m.transform(te).select("order_id", "label", "prediction")


@query("linear_regression")
def q_linear_regression(spark, sf_dir):
    return _fit_reg(spark, sf_dir, False)


@query("ridge_regression")
def q_ridge_regression(spark, sf_dir):
    return _fit_reg(spark, sf_dir, True)


def _importances(spark, sf_dir):
    x = cls_frame(spark, sf_dir)
    tr, _ = split.train_test_split(x)
    m = mdl.train_classifier(tr, "random_forest", NUM, CAT, n_estimators=200)
    imp = mdl.feature_importance(m, m.transform(tr.limit(1)))
    return imp.withColumn("feature_short", feat.short_feature_name("feature"))


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    return drivers.top_k(_importances(spark, sf_dir), [F.desc("importance"), F.asc("feature")], 10)


@query("importance_rest")
def q_importance_rest(spark, sf_dir):
    return reshape.rest_after_top(_importances(spark, sf_dir), [F.desc("importance"), F.asc("feature")], 10)


def _kmeans(spark, sf_dir):
    md = model_df(spark, sf_dir)
    cf = feat.cluster_features(md)
    model, cost = segments.kmeans_fit(cf, k=3, n_init=10, seed=42)
    mapping = segments.spend_order(model, cf)
    return md, cf, model, cost, mapping


@query("kmeans_fit")
def q_kmeans_fit(spark, sf_dir):
    md, cf, model, cost, mapping = _kmeans(spark, sf_dir)
    centers = model.stages[-1].clusterCenters()
    rows = [(mapping[i], [float(v) for v in c], float(cost)) for i, c in enumerate(centers)]
    return spark.createDataFrame(rows, "cluster int, center array<double>, training_cost double")


@query("assign_clusters")
def q_assign_clusters(spark, sf_dir):
    md, cf, model, cost, mapping = _kmeans(spark, sf_dir)
    labels = segments.assign_clusters(model, cf, mapping=mapping)
    return segments.write_back(md.select("order_id", "review_score"), labels)


@query("kmeans_cluster_summary")
def q_kmeans_cluster_summary(spark, sf_dir):
    md, cf, model, cost, mapping = _kmeans(spark, sf_dir)
    lab = segments.write_back(md, segments.assign_clusters(model, cf, mapping=mapping))
    return segments.cluster_summary(lab)


@query("elbow")
def q_elbow(spark, sf_dir):
    return segments.elbow(feat.cluster_features(model_df(spark, sf_dir)), max_k=10)


@query("mean_ci_bootstrap")
def q_mean_ci_bootstrap(spark, sf_dir):
    from ..functions import late_flag
    c = cat(spark, sf_dir)
    ro = drivers.reviews_with_delay(c["order_reviews"], c["orders"]).withColumn(
        "delayed", late_flag("delivery_delay_days"))
    return rnd(profile.mean_ci_bootstrap(ro, "review_score", ["delayed"], n_boot=1000))


@query("mean_ci_bags")
def q_mean_ci_bags(spark, sf_dir):
    md = model_df(spark, sf_dir).select("order_id", "payment_type", "payment_value")
    return rnd(profile.mean_ci_bags(md, "payment_value", ["payment_type"], "order_id"))


# ---------------------------------------------------------------- what fitted results must satisfy


@query("kmeans_check")
def q_kmeans_check(spark, sf_dir):
    """Rows away from their nearest centre, centres away from their rows' mean, and the inertia added up."""
    md, cf, model, cost, mapping = _kmeans(spark, sf_dir)
    scored = model.transform(cf)
    cols, centres = model.stages[-1].getOrDefault("inputCols"), model.stages[-1].clusterCenters()

    def away(c):
        return sum((F.pow(F.col(x) - float(v), F.lit(2.0)) for x, v in zip(cols, c)), F.lit(0.0))
    far = F.array(*map(away, centres))
    own = F.get(far, F.col("_cluster"))
    total = scored.select((own > F.array_min(far) + 1e-9).cast("long").alias("m"), own.alias("d")).agg(F.sum("m"), F.sum("d"), F.count("d")).first()
    means = scored.groupBy("_cluster").agg(*(F.avg(c) for c in cols)).collect()
    gap = max(abs(m - v) for r in means for m, v in zip(r[1:], centres[r["_cluster"]]))
    return spark.createDataFrame([(total[2], len(means), total[0], bool(gap < 0.011), bool(abs(total[1] - cost) < 1e-6 * cost))],
                                 "n_rows long, n_clusters int, n_misplaced long, centres_are_means boolean, inertia_adds_up boolean")


@query("regression_check")
def q_regression_check(spark, sf_dir):
    """Whether the gradient of (penalised) least squares is zero over the training rows of both fits."""
    from pyspark.ml.functions import vector_to_array
    tr, _ = split.train_test_split(reg_frame(spark, sf_dir))
    rows = []
    for name, alpha in (("linear_regression", 0.0), ("ridge_regression", 0.001)):
        m = mdl.train_regression(tr, NUM, CAT, ridge=alpha > 0)
        r = (F.col("label") - F.col("prediction")).alias("r")
        scored = m.transform(tr).select(r, vector_to_array("features").alias("x"))
        n, mean = scored.agg(F.count("r"), F.avg("r")).first()
        grad = scored.select("r", F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.avg(F.col("r") * F.col("v")).alias("g")).collect()
        w = m.stages[-1].coefficients.toArray()
        rows.append((name, n, abs(mean) < 1e-6 and all(abs(g["g"] - alpha * w[g["j"]]) < 1e-6 for g in grad)))
    return spark.createDataFrame(rows, "model string, n_train long, gradient_is_zero boolean")


@query("classifier_check")
def q_classifier_check(spark, sf_dir):
    """Held-out rows that each classifier scored, and whether its probabilities are ones that fit its class."""
    tr, te = split.train_test_split(cls_frame(spark, sf_dir))
    out, pre = [], prep.fit_preprocessors(tr, NUM, CAT)[-1]
    for name, params in (("naive_bayes", {}), ("logistic", {}), ("random_forest", {"n_estimators": 40}), ("gbt", {"n_estimators": 40})):
        p = mdl.predict(mdl.train_classifier(tr, name, NUM, CAT, pre=pre, **params), te, keep=["label"])
        one = F.col("probability")[1]
        fits = (F.abs(F.col("probability")[0] + one - 1) < 1e-9) & one.between(0, 1) & ((F.col("prediction") == 1) == (one > F.col("probability")[0]))
        out.append(p.agg(F.count(F.lit(1)).alias("n_test"), F.sum(F.col("label").cast("long")).alias("n_positive"), F.every(fits).alias("probabilities_fit"))
                   .select(F.lit(name).alias("model"), "*"))
    return segments.union_all(out)


@query("svm_certificate")
def q_svm_certificate(spark, sf_dir):
    """Whether the linear SVM's loss, summed anew over the training rows, is what the fit says, and its dual bound within
    a thousandth of it."""
    tr, _ = split.train_test_split(cls_frame(spark, sf_dir))
    m = mdl.train_classifier(tr, "linear_svm", NUM, CAT)
    fitted = m.stages[-1]
    w = [*fitted.getOrDefault(fitted.weights), fitted.getOrDefault(fitted.intercept)]
    p, bound = fitted.getOrDefault(fitted.objective), fitted.getOrDefault(fitted.bound)
    y = F.when(F.col("label") == 1, 1.0).otherwise(-1.0)
    hinge = F.col("weight") * F.greatest(F.lit(0.0), 1 - y * F.col("svm_margin"))
    objective = F.lit(sum(v * v for v in w) / 2) + F.sum(hinge)
    return m.transform(split.with_class_weights(tr, "label")).agg(
        F.count(F.lit(1)).alias("n_train"), (F.abs(objective - p) < 1e-6 * p).alias("objective_is_loss"),
        ((F.lit(bound) <= objective) & (objective - bound <= 1.0001e-3 * objective)).alias("gap_is_small"))


@query("importance_check")
def q_importance_check(spark, sf_dir):
    """Features that have an importance, and their sum."""
    return _importances(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_features"), F.round(F.sum("importance"), 6).alias("total"))
