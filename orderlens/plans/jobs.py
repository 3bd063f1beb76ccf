"""End-to-end jobs: build the modelling table, EDA, classification,
clustering, regression, batch scoring.

Each job is a sequence of lazy plans with few actions; whole tables are
written by executors (parquet), only bounded results (metrics, top-k,
per-class and per-cluster tables, model parameters) are coalesced or
reach the driver.

    python -m orderlens.plans.jobs build  <source_dir> <out_dir> [csv|parquet|derived]
    python -m orderlens.plans.jobs eda    <source_dir> <out_dir> [csv|parquet|derived]
    python -m orderlens.plans.jobs classify|cluster|regress <table_path> <out_dir>
    python -m orderlens.plans.jobs score  <model_path> <table_path> <out_dir>
    python -m orderlens.plans.jobs stream <model_path> <incoming_dir> <out_dir>
"""

from __future__ import annotations

import os
import sys
import warnings

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drivers, features, metrics, models, orders, profile, reshape, segments, split
from ..sources import catalog, sinks
from ..sources.derived import derived_catalog

NUM, CAT = features.NUMERIC_FEATURES, features.CATEGORICAL_FEATURES


def load(spark: SparkSession, source: str, fmt: str = "csv") -> dict[str, DataFrame]:
    return derived_catalog(spark, source) if fmt == "derived" else catalog.load_catalog(spark, source, fmt)


# ---------------------------------------------------------------- A. modelling table
def build_modelling_table(spark: SparkSession, source: str, out_dir: str, fmt: str = "csv",
                          drop_canceled: bool = True, csv_copy: bool = False) -> str:
    data = load(spark, source, fmt)
    md = orders.model_dataset(data, drop_canceled, item_lists=True)
    missing = profile.missing_columns(md, NUM + CAT)
    if missing:
        warnings.warn(f"expected features absent: {missing}")
    path = os.path.join(out_dir, "model_dataset")
    sinks.write_table(md, path)
    if csv_copy:
        sinks.export_csv(spark.read.parquet(path), os.path.join(out_dir, "model_dataset_csv"))
    return path


# ---------------------------------------------------------------- C. EDA
def eda_report(spark: SparkSession, source: str, out_dir: str, fmt: str = "csv", top_n: int = 10) -> None:
    data = load(spark, source, fmt)
    r, o = data["order_reviews"], data["orders"]
    out = {
        "table_shapes": profile.table_shapes(data),
        "missing_profile": profile.missing_profile_catalog(data),
        "score_distribution": profile.score_distribution(r),
        "orders_per_month": profile.orders_per_month(o),
        "period_covered": profile.period_covered(o),
        "delay_by_score": profile.describe(drivers.delay_by_score_rows(r, o), "delivery_delay_days", ["review_score"]),
        "corr_delay_score": drivers.corr_delay_score(r, o),
        "review_by_late_flag": drivers.review_by_late_flag(r, o),
        "worst_categories": drivers.worst_categories(r, data["order_items"], data["products"],
                                                                 top_n=top_n),
        "worst_states": drivers.worst_states(r, o, data["customers"], top_n=top_n),
    }
    for name, df in out.items():  # all bounded results
        sinks.export_csv(df, os.path.join(out_dir, name), single_file=True)


# ---------------------------------------------------------------- B. classification
def classification_job(spark: SparkSession, table_path: str, out_dir: str, with_search: bool = True) -> dict:
    md = sinks.read_table(spark, table_path).dropna(how="any")
    xy = features.supervised_xy(md).persist(StorageLevel.MEMORY_AND_DISK)
    tr, te = split.stratified_split(xy)
    folds = models.folded(tr, NUM, CAT)
    cv = segments.union_all([models.cross_validate(tr, n, NUM, CAT, folds=folds)
                             for n in ("naive_bayes", "logistic", "random_forest", "linear_svm")])
    sinks.write_metrics(cv, os.path.join(out_dir, "metrics", "cv_results"))
    fitted = {n: models.train_classifier(tr, n, NUM, CAT) for n in ("naive_bayes", "logistic", "linear_svm")}
    if with_search:
        fitted["random_forest"], res = models.random_search(tr, "random_forest", NUM, CAT, models.RF_GRID, 10)
        sinks.write_metrics(res, os.path.join(out_dir, "metrics", "search_random_forest"))
        fitted["gbt"], res = models.random_search(tr, "gbt", NUM, CAT, models.GBT_GRID, 12)
        sinks.write_metrics(res, os.path.join(out_dir, "metrics", "search_gbt"))
    else:
        fitted["random_forest"] = models.train_classifier(tr, "random_forest", NUM, CAT)
        fitted["gbt"] = models.train_classifier(tr, "gbt", NUM, CAT, n_estimators=300, max_depth=6, subsample=0.8)
    rows, summary = [], {}
    for i, (name, m) in enumerate(fitted.items()):
        pred = models.predict(m, te, keep=["order_id", "label"]).persist(StorageLevel.MEMORY_AND_DISK)
        counts = metrics.confusion_counts(pred)
        summary[name] = metrics.metrics_dict(counts)
        rows.append((name, i, *summary[name].values()))
        sinks.export_csv(metrics.confusion_matrix(pred), os.path.join(out_dir, "metrics", f"confusion_{name}"), True)
        sinks.export_csv(metrics.classification_report(pred), os.path.join(out_dir, "metrics", f"class_report_{name}"),
                         True)
        pred.unpersist()
    mrows = spark.createDataFrame(rows, "model string, ordinal int, " + metrics.METRICS_SCHEMA)
    sinks.write_metrics(mrows, os.path.join(out_dir, "metrics", "holdout_results"))
    best_acc = reshape.arg_best(mrows, "accuracy").first()["model"]
    best_rec = reshape.arg_best(mrows, "recall_0").first()["model"]
    sinks.save_model(fitted[best_acc], os.path.join(out_dir, "models", "best_accuracy"))
    sinks.save_model(fitted[best_rec], os.path.join(out_dir, "models", "best_recall_0"))
    sinks.write_json_dict(spark, {"best_model": best_acc, "accuracy": summary[best_acc]["accuracy"]},
                          os.path.join(out_dir, "models", "best_accuracy.json"))
    sinks.write_json_dict(spark, {"best_model_recall": best_rec, "recall_class_0": summary[best_rec]["recall_0"]},
                          os.path.join(out_dir, "models", "best_recall_0.json"))
    for name in (best_acc,):
        m = fitted[name]
        imp = models.feature_importance(m, m.transform(tr.limit(1))).withColumn(
            "feature_short", features.short_feature_name("feature"))
        order = [F.desc("importance"), F.asc("feature")]
        sinks.export_csv(drivers.top_k(imp, order, 10), os.path.join(out_dir, "metrics", f"importance_{name}"), True)
        sinks.export_csv(reshape.rest_after_top(imp, order, 10),
                         os.path.join(out_dir, "metrics", f"importance_{name}_rest"), True)
    xy.unpersist()
    return {"best_accuracy": best_acc, "best_recall_0": best_rec, "holdout": summary}


# ---------------------------------------------------------------- D. clustering
def clustering_job(spark: SparkSession, table_path: str, out_dir: str, k: int = 3, n_init: int = 10) -> None:
    md = sinks.read_table(spark, table_path)
    cf = features.cluster_features(md).persist(StorageLevel.MEMORY_AND_DISK)
    model, _ = segments.kmeans_fit(cf, k=k, n_init=n_init)
    mapping = segments.spend_order(model, cf)
    labelled = segments.write_back(md, segments.assign_clusters(model, cf, mapping=mapping))
    sinks.save_model(model, os.path.join(out_dir, "models", "kmeans"))
    path = os.path.join(out_dir, "model_dataset_clusters")
    sinks.write_table(labelled, path)
    lab = spark.read.parquet(path)
    sinks.export_csv(segments.cluster_summary(lab), os.path.join(out_dir, "metrics", "cluster_summary"), True)
    sinks.export_csv(features.cluster_names(segments.cluster_ranking(lab)),
                     os.path.join(out_dir, "metrics", "cluster_ranking"), True)
    cf.unpersist()


# ---------------------------------------------------------------- E. regression
def regression_job(spark: SparkSession, table_path: str, out_dir: str) -> dict:
    md = sinks.read_table(spark, table_path)
    xy = features.supervised_xy(md, "review_score", target_type="double").persist(StorageLevel.MEMORY_AND_DISK)
    tr, te = split.train_test_split(xy)
    results = {}
    for name, ridge in (("linear_regression", False), ("ridge_regression", True)):
        m = models.train_regression(tr, NUM, CAT, ridge=ridge)
        pred = m.transform(te).select("order_id", "label", "prediction").persist(StorageLevel.MEMORY_AND_DISK)
        r = metrics.regression_metrics(pred).first().asDict()
        r["parity"] = metrics.parity_metrics(pred).first().asDict()
        results[name] = r
        base = os.path.join(out_dir, "metrics", name)
        sinks.export_csv(features.residual_bins(pred), base + "_residual_bins", True)
        sinks.export_csv(features.residuals_by_score(pred), base + "_residuals_by_score", True)
        sinks.export_csv(features.pred_distribution(pred), base + "_pred_distribution", True)
        sinks.export_csv(features.pred_density(pred), base + "_pred_density", True)
        sinks.export_csv(features.pred_histogram(pred), base + "_pred_histogram", True)
        resid = features.residual_frame(pred)
        sinks.export_csv(features.hexagons(resid, "y_true", "y_pred"), base + "_hexagons", True)
        sinks.export_csv(features.hexagons(resid, "y_pred", "residual", 35), base + "_residual_hexagons", True)
        sinks.save_model(m, os.path.join(out_dir, "models", name))
        pred.unpersist()
    best = min(results, key=lambda n: (results[n]["rmse"], n))
    results["best_by_rmse"] = best
    sinks.write_json_dict(spark, results, os.path.join(out_dir, "metrics", "regression_results"))
    xy.unpersist()
    return results


# ---------------------------------------------------------------- batch scoring
def score_batch(model_path: str, candidates: DataFrame, key: str = "order_id") -> DataFrame:
    """Score a DataFrame of candidate orders with a stored model; regression
    models also get the clamped value and stars."""
    from ..functions import class_label, score_bucket, stars
    m = sinks.load_model(model_path)
    out = models.predict(m, candidates, keep=[key])
    if "probability" not in out.columns and not _is_classifier(m):
        out = out.withColumn("prediction_clipped", features.clip("prediction", 1.0, 5.0)) \
                 .withColumn("stars_n", score_bucket("prediction")).withColumn("stars", stars("prediction"))
    else:
        out = out.withColumn("prediction_label", class_label("prediction"))
    return out


CHAMPIONS = {"best_accuracy": "best_accuracy", "best_recall_0": "best_recall_0"}


def score_champions(models_dir: str, regression: str, candidates: DataFrame, key: str = "order_id") -> DataFrame:
    """Candidates scored by the chosen models: the class (and its label) of the most accurate classifier and of the
    one with the best recall of class 0, and the clamped score and stars of the regression model named. The models
    read the candidates one after the other, row by row: nothing is joined or exchanged."""
    from ..functions import class_label, score_bucket, stars
    out = candidates
    for name in CHAMPIONS:
        m = sinks.load_model(os.path.join(models_dir, name))
        scored = m.transform(out)
        out = scored.select(*out.columns, F.col("prediction").alias(name), class_label("prediction").alias(f"{name}_label"))
    m = sinks.load_model(os.path.join(models_dir, regression))
    scored = m.transform(out).select(key, *(c for n in CHAMPIONS for c in (n, f"{n}_label")), "prediction")
    return scored.select(key, *(c for n in CHAMPIONS for c in (n, f"{n}_label")), features.clip("prediction", 1.0, 5.0).alias("score"),
                         score_bucket("prediction").alias("stars_n"), stars("prediction").alias("stars"))


def _is_classifier(model) -> bool:
    last = model.stages[-1].__class__.__name__
    return "Classif" in last or last in ("LinearSVMModel", "GaussianNBModel", "LogisticRegressionModel", "TreeModel")


def main(argv: list[str]) -> None:
    from ..session import get_spark
    spark = get_spark()
    job, a, b = argv[1], argv[2], argv[3]
    fmt = argv[4] if len(argv) > 4 and job in ("build", "eda") else "csv"
    if job == "build":
        print(build_modelling_table(spark, a, b, fmt))
    elif job == "eda":
        eda_report(spark, a, b, fmt)
    elif job == "classify":
        print(classification_job(spark, a, b))
    elif job == "cluster":
        clustering_job(spark, a, b)
    elif job == "regress":
        print(regression_job(spark, a, b))
    elif job == "score":
        sinks.write_table(score_batch(a, sinks.read_table(spark, b)), argv[4])
    elif job == "stream":
        from ..streaming.scoring import start_scoring
        incoming = sinks.read_table(spark, b).schema  # the files' own schema
        start_scoring(spark, b, incoming, a, argv[4], available_now=True).awaitTermination()
    else:
        raise SystemExit(__doc__)


if __name__ == "__main__":
    main(sys.argv)
