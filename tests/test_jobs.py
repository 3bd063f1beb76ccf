"""End-to-end jobs on the smallest derived data."""
import json
import os

from orderlens.plans import jobs
from tests.conftest import SF_SMALL


def test_jobs_end_to_end(spark, tmp_dir):
    path = jobs.build_modelling_table(spark, SF_SMALL, tmp_dir, fmt="derived", csv_copy=True)
    assert spark.read.parquet(path).count() > 0
    jobs.eda_report(spark, SF_SMALL, os.path.join(tmp_dir, "eda"), fmt="derived")
    assert os.path.isdir(os.path.join(tmp_dir, "eda", "worst_categories"))
    res = jobs.classification_job(spark, path, os.path.join(tmp_dir, "cls"), with_search=False)
    assert set(res["holdout"]) == {"naive_bayes", "logistic", "linear_svm", "random_forest", "gbt"}
    assert os.path.isdir(os.path.join(tmp_dir, "cls", "models", "best_accuracy"))
    jobs.clustering_job(spark, path, os.path.join(tmp_dir, "clu"), n_init=2)
    lab = spark.read.parquet(os.path.join(tmp_dir, "clu", "model_dataset_clusters"))
    assert lab.count() == spark.read.parquet(path).count()
    reg = jobs.regression_job(spark, path, os.path.join(tmp_dir, "reg"))
    assert reg["best_by_rmse"] in ("linear_regression", "ridge_regression")
    doc = spark.read.text(os.path.join(tmp_dir, "reg", "metrics", "regression_results")).first()[0]
    assert "rmse" in json.loads(doc)["linear_regression"]
    scored = jobs.score_batch(os.path.join(tmp_dir, "reg", "models", "linear_regression"), spark.read.parquet(path))
    assert {"prediction_clipped", "stars"} <= set(scored.columns)
    cls_scored = jobs.score_batch(os.path.join(tmp_dir, "cls", "models", "best_accuracy"), spark.read.parquet(path))
    assert "prediction_label" in cls_scored.columns
    assert {r.prediction_label for r in cls_scored.select("prediction_label").distinct().collect()} <= \
        {"Bom (1)", "Ruim (0)"}
