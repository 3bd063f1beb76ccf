"""The scoring stream reproduces batch predictions."""
import os

from orderlens.operators import features, models, orders, split
from orderlens.sources import sinks
from orderlens.sources.derived import derived_catalog
from orderlens.streaming import scoring
from tests.conftest import SF_SMALL


def test_stream_scores_equal_batch(spark, tmp_dir):
    md = orders.model_dataset(derived_catalog(spark, SF_SMALL))
    xy = features.supervised_xy(md.dropna(how="any"))
    tr, _ = split.train_test_split(xy)
    m = models.train_classifier(tr, "logistic", features.NUMERIC_FEATURES, features.CATEGORICAL_FEATURES)
    mp = os.path.join(tmp_dir, "model")
    sinks.save_model(m, mp)
    src = os.path.join(tmp_dir, "incoming")
    md.repartition(3).write.parquet(src)
    sink = os.path.join(tmp_dir, "scores")
    q = scoring.start_scoring(spark, src, md.schema, mp, sink, name=f"t{os.getpid()}", available_now=True)
    q.awaitTermination(300)
    got = {r.order_id: r.prediction for r in spark.read.parquet(sink).collect()}
    want = {r.order_id: r.prediction for r in models.predict(m, md, keep=["order_id"]).collect()}
    assert got == want and len(got) == md.count()
