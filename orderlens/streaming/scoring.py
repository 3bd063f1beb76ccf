"""Continuous scoring of arriving modelling-table rows.

The reference scores user-entered rows one at a time in a dashboard; the
Spark form is a stream: new rows (same schema as the modelling table)
land as parquet files, each micro-batch is transformed by a stored
``PipelineModel`` (a narrow, stateless projection — no shuffle, no state
store), and predictions are appended to a parquet sink. Exactly-once
file output comes from the checkpoint, which lives under the shared
``spark.checkpoint.dir`` so a restarted driver or lost executor resumes.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import features, models
from ..session import checkpoint_dir
from ..sources import sinks


def scored_stream(spark: SparkSession, source_dir: str, schema, model_path: str, key: str = "order_id",
                  max_files_per_trigger: int = 64) -> DataFrame:
    """The streaming DataFrame of predictions (not started)."""
    rows = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(source_dir))
    model = sinks.load_model(model_path)
    out = models.predict(model, rows, keep=[key])
    if "probability" not in out.columns:
        out = out.withColumn("prediction_clipped", features.clip("prediction", 1.0, 5.0))
    return out


def start_scoring(spark: SparkSession, source_dir: str, schema, model_path: str, sink_dir: str,
                  name: str = "order_scores", key: str = "order_id", trigger_seconds: int | None = None,
                  available_now: bool = False) -> StreamingQuery:
    """Start the scoring stream into a parquet sink (append mode)."""
    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)
    w = (scored_stream(spark, source_dir, schema, model_path, key).writeStream
         .format("parquet").option("path", sink_dir).option("checkpointLocation", ckpt).outputMode("append"))
    if available_now:
        w = w.trigger(availableNow=True)
    elif trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
