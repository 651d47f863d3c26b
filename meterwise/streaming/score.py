"""Scoring of arriving feature files with Structured Streaming (L10 on a
stream source).

The reference scores test files in batch.  A fitted ``PipelineModel`` is
stateless, so the same model scores a stream: new Parquet files in
``source_dir`` are read with a fixed schema, scored, and appended to
``sink_dir``; the query's progress lives in a checkpoint under the shared
checkpoint folder, so a restarted or failed job resumes where it stopped.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_path


def score_stream(spark: SparkSession, model: PipelineModel, source_dir: str, schema: T.StructType,
                 sink_dir: str, id_col: str = "client_id", checkpoint: str | None = None,
                 available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the scoring query; returns the ``StreamingQuery``.

    Output rows: (id, target = P(class 1)).  With ``available_now`` the
    query processes every file present and stops (batch-like runs).
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(source_dir)
    scored = model.transform(rows).select(id_col, vector_to_array(F.col("probability"))[1].alias("target"))
    writer = (scored.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint or shared_path(spark, "streams", "score")))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start(sink_dir)
