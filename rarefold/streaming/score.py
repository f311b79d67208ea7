"""Scoring a feed (C8): the batch scorer applied to a stream of arriving files.

Scoring is stateless and row-wise, so no watermark or state store is needed;
``availableNow`` processes what has arrived and stops; the checkpoint folder
makes restarts exactly-once for the file sink.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from rarefold.operators.model import score_new_data


def score_stream(spark: SparkSession, clf, prep, source_dir: str, schema: StructType, sink_dir: str, checkpoint_dir: str, threshold: float = 0.5, max_files_per_trigger: int | None = None):
    r = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    src = r.load(source_dir)
    scored = score_new_data(clf, prep, src, threshold)
    q = (
        scored.writeStream.format("parquet")
        .option("path", sink_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(sink_dir)
