"""Scoring a stream (M7 on Structured Streaming).

Nearest-code scoring is stateless and map-only, so the same operator runs on
a ``readStream`` source: every micro-batch is scored against the broadcast
codebook, and the running confusion matrix is a streaming aggregation
(``complete`` mode state of classes x classes counts).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskvq.operators.codebook import as_codebook
from riskvq.operators.evaluate import confusion
from riskvq.operators.nearest import predict


def read_labeled_stream(spark: SparkSession, path: str, schema: T.StructType, id_col: str, label_col: str,
                        features_col: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet file stream projected into ``(id, label, features)``.

    ``path`` is a folder that receives files, or one file (then its folder is
    watched for files of that name)."""
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if os.path.isfile(path):
        reader = reader.option("pathGlobFilter", os.path.basename(path))
        path = os.path.dirname(path)
    raw = reader.load(path)
    return raw.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"),
                      F.col(features_col).cast("array<double>").alias("features"))


def score_stream(stream: DataFrame, codebook, method: str = "auto") -> DataFrame:
    """Streaming predictions ``(id, label, pred)``; no state."""
    return predict(stream, as_codebook(codebook), method=method).select("id", "label", "pred")


def start_scoring(stream: DataFrame, codebook, sink_path: str, checkpoint: str, method: str = "auto",
                  trigger_available_now: bool = True) -> StreamingQuery:
    """Write streaming predictions to Parquet (exactly-once file sink)."""
    writer = (score_stream(stream, codebook, method).writeStream.format("parquet")
              .option("path", sink_path).option("checkpointLocation", checkpoint).outputMode("append"))
    if trigger_available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_confusion(stream: DataFrame, codebook, query_name: str, checkpoint: str,
                    method: str = "auto") -> StreamingQuery:
    """Running confusion matrix in a memory table ``query_name``."""
    counts = confusion(score_stream(stream, codebook, method))
    return (counts.writeStream.format("memory").queryName(query_name).outputMode("complete")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
