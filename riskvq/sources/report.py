"""Run report sink (IO2): metrics and codebooks as ``;``-separated text and
as Parquet.  Both are distributed writes; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def codebook_text(cb_df: DataFrame) -> DataFrame:
    """Codebook rows as ``w1;w2;...;"label"`` text lines, keyed by stage."""
    cols = [c for c in ("stage_idx", "stage") if c in cb_df.columns]
    line = F.concat(F.array_join(F.transform("w", lambda x: x.cast("string")), ";"), F.lit(';"'),
                    F.col("code_label").cast("string"), F.lit('"'))
    return cb_df.select(*cols, "code_id", line.alias("line"))


def read_run_report(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The ``(metric, value)`` rows of a report."""
    base = f"{path.rstrip('/')}/metrics"
    if fmt == "parquet":
        return spark.read.parquet(base)
    return spark.read.schema("metric string, value string").option("sep", ";").option("header", "true").csv(base)


def write_run_report(metrics: DataFrame, codebooks: DataFrame | None, path: str, mode: str = "overwrite",
                     fmt: str = "csv") -> None:
    """Write ``metrics`` (``metric, value``) and stage codebooks under ``path``.

    ``fmt="csv"`` writes ``;``-separated metrics and codebook text lines
    ``stage_idx;stage;code_id;w1;...;wn;"label"``; ``"parquet"`` keeps types.
    """
    base = path.rstrip("/")
    if fmt == "parquet":
        metrics.write.mode(mode).parquet(f"{base}/metrics")
        if codebooks is not None:
            codebooks.write.mode(mode).parquet(f"{base}/codebooks")
        return
    metrics.write.mode(mode).option("sep", ";").option("header", "true").csv(f"{base}/metrics")
    if codebooks is not None:
        text = codebook_text(codebooks)
        keys = [c for c in text.columns if c != "line"]
        line = F.concat_ws(";", *[F.col(c).cast("string") for c in keys], F.col("line"))
        text.select(line.alias("value")).write.mode(mode).text(f"{base}/codebooks")
