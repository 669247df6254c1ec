"""Training that goes on where a lost driver left off (M3, M6).

After each epoch the codebook is written to a folder of its own, as one file, so
a step is there whole or not at all.  A run that starts again reads the last
step that belongs to it: the same start codebook and the same parameters.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from riskvq.operators.codebook import Codebook

SCHEMA = "run string, codes bigint, code_id bigint, code_label int, w array<double>, step int"


class Progress:
    """The steps of one training run in ``folder`` (none without a folder)."""

    def __init__(self, spark: SparkSession, folder: str | None, start: Codebook, params: tuple):
        self.spark, self.folder = spark, folder
        state = hashlib.sha256(repr(params).encode())
        for part in (start.code_id, start.code_label, start.w):
            state.update(part.tobytes())
        self.run = state.hexdigest()

    def last(self, start: Codebook) -> tuple[int, Codebook]:
        """The last step written and its codebook; 0 and ``start`` if there is none."""
        if self.folder is None:
            return 0, start
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(self.folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, start
        steps = rows.groupBy("step", "run").agg(F.count(F.lit(1)).alias("n"), F.max("codes").alias("codes")).collect()
        if any(s["run"] != self.run for s in steps):
            raise ValueError(f"{self.folder} holds the steps of a run with another start or other parameters")
        whole = [s["step"] for s in steps if s["n"] == s["codes"]]
        if not whole:
            return 0, start
        codes = rows.where(F.col("step") == max(whole)).collect()
        return max(whole), Codebook(np.array([r["code_id"] for r in codes]), np.array([r["code_label"] for r in codes]),
                                    np.array([r["w"] for r in codes], np.float64))

    def save(self, step: int, cb: Codebook) -> None:
        if self.folder is None:
            return
        rows = cb.to_df(self.spark).select(F.lit(self.run).alias("run"), F.lit(cb.k).cast("bigint").alias("codes"),
                                           "code_id", "code_label", "w")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/step={step}")
