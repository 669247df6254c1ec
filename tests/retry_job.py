"""Run operators twice -- cleanly, and with the first attempt of every task
failing -- and print whether the results are identical.  Started as its own
process by tests/test_retry.py (it needs a session that allows task retries).
"""

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import numpy as np  # noqa: E402
from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from riskvq.operators import sampling as S  # noqa: E402
from riskvq.operators.bvq import bvq_step  # noqa: E402
from riskvq.operators.codebook import Codebook  # noqa: E402
from riskvq.operators.ranking import with_position  # noqa: E402
from riskvq.sources.labeled import embeddings_labeled, events_labeled  # noqa: E402

SF = "/root/testdata/sf0.001"


MARKS = tempfile.mkdtemp(prefix="riskvq-retry-marks-", dir="/tmp")


def flaky(df):
    """Pass rows through, but fail every task's first attempt (leaving a
    marker file, so the test can tell the failures happened)."""
    marks = MARKS

    def run(batches):
        ctx = TaskContext.get()
        if ctx.attemptNumber() == 0:
            open(os.path.join(marks, f"{ctx.stageId()}-{ctx.partitionId()}"), "w").close()
            raise RuntimeError("injected task loss")
        yield from batches
    return df.mapInArrow(run, df.schema)


def results(spark, wrap):
    ev = wrap(events_labeled(spark, SF))
    emb = wrap(embeddings_labeled(spark, SF))
    out = {
        "split": sorted((r.id, r.part) for r in S.split_random(ev, 80, 3).collect()),
        "positions": sorted((r.id, r.pos) for r in with_position(ev, ["label", "id"]).collect()),
        "bags": sorted((r.bag, r.pos, r.id) for r in S.draw_bags(emb, 3, 20, 5).collect()),
        "per_class": sorted((r.code_id, r.code_label) for r in
                            S.init_codebook_per_class(emb, {c: 2 for c in range(10)}, 7).collect()),
    }
    cb = Codebook.from_df(S.init_codebook_per_class(embeddings_labeled(spark, SF), {c: 2 for c in range(10)}, 1))
    out["bvq"] = bvq_step(emb, cb, 0.05, delta=2.0).w.tolist()
    return out


def main():
    spark = (SparkSession.builder.master("local[4,4]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "4").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="riskvq-retry-", dir="/tmp"))
    clean = results(spark, lambda df: df)
    retried = results(spark, flaky)
    # the BVQ sums pass a shuffle whose fetch order may differ run to run
    checks = {k: clean[k] == retried[k] for k in clean if k != "bvq"}
    checks["bvq"] = bool(np.allclose(clean["bvq"], retried["bvq"], rtol=0, atol=1e-12))
    checks["failures_injected"] = len(os.listdir(MARKS)) > 0
    print("SAME" if all(checks.values()) else "DIFFERENT", checks, len(os.listdir(MARKS)))
    spark.stop()


if __name__ == "__main__":
    main()
