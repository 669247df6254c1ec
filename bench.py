"""Headline timings.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Every query runs to completion (noop sink or a small collect).  The headline
value is the end-to-end run in the shape of the recorded reference run
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from riskvq.operators import evaluate as E  # noqa: E402
from riskvq.operators import sampling as S  # noqa: E402
from riskvq.operators.bvq import bvq_step  # noqa: E402
from riskvq.operators.codebook import Codebook  # noqa: E402
from riskvq.operators.nearest import assign_nearest, predict  # noqa: E402
from riskvq.operators.som import som_step  # noqa: E402
from riskvq.plans import catalog as C  # noqa: E402
from riskvq.plans.pipeline import RunParams, classify_pipeline  # noqa: E402
from riskvq.session import get_spark  # noqa: E402
from riskvq.sources.labeled import events_labeled, lineitem_labeled  # noqa: E402

LI_PER_CLASS = {0: 3, 1: 7, 2: 5}


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", max(cpus, 8), app_name="riskvq-bench",
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # JVM warm-up

    li = lineitem_labeled(spark, sf_dir)
    times: dict[str, float] = {}
    state: dict = {}

    def timed(name, fn):
        t = time.time()
        fn()
        times[name] = round(time.time() - t, 3)

    def li_split():
        return S.train_test(S.split_random(li, 80, C.SEED))

    def init():
        train, _ = li_split()
        state["cb"] = Codebook.from_df(S.init_codebook_per_class(train, LI_PER_CLASS, C.SEED))

    timed("init_per_class_lineitem", init)
    timed("nearest_lineitem", lambda: drain(assign_nearest(li, state["cb"])))
    timed("predict_confusion_lineitem",
          lambda: E.confusion(predict(li_split()[1], state["cb"])).collect())
    timed("som_step_lineitem", lambda: som_step(li_split()[0], state["cb"], C.SOM_RATE))
    timed("bvq_step_lineitem", lambda: bvq_step(li_split()[0], state["cb"], C.BVQ_RATE, C.DELTA))
    # The recorded run's shape: 10 codes, SOM 1 epoch, BVQ 1 bag of 10.
    recorded = RunParams(per_class={0: 3, 1: 4, 2: 3}, seed=C.SEED, train_pct=80, delta=C.DELTA, rate=C.BVQ_RATE,
                         use_som=True, som_epochs=1, som_rate=C.SOM_RATE, bvq_epochs=1, use_bags=True, n_bags=1,
                         bag_size=10)
    timed("pipeline_recorded_shape_lineitem",
          lambda: classify_pipeline(li, recorded).confusion().collect())
    # The launch parameters: 5 SOM epochs, 5 BVQ epochs of 10 bags of 100.
    launch = RunParams(per_class=LI_PER_CLASS, seed=C.SEED, train_pct=80, delta=C.DELTA, rate=C.BVQ_RATE,
                       use_som=True, som_epochs=5, som_rate=C.SOM_RATE, bvq_epochs=5, use_bags=True, n_bags=10,
                       bag_size=100)
    timed("pipeline_launch_params_lineitem",
          lambda: classify_pipeline(li, launch).confusion().collect())
    # Closest to the recorded run itself: 2 features, 10 codes, SOM 1 epoch,
    # BVQ 1 bag of 10 -- on all of ``events``.
    ev = events_labeled(spark, sf_dir)
    ev_recorded = RunParams(per_class={c: 2 for c in range(5)}, seed=C.SEED, train_pct=80, delta=C.DELTA,
                            rate=C.BVQ_RATE, use_som=True, som_epochs=1, som_rate=C.SOM_RATE, bvq_epochs=1,
                            use_bags=True, n_bags=1, bag_size=10)
    timed("pipeline_recorded_shape_events",
          lambda: classify_pipeline(ev, ev_recorded).confusion().collect())
    timed("pipeline_embeddings", lambda: C.q_classify_pipeline(spark, sf_dir).collect())
    timed("split_position_events", lambda: drain(C.q_split_position(spark, sf_dir)))
    timed("draw_bags_lineitem", lambda: drain(S.draw_bags(li, 10, 100, C.SEED)))
    timed("class_profile_lineitem", lambda: C.q_class_profile(spark, sf_dir).collect())

    # The same nearest-code query on each physical path (not in the total).
    paths: dict[str, float] = {}
    for method in ("arrow", "unrolled", "expr"):
        t = time.time()
        drain(assign_nearest(li, state["cb"], method=method))
        paths[f"nearest_lineitem_{method}"] = round(time.time() - t, 3)

    # A codebook of 10,000 codes, with the metric tree and measuring every code (not in the total).
    large = Codebook.from_df(S.init_codebook_per_class(li, {0: 3000, 1: 4000, 2: 3000}, C.SEED))
    for method in ("tree", "arrow"):
        t = time.time()
        drain(assign_nearest(li, large, method=method))
        paths[f"nearest_lineitem_10000_codes_{method}"] = round(time.time() - t, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    # Headline: the configuration of the one recorded reference run (2 features,
    # 10 codes, SOM 1 epoch, BVQ 1 bag of 10), end to end on all of ``events``.
    # The sum over every query is reported next to it.
    print(json.dumps({"metric": "recorded_run_shape_events_sec", "value": times["pipeline_recorded_shape_events"],
                      "unit": "sec", "total_query_sec": round(sum(times.values()), 3),
                      "queries": times, "nearest_paths": paths, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
                      "rows": {"lineitem": li.count(), "events": ev.count()}}))
    spark.stop()


if __name__ == "__main__":
    main()
