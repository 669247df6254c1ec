"""End-to-end classification run (M8).

split -> initial codebook per class -> optional SOM epochs -> BVQ epochs
(over bags or the whole training part) -> predict the test part ->
confusion, accuracy, mean cost, and the codebook at every stage.

Every step is a Spark job over the table; only codebooks (K x D, checked)
and per-code sums come back to the driver.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, fields

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskvq.operators.bvq import bvq_train
from riskvq.operators.codebook import Codebook
from riskvq.operators.evaluate import accuracy, confusion, cost_table, mean_cost
from riskvq.operators.nearest import predict
from riskvq.operators.sampling import init_codebook_per_class, split_by_position, split_random, split_sizes, train_test
from riskvq.operators.som import som_train


@dataclass
class RunParams:
    per_class: dict                      # {label: number of code vectors}
    seed: int = 15
    train_pct: float = 80
    split: str = "random"                # "random" (keyed) or "position"
    delta: float | None = 0.2
    window_half_width: float | None = None
    rate: float = 0.01
    cost: dict | None = None             # {(actual, decided): cost}; None = 0/1
    target: str = "sample"
    bvq_epochs: int = 1
    use_bags: bool = True
    n_bags: int = 1
    bag_size: int = 10
    use_som: bool = True
    som_epochs: int = 1
    som_rate: float = 0.05
    som_radius: int = 0
    som_within_class: bool = False
    som_sample_fraction: float | None = None
    method: str = "auto"
    replicable: bool = False             # the same codebooks to the byte under any partitioning
    order: str = "batch"                 # "online": rows of a bag one by one
    progress: str | None = None          # shared folder to go on from after a loss
    persist_train: bool | None = None    # keep the training part between passes; None: if it is estimated small


# A training part estimated below this is kept in memory (and on disk) between passes.
PERSIST_BYTES = 256 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the size of a DataFrame, from file sizes and column types."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@dataclass
class RunResult:
    params: RunParams
    split: DataFrame
    predictions: DataFrame
    stages: list = field(default_factory=list)     # [(stage name, Codebook)]
    timings: dict = field(default_factory=dict)

    def confusion(self) -> DataFrame:
        return confusion(self.predictions)

    def accuracy(self) -> DataFrame:
        return accuracy(self.predictions)

    def mean_cost(self, classes: list[int]) -> DataFrame:
        spark = self.predictions.sparkSession
        cost = self.params.cost
        matrix = None if cost is None else (lambda a, p: cost[(a, p)] if a != p else cost.get((a, p), 0.0))
        return mean_cost(self.predictions, cost_table(spark, classes, matrix))

    def codebook(self) -> Codebook:
        return self.stages[-1][1]


def classify_pipeline(df: DataFrame, params: RunParams) -> RunResult:
    """Run the whole classifier on a labelled table ``(id, label, features)``."""
    t0 = time.time()
    if params.split == "position":
        split = split_by_position(df, int(params.train_pct))
    else:
        split = split_random(df, params.train_pct, params.seed)
    train, test = train_test(split)
    train = train.select("id", "label", "features")
    timings = {}
    keep = estimated_bytes(train) <= PERSIST_BYTES if params.persist_train is None else params.persist_train
    if keep:
        train = train.persist(StorageLevel.MEMORY_AND_DISK)

    def folder(name: str) -> str | None:
        return None if params.progress is None else f"{params.progress.rstrip('/')}/{name}"

    try:
        cb = Codebook.from_df(init_codebook_per_class(train, params.per_class, params.seed))
        stages = [("init", cb)]
        if params.use_som and params.som_epochs > 0:
            t = time.time()
            cb = som_train(train, cb, params.som_epochs, params.som_rate, params.som_radius,
                           params.som_within_class, params.som_sample_fraction, params.seed, params.method,
                           params.replicable, folder("som"))
            timings["som_sec"] = time.time() - t
            stages.append(("som", cb))
        t = time.time()
        cb, _ = bvq_train(train, cb, params.bvq_epochs, params.rate, params.delta, params.window_half_width,
                          params.cost, params.target, params.n_bags, params.bag_size, params.seed, params.use_bags,
                          method=params.method, replicable=params.replicable, order=params.order,
                          progress=folder("bvq"))
        timings["bvq_sec"] = time.time() - t
        stages.append(("bvq", cb))
    finally:
        if keep:
            train.unpersist()
    preds = predict(test, cb, method=params.method)
    timings["train_sec"] = time.time() - t0
    return RunResult(params, split, preds, stages, timings)


def run_report(result: RunResult, classes: list[int]) -> DataFrame:
    """``(metric, value)`` rows of a run: parameters, sizes, times, the confusion
    matrix, accuracy and mean cost.

    ``score_sec`` is the time to score the whole test part, ``total_sec`` that
    of training and scoring."""
    spark = result.predictions.sparkSession
    t = time.time()
    # one scoring pass; the rest follows from at most classes^2 counts
    counts = {(r["actual"], r["predicted"]): r["n"] for r in result.confusion().collect()}
    score_sec = time.time() - t
    sizes = {r["part"]: r["n"] for r in split_sizes(result.split).collect()}
    total = sum(counts.values())
    acc = sum(n for (a, p), n in counts.items() if a is not None and a == p) / total if total else None
    rows = [(f"param_{f.name}", str(getattr(result.params, f.name))) for f in fields(result.params)]
    rows += [("train_rows", str(sizes.get("train", 0))), ("test_rows", str(sizes.get("test", 0))),
             ("codes", str(result.codebook().k))]
    rows.append(("confusion_columns", " ".join([*map(str, classes), "other"])))
    for a in sorted({a for a, _ in counts}, key=lambda x: (x is None, x)):
        own = {p: n for (b, p), n in counts.items() if b == a}
        cells = [own.get(c, 0) for c in classes]
        rows.append((f"confusion_{a}", " ".join(map(str, [*cells, sum(own.values()) - sum(cells)]))))
    cost = result.params.cost
    listed = {(a, p): n for (a, p), n in counts.items() if a in classes and p in classes}
    spent = sum(n * ((0.0 if a == p else 1.0) if cost is None else cost.get((a, p), 0.0) if a == p else cost[(a, p)])
                for (a, p), n in listed.items())
    n_listed = sum(listed.values())
    rows += [("accuracy", repr(acc)), ("mean_cost", repr(spent / n_listed if n_listed else None)),
             ("unlisted_rows", str(total - n_listed))]
    rows += [(k, f"{v:.3f}") for k, v in result.timings.items()]
    rows += [("score_sec", f"{score_sec:.3f}"), ("total_sec", f"{result.timings['train_sec'] + score_sec:.3f}")]
    return spark.createDataFrame(rows, "metric string, value string")


def stage_codebooks(result: RunResult) -> DataFrame:
    """All stages as ``(stage_idx, stage, code_id, code_label, w)``."""
    spark = result.predictions.sparkSession
    out = None
    for i, (name, cb) in enumerate(result.stages):
        df = cb.to_df(spark).select(F.lit(i).alias("stage_idx"), F.lit(name).alias("stage"), "*")
        out = df if out is None else out.unionByName(df)
    return out
