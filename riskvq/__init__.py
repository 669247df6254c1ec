"""riskvq: codebook classification (SOM initialisation, cost-sensitive BVQ
training, nearest-code scoring, evaluation) as Spark DataFrame jobs."""

from riskvq.operators.bvq import bvq_step, bvq_train, bvq_window
from riskvq.operators.codebook import Codebook
from riskvq.operators.evaluate import accuracy, confusion, cost_table, mean_cost
from riskvq.operators.nearest import assign_nearest, predict, two_nearest
from riskvq.operators.sampling import (bernoulli_sample, draw_bags, init_codebook_per_class, shuffle_rows,
                                       split_by_position, split_random)
from riskvq.operators.som import som_step, som_train
from riskvq.plans.pipeline import RunParams, classify_pipeline
from riskvq.session import get_spark

__version__ = "0.1.0"

__all__ = [
    "Codebook", "RunParams", "accuracy", "assign_nearest", "bernoulli_sample", "bvq_step", "bvq_train",
    "bvq_window", "classify_pipeline", "confusion", "cost_table", "draw_bags", "get_spark",
    "init_codebook_per_class", "mean_cost", "predict", "shuffle_rows", "som_step", "som_train",
    "split_by_position", "split_random", "two_nearest",
]
