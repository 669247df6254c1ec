"""Query catalogue: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Output rules (so results compare without order against SQL):
long form, one row per ``(code_id, dim)`` for vectors; sorts and ranks carry
their position as a column; doubles rounded to ``DIGITS``; counts BIGINT.
Every query reads the driver tables and runs over all of their rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskvq.functions import vectors as V
from riskvq.operators import evaluate as E
from riskvq.operators import sampling as S
from riskvq.operators.aggregates import vec_avg_long
from riskvq.operators.bvq import bvq_step, bvq_train, bvq_window
from riskvq.operators.codebook import Codebook, codebook_long
from riskvq.operators.exact_sums import exact_vec_sum
from riskvq.operators.large_codebook import CodeParts
from riskvq.operators.nearest import assign_nearest, k_nearest_codes, predict, two_nearest
from riskvq.operators.ranking import sort_by_first, sort_by_label
from riskvq.operators.som import som_step, som_train
from riskvq.plans.pipeline import RunParams, classify_pipeline, run_report
from riskvq.session import ensure_checkpoint_dir
from riskvq.sources import generate as G
from riskvq.sources.row_index import with_row_index
from riskvq.sources.labeled import (EVENT_TYPES, LINEITEM_FEATURES, RETURN_FLAGS, embeddings_labeled,
                                    events_labeled, feature_columns, from_matrix, label_index, parse_labeled_csv, table,
                                    to_labeled)
from riskvq.sources.report import read_run_report, write_run_report

DIGITS = 6

# Parameters of the catalogue (seed, percent and BVQ settings as in the
# recorded launch parameters; 3 codes for each of the 10 embedding classes).
SEED = 15
TRAIN_PCT = 80
EMB_CLASSES = list(range(10))
EMB_DIMS = 64
PER_CLASS = {c: 3 for c in EMB_CLASSES}
SOM_RATE = 0.05
BVQ_RATE = 0.01
DELTA = 0.2
SAMPLE_FRACTION = 0.1
LIMIT_N = 10
INIT_N = 10
N_BAGS = 3
BAG_SIZE = 50
TRAIN_BAGS = 2
TRAIN_BAG_SIZE = 100
UNIFORM_DIMS = 2
UNIFORM_LO, UNIFORM_HI = -1.0, 1.0
INT_LO, INT_HI = 1, 6
SCALE_OFFSET = 1.0
SOM_RADIUS = 1
# A larger codebook, searched in parts of 64 codes, and the number of codes returned.
MORE_PER_CLASS = {c: 20 for c in EMB_CLASSES}
PART_CELLS = 64 * EMB_DIMS
K_NEAREST = 3


def r(c, digits: int = DIGITS):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _long_vec(df: DataFrame, keys: list[str], vec: str, out: str = "x") -> DataFrame:
    return df.select(*keys, F.posexplode(vec).alias("dim", out)).select(
        *keys, F.col("dim").cast("int").alias("dim"), r(out).alias(out))


# -- shared derivations ------------------------------------------------------

def emb(spark, sf):
    return embeddings_labeled(spark, sf)


def emb_train(spark, sf):
    return S.train_test(S.split_random(emb(spark, sf), TRAIN_PCT, SEED))[0]


def emb_test(spark, sf):
    return S.train_test(S.split_random(emb(spark, sf), TRAIN_PCT, SEED))[1]


def init_cb(spark, sf) -> Codebook:
    return Codebook.from_df(S.init_codebook_per_class(emb_train(spark, sf), PER_CLASS, SEED))


def cb_long(spark, cb: Codebook) -> DataFrame:
    return cb.long_df(spark, DIGITS)


def next_pairs(df: DataFrame) -> DataFrame:
    """Row ``id`` paired with row ``id + 1`` (equi-join on the key)."""
    a = df.select(F.col("id"), F.col("label"), F.col("features").alias("a"))
    b = df.select((F.col("id") - 1).alias("id"), F.col("features").alias("b"))
    return a.join(b, "id")


# -- sources -----------------------------------------------------------------

def q_to_labeled(spark, sf):
    lab = to_labeled(table(spark, sf, "events"), "event_id", "event_type", ["value", "user_id"],
                     label_values=EVENT_TYPES)
    return feature_columns(lab, 2)


def q_to_labeled_numeric(spark, sf):
    orders = table(spark, sf, "orders").withColumn("band", F.col("o_totalprice") / F.lit(100000.0))
    return feature_columns(to_labeled(orders, "o_orderkey", "band", ["o_totalprice"]), 1)


def q_from_matrix(spark, sf):
    li = table(spark, sf, "lineitem")
    matrix = li.select(*LINEITEM_FEATURES, label_index("l_returnflag", RETURN_FLAGS).alias("label"))
    return feature_columns(from_matrix(matrix), len(LINEITEM_FEATURES))


def quirky_line(i: Column, columns: list[Column]) -> Column:
    """A CSV line of lineitem row ``i`` as careless programs write it; some are wrong, by the row number."""
    def joined(cols):
        return F.concat_ws(",", *[c.cast("string") for c in cols])

    def is_(k, rest):
        return i % k == rest

    row, label, f1, f2, *others = columns
    line = (F.when(is_(11, 3), joined([row, label, f1, F.lit("n/a"), *others]))
            .when(is_(13, 5), joined(columns[:-1]))
            .when(is_(17, 7), joined([*columns, F.lit(9)]))
            .when(is_(19, 8), joined([row, F.lit("x"), f1, f2, *others]))
            .when(is_(23, 9), joined([F.concat(F.lit("no"), row.cast("string")), *columns[1:]]))
            .otherwise(joined(columns)))
    start, end = F.when(i == 0, F.lit("\ufeff")).otherwise(""), F.when(is_(7, 0), " \r").when(is_(5, 0), "  ").otherwise("")
    return F.concat(start, line, end)


def q_csv_rejects(spark, sf):
    """lineitem written as CSV with mistakes and read back: lines by reason, with sums of the good ones."""
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = lineitem_rows(spark, sf)
    columns = [F.col("row_index"), label_index("l_returnflag", RETURN_FLAGS), *[F.col(c).cast("double") for c in LINEITEM_FEATURES]]
    rows.select(quirky_line(F.col("row_index"), columns).alias("value")).write.text(path)
    parsed = parse_labeled_csv(spark, path, len(LINEITEM_FEATURES))
    good = F.col("reason").isNull()
    return parsed.groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(good, F.col("id"))).alias("ids"),
        F.sum(F.when(good, F.col("label"))).alias("labels"),
        F.round(F.sum(F.when(good, F.element_at("features", 2))), 2).alias("prices"))


def q_uniform_table(spark, sf):
    ev = table(spark, sf, "events")
    u = G.uniform_features(ev, UNIFORM_DIMS, SEED, UNIFORM_LO, UNIFORM_HI, id_col="event_id")
    return _long_vec(u, ["id", "label"], "features")


def q_uniform_int(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(F.col("event_id").alias("id"), G.uniform_int("event_id", SEED, INT_LO, INT_HI).alias("r"))


# -- counting, sampling, splits ------------------------------------------------

def q_row_count(spark, sf):
    return S.row_count(events_labeled(spark, sf))


def q_bernoulli_sample(spark, sf):
    return S.bernoulli_sample(events_labeled(spark, sf), SAMPLE_FRACTION, SEED).select("id", "label")


def q_limit_n(spark, sf):
    return S.limit_n(events_labeled(spark, sf), LIMIT_N, SEED).select("pos", "id")


def q_init_sampled(spark, sf):
    return codebook_long(S.init_codebook_sampled(emb(spark, sf), INIT_N, SEED), DIGITS)


def q_init_first(spark, sf):
    return codebook_long(S.init_codebook_first(emb(spark, sf), INIT_N), DIGITS)


def q_init_per_class(spark, sf):
    return codebook_long(S.init_codebook_per_class(emb(spark, sf), PER_CLASS, SEED), DIGITS)


def q_split_position(spark, sf):
    return S.split_by_position(events_labeled(spark, sf), TRAIN_PCT).select("id", "part")


def q_split_random(spark, sf):
    return S.split_random(events_labeled(spark, sf), TRAIN_PCT, SEED).select("id", "part")


def q_split_sizes(spark, sf):
    return S.split_sizes(S.split_random(events_labeled(spark, sf), TRAIN_PCT, SEED))


def q_shuffle_rows(spark, sf):
    return S.shuffle_rows(events_labeled(spark, sf), SEED).select("pos", "id")


def q_draw_bags(spark, sf):
    return S.draw_bags(emb(spark, sf), N_BAGS, BAG_SIZE, SEED).select(F.col("bag").cast("int").alias("bag"),
                                                                      "pos", "id")


def lineitem_rows(spark, sf):
    """``lineitem``, which has no single id, with its row number."""
    return with_row_index(table(spark, sf, "lineitem"))


def q_row_index(spark, sf):
    return lineitem_rows(spark, sf).select("row_index", "l_orderkey", "l_partkey", "l_linenumber")


def q_sample_by_row(spark, sf):
    return S.bernoulli_sample(lineitem_rows(spark, sf), SAMPLE_FRACTION, SEED, id_col="row_index").select(
        "row_index", "l_orderkey")


def q_split_by_row(spark, sf):
    return S.split_by_position(lineitem_rows(spark, sf), TRAIN_PCT, id_col="row_index").select("row_index", "part")


def q_bags_by_row(spark, sf):
    bags = S.draw_bags(lineitem_rows(spark, sf), N_BAGS, BAG_SIZE, SEED, id_col="row_index")
    return bags.select(F.col("bag").cast("int").alias("bag"), "pos", "row_index")


# -- vectors -----------------------------------------------------------------

def q_vec_sum(spark, sf):
    return emb(spark, sf).select("id", r(V.vec_sum("features")).alias("s"))


def q_vec_sum_skip_last(spark, sf):
    return emb(spark, sf).select("id", r(V.vec_sum("features", skip_last=1)).alias("s"))


def q_vec_sqdist(spark, sf):
    return next_pairs(emb(spark, sf)).select("id", r(V.vec_sqdist("a", "b")).alias("d2"))


def q_vec_dist(spark, sf):
    return next_pairs(emb(spark, sf)).select("id", r(V.vec_dist("a", "b")).alias("d"))


def q_vec_add(spark, sf):
    return _long_vec(next_pairs(emb(spark, sf)).select("id", V.vec_add("a", "b").alias("v")), ["id"], "v")


def q_vec_sub(spark, sf):
    return _long_vec(next_pairs(emb(spark, sf)).select("id", V.vec_sub("a", "b").alias("v")), ["id"], "v")


def q_vec_dot(spark, sf):
    return next_pairs(emb(spark, sf)).select("id", r(V.vec_dot("a", "b")).alias("dot"))


def q_vec_dot_skip_last(spark, sf):
    return next_pairs(emb(spark, sf)).select("id", r(V.vec_dot("a", "b", skip_last=1)).alias("dot"))


def q_vec_scale(spark, sf):
    scal = F.col("label").cast("double") + F.lit(SCALE_OFFSET)
    return _long_vec(emb(spark, sf).select("id", V.vec_scale(scal, "features").alias("v")), ["id"], "v")


def q_vec_avg(spark, sf):
    return vec_avg_long(emb(spark, sf), "label", dims=EMB_DIMS).select("label", "dim", r("avg").alias("avg"))


# -- sorts -------------------------------------------------------------------

def q_sort_by_first(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sort_by_first(orders, "o_totalprice", id_col="o_orderkey").select("pos", "o_orderkey", "o_totalprice")


def q_sort_by_label(spark, sf):
    return sort_by_label(events_labeled(spark, sf)).select("pos", "id", "label")


# -- model -------------------------------------------------------------------

def q_nearest(spark, sf):
    cb = init_cb(spark, sf)
    return assign_nearest(emb(spark, sf), cb).select("id", "code_id", "code_label", r("d2").alias("d2"))


def q_two_nearest(spark, sf):
    cb = init_cb(spark, sf)
    return two_nearest(emb(spark, sf), cb).select("id", "code_i", "label_i", r("d2_i").alias("d2_i"),
                                                  "code_j", "label_j", r("d2_j").alias("d2_j"))


def more_codes(spark, sf) -> DataFrame:
    return S.init_codebook_per_class(emb_train(spark, sf), MORE_PER_CLASS, SEED)


def q_nearest_in_parts(spark, sf):
    parts = CodeParts.of(more_codes(spark, sf), PART_CELLS)
    near = k_nearest_codes(emb(spark, sf).select("id", "features"), parts, K_NEAREST)
    return near.select("id", F.posexplode("nearest").alias("p", "c")).select(
        "id", (F.col("p") + 1).alias("rank"), "c.code_id", "c.code_label", r("c.d2").alias("d2"))


def q_nearest_tree(spark, sf):
    near = two_nearest(emb(spark, sf), Codebook.from_df(more_codes(spark, sf)), method="tree")
    return near.select("id", "code_i", "label_i", r("d2_i").alias("d2_i"), "code_j", "label_j", r("d2_j").alias("d2_j"))


def q_som_step(spark, sf):
    return cb_long(spark, som_step(emb_train(spark, sf), init_cb(spark, sf), SOM_RATE))


def q_som_step_radius(spark, sf):
    return cb_long(spark, som_step(emb_train(spark, sf), init_cb(spark, sf), SOM_RATE, radius=SOM_RADIUS))


def q_som_step_within_class(spark, sf):
    return cb_long(spark, som_step(emb_train(spark, sf), init_cb(spark, sf), SOM_RATE, within_class=True))


def q_som_train_2(spark, sf):
    return cb_long(spark, som_train(emb_train(spark, sf), init_cb(spark, sf), 2, SOM_RATE))


def q_bvq_window(spark, sf):
    win = bvq_window(emb_train(spark, sf), init_cb(spark, sf), DELTA, keep=["id", "label"])
    return win.select("id", "label", "code_i", "code_j", r("gap").alias("gap"))


def q_bvq_step(spark, sf):
    return cb_long(spark, bvq_step(emb_train(spark, sf), init_cb(spark, sf), BVQ_RATE, DELTA))


def q_bvq_step_projection(spark, sf):
    return cb_long(spark, bvq_step(emb_train(spark, sf), init_cb(spark, sf), BVQ_RATE, DELTA,
                                   target="projection"))


def q_bvq_step_cost(spark, sf):
    cost = {(a, p): float(abs(a - p)) for a in EMB_CLASSES for p in EMB_CLASSES}
    return cb_long(spark, bvq_step(emb_train(spark, sf), init_cb(spark, sf), BVQ_RATE, DELTA, cost=cost))


def q_som_train_replicable(spark, sf):
    return cb_long(spark, som_train(emb_train(spark, sf), init_cb(spark, sf), 2, SOM_RATE, replicable=True))


def q_som_train_resumed(spark, sf):
    """A run of two passes that finds the first one done by a run before."""
    train, cb = emb_train(spark, sf), init_cb(spark, sf)
    folder = f"{ensure_checkpoint_dir(spark)}/som-{uuid.uuid4().hex}"
    som_train(train, cb, 1, SOM_RATE, progress=folder)
    return cb_long(spark, som_train(train, cb, 2, SOM_RATE, progress=folder))


def q_bvq_train_online(spark, sf):
    cb, _ = bvq_train(emb_train(spark, sf), init_cb(spark, sf), epochs=1, rate=BVQ_RATE, delta=DELTA,
                      n_bags=TRAIN_BAGS, bag_size=TRAIN_BAG_SIZE, seed=SEED, order="online")
    return cb_long(spark, cb)


def q_bvq_step_replicable(spark, sf):
    return cb_long(spark, bvq_step(emb_train(spark, sf), init_cb(spark, sf), BVQ_RATE, DELTA, replicable=True))


def q_vec_avg_exact(spark, sf):
    avg = exact_vec_sum(emb(spark, sf), "label", dims=EMB_DIMS, mean=True)
    return _long_vec(avg.select(F.col("key").cast("int").alias("label"), "sums"), ["label"], "sums", "avg")


def q_bvq_train_2(spark, sf):
    cb, _ = bvq_train(emb_train(spark, sf), init_cb(spark, sf), epochs=1, rate=BVQ_RATE, delta=DELTA,
                      n_bags=TRAIN_BAGS, bag_size=TRAIN_BAG_SIZE, seed=SEED)
    return cb_long(spark, cb)


def q_bvq_train_epochs(spark, sf):
    cb, _ = bvq_train(emb_train(spark, sf), init_cb(spark, sf), epochs=2, rate=BVQ_RATE, delta=DELTA,
                      n_bags=TRAIN_BAGS, bag_size=TRAIN_BAG_SIZE, seed=SEED)
    return cb_long(spark, cb)


def q_predict(spark, sf):
    return predict(emb_test(spark, sf), init_cb(spark, sf)).select("id", "label", "pred")


def q_confusion(spark, sf):
    return E.confusion(predict(emb_test(spark, sf), init_cb(spark, sf), keep=["label"]))


def q_confusion_matrix(spark, sf):
    return E.confusion_matrix(predict(emb_test(spark, sf), init_cb(spark, sf), keep=["label"]), EMB_CLASSES)


def q_accuracy(spark, sf):
    return E.accuracy(predict(emb_test(spark, sf), init_cb(spark, sf))).select(r("accuracy").alias("accuracy"))


def q_mean_cost(spark, sf):
    cost = E.cost_table(spark, EMB_CLASSES, lambda a, p: abs(a - p))
    pred = predict(emb_test(spark, sf), init_cb(spark, sf))
    return E.mean_cost(pred, cost).select(r("mean_cost").alias("mean_cost"), "n_unlisted")


def _stages(spark, sf):
    train = emb_train(spark, sf)
    cb0 = init_cb(spark, sf)
    cb1 = som_step(train, cb0, SOM_RATE)
    cb2 = bvq_step(train, cb1, BVQ_RATE, DELTA)
    return [("init", cb0.to_df(spark)), ("som", cb1.to_df(spark)), ("bvq", cb2.to_df(spark))]


def q_codebook_trace(spark, sf):
    tr = E.codebook_trace(_stages(spark, sf))
    return tr.select("stage_idx", "stage", "code_id", "code_label", F.posexplode("w").alias("dim", "w")).select(
        "stage_idx", "stage", "code_id", "code_label", F.col("dim").cast("int").alias("dim"), r("w").alias("w"))


def q_codebook_shift(spark, sf):
    sh = E.codebook_shift(E.codebook_trace(_stages(spark, sf)))
    return sh.select("stage_idx", "stage", "code_id", r("shift").alias("shift"))


def q_class_profile(spark, sf):
    li = to_labeled(table(spark, sf, "lineitem"), F.lit(0), "l_returnflag", LINEITEM_FEATURES,
                    label_values=RETURN_FLAGS)
    prof = E.class_profile(li, len(LINEITEM_FEATURES))
    return prof.select("label", F.col("dim").cast("int").alias("dim"), "n", r("mean").alias("mean"),
                       r("std").alias("std"), r("min").alias("min"), r("max").alias("max"))


def pipeline_params() -> RunParams:
    return RunParams(per_class=PER_CLASS, seed=SEED, train_pct=TRAIN_PCT, delta=DELTA, rate=BVQ_RATE,
                     use_bags=False, bvq_epochs=1, use_som=True, som_epochs=1, som_rate=SOM_RATE)


def q_run_report(spark, sf):
    """The report of a run, written as text and read back, without its parameters and times."""
    path = f"{ensure_checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    result = classify_pipeline(emb(spark, sf), pipeline_params())
    write_run_report(run_report(result, EMB_CLASSES), None, path)
    rows = read_run_report(spark, path)
    return rows.where(~F.col("metric").like("param\\_%") & ~F.col("metric").like("%\\_sec"))


def q_classify_pipeline(spark, sf):
    res = classify_pipeline(emb(spark, sf), pipeline_params())
    return res.confusion()


QUERIES = {
    "to_labeled": q_to_labeled,
    "to_labeled_numeric": q_to_labeled_numeric,
    "from_matrix": q_from_matrix,
    "csv_rejects": q_csv_rejects,
    "uniform_table": q_uniform_table,
    "uniform_int": q_uniform_int,
    "row_count": q_row_count,
    "bernoulli_sample": q_bernoulli_sample,
    "limit_n": q_limit_n,
    "init_sampled": q_init_sampled,
    "init_first": q_init_first,
    "init_per_class": q_init_per_class,
    "split_position": q_split_position,
    "split_random": q_split_random,
    "split_sizes": q_split_sizes,
    "shuffle_rows": q_shuffle_rows,
    "draw_bags": q_draw_bags,
    "row_index": q_row_index,
    "sample_by_row": q_sample_by_row,
    "split_by_row": q_split_by_row,
    "bags_by_row": q_bags_by_row,
    "vec_sum": q_vec_sum,
    "vec_sum_skip_last": q_vec_sum_skip_last,
    "vec_sqdist": q_vec_sqdist,
    "vec_dist": q_vec_dist,
    "vec_add": q_vec_add,
    "vec_sub": q_vec_sub,
    "vec_dot": q_vec_dot,
    "vec_dot_skip_last": q_vec_dot_skip_last,
    "vec_scale": q_vec_scale,
    "vec_avg": q_vec_avg,
    "sort_by_first": q_sort_by_first,
    "sort_by_label": q_sort_by_label,
    "nearest": q_nearest,
    "two_nearest": q_two_nearest,
    "nearest_in_parts": q_nearest_in_parts,
    "nearest_tree": q_nearest_tree,
    "som_train_replicable": q_som_train_replicable,
    "som_train_resumed": q_som_train_resumed,
    "bvq_train_online": q_bvq_train_online,
    "bvq_step_replicable": q_bvq_step_replicable,
    "vec_avg_exact": q_vec_avg_exact,
    "som_step": q_som_step,
    "som_step_radius": q_som_step_radius,
    "som_step_within_class": q_som_step_within_class,
    "som_train_2": q_som_train_2,
    "bvq_window": q_bvq_window,
    "bvq_step": q_bvq_step,
    "bvq_step_projection": q_bvq_step_projection,
    "bvq_step_cost": q_bvq_step_cost,
    "bvq_train_2": q_bvq_train_2,
    "bvq_train_epochs": q_bvq_train_epochs,
    "predict": q_predict,
    "confusion": q_confusion,
    "confusion_matrix": q_confusion_matrix,
    "accuracy": q_accuracy,
    "mean_cost": q_mean_cost,
    "codebook_trace": q_codebook_trace,
    "codebook_shift": q_codebook_shift,
    "class_profile": q_class_profile,
    "classify_pipeline": q_classify_pipeline,
    "run_report": q_run_report,
}
