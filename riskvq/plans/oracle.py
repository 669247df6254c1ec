"""Reference SQL (DuckDB dialect) for every catalogue query.

Written independently of the Spark code path: row-wise list lambdas,
window functions and cross joins that are fine on the oracle's small
inputs.  Training passes (SOM, BVQ) are chained CTE blocks, one per pass.
"""

from __future__ import annotations

from riskvq.plans import catalog as C
from riskvq.sources.labeled import EVENT_TYPES, LINEITEM_FEATURES, RETURN_FLAGS

D = C.DIGITS


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def key(id_expr: str, *salts: str) -> str:
    parts = [f"'{C.SEED}:'"] + [f"{s} || ':'" for s in salts] + [id_expr]
    return "md5(" + " || ".join(parts) + ")"


def draw(purpose: str, id_expr: str = "id") -> str:
    """Key of one kind of draw: seed, purpose, id."""
    return key(id_expr, f"'{purpose}'")


def below(key_expr: str, fraction: float) -> str:
    """The first 64 bits of the key as a fraction of 2^64, compared as hex text."""
    return f"substr({key_expr}, 1, 16) < '{int(fraction * 2 ** 64):016x}'"


def uniform(key_expr: str) -> str:
    return f"(('0x' || substr({key_expr}, 1, 8))::BIGINT / {dbl(4294967296.0)})"


def fold(list_expr: str) -> str:
    return f"list_reduce({list_expr}, lambda s, v: s + v)"


def zipped(a: str, b: str, body: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda p: {body})"


def sqd(a: str, b: str) -> str:
    return fold(zipped(a, b, "(p[1] - p[2]) * (p[1] - p[2])"))


def case_label(col: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(values))
    return f"CASE {col} {whens} END"


LAB_EMB = "SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS features FROM embeddings"
LAB_EV = (f"SELECT event_id AS id, {case_label('event_type', EVENT_TYPES)} AS label, "
          "[CAST(value AS DOUBLE), CAST(user_id AS DOUBLE)] AS features FROM events")


def split_ctes(lab: str = LAB_EMB) -> str:
    return f"""lab AS ({lab}),
split AS (SELECT *, CASE WHEN {below(draw('split'), C.TRAIN_PCT / 100.0)} THEN 'train' ELSE 'test' END AS part
          FROM lab),
train AS (SELECT id, label, features FROM split WHERE part = 'train'),
test AS (SELECT id, label, features FROM split WHERE part = 'test')"""


def per_class_cte(name: str, data: str, quotas: dict[int, int] = C.PER_CLASS) -> str:
    offsets = {}
    total = 0
    for lab in sorted(quotas):
        offsets[lab] = total
        total += quotas[lab]
    off = "CASE label " + " ".join(f"WHEN {k} THEN {v}" for k, v in offsets.items()) + " END"
    quota = "CASE label " + " ".join(f"WHEN {k} THEN {v}" for k, v in quotas.items()) + " END"
    labels = ", ".join(str(k) for k in sorted(quotas))
    return f"""{name} AS (SELECT CAST({off} + rn AS BIGINT) AS code_id, label AS code_label, features AS w
    FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {draw('init')}, id) AS rn
          FROM {data} WHERE label IN ({labels}))
    WHERE rn <= {quota})"""


def long_cb(cb: str, extra: str = "") -> str:
    return f"""SELECT {extra}code_id, code_label, CAST(dim AS INTEGER) AS dim, round(w, {D}) AS w
FROM (SELECT code_id, code_label, unnest(range(len(w))) AS dim, unnest(w) AS w FROM {cb})"""


def nearest_cte(name: str, data: str, cb: str) -> str:
    return f"""{name} AS (SELECT * FROM (
      SELECT d.id, d.label, d.features, c.code_id, c.code_label, {sqd('d.features', 'c.w')} AS d2
      FROM {data} d CROSS JOIN {cb} c)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, code_id) = 1)"""


def som_ctes(out: str, prev: str, data: str, rate: float, radius: int = 0, within_class: bool = False) -> str:
    if within_class:
        assign = f"""{out}_a AS (SELECT * FROM (
      SELECT d.id, d.label, d.features, c.code_id, c.code_label, {sqd('d.features', 'c.w')} AS d2
      FROM {data} d JOIN {prev} c ON c.code_label = d.label)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, code_id) = 1)"""
    else:
        assign = nearest_cte(out + '_a', data, prev)
    if radius > 0:
        # winners pull the codes of their class within ``radius`` positions
        # of the code_id chain
        assign += f""",
{out}_k AS (SELECT code_id, code_label, row_number() OVER (PARTITION BY code_label ORDER BY code_id) AS r
    FROM {prev}),
{out}_nb AS (SELECT a.code_id AS winner, b.code_id AS target FROM {out}_k a JOIN {out}_k b
    ON a.code_label = b.code_label AND abs(a.r - b.r) <= {radius}),
{out}_x AS (SELECT nb.target AS code_id, a.features FROM {out}_a a JOIN {out}_nb nb ON nb.winner = a.code_id)"""
        src = f"{out}_x"
    else:
        src = f"{out}_a"
    return f"""{assign},
{out}_m AS (SELECT code_id, dim, sum(x) AS sx, count(*) AS n
    FROM (SELECT code_id, unnest(range(len(features))) AS dim, unnest(features) AS x FROM {src})
    GROUP BY code_id, dim),
{out}_e AS (SELECT code_id, code_label, unnest(range(len(w))) AS dim, unnest(w) AS w FROM {prev}),
{out}_l AS (SELECT e.code_id, e.code_label, e.dim,
       CASE WHEN m.n IS NULL THEN e.w ELSE e.w + {dbl(rate)} * (m.sx / m.n - e.w) END AS w
    FROM {out}_e e LEFT JOIN {out}_m m ON m.code_id = e.code_id AND m.dim = e.dim),
{out} AS (SELECT code_id, code_label, list(w ORDER BY dim) AS w FROM {out}_l GROUP BY code_id, code_label)"""


def bvq_pairs_ctes(out: str, prev: str, data: str) -> str:
    return f"""{out}_r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, code_id) AS rn FROM (
      SELECT d.id, d.label AS u, d.features AS x, c.code_id, c.code_label, {sqd('d.features', 'c.w')} AS d2
      FROM {data} d CROSS JOIN {prev} c)),
{out}_t AS (SELECT i.id, i.u, i.x, i.code_id AS ci, i.code_label AS li, i.d2 AS d2i,
                   j.code_id AS cj, j.code_label AS lj, j.d2 AS d2j, wi.w AS wi, wj.w AS wj
    FROM {out}_r i JOIN {out}_r j ON i.id = j.id AND i.rn = 1 AND j.rn = 2
    JOIN {prev} wi ON wi.code_id = i.code_id JOIN {prev} wj ON wj.code_id = j.code_id),
{out}_n AS (SELECT *, sqrt({sqd('wi', 'wj')}) AS n FROM {out}_t),
{out}_w AS (SELECT *, (d2j - d2i) / ({dbl(2.0)} * n) AS gap FROM {out}_n
    WHERE li <> lj AND n > 0 AND (d2j - d2i) / ({dbl(2.0)} * n) <= {dbl(C.DELTA / 2.0)})"""


def bvq_ctes(out: str, prev: str, data: str, rate: float, target: str = "sample", cost: str = "01") -> str:
    if cost == "abs":
        b_i, b_j = "CAST(abs(u - li) AS DOUBLE)", "CAST(abs(u - lj) AS DOUBLE)"
    else:
        b_i = f"CASE WHEN u = li THEN {dbl(0.0)} ELSE {dbl(1.0)} END"
        b_j = f"CASE WHEN u = lj THEN {dbl(0.0)} ELSE {dbl(1.0)} END"
    if target == "sample":
        tgt = f"""{out}_g AS (SELECT ci, cj, ({dbl(rate)} * ({b_j} - {b_i})) / n AS g, x AS t FROM {out}_w)"""
    else:
        mid = zipped("wi", "wj", f"(p[1] + p[2]) / {dbl(2.0)}")
        dw = zipped("wi", "wj", "p[1] - p[2]")
        tgt = f"""{out}_p AS (SELECT *, {mid} AS mid, {dw} AS dw FROM {out}_w),
{out}_q AS (SELECT *, {fold(zipped(zipped('x', 'mid', 'p[1] - p[2]'), 'dw', 'p[1] * p[2]'))} / (n * n) AS pc
    FROM {out}_p),
{out}_g AS (SELECT ci, cj, ({dbl(rate)} * ({b_j} - {b_i})) / n AS g,
       list_transform(list_zip(x, dw), lambda p: p[1] - pc * p[2]) AS t FROM {out}_q)"""
    return f"""{bvq_pairs_ctes(out, prev, data)},
{tgt},
{out}_c AS (SELECT ci AS code_id, -g AS coef, t FROM {out}_g WHERE g <> 0
            UNION ALL SELECT cj AS code_id, g AS coef, t FROM {out}_g WHERE g <> 0),
{out}_s AS (SELECT code_id, sum(coef) AS s FROM {out}_c GROUP BY code_id),
{out}_v AS (SELECT code_id, dim, sum(coef * tx) AS v
    FROM (SELECT code_id, coef, unnest(range(len(t))) AS dim, unnest(t) AS tx FROM {out}_c) GROUP BY code_id, dim),
{out}_e AS (SELECT code_id, code_label, unnest(range(len(w))) AS dim, unnest(w) AS w FROM {prev}),
{out}_l AS (SELECT e.code_id, e.code_label, e.dim,
       CASE WHEN s.s IS NULL THEN e.w ELSE e.w + s.s * e.w - v.v END AS w
    FROM {out}_e e LEFT JOIN {out}_s s ON s.code_id = e.code_id
    LEFT JOIN {out}_v v ON v.code_id = e.code_id AND v.dim = e.dim),
{out} AS (SELECT code_id, code_label, list(w ORDER BY dim) AS w FROM {out}_l GROUP BY code_id, code_label)"""


def bags_cte(name: str, data: str, n_bags: int, bag_size: int) -> str:
    """Mini-batches of the seeded shuffle, wrapping past the last row."""
    total = n_bags * bag_size
    return f"""{name}_r AS (SELECT *, row_number() OVER (ORDER BY {draw('bag')}, id) - 1 AS p,
                          least(count(*) OVER (), {total}) AS n FROM {data}),
{name} AS (SELECT {name}_r.* EXCLUDE (p, n), CAST(slot // {bag_size} + 1 AS INTEGER) AS bag,
                  CAST(slot % {bag_size} + 1 AS BIGINT) AS pos
           FROM {name}_r, unnest(range(p, {total}, n)) AS s(slot) WHERE p < {total})"""


def pred_cte(name: str, data: str, cb: str) -> str:
    return f"""{nearest_cte(name + '_n', data, cb)},
{name} AS (SELECT id, label, code_label AS pred FROM {name}_n)"""


def pairs_cte() -> str:
    return f"""lab AS ({LAB_EMB}),
pairs AS (SELECT a.id, a.label, a.features AS a, b.features AS b FROM lab a JOIN lab b ON b.id = a.id + 1)"""


def long_list(keys: str, list_expr: str, src: str, out: str = "x") -> str:
    return f"""SELECT {keys}, CAST(dim AS INTEGER) AS dim, round({out}, {D}) AS {out}
FROM (SELECT {keys}, unnest(range(len(v))) AS dim, unnest(v) AS {out} FROM (SELECT {keys}, {list_expr} AS v FROM {src}))"""


def li_rows() -> str:
    return "li AS (SELECT row_number() OVER () - 1 AS row_index, * FROM lineitem)"


def _li_lab() -> str:
    feats = ", ".join(f"CAST({c} AS DOUBLE)" for c in LINEITEM_FEATURES)
    return f"SELECT {case_label('l_returnflag', RETURN_FLAGS)} AS label, [{feats}] AS features FROM lineitem"


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    thr80 = C.TRAIN_PCT / 100.0
    ev_label = case_label("event_type", EVENT_TYPES)

    q["to_labeled"] = (f"SELECT event_id AS id, {ev_label} AS label, CAST(value AS DOUBLE) AS f1, "
                       "CAST(user_id AS DOUBLE) AS f2 FROM events")
    li_feats = ", ".join(f"CAST({c} AS DOUBLE) AS f{i + 1}" for i, c in enumerate(LINEITEM_FEATURES))
    q["from_matrix"] = f"SELECT {case_label('l_returnflag', RETURN_FLAGS)} AS label, {li_feats} FROM lineitem"
    label = case_label("l_returnflag", RETURN_FLAGS)
    q["csv_rejects"] = f"""WITH {li_rows()},
r AS (SELECT row_index AS i, {label} AS label, CAST(l_extendedprice AS DOUBLE) AS price,
             CASE WHEN row_index % 11 = 3 THEN 'feature' WHEN row_index % 13 = 5 OR row_index % 17 = 7 THEN 'columns'
                  WHEN row_index % 19 = 8 THEN 'label' WHEN row_index % 23 = 9 THEN 'id' ELSE 'good' END AS reason FROM li)
SELECT reason, count(*) AS n, CAST(sum(CASE WHEN reason = 'good' THEN i END) AS BIGINT) AS ids,
       CAST(sum(CASE WHEN reason = 'good' THEN label END) AS BIGINT) AS labels,
       round(sum(CASE WHEN reason = 'good' THEN price END), 2) AS prices FROM r GROUP BY reason"""
    q["to_labeled_numeric"] = """SELECT o_orderkey AS id, CAST(trunc(o_totalprice / 100000.0) AS INTEGER) AS label,
  CAST(o_totalprice AS DOUBLE) AS f1 FROM orders"""
    span = C.UNIFORM_HI - C.UNIFORM_LO
    q["uniform_table"] = f"""SELECT event_id AS id, 0 AS label, CAST(d.dim AS INTEGER) AS dim,
  round({dbl(C.UNIFORM_LO)} + {dbl(span)} * {uniform(key('event_id', 'd.dim'))}, {D}) AS x
FROM events CROSS JOIN (SELECT range AS dim FROM range({C.UNIFORM_DIMS})) d"""
    q["uniform_int"] = f"""SELECT event_id AS id,
  CAST({C.INT_LO} + floor({uniform(key('event_id'))} * {dbl(C.INT_HI - C.INT_LO + 1)}) AS BIGINT) AS r FROM events"""

    q["row_count"] = "SELECT count(*) AS n FROM events"
    q["bernoulli_sample"] = f"""WITH ev AS ({LAB_EV})
SELECT id, label FROM ev WHERE {below(draw('sample'), C.SAMPLE_FRACTION)}"""
    q["limit_n"] = f"""WITH ev AS ({LAB_EV})
SELECT row_number() OVER (ORDER BY {draw('limit')}, id) AS pos, id FROM ev QUALIFY pos <= {C.LIMIT_N}"""
    q["init_sampled"] = f"""WITH lab AS ({LAB_EMB}),
cb AS (SELECT row_number() OVER (ORDER BY {draw('init')}, id) AS code_id, label AS code_label, features AS w
       FROM lab QUALIFY code_id <= {C.INIT_N})
{long_cb('cb')}"""
    q["init_first"] = f"""WITH lab AS ({LAB_EMB}),
cb AS (SELECT row_number() OVER (ORDER BY id) AS code_id, label AS code_label, features AS w
       FROM lab QUALIFY code_id <= {C.INIT_N})
{long_cb('cb')}"""
    q["init_per_class"] = f"""WITH lab AS ({LAB_EMB}),
{per_class_cte('cb', 'lab')}
{long_cb('cb')}"""
    q["split_position"] = f"""WITH ev AS ({LAB_EV})
SELECT id, CASE WHEN row_number() OVER (ORDER BY id) <= (count(*) OVER ()) * {C.TRAIN_PCT} // 100
                THEN 'train' ELSE 'test' END AS part FROM ev"""
    q["split_random"] = f"""WITH ev AS ({LAB_EV})
SELECT id, CASE WHEN {below(draw('split'), thr80)} THEN 'train' ELSE 'test' END AS part FROM ev"""
    q["split_sizes"] = f"""WITH ev AS ({LAB_EV})
SELECT part, count(*) AS n FROM (
  SELECT CASE WHEN {below(draw('split'), thr80)} THEN 'train' ELSE 'test' END AS part FROM ev) GROUP BY part"""
    q["shuffle_rows"] = f"""WITH ev AS ({LAB_EV})
SELECT row_number() OVER (ORDER BY {draw('shuffle')}, id) AS pos, id FROM ev"""
    q["draw_bags"] = f"""WITH lab AS ({LAB_EMB}),
{bags_cte('bags', 'lab', C.N_BAGS, C.BAG_SIZE)}
SELECT bag, pos, id FROM bags"""

    q["row_index"] = f"WITH {li_rows()} SELECT row_index, l_orderkey, l_partkey, l_linenumber FROM li"
    q["sample_by_row"] = f"""WITH {li_rows()}
SELECT row_index, l_orderkey FROM li WHERE {below(draw('sample', 'row_index'), C.SAMPLE_FRACTION)}"""
    q["split_by_row"] = f"""WITH {li_rows()}
SELECT row_index, CASE WHEN row_number() OVER (ORDER BY row_index) <= (count(*) OVER ()) * {C.TRAIN_PCT} // 100
                       THEN 'train' ELSE 'test' END AS part FROM li"""
    q["bags_by_row"] = f"""WITH {li_rows()}, rows AS (SELECT row_index AS id FROM li),
{bags_cte('bags', 'rows', C.N_BAGS, C.BAG_SIZE)}
SELECT bag, pos, id AS row_index FROM bags"""

    q["vec_sum"] = f"WITH lab AS ({LAB_EMB}) SELECT id, round({fold('features')}, {D}) AS s FROM lab"
    q["vec_sum_skip_last"] = (f"WITH lab AS ({LAB_EMB}) SELECT id, "
                              f"round({fold('list_slice(features, 1, len(features) - 1)')}, {D}) AS s FROM lab")
    q["vec_sqdist"] = f"WITH {pairs_cte()} SELECT id, round({sqd('a', 'b')}, {D}) AS d2 FROM pairs"
    q["vec_dist"] = f"WITH {pairs_cte()} SELECT id, round(sqrt({sqd('a', 'b')}), {D}) AS d FROM pairs"
    q["vec_add"] = f"WITH {pairs_cte()}\n" + long_list("id", zipped("a", "b", "p[1] + p[2]"), "pairs")
    q["vec_sub"] = f"WITH {pairs_cte()}\n" + long_list("id", zipped("a", "b", "p[1] - p[2]"), "pairs")
    q["vec_dot"] = f"WITH {pairs_cte()} SELECT id, round({fold(zipped('a', 'b', 'p[1] * p[2]'))}, {D}) AS dot FROM pairs"
    prods = zipped("a", "b", "p[1] * p[2]")
    q["vec_dot_skip_last"] = (f"WITH {pairs_cte()} SELECT id, "
                              f"round({fold(f'list_slice({prods}, 1, len(a) - 1)')}, {D}) AS dot FROM pairs")
    q["vec_scale"] = (f"WITH lab AS ({LAB_EMB}), sc AS (SELECT id, CAST(label AS DOUBLE) + {dbl(C.SCALE_OFFSET)} AS k, "
                      "features FROM lab)\n" + long_list("id", "list_transform(features, lambda e: k * e)", "sc"))
    q["vec_avg"] = f"""WITH lab AS ({LAB_EMB})
SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(x), {D}) AS avg
FROM (SELECT label, unnest(range(len(features))) AS dim, unnest(features) AS x FROM lab) GROUP BY label, dim"""

    q["sort_by_first"] = ("SELECT row_number() OVER (ORDER BY o_totalprice NULLS FIRST, o_orderkey) AS pos, "
                          "o_orderkey, o_totalprice FROM orders")
    q["sort_by_label"] = f"""WITH ev AS ({LAB_EV})
SELECT row_number() OVER (ORDER BY label NULLS FIRST, id) AS pos, id, label FROM ev"""

    base = f"WITH {split_ctes()},\n{per_class_cte('cb0', 'train')}"
    q["nearest"] = f"""{base},
{nearest_cte('nn', 'lab', 'cb0')}
SELECT id, code_id, code_label, round(d2, {D}) AS d2 FROM nn"""
    q["two_nearest"] = f"""{base},
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, code_id) AS rn FROM (
      SELECT l.id, c.code_id, c.code_label, {sqd('l.features', 'c.w')} AS d2 FROM lab l CROSS JOIN cb0 c))
SELECT i.id, i.code_id AS code_i, i.code_label AS label_i, round(i.d2, {D}) AS d2_i,
       j.code_id AS code_j, j.code_label AS label_j, round(j.d2, {D}) AS d2_j
FROM r i JOIN r j ON i.id = j.id AND i.rn = 1 AND j.rn = 2"""
    more = f"""WITH {split_ctes()},
{per_class_cte('cb0', 'train', C.MORE_PER_CLASS)},
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, code_id) AS rn FROM (
      SELECT l.id, c.code_id, c.code_label, {sqd('l.features', 'c.w')} AS d2 FROM lab l CROSS JOIN cb0 c))"""
    q["nearest_in_parts"] = f"""{more}
SELECT id, CAST(rn AS INTEGER) AS rank, code_id, code_label, round(d2, {D}) AS d2 FROM r WHERE rn <= {C.K_NEAREST}"""
    q["nearest_tree"] = f"""{more}
SELECT i.id, i.code_id AS code_i, i.code_label AS label_i, round(i.d2, {D}) AS d2_i,
       j.code_id AS code_j, j.code_label AS label_j, round(j.d2, {D}) AS d2_j
FROM r i JOIN r j ON i.id = j.id AND i.rn = 1 AND j.rn = 2"""
    q["som_step"] = f"""{base},
{som_ctes('cb1', 'cb0', 'train', C.SOM_RATE)}
{long_cb('cb1')}"""
    q["som_step_radius"] = f"""{base},
{som_ctes('cb1', 'cb0', 'train', C.SOM_RATE, radius=C.SOM_RADIUS)}
{long_cb('cb1')}"""
    q["som_step_within_class"] = f"""{base},
{som_ctes('cb1', 'cb0', 'train', C.SOM_RATE, within_class=True)}
{long_cb('cb1')}"""
    q["som_train_2"] = f"""{base},
{som_ctes('cb1', 'cb0', 'train', C.SOM_RATE)},
{som_ctes('cb2', 'cb1', 'train', C.SOM_RATE)}
{long_cb('cb2')}"""
    q["som_train_replicable"] = q["som_train_resumed"] = q["som_train_2"]
    q["vec_avg_exact"] = q["vec_avg"]
    q["bvq_window"] = f"""{base},
{bvq_pairs_ctes('b1', 'cb0', 'train')}
SELECT id, u AS label, ci AS code_i, cj AS code_j, round(gap, {D}) AS gap FROM b1_w"""
    q["bvq_step"] = f"""{base},
{bvq_ctes('cb1', 'cb0', 'train', C.BVQ_RATE)}
{long_cb('cb1')}"""
    q["bvq_step_replicable"] = q["bvq_step"]
    q["bvq_step_projection"] = f"""{base},
{bvq_ctes('cb1', 'cb0', 'train', C.BVQ_RATE, target='projection')}
{long_cb('cb1')}"""
    q["bvq_step_cost"] = f"""{base},
{bvq_ctes('cb1', 'cb0', 'train', C.BVQ_RATE, cost='abs')}
{long_cb('cb1')}"""
    q["bvq_train_2"] = f"""{base},
{bags_cte('bags', 'train', C.TRAIN_BAGS, C.TRAIN_BAG_SIZE)},
bag1 AS (SELECT id, label, features FROM bags WHERE bag = 1),
bag2 AS (SELECT id, label, features FROM bags WHERE bag = 2),
{bvq_ctes('cb1', 'cb0', 'bag1', C.BVQ_RATE)},
{bvq_ctes('cb2', 'cb1', 'bag2', C.BVQ_RATE)}
{long_cb('cb2')}"""
    pred = f"""{base},
{pred_cte('pr', 'test', 'cb0')}"""
    q["bvq_train_epochs"] = f"""{base},
{bags_cte('bags', 'train', 4, C.TRAIN_BAG_SIZE)},
{', '.join(f"bag{b} AS (SELECT id, label, features FROM bags WHERE bag = {b})" for b in range(1, 5))},
{', '.join(bvq_ctes(f'cb{b}', f'cb{b - 1}', f'bag{b}', C.BVQ_RATE) for b in range(1, 5))}
{long_cb('cb4')}"""
    q["predict"] = f"{pred}\nSELECT id, label, pred FROM pr"
    q["confusion"] = f"{pred}\nSELECT label AS actual, pred AS predicted, count(*) AS n FROM pr GROUP BY label, pred"
    cells = ", ".join(f"count(*) FILTER (WHERE pred = {c}) AS \"{c}\"" for c in C.EMB_CLASSES)
    known = ", ".join(map(str, C.EMB_CLASSES))
    q["confusion_matrix"] = (f"{pred}\nSELECT label AS actual, {cells}, "
                             f"count(*) FILTER (WHERE pred IS NULL OR pred NOT IN ({known})) AS other FROM pr GROUP BY label")
    q["accuracy"] = (f"{pred}\nSELECT round(avg(CASE WHEN label = pred THEN {dbl(1.0)} ELSE {dbl(0.0)} END), {D}) "
                     "AS accuracy FROM pr")
    q["mean_cost"] = (f"{pred}\nSELECT round(avg(CAST(abs(label - pred) AS DOUBLE)), {D}) AS mean_cost, "
                      "count(*) FILTER (WHERE label IS NULL OR pred IS NULL) AS n_unlisted FROM pr")
    stages = f"""{base},
{som_ctes('cb1', 'cb0', 'train', C.SOM_RATE)},
{bvq_ctes('cb2', 'cb1', 'train', C.BVQ_RATE)},
tr AS (SELECT 0 AS stage_idx, 'init' AS stage, * FROM cb0
       UNION ALL SELECT 1, 'som', * FROM cb1
       UNION ALL SELECT 2, 'bvq', * FROM cb2)"""
    q["codebook_trace"] = f"""{stages}
SELECT stage_idx, stage, code_id, code_label, CAST(dim AS INTEGER) AS dim, round(w, {D}) AS w
FROM (SELECT stage_idx, stage, code_id, code_label, unnest(range(len(w))) AS dim, unnest(w) AS w FROM tr)"""
    q["codebook_shift"] = f"""{stages},
lg AS (SELECT *, lag(w) OVER (PARTITION BY code_id ORDER BY stage_idx) AS prev FROM tr)
SELECT stage_idx, stage, code_id,
       CASE WHEN prev IS NULL THEN NULL ELSE round(sqrt({sqd('w', 'prev')}), {D}) END AS shift FROM lg"""
    parts = []
    for d in range(len(LINEITEM_FEATURES)):
        x = f"features[{d + 1}]"
        parts.append(f"""SELECT label, {d} AS dim, count(*) AS n, round(avg({x}), {D}) AS mean,
       round(stddev_pop({x}), {D}) AS std, round(min({x}), {D}) AS min, round(max({x}), {D}) AS max
FROM li GROUP BY label""")
    q["class_profile"] = f"WITH li AS ({_li_lab()})\n" + "\nUNION ALL\n".join(parts)
    q["classify_pipeline"] = f"""{base},
{som_ctes('cb1', 'cb0', 'train', C.SOM_RATE)},
{bvq_ctes('cb2', 'cb1', 'train', C.BVQ_RATE)},
{pred_cte('pr', 'test', 'cb2')}
SELECT label AS actual, pred AS predicted, count(*) AS n FROM pr GROUP BY label, pred"""
    per_class = " || ' ' || ".join(f"count(*) FILTER (WHERE pred = {c})" for c in C.EMB_CLASSES)
    q["run_report"] = f"""{base},
{som_ctes('cb1', 'cb0', 'train', C.SOM_RATE)},
{bvq_ctes('cb2', 'cb1', 'train', C.BVQ_RATE)},
{pred_cte('pr', 'test', 'cb2')}
SELECT 'train_rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM train
UNION ALL SELECT 'test_rows', CAST(count(*) AS VARCHAR) FROM test
UNION ALL SELECT 'codes', CAST(count(*) AS VARCHAR) FROM cb2
UNION ALL SELECT 'confusion_columns', '{" ".join(map(str, C.EMB_CLASSES))} other'
UNION ALL SELECT 'confusion_' || coalesce(CAST(label AS VARCHAR), 'None'), {per_class} || ' ' ||
  count(*) FILTER (WHERE pred IS NULL OR pred NOT IN ({known})) FROM pr GROUP BY label
UNION ALL SELECT 'accuracy', CAST(count(*) FILTER (WHERE label = pred) / count(*) AS VARCHAR) FROM pr
UNION ALL SELECT 'mean_cost', CAST(count(*) FILTER (WHERE label <> pred) / count(*) AS VARCHAR) FROM pr
  WHERE label IN ({known}) AND pred IN ({known})
UNION ALL SELECT 'unlisted_rows', CAST(count(*) FILTER (WHERE label IS NULL OR label NOT IN ({known}) OR pred IS NULL
  OR pred NOT IN ({known})) AS VARCHAR) FROM pr"""
    return q


ORACLE_SQL = build()
