import math
import random
import re

import numpy as np
import pytest
from conftest_llm import by_id, prose

from riskvq.llm import near_dup as N
from riskvq.llm.graph import components, local_roots


def word_sets(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        out.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    return out


def plain(rows):
    sets = word_sets(rows)
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            (i, s), (j, t) = (rows[a][0], sets[a]), (rows[b][0], sets[b])
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i)
                   for (i, _), s in zip(rows, sets, strict=True)), key=repr)


def corpus(n=12):
    rng = random.Random(4)
    rows, at = [], 100
    for _ in range(n):
        words = prose(rng, rng.randrange(6, 150)).split()
        for _ in range(rng.randrange(1, 7)):
            near = list(words)
            for _ in range(rng.randrange(3)):
                near[rng.randrange(len(near))] = f"x{rng.randrange(999)}"
            rows.append((at, " ".join(near)))
            at += rng.randrange(1, 4)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"NODE": 2, "BLOCK_ROWS": 3}, {"NODE": 1, "DEPTH": 1, "BLOCK_SHINGLES": 150, "PIVOTS": 0},
                                    {"NODE": 1, "DEPTH": 1, "BLOCK_ROWS": 2, "PIVOTS": 1}])
def test_equals_brute_force(documents, odd_rows, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(N, k, v)
    rows = corpus() + [r for r in odd_rows if r[0] != 4] + [(4, odd_rows[3][1])] * 2
    assert by_id(N.near_duplicates(documents(rows))) == plain(rows)


def test_one_large_group(documents):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(700):
        near = list(words)
        near[rng.randrange(120)] = f"y{i}"
        rows.append((i, " ".join(near)))
    out = N.near_duplicates(documents(rows)).collect()
    assert sum(r.kept for r in out) == 1 and {r.component_id for r in out} == {0}


def template(n, own=14, links=()):
    """Texts that share 80 words and have ``own`` of their own; text i also comes with one word more, for i in links."""
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(words + [f"y{i}_{j}" for j in range(own)])) for i in range(n)]
    return rows + [(n + i, rows[i][1] + " z") for i in links]


def test_texts_of_one_template_are_parted(documents, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 32)
    compared = []
    plain_blocks = N._dealt

    def dealt(rows):
        compared.append(rows.groupBy("grp", "x", "y").count().selectExpr("coalesce(sum(count * count), 0)").first()[0])
        return plain_blocks(rows)

    monkeypatch.setattr(N, "_dealt", dealt)
    rows = template(600, links=(3, 250, 599))
    sets = word_sets(rows[:2])
    assert 0.6 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.8
    assert by_id(N.near_duplicates(documents(rows))) == plain(rows)
    # blocks with their pivots, nothing for rests of one block, prefixes, and what they leave
    assert len(compared) == 4 and compared[1] == 0 and sum(compared) < 600 * 200 and compared[3] < 100


def test_prefixes_part_no_link(documents, monkeypatch):
    """Some links in a template of few words, where rare shingles are shared by many."""
    for k, v in {"BLOCK_ROWS": 8, "NODE": 4, "PIVOTS": 4}.items():
        monkeypatch.setattr(N, k, v)
    rng = random.Random(9)
    rows = []
    for i in range(160):
        words = [f"w{j}" for j in range(70)]
        for _ in range(rng.choice((1, 2, 4, 6))):
            words[rng.randrange(70)] = f"x{rng.randrange(6)}"
        rows.append((i, " ".join(words)))
    assert by_id(N.near_duplicates(documents(rows))) == plain(rows)


def test_kept_documents(documents, odd_rows):
    rows = [*odd_rows, (4, "another text of the same id")]
    docs = documents(rows)
    out = N.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    base = odd_rows[3][1]
    assert sum(t == base for _, t in got) == 2 and (4, base) in got and (None, base) in got
    assert {i for i, _ in got} == {None, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12} and len(got) == 14
    assert N.drop_near_duplicates(documents([])).count() == N.near_duplicates(documents([])).count() == 0


def test_rows_that_share_an_id_are_placed_by_their_text(documents):
    rng = random.Random(12)
    a, b = prose(rng, 100), prose(rng, 100)
    rows = [(3, a), (7, a + " more"), (7, b), (5, b + " end"), (9, prose(rng, 50)), (9, prose(rng, 50)), (7, b), (11, None),
            (11, ""), (11, "")]
    out = sorted(map(tuple, N.near_duplicates(documents(rows)).collect()))
    by = {(i, c): k for i, _, c, k in out}
    assert by[(3, 3)] and not by[(7, 3)] and not by[(7, 5)] and by[(5, 5)] and by[(9, 9)] and by[(11, 11)]
    assert sorted((i, c) for i, _, c, _ in out) == [(3, 3), (5, 5), (7, 3), (7, 5), (7, 5), (9, 9), (9, 9), (11, 11),
                                                    (11, 11), (11, 11)]
    kept = sorted((r.doc_id, r.text or "") for r in N.drop_near_duplicates(documents(rows)).collect())
    assert kept == sorted([(3, a), (5, b + " end"), *((i, t) for i, t in rows if i == 9), (11, ""), (11, "")])


def test_unique_texts_of_a_repeated_id_stay(documents):
    rng = random.Random(13)
    a, lone = prose(rng, 80), prose(rng, 80)
    rows = [(3, a), (7, a + " x"), (7, lone), (9, prose(rng, 70))]
    got = {(r.doc_id, r.text) for r in N.drop_near_duplicates(documents(rows)).collect()}
    assert got == {rows[0], rows[2], rows[3]}
    twice = [(4, a), (4, a + " x"), (4, a.replace("b", "B")), (4, a)]  # one group under one id: one of its texts stays
    assert N.drop_near_duplicates(documents(twice)).count() == 1


def test_a_hot_id_with_equal_and_other_texts(documents):
    rng = random.Random(14)
    a = prose(rng, 60)
    rows = [(1, a)] * 300 + [(1, prose(rng, 60)) for _ in range(20)] + [(2, a + " z"), (0, prose(rng, 9))]
    out = N.near_duplicates(documents(rows)).collect()
    assert len(out) == len(rows) and sum(not r.kept for r in out) == 1
    assert N.drop_near_duplicates(documents(rows)).count() == 22


def test_sketch_agrees_with_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    agree = []
    for _ in range(40):
        a, b = np.unique(rng.choice(base, 1500, replace=False)), np.unique(rng.choice(base, 1500, replace=False))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        agree.append((N.sketch(a) == N.sketch(b)).mean() - j)
    assert abs(np.mean(agree)) < 0.03 and np.std(agree) < 0.1


def test_intersections_of_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(30)]
    got = N._intersections(sets)
    assert all(i == j or got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30))


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(300, 300), (7, 3), (402, 401), (401, 400)]
    edges += [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(40)]
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    at = {x: i for i, x in enumerate(nodes)}
    pairs = np.array([(at[a], at[b]) for a, b in edges if a != b])
    root = local_roots(len(nodes), pairs[:, 0], pairs[:, 1])
    seen = {}
    for a, b in pairs:  # an independent closure
        merged = seen.get(a, {a}) | seen.get(b, {b})
        for x in merged:
            seen[x] = merged
    assert all(root[i] == min(seen[i]) for i in range(len(nodes)))
    out = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {x: nodes[root[at[x]]] for x in nodes}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_chance_to_miss_a_link():
    """Two classes of similarity 0.85 agree in a coordinate with that chance; simulate the trees."""
    rng = np.random.default_rng(2)
    missed, trials = 0, 2000
    for _ in range(trials):
        a = rng.integers(0, 2**32, N.COORDINATES, dtype=np.uint32)
        b = np.where(rng.random(N.COORDINATES) < 0.85, a, rng.integers(0, 2**32, N.COORDINATES, dtype=np.uint32))
        nodes = [N.mix64(np.array([t + 1], np.uint64))[0] for t in range(N.TREES)]
        for _ in range(N.DEPTH):
            both = []
            for node in nodes:
                i, keys = N.branches(np.full(2, node), np.stack([a, b]))
                both += list(set(keys[i == 0].tolist()) & set(keys[i == 1].tolist()))
            nodes = [np.uint64(x) for x in both]
        missed += not nodes
    assert missed / trials < 0.01 and math.isfinite(missed)


def test_deeper_levels_and_later_rounds_move_large_groups_only(documents, monkeypatch):
    """Sketches of classes outside large nodes, and texts of groups compared whole, are not dealt out again."""
    monkeypatch.setattr(N, "NODE", 4)
    monkeypatch.setattr(N, "BLOCK_ROWS", 8)
    monkeypatch.setattr(N, "PIVOTS", 1)
    sketches, dealt, settled, deal = [], [], N.settled, N._dealt

    def settle(df):
        out = settled(df)
        if out.columns == ["id", "sketch"]:
            sketches.append(out.count())
        return out

    def dealing(rows):
        dealt.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return deal(rows)

    monkeypatch.setattr(N, "settled", settle)
    monkeypatch.setattr(N, "_dealt", dealing)
    rng = random.Random(8)
    rows = template(24) + [(i, prose(rng, 40)) for i in range(100, 160)]
    rows += [(i + 100, t + " end") for i, t in rows if i >= 100]
    assert by_id(N.near_duplicates(documents(rows))) == plain(rows)
    assert sketches and max(sketches) <= len(rows) // 2
    assert len(dealt) > 1
    for plan in dealt[1:]:
        texts = [line for line in plan.splitlines() if "Relation [" in line]
        assert texts and len(re.findall(r"Filter .*\(b#\d+ > 1\)", plan)) >= len(texts)
