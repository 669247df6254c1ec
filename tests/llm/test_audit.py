import random
from itertools import permutations

import numpy as np
from conftest_llm import prose

from riskvq.llm import audit as A

LABELS = "doc_id bigint, quality int, toxic int, part string, failed int"


def plain(rows, labels):
    """All orders by applying the filters one after the other."""
    out = []
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    docs = []
    least = {}
    for i, text, source in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, source in rows:
        text = text or ""
        words = text.encode().split()
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text),
                 "E": i is not None and least[text] < i}
        docs.append((source or "", fails, i in good, i in toxic))
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        per, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                after = [d for d in left if not d[1][f]]
                failing = sum(d[1][f] for d in own)
                only = sum(d[1][f] and sum(d[1].values()) == 1 for d in own)
                per.append((part, "".join(order), step, len(after), len(gone), failing - len(gone), only,
                            sum(d[2] for d in gone), sum(d[3] for d in gone), f))
                total[f] += len(gone)
                left = after
        out += [(*p[:9], total[p[9]]) for p in per]
    return sorted(out)


def test_potential_gives_shapley_of_any_game():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 5):
        game = rng.integers(0, 1000, 2**n)
        game[0] = 0
        p = A.potentials(game[None])[0]
        total = np.zeros(n, np.int64)
        for order in permutations(range(n)):
            s = 0
            for i in order:
                total[i] += game[s | 1 << i] - game[s]
                s |= 1 << i
        full = 2**n - 1
        assert [p[full] - p[full ^ (1 << i)] for i in range(n)] == total.tolist()


def test_equals_plain_orders(spark, odd_rows):
    rng = random.Random(8)
    texts = [prose(rng, 250), prose(rng, 250) + " #", "A " * 300, prose(rng, 250).upper(), "x y " * 400, prose(rng, 20),
             prose(rng, 300) + " $5", "", None]
    rows = [(i, t, f"s{(i or 0) % 3}" if i != 8 else None) for i, t in odd_rows]
    rows += [(100 + k, rng.choice(texts), rng.choice(["hot", "hot", "hot", "s1", "", None])) for k in range(300)]
    rows += [(100, texts[0], "hot"), (90, texts[0], "s1"), (None, texts[0], "hot")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(80, 300)]
    labels += [(120, 1, 0), (120, 0, 1), (120, 0, 0), (None, 1, 1), (5000, 1, 1)]
    docs = spark.createDataFrame([(*r, "en", 1, 2, 3, b"d") for r in rows],
                                 "doc_id bigint, text string, source string, lang string, failed int, part int, good int, digest binary")
    marks = spark.createDataFrame([(*r, "x", 1) for r in labels], LABELS)
    got = sorted(tuple(r) for r in A.audit_filters(docs.repartition(5), marks).collect())
    assert got == plain(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    unlabelled = sorted(tuple(r) for r in A.audit_filters(docs, marks.limit(0)).collect())
    assert unlabelled == plain(rows, [])
    assert A.audit_filters(docs.limit(0), marks).count() == 0
