import random
import re

import pytest
from conftest_llm import by_id, prose, sha

from riskvq.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(rows, items):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + k]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, ids = WORD.findall(lower(text)), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in windows:
                    hit.update(range(i, i + k))
                    ids |= windows[tuple(w[i:i + k])]
        ids = sorted(str(x) for x in ids if x is not None)
        out.append((doc, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [10**6, 40])
def test_equals_brute_force(spark, documents, odd_rows, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_CHARS", block)
    rng = random.Random(8)
    words = ["aa", "bb", "Cc", "dd1", "é", "Ünd"]
    items = [(i, prose(rng, n, words)) for i, n in enumerate((3, 9, 10, 11, 14, 25, 12, 2))]
    items += [(3, "something else altogether"), (None, prose(rng, 12, words)), (30, None), (31, "  ?! "), (32, items[4][1])]
    rows = [*odd_rows, *((100 + i, prose(rng, rng.randrange(60), words)) for i in range(60))]
    rows += [(200 + i, "Well-known: " + t.replace(" ", rng.choice([" ", ", ", "--", "\n"])).upper() + "!") for i, t in items[:7]]
    benchmark = spark.createDataFrame([(a, b, "z") for a, b in items], "item_id bigint, text string, _items string")
    out = D.find_contamination(documents(rows), benchmark)
    assert by_id(out.drop("spans")) == plain(rows, items)


def test_spans_point_into_the_original(spark, documents):
    item = "one two three four five six seven eight nine ten"
    text = "É! One, two;three FOUR five six seven (eight) nine ten. End"
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    r = D.find_contamination(documents([(1, text)]), benchmark).collect()[0]
    s, e = map(int, r.spans.split(":"))
    assert text[s:e] == "One, two;three FOUR five six seven (eight) nine ten" and r.n_hit == 10


def test_empty_tables(spark, documents, odd_rows):
    none = spark.createDataFrame([], "item_id bigint, text string")
    out = D.find_contamination(documents(odd_rows), none).collect()
    assert len(out) == len(odd_rows) and not any(r.contaminated for r in out)
    assert D.find_contamination(documents([]), none).count() == 0
