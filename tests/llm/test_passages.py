import random

import pytest
from conftest_llm import by_id, prose, sha

from riskvq.llm import passages as P

SPACE = " \t\n\r\x0b\x0c"


def plain(rows):
    words = [(t or "").translate(str.maketrans(SPACE, " " * 6)).split(" ") for _, t in rows]
    words = [[w for w in ws if w] for ws in words]
    first = {}
    for (i, _), ws in zip(rows, words, strict=True):
        for j in range(len(ws) - 49 if i is not None else 0):
            k = tuple(ws[j:j + 50])
            first[k] = min(i, first.get(k, i))
    out = []
    for (i, _), ws in zip(rows, words, strict=True):
        gone = set()
        for j in range(len(ws) - 49 if i is not None else 0):
            if first[tuple(ws[j:j + 50])] < i:
                gone.update(range(j, j + 50))
        kept = " ".join(w for j, w in enumerate(ws) if j not in gone)
        out.append((i, len(ws), len(gone), sha(kept)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(11)
    passages = [prose(rng, n) for n in (49, 50, 51, 70, 120, 300)] + [" ".join(["of"] * 130), " ".join(["a", "b"] * 60)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages).split()
            a = rng.randrange(max(1, len(p) - 50))
            parts += [" ".join(p[a:]), prose(rng, rng.randrange(40))]
        rows.append((rng.randrange(1000), rng.choice([" ", "\n", "\x0b "]).join(parts)))
    long_word = "z" * 5000
    rows += [(2000 + i, prose(random.Random(3), 30) + f" {long_word} " + prose(random.Random(3), 60)) for i in range(3)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"HOT": 2}, {"HOT": 0}, {"LONGEST_RUN": 3}])
def test_equals_brute_force(documents, odd_rows, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(P, k, v)
    rows = odd_rows + corpus()
    assert by_id(P.remove_repeats(documents(rows))) == plain(rows)


def test_words_that_look_like_digests(documents):
    """A long word and a short one that spells its digest are different words."""
    import xxhash

    rng = random.Random(4)
    left, right, long = prose(rng, 30), prose(rng, 30), "y" * 100
    fake = "\0" + xxhash.xxh3_128_hexdigest(long.encode())
    rows = [(1, f"{left} {long} {right}"), (2, f"{left} {fake} {right}"), (3, f"{left} {long} {right}"),
            (4, " ".join(f"{c}" * 300 for c in "abcdefgh" * 20)), (5, " ".join(f"{c}" * 300 for c in "abcdefgh" * 20) + " z")]
    assert by_id(P.remove_repeats(documents(rows))) == plain(rows)
    assert plain(rows)[1][2] == 0


def test_kept_text(documents):
    rng = random.Random(2)
    p = prose(rng, 60)
    out = {r.doc_id: r for r in P.remove_repeats(documents([(1, p), (2, f"q {p} r"), (3, p), (4, "s t")]), with_text=True).collect()}
    assert (out[2].kept, out[3].kept, out[1].kept, out[4].kept) == ("q r", "", None, None)


def test_empty_table(documents):
    assert P.remove_repeats(documents([])).count() == 0


def test_super_kmers_cover_every_window():
    rng, hashes = random.Random(5), P.WordHashes()
    for n in (0, 49, 50, 51, 100, 700):
        words = prose(rng, n).encode().split()
        low, begin, length = P.super_kmers(words, hashes)
        assert length.sum() == max(0, n - 49) and (begin == [0, *length.cumsum()[:-1]][:len(begin)]).all()
        assert len(low) <= max(1, n // 8)
