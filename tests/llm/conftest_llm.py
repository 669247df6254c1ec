import hashlib
import random

import pytest

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, _h int, score double, spans string"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def prose(rng, n, words=None):
    words = words or [a + b for a in ("ba", "ko", "li", "mu", "re", "só", "té") for b in ("n", "r", "st", "lo", "mi", "ü")]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture
def documents(spark):
    """Builds a documents table of (doc_id, text[, lang]) rows, with extra columns that clash with results."""
    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None if r[0] is None else f"s{r[0] % 3}",
                 None if r[1] is None else len(r[1]), "x", 1, 0.5, "y") for r in rows]
        return spark.createDataFrame(full, DOCUMENT)

    return build


@pytest.fixture
def odd_rows():
    """NULL, empty, blank, repeated, very long and awkward texts; NULL and repeated ids."""
    rng = random.Random(5)
    base = prose(rng, 120)
    return [(1, None), (2, ""), (3, "  \t\n "), (4, base), (4, base), (5, base), (None, base), (None, None), (6, "a"),
            (7, "Ünïcode     ﬀ K ſ 😀 \x1c\x1d"), (8, prose(rng, 30_000)), (9, "x" * 60_000), (10, " ".join(["of"] * 500)),
            (11, base.upper()), (12, prose(rng, 60) + " " + base)]


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
