"""Operator 5: toxicity by a weighted lexicon.

Texts are folded (case, full-width letters, look-alike letters of other
scripts, digits that stand for letters) and matched once by an Aho-Corasick
automaton of whole words and word beginnings.  Each matched word adds the weight
of its longest entry, unless the word and a neighbour form an exception phrase;
the sum is normalised by the number of words and turned into a probability.

Weights, exceptions and the last step are fitted on a bounded sample of
labelled rows (``bound`` of ``fit_toxicity``); lexicon and phrases hold what
those rows show and have no bound of their own.

Cases: NULL, empty and wordless texts score as a text without matches; without
usable labels every score is 0.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskvq.llm.common import arrow_rows, checkpointed, ddl, fold, labelled_texts, map_texts, sample_of_labels

FOLDS, HELD = 4, 2
SAMPLE = 16_000       # labelled rows of a fit, about
PREFIX = range(3, 11)  # lengths of word beginnings that may be entries
MIN_TOXIC, MIN_WEIGHT = 3, 1.0
SURE = 1.64            # a weight is its log odds less so many standard errors
ASIDE = 3              # one in so many sampled rows fits the last step, the others the lexicon
THRESHOLD = 0.3

# Letters of other scripts (Cyrillic, Greek, Armenian, Cherokee, Lisu, phonetic and small capitals) that
# look like a Latin letter, by that letter; and digits and signs written for letters.
LOOKALIKES = {"a": "аαɑᴀꓮᎪ", "b": "вβʙᏴꓐ", "c": "сϲᴄⅽᏟꓚ", "d": "ԁᴅꓓᎠժ", "e": "еεёєᴇᎬꓰҽ", "f": "ϝꜰꓝƒ", "g": "ɡɢԍꓖᏀց", "h": "нһʜᎻꓧհ",
              "i": "іιїɩıᎥɪꙇ", "j": "јϳᴊᎫꓙյ", "k": "кκᴋᏦꓗ", "l": "ӏʟᏞꓡⅼ", "m": "мᴍᎷꓟϻ", "n": "ոպηɴꓠп", "o": "оοσօᴏꓳ",
              "p": "рρᴘᏢꓑ", "q": "ԛզɋ", "r": "гʀᏒꓣᴦ", "s": "ѕꜱꓢᏚʂ", "t": "тτᴛᎢꓔ", "u": "υսᴜꓴʋ", "v": "νѵᴠᏙꓦ", "w": "ԝωᴡᎳꓪѡ",
              "x": "хχꓫⅹ", "y": "уγүʏᎩꓬ", "z": "ᴢᏃꓜʐ"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


def folding() -> dict[int, str]:
    """Code point to folded character; ASCII that is no letter becomes a blank."""
    table = {c: chr(c).lower() if chr(c).isalpha() else " " for c in range(128)}
    table |= {ord(a): b for a, b in DIGITS.items()}
    # letters in another dress (bold, circled, full-width, raised ...): those that decompose to one ASCII letter or digit
    for first, last in ((0xAA, 0xBA), (0x2070, 0x24FF), (0x3250, 0x33FF), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0x1F100, 0x1F1FF)):
        for c in range(first, last + 1):
            plain = unicodedata.normalize("NFKD", chr(c)).strip("()")
            if len(plain) == 1 and plain.isascii() and plain.isalnum():
                table[c] = table[ord(plain)]
    for latin, others in LOOKALIKES.items():
        for c in others:
            for form in (c, c.upper(), c.lower()):
                if len(form) == 1 and not form.isascii():
                    table[ord(form)] = latin
    return {c: chr(c).lower() for c in range(0xC0, 0x17F) if len(chr(c).lower()) == 1} | table


_FOLD = folding()


def folded(text: str) -> str:
    """The folded text between two blanks."""
    return f" {text.translate(_FOLD)} "


def entries_of(word: str) -> list[str]:
    """Entries that would match the word: the word itself and its beginnings."""
    return [f" {word} ", *(f" {word[:n]}" for n in PREFIX if n <= len(word))]


class Matcher:
    def __init__(self, lexicon: dict[str, float], exceptions: frozenset):
        import ahocorasick

        self.exceptions = exceptions
        self.automaton = ahocorasick.Automaton()
        for e, w in lexicon.items():
            self.automaton.add_word(e, (len(e), w))
        if lexicon:
            self.automaton.make_automaton()

    def matched(self, text: str) -> tuple[dict[int, float], str]:
        """Weight by the position where a matched word starts, longest entry first; the folded text."""
        plain = folded(text)
        by_start: dict[int, float] = {}
        if len(self.automaton):
            for end, (n, w) in self.automaton.iter(plain):  # entries of one word come shortest first
                by_start[end - n + 1] = w
        return by_start, plain

    def around(self, plain: str, start: int) -> tuple[str, str]:
        """The word at a match with the word before it, and with the word after it."""
        end = plain.find(" ", start + 1)
        word = plain[start + 1:end]
        stop = start
        while stop > 0 and plain[stop - 1] == " ":
            stop -= 1
        before = plain[plain.rfind(" ", 0, stop) + 1:stop] if stop else ""
        begin = end
        while begin < len(plain) and plain[begin] == " ":
            begin += 1
        after = plain[begin:plain.find(" ", begin)] if begin < len(plain) else ""
        return f"{before} {word}", f"{word} {after}"

    def measures(self, text: str) -> tuple[float, float, float]:
        """Sum of the weights, the sum per word, and the largest weight."""
        by_start, plain = self.matched(text)
        weights = [w for s, w in by_start.items()
                   if not self.exceptions or not self.exceptions.intersection(self.around(plain, s))]
        if not weights:
            return 0.0, 0.0, 0.0
        return sum(weights), sum(weights) / max(1, len(plain.split())), max(weights)


def features(total, per_word, largest) -> np.ndarray:
    return np.stack([np.log1p(total), np.log1p(100 * np.asarray(per_word)), np.asarray(largest) / 4], axis=-1)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 0.02) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w


def weight(t: int, c: int, toxic: int, clean: int) -> float:
    """Lower confidence bound of an entry's log odds."""
    return (math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
            - SURE * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)))


def lexicon_of(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weights by entry; an entry that says no more than a shorter beginning of it is left out."""
    weights = {e: weight(t, c, toxic, clean) for e, t, c in counts}
    kept: dict[str, float] = {}
    for e in sorted(weights, key=lambda e: (len(e), e)):
        if weights[e] < MIN_WEIGHT:
            continue
        shorter = next((e[:n] for n in range(len(e) - 1, 3, -1) if e[:n] in kept), None)
        if shorter is None or weights[e] > weights[shorter] + 0.5:
            kept[e] = weights[e]
    return kept


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> dict:
    """Lexicon, exception phrases and weights, from about ``bound`` labelled rows outside the held-out fold."""
    sample = sample_of_labels(labels, "toxic", FOLDS, HELD, bound, "toxic")
    rows = labelled_texts(docs, sample).withColumn(
        "aside", F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(ASIDE)) == 0)

    def count(batches):
        tox, clean, n = Counter(), Counter(), [0, 0]
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[bool(y)] += 1
                (tox if y else clean).update({e for w in set(folded(text or "").split()) for e in entries_of(w)})
        keys = ["", *(tox.keys() | clean.keys())]
        if sum(n):
            yield arrow_rows([keys, [n[1], *(tox[k] for k in keys[1:])], [n[0], *(clean[k] for k in keys[1:])]],
                             [("e", "string"), ("t", "bigint"), ("c", "bigint")])

    counts = checkpointed(rows.where(~F.col("aside")).select("y", "text").mapInArrow(count, "e string, t bigint, c bigint")
                          .groupBy("e").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    toxic, clean = next(((r.t, r.c) for r in counts.where("e = ''").collect()), (0, 0))
    # only entries that may weigh enough come to the driver; lexicon_of weighs them again
    weighty = (F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
               - SURE * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)))
    top = counts.where((F.col("e") != "") & (F.col("t") >= MIN_TOXIC) & (weighty >= MIN_WEIGHT - 1e-6)).collect()
    lexicon = lexicon_of([(r.e, r.t, r.c) for r in top], toxic, clean)

    def phrases(batches):
        m, seen = Matcher(lexicon, frozenset()), Counter()
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by_start, plain = m.matched(text or "")
                seen.update({(p, bool(y)) for s in by_start for p in m.around(plain, s)})
        if seen:
            yield arrow_rows([[p for p, _ in seen], [n * y for (_, y), n in seen.items()],
                              [n * (not y) for (_, y), n in seen.items()]],
                             [("p", "string"), ("t", "bigint"), ("c", "bigint")])

    # phrases that at least three clean and no toxic rows of the sample use, aside rows included
    exceptions = frozenset(r.p for r in rows.select("y", "text").mapInArrow(phrases, "p string, t bigint, c bigint")
                           .groupBy("p").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
                           .where("t = 0 and c >= 3").collect())
    model = {"lexicon": lexicon, "exceptions": exceptions, "w": None}

    def measure(batches):
        m = Matcher(lexicon, exceptions)
        for b in batches:
            got = [m.measures(t or "") for t in b.column(2).to_pylist()]
            if got:
                yield arrow_rows([b.column(0), b.column(1), *map(list, zip(*got, strict=True)), b.column(3)], fields)

    fields = [("doc_id", dict(docs.dtypes)["doc_id"]), ("y", "int"), ("a", "double"), ("b", "double"), ("c", "double"),
              ("aside", "boolean")]
    got = sorted(tuple(r) for r in rows.select("doc_id", "y", "text", "aside").mapInArrow(measure, ddl(fields)).collect())
    # rows that the lexicon has not seen, if they hold both labels
    got = [r for r in got if r[5]] if len({r[1] for r in got if r[5]}) == 2 else got
    if got:
        x = np.array([r[1:5] for r in got], dtype=float)
        model["w"] = logistic(features(*x[:, 1:].T), x[:, 0])
    return model


def score_toxicity(docs: DataFrame, model: dict, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Carried columns, score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # what the bounded sample holds

    def make():
        m, w = Matcher(sent.value["lexicon"], sent.value["exceptions"]), sent.value["w"]

        def of_text(text):
            if w is None:
                return 0.0, 0
            z = float(features(*m.measures(text)) @ w[:-1] + w[-1])
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            return p, int(p >= THRESHOLD)

        return of_text

    return map_texts(docs, make, [("score", "double"), ("predicted", "int")], carry=carry)


def classify_toxicity(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = score_toxicity(docs, fit_toxicity(docs, labels, bound))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"),
                      "score", "predicted")
