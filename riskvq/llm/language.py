"""Operator 6: language identification with hyperdimensional profiles.

Every character has a random bipolar vector, made from a hash of its code point.
An n-gram vector binds (multiplies) the vectors of its characters, each rotated
by its place; a document bundles (adds) the vectors of its n-grams; a language's
prototype bundles the signs of its documents.  A document gets the language of
the highest cosine, after the part common to all prototypes is taken out.

Prototypes are learned from at most about ``per_language`` documents of each
language, drawn by a keyed hash; rarer languages are used whole.  Every language
that has a learnable text gets one.  More than LANGUAGES of them are compared
block by block, each document carrying its vector and best language so far.

Cases: texts that are NULL or have no letter (Unicode category L) get ``und`` and
score 0; so do all texts if nothing could be learned; equal cosines go to the
first name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskvq.llm.common import arrow_rows, checkpointed, ddl, fold, map_texts, mix64, per_process, sliced
from riskvq.llm.graph import runs

FOLDS, HELD = 4, 2
DIMS = 512
PER_LANGUAGE = 3000
LANGUAGES = 4000       # prototypes that a task holds at a time, DIMS numbers each
BROADCAST_NAMES = 100_000
GRAMS_KEPT = 40_000    # n-gram vectors kept by a Python worker
_GAPS = re.compile(r"[\W\d_]+")


def character_vectors(codes: np.ndarray) -> np.ndarray:
    """Bipolar vectors (int8) of code points."""
    words = mix64((codes.astype(np.uint64)[:, None] << np.uint64(16)) + np.arange(DIMS // 64, dtype=np.uint64)[None, :]
                  + np.uint64(0x5851F42D))
    bits = np.unpackbits(words.view(np.uint8).reshape(len(codes), DIMS // 8), axis=1)
    return (bits.astype(np.int8) << 1) - 1


class Profiler:
    """Document vectors; n-gram vectors are made once in a Python worker and kept until there are too many."""

    def __init__(self):
        self.vectors = np.empty((GRAMS_KEPT, DIMS), np.float32)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)                  # sorted n-gram keys
        self.slots = np.zeros(0, np.int64)                  # the row of vectors of each

    def gram_vectors(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of distinct keys, at most GRAMS_KEPT of them."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            if len(self.keys) + np.count_nonzero(~known) > GRAMS_KEPT:
                self.forget()
                known[:] = False
            new = keys[~known]
            slots = np.arange(len(self.keys), len(self.keys) + len(new))
            self.vectors[slots] = self.bind(new)
            order = np.argsort(np.concatenate([self.keys, new]), kind="stable")
            self.keys = np.concatenate([self.keys, new])[order]
            self.slots = np.concatenate([self.slots, slots])[order]
            at = np.searchsorted(self.keys, keys)
        return self.vectors[self.slots[at]]

    @staticmethod
    def bind(keys: np.ndarray) -> np.ndarray:
        """Three 21-bit code points to a key; the vectors, rotated by place, are multiplied."""
        mask = np.uint64((1 << 21) - 1)
        parts = [character_vectors((keys >> np.uint64(s)) & mask) for s in (42, 21, 0)]
        return reduce(np.multiply, [np.roll(v, 2 - i, axis=1) for i, v in enumerate(parts)]).astype(np.float32)

    def profile(self, text: str) -> np.ndarray | None:
        """The document vector; None without a letter."""
        plain = _GAPS.sub(" ", text.lower()).strip()
        if not any(map(str.isalpha, plain)):
            return None
        codes = np.frombuffer(f"  {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        keys, counts = np.unique((codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:],
                                 return_counts=True)
        out, step = np.zeros(DIMS, np.float64), min(8192, GRAMS_KEPT)
        for i in range(0, len(keys), step):
            out += counts[i:i + step].astype(np.float32) @ self.gram_vectors(keys[i:i + step])
        return out


def fit_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, v): the bundled signs of each language's documents, DIMS whole numbers."""
    usable = docs.select("doc_id", "lang", "text").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
        & F.coalesce(fold(F.col("doc_id"), FOLDS) != HELD, F.lit(False)))
    # only frequent languages are drawn from: at most rows / per_language names
    frequent = usable.groupBy("lang").count().where(F.col("count") > per_language).collect()
    if frequent:
        limits = docs.sparkSession.createDataFrame(
            [(r["lang"], int(per_language / r["count"] * 2**32)) for r in frequent], "lang string, below bigint")
        usable = usable.join(F.broadcast(limits) if len(frequent) <= BROADCAST_NAMES else limits, "lang", "left")
        usable = usable.where(F.col("below").isNull()
                              | (F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(2**32)) < F.col("below")))

    def bundle(batches):
        profiler, sums = per_process("language", (DIMS, GRAMS_KEPT), Profiler), {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = profiler.profile(text)
                if v is not None:
                    if len(sums) >= LANGUAGES and lang not in sums:
                        yield packed(sums)
                        sums = {}
                    sums[lang] = sums.get(lang, 0) + np.sign(v).astype(np.int64)
        if sums:
            yield packed(sums)

    def packed(sums):
        return arrow_rows([[*sums], [v.tobytes() for v in sums.values()]], BUNDLE)

    def total(batches):
        for (lang,), (raws,) in runs(batches, 1):
            yield arrow_rows([[lang], [sum(np.frombuffer(r, np.int64) for r in raws).tobytes()]], BUNDLE)

    # a row a language and task
    return checkpointed(usable.select("lang", "text").mapInArrow(bundle, ddl(BUNDLE)).repartition("lang")
                        .sortWithinPartitions("lang").mapInArrow(total, ddl(BUNDLE)))


BUNDLE = [("lang", "string"), ("v", "binary")]


def unit_rows(raws: list[bytes]) -> np.ndarray:
    out = np.stack([np.frombuffer(r, np.int64) for r in raws]).astype(np.float64)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def prototypes(bundles: DataFrame, block: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """Names and centred unit prototypes in order of name, ``block`` languages at a time on the driver."""
    def summed(batches):
        s, n = np.zeros(DIMS), 0
        for b in batches:
            if b.num_rows:
                s, n = s + unit_rows(b.column(1).to_pylist()).sum(axis=0), n + b.num_rows
        if n:
            yield arrow_rows([[n], [s.tolist()]], [("n", "bigint"), ("s", "array<double>")])

    parts = sorted((tuple(r.s), r.n) for r in bundles.mapInArrow(summed, "n bigint, s array<double>").collect())
    n = sum(k for _, k in parts)
    mean = sum((np.array(s) for s, _ in parts), np.zeros(DIMS)) / max(1, n)
    names, raws = [], []

    def done():
        out = unit_rows(raws)
        if n > 1:  # what all languages share says nothing
            out = out - mean
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        return names, out

    for r in bundles.orderBy("lang").toLocalIterator():
        names.append(r.lang)
        raws.append(r.v)
        if len(names) == block:
            yield done()
            names, raws = [], []
    if names:
        yield done()


def _score(cos: float) -> float:
    return float(min(1.0, max(0.0, (1 + cos) / 2)))


def predict_language(docs: DataFrame, bundles: DataFrame, carry: tuple[str, ...] = ("doc_id",),
                     block: int | None = None) -> DataFrame:
    """Carried columns, lang_pred and score (the cosine, mapped to 0 to 1)."""
    block = block or LANGUAGES
    sc = docs.sparkSession.sparkContext
    if bundles.count() <= block:
        sent = sc.broadcast(next(prototypes(bundles, block), ([], np.zeros((0, DIMS)))))  # at most LANGUAGES x DIMS numbers

        def make():
            profiler = per_process("language", (DIMS, GRAMS_KEPT), Profiler)
            names, protos = sent.value

            def of_text(text):
                v = profiler.profile(text) if names else None
                if v is None:
                    return "und", 0.0
                cos = protos @ v / max(np.linalg.norm(v), 1e-9)
                i = int(np.argmax(cos))
                return names[i], _score(cos[i])

            return of_text

        return map_texts(docs, make, [("lang_pred", "string"), ("score", "double")], carry=carry)

    def vectors():
        profiler = per_process("language", (DIMS, GRAMS_KEPT), Profiler)

        def of_text(text):
            v = profiler.profile(text)
            return (None if v is None else (v / max(np.linalg.norm(v), 1e-9)).tobytes(), "und", None)

        return of_text

    kept = [(c, t) for c, t in docs.select(*carry).dtypes]
    fields = [("_vector", "binary"), ("lang_pred", "string"), ("_cos", "double")]
    state = checkpointed(map_texts(docs, vectors, fields, carry=carry))
    n = len(kept)

    def compared(part):
        sent = sc.broadcast(part)

        def run(batches):
            names, protos = sent.value
            for b in sliced(batches):
                best, cosines = b.column(n + 1).to_pylist(), b.column(n + 2).to_pylist()
                at = [i for i, v in enumerate(b.column(n).to_pylist()) if v is not None]
                if at:
                    v = np.stack([np.frombuffer(b.column(n)[i].as_py()) for i in at])
                    cos = v @ protos.T
                    for i, j, c in zip(at, cos.argmax(axis=1).tolist(), cos.max(axis=1).tolist(), strict=True):
                        if cosines[i] is None or c > cosines[i]:
                            best[i], cosines[i] = names[j], c
                yield arrow_rows([*b.columns[:n + 1], best, cosines], kept + fields)

        return run

    for part in prototypes(bundles, block):
        state = checkpointed(state.mapInArrow(compared(part), ddl(kept + fields)))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 + F.col("_cos")) / 2))
    return state.select(*carry, "lang_pred", F.coalesce(score, F.lit(0.0)).alias("score"))


def identify_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    out = predict_language(docs, fit_languages(docs, per_language))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"),
                      "lang_pred", "score")
