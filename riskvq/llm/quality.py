"""Operator 2: quality classifier.

Tokens are words and marks of their shape (trailing signs, capitals, repeats),
hashed to a fixed number of buckets.  Random indexing gives each bucket a sparse
ternary index vector and sums those of its neighbours into a context vector; a
document is the mean of its tokens' vectors.  A two-layer network scores it, and
a temperature fitted on rows kept aside calibrates the probability.

Vectors and network are fitted on a bounded sample of labelled rows (``bound``
of ``fit_quality``).

Cases: NULL, empty and blank texts score as a text without tokens; without
usable labels, or with one class only, every score is the share of label 1
(1.0 without labels).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskvq.llm.common import arrow_rows, ddl, fold, forget, labelled_texts, map_texts, mix64, sample_of_labels

FOLDS, HELD = 5, 0
SAMPLE = 12_000  # labelled rows of a fit, about
BUCKETS, DIMS, NONZERO, SPAN = 8192, 64, 6, 2
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 0.01, 1e-4
THRESHOLD = 0.3
WORDS_KEPT = 200_000  # words whose buckets a Python worker remembers


def index_vectors() -> np.ndarray:
    """Per bucket a sparse ternary vector, from hashes alone."""
    out = np.zeros((BUCKETS, DIMS), np.int32)
    h = mix64(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(1)).reshape(BUCKETS, NONZERO)
    sign = np.where(h >> np.uint64(63), 1, -1).astype(np.int32)
    np.add.at(out, (np.arange(BUCKETS)[:, None], (h % np.uint64(DIMS)).astype(np.int64)), sign)
    return out


class Buckets(dict):
    """Word to the buckets of its word and shape tokens."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        core = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        tokens = ["w:" + core.lower()] if core else []
        rest = word[len(core):] if word.startswith(core) else word
        if len(rest) > 1 or not core:
            tokens.append("s:" + rest[:4])
            tokens.append("signs")
        if len(core) > 1 and core.isupper():
            tokens.append("capitals")
        found = tuple(zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in tokens)
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = found
        return found


REPEAT = zlib.crc32(b"repeat") % BUCKETS


def tokens_of(text: str, buckets: Buckets) -> np.ndarray:
    """Bucket ids of the text's tokens in order; a word like the one before it adds a repeat mark."""
    ids, last = [], None
    for w in text.split():
        ids += buckets[w]
        if w == last:
            ids.append(REPEAT)
        last = w
    return np.array(ids, dtype=np.int64)


def contexts(ids: np.ndarray, index: np.ndarray, into: np.ndarray) -> None:
    """Add to each token's bucket the index vectors of its neighbours within SPAN."""
    for d in range(1, SPAN + 1):
        if len(ids) > d:
            np.add.at(into, ids[d:], index[ids[:-d]])
            np.add.at(into, ids[:-d], index[ids[d:]])


def word_vectors(context: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Unit vectors: own index vector plus normalised context."""
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    own = index / np.maximum(np.linalg.norm(index, axis=1, keepdims=True), 1e-9)
    v = own + context / np.maximum(norm, 1e-9)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean of the tokens' vectors, computed from the counts of the distinct tokens."""
    if not len(ids):
        return np.zeros(DIMS, np.float32)
    distinct, counts = np.unique(ids, return_counts=True)
    return (counts.astype(np.float32) @ vectors[distinct]) / np.float32(len(ids))


def logits(net: dict, x: np.ndarray) -> np.ndarray:
    """Two layers: tanh, then a linear logit; inputs are standardised."""
    z = (x - net["mean"]) / net["scale"]
    return np.tanh(z @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"][0]


def probability(net: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits(net, x) / net["temperature"], -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> dict:
    """The network after EPOCHS of Adam on class-balanced log loss."""
    rng = np.random.default_rng(7)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    p = [rng.normal(0, 1 / math.sqrt(DIMS), (DIMS, HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(z)), max(4, len(z) // 256)):
            zi, yi, wi = z[part], y[part], weight[part]
            hid = np.tanh(zi @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(hid @ p[2] + p[3][0], -30, 30))) - yi) * wi / max(1, len(part))
            back = np.outer(err, p[2]) * (1 - hid * hid)
            grads = [zi.T @ back + DECAY * p[0], back.sum(0), hid.T @ err + DECAY * p[2], np.array([err.sum()])]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return {"mean": mean, "scale": scale, "w1": p[0], "b1": p[1], "w2": p[2], "b2": p[3], "temperature": 1.0}


def calibrate(net: dict, x: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on rows that the weights have not seen."""
    z = logits(net, x)

    def loss(t):
        q = np.clip(1 / (1 + np.exp(-np.clip(z / t, -30, 30))), 1e-9, 1 - 1e-9)
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    return float(min(np.geomspace(0.25, 8, 41), key=loss))


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> dict:
    """Word vectors and network, from about ``bound`` labelled rows outside the held-out fold."""
    rows = labelled_texts(docs, sample_of_labels(labels, "quality", FOLDS, HELD, bound, "quality"))

    def gather(batches):
        forget()
        index, into, buckets = index_vectors(), np.zeros((BUCKETS, DIMS), np.int32), Buckets()
        for b in batches:
            for text in b.column(0).to_pylist():
                contexts(tokens_of(text or "", buckets), index, into)
        used = np.flatnonzero(into.any(axis=1))
        if len(used):
            yield arrow_rows([used.tolist(), [into[i].tobytes() for i in used]], [("k", "bigint"), ("v", "binary")])

    def total(batches):
        into = np.zeros((BUCKETS, DIMS), np.int64)
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                into[k] += np.frombuffer(v, np.int32)
        used = np.flatnonzero(into.any(axis=1))
        if len(used):
            yield arrow_rows([used.tolist(), [into[i].tobytes() for i in used]], [("k", "bigint"), ("v", "binary")])

    context = np.zeros((BUCKETS, DIMS))
    # integer sums: the same in any order; at most BUCKETS rows reach the driver
    for r in (rows.select("text").mapInArrow(gather, "k bigint, v binary").repartition(8, "k")
              .mapInArrow(total, "k bigint, v binary").collect()):
        context[r.k] = np.frombuffer(r.v, np.int64)
    vectors = word_vectors(context, index_vectors())
    sent = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIMS numbers

    def measure(batches):
        buckets = Buckets()
        for b in batches:
            x = [pooled(tokens_of(t or "", buckets), sent.value).tobytes() for t in b.column(2).to_pylist()]
            if x:
                yield arrow_rows([b.column(0), b.column(1), x], fields)

    fields = [("doc_id", dict(docs.dtypes)["doc_id"]), ("y", "int"), ("x", "binary")]
    got = sorted(tuple(r) for r in rows.select("doc_id", "y", "text").mapInArrow(measure, ddl(fields)).collect())
    y = np.array([r[1] for r in got], float)
    if len(set(y)) < 2:
        return {"vectors": vectors, "network": None, "share": float(y.mean()) if len(y) else 1.0}
    x = np.stack([np.frombuffer(r[2], np.float32) for r in got]).astype(float)
    aside = np.array([zlib.crc32(f"aside:{r[0]}".encode()) % 6 == 0 for r in got])
    if min(len(set(y[aside])), len(set(y[~aside]))) < 2:
        aside = np.zeros(len(y), bool)
    net = train(x[~aside], y[~aside])
    if aside.any():
        net["temperature"] = calibrate(net, x[aside], y[aside])
    return {"vectors": vectors, "network": net, "share": float(y.mean())}


def score_quality(docs: DataFrame, model: dict, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Carried columns, score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIMS numbers and the small network

    def make():
        forget()
        buckets, vectors, net = Buckets(), sent.value["vectors"], sent.value["network"]

        def of_text(text):
            if net is None:
                p = sent.value["share"]
            else:
                p = float(probability(net, pooled(tokens_of(text, buckets), vectors)[None, :].astype(float))[0])
            return p, int(p >= THRESHOLD)

        return of_text

    return map_texts(docs, make, [("score", "double"), ("predicted", "int")], carry=carry)


def classify_quality(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = score_quality(docs, fit_quality(docs, labels, bound))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"),
                      "score", "predicted")
