"""Operator 7: repeated passages by super-k-mer partitioning.

A window is 50 consecutive words.  Its minimiser is the smallest hash of its
8-word grams; consecutive windows with one minimiser form a super-k-mer, which
travels as one packed string to the bucket of its minimiser.  In a bucket the
windows are sorted, so equal word sequences meet and the smallest doc_id of each
is known; windows of larger ids are repeats and cover words to remove.

Before any text travels, minimisers alone (a few bytes per super-k-mer) tell
which of them occur in two documents; only those super-k-mers are packed.
Documents of equal word sequences are settled by their digest: the smallest id
stands for them, the others lose every word that a window covers.  Buckets of
more than HOT super-k-mers are not sorted in one task: their windows are
digested (128 bits) and aggregated by digest with partial sums.

Cases: NULL and empty texts have no words; texts of fewer than 50 words lose
none; rows that share a doc_id do not remove each other; rows without doc_id
are left as they are and remove nothing.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskvq.llm.common import EMPTY_SHA, arrow_rows, checkpointed, ddl, map_texts, mix64, settled, sha_hex, sliced
from riskvq.llm.graph import runs
from riskvq.session import ensure_checkpoint_dir

WINDOW, GRAM = 50, 8
LONGEST_RUN = 256      # windows of a super-k-mer; longer runs are cut
HOT = 2000             # super-k-mers of a bucket that one task sorts
WORDS_KEPT = 200_000   # words whose hashes a Python worker remembers
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

FIELDS = [("n_words", "bigint"), ("own_sha256", "string"), ("sig", "bigint"),
          ("minimisers", "array<bigint>"), ("starts", "array<int>")]


class WordHashes(dict):
    """64-bit hash by word; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def super_kmers(words: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each super-k-mer."""
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    grams = np.zeros(len(words) - GRAM + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(GRAM):
            grams = (grams + h[i:len(words) - GRAM + 1 + i]) * _MULTIPLIER
    low, k = mix64(grams), 1
    span = WINDOW - GRAM + 1
    while 2 * k <= span:  # minima of runs of k grams
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    if k < span:
        low = np.minimum(low[:-(span - k)], low[span - k:])
    begin = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    length = np.diff(np.concatenate([begin, [n]]))
    if length.max() > LONGEST_RUN:
        cuts = [np.arange(b, b + c, LONGEST_RUN) for b, c in zip(begin, length, strict=True)]
        begin = np.concatenate(cuts)
        length = np.diff(np.concatenate([begin, [n]]))
    return low[begin].view(np.int64), begin, length


def _signature(words: list[bytes]) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def _make_features():
    hashes = WordHashes()

    def of_text(text):
        words = words_of(text)
        joined = b" ".join(words)
        low, begin, _ = super_kmers(words, hashes)
        return len(words), sha_hex(joined), _signature(words), low.tolist(), begin.tolist()

    return of_text


def packed(words: list[bytes]) -> bytes:
    """Whole words joined by blanks, which no word holds."""
    return b" ".join(words)


def _windows(raw: bytes) -> list[bytes]:
    """The windows of a packed super-k-mer."""
    at = [0]
    for w in raw.split(b" "):
        at.append(at[-1] + len(w) + 1)
    return [raw[at[i]:at[i + WINDOW] - 1] for i in range(len(at) - WINDOW)]


def numbered_windows(raw: bytes, numbers: dict[bytes, int]) -> list[bytes]:
    """The windows of a packed super-k-mer as word numbers of four bytes: equal where the words are, however long."""
    words = raw.split(b" ")
    line = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32).tobytes()
    return [line[4 * i:4 * (i + WINDOW)] for i in range(len(words) - WINDOW + 1)]


def _pack(hot: bool):
    """Rows (doc_id, sig, text, starts, hots) to packed super-k-mers, or to digests of the windows of hot ones."""
    def run(batches):
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                out: list[tuple] = []
                for doc, sig, text, starts, hots in zip(*(c.to_pylist() for c in batch.slice(s, 200).columns), strict=True):
                    words = words_of(text)
                    if _signature(words) != sig:
                        continue  # another text of the same doc_id
                    wanted = {a for a, x in zip(starts, hots, strict=True) if x == hot}
                    for low, a, n in zip(*(x.tolist() for x in super_kmers(words, hashes)), strict=True):
                        if a in wanted:
                            raw = packed(words[a:a + n + WINDOW - 1])
                            if hot:
                                out += [(xxhash.xxh3_128_digest(w), doc, sig, a + i) for i, w in enumerate(_windows(raw))]
                            else:
                                out.append((low, doc, sig, a, raw))
                if out:
                    yield arrow_rows([list(c) for c in zip(*out, strict=True)], HOT_FIELDS if hot else PACKED_FIELDS)

    return run


PACKED_FIELDS = [("bucket", "bigint"), ("doc_id", "bigint"), ("sig", "bigint"), ("start", "int"), ("packed", "binary")]
HOT_FIELDS = [("digest", "binary"), ("doc_id", "bigint"), ("sig", "bigint"), ("start", "int")]
SPAN_FIELDS = [("doc_id", "bigint"), ("sig", "bigint"), ("a", "int"), ("b", "int")]


def _sort_buckets(batches):
    """Rows (bucket, doc_id, sig, start, packed) sorted by bucket to word spans [a, b) of repeats."""
    out: list[tuple] = []
    for _, (docs, sigs, starts, raws) in runs(batches, 1):
        if min(docs) == max(docs):
            continue
        same: dict[bytes, list[int]] = {}
        for i, raw in enumerate(raws):
            same.setdefault(raw, []).append(i)
        least = {raw: min(docs[i] for i in at) for raw, at in same.items()}
        first = {}  # smallest id by window, for each distinct string
        if len(same) == 1:
            first = {raw: None for raw in same}
        else:
            numbers: dict[bytes, int] = {}
            entries = sorted((w, least[raw], k, i) for k, raw in enumerate(same)
                             for i, w in enumerate(numbered_windows(raw, numbers)))
            lows = [[0] * (raw.count(b" ") + 2 - WINDOW) for raw in same]
            last, low = None, 0
            for w, doc, k, i in entries:
                if w != last:
                    last, low = w, doc
                lows[k][i] = low
            first = dict(zip(same, lows, strict=True))
        for raw, at in same.items():
            n = raw.count(b" ") + 2 - WINDOW
            for j in at:
                doc, start = docs[j], starts[j]
                if first[raw] is None:
                    if doc > least[raw]:
                        out.append((doc, sigs[j], start, start + n + WINDOW - 1))
                    continue
                i = 0
                while i < n:
                    if first[raw][i] < doc:
                        e = i + 1
                        while e < n and first[raw][e] < doc:
                            e += 1
                        out.append((doc, sigs[j], start + i, start + e + WINDOW - 1))
                        i = e
                    else:
                        i += 1
        if len(out) >= 20_000:
            yield arrow_rows([list(c) for c in zip(*out, strict=True)], SPAN_FIELDS)
            out = []
    if out:
        yield arrow_rows([list(c) for c in zip(*out, strict=True)], SPAN_FIELDS)


CUT_FIELDS = [("doc_id", "bigint"), ("sig", "bigint"), ("n_removed", "bigint"), ("cut_sha256", "string"),
              ("kept", "string")]


def _cut(with_text: bool):
    """Rows (doc_id, sig, text, spans as a, b, a, b ...) to what is left of the text."""
    def run(batches):
        for b in sliced(batches):
            out = []
            for doc, sig, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text)
                if _signature(words) != sig:
                    continue
                gone = np.zeros(len(words) + 1, np.int32)
                np.add.at(gone, spans[0::2], 1)
                np.add.at(gone, spans[1::2], -1)
                keep = np.cumsum(gone)[:-1] == 0
                kept = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)
                out.append((doc, sig, int(len(words) - keep.sum()), sha_hex(kept),
                            kept.decode("utf-8", "replace") if with_text else None))
            if out:
                yield arrow_rows([list(c) for c in zip(*out, strict=True)], CUT_FIELDS)

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_words, n_removed, kept_sha256, and the kept words if asked for.

    ``with_text`` adds ``kept``: the kept words joined by one blank, NULL where the text loses nothing.
    """
    folder = f"{ensure_checkpoint_dir(docs.sparkSession)}/passages-{uuid.uuid4().hex}"
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    features = checkpointed(map_texts(texts, _make_features, FIELDS))
    key = ["doc_id", "sig"]

    # Aggregates that are joined back to their rows are kept apart from them (checkpointed), so that Spark can
    # split those joins at a hot key.  First, one document stands for all of an equal word sequence.
    long = features.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    first = settled(long.groupBy("sig", "own_sha256").agg(F.min("doc_id").alias("first_id")))
    copies = long.select("doc_id", "sig", "own_sha256").join(first, ["sig", "own_sha256"])
    only = first.select(F.col("first_id").alias("doc_id"), "sig", "own_sha256")

    pieces = (long.join(only, ["doc_id", "sig", "own_sha256"], "left_semi")
              .select("doc_id", "sig", F.explode(F.arrays_zip("minimisers", "starts")).alias("p"))
              .select("doc_id", "sig", F.col("p.minimisers").alias("low"), F.col("p.starts").alias("start")))
    shared = settled(pieces.groupBy("low").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"),
                                               F.count("*").alias("n"))
                     .where("x < y").select("low", (F.col("n") > HOT).alias("hot")))
    wanted = (pieces.join(shared, "low").groupBy(*key)
              .agg(F.collect_list("start").alias("starts"), F.collect_list("hot").alias("hots")))
    (texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
     .join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "sig", "text", "starts", "hots")
     .write.parquet(f"{folder}/texts"))
    held = docs.sparkSession.read.parquet(f"{folder}/texts")

    spans = (held.mapInArrow(_pack(False), ddl(PACKED_FIELDS)).repartition("bucket").sortWithinPartitions("bucket")
             .mapInArrow(_sort_buckets, ddl(SPAN_FIELDS)))
    hot = held.where(F.exists("hots", lambda x: x)).mapInArrow(_pack(True), ddl(HOT_FIELDS))
    least = settled(hot.groupBy("digest").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"))
                    .where("x < y").select("digest", "x"))
    spans = spans.unionByName(
        hot.join(least, "digest").where(F.col("doc_id") > F.col("x"))
        .select(*key, F.col("start").alias("a"), (F.col("start") + WINDOW).alias("b")))
    spans = spans.groupBy(*key).agg(F.flatten(F.collect_list(F.array("a", "b"))).alias("spans"))
    cut = (held.select(*key, "text").join(spans.hint("shuffle_hash"), key).select(*key, "text", "spans")
           .mapInArrow(_cut(with_text), ddl(CUT_FIELDS)).dropDuplicates(key))

    out = (features.select("doc_id", "n_words", "own_sha256", "sig")
           .join(copies.where(F.col("doc_id") > F.col("first_id")).select(*key).distinct().withColumn("copy", F.lit(True)),
                 key, "left")
           .join(cut, key, "left"))
    return out.select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("cut_sha256", "own_sha256")).alias("kept_sha256"),
        *([F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept")] if with_text else []))
