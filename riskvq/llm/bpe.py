"""Operator 3: byte-level BPE encoding and decoding.

Each match of the split pattern is merged on its own.  Pairs wait in one bucket
per merge rank, each a heap of positions in the linked list of tokens; a
bitmap of two levels over the ranks gives the next rank by find-first-set; entries
whose pair has changed meanwhile are skipped.  A pre-token of n bytes takes
O(n log n), however long it is.

Cases: a NULL text encodes as the empty text (no tokens); strings of special
tokens are ordinary text; repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

from pyspark.sql import DataFrame

from riskvq.llm.common import map_texts, per_process, sha_hex

CACHE_ENTRIES = 150_000  # pre-tokens of a generation kept per Python worker
NONE = 1 << 40         # the rank of a pair that is no token
CACHE_LENGTH = 64        # longer pre-tokens are merged anew

FIELDS = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class RankQueue:
    """Positions by merge rank: lowest rank first, then lowest position.

    ``low`` has one bit per rank in words of 256, ``top`` one bit per word that is not empty; ``buckets[rank]`` is a heap of
    positions.  The merge loop below works on these fields itself, for a call per step would cost more than the step.
    """

    def __init__(self, n_ranks: int):
        self.low = [0] * ((n_ranks >> 8) + 1)
        self.top = 0
        self.buckets: list[list[int]] = [[] for _ in range(n_ranks)]


class PieceCache(dict):
    """Ids by pre-token, in two generations: when the young one is full it becomes the old one, which is dropped."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.old = merge, {}

    def __missing__(self, piece: str):
        ids = self.old.get(piece)
        if ids is None:
            ids = self.merge(piece.encode())
            if len(piece) > CACHE_LENGTH:
                return ids
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class BytePairCodec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.names = {r: str(r) for r in self.tokens}
        self.longest = max(map(len, ranks))
        # the library's \s is the White_Space property
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.cache = PieceCache(self.merge)
        self.bits = [1 << i for i in range(256)]
        self.pairs = [[ranks.get(bytes((a, b)), NONE) for b in range(256)] for a in range(256)]

    def merge(self, piece: bytes) -> tuple[int, ...]:
        ranks, longest, bits, pairs = self.ranks, self.longest, self.bits, self.pairs
        if piece in ranks:
            return (ranks[piece],)
        low, buckets, top = self.queue.low, self.queue.buckets, 0
        push, pop, get = heapq.heappush, heapq.heappop, ranks.get
        n = len(piece)
        end = list(range(1, n + 2))     # a token spans piece[i:end[i]]; end[i] is its successor
        prev = list(range(-1, n))       # prev[0] is -1: the last entry of pair, which is NONE
        # rank of the pair that begins at i; one that does not precede both neighbours waits outside the queue
        pair = [pairs[a][b] for a, b in zip(piece, piece[1:])]
        pair += (NONE, NONE)
        left = NONE
        for i in range(n - 1):
            r = pair[i]
            if r < left and r <= pair[i + 1] and r != NONE:
                buckets[r].append(i)    # ascending, so a heap
                a = r >> 8
                low[a] |= bits[r & 255]
                top |= bits[a]
            left = r
        while top:
            a = (top & -top).bit_length() - 1
            w = low[a]
            r = (a << 8) + (w & -w).bit_length() - 1
            bucket = buckets[r]
            i = pop(bucket)
            if not bucket:
                w &= w - 1
                low[a] = w
                if not w:
                    top &= top - 1
            if pair[i] != r:
                continue  # stale
            j = end[i]
            e = end[i] = end[j]
            pair[j] = NONE
            p = prev[i]
            ri = rp = NONE
            if e < n:
                prev[e] = i
                f = end[e]
                if f - i <= longest:
                    ri = get(piece[i:f], NONE)
            if p >= 0:
                if e - p <= longest:
                    rp = get(piece[p:e], NONE)
                pair[p] = rp
                q = prev[p]
                rq = pair[q]
            else:
                q, rq = -1, NONE
            pair[i] = ri
            re = pair[e]
            # of the two new pairs and the two beside them, those that now precede their neighbours
            if rq <= rp and rq != NONE and rq < pair[prev[q]]:
                push(buckets[rq], q)
                a = rq >> 8
                low[a] |= bits[rq & 255]
                top |= bits[a]
            elif rp < rq and rp <= ri and rp != NONE:
                push(buckets[rp], p)
                a = rp >> 8
                low[a] |= bits[rp & 255]
                top |= bits[a]
            if re < ri and re <= pair[end[e]]:
                push(buckets[re], e)
                a = re >> 8
                low[a] |= bits[re & 255]
                top |= bits[a]
            elif ri < rp and ri <= re and ri != NONE:
                push(buckets[ri], i)
                a = ri >> 8
                low[a] |= bits[ri & 255]
                top |= bits[a]
        ids, i = [], 0
        while i < n:
            j = end[i]
            ids.append(ranks[piece[i:j]])
            i = j
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.cache.__getitem__, self.split(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _codec_maker(spark, rank_file: str, pattern: str):
    with open(rank_file, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())  # one vocabulary file, under 1 MB
    return lambda: per_process("bpe", (rank_file, pattern),
                               lambda: BytePairCodec(read_ranks(data.value), pattern))


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, carry: tuple[str, ...] = ("doc_id",),
                     with_ids: bool = False) -> DataFrame:
    """Carried columns, n_tokens, digests of the ids and of the decoded bytes, and the ids if asked for."""
    codec_of = _codec_maker(docs.sparkSession, rank_file, pattern)

    def make():
        codec = codec_of()
        names = codec.names

        def of_text(text):
            ids = codec.encode(text)
            row = (len(ids), sha_hex(",".join(map(names.__getitem__, ids)).encode()), sha_hex(codec.decode(ids)))
            return (*row, ids) if with_ids else row

        return of_text

    return map_texts(docs, make, FIELDS + [("ids", "array<int>")] * with_ids, carry=carry)


def decode_ids(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids") -> DataFrame:
    """doc_id and the decoded text of a column of ids (bytes that are no UTF-8 are replaced)."""
    import pyarrow as pa

    codec_of = _codec_maker(df.sparkSession, rank_file, pattern)

    def run(batches):
        codec = codec_of()
        for b in batches:
            texts = [codec.decode(x or []).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select("doc_id", ids).mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, text string")
