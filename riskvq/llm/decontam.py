"""Operator 4: benchmark decontamination.

The windows of all benchmark items go into one Aho-Corasick automaton over
normalised words; each document is normalised the same way and scanned once;
hits are mapped back to words and to code points of the original text.

Cases: NULL texts have no words; items without words or without text have no
window; an item_id that repeats counts once; windows of an item without id hit
words but add to no item count; an empty benchmark hits nothing.
"""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskvq.llm.common import arrow_rows, checkpointed, ddl, per_process, sha_hex, sliced

WINDOW = 10
# Of the item texts that are broadcast and stand behind one automaton, in characters.  A benchmark beyond that bound
# goes in several scans, one automaton each.
BLOCK_CHARS = 2_500_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # of the text as it is, with A-Z
# after lower-casing A-Z: other ASCII than 0-9 and a-z becomes a blank
_TO_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

FIELDS = [("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"),
          ("contaminated", "boolean"), ("spans", "string")]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_TO_WORDS).split()


class Windows:
    """The windows of all items in one automaton; a word is two symbols, so tries stay small and hits fall on words.

    Words are numbered; the two digits of a number have an alphabet each, of about
    the square root of the vocabulary.  Words of no item are two symbols of no window.
    """

    def __init__(self, items: list[tuple[str | None, str]], size: int = WINDOW):
        import ahocorasick

        texts = [(item, words_of(text or "")) for item, text in items]
        known = sorted({w for _, words in texts for w in words})
        base = math.isqrt(len(known)) + 1
        self.symbols = {w: chr(1 + i // base) + chr(base + 2 + i % base) for i, w in enumerate(known)}
        self.automaton = ahocorasick.Automaton()
        for item, words in texts:
            line = self.line(words)
            for w in {line[2 * i:2 * (i + size)] for i in range(max(1, len(words) - size + 1))} if words else ():
                found = self.automaton.get(w, None)
                if found is None:
                    found = (len(w) // 2, set())
                    self.automaton.add_word(w, found)
                if item is not None:
                    found[1].add(item)
        if len(self.automaton):
            self.automaton.make_automaton()

    def line(self, words: list[bytes]) -> str:
        symbols = self.symbols
        return "".join([symbols.get(w, "\0\0") for w in words])


def automaton_of(items: list[tuple[str | None, str]]) -> Windows:
    return Windows(items)


def hits_of(words: list[bytes], windows: Windows) -> tuple[set[int], set[str]]:
    """Indices of the words inside any occurrence of a window, and the items of those windows."""
    hit, items = set(), set()
    if words and len(windows.automaton):
        for end, (n, ids) in windows.automaton.iter(windows.line(words)):
            hit.update(range(end // 2 - n + 1, end // 2 + 1))
            items.update(ids)
    return hit, items


def spans_of(text: str, hit: set[int]) -> list[tuple[int, int]]:
    """Code point spans of the runs of hit words in the original text."""
    out = []
    last = -2
    for i, m in enumerate(WORD.finditer(text)):
        if i in hit:
            if i == last + 1:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append(m.span())
            last = i
    return out


def _blocks(benchmark: DataFrame):
    """Lists of (item id, text), each of bounded size; one at a time on the driver."""
    block, size = [], 0
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("i"), "text")
    for i, text in items.toLocalIterator():
        block.append((i, text))
        size += len(text)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Carried columns, n_words, n_hit, n_items, items_sha256, contaminated, and the hit spans as start:end."""
    sc = docs.sparkSession.sparkContext
    types_of = dict(docs.dtypes)
    kept = [(c, types_of[c]) for c in carry]
    n = len(kept)
    empty_ints, empty_strings = F.array().cast("array<int>"), F.array().cast("array<string>")
    state = docs.select(*carry, F.col("text").alias("_text"), empty_ints.alias("_hit"), empty_strings.alias("_items"))
    middle = [("_text", "string"), ("_hit", "array<int>"), ("_items", "array<string>")]

    def scan(block, last: bool):
        items, version = sc.broadcast(block), uuid.uuid4().hex

        def run(batches):
            # built once in a Python worker
            automaton = per_process("decontam", version, lambda: automaton_of(items.value))
            for b in sliced(batches):
                rows = []
                for text, hit0, items0 in zip(*(b.column(n + i).to_pylist() for i in range(3)), strict=True):
                    words = words_of(text or "")
                    hit, ids = hits_of(words, automaton)
                    hit.update(hit0)
                    ids.update(items0)
                    if not last:
                        rows.append((text, sorted(hit), sorted(ids)))
                        continue
                    spans = spans_of(text, hit) if hit else ()
                    rows.append((len(words), len(hit), len(ids), sha_hex(",".join(sorted(ids)).encode()), bool(hit),
                                 ",".join(f"{s}:{e}" for s, e in spans)))
                if rows:
                    yield arrow_rows([b.column(i) for i in range(n)] + [list(c) for c in zip(*rows, strict=True)],
                                     kept + (FIELDS if last else middle))

        return run

    blocks, block = _blocks(benchmark), []
    for following in blocks:
        if block:  # not the last: keep what it found and free its automaton
            state = checkpointed(state.mapInArrow(scan(block, False), ddl(kept + middle)))
        block = following
    return state.mapInArrow(scan(block, True), ddl(kept + FIELDS))
