import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from conftest_llm import by_id, sha

from riskvq.llm import bpe
from riskvq.llm.queries import rank_file, split_pattern


@pytest.fixture(scope="module")
def codecs():
    with open(rank_file(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(rank_file(), "rb") as f:
        own = bpe.BytePairCodec(bpe.read_ranks(f.read()), split_pattern())
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library(codecs):
    own, theirs = codecs
    rng = random.Random(3)
    chars = ["a", "b", "ab", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "é", "ß", "中", "😀", "'s", "'LL", "9", "٣", "!", "<|endoftext|>", "́"]
    for _ in range(3000):
        text = "".join(rng.choice(chars) for _ in range(rng.randrange(30)))
        ids = own.encode(text)
        assert ids == theirs.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


def test_every_assigned_character(codecs):
    import unicodedata
    own, theirs = codecs
    old = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    for i in range(0, len(old), 500):
        text = "".join(f"a{chr(c)}a{chr(c)} " for c in old[i:i + 500])
        assert own.decode(own.encode(text)) == text.encode()
    text = "".join(f"x{chr(c)}1 " for c in old if c < 0x3000)
    assert own.encode(text) == theirs.encode_ordinary(text)


def test_long_pre_tokens(codecs):
    own, theirs = codecs
    rng = random.Random(4)
    for text in ("a" * 20_000, "".join(rng.choice("abcdeiou") for _ in range(20_000)), "é" * 5000, " " * 3000):
        assert own.encode(text) == theirs.encode_ordinary(text)
        assert not any(own.queue.low) and not any(own.queue.buckets)


def test_documents_and_back(spark, documents, odd_rows, codecs):
    theirs = codecs[1]
    out = bpe.encode_documents(documents(odd_rows), rank_file(), split_pattern(), with_ids=True)
    expected = []
    for i, t in odd_rows:
        ids = theirs.encode_ordinary(t or "")
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(t or ""), ids))
    assert by_id(out) == sorted(expected, key=repr)
    back = bpe.decode_ids(out, rank_file(), split_pattern())
    assert by_id(back) == sorted(((i, t or "") for i, t in odd_rows), key=repr)
    assert by_id(bpe.encode_documents(documents([]), rank_file(), split_pattern())) == []
