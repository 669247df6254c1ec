import gzip
import hashlib
import random
import zlib

import pytest
from conftest_llm import prose

from riskvq.llm import warc as W

SCHEMA = "page_id bigint, url string, html string, size string, key int, response string, payload string"


def plain(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        ids = [j for j, _, h in rows if j is not None and (h or "").encode() == body]
        top = max(ids, default=None) if len(body) >= 1000 else None
        revisit = top is not None and top != i
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "b", "c") for r in rows], SCHEMA)


@pytest.fixture
def pages():
    rng = random.Random(6)
    body = "<p>" + prose(rng, 400)
    other = prose(rng, 3000)
    rows = [(i, f"http://h{i}.example/ä b\r\nX: y", body) for i in range(1, 60)]       # a hot payload
    rows += [(100, None, None), (101, "u", ""), (102, "", "x" * 999), (103, "u", "x" * 999), (104, "u", "y" * 1000),
             (105, "u", "y" * 1000), (105, "v", "y" * 1000), (106, "u", "é" * 500), (107, "u", "é" * 500),
             (108, "u", "é" * 499), (109, "u", "é" * 499), (None, "u", body), (None, "u", other), (None, None, other),
             (110, "u", other + " 😀"), (111, "u", "\0\r\n\r\nWARC/1.1\r\n" * 200), (112, "u", "z" * (17 << 20)),
             (113, "u", "".join(chr(rng.randrange(33, 0x2000)) for _ in range(300_000)))]
    return rows


def test_round_trip_equals_plain(spark, pages):
    df = table(spark, pages)
    for docs in (df, df.repartition(9)):
        out = W.archive_pages(docs).collect()
        assert {r.problem for r in out} == {None}
        assert sorted((tuple(r)[:5] for r in out), key=repr) == plain(pages)
    assert W.archive_pages(df.limit(0)).count() == 0


def test_shuffled_join_gives_the_same(spark, pages):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = W.archive_pages(table(spark, pages)).drop("problem").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, out), key=repr) == plain(pages)


def test_files_are_plain_warc(spark, pages, tmp_path):
    """Files are gzip members of one record each, cut at the size asked for, with payloads that come back."""
    path = str(tmp_path / "w")
    W.write_warc(table(spark, pages).coalesce(1), path, archive_bytes=5_000)
    files = sorted(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-"))
    assert len(files) > 3
    total = 0
    for f in files:
        raw = f.read_bytes()
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: ")
        members = 0
        while raw:
            z = zlib.decompressobj(31)
            record = z.decompress(raw)
            assert z.eof and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            head, _, block = record.partition(b"\r\n\r\n")
            assert f"Content-Length: {len(block) - 4}".encode() in head and b"X: y" not in head.split(b"\r\n")
            raw, members = z.unused_data, members + 1
        total += members - 1
    assert total == len(pages)
    back = W.read_warc(spark, path, with_payload=True).where("record_type = 'response'").collect()
    texts = {W_id(r.record_id): r.payload.decode() for r in back}
    want = {i: h or "" for i, _, h in pages if i is not None}
    assert all(texts[i] == h for i, h in want.items() if i in texts) and len(texts) > 10


def W_id(record):
    return int(record[len("<urn:x-page:"):-1] or -1)


def archive(n=5):
    rng = random.Random(n)
    parts = []
    for i in range(n):
        body = prose(rng, 50).encode()
        parts.append(W.page_member(i, f"http://x/{i}", body, len(body), hashlib.sha1(body).digest(), None, "2000-01-01T00:00:00Z"))
    return parts


def read(raw, **how):
    return list(W.read_archive(memoryview(raw), **how))


def test_damage_is_reported_and_skipped():
    parts = archive()
    whole = b"".join(parts)
    assert [r[6] for r in read(whole)] == [None] * 5
    assert read(whole, counted=True)[-1][6] == "archive of None records holds 5"
    flipped = bytearray(whole)
    flipped[len(parts[0]) + len(parts[1]) // 2] ^= 0x55
    ids = [r[1] for r in read(bytes(flipped)) if r[6] is None]
    assert ids == ["<urn:x-page:0>", "<urn:x-page:2>", "<urn:x-page:3>", "<urn:x-page:4>"]
    cut = read(whole[:-10])
    assert cut[-1][6] == "archive ends inside a record" and len(cut) == 5
    assert read(b"") == [] and read(b"no gzip at all")[0][6].startswith("gzip")


@pytest.mark.parametrize("old, new, problem", [
    (b"HTTP/1.1", b"HTTP/1.2", "block digest differs"),
    (b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:A", "payload digest differs"),
    (b"WARC/1.1", b"WARD/1.1", "no WARC record"),
])
def test_wrong_records_are_reported(old, new, problem):
    text = gzip.decompress(archive(1)[0])
    got = read(gzip.compress(text.replace(old, new)))
    assert got[0][6] == problem


def test_length_frames_the_block():
    text = gzip.decompress(archive(1)[0])
    head, _, _ = text.partition(b"\r\n\r\n")
    n = int(head.rpartition(b"Content-Length: ")[2])
    for said, problem in ((n + 50, "block shorter than Content-Length"), (n - 5, "block digest differs")):
        wrong = text.replace(f"Content-Length: {n}".encode(), f"Content-Length: {said}".encode(), 1)
        assert read(gzip.compress(wrong))[0][6] == problem
    plain_record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\nX-Folded: a\r\n b\r\n\r\nabc"
    assert read(gzip.compress(plain_record + b"\r\n\r\n"), with_payload=True)[0][7] == b"abc"
    assert read(gzip.compress(plain_record + b"d\r\n\r\n"))[0][6] == "record does not end after Content-Length bytes"
