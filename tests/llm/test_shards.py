import random
import zlib

import numpy as np

from riskvq.llm import shards as S


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_and_growth():
    rng = random.Random(1)
    keys = [rng.randrange(2**64) for _ in range(3000)]
    before = None
    for n in (1, 2, 8, 9, 50):
        got = S.jump_hash(np.array(keys, np.uint64), n)
        assert got.tolist() == [plain_jump(k, n) for k in keys]
        if n == 9:
            moved = got != before
            assert (got[moved] == 8).all() and abs(moved.mean() - 1 / 9) < 0.03
        before = got


def test_shards_and_slots(documents, odd_rows):
    rows = odd_rows + [(i, f"t{i}") for i in range(100, 900)] + [(50, "same")] * 40
    docs = documents(rows)
    out = S.assign_shards(docs).collect()
    assert len(out) == len(rows) and {r.law for r in out} == {"key"}
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=repr) == want
    for shard in range(8):
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))
    place = {}
    for r in out:
        assert place.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 8)
    again = S.assign_shards(docs.repartition(5)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)
    assert S.assign_shards(documents([])).count() == 0


def test_many_equal_rows_are_numbered_in_pieces(spark, documents, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 7)
    rows = [(1, "same")] * 500 + [(None, None)] * 300 + [(i, f"t{i}") for i in range(2, 60)]
    out = S.assign_shards(documents(rows)).collect()
    assert len(out) == len(rows)
    for shard in range(8):
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_a_million_equal_rows(spark):
    docs = spark.range(1_000_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text")
    out = S.assign_shards(docs)
    assert out.rdd.getNumPartitions() > 1
    r = out.selectExpr("count(*) AS n", "count(DISTINCT slot) AS d", "min(slot) AS a", "max(slot) AS z").collect()[0]
    assert (r.n, r.d, r.a, r.z) == (1_000_000, 1_000_000, 0, 999_999)


def test_written_shards(spark, documents, tmp_path):
    rows = [(i, f"t{i}") for i in range(200)] + [(None, None)]
    S.write_shards(documents(rows), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 201 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
