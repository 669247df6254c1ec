import random

import corpus_pipeline
import duckdb
import pytest
from conftest_llm import prose, sha

import __spark_entry__ as entry
from riskvq.llm import bpe, decontam, near_dup, quality, secrets
from riskvq.llm.queries import ORACLE_SQL, QUERIES, rank_file, split_pattern


@pytest.fixture
def folder(spark, documents, odd_rows, tmp_path):
    rng = random.Random(3)
    item = prose(rng, 14)
    rows = list(odd_rows)
    for i in range(100, 260):
        t = prose(rng, rng.randrange(30, 90))
        t = t.upper().replace(" ", "!! ") if i % 4 == 0 else t
        t = f"{t} {item}" if i % 9 == 1 else t
        t = f'{t} password = "abcdef1234"' if i % 5 == 2 else t
        rows.append((i, t))
        if i % 7 == 3:
            rows.append((i + 500, t + " end"))
    marks = [(i, int(not (t or "").isupper()), 0) for i, t in rows if i is not None and i >= 100 and (t or "")]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = quality.fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    buckets = quality.Buckets()

    def accepted(t):
        x = quality.pooled(quality.tokens_of(t or "", buckets), model["vectors"])[None, :].astype(float)
        return quality.probability(model["network"], x)[0] >= 0.3

    left = [(i, t) for i, t in rows if accepted(t)]
    assert 0 < len(left) < len(rows)
    sets, kept, seen = {}, [], set()
    for k, (i, t) in enumerate(left):
        w = (t or "").encode().lower().split()
        sets[k] = frozenset(tuple(w[j:j + min(5, len(w))]) for j in range(len(w) - min(5, len(w)) + 1)) if w else frozenset()
    for k in sorted(sets, key=lambda k: (left[k][0] is None, left[k][0] or 0)):  # groups here are stars around the smallest id
        i, t = left[k]
        twin = any(i is not None and j is not None and j < i and sets[k] and 100 * len(sets[k] & s) >= 85 * len(sets[k] | s)
                   for j, s in seen)
        if not twin and (i is None or (i, sets[k]) not in seen or not sets[k]):
            kept.append((i, t))
        seen.add((i, sets[k]))
    automaton = decontam.automaton_of([(str(r.item_id), r.text) for r in bench.collect()])
    kept = [(i, t) for i, t in kept if not decontam.hits_of(decontam.words_of(t or ""), automaton)[0]]
    redact = secrets._make_redact()
    with open(rank_file(), "rb") as f:
        codec = bpe.BytePairCodec(bpe.read_ranks(f.read()), split_pattern())
    want = []
    for i, t in kept:
        text = redact(t or "")[0]
        ids = codec.encode(text)
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(text), ids))
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema == docs.schema or stage(spark, docs, folder).columns == docs.columns
        empty = stage(spark, docs.limit(0), folder)
        assert empty.columns == docs.columns and empty.count() == 0


def test_registered_queries(spark):
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(ORACLE_SQL[name])
    columns = sorted(rel.columns)
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == columns
    want = sorted(tuple(map(str, r)) for r in rel.select(", ".join(columns)).fetchall())
    assert sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) == want
