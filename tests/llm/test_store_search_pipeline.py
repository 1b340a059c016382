import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import partenum, shards, topk
from plumbline.llm.queries import table


def test_top_k_against_brute_force(spark):
    import math

    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, rng.uniform(-1, 1)]) for _ in range(rng.choice([3, 5]))]) for i in range(300)]
    rows += [(400, None), (401, [None, 1.0]), (402, [float("nan")]), (403, [float("inf")]), (None, [1.0]), (404, []), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(5)
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, block=4)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_store(spark, tmp_path):
    df = spark.range(4000).select("id", F.md5(F.col("id").cast("string")).alias("text"), F.lit("mine").alias("_shard")).repartition(8)
    store = shards.shard_documents(df, str(tmp_path / "s"), arrivals=3, target=100_000)
    now = store.manifest()
    sizes = [s.size for s in store.shards()]
    assert all(len(s) < store.fan_in for t, s in store.tiers(store.shards()).items() if t) and sum(sizes)
    assert sorted((r.id, r._shard) for r in store.read().collect()) == [(i, "mine") for i in range(4000)]
    assert {r.file for r in store.read(shard_col="file").collect()} == {s.path for s in store.shards()}
    with pytest.raises(ValueError, match="column _SHARD"):
        store.read(shard_col="_SHARD")
    with pytest.raises(shards.Conflict):
        store._commit(now | {"version": now["version"] - 1}, None, [])
    v = store.append(df.limit(5))
    assert store.read().count() == 4005 and store.read(v - 1).count() == 4000
    with pytest.raises(ValueError, match="columns"):
        store.append(df.select("id"))
    empty = shards.shard_documents(df.limit(0), str(tmp_path / "e"))
    assert empty.read().count() == 0 and empty.compact() == empty.manifest()["version"]


def test_arrivals_are_merged_and_merged_again(spark, tmp_path, monkeypatch):
    df = spark.range(4000).select("id", F.md5(F.col("id").cast("string")).alias("text")).coalesce(1)
    write, written = shards.ShardStore._write, []
    monkeypatch.setattr(shards.ShardStore, "_write", lambda self, rows, name: written.append(write(self, rows, name)) or written[-1])
    store = shards.shard_documents(df, str(tmp_path / "s"))
    assert [len(w) for w in written] == [1] * 21  # 16 arrivals, of which four at a time are merged, and these four
    assert [s.size for s in store.shards()] == [written[-1][0].size]
    assert sorted(r.id for r in store.read().collect()) == list(range(4000))


def test_store_keeps_rows_of_any_kind(spark, tmp_path):
    rows = [(1, None), (1, None), (None, ""), (None, None), (2, "x" * 500_000), (2, "x" * 500_000), (3, "é\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    store = shards.shard_documents(df, str(tmp_path / "s"))
    assert sorted(map(str, store.read().collect())) == sorted(map(str, df.collect()))


def test_expire_spares_what_is_being_written(spark, tmp_path, monkeypatch):
    df = spark.range(100)
    store = shards.ShardStore(spark, str(tmp_path / "s"))
    store.append(df)
    commit = store._commit

    def late(base, schema, found):  # another process expires, and another writer commits, before this one's commit
        monkeypatch.setattr(store, "_commit", commit)
        other = shards.ShardStore(spark, store.path)
        other.append(spark.range(100, 150))
        other.expire()
        return commit(base, schema, found)

    monkeypatch.setattr(store, "_commit", late)
    store.append(spark.range(150, 170))
    assert sorted(r.id for r in store.read().collect()) == list(range(170))
    store.compact()
    left = store._write(spark.range(5), "shards/abandoned")
    store.expire()
    assert store._list("shards/abandoned") == left
    assert store.expire(grace=-1) == len(left) and store.read().count() == 170


def test_manifests_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "PART", 4)
    store = shards.ShardStore(spark, str(tmp_path / "s"), fan_in=50)
    for i in range(6):
        store.append(spark.range(i * 10, i * 10 + 10).coalesce(2))
    parts = store.manifest()["parts"]
    assert len(parts) >= 2 and len(store.shards()) >= 6 and store.read().count() == 60
    store.append(spark.range(60, 61))
    assert len(set(parts) & set(store.manifest()["parts"])) >= 1 and store.read().count() == 61


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    known = {r.doc_id: r for r in table(spark, sf, "labels").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "toxicity", "line dedup", "n-gram Jaccard join", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf).persist()
        if k < 4:
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
            assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        if k == 0:
            kept = {r.doc_id for r in out.select("doc_id").collect()}
            good = [i for i, r in known.items() if r.quality == 1]
            assert sum(i in kept for i in good) >= 0.97 * len(good)
        if name == "n-gram Jaccard join":
            left = partenum.near_duplicates(out, "0.8", 5)
            assert left.where("component_id <> doc_id").count() == 0
            gone = docs.select("doc_id").exceptAll(out.select("doc_id"))
            found = partenum.near_duplicates(docs, "0.8", 5)
            assert gone.exceptAll(found.where("component_id <> doc_id").select("doc_id")).count() == 0
        docs = out
    assert docs.agg(F.sum("length")).first()[0] > 0
