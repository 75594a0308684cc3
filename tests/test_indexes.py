"""Vector and text indexes against exact search, and tables that survive."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspike.operators import blocks, hnsw, ivf, search, versions
from marlspike.operators.postings import Postings
from marlspike.operators.store import StoreError

SCHEMA = "id long, v array<double>, tag long"


@pytest.fixture(scope="module")
def table(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "cast(embedding AS array<double>) AS v", "cast(label AS long) AS tag")
    return v.where("id % 20 = 0").selectExpr("id AS qid", "v"), v


def found(df):
    return sorted(map(tuple, df.select("qid", "rank", "id", "score").collect()))


def recall(want, got):
    want, got = ({(r["qid"], r["id"]) for r in df.collect()} for df in (want, got))
    return len(want & got) / len(want)


# dense blocks -----------------------------------------------------------------------------------


def test_grid_gives_each_pair_once_and_no_cell_too_many(spark):
    asked = blocks.packed(spark.range(100).selectExpr("id AS qid", "array(cast(id AS double), 1.0) AS v"), ["qid"], 7)
    given = blocks.packed(spark.range(90).selectExpr("id", "array(cast(id AS double), 2.0) AS v").union(spark.createDataFrame([(900, [1.0, 2.0, 3.0])], "id long, v array<double>")), ["id"], 5)
    pairs = blocks.block_pairs(asked, given)
    got = [(r["a_qid"], r["g_id"]) for r in pairs.select("a_qid", "g_id").collect()]
    ids = [(int(a), int(b)) for q, x in got for a in np.frombuffer(q, "<i8") for b in np.frombuffer(x, "<i8")]
    assert len(ids) == len(set(ids)) == 100 * 90
    per_task = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in per_task) < len(got) / 3  # one length of vectors, and still no one task


def test_dense_search_without_broadcasts(spark, table):
    q, v = table
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = blocks.block_pairs(blocks.packed(q, ["qid"], 8), blocks.packed(v, ["id"], 64))
        counts = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) >= 13 * 32 and max(counts) < sum(counts) / 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# cells and codes --------------------------------------------------------------------------------


@pytest.mark.parametrize("metric", ["ip", "l2", "cosine"])
def test_ivf_with_all_cells_is_exact_and_recall_is_high(spark, table, tmp_path, metric):
    q, v = table
    index = ivf.IvfIndex.build(v, f"file://{tmp_path}/{metric}", ivf.IvfSettings(metric=metric))
    want = search.dense_topk(q, v, 10, metric)
    assert found(index.search(q, 10, probes=64, refine=None)) == found(want)
    assert recall(want, index.search(q, 10)) >= 0.9
    again = ivf.IvfIndex(spark, f"file://{tmp_path}/{metric}")
    assert recall(want, again.search(q, 10, probes=64)) >= 0.97


def test_ivf_adds_deletes_and_filters(spark, table, tmp_path):
    q, v = table
    index = ivf.IvfIndex.build(v.where("id < 1500"), f"file://{tmp_path}/i", ivf.IvfSettings(cells=16, parts=8))
    index.add(v.where("id >= 1500"))
    assert index.delete(v.where("id % 3 = 0")) == v.where("id % 3 = 0").count() and index.delete(v.where("id % 3 = 0")) == 0
    left = v.where("id % 3 <> 0 AND tag IN (2, 5)")
    assert found(index.search(q, 4, probes=16, refine=None, tags=[2, 5])) == found(search.dense_topk(q, left, 4))
    assert {r["id"] for r in index.rows().select("id").collect()} == {r["id"] for r in v.where("id % 3 <> 0").select("id").collect()}


def test_ivf_of_odd_and_hot_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.0, 0.0, 0.0] if i % 3 == 0 else [float(x) for x in rng.normal(size=4)], 0) for i in range(6000)]
    odd = [(None, [1.0] * 4, 1), (9001, None, 1), (9002, [], 1), (9003, [1.0, None, 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    index = ivf.IvfIndex.build(df, f"file://{tmp_path}/h", ivf.IvfSettings(cells=8, parts=2, codes=16))
    q = spark.createDataFrame([(1, [1.0, 0.1, 0.0, 0.0]), (2, None), (3, [1.0]), (None, [1.0] * 4)], "qid long, v array<double>")
    assert index.rows().count() == 6000
    assert found(index.search(q, 5, probes=8, refine=None)) == found(search.dense_topk(q.where("qid = 1"), df, 5))
    assert index.search(q.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        ivf.IvfIndex.build(df.union(spark.createDataFrame([(1, [1.0], 0)], SCHEMA)), f"file://{tmp_path}/x", ivf.IvfSettings(parts=1))


# small-world graphs -----------------------------------------------------------------------------


@pytest.mark.parametrize("metric", ["ip", "l2", "cosine"])
def test_hnsw_recall(spark, table, tmp_path, metric):
    q, v = table
    index = hnsw.HnswIndex.build(v, f"file://{tmp_path}/{metric}", metric, shard_rows=700)
    assert index.shards.count() == 3
    assert index.recall(q, 10) >= 0.9
    assert {r["id"] for r in index.rows().select("id").collect()} == {r["id"] for r in v.select("id").collect()}


def test_hnsw_is_the_same_when_a_task_is_repeated(spark, table, tmp_path):
    _, v = table
    made = [hnsw.HnswIndex.build(v.limit(400).repartition(n), f"file://{tmp_path}/{n}", "ip", 200).shards.orderBy("shard").collect() for n in (1, 3)]
    assert made[0] == made[1]


def test_hnsw_of_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (None, [1.0, 1.0]), (4, [1.0, 2.0, 3.0]), (5, [])]
    index = hnsw.HnswIndex.build(spark.createDataFrame(rows, "id long, v array<double>"), f"file://{tmp_path}/o")
    q = spark.createDataFrame([(7, [1.0, 0.1]), (8, [0.0, 0.0, 1.0]), (9, None)], "qid long, v array<double>")
    assert [(r["qid"], r["id"]) for r in index.search(q, 2).orderBy("qid", "rank").collect()] == [(7, 1), (7, 1), (8, 4)]
    assert hnsw.HnswIndex.build(spark.createDataFrame([], "id long, v array<double>"), f"file://{tmp_path}/e").search(q, 2).count() == 0


# postings ---------------------------------------------------------------------------------------


def brute_topk(postings, queries, k, allowed=None):
    out = []
    for qid, terms in queries.items():
        scores = defaultdict(float)
        for i, t, w in postings:
            if t in terms and (allowed is None or i in allowed):
                scores[i] += w * terms[t]
        best = sorted((-round(s, 6), i) for i, s in scores.items())[:k]
        out += [(qid, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_docs", [50, 100_000])
def test_postings_skip_blocks_and_lose_nothing(spark, shard_docs):
    rng = random.Random(4)
    docs = [(i, f"t{t}", round(rng.random() ** 4 * (5 if t > 3 else 0.2), 3) + 0.001) for i in range(2000) for t in {0, rng.randrange(40), rng.randrange(6)}]
    docs += [(i, "rare", 20.0 + i) for i in range(12)]
    queries = {1: {"t0": 1.0, "rare": 1.0, "t5": 2.0}, 2: {"t1": 1.0, "t2": 0.5}, 3: {"none": 1.0}, 4: {f"t{t}": 1.0 for t in range(40)}}
    index = Postings.build(spark.createDataFrame(docs, "id long, term string, w double"), 2000, shard_docs)
    q = spark.createDataFrame([(i, t, w) for i, ts in queries.items() for t, w in ts.items()], "qid long, term string, qw double")
    for k in (1, 5, 3000):
        assert found(index.topk(q, k)) == brute_topk(docs, queries, k)
    some = {i for i in range(0, 2000, 7)}
    assert found(index.topk(q, 5, spark.createDataFrame([(i,) for i in some], "id long"))) == brute_topk(docs, queries, 5, some)
    assert found(index.topk(q, 5, spark.createDataFrame([], "id long"))) == []
    counts = {r["qid"]: r for r in index.topk(q, 5, counts=True).collect()}
    assert counts[2]["read"] > 0 and (shard_docs == 50 or counts[1]["skipped"] > 0)


def test_postings_of_odd_rows(spark):
    docs = [(1, "a", 1.0), (None, "a", 9.0), (2, None, 9.0), (3, "a", 0.0), (4, "a", None)]
    index = Postings.build(spark.createDataFrame(docs, "id long, term string, w double"), 1)
    q = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "a")], "qid long, term string")
    assert found(index.topk(q, 3)) == [(1, 1, 1, 2.0)]
    assert [tuple(r) for r in index.frequencies(q).collect()] == [("a", 1)]


# versions ---------------------------------------------------------------------------------------


COLUMNS = "id long, name string, n int"


def rows(spark, *given):
    return spark.createDataFrame(list(given), COLUMNS)


def held(table):
    return sorted(map(tuple, table.rows().collect()))


def test_versions_of_a_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    t0 = versions.VersionedTable.create(spark, path, COLUMNS)
    assert held(t0) == []
    t1 = t0.add(rows(spark, (1, "a", 1), (2, "b", 2), (3, "c", 3)))
    t2, replaced = t1.upsert(rows(spark, (2, "B", 20), (4, "d", 4)))
    t3, gone = t2.delete(spark.createDataFrame([(1,), (9,), (None,)], "id long"))
    assert (replaced, gone) == (1, 1)
    assert held(t3) == [(2, "B", 20), (3, "c", 3), (4, "d", 4)] and held(t1) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    t4, _ = t3.upsert(spark.createDataFrame([(3, 33)], "id long, n int"))  # a column that isn't given stays
    t5, _ = t4.delete(spark.createDataFrame([(4,)], "id long"))
    t6 = t5.add(rows(spark, (1, "again", 7)))
    assert held(t6) == [(1, "again", 7), (2, "B", 20), (3, "c", 33)]
    t7 = t6.compact()
    assert held(t7) == held(t6) and len(t7.version.rows) == 1 and not t7.version.gone
    assert held(versions.VersionedTable(spark, path, number=2)) == [(1, "a", 1), (2, "B", 20), (3, "c", 3), (4, "d", 4)]
    assert t7.vacuum() > 0 and held(versions.VersionedTable(spark, path)) == held(t7)
    with pytest.raises(StoreError):
        versions.VersionedTable(spark, path, number=2)


def test_two_writers_conflict_and_one_tries_again(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    table = versions.VersionedTable.create(spark, path, COLUMNS)
    mine, yours = (versions.VersionedTable(spark, path) for _ in range(2))
    mine.add(rows(spark, (1, "mine", 1)))
    with pytest.raises(versions.Conflict):
        yours.add(rows(spark, (2, "yours", 2)))
    assert held(versions.VersionedTable(spark, path)) == [(1, "mine", 1)]
    tries = []

    def change(t):
        if not tries:
            versions.VersionedTable(spark, path).add(rows(spark, (3, "between", 3)))
        tries.append(t.version.number)
        return t.add(rows(spark, (2, "yours", 2)))

    assert len(held(versions.current(spark, path)(change))) == 3 and len(tries) == 2
    with pytest.raises(versions.Conflict):
        versions.VersionedTable.create(spark, path, COLUMNS)
    assert held(table) == []


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/x"
    table = versions.VersionedTable.create(spark, path, COLUMNS).add(rows(spark, (1, "a", 1)))

    def crash(self, version):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions.VersionedTable, "_publish", crash)
        with pytest.raises(RuntimeError):
            table.add(rows(spark, (2, "b", 2)))
    now = versions.VersionedTable(spark, path)
    assert now.version.number == 1 and held(now) == [(1, "a", 1)]
    assert held(now.add(rows(spark, (2, "b", 2)))) == [(1, "a", 1), (2, "b", 2)]
    assert versions.VersionedTable(spark, path).vacuum(keep=9) == 1  # the part that no list names


def test_versions_refuse_bad_keys(spark, tmp_path):
    table = versions.VersionedTable.create(spark, f"file://{tmp_path}/k", COLUMNS).add(rows(spark, (1, "a", 1)))
    for bad in (rows(spark, (1, "b", 2)), rows(spark, (2, "b", 2), (2, "c", 2)), rows(spark, (None, "b", 2)), spark.createDataFrame([(5, 1)], "id long, other int")):
        with pytest.raises(StoreError):
            table.add(bad)
    with pytest.raises(StoreError):
        versions.VersionedTable(spark, f"file://{tmp_path}/none")
