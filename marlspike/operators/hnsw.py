"""Hierarchical small-world graphs over shards of vectors, stored in a folder and searched shard by shard.

Rows are dealt over shards of about ``shard_rows`` by their id. A task turns one shard into one row: its
ids, vectors and, for each layer, a list of links. A row's highest layer is drawn from its id, each layer
holding about 1 / ``fan`` of the one below. Links of a layer join a row to near rows of it, taken so
that no two of them are nearer to each other than to it, and back. Within a shard candidates for links
come from matrix products, not from searches of the graph made so far, so a shard's graph doesn't
depend on the order of its rows, and a task that is run again makes the same.

A search enters a shard's top layer, walks greedily down and keeps the ``breadth`` best rows met on the
bottom layer. Shards are searched independently and their k best are merged, so recall is that of single
shards. ``exact`` gives the plain scan beside it, over the same stored vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from marlspike.operators.blocks import block_pairs, packed
from marlspike.operators.search import _measure, dense_topk, scaled
from marlspike.scratch import Scratch

_DDL = "shard int, dims int, ids binary, vectors binary, layers array<struct<members:binary,starts:binary,links:binary>>"
_LAYER = pa.struct([("members", pa.binary()), ("starts", pa.binary()), ("links", pa.binary())])
_ARROW = pa.schema([("shard", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("layers", pa.list_(_LAYER))])


def costs(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    raw = _measure(q, x, metric)
    return raw if metric == "l2" else -raw


def level(ids: np.ndarray, fan: int) -> np.ndarray:
    """The highest layer of each row: geometric, drawn from a hash of its id."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    share = ((h ^ (h >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / 2**53
    return np.floor(-np.log(np.maximum(share, 2.0**-60)) / np.log(fan)).astype(np.int64)


def links(x: np.ndarray, metric: str, most: int, wide: int, chunk: int = 512) -> list[np.ndarray]:
    """For each row at most ``most`` diverse near rows, and those that it is such a row of (2 * most in all, the nearest)."""
    n = len(x)
    chosen: list[list[int]] = []
    for start in range(0, n, chunk):
        cost = costs(x[start : start + chunk], x, metric)
        cost[np.arange(len(cost)), np.arange(start, start + len(cost))] = np.inf
        near = np.argsort(cost, axis=1, kind="stable")[:, : min(wide, n - 1)]
        for i, candidates in enumerate(near):
            between = costs(x[candidates], x[candidates], metric)
            kept: list[int] = []
            for c in range(len(candidates)):
                if all(between[c, o] > cost[i, candidates[c]] for o in kept):
                    kept.append(c)
                    if len(kept) == most:
                        break
            spare = [c for c in range(len(candidates)) if c not in kept][: max(0, most // 2 - len(kept))]
            chosen.append([int(candidates[c]) for c in (*kept, *spare)])
    both: list[set[int]] = [set(c) for c in chosen]
    for i, own in enumerate(chosen):
        for j in own:
            both[j].add(i)
    out = []
    for i, own in enumerate(both):
        own_links = np.array(sorted(own), dtype=np.int64)
        if len(own_links) > 2 * most:
            cost = costs(x[i : i + 1], x[own_links], metric)[0]
            own_links = np.sort(own_links[np.lexsort((own_links, cost))[: 2 * most]])
        out.append(own_links)
    return out


def graph(ids: np.ndarray, x: np.ndarray, metric: str, most: int, fan: int, wide: int) -> list[dict]:
    """Layers from the bottom up: members (places in the shard), and links among them as starts and places."""
    top = level(ids, fan)
    layers = []
    for layer in range(int(top.max()) + 1):
        members = np.flatnonzero(top >= layer)
        own = links(x[members], metric, most, wide)
        starts = np.concatenate([[0], np.cumsum([len(o) for o in own])])
        layers.append({"members": members.astype("<i4").tobytes(), "starts": starts.astype("<i4").tobytes(), "links": np.concatenate([members[o] for o in own]).astype("<i4").tobytes()})
    return layers


class Shard:
    """A stored shard, opened for searching."""

    def __init__(self, row: dict, metric: str):
        self.metric, self.ids = metric, np.frombuffer(row["ids"], "<i8")
        self.x = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dims"])
        self.layers = []
        for layer in row["layers"]:
            members, starts, held = (np.frombuffer(layer[c], "<i4") for c in ("members", "starts", "links"))
            self.layers.append((dict(zip(members.tolist(), range(len(members)), strict=True)), starts, held))

    def _links(self, layer: int, place: int) -> np.ndarray:
        at, starts, held = self.layers[layer]
        own = at[place]
        return held[starts[own] : starts[own + 1]]

    def search(self, q: np.ndarray, k: int, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, costs) of the k best rows met, ties by id."""
        own = lambda places: costs(q[None], self.x[places], self.metric)[0]
        starts = np.fromiter(self.layers[-1][0], dtype=np.int64)[:breadth]
        cost = own(starts)
        here, best = int(starts[cost.argmin()]), float(cost.min())
        for layer in range(len(self.layers) - 1, 0, -1):
            while len(near := self._links(layer, here)):
                cost = own(near)
                if cost.min() >= best:
                    break
                here, best = int(near[cost.argmin()]), float(cost.min())
        seen = {here}
        open_, kept = [(best, here)], [(-best, here)]
        while open_:
            cost_here, here = heapq.heappop(open_)
            if len(kept) >= breadth and cost_here > -kept[0][0]:
                break
            fresh = [int(p) for p in self._links(0, here) if p not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for c, p in zip(own(np.array(fresh)), fresh, strict=True):
                if len(kept) < breadth or c < -kept[0][0]:
                    heapq.heappush(open_, (float(c), p))
                    heapq.heappush(kept, (-float(c), p))
                    if len(kept) > breadth:
                        heapq.heappop(kept)
        places = np.array([p for _, p in kept])
        cost = np.array([-c for c, _ in kept])
        order = np.lexsort((self.ids[places], cost))[:k]
        return self.ids[places[order]], cost[order]


class HnswIndex:
    """An index in ``path``: one row a shard, written by ``build``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.metric = spark.read.parquet(f"{self.path}/settings").first()["metric"]
        self.shards = spark.read.schema(_DDL).parquet(f"{self.path}/shards")
        self.shards.scratch_path = f"{self.path}/shards"

    @classmethod
    def build(cls, rows: DataFrame, path: str, metric: str = "ip", shard_rows: int = 4096, most: int = 12, fan: int = 12, wide: int = 64) -> HnswIndex:
        """From rows (id, v). Rows with a null id, or a null or empty vector or one with nulls, are left out.

        Vectors of each length have shards of their own. A shard is one task's work: its vectors and a few
        thousand links a layer, whatever the table's size.
        """
        spark = rows.sparkSession
        good = F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull())
        rows = rows.where(good).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.size("v").alias("dims"))
        counts = {r["dims"]: r["count"] for r in rows.groupBy("dims").count().collect()}  # a row for each length
        shards = F.coalesce(*[F.when(F.col("dims") == d, -(-n // shard_rows)) for d, n in counts.items()], F.lit(1)) if counts else F.lit(1)
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), shards).cast("int"))

        def make(key: tuple, group: pa.Table) -> pa.Table:
            group = group.sort_by("id")
            shard, dims = (k.as_py() for k in key)
            ids = group.column("id").to_numpy()
            x = group.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dims)
            row = {"shard": shard, "dims": dims, "ids": ids.astype("<i8").tobytes(), "vectors": x.astype("<f8").tobytes(), "layers": graph(ids, x, metric, most, fan, wide)}
            return pa.Table.from_pylist([row], schema=_ARROW)

        dealt.groupBy("shard", "dims").applyInArrow(make, _DDL).write.mode("overwrite").option("compression", "lz4").parquet(f"{path}/shards")
        spark.createDataFrame([(metric,)], "metric string").write.mode("overwrite").parquet(f"{path}/settings")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int = 3, breadth: int = 64, profile: str = "faiss") -> DataFrame:
        """The k nearest rows found for each query (qid, v): qid, rank, id, score. Ranked and scaled as ``dense_topk`` does."""
        metric = self.metric

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_: dict[tuple, Shard] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    key = (row["g_shard"], row["dims"])
                    if key not in open_:
                        open_.clear()  # pairs come shard by shard
                        open_[key] = Shard({c.removeprefix("g_"): v for c, v in row.items()}, metric)
                    qids = np.frombuffer(row["a_qid"], "<i8")
                    q = np.frombuffer(row["a_vectors"], "<f8").reshape(-1, row["dims"])
                    found = [open_[key].search(v, k, max(breadth, k)) for v in q]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, [len(f[0]) for f in found])), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], names=["qid", "id", "cost"])

        asked = packed(queries.select("qid", F.col("v").cast("array<double>").alias("v")), ["qid"], 256)
        pairs = block_pairs(asked, self.shards).sortWithinPartitions("dims", "g_shard", "asked")
        found = pairs.mapInArrow(run, "qid long, id long, cost double")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("cost", "id"))).where(F.col("rank") <= k)
        raw = F.col("cost") if metric == "l2" else -F.col("cost")
        return ranked.select("qid", "rank", "id", F.round(scaled(raw, metric, profile), 6).alias("score"))

    def rows(self) -> DataFrame:
        """(id, v) of all rows."""

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    x = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dims"])
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["ids"], "<i8")), pa.array(list(x))], names=["id", "v"])

        return self.shards.select("dims", "ids", "vectors").mapInArrow(unpack, "id long, v array<double>")

    def exact(self, queries: DataFrame, k: int = 3) -> DataFrame:
        return dense_topk(queries, self.rows(), k, self.metric)

    def recall(self, queries: DataFrame, k: int = 10, breadth: int = 64) -> float:
        """Share of the exact k best that a search finds, over all given queries."""
        scratch = Scratch(self.spark, "hnsw")
        want = scratch.save(self.exact(queries, k).select("qid", "id"), "exact")
        got = self.search(queries, k, breadth).select("qid", "id")
        n = want.count()
        return want.join(got, ["qid", "id"], "left_semi").count() / n if n else 1.0
