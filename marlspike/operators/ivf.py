"""A vector index of cells with product-quantised codes, as tables in a folder.

Cells are k-means centroids and codes are k-means centroids of sub-vectors of what is left of a row
behind its cell's centroid. Both are fitted on a sample of about ``fit_rows`` rows, the one thing here
that doesn't see every row; the index itself holds every row, packed into blocks in files by cell. A
search probes the cells nearest to each query, ranks their rows by sums over distance tables (reading ids
and codes only), fetches the vectors of the best and ranks these exactly. ``refine=None`` ranks every
row of the probed cells exactly instead, so that probing all cells is exact search.

Cells and queries meet in groups of at most ``GROUP_BLOCKS`` blocks and about ``GROUP_QUERIES`` queries,
however many rows or queries one cell has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from marlspike.operators.search import _measure, scaled
from marlspike.scratch import Scratch, exists

BLOCK, GROUP_BLOCKS, GROUP_QUERIES = 2048, 16, 2048


@dataclass(frozen=True)
class IvfSettings:
    """``fit_rows`` bounds the sample that cells and codes are fitted on; ``parts`` must divide the vectors' length.

    ``recall`` is the share of the ten nearest rows that the number of probes found in fitting holds.
    """

    metric: str = "ip"
    cells: int = 64
    parts: int = 16
    codes: int = 256
    fit_rows: int = 50_000
    rounds: int = 15
    recall: float = 0.95


@dataclass(frozen=True)
class Model:
    cells: np.ndarray  # (cells, dims)
    books: np.ndarray  # (parts, codes, dims / parts)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.cells)
        rest = (x - self.cells[cell]).reshape(len(x), len(self.books), -1)
        return cell, np.stack([nearest(rest[:, p], book) for p, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def costs(self, q: np.ndarray, cell: int, codes: np.ndarray, metric: str) -> np.ndarray:
        """Estimated cost of each coded row of a cell for each query, the less the nearer."""
        own = q - self.cells[cell] if metric == "l2" else q
        own = own.reshape(len(q), len(self.books), -1)
        table = np.einsum("qps,pcs->qpc", own, self.books)
        if metric == "l2":
            table = (own**2).sum(axis=2)[:, :, None] - 2 * table + (self.books**2).sum(axis=2)[None]
        total = np.zeros((len(q), len(codes)))
        for p in range(len(self.books)):
            total += table[:, p, codes[:, p]]
        return total if metric == "l2" else -(total + (q @ self.cells[cell])[:, None])


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1)[None] - 2 * (x @ centroids.T), axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 0) -> np.ndarray:
    """At most k centroids by Lloyd's rounds; a centroid without rows takes the row furthest from its own."""
    rng = np.random.default_rng(seed)
    kinds = np.unique(x, axis=0)
    centroids = kinds[rng.choice(len(kinds), min(k, len(kinds)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        own = nearest(x, centroids)
        count = np.bincount(own, minlength=len(centroids))
        sums = np.stack([np.bincount(own, weights=column, minlength=len(centroids)) for column in x.T], axis=1)
        moved = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            far = np.argsort(((x - centroids[own]) ** 2).sum(axis=1))[::-1][: len(empty)]
            moved[empty[: len(far)]] = x[far]
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def probes_for(x: np.ndarray, cells: np.ndarray, settings: IvfSettings, queries: int = 500, k: int = 10) -> int:
    """The least number of cells to probe that holds the wanted share of the k nearest rows of some of the sample, in the sample.

    In the whole table, whose rows lie closer, nearest rows are nearer and their cells are found no later.
    """
    q = x[:: max(1, len(x) // queries)]
    cost, to_cells = (-(q @ y.T) if settings.metric != "l2" else (y**2).sum(axis=1)[None] - 2 * (q @ y.T) for y in (x, cells))
    near = np.argsort(cost, axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(to_cells, axis=1, kind="stable"), axis=1)  # of each cell for each query
    needed = np.sort(np.take_along_axis(place, nearest(x, cells)[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(settings.recall * len(needed))))]) + 1


def _fit(settings: IvfSettings, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = [_matrix(batch.column("v"), dims, settings.metric) for batch in batches if batch.num_rows]
        if not x:
            return
        x = np.concatenate(x)
        cells = kmeans(x, settings.cells, settings.rounds)
        rest = (x - cells[nearest(x, cells)]).reshape(len(x), settings.parts, -1)
        rows = [("cell", i, c.tolist()) for i, c in enumerate(cells)]
        for p in range(settings.parts):
            book = kmeans(rest[:, p], settings.codes, settings.rounds, p + 1)
            book = np.concatenate([book, np.repeat(book[-1:], settings.codes - len(book), axis=0)])
            rows += [("book", p * settings.codes + i, c.tolist()) for i, c in enumerate(book)]
        rows.append(("probes", probes_for(x, cells, settings), []))
        types = (pa.string(), pa.int32(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["kind", "number", "centroid"])

    return run


def _matrix(v: pa.Array, dims: int, metric: str) -> np.ndarray:
    x = v.flatten().to_numpy().astype(np.float64).reshape(-1, dims)
    if metric == "cosine":
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(length > 0, length, 1)
    return x


def _assigned(model, dims: int, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"), dims, metric)
                cell, codes = model.value.assign(x)
                raw = batch.column("v").flatten().to_numpy().astype("<f8").reshape(-1, dims)
                columns = [batch.column("id"), batch.column("tag"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes]), pa.array([r.tobytes() for r in raw])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "tag", "cell", "code", "vector"])

    return run


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell as blocks. A block's number is made of its task's and its place there; it is fixed once written."""
    start, made, held, now = TaskContext.get().partitionId() << 32, 0, [], None

    def out() -> pa.RecordBatch:
        ids, tags, codes, vectors = zip(*held, strict=True)
        columns = [[now], [start + made], [np.array(ids, "<i8").tobytes()], [np.array(tags, "<i8").tobytes()], [b"".join(codes)], [b"".join(vectors)]]
        types = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["cell", "block", "ids", "tags", "codes", "vectors"])

    for batch in batches:
        for cell, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", "id", "tag", "code", "vector")), strict=True):
            if held and (cell != now or len(held) == BLOCK):
                yield out()
                made, held = made + 1, []
            now = cell
            held.append(row)
    if held:
        yield out()


_BLOCKS = "cell int, block long, ids binary, tags binary, codes binary, vectors binary"


class IvfIndex:
    """An index in ``path``: build it once, then open, search, add and delete."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        row = spark.read.parquet(f"{self.path}/settings").first().asDict()
        self.dims = row.pop("dims")
        self.settings = IvfSettings(**row)
        found = spark.read.parquet(f"{self.path}/model").orderBy("kind", "number").collect()  # cells + parts * codes centroids, by the settings
        self.probes = next(r["number"] for r in found if r["kind"] == "probes")
        books = np.array([r["centroid"] for r in found if r["kind"] == "book"])
        self.model = Model(np.array([r["centroid"] for r in found if r["kind"] == "cell"]), books.reshape(self.settings.parts, self.settings.codes, -1))
        self.shared = spark.sparkContext.broadcast(self.model)

    @classmethod
    def build(cls, rows: DataFrame, path: str, settings: IvfSettings = IvfSettings()) -> IvfIndex:
        """Fits and writes the index of rows (id, v, and perhaps tag, a whole number to filter by).

        Rows with a null id or a null or empty vector, or one with nulls, are left out. Vectors of
        different lengths, and a length that ``parts`` doesn't divide, are an error. At most 256 codes.
        """
        spark, rows = rows.sparkSession, _clean(rows)
        lengths = [r["d"] for r in rows.select(F.size("v").alias("d")).distinct().limit(2).collect()]
        if len(lengths) != 1 or lengths[0] % settings.parts:
            raise ValueError(f"vectors of lengths {lengths} can't be indexed in {settings.parts} parts")
        if not 0 < settings.codes <= 256:
            raise ValueError("codes are bytes")
        dims, total = lengths[0], rows.count()
        share = min(1.0, settings.fit_rows / total)
        sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("v").limit(2 * settings.fit_rows)
        spark.createDataFrame([tuple(asdict(settings).values()) + (dims,)], [*asdict(settings), "dims"]).write.mode("overwrite").parquet(f"{path}/settings")
        fitted = sample.coalesce(1).mapInArrow(_fit(settings, dims), "kind string, number int, centroid array<double>")
        fitted.write.mode("overwrite").parquet(f"{path}/model")
        index = cls(spark, path)
        index._write(rows, "overwrite")
        return index

    def _write(self, rows: DataFrame, mode: str) -> None:
        coded = rows.mapInArrow(_assigned(self.shared, self.dims, self.settings.metric), "id long, tag long, cell int, code binary, vector binary")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = coded.repartition(parts, "cell", F.pmod(F.xxhash64("id"), F.lit(max(1, parts // 4)))).sortWithinPartitions("cell", "id")
        blocks = Scratch(self.spark, "ivf").save(dealt.mapInArrow(_in_blocks, _BLOCKS), "blocks", codec="lz4")
        start = 0
        if mode == "append":
            start = self.spark.read.parquet(f"{self.path}/blocks").agg(F.max("block")).first()[0] + 1
        blocks.withColumn("block", F.col("block") + start).write.mode(mode).partitionBy("cell").option("compression", "lz4").parquet(f"{self.path}/blocks")

    def _blocks(self, *columns: str) -> DataFrame:
        return self.spark.read.schema(_BLOCKS).parquet(f"{self.path}/blocks").select("cell", "block", "ids", *columns)

    def _deleted(self) -> DataFrame | None:
        if not exists(self.spark, f"{self.path}/deleted"):
            return None
        gone = self.spark.read.parquet(f"{self.path}/deleted")
        return gone.groupBy("block").agg(F.collect_set("place").alias("gone"))  # at most BLOCK places

    def add(self, rows: DataFrame) -> None:
        """More rows under the same cells and codes."""
        self._write(_clean(rows), "append")

    def delete(self, ids: DataFrame) -> int:
        """Marks the rows of ids (id) as deleted, in a table of places by block; how many there were."""
        live = self.rows().select("id", "block", "place")
        gone = Scratch(self.spark, "ivf").save(live.join(ids.select("id").distinct(), "id", "left_semi").select("block", "place"), "gone")
        n = gone.count()
        if n:
            gone.write.mode("append").parquet(f"{self.path}/deleted")
        return n

    def rows(self) -> DataFrame:
        """(id, cell, block, place) of all rows that aren't deleted."""

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cell, block, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids = np.frombuffer(ids, "<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), cell, np.int32)), pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids), dtype=np.int32))], names=["id", "cell", "block", "place"])

        every = self._blocks().mapInArrow(unpack, "id long, cell int, block long, place int")
        gone = self._deleted()
        return every if gone is None else every.join(gone.select("block", F.explode("gone").alias("place")), ["block", "place"], "left_anti")

    def search(self, queries: DataFrame, k: int = 3, probes: int | None = None, refine: int | None = 100, tags: list[int] | None = None, profile: str = "faiss") -> DataFrame:
        """The k nearest rows of each query (qid, v) found in its ``probes`` nearest cells (as many as fitting found to need): qid, rank, id, score.

        The ``refine`` best rows by their codes are ranked exactly, as ``dense_topk`` ranks; with None all
        rows of these cells are. ``tags`` are those a row may have. Queries with a null qid, or a null
        vector or one of another length, find nothing.
        """
        scratch, metric, dims = Scratch(self.spark, "ivf"), self.settings.metric, self.dims
        probes = min(probes or self.probes, len(self.model.cells))
        asked = queries.where(F.col("qid").isNotNull() & (F.size("v") == dims) & ~F.exists("v", lambda c: c.isNull())).select(F.col("qid").cast("long").alias("qid"), F.col("v").cast("array<double>").alias("v"))
        asked = scratch.save(asked, "asked")
        probed = scratch.save(asked.mapInArrow(_probe(self.shared, dims, metric, probes), "cell int, qid long, v array<double>"), "probed")
        cells = {r["cell"]: r["count"] for r in probed.groupBy("cell").count().collect()}  # no more rows than there are cells
        blocks = self._blocks("tags", "vectors" if refine is None else "codes").where(F.col("cell").isin(list(cells)))
        counts = {r["cell"]: r["count"] for r in blocks.groupBy("cell").count().collect()}
        sizes = [(c, -(-counts[c] // GROUP_BLOCKS), -(-n // GROUP_QUERIES)) for c, n in cells.items() if c in counts]
        if not sizes:
            return self.spark.createDataFrame([], "qid long, rank int, id long, score double")
        table = lambda: F.broadcast(self.spark.createDataFrame(sizes, "cell int, slots int, sides int"))  # noqa: E731  no more rows than there are cells
        left = probed.join(table(), "cell").withColumns({"side": F.pmod(F.xxhash64("qid"), F.col("sides")), "slot": F.explode(F.sequence(F.lit(0), F.col("slots") - 1))})
        if (gone := self._deleted()) is not None:
            blocks = blocks.join(gone, "block", "left")
        right = blocks.join(table(), "cell").withColumns({"slot": F.pmod(F.xxhash64("block"), F.col("slots")).cast("int"), "side": F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - F.lit(1).cast("long")))})
        group = ("cell", "slot", "side")
        scan = _scan(self.shared, dims, metric, k if refine is None else refine, refine is None, None if tags is None else list(tags))
        found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(scan, "qid long, block long, place int, id long, cost double")
        if refine is not None:
            best = found.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("cost", "id"))).where(F.col("r") <= refine)
            best = scratch.save(best.select("qid", "block", "place", F.pmod(F.xxhash64("qid"), F.lit(-(-sum(cells.values()) // (probes * GROUP_QUERIES)))).alias("side")), "best")
            wanted = best.groupBy("block", "side").agg(F.collect_list(F.struct("qid", "place")).alias("wanted"))  # bounded by a block's rows times a side's queries
            fetched = self._blocks("vectors").where(F.col("cell").isin(list(cells))).join(wanted, "block").mapInArrow(_fetch(dims), "qid long, id long, x binary")
            found = fetched.join(asked, "qid").mapInArrow(_exact(dims, metric), "qid long, id long, cost double")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("cost", "id"))).where(F.col("rank") <= k)
        raw = F.col("cost") if metric == "l2" else -F.col("cost")
        return ranked.select("qid", "rank", "id", F.round(scaled(raw, metric, profile), 6).alias("score"))


def _clean(rows: DataFrame) -> DataFrame:
    tag = F.coalesce(F.col("tag").cast("long"), F.lit(-1)) if "tag" in rows.columns else F.lit(-1).cast("long")
    good = F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull())
    return rows.where(good).select(F.col("id").cast("long").alias("id"), tag.alias("tag"), "v")


def _probe(model, dims: int, metric: str, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, cells = _matrix(batch.column("v"), dims, metric), model.value.cells
            cost = -(q @ cells.T)
            if metric == "l2":
                cost = (cells**2).sum(axis=1)[None] + 2 * cost
            chosen = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
            at = pa.array(np.repeat(np.arange(len(q)), probes))
            yield pa.RecordBatch.from_arrays([pa.array(chosen.ravel().astype(np.int32)), batch.column("qid").take(at), batch.column("v").take(at)], names=["cell", "qid", "v"])

    return run


def _scan(model, dims: int, metric: str, most: int, exact: bool, tags: list[int] | None):
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64())
    names = ["qid", "block", "place", "id", "cost"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        qid = left.column("qid").to_numpy()
        q = left.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        plain = q if metric != "cosine" else q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        parts = []
        for row in right.to_pylist():
            ids = np.frombuffer(row["ids"], "<i8")
            if exact:
                raw = _measure(q, np.frombuffer(row["vectors"], "<f8").reshape(-1, dims), metric)
                cost = raw if metric == "l2" else -raw
            else:
                cost = model.value.costs(plain, row["cell"], np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1), metric)
            live = np.ones(len(ids), dtype=bool)
            if row.get("gone"):
                live[row["gone"]] = False
            if tags is not None:
                live &= np.isin(np.frombuffer(row["tags"], "<i8"), tags)
            place = np.flatnonzero(live)
            parts.append((cost[:, place], ids[place], np.full(len(place), row["block"]), place))
        cost = np.concatenate([p[0] for p in parts], axis=1)
        ids, block, place = (np.concatenate([p[n] for p in parts]) for n in (1, 2, 3))
        if not len(ids):
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        order = np.argsort(ids, kind="stable")  # ties by id
        cost, ids, block, place = cost[:, order], ids[order], block[order], place[order]
        chosen = np.argsort(cost, axis=1, kind="stable")[:, :most]
        i = np.repeat(np.arange(len(qid)), chosen.shape[1])
        j = chosen.ravel()
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip((qid[i], block[j], place[j], ids[j], cost[i, j]), kinds, strict=True)], names=names)

    return run


def _fetch(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, wanted in zip(*(batch.column(c).to_pylist() for c in ("ids", "vectors", "wanted")), strict=True):
                ids, places = np.frombuffer(ids, "<i8"), [w["place"] for w in wanted]
                rows = [vectors[8 * dims * p : 8 * dims * (p + 1)] for p in places]
                yield pa.RecordBatch.from_arrays([pa.array([w["qid"] for w in wanted], pa.int64()), pa.array(ids[places]), pa.array(rows, pa.binary())], names=["qid", "id", "x"])

    return run


def _exact(dims: int, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = batch.column("v").flatten().to_numpy().reshape(-1, dims)
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<f8").reshape(-1, dims)
            raw = np.concatenate([_measure(q[i : i + 1], x[i : i + 1], metric)[0] for i in range(len(q))])
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("id"), pa.array(raw if metric == "l2" else -raw)], names=["qid", "id", "cost"])

    return run
