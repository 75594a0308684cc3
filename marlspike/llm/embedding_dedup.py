"""Near-duplicate embeddings by randomised-rotation binary codes.

A vector's code is the signs of its coordinates after random rotations. With each code goes its
correction factor, the inner product c of the vector and its own code vector; the inner product of
another vector with the code vector, divided by c, estimates the cosine of the two without bias. If
the cosine is at least t, the estimate falls short of it by at most
eps * sqrt(1 - t^2) * sqrt((1 - c^2) / c^2) / sqrt(bits - 1) but for a chance that a normal variable
exceeds eps; pairs whose estimate is below that bound from both sides are passed over, all others are
recomputed from the vectors in double precision.

Which pairs are estimated: those whose codes agree in one of ``tables`` bands of ``band`` bits. At
cosine t two signs agree with chance 1 - acos(t) / pi, so the number of tables follows from the band
and the chance ``miss`` of losing a pair at the threshold itself; pairs above it are lost more rarely.
The band grows with log2 of the number of vectors. A pair is counted in the first band it agrees in.

Two rounds: bands first deal codes with their factors and the vector in steps of one byte, whose
rounding widens the bound; they leave the members of undecided pairs, not the pairs. Only these members
then meet again, in the same groups, with their exact vectors. So a vector that resembles no other
never travels whole.

Equal vectors are one node with a weight. A band's group is never expanded into pairs outside its
task: it leaves link counts and the edges of a spanning forest. Groups of more than ``block`` vectors
are cut into blocks, and pairs of blocks are separate tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from marlspike.llm.common import bounded, table
from marlspike.operators.components import connected_components
from marlspike.scratch import Scratch


@dataclass(frozen=True)
class Codes:
    """Parameters of the codes for one number of vectors."""

    threshold: float = 0.9
    miss: float = 1e-3
    eps: float = 6.0
    block: int = 2048
    most_bits: int = 256
    seed: int = 11
    band: int = 8
    tables: int = 22

    @staticmethod
    def of(n: int, **given) -> Codes:
        base = Codes(**given)
        band = min(24, max(6, math.ceil(math.log2(max(n, 1) / 128 + 1))))
        agree = (1 - math.acos(min(1.0, base.threshold)) / math.pi) ** band
        return Codes(**given, band=band, tables=math.ceil(math.log(base.miss) / math.log(1 - agree)))


@dataclass
class Rotations:
    """Orthogonal matrices stacked so that they give at least the bits wanted."""

    dims: int
    codes: Codes
    rows: np.ndarray = field(init=False)

    def __post_init__(self):
        rng = np.random.default_rng((self.codes.seed, self.dims))
        n = -(-self.codes.band * self.codes.tables // self.dims)
        self.rows = np.concatenate([np.linalg.qr(rng.standard_normal((self.dims, self.dims)))[0].T for _ in range(n)])
        whole = max(1, min(n, self.codes.most_bits // self.dims))
        self.used = whole * self.dims  # bits of the estimate: whole rotations, a tight frame
        self.scale = 1 / math.sqrt(whole)

    def keys(self, signs: np.ndarray) -> np.ndarray:
        bits = signs[:, : self.codes.band * self.codes.tables].reshape(len(signs), self.codes.tables, self.codes.band)
        return bits @ (1 << np.arange(self.codes.band, dtype=np.int64))


_rotations: dict[tuple, Rotations] = {}


def rotations(dims: int, codes: Codes) -> Rotations:
    key = (dims, codes)
    if key not in _rotations:
        _rotations[key] = Rotations(dims, codes)
    return _rotations[key]


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _raw(kind: str):
    """Vectors as bytes; null for those that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values in batch.column("v"):
                raw = None
                if values.is_valid and len(values) and not values.values.null_count:
                    x = values.values.to_numpy(zero_copy_only=False).astype(kind)
                    if np.isfinite(x).all() and np.any(x):
                        raw = (x + np.zeros(1, dtype=kind)).tobytes()  # -0.0 becomes 0.0
                out.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "raw"])

    return run


def _steps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in whole steps of a byte each, and the length of a step."""
    step = np.abs(x).max(axis=1) / 127
    return np.rint(x / step[:, None]).astype(np.int8), step


_CODED = ("code", "factor", "steps", "step", "lost")
_CODED_TYPES = "code binary, factor double, steps binary, step double, lost double"


def _encode(kind: str, codes: Codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                r = rotations(int(size) // np.dtype(kind).itemsize, codes)
                x = _unit([raw[i] for i in own], kind)
                turned = x @ r.rows.T
                signs = turned > 0
                c = np.abs(turned[:, : r.used]).sum(axis=1) * r.scale / math.sqrt(r.used)
                steps, step = _steps(x)
                lost = np.linalg.norm(x - steps * step[:, None], axis=1)
                part = batch.take(pa.array(own))
                keys = pa.array(r.keys(signs).tolist(), pa.list_(pa.int64()))
                code, small = (pa.array([y.tobytes() for y in z], pa.binary()) for z in (np.packbits(signs, axis=1), steps))
                yield pa.RecordBatch.from_arrays([*part.columns, code, pa.array(c), small, pa.array(step), pa.array(lost), keys], names=[*batch.schema.names, *_CODED, "keys"])

    return run


_GROUP = ("size", "tab", "key", "left", "right")
_ROUGH = f"hot boolean, size int, tab int, key long, left int, right int, block int, node long, {_CODED_TYPES}"
_FOUND = "kind byte, a long, b long, n long"
_ARROW = {"byte": pa.int8(), "boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
COUNT, EDGE = 0, 1


def _out(schema: str, size_: int, **columns) -> pa.RecordBatch:
    """A batch of that schema; columns that aren't given are null, single values fill theirs."""
    arrays = []
    for name, kind in (x.split() for x in schema.split(", ")):
        value = columns.get(name)
        arrays.append(pa.nulls(size_, _ARROW[kind]) if value is None else pa.array([value] * size_ if isinstance(value, (int, bool)) else value, _ARROW[kind]))
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (before == label).all():
            break
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def _undecided(x: np.ndarray, code: list[bytes], factor: np.ndarray, lost: np.ndarray | float, block: np.ndarray, tab: int, codes: Codes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one band's group whose estimate may reach the threshold and that agree in no earlier band.

    ``x`` may be rounded; ``lost`` is the length of what rounding took from each vector. As a code vector
    has length 1, an estimate moves by that over the factor at most.
    """
    r = rotations(x.shape[1], codes)
    signs = np.unpackbits(np.array([np.frombuffer(c, dtype=np.uint8) for c in code]), axis=1, count=len(r.rows))
    turned = (x @ r.rows[: r.used].T * r.scale).astype(np.float32)
    estimate = turned @ (signs[:, : r.used].T.astype(np.float32) * 2 - 1) / (math.sqrt(r.used) * factor.astype(np.float32))
    slack = codes.eps * math.sqrt(1 - codes.threshold**2) * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(r.used - 1 or 1)
    estimate += np.float32(1.0001) * np.outer(np.broadcast_to(lost, len(x)), 1 / factor).astype(np.float32)
    may = estimate >= (codes.threshold - 1e-4 - slack).astype(np.float32)
    a, b = np.nonzero(np.triu(may | may.T, 1))
    if len(np.unique(block)) > 1:
        across = block[a] != block[b]
        a, b = a[across], b[across]
    keys = r.keys(signs)
    for lo in range(0, len(a), 200_000):
        i, j = a[lo : lo + 200_000], b[lo : lo + 200_000]
        fresh = ~(keys[i, :tab] == keys[j, :tab]).any(axis=1)
        yield i[fresh], j[fresh]


def links(raw: list[bytes], code: list[bytes], factor: np.ndarray, block: np.ndarray, tab: int, kind: str, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one band's group that are linked and agree in no earlier band."""
    x = _unit(raw, kind)
    found_a, found_b = [], []
    for i, j in _undecided(x, code, factor, 0.0, block, tab, codes):
        linked = np.einsum("ij,ij->i", x[i], x[j]) >= codes.threshold
        found_a.append(i[linked])
        found_b.append(j[linked])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.zeros(0, dtype=int),) * 2


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], most: int | None = None) -> Iterator[tuple[tuple, list[tuple], int | None]]:
    """(group, rows, block) of sorted rows; groups of more than ``most`` rows come in blocks, whose number is null for whole groups."""
    group, rows, block = None, [], None
    for batch in batches:
        own, rest = ([batch.column(c).to_pylist() for c in names] for names in (_GROUP, columns))
        for key, row in zip(zip(*own, strict=True), zip(*rest, strict=True), strict=True):
            if key != group:
                if rows:
                    yield group, rows, block
                group, rows, block = key, [], None
            elif most and len(rows) == most:
                yield group, rows, block or 0
                rows, block = [], (block or 0) + 1
            rows.append(row)
    if rows:
        yield group, rows, block


def _rough(codes: Codes, most: int | None):
    """Members of each group's undecided pairs; groups of more than ``most`` rows go on whole, in blocks, as hot rows."""
    names = ("node", "block", *_CODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows, cut in _groups(batches, names, most):
            node, block, code, factor, steps, step, lost = zip(*rows, strict=True)
            place = dict(zip(_GROUP, group, strict=True))
            if cut is not None:
                yield _out(_ROUGH, len(rows), hot=True, **place | {"block": cut}, node=node, code=code, factor=factor, steps=steps, step=step, lost=lost)
            elif len(rows) > 1:
                x = np.frombuffer(b"".join(steps), dtype=np.int8).reshape(len(rows), -1) * np.array(step)[:, None]
                need = np.zeros(len(rows), dtype=bool)
                for i, j in _undecided(x, list(code), np.array(factor), np.array(lost), np.array(block), place["tab"], codes):
                    need[i] = need[j] = True
                at = np.flatnonzero(need)
                if len(at):
                    yield _out(_ROUGH, len(at), hot=False, **place, block=np.array(block)[at], node=np.array(node)[at])

    return run


def _exact(kind: str, codes: Codes):
    """Link counts of each group's nodes and the edges of its spanning forest, from the vectors themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows, _ in _groups(batches, ("a", "weight", "raw", "code", "factor", "block")):
            node, weight, raw, code, factor, block = zip(*rows, strict=True)
            node, weight = np.array(node), np.array(weight)
            a, b = links(list(raw), list(code), np.array(factor), np.array(block), group[1], kind, codes)
            if not len(a):
                continue
            n = np.bincount(a, weight[b], len(rows)) + np.bincount(b, weight[a], len(rows))
            some = np.flatnonzero(n)
            yield _out(_FOUND, len(some), kind=COUNT, a=node[some], n=n[some].astype(np.int64))
            x, y = _forest(a, b, len(rows))
            yield _out(_FOUND, len(x), kind=EDGE, a=node[x], b=node[y])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, **settings) -> DataFrame:
    """For rows (vec_id, embedding): vec_id, n_links, component_id, kept.

    Two vectors of equal length are linked if their cosine, in double precision, is at least the
    threshold. Vectors that are null, empty or zero, or hold null or non-finite components, and rows
    with a null vec_id link with nothing; the latter have a null component and aren't kept. Each row is
    a vector of its own, so copies are linked with each other; different vectors with one vec_id are one
    node. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"
    given = bounded(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v") if kind == "<f4" else F.col("embedding").cast("array<double>").alias("v"))
    rows = scratch.save(given.mapInArrow(_raw(kind), "vec_id long, raw binary"), "raw", codec="none")
    live = rows.where("vec_id is not null and raw is not null")
    alike = live.groupBy("raw").agg(F.min("vec_id").alias("a"), F.count("*").alias("weight"))
    nodes = scratch.save(alike.withColumn("node", F.monotonically_increasing_id()), "nodes", codec="none")
    codes = Codes.of(nodes.count(), threshold=threshold, **settings)  # nodes are numbered, as different vectors may share an id

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(*_GROUP).sortWithinPartitions(*_GROUP)

    coded = scratch.save(nodes.mapInArrow(_encode(kind, codes), f"raw binary, a long, weight long, node long, {_CODED_TYPES}, keys array<long>"), "coded", codec="none")
    none = F.lit(0)
    banded = coded.select("node", *_CODED, F.length("raw").alias("size"), none.alias("left"), none.alias("right"), none.alias("block"), F.posexplode("keys").alias("tab", "key"))
    rough = scratch.save(dealt(banded).mapInArrow(_rough(codes, codes.block), _ROUGH), "rough")
    hot = rough.where("hot")
    blocks = hot.groupBy("size", "tab", "key").agg((F.max("block") + 1).alias("blocks"))
    pairs = hot.drop("left", "right").join(blocks, ["size", "tab", "key"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")}).select(*_GROUP, "block", "node", *_CODED)
    more = scratch.save(dealt(pairs).mapInArrow(_rough(codes, None), _ROUGH), "rough")
    members = rough.where("not hot").unionByName(more).select(*_GROUP, "block", "node")
    whole = members.join(coded.select("node", "a", "weight", "raw", "code", "factor"), "node")
    found = scratch.save(dealt(whole).mapInArrow(_exact(kind, codes), _FOUND), "links")

    counts = found.where(F.col("kind") == COUNT).groupBy("a").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where(F.col("kind") == EDGE), "a", "b").withColumnRenamed("node", "a")
    named = rows.join(nodes, "raw", "left").select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("a")).alias("a"), "weight")
    out = named.join(counts, "a", "left").join(parts, "a", "left")
    links_ = F.when(F.col("a").isNull(), F.lit(0)).otherwise(F.coalesce("n", F.lit(0)) + F.col("weight") - 1)
    component = F.coalesce("component", "a", "vec_id")
    return out.select("vec_id", links_.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES = {"op4_embedding_near_dedup": op4_embedding_near_dedup}
SQL = {
    "op4_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN 0 ELSE 1 END)) = 0
    AND len(list_filter(embedding, lambda x: x IS NULL)) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c ON e.vec_id = c.node
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON e.vec_id = n.a
"""
}
