"""Tables of vectors packed into blocks, and pairs of blocks dealt over a grid.

A query set against all rows is a matrix product for each pair of blocks. Both sides are packed on the
executors and written to the shared folder, so that a lost executor can't change what lies in a block;
the pairs are then dealt over a grid of cells, each side copied only along the other side's cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from marlspike.scratch import Scratch

#: Vectors of a block; a pair of blocks is one matrix product.
BLOCK = 2048
#: Pairs of blocks that a cell of the grid has at most, where there are more cells than tasks run at once.
PAIRS = 256
#: Cells have a partition each up to so many, beyond that they share them.
MOST_PARTITIONS = 50_000


def packed(rows: DataFrame, numbers: list[str], block: int = BLOCK, convert: Callable[[np.ndarray], np.ndarray] | None = None, kind: str | None = None) -> DataFrame:
    """(dims, vectors, and each of ``numbers``): blocks of rows with vectors ``v`` of one length, all as little-endian bytes.

    Numbers are 64-bit integers. Vectors keep their component type, or are of numpy type ``kind`` after
    ``convert``. Rows with a null among the numbers, or a null or empty vector or one with a null, drop out.
    """
    is_float = isinstance(rows.schema["v"].dataType.elementType, FloatType)
    kind = kind or ("<f4" if is_float else "<f8")
    schema = pa.schema([("dims", pa.int32()), ("vectors", pa.binary()), *((c, pa.binary()) for c in numbers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}

        def out(dims: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], schema=schema)

        for batch in batches:
            v = batch.column("v")
            sizes = np.diff(v.offsets.to_numpy())
            flat = v.values.to_numpy()[v.offsets[0].as_py() : v.offsets[-1].as_py()]
            own = [batch.column(c).to_numpy().astype("<i8") for c in numbers]
            for dims in np.unique(sizes):
                mine = sizes == dims
                x = flat[np.repeat(mine, sizes)].reshape(-1, dims)
                parts = held.setdefault(int(dims), [])
                parts.append([(convert(x) if convert else x).astype(kind), *(c[mine] for c in own)])
                if sum(len(p[0]) for p in parts) >= block:
                    whole = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    for start in range(0, len(whole[0]) - block + 1, block):
                        yield out(dims, [c[start : start + block] for c in whole])
                    rest = len(whole[0]) // block * block
                    held[int(dims)] = [[c[rest:] for c in whole]] if rest < len(whole[0]) else []
        for dims, parts in held.items():
            if parts:
                yield out(dims, [np.concatenate(c) for c in zip(*parts, strict=True)])

    v = F.col("v")
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull())
    for c in numbers:
        good &= F.col(c).isNotNull()
    chosen = rows.where(good).select("v", *[F.col(c).cast("long").alias(c) for c in numbers])
    return chosen.mapInArrow(run, ", ".join(["dims int", "vectors binary", *(f"{c} binary" for c in numbers)]))


def _cells(asked: int, given: int, at_once: int) -> tuple[int, int]:
    """Cells along both sides: enough for all tasks and for the bound on pairs, with least copying."""
    pairs = asked * given
    cells = max(1, min(pairs, max(4 * at_once, math.ceil(pairs / PAIRS))))
    over = min(asked, max(1, round(math.sqrt(cells * asked / given)))) if pairs else 1
    return over, min(given, math.ceil(cells / over)) if pairs else 1


def saved_blocks(blocks: DataFrame) -> DataFrame:
    return blocks if hasattr(blocks, "scratch_path") else Scratch(blocks.sparkSession, "blocks").save(blocks, "blocks", codec="lz4")


def block_pairs(asked: DataFrame, given: DataFrame) -> DataFrame:
    """Each block of ``asked`` beside each block of ``given`` that has vectors of the same length.

    Columns: ``asked`` (the number of the asking block), ``dims``, and those of both sides with a_ and g_
    before their names. A block of ``asked`` goes to as many cells as ``given`` is split into, and the
    other way round, so no task has more than its share of the pairs, whatever the lengths of vectors.
    Both sides are written first, but for tables that ``Scratch`` or an index has written.
    """
    asked, given = saved_blocks(asked), saved_blocks(given)
    over, down = _cells(asked.count(), given.count(), asked.sparkSession.sparkContext.defaultParallelism)
    number = F.monotonically_increasing_id()  # of rows of a written table: the same whenever a task is repeated
    place = lambda n: (F.shiftright("__n", 33) + F.col("__n").bitwiseAND(2**33 - 1)) % n
    left = asked.select(*[F.col(c).alias(f"a_{c}") for c in asked.columns], number.alias("__n"))
    left = left.withColumn("__cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda r: (place(over) * down + r).cast("int")))).withColumnRenamed("__n", "asked")
    right = given.select(*[F.col(c).alias(f"g_{c}") for c in given.columns], number.alias("__n"))
    right = right.withColumn("__cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(over - 1)), lambda q: (q * down + place(down)).cast("int")))).drop("__n")
    cells = over * down
    deal = (lambda side: side.repartitionById(cells, F.col("__cell"))) if cells <= MOST_PARTITIONS else (lambda side: side.repartition(MOST_PARTITIONS, "__cell"))
    left, right = (deal(side) for side in (left, right))
    return left.join(right, "__cell").where("a_dims = g_dims").withColumnRenamed("a_dims", "dims").drop("__cell", "g_dims")


def first_k(groups: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Places of the k first rows of each group by the given order, both from the most to the least significant key."""
    by = np.lexsort((*order[::-1], *groups[::-1]))
    new = np.zeros(len(by), dtype=bool)
    new[:1] = True
    for g in groups:
        new[1:] |= g[by][1:] != g[by][:-1]
    first = np.flatnonzero(new)
    place = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    return by[place < k]
