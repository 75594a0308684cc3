"""Hard negatives of anchors from a full sort of their integer scores.

Components become integers, so scores are exact and ties are ties. Anchors and rows are packed into
blocks and each anchor block meets each row block once in either pass (``operators.blocks`` deals the
pairs). There all scores of an anchor are sorted by score and id. The first pass reads the first rows of
the anchor's label, which merged over the blocks are its positives. The second pass finds each positive's
upper limit by binary search among the rows of other labels and reads on from there while scores reach
the lower limit. No task holds more than one pair of blocks and the few rows read so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from marlspike.llm.common import bounded, table
from marlspike.operators.blocks import block_pairs, first_k, packed, saved_blocks
from marlspike.scratch import Scratch

SCALE = 256
ANCHORS, ROWS = 256, 2048
#: Anchor blocks whose rows a task holds before it hands them on.
HELD = 64


def integers(v: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * v.astype(np.float64)).astype(np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of both: as doubles where those hold every sum, else as 64-bit integers."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if reach < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if reach >= 2**62:
        raise OverflowError("scores don't fit in 64 bits")
    return a @ b.T


def _sorted(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the scores of all rows from the highest down, ties by id, and the rows' places."""
    s = scores(a, b)
    order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=-1)
    return np.take_along_axis(s, order, axis=1), order


def _read(passes, keys: list[str], values: list[str], n_groups: int, k: int):
    """Runs ``passes`` over pairs of blocks and merges what they read for a group of an anchor block, over all of a task's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, ...]] = {}

        def out(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=[*keys, *values])

        for batch in batches:
            for row in batch.to_pylist():
                numbers = {c: np.frombuffer(b, "<i8") for c, b in row.items() if c not in ("asked", "dims")}
                found = passes(numbers, numbers["a_vectors"].reshape(-1, row["dims"]), numbers["g_vectors"].reshape(-1, row["dims"]))
                if row["asked"] in held:
                    found = tuple(np.concatenate(c) for c in zip(held[row["asked"]], found, strict=True))
                kept = first_k(found[:n_groups], (-found[-1], found[-2]), k)
                held[row["asked"]] = tuple(c[kept] for c in found)
                if len(held) > HELD:
                    yield out(list(held.values()))
                    held.clear()
        if held:
            yield out(list(held.values()))

    return run


def _positives(k: int):
    def passes(n: dict, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        s, order = _sorted(a, b, n["g_id"])
        fit = (n["g_label"][order] == n["a_label"][:, None]) & (n["g_id"][order] != n["a_id"][:, None])
        i, j = np.nonzero(fit & (np.cumsum(fit, axis=1) <= k))
        return n["a_id"][i], n["a_mark"][i], n["g_id"][order[i, j]], s[i, j]

    return passes


def _negatives(k: int, positives: int, lower: int, upper: int):
    def passes(n: dict, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        s, order = _sorted(a, b, n["g_id"])
        best = np.stack([n[f"a_s{p}"] for p in range(positives)], axis=1)
        most, least = upper * best // 100, -(-lower * best // 100)
        who, which, where = [], [], []
        for i in range(len(a)):
            other = np.flatnonzero(n["g_label"][order[i]] != n["a_label"][i])
            falling = s[i, other]
            start = np.searchsorted(-falling, -most[i, : n["a_n"][i]], side="left")
            for p, first in enumerate(start):
                read = other[first : first + k][falling[first : first + k] >= least[i, p]]
                who.append(np.full(len(read), i))
                which.append(np.full(len(read), p))
                where.append(read)
        i, p, j = (np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in (who, which, where))
        return n["a_id"][i], n["a_mark"][i], p, n["g_id"][order[i, j]], s[i, j]

    return passes


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, lower: int = 80, upper: int = 100) -> DataFrame:
    """Hard negatives among rows (vec_id, label, embedding): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components x count as floor(256 * x). An anchor (a row for which ``anchors`` holds) has as positives its
    ``positives`` best rows of the same label with another id; for each, the ``negatives`` best rows of other
    labels follow whose score is from ``lower`` to ``upper`` percent of the positive's, in exact arithmetic.
    Higher scores come first, ties by smaller id. A positive without such rows gives none.

    Rows take no part if their id or label is null, or their vector is null, empty or holds a null or
    non-finite component. Vectors only score against those of the same length. Repeated rows count as
    often as they are given, as positives, negatives and anchors; rows of one id that differ are
    anchors of their own. Scores that leave 64 bits are an error. Other columns aren't carried. An
    empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "negatives")
    v = F.col("embedding")
    good = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    given = bounded(rows).where(good).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), v.alias("v"), anchors.alias("anchor"))
    blocks = saved_blocks(packed(given, ["id", "label"], ROWS, integers, "<i8"))
    chosen = given.where("anchor and id is not null and label is not null").groupBy("id", "label", "v").agg(F.count("*").alias("copies"))
    chosen = scratch.save(chosen.withColumn("mark", F.xxhash64("label", "v")), "anchors")

    pairs = block_pairs(packed(chosen, ["id", "mark", "label"], ANCHORS, integers, "<i8"), blocks)
    found = pairs.mapInArrow(_read(_positives(positives), ["id", "mark"], ["other", "score"], 2, positives), "id long, mark long, other long, score long")
    of_anchor = Window.partitionBy("id", "mark")
    ranked = found.withColumn("p", F.row_number().over(of_anchor.orderBy(F.desc("score"), "other"))).where(F.col("p") <= positives)
    ranked = scratch.save(ranked.withColumn("p", F.col("p") - 1), "positives")

    at = lambda p: F.coalesce(F.max(F.when(F.col("p") == p, F.col("score"))), F.lit(0)).alias(f"s{p}")
    limits = ranked.groupBy("id", "mark").agg(F.count("*").alias("n"), *[at(p) for p in range(positives)])
    limits = chosen.join(limits, ["id", "mark"])
    asked = packed(limits, ["id", "mark", "label", "n", *[f"s{p}" for p in range(positives)]], ANCHORS, integers, "<i8")
    pairs = block_pairs(asked, blocks)
    read = _read(_negatives(negatives, positives, lower, upper), ["id", "mark", "p"], ["negative_id", "negative_score"], 3, negatives)
    found = pairs.mapInArrow(read, "id long, mark long, p long, negative_id long, negative_score long")
    of_positive = Window.partitionBy("id", "mark", "p").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(of_positive)).where(F.col("rank") <= negatives)
    found = found.join(ranked.select("id", "mark", F.col("p").cast("long").alias("p"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), ["id", "mark", "p"])
    found = found.join(chosen.select("id", "mark", "copies"), ["id", "mark"])
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
SQL = {
    "op13_hard_negatives": """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.id AS anchor_id, a.label AS anchor_label, r.id, r.label, list_inner_product(a.x, r.x)::BIGINT AS score
  FROM r AS a JOIN r ON a.id <> r.id AND len(a.x) = len(r.x) WHERE a.id % 100 = 0),
p AS (SELECT * FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INT) AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.label AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""
}
