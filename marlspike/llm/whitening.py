"""Whitening of embeddings by principal components of exactly centred rows.

Entries are made integers, so their number n and sums S are exact, and n * x - S is the centred row
without rounding. Spark's RowMatrix adds up the rows' outer products over a tree of tasks
(computeGramianMatrix); divided by n that is the covariance, which is small enough to decompose on the
driver. Mean and projection go to the tasks as one broadcast of (components + 1) * dimensions numbers,
and rows are whitened where they are. The covariance of the result is measured in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, functions as F

from marlspike.llm.common import bounded, table
from marlspike.scratch import Scratch

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: A component of less than this share of the largest one's variance is rounding and can't be whitened.
LEAST_SHARE = 1e-12


def integers(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values.astype(np.float64)).astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dims, n, sums, greatest entry): one row a task for each length of vectors."""
    held: dict[int, list] = {}
    for batch in batches:
        vectors = batch.column("v")
        sizes = np.diff(vectors.offsets.to_numpy())
        flat = vectors.values.to_numpy()[vectors.offsets[0].as_py() : vectors.offsets[-1].as_py()]
        for dims in np.unique(sizes):
            own = flat[np.repeat(sizes == dims, sizes)].reshape(-1, dims)
            n, sums, most = held.get(dims, (0, 0, 0.0))
            held[dims] = (n + len(own), sums + integers(own).sum(axis=0), max(most, float(np.abs(own).max())))
    rows = [{"dims": int(d), "n": n, "sums": s.tolist(), "most": m} for d, (n, s, m) in held.items()]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("dims", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("most", pa.float64())]))


@dataclass(frozen=True)
class Centre:
    """Number of rows, exact sums of their integers by dimension, and the greatest magnitude of an entry."""

    n: int
    sums: np.ndarray
    most: float

    @property
    def reach(self) -> float:
        """No entry of n * x, S or n * x - S is beyond this."""
        return self.n * (2 * SCALE * self.most + SHIFT + 2)


def centre(vectors: DataFrame) -> Centre | None:
    """Over rows (v) of one length: that of most rows, of equally many the greater. None without rows."""
    parts = Scratch(vectors.sparkSession, "sums").save(bounded(vectors.select("v")).mapInArrow(_sums, "dims int, n long, sums array<long>, most double"), "parts")
    top = parts.groupBy("dims").agg(F.sum("n").alias("n"), F.max("most").alias("most")).orderBy(F.desc("n"), F.desc("dims")).first()
    if top is None:
        return None
    summed = parts.where(F.col("dims") == top["dims"]).select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
    return Centre(top["n"], np.array([r["s"] for r in summed], dtype=np.int64), top["most"])


def _gramian(rows: DataFrame, column: str) -> np.ndarray:
    """Sum of the outer products of the rows of an array column, by RowMatrix in the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(column)).alias("row")), "row")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def covariance(vectors: DataFrame, about: Centre) -> np.ndarray:
    """Covariance, with divisor n, of the integers of rows (v). Each centred row n * x - S is exact up to 2^53."""
    x = F.transform("v", lambda c: F.floor(SCALE * c.cast("double")).cast("long") + SHIFT)
    centred = F.zip_with(x, F.lit(about.sums.tolist()), lambda a, s: (about.n * a - s).cast("double"))
    return _gramian(vectors.select(centred.alias("c")), "c") / about.n / float(about.n) ** 2


def principal(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and the matrix that projects on unit eigenvectors and divides by their deviation; null columns where nothing varies."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(values)[::-1][:components]
    values, vectors = np.clip(values[order], 0, None), vectors[:, order]
    varies = values > LEAST_SHARE * max(values[0], 0)
    scale = np.where(varies, 1 / np.sqrt(np.where(varies, values, 1)), np.nan)
    return values, vectors * scale


def whitened(vectors: DataFrame, about: Centre, projection: np.ndarray) -> DataFrame:
    """Rows (vec_id, v) as vec_id, deviation, w. The deviation is an exact whole number of up to 38 digits."""
    given = vectors.sparkSession.sparkContext.broadcast((about, projection))
    # where even the largest row's deviation fits in 64 bits it is added up there, else with Python's integers
    short = len(about.sums) * about.reach**2 < 2**62

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        about, projection = given.value
        for frame in frames:
            if not len(frame):
                continue
            centred = about.n * integers(np.stack(frame["v"].to_numpy())) - about.sums
            squares = (centred**2).sum(axis=1) if short else [str(sum(int(c) ** 2 for c in row)) for row in centred]
            w = (centred / about.n) @ projection
            yield pd.DataFrame({"vec_id": frame["vec_id"], "deviation": squares, "w": list(w)})

    out = vectors.select("vec_id", "v").mapInPandas(run, f"vec_id long, deviation {'long' if short else 'string'}, w array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(rows: DataFrame, n: int, used: list[int]) -> float | None:
    """Largest absolute entry of the covariance of the used places of ``w`` minus the identity, centred before multiplying."""
    if not used:
        return None
    picked = rows.select(F.array(*[F.col("w")[i] for i in used]).alias("w"))
    mean = picked.agg(*[F.avg(F.col("w")[i]) for i in range(len(used))]).first()
    centred = picked.select(F.zip_with("w", F.lit([float(m) for m in mean]), lambda a, m: a - m).alias("c"))
    return float(np.abs(_gramian(centred, "c") / n - np.eye(len(used))).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitens rows (vec_id, embedding): a row for each vector and component, vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries c become integers floor(1024 * c) + 100000. Vectors that are null, empty or hold a null or
    non-finite entry drop out, and so do those of another length than most have. Entries so large
    that sums leave 64 bits are an error. Repeated rows and null ids are rows like others; other
    columns aren't carried. Components are numbered by falling eigenvalue, ties as the solver gives
    them. One along which nothing varies (as all do with a single vector) has a null ``whitened`` and
    stays out of ``identity_error``, which is null where there is no other. ``explained`` is null where
    nothing varies at all. A table without such vectors gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    about = centre(rows)
    if about is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    if about.reach >= 2**62:
        raise ValueError(f"sums over {about.n} rows with entries up to {about.most:g} aren't exact in 64 bits")
    rows = rows.where(F.size("v") == len(about.sums))
    v_matrix = covariance(rows, about)
    values, projection = principal(v_matrix, components)
    found = Scratch(spark, "whitened").save(whitened(rows, about, projection), "rows")
    used = [i for i in range(len(values)) if not np.isnan(projection[0, i])]
    error = identity_error(found, about.n, used)
    trace = float(np.trace(v_matrix))
    explained = F.lit([float(e / trace) if trace > 0 else None for e in values]).cast("array<double>")
    each = found.select("vec_id", "deviation", F.posexplode("w").alias("place", "whitened"))
    return each.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(about.n).cast("long").alias("n"), "deviation",
        F.when(~F.isnan("whitened"), F.col("whitened")).alias("whitened"), explained[F.col("place")].alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
SQL: dict[str, str] = {}
