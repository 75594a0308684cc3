"""What several operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: White space as the contracts define it: blank and 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 2 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The same frame, after its session's Arrow batches are bounded by bytes.

    By default 10,000 rows go to Python at once, however long their texts are.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def text_slices(batch, column: str, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """(start, end) row ranges of an Arrow batch with at most that many bytes of text, or one row."""
    col = batch.column(column)
    sizes = [0 if not v.is_valid else len(v.as_buffer() or b"") for v in col]
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)
