"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries, one per task and merged, find the digests that may be frequent. Their exact
counts and smallest ids are verified against all rows with map-side combination; what is verified is
broadcast, at most ``counters`` rows, and the rows of these digests are decided where they are. The
rows of all other digests take an ordinary shuffle, in which no digest has more than
2 * rows / (counters + 1) rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from marlspike.llm.common import SPACE, table
from marlspike.scratch import Scratch

COUNTERS = 1024


def _misra_gries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for pair in batch.column(0).value_counts():
                key, n = pair["values"].as_py(), pair["counts"].as_py()
                if key in held or len(held) < counters:
                    held[key] = held.get(key, 0) + n
                    continue
                least = min(n, min(held.values()))
                held = {k: v - least for k, v in held.items() if v > least}
                if n > least:
                    held[key] = n - least
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["digest", "n"])

    return run


def exact_groups(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """For rows (doc_id, digest): doc_id, digest, keep_id, group_size, heavy.

    keep_id is the smallest doc_id with that digest and group_size the number of its rows. Null ids
    sort behind all others; a digest with only null ids has a null keep_id.
    """
    spark = rows.sparkSession
    summaries = rows.select("digest").mapInArrow(_misra_gries(counters), "digest binary, n long")
    likely = summaries.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters)
    # at most `counters` rows: broadcast both ways
    heavy = (
        rows.join(F.broadcast(likely.select("digest")), "digest")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    heavy = Scratch(spark, "heavy").save(heavy, "verified")
    marked = rows.join(F.broadcast(heavy), "digest", "left")
    w = Window.partitionBy("digest")
    light = marked.where("group_size is null").select(
        "doc_id", "digest", F.min("doc_id").over(w).alias("keep_id"), F.count("*").over(w).alias("group_size"), F.lit(False).alias("heavy")
    )
    found = marked.where("group_size is not null").select("doc_id", "digest", "keep_id", "group_size", F.lit(True).alias("heavy"))
    return light.unionByName(found)


def exact_dedup(docs: DataFrame, text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """Marks exact copies among documents (doc_id, text), one row for each row given.

    Texts are equal when identical after each run of blanks and 0x09 to 0x0D became one space; null
    counts as empty. Columns: doc_id, keep_id, group_size, kept, text_sha256, heavy. Rows with the same
    doc_id and text are copies too; all of them that have the keep_id are kept. Rows with a null doc_id
    are kept only where their whole group has none. An empty table gives no rows.
    """
    normal = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE + "+", " ")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normal, 256)).alias("digest"))
    rows = Scratch(docs.sparkSession, "digests").save(rows, "digests", codec="none")
    out = exact_groups(rows, counters)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "heavy")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
SQL = {
    "op2_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
}
