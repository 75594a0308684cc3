"""A corpus as one text, cut into overlapping chunks that go on across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from marlspike.scratch import Scratch


def placed(docs: DataFrame, id_: str, text: str, gap: int = 1) -> DataFrame:
    """(id, text, start): where each text begins when all are put end to end in the order of ids, ``gap`` characters apart.

    A prefix sum: documents are dealt by ranges of ids, summed up by range, and each range begins where
    those before it end. The sums of ranges are the only rows that meet in one task.
    """
    scratch = Scratch(docs.sparkSession, "corpus")
    rows = docs.where(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("size", F.length("text").cast("long") + gap).repartitionByRange("id", "text").withColumn("part", F.spark_partition_id())
    rows = scratch.save(rows, "placed")
    sums = rows.groupBy("part").agg(F.sum("size").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))  # a row for each range
    own = Window.partitionBy("part").orderBy("id", "text").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(sums), "part").select("id", "text", (F.col("base") + F.coalesce(F.sum("size").over(own), F.lit(0))).alias("start"))


def corpus_chunks(docs: DataFrame, id_: str = "id", text: str = "text", size: int = 2048, overlap: int = 100) -> DataFrame:
    """(chunk, contents, title) of the corpus, all texts joined by a blank in the order of ids: chunk k holds ``size`` characters from k * (size - overlap) on.

    Chunks go on from document to document; the last may be shorter, and one that would only repeat the
    overlap of the one before it isn't made. Null texts are empty ones, rows with a null id drop out, rows
    with equal ids follow one another by text. Each document gives a piece to each chunk it reaches into, so
    a chunk is put together from at most ``size`` characters, wherever its documents lie. An empty table
    has no chunk.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than a chunk")
    step = size - overlap
    rows = Scratch(docs.sparkSession, "corpus").save(placed(docs, id_, text).withColumn("text", F.concat("text", F.lit(" "))), "starts")
    total = rows.agg(F.max(F.col("start") + F.length("text"))).first()[0]
    if not total:
        return docs.sparkSession.createDataFrame([], "chunk long, contents string, title string")
    total -= 1  # there is no blank behind the last text
    last = max(0, -(-(total - size) // step))
    end = F.col("start") + F.length("text")
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("start") - size) / step).cast("long") + 1)
    reached = rows.withColumn("chunk", F.explode(F.sequence(first, F.least(F.floor((end - 1) / step).cast("long"), F.lit(last).cast("long")))))
    low = F.greatest(F.col("start"), F.col("chunk") * step)
    high = F.least(end, F.col("chunk") * step + size, F.lit(total).cast("long"))
    pieces = reached.where(low < high).select("chunk", low.alias("at"), F.substr("text", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("piece"))
    held = pieces.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
    return held.select("chunk", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("contents"), F.lit("").alias("title"))
