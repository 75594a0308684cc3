"""Best-fit packing by minimum bin slack.

A sequence is filled by the combination of available pieces that leaves the least room: the largest
piece left is fixed, and a subset-sum over the other available lengths, held as a bitset in one
integer, finds the fullest feasible combination, which is then removed. Only the histogram of piece
lengths is needed for that, so the plan is made on the driver from at most ``capacity`` counts, and a
combination is removed as often as the counts allow. Each removal leaves one of its lengths with
fewer pieces than the combination takes, at most half of what it had, so a plan has at most
sum(2 + log2(capacity / length)) combinations, some 14,000 for 4096, however many documents there are.

Pieces get their places without any group being gathered: a piece's rank among those of its length
is its rank within its input partition plus what earlier partitions hold, and the plan maps ranks to
places.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from marlspike.llm.common import bounded, table, text_slices
from marlspike.scratch import Scratch

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"


def fullest(free: int, lengths: list[int], counts: np.ndarray) -> dict[int, int]:
    """The combination {length: uses} of available lengths with the largest sum up to ``free``.

    ``lengths`` is ascending. Of equally full combinations one with long pieces is found, as lengths
    are offered in descending order until the room can be filled exactly.
    """
    mask, reach, steps = (1 << (free + 1)) - 1, 1, []
    for i in range(bisect_right(lengths, free) - 1, -1, -1):
        length = lengths[i]
        copies, block = min(int(counts[length]), free // length), 1
        while copies > 0:
            block = min(block, copies)
            steps.append((length, block, reach))
            reach |= (reach << (length * block)) & mask
            copies -= block
            block *= 2
        if reach >> free & 1:
            break
    sum_, uses = reach.bit_length() - 1, {}
    for length, block, before in reversed(steps):
        if not before >> sum_ & 1:
            sum_ -= length * block
            uses[length] = uses.get(length, 0) + block
    return uses


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, uses, offset), sorted; for pieces shorter than the capacity."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] += n
    lengths = [int(x) for x in np.flatnonzero(counts) if 0 < x < capacity]
    ranks, rows, sequence = np.zeros(capacity + 1, dtype=np.int64), [], 0
    while lengths:
        longest = lengths[-1]
        counts[longest] -= 1
        uses = fullest(capacity - longest, lengths, counts)
        counts[longest] += 1
        uses[longest] = uses.get(longest, 0) + 1
        times = min(int(counts[x]) // n for x, n in uses.items())
        offset = 0
        for length, n in sorted(uses.items(), reverse=True):
            rows.append((length, ranks[length], sequence, n, offset))
            ranks[length] += n * times
            counts[length] -= n * times
            offset += n * length
        sequence += times
        lengths = [x for x in lengths if counts[x] > 0] if any(counts[x] == 0 for x in uses) else lengths
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, local_rank long"


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from marlspike.llm.tokens import word_encoder

        encoder, part = word_encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for lo, hi in text_slices(batch, "text", 2_000_000):
                rows: list[tuple] = []
                texts = batch.column("text").slice(lo, hi - lo).to_pylist()
                for doc_id, text in zip(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), texts, strict=True):
                    ids = np.frombuffer(encoder.encode(text or ""), dtype=np.uint16).astype("<u4").tobytes() + end
                    for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * at : 4 * (at + capacity)]
                        n = len(own) // 4
                        rows.append((doc_id, k, at, n, own, part, int(seen[n])))
                        seen[n] += 1
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids", "part", "local_rank")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def _place(rows: np.ndarray, capacity: int):
    keys = rows[:, 0] << 44 | rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            whole = length == capacity
            at = np.maximum(np.searchsorted(keys, length << 44 | rank, side="right") - 1, 0)
            if len(rows):
                _, first, sequence, uses, offset = rows[at].T
                turn = rank - first
                sequence, offset = sequence + turn // uses, offset + turn % uses * length
            else:
                sequence = offset = np.zeros_like(length)
            sequence = np.where(whole, -1 - rank, sequence)
            out = [batch.column(c) for c in batch.schema.names if c != "rank"]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sequence), pa.array(np.where(whole, 0, offset))], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Packs documents (doc_id, text) into sequences of at most ``capacity`` tokens, as few as it can.

    Returns one row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit ids,
    if ``with_ids``), ids_crc32, sequence_id, offset. A document is its ids and one END_ID; a null or
    empty text is END_ID alone. Only documents longer than the capacity are cut. Sequences that one
    full piece fills have negative numbers. Repeated rows and rows with a null doc_id are packed as
    documents of their own; an empty table gives no rows. Other columns are not carried.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    source = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = source.mapInArrow(_cut(tokenizer_path, capacity), PIECES)
    pieces = scratch.save(pieces.withColumn("ids_crc32", F.crc32("ids")), "pieces")
    counted = scratch.save(pieces.groupBy("part", "length").count(), "counts")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    rows = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    keep = ["doc_id", "piece", "start", "length", *(["ids"] if with_ids else []), "ids_crc32"]
    ranked = pieces.join(base, ["part", "length"]).select(*keep, (F.col("base") + F.col("local_rank")).alias("rank"))
    schema = T.StructType([f for f in ranked.schema.fields if f.name != "rank"]).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(_place(rows, capacity), schema)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pack(docs, public_tokenizers.path(TOKENIZER), with_ids=False)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids and places."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(TOKENIZER))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
SQL: dict[str, str] = {}
