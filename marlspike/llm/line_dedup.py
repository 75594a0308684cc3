"""Line deduplication over range-partitioned line digests.

Each line's key (stripped, A-Z lower-cased) is hashed to 128 bits. The digests are dealt over equal
ranges of the hash space and sorted by (digest, document, position), so one pass over a partition
meets a key's occurrences in document order and decides on them as they come. What leaves the pass is
small: positions to drop, gathered per document into a compressed keep bitmap. Text isn't shuffled
for the decision.

A key that already has enough documents within one slice of a task's input is decided there: its
occurrences are dropped at once and one marker row stands for them in the shuffle, so a very common
line sends at most ``min_docs - 1`` documents' rows and a marker from each slice to its range. The
dropped occurrences go where their documents' hashes send them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marlspike.llm.common import bounded, table, text_slices
from marlspike.scratch import Scratch

NO_ID = -(2**63)
LINE, DROPPED, LINES, MARKER = 0, 1, 2, 3
_SCHEMA = "range int, digest long, more long, kind byte, doc long, text_hash long, pos int"
_NAMES = ("range", "digest", "more", "kind", "doc", "text_hash", "pos")
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.int32())


def _batch(*arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, _TYPES, strict=True)], names=_NAMES)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it in any column."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _docs_per_group(starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return np.add.reduceat((starts | _changes(doc)).astype(np.int64), np.flatnonzero(starts))


def _digests(min_docs: int, min_chars: int, keep_first: bool, ranges: int):
    width = 2**64 // ranges + 1

    def deal(digest: np.ndarray) -> np.ndarray:
        return ((digest.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) // np.uint64(width)).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest as hashed

        for batch in batches:
            for lo, hi in text_slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                docs, hashes = part.column("doc").to_numpy(), part.column("text_hash").to_numpy()
                keys, owner, places, counts = [], [], [], []
                for i, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    lines = (text or b"").split(b"\n")
                    counts.append(len(lines))
                    for pos, line in enumerate(lines):
                        key = line.strip().lower()
                        if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
                            keys.append(hashed(key))
                            owner.append(i)
                            places.append(pos)
                n = np.array(counts, dtype=np.int32)
                yield _batch(deal(hashes), hashes, np.zeros(len(n)), np.full(len(n), LINES), docs, hashes, n)
                if not keys:
                    continue
                digest, more = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2).T
                own = np.array(owner)
                pos, doc, text_hash = np.array(places, dtype=np.int32), docs[own], hashes[own]
                order = np.lexsort((pos, text_hash, doc, more, digest))
                digest, more, doc, text_hash, pos = (c[order] for c in (digest, more, doc, text_hash, pos))
                starts = _changes(digest, more)
                common = _docs_per_group(starts, doc) >= min_docs
                drop = common[np.cumsum(starts) - 1]
                first, second = digest[starts][common], more[starts][common]
                if keep_first:
                    drop = drop & ~starts
                yield _batch(np.where(drop, deal(text_hash), deal(digest)), digest, more, np.where(drop, DROPPED, LINE), doc, text_hash, pos)
                if len(first):
                    zero = np.zeros(len(first), dtype=np.int64)
                    yield _batch(deal(first), first, second, np.full(len(first), MARKER), zero, zero, zero)

    return run


def _decide(min_docs: int, keep_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # occurrences of the last digest while it isn't known to be common
        open_digest, open_common = None, False
        for batch in batches:
            digest, more, kind, doc, text_hash, pos = (batch.column(c).to_numpy() for c in _NAMES[1:])
            through = (kind == DROPPED) | (kind == LINES)
            if through.any():
                yield _batch(np.zeros(through.sum()), *(c[through] for c in (digest, more, kind, doc, text_hash, pos)))
            rows = [c[~through] for c in (digest, more, kind, doc, text_hash, pos)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
                held = None
            digest, more, kind, doc, text_hash, pos = rows
            if not len(digest):
                continue
            starts = _changes(digest, more)
            common = _docs_per_group(starts, doc) >= min_docs
            marked = np.maximum.reduceat(kind, np.flatnonzero(starts)) == MARKER
            common |= marked
            carried = open_digest == (digest[0], more[0]) and open_common
            common[0] |= carried
            group = np.cumsum(starts) - 1
            drop = common[group] & (kind == LINE)
            if keep_first:
                lines = np.flatnonzero(kind == LINE)
                firsts = lines[_changes(group[lines])]
                drop[firsts[group[firsts] > 0] if carried else firsts] = False
            last = group == group[-1]
            open_digest, open_common = (digest[-1], more[-1]), bool(common[-1])
            if not open_common:
                held = [c[last] for c in rows]
            if drop.any():
                yield _batch(np.zeros(drop.sum()), digest[drop], more[drop], np.full(drop.sum(), DROPPED), doc[drop], text_hash[drop], pos[drop])

    return run


def bitmap(n_lines: int, dropped) -> bytes:
    """Keep bitmap of a document: a bit a line, 1 for kept, packed and deflated."""
    keep = np.ones(n_lines, dtype=np.uint8)
    keep[list(dropped)] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack(packed: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), dtype=np.uint8), count=n_lines)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column("n_lines").to_pylist(), batch.column("dropped").to_pylist(), strict=True)
        packed = [bitmap(n, d) if d else None for n, d in rows]
        names = ["doc", "text_hash", "n_lines"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(packed, pa.binary())], names=[*names, "keep"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__text_hash": F.xxhash64("text")})


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Keep bitmaps of documents (doc_id, text): doc, text_hash, n_lines, keep.

    Lines whose key has at least ``min_chars`` code points and is found in at least ``min_docs``
    documents are dropped everywhere, or everywhere but at their first occurrence, by doc_id and
    position, with ``keep_first``. ``keep`` is null where no line goes. A null or empty text is one
    empty line. Rows with the same doc_id are one document in the count; they are told apart by the
    hash of their text, and equal rows share one bitmap. All null ids are one document, with the
    number NO_ID. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _keyed(bounded(docs)).select(F.col("__doc").alias("doc"), F.col("__text_hash").alias("text_hash"), "text")
    rows = rows.mapInArrow(_digests(min_docs, min_chars, keep_first, ranges), _SCHEMA)
    rows = rows.repartitionById(ranges, F.col("range")).sortWithinPartitions("digest", "more", F.desc("kind"), "doc", "text_hash", "pos")
    found = rows.mapInArrow(_decide(min_docs, keep_first), _SCHEMA)
    gathered = found.groupBy("doc", "text_hash").agg(
        F.max(F.when(F.col("kind") == LINES, F.col("pos"))).alias("n_lines"),
        F.collect_set(F.when(F.col("kind") == DROPPED, F.col("pos"))).alias("dropped"),
    )
    return gathered.mapInArrow(_bitmaps, "doc long, text_hash long, n_lines int, keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [c for c in batch.schema.names if c not in ("text", "__keep")]
        texts, dropped = [], []
        rows = zip(batch.column("text").to_pylist(), batch.column("__n_lines").to_pylist(), batch.column("__keep").to_pylist(), strict=True)
        for text, n, packed in rows:
            if packed is None:
                texts.append(text)
                dropped.append(0)
            else:
                keep = unpack(packed, n)
                texts.append("\n".join(compress(text.split("\n"), keep)))
                dropped.append(n - int(keep.sum()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(dropped, pa.int64())], names=[*names, "text", "__n_dropped"])


def drop_lines(docs: DataFrame, bitmaps: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """The documents with the lines their bitmaps keep, all their columns, and two counts.

    A column that has the name of a count is an error.
    """
    if clash := {n_lines, n_dropped} & set(docs.columns):
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    own = bitmaps.select(F.col("doc").alias("__doc"), F.col("text_hash").alias("__text_hash"), F.col("n_lines").alias("__n_lines"), F.col("keep").alias("__keep"))
    joined = _keyed(docs).join(own, ["__doc", "__text_hash"], "left").drop("__doc", "__text_hash")
    rest = [f for f in joined.schema.fields if f.name not in ("text", "__keep")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", text string, __n_dropped long"
    out = joined.mapInArrow(_apply, schema)
    counts = [F.col("__n_lines").cast("long").alias(n_lines), F.col("__n_dropped").alias(n_dropped)]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *counts)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    bitmaps = Scratch(spark, "lines").save(keep_bitmaps(docs), "bitmaps")
    out = drop_lines(docs, bitmaps)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines found in ten documents or more; n_chars follows the text."""
    bitmaps = Scratch(spark, "lines").save(keep_bitmaps(docs), "bitmaps")
    out = drop_lines(docs, bitmaps, "__lines", "__dropped").drop("__lines", "__dropped")
    return out.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op8_line_dedup": op8_line_dedup}
SQL = {
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.k = common.k GROUP BY doc_id
"""
}
