"""Repeated passages by a depth-limited radix sort of suffixes.

Suffixes are told apart only through ``length`` bytes, digit by digit from the most significant one;
suffixes still equal then are exactly the repeated windows. To send fewer than one row for each byte,
the sort's first digits are chosen so that neighbouring suffixes share them:

1. The first digit of a window is the hash of its anchor, the 32-byte gram with the smallest hash
   among those it holds (the leftmost of equal ones). Equal windows have equal anchors. Consecutive
   windows with one anchor are a run, about 35 windows, and travel as one row.
2. The second digit is the digest of the run's bytes. Of runs with equal digests only the first can
   hold a first occurrence, all windows of the others are repeats. This is done within each slice of
   a task's input before the shuffle, so a very common passage sends one row a slice.
3. Where an anchor has runs of different bytes, the first run of each kind is fetched from its text
   and its windows are sorted by further digits of eight bytes, dropping windows that stand alone
   after each pass. In each group that is left after ``length`` bytes all but the first are repeats.

What leaves a pass are intervals of window starts; they are merged into spans for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marlspike.llm.common import bounded, table, text_slices
from marlspike.scratch import Scratch

LENGTH = 100
GRAM = 32
SEGMENT = 2_000_000
RUN, REPEAT, FETCH = 0, 1, 2
_SCHEMA = "kind byte, anchor long, digest long, doc long, place long, size int"
_NAMES = ("kind", "anchor", "digest", "doc", "place", "size")
_TYPES = (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())

_rng = np.random.default_rng(0xA17)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0xD1342543DE82EF95
_INVERSE = pow(_P, -1, 2**64)


def _rows(kind: int, anchor, digest, doc, place, size) -> pa.RecordBatch:
    columns = (np.full(len(doc), kind), anchor, digest, doc, place, size)
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c), t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _repeats(doc: np.ndarray, place: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Intervals of window starts, merged where they touch."""
    order = np.lexsort((place, doc))
    doc, place, size = doc[order], place[order], size[order].astype(np.int64)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + size[:-1])
    at = np.flatnonzero(new)
    ends = (place + size)[np.append(at[1:], len(doc)) - 1]
    spread = doc[at] * np.int64(0x9E3779B97F4A7C1)  # only deals the rows out
    return _rows(REPEAT, spread, spread, doc[at], place[at], ends - place[at])


def runs(flat: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """anchor, digest, start, size of the runs of windows in ``flat``, texts end to end, each ending at one of ``ends``."""
    from marlspike.llm.shingles import _power, mix

    n = len(flat) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    value = _BYTE[flat]
    gram, step = value, 1
    while step < GRAM:
        gram = gram[:-step] * np.uint64(pow(_P, step, 2**64)) + gram[step:]
        step *= 2
    gram = mix(gram)
    low = np.uint64((1 << 24) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    width, step = length - GRAM + 1, 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: -(width - step)], least[width - step :])
    owner = np.searchsorted(ends, np.arange(n), side="right")
    inside = np.flatnonzero(np.arange(n) + length <= ends[owner])
    at = (least[inside] & low).astype(np.int64)
    new = np.ones(len(inside), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)
    first = np.flatnonzero(new)
    start = inside[first]
    size = np.diff(np.append(first, len(inside)))
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(value * _power(_P, len(flat)), out=sums[1:])
    digest = (sums[start + size + length - 1] - sums[start]) * _power(_INVERSE, len(flat) + 1)[start]
    return gram[at[first]], mix(digest + size.astype(np.uint64)), start, size


def _segments(docs: list, texts: list[bytes], length: int, most: int = SEGMENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of texts end to end: bytes, ends, doc and offset of each piece. Long texts come in overlapping pieces."""
    pieces, held = [], 0
    for doc, text in zip(docs, texts, strict=True):
        for at in range(0, max(1, len(text) - length + 1), most):
            piece = text[at : at + most + length - 1]
            if len(piece) >= length:
                pieces.append((doc, at, piece))
                held += len(piece)
            if held >= most:
                yield _joined(pieces)
                pieces, held = [], 0
    if pieces:
        yield _joined(pieces)


def _joined(pieces: list[tuple]) -> tuple[np.ndarray, ...]:
    doc, at, piece = zip(*pieces, strict=True)
    return np.frombuffer(b"".join(piece), dtype=np.uint8), np.cumsum([len(p) for p in piece]), np.array(doc), np.array(at)


def _scan(length: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                found = []
                for flat, ends, docs, offsets in _segments(part.column("doc").to_pylist(), texts, length, segment):
                    anchor, digest, start, size = runs(flat, ends, length)
                    own = np.searchsorted(ends, start, side="right")
                    found.append((anchor.view(np.int64), digest.view(np.int64), docs[own], start - (ends[own] - np.diff(ends, prepend=0)[own]) + offsets[own], size))
                if not found:
                    continue
                anchor, digest, doc, place, size = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((place, doc, digest, anchor))
                anchor, digest, doc, place, size = (c[order] for c in (anchor, digest, doc, place, size))
                first = np.ones(len(anchor), dtype=bool)
                first[1:] = (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])
                yield _rows(RUN, anchor[first], digest[first], doc[first], place[first], size[first])
                if not first.all():
                    yield _repeats(doc[~first], place[~first], size[~first])

    return run


def _second_digit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over runs sorted by (anchor, digest, doc, place): repeats, and first runs whose anchor has several digests."""
    held = None
    for batch in _flushed(batches):
        if batch is not None:
            kind = batch.column("kind").to_numpy()
            columns = [batch.column(c).to_numpy() for c in _NAMES[1:]]
            through = kind == REPEAT
            if through.any():
                yield _rows(REPEAT, *(c[through] for c in columns))
            rows = [c[~through] for c in columns]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            last = rows[0] == rows[0][-1] if len(rows[0]) else np.zeros(0, dtype=bool)
            held, rows = [c[last] for c in rows], [c[~last] for c in rows]
        else:
            rows, held = held, None
        if rows is None or not len(rows[0]):
            continue
        anchor, digest, doc, place, size = rows
        new = np.ones(len(anchor), dtype=bool)
        new[1:] = anchor[1:] != anchor[:-1]
        first = new.copy()
        first[1:] |= digest[1:] != digest[:-1]
        kinds = np.add.reduceat(first.astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
        fetch = first & (kinds > 1)
        if not first.all():
            yield _repeats(doc[~first], place[~first], size[~first])
        if fetch.any():
            yield _rows(FETCH, *(c[fetch] for c in rows))


def _flushed(batches):
    yield from batches
    yield None


_CONTEXT = "anchor long, doc long, place long, size int, bytes binary"


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i, (doc, asked) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("asked").to_pylist(), strict=True)):
                text = texts[i].as_py()
                rows = [(x["anchor"], doc, x["place"], x["size"], text[x["place"] : x["place"] + x["size"] + length - 1]) for x in asked]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["anchor", "doc", "place", "size", "bytes"])

    return run


def _words(flat: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    padded = np.concatenate([flat, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    out = np.zeros(len(flat), dtype=np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(flat)]
    return out


def radix_repeats(anchor, doc, place, size, contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(doc, window start) of all windows equal to an earlier one of the same anchor, by passes of eight bytes."""
    flat = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum(size + length - 1)[:-1]])
    row = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    at, word = begin[row] + step, _words(flat)
    group = np.unique(anchor, return_inverse=True)[1][row]
    depth = 0
    while True:
        digit = word[at + min(depth, length - 8)]
        order = np.lexsort((digit, group))
        group, digit = group[order], digit[order]
        new = np.ones(len(group), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new) - 1
        shared = (np.bincount(group)[group] > 1) if len(group) else np.zeros(0, dtype=bool)
        keep = order[shared]
        row, step, at, group = row[keep], step[keep], at[keep], group[shared]
        depth += 8
        if depth >= length or not len(row):
            break
    docs, starts = doc[row], place[row] + step
    order = np.lexsort((starts, docs, group))
    docs, starts, group = docs[order], starts[order], group[order]
    again = np.zeros(len(group), dtype=bool)
    again[1:] = group[1:] == group[:-1]
    return docs[again], starts[again]


def _third_digits(length: int, most: int = 20_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                anchor, doc, place, size = (np.array(c, dtype=np.int64) for c in list(zip(*rows, strict=True))[:4])
                docs, starts = radix_repeats(anchor, doc, place, size, [r[4] for r in rows], length)
                if len(docs):
                    yield _repeats(docs, starts, np.ones(len(docs), dtype=np.int64))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if len(held) >= most and row[0] != held[-1][0]:
                    yield from done(held)
                    held = []
                held.append(row)
        yield from done(held)

    return run


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (doc, text) whose doc numbers are distinct and keep the order of doc_id, and the numbers' meaning.

    Where doc_ids repeat or are null, rows are numbered by (doc_id, hash of the text), nulls first;
    equal rows are one document. Otherwise doc_id itself is the number and no table is needed.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    odd = rows.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if odd.isEmpty():
        return rows.withColumnRenamed("doc_id", "doc"), None
    spark = docs.sparkSession
    marked = rows.withColumn("text_hash", F.xxhash64("text"))
    pairs = marked.select("doc_id", "text_hash").distinct().orderBy("doc_id", "text_hash").rdd.zipWithIndex()
    names = spark.createDataFrame(pairs.map(lambda x: (x[0][0], x[0][1], x[1])), "doc_id long, text_hash long, doc long")
    names = Scratch(spark, "repeats").save(names, "numbers")
    match = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash"))
    numbered = marked.alias("l").join(names.alias("r"), match).select("r.doc", "l.text")
    return numbered.groupBy("doc").agg(F.first("text").alias("text")), names


def repeat_intervals(texts: DataFrame, length: int = LENGTH, segment: int = SEGMENT) -> DataFrame:
    """For rows (doc, text) with distinct doc numbers: (doc, place, size), intervals of starts of windows that also start earlier."""
    scratch = Scratch(texts.sparkSession, "repeats")
    found = bounded(texts).mapInArrow(_scan(length, segment), _SCHEMA)
    found = found.repartition("anchor").sortWithinPartitions("anchor", "digest", "doc", "place").mapInArrow(_second_digit, _SCHEMA)
    found = scratch.save(found, "runs")
    scratch.free_shuffles()
    asked = found.where(F.col("kind") == FETCH).groupBy("doc").agg(F.collect_list(F.struct("anchor", "place", "size")).alias("asked"))
    contexts = texts.join(asked, "doc").mapInArrow(_contexts(length), _CONTEXT)
    rest = contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_third_digits(length), _SCHEMA)
    rest = scratch.save(rest.select("doc", "place", "size"), "windows")
    scratch.free_shuffles()
    return found.where(F.col("kind") == REPEAT).select("doc", "place", "size").unionByName(rest)


def merged(intervals: list, length: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes, end exclusive, from intervals of window starts."""
    out: list[list[int]] = []
    for place, size in sorted((x["place"], x["size"]) for x in intervals or ()):
        end = place + size + length - 1
        if out and place <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([place, end])
    return [(a, b) for a, b in out]


SPANS = "array<struct<start:long,end:long>>"


def _cut_out(length: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch, "text", 8_000_000):
                part = batch.slice(lo, hi - lo)
                texts, kept, spans = part.column("text").cast(pa.binary()), [], []
                for i, intervals in enumerate(part.column("intervals").to_pylist()):
                    text, own = texts[i].as_py() or b"", merged(intervals, length)
                    spans.append([{"start": a, "end": b} for a, b in own])
                    edges = [0, *(x for s in own for x in s), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if own else text)
                sizes = pa.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, segment: int = SEGMENT) -> DataFrame:
    """For rows (doc_id, text): doc_id, n_bytes, spans removed (byte offsets) and the bytes kept.

    Texts are UTF-8 bytes, null is empty. Each byte goes that a window of ``length`` bytes covers which
    also starts earlier, in a document with a smaller doc_id or further left in its own; windows are judged
    on the input. Rows with the same doc_id and text are one document and get equal results; rows with
    the same doc_id and other texts are ordered by a hash of the text; null ids come first. An empty
    table gives no rows. Other columns aren't carried.
    """
    texts, names = keyed(docs)
    intervals = repeat_intervals(texts, length, segment).groupBy("doc").agg(F.collect_list(F.struct("place", "size")).alias("intervals"))
    if names is None:
        rows = texts.join(intervals, "doc", "left").withColumnRenamed("doc", "doc_id")
    else:
        marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).alias("l")
        match = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash"))
        rows = marked.join(names.alias("r"), match).select("l.doc_id", "l.text", "r.doc").join(intervals, "doc", "left")
    return rows.select("doc_id", "text", "intervals").mapInArrow(_cut_out(length), f"doc_id long, n_bytes long, spans {SPANS}, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
SQL = {
    "op7_suffix_dedup": """
WITH b AS (SELECT doc_id, unnest(bytes) AS x1, generate_subscripts(bytes, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS bytes FROM documents)),
b2 AS (SELECT *, x1 || lead(x1) OVER d AS x2 FROM b WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
b4 AS (SELECT *, x2 || lead(x2, 2) OVER d AS x4 FROM b2 WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
b20 AS (SELECT *, x4 || lead(x4, 4) OVER d || lead(x4, 8) OVER d || lead(x4, 12) OVER d || lead(x4, 16) OVER d AS x20 FROM b4 WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
b100 AS (SELECT doc_id, pos, x1, x20 || lead(x20, 20) OVER d || lead(x20, 40) OVER d || lead(x20, 60) OVER d || lead(x20, 80) OVER d AS x100
  FROM b20 WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
m AS (SELECT doc_id, pos, x1, CASE WHEN x100 IS NOT NULL AND row_number() OVER (PARTITION BY x100 ORDER BY doc_id, pos) > 1 THEN 1 ELSE 0 END AS again FROM b100),
c AS (SELECT doc_id, pos, x1, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM m),
e AS (SELECT *, gone - coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS edge FROM c),
k AS (SELECT doc_id, count(*) AS n_bytes, sum(gone)::BIGINT AS n_removed, count(*) FILTER (edge = 1) AS n_spans, string_agg(x1, '' ORDER BY pos) FILTER (gone = 0) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
}
