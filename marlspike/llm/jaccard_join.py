"""Exact Jaccard self-join of documents' word shingles by PartEnum signatures.

Sizes are cut into bands [low, high] whose ends lie the threshold apart, so a similar pair lies in one
band or in two that adjoin. Two sets of at most ``high`` shingles that are similar differ in at most
k = 2 * high * (1 - t) / (1 + t) shingles. A band's shingle domain is cut into k // 2 + 1 + spare parts
(1 if k is 0), so in at least spare + 1 of them a similar pair differs in one shingle at most. Each
part is cut into three cells, of which two are equal then: a set gives a signature for each two cells
of each part, the digest of its shingles there. Sets sign for their own band and the next. Two cells
without shingles give no signature; a part with such cells is weak. A set with at most ``spare`` weak
parts shares a signature that isn't empty with each similar set, and one with more signs its empty
cells too, so nothing is lost.

Sets that share a signature are compared by parity sketches: bit h of a sketch tells whether an odd
number of shingles has hash h, so two sketches differ in at most as many bits as the sets differ in
shingles. Only pairs that pass this bound, which never rejects a similar pair, are verified, on the
words themselves. The second look has finer sketches, whose bound fewer other pairs pass. A group of copies isn't expanded: each signature first proposes a spanning forest of
its members under the bound. Where all pairs of a forest turn out similar there is nothing more to
find. Only groups with a pair that isn't and with members in different components are looked at
again, and propose the pairs within the bound whose ends are still in different components. Signatures
that the same sets share, as those of near copies mostly are, are one group. Of equal sets within one slice of a task's input one
signs; the others share one signature with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from marlspike.llm.common import bounded, table, text_slices
from marlspike.operators.components import connected_components
from marlspike.scratch import Scratch


#: Ids of documents to verify are broadcast only up to so many, 8 bytes each.
BROADCAST_ROWS = 1_000_000
#: The sketches of the second look have so many times the bits: there each pair within the bound is verified.
FINER = 4


@dataclass(frozen=True)
class Similarity:
    """Sets are similar when den * intersection >= num * union."""

    words: int = 5
    num: int = 80
    den: int = 100
    block: int = 4096

    def apart(self, total: int) -> int:
        """The most shingles in which similar sets of that total size differ."""
        return total * (self.den - self.num) // (self.den + self.num)


@lru_cache(maxsize=8)
def bands(s: Similarity, largest: int = 1 << 40) -> tuple[np.ndarray, ...]:
    """low, k, spare and parts of each band."""
    low, high = [1], []
    while low[-1] < largest:
        high.append(max(low[-1], low[-1] * s.den // s.num))
        low.append(high[-1] + 1)
    high.append(low[-1] * s.den // s.num)
    k = np.array([s.apart(2 * h) for h in high], dtype=np.int64)
    spare = np.where(k > 0, 1 + k // 32, 0)
    return np.array(low, dtype=np.int64), k, spare, np.where(k > 0, k // 2 + 1 + spare, 1)


def sketch_bits(k: int) -> int:
    return 1 << max(7, int(4 * k).bit_length())


_CELL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_PART, _BAND, _PAIR, _SIZE, _COPY = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def _signed(band: np.ndarray, part: np.ndarray, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The three signatures of each part, for the cells but the first, second and third."""
    from marlspike.llm.shingles import mix

    terms = sums * _CELL + sizes.astype(np.uint64) * _SIZE * _CELL
    salt = band.astype(np.uint64) * _BAND + part.astype(np.uint64) * _PART
    return mix(terms.sum(axis=1, keepdims=True) - terms + salt[:, None] + np.arange(1, 4, dtype=np.uint64) * _PAIR)


def signatures(sh: np.ndarray, own: np.ndarray, sizes: np.ndarray, s: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set number) of sets given as flat sorted shingle hashes."""
    from marlspike.llm.shingles import mix

    low, k, spare, parts = bands(s)
    home = np.searchsorted(low, sizes, side="right") - 1
    found, owners = [], []
    mixed = mix(sh ^ np.uint64(0x1234567))
    for step in (0, 1):
        band = home + step
        takes = (sizes > 0) if step == 0 else (sizes > 0) & (sizes * s.den >= s.num * low[band])
        rows = np.flatnonzero(takes[own])
        if not len(rows):
            continue
        o = own[rows]
        cell = (((sh[rows] >> np.uint64(32)) * (3 * parts[band[o]]).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        cell[k[band[o]] == 0] = 0  # equal sets only: one cell
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (o[1:] != o[:-1]) | (cell[1:] != cell[:-1])
        at = np.flatnonzero(new)
        sums, n, o, cell = np.add.reduceat(mixed[rows], at), np.diff(np.append(at, len(rows))), o[at], cell[at]
        new = np.ones(len(o), dtype=bool)
        new[1:] = (o[1:] != o[:-1]) | (cell[1:] // 3 != cell[:-1] // 3)
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        by_cell, filled = np.zeros((len(first), 3), dtype=np.uint64), np.zeros((len(first), 3), dtype=np.int64)
        by_cell[group, cell % 3], filled[group, cell % 3] = sums, n
        who, part = o[first], cell[first] // 3
        signs = _signed(band[who], part, by_cell, filled)
        some = filled.sum(axis=1, keepdims=True) - filled > 0
        some[k[band[who]] == 0] = (False, False, True)
        found.append(signs[some])
        owners.append(np.repeat(who, 3).reshape(-1, 3)[some])
        empty = ~some.all(axis=1)
        weak = parts[band] - np.bincount(who, minlength=len(sizes)) + np.bincount(who[empty], minlength=len(sizes))
        for i in np.flatnonzero(takes & (k[band] > 0) & (weak > spare[band])):
            mine = who == i
            bare = np.setdiff1d(np.arange(parts[band[i]]), part[mine])
            zero = np.zeros((len(bare), 3), dtype=np.int64)
            more = np.concatenate([_signed(np.full(len(bare), band[i]), bare, zero.astype(np.uint64), zero).ravel(), signs[mine][~some[mine]]])
            found.append(more)
            owners.append(np.full(len(more), i))
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found), np.concatenate(owners)


def sketch(hashes: np.ndarray, bits: int) -> bytes:
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(sketch_: bytes, size: int) -> bytes:
    """The sketch of the same set with fewer bits."""
    x = np.frombuffer(sketch_, dtype=np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


_SIZES = "doc long, n long, sketch binary, fine binary"
_SIGNED = "doc long, signatures array<long>"


def _slices(batches: Iterator[pa.RecordBatch], s: Similarity) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, shingles, owners, sizes) of slices of texts; rows without a document have size 0."""
    from marlspike.llm.shingles import shingle_sets

    for batch in batches:
        for lo, hi in text_slices(batch, "text", 1_500_000):
            part = batch.slice(lo, hi - lo)
            docs = part.column("doc").to_pylist()
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            sh, own = shingle_sets(texts, s.words)
            yield docs, sh, own, np.bincount(own, minlength=len(texts))


def _sketches(s: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, k, _, _ = bands(s)
        for docs, sh, own, sizes in _slices(batches, s):
            ends = np.cumsum(sizes)
            bits = [sketch_bits(int(x)) for x in k[np.searchsorted(low, sizes, side="right")]]
            fine = [sketch(sh[end - n : end], FINER * b) if n and doc is not None else None for doc, n, end, b in zip(docs, sizes, ends, bits, strict=True)]
            sketches = [fold(x, b // 8) if x is not None else None for x, b in zip(fine, bits, strict=True)]
            columns = [pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(fine, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "sketch", "fine"])

    return run


def _sign(s: Similarity):
    """The signatures of each document; equal sets of a slice all sign the first one's id, and only that one signs all else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from marlspike.llm.shingles import mix

        for docs, sh, own, sizes in _slices(batches, s):
            ends = np.cumsum(sizes)
            first: dict[bytes, int] = {}
            same = np.full(len(docs), -1)
            for i in sorted((i for i in range(len(docs)) if docs[i] is not None and sizes[i]), key=lambda i: docs[i]):
                same[i] = first.setdefault(sh[ends[i] - sizes[i] : ends[i]].tobytes(), i)
            signs = same == np.arange(len(docs))
            chosen = signs[own]
            sig, who = signatures(sh[chosen], own[chosen], np.where(signs, sizes, 0), s)
            copies = np.flatnonzero((same >= 0) & ~signs)
            copied = np.unique(same[copies])
            if len(copies):
                ids = np.array([d or 0 for d in docs], dtype=np.int64).view(np.uint64)
                sig = np.concatenate([sig, mix(ids[copied] ^ _COPY), mix(ids[same[copies]] ^ _COPY)])
                who = np.concatenate([who, copied, copies])
            order = np.argsort(who, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(docs)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), lists], names=["doc", "signatures"])

    return run


def _close(rows: list[tuple], s: Similarity, all_pairs: bool) -> Iterator[tuple[int, int]]:
    """Pairs of one group (block, doc, n, sketch, component) that may be similar.

    Without ``all_pairs`` a spanning forest of them; with it all whose components differ.
    """
    if len(rows) < 2:
        return
    size = min(len(r[3]) for r in rows)
    cut = len({r[0] for r in rows}) > 1  # two blocks of a large group: only pairs across
    group = [r[4] for r in rows] if all_pairs else list(range(len(rows)))
    if len(rows) <= 12:
        bits = [int.from_bytes(r[3] if len(r[3]) == size else fold(r[3], size), "little") for r in rows]
        for j in range(1, len(rows)):
            for i in range(j):
                a, b = rows[i], rows[j]
                if group[i] == group[j] or a[1] == b[1] or (cut and a[0] == b[0]):
                    continue
                if (bits[i] ^ bits[j]).bit_count() <= s.apart(a[2] + b[2]):
                    yield (a[1], b[1])
                    if not all_pairs:
                        group = [group[j] if g == group[i] else g for g in group]
        return
    bits = np.array([np.frombuffer(r[3] if len(r[3]) == size else fold(r[3], size), dtype=np.uint64) for r in rows])
    block, doc, n, group = (np.array([r[x] for r in rows]) for x in (0, 1, 2, 4))

    def may(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of rows j may be similar to rows i; only these rows' part of the matrix is ever made."""
        apart = np.bitwise_count(bits[i, None] ^ bits[None, j]).sum(axis=2, dtype=np.int32)
        out = (apart <= (n[i, None] + n[None, j]) * (s.den - s.num) // (s.den + s.num)) & (doc[i, None] != doc[None, j])
        if cut:
            out &= block[i, None] != block[None, j]
        return out & (group[i, None] != group[None, j]) if all_pairs else out

    if all_pairs:
        step = max(1, 2_000_000 // (len(rows) * bits.shape[1]))
        for lo in range(0, len(rows), step):
            for i, j in zip(*np.nonzero(np.triu(may(np.arange(lo, min(lo + step, len(rows))), np.arange(lo, len(rows))))), strict=True):
                yield (int(doc[lo + i]), int(doc[lo + j]))
        return
    left = np.arange(len(rows))  # in no tree yet
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            i = stack.pop()
            near = may(np.array([i]), left)[0]
            found, left = left[near], left[~near]
            stack += found.tolist()
            yield from ((int(doc[i]), int(doc[j])) for j in found)


def _propose(s: Similarity, all_pairs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, pairs = None, [], set()

        def packed() -> pa.RecordBatch:
            a, b = zip(*pairs, strict=True)
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def closed() -> Iterator[pa.RecordBatch]:
            for p in _close(rows, s, all_pairs):
                pairs.add((min(p), max(p)))
                if len(pairs) >= 100_000:
                    yield packed()

        names = ("sig", "left", "right", "block", "doc", "n", "sketch", "component")
        for batch in batches:
            for sig, left, right, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (sig, left, right) != key:
                    yield from closed()
                    key, rows = (sig, left, right), []
                rows.append(tuple(row))
        yield from closed()
        if pairs:
            yield packed()

    return run


def _verify(s: Similarity):
    def shingles(text: bytes | None) -> set:
        words = (text or b"").lower().split()
        if len(words) < s.words:
            return {tuple(words)} if words else set()
        return set(zip(*(words[i:] for i in range(s.words)), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            out = []
            rows = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_a").cast(pa.binary()), batch.column("text_b").cast(pa.binary()), strict=True)
            for a, b, text_a, text_b in rows:
                if a != last:
                    last, held = a, shingles(text_a.as_py())
                other = shingles(text_b.as_py())
                both = len(held & other)
                out.append((a, b, both > 0 and s.den * both >= s.num * (len(held) + len(other) - both)))
            a, b, ok = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "similar"])

    return run


def similar_groups(docs: DataFrame, s: Similarity = Similarity()) -> DataFrame:
    """For rows (doc_id, text): doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Words are runs without blanks and 0x09 to 0x0D, A-Z lower-cased; a set is the distinct shingles of
    ``words`` words, of a shorter text its whole sequence; without words it's empty and linked with
    nothing. Rows with the same doc_id are one node of the graph, linked if any of their texts is; a null
    doc_id is linked with nothing and has a null component. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = bounded(docs).select(F.col("doc_id").cast("long").alias("doc"), "text")
    sizes = scratch.save(texts.mapInArrow(_sketches(s), _SIZES), "sizes", codec="none")
    w = Window.partitionBy("sig")
    # signatures go from Python straight into the exchange: saved, they would take as much disk again
    signed = texts.mapInArrow(_sign(s), _SIGNED).where("size(signatures) > 0").select(F.explode("signatures").alias("sig"), "doc")
    members = signed.select("sig", "doc", F.count("*").over(w).alias("members"), F.row_number().over(w.orderBy("doc")).alias("place"), F.min("doc").over(w).alias("lead")).where("members > 1")
    # signatures of the same members become one group, named by a hash of its members in order; should two
    # groups have the same hash, they are looked at as one, and nothing is lost
    named = F.expr("bit_xor(xxhash64(doc, place))").over(w).alias("sig")
    members = scratch.save(members.select(named, "doc", "members", "place", "lead").distinct(), "members")
    del signed
    scratch.free_shuffles()
    signed = sizes.where("sketch is not null")
    sketches, fine = signed.select("doc", "n", "sketch"), signed.select("doc", "n", F.col("fine").alias("sketch"))

    tried = scratch.save(_proposed(_first_look(members, s), sketches, s, False), "pairs")
    checked = scratch.save(_checked(tried, texts, s), "checked")
    found = scratch.save(connected_components(checked.where("similar").select("a", "b"), "a", "b"), "components")

    more = scratch.save(_proposed(_second_look(members, checked, found, s), fine, s, True).join(tried, ["a", "b"], "left_anti"), "pairs")
    scratch.drop(members)
    if not more.isEmpty():
        fresh = scratch.save(_checked(more, texts, s), "checked").where("similar").select("a", "b")
        if not fresh.isEmpty():
            stars = found.select(F.col("component").alias("a"), F.col("node").alias("b"))
            found = scratch.save(connected_components(stars.unionByName(fresh), "a", "b"), "components")
    scratch.drop(tried, checked, more)
    scratch.free_shuffles()
    out = sizes.select("doc", "n").join(found.withColumnRenamed("node", "doc"), "doc", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def _first_look(members: DataFrame, s: Similarity) -> DataFrame:
    """Groups to propose forests for: a signature's members in blocks, each with the first member, so that near copies of it need no other block."""
    own = F.floor((F.col("place") - 1) / s.block).cast("int")
    last = F.floor((F.col("members") - 1) / s.block).cast("int")
    dealt = members.withColumn("left", F.explode(F.when(F.col("place") == 1, F.sequence(F.lit(0), last)).otherwise(F.array(own))))
    return dealt.select("lead", "members", "sig", "left", F.col("left").alias("right"), "left", "doc", F.lit(0).cast("long").alias("component")).toDF(*_GROUPED)


def _second_look(members: DataFrame, checked: DataFrame, found: DataFrame, s: Similarity) -> DataFrame:
    """Groups in which pairs of different components are still to be compared.

    A signature of one block comes again if it has two ends of pairs that weren't similar and members of two components. A larger one
    comes again if it has members outside the first member's component; each block of those meets each
    other block of them and each block of the rest, which needs no comparison within itself.
    """
    component = found.withColumnRenamed("node", "doc")
    failed = checked.where("not similar").select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    small = members.where(F.col("members") <= s.block)
    again = small.join(failed, "doc", "left_semi").groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig")
    small = small.join(again, "sig", "left_semi").join(component, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    group = Window.partitionBy("sig")
    small = small.withColumns({"least": F.min("component").over(group), "most": F.max("component").over(group)}).where("least <> most")
    zero = F.lit(0)
    small = small.select("lead", "members", "sig", zero.alias("left"), zero.alias("right"), zero.alias("block"), "doc", "component")

    large = members.where(F.col("members") > s.block).join(component, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    home = component.select(F.col("doc").alias("lead"), F.col("component").alias("home"))
    large = large.join(home, "lead", "left").withColumn("out", F.col("component") != F.coalesce("home", "lead"))
    w = Window.partitionBy("sig", "out")
    large = large.withColumn("own", F.floor((F.row_number().over(w.orderBy("component", "doc")) - 1) / s.block).cast("int"))
    n_out = F.max(F.when(F.col("out"), F.col("own") + 1).otherwise(0)).over(Window.partitionBy("sig"))
    n_in = F.max(F.when(F.col("out"), 0).otherwise(F.col("own") + 1)).over(Window.partitionBy("sig"))
    large = large.withColumn("n_out", n_out).withColumn("n_in", n_in).where("n_out > 0")
    inside = F.transform(F.sequence(zero, F.col("n_in") - 1), lambda j: -1 - j)  # blocks of the first member's component are numbered -1, -2, ...
    outside = F.sequence(zero, F.col("n_out") - 1)
    pair = lambda a, b: F.struct(a.cast("int").alias("left"), b.cast("int").alias("right"))
    others = F.transform(F.concat(outside, inside), lambda x: F.when(x >= 0, pair(F.least(x, F.col("own")), F.greatest(x, F.col("own")))).otherwise(pair(F.col("own"), x)))
    met = F.when(F.col("out"), others).otherwise(F.transform(outside, lambda x: pair(x, -1 - F.col("own"))))
    block = F.when(F.col("out"), F.col("own")).otherwise(-1 - F.col("own"))
    large = large.withColumn("pair", F.explode(met)).select("lead", "members", "sig", "pair.left", "pair.right", block.cast("int").alias("block"), "doc", "component")
    return small.unionByName(large)


_GROUPED = ("lead", "members", "sig", "left", "right", "block", "doc", "component")


def _proposed(grouped: DataFrame, sketches: DataFrame, s: Similarity, all_pairs: bool) -> DataFrame:
    """Distinct pairs proposed within the groups.

    Signatures with the same first member go to one task, where a pair that shares many of them is
    proposed once; they are salted by their number of members, so that a task gets about ``rows`` rows for
    each signature of a first member, however many members there are. The second look proposes more pairs
    than rows, so there fewer tasks share the same pairs.
    """
    rows = 64
    salt = F.pmod(F.xxhash64("sig"), F.ceil(F.least("members", F.lit(s.block)) / rows)).alias("salt")
    dealt = grouped.select("lead", salt, "sig", "left", "right", "block", "doc", "component")
    full = dealt.join(sketches, "doc").repartition("lead", "salt", "left", "right").sortWithinPartitions("lead", "sig", "left", "right", "doc")
    return full.mapInArrow(_propose(s, all_pairs), "a long, b long").distinct()


def _checked(pairs: DataFrame, texts: DataFrame, s: Similarity) -> DataFrame:
    """(a, b, similar) of each pair, from the texts' own words."""
    needed = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    scratch = Scratch(pairs.sparkSession, "verify")
    needed = scratch.save(needed, "needed")
    if needed.count() <= BROADCAST_ROWS:  # else an ordinary join
        needed = F.broadcast(needed)
    own = scratch.save(texts.join(needed, "doc", "left_semi"), "texts")
    left = own.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    right = own.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").sortWithinPartitions("a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(s), "a long, b long, similar boolean").groupBy("a", "b").agg(F.max("similar").alias("similar"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents", "doc_id", "text"), Similarity(words=4, num=85, den=100))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; five words, similarity 0.8."""
    groups = similar_groups(docs.select("doc_id", "text"), Similarity())
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


QUERIES = {"op5_ngram_jaccard_join": op5_ngram_jaccard_join}
SQL = {
    "op5_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos, len(words) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents)),
s AS (SELECT DISTINCT doc_id, shingle FROM (
  SELECT doc_id, word || ' ' || lead(word) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d AS shingle FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
  UNION ALL SELECT doc_id, string_agg(word, ' ' ORDER BY pos) FROM w WHERE n < 4 GROUP BY doc_id) WHERE shingle IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, g.component_id
FROM documents d JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) g ON d.doc_id = g.node LEFT JOIN n ON d.doc_id = n.doc_id
"""
}
