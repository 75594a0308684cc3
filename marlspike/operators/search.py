"""Top-k search over dense vectors, sparse vectors and text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from marlspike.functions.text import recall_tokens
from marlspike.operators.blocks import BLOCK, block_pairs, first_k, packed
from marlspike.operators.postings import Postings
from marlspike.scratch import Scratch

#: How a raw measure becomes a score, by profile and metric.
METRICS = ("ip", "l2", "cosine")


def scaled(raw: Column, metric: str, profile: str = "faiss") -> Column:
    """Scores as the index profiles give them; ranking is by the raw measure, as clipping makes ties."""
    if profile == "faiss":
        return F.greatest(1 - raw / 2, F.lit(0.0)) if metric == "l2" else F.least(raw, F.lit(1.0))
    if metric == "ip":
        return raw
    return F.greatest(1 - (F.sqrt(raw) if metric == "l2" else 1 - raw) / 2, F.lit(0.0))


def _measure(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        raw = (q**2).sum(axis=1)[:, None] - 2 * q @ x.T + (x**2).sum(axis=1)[None]
    else:
        raw = q @ x.T
        if metric == "cosine":
            both = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
            raw = np.divide(raw, both, out=np.zeros_like(raw), where=both > 0)
    return np.round(raw, 6)


def _scan(k: int | None, metric: str, floor: float | None, most_blocks: int = 64):
    """Over pairs of blocks: the k best rows of each query, merged over all of a task's pairs, or all rows over the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, ...]] = {}

        def out(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            who, number, cost = (np.concatenate([f[i] for f in found]) for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array(who), pa.array(number), pa.array(cost if metric == "l2" else -cost)], names=["qid", "id", "raw"])

        for batch in batches:
            for dims, number, qids, q, ids, x in zip(*(batch.column(c).to_pylist() for c in ("dims", "asked", "a_qid", "a_vectors", "g_id", "g_vectors")), strict=True):
                qids, ids = np.frombuffer(qids, "<i8"), np.frombuffer(ids, "<i8")
                q, x = (np.frombuffer(v, kind).reshape(-1, dims).astype("<f8", copy=False) for v, kind in ((q, f"<f{len(q) // len(qids) // dims}"), (x, f"<f{len(x) // len(ids) // dims}")))
                raw = _measure(q, x, metric)
                cost = raw if metric == "l2" else -raw
                good = np.ones(cost.shape, dtype=bool) if floor is None else raw <= floor if metric == "l2" else raw >= floor
                if k is not None and k < cost.shape[1]:
                    good &= cost <= np.partition(cost, k - 1, axis=1)[:, k - 1 : k]
                i, j = np.nonzero(good)
                found = (qids[i], ids[j], cost[i, j])
                if k is None:
                    yield out([found])
                    continue
                if number in best:
                    found = tuple(np.concatenate(pair) for pair in zip(best[number], found, strict=True))
                kept = first_k(found[:1], (found[2], found[1]), k)
                best[number] = tuple(f[kept] for f in found)
                if len(best) > most_blocks:
                    yield out(list(best.values()))
                    best.clear()
        if best:
            yield out(list(best.values()))

    return run


def dense_scan(queries: DataFrame, vectors: DataFrame, k: int | None, metric: str, floor: float | None = None, block: int = BLOCK) -> DataFrame:
    """(qid, id, raw) of each query's k best rows in every part of the table, or of all rows that reach the floor.

    A query set against all rows in blocks: both sides are packed into blocks of at most ``block``
    vectors on the executors, pairs of blocks are dealt over a grid of tasks, and each is one matrix
    product. Vectors of another length than a query's are never found by it.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    asked = packed(queries.select("qid", "v"), ["qid"], block)
    pairs = block_pairs(asked, packed(vectors.select("id", "v"), ["id"], block))
    return pairs.mapInArrow(_scan(k, metric, floor), "qid long, id long, raw double")


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 3, metric: str = "ip", profile: str = "faiss", block: int = BLOCK) -> DataFrame:
    """The k nearest rows (id, v) of each query (qid, v): qid, rank, id, score.

    Exact. Tasks keep the k best of their pairs of blocks, which are merged by a ranked window. Measures
    are rounded to six places before they are ranked, ties go to the smaller id. Null vectors are never found.
    """
    order = [F.col("raw") if metric == "l2" else F.desc("raw"), F.col("id")]
    ranked = dense_scan(queries, vectors, k, metric, block=block).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("qid", "rank", "id", F.round(scaled(F.col("raw"), metric, profile), 6).alias("score"))


def dense_range(queries: DataFrame, vectors: DataFrame, floor: float, metric: str = "ip", profile: str = "faiss") -> DataFrame:
    """All rows that a query's measure reaches the floor with (or stays within, for l2), however many: qid, id, score."""
    return dense_scan(queries, vectors, None, metric, floor).select("qid", "id", F.round(scaled(F.col("raw"), metric, profile), 6).alias("score"))


def top_k(scores: DataFrame, k: int, group: str = "qid", score: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows of each group with their rank."""
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def term_counts(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, term, tf) of each document."""
    terms = docs.select(F.col(id_).alias("id"), F.explode(recall_tokens(F.col(text))).alias("term"))
    return terms.groupBy("id", "term").agg(F.count("*").alias("tf"))


def saved_terms(terms: DataFrame) -> DataFrame:
    """Terms as a table that several statistics read; those already saved stay as they are."""
    return terms if hasattr(terms, "scratch_path") else Scratch(terms.sparkSession, "terms").save(terms, "terms", codec="snappy")


def sparse_topk(queries: DataFrame, docs: DataFrame, k: int = 3, drop_ratio: float = 0.0) -> DataFrame:
    """Inner product of sparse vectors (qid, term, w) and (id, term, w), by block-max postings. Exact; weights below 0 aren't for this.

    With ``drop_ratio`` that share of each query's terms, those of least weight, isn't looked for.
    """
    q = queries.select("qid", "term", F.col("w").alias("qw"))
    if drop_ratio:
        of, least = Window.partitionBy("qid"), Window.partitionBy("qid").orderBy("qw", "term")
        q = q.withColumns({"n": F.count("*").over(of), "r": F.row_number().over(least)}).where(F.col("r") > F.floor(F.col("n") * drop_ratio)).select("qid", "term", "qw")
    return Postings.build(docs, docs.agg(F.approx_count_distinct("id")).first()[0]).topk(q, k)


def log_weights(terms: DataFrame, id_: str = "id") -> DataFrame:
    """The default lexical embedding: log(1 + tf) for each term."""
    return terms.select(F.col("id").alias(id_), "term", F.log1p("tf").alias("w"))


def greatest_weights(tokens: DataFrame, special: list[int]) -> DataFrame:
    """The lexical embedding from a model's weights of each token place (id, token, weight): the greatest of a token, above 0, without special tokens."""
    kept = tokens.where(~F.col("token").isin(special) if special else F.lit(True)).where("weight > 0")
    return kept.groupBy("id", "token").agg(F.max("weight").alias("w"))


def _totals(lengths: DataFrame) -> dict[str, Column]:
    """Number of documents and their mean length, two numbers taken in a first pass."""
    row = lengths.agg(F.count("*"), F.avg("dl")).first()
    return {"n": F.lit(row[0]), "avgdl": F.lit(row[1])}


def bm25_scores(queries: DataFrame, terms: DataFrame, k1: float = 1.2, b: float = 0.75, allowed: DataFrame | None = None) -> DataFrame:
    """BM25 of each query (qid, term) and document that share a term: qid, id, score.

    Statistics are over all of ``terms`` (id, term, tf), which are written once; only postings of the
    queries' terms are weighed. ``allowed`` (id) restricts what is returned. A query's terms count once.
    """
    terms = saved_terms(terms)
    lengths = terms.groupBy("id").agg(F.sum("tf").alias("dl"))
    totals = _totals(lengths)
    wanted = queries.select("qid", "term").distinct()
    hits = terms.join(wanted.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    hits = hits if allowed is None else hits.join(allowed, "id", "left_semi")
    weighed = hits.join(df, "term").join(lengths, "id").withColumns(totals)
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return weighed.select("term", "id", part.alias("part")).join(wanted, "term").groupBy("qid", "id").agg(F.round(F.sum("part"), 6).alias("score"))


def bm25_topk(queries: DataFrame, terms: DataFrame, k: int = 10, allowed: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents by ``bm25_scores`` for each query (qid, term): qid, rank, id, score, by block-max postings.

    The index holds what of a posting's score doesn't depend on its term; the idf is the term's weight in the query.
    """
    terms = saved_terms(terms)
    lengths = terms.groupBy("id").agg(F.sum("tf").alias("dl"))
    n, mean = lengths.agg(F.count("*"), F.avg("dl")).first()
    if not n:
        return terms.sparkSession.createDataFrame([], "qid long, rank int, id long, score double")
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(mean)))
    index = Postings.build(terms.join(lengths, "id").select("id", "term", part.alias("w")), n)
    wanted = queries.select("qid", "term").distinct()
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return index.topk(wanted.join(index.frequencies(wanted), "term").select("qid", "term", idf.alias("qw")), k, allowed)


def keyword_topk(questions: DataFrame, terms: DataFrame, keywords, k: int = 1, separator: str = ",", **given) -> DataFrame:
    """BM25 with the keywords that a provider column makes of each question (qid, question), one comma-separated list each."""
    words = F.filter(F.transform(F.split(keywords(F.col("question")), separator), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return bm25_topk(questions.select("qid", F.explode(words).alias("term")), terms, k, **given)


def okapi_pairs(pairs: DataFrame, queries: DataFrame, terms: DataFrame, k1: float = 1.5, b: float = 0.75, eps: float = 0.25) -> DataFrame:
    """Okapi score of each pair (qid, id); negative idf becomes eps times the mean idf. Pairs sharing no term have 0.

    ``queries`` has a row (qid, term) for each occurrence of a term, and each occurrence counts.
    """
    terms = saved_terms(terms)
    lengths = terms.groupBy("id").agg(F.sum("tf").alias("dl"))
    df = terms.groupBy("term").agg(F.count("*").alias("df")).withColumns(_totals(lengths))
    idf = df.select("term", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = F.lit(idf.agg(F.avg("idf")).first()[0])
    idf = idf.withColumn("idf", F.when(F.col("idf") < 0, eps * mean).otherwise(F.col("idf")))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    joined = pairs.join(queries, "qid").join(terms, ["id", "term"]).join(idf, "term").join(lengths, "id")
    scores = joined.groupBy("qid", "id").agg(F.sum(part).alias("score"))
    return pairs.join(scores, ["qid", "id"], "left").select("qid", "id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


def first_of_each(rows: DataFrame, key: list[str] | str, order: list[str] | str) -> DataFrame:
    """Ordered dedupe: the first row of each key."""
    keys, orders = ([x] if isinstance(x, str) else x for x in (key, order))
    w = Window.partitionBy(*keys).orderBy(*orders)
    return rows.withColumn("__row", F.row_number().over(w)).where("__row = 1").drop("__row")
