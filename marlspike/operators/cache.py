"""Answer caches as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from marlspike.operators.search import dense_topk

#: Order in which entries are given up, per policy; the last ones stay.
POLICIES = {"lru": ["last_access"], "lfu": ["hits", "last_access"], "fifo": ["inserted_at"]}


def exact_lookup(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """Questions (qid, question) with the answer cached for the same key, null on a miss."""
    entries = cache.groupBy("key").agg(F.max_by("answer", "inserted_at").alias("answer"))
    return questions.join(entries, questions["question"] == entries["key"], "left").select("qid", "question", "answer")


def semantic_lookup(questions: DataFrame, cache: DataFrame, threshold: float = 0.8, k: int = 1) -> DataFrame:
    """Questions (qid, v) with the answer of the nearest entry (id, v, answer), if it is near enough."""
    hits = dense_topk(questions, cache.select("id", "v"), k, "cosine").where(F.col("score") >= threshold)
    best = hits.where("rank = 1").join(cache.select("id", "answer"), "id")
    return questions.select("qid").join(best, "qid", "left").select("qid", "id", "score", "answer")


def cascade(questions: DataFrame, caches: list[DataFrame]) -> DataFrame:
    """The first cache that has an answer gives it; level counts from 1, 0 is a miss."""
    out, answers = questions, []
    for i, cache in enumerate(caches):
        found = exact_lookup(questions, cache).select("qid", F.col("answer").alias(f"a{i}"))
        out = out.join(found, "qid", "left")
        answers.append(F.col(f"a{i}"))
    level = F.lit(0)
    for i, a in reversed(list(enumerate(answers))):
        level = F.when(a.isNotNull(), i + 1).otherwise(level)
    return out.select("qid", "question", F.coalesce(*answers).alias("answer"), level.alias("level"))


def evict(cache: DataFrame, size: int, policy: str = "lru", tie: str = "key", by: str | None = None) -> DataFrame:
    """The entries that stay when at most ``size`` may, of the whole cache or of each group ``by``."""
    order = [*(F.desc(c) for c in POLICIES[policy]), tie]
    if by is None:
        return cache.orderBy(*order).limit(size)
    w = Window.partitionBy(by).orderBy(*order)
    return cache.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= size).drop("__rank")


def similarity(question: str, cached: str, raw: str, most: float = 1.0, reverse: bool = False):
    """Equal texts, case aside, are as similar as can be; else the measure within [0, most], turned round if it is a distance."""
    value = F.greatest(F.lit(0.0), F.least(F.lit(most), F.col(raw)))
    return F.when(F.lower(question) == F.lower(cached), most).otherwise(most - value if reverse else value)
