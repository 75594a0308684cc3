"""Training rows from reasoning paths and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from marlspike.operators.fusion import best_share, reciprocal_rank_fusion


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_rows(paths: DataFrame) -> DataFrame:
    """Messages of paths (qid, question, steps of (subquery, context, subanswer), answer): the query, each step, the answer."""
    turn = lambda s: F.array(message("assistant", F.concat(F.lit("SubQuery: "), s["subquery"])), message("observation", F.concat(F.lit("Retrieved Context: "), s["context"])), message("assistant", F.concat(F.lit("SubAnswer: "), s["subanswer"])))
    steps = F.flatten(F.transform("steps", turn))
    return paths.select("qid", F.concat(F.array(message("user", F.col("question"))), steps, F.array(message("assistant", F.concat(F.lit("Final Answer: "), F.col("answer"))))).alias("messages"))


def aligned_samples(paths: DataFrame) -> DataFrame:
    """One sample for each sub-query, sub-answer and final answer, with the history before it: qid, no, type, prompt, target."""
    steps = paths.select("qid", "question", "answer", F.posexplode("steps").alias("pos", "s"))
    w = Window.partitionBy("qid").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    line = F.concat(F.col("s.subquery"), F.lit("\n"), F.col("s.subanswer"))
    seen = steps.withColumn("history", F.array_join(F.collect_list(line).over(w), "\n"))
    ask = seen.select("qid", (2 * F.col("pos")).alias("no"), F.lit("subquery").alias("type"), F.concat_ws("\n", "question", "history").alias("prompt"), F.col("s.subquery").alias("target"))
    tell = seen.select("qid", (2 * F.col("pos") + 1).alias("no"), F.lit("subanswer").alias("type"), F.concat_ws("\n", "s.context", "s.subquery").alias("prompt"), F.col("s.subanswer").alias("target"))
    whole = F.array_join(F.transform("steps", lambda s: F.concat(s["subquery"], F.lit("\n"), s["subanswer"])), "\n")
    end = paths.select("qid", (2 * F.size("steps")).alias("no"), F.lit("final").alias("type"), F.concat_ws("\n", "question", whole).alias("prompt"), F.col("answer").alias("target"))
    return ask.unionByName(tell).unionByName(end)


def label_mask(spans: Column, most: int, ignore: int = -100, pad: int = 0) -> Column:
    """(input_ids, labels) of spans (ids, trainable): labels of untrained spans are ignored; both are cut and padded to ``most``."""
    ids = F.flatten(F.transform(spans, lambda s: s["ids"]))
    labels = F.flatten(F.transform(spans, lambda s: F.transform(s["ids"], lambda i: F.when(s["trainable"], i).otherwise(ignore))))
    fit = lambda x, fill: F.slice(F.concat(x, F.array_repeat(F.lit(fill), most)), 1, most)
    return F.struct(fit(ids, pad).alias("input_ids"), fit(labels, ignore).alias("labels"))


def query_document_pairs(lexical: DataFrame, judged: DataFrame, share: float, threshold: float) -> DataFrame:
    """Generated pairs (qid is the source, id the query) that survive both sieves.

    Each source's pairs are ranked by two scores, the ranks fused, the best ``share`` kept, and of these
    the pairs the judge gives at least ``threshold``.
    """
    ranked = lambda df: df.select("qid", "id", (F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")) - 1).alias("rank"))
    kept = best_share(reciprocal_rank_fusion([ranked(lexical), ranked(judged)]), share)
    return kept.select("qid", "id", "rank").join(judged.select("qid", "id", F.col("score").alias("judged")), ["qid", "id"]).where(F.col("judged") >= threshold)
