"""Reports over evaluated samples: answers, recalls, steps, times, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from marlspike.functions.text import answer_form, model_answer, sentences
from marlspike.operators.metrics import contains_match, distribution, exact_match, failure_flags, no_info, soft_hits, token_f1_rows


def _share(part: Column, whole: Column) -> Column:
    """part / whole to six places, 0 where there is nothing."""
    return F.round(F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)), 6)


def paragraph_facts(items: DataFrame) -> DataFrame:
    """(qid, fact_no, fact): the sentences of supporting paragraphs (qid, paragraphs of (is_supporting, paragraph_text)), in order."""
    told = F.filter("paragraphs", lambda p: F.coalesce(p["is_supporting"], F.lit(False)))
    facts = F.flatten(F.transform(told, lambda p: sentences(F.coalesce(p["paragraph_text"], F.lit("")))))
    return items.select("qid", F.posexplode(facts).alias("fact_no", "fact"))


def context_facts(items: DataFrame) -> DataFrame:
    """(qid, fact_no, fact): the sentences that supporting_facts (title, place) point at in context (title, sentences).

    Of equal titles the last one counts; a title that isn't there or a place outside its sentences gives nothing.
    """
    wanted = items.select("qid", "context", F.posexplode("supporting_facts").alias("pos", "f"))
    same = F.filter("context", lambda c: c["title"] == F.col("f.title"))
    found = F.try_element_at(same, F.lit(-1))["sentences"]
    place = F.col("f.place").cast("int")
    fact = F.when((place >= 0) & (place < F.size(found)), F.get(found, place))
    rows = wanted.select("qid", "pos", fact.alias("fact")).where("fact is not null")
    return rows.select("qid", (F.row_number().over(Window.partitionBy("qid").orderBy("pos")) - 1).alias("fact_no"), "fact")


def answer_quality(samples: DataFrame) -> DataFrame:
    """One row over samples (answer, ground_truth): mean exact match, token F1, containment, accuracy on yes and no, share without information."""
    judged = samples.withColumns({"p": model_answer(F.col("answer")), "t": F.coalesce("ground_truth", F.lit(""))})
    scored = token_f1_rows(judged, "p", "t", "f1")
    closed, right = answer_form(F.col("t")).isin("yes", "no"), exact_match(F.col("p"), F.col("t"))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return scored.agg(
        mean(right).alias("exact_match"), mean(F.col("f1")).alias("token_f1"), mean(contains_match(F.col("p"), F.col("t"))).alias("contains_match"),
        _share(F.count_if(closed & (right == 1)), F.count_if(closed)).alias("yes_no_accuracy"), F.count_if(closed).alias("yes_no_total"),
        _share(F.count_if(F.lower("p").contains("no relevant information found")), F.count(F.lit(1))).alias("no_info_rate"),
    )


def step_counts(samples: DataFrame) -> DataFrame:
    """One row: mean, median, greatest and least number of steps."""
    n = F.greatest(F.coalesce(F.size("steps"), F.lit(0)), F.lit(0))
    rows = samples.select(n.cast("double").alias("n"))
    out = distribution(rows, "n", [])
    return out.select(F.col("mean").alias("avg_steps"), F.col("median").alias("median_steps"), F.col("most").cast("long").alias("max_steps"), F.col("least").cast("long").alias("min_steps"))


def format_issues(samples: DataFrame) -> DataFrame:
    """One row: issues summed over the steps of our retrieval (own_steps array) and of the plain one (plain)."""
    own = F.aggregate(F.coalesce("own_steps", F.array().cast("array<long>")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return samples.agg(total(own).alias("own_format_issues"), total(F.coalesce("plain", F.lit(0))).alias("plain_format_issues"))


#: Fixed names of the four time slots of a sample; the last two also go by what they time.
TIME_SLOTS = ("q2t", "ppr", "reranker", "llm_call")


def timing_summary(samples: DataFrame, by: list[str]) -> DataFrame:
    """Mean of each slot of time (array of four numbers), with the names path_generation and final_generation for the last two."""
    slot = lambda i: F.round(F.avg(F.element_at("time", i + 1)), 6)
    named = [slot(i).alias(f"avg_{name}_time") for i, name in enumerate(TIME_SLOTS)]
    return samples.groupBy(*by).agg(F.count("*").alias("total_samples"), *named, slot(2).alias("avg_path_generation_time"), slot(3).alias("avg_final_generation_time"))


def time_distributions(samples: DataFrame) -> DataFrame:
    """(part, n, mean, median, p90, p95, most, least) of path generation, final generation and both together."""
    path, final = F.element_at("time", 3), F.element_at("time", 4)
    parts = F.array(*[F.struct(F.lit(n).alias("part"), v.cast("double").alias("v")) for n, v in (("path_generation", path), ("final_generation", final), ("end_to_end", path + final))])
    return distribution(samples.select(F.explode(parts).alias("x")).select("x.part", "x.v"), "v", ["part"])


def slowest(samples: DataFrame, k: int, key: str = "qid") -> DataFrame:
    """A top-k report: the samples whose path and final generation took longest."""
    total = F.round(F.element_at("time", 3) + F.element_at("time", 4), 6)
    return samples.select(key, total.alias("total_time")).orderBy(F.desc("total_time"), key).limit(k)


def failure_rates(samples: DataFrame) -> DataFrame:
    """One row of rates over samples (question, steps, answer, ground_truth, recall): each rate on those it can befall."""
    flags = failure_flags(samples).withColumns({"p": model_answer(F.col("answer")), "zero": F.coalesce("recall", F.lit(0.0)) == 0})
    closed = answer_form(F.col("ground_truth")).isin("yes", "no")
    wrong = closed & (answer_form(F.col("p")) != answer_form(F.col("ground_truth")))
    n, of = F.count(F.lit(1)), lambda kind: F.col("category") == kind
    return flags.agg(
        _share(F.count_if(F.col("recall") == 0), n).alias("zero_recall_rate"), _share(F.count_if(no_info(F.col("answer"))), n).alias("no_info_rate"),
        _share(F.count_if(wrong), F.count_if(closed)).alias("yes_no_error_rate"), _share(F.count_if("first_failed"), n).alias("first_step_failure_rate"),
        _share(F.count_if("rewritten"), F.count_if("first_failed")).alias("rewrite_after_failure_rate"), _share(F.count_if("salvaged"), F.count_if("rewritten")).alias("rewrite_salvage_rate"),
        F.count_if("drift").alias("relation_drift_count"), _share(F.count_if("one_side_missing"), F.count_if(of("comparison"))).alias("one_side_missing_rate"),
        *[_share(F.count_if(of(c) & F.col("zero")), F.count_if(of(c))).alias(f"{c}_failure_rate") for c in ("complex_kinship", "role_bridge")],
    )


def category_recalls(samples: DataFrame) -> DataFrame:
    """Per question category: samples, share without any recall, mean recall."""
    recall = F.coalesce("recall", F.lit(0.0))
    return failure_flags(samples).groupBy("category").agg(F.count("*").alias("n"), _share(F.count_if(recall == 0), F.count(F.lit(1))).alias("zero_recall_rate"), F.round(F.avg(recall), 6).alias("avg_recall"))


def recall_gain(facts: DataFrame, ours: DataFrame, plain: DataFrame) -> DataFrame:
    """Each question's recall of its facts in our documents and in those of one plain search: qid, total, hits, plain_hits."""
    both = [soft_hits(facts, docs).groupBy("qid").agg(F.sum("hit").alias(n), F.count("*").alias(f"{n}_total")) for docs, n in ((ours, "hits"), (plain, "plain_hits"))]
    joined = both[0].join(both[1], "qid")
    return joined.select("qid", F.col("hits_total").alias("total"), "hits", "plain_hits")


def aligned_output(eval_file: Column, save_file: Column) -> Column:
    """The output path with the split's tag that the evaluated file has (small, else full) in place of the other one in its stem."""
    name = lambda path: F.element_at(F.split(path, "/"), -1)
    small = F.lower(name(eval_file)).contains("small")
    folder = F.regexp_extract(save_file, r"^(.*/)?[^/]*$", 1)
    stem, suffix = (F.regexp_extract(name(save_file), r"^(.+?)(\.[^.]*)?$", i) for i in (1, 2))
    swapped = F.when(small, F.regexp_replace(stem, r"(?i)^(.*?)full", "$1small")).otherwise(F.regexp_replace(stem, r"(?i)^(.*?)small", "$1full"))
    return F.concat(folder, swapped, suffix)
