"""What asks models and remembers: cached chains, summaries, sub-answers over documents, sampled and searched paths.

Models are columns or functions over tables that the caller gives; every step asks for all open rows at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from marlspike.functions.text import NO_INFO, answer_entity, follow_up, sub_answer, sub_query
from marlspike.operators.agent import frames, least_steps, next_query
from marlspike.operators.cache import evict, exact_lookup
from marlspike.operators.fusion import greedy_pack
from marlspike.operators.retrieve import Search, search_variants, usable_documents, variants
from marlspike.scratch import Scratch

Model = Callable[[Column], Column]
#: Fixed word with which a model ends its path.
STOP = "[STOP]"


# --- caches ---------------------------------------------------------------------------------------


def update(cache: DataFrame, new: DataFrame, limit: int, size: int | None = None, policy: str = "lru") -> DataFrame:
    """The cache (key, answer, inserted_at, ...) with new entries; answers of ``limit`` characters and more aren't kept, the newest of a key is, and of all at most ``size``."""
    every = cache.unionByName(new.where(F.length("answer") < limit), allowMissingColumns=True)
    w = Window.partitionBy("key").orderBy(F.desc("inserted_at"))
    latest = every.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return latest if size is None else evict(latest, size, policy)


def evict_at_random(cache: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """The entries that stay when others go at random: those with the smallest hashes, the same ones for each run of a seed."""
    return cache.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(size)


def flush(cache: DataFrame, path: str) -> None:
    cache.write.mode("overwrite").parquet(path)


def cached_chain(questions: DataFrame, cache: DataFrame, chain: Callable[[DataFrame], DataFrame], stamp: Column, limit: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Answers (qid, question, answer, hit) from the cache or the chain, and the cache with what the chain said.

    ``chain`` takes (qid, question) and returns (qid, answer). A cached JSON object with a query is given
    back with the present question in its place; what isn't JSON comes back as it is.
    """
    found = exact_lookup(questions, cache)
    kept = F.from_json("answer", "map<string,string>")
    asked = F.transform_values(kept, lambda k, v: F.when((k == "query") & (F.coalesce(v, F.lit("")) != ""), F.col("question")).otherwise(v))
    given = F.when(F.size(kept) > 0, F.to_json(asked)).otherwise(F.col("answer"))
    hits = found.where("answer is not null").select("qid", "question", given.alias("answer"), F.lit(True).alias("hit"))
    missed = found.where("answer is null").select("qid", "question")
    told = missed.join(chain(missed).select("qid", "answer"), "qid").select("qid", "question", "answer", F.lit(False).alias("hit"))
    new = told.groupBy(F.col("question").alias("key")).agg(F.min_by("answer", "qid").alias("answer"), F.min(stamp).alias("inserted_at"))
    return hits.unionByName(told), update(cache, new, limit)


# --- summaries ------------------------------------------------------------------------------------


def summarised(rows: DataFrame, complete: Model, least: int = 30, text: str = "text") -> DataFrame:
    """Rows whose texts of over ``least`` characters are replaced by the model's summaries."""
    return rows.withColumn(text, F.when(F.length(text) > least, complete(F.col(text))).otherwise(F.col(text)))


def merged_summaries(rows: DataFrame, complete: Model, threshold: int = 4096, least: int = 30, most_rounds: int = 10) -> DataFrame:
    """One summary (id, text) of each id's texts (id, pos, text): neighbours are joined up to ``threshold`` characters and summarised until one is left.

    More than ``most_rounds`` rounds are an error: then the summaries don't get shorter.
    """
    if threshold <= least:
        raise ValueError("the threshold must be above the length that isn't summarised")
    scratch = Scratch(rows.sparkSession, "summaries")
    now = scratch.save(rows.select("id", F.col("pos").cast("long").alias("pos"), "text"), "texts")
    for _ in range(most_rounds):
        groups = greedy_pack(now, "id", "pos", "text", threshold).select("id", "pos", "group_no")
        gathered = now.join(groups, ["id", "pos"]).groupBy("id", "group_no").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("x"))
        joined = gathered.select("id", F.col("group_no").alias("pos"), F.array_join(F.transform("x", lambda s: s["text"]), "\n\n").alias("text"))
        now = scratch.save(summarised(joined, complete, least), "texts")
        if now.where("pos > 0").isEmpty():
            return now.select("id", "text")
    raise ValueError(f"more than one text is left after {most_rounds} rounds")


def rewritten(rows: DataFrame, rewrite: Callable[[Column, Column], Column], copies: int, done: DataFrame | None = None) -> DataFrame:
    """(id, copy, query) of ``copies`` rewritings of each query (id, query), without those done and without empty ones."""
    wanted = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    if done is not None:
        wanted = wanted.join(done.select("id", "copy").distinct(), ["id", "copy"], "left_anti")
    made = wanted.select("id", "copy", F.trim(rewrite(F.col("query"), F.col("copy"))).alias("query"))
    return made.where("query <> ''")


def origin_documents(pieces: DataFrame, keep: Model | None = None) -> DataFrame:
    """(id, pos, text): pieces that a filter keeps, each text once, where it first comes."""
    kept = pieces if keep is None else pieces.where(keep(F.col("text")))
    first = kept.groupBy("text").agg(F.min(F.struct("id", "pos")).alias("at"))
    return first.select("at.id", "at.pos", "text")


# --- paths ----------------------------------------------------------------------------------------


def sub_answers(asked: DataFrame, search: Search, complete: Callable[[Column, Column], Column], per_query: int = 5, limit: int = 5, most_variants: int = 4) -> DataFrame:
    """(qid, subanswer, documents, format_issues) of sub-queries (qid, subquery): variants are searched, the model answers from the documents, last hit first.

    Without a document the model isn't asked: there's no information.
    """
    hits = search_variants(variants(asked.select("qid", F.col("subquery").alias("question")), most_variants), search, per_query)
    found = usable_documents(hits, limit, reverse=True)
    joined = asked.join(found, "qid", "left").withColumn("documents", F.coalesce("documents", F.array().cast("array<string>")))
    answer = F.when(F.size("documents") == 0, NO_INFO).otherwise(sub_answer(complete(F.array_join("documents", "\n\n"), F.col("subquery"))))
    return joined.select("qid", "subquery", answer.alias("subanswer"), "documents", F.coalesce("format_issues", F.lit(0)).alias("format_issues"))


def distinct_samples(completions: DataFrame, n: int) -> DataFrame:
    """(qid, no, subquery): the first n different sub-queries of sampled completions (qid, no, text), cleaned; empty ones don't count."""
    clean = completions.select("qid", "no", follow_up(sub_query(F.col("text"))).alias("subquery")).where("subquery <> ''")
    first = clean.groupBy("qid", "subquery").agg(F.min("no").alias("first"))
    placed = first.withColumn("no", F.row_number().over(Window.partitionBy("qid").orderBy("first")))
    return placed.where(F.col("no") <= n).select("qid", "no", "subquery")


#: Fixed token that stands before an answer, and the number of tokens of the next prompt after it.
HEADER, AFTER = "<|end_header_id|>", 4


def answer_logprobs(tokens: Column) -> Column:
    """Log probabilities of an answer's tokens, last one first, from a prompt's tokens (arrays of (rank, logprob, token)).

    Of each place the alternative with the greatest rank counts. The places of the next prompt are
    skipped; at the header the answer begins, and the line break after it goes as well.
    """
    worst = F.transform(F.reverse(tokens), lambda alternatives: F.array_max(F.transform(alternatives, lambda x: F.struct(x["rank"].alias("rank"), x["logprob"].alias("logprob"), x["token"].alias("token")))))
    rest = F.slice(worst, AFTER + 1, F.greatest(F.size(worst) - AFTER, F.lit(0)))
    header = F.array_position(F.transform(rest, lambda x: x["token"]), HEADER)
    cut = F.when(header > 0, F.slice(rest, 1, F.greatest(header.cast("int") - 2, F.lit(0)))).otherwise(rest)
    return F.transform(cut, lambda x: x["logprob"])


def path_score(tokens: Column) -> Column:
    """Mean log probability of an answer; the lower it is for "no information", the better the path."""
    found = answer_logprobs(tokens)
    return F.aggregate(found, F.lit(0.0), lambda s, x: s + x) / F.size(found)


def sampled_paths(questions: DataFrame, propose: Callable[[DataFrame], DataFrame], answer: Callable[[DataFrame], DataFrame], most_steps: int = 3, plan: bool = True) -> DataFrame:
    """Greedy paths: qid, question, subqueries, answers, calls.

    Each round a rule plans an open question's next sub-query, or ``propose`` is asked for it:
    (qid, question, subqueries, answers) to (qid, text). A path ends at its number of steps, when a
    planned sub-query repeats one, when the model says to stop after a first step, or when the model
    has been asked four times as often as steps were to come. Empty and repeated proposals only count as asked.
    """
    scratch = Scratch(questions.sparkSession, "sampled")
    none = F.array().cast("array<string>")
    state = frames(questions.select("qid", "question")).withColumns({"subqueries": none, "answers": none, "calls": F.lit(0), "open": F.lit(True)})
    state = scratch.save(state.withColumn("most", least_steps(F.col("frame"), most_steps)), "state")
    while not state.where("open").isEmpty():
        heard = [F.coalesce(F.try_element_at("answers", F.lit(i)), F.lit("")) for i in (1, 2)]
        known = scratch.save(state.where("open").withColumns({"e1": answer_entity(heard[0]), "e2": answer_entity(heard[1]), "missed": sub_answer(heard[0]) == NO_INFO, "missed_again": sub_answer(heard[1]) == NO_INFO}), "known")
        rule = next_query(F.col("frame"), F.size("answers"), F.col("e1"), F.col("e2"), F.col("missed"), F.col("missed_again")) if plan else F.lit(None).cast("string")
        planned = scratch.save(known.withColumn("rule", follow_up(rule)).drop("e1", "e2", "missed", "missed_again"), "planned")
        spent = F.col("calls") >= 4 * F.col("most")
        asks = planned.where(F.col("rule").isNull() & ~spent)
        told = propose(asks.select("qid", "question", "subqueries", "answers")).select("qid", "text")
        both = planned.join(told, "qid", "left").withColumn("made", F.when(F.col("rule").isNotNull(), F.col("rule")).otherwise(follow_up(sub_query(F.col("text")))))
        made = F.coalesce("made", F.lit(""))
        repeated = F.array_contains("subqueries", made)
        stop = (F.upper(made) == STOP) & (F.size("subqueries") > 0)
        ends = (F.col("rule").isNull() & spent) | stop | (F.col("rule").isNotNull() & repeated)
        step = F.when(~ends & (made != "") & ~repeated, made)
        both = scratch.save(both.withColumns({"ends": ends, "subquery": step}), "asked")
        got = answer(both.where("subquery is not null").select("qid", "subquery")).select("qid", "subanswer")
        joined = both.join(got, "qid", "left")
        live = F.col("subquery").isNotNull()
        moved = joined.select(
            "qid", "question", "frame", F.when(live, F.concat("subqueries", F.array("subquery"))).otherwise(F.col("subqueries")).alias("subqueries"),
            F.when(live, F.concat("answers", F.array(F.coalesce("subanswer", F.lit(NO_INFO))))).otherwise(F.col("answers")).alias("answers"),
            (F.col("calls") + (F.col("rule").isNull() & ~spent).cast("int")).alias("calls"), (~F.col("ends") & (F.size("subqueries") + live.cast("int") < F.col("most"))).alias("open"), "most",
        )
        state = scratch.save(state.where("not open").select(*moved.columns).unionByName(moved), "state")
    return state.select("qid", "question", "subqueries", "answers", "calls")


def beam_search(questions: DataFrame, expand: Callable[[DataFrame], DataFrame], answer: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame], steps: int = 3, beam: int = 1) -> DataFrame:
    """(qid, subqueries, answers): the best path after ``steps`` expansions, of which the ``beam`` of least score go on each time.

    ``expand`` takes paths (qid, path, question, subqueries, answers) to (qid, path, no, subquery),
    ``answer`` takes (qid, path, no, subquery) to the same with subanswer, ``score`` takes paths to
    (qid, path, score). Equal scores keep the order in which paths came. A path nothing follows ends there.
    """
    scratch = Scratch(questions.sparkSession, "beam")
    none = F.array().cast("array<string>")
    paths = scratch.save(questions.select("qid", F.lit(0).cast("long").alias("path"), "question").withColumns({"subqueries": none, "answers": none}), "paths")
    for _ in range(steps):
        made = scratch.save(expand(paths).select("qid", "path", "no", "subquery"), "made")
        told = answer(made).select("qid", "path", "no", "subanswer")
        grown = made.join(told, ["qid", "path", "no"], "left").join(paths, ["qid", "path"])
        order = Window.partitionBy("qid").orderBy("path", "no")
        heard = F.coalesce("subanswer", F.lit(NO_INFO))
        grown = grown.select("qid", (F.row_number().over(order) - 1).cast("long").alias("path"), "question", F.concat("subqueries", F.array("subquery")).alias("subqueries"), F.concat("answers", F.array(heard)).alias("answers"))
        grown = scratch.save(grown, "grown")
        ranked = grown.join(score(grown).select("qid", "path", "score"), ["qid", "path"], "left")
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.asc_nulls_last("score"), "path"))
        kept = ranked.withColumn("place", place).where(F.col("place") <= beam)
        kept = kept.select("qid", (F.col("place") - 1).cast("long").alias("path"), "question", "subqueries", "answers")
        paths = scratch.save(kept.unionByName(paths.join(grown.select("qid").distinct(), "qid", "left_anti")), "paths")
    return paths.where("path = 0").select("qid", "subqueries", "answers")
