"""Queries of text parsers, JSON and evaluation reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from marlspike.functions import json_text as J, text as T
from marlspike.operators import evaluate, metrics, rag_metrics
from marlspike.plans.catalogue import ANSWER, BM25, SENTENCES, TOKENS, bm25_topk, query, read
from marlspike.scratch import Scratch

NONE = T.NO_INFO
#: SQL for the canonical form of a bare answer.
CANONICAL = f"CASE WHEN trim(%s) = '' OR lower(trim(%s)) IN ('no relevant information found', 'unable to determine.', 'unable to determine', 'cannot determine', 'unknown') THEN '{NONE}' WHEN lower(trim(%s)) IN ('yes', 'no', 'insufficient information') THEN lower(trim(%s)) ELSE trim(%s) END"


def canonical(x: str) -> str:
    return CANONICAL.replace("%s", x)


def form(x: str) -> str:
    return f"array_to_string({ANSWER % x}, ' ')"


# --- answers and queries as models write them -----------------------------------------------------

LABELS = ("SubQuery: ", "SubAnswer: ", "Final Answer: ")
#: Fixed short answers that replace some texts below, so that each canonical form comes up.
SHORT = ("Yes", "NO", "Unknown", "cannot determine", "", "insufficient information", '"quoted"')
REPLY = "CASE conv_id % 9 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SHORT)) + " ELSE left(regexp_replace(text, '\\s+', ' ', 'g'), 40) END"


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with a reply that is a short answer or the text's start."""
    out = F.left(F.regexp_replace("text", r"\s+", " "), F.lit(40))
    for i, s in reversed(list(enumerate(SHORT))):
        out = F.when(F.col("conv_id") % 9 == i, s).otherwise(out)
    return read(spark, sf, "conversations").select("conv_id", "turn", out.alias("reply"))


@query(f"""WITH r AS (SELECT conv_id, turn, {REPLY} AS reply FROM conversations), u AS (SELECT *, CASE WHEN starts_with(reply, '"') THEN 'quoted' ELSE reply END AS bare FROM r)
SELECT conv_id, turn, CASE WHEN reply = '' AND turn % 2 = 0 THEN 'more' ELSE {canonical("bare")} END AS answer FROM u""")
def model_answers(spark, sf):
    """An empty part takes the next line with it, whose label then goes."""
    said = F.concat(F.lit("<think>so\nfar</think>SubQuery: x?\nSubAnswer: wrong\nFinal Answer: "), F.col("reply"), F.when(F.col("turn") % 2 == 0, "\nSubQuery: more").otherwise(""))
    return _replies(spark, sf).select("conv_id", "turn", T.model_answer(said).alias("answer"))


@query(f"""WITH r AS (SELECT conv_id, turn, {REPLY} AS reply FROM conversations), u AS (SELECT *, CASE WHEN reply = '' THEN '' ELSE {canonical("reply")} END AS x FROM r)
SELECT conv_id, turn, CASE WHEN reply = '' THEN '{NONE}' ELSE x END AS subanswer, CASE WHEN reply = '' THEN '' ELSE x END AS final, trim(reply) AS subquery FROM u WHERE NOT starts_with(reply, '"')""")
def answer_normalisers(spark, sf):
    """Labels, thoughts and lines around replies; replies in quotes are another query's."""
    rows = _replies(spark, sf).where(~F.col("reply").startswith('"'))
    sub = F.concat(F.lit("<think>hm</think> SubAnswer: "), F.col("reply"))
    last = F.concat(F.lit("Reason\n\nFinal Answer: "), F.col("reply"), F.lit("\n "))
    ask = F.concat(F.lit("<think>a</think>\"SubQuery: "), F.col("reply"), F.lit('"'))
    return rows.select("conv_id", "turn", T.sub_answer(sub).alias("subanswer"), T.final_answer(last).alias("final"), T.sub_query(ask).alias("subquery"))


@query("""SELECT n_nationkey, 'What nationality is ' || n_name || '?' AS asked, 'Who is the father of ' || n_name || '?' AS father, 'Who is ' || n_name || '''s spouse?' AS spouse, n_name AS entity,
CASE WHEN n_nationkey % 2 = 0 THEN 'Who is ' || n_name || '?' ELSE 'Which country is ' || n_name || ' from?' END AS canonical FROM nation""")
def follow_up_rewrites(spark, sf):
    name = F.col("n_name")
    asked = lambda a, b: F.concat(F.lit(a), name, F.lit(b))
    titled = F.concat(F.element_at(F.array(*map(F.lit, ("Queen ", "Grand Duke ", "", "St. "))), (F.col("n_nationkey") % 4 + 1).cast("int")), name, F.lit(", of that name; or another"))
    canonical_ = F.when(F.col("n_nationkey") % 2 == 0, asked("<think>x</think> SubQuery: Who  is “", "”?")).otherwise(asked("Intermediate query 3: Who is the country of ", "?"))
    return read(spark, sf, "nation").select(
        "n_nationkey", T.follow_up(asked("Who is the nationality of ", "?")).alias("asked"), T.follow_up(asked("who was the father of ", "?")).alias("father"),
        T.follow_up(asked("Who was ", "'s spouse?")).alias("spouse"), T.answer_entity(titled).alias("entity"), T.canonical_query(canonical_).alias("canonical"),
    )


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) > 21 THEN array_to_string(w[1:10], ' ') || ' ' || array_to_string(w[len(w)-10:len(w)], ' ') ELSE array_to_string(w, ' ') END AS kept FROM w""")
def truncated_middles(spark, sf):
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    return read(spark, sf, "documents").select("doc_id", F.array_join(T.truncated_middle(words, 21), " ").alias("kept"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, trim(unnest(x), ' ') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
n AS (SELECT doc_id, i, line, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '')) AS n FROM l WHERE line <> ''),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS held, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM n),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM c WHERE held <= 60 OR r = 1 GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 60 THEN text ELSE coalesce(kept, '') END AS kept FROM documents d LEFT JOIN k USING (doc_id) WHERE text IS NOT NULL""")
def line_budgets(spark, sf):
    return read(spark, sf, "documents").where("text is not null").select("doc_id", J.first_lines_within(F.col("text"), 60).alias("kept"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1.0 WHEN doc_id % 4 = 1 THEN round((doc_id % 100) / 100.0, 2) WHEN doc_id % 4 = 2 THEN 0.0 ELSE 0.0 END::DOUBLE AS score,
['q' || doc_id, 'second ' || lang] AS questions, ['1. q' || doc_id, '2) more'] AS variants FROM documents""")
def judgement_parsers(spark, sf):
    share = F.format_string("%.2f", F.col("doc_id") % 100 / 100.0)
    said = F.when(F.col("doc_id") % 4 == 0, "score: 1.00 of one").when(F.col("doc_id") % 4 == 1, F.concat(F.lit("I say "), share)).when(F.col("doc_id") % 4 == 2, "none").otherwise("0")
    asked = F.concat(F.lit(" 问题1：q"), F.col("doc_id").cast("string"), F.lit("\n\n问题 2: second "), F.col("lang"))
    listed = F.concat(F.lit("Here:\n1. q"), F.col("doc_id").cast("string"), F.lit("\n2) more\n- no"))
    return read(spark, sf, "documents").select("doc_id", T.score_in(said).alias("score"), T.question_lines(asked).alias("questions"), T.numbered_lines(listed).alias("variants"))


# --- JSON -----------------------------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.k'), 'none') AS present, 'none' AS absent FROM events")
def json_paths(spark, sf):
    props = F.col("props")
    return read(spark, sf, "events").select("event_id", J.at_path(props, ["k"]).alias("k"), J.at_path(props, ["k"], "none").alias("present"), J.at_path(props, ["k", 0, "z"], "none").alias("absent"))


@query("SELECT n_nationkey, n_name AS head, 'in ' || r_regionkey AS relation, r_name AS tail FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_repairs(spark, sf):
    """Relations in four states of repair: valid, in prose, in single quotes, cut off."""
    rows = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    a, b, c = J.ENTITY_KEYS
    record = F.format_string(f'{{"{a}": "%s", "{b}": "in %s", "{c}": "%s"}}', "n_name", F.col("r_regionkey").cast("string"), "r_name")
    turn = F.col("n_nationkey") % 4
    text = F.when(turn == 0, F.concat(F.lit("["), record, F.lit("]"))).when(turn == 1, F.concat(F.lit("Found:\n["), record, F.lit("\n] so.")))
    text = text.when(turn == 2, F.concat(F.lit("["), F.replace(record, F.lit('"'), F.lit("'")), F.lit("]"))).otherwise(F.concat(F.lit("[ "), record, F.lit(f', {{"{a}": "cut', )))
    made = rows.select("n_nationkey", F.explode(J.parsed_records(text, J.ENTITY_KEYS)).alias("m"))
    return made.select("n_nationkey", F.col("m")[a].alias("head"), F.col("m")[b].alias("relation"), F.col("m")[c].alias("tail"))


@query("SELECT p_partkey, 'made of ' || p_type AS event, list_filter(string_split(p_type, ' '), lambda x: x <> '') AS entities FROM part")
def json_members(spark, sf):
    event, entity = J.MEMBER_KEYS
    listed = F.array_join(F.transform(F.split("p_type", " "), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), " , ")
    text = F.concat(F.lit(f'x {{"{event}": "made of '), F.col("p_type"), F.lit(f'", "{entity}": ["",'), listed, F.lit("]} trailing"))
    return read(spark, sf, "part").select("p_partkey", F.explode(J.rebuilt_members(text)).alias("m")).select("p_partkey", "m.event", "m.entities")


@query("""SELECT r_regionkey, n_nationkey::VARCHAR AS doc_id, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE '' END AS title,
CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN 'about ' || n_name ELSE 'first' || chr(10) || n_name END AS contents FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_regionkey, 'graph_chunk', '', 'bare ' || r_name FROM region""")
def service_answers(spark, sf):
    """Answers with records of three shapes at several depths, and one that is a bare string."""
    name, number = F.col("n_name"), F.col("n_nationkey")
    quoted = lambda c: F.to_json(F.array(c))
    bare = lambda c: F.regexp_extract(quoted(c), r"^\[(.*)\]$", 1)
    record = F.when(number % 3 == 0, F.concat(F.lit('{"id": '), number.cast("string"), F.lit(', "title": '), bare(name), F.lit("}")))
    record = record.when(number % 3 == 1, F.concat(F.lit('{"content": " ", "text": '), bare(F.concat(F.lit("about "), name)), F.lit(', "chunk_id": '), number.cast("string"), F.lit("}")))
    record = record.otherwise(F.concat(F.lit('{"doc_id": " '), number.cast("string"), F.lit('", "contents": ["first", {"body": '), bare(name), F.lit("}]}")))
    nations = read(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(record), ",").alias("all"))
    rows = read(spark, sf, "region").join(nations, F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(F.lit('{"hits": 3, "results": {"data": [['), F.col("all"), F.lit('], [], '), bare(F.concat(F.lit("bare "), F.col("r_name"))), F.lit(', {}, ""]}}'))
    return rows.select("r_regionkey", F.explode(J.service_records(text)).alias("r")).select("r_regionkey", "r.doc_id", "r.title", "r.contents")


@query("""SELECT item_id, CASE WHEN item_id % 3 = 0 THEN NULL ELSE 'What is ' || item_id || '?' END AS question, CASE WHEN item_id % 3 = 0 THEN NULL ELSE regexp_replace(trim(text), '\\n', '', 'g') END AS passage
FROM benchmark WHERE item_id % 3 <> 0 AND trim(text) <> ''""")
def qa_pairs(spark, sf):
    """Two pairs are asked for; every third item has only one and is left out."""
    number = F.col("item_id").cast("string")
    second = F.when(F.col("item_id") % 3 == 0, "no label").otherwise("参考段落：later")
    said = F.concat(F.lit("Sure. Q1: What is "), number, F.lit("?\n参考段落: "), F.lit(""), F.trim("text"), F.lit("\nQ2：Same?"), second)
    rows = read(spark, sf, "benchmark").where("trim(text) <> ''").select("item_id", F.explode(J.qa_pairs(said, 2)).alias("question", "passage"))
    return rows.where("question <> 'Same?'").select("item_id", "question", F.trim("passage").alias("passage"))


# --- facts ----------------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT conv_id AS qid, turn, {SENTENCES % 'text'} AS x FROM conversations WHERE role = 'assistant'), f AS (SELECT qid, turn, generate_subscripts(x, 1) AS i, unnest(x) AS fact FROM p)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY turn, i) - 1 AS fact_no, fact FROM f""")
def facts_of_paragraphs(spark, sf):
    part = F.struct("turn", (F.col("role") == "assistant").alias("is_supporting"), F.col("text").alias("paragraph_text"))
    items = read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("qid")).agg(F.array_sort(F.collect_list(part)).alias("paragraphs"))
    return evaluate.paragraph_facts(items)


@query(f"""WITH c AS (SELECT conv_id AS qid, role, max_by({SENTENCES % 'text'}, turn) AS x FROM conversations GROUP BY conv_id, role),
f AS (SELECT s.conv_id AS qid, s.turn, c.x[s.turn % 4 + 1] AS fact FROM conversations s JOIN c ON c.qid = s.conv_id AND c.role = s.role WHERE s.turn % 4 < len(c.x))
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY turn) - 1 AS fact_no, fact FROM f""")
def facts_of_contexts(spark, sf):
    turns = read(spark, sf, "conversations")
    context = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("title"), T.sentences(F.col("text")).alias("sentences"))))
    facts = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("title"), (F.col("turn") % 4).alias("place"))))
    return evaluate.context_facts(turns.groupBy(F.col("conv_id").alias("qid")).agg(context.alias("context"), facts.alias("supporting_facts")))


# --- reports --------------------------------------------------------------------------------------

#: Fixed beginnings of the questions, so that every category and flag comes up.
PREFIXES = ("Are both from the same country? ", "Who is the stepmother of ", "Who is the father-in-law of ", "Who is the director of film ", "")


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as samples of several steps; every third reply has no information."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf, "conversations").withColumns({"r": F.lead("role").over(w), "a": F.lead("text").over(w)}).where("role = 'user' and r = 'assistant'")
    told = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, NONE).otherwise(F.col("a"))
    step = F.struct("turn", F.col("text").alias("subquery"), told.alias("subanswer"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    opening = F.element_at(F.array(*map(F.lit, PREFIXES)), (F.col("conv_id") % 5 + 1).cast("int"))
    last = F.element_at("steps", -1)["subanswer"]
    closed = F.col("conv_id") % 4
    answer = F.when(closed == 0, "Final Answer: Yes").when(closed == 1, "no").otherwise(F.concat(F.lit("SubAnswer: "), last))
    truth = F.when(closed == 0, "yes").when(closed == 1, "Yes.").otherwise(F.element_at("steps", 1)["subanswer"])
    informed = F.size(F.filter("steps", lambda s: s["subanswer"] != NONE))
    return rows.select(
        F.col("conv_id").alias("qid"), F.concat(opening, F.element_at("steps", 1)["subquery"]).alias("question"), "steps", answer.alias("answer"), truth.alias("ground_truth"),
        F.round(informed / F.size("steps"), 6).alias("recall"),
    )


SAMPLES = f"""t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
st AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step, text AS subquery, CASE WHEN (conv_id + turn) % 3 = 0 THEN '{NONE}' ELSE a END AS subanswer FROM t WHERE role = 'user' AND r = 'assistant'),
sf AS (SELECT *, subanswer = '{NONE}' AS missing, {form("subquery")} AS form, first({form("subquery")}) OVER (PARTITION BY conv_id ORDER BY step) AS form1 FROM st),
q AS (SELECT conv_id, CASE conv_id % 5 {" ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PREFIXES))} END || first(subquery ORDER BY step) AS question, string_agg(lower(subquery), ' ' ORDER BY step) AS asked,
  count(*) AS n_steps, count(*) FILTER (WHERE NOT missing) AS informed, bool_or(step = 1 AND missing) AS first_failed, bool_or(step > 1 AND form <> '' AND form <> form1) AS other, bool_or(step > 1 AND NOT missing) AS later,
  CASE conv_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE last(subanswer ORDER BY step) END AS prediction, CASE conv_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'Yes.' ELSE first(subanswer ORDER BY step) END AS truth
  FROM sf GROUP BY conv_id),
cat AS (SELECT *, round(informed / n_steps, 6) AS recall, CASE WHEN contains(lower(question), 'same nationality') OR contains(lower(question), 'same country') OR contains(lower(question), 'same place') THEN 'comparison'
  WHEN contains(lower(question), 'father-in-law') OR contains(lower(question), 'mother-in-law') OR contains(lower(question), 'maternal ') OR contains(lower(question), 'paternal ') OR contains(lower(question), 'stepmother') OR contains(lower(question), 'stepfather') THEN 'complex_kinship'
  WHEN contains(lower(question), 'director of film') OR contains(lower(question), 'composer of film') OR contains(lower(question), 'performer of song') OR contains(lower(question), 'composer of song') OR contains(lower(question), 'director of the film') OR contains(lower(question), 'composer of the film') THEN 'role_bridge' ELSE 'other' END AS category FROM q),
fl AS (SELECT *, first_failed AND other AS rewritten, first_failed AND other AND later AS salvaged, category = 'comparison' AND informed = 1 AS one_side,
  (contains(lower(question), 'father-in-law') AND NOT contains(asked, 'spouse')) OR (contains(lower(question), 'maternal grandmother') AND NOT contains(asked, 'mother'))
  OR (contains(lower(question), 'paternal grandmother') AND NOT contains(asked, 'father')) OR (contains(lower(question), 'stepmother') AND NOT contains(asked, 'father')) AS drift FROM cat)"""


def share(part: str, whole: str = "count(*)") -> str:
    return f"round(coalesce(({part}) / nullif({whole}, 0), 0), 6)"


@query(f"""WITH {SAMPLES} SELECT category, count(*) AS n, count(*) FILTER (WHERE first_failed) AS first_failed, count(*) FILTER (WHERE rewritten) AS rewritten, count(*) FILTER (WHERE salvaged) AS salvaged,
count(*) FILTER (WHERE drift) AS drift, count(*) FILTER (WHERE one_side) AS one_side_missing, {share("count(*) FILTER (WHERE rewritten)", "count(*) FILTER (WHERE first_failed)")} AS rewrite_rate FROM fl GROUP BY category""")
def category_failure_rollup(spark, sf):
    return metrics.failure_report(metrics.failure_flags(_samples(spark, sf)))


@query(f"WITH {SAMPLES} SELECT conv_id AS qid, category, first_failed, rewritten, salvaged, drift, one_side AS one_side_missing FROM fl")
def failure_flags(spark, sf):
    return metrics.failure_flags(_samples(spark, sf)).select("qid", "category", "first_failed", "rewritten", "salvaged", "drift", "one_side_missing")


@query(f"""WITH {SAMPLES}, y AS (SELECT *, {form("truth")} IN ('yes', 'no') AS closed, {form("prediction")} <> {form("truth")} AS wrong FROM fl)
SELECT {share("count(*) FILTER (WHERE recall = 0)")} AS zero_recall_rate, {share(f"count(*) FILTER (WHERE prediction = '{NONE}')")} AS no_info_rate, {share("count(*) FILTER (WHERE closed AND wrong)", "count(*) FILTER (WHERE closed)")} AS yes_no_error_rate,
{share("count(*) FILTER (WHERE first_failed)")} AS first_step_failure_rate, {share("count(*) FILTER (WHERE rewritten)", "count(*) FILTER (WHERE first_failed)")} AS rewrite_after_failure_rate,
{share("count(*) FILTER (WHERE salvaged)", "count(*) FILTER (WHERE rewritten)")} AS rewrite_salvage_rate, count(*) FILTER (WHERE drift) AS relation_drift_count, {share("count(*) FILTER (WHERE one_side)", "count(*) FILTER (WHERE category = 'comparison')")} AS one_side_missing_rate,
{share("count(*) FILTER (WHERE category = 'complex_kinship' AND recall = 0)", "count(*) FILTER (WHERE category = 'complex_kinship')")} AS complex_kinship_failure_rate, {share("count(*) FILTER (WHERE category = 'role_bridge' AND recall = 0)", "count(*) FILTER (WHERE category = 'role_bridge')")} AS role_bridge_failure_rate FROM y""")
def failure_rates(spark, sf):
    return evaluate.failure_rates(_samples(spark, sf))


@query(f"WITH {SAMPLES} SELECT category, count(*) AS n, {share('count(*) FILTER (WHERE recall = 0)')} AS zero_recall_rate, round(avg(recall), 6) AS avg_recall FROM fl GROUP BY category")
def category_recalls(spark, sf):
    return evaluate.category_recalls(_samples(spark, sf))


@query(f"""WITH {SAMPLES}, p AS (SELECT conv_id, prediction, truth, {ANSWER % 'prediction'} AS a, {ANSWER % 'truth'} AS b FROM fl),
c AS (SELECT *, array_to_string(a, ' ') AS fa, array_to_string(b, ' ') AS fb, coalesce(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) AS same FROM p)
SELECT round(avg(CASE WHEN fa = fb THEN 1 ELSE 0 END), 6) AS exact_match, round(avg(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN same = 0 THEN 0.0 ELSE 2.0 * (same / len(a)) * (same / len(b)) / (same / len(a) + same / len(b)) END), 6) AS token_f1,
round(avg(CASE WHEN fa <> '' AND fb <> '' AND (contains(' ' || fa || ' ', ' ' || fb || ' ') OR contains(' ' || fb || ' ', ' ' || fa || ' ')) THEN 1 ELSE 0 END), 6) AS contains_match,
{share("count(*) FILTER (WHERE fb IN ('yes', 'no') AND fa = fb)", "count(*) FILTER (WHERE fb IN ('yes', 'no'))")} AS yes_no_accuracy, count(*) FILTER (WHERE fb IN ('yes', 'no')) AS yes_no_total, {share(f"count(*) FILTER (WHERE prediction = '{NONE}')")} AS no_info_rate FROM c""")
def answer_quality(spark, sf):
    return evaluate.answer_quality(_samples(spark, sf))


@query(f"WITH {SAMPLES} SELECT round(avg(n_steps), 6) AS avg_steps, round(quantile_cont(n_steps, 0.5), 6) AS median_steps, max(n_steps) AS max_steps, min(n_steps) AS min_steps FROM fl")
def reasoning_steps(spark, sf):
    return evaluate.step_counts(_samples(spark, sf))


@query("SELECT sum(length(text) % 3)::BIGINT AS own_format_issues, (SELECT sum(conv_id % 2)::BIGINT FROM (SELECT DISTINCT conv_id FROM conversations)) AS plain_format_issues FROM conversations")
def format_issue_totals(spark, sf):
    own = F.collect_list((F.length("text") % 3).cast("long")).alias("own_steps")
    return evaluate.format_issues(read(spark, sf, "conversations").groupBy("conv_id").agg(own).withColumn("plain", F.col("conv_id") % 2))


def _timed(spark: SparkSession, sf: str) -> DataFrame:
    times = F.array(F.col("value") / 4, F.col("value") / 2, F.col("value"), F.col("value") * 2)
    return read(spark, sf, "events").select("event_type", F.col("event_id").alias("qid"), times.alias("time"))


@query("""SELECT event_type, count(*) AS total_samples, round(avg(value / 4), 6) AS avg_q2t_time, round(avg(value / 2), 6) AS avg_ppr_time, round(avg(value), 6) AS avg_reranker_time, round(avg(value * 2), 6) AS avg_llm_call_time,
round(avg(value), 6) AS avg_path_generation_time, round(avg(value * 2), 6) AS avg_final_generation_time FROM events GROUP BY event_type""")
def timing_summary(spark, sf):
    return evaluate.timing_summary(_timed(spark, sf), ["event_type"])


@query("""SELECT part, count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95, max(v) AS most, min(v) AS least FROM
(SELECT 'path_generation' AS part, value AS v FROM events UNION ALL SELECT 'final_generation', value * 2 FROM events UNION ALL SELECT 'end_to_end', value + value * 2 FROM events) GROUP BY part""")
def time_distributions(spark, sf):
    return evaluate.time_distributions(_timed(spark, sf))


@query("SELECT event_id AS qid, round(value + value * 2, 6) AS total_time FROM events WHERE value IS NOT NULL ORDER BY total_time DESC, qid LIMIT 8")
def slowest_samples(spark, sf):
    return evaluate.slowest(_timed(spark, sf).where("time[2] is not null"), 8)


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'full/out_small_' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '_full' ELSE '' END || '.json' ELSE 'full/out_Full_' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '_full' ELSE '' END || '.json' END AS path FROM documents""")
def output_alignment(spark, sf):
    number = F.col("doc_id").cast("string")
    given = F.when(F.col("doc_id") % 2 == 0, "data/Dev_SMALL.json").otherwise("data/small/dev.json")
    saved = F.concat(F.lit("full/out_Full_"), number, F.when(F.col("doc_id") % 3 == 0, "_full").otherwise(""), F.lit(".json"))
    return read(spark, sf, "documents").select("doc_id", evaluate.aligned_output(given, saved).alias("path"))


@query("""SELECT count(*) FILTER (WHERE a > b) AS win, count(*) FILTER (WHERE a < b) AS lose, count(*) FILTER (WHERE a = b) AS tie FROM
(SELECT l.doc_id, l.quality AS a, l.toxic AS b FROM labels l WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL)""")
def recall_comparison(spark, sf):
    rows = read(spark, sf, "labels").where("quality is not null and toxic is not null")
    side = lambda c: rows.select(F.col("doc_id").alias("qid"), F.col(c).alias("recall"))
    return metrics.win_lose_tie(side("quality"), side("toxic"))


@query("""SELECT l_returnflag, CASE WHEN n > bad THEN round((n - bad) / n, 4) ELSE -1.0 END AS precision, CASE WHEN n > bad THEN round((n - bad) / (n - bad + more), 4) ELSE -1.0 END AS recall,
CASE WHEN n > bad THEN round(2 * ((n - bad) / n) * ((n - bad) / (n - bad + more)) / ((n - bad) / n + (n - bad) / (n - bad + more)), 4) ELSE -1.0 END AS f1 FROM
(SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_linenumber = 1 OR l_returnflag = 'R') AS bad, count(*) FILTER (WHERE l_quantity > 40) AS more FROM lineitem GROUP BY l_returnflag)""")
def extraction_quality(spark, sf):
    rows = read(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_if((F.col("l_linenumber") == 1) | (F.col("l_returnflag") == "R")).alias("bad"), F.count_if(F.col("l_quantity") > 40).alias("more")
    )
    return rows.select("l_returnflag", *[F.nanvl(c, F.lit(-1.0)).alias(n) for n, c in metrics.extraction_quality(F.col("n"), F.col("bad"), F.col("more")).items()])


def retrieved(spark: SparkSession, sf: str) -> DataFrame:
    return bm25_topk(spark, sf)


# --- answers and their contexts -------------------------------------------------------------------

CLAIMS = f"""top AS (SELECT qid, rank, text FROM br JOIN documents ON br.id = doc_id WHERE rank <= 3),
rows AS (SELECT item_id AS qid, benchmark.text AS reference, (SELECT array_to_string({SENTENCES % "t.text"}[1:3], ' ') FROM top t WHERE t.qid = item_id AND t.rank = 1) AS response FROM benchmark),
texts AS (SELECT qid, rank AS m, text FROM top),
cl AS (SELECT qid, 'response' AS side, unnest(s) AS claim, generate_subscripts(s, 1) AS n FROM (SELECT qid, {SENTENCES % "response"} AS s FROM rows)
  UNION ALL SELECT qid, 'reference', unnest(s), generate_subscripts(s, 1) FROM (SELECT qid, {SENTENCES % "reference"} AS s FROM rows)),
tx AS (SELECT qid, m, {TOKENS % "text"} AS tok, 'both' AS side FROM texts UNION ALL SELECT qid, 0, {TOKENS % "reference"}, 'response' FROM rows UNION ALL SELECT qid, 0, {TOKENS % "coalesce(response, '')"}, 'reference' FROM rows),
w AS (SELECT *, list_distinct({TOKENS % "claim"}) AS own FROM cl),
v AS (SELECT w.qid, w.side, w.n, tx.m, CASE WHEN len(own) = 0 THEN false ELSE len(list_intersect(own, tok)) / len(own) >= 0.8 END AS yes FROM w JOIN tx ON w.qid = tx.qid AND tx.side IN ('both', w.side)),
ctx AS (SELECT qid, m, bool_or(yes AND side = 'reference') AS useful, bool_or(yes AND side = 'response') AS used FROM v WHERE m > 0 GROUP BY qid, m),
c AS (SELECT v.qid, side, n, bool_or(v.m > 0 AND yes) AS found, bool_or(v.m = 0 AND yes) AS agreed, bool_or(coalesce(useful, false) AND yes) AS misled, bool_or(v.m > 0) AS had
  FROM v LEFT JOIN ctx ON v.qid = ctx.qid AND v.m = ctx.m GROUP BY v.qid, side, n),
k AS (SELECT qid, count(*) FILTER (side = 'response' AND found) / nullif(count(*) FILTER (side = 'response' AND had), 0) AS faithfulness,
  count(*) FILTER (side = 'reference' AND found) / nullif(count(*) FILTER (side = 'reference' AND had), 0) AS context_recall,
  count(*) FILTER (side = 'response' AND NOT agreed AND misled) / nullif(count(*) FILTER (side = 'response' AND had), 0) AS noise_sensitivity FROM c GROUP BY qid),
hits AS (SELECT *, sum(useful::INT) OVER (PARTITION BY qid ORDER BY m) AS hu, sum(used::INT) OVER (PARTITION BY qid ORDER BY m) AS hs FROM ctx),
ap AS (SELECT qid, coalesce(sum(hu / m) FILTER (useful) / nullif(sum(useful::INT), 0), 0) AS context_precision, coalesce(sum(hs / m) FILTER (used) / nullif(sum(used::INT), 0), 0) AS context_utilization FROM hits GROUP BY qid)"""


@query(f"""WITH {BM25}, {CLAIMS} SELECT r.qid, round(faithfulness, 6) AS faithfulness, round(context_recall, 6) AS context_recall, round(context_precision, 6) AS context_precision,
round(context_utilization, 6) AS context_utilization, round(noise_sensitivity, 6) AS noise_sensitivity FROM rows r LEFT JOIN k USING (qid) LEFT JOIN ap USING (qid)""")
def rag_claim_metrics(spark, sf):
    """Benchmark items as questions and references, the three best documents as contexts, the first three sentences of the best as the response."""
    names = ["faithfulness", "context_recall", "context_precision", "context_utilization", "noise_sensitivity"]
    return rag_metrics.rag_metrics(_answers(spark, sf), names)


@query()
def rag_all_metrics(spark, sf):
    """All twelve metrics; hashed embeddings can't be told in SQL."""
    return rag_metrics.rag_metrics(_answers(spark, sf))


def _answers(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    top = bm25_topk(spark, sf).where("rank <= 3").join(docs, "id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"))
    top = Scratch(spark, "rag").save(top.select("qid", F.transform("x", lambda t: t["text"]).alias("retrieved_contexts")), "contexts")
    items = read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("user_input"), F.col("text").alias("reference")).join(top, "qid", "left")
    return items.withColumn("response", F.array_join(F.slice(T.sentences(F.element_at("retrieved_contexts", 1)), 1, 3), " "))
