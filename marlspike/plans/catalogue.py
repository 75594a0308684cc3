"""Queries over the driver's tables, and the SQL that an independent engine answers them with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from marlspike.functions import text as T
from marlspike.operators import agent, cache, fusion, graph, hnsw, ivf, metrics, search, store, training
from marlspike.scratch import Scratch
from marlspike.sources import corpus, loaders, splitters

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as the query of its name."""

    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- SQL fragments -------------------------------------------------------------------------------

TOKENS = r"list_filter(regexp_split_to_array(lower(%s), '[^\p{L}\p{N}_]+'), lambda x: x NOT IN ('', 'a', 'an', 'the'))"
ANSWER = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(%s, '')), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the'))"
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(%s, '([.?!])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: trim(s)), lambda s: s <> '')"
TERMS = f"""
tok AS (SELECT doc_id AS id, unnest({TOKENS % "text"}) AS term FROM documents),
t AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY id, term),
q AS (SELECT DISTINCT qid, term FROM (SELECT item_id AS qid, unnest({TOKENS % "text"}) AS term FROM benchmark))"""
BM25 = f"""{TERMS},
d AS (SELECT id, sum(tf) AS dl FROM t GROUP BY id),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
bm AS (SELECT q.qid, t.id, round(sum(ln((st.n - f.df + 0.5) / (f.df + 0.5) + 1) * t.tf * 2.2 / (t.tf + 1.2 * (1 - 0.75 + 0.75 * d.dl / st.avgdl))), 6) AS score
  FROM q JOIN t ON q.term = t.term JOIN f ON f.term = t.term JOIN d ON d.id = t.id, st GROUP BY q.qid, t.id),
br AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm)"""
SPARSE = """
sq AS (SELECT qid, term, ln(1 + count(*)) AS w FROM (SELECT item_id AS qid, unnest(%s) AS term FROM benchmark) GROUP BY qid, term),
sp AS (SELECT sq.qid, t.id, round(sum(sq.w * ln(1 + t.tf)), 6) AS score FROM sq JOIN t ON sq.term = t.term GROUP BY sq.qid, t.id),
sr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sp)""" % (TOKENS % "text")


def _dense_sql(measure: str, order: str, score: str, k: int = 3, where: str = "", floor: str = "") -> str:
    return f"""
WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT qid, vec_id AS id, round({measure}, 6) AS raw FROM q, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings {where})),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY raw {order}, id) AS rank FROM s)
SELECT qid, rank, id, round({score}, 6) AS score FROM r WHERE rank <= {k} {floor}"""


IP = "list_dot_product(qv, v)"
L2 = "list_dot_product(qv, qv) - 2 * list_dot_product(qv, v) + list_dot_product(v, v)"
COS = "list_dot_product(qv, v) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v)))"


# --- search --------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Search queries are the rows whose id 20 divides, against all rows."""
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return v.where("id % 20 = 0").select(F.col("id").alias("qid"), "v"), v


@query(_dense_sql(IP, "DESC", "least(raw, 1.0)"))
def dense_topk_ip(spark, sf):
    q, v = _vectors(spark, sf)
    return search.dense_topk(q, v, 3, "ip")


@query(_dense_sql(L2, "ASC", "greatest(1 - raw / 2, 0.0)"))
def dense_topk_l2(spark, sf):
    q, v = _vectors(spark, sf)
    return search.dense_topk(q, v, 3, "l2")


@query(_dense_sql(COS, "DESC", "least(raw, 1.0)"))
def dense_topk_cosine(spark, sf):
    q, v = _vectors(spark, sf)
    return search.dense_topk(q, v, 3, "cosine")


@query(_dense_sql(IP, "DESC", "least(raw, 1.0)", where="WHERE label IN (1, 2, 3)"))
def dense_topk_filtered(spark, sf):
    q, v = _vectors(spark, sf)
    return search.dense_topk(q, v.where(F.col("label").isin(1, 2, 3)), 3, "ip")


@query(_dense_sql(IP, "DESC", "least(raw, 1.0)", k=10, floor="AND least(raw, 1.0) >= 0.3"))
def dense_threshold(spark, sf):
    q, v = _vectors(spark, sf)
    return search.dense_topk(q, v, 10, "ip").where("score >= 0.3")


@query(f"""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, vec_id AS id, round({IP}, 6) AS raw FROM q, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))
SELECT qid, id, round(least(raw, 1.0), 6) AS score FROM s WHERE raw >= 0.3""")
def dense_range(spark, sf):
    """Every row within the threshold, however many."""
    q, v = _vectors(spark, sf)
    return search.dense_range(q, v, 0.3)


@query(_dense_sql(IP, "DESC", "least(raw, 1.0)", k=10))
def ivf_topk_all_cells(spark, sf):
    """The index of cells with every cell probed and every row ranked exactly."""
    q, v = _vectors(spark, sf)
    index = ivf.IvfIndex.build(v.withColumnRenamed("label", "tag"), f"{Scratch(spark, 'ivf').root}/index")
    return index.search(q, 10, probes=index.settings.cells, refine=None)


@query(_dense_sql(IP, "DESC", "least(raw, 1.0)", k=3, where="WHERE label IN (1, 2, 3) AND vec_id % 10 <> 7"))
def ivf_topk_filtered(spark, sf):
    """All cells with a filter on labels, after the rows whose id ends in 7 were deleted and one half was added later."""
    q, v = _vectors(spark, sf)
    v = v.withColumnRenamed("label", "tag")
    index = ivf.IvfIndex.build(v.where("id % 2 = 0"), f"{Scratch(spark, 'ivf').root}/index")
    index.add(v.where("id % 2 = 1"))
    index.delete(v.where("id % 10 = 7"))
    return index.search(q, 3, probes=index.settings.cells, refine=None, tags=[1, 2, 3])


@query()
def ivf_topk(spark, sf):
    """The index of cells as it ships: as many cells as fitting asks for, codes first, the best 100 ranked exactly. Its recall is held in tests."""
    q, v = _vectors(spark, sf)
    return ivf.IvfIndex.build(v, f"{Scratch(spark, 'ivf').root}/index").search(q, 10)


@query()
def hnsw_topk(spark, sf):
    """Small-world graphs by shard. Their recall is held in tests."""
    q, v = _vectors(spark, sf)
    return hnsw.HnswIndex.build(v, f"{Scratch(spark, 'hnsw').root}/index").search(q, 10)


def _items(spark: SparkSession, sf: str) -> DataFrame:
    items = read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return items.select("qid", F.explode(T.recall_tokens(F.col("text"))).alias("term"))


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return search.saved_terms(search.term_counts(read(spark, sf, "documents"), "doc_id", "text"))


def _sparse(spark: SparkSession, sf: str, k: int, terms: DataFrame | None = None) -> DataFrame:
    asked = _items(spark, sf).groupBy(F.col("qid").alias("id"), "term").agg(F.count("*").alias("tf"))
    return search.sparse_topk(search.log_weights(asked, "qid"), search.log_weights(terms or _terms(spark, sf)), k)


@query(f"WITH {TERMS}, {SPARSE} SELECT qid, rank, id, score FROM sr WHERE rank <= 3")
def sparse_topk_ip(spark, sf):
    return _sparse(spark, sf, 3)


@query(f"WITH {BM25} SELECT qid, rank, id, score FROM br WHERE rank <= 10")
def bm25_topk(spark, sf):
    return search.bm25_topk(_items(spark, sf), _terms(spark, sf), 10)


@query(f"""WITH {BM25}, e AS (SELECT bm.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r
FROM bm JOIN documents ON bm.id = documents.doc_id WHERE lang = 'en') SELECT qid, r AS rank, id, score FROM e WHERE r <= 10""")
def bm25_topk_filtered(spark, sf):
    allowed = read(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    return search.bm25_topk(_items(spark, sf), _terms(spark, sf), 10, allowed)


@query(f"""WITH {BM25},
i AS (SELECT term, ln(st.n - f.df + 0.5) - ln(f.df + 0.5) AS idf FROM f, st),
j AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i) ELSE idf END AS idf FROM i),
a AS (SELECT item_id AS qid, unnest({TOKENS % "text"}) AS term FROM benchmark),
s AS (SELECT a.qid, t.id, sum(j.idf * t.tf * 2.5 / (t.tf + 1.5 * (1 - 0.75 + 0.75 * d.dl / st.avgdl))) AS score
  FROM a JOIN t ON t.id = a.qid AND t.term = a.term JOIN j ON j.term = t.term JOIN d ON d.id = t.id, st GROUP BY a.qid, t.id)
SELECT b.item_id AS qid, x.doc_id AS id, round(coalesce(s.score, 0), 6) AS score
FROM benchmark b JOIN documents x ON b.item_id = x.doc_id LEFT JOIN s ON s.qid = b.item_id""")
def bm25_okapi_pairs(spark, sf):
    pairs = read(spark, sf, "benchmark").select(F.col("item_id").alias("qid")).join(read(spark, sf, "documents").select(F.col("doc_id").alias("id")), F.col("qid") == F.col("id"))
    return search.okapi_pairs(pairs, _items(spark, sf), _terms(spark, sf))


# --- text ----------------------------------------------------------------------------------------


@query(f"SELECT doc_id, array_to_string({TOKENS % 'text'}, ' ') AS form FROM documents")
def text_norm_recall(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.recall_form(F.col("text")).alias("form"))


@query(f"SELECT doc_id, array_to_string({ANSWER % 'text'}, ' ') AS form FROM documents")
def text_norm_squad(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.answer_form(F.col("text")).alias("form"))


@query(f"SELECT doc_id, len({SENTENCES % 'text'}) AS n_sentences FROM documents")
def sentence_split_counts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("SELECT min(doc_id) AS doc_id, length(text) AS n_chars FROM documents GROUP BY text")
def ordered_dedupe_docs(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return search.first_of_each(docs, "text", "doc_id").select("doc_id", F.length("text").alias("n_chars"))


@query(f"""WITH p AS (SELECT u.conv_id, u.turn, {ANSWER % 'u.text'} AS a, {ANSWER % 's.text'} AS b
  FROM conversations u JOIN conversations s ON s.conv_id = u.conv_id AND s.turn = u.turn + 1 WHERE u.role = 'user' AND s.role = 'assistant'),
c AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) AS same FROM p)
SELECT conv_id, turn, CASE WHEN array_to_string(a, ' ') = array_to_string(b, ' ') THEN 1 ELSE 0 END AS em,
  round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN same = 0 THEN 0.0 ELSE 2.0 * (same / len(a)) * (same / len(b)) / (same / len(a) + same / len(b)) END, 6) AS f1,
  CASE WHEN len(a) > 0 AND len(b) > 0 AND (contains(' ' || array_to_string(a, ' ') || ' ', ' ' || array_to_string(b, ' ') || ' ')
    OR contains(' ' || array_to_string(b, ' ') || ' ', ' ' || array_to_string(a, ' ') || ' ')) THEN 1 ELSE 0 END AS contains
FROM c""")
def exact_match_f1_contains(spark, sf):
    turns = read(spark, sf, "conversations")
    told = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("truth"))
    both = turns.where("role = 'user'").join(told, ["conv_id", "turn"])
    a, b = F.col("text"), F.col("truth")
    scored = metrics.token_f1_rows(both, "text", "truth", "f1")
    return scored.select("conv_id", "turn", metrics.exact_match(a, b).alias("em"), F.round("f1", 6).alias("f1"), metrics.contains_match(a, b).alias("contains"))


HITS = f"""{BM25},
facts AS (SELECT item_id AS qid, generate_subscripts(s, 1) - 1 AS fact_no, array_to_string({TOKENS % 'unnest(s)'}, ' ') AS fact
  FROM (SELECT item_id, {SENTENCES % 'text'} AS s FROM benchmark)),
got AS (SELECT qid, array_to_string({TOKENS % 'text'}, ' ') AS x FROM br JOIN documents ON br.id = documents.doc_id WHERE rank <= 10),
hits AS (SELECT f.qid, f.fact_no, max(CASE WHEN f.fact <> '' AND g.x <> '' AND (contains(g.x, f.fact) OR (contains(f.fact, g.x) AND length(g.x) > 0.5 * length(f.fact))) THEN 1 ELSE 0 END) AS hit
  FROM facts f LEFT JOIN got g ON f.qid = g.qid GROUP BY f.qid, f.fact_no)"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    found = bm25_topk(spark, sf).join(docs, "id").select("qid", "text")
    return metrics.soft_hits(metrics.golden_sentences(read(spark, sf, "benchmark"), "item_id", "text"), found)


@query(f"WITH {HITS} SELECT * FROM hits")
def soft_inclusion_hits(spark, sf):
    return _hits(spark, sf)


@query(f"""WITH {HITS}, p AS (SELECT qid, sum(hit) AS hits, count(*) AS total FROM hits GROUP BY qid)
SELECT round(sum(hits) / sum(total), 6) AS micro_recall, round(avg(hits / total), 6) AS macro_recall, count(*) AS n_questions FROM p""")
def micro_macro_recall(spark, sf):
    return metrics.micro_macro(metrics.recalls(_hits(spark, sf)))


# --- fusion, compression, packing ----------------------------------------------------------------


@query(f"""WITH {BM25}, {SPARSE},
m AS (SELECT qid, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS d FROM sr WHERE rank <= 10 WINDOW w AS (PARTITION BY qid)),
o AS (SELECT qid, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM br WHERE rank <= 10 WINDOW w AS (PARTITION BY qid)),
j AS (SELECT coalesce(m.qid, o.qid) AS qid, coalesce(m.id, o.id) AS id, m.d, o.s FROM m FULL JOIN o ON m.qid = o.qid AND m.id = o.id),
x AS (SELECT j.qid, j.id, round((0.4 + 0.3 / (1 + exp(-(length(b.text) - 6.0)))) * coalesce(d, 0) + (1 - (0.4 + 0.3 / (1 + exp(-(length(b.text) - 6.0))))) * coalesce(s, 0), 6) AS score,
  CASE WHEN d IS NULL THEN 'sparse' WHEN s IS NULL THEN 'dense' ELSE 'both' END AS retrieval_type FROM j JOIN benchmark b ON b.item_id = j.qid)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, id, score, retrieval_type FROM x""")
def minmax_fusion(spark, sf):
    queries = read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.length("text").alias("length"))
    terms = _terms(spark, sf)
    return fusion.weighted_fusion(_sparse(spark, sf, 10, terms), search.bm25_topk(_items(spark, sf), terms, 10), queries)


RRF = f"""{BM25}, {SPARSE},
l AS (SELECT qid, id, 0 AS list, rank - 1 AS r FROM br WHERE rank <= 10 UNION ALL SELECT qid, id, 1, rank - 1 FROM sr WHERE rank <= 10),
z AS (SELECT qid, id, round(sum(1.0::DOUBLE / (r + 60)), 6) AS score, min(list * 1000 + r) AS first FROM l GROUP BY qid, id),
y AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS rank FROM z)"""


def _rrf(spark: SparkSession, sf: str) -> DataFrame:
    zero = lambda df: df.withColumn("rank", F.col("rank") - 1)
    terms = _terms(spark, sf)
    return fusion.reciprocal_rank_fusion([zero(search.bm25_topk(_items(spark, sf), terms, 10)), zero(_sparse(spark, sf, 10, terms))])


@query(f"WITH {RRF} SELECT qid, id, score, rank FROM y")
def rrf_fusion(spark, sf):
    return _rrf(spark, sf)


@query(f"WITH {RRF} SELECT qid, id, score, rank FROM y QUALIFY rank <= round_even(0.35 * count(*) OVER (PARTITION BY qid), 0)")
def feature_select_bround(spark, sf):
    return fusion.best_share(_rrf(spark, sf), 0.35)


SPLIT = f"""s AS (SELECT doc_id AS id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS text, x[1] AS lead FROM (SELECT doc_id, {SENTENCES % 'text'} AS x FROM documents)),
v AS (SELECT id, pos, text, round(len(list_intersect({TOKENS % 'text'}, {TOKENS % 'lead'})) / greatest(len(list_distinct(list_concat({TOKENS % 'text'}, {TOKENS % 'lead'}))), 1), 6) AS sim FROM s)"""


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of each document with their word overlap with the first one."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.sentences(F.col("text")).alias("x"))
    led = docs.select("id", "x", T.recall_tokens(F.try_element_at("x", F.lit(1))).alias("lead"))
    rows = led.select("id", "lead", F.posexplode("x").alias("pos", "text")).withColumn("own", T.recall_tokens(F.col("text")))
    a, b = F.col("own"), F.col("lead")
    return rows.select("id", "pos", "text", F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)), 6).alias("sim"))


@query(f"""WITH {SPLIT}, r AS (SELECT *, count(*) OVER (PARTITION BY id, pos % 3) AS n, row_number() OVER (PARTITION BY id, pos % 3 ORDER BY sim, pos) AS least FROM v)
SELECT id, string_agg(text, '' ORDER BY pos) AS text, count(*) AS n_kept FROM r WHERE least > floor(n * 0.4) GROUP BY id""")
def compress_by_cluster(spark, sf):
    return fusion.compress_clusters(_sentences(spark, sf).withColumn("cluster", F.col("pos") % 3), 0.4)


@query(f"""WITH {SPLIT}, r AS (SELECT *, sum(length(text)) OVER (PARTITION BY id) AS total,
  coalesce(sum(length(text)) OVER (PARTITION BY id ORDER BY sim DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM v)
SELECT id, string_agg(text, '' ORDER BY pos) AS text, count(*) AS n_kept FROM r WHERE spent <= total * 0.5 GROUP BY id""")
def compress_by_budget(spark, sf):
    return fusion.compress_budget(_sentences(spark, sf).withColumnRenamed("sim", "score"), 0.5)


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS l, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
g AS (SELECT conv_id, turn, rn, l, 0 AS group_no, l AS held FROM t WHERE rn = 1
  UNION ALL SELECT t.conv_id, t.turn, t.rn, t.l, CASE WHEN g.held + t.l > 500 THEN g.group_no + 1 ELSE g.group_no END, CASE WHEN g.held + t.l > 500 THEN t.l ELSE g.held + t.l END
  FROM g JOIN t ON t.conv_id = g.conv_id AND t.rn = g.rn + 1)
SELECT conv_id, turn, l AS length, group_no FROM g""")
def greedy_pack(spark, sf):
    return fusion.greedy_pack(read(spark, sf, "conversations"), "conv_id", "turn", "text", 500)


# --- metrics -------------------------------------------------------------------------------------


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90,
round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most, min(value) AS least FROM events GROUP BY event_type""")
def percentile_report(spark, sf):
    return metrics.distribution(read(spark, sf, "events"), "value", ["event_type"])


# --- caches --------------------------------------------------------------------------------------


def _cache(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Even conversations' questions with the replies after them are the cache; all user turns are asked."""
    turns = read(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    stamp = F.col("conv_id") * 100_000 + F.col("turn")
    users = turns.withColumns({"a": F.lead("text").over(w), "stamp": stamp}).where("role = 'user'")
    asked = users.select(F.col("stamp").alias("qid"), F.col("text").alias("question"))
    return asked, users.where("conv_id % 2 = 0 and a is not null").select(F.col("text").alias("key"), F.col("a").alias("answer"), F.col("stamp").alias("inserted_at"))


CACHE = """u AS (SELECT conv_id, conv_id * 100000 + turn AS qid, text AS question, role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations),
asked AS (SELECT qid, question, conv_id, a FROM u WHERE role = 'user'),
c AS (SELECT question AS key, max_by(a, qid) AS answer FROM asked WHERE conv_id % 2 = 0 AND a IS NOT NULL GROUP BY question)"""


@query(f"WITH {CACHE} SELECT qid, question, c.answer FROM asked LEFT JOIN c ON question = c.key")
def cache_exact(spark, sf):
    asked, entries = _cache(spark, sf)
    return cache.exact_lookup(asked, entries)


@query(f"""WITH {CACHE}, b AS (SELECT question AS key, max_by(a, qid) AS answer FROM asked WHERE conv_id % 3 = 0 AND a IS NOT NULL GROUP BY question)
SELECT qid, question, coalesce(c.answer, b.answer) AS answer, CASE WHEN c.answer IS NOT NULL THEN 1 WHEN b.answer IS NOT NULL THEN 2 ELSE 0 END AS level
FROM asked LEFT JOIN c ON question = c.key LEFT JOIN b ON question = b.key""")
def cache_cascade(spark, sf):
    asked, first = _cache(spark, sf)
    turns = read(spark, sf, "conversations")
    users = turns.withColumns({"a": F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), "stamp": F.col("conv_id") * 100_000 + F.col("turn")}).where("role = 'user'")
    second = users.where("conv_id % 3 = 0 and a is not null").select(F.col("text").alias("key"), F.col("a").alias("answer"), F.col("stamp").alias("inserted_at"))
    return cache.cascade(asked, [first, second])


@query(f"""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT qid, vec_id AS id, label, round({COS}, 6) AS raw FROM q, (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 <> 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, id) AS rank FROM s)
SELECT q.qid, r.id, CASE WHEN r.raw IS NOT NULL THEN round(least(r.raw, 1.0), 6) END AS score, r.label AS answer FROM q LEFT JOIN r ON q.qid = r.qid AND rank = 1 AND least(raw, 1.0) >= 0.35""")
def cache_semantic(spark, sf):
    q, v = _vectors(spark, sf)
    return cache.semantic_lookup(q, v.where("id % 20 <> 0").withColumnRenamed("label", "answer"), 0.35)


@query("""SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 5""")
def cache_evict_lru(spark, sf):
    entries = read(spark, sf, "events").select("user_id", "event_id", "ts", F.col("ts").alias("last_access"))
    return cache.evict(entries, 5, "lru", "event_id", by="user_id").select("user_id", "event_id", "ts")


# --- graphs --------------------------------------------------------------------------------------


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers in nations, nations in regions, customers who placed orders."""
    tag = lambda letter, c: F.concat(F.lit(f"{letter}:"), F.col(c).cast("string"))
    row = lambda df, a, b, relation, n: df.select(a.alias("src"), b.alias("dst"), F.lit(relation).alias("relation"), F.lit(n).alias("ord"), F.lit(relation).alias("file_id"))
    parts = [
        row(read(spark, sf, "customer"), tag("c", "c_custkey"), tag("n", "c_nationkey"), "lives_in", 0),
        row(read(spark, sf, "supplier"), tag("s", "s_suppkey"), tag("n", "s_nationkey"), "trades_in", 1),
        row(read(spark, sf, "nation"), tag("n", "n_nationkey"), tag("r", "n_regionkey"), "part_of", 2),
        row(read(spark, sf, "orders"), tag("c", "o_custkey"), F.concat(F.lit("p:"), F.col("o_orderpriority")), "orders_as", 3),
    ]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every


EDGES = """raw AS (SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst, 'lives_in' AS relation FROM customer
UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'trades_in' FROM supplier
UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'part_of' FROM nation
UNION ALL SELECT 'c:' || o_custkey, 'p:' || o_orderpriority, 'orders_as' FROM orders),
e AS (SELECT src, dst, min(relation) AS relation FROM raw GROUP BY src, dst),
nodes AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"""


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    edges = graph.merge_edges(_edges(spark, sf))
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), edges


@query(f"WITH {EDGES} SELECT * FROM e")
def graph_build_edges(spark, sf):
    return _graph(spark, sf)[1].select("src", "dst", "relation")


@query(f"WITH {EDGES} SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS in_degree, (SELECT count(*) FROM e WHERE src = id) AS out_degree FROM nodes")
def graph_degree(spark, sf):
    return graph.degrees(*_graph(spark, sf))


@query(f"WITH {EDGES} SELECT n AS n_nodes, m AS n_edges, round(m / (n * (n - 1)), 6) AS density FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM e) AS m)")
def graph_density(spark, sf):
    return graph.density(*_graph(spark, sf))


@query(f"""WITH RECURSIVE x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.id AS qid, b.id AS id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS raw FROM x a, x b),
k AS (SELECT qid, id, raw, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, id) AS rank FROM s),
l AS (SELECT qid AS a, id AS b FROM k WHERE rank <= 5 AND round(least(raw, 1.0), 6) > 0.38 AND qid <> id),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, a AS reach FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a)
SELECT node AS id, min(reach) AS component FROM r GROUP BY node""")
def graph_components(spark, sf):
    _, v = _vectors(spark, sf)
    return graph.cluster_concepts(v.select("id", "v"), 5, 0.38)


@query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e),
h AS (SELECT id AS seed, id, 0 AS hops FROM nodes WHERE id LIKE 'r:%' UNION SELECT h.seed, b.y, h.hops + 1 FROM h JOIN b ON h.id = b.x WHERE h.hops < 2)
SELECT seed, id, min(hops) AS hops FROM h GROUP BY seed, id""")
def graph_nhop(spark, sf):
    nodes, edges = _graph(spark, sf)
    seeds = nodes.where("id like 'r:%'").select(F.col("id").alias("seed"), "id")
    return graph.n_hop(edges, seeds, 2, by="seed").select("seed", "id", "hops")


@query(f"WITH {EDGES} SELECT src, dst, relation FROM e WHERE src NOT LIKE 'c:%' AND dst NOT LIKE 'c:%'")
def graph_induced(spark, sf):
    nodes, edges = _graph(spark, sf)
    return graph.induced_edges(edges, nodes.where("id not like 'c:%'")).select("src", "dst", "relation")


@query("""WITH c AS (SELECT p_partkey, unnest(list_distinct(string_split(p_type, ' '))) AS concept FROM part),
f AS (SELECT concept, count(*) AS n FROM c GROUP BY concept),
lead AS (SELECT left(concept, 1) AS component, first(concept ORDER BY n DESC, concept) AS lead FROM f GROUP BY left(concept, 1))
SELECT p_partkey, array_to_string(list_sort(list(DISTINCT lead)), ',') AS synset FROM c JOIN lead ON left(c.concept, 1) = lead.component GROUP BY p_partkey""")
def synset_propagation(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", graph.concepts(F.translate("p_type", " ", ",")).alias("concepts"))
    frequency = rows.select(F.explode("concepts").alias("concept")).groupBy("concept").agg(F.count("*").alias("n"))
    sets = graph.synsets(frequency.select("concept", F.left("concept", F.lit(1)).alias("component")), frequency)
    return graph.propagate_synsets(rows, sets, "p_partkey").select("p_partkey", F.array_join("synset", ",").alias("synset"))


# --- stores --------------------------------------------------------------------------------------


@query("""SELECT c_custkey AS user_id, count(*) AS n_documents, min(d.doc_id) AS first_document FROM customer JOIN documents d ON d.doc_id % 25 = c_nationkey
WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey""")
def kb_rbac_docs(spark, sf):
    role = F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("member")
    members = read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("knowledge_id"), role.alias("role"))
    registry = read(spark, sf, "documents").select((F.col("doc_id") % 25).alias("knowledge_id"), F.col("doc_id").alias("document_name"))
    seen = store.visible_documents(members, registry, admin_only=True)
    return seen.groupBy("user_id").agg(F.count("*").alias("n_documents"), F.min("document_name").alias("first_document"))


@query("""SELECT coalesce(d.doc_id, v.vec_id) AS id, CASE WHEN d.doc_id IS NULL THEN 'chunks' ELSE 'vectors' END AS missing_in
FROM documents d FULL JOIN embeddings v ON d.doc_id = v.vec_id WHERE d.doc_id IS NULL OR v.vec_id IS NULL""")
def store_accordance(spark, sf):
    chunks = read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"))
    return store.accordance(chunks, read(spark, sf, "embeddings").select(F.col("vec_id").alias("id")))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 20 = 0 THEN label + 100 ELSE label END AS label, len(embedding) AS dims FROM embeddings")
def vector_upsert(spark, sf):
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    new = rows.where("id % 20 = 0").select("id", F.lit(None).cast("array<float>").alias("embedding"), (F.col("label") + 100).alias("label"))
    return store.upsert_vectors(rows, new).select("id", "label", F.size("embedding").cast("long").alias("dims"))


@query("SELECT d.doc_id AS chunk_id, CASE WHEN l.quality = 0 THEN upper(d.lang) ELSE d.text END AS chunk_content FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def chunk_update(spark, sf):
    docs = read(spark, sf, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_content"))
    poor = read(spark, sf, "labels").where("quality = 0").select("doc_id")
    return store.update_texts(chunks, docs.join(poor, "doc_id").select(F.col("doc_id").alias("chunk_id"), F.upper("lang").alias("chunk_content")))


# --- training data, agents, sources --------------------------------------------------------------


@query("""SELECT conv_id, turn, (row_number() OVER w) - 1 AS n_before, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chars_before,
length(text) AS n_target FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY role = 'assistant'""")
def aligned_history(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = read(spark, sf, "conversations").withColumns({"n_before": (F.row_number().over(w) - 1).cast("long"), "chars_before": F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))})
    return rows.where("role = 'assistant'").select("conv_id", "turn", "n_before", "chars_before", F.length("text").cast("long").alias("n_target"))


PATHS = """t AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations),
st AS (SELECT conv_id AS qid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text AS q, a FROM t WHERE role = 'user' AND a IS NOT NULL),
pt AS (SELECT qid, first(q ORDER BY pos) AS question, last(a ORDER BY pos) AS answer, count(*) AS n FROM st GROUP BY qid)"""


@query(f"""WITH {PATHS}, m AS (SELECT qid, 0 AS no, 'user' AS role, question AS content FROM pt UNION ALL SELECT qid, 3 * pos + 1, 'assistant', 'SubQuery: ' || q FROM st UNION ALL SELECT qid, 3 * pos + 2, 'observation', 'Retrieved Context: ' FROM st
UNION ALL SELECT qid, 3 * pos + 3, 'assistant', 'SubAnswer: ' || a FROM st UNION ALL SELECT qid, 3 * n + 1, 'assistant', 'Final Answer: ' || answer FROM pt) SELECT qid, no, role, content FROM m""")
def training_chat_rows(spark, sf):
    return training.chat_rows(_paths(spark, sf)).select("qid", F.posexplode("messages").alias("no", "m")).select("qid", "no", "m.role", "m.content")


@query(f"""WITH {PATHS}, h AS (SELECT *, string_agg(q || chr(10) || a, chr(10)) OVER (PARTITION BY qid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history FROM st)
SELECT h.qid, 2 * pos AS no, 'subquery' AS type, question || chr(10) || coalesce(history, '') AS prompt, q AS target FROM h JOIN pt ON h.qid = pt.qid
UNION ALL SELECT qid, 2 * pos + 1, 'subanswer', chr(10) || q, a FROM st
UNION ALL SELECT pt.qid, 2 * n, 'final', question || chr(10) || (SELECT string_agg(q || chr(10) || a, chr(10) ORDER BY pos) FROM st WHERE st.qid = pt.qid), answer FROM pt""")
def aligned_samples(spark, sf):
    return training.aligned_samples(_paths(spark, sf))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths made of conversations: user turns are sub-queries, the replies sub-answers."""
    turns = read(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("a", F.lead("text").over(w)).where("role = 'user' and a is not null")
    step = F.struct("turn", F.col("text").alias("subquery"), F.lit("").alias("context"), F.col("a").alias("subanswer"))
    paths = pairs.groupBy(F.col("conv_id").alias("qid")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return paths.select("qid", F.element_at("steps", 1)["subquery"].alias("question"), F.element_at("steps", -1)["subanswer"].alias("answer"), "steps")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """A question about each part, of four forms."""
    forms = F.array(
        F.concat(F.lit("Who directed the film "), "p_name", F.lit("?")), F.concat(F.lit("Who performed the song "), "p_name", F.lit("?")),
        F.concat(F.lit("Who is the father of the director of film "), "p_name", F.lit("?")), F.concat(F.lit("Are "), "p_name", F.lit(" and "), "p_brand", F.lit(" of the same nationality?")),
    )
    return read(spark, sf, "part").select(F.col("p_partkey").alias("qid"), F.element_at(forms, (F.col("p_partkey") % 4 + 1).cast("int")).alias("question"))


ASKED = "q AS (SELECT p_partkey AS qid, p_name AS n, p_brand AS b, p_partkey % 4 AS form FROM part)"


@query(f"""WITH {ASKED}, v AS (SELECT qid, CASE form WHEN 0 THEN [n || ' director', 'director ' || n, 'directed by ' || n, 'Who directed the film ' || n || '?']
WHEN 1 THEN [n || ' performer', 'performer ' || n, n || ' originally performed by', 'Who performed the song ' || n || '?']
WHEN 2 THEN ['the director of film ' || n || ' father', 'father of the director of film ' || n, 'Who is the father of the director of film ' || n || '?']
ELSE ['Are ' || n || ' and ' || b || ' of the same nationality?'] END AS x FROM q)
SELECT qid, CAST(generate_subscripts(x, 1) - 1 AS INT) AS place, unnest(x) AS variant FROM v""")
def query_variant_expansion(spark, sf):
    return _questions(spark, sf).select("qid", F.posexplode(agent.query_variants(F.col("question"))).alias("place", "variant"))


@query(f"""WITH {ASKED}, a AS (SELECT q.*, s_name FROM q JOIN supplier ON s_suppkey = qid % (SELECT count(*) FROM supplier))
SELECT qid, CASE form WHEN 2 THEN 'role_relation' WHEN 3 THEN 'comparison' ELSE 'other' END AS kind,
CASE form WHEN 2 THEN ['Who directed the film ' || n || '?', 'Who is ' || s_name || chr(39) || 's father?'] WHEN 3 THEN ['What nationality is ' || n || '?', 'What nationality is ' || b || '?'] ELSE [] END AS subqueries,
CASE WHEN form >= 2 THEN [s_name, s_name] ELSE [] END AS answers, CASE WHEN form >= 2 THEN s_name END AS answer FROM a""")
def planner_multihop(spark, sf):
    """Paths over the questions about parts; a supplier's name stands for each answer."""
    names = read(spark, sf, "supplier").select("s_suppkey", "s_name")
    n = names.count()

    def answer(asked: DataFrame) -> DataFrame:
        return asked.withColumn("s_suppkey", F.col("qid") % n).join(names, "s_suppkey").select("qid", F.col("s_name").alias("subanswer"))

    done = agent.run_paths(_questions(spark, sf), answer)
    final = agent.guarded_answer(F.col("frame"), F.col("answers"), F.try_element_at("answers", F.lit(-1)))
    return done.select("qid", "frame.kind", "subqueries", "answers", final.alias("answer"))


@query()
def recursive_split(spark, sf):
    return splitters.split(read(spark, sf, "documents"), "doc_id", "text", size=2048, overlap=100)


@query()
def markdown_split(spark, sf):
    return splitters.split(read(spark, sf, "documents"), "doc_id", "text", how="markdown", size=1000)


@query("""SELECT n_regionkey AS id, 1 AS table_no, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row_no, 'Key:' || n_nationkey || ',Name of it:' || n_name || ';' AS text FROM nation""")
def html_table_kv(spark, sf):
    """Tables made of each region's nations, after a table that has a head only."""
    row = F.concat(F.lit("<TR class=x><td>"), F.col("n_nationkey").cast("string"), F.lit("</td>\n<td> <b>"), F.col("n_name"), F.lit("</b></td></TR>"))
    rows = read(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    page = F.concat(F.lit("<p>no</p><table><tr><th>alone</th></tr></table><table border=1><tr><th>Key</th><th>Name\n of it</th></tr>"), "rows", F.lit("</table>"))
    return loaders.html_table_rows(rows.select("n_regionkey", page.alias("html")), "n_regionkey", "html")


@query("""WITH o AS (SELECT string_agg(coalesce(text, ''), ' ' ORDER BY doc_id, text) AS whole FROM documents),
n AS (SELECT whole, greatest(1, CAST(ceil((length(whole) - 100) / 1948.0) AS BIGINT)) AS chunks FROM o),
k AS (SELECT unnest(range(chunks)) AS chunk, whole FROM n)
SELECT chunk, substring(whole, chunk * 1948 + 1, 2048) AS contents, '' AS title FROM k WHERE length(whole) > 0""")
def corpus_chunks(spark, sf):
    """All documents as one text in chunks of 2048 characters that share 100 with the one before."""
    return corpus.corpus_chunks(read(spark, sf, "documents"), "doc_id")
