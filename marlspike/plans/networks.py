"""Queries of graphs: building, parts, neighbours, strong components, ranks, concepts; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marlspike.operators import graph, strong, subgraphs
from marlspike.plans.catalogue import EDGES, _edges, _graph, _vectors, query, read

# --- building -------------------------------------------------------------------------------------


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """A record for each nation: its customers as entities, itself and its region as events; some ends are blank."""
    people = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list("c_name")).alias("names"))
    rows = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(people, "n_nationkey", "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    entity = F.transform(names, lambda x: F.struct(x.alias("Head"), F.lit("lives in").alias("Relation"), F.concat(F.lit(" "), F.col("n_name")).alias("Tail")))
    event = F.array(F.struct(F.col("n_name").alias("Head"), F.lit("is in").alias("Relation"), F.col("r_name").alias("Tail")), F.struct(F.lit(" ").alias("Head"), F.lit("is in").alias("Relation"), F.col("r_name").alias("Tail")))
    member = F.array(F.struct(F.col("r_name").alias("Event"), F.concat(F.slice(names, 1, 2), F.array(F.lit(""))).alias("Entity")))
    return rows.select(F.concat(F.lit("About "), "n_name").alias("raw_text"), F.col("n_nationkey").cast("string").alias("file_id"), entity.alias("entity_relations"), event.alias("event_relations"), member.alias("event_entity_relations"))


ROWS = """ppl AS (SELECT c_nationkey, list(c_name ORDER BY c_name) AS names FROM customer GROUP BY c_nationkey),
n AS (SELECT n_nationkey, n_name, r_name, coalesce(names, []) AS names, 'About ' || n_name AS raw_text FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN ppl ON c_nationkey = n_nationkey),
rel AS (SELECT n_nationkey, unnest(names) AS src, 'lives in' AS relation, n_name AS dst, 'entity' AS kind, raw_text FROM n
UNION ALL SELECT n_nationkey, n_name, 'is in', r_name, 'event', raw_text FROM n UNION ALL SELECT n_nationkey, unnest(names[1:2]), 'participate', r_name, 'event_entity', raw_text FROM n)"""


@query(f"WITH {ROWS} SELECT src, relation, dst, kind, raw_text, n_nationkey::VARCHAR AS file_id FROM rel")
def graph_relation_rows(spark, sf):
    return graph.relation_rows(_records(spark, sf)).drop("ord")


EXPANDED = f"""{ROWS}, x AS (SELECT src, dst, relation, n_nationkey FROM rel UNION ALL SELECT src, raw_text, 'text_conclude', n_nationkey FROM rel UNION ALL SELECT dst, raw_text, 'text_conclude', n_nationkey FROM rel)"""


@query(f"WITH {EXPANDED} SELECT src, dst, relation, n_nationkey::VARCHAR AS file_id, count(*) AS n FROM x WHERE src <> dst GROUP BY ALL")
def graph_expanded_edges(spark, sf):
    return graph.expand_edges(graph.relation_rows(_records(spark, sf))).groupBy("src", "dst", "relation", "file_id").agg(F.count("*").alias("n"))


@query(f"WITH {EXPANDED} SELECT DISTINCT dst AS context FROM x WHERE relation = 'text_conclude' UNION ALL SELECT DISTINCT src || ' ' || relation || ' ' || dst FROM x WHERE relation <> 'text_conclude' AND src <> dst")
def graph_contexts(spark, sf):
    edges = graph.expand_edges(graph.relation_rows(_records(spark, sf)))
    return graph.contexts(edges, True).unionByName(graph.contexts(edges, False))


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions of nations and parts: the type last seen wins, files gather."""
    a = read(spark, sf, "customer").select(F.concat(F.lit("n:"), F.col("c_nationkey").cast("string")).alias("id"), F.lit("entity").alias("type"), F.col("c_mktsegment").alias("file_id"), F.col("c_custkey").alias("ord"))
    b = read(spark, sf, "supplier").select(F.concat(F.lit("n:"), F.col("s_nationkey").cast("string")).alias("id"), F.lit("event").alias("type"), F.lit("supplier").alias("file_id"), (F.col("s_suppkey") + 0).alias("ord"))
    return a.unionByName(b)


MENTIONS = """m AS (SELECT 'n:' || c_nationkey AS id, 'entity' AS type, c_mktsegment AS file_id, c_custkey AS ord, 1 AS tie FROM customer UNION ALL SELECT 'n:' || s_nationkey, 'event', 'supplier', s_suppkey, 2 FROM supplier),
nd AS (SELECT id, arg_max(type, ord * 2 + CASE WHEN type = 'event' THEN 1 ELSE 0 END) AS type, list_sort(list(DISTINCT file_id)) AS file_ids FROM m GROUP BY id)"""


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _typed(spark, sf)
    return graph.merge_nodes(rows.withColumn("ord", F.col("ord") * 2 + F.when(F.col("type") == "event", 1).otherwise(0)))


@query(f"WITH {MENTIONS} SELECT id, type, array_to_string(file_ids, ',') AS file_ids FROM nd")
def graph_merge_nodes(spark, sf):
    return _nodes(spark, sf).select("id", "type", F.array_join("file_ids", ",").alias("file_ids"))


@query(f"""WITH {MENTIONS} SELECT id, CASE WHEN id IN ('n:1', 'n:2', 'n:3') THEN array_to_string(list_sort(list_distinct(list_concat(file_ids, ['added', 'supplier']))), ',') ELSE array_to_string(file_ids, ',') END AS appended,
CASE WHEN id IN ('n:1', 'n:2', 'n:3') THEN 'added,supplier' ELSE array_to_string(file_ids, ',') END AS replaced FROM nd""")
def graph_update_attribute(spark, sf):
    nodes = _nodes(spark, sf)
    new = nodes.where(F.col("id").isin("n:1", "n:2", "n:3")).select("id", F.array(F.lit("supplier"), F.lit("added"), F.lit("added")).alias("file_ids"))
    show = lambda append, name: graph.update_attribute(nodes, new, ["id"], "file_ids", append).select("id", F.array_join("file_ids", ",").alias(name))
    return show(True, "appended").join(show(False, "replaced"), "id")


@query(f"WITH {MENTIONS} SELECT id, 'is' AS how FROM nd WHERE type = 'event' UNION ALL SELECT id, 'holds' FROM nd WHERE contains(id, ':1')")
def graph_nodes_by_attribute(spark, sf):
    nodes = _nodes(spark, sf)
    return subgraphs.nodes_with(nodes, "type", "event").withColumn("how", F.lit("is")).unionByName(subgraphs.nodes_with(nodes, "id", ":1", contains=True).withColumn("how", F.lit("holds")))


@query(f"WITH {EDGES}, f AS (SELECT relation AS value, min({{'src': src, 'dst': dst}}) AS first FROM e GROUP BY relation) SELECT row_number() OVER (ORDER BY first) AS place, value FROM f")
def graph_edge_values(spark, sf):
    return subgraphs.edge_values(_graph(spark, sf)[1])


# --- neighbours and parts -------------------------------------------------------------------------


@query(f"""WITH {EDGES}, b AS (SELECT 'out' AS way, src AS id, dst AS other FROM e UNION SELECT 'in', dst, src FROM e UNION SELECT 'both', src, dst FROM e UNION SELECT 'both', dst, src FROM e)
SELECT way, id, count(*) AS n, min(other) AS least FROM b GROUP BY way, id""")
def graph_neighbours(spark, sf):
    _, edges = _graph(spark, sf)
    counted = [graph.neighbours(edges, way).groupBy("id").agg(F.count("*").alias("n"), F.min("other").alias("least")).withColumn("way", F.lit(way)) for way in ("out", "in", "both")]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


TREE = f"""{EDGES}, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), seeds AS (SELECT id FROM nodes WHERE id LIKE 'r:%'),
h1 AS (SELECT s.id AS seed, y AS id, min(x) AS parent FROM seeds s JOIN b ON x = s.id WHERE y <> s.id GROUP BY s.id, y),
h2 AS (SELECT h1.seed, y AS id, min(x) AS parent FROM h1 JOIN b ON x = h1.id WHERE y <> h1.seed AND NOT EXISTS (SELECT 1 FROM h1 o WHERE o.seed = h1.seed AND o.id = y) GROUP BY h1.seed, y)"""


@query(f"WITH {TREE} SELECT seed, parent AS src, id AS dst, 1 AS hop FROM h1 UNION ALL SELECT seed, parent, id, 2 FROM h2")
def graph_bfs_tree(spark, sf):
    nodes, edges = _graph(spark, sf)
    return graph.bfs_tree(edges, nodes.where("id like 'r:%'"), 2)


@query(f"""WITH {TREE}, t AS (SELECT parent AS a, id AS b FROM h1 UNION SELECT parent, id FROM h2)
SELECT DISTINCT e.src, e.dst, e.relation FROM e JOIN t ON (src = a AND dst = b) OR (src = b AND dst = a) UNION SELECT src, dst, relation FROM e WHERE src LIKE 'r:%' AND dst LIKE 'r:%'""")
def graph_seed_subgraph(spark, sf):
    nodes, edges = _graph(spark, sf)
    return subgraphs.seed_subgraph(edges, nodes.where("id like 'r:%'"), 2).select("src", "dst", "relation")


@query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e),
r AS (SELECT id AS node, id AS reach FROM nodes WHERE id LIKE 'r:%' UNION SELECT r.node, b.y FROM r JOIN b ON r.reach = b.x)
SELECT reach AS id, min(first) AS component FROM (SELECT reach, node, (SELECT min(q.reach) FROM r q WHERE q.node = r.node) AS first FROM r) GROUP BY reach""")
def graph_weak_components(spark, sf):
    """Every node of this graph is tied to a region by its nation, so regions find all components."""
    return graph.components(*_graph(spark, sf))


def _arrows(spark: SparkSession, sf: str) -> DataFrame:
    """A directed graph on customers' keys with long chains and cycles of many sizes."""
    keys = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    step = keys.select(F.col("k").alias("src"), (F.col("k") + F.when(F.col("k") % 7 == 0, -5).otherwise(1)).alias("dst")).where("src % 40 <> 39")
    return step.unionByName(keys.where("k % 40 = 39").select(F.col("k").alias("src"), (F.col("k") - F.col("k") % 9).alias("dst")))


ARROWS = """a AS (SELECT c_custkey AS src, c_custkey + CASE WHEN c_custkey % 7 = 0 THEN -5 ELSE 1 END AS dst FROM customer WHERE c_custkey % 40 <> 39
UNION SELECT c_custkey, c_custkey - c_custkey % 9 FROM customer WHERE c_custkey % 40 = 39),
v AS (SELECT src AS id FROM a UNION SELECT dst FROM a)"""


@query(f"""WITH RECURSIVE {ARROWS}, r AS (SELECT id AS x, id AS y FROM v UNION SELECT r.x, a.dst FROM r JOIN a ON r.y = a.src)
SELECT f.x AS id, min(f.y) AS component FROM r f JOIN r g ON f.x = g.y AND f.y = g.x GROUP BY f.x""")
def graph_strong_components(spark, sf):
    return strong.strong_components(_arrows(spark, sf))


@query(f"""WITH {EDGES}, d AS (SELECT src, count(*) AS d FROM e GROUP BY src), s AS (SELECT id, 1.0 / count(*) OVER () AS r0 FROM nodes WHERE id LIKE 's:%'),
r1 AS (SELECT id, 0.85 * coalesce(g, 0) + 0.15 * coalesce(r0, 0) AS rank FROM (SELECT dst AS id, sum(r0 / d) AS g FROM e JOIN d USING (src) JOIN s ON s.id = src GROUP BY dst) FULL JOIN s USING (id)),
r2 AS (SELECT id, 0.85 * coalesce(g, 0) + 0.15 * coalesce(r0, 0) AS rank FROM (SELECT dst AS id, sum(rank / d) AS g FROM e JOIN d USING (src) JOIN r1 ON r1.id = src GROUP BY dst) FULL JOIN s USING (id)),
r3 AS (SELECT id, 0.85 * coalesce(g, 0) + 0.15 * coalesce(r0, 0) AS rank FROM (SELECT dst AS id, sum(rank / d) AS g FROM e JOIN d USING (src) JOIN r2 ON r2.id = src GROUP BY dst) FULL JOIN s USING (id))
SELECT id, round(rank, 9) AS rank FROM r3""")
def graph_personalised_rank(spark, sf):
    nodes, edges = _graph(spark, sf)
    return graph.personalised_rank(edges, nodes.where("id like 's:%'"), rounds=3).select("id", F.round("rank", 9).alias("rank"))


@query("SELECT o_orderpriority AS context, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, min(o_orderkey) LIMIT 3")
def graph_common_contexts(spark, sf):
    found = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("context"), F.col("o_orderkey").alias("place"))
    return subgraphs.common_contexts(found, 3).select("context", "n")


# --- concepts and node search ---------------------------------------------------------------------


@query(f"""WITH {MENTIONS}, {EDGES}, rl AS (SELECT DISTINCT relation FROM e)
SELECT id AS node, type AS node_type, CASE WHEN type = 'event' THEN 0 ELSE 1 END AS asks FROM nd UNION ALL SELECT relation, 'relation', 0 FROM rl""")
def graph_concept_requests(spark, sf):
    """Which nodes are asked about; contexts are one edge each way, told apart by a hash, so only their being there is compared."""
    asked = subgraphs.concept_requests(_nodes(spark, sf), _graph(spark, sf)[1])
    return asked.select("node", "node_type", (F.col("context") != "").cast("int").alias("asks"))


@query("SELECT p_partkey, string_agg(DISTINCT trim(c), ',' ORDER BY trim(c)) AS concepts FROM (SELECT p_partkey, unnest(string_split(p_type || ' , ' || p_brand || ',,' || p_type, ',')) AS c FROM part) WHERE trim(c) <> '' GROUP BY p_partkey")
def graph_concept_lists(spark, sf):
    text = F.concat("p_type", F.lit(" , "), "p_brand", F.lit(",,"), "p_type")
    return read(spark, sf, "part").select("p_partkey", F.array_join(graph.concepts(text), ",").alias("concepts"))


@query("SELECT concept, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(p_type, ' '))) AS concept FROM part) GROUP BY concept")
def graph_concept_frequency(spark, sf):
    rows = read(spark, sf, "part").select(F.explode(graph.concepts(F.translate("p_type", " ", ","))).alias("concept"))
    return graph.frequencies(rows, "concept")


@query("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0), v AS (SELECT vec_id AS id, vec_id % 50 AS grp, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT qid, id, grp, round(list_dot_product(qv, v), 6) AS raw, id % 2 AS side FROM q, v),
h AS (SELECT qid, 'node ' || grp AS name, side, row_number() OVER (PARTITION BY qid, side ORDER BY raw DESC, id) AS rank FROM s),
c AS (SELECT qid, name, count(*) AS n, min(rank + side * 5) AS first FROM h WHERE rank <= 5 GROUP BY qid, name)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY n DESC, first) AS rank, name FROM c QUALIFY rank <= 5""")
def graph_node_search(spark, sf):
    q, v = _vectors(spark, sf)
    named = v.withColumn("name", F.concat(F.lit("node "), (F.col("id") % 50).cast("string")))
    return subgraphs.node_search(q, named.where("id % 2 = 0"), 5, named.where("id % 2 = 1"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 3 = 1 THEN 2 ELSE 1 END AS missing FROM customer")
def graph_judged_lines(spark, sf):
    name = F.col("c_name")
    told = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("all recognized: "), name)).when(F.col("c_custkey") % 3 == 1, F.concat(name, F.lit(", is, x\n \n"), name)).otherwise(name)
    return read(spark, sf, "customer").select("c_custkey", subgraphs.judged_lines(told).alias("missing"))


@query("""SELECT n_nationkey::VARCHAR AS file_id, n_name AS src, 'in' AS relation, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT n_nationkey::VARCHAR, n_name, 'participate', 'meeting of ' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def graph_extraction(spark, sf):
    """Relations from texts by way of a stand-in model that answers each prompt from the text's own words."""
    rows = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    texts = rows.select(F.concat_ws("|", "n_name", "r_name").alias("raw_text"), F.col("n_nationkey").cast("string").alias("file_id"))

    def complete(prompt):
        kind, name, region = (F.element_at(F.split(prompt, r"\|"), i) for i in (1, 2, 3))
        entity = F.concat(F.lit('Sure: [{"头实体": "'), name, F.lit('", "关系": "in", "尾实体": "'), region, F.lit('"}]'))
        member = F.concat(F.lit('[{"事件": "meeting of '), region, F.lit('", "实体": ["'), name, F.lit('"]}]'))
        return F.when(kind == "entities", entity).when(kind == "members", member).otherwise("none")

    records = subgraphs.extracted_relations(texts, ("entities|", "events|", "members|"), complete)
    return graph.relation_rows(records).select("file_id", "src", "relation", "dst")


def raw_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf)
