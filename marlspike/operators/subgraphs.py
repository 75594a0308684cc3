"""Parts of property graphs, what is asked of a model about them, and their files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from marlspike.functions.json_text import ENTITY_KEYS, EVENT_KEYS, parsed_records, rebuilt_members
from marlspike.functions.vectors import unit
from marlspike.operators.graph import bfs_tree, induced_edges, most_common
from marlspike.operators.search import dense_topk

Model = Callable[[Column], Column]
#: Fixed words with which a judge says that nothing is missing or wrong.
ALL_WELL = ("All recognized", "all correct")


def nodes_with(nodes: DataFrame, column: str, value: str, contains: bool = False) -> DataFrame:
    """The ids of nodes whose attribute is a value, or holds it as a part."""
    held = F.col(column).contains(value) if contains else F.col(column) == value
    return nodes.where(held).select("id")


def edge_values(edges: DataFrame, column: str = "relation", order: list[str] | None = None) -> DataFrame:
    """The distinct values of an edge attribute, numbered by where they first come: place, value. Null values don't count."""
    first = edges.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(F.struct(*(order or ["src", "dst"]))).alias("first"))
    return first.select(F.row_number().over(Window.orderBy("first")).alias("place"), "value")


def seed_subgraph(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Edges among the seeds (id), and those along breadth-first trees from each seed, in the direction they have."""
    tree = bfs_tree(edges, seeds, depth).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    # a tree edge that both directions could make is the one out of the node that was there first
    found = edges.join(tree, (F.col("src") == F.col("a")) & (F.col("dst") == F.col("b"))).select(*edges.columns, "a", "b")
    back = edges.join(tree, (F.col("src") == F.col("b")) & (F.col("dst") == F.col("a"))).select(*edges.columns, "a", "b")
    back = back.join(found.select("a", "b"), ["a", "b"], "left_anti").select(*edges.columns)
    return induced_edges(edges, seeds).unionByName(found.select(*edges.columns)).unionByName(back).dropDuplicates(["src", "dst"])


def concept_requests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What a model is asked to put in more general words: node, node_type, context.

    Events and entities come from the nodes' types, relations from the edges. An entity's context is one
    edge into it and one out of it, each the one with the smallest hash, so that runs agree.
    """
    pick = lambda end, other: edges.select(F.col(end).alias("id"), other.alias("text"), F.xxhash64("src", "dst").alias("h")).groupBy("id").agg(F.min_by("text", F.struct("h", "text")).alias("text"))
    into, out = pick("dst", F.concat_ws(" ", "src", "relation")), pick("src", F.concat_ws(" ", "relation", "dst"))
    typed = nodes.where(F.col("type").isin("event", "entity")).select("id", "type")
    joined = typed.join(into.withColumnRenamed("text", "into"), "id", "left").join(out.withColumnRenamed("text", "out"), "id", "left")
    context = F.when(F.col("type") == "entity", F.concat_ws(", ", "into", "out")).otherwise("")
    asked = joined.select(F.col("id").alias("node"), F.col("type").alias("node_type"), context.alias("context"))
    relations = edges.where("relation is not null").select(F.col("relation").alias("node")).distinct()
    return asked.unionByName(relations.select("node", F.lit("relation").alias("node_type"), F.lit("").alias("context")))


def conceptualise(requests: DataFrame, prompts: dict[str, str], complete: Model) -> DataFrame:
    """(node, conceptualized_node, node_type): the model's answer to each type's prompt, with [NODE] and [CONTEXT] filled in.

    Of an entity only what stands before ::: goes into the prompt.
    """
    form = F.create_map(*[F.lit(x) for pair in prompts.items() for x in pair])[F.col("node_type")]
    name = F.when(F.col("node_type") == "entity", F.substring_index("node", ":::", 1)).otherwise(F.col("node"))
    prompt = F.replace(F.replace(form, F.lit("[NODE]"), name), F.lit("[CONTEXT]"), F.col("context"))
    return requests.select("node", complete(prompt).alias("conceptualized_node"), "node_type")


def extracted_relations(texts: DataFrame, prompts: tuple[str, str, str], complete: Model) -> DataFrame:
    """Records for ``relation_rows`` from texts (raw_text, file_id): a model is asked for entity, event and member relations, one prompt each."""
    asked = [complete(F.concat(F.lit(p), F.col("raw_text"))) for p in prompts]
    rows = texts.withColumns({"__a": asked[0], "__b": asked[1], "__c": asked[2]})
    triple = lambda m, keys: F.struct(m[keys[0]].alias("Head"), m[keys[1]].alias("Relation"), m[keys[2]].alias("Tail"))
    members = F.transform(rebuilt_members(F.col("__c")), lambda m: F.struct(m["event"].alias("Event"), m["entities"].alias("Entity")))
    return rows.select(
        "raw_text", "file_id", F.transform(parsed_records(F.col("__a"), ENTITY_KEYS), lambda m: triple(m, ENTITY_KEYS)).alias("entity_relations"),
        F.transform(parsed_records(F.col("__b"), EVENT_KEYS), lambda m: triple(m, EVENT_KEYS)).alias("event_relations"), members.alias("event_entity_relations"),
    )


def judged_lines(answer: Column) -> Column:
    """How many items a judge lists, one a line; 0 where it says that all is well."""
    lines = F.filter(F.split(answer, "\n"), lambda x: F.trim(x) != "")
    well = F.lit(False)
    for words in ALL_WELL:
        well = well | F.lower(answer).contains(words.lower())
    return F.when(F.coalesce(well, F.lit(False)), 0).otherwise(F.coalesce(F.size(lines), F.lit(0)))


def node_vectors(nodes: DataFrame, embed: Model) -> DataFrame:
    """(id, name, v): nodes with numbers by name and unit vectors."""
    w = F.xxhash64("id")
    return nodes.select(w.alias("id"), F.col("id").alias("name"), unit(embed(F.col("id"))).alias("v"))


def stale(nodes: DataFrame, vectors: DataFrame) -> bool:
    """Whether vectors must be built anew: there are more or fewer than nodes."""
    return nodes.count() != vectors.count()


def node_search(queries: DataFrame, vectors: DataFrame, k: int = 5, concepts: DataFrame | None = None) -> DataFrame:
    """Nodes for each query (qid, v): qid, rank, name. With concept vectors those found by both come first, then by place, node hits before concept hits."""
    hits = [dense_topk(queries, v.select("id", "v"), k).join(v.select("id", "name"), "id").select("qid", "name", (F.col("rank") + i * k).alias("place")) for i, v in enumerate([vectors, *([concepts] if concepts is not None else [])])]
    every = hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
    counted = every.groupBy("qid", "name").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    w = Window.partitionBy("qid").orderBy(F.desc("n"), "first")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "name")


def common_contexts(found: DataFrame, k: int) -> DataFrame:
    """The k contexts found most often, ties by where they first come (context, place)."""
    return most_common(found, "context", "place", k)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, encrypt: Model | None = None) -> None:
    """Nodes and links as JSON lines beside one another, texts put through ``encrypt`` if there is one."""
    for rows, name in ((nodes, "nodes"), (edges, "links")):
        hidden = rows if encrypt is None else rows.withColumns({f.name: encrypt(F.col(f.name)) for f in rows.schema.fields if f.dataType.simpleString() == "string"})
        hidden.write.mode("overwrite").json(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str, nodes_schema: str, edges_schema: str, decrypt: Model | None = None) -> tuple[DataFrame, DataFrame]:
    out = []
    for name, schema in (("nodes", nodes_schema), ("links", edges_schema)):
        rows = spark.read.schema(schema).json(f"{path}/{name}")
        out.append(rows if decrypt is None else rows.withColumns({f.name: decrypt(F.col(f.name)) for f in rows.schema.fields if f.dataType.simpleString() == "string"}))
    return out[0], out[1]
