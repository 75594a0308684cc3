"""Property graphs as two tables: nodes (id, type, file_ids, ...) and edges (src, dst, relation, file_ids)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from marlspike.operators.components import connected_components
from marlspike.operators.search import dense_topk
from marlspike.scratch import Scratch

CONCLUDES, TAKES_PART = "text_conclude", "participate"


def relation_rows(records: DataFrame) -> DataFrame:
    """(ord, src, relation, dst, kind, raw_text, file_id) of extracted records; blank or missing ends drop out.

    Records hold entity_relations and event_relations as arrays of (Head, Relation, Tail) and
    event_entity_relations as arrays of (Event, Entity array); an entity takes part in an event.
    """
    base = records.withColumn("rec", F.monotonically_increasing_id())
    parts = []
    for i, (column, kind) in enumerate((("entity_relations", "entity"), ("event_relations", "event"))):
        rows = base.select("rec", "raw_text", "file_id", F.posexplode(column).alias("pos", "r"))
        parts.append(rows.select("rec", F.lit(i).alias("part"), "pos", F.trim("r.Head").alias("src"), F.trim("r.Relation").alias("relation"), F.trim("r.Tail").alias("dst"), F.lit(kind).alias("kind"), "raw_text", "file_id"))
    rows = base.select("rec", "raw_text", "file_id", F.posexplode("event_entity_relations").alias("pos", "r"))
    rows = rows.select("rec", "raw_text", "file_id", "pos", "r.Event", F.explode("r.Entity").alias("entity"))
    parts.append(rows.select("rec", F.lit(2).alias("part"), "pos", F.trim("entity").alias("src"), F.lit(TAKES_PART).alias("relation"), F.trim("Event").alias("dst"), F.lit("event_entity").alias("kind"), "raw_text", "file_id"))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    filled = (F.col("src") != "") & (F.col("relation") != "") & (F.col("dst") != "")
    return every.where(filled).select(F.struct("rec", "part", "pos").alias("ord"), "src", "relation", "dst", "kind", "raw_text", "file_id")


def expand_edges(rows: DataFrame) -> DataFrame:
    """Each relation with edges from both its ends to the text that says so; self loops drop out."""
    made = F.array(
        F.struct(F.lit(0).alias("step"), F.col("src").alias("src"), F.col("dst").alias("dst"), F.col("relation").alias("relation")),
        F.struct(F.lit(1).alias("step"), F.col("src").alias("src"), F.col("raw_text").alias("dst"), F.lit(CONCLUDES).alias("relation")),
        F.struct(F.lit(2).alias("step"), F.col("dst").alias("src"), F.col("raw_text").alias("dst"), F.lit(CONCLUDES).alias("relation")),
    )
    out = rows.select("ord", "file_id", F.explode(made).alias("e"))
    return out.select(F.struct("ord", "e.step").alias("ord"), "e.src", "e.dst", "e.relation", "file_id").where("src <> dst")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): the first relation wins, file ids are a sorted set."""
    return edges.groupBy("src", "dst").agg(F.min_by("relation", "ord").alias("relation"), F.array_sort(F.collect_set("file_id")).alias("file_ids"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id: the last type wins, file ids are a sorted set."""
    return nodes.groupBy("id").agg(F.max_by("type", "ord").alias("type"), F.array_sort(F.collect_set("file_id")).alias("file_ids"))


def update_attribute(rows: DataFrame, updates: DataFrame, key: list[str], column: str, append: bool) -> DataFrame:
    """Array attribute set anew, or united with what is there, for the rows that ``updates`` names."""
    new = updates.select(*key, F.col(column).alias("__new"))
    joined = rows.join(new, key, "left")
    united = F.array_union(F.coalesce(column, F.array().cast("array<string>")), F.col("__new")) if append else F.col("__new")
    value = F.when(F.col("__new").isNotNull(), F.array_sort(F.array_distinct(united))).otherwise(F.col(column))
    return joined.withColumn(column, value).drop("__new").select(*rows.columns)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    joined = nodes.select("id").join(into, "id", "left").join(out, "id", "left")
    return joined.select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and edges over the most there can be in a directed graph; 0 below two nodes."""
    counts = nodes.agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("m")).unionByName(edges.agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("m")))
    total = counts.agg(F.sum("n").alias("n_nodes"), F.sum("m").alias("n_edges"))
    most = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return total.withColumn("density", F.round(F.when(F.col("n_nodes") > 1, F.col("n_edges") / most).otherwise(0.0), 6))


def neighbours(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(id, other): successors, predecessors, or both."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"))
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("other"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (id)."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def n_hop(edges: DataFrame, seeds: DataFrame, depth: int, by: str | None = None) -> DataFrame:
    """(id, hops) within ``depth`` undirected hops of the seeds (id), each with its least number of hops.

    One join a hop over the frontier only; each hop is written to the shared folder.
    """
    scratch = Scratch(edges.sparkSession, "hops")
    both = neighbours(edges, "both")
    keys = ["id"] if by is None else [by, "id"]
    reached = scratch.save(seeds.select(*keys).distinct().withColumn("hops", F.lit(0)), "reached")
    for hop in range(1, depth + 1):
        frontier = reached.where(F.col("hops") == hop - 1).join(both, "id")
        new = frontier.select(*[c for c in keys if c != "id"], F.col("other").alias("id")).distinct().join(reached, keys, "left_anti")
        grown = scratch.save(reached.unionByName(new.withColumn("hops", F.lit(hop))), "reached")
        scratch.drop(reached)
        reached = grown
    return reached


def bfs_tree(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Edges of a breadth-first tree for each seed (id): seed, src, dst, hop; the smallest parent finds a node."""
    scratch = Scratch(edges.sparkSession, "tree")
    both = neighbours(edges, "both")
    seen = scratch.save(seeds.select(F.col("id").alias("seed"), "id", F.lit(None).cast(seeds.schema["id"].dataType).alias("parent"), F.lit(0).alias("hop")).distinct(), "seen")
    for hop in range(1, depth + 1):
        front = seen.where(F.col("hop") == hop - 1).join(both, "id").select("seed", F.col("other").alias("id"), F.col("id").alias("parent"))
        new = front.groupBy("seed", "id").agg(F.min("parent").alias("parent")).join(seen, ["seed", "id"], "left_anti")
        seen = scratch.save(seen.unionByName(new.withColumn("hop", F.lit(hop))), "seen")
    return seen.where("parent is not null").select("seed", F.col("parent").alias("src"), F.col("id").alias("dst"), "hop")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node; a node without edges is its own component."""
    found = connected_components(edges).withColumnRenamed("node", "id")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def contexts(edges: DataFrame, as_text: bool) -> DataFrame:
    """Texts that edges stand for: the passages that ends conclude in, or "src relation dst"."""
    if as_text:
        return edges.where(F.col("relation") == CONCLUDES).select(F.col("dst").alias("context")).distinct()
    return edges.where(F.col("relation") != CONCLUDES).select(F.concat_ws(" ", "src", "relation", "dst").alias("context")).distinct()


def most_common(rows: DataFrame, value: str, place: str, k: int) -> DataFrame:
    """The k commonest values, ties by first place."""
    return rows.groupBy(value).agg(F.count("*").alias("n"), F.min(place).alias("first")).orderBy(F.desc("n"), "first").limit(k)


def concepts(text: Column) -> Column:
    """The sorted distinct concepts of a comma-separated list."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")))


def cluster_concepts(vectors: DataFrame, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """(id, component) of vectors (id, v) linked by nearest neighbours over a cosine; those without a link don't appear."""
    hits = dense_topk(vectors.select(F.col("id").alias("qid"), "v"), vectors, k, "cosine")
    edges = hits.where((F.col("score") > threshold) & (F.col("qid") != F.col("id"))).select(F.col("qid").alias("src"), F.col("id").alias("dst"))
    return connected_components(edges).withColumnRenamed("node", "id")


def synsets(members: DataFrame, frequency: DataFrame) -> DataFrame:
    """(concept, synset): each concept's group (concept, component) ordered by global frequency, then name."""
    ranked = members.join(frequency, "concept", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    grouped = ranked.groupBy("component").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "concept"))).alias("x"))
    return grouped.select(F.transform("x", lambda s: s["concept"]).alias("synset")).select(F.explode("synset").alias("concept"), "synset")


def propagate_synsets(rows: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """The first concepts of the synsets of each row's concepts (key, concepts), sorted."""
    lead = sets.select("concept", F.element_at("synset", 1).alias("lead"))
    pairs = rows.select(key, F.explode("concepts").alias("concept")).join(lead, "concept")
    return pairs.groupBy(key).agg(F.array_sort(F.collect_set("lead")).alias("synset"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """Personalised PageRank by power iteration over out edges; the seeds' name column is id."""
    scratch = Scratch(edges.sparkSession, "rank")
    n = seeds.count()
    start = seeds.select("id", F.lit(1.0 / max(n, 1)).alias("r0"))
    out = edges.groupBy("src").agg(F.count("*").alias("d"))
    steps = edges.select("src", "dst").join(out, "src")
    rank = scratch.save(start.withColumnRenamed("r0", "rank"), "rank")
    for _ in range(rounds):
        given = steps.join(rank, steps["src"] == rank["id"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("d")).alias("g")).withColumnRenamed("dst", "id")
        mixed = given.join(start, "id", "full_outer").select("id", (damping * F.coalesce("g", F.lit(0.0)) + (1 - damping) * F.coalesce("r0", F.lit(0.0))).alias("rank"))
        rank = scratch.save(mixed, "rank")
    return rank


def samples_by_hash(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """A sampling operator: the n rows with the smallest hash of their key, the same for each run."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)



def frequencies(rows: DataFrame, value: str) -> DataFrame:
    """(value, n) of how often each value comes."""
    return rows.groupBy(value).agg(F.count("*").alias("n"))
