"""Golden cases and brute force for the operators outside the catalogue."""

import random
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from marlspike.functions import text as T, vectors as V
from marlspike.operators import agent, cache, fusion, graph, metrics, search, store, strong, training
from marlspike.operators.components import connected_components
from marlspike.sources import loaders, splitters


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given_", "wanted"), [
    ("<think>a</think>Answer: Yes", "yes"), ("", ""), ("SubAnswer: unknown", "No relevant information found"), ("Final Answer: x\nAnswer: Rome", "Rome"), ("insufficient information", "insufficient information"),
])
def test_sub_answers(spark, given_, wanted):
    assert one(spark, T.sub_answer(F.col("t")), t=given_) == wanted


def test_other_normalisers(spark):
    assert one(spark, T.sub_query(F.col("t")), t='<think>why</think> "Query: Who is it?"') == "Who is it?"
    assert one(spark, T.sub_query(F.col("t")), t="SubQuery: Who is it?") == "Who is it?"
    assert one(spark, T.thought(F.col("t")), t="<think> why </think>x") == "why"
    assert one(spark, T.answer_entity(F.col("t")), t="Queen Anna of Bern and Otto") == "Anna of Bern"
    assert one(spark, T.follow_up(F.col("t")), t="Who was Anna's wife?") == "Who is Anna's wife?"
    assert one(spark, T.score_in(F.col("t")), t="score 0.13 of 1") == 0.13
    assert one(spark, T.score_in(F.col("t")), t="none") == 0.0
    assert one(spark, T.excel_time(F.col("t")), t=0.5) == "12:00"
    assert one(spark, T.truncated_middle(F.col("t"), 4), t=list("abcdefg")) == list("abfg")
    assert one(spark, T.question_lines(F.col("t")), t="问题1：A\n\n问题2：B") == ["A", "B"]


def test_vectors(spark):
    assert one(spark, V.unit(F.col("v")), v=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, V.unit(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, V.pooled(F.col("v"), "weighted"), v=[[1.0, 0.0], [4.0, 3.0]]) == pytest.approx([3.0, 2.0])


def test_min_max_and_weight(spark):
    rows = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4, 5)] + [(2, 7.0), (2, 7.0)], "qid long, score double")
    got = sorted((r["qid"], r["norm_score"]) for r in fusion.min_max(rows, ["qid"]).collect())
    assert got == [(1, 0.0), (1, 0.25), (1, 0.5), (1, 0.75), (1, 1.0), (2, 0.0), (2, 0.0)]
    w = [one(spark, fusion.logistic_weight(F.col("n")), n=n) for n in (1, 6, 10)]
    assert w[0] == pytest.approx(0.4, abs=0.05) and w[2] == pytest.approx(0.7, abs=0.05) and w == sorted(w)


def test_rank_fusion(spark):
    ranked = lambda xs: spark.createDataFrame([(0, i, x) for i, x in enumerate(xs)], "qid long, rank long, id long")
    got = fusion.reciprocal_rank_fusion([ranked([1, 2, 3]), ranked([2, 3, 4])]).orderBy("rank").collect()
    assert [r["id"] for r in got] == [2, 3, 1, 4]


def test_greedy_groups(spark):
    assert one(spark, fusion.greedy_groups(F.col("t"), 5), t=["abc", "de", "f", "longer than", "g"]) == [["abc", "de"], ["f"], ["longer than"], ["g"]]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
def test_components(spark, edges):
    parent = list(range(13))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_dense_search_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, v array<double>")
    queries = rows.where("id < 10").select(F.col("id").alias("qid"), "v")
    for metric, order in (("ip", -(x[:10] @ x.T)), ("l2", ((x[:10, None] - x[None]) ** 2).sum(-1))):
        got = {(r["qid"], r["rank"]): r["id"] for r in search.dense_topk(queries, rows, 4, metric, block=3).collect()}
        wanted = {(q, k + 1): int(i) for q in range(10) for k, i in enumerate(np.argsort(order[q])[:4])}
        assert got == wanted
    assert search.dense_topk(queries.where("qid < 0"), rows).count() == 0


def test_graph_merge(spark):
    rel = "array<struct<Head:string,Relation:string,Tail:string>>"
    schema = f"raw_text string, file_id string, entity_relations {rel}, event_relations {rel}, event_entity_relations array<struct<Event:string,Entity:array<string>>>"
    rows = spark.createDataFrame([("T1", "f1", [("a", "likes", "b"), ("a", "hates", "b"), ("", "x", "y")], [("e1", "causes", "e2")], [("e1", ["a", " "])]), ("T2", "f2", [("a", "sees", "b")], [], [])], schema)
    edges = graph.merge_edges(graph.expand_edges(graph.relation_rows(rows)))
    got = {(r["src"], r["dst"]): (r["relation"], r["file_ids"]) for r in edges.collect()}
    assert got["a", "b"] == ("likes", ["f1", "f2"]) and got["a", "e1"][0] == "participate" and got["e1", "e2"][0] == "causes" and got["a", "T2"][0] == "text_conclude"


def test_long_chain_into_a_cycle(spark):
    """100,000 nodes one after another, then a cycle: paths are drawn together by doubling."""
    for length in (100_000, 6):
        rows = spark.range(length + 3).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
        rows = rows.union(spark.createDataFrame([(length + 3, length), (length, length)], "src long, dst long"))
        got = strong.strong_components(rows).select("id", "component", F.least("id", F.lit(length)).alias("want"))
        assert got.count() == length + 4 and got.where("component <> want").isEmpty()


def components_by_reach(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    reach = {}
    for a in out:
        seen, stack = {a}, [a]
        while stack:
            for b in out[stack.pop()] - seen:
                seen.add(b)
                stack.append(b)
        reach[a] = seen
    return {a: min(b for b in reach[a] if a in reach[b]) for a in out}


@pytest.mark.parametrize("seed,nodes,edges", [(1, 40, 45), (2, 40, 80), (3, 30, 150), (4, 60, 60)])
def test_strong_components_of_random_graphs(spark, seed, nodes, edges):
    rng = random.Random(seed)
    rows = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]
    got = {r["id"]: r["component"] for r in strong.strong_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == components_by_reach(rows)


def test_strong_components_and_tree(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1)], "src long, dst long").withColumn("relation", F.lit("r"))
    got = {r["id"]: r["component"] for r in strong.strong_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert strong.strong_components(edges.limit(0)).count() == 0
    tree = graph.bfs_tree(edges, spark.createDataFrame([(6,)], "id long"), 2)
    assert sorted((r["src"], r["dst"], r["hop"]) for r in tree.collect()) == [(1, 2, 2), (1, 3, 2), (6, 1, 1)]
    rank = {r["id"]: r["rank"] for r in graph.personalised_rank(edges, spark.createDataFrame([(6,)], "id long"), 3).collect()}
    assert rank[6] == pytest.approx(0.15)


def test_synsets(spark):
    members = spark.createDataFrame([("concept1", 0), ("concept2", 0)], "concept string, component long")
    counts = spark.createDataFrame([("concept1", 3), ("concept2", 1)], "concept string, n long")
    got = {r["concept"]: r["synset"] for r in graph.synsets(members, counts).collect()}
    assert got == {"concept1": ["concept1", "concept2"], "concept2": ["concept1", "concept2"]}
    assert one(spark, graph.concepts(F.col("t")), t="concept1, concept2, concept1") == ["concept1", "concept2"]


def test_stores(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, label string")
    new = spark.createDataFrame([(2, None)], "id long, label string")
    assert sorted(tuple(r) for r in store.upsert_vectors(rows, new).collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(store.StoreError):
        store.upsert_vectors(rows, spark.createDataFrame([(9, "x")], "id long, label string"))
    with pytest.raises(store.StoreError):
        store.upsert_vectors(rows, new.union(new))
    members = spark.createDataFrame([(1, "kb", "u1", "admin")], "knowledge_id long, knowledge_name string, user_id string, role string")
    more = store.create_knowledge(store.create_knowledge(members, "kb", "u2", "member"), "other", "u3")
    assert sorted((r[0], r[2]) for r in more.collect()) == [(1, "u1"), (1, "u2"), (2, "u3")]
    with pytest.raises(store.StoreError):
        store.detach_user(more, "other", "u3")
    assert store.detach_user(more, "kb", "u1").count() == 2
    registry = spark.createDataFrame([(1, "doc")], "knowledge_id long, document_name string")
    wanted = spark.createDataFrame([("u2", 1, "new"), ("u1", 1, "new"), ("u1", 1, "doc")], "user_id string, knowledge_id long, document_name string")
    assert sorted(r["document_name"] for r in store.add_documents(more, registry, wanted).collect()) == ["doc", "new"]
    chunks = spark.createDataFrame([(7, 1, 0, "x")], "chunk_id long, document_id long, pos long, chunk_content string")
    added = store.add_chunks(chunks, spark.createDataFrame([(3, 1, "b"), (2, 0, "c"), (3, 0, "a")], "document_id long, pos long, chunk_content string"))
    assert sorted((r["chunk_id"], r["chunk_content"]) for r in added.collect()) == [(7, "x"), (8, "c"), (9, "a"), (10, "b")]
    left, gone = store.delete_chunks(added, spark.createDataFrame([(3,)], "document_id long"))
    assert left.count() == 2 and sorted(r[0] for r in gone.collect()) == [9, 10]


def test_cache_eviction_and_similarity(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("b", 3, 1), ("c", 2, 9)], "key string, last_access long, hits long")
    assert [r["key"] for r in cache.evict(rows, 2, "lru").collect()] == ["b", "c"]
    assert [r["key"] for r in cache.evict(rows, 2, "lfu").collect()] == ["c", "a"]
    df = spark.createDataFrame([("A", "a", 0.2), ("A", "b", 1.7), ("A", "b", 0.25)], "q string, c string, raw double")
    assert [r[0] for r in df.select(cache.similarity("q", "c", "raw", reverse=True)).collect()] == [1.0, 0.0, 0.75]


def test_failure_flags(spark):
    bad = "No relevant information found"
    step = "array<struct<subquery:string,subanswer:string>>"
    rows = spark.createDataFrame([(0, "Are A and B of the same country?", [("q1", bad), ("q2", "France")]), (1, "Who is the father-in-law of X?", [("q1", bad)]), (2, "x", [])], f"i long, question string, steps {step}")
    got = {r["i"]: r for r in metrics.failure_flags(rows).collect()}
    assert got[0]["first_failed"] and got[0]["rewritten"] and got[0]["salvaged"] and got[0]["one_side_missing"] and got[0]["category"] == "comparison"
    assert got[1]["drift"] and not got[1]["rewritten"] and got[2]["category"] == "other" and not got[2]["first_failed"]


def test_planner(spark):
    asked = ["Who is the father of the director of film The Long River?", "Are director of film Alpha and director of film Beta from the same country?", "Who is the maternal grandmother of Otto?", "What is it?"]
    rows = spark.createDataFrame(list(enumerate(asked)), "qid long, question string")
    known = {"Who directed the film The Long River?": "Jo Han", "Who is Jo Han's father?": "Old Han", "Who directed the film Alpha?": "A", "Who directed the film Beta?": "B", "Which country is A from?": "Peru", "Which country is B from?": "Peru"}
    table = spark.createDataFrame(list(known.items()), "subquery string, subanswer string")
    got = {r["qid"]: r for r in agent.run_paths(rows, lambda df: df.join(table, "subquery")).withColumn("final", agent.guarded_answer(F.col("frame"), F.col("answers"), F.try_element_at("answers", F.lit(-1)))).collect()}
    assert got[0]["answers"] == ["Jo Han", "Old Han"] and got[0]["final"] == "Old Han"
    assert got[1]["subqueries"][2:] == ["Which country is A from?", "Which country is B from?"]
    assert got[2]["subqueries"] == ["Who is Otto's mother?", "Who is the mother of Otto?"] and got[2]["final"] == T.NO_INFO
    assert got[3]["subqueries"] == []


def test_best_paths(spark):
    rows = spark.createDataFrame([(1, 7, 3.0), (1, 6, 3.0), (1, 5, 4.0), (2, 1, None), (2, 9, 8.0), (3, 2, None)], "qid long, path long, score double")
    assert sorted(map(tuple, agent.best_of(rows).collect())) == [(1, 6, 3.0), (2, 9, 8.0), (3, None, None)]
    assert sorted(map(tuple, agent.best_of(rows, F.col("score") + 2 * F.col("path")).collect())) == [(1, 5, 3.0), (2, 9, 8.0), (3, None, None)]


def test_query_variants(spark):
    got = one(spark, agent.query_variants(F.col("t")), t="Where was Anna Berg (painter) born?")
    assert got == ["Anna Berg (painter) place of birth", "Anna Berg place of birth", "birth place Anna Berg (painter)", "birth place Anna Berg"]


def test_training_rows(spark):
    step = "array<struct<subquery:string,context:string,subanswer:string>>"
    rows = spark.createDataFrame([(1, "Q", [("q1", "c1", "a1"), ("q2", "c2", "a2")], "A")], f"qid long, question string, steps {step}, answer string")
    messages = training.chat_rows(rows).first()["messages"]
    assert len(messages) == 8 and messages[1]["content"] == "SubQuery: q1" and messages[-1]["content"] == "Final Answer: A"
    got = training.aligned_samples(rows).orderBy("no").collect()
    assert [r["type"] for r in got] == ["subquery", "subanswer", "subquery", "subanswer", "final"] and got[2]["prompt"] == "Q\nq1\na1"
    span = "array<struct<ids:array<int>,trainable:boolean>>"
    masked = spark.createDataFrame([([([1, 2], False), ([3], True)],)], f"s {span}").select(training.label_mask(F.col("s"), 5).alias("m")).first()["m"]
    assert masked["input_ids"] == [1, 2, 3, 0, 0] and masked["labels"] == [-100, -100, 3, -100, -100]


def test_splitters():
    random.seed(1)
    text = " ".join("".join(random.choices("abc", k=random.randint(1, 9))) for _ in range(300))
    parts = splitters.recursive(text, 60, 20)
    assert all(len(p) <= 60 for p in parts) and set(text.split()) == set(" ".join(parts).split())
    assert splitters.recursive("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert splitters.markdown("", 100) == [""] and splitters.markdown("# T\n\nshort", 100) == ["# T\n\nshort"]
    long = "# A\n\n" + "one two " * 30 + "\n## B\n\n" + "three " * 40
    chunks = splitters.markdown(long, 120)
    assert chunks[0].startswith("# A\n") and any(c.startswith("# A\n## B\n") for c in chunks)


def test_loaders(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    row = lambda *ts: "<w:tr>" + "".join(map(cell, ts)) + "</w:tr>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl>{row('h', 'k')}{row('1', '2')}</w:tbl></w:body></w:document>")
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c r="A2" t="inlineStr"><is><t>n</t></is></c><c r="B2" t="inlineStr"><is><t>m</t></is></c></row><row><c r="A3"><v>0</v></c><c r="B3"><v>5</v></c></row></sheetData></worksheet>')
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.md").write_text("# T\n![x](data:image/png;base64,AA)\ntext")
    (tmp_path / "e.xyz").write_text("skipped")
    got = {r["path"].rsplit("/", 1)[1]: r for r in loaders.Loaders().load(spark, str(tmp_path)).collect()}
    assert got["a.docx"]["page_content"] == "Hello\n\nh: 1，k: 2。" and got["b.xlsx"]["page_content"] == "m:5;"
    assert got["c.docx"]["error"] and "e.xyz" not in got
    assert [tuple(r) for r in loaders.markdown_files(spark, str(tmp_path)).collect()] == [("d", "# T\ntext")]
    pages = spark.createDataFrame([(1, "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td><b>2</b></td></tr></table>")], "page_id long, html string")
    assert [r["text"] for r in loaders.html_table_rows(pages, "page_id", "html").collect()] == ["a:1,b:2;"]


def test_streaming_append(spark, tmp_path):
    from marlspike.streaming import ingest

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([(1, "a"), (2, "b")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(part, "id long, t string").write.mode("append").parquet(source)
        ingest.append_new(ingest.stream_table(spark, source, "id long, t string"), target, "id", str(tmp_path / "check")).awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 2, 3]
