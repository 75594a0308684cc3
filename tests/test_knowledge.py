"""Knowledge bases, collections, loaders of PDF and Markdown, graph files, planner retries."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from marlspike.functions import json_text as J
from marlspike.operators import agent, chains, evaluate, graph, knowledge, store, subgraphs
from marlspike.sources import loaders
from marlspike.sources.pdf import pdf

TEXTS = "document_name string, file_path string, pos int, page_content string, metadata map<string,string>"


def _dense(text):
    return F.array(F.length(text).cast("double"))


def test_base_lifecycle(spark):
    base = knowledge.KnowledgeBase.create(spark, "kb", "user_1")
    texts = spark.createDataFrame([("b", "/b", 0, "one", None), ("a", "/a", 1, "two", None), ("a", "/a", 0, "first", None), ("a", "/a", 2, "", None)], TEXTS)
    full = base.add_files("user_1", texts, dense=_dense, sparse=lambda t: F.create_map(F.lit("1"), F.lit(0.5)))
    assert sorted((r["chunk_id"], r["document_id"], r["chunk_content"]) for r in full.chunks.collect()) == [(1, 1, "first"), (2, 1, "two"), (3, 2, "one")]
    assert full.accordance().count() == 0 and base.chunks.count() == 0
    for call in (lambda: full.add_files("user_1", texts, dense=_dense), lambda: full.add_files("user_2", texts, dense=_dense), lambda: base.add_files("user_1", texts), lambda: full.documents("user_2")):
        with pytest.raises(store.StoreError):
            call()
    left, report = full.delete_files("user_1", spark.createDataFrame([("a",), ("zzz",)], "document_name string"))
    assert sorted(tuple(r) for r in report.collect()) == [("a", True, 2, 2), ("zzz", False, 0, 0)]
    assert [r["document_name"] for r in left.registry.collect()] == ["b"] and left.vectors.count() == 1
    gone = full.delete_all("user_1")
    assert gone.chunks.count() == gone.members.count() == gone.registry.count() == 0


def test_upload_dir(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\ntext\n\n| h | k |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n")
    (tmp_path / "b.txt").write_text("word " * 500)
    (tmp_path / "c.zzz").write_text("?")
    (tmp_path / "d.docx").write_bytes(b"no zip")
    base, failed = knowledge.upload_dir(knowledge.KnowledgeBase.create(spark, "kb", "user_1"), spark, "user_1", f"file://{tmp_path}", loaders.Loaders(), dense=_dense)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in failed.collect()) == ["c.zzz", "d.docx"]
    chunks = base.chunks.orderBy("chunk_id").collect()
    assert chunks[0]["chunk_content"] == "# Title\n\ntext\n\nh:1,k:2;h:3,k:4。" and len(chunks) == 4
    again, _ = knowledge.upload_dir(base, spark, "user_1", f"file://{tmp_path}", loaders.Loaders(), dense=_dense, force=True)
    assert again.chunks.count() == 4 and again.accordance().count() == 0
    with pytest.raises(ValueError):
        loaders.Loaders().register_splitter("recursive", ".png")


def test_collections(spark, tmp_path):
    rooms = knowledge.Collections(spark, f"file://{tmp_path}/rooms")
    rooms.create("a", "id long, v string")
    rooms.add("a", spark.createDataFrame([(1, "x")], "id long, v string"))
    assert rooms.has("a") and not rooms.has("b") and [tuple(r) for r in rooms.load("a").collect()] == [(1, "x")]
    with pytest.raises(store.StoreError):
        rooms.create("a", "id long")
    rooms.drop("a")
    assert not rooms.has("a")
    with pytest.raises(store.StoreError):
        rooms.drop("a")


def test_refused_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, vector array<double>")
    with pytest.raises(store.StoreError):
        knowledge.mixed(rows, "dense", 2)
    with pytest.raises(store.StoreError):
        knowledge.mixed(rows, "hybrid")
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id long, chunk_content string")
    for bad in ([(1, "x"), (1, "y")], [(1, None)]):
        with pytest.raises(store.StoreError):
            store.update_texts(chunks, spark.createDataFrame(bad, "chunk_id long, chunk_content string"))


def _pdf(pages, packed):
    parts = [b"%PDF-1.4\n"]
    for i, content in enumerate(pages):
        data = zlib.compress(content) if packed else content
        filter_ = b"/Filter /FlateDecode " if packed else b""
        parts.append(b"%d 0 obj << /Type /Page /Resources << /Font << /F1 90 0 R >> >> /Contents %d 0 R >> endobj\n" % (10 + i, 50 + i))
        parts.append(b"%d 0 obj << %s/Length %d >> stream\n%s\nendstream endobj\n" % (50 + i, filter_, len(data), data))
    parts.append(b"90 0 obj << /Type /Font /ToUnicode 91 0 R >> endobj\n" if packed else b"90 0 obj << /Type /Font >> endobj\n")
    table = b"1 beginbfchar <0001> <00E9> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    parts.append(b"91 0 obj << /Length %d >> stream\n%s\nendstream endobj\n%%%%EOF" % (len(table), table))
    return b"".join(parts)


def test_pdf():
    plain = _pdf([b"BT /F1 12 Tf (Hello \\(you\\)) Tj 0 -14 Td [(wor) -50 (ld) -400 (again)] TJ ET", b"BT (two\\041) Tj ET"], False)
    assert pdf(plain) == [("Hello (you) world again two!", {"type": "text", "page_count": "2"})]
    assert pdf(_pdf([b"BT /F1 12 Tf <001000110012> Tj <0001> Tj ET"], True)) == [("abcé", {"type": "text", "page_count": "1"})]
    with pytest.raises(ValueError):
        pdf(b"no")


def test_markdown_loader():
    text = "Big\n===\npara\nmore ![x](data:image/png;base64,AA)\n\n### Small ###\n```\n# code\n```\n"
    assert loaders.markdown_text(text.encode())[0][0] == "# Big\n\npara\nmore\n\n### Small\n\n```\n# code\n```"


def test_result_files(spark, tmp_path):
    old = [{"type": "Summary", "n": 2}, {"type": None, "n": 1}, {"n": 5}]
    new = {"summary": {"n": 9}, "results": [{"n": 1}, {"n": 2}]}
    for value, wanted, total in ((old, [1, 5], 2), (new, [1, 2], 9)):
        (tmp_path / "r.json").write_text(json.dumps(value))
        samples, summary = loaders.eval_results(spark, f"file://{tmp_path}/r.json", "type string, n long")
        assert sorted(r["n"] for r in samples.collect()) == wanted and summary.first()["n"] == total


def test_graph_files(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a", "entity")], "id string, type string"), spark.createDataFrame([("a", "b", "r")], "src string, dst string, relation string")
    subgraphs.save_graph(nodes, edges, f"file://{tmp_path}/g", F.reverse)
    got = subgraphs.load_graph(spark, f"file://{tmp_path}/g", "id string, type string", "src string, dst string, relation string", F.reverse)
    assert [tuple(r) for r in got[0].collect()] == [("a", "entity")] and [tuple(r) for r in got[1].collect()] == [("a", "b", "r")]
    vectors = subgraphs.node_vectors(nodes, lambda x: F.array(F.lit(3.0), F.lit(4.0)))
    assert vectors.first()["v"] == [0.6, 0.8] and not subgraphs.stale(nodes, vectors)
    asked = subgraphs.concept_requests(nodes, edges)
    told = subgraphs.conceptualise(asked, {"entity": "E [NODE]: [CONTEXT]", "relation": "R [NODE]"}, F.upper)
    assert sorted(tuple(r) for r in told.collect()) == [("a", "E A: R B", "entity"), ("r", "R R", "relation")]
    assert graph.frequencies(edges, "src").first()["n"] == 1


def test_in_laws_are_asked_for_once_more(spark):
    asked = spark.createDataFrame([(1, "Who is the father-in-law of Jane?")], "qid long, question string")
    known = {"Who is Jane's spouse?": "Otto"}
    answer = lambda rows: rows.select("qid", F.create_map(*[F.lit(x) for p in known.items() for x in p])[F.col("subquery")].alias("subanswer"))
    got = agent.run_paths(asked, answer).first()
    assert got["subqueries"] == ["Who is Jane's spouse?", "Who is Otto's father?", "Who was Jane's spouse?"]


def test_parsers_of_odd_input(spark):
    rows = spark.createDataFrame([(None,), ("",), ("[{]",), ("no json",)], "t string")
    got = rows.select(J.parsed_records(F.col("t"), J.ENTITY_KEYS).alias("r"), J.service_records(F.col("t")).alias("s"), J.qa_pairs(F.col("t"), 1).alias("q")).collect()
    assert [r["r"] for r in got][1:] == [[], [], []] and [len(r["s"]) for r in got] == [0, 0, 1, 1]
    assert [r["q"] for r in got][1:] == [{}, {}, {}]


def test_empty_reports(spark):
    none = spark.createDataFrame([], "question string, steps array<struct<subquery:string,subanswer:string>>, answer string, ground_truth string, recall double")
    assert evaluate.failure_rates(none).first()["zero_recall_rate"] == 0 and evaluate.answer_quality(none).first()["token_f1"] == 0
    assert evaluate.category_recalls(none).count() == 0


def test_random_eviction_and_summaries(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("key"))
    assert chains.evict_at_random(rows, 7).count() == 7 and chains.evict_at_random(rows, 7, 1).collect() != chains.evict_at_random(rows, 7).collect()
    with pytest.raises(ValueError):
        chains.merged_summaries(spark.createDataFrame([(1, 0, "x" * 50), (1, 1, "y" * 50)], "id long, pos long, text string"), lambda t: t, 60, 30, 2).collect()
