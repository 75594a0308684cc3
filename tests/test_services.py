"""Services against a local server that fails, is slow or breaks off; chunks across documents against one text."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from marlspike.sources import corpus, services
from tests.oracle import SF


class Fake(BaseHTTPRequestHandler):
    """Answers by what is asked: 'fail N' fails N times, 'slow N' is late N times, 'bad' isn't JSON, 'long' stops for its length."""

    seen: Counter = Counter()
    answered: Counter = Counter()
    under_way, most = 0, 0
    lock = threading.Lock()

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        asked = body.get("query") or body.get("prompt") or body["messages"][-1]["content"]
        with self.lock:
            Fake.seen[asked] += 1
            n = Fake.seen[asked]
            Fake.under_way += 1
            Fake.most = max(Fake.most, Fake.under_way)
        try:
            time.sleep(0.01)
            word, _, times = asked.partition(" ")
            if word == "fail" and n <= int(times):
                self.send_error(503)
                return
            if word == "slow" and n <= int(times):
                time.sleep(1.5)
            with self.lock:
                Fake.answered[asked] += 1
            self.send_response(200)
            self.end_headers()
            self.wfile.write(self.answer(body, asked))
        except (BrokenPipeError, ConnectionResetError):
            pass
        finally:
            with self.lock:
                Fake.under_way -= 1

    def answer(self, body, asked):
        if asked == "bad":
            return b"<html>"
        if "query" in body:
            if asked == "nothing":
                return b"[]"
            return json.dumps({"data": {"results": [{"doc_id": 7, "title": "T", "content": f"of {asked}"}, "", "plain", {"text": ""}]}}).encode()
        why = "length" if asked == "long" else "stop"
        if body.get("stream"):
            parts = [{"choices": [{"delta": {"content": c}, "finish_reason": None}]} for c in ("one", " two")] + [{"choices": [{"delta": {}, "finish_reason": why}]}]
            return b": comment\n\n" + b"".join(b"data: " + json.dumps(p).encode() + b"\n\n" for p in parts) + b"data: [DONE]\n\n"
        text = {"message": {"role": "assistant", "content": f"re {asked}"}} if "messages" in body else {"text": f"re {asked}"}
        return json.dumps({"choices": [{**text, "finish_reason": why}], "usage": {"total_tokens": len(asked)}}).encode()

    def log_message(self, *_):
        pass


@pytest.fixture
def url():
    Fake.seen.clear(), Fake.answered.clear()
    Fake.most = 0
    server = ThreadingHTTPServer(("127.0.0.1", 0), Fake)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_answers_keep_order_and_none_is_lost(spark, url):
    prompts = [f"p{i}" for i in range(150)] + ["fail 2", "fail 9", "long", "bad", None]
    rows = spark.createDataFrame(list(enumerate(prompts)), "id long, prompt string").coalesce(1)
    got = services.ask(rows, services.Endpoint(url, first_wait=0.01, workers=3), prompt="prompt").collect()
    assert [r["id"] for r in got] == list(range(len(prompts)))
    by = dict(zip(prompts, got))
    assert all(by[f"p{i}"]["content"] == f"re p{i}" and by[f"p{i}"]["tries"] == 1 for i in range(150))
    assert (by["fail 2"]["content"], by["fail 2"]["tries"]) == ("re fail 2", 3)
    assert (by["fail 9"]["content"], by["fail 9"]["error"], by["fail 9"]["tries"]) == (None, "HTTP 503", 3)
    assert by["long"]["content"] == "re long......" and by["bad"]["error"] and by[None]["error"] == "nothing to ask"
    assert all(n == 1 for n in Fake.answered.values() if n) or Fake.answered["bad"] == 3
    assert Fake.most <= 3


def test_chats_and_streams(spark, url):
    rows = spark.createDataFrame([(1, [("system", "be brief"), ("user", "hello")])], "id long, messages array<struct<role:string,content:string>>")
    got = services.ask(rows.withColumn("messages", F.transform("messages", lambda m: F.create_map(F.lit("role"), m["role"], F.lit("content"), m["content"]))), services.Endpoint(url, "m", "secret"), messages="messages").first()
    assert (got["content"], got["tokens"], got["error"]) == ("re hello", 5, None)
    states, reply = services.streamed_chat(services.Endpoint(url), [{"role": "user", "content": "hi"}])
    assert states == ["one", "one two"] and reply.content == "one two"
    assert services.streamed_chat(services.Endpoint(url), [{"role": "user", "content": "long"}])[0][-1] == "one two......"
    assert services.growing(iter([b"data: {broken", b"data: {}"])) == []
    with pytest.raises(ValueError):
        services.ask(rows, services.Endpoint(url))


def test_a_broken_job_goes_on_and_asks_nothing_twice(spark, url, tmp_path):
    rows = spark.createDataFrame([(i, f"q{i}" if i else "fail 4") for i in range(40)], "id long, prompt string")
    path, endpoint = f"file://{tmp_path}/answers", services.Endpoint(url, timeouts=(5, 5), first_wait=0.01)
    services.ask_into(rows.where("id < 25"), path, endpoint, slices=3, prompt="prompt")  # the job that broke off
    got = services.ask_into(rows, path, endpoint, slices=3, prompt="prompt")
    first = {r["id"]: r for r in got.collect()}
    assert len(first) == 40 and first[0]["error"] == "HTTP 503" and all(first[i]["content"] == f"re q{i}" for i in range(1, 40))
    last = {r["id"]: r for r in services.ask_into(rows, path, endpoint, slices=3, prompt="prompt").collect()}
    assert last[0]["content"] == "re fail 4" and all(n == 1 for n in Fake.answered.values())
    answers, seen = services.metered(spark.createDataFrame([(1, "a", 5, None), (2, None, 0, "late")], "id long, content string, tokens long, error string"))
    answers.count(), answers.collect()
    assert seen.get == {"processed": 2, "failed": 1, "tokens": 5} == services.totals(answers)


def test_retrieval_of_failures_and_slow_answers(spark, url):
    queries = ["a", "slow 1", "slow 9", "fail 1", "bad", "nothing", None]
    df = spark.createDataFrame(list(enumerate(queries)), "qid long, query string")
    got = {}
    for r in services.retrieve(df, url, 5, timeouts=(0.5, 0.6), wait=0.01).collect():
        got.setdefault(queries[r["qid"]], []).append(tuple(r)[1:])
    assert got["a"] == [(1, "7", "T", "of a", None), (2, "graph_chunk", "", "plain", None)]
    assert got["slow 1"][0][3] == "of slow 1" and Fake.seen["slow 1"] == 2
    assert got["slow 9"][0][:4] == (None,) * 4 and "time" in got["slow 9"][0][4].lower() and Fake.seen["slow 9"] == 2
    assert got["fail 1"][0][4] == "HTTP 503" and Fake.seen["fail 1"] == 1  # only late answers are asked for again
    assert got["bad"][0][4] and got["nothing"] == [(None,) * 5] and got[None][0][4] == "nothing to ask"


def test_retrieval_as_a_data_source(spark, url):
    spark.dataSource.register(services.RetrievalSource)
    read = lambda **options: spark.read.format("retrieval").options(url=url, **options).load()
    rows = read(queries=json.dumps(["x", "fail 1", "y"]), partitions="2", top_k="3").collect()
    rows.sort(key=lambda r: (r["query"], r["rank"] or 0))
    assert [(r["query"], r["rank"], r["contents"]) for r in rows] == [("fail 1", None, None), ("x", 1, "of x"), ("x", 2, "plain"), ("y", 1, "of y"), ("y", 2, "plain")]
    assert rows[0]["error"] == "HTTP 503"
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert {r["contents"] for r in read().where("query IN ('k', 'l')").collect()} == {"of k", "of l", "plain"}
        assert read().where("query = 'm'").count() == 2 and set(Fake.seen) == {"x", "y", "fail 1", "k", "l", "m"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


# corpus -----------------------------------------------------------------------------------------


def cut(texts, size, overlap):
    whole = " ".join(texts)
    out = []
    for at in range(0, max(1, len(whole)), size - overlap):
        out.append(whole[at : at + size])
        if at + size >= len(whole):
            break
    return out if whole else []


@pytest.mark.parametrize(("size", "overlap"), [(2048, 100), (50, 0), (7, 6)])
def test_chunks_cross_documents(spark, size, overlap):
    docs = [(i, t) for i, t in enumerate(["first text", "", "x" * 120, None, "é日本", "end", "a " * 30])]
    df = spark.createDataFrame(docs, "id long, text string").repartition(5)
    got = [r["contents"] for r in corpus.corpus_chunks(df, size=size, overlap=overlap).orderBy("chunk").collect()]
    assert got == cut([t or "" for _, t in docs], size, overlap)


def test_chunks_of_a_corpus_and_of_none(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r["text"] or "" for r in df.orderBy("doc_id", "text").collect()]
    got = [r["contents"] for r in corpus.corpus_chunks(df, "doc_id").orderBy("chunk").collect()]
    assert got == cut(texts, 2048, 100)
    assert corpus.corpus_chunks(df.limit(0), "doc_id").count() == 0
    with pytest.raises(ValueError):
        corpus.corpus_chunks(df, "doc_id", size=10, overlap=10)
