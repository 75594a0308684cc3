"""Services behind HTTP, called from Spark tasks: retrieval, completions and chats.

Calls are made where the rows are, a bounded number at a time in each task, and answers keep the order of
their rows. What fails for good is a row with its error, never a lost row or a failed job. Waits between
tries double. ``ask_into`` keeps answers in a folder, slice by slice, and asks only what has no answer
there yet, so a job that broke off goes on where it was.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from marlspike.functions.json_text import DEFAULT_ID, nodes, record
from marlspike.scratch import exists

#: Fixed mark behind an answer that stopped because of its length.
CUT_SHORT = "......"


@dataclass(frozen=True)
class Endpoint:
    """Where to call, how often, and how long to wait: seconds to answer of each try, then between tries 1, 2, 4 ... up to ``longest_wait``.

    ``workers`` bounds the calls that one task has under way.
    """

    url: str
    model: str = ""
    key: str = ""
    timeouts: tuple[float, ...] = (60, 60, 60)
    longest_wait: float = 4
    first_wait: float = 1
    workers: int = 4
    options: tuple[tuple[str, object], ...] = ()

    def headers(self) -> dict[str, str]:
        return {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})


@dataclass(frozen=True)
class Reply:
    """Content and tokens of an answer, or its error, and how many tries it took."""

    content: str | None
    tokens: int = 0
    error: str | None = None
    tries: int = 1


def _post(endpoint: Endpoint, path: str, body: dict, read: Callable, retry_all: bool = True) -> tuple[object, str | None, int]:
    """(what ``read`` makes of the answer, error, tries). Only time-outs are tried again where ``retry_all`` isn't set."""
    error = "no try was allowed"
    for n, timeout in enumerate(endpoint.timeouts, 1):
        try:
            request = urllib.request.Request(endpoint.url.rstrip("/") + path, json.dumps(body).encode(), endpoint.headers())
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return read(answer), None, n
        except Exception as e:  # whatever a service does is data
            reason = getattr(e, "reason", e)
            late = isinstance(e, TimeoutError) or isinstance(reason, TimeoutError)
            error = f"HTTP {e.code}" if isinstance(e, urllib.error.HTTPError) else f"{type(reason).__name__}: {reason}"
            if not late and not retry_all:
                return None, error, n
        if n < len(endpoint.timeouts):
            time.sleep(min(endpoint.first_wait * 2 ** (n - 1), endpoint.longest_wait))
    return None, error, len(endpoint.timeouts)


def _loaded(answer) -> object:
    return json.loads(answer.read())


# --- completions and chats ------------------------------------------------------------------------


def _reply(found: object, error: str | None, tries: int, where: list) -> Reply:
    if error is not None:
        return Reply(None, 0, error, tries)
    content = _dig(found, ["choices", 0, *where])
    if not isinstance(content, str):
        return Reply(None, 0, f"no content in {json.dumps(found)[:200]}", tries)
    if _dig(found, ["choices", 0, "finish_reason"]) == "length":
        content += CUT_SHORT
    return Reply(content, int(_dig(found, ["usage", "total_tokens"]) or 0), None, tries)


def _dig(value: object, keys: list) -> object:
    for k in keys:
        try:
            value = value[k]
        except (KeyError, IndexError, TypeError):
            return None
    return value


def chat(endpoint: Endpoint, messages: list[dict]) -> Reply:
    """The answer to a list of messages (role, content)."""
    body = {"model": endpoint.model, "messages": messages, "stream": False, **dict(endpoint.options)}
    return _reply(*_post(endpoint, "/chat/completions", body, _loaded), ["message", "content"])


def complete(endpoint: Endpoint, prompt: str) -> Reply:
    """The continuation of a prompt."""
    body = {"model": endpoint.model, "prompt": prompt, **dict(endpoint.options)}
    return _reply(*_post(endpoint, "/completions", body, _loaded), ["text"])


def growing(lines: Iterator[bytes]) -> list[str]:
    """The states of a streamed answer, each longer than the one before; lines that aren't data are passed over, one that can't be read ends it."""
    text, out = "", []
    for line in lines:
        if not line.startswith(b"data:"):
            continue
        try:
            data = json.loads(line[5:].strip())
        except ValueError:
            break
        why = _dig(data, ["choices", 0, "finish_reason"])
        if why == "length":
            out.append(text + CUT_SHORT)
        if why:
            break
        text += _dig(data, ["choices", 0, "delta", "content"]) or ""
        out.append(text)
    return out


def streamed_chat(endpoint: Endpoint, messages: list[dict]) -> tuple[list[str], Reply]:
    """States of a streamed answer, and the last one as the answer."""
    body = {"model": endpoint.model, "messages": messages, "stream": True, **dict(endpoint.options)}
    states, error, tries = _post(endpoint, "/chat/completions", body, growing)
    states = states or []
    return states, Reply(states[-1] if states else None, 0, error or (None if states else "an empty stream"), tries)


ANSWER = "content string, tokens long, error string, tries int"


def ask(rows: DataFrame, endpoint: Endpoint, key: str = "id", prompt: str | None = None, messages: str | None = None) -> DataFrame:
    """(key, content, tokens, error, tries) of each row: its ``prompt`` (a text) completed, or its ``messages`` (an array of structs or maps of role and content) answered.

    A row whose prompt is null isn't sent and has an error. Rows with equal keys are asked one by one.
    """
    if (prompt is None) == (messages is None):
        raise ValueError("give prompts or messages")
    asked = prompt or messages
    kind = rows.schema[key].dataType.simpleString()

    def one(value) -> Reply:
        if value is None:
            return Reply(None, 0, "nothing to ask", 0)
        return complete(endpoint, value) if prompt else chat(endpoint, [dict(m) for m in value])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(endpoint.workers) as pool:
            for batch in batches:
                values = batch.column("asked").to_pylist()
                for start in range(0, len(values), 16 * endpoint.workers):  # answers go on as they come, in order
                    part = list(pool.map(one, values[start : start + 16 * endpoint.workers]))
                    columns = [pa.array([getattr(r, c) for r in part], t) for c, t in (("content", pa.string()), ("tokens", pa.int64()), ("error", pa.string()), ("tries", pa.int32()))]
                    yield pa.RecordBatch.from_arrays([batch.column(key).slice(start, len(part)), *columns], names=[key, "content", "tokens", "error", "tries"])

    return rows.select(key, F.col(asked).alias("asked")).mapInArrow(run, f"`{key}` {kind}, {ANSWER}")


def ask_into(rows: DataFrame, path: str, endpoint: Endpoint, key: str = "id", slices: int = 16, **what) -> DataFrame:
    """As ``ask``, with the answers kept in ``path``: keys answered there already aren't asked again, those that failed are.

    Rows are asked in ``slices`` by a hash of their key, and each slice's answers are kept when it is
    done, so what a broken job has to ask again is one slice at most. Keys tell rows apart. Gives the answers
    that are there at the end, of the rows given, errors of the last try where there is none.
    """
    spark = rows.sparkSession
    for n in range(slices):
        todo = rows.where(F.pmod(F.xxhash64(key), F.lit(slices)) == n)
        if exists(spark, path):
            todo = todo.join(spark.read.parquet(path).where("error is null").select(key), key, "left_anti")
        answers = ask(todo, endpoint, key, **what).withColumn("slice", F.lit(time.time()))
        answers.write.mode("append").parquet(path)
    kept = spark.read.parquet(path).join(rows.select(key).distinct(), key, "left_semi")
    latest = F.max_by(F.struct("content", "tokens", "error", "tries"), F.struct(F.col("error").isNull(), "slice"))
    return kept.groupBy(key).agg(latest.alias("x")).select(key, "x.*")


def metered(answers: DataFrame, name: str = "calls") -> tuple[DataFrame, Observation]:
    """The answers, and counts that are there once a job has read them: processed, failed and tokens.

    For watching a job. A task that is run again for a lost executor may count twice; ``totals`` of kept
    answers is exact.
    """
    seen = Observation(name)
    return answers.observe(seen, *_counts()), seen


def _counts() -> list[Column]:
    return [F.count("*").alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")]


def totals(answers: DataFrame) -> dict[str, int]:
    return answers.agg(*_counts()).first().asDict()


# --- retrieval ------------------------------------------------------------------------------------


def usable(answer: object) -> list[tuple[str, str, str]]:
    """(doc_id, title, contents) of the records of an answer, in order, without those that hold neither text nor id."""
    found = [tuple(record(x)[c] for c in ("doc_id", "title", "contents")) for x in nodes(answer)]
    return [r for r in found if r[2] or r[0] != DEFAULT_ID]


#: Fixed waits for an answer: of a search service, and of a graph service, whose second try may take twice as long.
SEARCH_TIMEOUTS, GRAPH_TIMEOUTS = (10.0,), (240.0, 480.0)


def retrieve_one(endpoint: Endpoint, query: str, top_k: int) -> tuple[list, str | None]:
    """(records, error) of a query. Time-outs are tried again, other failures aren't; a failure has no records."""
    found, error, _ = _post(endpoint, "", {"query": query, "top_k": top_k}, _loaded, retry_all=False)
    return (usable(found), None) if error is None else ([], error)


HITS = "rank int, doc_id string, title string, contents string, error string"


def retrieve(queries: DataFrame, url: str, top_k: int = 10, timeouts: tuple[float, ...] = SEARCH_TIMEOUTS, workers: int = 4, wait: float = 1) -> DataFrame:
    """(qid, rank, doc_id, title, contents, error) of what a service finds for each row (qid, query).

    Records that hold nothing are left out and the rest keep their order. A query that fails, or finds
    nothing, has one row of nulls, with the error.
    """
    endpoint = Endpoint(url, timeouts=tuple(timeouts), workers=workers, first_wait=wait)
    kind = queries.schema["qid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                answers = pool.map(lambda q: ([], "nothing to ask") if q is None else retrieve_one(endpoint, q, top_k), batch.column("query").to_pylist())
                rows = []
                for i, (found, error) in enumerate(answers):
                    rows += [(i, n, *r, None) for n, r in enumerate(found, 1)] or [(i, None, None, None, None, error)]
                if rows:
                    at, *columns = zip(*rows, strict=True)
                    types = (pa.int32(), *[pa.string()] * 4)
                    yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["qid", "rank", "doc_id", "title", "contents", "error"])

    return queries.select("qid", "query").mapInArrow(run, f"qid {kind}, {HITS}")


class RetrievalSource(DataSource):
    """``spark.read.format("retrieval")``: (query, rank, doc_id, title, contents, error) of the queries asked for.

    Options: ``url``; ``queries``, a JSON list; ``top_k``; ``timeouts``, seconds with commas; ``partitions``,
    into how many tasks the queries go. Without ``queries``, those of a filter are asked
    (``query = ...`` or ``query IN (...)``, with ``spark.sql.python.filterPushdown.enabled``). Register it with
    ``spark.dataSource.register(RetrievalSource)``.
    """

    @classmethod
    def name(cls) -> str:
        return "retrieval"

    def schema(self) -> str:
        return f"query string, {HITS}"

    def reader(self, schema) -> RetrievalReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return RetrievalReader(options, json.loads(options["queries"])) if "queries" in options else FilteredReader(options, None)


class RetrievalReader(DataSourceReader):
    def __init__(self, options: dict, queries: list[str] | None):
        self.options, self.queries = options, queries

    def partitions(self) -> list[InputPartition]:
        if self.queries is None:
            raise ValueError("which queries? give the option 'queries' or a filter on the column query")
        n = max(1, min(int(self.options.get("partitions", "4")), len(self.queries)))
        return [InputPartition(self.queries[i::n]) for i in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        timeouts = tuple(float(t) for t in self.options.get("timeouts", ",".join(map(str, SEARCH_TIMEOUTS))).split(","))
        endpoint = Endpoint(self.options["url"], timeouts=timeouts, first_wait=float(self.options.get("wait", "1")))
        one = partial(retrieve_one, endpoint, top_k=int(self.options.get("top_k", "10")))
        with ThreadPoolExecutor(endpoint.workers) as pool:
            for query, (found, error) in zip(partition.value, pool.map(one, partition.value), strict=True):
                yield from ((query, n, *r, None) for n, r in enumerate(found, 1))
                if not found:
                    yield (query, None, None, None, None, error)


class FilteredReader(RetrievalReader):
    """Asks the queries that a filter names. Spark refuses a reader that takes filters while they aren't pushed down."""

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            named = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if named is not None and f.attribute == ("query",):
                self.queries = [q for q in dict.fromkeys(named if self.queries is None else self.queries) if q in named]
            yield f  # still applied to what comes back
