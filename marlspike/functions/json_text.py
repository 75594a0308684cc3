"""JSON as models and services write it: found in prose, repaired, taken apart."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from marlspike.functions.text import json_tail

#: Fixed names of keys that hold lists of records, of their contents, titles and ids, in order of precedence.
CONTAINER_KEYS = ("chunks", "chunk_list", "data", "results", "docs", "documents", "passages", "items", "records", "hits")
CONTENT_KEYS = ("contents", "content", "text", "snippet", "passage", "chunk_text", "body", "document", "document_text")
TITLE_KEYS = ("title", "name", "doc_title", "article_title")
ID_KEYS = ("doc_id", "id", "chunk_id", "document_id", "passage_id")
DEFAULT_ID = "graph_chunk"
#: Fixed key names of extracted relations; a record ends with its last key.
ENTITY_KEYS, EVENT_KEYS, MEMBER_KEYS = ("头实体", "关系", "尾实体"), ("头事件", "关系", "尾事件"), ("事件", "实体")


def json_like(text: Column, marker: str = "") -> Column:
    """From the first [ to the last ] after the last marker; all that follows the marker where there's no such pair; "" without a marker."""
    rest = F.element_at(F.split(text, f"\\Q{marker}\\E"), -1) if marker else text
    found = json_tail(rest)
    out = F.when(found != "", found).otherwise(rest)
    return F.when(text.contains(marker), out).otherwise("") if marker else out


def normalised_json(text: Column, blanks: bool = False, quotes: bool = False) -> Column:
    """Trimmed, without line breaks and tabs, or without any blank; single quotes become double ones if asked."""
    out = F.regexp_replace(F.trim(text), r"\s+" if blanks else r"[\n\r\t]", "")
    return F.replace(out, F.lit("'"), F.lit('"')) if quotes else out


def rebuilt_records(text: Column, keys: tuple[str, ...]) -> Column:
    """Maps of quoted values of the keys, as they come; the last key ends a record, and what has no end is left out."""
    pattern = rf""""({'|'.join(keys)})":\s*("[^"]*"|'[^']*')"""
    names, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    pairs = F.zip_with(names, values, lambda k, v: F.struct(k.alias("k"), F.substring(v, F.lit(2), F.length(v) - 2).alias("v")))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    start = F.struct(empty.alias("now"), F.array().cast("array<map<string,string>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        grown = F.map_concat(F.map_filter(s["now"], lambda k, _: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"])))
        last = p["k"] == keys[-1]
        return F.struct(F.when(last, empty).otherwise(grown).alias("now"), F.when(last, F.concat(s["out"], F.array(grown))).otherwise(s["out"]).alias("out"))

    return F.aggregate(pairs, start, step, lambda s: s["out"])


def rebuilt_members(text: Column) -> Column:
    """Structs (event, entities) of records whose entities are a list; events and lists pair up in order."""
    event, entity = MEMBER_KEYS
    events = F.regexp_extract_all(text, F.lit(rf""""{event}":\s*("[^"]*"|'[^']*')"""), F.lit(1))
    lists = F.regexp_extract_all(text, F.lit(rf'"{entity}":\s*\[([^,\[\]]*(?:,[^,\[\]]*)*)\]'), F.lit(1))
    members = lambda x: F.filter(F.transform(F.split(x, ","), lambda e: F.btrim(F.btrim(F.trim(e), F.lit('"')), F.lit("'"))), lambda e: F.trim(e) != "")
    n = F.least(F.size(events), F.size(lists))
    return F.zip_with(F.slice(events, 1, n), F.slice(lists, 1, n), lambda v, x: F.struct(F.substring(v, F.lit(2), F.length(v) - 2).alias("event"), members(x).alias("entities")))


def parsed_records(text: Column, keys: tuple[str, ...]) -> Column:
    """Maps of the records in a model's answer: as it stands, else normalised, else with quotes mended, else key by key; none at last."""
    of = "array<map<string,string>>"
    tail = json_like(text)
    attempts = [F.from_json(tail, of, {"mode": "PERMISSIVE"}), F.from_json(normalised_json(tail), of), F.from_json(normalised_json(tail, quotes=True), of)]
    # rows that don't parse are null or hold only null maps
    good = [F.when(F.exists(a, lambda m: m.isNotNull() & (F.size(m) > 0)), a) for a in attempts]
    rebuilt = rebuilt_records(normalised_json(text), keys)
    return F.coalesce(*good, F.when(F.size(rebuilt) > 0, rebuilt), F.array().cast(of))


def at_path(text: Column, path: list[str | int], default: str | None = None) -> Column:
    """The value at a path of keys and places, as text; the default where the path leads nowhere."""
    steps = "".join(f"[{x}]" if isinstance(x, int) else f"['{x}']" for x in path)
    return F.coalesce(F.get_json_object(text, f"${steps}"), F.lit(default))


def nodes(x: Any) -> list:
    if isinstance(x, list):
        return [n for item in x for n in nodes(item)]
    if isinstance(x, dict):
        for key in CONTAINER_KEYS:
            if isinstance(x.get(key), (list, dict)):
                return nodes(x[key])
    return [x] if x else []


def _first_text(x: Any) -> str:
    if isinstance(x, str):
        return x.strip()
    if isinstance(x, list):
        return "\n".join(t for t in map(_first_text, x) if t).strip()
    if isinstance(x, dict):
        return next((t for k in (*CONTENT_KEYS, *TITLE_KEYS) if (t := _first_text(x.get(k)))), "")
    return ""


def record(x: Any) -> dict[str, str]:
    if not isinstance(x, dict):
        return {"doc_id": DEFAULT_ID, "title": "", "contents": _first_text(x)}
    number = next((s for k in ID_KEYS if x.get(k) is not None and (s := str(x[k]).strip())), DEFAULT_ID)
    title = next((t for k in TITLE_KEYS if (t := _first_text(x.get(k)))), "")
    return {"doc_id": number, "title": title, "contents": _first_text(x)}


RECORD = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "title", "contents")]))


def service_records(text: Column) -> Column:
    """Records (doc_id, title, contents) of a service's answer, however deep its containers lie.

    Of an object with containers the first one by name is entered, all else of it is left aside. What
    isn't JSON is one record of its own text; null has none. Nesting has no schema, so this is an Arrow UDF.
    """

    @F.pandas_udf(RECORD)
    def run(answers: pd.Series) -> pd.Series:
        out = []
        for answer in answers:
            try:
                found = nodes(json.loads(answer)) if answer is not None else []
            except ValueError:
                found = [answer] if answer.strip() else []
            out.append([record(x) for x in found])
        return pd.Series(out)

    return run(text)


def qa_pairs(text: Column, n: int) -> Column:
    """Map of question to passage from generated "Qi:" items with a passage label; none if fewer than n have it, else of the first n.

    Of equal questions the last one's passage stays; an item with two labels is left out.
    """
    label = r"参考段落[:：]"
    items = F.filter(F.transform(F.split(text, r"Q\d+[:：]"), lambda x: F.trim(x)), lambda x: x.rlike(label))
    chosen = F.transform(F.slice(items, 1, n), lambda x: F.split(F.replace(x, F.lit("\n"), F.lit("")), label))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    pairs = F.filter(F.when(F.size(items) >= n, chosen).otherwise(F.array().cast("array<array<string>>")), lambda p: F.size(p) == 2)
    return F.aggregate(pairs, empty, lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p[0]), F.map_from_arrays(F.array(p[0]), F.array(p[1]))))


def first_lines_within(text: Column, most: int, tokens=lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))) -> Column:
    """The text if it has at most ``most`` tokens, else its longest run of first lines, trimmed and not empty, that has; the first line at least."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    start = F.struct(F.lit(0).alias("held"), F.array().cast("array<string>").alias("kept"), F.lit(False).alias("full"))

    def step(s: Column, line: Column) -> Column:
        held = s["held"] + tokens(line)
        full = s["full"] | ((held > most) & (F.size(s["kept"]) > 0))
        return F.struct(held.alias("held"), F.when(full, s["kept"]).otherwise(F.concat(s["kept"], F.array(line))).alias("kept"), (full | (held > most)).alias("full"))

    return F.when(tokens(text) <= most, text).otherwise(F.aggregate(lines, start, step, lambda s: F.array_join(s["kept"], "\n")))


def any_of(found: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, found, F.lit(False))
