"""Readers of files into rows (path, page_content, metadata), one parser for each file type.

Files are read by Spark's binaryFile source, so any store that Spark reads will do, and parsed on the
executors. A file that can't be parsed gives a row with its error instead of content.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marlspike.sources.pdf import pdf

Parser = Callable[[bytes], list[tuple[str, dict[str, str]]]]
SCHEMA = "path string, page_content string, metadata map<string,string>, error string"
MOST_BYTES = 100 * 1024 * 1024
MOST_UNPACKED = 10 * MOST_BYTES
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _unzip(data: bytes) -> zipfile.ZipFile:
    packed = zipfile.ZipFile(io.BytesIO(data))
    if sum(i.file_size for i in packed.infolist()) > MOST_UNPACKED:
        raise ValueError("the file unpacks to too much")
    return packed


def _text(node, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def docx(data: bytes) -> list[tuple[str, dict[str, str]]]:
    """Paragraphs and tables in body order; a table row reads header: value，header: value；"""
    body = ElementTree.fromstring(_unzip(data).read("word/document.xml")).find(f"{_W}body")
    parts = []
    for node in body:
        if node.tag == f"{_W}p" and (text := _text(node, f"{_W}t").strip()):
            parts.append(text)
        elif node.tag == f"{_W}tbl":
            rows = [[_text(c, f"{_W}t").strip() for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            if len(rows) > 1:
                parts.append("；".join("，".join(f"{h}: {v}" for h, v in zip(rows[0], row, strict=False)) for row in rows[1:]) + "。")
    return [("\n\n".join(parts), {"type": "text"})]


def _cells(sheet, shared: list[str]) -> dict[tuple[int, int], str]:
    out = {}
    for c in sheet.iter(f"{_S}c"):
        letters, row = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
        col = 0
        for ch in letters:
            col = col * 26 + ord(ch) - 64
        v = c.find(f"{_S}v")
        value = _text(c, f"{_S}t") if c.get("t") == "inlineStr" else "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
        out[int(row), col] = value or ""
    for merged in sheet.iter(f"{_S}mergeCell"):
        ends = [re.match(r"([A-Z]+)(\d+)", x).groups() for x in merged.get("ref").split(":")]
        (c1, r1), (c2, r2) = [(sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(a))), int(b)) for a, b in ends]
        for r in range(r1, r2 + 1):
            for c in range(c1, c2 + 1):
                out[r, c] = out.get((r1, c1), "")
    return out


def table_text(cells: dict[tuple[int, int], str]) -> str:
    """First row that isn't blank holds the titles; each further row reads title:value; and cells like 0 are left out."""
    rows = sorted({r for (r, _), v in cells.items() if v})
    if not rows:
        return ""
    titles = {c: v for (r, c), v in cells.items() if r == rows[0] and v}
    lines = []
    for r in rows[1:]:
        lines.append("".join(f"{t}:{cells[r, c]};" for c, t in sorted(titles.items()) if cells.get((r, c)) not in (None, "", "0", "False")))
    return "\n".join(x for x in lines if x)


def xlsx(data: bytes) -> list[tuple[str, dict[str, str]]]:
    packed = _unzip(data)
    names = packed.namelist()
    shared = [_text(x, f"{_S}t") for x in ElementTree.fromstring(packed.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    sheets = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
    return [(table_text(_cells(ElementTree.fromstring(packed.read(n)), shared)), {"sheet": n.rsplit("/", 1)[1]}) for n in sheets]


def pptx(data: bytes) -> list[tuple[str, dict[str, str]]]:
    packed = _unzip(data)
    slides = sorted((n for n in packed.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    pages = [[_text(p, f"{_A}t") for p in ElementTree.fromstring(packed.read(n)).iter(f"{_A}p")] for n in slides]
    return [(" ".join(t for t in page if t), {"type": "text", "slide": str(i + 1)}) for i, page in enumerate(pages)]


def plain(data: bytes) -> list[tuple[str, dict[str, str]]]:
    return [(data.decode("utf-8", errors="replace").removeprefix("﻿"), {"type": "text"})]


def image(data: bytes) -> list[tuple[str, dict[str, str]]]:
    import base64

    return [(base64.b64encode(data).decode(), {"type": "image"})]


def _table_cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def markdown_text(data: bytes) -> list[tuple[str, dict[str, str]]]:
    """Titles with as many # as they are deep, tables as header:value rows, paragraphs; images go."""
    lines = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", plain(data)[0][0]).split("\n")
    out: list[str] = []
    held: list[str] = []
    fenced = False

    def flush() -> None:
        if text := "\n".join(held).strip():
            out.append(text)
        held.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        after = lines[i + 1] if i + 1 < len(lines) else ""
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
            held.append(line)
        elif fenced:
            held.append(line)
        elif title := re.match(r" {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            flush()
            out.append(f"{title[1]} {title[2]}")
        elif line.strip() and not held and re.fullmatch(r" {0,3}(=+|-+)\s*", after):
            out.append(("# " if "=" in after else "## ") + line.strip())
            i += 1
        elif "|" in line and re.fullmatch(r"\s*\|?(\s*:?-+:?\s*\|)+\s*(:?-+:?)?\s*", after):
            flush()
            head, rows, i = _table_cells(line), [], i + 2
            while i < len(lines) and "|" in lines[i]:
                rows.append(",".join(f"{h}:{v}" for h, v in zip(head, _table_cells(lines[i]), strict=False)))
                i += 1
            out.append(";".join(rows) + "。")
            continue
        elif line.strip():
            held.append(line.rstrip())
        else:
            flush()
        i += 1
    flush()
    return [("\n\n".join(out), {"type": "text"})]


IMAGE_TYPES = (".png", ".jpg", ".jpeg")


class Loaders:
    """Parsers and splitters by file type; more can be registered, among them ones that call a service for OCR. Images have no splitter."""

    def __init__(self):
        self.splitters: dict[str, str] = dict.fromkeys((".docx", ".xlsx", ".pptx", ".pdf", ".txt", ".html", ".json"), "recursive") | {".md": "markdown"}
        self.parsers: dict[str, Parser] = {".docx": docx, ".xlsx": xlsx, ".pptx": pptx, ".pdf": pdf, ".txt": plain, ".md": markdown_text, ".html": plain, ".json": plain, ".png": image, ".jpg": image, ".jpeg": image}

    def register(self, parser: Parser, *types: str) -> None:
        for t in types:
            self.parsers[t.lower()] = parser

    def unregister(self, *types: str) -> None:
        for t in types:
            if t.lower() not in self.parsers:
                raise KeyError(t)
            del self.parsers[t.lower()]

    def register_splitter(self, how: str, *types: str) -> None:
        for t in types:
            if t.lower() in IMAGE_TYPES:
                raise ValueError(f"{t} files are images, which aren't split")
            self.splitters[t.lower()] = how

    def unregister_splitter(self, *types: str) -> None:
        for t in types:
            del self.splitters[t.lower()]

    def supported(self, images: bool = False) -> set[str]:
        """File types that can be uploaded: those with a parser and a splitter, or images with a parser."""
        return set(self.parsers) & (set(IMAGE_TYPES) if images else set(self.splitters))

    def load(self, spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
        """Every supported file of a folder (not of folders in it), or one file. One that is too long or can't be parsed has a row with its error."""
        files = spark.read.format("binaryFile").load(path)
        kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
        known = files.where(kind.isin(*self.parsers)).withColumn("kind", kind)
        parsed = known.where(F.col("length") <= most_bytes).select("path", "kind", "content").mapInArrow(_parse(dict(self.parsers)), SCHEMA)
        error = F.format_string(f"ValueError: %d bytes are more than {most_bytes}", F.col("length"))
        long = known.where(F.col("length") > most_bytes).select("path", F.lit(None).cast("string").alias("page_content"), F.create_map().cast("map<string,string>").alias("metadata"), error.alias("error"))
        return parsed.unionByName(long)


def _parse(parsers: dict[str, Parser]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, kind, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [(path, text, list(meta.items()), None) for text, meta in parsers[kind](content)]
                except Exception as e:  # a broken file is data, reported in its own row
                    rows.append((path, None, [], f"{type(e).__name__}: {e}"))
            types = (pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())
            columns = zip(zip(*rows, strict=True), types, strict=True) if rows else ((x, t) for x, t in zip(((),) * 4, types, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in columns], names=["path", "page_content", "metadata", "error"])

    return run


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(title, content) of Markdown files, without lines that embed images."""
    rows = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).withColumn("path", F.input_file_name())
    lines = F.filter(F.split("value", "\n"), lambda x: ~x.contains("data:image"))
    return rows.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("title"), F.array_join(lines, "\n").alias("content"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def eval_results(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(samples, summary) of a result file: an object with summary and results, or a list whose rows of type Summary sum up the others."""
    whole = spark.read.text(path, wholetext=True)
    first = whole.select(F.trim("value").startswith("{")).first()
    if first is not None and first[0]:
        held = whole.select(F.from_json("value", f"summary struct<{schema}>, results array<struct<{schema}>>").alias("x"))
        return held.select(F.explode("x.results").alias("r")).select("r.*"), held.where("x.summary is not null").select("x.summary.*")
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.where("type is null or type <> 'Summary'"), rows.where("type = 'Summary'").limit(1)


def retrieval_records(rows: DataFrame, column: str) -> DataFrame:
    """(doc_id, title, contents) of JSON objects, each from the first of its usual keys that isn't blank."""
    first = lambda keys: F.coalesce(*[F.nullif(F.trim(F.get_json_object(column, f"$.{k}")), F.lit("")) for k in keys])
    return rows.withColumns({"contents": F.coalesce(first(("contents", "content", "text", "page_content", "title")), F.lit("")), "title": F.coalesce(first(("title", "name")), F.lit("")), "doc_id": F.coalesce(first(("doc_id", "id", "chunk_id")), F.lit("graph_chunk"))})


def html_table_rows(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """(id, table_no, row_no, text) of HTML tables: the first row's cells head those of each further row."""
    cell = r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    tables = pages.select(F.col(id_).alias("id"), F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), 1)).alias("table_no", "t"))
    rows = tables.select("id", "table_no", F.regexp_extract_all("t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1).alias("rows"))
    rows = rows.select("id", "table_no", F.transform("rows", lambda r: F.transform(F.regexp_extract_all(r, F.lit(cell), 1), bare)).alias("rows"))
    body = rows.where("size(rows) > 1").select("id", "table_no", F.element_at("rows", 1).alias("head"), F.posexplode(F.slice("rows", 2, F.size("rows"))).alias("row_no", "cells"))
    return body.select("id", "table_no", "row_no", F.concat(F.array_join(F.zip_with("head", "cells", lambda h, c: F.concat_ws(":", h, c)), ","), F.lit(";")).alias("text"))
