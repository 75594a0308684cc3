"""Splitters of texts into chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SEPARATORS = ("\n\n", "\n", " ", "")


def recursive(text: str, size: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that does; neighbours share up to ``overlap``."""
    chosen = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(chosen) + 1 :] if chosen in separators else ()
    parts = list(text) if chosen == "" else [p for p in text.split(chosen) if p]
    out: list[str] = []
    held: list[str] = []
    length = lambda xs: sum(map(len, xs)) + len(chosen) * max(len(xs) - 1, 0)

    def flush() -> None:
        if held and (joined := chosen.join(held).strip()):
            out.append(joined)

    for part in parts:
        if len(part) > size:
            flush()
            held.clear()
            out += recursive(part, size, overlap, finer or ("",))
            continue
        if held and length([*held, part]) > size:
            flush()
            while held and (length(held) > overlap or length([*held, part]) > size):
                del held[0]
        held.append(part)
    flush()
    return out


_HEADER = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")


def sections(text: str, levels: int) -> list[tuple[tuple[tuple[int, str], ...], str]]:
    """(headers above, body) of a Markdown text cut at headers down to a level; fenced code isn't looked into."""
    out: list[tuple[tuple[tuple[int, str], ...], str]] = []
    path: list[tuple[int, str]] = []
    body: list[str] = []
    fenced = False

    def close() -> None:
        joined = "\n".join(body).strip("\n")
        if joined.strip():
            out.append((tuple(path), joined))
        body.clear()

    for line in text.split("\n"):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        header = None if fenced else _HEADER.match(line)
        if header and len(header[1]) <= levels:
            close()
            path[:] = [h for h in path if h[0] < len(header[1])] + [(len(header[1]), header[2])]
        else:
            body.append(line)
    close()
    return out


def markdown(text: str, size: int, overlap: int = 0, levels: int = 3) -> list[str]:
    """A short text whole; else its sections, small neighbours merged, large ones cut, headers put before them."""
    if len(text) <= size:
        return [text]
    merged: list[tuple[tuple[tuple[int, str], ...], str]] = []
    for path, body in sections(text, levels):
        if merged and len(merged[-1][1]) + len(body) <= size:
            shared = tuple(h for h in merged[-1][0] if h in path)
            merged[-1] = shared, f"{merged[-1][1]}\n\n{body}"
        else:
            merged.append((path, body))
    out = []
    for path, body in merged:
        head = "".join(f"{'#' * n} {title}\n" for n, title in path)
        for piece in recursive(body, size, overlap) if len(body) > size else [body]:
            out.append(f"{head}\n{piece}" if head else piece)
    return out


def split(docs: DataFrame, id_: str, text: str, how: str = "recursive", **given) -> DataFrame:
    """(id, pos, chunk) of each document; null and empty texts give no chunk of the recursive splitter."""
    cut = {"recursive": recursive, "markdown": markdown}[how]
    kind = docs.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, chunks = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for pos, chunk in enumerate(cut(t or "", **given)):
                    ids.append(i)
                    places.append(pos)
                    chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(places, pa.int32()), pa.array(chunks, pa.string())], names=["id", "pos", "chunk"])

    return docs.select(id_, text).mapInArrow(run, f"id {kind}, pos int, chunk string")
