"""Main text of pages with a style tree for each site.

The block elements of a host's pages are merged by path, tag and style names from the root down. Of
each merged node two things are measured over the pages that hold it: how much the layouts of its
children vary (entropy of the styles, l of them), and how much its text varies: a text found on k of
the node's m pages has entropy log(k) / log(m), and the content's importance is the mean of 1 minus
that over the texts beneath. Importance is (1 - g^l) * layout + g^l * content. A branch of low
importance is cut from every page.

Entropy alone can't tell a menu of links that differ on every page from text, and takes an article
that many pages repeat for furniture. So names have their say as well: menus, footers, asides, forms
and elements named as such are cut and don't count in the tree, and article and main elements weigh:
one with text is never cut for its entropy, nor what it lies in, and inside it a branch is cut only
where its importance is low beside that of the article or main element, so that an article which many
pages repeat stays whole. All other text of a page stays, beside its articles as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marlspike.llm.common import bounded, table, text_slices
from marlspike.llm.html import Node, blocks, number
from marlspike.scratch import Scratch

LOW, DECAY, PRIOR, SALTS = 0.2, 0.9, 1.0, 64
#: An element that lies further above a text than this isn't judged by it, which leaves it standing.
REACH = 128
_FEATURES = "host string, page long, path long, mark long, style long, text long"
_NAMES = ("host", "page", "path", "mark", "style", "text")


def _landmark(node: Node | None) -> Node | None:
    """The article or main element that the node is or lies in, the innermost of more."""
    return None if node is None else node.mark


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node path of a page with its layout and the landmark above it, and for each text beneath it, without furniture by name."""
    for batch in batches:
        for lo, hi in text_slices(batch, "html"):
            part, rows = batch.slice(lo, hi - lo), []
            for host, page, html in zip(part.column("host").to_pylist(), part.column("page").to_pylist(), part.column("html").to_pylist(), strict=True):
                nodes, found = blocks(html)
                layouts: dict[int, list[str]] = {}
                marks: dict[int, int | None] = {}
                for node in nodes[1:]:
                    if not node.noise:
                        mark = _landmark(node.parent)
                        marks[node.path] = mark.path if mark else None
                        layouts.setdefault(node.path, []).append(" ".join(c for i, c in enumerate(node.children) if i == 0 or c != node.children[i - 1]))
                rows += [(host, page, p, marks[p], number("|".join(dict.fromkeys(x))), None) for p, x in layouts.items()]
                texts: set[tuple[int, int]] = set()
                for block in found:
                    node, told, steps = None if block.node.noise else block.node, number(block.text), 0
                    while node is not None and node.parent is not None and steps < REACH:
                        texts.add((node.path, told))
                        node, steps = node.parent, steps + 1
                rows += [(host, page, p, None, None, t) for p, t in texts]
            if rows:
                types = (pa.string(), *[pa.int64()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_NAMES)


def importance(features: DataFrame, decay: float = DECAY, prior: float = PRIOR) -> DataFrame:
    """host, path, mark, pages, importance of each node of the style trees; mark is the path of the landmark above.

    On few pages text that all of them share may be furniture or near copies of one page. So the
    importance is a mean with ``prior`` pages on which everything is important: (m * i + prior) / (m + prior).
    """
    layouts = features.where("style is not null").groupBy("host", "path", "style").agg(F.count("*").alias("n"), F.min("mark").alias("mark"))
    pages = layouts.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.min("mark").alias("mark"), F.count("*").alias("l"), F.sum(F.col("n") * F.log("n")).alias("n_log_n"))
    # -sum(p log p) = log(m) - sum(n log n) / m, to the base m
    layout = F.when(F.col("pages") > 1, 1 - F.col("n_log_n") / F.col("pages") / F.log("pages")).otherwise(1.0)
    pages = pages.select("host", "path", "mark", "pages", "l", layout.alias("layout"))
    texts = features.where("text is not null").groupBy("host", "path", "text").agg(F.count("*").alias("k"))
    heard = texts.groupBy("host", "path").agg(F.avg(F.log("k")).alias("mean_log_k"))
    content = F.when(F.col("pages") > 1, 1 - F.coalesce("mean_log_k", F.lit(0.0)) / F.log("pages")).otherwise(1.0)
    faded = F.pow(F.lit(decay), F.col("l"))
    out = pages.join(heard, ["host", "path"], "left")
    measured = (1 - faded) * F.col("layout") + faded * content
    return out.select("host", "path", "mark", "pages", ((F.col("pages") * measured + prior) / (F.col("pages") + prior)).alias("importance"))


def main_text(html: str | None, low: frozenset[int] = frozenset()) -> str:
    """The page's main text without furniture and without branches whose path is in ``low``.

    If the entropies would leave nothing of the page they don't count: then its host's pages are all alike.
    """
    nodes, found = blocks(html)
    bearing: set[int] = set()  # landmarks with text and what they lie in; an entropy cut would take it along
    for block in found:
        node = _landmark(block.node) if not block.node.noise else None
        while node is not None and id(node) not in bearing:
            bearing.add(id(node))
            node = node.parent
    cut: set[int] = set()
    for node in nodes[1:]:  # parents come first
        if id(node.parent) in cut or (node.path in low and id(node) not in bearing):
            cut.add(id(node))
    own = [b for b in found if not b.node.noise]
    return "\n".join(b.text for b in [b for b in own if id(b.node) not in cut] or own)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in text_slices(batch, "html"):
            part = batch.slice(lo, hi - lo)
            texts = [main_text(h, frozenset(x or ())) for h, x in zip(part.column("html").to_pylist(), part.column("low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, low: float = LOW, prior: float = PRIOR) -> DataFrame:
    """For rows (page_id, url, html): page_id, url and the main text, one row for each row given.

    Text is empty where html is null or has none. Pages whose url is null or has no host share one style
    tree. Character references are decoded, white space inside a block becomes one space, blocks are
    joined by a line feed. Rows with equal page_id and html count as one page and get equal texts. Other
    columns aren't carried. An empty table gives no rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "html")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    keyed = bounded(pages).select("page_id", "url", "html", host.alias("host"), F.xxhash64("page_id", "html").alias("page"))
    features = scratch.save(keyed.select("host", "page", "html").mapInArrow(_features, _FEATURES), "features")
    tree = scratch.save(importance(features, prior=prior), "tree")
    marks = tree.select("host", F.col("path").alias("mark"), F.col("importance").alias("weight"))
    weighed = tree.where(F.col("importance") < low).join(marks, ["host", "mark"], "left")
    cut = weighed.where(F.col("importance") < low * F.coalesce("weight", F.lit(1.0))).select("host", "path")
    # a node of a large host lies on all its pages: these are dealt by page as well
    cut = cut.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    held = features.where("style is not null").select("host", "page", "path", F.pmod("page", F.lit(SALTS)).alias("salt"))
    flagged = held.join(cut, ["host", "path", "salt"], "left_semi").groupBy("page").agg(F.collect_set("path").alias("low"))
    return keyed.join(flagged, "page", "left").select("page_id", "url", "html", "low").mapInArrow(_extract, "page_id long, url string, text string")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op6_html_extraction": op6_html_extraction}
SQL: dict[str, str] = {}
