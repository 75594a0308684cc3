"""Knowledge bases: members, a registry of documents, their chunks and vectors, as four tables that change together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from marlspike.operators.store import StoreError, accordance, numbered
from marlspike.scratch import Scratch
from marlspike.sources.loaders import Loaders
from marlspike.sources.splitters import split

Embed = Callable[[Column], Column]
MEMBERS = "knowledge_id long, knowledge_name string, user_id string, role string"
REGISTRY = "knowledge_id long, document_id long, document_name string, file_path string"
CHUNKS = "chunk_id long, document_id long, document_name string, chunk_content string, chunk_metadata map<string,string>"
VECTORS = "id long, document_id long, vector array<double>, sparse map<string,double>"
ADMIN, MEMBER = "admin", "member"


def _top(rows: DataFrame, column: str) -> int:
    return rows.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]


@dataclass(frozen=True)
class KnowledgeBase:
    """One base among the tables; a change gives a new object over new tables, and the old one stays as it was."""

    name: str
    members: DataFrame
    registry: DataFrame
    chunks: DataFrame
    vectors: DataFrame

    @staticmethod
    def create(spark: SparkSession, name: str, user: str) -> KnowledgeBase:
        empty = lambda schema: spark.createDataFrame([], schema)
        return KnowledgeBase(name, spark.createDataFrame([(1, name, user, ADMIN)], MEMBERS), empty(REGISTRY), empty(CHUNKS), empty(VECTORS))

    def _number(self, user: str, admin: bool) -> int:
        own = self.members.where((F.col("knowledge_name") == self.name) & (F.col("user_id") == user))
        found = own.where(F.col("role") == ADMIN).first() if admin else own.first()
        if found is None:
            raise StoreError(f"{user} is no {'admin' if admin else 'member'} of {self.name}")
        return found["knowledge_id"]

    def documents(self, user: str) -> DataFrame:
        """The base's documents, for its members."""
        return self.registry.where(F.col("knowledge_id") == self._number(user, False))

    def exists(self, user: str, names: DataFrame) -> DataFrame:
        """Those of the names (document_name) that the base has."""
        return names.select("document_name").distinct().join(self.documents(user), "document_name", "left_semi")

    def accordance(self) -> DataFrame:
        """Ids that only chunks or only vectors have."""
        return accordance(self.chunks, self.vectors)

    def add_files(self, user: str, texts: DataFrame, dense: Embed | None = None, sparse: Embed | None = None) -> KnowledgeBase:
        """The base with new documents of texts (document_name, file_path, pos, page_content, metadata), embedded one or both ways.

        Documents are numbered by name and chunks by name and place, after the greatest numbers there
        are. Empty texts are left out. A name that the base has is refused.
        """
        if dense is None and sparse is None:
            raise StoreError("an embedding is needed, dense or sparse")
        number = self._number(user, True)
        if not self.exists(user, texts).isEmpty():
            raise StoreError("a document of that name is there already")
        filled = texts.where("page_content is not null and page_content <> ''")
        files = texts.groupBy("document_name").agg(F.min("file_path").alias("file_path"))
        files = numbered(files, ["document_name"], _top(self.registry, "document_id"), "document_id")
        entries = files.select(F.lit(number).cast("long").alias("knowledge_id"), "document_id", "document_name", "file_path")
        placed = numbered(filled.join(files.select("document_name", "document_id"), "document_name"), ["document_id", "pos"], _top(self.chunks, "chunk_id"), "chunk_id")
        chunks = placed.select("chunk_id", "document_id", "document_name", F.col("page_content").alias("chunk_content"), F.col("metadata").alias("chunk_metadata"))
        made = lambda f, kind: (f(F.col("page_content")) if f else F.lit(None)).cast(kind)
        vectors = placed.select(F.col("chunk_id").alias("id"), "document_id", made(dense, "array<double>").alias("vector"), made(sparse, "map<string,double>").alias("sparse"))
        return replace(self, registry=self.registry.unionByName(entries), chunks=self.chunks.unionByName(chunks), vectors=self.vectors.unionByName(vectors))

    def delete_files(self, user: str, names: DataFrame) -> tuple[KnowledgeBase, DataFrame]:
        """The base without documents of the names, their chunks and vectors; and per name found, chunks and vectors gone (document_name, found, chunks, vectors)."""
        number = self._number(user, True)
        asked = names.select("document_name").distinct()
        gone = self.registry.where(F.col("knowledge_id") == number).join(asked, "document_name", "left_semi").select("document_name", "document_id")
        count = lambda rows, n: rows.join(gone, "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias(n))
        report = asked.join(gone, "document_name", "left").join(count(self.chunks, "chunks"), "document_id", "left").join(count(self.vectors, "vectors"), "document_id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        report = report.select("document_name", F.col("document_id").isNotNull().alias("found"), zero("chunks"), zero("vectors"))
        ids = gone.select("document_id")
        left = {n: getattr(self, n).join(ids, "document_id", "left_anti").select(*getattr(self, n).columns) for n in ("registry", "chunks", "vectors")}
        return replace(self, **left), report

    def delete_all(self, user: str) -> KnowledgeBase:
        """The base without any document, and without members."""
        emptied, _ = self.delete_files(user, self.documents(user).select("document_name"))
        return replace(emptied, members=self.members.where(F.col("knowledge_name") != self.name))

    def upload(self, user: str, loaded: DataFrame, dense: Embed | None = None, sparse: Embed | None = None, force: bool = False, size: int = 1000, how: dict[str, str] | None = None) -> tuple[KnowledgeBase, DataFrame]:
        """The base with loaded files (path, page_content, metadata, error), split by file type; and the files that failed (path, error).

        Parts whose metadata has the type text are split, by the splitter that ``how`` names for the file
        type (recursive if none is named); others, images say, stay whole. A file that couldn't be read
        is reported and not added. A name that the base has is refused, or replaced with ``force``.
        """
        scratch = Scratch(loaded.sparkSession, "upload")
        name = F.element_at(F.split("path", "/"), -1)
        rows = scratch.save(loaded.withColumns({"document_name": name, "kind": F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)), "part": F.monotonically_increasing_id()}), "loaded")
        failed = rows.where("error is not null").select("path", "error")
        good = rows.join(failed.select("path").distinct(), "path", "left_anti")
        text = F.coalesce(F.col("metadata")["type"] == "text", F.lit(False))
        kinds = dict(how or {})
        pieces = None
        for splitter in sorted({"recursive", *kinds.values()}):
            own = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in kinds.items()], F.lit("recursive")) == splitter
            made = split(good.where(text & own).select("part", "page_content"), "part", "page_content", how=splitter, size=size)
            made = made.select(F.col("id").alias("part"), F.col("pos").alias("piece"), F.col("chunk").alias("page_content"))
            pieces = made if pieces is None else pieces.unionByName(made)
        whole = good.where(~text).select("part", F.lit(0).alias("piece"), "page_content")
        parts = pieces.unionByName(whole).join(good.select("part", "document_name", F.col("path").alias("file_path"), "metadata"), "part")
        texts = scratch.save(parts.select("document_name", "file_path", F.struct("part", "piece").alias("pos"), "page_content", "metadata"), "texts")
        base = self.delete_files(user, texts)[0] if force else self
        return base.add_files(user, texts, dense, sparse), failed


def upload_dir(base: KnowledgeBase, spark: SparkSession, user: str, path: str, loaders: Loaders, images: bool = False, **given) -> tuple[KnowledgeBase, DataFrame]:
    """The base with the files of a folder (not of folders in it) whose types are supported; and those left out or failed (path, error)."""
    files = spark.read.format("binaryFile").load(path).select("path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("kind"))
    known = F.col("kind").isin(*loaders.supported(images))
    loaded = loaders.load(spark, path).withColumn("kind", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))).where(known).drop("kind")
    base, failed = base.upload(user, loaded, how=loaders.splitters, **given)
    return base, failed.unionByName(files.where(~known).select("path", F.lit("no loader or splitter for the file's type").alias("error")))


class Collections:
    """Named tables under a folder: made, dropped, looked up, appended to and read again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        path, files = self._path(name)
        return files.exists(path)

    def create(self, name: str, schema: str, partition_by: str | None = None) -> None:
        if self.has(name):
            raise StoreError(f"there is a collection {name} already")
        writer = self.spark.createDataFrame([], schema).write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        path, files = self._path(name)
        if not files.exists(path):
            raise StoreError(f"there is no collection {name}")
        files.delete(path, True)

    def add(self, name: str, rows: DataFrame) -> None:
        if not self.has(name):
            raise StoreError(f"there is no collection {name}")
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")


def mixed(new: DataFrame, mode: str, dims: int | None = None) -> DataFrame:
    """Rows to add to a store of a mode (dense, sparse, hybrid), refused where a side that the mode needs is missing, or has another length than ``dims``."""
    needs = {"dense": ["vector"], "sparse": ["sparse"], "hybrid": ["vector", "sparse"]}[mode]
    missing = [c for c in needs if c not in new.columns]
    if missing:
        raise StoreError(f"a {mode} store needs {missing}")
    wrong = F.lit(False)
    for c in needs:
        wrong = wrong | F.col(c).isNull()
    if dims is not None and "vector" in needs:
        wrong = wrong | (F.size("vector") != dims)
    if not new.where(wrong).isEmpty():
        raise StoreError(f"a row has no {' or '.join(needs)}, or one of another length")
    return new
