"""Tables of chunks, vectors and knowledge bases; a change is a new table, never an update in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from marlspike.scratch import Scratch


class StoreError(ValueError):
    """A change that the store refuses."""


class VectorTable:
    """Facade over a table (id, document_id, vector, sparse); every change returns a new facade."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def add(self, new: DataFrame) -> VectorTable:
        return VectorTable(self.rows.unionByName(new, allowMissingColumns=True))

    def delete(self, ids: DataFrame) -> tuple[VectorTable, int]:
        gone = self.rows.join(ids.select("id").distinct(), "id", "left_semi").count()
        return VectorTable(self.rows.join(ids.select("id").distinct(), "id", "left_anti")), gone

    def update(self, new: DataFrame) -> VectorTable:
        return VectorTable(upsert_vectors(self.rows, new))

    def ids(self) -> DataFrame:
        return self.rows.select("id")

    def total(self) -> int:
        return self.rows.count()

    def of_documents(self, documents: DataFrame) -> DataFrame:
        return self.rows.join(documents.select("document_id").distinct(), "document_id", "left_semi")

    def as_retriever(self, k: int = 3, metric: str = "ip", documents: DataFrame | None = None):
        from marlspike.operators.search import dense_topk

        rows = self.rows if documents is None else self.of_documents(documents)
        return lambda queries: dense_topk(queries, rows.select("id", F.col("vector").alias("v")), k, metric)

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)


def upsert_vectors(rows: DataFrame, new: DataFrame, check: bool = True) -> DataFrame:
    """Rows with the columns of ``new`` (by id) put over theirs; a null there keeps the old value.

    Unknown and repeated ids are refused.
    """
    if check:
        if not new.groupBy("id").count().where("count > 1").isEmpty():
            raise StoreError("an id is given twice")
        if not new.join(rows, "id", "left_anti").isEmpty():
            raise StoreError("an id is unknown")
    changed = [c for c in new.columns if c != "id"]
    given = new.select("id", *[F.col(c).alias(f"__{c}") for c in changed])
    joined = rows.join(given, "id", "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in changed}).select(*rows.columns)


def numbered(rows: DataFrame, order: list[str], start: int = 0, name: str = "number") -> DataFrame:
    """Rows with consecutive numbers after ``start`` in the order of columns that tell them apart.

    Rows are dealt by range and counted in their partitions, so that no task sorts them all.
    """
    scratch = Scratch(rows.sparkSession, "numbers")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id()
    placed = scratch.save(dealt.withColumns({"__part": F.spark_partition_id(), "__at": local.bitwiseAND(F.lit((1 << 33) - 1))}), "placed")
    counts = placed.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))  # a row for each partition
    return placed.join(offsets, "__part").withColumn(name, (F.col("__before") + F.col("__at") + (start + 1)).cast("long")).drop("__part", "__at", "__before")


def add_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """New chunks (document_id, pos, ...) with ids after the greatest there is, in order of document and place."""
    top = chunks.agg(F.coalesce(F.max("chunk_id"), F.lit(0))).first()[0]
    made = numbered(new, ["document_id", "pos"], top, "chunk_id")
    return chunks.unionByName(made.select(*chunks.columns))


def delete_chunks(chunks: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks left, and the ids of those that went."""
    ids = documents.select("document_id").distinct()
    return chunks.join(ids, "document_id", "left_anti"), chunks.join(ids, "document_id", "left_semi").select("chunk_id")


def lookup(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of ids (chunk_id); those that don't exist drop out."""
    return ids.join(chunks, "chunk_id")


def update_texts(chunks: DataFrame, texts: DataFrame, check: bool = True) -> DataFrame:
    """Chunks with the texts (chunk_id, chunk_content) put in place of theirs. An id given twice or without a text is refused."""
    given = texts.select("chunk_id", F.col("chunk_content").alias("__text"))
    if check:
        if not given.where("chunk_id is null or __text is null").isEmpty():
            raise StoreError("ids and texts don't pair up")
        if not given.groupBy("chunk_id").count().where("count > 1").isEmpty():
            raise StoreError("an id is given twice")
    return chunks.join(given, "chunk_id", "left").withColumn("chunk_content", F.coalesce("__text", "chunk_content")).select(*chunks.columns)


def accordance(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids that only one of the two stores has: id, missing_in."""
    a, b = chunks.select(F.col("chunk_id").alias("id")).distinct().withColumn("c", F.lit(1)), vectors.select("id").distinct().withColumn("v", F.lit(1))
    return a.join(b, "id", "full_outer").where("c is null or v is null").select("id", F.when(F.col("c").isNull(), "chunks").otherwise("vectors").alias("missing_in"))


def visible_documents(members: DataFrame, registry: DataFrame, admin_only: bool = False) -> DataFrame:
    """(user_id, knowledge_id, document_name) of documents in knowledge bases a user belongs to, or administers."""
    own = members.where("role = 'admin'") if admin_only else members
    return own.select("user_id", "knowledge_id").distinct().join(registry.select("knowledge_id", "document_name"), "knowledge_id").select("user_id", "knowledge_id", "document_name")


def add_documents(members: DataFrame, registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """The registry with those documents wanted (user_id, knowledge_id, document_name) that an admin asks for and that are new."""
    admins = members.where("role = 'admin'").select("knowledge_id", "user_id").distinct()
    allowed = wanted.join(admins, ["knowledge_id", "user_id"], "left_semi").select("knowledge_id", "document_name").distinct()
    return registry.unionByName(allowed.join(registry, ["knowledge_id", "document_name"], "left_anti"), allowMissingColumns=True)


def create_knowledge(members: DataFrame, name: str, user: str, role: str = "admin") -> DataFrame:
    """Attaches the user to the base of that name, which is made with the next id if there is none."""
    spark = members.sparkSession
    row = members.where(F.col("knowledge_name") == name).agg(F.min("knowledge_id")).first()[0]
    known = row is not None
    number = row if known else members.agg(F.coalesce(F.max("knowledge_id"), F.lit(0)) + 1).first()[0]
    if known and not members.where((F.col("knowledge_name") == name) & (F.col("user_id") == user)).isEmpty():
        raise StoreError(f"{user} already belongs to {name}")
    return members.unionByName(spark.createDataFrame([(number, name, user, role)], "knowledge_id long, knowledge_name string, user_id string, role string"), allowMissingColumns=True)


def detach_user(members: DataFrame, name: str, user: str) -> DataFrame:
    own = (F.col("knowledge_name") == name) & (F.col("user_id") == user)
    if members.where(own).isEmpty():
        raise StoreError(f"{user} doesn't belong to {name}")
    if members.where((F.col("knowledge_name") == name) & (F.col("user_id") != user)).isEmpty():
        raise StoreError(f"{user} is the last member of {name}")
    return members.where(~own)


def user_roles(members: DataFrame) -> DataFrame:
    return members.groupBy("knowledge_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("user_id", "role")))).alias("roles"))
