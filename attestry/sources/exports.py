"""Reading exports and files, and writing topic texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.operators.lineage import written
from attestry.sources import file_digests as D
from attestry.sources.json_lists import read_json_list

BLOCK = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])
MESSAGE = T.StructType(
    [
        T.StructField("uuid", T.StringType()),
        T.StructField("sender", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("content", T.ArrayType(BLOCK)),
    ]
)
CONVERSATION = T.StructType([T.StructField("uuid", T.StringType()), T.StructField("name", T.StringType()), T.StructField("created_at", T.StringType()), T.StructField("chat_messages", T.ArrayType(MESSAGE))])
MEMORIES = T.StructType(
    [
        T.StructField("conversations_memory", T.StringType()),
        T.StructField("memory_files", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.StringType()), T.StructField("updated_at", T.StringType())]))),
        T.StructField("project_memories", T.MapType(T.StringType(), T.StringType())),
    ]
)


def visible_blocks(content: Column, text: Column) -> Column:
    """Texts of a message that its reader sees: structured content decides where there is any, else the flat text."""
    return F.when(content.isNotNull(), F.transform(F.filter(content, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))).otherwise(F.array(F.coalesce(text, F.lit(""))))


def flatten_conversations(conversations: DataFrame) -> DataFrame:
    """(conversation_id, title, message_no, message_id, role, created_at, block_no, text): one row a visible block; a conversation without messages keeps a row."""
    m = conversations.select(F.col("uuid").alias("conversation_id"), F.substring("name", 1, 120).alias("title"), F.posexplode_outer("chat_messages").alias("message_no", "m"))
    role = F.when(F.col("m.sender") == "human", "user").when(F.col("m.sender") == "assistant", "assistant").when(F.col("m").isNotNull(), "external")
    rows = m.select("conversation_id", "title", "message_no", F.col("m.uuid").alias("message_id"), role.alias("role"), F.col("m.created_at").alias("created_at"), F.posexplode_outer(visible_blocks(F.col("m.content"), F.col("m.text"))).alias("block_no", "text"))
    return rows


def read_conversation_export(spark: SparkSession, path: str) -> DataFrame:
    """The visible blocks (see ``flatten_conversations``) of JSON files that hold a list of conversations each, read in parallel within a file too.

    An id that occurs more than once, or an element that is no conversation, refuses the whole export with a ``ValueError``.
    """
    raw = written(read_json_list(spark, path).select(F.from_json("text", CONVERSATION, {"mode": "PERMISSIVE"}).alias("c")).select("c.*"), "export")
    bad = raw.groupBy("uuid").agg(F.count("*").alias("n")).where("uuid is null or n > 1").select("uuid").take(5)
    if bad:
        raise ValueError(f"ids that are missing or not unique: {', '.join(str(b['uuid']) for b in bad)}")
    return flatten_conversations(raw)


def flatten_memories(df: DataFrame) -> DataFrame:
    """(key, text) of summary files, the one summary of all conversations, and the summaries of projects."""
    files = df.select(F.explode("memory_files").alias("f")).select(F.concat(F.lit("file:"), "f.path").alias("key"), F.col("f.content").alias("text"))
    whole = df.where("conversations_memory is not null").select(F.lit("conversations").alias("key"), F.col("conversations_memory").alias("text"))
    projects = df.select(F.explode("project_memories").alias("k", "text")).select(F.concat(F.lit("project:"), "k").alias("key"), "text")
    return files.unionByName(whole).unionByName(projects).where("trim(text) <> ''")


def scan_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, digest) of all files below a folder; contents are hashed where they are read, those of large files by many tasks (see ``file_digests``).

    Packed files (``PACKED``) are read whole whatever their size.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")

    def whole(rows: DataFrame) -> DataFrame:
        return rows.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))

    out = whole(files.where(size <= D.WHOLE))
    large = files.where(size > D.WHOLE).select("path", F.col("length").alias("size"), name.alias("file"), F.col("path").rlike(D.PACKED).alias("packed")).collect()
    digests = D.long_file_digests(spark, folder, {r.file: r.size for r in large if not r.packed})
    if digests:
        out = out.unionByName(spark.createDataFrame([(r.path, r.size, digests[r.file]) for r in large if r.file in digests], "path string, size long, digest string"))
    uncut = [r.file for r in large if r.file not in digests]
    return out.unionByName(whole(files.where(name.isin(uncut)))) if uncut else out


def batch_id(manifest: DataFrame) -> DataFrame:
    """One row: files, bytes, and a digest of the whole manifest."""
    from attestry.operators.aggregates import fingerprint

    one = fingerprint(manifest.withColumn("all", F.lit(1)), ["all"], "path", "size", "digest")
    return one.select(F.col("n").alias("files"), F.col("fingerprint").alias("batch_id")).crossJoin(manifest.agg(F.sum("size").alias("bytes")))


def load_table(spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def export_topics(topics: DataFrame, path: str) -> None:
    """One folder of text files for each owner, scope and slug; ``topics``: owner, scope, slug, text."""
    topics.select("owner", "scope", "slug", F.col("text").alias("value")).write.mode("overwrite").partitionBy("owner", "scope", "slug").text(path)
