"""File sources: watched folders, session logs, chat exports and note vaults, read by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import strip

EXTENSIONS = ["md", "txt", "json", "jsonl", "log"]
MESSAGE = "message struct<author: struct<role: string>, content: struct<parts: array<string>>>, parent string, children array<string>"


def watched(spark: SparkSession, path: str, since: str | None = None, extensions: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """(source_id, content, timestamp, content_type) of files changed strictly after ``since``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rows = files.where(kind.isin(extensions or EXTENSIONS))
    rows = rows.where(F.col("modificationTime") > F.lit(since).cast("timestamp")) if since else rows
    types = F.when(kind.isin("json", "jsonl"), "conversation").when(kind == "log", "note").otherwise("document")
    return rows.select(F.concat(F.lit("file:"), F.element_at(F.split("path", "/"), -1)).alias("source_id"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("timestamp"), types.alias("content_type"))


def transcript(lines: DataFrame, session: str, line: str, order: str) -> DataFrame:
    """(session, content, turns): JSON lines of user and assistant turns as one text; other lines are left out."""
    parsed = lines.select(session, order, F.from_json(line, "type string, role string, content string, payload struct<type: string, role: string, content: string>").alias("j"))
    role = F.coalesce("j.payload.role", "j.role", "j.type")
    text = F.coalesce("j.payload.content", "j.content")
    said = F.when(role.isin("human", "user"), "User").when(role.isin("ai", "assistant"), "Assistant")
    rows = parsed.select(session, F.struct(F.col(order).alias("o"), F.concat(said, F.lit(": "), text).alias("t")).alias("r")).where("r.t is not null")
    return rows.groupBy(session).agg(F.array_sort(F.collect_list("r")).alias("rows")).select(session, F.array_join(F.col("rows.t"), "\n").alias("content"), F.size("rows").cast("long").alias("turns"))


def chat_messages(exports: DataFrame, id_col: str, mapping: str) -> DataFrame:
    """(conversation, message, parent, role, node_type, text) of exported message trees."""
    entries = exports.select(F.col(id_col).alias("conversation"), F.explode(F.from_json(mapping, f"map<string, struct<{_typed(MESSAGE)}>>")).alias("message", "m"))
    kind = F.when(F.col("role") == "user", "fact").when(F.col("role") == "assistant", "topic").when(F.col("role").isin("system", "tool"), "context").otherwise("fact")
    rows = entries.select("conversation", "message", F.col("m.parent").alias("parent"), F.col("m.message.author.role").alias("role"), F.array_join("m.message.content.parts", "\n").alias("text"))
    return rows.where("role is not null").withColumn("node_type", kind)


def chat_edges(messages: DataFrame) -> DataFrame:
    """(conversation, source, target, edge_type, weight): replies follow their parents; roots are mentioned by the context."""
    known = messages.select("conversation", F.col("message").alias("parent"), F.lit(True).alias("__known"))
    joined = messages.join(known, ["conversation", "parent"], "left")
    follows = joined.where("__known").select("conversation", F.col("parent").alias("source"), F.col("message").alias("target"), F.lit("followed_by").alias("edge_type"), F.lit(0.9).alias("weight"))
    roots = joined.where("__known is null").select("conversation", F.concat(F.lit("context:"), "conversation").alias("source"), F.col("message").alias("target"), F.lit("mentioned_by").alias("edge_type"), F.lit(0.8).alias("weight"))
    return follows.unionByName(roots)


def _typed(ddl: str) -> str:
    return ddl.replace("message struct", "message: struct").replace("parent string", "parent: string").replace("children array", "children: array")


def chunks(notes: DataFrame, path: str, content: str) -> DataFrame:
    """(path, i, heading, body): a note's preamble and its sections, empty ones left out."""
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(content, r"(?s)^---\n.*?\n---\n", "")), r"\n(?=#{1,6} )")
    rows = notes.select(path, F.posexplode(parts).alias("i", "part"))
    rows = rows.select(path, "i", F.regexp_extract("part", r"^#{1,6} +([^\n]*)", 1).alias("heading"), strip(F.regexp_replace("part", r"^#{1,6} [^\n]*\n?", "")).alias("body"))
    return rows.where("heading <> '' or body <> ''")


def links(content: Column) -> Column:
    """Targets of double-bracket links, and tags."""
    targets = F.transform(F.regexp_extract_all(content, F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), lambda t: strip(t))
    tags = F.regexp_extract_all(content, F.lit(r"(?:^|\s)#([A-Za-z][\w/-]*)"), F.lit(1))
    return F.array_sort(F.array_union(targets, tags))


def since_cursor(rows: DataFrame, cursors: DataFrame, source: str, at: str) -> DataFrame:
    """Rows strictly newer than their source's cursor; a source without one starts at the beginning."""
    return rows.join(cursors.select(source, F.col("cursor").alias("__c")), source, "left").where(F.col("__c").isNull() | (F.col(at) > F.col("__c"))).drop("__c")
