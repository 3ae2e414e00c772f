"""Scans of chat exports and text trees, with bad files set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import tables

#: Fixed names of an export's media fields.
MEDIA = ("photo", "file", "video", "animation", "sticker", "voice", "video_message", "audio")
MESSAGE = f"struct<id: bigint, type: string, date: string, from_id: string, actor_id: string, text: variant, {', '.join(f'{x}: variant' for x in MEDIA)}>"
CHAT = f"struct<id: bigint, name: string, type: string, messages: array<{MESSAGE}>>"


def flat_text(v: Column) -> Column:
    """Rich text: a string as it is; of a list the strings and the ``text`` of its objects, joined; stripped."""
    parts = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), F.lit("")))
    whole = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return T.strip(F.coalesce(F.array_join(parts, ""), whole, F.lit("")))


def chat_exports(spark: SparkSession, path: str, glob: str = "result.json") -> tuple[DataFrame, DataFrame]:
    """(messages, quarantine): one row for each message of both layouts, with its places; files and chats that cannot be read with a reason.

    A file is set aside if it is no JSON or no export, a chat if its messages do not have the types of an export.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    several = F.try_variant_get("v", "$.chats.list", "array<variant>")
    single = F.when(F.try_variant_get("v", "$.messages", "variant").isNotNull(), F.array(F.col("v")))
    chats = files.select("path", F.col("v").isNotNull().alias("is_json"), F.coalesce(several, single).alias("chats"))
    each = chats.where("chats is not null").select("path", F.posexplode("chats").alias("chat_pos", "c")).withColumn("chat", F.try_variant_get("c", "$", CHAT))
    messages = each.where("chat.messages is not null").select("path", "chat_pos", F.coalesce("chat.name", F.lit("unknown")).alias("chat_name"), F.coalesce("chat.type", F.lit("unknown")).alias("chat_type"), F.posexplode("chat.messages").alias("msg_pos", "m"))
    media = [F.col(f"m.{x}") for x in MEDIA]
    text = flat_text(F.col("m.text"))
    out = messages.select("path", "chat_pos", "chat_name", "chat_type", "msg_pos", "m.id", "m.type", "m.date", F.coalesce("m.from_id", "m.actor_id").alias("author"), text.alias("text"), T.is_media_only(text, *media).alias("media_only"))
    reason = F.when(~F.col("is_json"), "not JSON").otherwise("no export")
    bad = chats.where("chats is null").select("path", F.lit(None).cast("int").alias("chat_pos"), reason.alias("reason"))
    no_list = F.try_variant_get("c", "$.messages", "variant").isNull()
    broken = each.where(F.col("chat.messages").isNull() & ~no_list).select("path", "chat_pos", F.lit("messages of other types").alias("reason"))
    return out, bad.unionByName(broken)


def cleaned_chats(messages: DataFrame, owner: str) -> DataFrame:
    """The cleaning job over messages of ``chat_exports``: the owner's, without media-only and noise ones, the first of equal texts by place, with content_hash, char_count and kind."""
    mine = T.is_owned(F.struct("type", "author", "chat_type"), owner)
    kept = messages.where(mine & ~F.col("media_only") & ~T.is_noise(F.col("text"))).withColumn("content_hash", F.sha2("text", 256))
    once = tables.first_of(kept, ["content_hash"], [F.col("path"), F.col("chat_pos"), F.col("msg_pos")])
    return once.withColumn("char_count", F.length("text")).withColumn("kind", F.when(F.col("chat_type") == "public_channel", "posts").otherwise("chats"))


def corpus_stats(messages: DataFrame, chat: str = "chat_name", kind: str = "kind", text: str = "text", most: int = 15) -> DataFrame:
    """Messages, characters and the ``most`` chats with most messages of each kind and of ``all``; of chats with as many, the first by name."""
    by_chat = messages.groupBy(kind, chat).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("chars"))
    both = by_chat.unionByName(by_chat.groupBy(chat).agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).withColumn(kind, F.lit("all")))
    w = Window.partitionBy(kind).orderBy(F.desc("n"), chat)
    ranked = both.withColumn("rank", F.row_number().over(w))
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", F.col(chat).alias("chat"), F.col("n").alias("messages")))))
    return ranked.groupBy(kind).agg(F.sum("n").alias("message_count"), F.sum("chars").alias("total_characters"), F.transform(top, lambda x: F.struct(x["chat"].alias("chat"), x["messages"].alias("messages"))).alias("top_chats"))


#: Folder names that tell a category, in order.
FOLDERS, OTHER_FOLDER = ("islam", "finance"), "it"


def text_tree(spark: SparkSession, path: str, glob: str = "*.md", excluded: list[str] | None = None, by_name: bool = False) -> DataFrame:
    """path, source_book (stem, underscores as spaces), category, content and a status: ``empty``, ``excluded`` (a pattern is in the file's name) or ``ok``.

    The category comes from the path's folders, or with ``by_name`` from keywords in the book's name.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))
    parts = F.split(F.lower("path"), "/")
    book = F.replace(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit("_"), F.lit(" "))
    kind = T.category(book) if by_name else F.coalesce(*[F.when(F.array_contains(parts, x), x) for x in FOLDERS], F.lit(OTHER_FOLDER))
    status = F.when(T.is_excluded(F.col("name"), excluded or []), "excluded").when(T.strip(F.col("content")) == "", "empty").otherwise("ok")
    return files.select("path", book.alias("source_book"), kind.alias("category"), "content", status.alias("status"))


def replace_books(chunks: DataFrame, path: str) -> None:
    """Replace all chunks of the books in ``chunks`` and leave other books alone."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_book").parquet(path)


def json_items(spark: SparkSession, path: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(objects as variants, counts of what was skipped by file) of files that hold a list, or an object with the list under ``key``."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", f"$.{key}", "array<variant>"))
    rows = files.select("path", F.posexplode(items).alias("pos", "item"))
    is_object = F.schema_of_variant("item").startswith("OBJECT")
    return rows.where(is_object), rows.groupBy("path").agg(F.count_if(~is_object).alias("skipped"))


def write_corpus(messages: DataFrame, path: str) -> DataFrame:
    """Posts and chats in folders of their own under ``corpus``, both together being the whole table; the statistics under ``stats``, and as the result."""
    messages.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/corpus")
    corpus_stats(messages).write.mode("overwrite").json(f"{path}/stats")
    return messages.sparkSession.read.parquet(f"{path}/corpus")


def append_log(rows: DataFrame, path: str, summary: str = "summary", limit: int = 1000) -> None:
    rows.withColumn(summary, F.substring(summary, 1, limit)).write.mode("append").parquet(path)
