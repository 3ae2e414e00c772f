"""Chat exports of any size, read by many tasks: a JSON file is cut wherever an object closes, whatever its layout.

Spark's text source with ``}`` for a line end splits a file and reads it from any file system. A task packs what it reads into runs of a few megabytes and notes what each does to the
stack of open brackets, once for a run that starts inside a string and once for one that does not. Composed along the file these say how each run really starts; only then are
messages cut out. Those that lie in one run pass straight on, the few others are put together from their fragments. A file that was cut off gives all its whole messages.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import scratch
from textloom.sources import exports

#: Characters of a run, about.
RUN = 4 << 20
#: Keys from the root down to a chat and to a message, in both layouts.
CHATS = [[""], ["", "chats", "list", ""]]
MESSAGES = [["", "messages", ""], ["", "chats", "list", "", "messages", ""]]
FIELDS = ("name", "type")

TOKEN = re.compile(r'"([^"\\]*(?:\\.[^"\\]*)*)("|\\?\Z)(\s*:)?|[{}\[\]]', re.S)
REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)

Stack = list[tuple[str, str]]


def _tokens(text: str, inside: bool) -> Iterator[re.Match]:
    """Brackets and strings of a run that starts inside a string or not; a string that it doesn't close ends with an empty second group."""
    rest = REST.match(text) if inside else None
    return TOKEN.finditer(text, rest.end() if rest else 0) if rest or not inside else iter(())


def _effect(text: str, inside: bool, place: str) -> str:
    """[brackets of before that close, keys and places of those that are left open, whether a string is] as JSON."""
    closed, opened, key, open_string = 0, [], "", inside and not REST.match(text)
    for m in _tokens(text, inside):
        t = m.group()
        if t[0] == '"':
            key = m.group(1) if m.group(3) else key
            open_string = m.group(2) != '"'
        elif t in "{[":
            opened.append((key, f"{place}{m.start():010x}"))
            key = ""
        else:
            key = ""
            if opened:
                opened.pop()
            else:
                closed += 1
    return json.dumps([closed, opened, open_string])


def _runs(segments: DataFrame, size: int) -> DataFrame:
    """Rows (path, block, size, value), as a split gives them, as rows path, size, place (sorts along the file), text, bytes and both effects."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held, chars, number = None, [], 0, 0

        def run() -> pa.RecordBatch:
            text = "}".join(held) + "}"
            place = f"{where[1]:016x}{number:08x}"
            own = [where[0], where[2], place, text, len(text.encode()), _effect(text, False, place), _effect(text, True, place)]
            return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(("path", "size", "place", "text", "bytes", "out", "in"), own, strict=True)})

        for b in batches:
            for row in b.to_pylist():
                here = row["path"], row["block"], row["size"]
                if held and (here != where or chars >= size):
                    yield run()
                    held, chars, number = [], 0, number + 1 if here == where else 0
                elif here != where:
                    number = 0
                where = here
                held.append(row["value"])
                chars += len(row["value"]) + 1
        if held:
            yield run()

    return segments.mapInArrow(pack, "path string, size long, place string, text string, bytes long, out string, in string")


def _starts(notes: pa.Table) -> pa.Table:
    """How each run of one file starts: ``inside`` a string, its ``stack``; whether the brace at its end is not in the file; of the last one, whether the file is ``whole``."""
    rows = sorted(notes.to_pylist(), key=lambda r: r["place"])
    extra = sum(r["bytes"] for r in rows) > rows[0]["size"] if rows else False
    inside, stack, below, out = False, [], 0, {"path": [], "place": [], "inside": [], "stack": [], "extra": [], "whole": []}
    for r in rows:
        for k, v in (("path", r["path"]), ("place", r["place"]), ("inside", inside), ("stack", json.dumps(stack)), ("extra", False), ("whole", None)):
            out[k].append(v)
        closed, opened, inside = json.loads(r["in" if inside else "out"])
        below += max(0, closed - len(stack))
        stack = stack[: max(0, len(stack) - closed)] + opened
    if rows:
        # A brace that Spark's lines don't tell from the end of the file closes one bracket too many.
        out["extra"][-1], out["whole"][-1] = extra, not stack and not inside and below == int(extra)
    types = {"path": pa.string(), "place": pa.string(), "inside": pa.bool_(), "stack": pa.string(), "extra": pa.bool_(), "whole": pa.bool_()}
    return pa.table({k: pa.array(v, types[k]) for k, v in out.items()})


def _cut(text: str, inside: bool, stack: Stack, place: str) -> Iterator[tuple]:
    """(chat, message, first, last, field, body) of a run: messages and fragments of messages, and fields of chats, which have no message."""
    keys = [k for k, _ in stack]
    depth = next((len(m) for m in MESSAGES if keys[: len(m)] == m), None)
    begun, first, key = 0, False, ""
    for m in _tokens(text, inside):
        t = m.group()
        if t[0] == '"':
            if m.group(3):
                key = m.group(1)
            elif key in FIELDS and depth is None and keys in CHATS and m.group(2):
                yield stack[-1][1], None, None, None, key, t
                key = ""
        elif t in "{[":
            keys.append(key)
            stack.append((key, f"{place}{m.start():010x}"))
            key = ""
            if depth is None and t == "{" and keys in MESSAGES:
                depth, begun, first = len(keys), m.start(), True
        elif stack:
            if len(stack) == depth:
                yield stack[-3][1], stack[-1][1], first, True, None, text[begun : m.end()]
                depth, first = None, False
            stack.pop()
            keys.pop()
            key = ""
    if depth is not None:
        yield stack[depth - 3][1], stack[depth - 1][1], first, False, None, text[begun:]


def _pieces(runs: DataFrame) -> DataFrame:
    schema = "path string, chat string, message string, first boolean, last boolean, field string, body string, place string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                text = r["text"][:-1] if r["extra"] else r["text"]
                found = list(_cut(text, r["inside"], [tuple(x) for x in json.loads(r["stack"])], r["place"]))
                cols = list(zip(*found, strict=True)) if found else [()] * 6
                types = [pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]
                same = [pa.array([r["path"]] * len(found), pa.string()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True)), pa.array([r["place"]] * len(found), pa.string())]
                yield pa.RecordBatch.from_arrays(same, [x.split()[0] for x in schema.split(", ")])

    return runs.select("path", "text", "place", "inside", "stack", "extra").mapInArrow(cut, schema)


def chat_exports(spark: SparkSession, path: str, glob: str = "result.json", run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """(messages, quarantine) as ``exports.chat_exports`` gives them, from files of any size: places are strings that sort along the file.

    Of a file that was cut off all messages that close are there, and the quarantine says so; no messages and no chats: no export. Messages that are
    not JSON are set aside one by one, and fields of other types than an export's are null. A chat without messages gives no row. A file with both layouts gives the messages of both. A chat's name that holds a ``}`` just where a run ends reads ``unknown``.
    A file's notes, some hundred bytes a run, pass through one task; its text doesn't.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "}").text(path)
    segments = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value")
    runs = scratch.written(_runs(segments, run), "export-runs")
    starts = runs.select("path", "size", "place", "bytes", "out", "in").groupBy("path").applyInArrow(_starts, "path string, place string, inside boolean, stack string, extra boolean, whole boolean")
    starts = scratch.written(starts, "export-starts")
    pieces = scratch.written(_pieces(runs.select("path", "place", "text").join(starts, ["path", "place"])), "export-pieces")
    whole = pieces.where("first and last").select("path", "chat", "message", "body")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "body"))), lambda x: x["body"])
    put = pieces.where("message is not null and not (first and last)").groupBy("path", "chat", "message").agg(F.array_join(parts, "").alias("body"), F.bool_or("last").alias("closed")).where("closed").drop("closed")
    named = pieces.where("field is not null").groupBy("path", "chat").agg(*[F.min(F.when(F.col("field") == x, F.try_variant_get(F.try_parse_json("body"), "$", "string"))).alias(f"chat_{x}") for x in FIELDS])
    every = whole.unionByName(put).withColumn("m", F.try_variant_get(F.try_parse_json("body"), "$", exports.MESSAGE))
    text = exports.flat_text(F.col("m.text"))
    out = every.where("m is not null").join(named, ["path", "chat"], "left").select("path", F.col("chat").alias("chat_pos"), *[F.coalesce(f"chat_{x}", F.lit("unknown")).alias(f"chat_{x}") for x in FIELDS], F.col("message").alias("msg_pos"), "m.id", "m.type", "m.date", F.coalesce("m.from_id", "m.actor_id").alias("author"), text.alias("text"), T.is_media_only(text, *[F.col(f"m.{x}") for x in exports.MEDIA]).alias("media_only"))
    seen = pieces.groupBy("path").agg(F.count("message").alias("n"))
    ends = starts.where("whole is not null").join(seen, "path", "left")
    reason = F.when(F.coalesce("n", F.lit(0)) == 0, "no export").otherwise("cut off")
    bad = ends.where(~F.col("whole") | (F.coalesce("n", F.lit(0)) == 0)).select("path", F.lit(None).cast("string").alias("chat_pos"), reason.alias("reason"))
    return out, bad.unionByName(every.where("m is null").select("path", F.col("chat").alias("chat_pos"), F.lit("message is not JSON").alias("reason")))


def write_exports(chats: DataFrame, path: str, chat: str, order: str, text: str, author: str, rows_a_file: int = 100_000) -> None:
    """Chats as exports under ``path``, of about ``rows_a_file`` messages and 8 at least, all chats of a file in one list: rows of one chat in ``order``, which becomes the id. Null texts are left out."""
    files = max(8, chats.count() // rows_a_file)
    message = F.to_json(F.struct(F.col(order).cast("long").alias("id"), F.lit("message").alias("type"), F.col(author).cast("string").alias("from_id"), F.col(text).alias("text")))
    rows = chats.select(F.pmod(F.xxhash64(chat), F.lit(files)).alias("file"), F.col(chat).cast("string").alias("chat"), F.col(order).alias("at"), message.alias("message"))
    one = rows.groupBy("file", "chat").agg(F.max("at").alias("last"), F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    first = one.withColumn("head", F.row_number().over(Window.partitionBy("file").orderBy("chat")) == 1)
    head = F.concat(F.when(F.col("head"), '{"chats": {"list": [').otherwise("]},"), F.lit('{"name": '), F.to_json(F.array("chat")).substr(F.lit(2), F.length(F.to_json(F.array("chat"))) - 2), F.lit(', "type": "personal_chat", "messages": ['))
    heads = first.select("file", "chat", F.lit(0).alias("part"), F.col("start").alias("at"), head.alias("value"))
    body = rows.join(one.select("file", "chat", "last"), ["file", "chat"]).select("file", "chat", F.lit(1).alias("part"), "at", F.concat("message", F.when(F.col("at") == F.col("last"), "").otherwise(",")).alias("value"))
    tails = one.groupBy("file").agg(F.max("chat").alias("chat"), F.max("last").alias("at")).select("file", "chat", F.lit(2).alias("part"), "at", F.lit("]}]}}").alias("value"))
    every = heads.unionByName(body).unionByName(tails)
    every.repartition("file").sortWithinPartitions("file", "chat", "part", "at").select("file", "value").write.partitionBy("file").text(path)
