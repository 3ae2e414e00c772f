"""Splitting documents into chunks: windows, paragraphs, sections, greedy packs, transcripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators import packs, scratch


def exploded(df: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    """One row for each non-empty stripped chunk, numbered from 1."""
    clean = F.filter(F.transform(chunks, T.strip), lambda x: x != "")
    return df.select(*keep, F.posexplode(clean).alias("pos", "chunk")).select(*keep, (F.col("pos") + 1).alias("chunk_no"), "chunk")


def windows(df: DataFrame, text: str, keep: list[str], size: int = 1000, overlap: int = 200) -> DataFrame:
    """Overlapping character windows; the last is the first that reaches the end."""
    n, step = F.length(text), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int") * step, F.lit(step))
    return exploded(df, F.transform(starts, lambda s: F.substring(F.col(text), s + 1, F.lit(size))), keep)


def paragraphs(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return exploded(df, F.split(text, "\n\n"), keep)


def sections(df: DataFrame, text: str, key: str) -> DataFrame:
    """Markdown sections by headings of level 1 to 3: section number, level, title and body; text before the first is ``Preamble``, one without headings ``Document``."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,3})[ \t]+\S", 1)))
    numbered = lines.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(Window.partitionBy(key).orderBy("pos")))
    grouped = numbered.groupBy(key, "section").agg(F.max("level").alias("level"), F.max(F.when(F.col("level") > 0, F.regexp_replace("line", r"^#+[ \t]+", ""))).alias("title"), F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "line")))).alias("body"))
    alone = F.max("section").over(Window.partitionBy(key)) == 0
    return grouped.select(key, "section", F.greatest("level", F.lit(1)).alias("level"), F.coalesce("title", F.when(alone, "Document").otherwise("Preamble")).alias("title"), T.strip(F.array_join(F.transform("body", lambda x: x["line"]), "\n")).alias("body")).where("section > 0 or body <> '' or title = 'Document'")


def _folded(parts: Column, limit: int, joiner: str) -> Column:
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        long, joined = F.length(p) > limit, F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit(joiner), p))
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(p) / limit) - 1, F.lit(0)).cast("int")), lambda i: F.substring(p, i * limit + 1, F.lit(limit)))
        fits = F.length(joined) <= limit
        return F.struct(F.when(long, F.concat(F.array_append(acc["done"], acc["open"]), cut)).when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), F.when(long, "").when(fits, joined).otherwise(p).alias("open"))

    return F.aggregate(parts, start, step, lambda acc: F.array_append(acc["done"], acc["open"]))


def packed(df: DataFrame, parts: Column, keep: list[str], limit: int, joiner: str = "\n") -> DataFrame:
    """Parts packed greedily, in order, up to ``limit`` characters; a longer part closes the open chunk and is cut into chunks of its own. A fold over each row's own array."""
    return exploded(df, _folded(parts, limit, joiner), keep)


def _paragraphs(text: str) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), T.strip), lambda x: x != "")


def paragraph_packs(df: DataFrame, text: str, keep: list[str], limit: int = 2500) -> DataFrame:
    """Stripped paragraphs packed up to ``limit`` characters."""
    return packed(df, _paragraphs(text), keep, limit, "\n\n")


def paragraph_pieces(text: str, limit: int = 2500) -> Column:
    """The chunks of ``paragraph_packs`` as an array."""
    return F.filter(F.transform(_folded(_paragraphs(text), limit, "\n\n"), T.strip), lambda x: x != "")


def line_packs(df: DataFrame, text: str, keep: list[str], limit: int = 12_000) -> DataFrame:
    """Lines packed up to ``limit`` characters, line ends included; a longer line is a chunk of its own and not cut. Chunks are not stripped."""
    lines = F.split(F.regexp_replace(F.col(text), rf"(?:{T.LINE_END})\z", ""), T.LINE_END)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        fits = F.length(acc["open"]) + 1 + F.length(x) + 1 <= limit
        full = acc["open"].isNotNull() & ~fits
        return F.struct(F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"), F.when(acc["open"].isNull() | full, x).otherwise(F.concat(acc["open"], F.lit("\n"), x)).alias("open"))

    chunks = F.aggregate(lines, start, step, lambda acc: F.array_append(acc["done"], acc["open"]))
    return df.where(F.col(text) != "").select(*keep, F.posexplode(chunks).alias("pos", "chunk")).select(*keep, (F.col("pos") + 1).alias("chunk_no"), "chunk")


def transcript(df: DataFrame, key: str, start: str, text: str) -> DataFrame:
    """``[MM:SS] text`` lines of each key in time order."""
    s = F.col(start).cast("long")
    line = F.concat(F.format_string("[%02d:%02d] ", F.floor(s / 60), s % 60), F.col(text))
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), line.alias("line")))), lambda x: x["line"]), "\n").alias("transcript"))


def semantic_breaks(df: DataFrame, key: str, order: str, vector: str, quantile: float = 0.95) -> DataFrame:
    """A chunk number for each sentence: a new chunk where the step to it is over the key's quantile of steps."""
    w = Window.partitionBy(key).orderBy(order)
    steps = df.withColumn("distance", 1 - V.cosine(F.lag(vector).over(w), F.col(vector)))
    limits = steps.groupBy(key).agg(F.expr(f"percentile(distance, {quantile})").alias("bound"))
    return steps.join(limits, key).withColumn("chunk_no", F.sum(F.coalesce((F.col("distance") > F.col("bound")).cast("int"), F.lit(0))).over(w)).drop("bound")


def routed(df: DataFrame, text: str, category: str, keep: list[str], by_window: list[str], by_paragraph: list[str], otherwise: DataFrame | None = None) -> DataFrame:
    """Windows or paragraphs by category; chunks of other categories are ``otherwise`` (the keys, chunk_no, chunk: a semantic split, say), or without it whole texts."""
    c = F.coalesce(F.col(category), F.lit(""))
    known = c.isin(*by_window, *by_paragraph)
    rest = exploded(df.where(~known), F.array(text), keep) if otherwise is None else otherwise.join(df.where(~known).select(*keep).distinct(), keep, "left_semi").select(*keep, "chunk_no", "chunk")
    return windows(df.where(c.isin(*by_window)), text, keep).unionByName(paragraphs(df.where(c.isin(*by_paragraph)), text, keep)).unionByName(rest)


def semantic_chunks(sentences: DataFrame, key: str, order: str, vector: str, text: str, quantile: float = 0.95) -> DataFrame:
    """Sentences joined by spaces between semantic breaks: the key, chunk_no (from 1) and chunk."""
    broken = semantic_breaks(sentences, key, order, vector, quantile)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ")
    return broken.groupBy(key, (F.col("chunk_no") + 1).cast("int").alias("chunk_no")).agg(joined.alias("chunk"))


def document_chunks(df: DataFrame, key: str, text: str, vector: Callable[[Column], Column], quantile: float = 0.95, around: int = 1) -> DataFrame:
    """Semantic chunks of raw texts: the key, chunk_no (from 1), sentences (how many) and chunk.

    Sentences are compared by the sum of their ``vector`` (an array of numbers, the same length for all) and those of ``around`` neighbours on each side. A chunk ends where the distance
    to the next sentence (one minus the cosine; 0 where one has a zero vector) is over the quantile of the text's distances, with linear interpolation; its sentences are joined by spaces,
    stripped, and empty chunks dropped. Distances count in billionths, rounded, and the quantile in ten-thousandths, so that all comparisons are of whole numbers and equal distances stay equal. All of a row is worked out in the row, without a shuffle; the work is in proportion to its sentences, but for sorting distances. Null texts give no chunks.
    """

    def summed(vectors: Column) -> Column:
        near = lambda i: F.slice(vectors, F.greatest(i - around, F.lit(0)) + 1, F.least(i, F.lit(around)) + around + 1)
        total = lambda some: F.aggregate(F.slice(some, 2, max(2 * around, 1)), F.get(some, 0), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
        return F.transform(F.sequence(F.lit(0), F.size(vectors) - 1), lambda i: T.let(near(i), total))

    def steps(v: Column) -> Column:
        one = lambda a, b: F.floor(F.coalesce(1 - V.cosine(a, b), F.lit(0.0)) * 1e9 + 0.5).cast("long")
        return F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), one)

    def bound(d: Column) -> Column:
        """The sorted distances about the quantile, and the place between them in ten-thousandths."""
        place = (F.size(d) - 1).cast("long") * round(quantile * 10_000)
        low = F.floor(place / 10_000).cast("int")
        return T.let(F.array_sort(d), lambda s: F.struct(F.get(s, low).alias("low"), F.coalesce(F.get(s, low + 1), F.get(s, low)).alias("high"), (place % 10_000).alias("part")))

    def ends(d: Column) -> Column:
        """How many sentences come before each break, then no number for the last chunk."""
        at = F.sequence(F.lit(1), F.size(d))
        over = T.let(bound(d), lambda b: F.filter(at, lambda i: (F.get(d, i - 1) - b["low"]) * 10_000 > (b["high"] - b["low"]) * b["part"]))
        return F.when(F.size(d) == 0, F.array().cast("array<int>")).otherwise(over)

    pieces = df.where(F.col(text).isNotNull()).select(key, T.sentences(F.col(text)).alias("_s"))
    vectors = F.transform("_s", lambda s: F.transform(vector(s), lambda x: x.cast("double")))
    cut = pieces.select(key, "_s", T.let(T.let(T.let(vectors, summed), steps), ends).alias("_ends"))
    spans = F.zip_with(F.concat(F.array(F.lit(0)), "_ends"), F.concat("_ends", F.array(F.size("_s"))), lambda a, b: F.struct((b - a).alias("sentences"), T.strip(F.array_join(F.slice("_s", a + 1, b - a), " ")).alias("chunk")))
    return cut.select(key, F.posexplode(F.filter(spans, lambda x: x["chunk"] != "")).alias("_pos", "_c")).select(key, (F.col("_pos") + 1).alias("chunk_no"), "_c.sentences", "_c.chunk")


def section_packs(df: DataFrame, key: str, section: str, level: str, title: str, body: str, tokens: int = 4000, share: float = 0.1, cell: int = packs.CELL) -> DataFrame:
    """Sections packed in order into chunks of at most ``tokens`` estimated tokens: chunk_no, titles (joined by bars) and chunk.

    A larger section starts chunks of its own, packed from its paragraphs, each with the section's title. Every chunk but a document's first starts with
    the last words of the one before: twice the overlap's tokens, at least 40. A document of any length spreads over tasks: chunks come from ``packs``; the
    last words before a chunk are the last words of all text before it, found by their place among the document's words.
    """
    overlap = int(tokens * share)
    blank = F.lit("\n\n")
    # A section's whole text is put together where it is asked for, so that packs carry a body once.
    whole = lambda x: T.strip(F.concat(F.repeat(F.lit("#"), x["_level"]), F.lit(" "), x["_title"], blank, x["_body"]))
    rows = df.select(key, F.col(section).alias("_section"), F.col(level).cast("int").alias("_level"), F.col(title).alias("_title"), F.col(body).alias("_body"))
    rows = rows.withColumn("_size", T.token_estimate(whole({c: F.col(c) for c in ("_level", "_title", "_body")})))
    first = scratch.written(packs.packs(rows, [key], ["_section"], "_size", tokens, cell=cell), "section-packs")
    large = F.get("rows", 0)["_size"] > tokens
    joined = lambda of: T.strip(F.array_join(F.transform("rows", of), "\n\n"))
    small = first.where(~large).select(key, "pack_no", F.lit(0).cast("long").alias("_sub"), F.array_join(F.transform("rows", lambda x: x["_title"]), " | ").alias("titles"), joined(whole).alias("_text"))
    paragraphs = F.filter(F.transform(F.split(F.get("rows", 0)["_body"], "\n\n"), T.strip), lambda x: x != "")
    blocks = first.where(large).select(key, "pack_no", F.get("rows", 0)["_title"].alias("_title"), F.posexplode(paragraphs).alias("_pos", "_p")).withColumn("_block", F.concat(F.lit("## "), "_title", blank, "_p"))
    # A section's first chunk starts with one token.
    sized = blocks.select(key, F.col("pack_no").alias("_pack"), "_pos", "_title", "_block", (T.token_estimate(F.col("_block")) + F.when(F.col("_pos") == 0, 1).otherwise(0)).alias("_size"))
    cut = packs.packs(sized, [key, "_pack"], ["_pos"], "_size", tokens, cell=cell).select(key, F.col("_pack").alias("pack_no"), F.col("pack_no").alias("_sub"), F.get("rows", 0)["_title"].alias("titles"), joined(lambda x: x["_block"]).alias("_text"))
    chunks = small.unionByName(cut).withColumn("_one", F.lit(1).cast("long")).withColumn("_words", F.when(F.col("_text") == "", 0).otherwise(F.size(F.split(T.squeezed(F.col("_text")), " "))).cast("long"))
    placed = packs.numbered(chunks, [key], ["pack_no", "_sub"], "_one", "_words")
    number = (F.col("_at__one") + 1).cast("int").alias("chunk_no")
    if overlap <= 0:
        return placed.select(key, number, "titles", F.col("_text").alias("chunk"))
    kept = max(2 * overlap, 40)
    # A chunk's words end at a place on the document's axis of words; those that a later chunk repeats end less than ``kept`` before it, in its stretch of the axis or the one before.
    end, start = F.col("_at__words") + F.col("_words"), F.col("_at__words")
    ends = placed.where("_words > 0").select("_key", F.floor(end / kept).alias("_stretch"), end.alias("_end"), F.slice(F.split(T.squeezed(F.col("_text")), " "), F.greatest(F.col("_words") - kept, F.lit(0)).cast("int") + 1, kept).alias("_last"))
    asked = placed.where(start > 0).select("_key", "_seq", start.alias("_start"), F.explode(F.array(F.floor(start / kept) - 1, F.floor(start / kept))).alias("_stretch"))
    near = asked.join(ends, ["_key", "_stretch"]).where((F.col("_end") <= F.col("_start")) & (F.col("_end") > F.col("_start") - kept))
    words = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_end", "_last"))), lambda x: x["_last"]))
    tails = near.groupBy("_key", "_seq").agg(words.alias("_w")).select("_key", "_seq", F.array_join(F.slice("_w", F.greatest(F.size("_w") - kept, F.lit(0)) + 1, kept), " ").alias("_tail"))
    return placed.join(tails, ["_key", "_seq"], "left").select(key, number, "titles", F.concat(F.coalesce(F.concat("_tail", blank), F.lit("")), "_text").alias("chunk"))
