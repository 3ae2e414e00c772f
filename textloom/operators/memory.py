"""Memory tables: candidates and their gate, merges, fallbacks of retrieval, cleanup plans, audits and logs of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import chunking, packs, scratch, tables

#: Confidence and context lengths from which a candidate is queued without a person's confirmation.
AUTO_CONFIDENCE, MIN_CONTEXT, MIN_QUOTE = 0.75, 40, 30
#: Chunks below are merged, above are split, and the size of what a split gives.
SHORT, LONG, TARGET = 100, 5000, 2500


def canonical(df: DataFrame, name: str, aliases: dict[str, str]) -> DataFrame:
    """A name replaced by its canonical form where the configured aliases have one."""
    if not aliases:
        return df
    table = df.sparkSession.createDataFrame(list(aliases.items()), "_alias string, _canonical string")
    joined = df.join(F.broadcast(table), F.col(name) == F.col("_alias"), "left")
    return joined.withColumn(name, F.coalesce("_canonical", name)).drop("_alias", "_canonical")


def merged(old: Column, new: Column) -> Column:
    """Two maps as one; the second wins. A null map counts as empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def reweighted(df: DataFrame, which: Column, weight: float, column: str = "quality_weight") -> DataFrame:
    """Rows that meet ``which`` get the weight; their metadata keeps the previous one."""
    note = F.create_map(F.lit("previous_weight"), F.col(column).cast("string"))
    return df.withColumn("metadata", F.when(which, merged(F.col("metadata"), note)).otherwise(F.col("metadata"))).withColumn(column, F.when(which, F.lit(weight)).otherwise(F.col(column)))


def unpublished(posts: DataFrame, *seen: tuple[DataFrame, list[str]]) -> DataFrame:
    """Posts that none of the tables has, each compared on its own columns; a null matches nothing."""
    for table, keys in seen:
        posts = posts.join(table.select(*keys), keys, "left_anti")
    return posts


def lookup(df: DataFrame, modes: DataFrame, key: str, default: object) -> DataFrame:
    """Columns of the row of ``modes`` with the requested key, else of the default's. Keys of ``modes`` are unique."""
    known = modes.select(F.col(key).alias("_known"))
    used = df.join(known, F.col(key) == F.col("_known"), "left").withColumn("_used", F.coalesce("_known", F.lit(default))).drop("_known")
    return used.join(modes.withColumnRenamed(key, "_used"), "_used", "left").withColumnRenamed("_used", "used_" + key)


def set_status(df: DataFrame, ids: DataFrame, status: str, allowed: tuple[str, ...] = ("verified", "rejected", "unverified")) -> DataFrame:
    """``verification_status`` of the listed ids (positive ones, repeats allowed) set to ``status``."""
    if status not in allowed:
        raise ValueError(f"{status!r} is none of {allowed}")
    hit = ids.select("id").where("id > 0").distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, "id", "left").withColumn("verification_status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("verification_status"))).drop("_hit")


def topic_merge(items: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Values of a key joined by newlines in order; a value that stands in what is there already is left out."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    fold = F.aggregate(values, F.lit(""), lambda acc, v: F.when(F.contains(acc, v), acc).when(acc == "", v).otherwise(F.concat(acc, F.lit("\n"), v)))
    # Equal values of a key meet before the lists are made, so a list holds distinct values only.
    once = items.where(F.trim(value) != "").groupBy(*key, value).agg(F.min(order).alias(order))
    return once.groupBy(*key).agg(fold.alias("merged"))


def first_by_title(df: DataFrame, title: str, order: str) -> DataFrame:
    """The first row of each title, whatever its case; blank titles go."""
    key = F.lower(T.strip(F.col(title)))
    rows = df.where(T.strip(F.col(title)) != "").groupBy(key.alias("_key")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order).alias("row"))
    return rows.select("row.*")


def marker_union(items: DataFrame, bucket: list[str], order: str, marker: str) -> DataFrame:
    """Distinct markers of each bucket in order of first appearance."""
    first = items.groupBy(*bucket, marker).agg(F.min(order).alias("_at"))
    return first.groupBy(*bucket).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", marker))), lambda x: x[marker]).alias("markers"))


def without_vector(queries: DataFrame, corpus: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The fallback for queries that have no vector: the same ``k`` rows for each, ranked by ``order``."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "id")))
    best = corpus.orderBy(*order).limit(k)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).agg(rows.alias("best")).withColumn("_one", F.lit(1))
    return queries.where(F.col("embedding").isNull()).withColumn("_one", F.lit(1)).join(F.broadcast(best), "_one").select("query_id", F.inline("best"))


def rules_for(queries: DataFrame, near: DataFrame, rules: DataFrame, is_global: Column, newest: list[Column], limit: int, most_global: int = 10) -> DataFrame:
    """Global rules, newest first, then nearest ones: as many of the nearest as the global rules leave of ``limit``, less those that are global rules already.

    The nearest are cut before repeats go, so a query may get fewer than ``limit``. A query with neither gets the ``limit`` newest rules.
    """
    all_queries = queries.withColumn("embedding", F.lit(None).cast("array<float>"))
    top = without_vector(all_queries, rules.where(is_global), newest, min(limit, most_global))
    taken = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("_taken"))
    cut = near.join(taken, "query_id", "left").where(F.col("rank") <= limit - F.coalesce("_taken", F.lit(0)))
    fill = cut.join(top.select("query_id", "id"), ["query_id", "id"], "left_anti")
    both = top.select("query_id", "id", F.lit(0).alias("_part"), "rank").unionByName(fill.select("query_id", "id", F.lit(1).alias("_part"), "rank"))
    recent = without_vector(all_queries.join(both.select("query_id"), "query_id", "left_anti"), rules, newest, limit)
    both = both.unionByName(recent.select("query_id", "id", F.lit(2).alias("_part"), "rank"))
    w = Window.partitionBy("query_id").orderBy("_part", "rank")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("_part")


def gate(confidence: Column, source: Column, quote: Column, context: Column, source_type: Column | None = None) -> Column:
    """``queue`` if the quote is in the source and confidence is high, and for channel posts if there is context; else ``pending_confirm``.

    Without a source type all rows count as channel posts.
    """
    long_enough = (F.length(F.coalesce(context, F.lit(""))) >= MIN_CONTEXT) | (F.length(F.coalesce(quote, F.lit(""))) >= MIN_QUOTE)
    other = F.lit(False) if source_type is None else F.coalesce(source_type != "channel", F.lit(True))
    return F.when(T.grounded(source, quote) & (confidence >= AUTO_CONFIDENCE) & (other | long_enough), "queue").otherwise("pending_confirm")


def style_gate(confidence: Column, source: Column, quote: Column, pattern_type: Column) -> Column:
    """The same for style entries: tone markers whose quote is in the source, stop words if their confidence is high too; others never by themselves."""
    sure = (pattern_type == "tone_markers") | (pattern_type == "stop_words") & (confidence >= AUTO_CONFIDENCE)
    return F.when(T.grounded(source, quote) & sure, "queue").otherwise("pending_confirm")


def gate_report(decided: DataFrame, known: DataFrame, layer: str = "kind", decision: str = "decision", key: str = "fingerprint") -> DataFrame:
    """Rows of each layer that were inserted (queued and not known yet), skipped (known) or are to be confirmed."""
    held = known.select(key).distinct().withColumn("_has", F.lit(True))
    outcome = F.when(F.col("_has"), "skipped").when(F.col(decision) == "queue", "inserted").otherwise("pending_confirm")
    return decided.join(held, key, "left").groupBy(layer, outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def with_manual_entries(profile: DataFrame, *more: DataFrame) -> DataFrame:
    """Profile entries with those of further tables after them, in the order of the tables: all columns and ``part`` (0 for the profile)."""
    out = profile.withColumn("part", F.lit(0))
    for n, df in enumerate(more, start=1):
        out = out.unionByName(df.withColumn("part", F.lit(n)), allowMissingColumns=True)
    return out


def style_corrections(corrections: DataFrame) -> DataFrame:
    """One pending candidate for each correction (id, instruction): the instruction is content and quote, confidence 1; of equal ones the first id comes, blank ones go."""
    rows = corrections.where(T.strip(F.coalesce("instruction", F.lit(""))) != "").select("id", F.lit("style").alias("kind"), F.col("instruction").alias("content"), F.col("instruction").alias("quote"), F.lit(1.0).alias("confidence"), F.lit("correction").alias("source_type"), F.lit("pending").alias("status"), T.fingerprint(F.lit("style"), F.col("instruction")).alias("fingerprint"))
    return tables.first_of(rows, ["fingerprint"], [F.col("id")])


def regret_candidates(regrets: DataFrame, default_title: str = "Reflection") -> DataFrame:
    """Candidates of imported regrets (id, event_title, source_quote, consequences_lessons, context, confidence): the first of quote, lessons, context and title
    that is not empty is the quote; an unknown confidence is 0.85. Of equal ones the first id comes."""
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    title = F.coalesce(full("event_title"), F.lit(default_title))
    quote = F.coalesce(full("source_quote"), full("consequences_lessons"), full("context"), title)
    rows = regrets.select("id", F.lit("regret").alias("kind"), title.alias("topic"), quote.alias("quote"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.85)).alias("confidence"), T.fingerprint(F.lit("regret"), title, F.coalesce("consequences_lessons", F.lit(""))).alias("fingerprint"))
    return tables.first_of(rows, ["fingerprint"], [F.col("id")])


def backfilled(legacy: DataFrame, existing: DataFrame, kind: str, content: Column, order: str) -> DataFrame:
    """Legacy rows as reviewable ones (kind, content, status pending, fingerprint) that the table does not have yet; blank contents go."""
    rows = legacy.select(F.lit(kind).alias("kind"), content.alias("content"), F.lit("pending").alias("status"), T.fingerprint(F.lit(kind), content).alias("fingerprint"), F.col(order).alias("legacy_id")).where(T.strip(F.col("content")) != "")
    return tables.insert_new(rows, existing, "fingerprint", [F.col("legacy_id")])


def candidates(extractions: DataFrame, buckets: list[str]) -> DataFrame:
    """One row (id, kind, content, quote, confidence, fingerprint) for each entry of the buckets, arrays of (content, quote, confidence).

    Of equal kind and content the one with the smallest id comes; blank contents go.
    """
    empty = F.array().cast("array<struct<content: string, quote: string, confidence: string>>")

    def entries(b: str) -> Column:
        return F.transform(F.coalesce(F.col(b), empty), lambda x: F.struct(F.lit(b).alias("kind"), x["content"].alias("content"), x["quote"].alias("quote"), T.clamp(x["confidence"], 0.0).alias("confidence")))

    rows = extractions.select("id", F.inline(F.flatten(F.array(*map(entries, buckets))))).where(T.strip(F.col("content")) != "").withColumn("fingerprint", T.fingerprint(F.col("kind"), F.col("content")))
    return tables.first_of(rows, ["fingerprint"], [F.col("id"), F.col("content"), F.col("quote")])


def confirmed(pending: DataFrame, ids: DataFrame, journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pending rows that were confirmed, the journal with their entries marked applied)."""
    done = ids.select("id").distinct()
    marked = journal.join(done.withColumn("_done", F.lit(True)), "id", "left").withColumn("status", F.when(F.col("_done"), "applied").otherwise(F.col("status"))).drop("_done")
    return pending.join(done, "id", "left_semi"), marked


def voice_rows(messages: DataFrame, kind: str = "kind") -> DataFrame:
    """Voice examples of messages: posts weigh 1.0; chats 0.45 and teach style only."""
    chat = F.col(kind) == "chats"
    return messages.withColumn("fingerprint", T.fingerprint(F.col(kind), F.col("text"))).withColumn("quality_weight", F.when(chat, 0.45).otherwise(1.0)).withColumn("style_only", chat)


#: What makes a chapter.
CHAPTER = ["source_book", "chapter_title"]


def _counted(content: Column) -> Column:
    """Characters that a chunk adds to a merged text: joined texts have a space between them that counts, empty ones none."""
    n = F.length(T.squeezed(content))
    return F.when(n > 0, n + 1).otherwise(0).cast("long")


def _with_merged(chunks: DataFrame, sized: DataFrame, cell: int) -> DataFrame:
    """``chunks`` (id, content and more) of which ``sized`` (id, source_book, chapter_title, chunk_index, _size) has the id, with ``merged``; see ``merged_shorts``.

    Packs are made of ids and sizes. Texts are joined only where a pack has several; every other chunk's text meets nothing but its own row.
    """
    found = packs.packs(sized.select("id", *CHAPTER, "chunk_index", "_size"), CHAPTER, ["chunk_index", "id"], "_size", SHORT + 1, at_least=True, cell=cell)
    total = F.aggregate("rows", F.lit(0).cast("long"), lambda acc, x: acc + x["_size"])
    groups = scratch.written(found.select(packs.key_of(CHAPTER).alias("_key"), "pack_no", F.transform("rows", lambda x: x["id"]).alias("ids"), F.element_at("rows", -1)["chunk_index"].alias("at"), (total > SHORT).alias("full")), "short-chunks")
    tails = groups.where("not full").select("_key", (F.col("pack_no") - 1).alias("pack_no"), F.col("at").alias("tail_at"), F.col("ids").alias("tail"))
    whole = groups.where("full").join(tails, ["_key", "pack_no"], "left")
    both = F.when(F.col("tail").isNull(), F.array("ids")).when(F.col("at") < F.col("tail_at"), F.array("ids", "tail")).otherwise(F.array("tail", "ids"))
    alone = groups.where("not full").select("ids", F.when(F.col("pack_no") == 1, F.array("ids")).alias("parts"))
    each = F.transform("ids", lambda x, i: F.struct(x.alias("id"), F.when(i == F.size("ids") - 1, F.col("parts")).alias("parts")))
    fates = scratch.written(whole.select("ids", both.alias("parts")).unionByName(alone).select(F.inline(each)), "chunk-fates")
    several = F.coalesce(F.size(F.flatten("parts")) > 1, F.lit(False))
    members = fates.where(several).select(F.col("id").alias("last"), F.posexplode("parts").alias("side", "ids")).select("last", "side", F.posexplode("ids").alias("nth", "id"))
    members = scratch.written(members, "short-members")
    in_order = lambda *by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by))), lambda x: x[by[-1]]), "\n\n")
    sides = members.join(chunks.select("id", "content"), "id").groupBy("last", "side").agg(in_order("nth", "content").alias("text"))
    texts = sides.groupBy("last").agg(in_order("side", "text").alias("_joined")).withColumnRenamed("last", "id")
    told = chunks.join(fates.select("id", F.col("parts").isNotNull().alias("_stays"), several.alias("_several")), "id").join(texts, "id", "left")
    merged = F.when(F.col("_several"), F.col("_joined")).when(F.col("_stays"), F.coalesce("content", F.lit("")))
    return told.withColumn("merged", merged).drop("_stays", "_several", "_joined")


def merged_shorts(chunks: DataFrame, cell: int = packs.CELL) -> DataFrame:
    """id and ``merged`` of chunks (id, source_book, chapter_title, chunk_index, content): the content after short ones joined the next chunk of their chapter, or the last ones the one before them; null where a chunk went.

    Chunks up to the first that makes the text long enough are a pack, so that a chapter of any length spreads over tasks; see ``packs``.
    """
    return _with_merged(chunks.select("id", "content"), chunks.withColumn("_size", _counted(F.col("content"))), cell).select("id", "merged")


def cleanup_plan(chunks: DataFrame) -> DataFrame:
    """What a cleanup does to each chunk of (id, source_book, chapter_title, chunk_index, content): columns id, chunk_index, action, content, split.

    Later copies within all books go (``delete``). In the order of chunk_index, a short chunk joins the next one of its book and chapter, the last ones the one before
    (``delete``; the other is an ``update``). What is then too long and falls into several pieces keeps the first (``update``, the others are in ``split``; see
    ``inserted_rows``). Others: ``keep``. Null contents count as empty, null books as one, null indexes as 0. See ``merged_shorts``.
    """
    none = F.array().cast("array<string>")
    text = chunks.select("id", F.coalesce("source_book", F.lit("unknown")).alias("source_book"), "chapter_title", F.coalesce("chunk_index", F.lit(0)).cast("long").alias("chunk_index"), F.coalesce("content", F.lit("")).alias("content"))
    # All that is decided by a chunk's print and length; contents are read once more, for what stays.
    heads = scratch.written(text.select("id", *CHAPTER, "chunk_index", T.fingerprint(F.col("content")).alias("print"), _counted(F.col("content")).alias("_size")), "chunk-heads")
    ranked = heads.join(heads.groupBy("print").agg(F.min("id").alias("first")), "print")
    copies = ranked.where("id > first").select("id", "chunk_index", F.lit("delete").alias("action"), F.lit("").alias("content"), none.alias("split"))
    merged = _with_merged(text.select("id", "chunk_index", "content"), ranked.where("id = first"), packs.CELL)
    # As a row of its own, so that the pieces are made once for all that is asked of them.
    pieces = F.explode(F.array(F.struct(F.when(F.length("merged") > LONG, chunking.paragraph_pieces("merged", TARGET)).alias("p"))))
    planned = merged.withColumn("x", pieces).withColumn("p", F.when(F.size("x.p") > 1, F.col("x.p")))
    content = F.when(F.col("p").isNotNull(), F.get("p", 0)).otherwise(F.coalesce("merged", F.lit("")))
    action = F.when(F.col("merged").isNull(), "delete").when(F.col("p").isNotNull() | (F.col("merged") != F.col("content")), "update").otherwise("keep")
    rest = F.coalesce(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(1))), none)
    return planned.select("id", "chunk_index", action.alias("action"), content.alias("content"), rest.alias("split")).unionByName(copies)


def inserted_rows(plan: DataFrame) -> DataFrame:
    """The further pieces of split chunks: split_from_id, chunk_index (1000 times the chunk's, plus the piece's number) and content."""
    return plan.select(F.col("id").alias("split_from_id"), "chunk_index", F.posexplode("split").alias("n", "content")).select("split_from_id", (F.col("chunk_index") * 1000 + F.col("n") + 1).alias("chunk_index"), "content")


def applied_plan(chunks: DataFrame, plan: DataFrame, sources: dict[str, str] | None = None) -> DataFrame:
    """Chunks (id, chunk_index, content, canonical_source, fingerprint) after the plan; inserted pieces have the id they come from. Of equal fingerprints the lowest id and index stay."""
    # One pass over the plan, which is a job of its own each time that it is read.
    kept = F.when(F.col("action").isin("keep", "update"), F.array(F.struct(F.lit(0).alias("_piece"), F.col("chunk_index").cast("long").alias("chunk_index"), "content")))
    more = F.transform("split", lambda x, i: F.struct(F.lit(1).alias("_piece"), (F.col("chunk_index") * 1000 + i + 1).cast("long").alias("chunk_index"), x.alias("content")))
    none = F.array().cast("array<struct<_piece:int,chunk_index:bigint,content:string>>")
    new = plan.select("id", F.inline(F.concat(F.coalesce(kept, none), F.coalesce(more, none))))
    named = canonical(new.join(chunks.select("id", F.coalesce("source_book", F.lit("unknown")).alias("canonical_source")), "id"), "canonical_source", sources or {})
    return tables.first_of(named.withColumn("fingerprint", T.fingerprint(F.col("content"))), ["fingerprint"], [F.col("id"), F.col("_piece"), F.col("chunk_index")]).drop("_piece")


def audit(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, old_value and new_value (JSON; null where there is no such row) of rows that differ."""
    pack = lambda df, to: df.select(key, F.to_json(F.struct(*sorted(c for c in df.columns if c != key))).alias(to))
    return pack(before, "old_value").join(pack(after, "new_value"), key, "full").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def purged(df: DataFrame, reviewed: Column, pending: Column) -> DataFrame:
    """Without reviewed rows, unless any row is pending: then all rows."""
    return df if df.where(pending).limit(1).count() else df.where(~F.coalesce(reviewed, F.lit(False)))


def seed_outcomes(items: DataFrame, active: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``insert``, ``update`` (neither value holds the other) or ``skip`` of each item against the active row of its keys."""
    held = active.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_has"))
    out = F.when(F.col("_has").isNull(), "insert").when(T.differs(F.col(value), F.col("_old")), "update").otherwise("skip")
    return items.join(held, keys, "left").withColumn("outcome", out).drop("_old", "_has")


def style_rows(df: DataFrame, buckets: str) -> DataFrame:
    """One row for each bucket of a map of arrays that is not empty."""
    return df.select(*[c for c in df.columns if c != buckets], F.explode(buckets).alias("pattern_type", "patterns")).where("size(patterns) > 0")


def current_drafts(changes: DataFrame, key: str, order: Column, fields: list[str]) -> DataFrame:
    """Each draft's latest value of every field; a change is a struct ``set_<field>`` of (value), so that a null can be set on purpose."""
    return changes.groupBy(key).agg(*[F.max_by(F.col(f"set_{f}"), F.when(F.col(f"set_{f}").isNotNull(), order))["value"].alias(f) for f in fields], F.max(order).alias("updated"))


#: Fixed values of a new draft.
NEW_DRAFT = {"state": "new", "length_mode": "normal"}


def draft_changes(events: DataFrame, fields: list[str]) -> DataFrame:
    """Events (draft_id, at, event, patch: map of strings) as changes for ``current_drafts``: ``created`` sets the defaults of NEW_DRAFT under what it gives; ``patched`` sets
    what it gives, nulls included; ``version`` sets final_text, the state ``drafted`` and no pending instruction."""

    def change(f: str) -> Column:
        given = F.map_contains_key("patch", F.lit(f))
        own = F.struct(F.element_at("patch", F.lit(f)).alias("value"))
        fixed = lambda v: F.struct(F.lit(v).cast("string").alias("value"))
        out = F.when(F.col("event").isin("created", "patched") & given, own)
        if f in NEW_DRAFT:
            out = out.when(F.col("event") == "created", fixed(NEW_DRAFT[f]))
        version = F.col("event") == "version"
        if f == "final_text":
            out = out.when(version, F.struct(F.element_at("patch", F.lit("text")).alias("value")))
        if f in ("state", "pending_instruction"):
            out = out.when(version, fixed("drafted" if f == "state" else None))
        return out.alias(f"set_{f}")

    return events.select("draft_id", "at", *[change(f) for f in fields])


def message_packs(messages: DataFrame, key: str, order: list[str], header: Column, text: str, limit: int = 80_000, cell: int = packs.CELL) -> DataFrame:
    """Messages of each chat packed greedily, in order, up to ``limit`` characters (header, text and three line ends each): pack_no, n_messages, pack.

    A longer message is a pack of its own. A chat of any length spreads over tasks; see ``packs``.
    """
    blocks = messages.select(key, *order, F.concat(header, F.lit("\n"), F.coalesce(F.col(text), F.lit(""))).alias("_block")).withColumn("_size", F.length("_block").cast("long") + 2)
    found = packs.packs(blocks, [key], order, "_size", limit, cell=cell)
    return found.select(key, "pack_no", F.size("rows").cast("long").alias("n_messages"), F.array_join(F.transform("rows", lambda x: x["_block"]), "\n\n---\n\n").alias("pack"))
