"""Caption files to clean segments."""

from __future__ import annotations

from collections.abc import Generator, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import folds

TIME = r"(?:\d{2}:)?\d{2}:\d{2}[.,]\d{3}"
CUE = rf"({TIME})\s+-->\s+({TIME})"


def vtt(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """start, end (seconds) and text of each cue with any text, in file order (``cue``): a cue ends at a blank line or at the next time line.

    ``keep`` identifies a file. Equal texts in a row come once.
    """
    lines = df.select(*keep, F.posexplode(F.split(text, T.LINE_END)).alias("pos", "line")).withColumn("line", T.strip(F.col("line")))
    timed, blank = F.col("line").rlike(CUE), F.col("line") == ""
    w = Window.partitionBy(*keep).orderBy("pos")
    cues = lines.withColumn("cue", F.sum((timed | blank).cast("int")).over(w)).withColumn("timed", timed)
    skip = blank | F.col("line").rlike(r"^(WEBVTT$|Kind:|Language:|NOTE)|-->|^[0-9]+$")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("timed") & ~skip, F.struct("pos", "line")))), lambda x: x["line"]), " ")
    heads = F.max(F.when(F.col("timed"), F.col("line")))
    found = cues.groupBy(*keep, "cue").agg(heads.alias("head"), T.caption_text(words).alias("text")).where("head is not null and text <> ''")
    return _once(found.select(*keep, "cue", T.seconds(F.regexp_extract("head", CUE, 1)).alias("start"), T.seconds(F.regexp_extract("head", CUE, 2)).alias("end"), "text"), keep)


def _once(cues: DataFrame, keep: list[str]) -> DataFrame:
    """Without the cues that say what the one before says."""
    before = F.lag("text").over(Window.partitionBy(*keep).orderBy("cue"))
    return cues.withColumn("_before", before).where(~F.col("text").eqNullSafe(F.col("_before"))).drop("_before")


def json3(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The same from timed JSON events in milliseconds; without a duration a cue ends where it starts. What is not JSON gives no rows."""
    events = F.from_json(text, "events array<struct<tStartMs: long, dDurationMs: long, segs: array<struct<utf8: string>>>>")["events"]
    e = df.select(*keep, F.posexplode(events).alias("cue", "e"))
    words = F.array_join(F.transform("e.segs", lambda s: s["utf8"]), "")
    start = F.col("e.tStartMs") / 1000
    cues = e.select(*keep, "cue", start.alias("start"), (start + F.coalesce(F.col("e.dDurationMs"), F.lit(0)) / 1000).alias("end"), T.caption_text(words).alias("text")).where("text <> ''")
    return _once(cues.withColumn("start", F.coalesce("start", F.lit(0.0))).withColumn("end", F.coalesce("end", "start")), keep)


def provider(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The same from a provider's list of (text, offset or start, duration) in milliseconds; what cannot be read counts as 0."""
    items = F.from_json(text, "array<struct<text: string, offset: string, start: string, duration: string>>")
    e = df.select(*keep, F.posexplode(items).alias("cue", "e"))
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    start = F.when(F.coalesce(F.col("e.offset"), F.lit("")).isin("", "0"), number("e.start")).otherwise(number("e.offset")) / 1000
    return e.select(*keep, "cue", start.alias("start"), (start + number("e.duration") / 1000).alias("end"), T.caption_text(F.coalesce("e.text", F.lit(""))).alias("text")).where("text <> ''")


def _rolled(state: tuple[dict, str] | None, rows: Iterator[dict]) -> Generator[dict, None, tuple[dict, str] | None]:
    """The segments that stay; the state is the last one kept, and what it says."""
    last, said = state or (None, "")
    for row in rows:
        now = " ".join(row["text"].lower().split())
        if last:
            if now in said:
                continue
            if said in now and row["start"] - last["start"] <= 5:
                last, said = row | {"start": last["start"]}, now
                continue
            old, new = said.split(), now.split()
            shared = next((n for n in range(min(len(old), len(new)), 2, -1) if old[-n:] == new[:n]), 0)
            if shared:
                row["text"] = " ".join(row["text"].split()[shared:])
                now = row["text"].lower()
            if not now or now == said:
                continue
            yield last
        last, said = row, now
    return (last, said) if last else None


def without_rolling_repeats(segments: DataFrame, track: str) -> DataFrame:
    """Segments of each track without the repeats of rolling captions: each is compared with the last one kept, whatever the case.

    One held in the last goes; one that holds the last and starts within 5 s of its start replaces it; a shared end and start of three words and more is cut.
    A long track is folded in segments; see ``folds.in_segments``.
    """
    return folds.in_segments(segments, [track], ["start", "cue"], _rolled, lambda state: [state[0]] if state else [])


def best_track(tracks: DataFrame, key: str, languages: list[str]) -> DataFrame:
    """The track to use of each video: manual before automatic, then preferred languages in order, then others by name, ``vtt`` before others."""
    place = F.array_position(F.array(*map(F.lit, languages)), F.col("lang"))
    order = [F.when(F.col("origin") == "manual", 0).otherwise(1), F.when(place == 0, len(languages) + 1).otherwise(place), F.col("lang"), F.when(F.col("ext") == "vtt", 0).otherwise(1), F.col("ext")]
    return tracks.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
