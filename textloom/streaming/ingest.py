"""Streaming ingest; each job shares its transformation with a batch twin."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from textloom.functions import text as T
from textloom.operators import memory


def long_enough(least: int = 80) -> Column:
    return F.length(T.strip(F.coalesce("text", F.lit("")))) >= least


def gated(posts: DataFrame, channel_id: int | None = None, least: int = 80) -> DataFrame:
    """Posts long enough, of the channel if one is named."""
    out = posts.where(long_enough(least))
    return out if channel_id is None else out.where(F.col("channel_id") == channel_id)


def voice_rows(posts: DataFrame) -> DataFrame:
    return posts.select("channel_id", "message_id", "text", T.fingerprint(F.lit("channel"), F.col("text")).alias("fingerprint"), F.when(F.col("forwarded"), 0.85).otherwise(1.0).alias("quality_weight"))


def channel_posts_batch(posts: DataFrame, processed: DataFrame) -> DataFrame:
    """The batch twin: gate, one row for each message, not processed before."""
    once = gated(posts).groupBy("channel_id", "message_id").agg(F.min(F.struct("date", "text", "forwarded")).alias("p")).select("channel_id", "message_id", "p.*")
    return voice_rows(once.join(processed, ["channel_id", "message_id"], "left_anti"))


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return None


class _First(StatefulProcessor):
    """Of each key the smallest row, by the fields of ``order``, of the batch in which it first comes; a key of state that has its row gives no other. Keys whose last field isn't 0 keep no state and give all rows."""

    def __init__(self, order: list[str], date: str | None, expire_ms: int) -> None:
        self.order, self.date, self.expire_ms = order, date, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.given = handle, handle.getValueState("given", "yes boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        if key[-1]:
            yield from rows
        elif self.given.exists():
            for _ in rows:
                pass
        else:
            first = min(rows, key=lambda r: [(r[f] is not None, r[f]) for f in self.order])
            self.given.update((True,))
            if self.date:
                self.handle.registerTimer(int(first[self.date].timestamp() * 1000) + self.expire_ms)
            yield first

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:
        self.given.update((True,))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        self.given.clear()
        return iter(())


#: Parts that rows without a key are dealt to.
LOOSE = 256


def first_by_key(rows: DataFrame, keys: list[str], order: list[str], known: DataFrame | None = None, bad: Column | None = None, expire: tuple[str, str, int] | None = None) -> DataFrame:
    """The stream's first row of each key, ever, by keyed state: a value a key, so that a batch reads and writes the state of its own keys only.

    ``known`` are keys that have had their row; they become state before the first batch. Rows for which ``bad`` holds go through as they are, without state, in parts by their hash,
    however many they are. Rows with a null key are one key unless they are bad. State stays for good, and no row is too late; with ``expire`` = (date column, delay of its watermark, milliseconds) a key
    is forgotten that long after its row's date, and rows behind the watermark, which are replays, are dropped. Needs the RocksDB state store (``started``).
    """
    loose = F.lit(False) if bad is None else F.coalesce(bad, F.lit(False))
    dealt = rows.withColumn("_part", F.when(loose, F.pmod(F.xxhash64(*rows.columns), F.lit(LOOSE)) + 1).otherwise(0).cast("long"))
    if expire:
        dealt = dealt.withWatermark(expire[0], expire[1])
    state = None if known is None else known.select(*keys).distinct().withColumn("_part", F.lit(0).cast("long")).groupBy(*keys, "_part")
    work = _First(order, expire[0] if expire else None, expire[2] if expire else 0)
    return dealt.groupBy(*keys, "_part").transformWithState(work, dealt.schema, "append", "EventTime" if expire else "None", state).drop("_part")


def started(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """The query over what has arrived, with its state in RocksDB: on local disk in changes, so that it may be larger than memory, and in the checkpoint for a lost executor."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def _run(checkpoint: str) -> str:
    return f"r{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"


def channel_posts(posts: DataFrame, ledger: str, dead: str, checkpoint: str, expire: tuple[str, int] | None = None) -> StreamingQuery:
    """Stream posts into the ledger table at ``ledger``: one row a message, however often and late it comes.

    What is done stands in keyed state; the ledger is read once, by a checkpoint's first batch, for what streams with other checkpoints have put there. Each batch is a folder of its own
    (run, batch) and a repeated batch is written over itself. One stream at a time writes a ledger. Rows without channel, message or date go to the table at ``dead`` in the same way.
    ``expire`` = (delay of the watermark, milliseconds) bounds the state (``first_by_key``).
    """
    spark, run = posts.sparkSession, _run(checkpoint)
    bad = F.col("channel_id").isNull() | F.col("message_id").isNull() | F.col("date").isNull()
    ready = posts.where(bad | long_enough())
    done = _table(spark, ledger)
    known = None if done is None else done.where(F.col("run") != run)
    first = first_by_key(ready, ["channel_id", "message_id"], ["date", "text", "forwarded"], known, bad, ("date", *expire) if expire else None)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        place = f"run={run}/batch={number}"
        batch.where(bad).write.mode("overwrite").parquet(f"{dead}/{place}")
        voice_rows(batch.where(~bad)).write.mode("overwrite").parquet(f"{ledger}/{place}")
        batch.unpersist()

    return started(first, write, checkpoint)


def ops_status(events: DataFrame, checkpoint: str, sink: str) -> StreamingQuery:
    """Stream of operation events to the latest status of each type, in update mode; ``sink`` holds the changes of every batch."""
    from textloom.operators import lifecycle

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(sink)

    return lifecycle.latest_status(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feedback_rows(published: DataFrame) -> DataFrame:
    """Voice rows of published drafts, weight 0.4."""
    return published.select("draft_id", F.col("final_text").alias("text"), T.fingerprint(F.lit("draft"), F.col("final_text")).alias("fingerprint"), F.lit(0.4).alias("quality_weight"))


def publish_feedback(published: DataFrame, voice: str, checkpoint: str, candidates: str | None = None, buckets: list[str] | None = None) -> StreamingQuery:
    """Stream published drafts into the voice table: one row a draft, however often it comes, by keyed state of the checkpoint. A batch that comes again is written over itself.

    With ``candidates`` the extraction ``buckets`` of the drafts (see ``memory.candidates``; the draft's id is theirs) go to a table there in the same way.
    """
    def write(batch: DataFrame, number: int) -> None:
        once, spark = batch.persist(), batch.sparkSession
        feedback_rows(once).write.mode("overwrite").parquet(f"{voice}/batch={number}")
        if candidates:
            rows = memory.candidates(once.withColumnRenamed("draft_id", "id"), buckets or [])
            known = _table(spark, candidates)
            if known is not None:
                rows = rows.join(known.where(F.col("batch") < number).select("fingerprint"), "fingerprint", "left_anti")
            rows.write.mode("overwrite").parquet(f"{candidates}/batch={number}")
        once.unpersist()

    return started(first_by_key(published, ["draft_id"], ["final_text"]), write, checkpoint)
