"""Streams with keyed state: replays, late rows, restarts, rows without a key, keys that are forgotten."""

import shutil

import pytest
from pyspark.sql import functions as F

from textloom.streaming import ingest

POST = "channel_id long, message_id long, text string, date timestamp, forwarded boolean"


@pytest.fixture
def world(spark, tmp_path):
    class World:
        ledger, dead = str(tmp_path / "ledger"), str(tmp_path / "dead")

        def arrive(self, *rows):
            made = [(c, m, t * 90, d, False) for c, m, t, d in rows]
            spark.createDataFrame(made, POST.replace("timestamp", "string")).withColumn("date", F.to_timestamp("date")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

        def run(self, checkpoint="c", **more):
            posts = spark.readStream.schema(POST).parquet(str(tmp_path / "in"))
            query = ingest.channel_posts(posts, self.ledger, self.dead, str(tmp_path / checkpoint), **more)
            query.awaitTermination()
            return query

        def held(self):
            return sorted((r.channel_id, r.message_id, r.text[0]) for r in spark.read.parquet(self.ledger).collect())

    return World()


def test_replays_late_rows_and_rows_without_a_key(spark, world):
    world.arrive((1, 1, "b", "2024-05-01"), (1, 1, "a", "2024-05-01"), (None, 1, "x", "2024-05-01"), (None, 1, "x", "2024-05-01"), (2, 2, "y", None))
    world.run()
    assert world.held() == [(1, 1, "a")] and spark.read.parquet(world.dead).count() == 3
    shutil.rmtree(world.ledger)  # a batch reads its state, not the ledger
    world.arrive((1, 1, "0", "2020-01-01"), (1, 2, "l", "2019-01-01"), (1, 3, "n", "2024-06-01"), (1, 3, "n", "2024-06-01"))
    world.run()
    assert world.held() == [(1, 2, "l"), (1, 3, "n")] and spark.read.parquet(world.dead).count() == 3
    world.run("other")  # a new checkpoint takes all posts again, and what is done from the ledger
    assert world.held() == [(1, 1, "0"), (1, 2, "l"), (1, 3, "n")]


def test_a_batch_that_failed_comes_again(spark, world, monkeypatch):
    world.arrive((1, 1, "a", "2024-05-01"), (None, 1, "x", "2024-05-01"))
    with monkeypatch.context() as m:
        m.setattr(ingest, "voice_rows", lambda _: (_ for _ in ()).throw(RuntimeError("sink")))
        with pytest.raises(Exception, match="sink"):
            world.run()
    assert spark.read.parquet(world.dead).count() == 1
    world.run()
    world.run()
    assert world.held() == [(1, 1, "a")] and spark.read.parquet(world.dead).count() == 1


def test_a_key_is_forgotten_after_its_time(spark, world):
    day = 24 * 3600 * 1000
    for rows in ([(1, 1, "a", "2024-05-01")], [(1, 1, "b", "2024-05-02"), (1, 2, "c", "2024-05-30")], [(1, 1, "d", "2024-06-01"), (1, 2, "e", "2024-06-01")]):
        world.arrive(*rows)
        world.run(expire=("1 day", 10 * day))
    assert world.held() == [(1, 1, "a"), (1, 1, "d"), (1, 2, "c")]
