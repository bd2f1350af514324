"""State carried between the turns of conversations: split inside a micro-batch, keyed state between them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from isotherm.operators.conversation import carried_answers, conversation_parts, route_turns, routed_texts
from isotherm.session import delete_path, temporary_tables
from isotherm.sources.delimited import path_exists

ROUTED = "conv_id long, turn long, place string, fixed string, follow boolean, keyword string"
PARTS = (
    "conv_id long, anchored boolean, led boolean, source string, place string, tail string, seen timestamp, clock timestamp"
)
SEEDS = "conv_id long, batch long, seed string, seed_place string"
START = dt.datetime(1970, 1, 2, tzinfo=dt.timezone.utc)  # the clock of a stream without times; a watermark starts before it


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB; a query takes its settings along when it starts."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def summarize_conversations(
    turns: DataFrame, names: DataFrame, as_of: Column, work: str, checkpoint: str, measure: str = "ratio", ts: str | None = None
) -> StreamingQuery:
    """Route the texts of each micro-batch and reduce each conversation's turns to one part.

    ``work``/turns and ``work``/parts get a partition ``batch``; a batch that is run again replaces both. All of it
    are batch operators: a conversation with a large share of the turns is cut into blocks and never meets in one task.
    A part carries the largest time of its turns (``seen``) and of the stream so far (``clock``).
    """
    spark = turns.sparkSession
    time = F.lit(START) if ts is None else F.col(ts).cast("timestamp")

    def write(rows: DataFrame, batch: int) -> None:
        with temporary_tables(spark):
            keyed = rows.withColumn("_key", F.struct("conv_id", "turn"))
            routed = routed_texts(keyed, "_key", "text", names, as_of, measure).drop("_key")
            stored, parts = f"{work}/turns/batch={batch}", f"{work}/parts/batch={batch}"
            routed.select("conv_id", "turn", "place", "fixed", "follow", "keyword", "_ts").write.mode("overwrite").parquet(stored)
            done = spark.read.schema(f"{ROUTED}, _ts timestamp").parquet(stored)
            seen = done.groupBy("conv_id").agg(F.coalesce(F.max("_ts"), F.lit(START)).alias("seen"))
            before = f"{work}/parts/batch={batch - 1}"
            clocks = done.agg(F.max("_ts").alias("clock"))
            if path_exists(spark, before):
                clocks = clocks.unionByName(spark.read.schema(PARTS).parquet(before).agg(F.max("clock").alias("clock")))
            clock = F.lit(clocks.agg(F.greatest(F.max("clock"), F.lit(START))).first()[0])
            made = conversation_parts(route_turns(done)).join(seen, "conv_id").withColumn("clock", clock)
            made.select("conv_id", "anchored", "led", "source", "place", "tail", "seen", "clock").write.mode("overwrite").parquet(parts)

    return (
        turns.select("conv_id", "turn", "text", time.alias("_ts")).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _carrier(max_age: dt.timedelta) -> StatefulProcessor:
    """The processor of one conversation; it is defined here so that it travels to the executors by value."""
    age = int(max_age.total_seconds() * 1000)

    class Carry(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("left", "source string, place string, seen long, batch long")

        def handleInputRows(self, key, rows, timerValues):
            from pyspark.sql import Row

            held = self.state.get()
            source, place, seen, batch = held if held is not None else (None, None, 0, -1)
            for part in sorted(rows, key=lambda r: r["batch"]):
                if part["batch"] <= batch:
                    continue  # written again after a failure; it has been carried already
                clock, batch = int(part["clock"].timestamp() * 1000), part["batch"]
                if clock - seen > age:
                    source = place = None
                yield Row(conv_id=key[0], batch=batch, seed=source, seed_place=place)
                if source is None:
                    source, place = part["source"], part["place"]
                else:
                    lead = "climate" if source == "hybrid" else source
                    if part["tail"] is not None:
                        place = part["tail"]
                    elif part["led"] and lead == "climate":
                        place = ""
                    if part["anchored"]:
                        source = part["source"]
                    elif part["led"]:
                        source = lead
                seen = max(seen, int(part["seen"].timestamp() * 1000))
            self.state.update((source, place, seen, batch))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(seen + age + 1)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.state.clear()
            return iter(())

        def close(self) -> None:
            pass

    return Carry()


def carry_conversations(spark: SparkSession, work: str, out: str, checkpoint: str, max_age: dt.timedelta = dt.timedelta(days=30)) -> StreamingQuery:
    """Hand each part the state its conversation came with, and write the answers of its turns.

    The state is one value per conversation in Spark's keyed state store: a micro-batch touches the conversations that
    have parts in it and no others. When the stream's clock is more than ``max_age`` past a conversation's last
    turn it starts anew, and a timer takes its state away. The clock of a part never falls, and the watermark stays
    a second behind it, so no part is late.
    ``out`` gets a partition ``round`` of answers with their ``batch``; turns and parts of rounds that are done are deleted.
    """
    parts = spark.readStream.schema(f"{PARTS}, batch long").parquet(f"{work}/parts").withWatermark("clock", "1 second")
    seeds = parts.groupBy("conv_id").transformWithState(_carrier(max_age), SEEDS, "Append", "EventTime")

    def write(seeds: DataFrame, number: int) -> None:
        with temporary_tables(spark):
            given = seeds.persist()
            try:
                batches = sorted(r["batch"] for r in given.select("batch").distinct().collect())
                if not batches:
                    return
                turns = spark.read.option("basePath", f"{work}/turns").schema(f"{ROUTED}, batch long").parquet(*[f"{work}/turns/batch={b}" for b in batches])
                part = F.struct("conv_id", "batch").alias("conv_id")
                # Turns of one batch are answered once, with the part that is in this round.
                here = turns.join(given.select("conv_id", "batch"), ["conv_id", "batch"], "left_semi")
                answers = carried_answers(
                    here.select(part, "turn", "place", "fixed", "follow", "keyword"), given.select(part, "seed", "seed_place")
                )
                unpacked = answers.select("conv_id.*", *[c for c in answers.columns if c != "conv_id"])
                unpacked.write.mode("overwrite").parquet(f"{out}/round={number}")
            finally:
                given.unpersist()
            _forget(spark, work, batches[0])

    with _keyed_state(spark):
        return (
            seeds.writeStream.foreachBatch(write).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )


def _forget(spark: SparkSession, work: str, first: int) -> None:
    """Delete turns and parts of batches before ``first``, which earlier rounds have answered."""
    for kind in ("turns", "parts"):
        folders = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{work}/{kind}")
        system = folders.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in system.listStatus(folders):
            name = status.getPath().getName()
            if name.startswith("batch=") and int(name.removeprefix("batch=")) < first:
                delete_path(spark, status.getPath().toString())


def route_conversations(
    turns: DataFrame, names: DataFrame, as_of: Column, out: str, checkpoint: str,
    max_age: dt.timedelta = dt.timedelta(days=30), measure: str = "ratio", ts: str | None = None,
) -> StreamingQuery:
    """Route each turn of a stream (``conv_id, turn, text``) with the state of the turns before it.

    Runs the two queries above one after the other over all that is there and returns the second; both can also be
    run side by side. Run again with the same folders it goes on where it stopped. Without a column ``ts`` of event
    times no state expires.
    """
    work = f"{out}-work"
    summarize_conversations(turns, names, as_of, work, f"{checkpoint}/parts", measure, ts).awaitTermination()
    return carry_conversations(turns.sparkSession, work, out, f"{checkpoint}/state", max_age)
