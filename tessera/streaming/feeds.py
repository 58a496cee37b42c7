"""Structured Streaming forms of ingestion, event handling and promotion."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.plans.scratch import shared_dir


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 1000, **options) -> DataFrame:
    """Files as they arrive, each once: the checkpoint remembers them."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).options(**options).load(path)


def drained(stream: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over what is there now, and give its output as a table of the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/tessera/stream-{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if each:
        writer.foreachBatch(each).start().awaitTermination()
        return spark.createDataFrame([], stream.schema)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def save(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    writer.foreachBatch(save).start().awaitTermination()
    every = spark.read.parquet(f"{base}/out")
    return every.join(F.broadcast(every.agg(F.max("epoch").alias("epoch"))), "epoch", "left_semi").drop("epoch")


def deduplicated(events: DataFrame, identity: list[str], ts: str, delay: str) -> DataFrame:
    """The first event of an identity; state is kept for ``delay`` only."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(identity)


def lateness(events: DataFrame, ts: str, received: str, limit: int) -> DataFrame:
    """All events, with how late they came and a flag; nothing is dropped."""
    late = F.unix_timestamp(received) - F.unix_timestamp(ts)
    return events.withColumn("late_seconds", late).withColumn("is_late", late > limit)


def volumes(events: DataFrame, ts: str, by: list[str], window: str = "15 minutes", delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    out = events.withWatermark(ts, delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.max(ts).alias("last_seen"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "last_seen")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str, delay: str = "1 hour") -> DataFrame:
    out = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that processors with several states and timers need, for the streams started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _OpenStay(StatefulProcessor):
    """One open stay a member: admission opens, discharge closes, a timer marks what stays open too long."""

    def __init__(self, admit: str, discharge: str, timeout_ms: int):
        self.admit, self.discharge, self.timeout = admit, discharge, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("since", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        out, since = [], self.state.get()[0] if self.state.exists() else None
        events = pd.concat(list(rows)).sort_values(["ms", "event_id"])
        for kind, ms in zip(events.kind, events.ms, strict=True):
            if kind == self.admit and since is None:
                since = int(ms)
                self.handle.registerTimer(since + self.timeout)
            elif kind == self.discharge and since is not None:
                out.append((key[0], since, int(ms), "closed"))
                since = None
        if since is None:
            if self.state.exists():
                self.state.clear()
        else:
            self.state.update((since,))
        yield pd.DataFrame(out, columns=["member", "admit_ms", "end_ms", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        out = []
        if self.state.exists() and self.state.get()[0] + self.timeout <= expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], self.state.get()[0], expiredTimerInfo.getExpiryTimeInMs(), "timed_out"))
            self.state.clear()
        yield pd.DataFrame(out, columns=["member", "admit_ms", "end_ms", "state"])

    def close(self) -> None:
        pass


def open_stays(events: DataFrame, member: str, ts: str, kind: str, admit: str, discharge: str, days: int, delay: str = "1 day") -> DataFrame:
    """``(member, admit_ms, end_ms, state)``: closed and timed-out stays from an event stream with ``event_id``."""
    rows = events.withWatermark(ts, delay).select(F.col(member).alias("member"), F.col(kind).alias("kind"), F.unix_millis(ts).alias("ms"), "event_id", ts)
    return rows.groupBy("member").transformWithStateInPandas(_OpenStay(admit, discharge, days * 86_400_000), "member long, admit_ms long, end_ms long, state string", "append", "eventTime")


def upsert(path: str, key: list[str], order: list[str], buckets: int = 8) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps each key's newest row; only the buckets that a batch touches are rewritten, and a repeated batch changes nothing."""
    from tessera.operators.ledger import latest_by
    from tessera.plans.scratch import written

    def merge(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        new = rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        try:
            old = spark.read.parquet(path)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            old = new.limit(0)
        touched = old.join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi").select(*new.columns)
        merged = written(latest_by(touched.unionByName(new), key, order), "merged")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return merge


def promoting(spec, path: str, batch: str, results: list) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that promotes each micro-batch whole, under a batch id that a replay repeats, and keeps its balance row."""
    from tessera.operators.mapping import promote

    def run(rows: DataFrame, epoch: int) -> None:
        if rows.limit(1).count():
            results.append(promote(rows, spec, path, f"{batch}-{epoch}"))

    return run
