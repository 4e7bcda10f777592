"""Incremental operators on Structured Streaming: changed files, seen keys, budgets, decisions, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.sources.storage import changed


def process_changed(stream: DataFrame, state_path: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``sink`` on files (path, hash, ...) whose hash is not in the state yet; a hash is written only after the sink has returned.

    A batch that is repeated after a failure finds the hashes that were written and repeats only the rest. Returns the query, which takes all there is and stops.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            state = spark.read.schema("path string, hash string, batch long").parquet(state_path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            state = spark.createDataFrame([], "path string, hash string, batch long")
        last = state.groupBy("path").agg(F.max_by("hash", "batch").alias("hash"))
        new = changed(batch.dropDuplicates(["path", "hash"]), last).persist()
        if not new.isEmpty():
            sink(new, number)
            new.select("path", "hash", F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(state_path)
        new.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unseen(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the watermark; state is bounded by it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def first_seen(stream: DataFrame, key: str, keep: timedelta | None = None) -> DataFrame:
    """The first row of each key, in this batch or any later one however late, with ``keep`` unless the key has not been seen for that long.

    State is one flag a key in the state store of the query (RocksDB), so a batch touches the keys it has and not all
    that are known. The flag's age is counted by the clock and starts anew each time the key comes; Spark looks for old flags in batches without
    data too, so with ``keep`` the query needs a trigger that goes on, not one that ends with the data. Of rows of one batch that share a key any one may pass; a null key is a key.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    life = None if keep is None else int(keep.total_seconds() * 1000)

    class First(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", "seen boolean", life)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
            known = self.seen.exists()
            for part in rows:
                if not known and len(part):
                    known = True
                    yield part.head(1)
            if not (known and life is None and self.seen.exists()):
                self.seen.update((True,))

        def close(self) -> None:
            pass

    return stream.groupBy(key).transformWithStateInPandas(First(), stream.schema, "Append", "None" if life is None else "ProcessingTime")


def windowed(stream: DataFrame, time: str, by: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def within_budget(stream: DataFrame, key: str, budget: int) -> DataFrame:
    """The first ``budget`` rows of each key, by state that outlives batches: one counter a key."""
    schema = stream.schema

    def take(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        for p in parts:
            got = p.head(max(0, budget - used))
            used += len(got)
            if len(got):
                yield got
        state.update((used,))

    return stream.groupBy(key).applyInPandasWithState(take, schema, "used long", "append", GroupStateTimeout.NoTimeout)


def record(spark: SparkSession, path: str, kind: str, rows: DataFrame) -> None:
    """Appends decisions (key, value) of a kind; readers take the last of a key."""
    rows.select(F.lit(kind).alias("kind"), "key", "value", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def replay(wanted: DataFrame, decisions: DataFrame, strict: bool = False) -> DataFrame:
    """``wanted(kind, key)`` with the recorded value, null where there is none; strict, a miss is an error when the rows are read."""
    last = decisions.groupBy("kind", "key").agg(F.max_by("value", "at").alias("value"))
    out = wanted.join(last, ["kind", "key"], "left")
    if not strict:
        return out
    missing = F.concat(F.lit("no recorded decision for "), F.col("kind"), F.lit(" "), F.col("key"))
    return out.withColumn("value", F.when(F.col("value").isNull(), F.raise_error(missing).cast("string")).otherwise(F.col("value")))
