"""Ingest as streams: late data, deduplication by key or by a bounded ring, idempotent appends, source state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DateType, LongType, StructField, StructType

RING = 200


def fresh(items: DataFrame, at: str, as_of: Column, days: int = 14, keep_undated: bool = False) -> DataFrame:
    """Items of the last ``days`` before ``as_of`` (a value, not the clock); undated ones go unless they are to be kept."""
    new = F.col(at) >= as_of - F.expr(f"INTERVAL {days} DAYS")
    return items.where(F.coalesce(new, F.lit(keep_undated)))


def distinct_within(items: DataFrame, at: str, key: list[str], late: str = "14 days") -> DataFrame:
    """The first item of each key; state of keys older than the watermark is dropped, later items too."""
    return items.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


class Ring(StatefulProcessor):
    """Per source: passes items whose hash isn't among the last ``size`` that were passed.

    With ``at`` items of a batch are taken in order of that time, and a source's state goes when the watermark is
    ``keep_ms`` past its last item.
    """

    def __init__(self, source: str, hash_: str, size: int = RING, at: str | None = None, keep_ms: int = 0):
        self.source, self.hash, self.size, self.at, self.keep_ms = source, hash_, size, at, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "hash string")
        if self.at:
            self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, newest = [r[0] for r in self.seen.get()], 0
        parts = [pd.concat(list(rows)).sort_values([self.at, self.hash], kind="stable")] if self.at else rows
        for part in parts:
            known, keep = set(seen), []
            for h in part[self.hash]:
                keep.append(h not in known)
                if keep[-1]:
                    known.add(h)
                    seen.append(h)
                    if len(seen) > self.size:
                        known.discard(seen.pop(0))
            if self.at:
                newest = max(newest, int(part[self.at].max().timestamp() * 1000))
            if any(keep):
                yield part[keep]
        self.seen.put([(h,) for h in seen])
        if self.at:
            self._keep_until(newest)

    def _keep_until(self, newest: int) -> None:
        """One timer a source, behind its newest item."""
        last = self.last.get()[0] if self.last.exists() else None
        if last is None or newest > last:
            if last is not None:
                self.handle.deleteTimer(last + self.keep_ms)
            self.handle.registerTimer(newest + self.keep_ms)
            self.last.update((newest,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def ring_distinct(items: DataFrame, source: str, hash_: str, size: int = RING, at: str | None = None, keep: str | None = None) -> DataFrame:
    """Deduplication against the exact ring of each source's last hashes (state of ``size`` hashes a source).

    ``at`` and ``keep`` (``"14 days"``): items are late by ``keep`` at most, and the ring of a source without items for so long goes.
    """
    if not at:
        return items.groupBy(source).transformWithStateInPandas(statefulProcessor=Ring(source, hash_, size), outputStructType=items.schema, outputMode="Append", timeMode="None")
    ring = Ring(source, hash_, size, at, int(pd.Timedelta(keep).total_seconds() * 1000))
    return items.withWatermark(at, keep).groupBy(source).transformWithStateInPandas(statefulProcessor=ring, outputStructType=items.schema, outputMode="Append", timeMode="EventTime")


STATE = "source string, status string, empty_runs int, block_strikes int, last_at timestamp"


def next_state(state: tuple[int, int, str], found: int, blocked: bool) -> tuple[int, int, str]:
    """(empty runs, block strikes, status) after one run: 3 empty runs warn, 5 pause, 40 disable; 5 block strikes disable; items resume."""
    empty, strikes, _ = state
    if blocked:
        strikes += 1
        return empty, strikes, "disabled" if strikes >= 5 else "paused"
    if found:
        return 0, 0, "active"
    empty += 1
    return empty, strikes, "disabled" if empty >= 40 else "paused" if empty >= 5 else "warned" if empty >= 3 else "active"


class SourceState(StatefulProcessor):
    """Per source: folds its runs (at, found, blocked) in order of time into its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "empty int, strikes int, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else (0, 0, "active")
        runs = pd.concat(list(rows)).sort_values("at")
        for found, blocked in zip(runs["found"], runs["blocked"]):
            state = next_state(state, int(found), bool(blocked))
        self.state.update(state)
        yield pd.DataFrame({"source": [key[0]], "status": [state[2]], "empty_runs": [state[0]], "block_strikes": [state[1]], "last_at": [runs["at"].max()]})

    def close(self) -> None:
        pass


def source_states(runs: DataFrame) -> DataFrame:
    """(source, status, empty_runs, block_strikes, last_at) of the sources that ran, after each batch."""
    return runs.groupBy("source").transformWithStateInPandas(statefulProcessor=SourceState(), outputStructType=StructType.fromDDL(STATE), outputMode="Update", timeMode="None")


def finished(stream: DataFrame, folder: str, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """What a stream gives from all that is there now, as a table in ``folder``; one that runs again goes on where it ended.

    In mode ``update`` a row of ``key`` replaces those of the batches before; a batch that runs again replaces itself.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(f"{folder}/rows")
    else:
        query = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    every = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/rows")
    last = every.groupBy(*key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("row"))
    return last.select("row.*")


def append_new(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the rows whose key the Parquet table at ``path`` lacks, so a batch that runs again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.dropDuplicates(key)
        if _exists(batch.sparkSession, path):
            batch = batch.join(batch.sparkSession.read.schema(batch.schema).parquet(path).select(*key), key, "left_anti")
        batch.write.mode("append").parquet(path)

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


class DatedTable:
    """A table of rows by day that batches append to once: rows and cursor of a batch become visible together.

    Rows lie in folders of batch and day.  A batch's rows are only compared with those of its own days, so it reads just
    their folders, and of these just the key; the key must decide the day (a posting's link and date of publication).
    A batch is there once its cursor is: a batch that failed halfway is written anew over what it left, one that is
    there already adds nothing, and readers see whole batches.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], at: str):
        self.spark, self.path, self.key, self.at = spark, path, key, at

    def last(self) -> int:
        """The last batch that is there; -1 before the first."""
        if not _exists(self.spark, f"{self.path}/cursors"):
            return -1
        return self.spark.read.schema("batch bigint").parquet(f"{self.path}/cursors").agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]

    def cursor(self) -> DataFrame | None:
        """What the last batch said of how far it got."""
        n = self.last()
        return None if n < 0 else self.spark.read.parquet(f"{self.path}/cursors/batch={n}")

    def rows(self, schema: StructType) -> DataFrame:
        """The rows of all batches that are there, with their day."""
        whole = StructType([*schema.fields, StructField("batch", LongType()), StructField("day", DateType())])
        if self.last() < 0:
            return self.spark.createDataFrame([], whole).drop("batch")
        return self.spark.read.schema(whole).parquet(f"{self.path}/rows").where(F.col("batch") <= self.last()).drop("batch")

    def new_rows(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch``, the first of each key, that the table lacks."""
        dated = batch.withColumn("day", F.coalesce(F.to_date(self.at), F.lit("1970-01-01").cast("date"))).dropDuplicates(self.key)
        days = [r.day for r in dated.select("day").distinct().collect()]  # as many as days that a batch spans
        have = self.rows(batch.schema).where(F.col("day").isin(days)) if days else self.rows(batch.schema).limit(0)
        return dated.join(have.select("day", *self.key), ["day", *self.key], "left_anti")

    def append(self, batch: DataFrame, n: int, cursor: DataFrame | None = None) -> None:
        """Batch ``n`` with its cursor (one row of any columns); for foreachBatch."""
        if n <= self.last():
            return
        new = self.new_rows(batch)
        new.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/rows/batch={n}")
        mark = self.spark.range(1).select(F.lit(n).alias("at_batch")) if cursor is None else cursor
        mark.write.mode("overwrite").parquet(f"{self.path}/cursors/batch={n}")
