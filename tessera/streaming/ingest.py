"""Micro-batch ingest: each batch is merged into a table by key, and its figures go to a ledger."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.lists import upserted


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


def _newest(spark: SparkSession, table: str, before: int | None = None) -> dict[int, int]:
    """The batch that each part of the table was last written by (before a batch): a row a part and batch is read, and there are few parts."""
    if not _exists(spark, f"{table}/pointers"):
        return {}
    rows = spark.read.schema("part int, batch long").json(f"{table}/pointers")
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return {r["part"]: r["last"] for r in rows.groupBy("part").agg(F.max("batch").alias("last")).collect()}


def current(spark: SparkSession, table: str, schema: str, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
    """The table after its last batch, or after the last before a batch (empty before the first), or only some parts of it."""
    folders = [f"{table}/data/batch={b}/part={p}" for p, b in _newest(spark, table, before).items() if parts is None or p in parts]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, schema: str, keys: list[str], order: str, content: list[str], every: str | None = None, parts: int = 16) -> StreamingQuery:
    """Merge a stream into a table: the last row of a key wins, equal content changes nothing.

    The table is cut into parts by a hash of the key; a batch reads and writes only the parts that its keys are in. What a batch
    wrote, which parts, and what it created, updated and skipped (table/ledger) are folders named after the batch: a batch that is tried
    again starts from the state before it and replaces its own. Parts that two later batches have replaced are deleted.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
        touched = sorted(r[0] for r in batch.select(part).distinct().collect())  # at most parts rows
        if not touched:
            return
        merged = upserted(current(spark, table, schema, number, touched), batch, keys, order, content, keep_order=True)
        folder = f"{table}/data/batch={number}"
        merged.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(folder)
        done = spark.read.schema(f"{schema}, action string, part int").parquet(folder)
        done.groupBy("action").agg(F.count("*").alias("n")).withColumn("batch", F.lit(number)).write.mode("overwrite").json(f"{table}/ledger/of={number}")
        old = _newest(spark, table, number)
        spark.createDataFrame([(p, number) for p in touched], "part int, batch long").coalesce(1).write.mode("overwrite").json(f"{table}/pointers/of={number}")
        for p in touched:  # what was replaced by the batch before this one is read by nobody
            for stale in _stale(spark, table, p, old.get(p)):
                files, where = _files(spark, stale)
                files.delete(where, True)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _stale(spark: SparkSession, table: str, part: int, last: int | None) -> list[str]:
    """Folders of a part that are older than its last state before this batch."""
    if last is None:
        return []
    rows = spark.read.schema("part int, batch long").json(f"{table}/pointers").where((F.col("part") == part) & (F.col("batch") < last)).collect()  # a row a batch
    return [f"{table}/data/batch={r['batch']}/part={part}" for r in rows]


def limited(stream: DataFrame, key: str, at: str, most: int, minutes: float, late: str = "7 days") -> DataFrame:
    """Attempts of a key with most others in the time up to them (its start excluded): an exact trailing count.

    Kept are a key's times back to the span before the watermark, so a late row that is still let in counts what lies before it and nothing after it;
    attempts that came earlier are not judged again. Attempts at the same moment count for each other in their order.
    """
    span = timedelta(minutes=minutes)

    def judge(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        out = []
        for t in sorted(x for batch in batches for x in batch[at]):
            n = sum(t - span < x <= t for x in times)
            if n >= most:
                out.append((group[0], t, n))
            times.append(t)
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        kept = [x for x in times if x.tz_localize(None) > mark - span] if hasattr(times[0], "tz_localize") else [x for x in times if pd.Timestamp(x).tz_localize(None) > mark - span]
        state.update((kept or times[-1:],))
        state.setTimeoutTimestamp(max(int((max(times) + span).timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=[key, at, "n"])

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, at).withWatermark(at, late)
    return rows.groupBy(key).applyInPandasWithState(judge, f"{key} {kind}, {at} timestamp, n long", "times array<timestamp>", "append", GroupStateTimeout.EventTimeTimeout)


def counted(stream: DataFrame, key: str, at: str, window: str = "10 minutes", slide: str = "1 minute", late: str = "7 days") -> DataFrame:
    """Attempts by key in sliding windows, for reports; items later than late are dropped."""
    return stream.withWatermark(at, late).groupBy(key, F.window(at, window, slide)).agg(F.count("*").alias("n"))
