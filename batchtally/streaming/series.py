"""Windowed series of streams: progress history and telemetry means.

Each micro-batch is aggregated on its own and becomes a part of the series.
Whenever ``FAN`` parts of a level have come together they are merged into one of
the next level, so N batches lie in O(log N) parts and every row is rewritten
O(log N) times. A pointer names the parts that count and the last batch; it is
renamed into place after they are written, so a batch that is run again after a
failure is taken in once, and readers never see half of a merge.

No window waits for a watermark, and records that come late still count. One
stream writes a series; its checkpoint lies with it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from batchtally.operators.rollup import MEASURES
from batchtally.plans.published import fresh_folder, read_pointer, write_pointer
from batchtally.plans.storage import remove

FAN = 8  # parts of a level that are merged


@dataclass(frozen=True)
class Series:
    """``parts`` aggregates the rows of a micro-batch; ``merge`` turns parts of several batches into one of the same columns."""

    parts: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]


def add_batch(batch: DataFrame, batch_id: int, series: Series, path: str, *, fan: int = FAN) -> None:
    """Take one micro-batch into the series; nothing happens if it is in already."""
    spark = batch.sparkSession
    before = read_pointer(spark, path)
    if batch_id <= before.get("last", -1):
        return
    name = fresh_folder("part")
    series.parts(batch).write.parquet(f"{path}/{name}")
    parts, gone = [*before.get("parts", []), [0, name]], []
    while len(full := _full_level(parts, fan)) > 0:
        merged = fresh_folder("part")
        series.merge(spark.read.parquet(*[f"{path}/{n}" for _, n in full])).write.parquet(f"{path}/{merged}")
        gone += [n for _, n in full]
        parts = [p for p in parts if p not in full] + [[full[0][0] + 1, merged]]
    write_pointer(spark, path, {"last": batch_id, "parts": parts, "gone": gone})
    for n in before.get("gone", []):  # merged a batch ago; readers that began then have passed
        remove(spark, f"{path}/{n}")


def _full_level(parts: list, fan: int) -> list:
    """The parts of the lowest level that has ``fan`` of them."""
    for level in sorted({p[0] for p in parts}):
        of = [p for p in parts if p[0] == level]
        if len(of) >= fan:
            return of
    return []


def start_series(stream: DataFrame, series: Series, path: str, *, fan: int = FAN, trigger: dict | None = None) -> StreamingQuery:
    """Take every micro-batch into the series at ``path``; by default until the input is used up."""
    return (
        stream.writeStream.foreachBatch(lambda batch, batch_id: add_batch(batch, batch_id, series, path, fan=fan))
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """All parts that count."""
    parts = read_pointer(spark, path).get("parts")
    if not parts:
        raise ValueError(f"no batch of a series at {path}")
    return spark.read.parquet(*[f"{path}/{n}" for _, n in parts])


def _start(width: str) -> Column:
    return F.unix_seconds(F.window("ts", width)["start"]).alias("ts")


def progress_parts(progress: DataFrame) -> DataFrame:
    """Latest progress record ``(dataset, ts, measures)`` per dataset and 5-minute window; ``ts`` is a TIMESTAMP."""
    point = F.struct(F.col("ts").alias("at"), *MEASURES)
    return progress.groupBy("dataset", _start("5 minutes")).agg(F.max(point).alias("point"))


def merged_progress(parts: DataFrame) -> DataFrame:
    """The latest record of each window; of equal times the one with the largest measures."""
    return parts.groupBy("dataset", "ts").agg(F.max("point").alias("point"))


def progress_history(parts: DataFrame) -> DataFrame:
    """The latest record of each window over all batches."""
    return merged_progress(parts).select("dataset", "ts", *[F.col(f"point.{m}").alias(m) for m in MEASURES])


def telemetry_parts(samples: DataFrame, *, width: str = "5 minutes") -> DataFrame:
    """Count and sum of each metric per log and window of samples ``(log, ts, metric, value)``."""
    return samples.groupBy("log", "metric", _start(width)).agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("known"), F.sum("value").alias("total")
    )


def merged_telemetry(parts: DataFrame) -> DataFrame:
    return parts.groupBy("log", "metric", "ts").agg(
        F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("total").alias("total")
    )


def telemetry_means(parts: DataFrame) -> DataFrame:
    """Samples and mean of each window over all batches; the mean is NULL without a value."""
    return merged_telemetry(parts).select("log", "metric", "ts", "n", F.try_divide("total", "known").alias("mean"))


PROGRESS = Series(progress_parts, merged_progress)
TELEMETRY = Series(telemetry_parts, merged_telemetry)
