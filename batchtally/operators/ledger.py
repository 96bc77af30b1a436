"""Ledger: outputs joined with listings, queue and attempts; state and completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from batchtally.functions.paths import log_path
from batchtally.functions.values import hours_between, status_name
from batchtally.plans.scan import number_rows

# A job may run this long, and be held this long.
MAX_RUNNING_HOURS = 24.0
MAX_HELD_HOURS = 5.0


def with_existence(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Add ``exists``: listed, or marked fake. ``listing`` holds ``name``."""
    listed = listing.select("name").distinct().withColumn("_listed", F.lit(True))
    seen = files.join(listed, "name", "left")
    return seen.withColumn("exists", F.coalesce("fake", F.lit(False)) | F.col("_listed").isNotNull()).drop("_listed")


def first_queue_rows(queue: DataFrame, order: str = "cluster_id") -> DataFrame:
    """The first queue row of each (task, jobnum)."""
    rest = [c for c in queue.columns if c not in ("task", "jobnum")]
    row = F.min_by(F.struct(*rest), F.col(order)).alias("_row")
    return queue.groupBy("task", "jobnum").agg(row).select("task", "jobnum", "_row.*")


def with_queue(outputs: DataFrame, queue: DataFrame, order: str = "cluster_id") -> DataFrame:
    """Outputs with their queue row by job number, ``on_queue`` and ``done``."""
    first = first_queue_rows(queue, order).withColumn("_q", F.lit(True)).withColumnRenamed("jobnum", "out_index")
    joined = outputs.join(first, ["task", "out_index"], "left")
    on_queue = F.col("_q").isNotNull()
    return joined.withColumn("on_queue", on_queue).withColumn("done", F.col("exists") & ~F.col("on_queue")).drop("_q")


def job_actions(ledger: DataFrame, now: int | Column) -> DataFrame:
    """Add ``state``, ``hours`` and ``action`` to rows of ``with_queue``.

    ``status`` is the queue letter; a missing one counts as idle. Limits are strict.
    """
    status = F.when(F.col("on_queue"), F.coalesce("status", F.lit("I")))
    hours = F.when(F.col("on_queue"), hours_between(now, "entered"))
    too_long = ((F.col("state") == "R") & (F.col("hours") > MAX_RUNNING_HOURS)) | (
        (F.col("state") == "H") & (F.col("hours") > MAX_HELD_HOURS)
    )
    return (
        ledger.withColumns({"state": status, "hours": hours})
        .withColumn(
            "action",
            F.when(F.col("done"), "none").when(~F.col("on_queue"), "submit").when(too_long, "remove").otherwise("wait"),
        )
        .withColumn("reason", F.when(F.col("action") == "remove", F.when(F.col("state") == "R", "running").otherwise("held")))
    )


def append_attempts(attempts: DataFrame, submitted: DataFrame) -> DataFrame:
    """Attempts plus one for each submitted ``(dataset, out_index, cluster_id)``."""
    keys = ["dataset", "out_index"]
    last = attempts.groupBy(*keys).agg(F.max("attempt_no").alias("_last"))
    placed = number_rows(submitted, keys, ["cluster_id"])
    fresh = placed.join(last, keys, "left").select(
        *keys, (F.coalesce("_last", F.lit(0)) + F.col("pos")).cast("int").alias("attempt_no"), "cluster_id"
    )
    return attempts.select(*keys, F.col("attempt_no").cast("int").alias("attempt_no"), "cluster_id").unionByName(fresh)


def completion(outputs: DataFrame, units: DataFrame, *, key: str = "dataset", min_fraction: float = 1.0) -> DataFrame:
    """Completion per unit in its three variants.

    ``outputs(key, exists, done)``; ``units(key)`` also names units without outputs.
    queue: share of done outputs, empty 0. base: all exist, empty complete.
    move: share that exist, empty NULL.
    """
    stats = outputs.groupBy(key).agg(
        F.avg(F.col("done").cast("double")).alias("_done"),
        F.avg(F.col("exists").cast("double")).alias("_exists"),
        F.bool_and("exists").alias("_all"),
    )
    done = F.coalesce("_done", F.lit(0.0))
    return units.select(key).join(stats, key, "left").select(
        key,
        done.alias("queue_fraction"),
        (done >= min_fraction).alias("queue_complete"),
        F.coalesce("_exists", F.lit(1.0)).alias("base_fraction"),
        F.coalesce("_all", F.lit(True)).alias("base_complete"),
        F.col("_exists").alias("move_fraction"),
        (F.col("_exists") >= min_fraction).alias("move_complete"),
    )


def completed_outputs(outputs: DataFrame, by: str = "exists") -> DataFrame:
    """Outputs that exist, or (``by='done'``) that are done."""
    return outputs.filter(F.coalesce(by, F.lit(False)))


def mapping_rows_done(outputs: DataFrame, key: str = "map_id") -> DataFrame:
    """Per mapping row: do all of its outputs exist; pending is the negation."""
    return outputs.groupBy(key).agg(F.bool_and("exists").alias("all_done")).withColumn("pending", ~F.col("all_done"))


def chain_requirements(tasks: DataFrame) -> DataFrame:
    """``(path, position, task)`` to ``(path, task, requires)``: each task requires its predecessor."""
    chain = W.partitionBy("path").orderBy("position", "task")  # a path is one user's chain of tasks, never large
    return tasks.select("path", "task", F.lag("task").over(chain).alias("requires"))


def readiness(tasks: DataFrame, edges: DataFrame, complete: DataFrame) -> DataFrame:
    """Per task: requirements satisfied (none is satisfied), and ready to start.

    ``tasks(task)``, ``edges(task, requires)``, ``complete(task, complete)``.
    """
    state = complete.select(F.col("task").alias("requires"), F.col("complete").alias("_ok"))
    met = (
        edges.filter(F.col("requires").isNotNull())
        .join(state, "requires", "left")
        .groupBy("task")
        .agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("_met"))
    )
    return (
        tasks.select("task")
        .join(met, "task", "left")
        .join(complete.select("task", "complete"), "task", "left")
        .withColumn("satisfied", F.coalesce("_met", F.lit(True)))
        .withColumn("ready", F.col("satisfied") & ~F.coalesce("complete", F.lit(False)))
        .drop("_met")
    )


def path_status(tasks: DataFrame, complete: DataFrame) -> DataFrame:
    """A path is complete when its last task is; also counts of its tasks."""
    joined = tasks.join(complete.select("task", "complete"), "task", "left").withColumn(
        "complete", F.coalesce("complete", F.lit(False))
    )
    return joined.groupBy("path").agg(
        F.max_by("complete", F.struct("position", "task")).alias("complete"),
        F.count(F.lit(1)).alias("n_tasks"),
        F.count_if("complete").alias("n_complete"),
    )


def complete_list(tasks: DataFrame, complete: DataFrame) -> DataFrame:
    """Completion of each task of a path with its place in the chain."""
    placed = number_rows(tasks, ["path"], ["position", "task"])
    done = complete.select("task", "complete")
    return placed.join(done, "task", "left").select(
        "path", "pos", "task", F.coalesce("complete", F.lit(False)).alias("complete")
    )


def last_attempts(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("dataset", "out_index").agg(
        F.max_by("cluster_id", "attempt_no").alias("last_cluster"), F.count(F.lit(1)).alias("n_attempts")
    )


def attempt_logs(attempts: DataFrame, logdir: Column) -> DataFrame:
    """Attempts with both log paths."""
    return attempts.withColumns(
        {"log_err": log_path(logdir, "cluster_id", "err"), "log_out": log_path(logdir, "cluster_id", "out")}
    )


def task_summary(outputs: DataFrame, attempts: DataFrame, queue: DataFrame) -> DataFrame:
    """One row per output: last attempt, its whole queue row as ``job_*``, and whether it is queued by cluster id.

    The inputs (mapping) and the attempts stay tables of their own, keyed by
    (dataset, out_index), so no list grows without bound.
    """
    fields = [c for c in queue.columns if c not in ("task", "jobnum", "cluster_id")]
    current = queue.groupBy("cluster_id").agg(
        F.max(F.struct(*fields)).alias("_job")
    ).select(F.col("cluster_id").alias("last_cluster"), "_job")
    joined = outputs.join(last_attempts(attempts), ["dataset", "out_index"], "left").withColumns(
        {
            "last_cluster": F.coalesce("last_cluster", F.lit(-1)),
            "n_attempts": F.coalesce("n_attempts", F.lit(0)),
        }
    )
    return joined.join(current, "last_cluster", "left").select(
        *outputs.columns,
        "last_cluster",
        "n_attempts",
        (F.col("_job").isNotNull() & (F.col("n_attempts") > 0)).alias("is_on_queue"),
        *[F.col(f"_job.{c}").alias(f"job_{c}") for c in fields],
    )


def queried_events(datasets: DataFrame) -> DataFrame:
    """Cached event total of a closed dataset, live one of an open dataset."""
    pick = F.when(~F.coalesce("open", F.lit(False)), F.col("cached_nevents")).otherwise(F.col("live_nevents"))
    return datasets.withColumn("queried_nevents", pick)


def with_status_name(df: DataFrame, code: str = "code") -> DataFrame:
    return df.withColumn("label", status_name(code))
