"""Monitoring rollups: progress, retries, histories, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchtally.functions.values import epoch_seconds, floor_to_history, round_half_up
from batchtally.operators.logs import error_signature
from batchtally.operators.telemetry import failed_attempts
from batchtally.plans.scan import MAX_GROUP_ROWS, carry_last
from batchtally.plans.storage import write_and_read

# Fixed values.
MEASURES = ("nevents_total", "nevents_done", "njobs_total", "njobs_done")
GRID_STATES = ("unsubmitted", "idle", "running", "failed", "transferring", "transferred", "cooloff", "finished")
HIDDEN_TYPE = "BABY"


def with_done(outputs: DataFrame) -> DataFrame:
    """Done: the output exists and its job is off the queue."""
    return outputs.withColumn("done", F.col("output_exists") & ~F.col("is_on_queue"))


def dataset_rollup(outputs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Jobs and events per dataset, with the missing events.

    ``outputs(dataset, nevents, done)``, ``datasets(dataset, queried_nevents, ...)``.
    """
    done = F.col("done")
    sums = outputs.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("njobs_total"),
        F.count_if(done).alias("njobs_done"),
        F.sum(F.when(done, F.col("nevents")).otherwise(F.lit(0))).cast("bigint").alias("nevents_done"),
    )
    filled = datasets.join(sums, "dataset", "left").na.fill(0, ["njobs_total", "njobs_done", "nevents_done"])
    total = F.coalesce("queried_nevents", F.lit(0)).cast("bigint")
    return filled.withColumns(
        {"nevents_total": total, "missing_events": F.greatest(total - F.col("nevents_done"), F.lit(0))}
    ).drop("queried_nevents")


def general_record(rollup: DataFrame) -> DataFrame:
    return rollup.withColumns({"status": F.lit("running"), "type": F.lit("CMSSW")})


def bad_jobs(outputs: DataFrame, mapping: DataFrame, attempts: DataFrame, logs: DataFrame, *, body: Column | str = "err") -> DataFrame:
    """Not-done outputs with at least one retry.

    ``logs`` holds ``cluster_id, log`` and the text ``body``; the error shown is that of
    the attempt before the last. Logs are picked by cluster before a text is looked
    into, so signatures are made of the asked-for logs alone.
    """
    keys = ["dataset", "out_index"]
    earlier = failed_attempts(attempts, outputs).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("retries"), F.max_by("cluster_id", "attempt_no").alias("cluster_id")
    )
    earlier = write_and_read(earlier, "earlier")  # read three times below
    inputs = mapping.join(earlier.select(*keys), keys, "left_semi").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("inputs"), F.sum("in_nevents").cast("bigint").alias("events")
    )
    asked = logs.join(earlier.select("cluster_id"), "cluster_id", "left_semi")
    errors = asked.select("cluster_id", error_signature(body).alias("last_error"), F.col("log").alias("last_log"))
    return (
        earlier.join(inputs, keys, "left")
        .join(errors, "cluster_id", "left")
        .select(
            *keys,
            "retries",
            F.coalesce("inputs", F.lit(0)).alias("inputs"),
            F.coalesce("events", F.lit(0)).alias("events"),
            F.coalesce("last_error", F.lit("")).alias("last_error"),
            F.coalesce("last_log", F.lit("")).alias("last_log"),
        )
    )


def history_points(rollup: DataFrame, now: int | Column) -> DataFrame:
    """One point per dataset at the 5-minute mark of ``now``."""
    stamp = now if isinstance(now, Column) else F.lit(now)
    return rollup.select("dataset", floor_to_history(stamp).alias("ts"), *MEASURES)


def merge_history(old: DataFrame | None, new: DataFrame, *, keep: bool = True) -> DataFrame:
    """Old points of the datasets in ``new``, then the new points; only the new columns stay."""
    if old is None or not keep:
        return new
    missing = [c for c in new.columns if c not in old.columns]
    known = old.withColumns({c: F.lit(None) for c in missing}) if missing else old
    here = new.select("dataset").distinct()
    return known.join(here, "dataset", "left_semi").select(*new.columns).unionByName(new)


def merge_history_arrays(old: DataFrame, new: DataFrame) -> DataFrame:
    """Array form: per measure of ``new``, old values and then new ones."""
    measures = [c for c in new.columns if c != "dataset"]
    prior = old.select("dataset", *[F.col(c).alias(f"_o_{c}") for c in measures if c in old.columns])
    joined = new.join(prior, "dataset", "left")
    for c in measures:
        if f"_o_{c}" in joined.columns:
            joined = joined.withColumn(c, F.concat(F.coalesce(F.col(f"_o_{c}"), F.slice(c, 1, 0)), F.col(c)))
    return joined.select(*new.columns)


def carry_over(old: DataFrame, new: DataFrame) -> DataFrame:
    """All of ``new`` plus the prior records of datasets absent from it."""
    return old.join(new.select("dataset"), "dataset", "left_anti").unionByName(new, allowMissingColumns=True)


def latest_summaries(summaries: DataFrame, stamp: str = "poll_ts") -> DataFrame:
    """The newest record of each dataset."""
    rest = [c for c in summaries.columns if c != "dataset"]
    newest = summaries.groupBy("dataset").agg(F.max_by(F.struct(*rest), F.col(stamp)).alias("_s"))
    return newest.select("dataset", "_s.*")


def grand_totals(rollup: DataFrame) -> DataFrame:
    """Sums over all datasets; percentages to 2 decimals, NULL on a zero total."""
    sums = rollup.agg(*[F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(m) for m in MEASURES])

    def pct(done: str, total: str) -> Column:
        return round_half_up(F.lit(100.0) * F.col(done) / F.nullif(F.col(total), F.lit(0)), 2)

    return sums.withColumns(
        {
            "nevents_missing": F.col("nevents_total") - F.col("nevents_done"),
            "njobs_running": F.col("njobs_total") - F.col("njobs_done"),
            "pct_events": pct("nevents_done", "nevents_total"),
            "pct_jobs": pct("njobs_done", "njobs_total"),
        }
    )


def progress(rollup: DataFrame) -> DataFrame:
    """Add ``pct`` (0 without jobs) and its rounded ``label``."""
    pct = F.when(F.col("njobs_total") > 0, F.lit(100.0) * F.col("njobs_done") / F.col("njobs_total")).otherwise(F.lit(0.0))
    return rollup.withColumn("pct", pct).withColumn("label", round_half_up(F.col("pct")).cast("bigint"))


def sort_datasets(rollup: DataFrame, by: str = "name") -> DataFrame:
    """By name, or by progress with the name as tie-break."""
    if by == "name":
        return rollup.orderBy("dataset")
    return progress(rollup).orderBy("pct", "dataset")


def history_totals(history: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Sums of the measures per timestamp; double points count twice."""
    return history.groupBy("ts").agg(*[F.sum(m).cast("bigint").alias(m) for m in measures])


def explode_history(arrays: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Parallel arrays to one row per timestamp."""
    zipped = F.arrays_zip(F.col("timestamps").alias("ts"), *[F.col(m) for m in measures])
    return arrays.select("dataset", F.explode(zipped).alias("_h")).select("dataset", "_h.*")


def chart_series(totals: DataFrame) -> DataFrame:
    return totals.select("ts", "njobs_done", "njobs_total").orderBy("ts")


def visible_types(tasks: DataFrame) -> DataFrame:
    """Tasks to export: every type but the hidden one; an unknown type is exported."""
    return tasks.filter(~F.col("type").eqNullSafe(F.lit(HIDDEN_TYPE)))


def status_breakdown(jobs: DataFrame) -> DataFrame:
    """Jobs per state and task, zero-filled; ``unknown`` counts states outside the list."""
    s = F.col("status")
    return jobs.groupBy("task").agg(
        *[F.count_if(s == state).alias(state) for state in GRID_STATES],
        F.count_if(~F.coalesce(s.isin(*GRID_STATES), F.lit(False))).alias("unknown"),
    )


def job_info(jobs: DataFrame, order: str = "seq") -> DataFrame:
    """Last listed status of each job; ``UNKNOWN`` when none."""
    return jobs.groupBy("task", "jobid").agg(F.coalesce(F.max_by("status", order), F.lit("UNKNOWN")).alias("status"))


def last_good_status(polls: DataFrame, *, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Per poll, its status or the last good one before it; ``UNKNOWN`` when there is none."""
    carried = carry_last(polls, ["task"], ["poll_ts", "poll_id"], {"shown": "status"}, max_group_rows=max_group_rows)
    return carried.withColumn("shown", F.coalesce("shown", F.lit("UNKNOWN")))


def current_status(polls: DataFrame) -> DataFrame:
    """The status to show now: the newest good one of each task."""
    good = F.when(F.col("status").isNotNull(), F.struct("poll_ts", "poll_id", "status"))
    return polls.groupBy("task").agg(F.coalesce(F.max(good)["status"], F.lit("UNKNOWN")).alias("shown"))


def minutes_since_submit(tasks: DataFrame, now: int, name: str = "request") -> DataFrame:
    """Minutes since the leading UTC stamp of the request name.

    ``minutes`` drops whole days; ``elapsed`` is the true distance.
    """
    text = F.substring_index(name, ":", 1)
    century = F.when(F.substring(text, 1, 2) >= "69", F.lit("19")).otherwise(F.lit("20"))
    then = epoch_seconds(F.to_timestamp_ntz(F.concat(century, text), F.lit("yyyyMMdd_HHmmss")))
    return tasks.withColumns(
        {"minutes": F.pmod(F.lit(now) - then, F.lit(86400)) / 60.0, "elapsed": (F.lit(now) - then) / 60.0}
    )


def sum_maps(df: DataFrame, col: str) -> DataFrame:
    """Key-wise sum of a map column over all rows."""
    return df.select(F.explode(col).alias("key", "_v")).groupBy("key").agg(F.sum("_v").alias("total"))
