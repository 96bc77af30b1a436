"""Queue snapshot from tab-separated text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of a snapshot row and letters of the status codes.
QUEUE_COLUMNS = ("ClusterId", "JobStatus", "EnteredCurrentStatus", "CMD", "ARGS", "Out", "Err", "HoldReason")
STATUS_LETTERS = {0: "U", 1: "I", 2: "R", 3: "X", 4: "C", 5: "H", 6: "E"}
REMOVED = "X"


def status_letter(code: Column | str) -> Column:
    """Letter of a numeric code; anything else is ``U``."""
    c = F.col(code) if isinstance(code, str) else code
    table = F.create_map(*[F.lit(x) for kv in STATUS_LETTERS.items() for x in kv])
    number = F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))
    return F.coalesce(F.try_element_at(table, number), F.lit("U"))


def queue_snapshot(
    lines: DataFrame,
    *,
    extra: Sequence[str] = (),
    equals: Mapping[str, str] | None = None,
    cluster_id: int | None = None,
    value: str = "value",
) -> DataFrame:
    """Rows with the right number of fields, minus removed jobs; all columns stay text."""
    names = [*QUEUE_COLUMNS, *extra]
    parts = lines.select(F.split(value, "\t").alias("_f")).filter(F.size("_f") == len(names))
    rows = parts.select(*[F.col("_f")[i].alias(n) for i, n in enumerate(names)])
    rows = rows.withColumn("JobStatus", status_letter("JobStatus")).filter(F.col("JobStatus") != REMOVED)
    for name, wanted in (equals or {}).items():
        rows = rows.filter(F.col(name) == wanted)
    return rows.filter(F.col("ClusterId") == str(cluster_id)) if cluster_id is not None else rows


def typed_queue(rows: DataFrame) -> DataFrame:
    """Snapshot with the extra columns ``taskname, jobnum`` as the ledger's queue table."""
    return rows.select(
        F.col("taskname").alias("task"),
        F.col("jobnum").try_cast("bigint").alias("jobnum"),
        F.col("ClusterId").try_cast("bigint").alias("cluster_id"),
        F.col("JobStatus").alias("status"),
        F.col("EnteredCurrentStatus").try_cast("bigint").alias("entered"),
        F.col("HoldReason").alias("hold_reason"),
    )
