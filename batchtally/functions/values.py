"""Value functions: typed text, times, status labels, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status codes of outputs and samples.
STATUS_LABELS = {
    1: "DONE",
    2: "PARTIAL_DONE",
    3: "FAIL",
    4: "SUCCESS",
    5: "VALID",
    6: "INVALID",
    7: "RUNNING",
    8: "IDLE",
    9: "HELD",
    10: "SUBMITTED",
    11: "FAKE",
}
VALID_TEXT = "valid"
HISTORY_SECONDS = 300


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_seconds(ts: Column | str) -> Column:
    """Whole epoch seconds of a zone-less timestamp, whatever the session zone."""
    span = _c(ts) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(span.cast("interval second").cast("decimal(20,6)")).cast("bigint")


def epoch_micros(ts: Column | str) -> Column:
    span = _c(ts) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (span.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("bigint")


def floor_to_history(ts: Column | str) -> Column:
    """Epoch seconds floored to the 5-minute mark."""
    return (F.floor(_c(ts) / HISTORY_SECONDS) * HISTORY_SECONDS).cast("bigint")


def try_number(text: Column | str) -> Column:
    """Double value of ``text``; NULL for clock-like (``:``) or bad text."""
    t = F.trim(_c(text))
    java_suffix = F.right(t, F.lit(1)).isin("d", "D", "f", "F") & t.rlike("[0-9.][dDfF]$")
    return F.when(~t.contains(":") & ~java_suffix, t.try_cast("double"))


def is_clock_text(text: Column | str) -> Column:
    return _c(text).contains(":")


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Rounding with halves going up, also below zero."""
    scale = 10**digits
    return F.floor(value * scale + F.lit(0.5)) / scale if digits else F.floor(value + F.lit(0.5))


def status_name(code: Column | str) -> Column:
    pairs = [F.lit(x) for kv in STATUS_LABELS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _c(code).cast("int"))


def hours_between(now: int | Column, then: Column | str) -> Column:
    stamp = now if isinstance(now, Column) else F.lit(now)
    return F.abs(stamp - _c(then).cast("bigint")) / F.lit(3600.0)
