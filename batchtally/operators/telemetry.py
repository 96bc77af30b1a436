"""Telemetry analytics: zeroed time, pairs, histograms, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit scale of each standard panel (metric against job time), and its bins per axis.
PANEL_SCALES = {
    "usr": 1.0,
    "sys": 1.0,
    "idl": 1.0,
    "writ": 0.125e-6,
    "read": 0.125e-6,
    "send": 1e-6,
    "recv": 1e-6,
    "used": 1e-9,
    "buff": 1e-9,
}
PANEL_BINS = 50


def zeroed_time(samples: DataFrame, *, log: str = "log", order: str = "row_no", epoch: str = "epoch") -> DataFrame:
    """Add ``x``: time since the first readable time of the log. Samples without a time are left out.

    The first time is an aggregate joined back, so a huge log needs no single task.
    """
    timed = samples.filter(F.col(epoch).isNotNull())
    start = timed.groupBy(log).agg(F.min_by(epoch, order).alias("_start"))
    return timed.join(start, log).withColumn("x", F.col(epoch) - F.col("_start")).drop("_start")


def flatten_metric(telemetry: DataFrame, metric: str) -> DataFrame:
    """All numbers of one metric across logs."""
    return telemetry.filter((F.col("metric") == metric) & F.col("value").isNotNull()).select("log", "row_no", "value")


def pair_metrics(telemetry: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y) of the same row of the same log; ``epoch`` stands for zeroed time.

    One conditional aggregate instead of a self join.
    """
    both = telemetry.filter(F.col("metric").isin(x, y)).groupBy("log", "row_no").agg(
        F.max(F.when(F.col("metric") == x, F.col("value"))).alias("x"),
        F.max(F.when(F.col("metric") == y, F.col("value"))).alias("y"),
    )
    if "epoch" in (x, y):
        first = (
            telemetry.filter((F.col("metric") == "epoch") & F.col("value").isNotNull())
            .groupBy("log")
            .agg(F.min_by("value", "row_no").alias("_start"))
        )
        both = both.join(first, "log")
        for name, metric in (("x", x), ("y", y)):
            if metric == "epoch":
                both = both.withColumn(name, F.col(name) - F.col("_start"))
        both = both.drop("_start")
    return both.filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def mean(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.avg(F.col(col).cast("double")).alias("mean"))


def _boxed(points: DataFrame, keys: Sequence[str], axes: Sequence[str], top: Column | None = None, scale_y: float = 1.0) -> DataFrame:
    """Points with the first axis divided by ``top``, the second times ``scale_y``, and the range of each axis.

    One aggregate over the raw values serves both: dividing and scaling keep the
    order (or turn it around), so the ends of the new ranges are the moved ends.
    Per key the ranges come by an equi join, for the whole table as one scalar
    subquery.
    """
    x = axes[0]
    ends = [f(a).alias(f"_{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]
    aggs = [*ends, (top if top is not None else F.lit(1.0)).alias("_top")]
    stats = points.groupBy(*keys).agg(*aggs) if keys else points.agg(*aggs)
    moved = {x: lambda c: c / F.col("_top")} if top is not None else {}
    if scale_y != 1.0:
        moved[axes[1]] = lambda c: c * F.lit(scale_y)
    for a in axes:
        lo, hi = F.col(f"_lo_{a}"), F.col(f"_hi_{a}")
        if a in moved:
            p, q = moved[a](lo), moved[a](hi)
            stats = stats.withColumns({f"_lo_{a}": F.least(p, q), f"_hi_{a}": F.greatest(p, q)})
        flat = lo == hi  # widened by a half on each side
        stats = stats.withColumns({f"_lo_{a}": F.when(flat, lo - 0.5).otherwise(lo), f"_hi_{a}": F.when(flat, hi + 0.5).otherwise(hi)})
    if keys:
        boxed = points.join(stats, list(keys))
    else:
        names = stats.columns
        box = points.withColumn("_b", stats.select(F.struct(*names)).scalar())
        boxed = box.select(*points.columns, *[F.col(f"_b.{n}").alias(n) for n in names])
    return boxed.withColumns({a: f(F.col(a)) for a, f in moved.items()}) if moved else boxed


def _largest(x: str, floor_at_one: bool = True) -> Column:
    top = F.max(x).cast("double")
    return F.greatest(top, F.lit(1.0)) if floor_at_one else F.coalesce(F.nullif(top, F.lit(0.0)), F.lit(1.0))


def bin_of(value: Column | str, lo: Column | str, hi: Column | str, bins: int) -> Column:
    """Equal-width bin from 0; the last bin holds its right edge.

    The first guess is corrected against the edges ``lo + i * width``.
    """
    v = F.col(value) if isinstance(value, str) else value
    low = F.col(lo) if isinstance(lo, str) else lo
    high = F.col(hi) if isinstance(hi, str) else hi
    width = (high - low) / bins
    guess = F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1))
    return (
        F.when(v < low + guess * width, guess - 1)
        .when((guess < bins - 1) & (v >= low + (guess + 1) * width), guess + 1)
        .otherwise(guess)
        .cast("bigint")
    )


def hist_1d(points: DataFrame, x: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per bin between the least and the largest value."""
    boxed = _boxed(points.filter(F.col(x).isNotNull()).select(*keys, x), keys, [x])
    binned = boxed.withColumn("bin", bin_of(x, f"_lo_{x}", f"_hi_{x}", bins))
    return binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def hist_2d(
    points: DataFrame, x: str, y: str, bins: int = PANEL_BINS, *, keys: Sequence[str] = (), norm_x: bool = True, scale_y: float = 1.0
) -> DataFrame:
    """Cell counts of a bins x bins grid (cells without points are absent)."""
    p = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    boxed = _boxed(p, keys, [x, y], _largest(x) if norm_x else None, scale_y)
    binned = boxed.select(
        *keys,
        bin_of(x, f"_lo_{x}", f"_hi_{x}", bins).alias("xbin"),
        bin_of(y, f"_lo_{y}", f"_hi_{y}", bins).alias("ybin"),
    )
    return binned.groupBy(*keys, "xbin", "ybin").agg(F.count(F.lit(1)).alias("n"))


def profile(points: DataFrame, x: str, y: str, bins: int, *, keys: Sequence[str] = (), norm_x: bool = False) -> DataFrame:
    """Mean and spread of y per bin of x, at the bin centre.

    ``norm_x`` divides x by its largest value; x stays as it is when that is 0.
    """
    p = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    boxed = _boxed(p, keys, [x], _largest(x, floor_at_one=False) if norm_x else None)
    lo, hi = F.col(f"_lo_{x}"), F.col(f"_hi_{x}")
    binned = boxed.withColumn("bin", bin_of(x, lo, hi, bins))
    centre = lo + (F.col("bin") + 0.5) * ((hi - lo) / bins)
    return binned.groupBy(*keys, "bin", centre.alias("centre")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("spread")
    )


def panel_hists(telemetry: DataFrame, *, keys: Sequence[str] = ("dataset",), bins: int = PANEL_BINS) -> DataFrame:
    """All standard panels of all datasets in one job.

    ``telemetry`` holds ``keys, metric, value, since_start``. Time is divided by
    its largest value per panel, values are scaled to the panel's unit.
    """
    pairs = [F.lit(v) for kv in PANEL_SCALES.items() for v in kv]
    scale = F.try_element_at(F.create_map(*pairs), F.col("metric"))
    points = telemetry.filter(
        F.col("metric").isin(*PANEL_SCALES) & F.col("value").isNotNull() & F.col("since_start").isNotNull()
    ).select(*keys, "metric", F.col("since_start").alias("x"), (F.col("value") * scale).alias("y"))
    panel = [*keys, "metric"]
    boxed = _boxed(points, panel, ["x", "y"], _largest("x"))
    binned = boxed.select(*panel, bin_of("x", "_lo_x", "_hi_x", bins).alias("xbin"), bin_of("y", "_lo_y", "_hi_y", bins).alias("ybin"))
    return binned.groupBy(*panel, "xbin", "ybin").agg(F.count(F.lit(1)).alias("n"))


def failed_attempts(attempts: DataFrame, outputs: DataFrame) -> DataFrame:
    """Attempts before the last one, of outputs that are not done."""
    keys = ["dataset", "out_index"]
    undone = attempts.join(outputs.filter(~F.col("done")).select(*keys), keys, "left_semi")
    last = undone.groupBy(*keys).agg(F.max("attempt_no").alias("_last"))
    return undone.join(last, keys).filter(F.col("attempt_no") < F.col("_last")).drop("_last")
