"""Ordered scans: positions, running sums and last-known values per key.

A window over ``key`` puts each key into one task. That is the best plan while
every key is small, and it fails when one key holds a third of the table. So
the size of the largest key is checked first. Beyond the bound the rows are
range-partitioned by (key, order) into blocks that may split a key, scanned
inside each block, and shifted by the totals of the blocks before. Only one row
per (key, block) takes part in the second step.

The block layout is checkpointed: both branches must see the same boundaries,
also after an executor was lost.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from batchtally.plans.storage import cut

MAX_GROUP_ROWS = 1_000_000
MOST_BLOCKS = 256  # each is a partition that is sampled and reported to the driver; only blocks of MAX_GROUP_ROWS may be more


def _cols(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def largest_group(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest key and of the whole frame; one small aggregate."""
    row = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.max("_n").alias("top"), F.sum("_n").alias("total"))
        .first()
    )
    return (row["top"] or 0, row["total"] or 0)


Census = DataFrame | tuple[int, int] | None


def group_sizes(df: DataFrame, keys: Sequence[str], census: Census) -> tuple[int, int]:
    """Bounds for the largest key and the whole frame: given, or counted."""
    if isinstance(census, tuple):
        return census
    return largest_group(df if census is None else census, keys)


def hot_keys(df: DataFrame, keys: Sequence[str], max_group_rows: int) -> DataFrame:
    """Keys with more rows than one task should hold; at most rows/bound of them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_group_rows).select(*keys)


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right["_r_" + n])
    return cond


def _join_blocks(rows: DataFrame, per_block: DataFrame, names: Sequence[str]) -> DataFrame:
    """Equi join on (key, block), NULL keys included."""
    right = per_block
    for n in names:
        right = right.withColumnRenamed(n, "_r_" + n)
    return rows.join(right, _same(rows, right, names), "left").drop(*["_r_" + n for n in names])


def _blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], total: int, rows: int) -> DataFrame:
    rows = max(rows, min(-(-total // MOST_BLOCKS), MAX_GROUP_ROWS))
    parts = max(2, -(-total // rows))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *_cols(order))
    return cut(ranged.withColumn("_block", F.spark_partition_id()))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    *,
    sums: Mapping[str, Column | str] | None = None,
    pos: str = "pos",
    total: str | None = None,
    census: Census = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add the 1-based position of each row within its key, and running sums.

    ``order`` must be total within a key. ``sums`` maps a new column to the
    expression summed up to and including the row, ``total`` names a column for
    the number of rows of the key. ``census`` may be a cheaper frame with at
    least as many rows per key, or (rows of the largest key, rows of all keys);
    it is used for the size check only.
    """
    keys = list(keys)
    sums = {k: (F.col(v) if isinstance(v, str) else v) for k, v in (sums or {}).items()}
    plain = not keys
    if plain:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
        census = census.withColumn("_all", F.lit(0)) if isinstance(census, DataFrame) else census
    top, size = group_sizes(df, keys, census)
    if top <= max_group_rows:
        w = W.partitionBy(*keys).orderBy(*_cols(order))
        upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
        added = {pos: F.row_number().over(w).cast("bigint"), **{k: F.sum(v).over(upto) for k, v in sums.items()}}
        if total:
            added[total] = F.count(F.lit(1)).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        out = df.withColumns(added)
        return out.drop("_all") if plain else out

    names = [*keys, "_block"]
    blocks = _blocks(df, keys, order, size, max_group_rows)
    w = W.partitionBy(*names).orderBy(*_cols(order))
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = blocks.withColumns(
        {"_p": F.row_number().over(w).cast("bigint"), **{f"_s_{k}": F.sum(v).over(upto) for k, v in sums.items()}}
    )
    totals = blocks.groupBy(*names).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()]
    )
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    shift = totals.select(
        *names,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"),
        *([F.sum("_n").over(W.partitionBy(*keys)).alias(total)] if total else []),
        *[F.sum(f"_t_{k}").over(before).alias(f"_o_{k}") for k in sums],
    )
    joined = _join_blocks(local, shift, names)
    out = joined.withColumns(
        {
            pos: (F.col("_p") + F.col("_o")).cast("bigint"),
            **{
                k: F.when(F.col(f"_o_{k}").isNull(), F.col(f"_s_{k}"))
                .when(F.col(f"_s_{k}").isNull(), F.col(f"_o_{k}"))
                .otherwise(F.col(f"_s_{k}") + F.col(f"_o_{k}"))
                for k in sums
            },
        }
    )
    extra = ["_block", "_p", "_o", *[f"_s_{k}" for k in sums], *[f"_o_{k}" for k in sums]]
    return out.drop(*extra, *(["_all"] if plain else []))


def _carry(df, keys, order, values, census, max_group_rows, pick, merge) -> DataFrame:
    """Running ``pick`` of each value; ``merge`` joins a block's own with what the blocks before gave."""
    keys = list(keys)
    values = {k: (F.col(v) if isinstance(v, str) else v) for k, v in values.items()}
    top, total = group_sizes(df, keys, census)
    if top <= max_group_rows:
        w = W.partitionBy(*keys).orderBy(*_cols(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumns({k: pick(v).over(w) for k, v in values.items()})

    names = [*keys, "_block"]
    blocks = _blocks(df, keys, order, total, max_group_rows)
    w = W.partitionBy(*names).orderBy(*_cols(order))
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = blocks.withColumns(
        {"_p": F.row_number().over(w), **{f"_l_{k}": pick(v).over(upto) for k, v in values.items()}}
    )
    ends = local.groupBy(*names).agg(*[F.max_by(f"_l_{k}", "_p").alias(f"_e_{k}") for k in values])
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    shift = ends.select(*names, *[pick(F.col(f"_e_{k}")).over(before).alias(f"_o_{k}") for k in values])
    joined = _join_blocks(local, shift, names)
    out = joined.withColumns({k: merge(F.col(f"_l_{k}"), F.col(f"_o_{k}")) for k in values})
    return out.drop("_block", "_p", *[f"_l_{k}" for k in values], *[f"_o_{k}" for k in values])


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    values: Mapping[str, Column | str],
    *,
    census: Census = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add, per new column, the last non-NULL value up to and including the row."""
    return _carry(df, keys, order, values, census, max_group_rows, lambda v: F.last(v, ignorenulls=True), F.coalesce)


def carry_min(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    values: Mapping[str, Column | str],
    *,
    census: Census = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add, per new column, the smallest non-NULL value up to and including the row."""
    return _carry(df, keys, order, values, census, max_group_rows, F.min, F.least)
