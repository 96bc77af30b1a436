"""Greedy, order-dependent grouping that also works inside one huge key.

Small keys: one sorted pass with a running state per key (``_fold``). The pass
reads the output of a window, not of a plain repartition: a window demands that
a key stays in one partition, so a join replanned at run time cannot split it.

Huge keys: each row knows its jump, the row that would open the next group if a
group opened here. The groups are the rows reached from row 1. They are found
in blocks of bounded size:

1. inside a block, follow jumps to the first one that leaves the block,
2. the distinct rows entered that way form a small graph; square its jumps
   until every chain has ended (log2 of the longest chain of blocks),
3. replay the squares from row 1 to get the one entry of each visited block,
4. walk each block from its entry and number the starts by a running count.

What is broadcast here has one row per huge key or per block, so at most one row
for every ``max_group_rows`` rows (``BLOCK_ROWS`` if that is less) and key of the huge part.

Chains that meet merge, so step 2 normally holds few rows; it stays exact when
they do not merge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from batchtally.plans.scan import MAX_GROUP_ROWS, Census, carry_min, group_sizes, hot_keys, number_rows
from batchtally.plans.storage import cut

BLOCK_ROWS = 1 << 17  # rows of a block that Python holds, at most


def _fold(count: str, files: int | None, limit: int | None, out: str, closed: str):
    """mapInPandas function over numbered rows of whole keys; its state outlives a batch.

    All jumps of a batch come from one search over its rows; Python then takes
    one step per group. The rows of the open group wait until it is closed or
    its key ends.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held, filled, group = 0, 0, 0, 0  # of the open group: events, rows, number
        waiting: list[pd.DataFrame] = []
        for pdf in batches:
            if pdf.empty:
                continue
            at, n = pdf["_at"].to_numpy(), pdf[count].to_numpy(dtype="int64")
            row, size = np.arange(len(at)), len(at)
            first = at == 1
            if not np.all(first | (at == np.concatenate(([last], at[:-1])) + 1)):
                raise RuntimeError("rows of a key are not in one partition in order")
            last = int(at[-1])
            heads = np.flatnonzero(first)
            ends = np.append(heads, size)[np.searchsorted(heads, row, side="right")]  # where the row's key ends
            if files is None:
                sums = np.cumsum(n)
                jump = np.maximum(np.searchsorted(sums, sums - n + limit, side="right"), row + 1)
                at_once = int(np.searchsorted(sums, limit - held, side="right"))
            else:
                jump, at_once = row + files, files - filled
                if limit is not None:
                    reach = np.maximum.accumulate(np.minimum(row + n - limit, row))
                    jump = np.minimum(jump, np.searchsorted(reach, row, side="right"))
                    at_once = min(at_once, int(np.searchsorted(reach, -filled, side="right")))
            hops = np.minimum(jump, ends).tolist()
            i = 0 if first[0] else min(at_once, int(ends[0]))
            starts = []
            while i < size:
                starts.append(i)
                i = hops[i]

            opened = np.zeros(size, dtype="int64")
            opened[starts] = 1
            number = np.cumsum(opened)
            before = np.maximum.accumulate(np.where(first, number, -1))
            pdf = pdf.drop(columns="_at")
            pdf[out] = np.where(before < 0, number + group, number - before)
            group = int(pdf[out].iloc[-1])
            if not starts:
                held, filled = held + int(n.sum()), filled + size
                waiting.append(pdf)
                continue
            full = not first[starts[0]] or filled + starts[0] == files
            for part in waiting:
                yield part.assign(**{closed: full})
            rows = np.diff(starts)
            done = np.concatenate((np.full(starts[0], full), np.repeat(~first[starts[1:]] | (rows == files), rows)))
            if starts[-1]:
                yield pdf.iloc[: starts[-1]].assign(**{closed: done})
            waiting = [pdf.iloc[starts[-1] :]]
            held, filled = int(n[starts[-1] :].sum()), size - starts[-1]
        for part in waiting:
            yield part.assign(**{closed: filled == files})

    return run


def _shape(df: DataFrame, keys: Sequence[str], *longs: str) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + [T.StructField(n, T.LongType()) for n in longs])


def _block_of(pos: str, size: int) -> Column:
    return F.floor((F.col(pos) - 1) / size).cast("bigint")


def _limit_jumps(rows: DataFrame, keys: list[str], level: Column, ask: Column, census: tuple[int, int], bound: int) -> DataFrame:
    """Jump to the first row whose ``level`` is above the row's ``ask``.

    Levels and asks are sorted together, downwards: the answer is the smallest
    position among the levels before the ask. On ties the ask sorts first, as
    the limit is strict.
    """
    base = rows.select(*keys, "_pos", level.alias("_v"), ask.alias("_a"))
    levels = base.select(*keys, "_pos", "_v", F.lit(0).alias("_ask"))
    both = levels.unionByName(base.select(*keys, "_pos", F.col("_a").alias("_v"), F.lit(1).alias("_ask")))
    downwards = [F.col("_v").desc(), F.col("_ask").desc(), F.col("_pos").desc()]
    above = F.when(F.col("_ask") == 0, F.col("_pos"))
    sizes = (2 * census[0], 2 * census[1])
    seen = carry_min(both, keys, downwards, {"_hit": above}, census=sizes, max_group_rows=bound)
    after_own = F.greatest(F.col("_hit"), F.col("_pos") + 1)
    return seen.filter("_ask = 1").select(*keys, "_pos", F.when(F.col("_hit").isNotNull(), after_own).alias("_jump"))


def _event_jumps(rows: DataFrame, keys: list[str], count: str, limit: int, census: tuple[int, int], bound: int) -> DataFrame:
    """The first later row whose running sum passes the sum before this row plus the limit."""
    return _limit_jumps(rows, keys, F.col("_sum"), F.col("_sum") - F.col(count) + F.lit(limit), census, bound)


def _both_jumps(
    rows: DataFrame, keys: list[str], count: str, files: int, limit: int, census: tuple[int, int], bound: int
) -> DataFrame:
    """Jump when both limits hold; the held number then counts files.

    Row j closes a group opened by row i < j when j - i + n(j) > limit, so when
    min(j, j + n(j) - limit) > i.
    """
    level = F.least(F.col("_pos"), F.col("_pos") + F.col(count) - F.lit(limit))
    jumps = _limit_jumps(rows, keys, level, F.col("_pos"), census, bound)
    return jumps.withColumn("_jump", F.least("_jump", F.col("_pos") + files))


def _leave_block(keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", ignore_index=True)
        first = int(pdf["_pos"].iloc[0])
        rows = np.arange(len(pdf))
        target = pdf["_jump"].astype("Int64").fillna(-1).to_numpy(dtype="int64") - first
        hop = np.where((target >= 0) & (target < len(pdf)), target, rows)
        while True:
            twice = hop[hop]
            if np.array_equal(twice, hop):
                break
            hop = twice
        pdf["_to"] = pdf["_jump"].astype("Int64").to_numpy()[hop]
        pdf["_to"] = pdf["_to"].astype("Int64")
        return pdf[[*keys, "_pos", "_to"]]

    return run


def _walk_block(keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", ignore_index=True)
        first = int(pdf["_pos"].iloc[0])
        jump = pdf["_jump"].astype("Int64").fillna(-1).tolist()
        start = np.zeros(len(pdf), dtype="int64")
        entries = np.flatnonzero(pdf["_entry"].fillna(0).to_numpy(dtype="int64"))
        at = int(entries[0]) if len(entries) else -1
        while 0 <= at < len(pdf):
            start[at] = 1
            at = jump[at] - first
        pdf["_start"], pdf["_starts"] = start, np.cumsum(start)
        return pdf[[*keys, "_block", "_pos", "_start", "_starts"]]

    return run


def _reach(jumps: DataFrame, keys: list[str], bound: int, files: int | None) -> DataFrame:
    """Rows (keys, _pos, _group, _closed) from each row's jump."""
    at, bound = [*keys, "_pos"], min(bound, BLOCK_ROWS)
    blocked = cut(jumps.withColumn("_block", _block_of("_pos", bound)))
    by_block = [*keys, "_block"]

    leaving = cut(blocked.groupBy(*by_block).applyInPandas(_leave_block(keys), _shape(jumps, keys, "_pos", "_to")))
    firsts = leaving.filter("_pos = 1").select(*at)
    entered = leaving.filter("_to is not null").select(*keys, F.col("_to").alias("_pos")).distinct()
    nodes = entered.unionByName(firsts)
    hop = cut(leaving.filter("_to is not null").join(nodes, at, "left_semi"))

    squares = []
    while not hop.isEmpty():
        squares.append(hop)
        second = hop.select(*keys, F.col("_pos").alias("_to"), F.col("_to").alias("_next"))
        hop = cut(hop.join(second, [*keys, "_to"]).select(*at, F.col("_next").alias("_to")))

    entries = firsts
    for square in reversed(squares):
        further = entries.join(square, at).select(*keys, F.col("_to").alias("_pos"))
        entries = cut(entries.unionByName(further))

    marked = blocked.join(entries.withColumn("_entry", F.lit(1)), at, "left")
    walked = cut(marked.groupBy(*by_block).applyInPandas(_walk_block(keys), _shape(jumps, keys, "_block", "_pos", "_start", "_starts")))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        walked.groupBy(*by_block)
        .agg(F.max("_starts").alias("_n"))
        .select(*by_block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    ends = walked.groupBy(*keys).agg(
        (F.sum("_start") - 1).alias("_last"),
        (F.max("_pos") - F.max(F.when(F.col("_start") == 1, F.col("_pos"))) + 1).alias("_tail"),
    )
    group = (F.col("_starts") + F.col("_off") - 1).cast("bigint")
    full = F.col("_tail") == files if files is not None else F.lit(False)
    return (
        walked.join(F.broadcast(offsets), by_block)
        .join(F.broadcast(ends), keys)
        .select(*at, group.alias("_group"), ((group < F.col("_last")) | full).alias("_closed"))
    )


def greedy_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    count: str,
    files: int | None = None,
    limit: float | None = None,
    out: str = "chunk",
    closed: str = "closed",
    census: Census = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add the 0-based group of each row, walking each key in ``order``.

    ``closed`` is false in the last group of a key unless it holds exactly
    ``files`` rows. A row opens a group when the held number plus its ``count`` would pass
    ``limit`` (strictly), or when ``files`` rows are held. With ``files`` given
    the held number counts rows. Keys, order and counts must not be NULL, the
    order must be total, and counts must be whole and not negative. All sums are
    whole numbers, so the limit counts by its whole part, and a key is grouped
    alike below and above ``max_group_rows``. Counts may sum up to 2**61.
    """
    keys, order = list(keys), list(order)
    limit = None if limit is None else math.floor(min(limit, 2**61))
    shape = T.StructType([*df.schema.fields, T.StructField(out, T.LongType()), T.StructField(closed, T.BooleanType())])

    def folded(part: DataFrame) -> DataFrame:
        walk = W.partitionBy(*keys).orderBy(*order)
        numbered = part.withColumn("_at", F.row_number().over(walk))
        return numbered.mapInPandas(_fold(count, files, limit, out, closed), shape)

    sizes = group_sizes(df, keys, census)
    if sizes[0] <= max_group_rows:
        return folded(df)

    # at most (all rows / max_group_rows) keys, so broadcasting them is safe and saves a shuffle by key
    hot = F.broadcast(cut(hot_keys(census if isinstance(census, DataFrame) else df, keys, max_group_rows)))
    large = df.join(hot, keys, "left_semi")
    sums = {"_sum": F.col(count).cast("bigint")}
    rows = cut(number_rows(large, keys, order, pos="_pos", sums=sums, census=sizes, max_group_rows=max_group_rows))
    if files is not None and limit is not None:
        jumps = _both_jumps(rows, keys, count, files, limit, sizes, max_group_rows)
    elif limit is not None:
        jumps = _event_jumps(rows, keys, count, limit, sizes, max_group_rows)
    else:
        jumps = rows.select(*keys, "_pos", (F.col("_pos") + files).alias("_jump"))
    groups = _reach(jumps, keys, max_group_rows, files)
    large = rows.join(groups, [*keys, "_pos"]).drop("_pos", "_sum").withColumnsRenamed({"_group": out, "_closed": closed})
    return folded(df.join(hot, keys, "left_anti")).unionByName(large)
