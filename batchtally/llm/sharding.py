r"""Resharding as a minimum-cost flow.

Rows lie in old shards and shall lie in new ones whose row counts are at most one
apart. Old shards supply their rows, new shards take them; staying costs nothing,
moving costs bytes. Inside an old shard the smallest rows move first, so each
further row costs at least what the one before did. What matters of these prices is
the row that moves or stays with the choice which shards hold one row more: its
bytes are looked up, and the flow of least cost then says how many rows of each
old shard go where. No other plan that meets the capacities moves fewer bytes.
Transfers are blocks: ranges of positions in the old shard, ordered by size.

Positions come from one range sort by (old shard, size, doc_id), whose partitions
may split a shard; it is stored, then counted per (partition, shard). Only those
counts (partitions + shards rows) and the totals per shard reach the driver.

Defined results
* null text has no bytes (size 8) and the checksum of the empty text;
* rows of null source lie in one old shard like those of any other source;
* ties in size go by doc_id, null first; repeated rows get slots of their own;
* an empty table gives an empty result; other columns are ignored, or kept by ``rewrite``, which ties rows to their places by a
  row id of its own, so null and repeated ids are written like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchtally.llm.common import documents, packed, required, text_of
from batchtally.plans.storage import write_and_read

SHARDS = 24
OLD_SHARDS = 20
RECORD_BYTES = 8  # besides the text
_LOW = (1 << 33) - 1  # monotonically_increasing_id: partition above, row below 33 bits


Prices = list[list[tuple[int, float]]]  # for each old shard steps of (rows, bytes a row), dearer from step to step


def cheapest_flow(supply: list[int], shards: int, prices: Prices) -> dict[tuple[int, int], int]:
    """Rows from each old to each new shard: all rows placed, counts at most one apart, least cost.

    Successive cheapest paths on old -> (stay, or pay and leave) -> new -> sink. Each new shard must take
    total // shards rows; the remaining rows go through a node that gives a shard
    one more at most.
    """
    old, total = len(supply), sum(supply)
    left, first = old, 2 * old  # nodes of rows that leave, nodes of new shards
    source, extra, sink = first + shards, first + shards + 1, first + shards + 2
    heads: list[list[int]] = [[] for _ in range(sink + 1)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, capacity: int, price: float) -> None:
        for u, v, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            heads[u].append(len(to))
            to.append(v)
            room.append(c)
            cost.append(p)

    for o in range(old):
        arc(source, o, supply[o], 0.0)
        if o < shards:
            arc(o, first + o, supply[o], 0.0)
        for rows, price in prices[o]:
            arc(o, left + o, rows, price)
        for n in range(shards):
            if n != o:
                arc(left + o, first + n, supply[o], 0.0)
    for n in range(shards):
        arc(first + n, sink, total // shards, 0.0)
        arc(first + n, extra, 1, 0.0)
    arc(extra, sink, total % shards, 0.0)

    while True:
        dist, via = [float("inf")] * (sink + 1), [-1] * (sink + 1)
        dist[source], queue, waiting = 0.0, [source], {source}
        while queue:
            u = queue.pop(0)
            waiting.discard(u)
            for e in heads[u]:
                if room[e] and dist[u] + cost[e] < dist[to[e]] - 1e-9:
                    dist[to[e]], via[to[e]] = dist[u] + cost[e], e
                    if to[e] not in waiting:
                        queue.append(to[e])
                        waiting.add(to[e])
        if via[sink] < 0:
            break
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        step = min(room[e] for e in path)
        for e in path:
            room[e] -= step
            room[e ^ 1] += step
    return {
        (u % old, to[e] - first): room[e ^ 1]
        for u in range(2 * old)
        for e in heads[u]
        if e % 2 == 0 and first <= to[e] < source and room[e ^ 1]
    }


def move_prices(supply: list[int], size: list[int], shards: int, border: dict[int, int]) -> Prices:
    """Price steps of the old shards. ``border`` holds, for shards of more than their least number of rows, the bytes of the row at the border."""
    base, out = sum(supply) // shards, []
    for o, (n, total) in enumerate(zip(supply, size, strict=True)):
        if o in border:
            # the rows before the border row leave in every plan, those behind it in none
            sure, last = n - base - 1, float(border[o])
            out.append([(sure, 0.0), (1, last), (base, max(last, total / n) + 1)])
        else:
            out.append([(n, total / n if n else 1.0)])
    return out


def transfers(flow: dict[tuple[int, int], int], supply: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Blocks (old, first, end, new, slot of the first row) over positions in the old shard; movers come first."""
    taken = {n: flow.get((n, n), 0) for n in range(shards)}
    blocks = []
    for o in range(len(supply)):
        at = 0
        for n in range(shards):
            if n != o and (rows := flow.get((o, n), 0)):
                blocks.append((o, at, at + rows, n, taken[n]))
                at, taken[n] = at + rows, taken[n] + rows
        if rows := flow.get((o, o), 0):
            blocks.append((o, at, at + rows, o, 0))
    return blocks


def reshard(docs: DataFrame, old_shard: Column, old_shards: int = OLD_SHARDS, shards: int = SHARDS, row_id: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard and slot (gapless from 0 in its shard) for every row, and its ``row_id`` where one is named."""
    required(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    more = [] if row_id is None else [row_id]
    rows = docs.select(
        "doc_id",
        (F.octet_length(text_of()) + RECORD_BYTES).cast("bigint").alias("size"),
        F.crc32(text_of()).alias("text_crc32"),
        old_shard.cast("int").alias("old_shard"),
        *more,
    )
    order = ["old_shard", "size", "doc_id"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = write_and_read(ranged, "sizes").withColumns({"part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit(_LOW))})
    counts = rows.groupBy("part", "old_shard").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"), F.sum("size").alias("bytes"))
    supply, size, starts = [0] * old_shards, [0] * old_shards, []
    for r in sorted(counts.collect(), key=lambda r: (r["old_shard"], r["part"])):
        starts.append((r["part"], r["old_shard"], supply[r["old_shard"]] - r["first"]))
        supply[r["old_shard"]] += r["n"]
        size[r["old_shard"]] += r["bytes"]
    # at most a row per partition and shard, and a row per pair of shards
    shift = F.broadcast(spark.createDataFrame(starts, "part bigint, old_shard int, shift bigint"))
    at = rows.join(shift, ["part", "old_shard"]).withColumn("pos", F.col("_at") + F.col("shift"))
    base = sum(supply) // shards
    asked = [(o, n - base - 1) for o, n in enumerate(supply) if o < shards and n > base]
    border = at.join(F.broadcast(spark.createDataFrame(asked, "old_shard int, pos bigint")), ["old_shard", "pos"]).select("old_shard", "size")
    prices = move_prices(supply, size, shards, {r["old_shard"]: r["size"] for r in border.collect()})
    blocks = transfers(cheapest_flow(supply, shards, prices), supply, shards)
    block = F.broadcast(spark.createDataFrame(blocks, "o int, first bigint, end bigint, shard int, slot0 bigint"))
    placed = at.join(block, (F.col("old_shard") == F.col("o")) & (F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("end")))
    slot = (F.col("slot0") + F.col("pos") - F.col("first")).alias("slot")
    return placed.select("doc_id", "size", "text_crc32", "old_shard", "shard", slot, *more)


FOLDER, ROW_ID = "new_shard", "__row_id"


def rewrite(docs: DataFrame, old_shard: Column, path: str, old_shards: int = OLD_SHARDS, shards: int = SHARDS, lanes: int = 8) -> DataFrame:
    """Reshard and write the shards that lose or take rows below ``path``, one folder ``new_shard=`` each; return the shards written.

    Every row of these shards is written once with all its columns; other folders stay as they are. The table must not have a
    column ``new_shard``. Several tasks write a shard.
    """
    required(docs, ["doc_id", "text"])
    if FOLDER in docs.columns:
        raise ValueError(f"the column {FOLDER} names the folders")
    # stored with its ids, so that both uses below see the same ones
    stored = write_and_read(packed(docs, F.monotonically_increasing_id().alias(ROW_ID), old_shard.cast("int").alias("__old")), "rows")
    facts = stored.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), ROW_ID, "__old")
    placed = write_and_read(reshard(facts, F.col("__old"), old_shards, shards, ROW_ID), "placed")
    affected = placed.filter("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct().filter(F.col("s") < shards)
    here = placed.join(F.broadcast(affected), F.col("shard") == F.col("s"), "left_semi").select(ROW_ID, F.col("shard").alias(FOLDER))
    spread = stored.join(here, ROW_ID).repartition(FOLDER, F.pmod(F.xxhash64(ROW_ID), F.lit(lanes)))
    spread.select("row.*", FOLDER).write.partitionBy(FOLDER).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return affected.select(F.col("s").alias("shard"))


def by_source(shards: int = OLD_SHARDS) -> Column:
    """The layout that the rows come from: sources hashed to shards, so a large source makes a large shard."""
    return F.pmod(F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit(""))), F.lit(shards)).cast("int")


def op4_resharding(spark, sf_dir: str) -> DataFrame:
    placed = reshard(documents(spark, sf_dir), by_source())
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )
