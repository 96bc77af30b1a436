"""Positions, sums, last-known values and greedy groups: small and split keys agree with plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from batchtally.plans import jumps, scan
from batchtally.plans.jumps import greedy_groups
from batchtally.plans.scan import carry_last, number_rows


def make_rows(seed, keys=("a", "b", "c"), hot=220, other=15, top=12):
    rnd = random.Random(seed)
    rows = []
    for k in keys:
        seqs = rnd.sample(range(10_000), hot if k == keys[0] else other)
        for s in seqs:
            n = rnd.choice([0, 0, 1, 2, 3, 5, 8, top, 4 * top])
            rows.append((k, s, n))
    return rows


def greedy(counts, files, limit):
    held, groups, group = 0, [], []
    for i, n in enumerate(counts):
        if (files and held >= files) or (limit and held + n > limit):
            groups.append(group)
            group, held = [], 0
        group.append(i)
        held += 1 if files else n
    groups.append(group)
    out = {}
    for g, members in enumerate([g for g in groups if g]):
        for i in members:
            out[i] = g
    return out


@pytest.mark.parametrize("bound", [1_000_000, 37])
def test_number_rows(spark, bound):
    rows = make_rows(1)
    df = spark.createDataFrame(rows, "k string, s bigint, n bigint").repartition(5)
    got = number_rows(df, ["k"], ["s"], sums={"run": "n"}, total="all", max_group_rows=bound)
    sizes = {k: sum(r[0] == k for r in rows) for k in {r[0] for r in rows}}
    assert all(r.all == sizes[r.k] for r in got.collect())
    got = {(r.k, r.s): (r.pos, r.run) for r in got.collect()}
    for k in {r[0] for r in rows}:
        total = 0
        for i, (_, s, n) in enumerate(sorted(r for r in rows if r[0] == k), 1):
            total += n
            assert got[(k, s)] == (i, total)


@pytest.mark.parametrize("bound", [1_000_000, 50])
def test_number_rows_whole_table(spark, bound):
    df = spark.range(500).withColumn("v", F.lit(2)).repartition(7)
    got = number_rows(df, [], [F.col("id").desc()], sums={"run": "v"}, max_group_rows=bound)
    assert got.columns == ["id", "v", "pos", "run"]
    assert all(r.pos == 500 - r.id and r.run == 2 * r.pos for r in got.collect())


@pytest.mark.parametrize("bound", [1_000_000, 31])
def test_carry_last(spark, bound):
    rows = [(k, s, n if n > 4 else None) for k, s, n in make_rows(2)]
    df = spark.createDataFrame(rows, "k string, s bigint, n bigint").repartition(5)
    got = {(r.k, r.s): r.last for r in carry_last(df, ["k"], ["s"], {"last": "n"}, max_group_rows=bound).collect()}
    for k in {r[0] for r in rows}:
        last = None
        for _, s, n in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            last = n if n is not None else last
            assert got[(k, s)] == last


@pytest.mark.parametrize("bound", [1_000_000, 40])
@pytest.mark.parametrize(
    "files,limit", [(None, 20), (None, 300), (None, 5.5), (None, 1e9), (4, 9), (7, 40), (90, 200), (25, None)]
)
def test_greedy_groups(spark, bound, files, limit):
    rows = make_rows(3)
    df = spark.createDataFrame(rows, "k string, s bigint, n bigint").repartition(3)
    got = greedy_groups(df, ["k"], ["s"], count="n", files=files, limit=limit, max_group_rows=bound)
    got = {(r.k, r.s): (r.chunk, r.closed) for r in got.collect()}
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        ordered = sorted(r for r in rows if r[0] == k)
        want = greedy([n for _, _, n in ordered], files, limit)
        last = max(want.values())
        full = files is not None and sum(g == last for g in want.values()) == files
        assert [got[(k, s)] for _, s, _ in ordered] == [(want[i], want[i] < last or full) for i in range(len(ordered))]


def test_groups_do_not_depend_on_partitions(spark):
    rows = make_rows(4, hot=900)
    seen = set()
    for parts in (1, 4, 16):
        df = spark.createDataFrame(rows, "k string, s bigint, n bigint").repartition(parts)
        out = greedy_groups(df, ["k"], ["s"], count="n", limit=17, max_group_rows=100)
        seen.add(tuple(sorted((r.k, r.s, r.chunk) for r in out.collect())))
    assert len(seen) == 1


@pytest.mark.parametrize("files,limit", [(None, 2), (None, 2.9), (3, 2)])
def test_groups_do_not_depend_on_the_bound(spark, files, limit):
    """Sums beyond the exact range of doubles, and limits that are not whole."""
    counts = [2**53, 1, 1, 1, 1, 1]
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate(counts)], "k string, s bigint, n bigint")
    want = greedy(counts, files, limit)
    for bound in (2, 1_000_000):
        got = greedy_groups(df, ["k"], ["s"], count="n", files=files, limit=limit, max_group_rows=bound)
        assert {r.s: r.chunk for r in got.collect()} == want
    if files is None:
        assert [want[i] for i in range(6)] == [0, 1, 1, 2, 2, 3]


def test_fold_waits_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = make_rows(6)
        df = spark.createDataFrame(rows, "k string, s bigint, n bigint").repartition(3)
        small = {tuple(r) for r in greedy_groups(df, ["k"], ["s"], count="n", limit=60).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == {tuple(r) for r in greedy_groups(df, ["k"], ["s"], count="n", limit=60).collect()}
    assert len(small) == len(rows)


def test_all_zero_counts_give_one_group(spark):
    df = spark.range(300).selectExpr("'a' as k", "id as s", "0L as n")
    out = greedy_groups(df, ["k"], ["s"], count="n", limit=10, max_group_rows=50)
    assert out.select("chunk").distinct().count() == 1 and out.count() == 300


def test_small_keys_beside_a_hot_one(spark):
    """The small keys come out of a join that is replanned at run time; each must still be walked as a whole.

    Below about a million rows Spark does not replan it that way.
    """
    hot = F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), (F.col("id") % 7).cast("string")))
    df = spark.range(0, 1_000_000, 1, 8).select(hot.alias("k"), F.col("id").alias("s"), F.pmod(F.xxhash64("id"), F.lit(100)).alias("n"))
    got = greedy_groups(df, ["k"], ["s"], count="n", limit=9000, max_group_rows=300_000).toPandas()
    assert len(got) == 1_000_000
    for k, rows in got.sort_values("s").groupby("k"):
        want = greedy(rows["n"].tolist(), None, 9000)
        assert rows["chunk"].tolist() == [want[i] for i in range(len(rows))], k


def test_scratch_must_be_shared_on_a_cluster():
    from batchtally.plans.storage import is_shared

    assert is_shared("local[8]", "file:/tmp/x") and is_shared("local", "file:/tmp/x") and is_shared("yarn", "hdfs://a/x")
    assert not is_shared("yarn", "file:/tmp/x") and not is_shared("local-cluster[2,1,1024]", "file:/tmp/x")


def test_blocks_are_bounded_in_number_and_in_python(spark, monkeypatch):
    """A small bound makes no partition for every few rows, and a large one no large block in Python."""
    df = spark.range(4000).selectExpr("'a' as k", "id as s", "id % 7 as n")
    ranged = spark.range(4000).selectExpr("'a' as k", "id as s")
    parts, sizes = [], []
    monkeypatch.setattr(scan, "cut", lambda x: parts.append(x.rdd.getNumPartitions()) or x)
    scan._blocks(ranged, ["k"], ["s"], 4000, 2)
    scan._blocks(ranged, ["k"], ["s"], 4000, 1000)
    monkeypatch.undo()
    assert parts[0] <= 256 and parts[1] == 4

    monkeypatch.setattr(jumps, "BLOCK_ROWS", 300, raising=False)
    block_of = jumps._block_of
    monkeypatch.setattr(jumps, "_block_of", lambda pos, size: sizes.append(size) or block_of(pos, size))
    got = {r.s: r.chunk for r in greedy_groups(df, ["k"], ["s"], count="n", limit=20, max_group_rows=1500).collect()}
    assert sizes == [300]
    held, chunk = 0, 0
    for s in range(4000):
        if s and held + s % 7 > 20:
            held, chunk = 0, chunk + 1
        held += s % 7
        assert got[s] == chunk
