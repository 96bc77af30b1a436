import pytest
from pyspark.sql import functions as F

from batchtally.operators.chunking import (
    ChunkRule,
    add_inputs,
    assign_chunks,
    chunk_table,
    combine_stage,
    combine_stages,
    dedupe_pairs,
    event_ranges,
    extend_mapping,
    flatten_inputs,
    inputs_of_output,
    inputs_of_ranges,
    materialise,
    output_totals,
    override_mapping,
    pair_in_order,
)
from batchtally.plans.storage import fresh_path, write_and_read
from batchtally.sources.mapping import MappingTable

SIX = [("d", i, f"f{i}", n) for i, n in enumerate([100, 200, 300, 100, 200, 300], 1)]
EMPTY_MAPPING = "dataset string, out_index bigint, out_name string, in_seq bigint, in_name string, in_nevents bigint"


def files(spark, rows=SIX):
    return spark.createDataFrame(rows, "dataset string, seq bigint, name string, nevents bigint")


def emitted(spark, rule, flush):
    rows = chunk_table(assign_chunks(files(spark), rule), flush=flush).orderBy("chunk").collect()
    kept = [r for r in rows if r.emitted]
    return len(kept), sum(r.n_files for r in rows) - sum(r.n_files for r in kept)


@pytest.mark.parametrize(
    "rule,flush,want",
    [
        (ChunkRule(events=300), True, (4, 0)),
        (ChunkRule(events=300), False, (3, 1)),
        (ChunkRule(files=4), True, (2, 0)),
        (ChunkRule(files=4), False, (1, 2)),
        (ChunkRule(files=3), False, (2, 0)),
        (ChunkRule(), True, (1, 0)),
        (ChunkRule(), False, (0, 6)),
    ],
)
def test_six_files(spark, rule, flush, want):
    assert emitted(spark, rule, flush) == want


def test_limits_must_be_positive():
    with pytest.raises(ValueError):
        ChunkRule(files=0)


@pytest.mark.parametrize("bound", [1_000_000, 3])
def test_mapping_closed_and_open(spark, bound):
    seven = files(spark, [("/a/b/C", i, f"input_{i}.root", 10) for i in range(1, 8)])
    none = spark.createDataFrame([], EMPTY_MAPPING)
    closed = spark.createDataFrame([("/a/b/C", False, "/out")], "dataset string, open boolean, output_dir string")
    opened = closed.withColumn("open", F.lit(True))
    rule = ChunkRule(files=2)

    m = extend_mapping(seven, none, closed, rule, max_group_rows=bound)
    assert m.count() == 7 and m.select("out_index").distinct().count() == 4
    assert extend_mapping(seven, m, closed, rule).count() == 0  # closed and mapped: nothing new

    first = extend_mapping(seven, none, opened, rule, max_group_rows=bound)
    assert sorted({r.out_index for r in first.collect()}) == [1, 2, 3]
    assert {r.out_name for r in first.collect()} == {f"/out/output_{i}.root" for i in (1, 2, 3)}
    more = extend_mapping(seven, first, opened, rule, flush=True, max_group_rows=bound)
    assert [(r.out_index, r.in_name) for r in more.collect()] == [(4, "input_7.root")]
    totals = {r.out_index: (r.n_inputs, r.out_nevents) for r in output_totals(first.unionByName(more)).collect()}
    assert totals == {1: (2, 20), 2: (2, 20), 3: (2, 20), 4: (1, 10)}
    assert inputs_of_output(first, "/out//./output_2.root").count() == 2
    assert inputs_of_output(first, "/out/unknown.root").count() == 0


def test_override(spark):
    made = spark.createDataFrame([("d", "f1", 5), ("d", "f6", 5), ("d", "f2", 9)], "dataset string, name string, chunk int")
    have = spark.createDataFrame([("d", 3, "x", 0, "old", 1)], EMPTY_MAPPING)
    ds = spark.createDataFrame([("d", "/o")], "dataset string, output_dir string")
    got = override_mapping(files(spark), made, have, ds).collect()
    assert sorted((r.out_index, r.in_name) for r in got) == [(4, "f1"), (4, "f6"), (5, "f2")]


def test_event_ranges(spark):
    ds = spark.createDataFrame([("d", 1050, 100), ("e", 250_001, 1)], "dataset string, total_nevents bigint, events_per_output bigint")
    got = event_ranges(ds)
    d = got.filter("dataset = 'd'").orderBy("out_index").collect()
    assert [r.first_event for r in d] == [1 + 100 * i for i in range(10)]
    assert {(r.n_events, r.expected, r.dropped_events) for r in d} == {(100, -1, 50)}
    files = spark.createDataFrame([("d", "x"), ("d", "y"), ("e", "z")], "dataset string, name string")
    asked = inputs_of_ranges(got.filter("dataset = 'd' and out_index in (2, 5)"), files)
    assert sorted((r.out_index, r.in_name) for r in asked.collect()) == [(2, "x"), (2, "y"), (5, "x"), (5, "y")]
    e = got.filter("dataset = 'e'").agg(F.count("*").alias("n"), F.countDistinct("out_index").alias("u"), F.max("first_event").alias("m")).first()
    assert tuple(e) == (250_001, 250_001, 250_001)
    with pytest.raises(Exception, match="must be at least 1"):
        event_ranges(spark.createDataFrame([("d", 0, 5)], ds.schema)).collect()


def test_combine(spark):
    inputs = spark.createDataFrame([("t", f"i{i}", i) for i in range(24)], "task string, name string, seq bigint")
    stages = combine_stages(inputs, [2, 3, 4])
    got = {r.stage: r.n for r in stages.groupBy("stage").agg(F.countDistinct("out_index").alias("n")).collect()}
    assert got == {1: 12, 2: 4, 3: 1}

    odd = spark.createDataFrame([("t", f"i{i}", 10 * i) for i in range(11)], "task string, name string, seq bigint")
    for flush in (True, False):  # as stage after stage
        got = sorted(tuple(r) for r in combine_stages(odd, [2, 2], "s%d_%%d", flush=flush).select("stage", "out_index", "out_name", "name", "seq").collect())
        one = combine_stage(odd, 2, "s1_%d", flush=flush)
        two = combine_stage(one.select("task", F.col("out_name").alias("name"), F.col("out_index").alias("seq")).distinct(), 2, "s2_%d", flush=flush)
        rows = [(i, r.out_index, r.out_name, r.name, r.seq) for i, part in ((1, one), (2, two)) for r in part.collect()]
        assert got == sorted(rows)
    with pytest.raises(ValueError):
        combine_stages(inputs, [2, 0])

    head = combine_stage(inputs.filter("seq < 5"), 2, "out_%d.root")
    assert sorted({r.out_index for r in head.collect()}) == [0, 1]
    rest = combine_stage(inputs.filter("seq < 9"), 2, "out_%d.root", mapped=head, flush=True)
    assert sorted((r.out_index, r.seq) for r in rest.collect()) == [(2, 4), (2, 5), (3, 6), (3, 7), (4, 8)]
    with pytest.raises(ValueError):
        combine_stage(inputs, 0, "x_%d")


def test_inputs_and_pairs(spark):
    known = spark.createDataFrame([("t", "a", 1), ("t", "b", 2)], "task string, name string, seq bigint")
    new = spark.createDataFrame([("t", "c", 1), ("t", "a", 2), ("t", "d", 3), ("t", "c", 4)], "task string, name string, arrival bigint")
    assert sorted((r.seq, r.name) for r in add_inputs(known, new).collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    pairs = spark.createDataFrame([(["a", "b"], ["x"], 1), (["b", "a"], ["x"], 2), (["a", "b"], ["x"], 3)], "inputs array<string>, outputs array<string>, seq int")
    assert sorted(r.seq for r in dedupe_pairs(pairs).collect()) == [1, 2]
    nested = spark.createDataFrame([(1, ["p", "q"])], "out_index int, inputs array<string>")
    assert [(r.in_pos, r.in_name) for r in flatten_inputs(nested).collect()] == [(0, "p"), (1, "q")]
    outs = spark.createDataFrame([("t", 1, "o1")], "task string, seq bigint, name string")
    got = pair_in_order(known.select("task", "seq", "name"), outs).collect()
    assert [(r.in_name, r.out_name) for r in got] == [("a", "o1")]


@pytest.mark.parametrize("threshold", ["1m", "-1"])  # a small mapping is broadcast, a large one joined
def test_materialise_spreads_a_huge_output(spark, threshold):
    """Equal records and counts missing in the manifest still use several tasks; small outputs use one."""
    mapping = write_and_read(spark.createDataFrame([("d", 1, "o1", 1, "big", 0), ("d", 2, "o2", 2, "small", 0)], EMPTY_MAPPING), "mapping")
    events = spark.range(0, 40_000, 1, 8).selectExpr("id", "'big' as file", "repeat(uuid(), 2) as v")
    events = write_and_read(events.unionByName(spark.range(10).selectExpr("id", "'small' as file", "'x' as v")), "events")
    path = fresh_path(spark, "merge")
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
        "spark.sql.files.maxPartitionBytes": "200k",
        "spark.sql.autoBroadcastJoinThreshold": threshold,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        materialise(events, mapping, path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    back = spark.read.parquet(path).withColumn("part", F.input_file_name())
    got = back.groupBy("out_index").agg(F.count("*").alias("n"), F.countDistinct("part").alias("files"), F.countDistinct("id").alias("ids")).collect()
    got = {r.out_index: (r.n, r.files, r.ids) for r in got}
    assert got[1][0] == got[1][2] == 40_000 and got[1][1] > 3 and got[2] == (10, 1, 10)


def test_materialise_reads_records_once(spark):
    mapping = spark.createDataFrame([("d", 1, "o1", 1, "a", 0)], EMPTY_MAPPING)
    events = spark.range(10).selectExpr("id", "'a' as file")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    materialise(events.mapInPandas(count, events.schema), mapping, fresh_path(spark, "merge"))
    assert seen.value == 10


def test_materialise_into_shared_folders(spark):
    mapping = spark.createDataFrame([("d", i, f"o{i}", i, f"f{i}", 3) for i in range(1, 8)], EMPTY_MAPPING)
    events = spark.range(21).selectExpr("id", "concat('f', id div 3 + 1) as file")
    path = fresh_path(spark, "merge")
    materialise(events, mapping, path, folders=2)
    back = spark.read.parquet(path)
    assert {(r.out_index, r["count"]) for r in back.groupBy("out_index").count().collect()} == {(i, 3) for i in range(1, 8)}
    assert {r.folder for r in back.select("folder").distinct().collect()} == {0, 1}


def test_file_of_an_unknown_dataset_is_an_error(spark):
    manifest = spark.createDataFrame([("a", 1, "f1", 1), ("b", 1, "f2", 1)], "dataset string, seq bigint, name string, nevents bigint")
    datasets = spark.createDataFrame([("a", False, "/out")], "dataset string, open boolean, output_dir string")
    with pytest.raises(Exception, match="no row in datasets for b"):
        extend_mapping(manifest, spark.createDataFrame([], EMPTY_MAPPING), datasets, ChunkRule(files=2)).collect()


def test_mapping_table_moves_no_history(spark):
    """Extensions equal those of a plain mapping; the lookup has no exchange on the history's side, and none at all over a manifest in buckets."""
    table, rule = MappingTable.create(fresh_path(spark, "mapping"), buckets=4), ChunkRule(files=3)
    ds = lambda *open_: spark.createDataFrame([(d, o, "/out") for d, o in zip("ab", open_)], "dataset string, open boolean, output_dir string")
    rows = [("a", i, f"f{i:02}", i) for i in range(11)] + [("b", i, f"f{i:02}", i) for i in range(5)]
    plain = spark.createDataFrame([], EMPTY_MAPPING)
    for upto, states in ((8, (True, False)), (9, (True, False)), (11, (True, True)), (11, (False, True))):
        manifest = files(spark, [r for r in rows if r[1] < upto])
        want = extend_mapping(manifest, plain, ds(*states), rule)
        got = table.extend(manifest, ds(*states), rule)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        plain = spark.createDataFrame(plain.unionByName(want).collect(), plain.schema)
    assert sorted(map(tuple, table.read(spark).collect())) == sorted(map(tuple, plain.collect())) and plain.count() == 14

    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        closed = ds(True, True).limit(0)
        table.bucketed(files(spark, rows), "dataset", "name").option("path", fresh_path(spark, "files")).saveAsTable("files_in_buckets")
        for manifest, most in ((write_and_read(files(spark, rows), "files"), 1), (spark.table("files_in_buckets"), 0)):
            fresh = manifest.select("dataset", "seq", "name", "nevents").join(
                table.read(spark).select("dataset", F.col("in_name").alias("name")), ["dataset", "name"], "left_anti"
            )
            plan = fresh._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == most and "Bucketed: true" in plan or "SelectedBucketsCount" in plan
            assert plan.rfind("Exchange") < plan.rfind("FileScan")  # the history comes last, right below its scan
        assert sorted(r.name for r in table.unmapped(files(spark, rows), closed).collect()) == ["f09", "f10"]
    finally:
        spark.sql("DROP TABLE IF EXISTS files_in_buckets")
        for k, v in before.items():
            spark.conf.set(k, v)
