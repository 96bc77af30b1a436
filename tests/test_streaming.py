import pytest
from pyspark.sql import functions as F

from batchtally.operators.chunking import ChunkRule
from batchtally.plans.storage import fresh_path
from batchtally.streaming import ingest
from batchtally.streaming.ingest import IngestStore, flush_leftovers, ingest_batch, outputs_stream, start_ingest
from batchtally.plans.published import read_pointer
from batchtally.streaming import series as series_
from batchtally.streaming.series import PROGRESS, Series, add_batch, progress_history, read_series, start_series, telemetry_means, telemetry_parts

FILES = "dataset string, seq bigint, name string, nevents bigint"


def write_files(spark, path, names, dataset="/d/RAW"):
    rows = [(dataset, int(n), f"f{n}", 10) for n in names]
    spark.createDataFrame(rows, FILES).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, store, datasets, **options):
    stream = spark.readStream.schema(FILES).parquet(path)
    start_ingest(stream, store, datasets, ChunkRule(files=2), **options).awaitTermination()


def chunks(spark, store):
    return {
        r.out_index: sorted(r.names)
        for r in store.read_mapping(spark).groupBy("out_index").agg(F.collect_list("in_name").alias("names")).collect()
    }


def test_open_dataset_grows(spark):
    path, store = fresh_path(spark, "in"), IngestStore(fresh_path(spark, "store"))
    ds = spark.createDataFrame([("/d/RAW", True, "/out")], "dataset string, open boolean, output_dir string")
    write_files(spark, path, range(1, 8))
    run(spark, path, store, ds)
    assert chunks(spark, store) == {1: ["f1", "f2"], 2: ["f3", "f4"], 3: ["f5", "f6"]}
    write_files(spark, path, [7, 8])  # f7 again, f8 new: the leftover is completed
    run(spark, path, store, ds)
    assert chunks(spark, store)[4] == ["f7", "f8"]
    write_files(spark, path, [9])
    run(spark, path, store, ds)
    assert len(chunks(spark, store)) == 4
    flush_leftovers(spark, store, ds, ChunkRule(files=2), 1)
    flush_leftovers(spark, store, ds, ChunkRule(files=2), 1)
    assert chunks(spark, store)[5] == ["f9"] and len(chunks(spark, store)) == 5
    # a replayed batch replaces itself
    batch = spark.createDataFrame([("/d/RAW", 9, "f9", 10)], FILES)
    ingest_batch(store, ds, ChunkRule(files=2))(batch, 2)
    assert len(chunks(spark, store)) == 5


def test_failure_between_the_writes_is_completed(spark, monkeypatch):
    store, rule = IngestStore(fresh_path(spark, "store")), ChunkRule(files=2)
    ds = spark.createDataFrame([("/d/RAW", True, "/out")], "dataset string, open boolean, output_dir string")
    batch = spark.createDataFrame([("/d/RAW", i, f"f{i}", 10) for i in range(5)], FILES)

    def published():
        return sorted(r.seq for r in spark.read.option("recursiveFileLookup", True).schema(FILES).parquet(store.outputs).collect())

    def stop(*_, **__):
        raise RuntimeError("lost")

    for run_ in (lambda: ingest_batch(store, ds, rule)(batch, 0), lambda: flush_leftovers(spark, store, ds, rule, 7)):
        with monkeypatch.context() as broken:
            broken.setattr(ingest, "_publish", stop)
            with pytest.raises(RuntimeError):
                run_()
        run_()
        run_()
    assert chunks(spark, store) == {1: ["f0", "f1"], 2: ["f2", "f3"], 3: ["f4"]}
    assert published() == [1, 2, 3]


def test_failure_before_the_commit_is_replaced(spark, monkeypatch):
    """Mapping rows of a batch that was not committed count for nothing once it runs again, and waiting files are not lost."""
    store, rule = IngestStore(fresh_path(spark, "store")), ChunkRule(files=2)
    ds = spark.createDataFrame([("/d/RAW", True, "/out")], "dataset string, open boolean, output_dir string")
    batch = lambda names: spark.createDataFrame([("/d/RAW", i, f"f{i}", 10) for i in names], FILES)
    ingest_batch(store, ds, rule)(batch(range(3)), 0)

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(ingest, "write_pointer", stop)
        with pytest.raises(RuntimeError):
            ingest_batch(store, ds, rule)(batch(range(3, 6)), 1)
    assert [r.name for r in store.read_waiting(spark).collect()] == ["f2"]
    ingest_batch(store, ds, rule)(batch(range(3, 6)), 1)
    assert chunks(spark, store) == {1: ["f0", "f1"], 2: ["f2", "f3"], 3: ["f4", "f5"]}
    assert store.read_waiting(spark).count() == 0


def test_a_batch_reads_no_history(spark, monkeypatch):
    """Over 50 batches, what a batch opens stays the same: the state and its own rows."""
    store, rule = IngestStore(fresh_path(spark, "store")), ChunkRule(files=4)
    ds = spark.createDataFrame([("/d/RAW", True, "/out")], "dataset string, open boolean, output_dir string")
    opened = []
    real = IngestStore.read
    monkeypatch.setattr(IngestStore, "read", lambda self, s, path, schema: opened.append(path) or real(self, s, path, schema))
    monkeypatch.setattr(IngestStore, "state", lambda self, s, of=IngestStore.state: (found := of(self, s), opened.extend(f for df in found for f in df.inputFiles()))[0])
    monkeypatch.setattr(ingest, "plan_files", lambda *a, of=ingest.plan_files, **k: of(*a, census=(9, 9), **k))  # sizes are not what is looked at
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # fewer jobs of tiny tables
    publish = ingest._publish
    for n in range(50):
        before = len(opened)
        # publishing reads the batch's own rows alone; looked at in every tenth batch
        monkeypatch.setattr(ingest, "_publish", publish if n % 10 == 9 else lambda *a, **k: None)
        at = ingest_batch(store, ds, rule)
        at(spark.createDataFrame([("/d/RAW", 3 * n + i, f"f{3 * n + i:03}", 10) for i in range(3)], FILES).coalesce(1), n)
        own = [p for p in opened[before:] if f"stream-{n}" in p or f"batch_id={n}" in p]
        state = [p for p in opened[before:] if "/state-" in p]
        assert len(own) + len(state) == len(opened[before:]) and len(own) == 2 * (n % 10 == 9) and len(state) <= 4
    monkeypatch.undo()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = {i + 1: [f"f{4 * i + j:03}" for j in range(4)] for i in range(37)}
    assert chunks(spark, store) == want and sorted(r.name for r in store.read_waiting(spark).collect()) == ["f148", "f149"]


def test_closed_and_reopened_datasets(spark):
    store, rule = IngestStore(fresh_path(spark, "store")), ChunkRule(files=2)
    of = lambda state: spark.createDataFrame([("a", state, "/out"), ("b", True, "/out")], "dataset string, open boolean, output_dir string")
    batch = lambda rows: spark.createDataFrame([(d, i, f"{d}{i}", 1) for d, i in rows], FILES)
    ingest_batch(store, of(False), rule)(batch([("a", 1), ("a", 2), ("a", 3), ("b", 1)]), 0)  # closed: all is mapped
    ingest_batch(store, of(False), rule)(batch([("a", 4), ("a", 5), ("b", 2)]), 1)  # settled: later files wait
    assert sorted(r.name for r in store.read_waiting(spark).collect()) == ["a4", "a5"]
    ingest_batch(store, of(True), rule)(batch([("a", 6)]), 2)
    rows = store.read_mapping(spark).filter("dataset = 'a'").collect()
    assert sorted((r.out_index, r.in_name) for r in rows) == [(1, "a1"), (1, "a2"), (2, "a3"), (3, "a4"), (3, "a5")]
    assert [r.name for r in store.read_waiting(spark).collect()] == ["a6"]


def test_a_stream_of_many_batches(spark):
    """Several files a trigger, names listed again in later batches, a restart in between."""
    path, store = fresh_path(spark, "in"), IngestStore(fresh_path(spark, "store"))
    ds = spark.createDataFrame([("/d/RAW", True, "/out")], "dataset string, open boolean, output_dir string")
    for n in range(4):
        write_files(spark, path, range(3 * n, 3 * n + 5))  # two names of each file come again
        if n % 2:
            stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(path)
            start_ingest(stream, store, ds, ChunkRule(files=5)).awaitTermination()
    names = [x for v in chunks(spark, store).values() for x in v] + [r.name for r in store.read_waiting(spark).collect()]
    assert sorted(names) == sorted(f"f{i}" for i in range(14))
    assert all(len(v) == 5 for v in chunks(spark, store).values()) and read_pointer(spark, store.root)["stream"] == 3
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ingest.ROCKSDB


def test_periodic_flush_and_chain(spark):
    path = fresh_path(spark, "in")
    one, two = IngestStore(fresh_path(spark, "one")), IngestStore(fresh_path(spark, "two"))
    raw = spark.createDataFrame([("/d/RAW", True, "/raw")], "dataset string, open boolean, output_dir string")
    aod = spark.createDataFrame([("/d/AOD", True, "/aod")], "dataset string, open boolean, output_dir string")
    write_files(spark, path, range(5))
    run(spark, path, one, raw, flush_every=1)
    assert len(chunks(spark, one)) == 3
    start_ingest(outputs_stream(spark, one, {"RAW": "AOD"}), two, aod, ChunkRule(events=40)).awaitTermination()
    # 20 + 20 + 10 > 40 opens a second chunk, so only the first is emitted
    assert chunks(spark, two) == {1: ["/raw/output_1.root", "/raw/output_2.root"]}


def test_windows(spark):
    """Late records count, the last windows are there, and a second run adds to the same series."""
    path, out = fresh_path(spark, "progress"), fresh_path(spark, "series")
    measures = ("nevents_total", "nevents_done", "njobs_total", "njobs_done")

    def points(rows):
        return spark.createDataFrame(rows, "dataset string, s bigint, v bigint").select(
            "dataset", F.timestamp_seconds("s").alias("ts"), *[F.col("v").alias(m) for m in measures]
        )

    def follow(rows):
        points(rows).coalesce(1).write.mode("append").parquet(path)
        start_series(spark.readStream.schema(points([]).schema).parquet(path), PROGRESS, out).awaitTermination()
        return sorted((r.dataset, r.ts, r.njobs_done) for r in progress_history(read_series(spark, out)).collect())

    assert follow([("a", 100, 1), ("a", 200, 2), ("a", 400, 3), ("b", 10, 4), ("a", 5000, 9)]) == [
        ("a", 0, 2), ("a", 300, 3), ("a", 4800, 9), ("b", 0, 4)
    ]
    assert follow([("a", 250, 5), ("a", 310, 6)]) == [("a", 0, 5), ("a", 300, 3), ("a", 4800, 9), ("b", 0, 4)]


def test_means_over_batches(spark):
    schema = "log string, s bigint, value double"
    one = spark.createDataFrame([("a", 100, 1.0), ("a", 200, 2.0), ("b", 9, None)], schema)
    two = spark.createDataFrame([("a", 299, 6.0), ("a", 300, 4.0)], schema)
    parts = [telemetry_parts(df.select("log", F.timestamp_seconds("s").alias("ts"), F.lit("usr").alias("metric"), "value")) for df in (one, two)]
    got = sorted((r.log, r.ts, r.n, r["mean"]) for r in telemetry_means(parts[0].unionByName(parts[1])).collect())
    assert got == [("a", 0, 3, 3.0), ("a", 300, 1, 4.0), ("b", 0, 1, None)]


def test_parts_of_a_series_stay_few(spark, monkeypatch):
    """N batches lie in O(log N) parts; one that is run again, or fails in a merge, changes nothing."""
    path = fresh_path(spark, "series")
    counts = Series(lambda df: df.groupBy("k").agg(F.sum("v").alias("v")), lambda df: df.groupBy("k").agg(F.sum("v").alias("v")))
    batch = lambda n: spark.createDataFrame([(n % 3, 1), (n % 3, n)], "k int, v int").coalesce(1)
    total = lambda: {r.k: r.v for r in read_series(spark, path).groupBy("k").agg(F.sum("v").alias("v")).collect()}
    want = {}

    def stop(*_):
        raise RuntimeError("lost")

    for n in range(40):
        if n == 26:  # the merge of two levels is written, and then the commit fails
            with monkeypatch.context() as broken:
                broken.setattr(series_, "write_pointer", stop)
                with pytest.raises(RuntimeError):
                    add_batch(batch(n), n, counts, path, fan=3)
            assert total() == want
        add_batch(batch(n), n, counts, path, fan=3)
        want[n % 3] = want.get(n % 3, 0) + 1 + n
        assert len(read_pointer(spark, path)["parts"]) <= 8  # two of each level, levels 0 to 3
    assert total() == want
    for n in (39, 38, 5):
        add_batch(batch(n), n, counts, path, fan=3)
    assert total() == want
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    folders = held.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(held)
    assert sum(f.isDirectory() for f in folders) <= 16  # merged parts go
