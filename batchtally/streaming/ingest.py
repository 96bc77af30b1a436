"""Open datasets: new files arrive, are chunked, and leftovers wait.

What a stage knows is small: the files that wait, and the largest output index of
each dataset. Both are a state of their own, written anew by every batch. Names
seen before are kept by the engine's keyed stream state, so a file that is
listed again costs a lookup. No batch reads arrivals or mapping rows of earlier
batches.

A batch writes its mapping rows and the next state, and then commits both by renaming a
pointer. Run again before the commit it starts from the same state and replaces its rows;
run again after it, it only completes what it publishes. ``outputs`` feeds the next
stage. It is derived from the written mapping rows of a batch, and only
what the batch has not published yet is added, so nothing is listed twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from batchtally.operators.chunking import ChunkRule, mapping_rows, output_totals, plan_files
from batchtally.plans.published import fresh_folder, read_pointer, write_pointer
from batchtally.plans.scan import MAX_GROUP_ROWS
from batchtally.plans.storage import load_or_empty, remove

# Fixed value: passes between two flushes.
FLUSH_EVERY = 48

FILES = "dataset string, seq bigint, name string, nevents bigint"
PLANNED = f"{FILES}, out_index bigint, output_dir string, complete boolean"
_FILE = ["dataset", "seq", "name", "nevents"]
INDICES = "dataset string, last_index bigint"
MAPPING_ROWS = "dataset string, out_index bigint, out_name string, in_seq bigint, in_name string, in_nevents bigint"
MAPPING = f"{MAPPING_ROWS}, origin string, batch_id bigint"
OUTPUTS = FILES
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# State on disk, with checkpoints of what a batch changed.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@dataclass(frozen=True)
class IngestStore:
    """Where one open-dataset stage keeps its tables."""

    root: str

    @property
    def mapping(self) -> str:
        return f"{self.root}/mapping"

    @property
    def outputs(self) -> str:
        return f"{self.root}/outputs"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"

    def read(self, spark: SparkSession, path: str, schema: str) -> DataFrame:
        reader = spark.read.format("parquet").schema(schema).option("basePath", path)
        return load_or_empty(reader, spark, path, schema)

    def state(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Waiting files and largest indices, as committed last."""
        folder = read_pointer(spark, self.root).get("state")
        if folder is None:
            return spark.createDataFrame([], FILES), spark.createDataFrame([], INDICES)
        waiting = spark.read.schema(PLANNED).parquet(f"{self.root}/{folder}/planned").filter("not complete")
        return waiting.select(*_FILE), spark.read.schema(INDICES).parquet(f"{self.root}/{folder}/indices")

    def read_waiting(self, spark: SparkSession) -> DataFrame:
        return self.state(spark)[0]

    def read_mapping_rows(self, spark: SparkSession, origin: str, number: int) -> DataFrame:
        """The rows of one batch, without looking at the others."""
        return self.read(spark, f"{self.mapping}/origin={origin}/batch_id={number}", MAPPING_ROWS)

    def read_mapping(self, spark: SparkSession) -> DataFrame:
        return self.read(spark, self.mapping, MAPPING)


def _advance(
    store: IngestStore, fresh: DataFrame, datasets: DataFrame, rule: ChunkRule, *, origin: str, number: int,
    flush: bool, base: str, max_group_rows: int,
) -> None:
    """Plan waiting and fresh files, unless this batch was committed before."""
    spark = fresh.sparkSession
    head = read_pointer(spark, store.root)
    if number <= head.get(origin, -1):
        return
    waiting, indices = store.state(spark)
    folder = fresh_folder("state")
    # stored, so that all that follows is of one plan; its incomplete part is what waits from then on
    planned = plan_files(waiting.unionByName(fresh), indices, datasets, rule, flush=flush, max_group_rows=max_group_rows)
    planned.write.partitionBy("complete").parquet(f"{store.root}/{folder}/planned")
    complete = spark.read.schema(PLANNED).parquet(f"{store.root}/{folder}/planned").filter("complete")
    mapping_rows(complete, base).write.mode("overwrite").parquet(f"{store.mapping}/origin={origin}/batch_id={number}")
    grown = indices.unionByName(complete.select("dataset", F.col("out_index").alias("last_index")))
    grown.groupBy("dataset").agg(F.max("last_index").alias("last_index")).write.parquet(f"{store.root}/{folder}/indices")
    write_pointer(spark, store.root, {**head, origin: number, "state": folder, "before": head.get("state")})
    if head.get("before"):
        remove(spark, f"{store.root}/{head['before']}")


def _publish(spark: SparkSession, store: IngestStore, *, origin: str, number: int) -> None:
    """List the outputs of one batch for the next stage. Published files stay, since a stream may be reading them."""
    written = store.read_mapping_rows(spark, origin, number)
    made = output_totals(written).select(
        "dataset", F.col("out_index").alias("seq"), F.col("out_name").alias("name"), F.col("out_nevents").alias("nevents")
    )
    folder = f"{store.outputs}/{origin}-{number}"
    there = store.read(spark, folder, OUTPUTS).select("dataset", "name")
    made.join(there, ["dataset", "name"], "left_anti").select(*made.columns).write.mode("append").parquet(folder)


def ingest_batch(
    store: IngestStore, datasets: DataFrame, rule: ChunkRule, *, flush_every: int = FLUSH_EVERY,
    base: str = "output.root", max_group_rows: int = MAX_GROUP_ROWS,
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function of one stage, for names that no earlier batch had; ``datasets`` holds ``dataset, open, output_dir``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.select("dataset", F.col("seq").cast("bigint").alias("seq"), "name", F.col("nevents").cast("bigint").alias("nevents"))
        _advance(
            store, fresh, datasets, rule, origin="stream", number=batch_id,
            flush=(batch_id + 1) % flush_every == 0, base=base, max_group_rows=max_group_rows,
        )
        _publish(batch.sparkSession, store, origin="stream", number=batch_id)

    return run


def start_ingest(
    files: DataFrame, store: IngestStore, datasets: DataFrame, rule: ChunkRule, *, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Run the stage over a stream of files ``(dataset, seq, name, nevents)``.

    The first row of a name counts; rows of one name within one batch are taken to be equal.
    """
    unseen = files.dropDuplicates(["dataset", "name"])
    conf = files.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        conf.set(k, v)
    try:  # a query takes the settings it is started with
        return (
            unseen.writeStream.foreachBatch(ingest_batch(store, datasets, rule, **options))
            .option("checkpointLocation", store.checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def flush_leftovers(
    spark: SparkSession, store: IngestStore, datasets: DataFrame, rule: ChunkRule, number: int, *,
    base: str = "output.root", max_group_rows: int = MAX_GROUP_ROWS,
) -> None:
    """Map the waiting files now. Flushes are numbered upwards; running one again completes what a failure left open.

    Spark runs no micro-batch without new data, so a flush on request is a batch
    job; run it while the stage's stream is stopped.
    """
    none = spark.createDataFrame([], FILES)
    _advance(store, none, datasets, rule, origin="flush", number=number, flush=True, base=base, max_group_rows=max_group_rows)
    _publish(spark, store, origin="flush", number=number)


def outputs_stream(spark: SparkSession, store: IngestStore, rename: dict[str, str] | None = None) -> DataFrame:
    """Outputs of one stage as the file stream of the next; ``rename`` maps dataset names by tier."""
    stream = spark.readStream.schema(OUTPUTS).option("recursiveFileLookup", True).parquet(store.outputs)
    for old, new in (rename or {}).items():
        stream = stream.withColumn("dataset", F.replace("dataset", F.lit(old), F.lit(new)))
    return stream
