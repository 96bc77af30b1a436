"""The mapping of inputs to outputs as a bucketed table.

Rows lie in buckets of the hash of (dataset, input name), as the engine's joins
would deal them, so looking up which files of a manifest are mapped moves the
manifest alone, and nothing if it is bucketed alike. The largest output index of
each dataset is a small table of its own, a few rows for every extension.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchtally.operators.chunking import ChunkRule, mapping_rows, plan_files
from batchtally.plans.scan import MAX_GROUP_ROWS
from batchtally.plans.storage import load_or_empty, write_and_read

INDICES = "dataset string, last_index bigint"


@dataclass(frozen=True)
class MappingTable:
    """``name`` in the session's catalog, its files below ``root``. Extensions of one table run one at a time."""

    name: str
    root: str
    buckets: int = 64

    @classmethod
    def create(cls, root: str, *, buckets: int = 64) -> MappingTable:
        return cls(f"mapping_{uuid.uuid4().hex}", root, buckets)

    def read(self, spark: SparkSession) -> DataFrame | None:
        """All mapping rows; None before the first extension."""
        return spark.table(self.name) if spark.catalog.tableExists(self.name) else None

    def indices(self, spark: SparkSession) -> DataFrame:
        """The largest index of each dataset that has outputs."""
        reader = spark.read.format("parquet").schema(INDICES)
        found = load_or_empty(reader, spark, f"{self.root}/indices", INDICES)
        return found.groupBy("dataset").agg(F.max("last_index").alias("last_index"))

    def bucketed(self, rows: DataFrame, dataset: str, name: str):
        """A writer of ``rows`` in the table's buckets, one file for each."""
        return rows.repartition(self.buckets, dataset, name).write.format("parquet").bucketBy(self.buckets, dataset, name).sortBy(dataset, name)

    def unmapped(self, manifest: DataFrame, datasets: DataFrame) -> DataFrame:
        """Files still to plan: not mapped by name, and not of a closed dataset that already has outputs."""
        spark = manifest.sparkSession
        files, known = manifest.select("dataset", "seq", "name", "nevents"), self.read(spark)
        if known is None:
            return files
        closed = datasets.filter(~F.coalesce("open", F.lit(False))).select("dataset")
        settled = closed.join(self.indices(spark), "dataset", "left_semi")
        mapped = known.select("dataset", F.col("in_name").alias("name"))
        return files.join(mapped, ["dataset", "name"], "left_anti").join(settled, "dataset", "left_anti")

    def plan(
        self, manifest: DataFrame, datasets: DataFrame, rule: ChunkRule, *, base: str = "output.root", flush: bool = False,
        max_group_rows: int = MAX_GROUP_ROWS,
    ) -> DataFrame:
        """New mapping rows for the files not mapped yet. What a lookup finds is stored before it is counted and planned, so that it runs once."""
        spark = manifest.sparkSession
        fresh = self.unmapped(manifest, datasets)
        if spark.catalog.tableExists(self.name):
            fresh = write_and_read(fresh, "unmapped")
        planned = plan_files(fresh, self.indices(spark), datasets, rule, flush=flush, max_group_rows=max_group_rows)
        return mapping_rows(planned.filter("complete"), base)

    def extend(self, manifest: DataFrame, datasets: DataFrame, rule: ChunkRule, **options) -> DataFrame:
        """Plan, add the new rows to the table, and return them.

        Indices are written first: a run that fails in between leaves a gap in the numbers, and no two outputs share one.
        """
        rows = write_and_read(self.plan(manifest, datasets, rule, **options), "mapped")
        last = rows.groupBy("dataset").agg(F.max("out_index").alias("last_index"))
        last.write.mode("append").parquet(f"{self.root}/indices")
        self.bucketed(rows, "dataset", "in_name").mode("append").option("path", f"{self.root}/rows").saveAsTable(self.name)
        return rows
