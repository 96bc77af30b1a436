"""Listings, logs, summaries, metadata and snapshots on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchtally.functions.paths import STORE_PREFIX
from batchtally.plans.published import current, publish
from batchtally.plans.storage import load_or_empty

LISTING = "path string, length bigint, modificationTime timestamp"


def plain_path(path: Column | str) -> Column:
    """Path without scheme and authority."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(p, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", "")


def list_files(spark: SparkSession, location: str | Sequence[str], glob: str = "*", *, recursive: bool = False) -> DataFrame:
    """Files with size and time. The content column is pruned, so no file is opened."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    found = load_or_empty(reader, spark, location if isinstance(location, str) else list(location), LISTING)
    return found.select(plain_path("path").alias("path"), "length", F.col("modificationTime").alias("modification_time"))


def dir_manifest(
    spark: SparkSession, dataset: str, location: str, glob: str = "*.root", *, strip_store: bool = False
) -> DataFrame:
    """Manifest of a directory: no event counts, ordered by name through ``seq`` of equal value."""
    if not dataset or not location:
        raise ValueError("dataset and location are required")
    name = F.replace(F.col("path"), F.lit(STORE_PREFIX), F.lit("")) if strip_store else F.col("path")
    return list_files(spark, location, glob).select(
        F.lit(dataset).alias("dataset"),
        F.lit(0).cast("bigint").alias("seq"),
        name.alias("name"),
        F.lit(0).cast("bigint").alias("nevents"),
        (F.col("length") / F.lit(1e9)).alias("size_gb"),
    )


def log_listing(spark: SparkSession, root: str, ext: str = ".out") -> DataFrame:
    """Logs with an extension under every task folder of ``root``."""
    sub = "logs" if ext == ".log" else "logs/std_logs"
    found = list_files(spark, f"{root}/*/{sub}", f"*{ext}")
    return found.filter(~F.col("path").contains("/plots/") & ~F.col("path").contains("/summary.json/"))


def read_logs(spark: SparkSession, paths: str | Sequence[str], glob: str = "*") -> DataFrame:
    """One row per log: path and whole text."""
    texts = spark.read.option("pathGlobFilter", glob).text(paths if isinstance(paths, str) else list(paths), wholetext=True)
    return texts.select(plain_path("_metadata.file_path").alias("log"), F.col("value").alias("body"))


def log_paths(attempts: DataFrame, ext: str, marker: str, root: str) -> DataFrame:
    """Log path of each attempt moved under ``root``; rows without the path or the marker go."""
    col = F.col(f"logfile_{ext.lstrip('.')}")
    moved = F.concat(F.lit(root), F.element_at(F.split(col, F.lit("\\Q" + marker + "\\E")), 2))
    return attempts.filter(col.contains(marker)).withColumn("log", moved)


def _sorted_value(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_sorted_value(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(value, lambda x: _sorted_value(x, kind.elementType))
    return value


def sort_fields(df: DataFrame) -> DataFrame:
    """Columns and struct fields in name order."""
    return df.select(*[_sorted_value(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)])


def write_summary(summary: DataFrame, path: str) -> None:
    """JSON lines with sorted keys, as the new version of the summary at ``path``."""
    lines = sort_fields(summary)
    publish(summary.sparkSession, path, lambda folder: lines.write.option("ignoreNullFields", False).json(folder))


def read_summary(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The current version; undecodable lines are ignored, and it is empty before the first one."""
    folder = current(spark, path)
    if folder is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def write_metadata(records: DataFrame, path: str) -> None:
    """One JSON document per row, in one folder per dataset."""
    ordered = sort_fields(records)
    doc = F.to_json(F.struct(*ordered.columns), {"ignoreNullFields": "false"})
    ordered.select("dataset", doc.alias("value")).write.mode("overwrite").partitionBy("dataset").text(path)


def save_snapshot(state: DataFrame, keys: Sequence[str], columns: Sequence[str], path: str) -> None:
    """Keep the declared columns of each unit, as the new version of the snapshot at ``path``."""
    kept = state.select(*keys, *columns)
    publish(state.sparkSession, path, kept.write.parquet)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The current version; empty before the first one."""
    folder = current(spark, path)
    return spark.createDataFrame([], schema) if folder is None else spark.read.schema(schema).parquet(folder)


def overlay_snapshot(current: DataFrame, saved: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Saved values, also NULL ones, replace the current ones where the unit was saved."""
    s = saved.select(*keys, F.lit(True).alias("_saved"), *[F.col(c).alias(f"_s_{c}") for c in columns])
    joined = current.join(s, list(keys), "left")
    chosen = {c: F.when(F.col("_saved"), F.col(f"_s_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(chosen).select(*current.columns)


# Fields of a task summary that have a column of their own, with their types.
TASK_FIELDS = {
    "queried_nevents": "bigint",
    "open_dataset": "boolean",
    "output_dir": "string",
    "tag": "string",
    "global_tag": "string",
    "cmssw_version": "string",
    "executable": "string",
}
_ATTEMPTS = "array<struct<cluster_id:bigint,logfile_err:string,logfile_out:string>>"


def read_task_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Task summary files, one document each, as rows."""
    return task_summary_rows(spark.read.text(path, wholetext=True))


def _members(rows: DataFrame, value: str, key: str) -> DataFrame:
    """One row per member of the JSON object ``value``: its name as ``key``, its value as ``_m``."""
    members = rows.sparkSession.tvf.variant_explode(F.col(value).outer())
    return rows.lateralJoin(members.select(F.col("key").alias(key), F.col("value").alias("_m"))).filter(F.col(key).isNotNull())


def task_summary_rows(docs: DataFrame) -> DataFrame:
    """Task summary documents (``value``) to one row per (dataset, out_index).

    ``current_job`` maps the fields of the queue row of the last attempt; ``extra`` holds what a
    task's summary was supplemented with, as text (JSON for nested values). Documents that are no JSON go.
    """
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    tasks = _members(docs.select(F.try_parse_json("value").alias("_d")), "_d", "dataset")
    # only the members that are kept become text; the jobs, by far the longest one, do not
    others = F.map_filter(get(F.col("_m"), "$", "map<string,variant>"), lambda k, _: ~k.isin("jobs", *TASK_FIELDS))
    raw = lambda v: F.when(F.schema_of_variant(v) == "STRING", get(v, "$", "string")).otherwise(F.to_json(v))
    extra = F.transform_values(others, lambda _, v: F.when(~F.is_variant_null(v), raw(v)))
    own = [get(F.col("_m"), f"$.{name}", kind).alias(name) for name, kind in TASK_FIELDS.items()]
    jobs = _members(tasks.select("dataset", *own, extra.alias("extra"), get(F.col("_m"), "$.jobs", "variant").alias("_jobs")), "_jobs", "_i")
    job = F.col("_m")
    pairs = get(job, "$.inputs", "array<array<string>>")
    whole = lambda x: x.try_cast("double").cast("bigint")
    return jobs.select(
        "dataset",
        *TASK_FIELDS,
        F.col("_i").cast("bigint").alias("out_index"),
        get(job, "$.output[0]", "string").alias("out_name"),
        whole(get(job, "$.output[1]", "string")).alias("nevents"),
        get(job, "$.output_exists", "boolean").alias("output_exists"),
        get(job, "$.is_on_condor", "boolean").alias("is_on_queue"),
        F.transform(pairs, lambda x: F.struct(x[0].alias("name"), whole(x[1]).alias("nevents"))).alias("inputs"),
        get(job, "$.condor_jobs", _ATTEMPTS).alias("attempts"),
        get(job, "$.current_job", "map<string,string>").alias("current_job"),
        "extra",
    )
