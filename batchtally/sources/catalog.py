"""Dataset catalog: lookups, search, config fill, upsert."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchtally.functions.paths import basepath, normpath
from batchtally.functions.values import VALID_TEXT
from batchtally.plans.published import fresh_folder, read_pointer, write_pointer
from batchtally.plans.scan import MAX_GROUP_ROWS, number_rows
from batchtally.plans.storage import remove

# The sample type that needs no analysis, and the tag of uncatalogued directories.
PLAIN_TYPE = "CMS3"
DUMMY_TAG = "dummy_gtag"


def catalog_manifest(files: DataFrame, *, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Typed file rows ``(dataset, name, nevents, size_gb)``; ``seq`` counts in lexical name order."""
    typed = files.select(
        "dataset", "name", F.col("nevents").cast("bigint").alias("nevents"), F.col("size_gb").cast("double").alias("size_gb")
    )
    return number_rows(typed, ["dataset"], ["name"], pos="seq", census=files, max_group_rows=max_group_rows)


def dataset_totals(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.coalesce("nevents", F.lit(0))).cast("bigint").alias("nevents")
    )


def timestamp_key(stamp: Column | str = "timestamp") -> Column:
    """Sort key of a record: a missing timestamp counts as -1."""
    return F.coalesce(F.col(stamp) if isinstance(stamp, str) else stamp, F.lit(-1))


def sort_by_timestamp(rows: DataFrame, tie: str, *, descending: bool = True) -> DataFrame:
    key = timestamp_key()
    return rows.orderBy(key.desc() if descending else key.asc(), tie)


def catalog_matches(
    catalog: DataFrame, sample_type: str, *, analysis: str | None = None, tag: str | None = None, dataset: str | None = None
) -> DataFrame:
    """Valid records of a sample type; the analysis counts for every type but the plain one, the tag when given."""
    rows = catalog.filter((F.col("status") == VALID_TEXT) & (F.col("sample_type") == sample_type))
    if sample_type != PLAIN_TYPE:
        if analysis is None:
            raise ValueError("this sample type needs an analysis")
        rows = rows.filter(F.col("analysis") == analysis)
    if tag:
        rows = rows.filter(F.col("tag") == tag)
    return rows.filter(F.col("dataset") == dataset) if dataset is not None else rows


def latest_records(rows: DataFrame, keys: Sequence[str], tie: str) -> DataFrame:
    """The newest record per key; among equal timestamps the smallest ``tie``."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(-timestamp_key(), F.col(tie).isNull().alias("unknown"), F.col(tie))
    newest = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return newest.select(*keys, "_r.*")


def catalog_lookup(catalog: DataFrame, sample_type: str, *, tie: str, **filters) -> DataFrame:
    return latest_records(catalog_matches(catalog, sample_type, **filters), ["dataset"], tie)


# What a record has where the catalog gives nothing.
RECORD_TEXTS = {"filter_name": "NoFilter", "analysis": "", "version": "v1.0", "assigned_to": "", "status": VALID_TEXT, "twiki_name": "", "comments": ""}
RECORD_LISTS = ("siblings", "files")


def with_record_defaults(records: DataFrame) -> DataFrame:
    """Records with the defaults in place of absent columns and NULLs; an absent tag is that of ``cms3tag``."""
    has = lambda name: F.col(name) if name in records.columns else F.lit(None).cast("string")
    filled = {name: F.coalesce(has(name), F.lit(text)) for name, text in RECORD_TEXTS.items()}
    filled |= {name: F.coalesce(F.col(name), F.array()) if name in records.columns else F.array().cast("array<string>") for name in RECORD_LISTS}
    return records.withColumns(filled | {"tag": F.coalesce(has("tag"), has("cms3tag"))})


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob with ``*`` and ``?``."""
    body = "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in pattern)
    return f"(?s)^{body}$"


def glob_match(column: str, pattern: str) -> Column:
    """Does the column match the glob; the text before its first wildcard reaches the scan as a prefix."""
    head = re.split(r"[*?]", pattern, maxsplit=1)[0]
    whole = F.col(column).rlike(glob_regex(pattern))
    return F.col(column).startswith(head) & whole if head else whole


def catalog_search(
    catalog: DataFrame, pattern: str, equals: Mapping[str, object] | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Records whose dataset matches the glob and whose columns equal the given values."""
    rows = catalog.filter(glob_match("dataset", pattern))
    for name, value in (equals or {}).items():
        rows = rows.filter(F.col(name) == F.lit(value))
    return rows.select(*columns) if columns else rows


def payload_union(*payloads: DataFrame) -> DataFrame:
    """One text table with the union of all columns; absent cells are empty."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_as_text(p) for p in payloads])
    return both.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in both.columns])


def _as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def payload_files(payload: DataFrame) -> DataFrame:
    """Rows of the ``files`` array of a payload."""
    return payload.select(F.explode("files").alias("_f")).select("_f.*")


def sort_by_widest(table: DataFrame) -> DataFrame:
    """Rows ordered by the column with the longest text (name as tie-break); one small aggregate finds it."""
    widths = table.agg(*[F.max(F.greatest(F.length(c), F.lit(len(c)))).alias(c) for c in table.columns]).first().asDict()
    widest = min(widths, key=lambda c: (-(widths[c] or 0), c))
    return table.orderBy(widest, *[c for c in table.columns if c != widest])


def fill_config(datasets: DataFrame, config: DataFrame) -> DataFrame:
    """User's global tag and release, else the catalog's, else the dummy tag."""
    c = config.select("dataset", F.col("gtag").alias("_gtag"), F.col("release").alias("_release"))
    given = F.nullif(F.col("gtag"), F.lit(""))
    return datasets.join(c, "dataset", "left").withColumns(
        {
            "gtag": F.coalesce(given, "_gtag", F.lit(DUMMY_TAG)),
            "release": F.coalesce(F.nullif(F.col("release"), F.lit("")), "_release"),
        }
    ).drop("_gtag", "_release")


CATALOG_KEYS = ("dataset", "sample_type", "tag")


@dataclass(frozen=True)
class CatalogStore:
    """An upserted catalog: versions of records in buckets of their dataset's hash.

    Every bucket has a base and the deltas of later upserts. The pointer names them,
    and is renamed into place when they are written. An upsert adds deltas to the buckets of its own records; a
    bucket of more than ``deltas`` is rewritten to the newest records. A lookup by dataset reads one bucket.
    """

    root: str
    tie: str
    buckets: int = 64
    deltas: int = 8

    def _bucket(self, dataset: Column) -> Column:
        return F.pmod(F.xxhash64(dataset), F.lit(self.buckets)).cast("int")

    def _folders(self, spark: SparkSession) -> tuple[dict[str, list[str]], dict]:
        head = read_pointer(spark, self.root)
        if head and head["of"] != self.buckets:
            raise ValueError(f"the catalog at {self.root} has {head['of']} buckets")
        return head.get("buckets", {}), head

    def _read(self, spark: SparkSession, folders: Sequence[str], schema: T.StructType) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def upsert(self, records: DataFrame, now: int) -> None:
        """Add versions of records as of ``now``."""
        spark = records.sparkSession
        versions = records.withColumn("timestamp", F.lit(now).cast("bigint"))
        held, head = self._folders(spark)
        delta = fresh_folder("delta")
        self._write(versions, delta)
        touched = self._touched(spark, delta)
        buckets = {**held, **{b: [*held.get(b, []), f"{delta}/_bucket={b}"] for b in touched}}
        full = {b: buckets[b] for b in touched if len(buckets[b]) > self.deltas}
        gone = []
        if full:
            old = self._read(spark, [f for fs in full.values() for f in fs], versions.schema)
            base = fresh_folder("base")
            self._write(catalog_versions(old, self.tie).select(*versions.columns), base)
            buckets |= {b: [f"{base}/_bucket={b}"] for b in full}
            gone = [f for fs in full.values() for f in fs]
        write_pointer(spark, self.root, {"of": self.buckets, "buckets": buckets, "schema": versions.schema.json(), "gone": gone})
        for f in head.get("gone", []):
            remove(spark, f"{self.root}/{f}")

    def _write(self, versions: DataFrame, folder: str) -> None:
        dealt = versions.withColumn("_bucket", self._bucket(F.col("dataset"))).hint("rebalance", "_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")

    def _touched(self, spark: SparkSession, folder: str) -> list[str]:
        """Buckets of a delta, by the names of its folders."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        names = [f.getPath().getName() for f in found]
        return sorted(n.removeprefix("_bucket=") for n in names if n.startswith("_bucket="))

    def _schema(self, head: dict) -> T.StructType:
        if not head:
            raise ValueError(f"no catalog at {self.root}")
        return T.StructType.fromJson(json.loads(head["schema"]))

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest version of every record."""
        held, head = self._folders(spark)
        return catalog_versions(self._read(spark, [f for fs in held.values() for f in fs], self._schema(head)), self.tie)

    def lookup(self, spark: SparkSession, dataset: str) -> DataFrame:
        """The newest records of one dataset; only its bucket is read."""
        held, head = self._folders(spark)
        bucket = spark.range(1).select(self._bucket(F.lit(dataset))).first()[0]
        rows = self._read(spark, held.get(str(bucket), []), self._schema(head)).filter(F.col("dataset") == dataset)
        return catalog_versions(rows, self.tie)


def catalog_versions(versions: DataFrame, tie: str) -> DataFrame:
    """Current state of an upserted catalog, keyed by dataset, type and tag."""
    return latest_records(versions, CATALOG_KEYS, tie)


def located_files(records: DataFrame, listing: DataFrame, glob: str = "*") -> DataFrame:
    """Listed files that lie directly in the location of a record and whose name matches the glob."""
    place = records.select("dataset", normpath("location").alias("_dir"))
    named = listing.filter(F.substring_index("path", "/", -1).rlike(glob_regex(glob)))
    return named.withColumn("_dir", normpath(basepath("path"))).join(place, "_dir").drop("_dir")


def dataset_product(primaries: DataFrame, periods: Sequence[tuple[str, str]], pattern: str) -> DataFrame:
    """Every primary dataset with every (era, version); ``pattern`` takes all three.

    The periods are a literal list of the plan, so each row expands on its own
    and no join is needed.
    """
    listed = F.array(*[F.struct(F.lit(era).alias("era"), F.lit(version).alias("version")) for era, version in periods])
    return primaries.select("primary", F.explode(listed).alias("_p")).select(
        F.format_string(pattern, F.col("primary"), F.col("_p.era"), F.col("_p.version")).alias("dataset")
    )
