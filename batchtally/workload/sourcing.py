"""Catalog, storage, name function and stream queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchtally.functions import paths as P
from batchtally.functions import values as V
from batchtally.operators.chunking import ChunkRule, output_totals
from batchtally.operators import rollup as M
from batchtally.plans.storage import fresh_path
from batchtally.sources import catalog as C
from batchtally.sources import files as S
from batchtally.streaming.ingest import IngestStore, flush_leftovers, outputs_stream, start_ingest
from batchtally.streaming.series import PROGRESS, TELEMETRY, Series, progress_history, read_series, start_series, telemetry_means
from batchtally.workload.progress import _rollup
from batchtally.workload.tables import Tables, with_views
from batchtally.workload.tracking import summary_rows


def catalog_manifest(t: Tables) -> DataFrame:
    return C.catalog_manifest(t.manifest).withColumn("size_gb", F.round("size_gb", 6))


MANIFEST_SQL = with_views(
    "manifest", "SELECT dataset, name, nevents, round(size_gb, 6) AS size_gb, row_number() OVER (PARTITION BY dataset ORDER BY name) AS seq FROM manifest"
)


def dataset_totals(t: Tables) -> DataFrame:
    return C.dataset_totals(t.manifest)


def catalog_latest(t: Tables) -> DataFrame:
    plain = C.catalog_lookup(t.catalog, "CMS3", tie="id")
    tagged = C.catalog_lookup(t.catalog, "BABY", tie="id", analysis="blue", tag="bolt")
    cols = ["dataset", "sample_type", "analysis", "tag", "gtag", "timestamp", "id"]
    return plain.select(*cols).unionByName(tagged.select(*cols))


LATEST_SQL = with_views(
    "catalog",
    """SELECT dataset, sample_type, analysis, tag, gtag, timestamp, id FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, sample_type ORDER BY coalesce(timestamp, -1) DESC, id) AS r FROM catalog
  WHERE status = 'valid' AND (sample_type = 'CMS3' OR (analysis = 'blue' AND tag = 'bolt'))) WHERE r = 1""",
)


def catalog_sorted(t: Tables) -> DataFrame:
    return C.sort_by_timestamp(t.catalog, "id").select("id", "dataset", "timestamp")


def catalog_search(t: Tables) -> DataFrame:
    return C.catalog_search(t.catalog, "/Brand#1*/*C*/T", {"status": "valid", "analysis": "red"}, ["dataset", "tag", "gtag", "id"])


SEARCH_SQL = with_views(
    "catalog", "SELECT dataset, tag, gtag, id FROM catalog WHERE dataset LIKE '/Brand#1%/%C%/T' AND status = 'valid' AND analysis = 'red'"
)


def payload_union(t: Tables) -> DataFrame:
    people = t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    firms = t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("key"))
    return C.payload_union(people, firms)


UNION_SQL = """SELECT c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment, '' AS key FROM customer
UNION ALL SELECT s_name, CAST(s_nationkey AS VARCHAR), '', CAST(s_suppkey AS VARCHAR) FROM supplier"""


def payload_sorted(t: Tables) -> DataFrame:
    """Customers as the ``files`` of one payload per nation, unwrapped and ordered by the widest column."""
    file = F.struct("c_name", "c_acctbal", F.col("c_mktsegment").alias("a_segment_of_the_market"))
    payload = t.customer.groupBy("c_nationkey").agg(F.collect_list(file).alias("files"))
    return C.sort_by_widest(C.payload_union(C.payload_files(payload)))


def catalog_records(t: Tables) -> DataFrame:
    """Looked-up records with their defaults; versions and comments are absent from the catalog, some tags and analyses are NULL."""
    found = C.catalog_lookup(t.catalog, "CMS3", tie="id")
    bare = found.select(
        "dataset", "id", "status", F.col("tag").alias("cms3tag"), F.when(F.col("id") % 2 == 0, F.col("tag")).alias("tag"),
        F.when(F.col("id") % 3 == 0, F.col("analysis")).alias("analysis"), F.when(F.col("id") % 5 == 0, F.array("gtag")).alias("siblings"),
    )
    full = C.with_record_defaults(bare)
    return full.select(
        "dataset", "id", "status", "tag", "analysis", "version", "filter_name", "comments", F.size("files").alias("n_files"), F.array_join("siblings", ",").alias("siblings")
    )


RECORDS_SQL = with_views(
    "catalog",
    """SELECT dataset, id, status, tag, CASE WHEN id % 3 = 0 THEN analysis ELSE '' END AS analysis, 'v1.0' AS version, 'NoFilter' AS filter_name, '' AS comments,
  CAST(0 AS INTEGER) AS n_files, CASE WHEN id % 5 = 0 THEN gtag ELSE '' END AS siblings
FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY coalesce(timestamp, -1) DESC, id) AS r FROM catalog WHERE status = 'valid' AND sample_type = 'CMS3') WHERE r = 1""",
)


def config_fill(t: Tables) -> DataFrame:
    """Datasets with an own tag, with the catalog's, or with none."""
    wanted = t.part.groupBy(F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type", F.lit("/T")).alias("dataset")).agg(
        F.max(F.when(F.col("p_size") > 49, F.lit("own")).otherwise(F.lit(""))).alias("gtag"), F.lit(None).cast("string").alias("release")
    )
    config = C.catalog_lookup(t.catalog, "BABY", tie="id", analysis="blue").select("dataset", "gtag", F.col("tag").alias("release"))
    return C.fill_config(wanted, config)


CONFIG_SQL = with_views(
    "catalog",
    """SELECT w.dataset, coalesce(nullif(own, ''), c.gtag, 'dummy_gtag') AS gtag, c.tag AS release
FROM (SELECT '/' || p_brand || '/' || p_type || '/T' AS dataset, max(CASE WHEN p_size > 49 THEN 'own' ELSE '' END) AS own FROM part GROUP BY 1) w
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY coalesce(timestamp, -1) DESC, id) AS r FROM catalog
  WHERE status = 'valid' AND sample_type = 'BABY' AND analysis = 'blue') c ON c.dataset = w.dataset AND c.r = 1""",
)


def catalog_upsert(t: Tables) -> DataFrame:
    """All records are pushed, then those of one analysis again with a new tag value."""
    store = C.CatalogStore(fresh_path(t.spark, "catalog"), "id", buckets=16)
    records = t.catalog.drop("timestamp")
    store.upsert(records, 100)
    store.upsert(records.filter("analysis = 'red'").withColumn("gtag", F.concat("gtag", F.lit("_new"))), 200)
    return store.read(t.spark).select("dataset", "sample_type", "tag", "gtag", "timestamp", "id")


UPSERT_SQL = with_views(
    "catalog",
    """SELECT dataset, sample_type, tag, CASE WHEN analysis = 'red' THEN gtag || '_new' ELSE gtag END AS gtag,
  CAST(CASE WHEN analysis = 'red' THEN 200 ELSE 100 END AS BIGINT) AS timestamp, id
FROM (SELECT *, row_number() OVER (PARTITION BY dataset, sample_type, tag ORDER BY analysis = 'red' DESC, id) AS r FROM catalog) WHERE r = 1""",
)


def located_files(t: Tables) -> DataFrame:
    """Parts as files below the location of their dataset; big ones lie one level deeper."""
    records = C.catalog_lookup(t.catalog, "CMS3", tie="id").withColumn("location", F.concat(F.lit("/store//data"), "dataset", F.lit("/")))
    deeper = F.when(F.col("p_size") > 40, F.lit("/sub")).otherwise(F.lit(""))
    listing = t.part.select(
        F.concat(F.lit("/store/data/"), "p_brand", F.lit("/"), "p_type", F.lit("/T"), deeper, F.lit("/f_"), F.col("p_partkey").cast("string"), F.lit(".root")).alias("path")
    )
    return C.located_files(records, listing, "f_*1?.root").select("dataset", "path")


LOCATED_SQL = with_views(
    "catalog",
    """SELECT d.dataset, '/store/data' || d.dataset || '/f_' || p_partkey || '.root' AS path FROM part
JOIN (SELECT DISTINCT dataset FROM catalog WHERE status = 'valid' AND sample_type = 'CMS3') d ON d.dataset = '/' || p_brand || '/' || p_type || '/T'
WHERE p_size <= 40 AND substr(CAST(p_partkey AS VARCHAR), -2, 1) = '1' AND p_partkey >= 10""",
)

PERIODS = [("2017A", "v1"), ("2017A", "v2"), ("2017B", "v1")]


def dataset_product(t: Tables) -> DataFrame:
    primaries = t.part.select(F.concat_ws("_", "p_brand", "p_type").alias("primary")).distinct()
    return C.dataset_product(primaries, PERIODS, "/%s/Run%s-Prompt-%s/MINI")


PRODUCT_SQL = """SELECT DISTINCT '/' || p_brand || '_' || p_type || '/Run' || era || '-Prompt-' || v || '/MINI' AS dataset
FROM part, (VALUES ('2017A', 'v1'), ('2017A', 'v2'), ('2017B', 'v1')) p(era, v)"""


def state_overlay(t: Tables) -> DataFrame:
    """Customers of one segment have a saved state."""
    path = fresh_path(t.spark, "state")
    saved = t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit(None).cast("string").alias("c_name"), F.lit(0.5).alias("c_acctbal"))
    S.save_snapshot(saved, ["c_custkey"], ["c_name", "c_acctbal"], path)
    return S.overlay_snapshot(t.customer, S.read_snapshot(t.spark, path, saved.schema), ["c_custkey"], ["c_name", "c_acctbal"])


OVERLAY_SQL = """SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS c_name, c_nationkey,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 0.5e0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer"""


def summary_round_trip(t: Tables) -> DataFrame:
    """Rollup written as JSON with sorted keys and read back."""
    path = fresh_path(t.spark, "web")
    nested = _rollup(t).select(F.struct("dataset", *M.MEASURES).alias("general"), F.struct("missing_events").alias("bad"))
    S.write_summary(nested, path)
    back = S.read_summary(t.spark, path, S.sort_fields(nested).schema)
    return back.select("general.*", "bad.missing_events")


ROUND_SQL = with_views(
    "rollup", f"SELECT dataset, {', '.join(M.MEASURES)}, greatest(nevents_total - nevents_done, 0) AS missing_events FROM rollup"
)


def metadata_round_trip(t: Tables) -> DataFrame:
    """One metadata document per customer, written below its dataset folder and read back."""
    path = fresh_path(t.spark, "metadata")
    records = t.orders.groupBy(F.col("o_orderpriority").alias("dataset"), F.month("o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("top")
    )
    S.write_metadata(records, path)
    docs = t.spark.read.text(path)
    return docs.select(F.col("dataset"), F.from_json("value", "month int, n bigint, top bigint").alias("d")).select("dataset", "d.*")


METADATA_SQL = "SELECT o_orderpriority AS dataset, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n, max(o_orderkey) AS top FROM orders GROUP BY 1, 2"


def summary_documents(t: Tables) -> DataFrame:
    """Every output as a task summary document of its own, parsed back to rows."""
    rows = summary_rows(t)
    text = lambda c: F.col(c).cast("string")
    queued = F.create_map(F.lit("JobStatus"), F.col("job_status"), F.lit("EnteredCurrentStatus"), text("job_entered"))
    job = F.struct(
        F.array(F.lit("/out/x.root"), text("nevents")).alias("output"),
        F.when(F.col("is_on_queue"), queued).otherwise(F.create_map().cast("map<string,string>")).alias("current_job"),
        "output_exists",
        F.array(F.array(F.lit("in.root"), text("neg"))).alias("inputs"),
        F.array(F.struct(F.col("last_cluster").alias("cluster_id"), F.lit("e").alias("logfile_err"), F.lit("o").alias("logfile_out"))).alias("condor_jobs"),
        F.col("is_on_queue").alias("is_on_condor"),
    )
    task = F.struct(F.create_map(text("out_index"), job).alias("jobs"), F.lit(7).alias("queried_nevents"), F.lit(False).alias("open_dataset"),
                    F.concat(F.lit("/out/"), "dataset").alias("output_dir"), F.lit("v9").alias("tag"), F.lit("g3").alias("global_tag"),
                    F.lit("R_9").alias("cmssw_version"), F.lit("run.sh").alias("executable"), F.concat(F.lit("p"), text("out_index"), F.lit(".py")).alias("pset"),
                    F.struct(F.array(F.lit("x"), "dataset").alias("by")).alias("note"))
    parsed = S.task_summary_rows(rows.select(F.to_json(F.create_map("dataset", task)).alias("value")))
    return parsed.select(
        "dataset", "out_index", "nevents", "output_exists", "is_on_queue", "queried_nevents", "output_dir", "tag", "global_tag",
        F.col("inputs")[0]["nevents"].alias("neg"), F.col("attempts")[0]["cluster_id"].alias("last_cluster"), "cmssw_version", "executable",
        F.col("current_job")["JobStatus"].alias("job_status"), F.col("current_job")["EnteredCurrentStatus"].cast("bigint").alias("job_entered"),
        F.size("current_job").alias("n_job_fields"), F.col("extra")["pset"].alias("pset"), F.col("extra")["note"].alias("note"), F.size("extra").alias("n_extra"),
    )


DOCUMENTS_SQL = with_views(
    "summary", "SELECT dataset, out_index, nevents, output_exists, is_on_queue, CAST(7 AS BIGINT) AS queried_nevents, '/out/' || dataset AS output_dir, 'v9' AS tag, 'g3' AS global_tag, neg, last_cluster, "
    "'R_9' AS cmssw_version, 'run.sh' AS executable, CASE WHEN is_on_queue THEN job_status END AS job_status, CASE WHEN is_on_queue THEN job_entered END AS job_entered, "
    "CAST(CASE WHEN is_on_queue THEN 2 ELSE 0 END AS INTEGER) AS n_job_fields, 'p' || out_index || '.py' AS pset, "
    """'{"by":["x","' || dataset || '"]}' AS note, CAST(2 AS INTEGER) AS n_extra FROM summary""",
)


def moved_log_paths(t: Tables) -> DataFrame:
    """Attempt logs moved under a new root; attempts of returned lines lie elsewhere and go."""
    area = F.when(F.col("l_returnflag") == "R", F.lit("/scratch/")).otherwise(F.lit("/home/me/area/tasks/"))
    name = F.concat(F.lit("T/1e."), F.col("l_orderkey").cast("string"), F.lit(".0.out"))
    logs = t.lineitem.select("l_orderkey", F.when(F.col("l_quantity") > 5, F.concat(area, name)).alias("logfile_out"))
    return S.log_paths(logs, ".out", "area/tasks", "/new").select("l_orderkey", "log")


MOVED_SQL = "SELECT l_orderkey, '/new/T/1e.' || l_orderkey || '.0.out' AS log FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity > 5"


def path_functions(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select(
        "page_id",
        P.extension(u).alias("extension"),
        P.basepath(u).alias("basepath"),
        P.basename(u).alias("basename"),
        P.basename_noext(u).alias("noext"),
        P.normpath(u).alias("normal"),
        P.same_path(u, F.concat(u, F.lit("//."))).alias("same"),
        P.dataset_slug(u).alias("slug"),
        P.output_dir("/root", F.lit("me"), "area", u, F.lit("v1")).alias("out_dir"),
        P.unique_name(F.lit("Task"), u, F.lit("v1")).alias("task_name"),
        P.join_basepath(F.lit("/base"), P.basename(u)).alias("joined"),
        P.dataset_tier_swap(u, "example", "mini").alias("swapped"),
        P.task_key(F.lit("Task"), F.lit("v1"), u).alias("task_key"),
    )


PATHS_SQL = r"""SELECT page_id, split_part(url, '.', -1) AS extension, regexp_replace(url, '/[^/]*$', '') AS basepath, split_part(url, '/', -1) AS basename,
  regexp_replace(split_part(url, '/', -1), '\.[^.]*$', '') AS noext, rtrim(regexp_replace(url, '/+', '/', 'g'), '/') AS normal, true AS same,
  substr(replace(url, '/', '_'), 2) AS slug, '/root/me/area/' || substr(replace(url, '/', '_'), 2) || '_v1/' AS out_dir,
  'Task_' || substr(replace(url, '/', '_'), 2) || '_v1' AS task_name, '/base/' || split_part(url, '/', -1) AS joined,
  replace(url, 'example', 'mini') AS swapped, md5('Task' || chr(1) || 'v1' || chr(1) || url) AS task_key FROM pages"""


def file_names(t: Tables) -> DataFrame:
    """Name functions over the manifest, with files kept below the store prefix."""
    full = F.concat(F.lit("/hadoop/cms/x/hadoop/cms/"), F.when(F.col("listed"), "Run2017A/").otherwise(""), "name")
    m = t.manifest.select("name", full.alias("path"), "nevents")
    return m.select(
        "name",
        P.file_index("path").alias("index"),
        P.strip_store_prefix("path").alias("stripped"),
        P.strip_store_prefix("path", anchored=True).alias("anchored"),
        P.is_data_by_name("path").alias("is_data"),
        P.same_file("path", F.col("name")).alias("same"),
        P.comma_join(P.comma_split(F.concat_ws(",", "name", "path"))).alias("both"),
        V.try_number(F.substring_index(F.substring_index("name", ".", 1), "_", -1)).alias("number"),
        V.floor_to_history(P.file_index("path")).alias("mark"),
    )


NAMES_SQL = with_views(
    "manifest",
    """SELECT name, seq AS index, '/x/' || d || name AS stripped, '/x/hadoop/cms/' || d || name AS anchored, listed AS is_data, false AS same,
  name || ',/hadoop/cms/x/hadoop/cms/' || d || name AS both, CAST(seq AS DOUBLE) AS number, seq // 300 * 300 AS mark
FROM (SELECT *, CASE WHEN listed THEN 'Run2017A/' ELSE '' END AS d FROM manifest)""",
)


def _order_files(t: Tables) -> DataFrame:
    """Orders arriving as a stream of files."""
    stream = t.spark.readStream.schema(t.orders.schema).option("pathGlobFilter", "orders.parquet").parquet(t.sf_dir)
    return stream.select(
        F.col("o_orderpriority").alias("dataset"),
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("file_"), F.col("o_orderkey").cast("string"), F.lit(".root")).alias("name"),
        F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("nevents"),
    )


def _open(t: Tables) -> DataFrame:
    return t.datasets.withColumn("open", F.lit(True))


def open_ingest(t: Tables) -> DataFrame:
    """Open dataset: full outputs are mapped, the rest waits."""
    store = IngestStore(fresh_path(t.spark, "ingest"))
    start_ingest(_order_files(t), store, _open(t), ChunkRule(files=100)).awaitTermination()
    return output_totals(store.read_mapping(t.spark))


_STREAM = """f AS (SELECT o_orderpriority AS dataset, CAST(floor(o_totalprice / 1000) AS BIGINT) AS nevents,
  (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 100 + 1 AS out_index FROM orders),
stage1 AS (SELECT dataset, out_index, '/out/output_' || out_index || '.root' AS out_name, count(*) AS n_inputs, CAST(sum(nevents) AS BIGINT) AS out_nevents FROM f GROUP BY 1, 2)"""
INGEST_SQL = f"WITH {_STREAM}\nSELECT * FROM stage1 WHERE n_inputs = 100"


def open_ingest_flush(t: Tables) -> DataFrame:
    """The same stage after a flush on request."""
    store, rule = IngestStore(fresh_path(t.spark, "ingest")), ChunkRule(files=100)
    start_ingest(_order_files(t), store, _open(t), rule).awaitTermination()
    flush_leftovers(t.spark, store, _open(t), rule, 1)
    return output_totals(store.read_mapping(t.spark))


def stage_chain(t: Tables) -> DataFrame:
    """Outputs of a flushed stage are the files of the next one, which is bounded by events."""
    one, two = IngestStore(fresh_path(t.spark, "one")), IngestStore(fresh_path(t.spark, "two"))
    start_ingest(_order_files(t), one, _open(t), ChunkRule(files=100), flush_every=1).awaitTermination()
    start_ingest(outputs_stream(t.spark, one), two, _open(t), ChunkRule(events=60_000)).awaitTermination()
    return output_totals(two.read_mapping(t.spark))


CHAIN_SQL = f"""WITH RECURSIVE {_STREAM},
walk AS (SELECT dataset, out_index AS rn, out_nevents AS n, out_nevents AS held, CAST(1 AS BIGINT) AS c FROM stage1 WHERE out_index = 1
  UNION ALL SELECT s.dataset, s.out_index, s.out_nevents, CASE WHEN w.held + s.out_nevents > 60000 THEN s.out_nevents ELSE w.held + s.out_nevents END,
    CASE WHEN w.held + s.out_nevents > 60000 THEN w.c + 1 ELSE w.c END FROM walk w JOIN stage1 s ON s.dataset = w.dataset AND s.out_index = w.rn + 1)
SELECT dataset, c AS out_index, '/out/output_' || c || '.root' AS out_name, n_inputs, out_nevents
FROM (SELECT dataset, c, count(*) AS n_inputs, CAST(sum(n) AS BIGINT) AS out_nevents, max(c) OVER (PARTITION BY dataset) AS last_c FROM walk GROUP BY 1, 2) WHERE c < last_c"""


def _event_stream(t: Tables) -> DataFrame:
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return stream.withColumn("ts", F.timestamp_micros(V.epoch_micros("ts"))).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def _run_series(t: Tables, stream: DataFrame, series: Series, label: str) -> DataFrame:
    path = fresh_path(t.spark, label)
    start_series(stream, series, path).awaitTermination()
    return read_series(t.spark, path)


def progress_stream(t: Tables) -> DataFrame:
    points = _event_stream(t).select(
        F.col("event_type").alias("dataset"), "ts", F.col("k").alias("nevents_total"), (F.col("k") - 1).alias("nevents_done"),
        F.col("event_id").alias("njobs_total"), F.col("user_id").alias("njobs_done"),
    )
    return progress_history(_run_series(t, points, PROGRESS, "progress"))


PROGRESS_STREAM_SQL = """SELECT event_type AS dataset, s AS ts, k AS nevents_total, k - 1 AS nevents_done, event_id AS njobs_total, user_id AS njobs_done
FROM (SELECT *, row_number() OVER (PARTITION BY event_type, s ORDER BY ts DESC, k DESC, event_id DESC, user_id DESC) AS place
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 300000000 * 300 AS s FROM events)) WHERE place = 1"""


def telemetry_stream(t: Tables) -> DataFrame:
    samples = _event_stream(t).select(F.col("event_type").alias("log"), "ts", F.lit("usr").alias("metric"), "value")
    return telemetry_means(_run_series(t, samples, TELEMETRY, "means")).withColumn("mean", F.round("mean", 6))


TELEMETRY_STREAM_SQL = """SELECT event_type AS log, 'usr' AS metric, epoch_us(ts) // 300000000 * 300 AS ts, count(*) AS n, round(avg(value), 6) AS mean
FROM events GROUP BY 1, 2, 3"""

QUERIES = {
    "catalog_manifest": (catalog_manifest, MANIFEST_SQL),
    "dataset_totals": (
        dataset_totals,
        with_views("manifest", "SELECT dataset, count(*) AS n_files, CAST(sum(nevents) AS BIGINT) AS nevents FROM manifest GROUP BY 1"),
    ),
    "catalog_latest": (catalog_latest, LATEST_SQL),
    "catalog_sorted": (catalog_sorted, with_views("catalog", "SELECT id, dataset, timestamp FROM catalog")),
    "catalog_search": (catalog_search, SEARCH_SQL),
    "payload_union": (payload_union, UNION_SQL),
    "payload_sorted": (
        payload_sorted, "SELECT c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment AS a_segment_of_the_market FROM customer"
    ),
    "catalog_records": (catalog_records, RECORDS_SQL),
    "config_fill": (config_fill, CONFIG_SQL),
    "catalog_upsert": (catalog_upsert, UPSERT_SQL),
    "located_files": (located_files, LOCATED_SQL),
    "dataset_product": (dataset_product, PRODUCT_SQL),
    "state_overlay": (state_overlay, OVERLAY_SQL),
    "summary_round_trip": (summary_round_trip, ROUND_SQL),
    "metadata_round_trip": (metadata_round_trip, METADATA_SQL),
    "summary_documents": (summary_documents, DOCUMENTS_SQL),
    "moved_log_paths": (moved_log_paths, MOVED_SQL),
    "path_functions": (path_functions, PATHS_SQL),
    "file_names": (file_names, NAMES_SQL),
    "open_ingest": (open_ingest, INGEST_SQL),
    "open_ingest_flush": (open_ingest_flush, f"WITH {_STREAM}\nSELECT * FROM stage1"),
    "stage_chain": (stage_chain, CHAIN_SQL),
    "progress_stream": (progress_stream, PROGRESS_STREAM_SQL),
    "telemetry_stream": (telemetry_stream, TELEMETRY_STREAM_SQL),
}
