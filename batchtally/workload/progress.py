"""Monitoring queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchtally.functions.values import epoch_micros
from batchtally.operators import rollup as M
from batchtally.workload.mining import SIGNATURE_VIEW
from batchtally.workload.tables import NOW, Tables, with_views
from batchtally.workload.tracking import summary_rows

LATER = 1_710_000_000
MEASURES_SQL = ", ".join(M.MEASURES)


def _rollup(t: Tables, *carried: Column) -> DataFrame:
    queried = t.manifest.groupBy("dataset").agg(F.sum("nevents").alias("queried_nevents"), *carried)
    return M.dataset_rollup(M.with_done(summary_rows(t)), queried)


def dataset_rollup(t: Tables) -> DataFrame:
    """General records, with the fields of the task summary."""
    own = [
        F.lit(False).alias("open_dataset"),
        F.concat(F.lit("/out/"), F.first("dataset")).alias("output_dir"),
        F.concat(F.lit("v"), F.max(F.month("o_orderdate")).cast("string")).alias("tag"),
        F.lit("g1").alias("global_tag"),
        F.lit("R_9").alias("cmssw_version"),
        F.lit("run.sh").alias("executable"),
    ]
    return M.general_record(_rollup(t, *own))


ROLLUP_SQL = with_views(
    "rollup",
    f"""SELECT dataset, {MEASURES_SQL}, greatest(nevents_total - nevents_done, 0) AS missing_events, 'running' AS status, 'CMSSW' AS type,
  false AS open_dataset, '/out/' || dataset AS output_dir, 'v' || m AS tag, 'g1' AS global_tag, 'R_9' AS cmssw_version, 'run.sh' AS executable
FROM rollup JOIN (SELECT o_orderpriority AS dataset, max(month(o_orderdate)) AS m FROM orders GROUP BY 1) USING (dataset)""",
)


def bad_jobs(t: Tables) -> DataFrame:
    """Retries of undone outputs; documents are the error logs of the clusters with their number."""
    logs = t.logs.select(F.regexp_extract("log", "([0-9]+)", 1).cast("bigint").alias("cluster_id"), "log", "err")
    rows = M.with_done(summary_rows(t, t.stored_attempts))
    mapping = t.lineitem.join(t.orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("dataset"), F.col("l_orderkey").alias("out_index"), F.col("l_quantity").cast("bigint").alias("in_nevents")
    )
    return M.bad_jobs(rows, mapping, t.stored_attempts, logs)


BAD_SQL = with_views(
    "summary",
    """SELECT e.dataset, e.out_index, retries, n AS inputs, ev AS events, coalesce(signature, '') AS last_error,
  CASE WHEN doc_id IS NULL THEN '' ELSE 'doc_' || doc_id || '.out' END AS last_log
FROM earlier e JOIN (SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS ev FROM lineitem GROUP BY 1) i ON i.l_orderkey = e.out_index
LEFT JOIN signatures s ON s.doc_id = e.cluster_id""",
    more=f"""{SIGNATURE_VIEW},
earlier AS (SELECT dataset, out_index, count(*) AS retries, arg_max(cluster_id, attempt_no) AS cluster_id
  FROM attempts JOIN last_attempt USING (dataset, out_index) JOIN summary USING (dataset, out_index)
  WHERE attempt_no < last_no AND NOT (output_exists AND NOT is_on_queue) GROUP BY 1, 2)""",
)


def history_points(t: Tables) -> DataFrame:
    return M.history_points(_rollup(t), NOW + 17)


POINTS_SQL = with_views("rollup", f"SELECT dataset, CAST({(NOW + 17) // 300 * 300} AS BIGINT) AS ts, {MEASURES_SQL} FROM rollup")


def history_totals(t: Tables) -> DataFrame:
    return M.history_totals(t.history)


def chart_series(t: Tables) -> DataFrame:
    return M.chart_series(M.history_totals(t.history))


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Old history of all types but one; new history of all types but another."""
    return t.history.filter("dataset <> 'view'"), t.history.filter("dataset <> 'error'")


def history_merge(t: Tables) -> DataFrame:
    old, new = _halves(t)
    return M.merge_history(old, new)


MERGE_SQL = with_views(
    "history",
    f"""SELECT dataset, ts, {MEASURES_SQL} FROM history WHERE dataset NOT IN ('view', 'error')
UNION ALL SELECT dataset, ts, {MEASURES_SQL} FROM history WHERE dataset <> 'error'""",
)


def history_arrays(t: Tables) -> DataFrame:
    """Array form: vectors as two measures of a dataset; two labels lack an old or a new part."""
    at = lambda first: F.transform("embedding", lambda _, i: (i + first).cast("bigint"))
    scaled = lambda by: F.transform("embedding", lambda x: F.floor(x.cast("double") * by).cast("bigint"))

    def arrays(rows: DataFrame, first: int, by: int) -> DataFrame:
        measures = [at(first).alias("timestamps"), scaled(by).alias("njobs_done"), scaled(by * 2).alias("nevents_done")]
        return rows.select(F.col("vec_id").cast("string").alias("dataset"), *measures)

    old, new = t.embeddings.filter("label <> 1"), t.embeddings.filter("label <> 2")
    return M.explode_history(M.merge_history_arrays(arrays(old, 0, 512), arrays(new, 1000, 1024)), ["njobs_done", "nevents_done"])


def _vector_sql(first: int, by: int, labels: str) -> str:
    return f"""SELECT CAST(vec_id AS VARCHAR) AS dataset, unnest(range(len(embedding))) + {first} AS ts,
  unnest(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {by}) AS BIGINT))) AS njobs_done,
  unnest(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {by * 2}) AS BIGINT))) AS nevents_done
FROM embeddings WHERE {labels}"""


ARRAYS_SQL = _vector_sql(0, 512, "label NOT IN (1, 2)") + "\nUNION ALL " + _vector_sql(1000, 1024, "label <> 2")


def carry_over(t: Tables) -> DataFrame:
    """Customers with orders are the new records; the others keep their prior one."""
    old = t.customer.select(F.col("c_custkey").alias("dataset"), F.lit("prior").alias("source"), F.col("c_acctbal").alias("v"))
    new = t.orders.groupBy(F.col("o_custkey").alias("dataset")).agg(F.lit("current").alias("source"), F.max("o_totalprice").alias("v"))
    return M.carry_over(old, new)


CARRY_SQL = """SELECT c_custkey AS dataset, 'prior' AS source, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT o_custkey, 'current', max(o_totalprice) FROM orders GROUP BY 1"""


def latest_summaries(t: Tables) -> DataFrame:
    s = t.events.select(F.col("user_id").alias("dataset"), F.col("event_id").alias("poll_ts"), "event_type", "value")
    return M.latest_summaries(s)


LATEST_SQL = """SELECT user_id AS dataset, max(event_id) AS poll_ts, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1"""


def grand_totals(t: Tables) -> DataFrame:
    return M.grand_totals(_rollup(t))


TOTALS_SQL = with_views(
    "rollup",
    """SELECT *, nevents_total - nevents_done AS nevents_missing, njobs_total - njobs_done AS njobs_running,
  floor(100e0 * nevents_done / nullif(nevents_total, 0) * 100 + 0.5) / 100 AS pct_events, floor(100e0 * njobs_done / nullif(njobs_total, 0) * 100 + 0.5) / 100 AS pct_jobs
FROM (SELECT """
    + ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in M.MEASURES)
    + " FROM rollup)",
)


def progress(t: Tables) -> DataFrame:
    return M.sort_datasets(_rollup(t), "progress").select("dataset", F.round("pct", 6).alias("pct"), "label")


PROGRESS_SQL = with_views(
    "rollup",
    "SELECT dataset, round(100e0 * njobs_done / njobs_total, 6) AS pct, CAST(floor(100e0 * njobs_done / njobs_total + 0.5) AS BIGINT) AS label FROM rollup",
)


def type_filter(t: Tables) -> DataFrame:
    return M.visible_types(t.catalog.select("id", F.nullif(F.col("sample_type"), F.lit("CMS3")).alias("type")))


def _jobs(t: Tables) -> DataFrame:
    state = {"view": "running", "click": "finished", "error": "failed", "purchase": "transferring", "signup": "held"}
    table = F.create_map(*[F.lit(x) for kv in state.items() for x in kv])
    return t.events.select(
        F.col("user_id").alias("task"),
        F.get_json_object("props", "$.k").cast("bigint").alias("jobid"),
        F.try_element_at(table, F.col("event_type")).alias("status"),
        F.col("event_id").alias("seq"),
    )


JOBS = """jobs AS (SELECT user_id AS task, CAST(json_extract_string(props, '$.k') AS BIGINT) AS jobid, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'finished' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'transferring' WHEN 'signup' THEN 'held' END AS status FROM events)"""


def status_breakdown(t: Tables) -> DataFrame:
    return M.status_breakdown(_jobs(t))


BREAKDOWN_SQL = (
    f"WITH {JOBS}\nSELECT task, "
    + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in M.GRID_STATES)
    + ", count(*) FILTER (WHERE status = 'held') AS unknown FROM jobs GROUP BY task"
)


def job_info(t: Tables) -> DataFrame:
    return M.job_info(_jobs(t))


def _polls(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("task"), epoch_micros("ts").alias("poll_ts"), F.col("event_id").alias("poll_id"),
        F.nullif(F.col("event_type"), F.lit("error")).alias("status"),
    )


def last_good_status(t: Tables) -> DataFrame:
    return M.last_good_status(_polls(t)).select("task", "poll_id", "shown")


GOOD_SQL = """SELECT user_id AS task, event_id AS poll_id, coalesce(last_value(nullif(event_type, 'error') IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'UNKNOWN') AS shown FROM events"""


def current_status(t: Tables) -> DataFrame:
    return M.current_status(_polls(t))


CURRENT_SQL = """SELECT user_id AS task, coalesce(arg_max(event_type, event_id) FILTER (WHERE event_type <> 'error'), 'UNKNOWN') AS shown FROM events GROUP BY 1"""


def elapsed_minutes(t: Tables) -> DataFrame:
    """Requests named after the minute an event came in."""
    s = F.col("ts").cast("string")
    stamp = F.concat(*[F.substring(s, i, 2) for i in (3, 6, 9)], F.lit("_"), *[F.substring(s, i, 2) for i in (12, 15, 18)])
    named = t.events.select("event_id", F.concat(stamp, F.lit(":user")).alias("request"))
    got = M.minutes_since_submit(named, LATER)
    return got.select("event_id", F.round("minutes", 4).alias("minutes"), F.round("elapsed", 4).alias("elapsed"))


MINUTES_SQL = f"""SELECT event_id, round((({LATER} - s) % 86400) / 60e0, 4) AS minutes, round(({LATER} - s) / 60e0, 4) AS elapsed
FROM (SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM events)"""


def map_sums(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return M.sum_maps(t.events.select(F.create_map("event_type", k, F.lit("all"), F.lit(1).cast("bigint")).alias("m")), "m")


MAPS_SQL = """SELECT event_type AS key, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1
UNION ALL SELECT 'all', count(*) FROM events"""

_TOTALS = "SELECT ts, " + ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in M.MEASURES) + " FROM history GROUP BY ts"

QUERIES = {
    "dataset_rollup": (dataset_rollup, ROLLUP_SQL),
    "bad_jobs": (bad_jobs, BAD_SQL),
    "history_points": (history_points, POINTS_SQL),
    "history_totals": (history_totals, with_views("history", _TOTALS)),
    "chart_series": (chart_series, with_views("history", f"SELECT ts, njobs_done, njobs_total FROM ({_TOTALS})")),
    "history_merge": (history_merge, MERGE_SQL),
    "history_arrays": (history_arrays, ARRAYS_SQL),
    "carry_over": (carry_over, CARRY_SQL),
    "latest_summaries": (latest_summaries, LATEST_SQL),
    "grand_totals": (grand_totals, TOTALS_SQL),
    "progress": (progress, PROGRESS_SQL),
    "type_filter": (type_filter, with_views("catalog", "SELECT id, CAST(NULL AS VARCHAR) AS type FROM catalog WHERE sample_type = 'CMS3'")),
    "status_breakdown": (status_breakdown, BREAKDOWN_SQL),
    "job_info": (job_info, f"WITH {JOBS}\nSELECT task, jobid, arg_max(status, seq) AS status FROM jobs GROUP BY 1, 2"),
    "last_good_status": (last_good_status, GOOD_SQL),
    "current_status": (current_status, CURRENT_SQL),
    "elapsed_minutes": (elapsed_minutes, MINUTES_SQL),
    "map_sums": (map_sums, MAPS_SQL),
}
