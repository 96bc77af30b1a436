"""Log and telemetry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchtally.operators import logs as G
from batchtally.operators import rollup as M
from batchtally.operators import telemetry as T
from batchtally.plans.storage import write_and_read
from batchtally.workload.tables import CLOCK, Tables, with_views
from batchtally.workload.tracking import summary_rows

BLANKS = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '{BLANKS}', '', 'g')"


def log_headers(t: Tables) -> DataFrame:
    return G.header_args(t.logs)


HEADERS_SQL = with_views(
    "doc_lines",
    f"""SELECT 'doc_' || doc_id || '.out' AS log, {_strip("split_part(line, ':', 1)")} AS key,
  arg_max({_strip("substr(line, strpos(line, ':') + 1)")}, line_no) AS val FROM header_lines WHERE contains(line, ':') GROUP BY 1, 2""",
    more="""header_lines AS (SELECT doc_id, line_no, line FROM doc_lines
  UNION ALL SELECT doc_id, -2, 'DOC: ' || doc_id FROM documents UNION ALL SELECT doc_id, -1, 'LANG: first' FROM documents
  UNION ALL SELECT doc_id, 0, 'LANG: ' || lang FROM documents)""",
)


def log_telemetry(t: Tables) -> DataFrame:
    return G.telemetry(t.logs).select("log", F.col("row_no").cast("bigint").alias("row_no"), "metric", "value", "raw", "since_start", "bad")


# Columns of the test logs, and what SQL says their cells hold; line_no counts from 1.
LOG_CELLS = {
    "usr": "length(line)",
    "sys": "len(string_split(line, ' '))",
    "idl": "100 - (line_no - 1) % 7",
    "read": "1",
    "writ": "(line_no - 1) * 3",
    "recv": "(line_no - 1) % 5",
    "send": "(line_no - 1) % 11",
    "used": "line_no * 1000",
    "buff": "(line_no - 1) * (line_no - 1)",
    "date/time": None,
    "epoch": "1500000000 + (line_no - 1) * 45",
}
METRICS = ", ".join(f"'{m}'" for m in LOG_CELLS)
CELLS = f"""cells AS (SELECT lang AS dataset, 'doc_' || doc_id || '.out' AS log, line_no - 1 AS row_no, (line_no - 1) * 45 AS since_start,
  unnest([{METRICS}]) AS metric, unnest([{', '.join('NULL' if e is None else f'CAST({e} AS DOUBLE)' for e in LOG_CELLS.values())}]) AS value FROM doc_lines)"""

TELEMETRY_SQL = with_views(
    "doc_lines",
    f"""SELECT log, row_no, metric, value, CASE WHEN metric = 'date/time' THEN '{CLOCK}' END AS raw, CAST(since_start AS DOUBLE) AS since_start, false AS bad FROM cells""",
    more=CELLS,
)


def telemetry_columns(t: Tables) -> DataFrame:
    cols = G.telemetry_columns(t.logs)
    return cols.select("log", "metric", F.array_join("cells", "|").alias("cells"))


COLUMNS_SQL = with_views(
    "doc_lines",
    f"""SELECT 'doc_' || doc_id || '.out' AS log, unnest([{METRICS}]) AS metric,
  unnest([{', '.join(f"string_agg({f"'{CLOCK}'" if e is None else e}, '|' ORDER BY line_no)" for e in LOG_CELLS.values())}]) AS cells FROM doc_lines GROUP BY doc_id""",
)


def log_telemetry_legacy(t: Tables) -> DataFrame:
    cells = G.telemetry_legacy(t.logs)
    return cells.groupBy("log", "host", "metric").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


LEGACY_SQL = with_views(
    "doc_lines",
    """SELECT log, 'host-' || dataset AS host, metric, count(*) AS n, sum(value) AS total FROM (
  SELECT dataset, log, CASE WHEN metric = 'used' THEN 'used_mem' ELSE metric END AS metric, value FROM cells WHERE metric <> 'date/time'
  UNION ALL SELECT dataset, log, 'used_swp', 7 FROM cells WHERE metric = 'usr') GROUP BY 1, 2, 3""",
    more=CELLS,
)


def log_validity(t: Tables) -> DataFrame:
    """Job logs are valid, error logs are not; each with the job log that stands for it."""
    both = t.logs.select("log", "body").unionByName(t.logs.select(G.err_name_of("log").alias("log"), F.col("err").alias("body")))
    return G.log_validity(both).withColumn("job_log", G.out_name_of("log"))


VALIDITY_SQL = """SELECT 'doc_' || doc_id || '.out' AS log, 'host-' || lang AS host, true AS valid, 'doc_' || doc_id || '.out' AS job_log FROM documents
UNION ALL SELECT 'doc_' || doc_id || '.err', NULL, false, 'doc_' || doc_id || '.out' FROM documents"""


def log_signatures(t: Tables) -> DataFrame:
    return t.logs.select(G.err_name_of("log").alias("log"), G.error_signature("err").alias("signature"))


_BLOCK = """' now -----' || chr(10) || 'An exception of category ''Err_' || source || ''' occurred while' || chr(10) || text || chr(10)"""
SIGNATURE_VIEW = f"""signatures AS (SELECT doc_id, CASE WHEN lang = 'en' THEN '' ELSE '[Err_' || source || '] ' ||
  left(array_to_string(list_transform(list_slice(lines, -2, -1), lambda x: {_strip('x')}), ', '), 300) END AS signature
  FROM (SELECT doc_id, lang, source, string_split_regex({_strip(_BLOCK)}, '\\r\\n|\\n|\\r') AS lines FROM documents))"""
SIGNATURES_SQL = f"WITH {SIGNATURE_VIEW}\nSELECT 'doc_' || doc_id || '.err' AS log, signature FROM signatures"


def log_errors(t: Tables) -> DataFrame:
    return G.error_counts(t.logs, body="err")


ERRORS_SQL = "SELECT CASE WHEN lang = 'en' THEN '' ELSE 'Err_' || source END AS category, count(*) AS n FROM documents GROUP BY 1"


def request_names(t: Tables) -> DataFrame:
    """Turns as submit logs; an assistant's turn never got its name line."""
    name = F.when(F.col("role") != "assistant", F.concat(F.lit("\nTask name:  "), "role", F.lit("_"), F.col("conv_id").cast("string"), F.lit(" \n")))
    body = F.concat("text", F.lit("\nSuccess: sent"), F.coalesce(name, F.lit("\n\nTask name: late")))
    return t.conversations.select("conv_id", "turn", G.request_name(body).alias("request"))


REQUESTS_SQL = "SELECT conv_id, turn, CASE WHEN role <> 'assistant' THEN role || '_' || conv_id END AS request FROM conversations"


def zeroed_times(t: Tables) -> DataFrame:
    return T.zeroed_time(t.samples).select("log", "row_no", F.round("x", 5).alias("x"))


ZEROED_SQL = with_views(
    "samples", "SELECT log, row_no, round(epoch - first_value(epoch) OVER (PARTITION BY log ORDER BY row_no), 5) AS x FROM samples"
)


def flat_metric(t: Tables) -> DataFrame:
    return T.flatten_metric(t.telemetry, "usr")


def metric_mean(t: Tables) -> DataFrame:
    return T.mean(T.flatten_metric(t.telemetry, "usr"), "value").select(F.round("mean", 6).alias("mean"))


def metric_pairs(t: Tables) -> DataFrame:
    return T.pair_metrics(t.telemetry, "epoch", "usr").select("log", "row_no", F.round("x", 5).alias("x"), "y")


PAIRS_SQL = with_views(
    "samples", "SELECT log, row_no, round(epoch - first_value(epoch) OVER (PARTITION BY log ORDER BY row_no), 5) AS x, usr AS y FROM samples"
)


def _bin(v: str, lo: str, hi: str, bins: int) -> str:
    guess = f"least(floor(({v} - {lo}) / ({hi} - {lo}) * {bins}), {bins - 1})"
    width = f"(({hi} - {lo}) / {bins})"
    return f"""CAST(CASE WHEN {v} < {lo} + {guess} * {width} THEN {guess} - 1
  WHEN {guess} < {bins - 1} AND {v} >= {lo} + ({guess} + 1) * {width} THEN {guess} + 1 ELSE {guess} END AS BIGINT)"""


def hist_1d(t: Tables) -> DataFrame:
    return T.hist_1d(t.samples, "usr", 40)


HIST1_SQL = with_views(
    "samples", f"SELECT {_bin('usr', 'lo', 'hi', 40)} AS bin, count(*) AS n FROM samples, (SELECT min(usr) AS lo, max(usr) AS hi FROM samples) GROUP BY 1"
)


def hist_2d(t: Tables) -> DataFrame:
    return T.hist_2d(t.samples, "sys", "usr", 10, keys=["dataset"], scale_y=0.125)


HIST2_SQL = with_views(
    "samples",
    f"""SELECT dataset, {_bin('x', 'lx', 'hx', 10)} AS xbin, {_bin('y', 'ly', 'hy', 10)} AS ybin, count(*) AS n
FROM points JOIN (SELECT dataset, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM points GROUP BY 1) USING (dataset) GROUP BY 1, 2, 3""",
    more="""points AS (SELECT dataset, sys / greatest(max(sys) OVER (PARTITION BY dataset), CAST(1 AS DOUBLE)) AS x, usr * CAST(0.125 AS DOUBLE) AS y FROM samples)""",
)


def profile(t: Tables) -> DataFrame:
    got = T.profile(t.samples, "sys", "usr", 12, norm_x=True)
    return got.select("bin", F.round("centre", 6).alias("centre"), "n", F.round("mean", 5).alias("mean"), F.round("spread", 5).alias("spread"))


PROFILE_SQL = with_views(
    "samples",
    f"""SELECT bin, round(lo + (bin + 0.5) * ((hi - lo) / 12), 6) AS centre, count(*) AS n, round(avg(y), 5) AS mean, round(stddev_pop(y), 5) AS spread
FROM (SELECT y, lo, hi, {_bin('x', 'lo', 'hi', 12)} AS bin FROM points, (SELECT min(x) AS lo, max(x) AS hi FROM points)) GROUP BY bin, lo, hi""",
    more="points AS (SELECT sys / CAST(max(sys) OVER () AS DOUBLE) AS x, usr AS y FROM samples)",
)


def panel_hists(t: Tables) -> DataFrame:
    """The parsed telemetry is a table: ranges and bins both read it, the logs are parsed once."""
    parsed = G.telemetry(t.logs, keep=["dataset"]).select("dataset", "metric", "value", "since_start")
    return T.panel_hists(write_and_read(parsed, "telemetry"), bins=50)


_POINTS = """points AS (SELECT dataset, metric, since_start / greatest(max(CAST(since_start AS DOUBLE)) OVER (PARTITION BY dataset, metric), CAST(1 AS DOUBLE)) AS x,
  value * CASE WHEN metric IN ('used', 'buff') THEN 1e-9 WHEN metric IN ('send', 'recv') THEN 1e-6 WHEN metric IN ('read', 'writ') THEN 0.125e-6 ELSE 1e0 END AS y
  FROM {cells} WHERE metric NOT IN ('date/time', 'epoch')),
boxes AS (SELECT dataset, metric, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lx, CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hx,
  CASE WHEN min(y) = max(y) THEN min(y) - 0.5 ELSE min(y) END AS ly, CASE WHEN min(y) = max(y) THEN max(y) + 0.5 ELSE max(y) END AS hy FROM points GROUP BY 1, 2)"""
_PANELS = f"""SELECT dataset, metric, {_bin('x', 'lx', 'hx', 50)} AS xbin, {_bin('y', 'ly', 'hy', 50)} AS ybin, count(*) AS n
FROM points JOIN boxes USING (dataset, metric) GROUP BY 1, 2, 3, 4"""
PANELS_SQL = with_views("doc_lines", _PANELS, more=CELLS + ",\n" + _POINTS.format(cells="cells"))


def failed_panels(t: Tables) -> DataFrame:
    """Panels over the logs of failed attempts only; documents are the logs of the clusters with their number."""
    outs = M.with_done(summary_rows(t, t.stored_attempts))
    failed = T.failed_attempts(t.stored_attempts, outs).select("dataset", "cluster_id")
    logs = t.logs.select(F.regexp_extract("log", "([0-9]+)", 1).cast("bigint").alias("cluster_id"), "log", "body")
    asked = logs.join(failed, "cluster_id")  # by the number in the name, before a text is looked into
    parsed = G.telemetry(asked, keep=["dataset"]).select("dataset", "metric", "value", "since_start")
    return T.panel_hists(write_and_read(parsed, "telemetry"), bins=50)


FAILED_PANELS_SQL = with_views(
    "doc_lines summary",
    _PANELS,
    more=CELLS
    + """,
failed AS (SELECT a.dataset, a.cluster_id FROM attempts a JOIN last_attempt l USING (dataset, out_index)
  JOIN summary s USING (dataset, out_index) WHERE a.attempt_no < l.last_no AND NOT (s.output_exists AND NOT s.is_on_queue)),
asked AS (SELECT f.dataset, metric, value, since_start FROM cells JOIN failed f ON log = 'doc_' || f.cluster_id || '.out'),
"""
    + _POINTS.format(cells="asked"),
)

QUERIES = {
    "log_headers": (log_headers, HEADERS_SQL),
    "log_telemetry": (log_telemetry, TELEMETRY_SQL),
    "telemetry_columns": (telemetry_columns, COLUMNS_SQL),
    "log_telemetry_legacy": (log_telemetry_legacy, LEGACY_SQL),
    "log_validity": (log_validity, VALIDITY_SQL),
    "log_signatures": (log_signatures, SIGNATURES_SQL),
    "log_errors": (log_errors, ERRORS_SQL),
    "request_names": (request_names, REQUESTS_SQL),
    "zeroed_times": (zeroed_times, ZEROED_SQL),
    "flat_metric": (flat_metric, with_views("samples", "SELECT log, row_no, usr AS value FROM samples")),
    "metric_mean": (metric_mean, with_views("samples", "SELECT round(avg(usr), 6) AS mean FROM samples")),
    "metric_pairs": (metric_pairs, PAIRS_SQL),
    "hist_1d": (hist_1d, HIST1_SQL),
    "hist_2d": (hist_2d, HIST2_SQL),
    "profile": (profile, PROFILE_SQL),
    "panel_hists": (panel_hists, PANELS_SQL),
    "failed_panels": (failed_panels, FAILED_PANELS_SQL),
}
