"""Ledger and event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchtally.operators import chunking as C
from batchtally.operators import events as E
from batchtally.operators import ledger as L
from batchtally.operators import telemetry as T
from batchtally.plans.storage import write_and_read
from batchtally.sources.queue import queue_snapshot as snapshot
from batchtally.sources.queue import typed_queue
from batchtally.workload.tables import NOW, QUEUE_EXTRA, SETTLED, Tables, ntz, with_views


def _ledger(t: Tables) -> DataFrame:
    return L.with_queue(L.with_existence(t.outputs, t.listing), t.queue)


LEDGER = """ledger AS (SELECT m.dataset, m.seq AS out_index, m.nevents, m.listed OR m.fake AS "exists", q.jobnum IS NOT NULL AS on_queue,
  (m.listed OR m.fake) AND q.jobnum IS NULL AS done, q.status, abs(CAST({now} AS BIGINT) - q.entered) / 3600.0 AS hours
  FROM manifest m LEFT JOIN queue q ON q.task = m.dataset AND q.jobnum = m.seq)""".format(now=NOW)


def with_ledger(body: str) -> str:
    return with_views("manifest queue", body, more=LEDGER)


def queue_snapshot(t: Tables) -> DataFrame:
    """The jobs of all orders, also those the ledger does not know."""
    return typed_queue(snapshot(t.queue_text, extra=QUEUE_EXTRA))


def job_actions(t: Tables) -> DataFrame:
    rows = L.job_actions(_ledger(t), NOW)
    return rows.select("dataset", "out_index", "done", "state", F.round("hours", 4).alias("hours"), "action", "reason")


ACTIONS_SQL = with_ledger(
    """SELECT dataset, out_index, done, CASE WHEN on_queue THEN status END AS state, round(CAST(hours AS DOUBLE), 4) AS hours,
  CASE WHEN done THEN 'none' WHEN NOT on_queue THEN 'submit' WHEN status = 'R' AND hours > 24 THEN 'remove'
    WHEN status = 'H' AND hours > 5 THEN 'remove' ELSE 'wait' END AS action,
  CASE WHEN done OR NOT on_queue THEN NULL WHEN status = 'R' AND hours > 24 THEN 'running' WHEN status = 'H' AND hours > 5 THEN 'held' END AS reason
FROM ledger"""
)


def completion(t: Tables) -> DataFrame:
    """Per dataset, with the region names as units that have no outputs."""
    units = t.datasets.select("dataset").unionByName(t.region.select(F.col("r_name").alias("dataset")))
    got = L.completion(_ledger(t), units, min_fraction=0.35)
    rounded = [F.round(c, 6).alias(c) if c.endswith("fraction") else F.col(c) for c in got.columns]
    return got.select(*rounded)


COMPLETION_SQL = with_ledger(
    """SELECT u.dataset, round(coalesce(avg(CAST(done AS INTEGER)), 0.0), 6) AS queue_fraction, coalesce(avg(CAST(done AS INTEGER)), 0.0) >= 0.35 AS queue_complete,
  round(coalesce(avg(CAST("exists" AS INTEGER)), 1.0), 6) AS base_fraction, coalesce(bool_and("exists"), true) AS base_complete,
  round(avg(CAST("exists" AS INTEGER)), 6) AS move_fraction, avg(CAST("exists" AS INTEGER)) >= 0.35 AS move_complete
FROM (SELECT DISTINCT o_orderpriority AS dataset FROM orders UNION ALL SELECT r_name FROM region) u LEFT JOIN ledger l ON l.dataset = u.dataset
GROUP BY u.dataset"""
)


def completed_outputs(t: Tables) -> DataFrame:
    return L.completed_outputs(_ledger(t), "done").select("dataset", "out_index", "nevents")


def pending_rows(t: Tables) -> DataFrame:
    outs = t.orders.select(F.col("o_custkey").alias("map_id"), (F.col("o_orderstatus") != "P").alias("exists"))
    return L.mapping_rows_done(outs)


def _complete(t: Tables) -> DataFrame:
    return L.completion(t.task_outputs.withColumn("done", F.col("exists")), t.tasks, key="task").select(
        "task", F.col("base_complete").alias("complete")
    )


def readiness(t: Tables) -> DataFrame:
    chain = L.chain_requirements(t.tasks)
    ready = L.readiness(t.tasks, chain, _complete(t))
    return chain.join(ready, "task").select("path", "task", "requires", "complete", "satisfied", "ready")


READINESS_SQL = with_views(
    "chain task_state",
    """SELECT CAST(c.path AS VARCHAR) AS path, c.task, c.requires, s.complete, coalesce(r.complete, c.requires IS NULL) AS satisfied,
  coalesce(r.complete, c.requires IS NULL) AND NOT s.complete AS ready
FROM chain c JOIN task_state s ON s.task = c.task LEFT JOIN task_state r ON r.task = c.requires""",
)


def path_status(t: Tables) -> DataFrame:
    return L.path_status(t.tasks, _complete(t))


PATH_SQL = with_views(
    "chain task_state",
    """SELECT CAST(path AS VARCHAR) AS path, arg_max(complete, position) AS complete, count(*) AS n_tasks, count(*) FILTER (WHERE complete) AS n_complete
FROM chain JOIN task_state USING (task) GROUP BY path""",
)


def complete_list(t: Tables) -> DataFrame:
    return L.complete_list(t.tasks, _complete(t))


LIST_SQL = with_views(
    "chain task_state",
    """SELECT CAST(path AS VARCHAR) AS path, row_number() OVER (PARTITION BY path ORDER BY position) AS pos, task, complete
FROM chain JOIN task_state USING (task)""",
)


def attempts_after_submit(t: Tables) -> DataFrame:
    """Every output whose action is to submit gets one more attempt."""
    todo = L.job_actions(_ledger(t), NOW).filter("action = 'submit'")
    submitted = todo.select("dataset", "out_index", (F.col("out_index") * 10 + 9).alias("cluster_id"))
    return L.append_attempts(t.stored_attempts, submitted)


APPEND_SQL = with_views(
    "manifest queue attempts last_attempt",
    """SELECT dataset, out_index, attempt_no, cluster_id FROM attempts
UNION ALL SELECT dataset, out_index, CAST(coalesce(last_no, 0) + 1 AS INTEGER), out_index * 10 + 9
FROM ledger LEFT JOIN last_attempt USING (dataset, out_index) WHERE NOT done AND NOT on_queue""",
    more=LEDGER,
)


def summary_rows(t: Tables, attempts: DataFrame | None = None) -> DataFrame:
    """Task summary rows the rollups read, with done decided by cluster id."""
    outs = L.with_existence(t.outputs, t.listing).select("dataset", "out_index", "nevents", "neg", F.col("exists").alias("output_exists"))
    return L.task_summary(outs, attempts if attempts is not None else t.attempts, t.queue)


def task_summary(t: Tables) -> DataFrame:
    """Outputs that were never attempted have no logs."""
    tried = F.when(F.col("n_attempts") > 0, F.col("last_cluster"))
    rows = L.attempt_logs(summary_rows(t).withColumn("cluster_id", tried), F.lit("/logs"))
    return rows.select(
        "dataset", "out_index", "output_exists", "last_cluster", "n_attempts", "is_on_queue", "job_status", "job_entered", "job_hold_reason", "log_err", "log_out"
    )


SUMMARY_SQL = with_views(
    "summary",
    """SELECT s.dataset, s.out_index, s.output_exists, s.last_cluster, s.n_attempts, s.is_on_queue, s.job_status, s.job_entered, s.job_hold_reason,
  '/logs/1e.' || a.last_cluster || '.0.err' AS log_err, '/logs/1e.' || a.last_cluster || '.0.out' AS log_out
FROM summary s LEFT JOIN last_attempt a USING (dataset, out_index)""",
)


def attempt_log_paths(t: Tables) -> DataFrame:
    """Both logs of every attempt, not only of the last one."""
    return L.attempt_logs(t.attempts, F.lit("/logs")).select("dataset", "out_index", "attempt_no", "log_err", "log_out")


ATTEMPT_LOGS_SQL = with_views(
    "attempts",
    """SELECT dataset, out_index, attempt_no, '/logs/1e.' || cluster_id || '.0.err' AS log_err, '/logs/1e.' || cluster_id || '.0.out' AS log_out FROM attempts""",
)


def queried_events(t: Tables) -> DataFrame:
    per = t.manifest.groupBy("dataset").agg(
        F.sum("nevents").alias("live_nevents"),
        F.sum(F.when(F.col("o_orderdate") < ntz(SETTLED), F.col("nevents"))).alias("cached_nevents"),
    )
    return L.queried_events(per.withColumn("open", F.col("dataset") < "3"))


QUERIED_SQL = with_views(
    "manifest",
    f"""SELECT *, CASE WHEN open THEN live_nevents ELSE cached_nevents END AS queried_nevents FROM (
  SELECT dataset, CAST(sum(nevents) AS BIGINT) AS live_nevents, CAST(sum(nevents) FILTER (WHERE o_orderdate < TIMESTAMP '{SETTLED}') AS BIGINT) AS cached_nevents,
    dataset < '3' AS open FROM manifest GROUP BY 1)""",
)


def status_names(t: Tables) -> DataFrame:
    codes = t.orders.groupBy(F.month("o_orderdate").cast("bigint").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return L.with_status_name(codes)


STATUS_SQL = """SELECT month(o_orderdate) AS code, count(*) AS n, label FROM orders LEFT JOIN (VALUES (1, 'DONE'), (2, 'PARTIAL_DONE'), (3, 'FAIL'), (4, 'SUCCESS'),
  (5, 'VALID'), (6, 'INVALID'), (7, 'RUNNING'), (8, 'IDLE'), (9, 'HELD'), (10, 'SUBMITTED'), (11, 'FAKE')) v(c, label) ON c = month(o_orderdate)
GROUP BY 1, 3"""


def event_counts(t: Tables) -> DataFrame:
    return E.event_counts(t.events_of_files)


COUNTS_SQL = """SELECT 'file_' || l_orderkey || '.root' AS file, count(*) AS n, count(*) FILTER (WHERE l_discount - 0.05 < 0) AS n_negative,
  count(*) FILTER (WHERE NOT l_discount - 0.05 > 0) AS n_nonpositive FROM lineitem GROUP BY l_orderkey"""


def stored_counts(t: Tables) -> DataFrame:
    """Old files carry a stored total, fake ones a stored negative count."""
    stored = t.manifest.select(
        F.col("name").alias("file"),
        F.when(F.col("o_orderdate") < ntz(SETTLED), F.col("nevents") + 1000).alias("n"),
        F.when(F.col("fake"), F.lit(0)).cast("bigint").alias("n_negative"),
    )
    unread = E.lacking_counts(stored)
    return E.prefer_stored(stored, E.event_counts(t.events_of_files.join(unread, "file", "left_semi")))


STORED_SQL = with_views(
    "manifest",
    f"""SELECT name AS file, CASE WHEN o_orderdate < TIMESTAMP '{SETTLED}' THEN nevents + 1000 ELSE coalesce(c, 0) END AS n,
  CASE WHEN fake THEN 0 ELSE coalesce(k, 0) END AS n_negative,
  CASE WHEN o_orderdate >= TIMESTAMP '{SETTLED}' OR NOT fake THEN coalesce(p, 0) END AS n_nonpositive
FROM manifest LEFT JOIN (SELECT l_orderkey, count(*) AS c, count(*) FILTER (WHERE l_discount - 0.05 < 0) AS k,
  count(*) FILTER (WHERE NOT l_discount - 0.05 > 0) AS p FROM lineitem GROUP BY 1) r ON r.l_orderkey = seq""",
)


def negative_events(t: Tables) -> DataFrame:
    """Files of the newest orders are data by name."""
    prefix = F.when(F.col("o_orderdate") >= ntz("2001-01-01"), "Run2017_").otherwise("")
    m = t.manifest.withColumn("name", F.concat(prefix, "name")).withColumn("nevents_negative", F.when(F.col("fake"), F.lit(7)))
    names = E.needs_scan(m).select(F.col("name").alias("file"))
    counts = E.event_counts(t.events_of_files.join(names, "file", "left_semi"))
    return E.negative_events(m, counts).select("dataset", "name", "neg")


NEGATIVE_SQL = with_views(
    "manifest",
    """SELECT dataset, CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01' THEN 'Run2017_' ELSE '' END || name AS name,
  CASE WHEN fake THEN 7 WHEN o_orderdate >= TIMESTAMP '2001-01-01' THEN 0 ELSE coalesce(k, 0) END AS neg
FROM manifest LEFT JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_discount - 0.05 < 0) AS k FROM lineitem GROUP BY 1) c ON c.l_orderkey = seq""",
)


def effective_counts(t: Tables) -> DataFrame:
    live = t.manifest.groupBy("dataset").agg(F.sum("nevents").alias("live_nevents")).withColumn("open", F.col("dataset") < "3")
    return E.dataset_metadata(_ledger(t), live)


EFFECTIVE_SQL = with_ledger(
    """SELECT m.dataset, CAST(sum(m.nevents) AS BIGINT) AS live_nevents, m.dataset < '3' AS open, count(*) FILTER (WHERE done) AS n_outputs,
  CAST(sum(m.nevents) FILTER (WHERE done) AS BIGINT) AS nevents_merged, CAST(sum(m.nevents - 2 * nevents_negative) FILTER (WHERE done) AS BIGINT) AS nevents_effective,
  CAST(CASE WHEN m.dataset < '3' THEN sum(m.nevents) ELSE sum(m.nevents) FILTER (WHERE done) END AS BIGINT) AS nevents_das
FROM manifest m JOIN ledger l ON l.dataset = m.dataset AND l.out_index = m.seq GROUP BY m.dataset"""
)


META_FILES, META_PART = 50, 20  # files of an output, outputs of a part


def metadata_documents(t: Tables) -> DataFrame:
    """Outputs of fifty files each are done when all their files are listed."""
    files = t.manifest.select("dataset", "seq", "name", "nevents", "nevents_negative", (F.col("listed") | (F.col("seq") % 7 > 0)).alias("listed"))
    none = t.spark.createDataFrame([], "dataset string, last_index bigint")
    plan = C.plan_files(files.select("dataset", "seq", "name", "nevents"), none, t.datasets, C.ChunkRule(files=META_FILES), census=t.census)
    mapping = write_and_read(plan.select("dataset", "out_index", F.col("seq").alias("in_seq"), F.col("name").alias("in_name")), "mapping")
    facts = files.select("dataset", F.col("name").alias("in_name"), "nevents", "nevents_negative", "listed")
    outputs = mapping.join(facts, ["dataset", "in_name"]).groupBy("dataset", "out_index").agg(
        F.sum("nevents").alias("nevents"), F.sum("nevents_negative").alias("neg"), F.bool_and("listed").alias("done")
    )
    live = files.groupBy("dataset").agg(F.sum("nevents").alias("live_nevents")).select(
        "dataset", "live_nevents", (F.col("dataset") < "3").alias("open"), F.lit("v1").alias("tag"), F.lit("g1").alias("gtag"),
        F.concat(F.lit("/out/"), "dataset").alias("finaldir"), F.lit("p.py").alias("pset"), F.lit(1.5).alias("xsec"), F.lit(1.0).alias("kfact"), F.lit(0.5).alias("efact"),
    )
    docs = E.metadata_documents(write_and_read(outputs, "outputs"), mapping, live, per_part=META_PART)
    return docs.withColumn("document", F.to_json(F.struct("ijob_to_miniaod", "ijob_to_nevents"))).drop("ijob_to_miniaod", "ijob_to_nevents")


METADATA_DOCUMENTS_SQL = with_views(
    "manifest",
    f"""SELECT d.dataset, live_nevents, d.dataset < '3' AS open, 'v1' AS tag, 'g1' AS gtag, '/out/' || d.dataset AS finaldir, 'p.py' AS pset, 1.5e0 AS xsec, 1e0 AS kfact, 0.5e0 AS efact,
  coalesce(n_outputs, 0) AS n_outputs, coalesce(merged, 0) AS nevents_merged, coalesce(eff, 0) AS nevents_effective,
  CASE WHEN d.dataset < '3' THEN live_nevents ELSE coalesce(merged, 0) END AS nevents_das, coalesce(part, 0) AS part,
  '{{"ijob_to_miniaod":{{' || coalesce(names, '') || '}},"ijob_to_nevents":{{' || coalesce(counts, '') || '}}}}' AS document
FROM (SELECT dataset, CAST(sum(nevents) AS BIGINT) AS live_nevents FROM manifest GROUP BY 1) d
LEFT JOIN (SELECT dataset, count(*) AS n_outputs, CAST(sum(n) AS BIGINT) AS merged, CAST(sum(e) AS BIGINT) AS eff FROM outs GROUP BY 1) s ON s.dataset = d.dataset
LEFT JOIN (SELECT dataset, (out_index - 1) // {META_PART} AS part, string_agg('"' || out_index || '":["' || names || '"]', ',' ORDER BY out_index) AS names,
  string_agg('"' || out_index || '":[' || n || ',' || e || ']', ',' ORDER BY out_index) AS counts FROM outs GROUP BY 1, 2) p ON p.dataset = d.dataset""",
    more=f"""placed AS (SELECT dataset, seq, name, nevents, nevents_negative, listed OR seq % 7 > 0 AS listed,
  (row_number() OVER (PARTITION BY dataset ORDER BY seq, name) - 1) // {META_FILES} + 1 AS out_index FROM manifest),
outs AS (SELECT dataset, out_index, CAST(sum(nevents) AS BIGINT) AS n, CAST(sum(nevents - 2 * nevents_negative) AS BIGINT) AS e,
  string_agg(name, '","' ORDER BY seq) AS names FROM placed GROUP BY 1, 2 HAVING bool_and(listed))""",
)


def output_metadata(t: Tables) -> DataFrame:
    return E.output_metadata(_ledger(t), is_tree=False)


OUTPUT_META_SQL = with_ledger("SELECT dataset, out_index, nevents AS n, -nevents AS effective FROM ledger WHERE done")


def skim(t: Tables) -> DataFrame:
    kept = E.skim(
        t.embeddings,
        [E.count_matching("embedding", lambda x: x > 0.2) >= 2, E.count_matching("embedding", lambda x: x < -0.25) <= 1],
        ["vec_id", "label"],
    )
    return kept


SKIM_SQL = """SELECT vec_id, label FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.2)) >= 2 AND len(list_filter(embedding, lambda x: x < -0.25)) <= 1"""


def skim_rows(t: Tables) -> DataFrame:
    big, cheap = F.col("l_quantity") > 25, F.col("l_discount") > 0.07
    return E.skim_rows(t.lineitem, ["l_orderkey"], {"n_big": (big, 1, None), "n_cheap": (cheap, None, 1)})


SKIM_ROWS_SQL = """SELECT l_orderkey, count(*) AS n_elements, count(*) FILTER (WHERE l_quantity > 25) AS n_big, count(*) FILTER (WHERE l_discount > 0.07) AS n_cheap
FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_quantity > 25) >= 1 AND count(*) FILTER (WHERE l_discount > 0.07) <= 1"""


def event_slice(t: Tables) -> DataFrame:
    ev = t.events.select("event_type", "ts", "event_id")
    return E.event_slice(ev, ["event_type"], ["ts", "event_id"], 101, 500).select("event_type", "event_id", "pos")


SLICE_SQL = """SELECT * FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos FROM events) WHERE pos BETWEEN 101 AND 600"""


def events_in_ranges(t: Tables) -> DataFrame:
    ev = t.events.select("event_type", "ts", "event_id")
    return E.event_ranges_of(ev, ["event_type"], ["ts", "event_id"], 100).groupBy("event_type", "range_no").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("min_id"), F.max("event_id").alias("max_id")
    )


IN_RANGES_SQL = """SELECT event_type, (pos - 1) // 100 + 1 AS range_no, count(*) AS n, min(event_id) AS min_id, max(event_id) AS max_id
FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY event_type) AS total FROM events)
WHERE (pos - 1) // 100 < total // 100 GROUP BY 1, 2"""


def rejects_resubmit(t: Tables) -> DataFrame:
    """An output with a broken record no longer exists and is planned again."""
    records = t.lineitem.select(F.col("l_orderkey").alias("out_index"), ((F.col("l_tax") >= 0.08) & (F.col("l_quantity") >= 50)).alias("broken"))
    bad = E.bad_outputs(records, ["out_index"], F.col("broken")).withColumn("reason", F.lit("bad record"))
    outs = L.with_existence(t.outputs, t.listing)
    return L.job_actions(L.with_queue(E.drop_rejected(outs, bad, ["out_index"]), t.queue).drop("reason"), NOW).select(
        "dataset", "out_index", "exists", "action"
    )


REJECTS_SQL = with_ledger(
    """SELECT dataset, out_index, "exists" AND b.k IS NULL AS "exists", CASE WHEN "exists" AND b.k IS NULL AND NOT on_queue THEN 'none' WHEN NOT on_queue THEN 'submit'
  WHEN status = 'R' AND hours > 24 THEN 'remove' WHEN status = 'H' AND hours > 5 THEN 'remove' ELSE 'wait' END AS action
FROM ledger LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_tax >= 0.08 AND l_quantity >= 50) b ON b.k = out_index"""
)


def missing_files(t: Tables) -> DataFrame:
    read = t.lineitem.select(F.concat(F.lit("file_"), F.col("l_orderkey").cast("string"), F.lit(".root")).alias("name"))
    files = t.orders.select(
        F.col("o_orderpriority").alias("dataset"), F.concat(F.lit("file_"), F.col("o_orderkey").cast("string"), F.lit(".root")).alias("name")
    )
    return E.missing_files(files, read)


MISSING_SQL = """SELECT o_orderpriority AS dataset, 'file_' || o_orderkey || '.root' AS name FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""


def failed_attempts(t: Tables) -> DataFrame:
    outs = summary_rows(t, t.stored_attempts).withColumn("done", F.col("output_exists") & ~F.col("is_on_queue"))
    return T.failed_attempts(t.stored_attempts, outs)


FAILED_SQL = with_views(
    "summary",
    """SELECT a.dataset, a.out_index, a.attempt_no, a.cluster_id FROM attempts a JOIN last_attempt l USING (dataset, out_index)
JOIN summary s USING (dataset, out_index) WHERE a.attempt_no < l.last_no AND NOT (s.output_exists AND NOT s.is_on_queue)""",
)

QUERIES = {
    "queue_snapshot": (queue_snapshot, with_views("all_jobs", "SELECT * EXCLUDE (o_orderdate), 'held by policy' AS hold_reason FROM all_jobs")),
    "job_actions": (job_actions, ACTIONS_SQL),
    "completion": (completion, COMPLETION_SQL),
    "completed_outputs": (completed_outputs, with_ledger("SELECT dataset, out_index, nevents FROM ledger WHERE done")),
    "pending_rows": (
        pending_rows,
        "SELECT o_custkey AS map_id, bool_and(o_orderstatus <> 'P') AS all_done, NOT bool_and(o_orderstatus <> 'P') AS pending FROM orders GROUP BY 1",
    ),
    "readiness": (readiness, READINESS_SQL),
    "path_status": (path_status, PATH_SQL),
    "complete_list": (complete_list, LIST_SQL),
    "attempts_after_submit": (attempts_after_submit, APPEND_SQL),
    "task_summary": (task_summary, SUMMARY_SQL),
    "attempt_log_paths": (attempt_log_paths, ATTEMPT_LOGS_SQL),
    "queried_events": (queried_events, QUERIED_SQL),
    "status_names": (status_names, STATUS_SQL),
    "event_counts": (event_counts, COUNTS_SQL),
    "stored_counts": (stored_counts, STORED_SQL),
    "negative_events": (negative_events, NEGATIVE_SQL),
    "effective_counts": (effective_counts, EFFECTIVE_SQL),
    "output_metadata": (output_metadata, OUTPUT_META_SQL),
    "metadata_documents": (metadata_documents, METADATA_DOCUMENTS_SQL),
    "skim": (skim, SKIM_SQL),
    "skim_rows": (skim_rows, SKIM_ROWS_SQL),
    "event_slice": (event_slice, SLICE_SQL),
    "events_in_ranges": (events_in_ranges, IN_RANGES_SQL),
    "rejects_resubmit": (rejects_resubmit, REJECTS_SQL),
    "missing_files": (missing_files, MISSING_SQL),
    "failed_attempts": (failed_attempts, FAILED_SQL),
}
