"""Operator inputs derived from the test tables, as DataFrames and as SQL views."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchtally.functions.values import epoch_micros
from batchtally.plans.storage import write_and_read
from batchtally.sources.queue import queue_snapshot, typed_queue

NOW = 1_600_000_000
RECENT = "1999-01-01"  # jobs of later orders are those that the ledger knows
QUEUE_EXTRA = ["taskname", "jobnum", "batch"]
SETTLED = "1996-01-01"  # files of earlier orders are mapped already

CLOCK = "23-02 17:05:31"  # clock-like cell of the logs


def ntz(day: str) -> Column:
    return F.lit(f"{day} 00:00:00").cast("timestamp_ntz")


class Tables:
    """Reads a test table by attribute, and builds the derived inputs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def file_counts(self) -> DataFrame:
        return self.lineitem.groupBy("l_orderkey").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") < 0.05).alias("neg")
        )

    @cached_property
    def census(self) -> DataFrame:
        """Dataset of every file, without the counts; enough to size the groups."""
        return self.orders.select(F.col("o_orderpriority").alias("dataset"))

    @cached_property
    def manifest(self) -> DataFrame:
        """Orders as files of priority datasets, line items as their events."""
        return self.orders.join(self.file_counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
            F.col("o_orderpriority").alias("dataset"),
            F.col("o_orderkey").alias("seq"),
            F.concat(F.lit("file_"), F.col("o_orderkey").cast("string"), F.lit(".root")).alias("name"),
            F.coalesce("n", F.lit(0)).alias("nevents"),
            F.coalesce("neg", F.lit(0)).alias("nevents_negative"),
            (F.col("o_totalprice") / 1e6).alias("size_gb"),
            (F.col("o_totalprice") > 450000).alias("fake"),
            (F.col("o_orderstatus") == "F").alias("listed"),
            "o_orderdate",
        )

    @cached_property
    def datasets(self) -> DataFrame:
        return self.orders.groupBy(F.col("o_orderpriority").alias("dataset")).agg(
            F.lit(False).alias("open"), F.lit("/out").alias("output_dir")
        )

    @cached_property
    def events_of_files(self) -> DataFrame:
        return self.lineitem.select(
            F.concat(F.lit("file_"), F.col("l_orderkey").cast("string"), F.lit(".root")).alias("file"),
            F.col("l_linenumber").alias("event_no"),
            (F.col("l_discount") - 0.05).alias("weight"),
        )

    @cached_property
    def outputs(self) -> DataFrame:
        return self.manifest.select(
            "dataset",
            F.col("dataset").alias("task"),
            F.col("seq").alias("out_index"),
            "name",
            "nevents",
            F.col("nevents_negative").alias("neg"),
            "fake",
        )

    @cached_property
    def listing(self) -> DataFrame:
        return self.manifest.filter("listed").select("name")

    @cached_property
    def queue_text(self) -> DataFrame:
        """A job of every order as tab-separated text; cheap orders lack a field, old ones belong to another batch."""
        fields = [
            (F.col("o_orderkey") * 10 + 5).cast("string"),
            (F.month("o_orderdate") - 1).cast("string"),
            (F.lit(NOW) - F.dayofmonth("o_orderdate") * 3600).cast("string"),
            F.lit("run.sh"),
            F.when(F.col("o_totalprice") >= 20000, F.lit("args")),
            F.lit("x.out"),
            F.lit("x.err"),
            F.lit("held by policy"),
            F.col("o_orderpriority"),
            F.col("o_orderkey").cast("string"),
            F.when(F.col("o_orderdate") >= ntz(RECENT), F.lit("recent")).otherwise(F.lit("old")),
        ]
        return self.orders.select(F.concat_ws("\t", *fields).alias("value"))

    @cached_property
    def queue(self) -> DataFrame:
        return typed_queue(queue_snapshot(self.queue_text, extra=QUEUE_EXTRA, equals={"batch": "recent"}))

    @cached_property
    def attempts(self) -> DataFrame:
        """Distinct line numbers as submission attempts."""
        lines = self.lineitem.select("l_orderkey", "l_linenumber").distinct()
        return lines.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_orderpriority").alias("dataset"),
            F.col("o_orderkey").alias("out_index"),
            F.col("l_linenumber").alias("attempt_no"),
            (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("cluster_id"),
        )

    @cached_property
    def stored_attempts(self) -> DataFrame:
        """The attempts as a table of their own, for queries that read them more than once."""
        return write_and_read(self.attempts, "attempts")

    @cached_property
    def tasks(self) -> DataFrame:
        """Nations as tasks of region paths."""
        return self.nation.select(
            F.col("n_regionkey").cast("string").alias("path"),
            F.col("n_nationkey").alias("position"),
            F.col("n_name").alias("task"),
        )

    @cached_property
    def task_outputs(self) -> DataFrame:
        """Customers as outputs of their nation's task."""
        return self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("n_name").alias("task"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("exists")
        )

    @cached_property
    def catalog(self) -> DataFrame:
        return self.part.select(
            F.concat(F.lit("/"), F.col("p_brand"), F.lit("/"), F.col("p_type"), F.lit("/T")).alias("dataset"),
            F.when(F.col("p_size") <= 25, "CMS3").otherwise("BABY").alias("sample_type"),
            F.substring_index("p_name", " ", 1).alias("analysis"),
            F.substring_index("p_name", " ", -1).alias("tag"),
            F.concat(F.lit("g"), F.col("p_size").cast("string")).alias("gtag"),
            F.when(F.col("p_size").isin(1, 2, 3, 26, 27), "invalid").otherwise("valid").alias("status"),
            F.when(~F.col("p_name").startswith("red"), F.col("p_partkey")).alias("timestamp"),
            F.col("p_partkey").alias("id"),
        )

    @cached_property
    def samples(self) -> DataFrame:
        """Events as telemetry samples of one log per user."""
        return self.events.select(
            F.col("user_id").alias("log"),
            F.col("event_id").alias("row_no"),
            F.col("event_type").alias("dataset"),
            (epoch_micros("ts") / F.lit(1e6)).alias("epoch"),
            F.col("value").alias("usr"),
            F.get_json_object("props", "$.k").cast("bigint").alias("sys"),
        )

    @cached_property
    def telemetry(self) -> DataFrame:
        s = self.samples
        stack = "stack(3, 'epoch', epoch, 'usr', usr, 'sys', cast(sys as double)) as (metric, value)"
        return s.selectExpr("log", "row_no", stack)

    @cached_property
    def history(self) -> DataFrame:
        k = F.col("sys")
        busy = F.col("usr") > 10
        return self.samples.groupBy("dataset", (F.floor(F.col("epoch") / 300) * 300).cast("bigint").alias("ts")).agg(
            F.sum(k).alias("nevents_total"),
            F.sum(F.when(busy, k).otherwise(F.lit(0))).alias("nevents_done"),
            F.count(F.lit(1)).alias("njobs_total"),
            F.count_if(busy).alias("njobs_done"),
        )

    @cached_property
    def logs(self) -> DataFrame:
        """One job log per document: text lines in the header, one telemetry row per line."""
        lines = F.split("text", "\n")
        row = lambda x, i: F.concat_ws(
            ",",
            F.length(x).cast("string"),
            F.size(F.split(x, " ")).cast("string"),
            (F.lit(100) - i % 7).cast("string"),
            F.lit("1"),
            (i * 3).cast("string"),
            (i % 5).cast("string"),
            (i % 11).cast("string"),
            ((i + 1) * 1000).cast("string"),
            (i * i).cast("string"),
            F.lit(CLOCK),
            F.lit("7"),
            (F.lit(1500000000) + i * 45).cast("string"),
        )
        table = F.concat(
            F.lit('--- begin dstat output ---\n"Host:","host-'),
            F.col("lang"),
            F.lit('",,,"User:","u"\n"usr","sys","idl","read","writ","recv","send","used","buff","date/time","used","epoch"\n'),
            F.array_join(F.transform(lines, row), "\n"),
            F.lit("\n--- end dstat output ---\n"),
        )
        header = F.concat(
            F.lit("--- begin header output ---\nDOC: "),
            F.col("doc_id").cast("string"),
            F.lit("\nLANG: first\nLANG: "),
            F.col("lang"),
            F.lit("\n"),
            F.col("text"),
            F.lit("\n--- end header output ---\nLANG: outside\n"),
        )
        error = F.when(
            F.col("lang") != "en",
            F.concat(
                F.lit("start\n----- Begin Fatal Exception now -----\nAn exception of category 'Err_"),
                F.col("source"),
                F.lit("' occurred while\n"),
                F.col("text"),
                F.lit("\n----- End Fatal Exception -----\ndone\n"),
            ),
        ).otherwise(F.col("text"))
        return self.documents.select(
            F.col("lang").alias("dataset"),
            F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".out")).alias("log"),
            F.concat(header, table).alias("body"),
            error.alias("err"),
        )


VIEWS = {
    "counts": """SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_discount < 0.05) AS neg
        FROM lineitem GROUP BY l_orderkey""",
    "manifest": """SELECT o_orderpriority AS dataset, o_orderkey AS seq, 'file_' || o_orderkey || '.root' AS name,
        coalesce(n, 0) AS nevents, coalesce(neg, 0) AS nevents_negative, o_totalprice / 1e6 AS size_gb,
        o_totalprice > 450000 AS fake, o_orderstatus = 'F' AS listed, o_orderdate, o_totalprice
        FROM orders LEFT JOIN counts ON o_orderkey = l_orderkey""",
    "all_jobs": f"""SELECT dataset AS task, seq AS jobnum, seq * 10 + 5 AS cluster_id,
        CASE month(o_orderdate) - 1 WHEN 1 THEN 'I' WHEN 2 THEN 'R' WHEN 4 THEN 'C' WHEN 5 THEN 'H' WHEN 6 THEN 'E'
          ELSE 'U' END AS status, {NOW} - day(o_orderdate) * 3600 AS entered, o_orderdate
        FROM manifest WHERE month(o_orderdate) <> 4 AND o_totalprice >= 20000""",
    "queue": f"SELECT * EXCLUDE (o_orderdate) FROM all_jobs WHERE o_orderdate >= TIMESTAMP '{RECENT}'",
    "attempts": """SELECT o_orderpriority AS dataset, o_orderkey AS out_index, l_linenumber AS attempt_no,
        o_orderkey * 10 + l_linenumber AS cluster_id
        FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN orders ON l_orderkey = o_orderkey""",
    "last_attempt": """SELECT dataset, out_index, arg_max(cluster_id, attempt_no) AS last_cluster, count(*) AS n_attempts,
        max(attempt_no) AS last_no FROM attempts GROUP BY dataset, out_index""",
    "summary": """SELECT m.dataset, m.seq AS out_index, m.nevents, m.nevents_negative AS neg, m.listed OR m.fake AS output_exists,
        coalesce(a.last_cluster, -1) AS last_cluster, coalesce(a.n_attempts, 0) AS n_attempts, q.cluster_id IS NOT NULL AS is_on_queue,
        q.status AS job_status, q.entered AS job_entered, CASE WHEN q.cluster_id IS NOT NULL THEN 'held by policy' END AS job_hold_reason
        FROM manifest m LEFT JOIN last_attempt a ON a.dataset = m.dataset AND a.out_index = m.seq
        LEFT JOIN queue q ON q.cluster_id = a.last_cluster""",
    "rollup": """SELECT dataset, count(*) AS njobs_total, count(*) FILTER (WHERE output_exists AND NOT is_on_queue) AS njobs_done,
        CAST(sum(nevents) AS BIGINT) AS nevents_total,
        CAST(coalesce(sum(nevents) FILTER (WHERE output_exists AND NOT is_on_queue), 0) AS BIGINT) AS nevents_done
        FROM summary GROUP BY dataset""",
    "catalog": """SELECT '/' || p_brand || '/' || p_type || '/T' AS dataset, CASE WHEN p_size <= 25 THEN 'CMS3' ELSE 'BABY' END AS sample_type,
        split_part(p_name, ' ', 1) AS analysis, split_part(p_name, ' ', -1) AS tag, 'g' || p_size AS gtag,
        CASE WHEN p_size IN (1, 2, 3, 26, 27) THEN 'invalid' ELSE 'valid' END AS status,
        CASE WHEN NOT starts_with(p_name, 'red') THEN p_partkey END AS timestamp, p_partkey AS id FROM part""",
    "samples": """SELECT user_id AS log, event_id AS row_no, event_type AS dataset, epoch_us(ts) / 1e6 AS epoch, value AS usr,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS sys FROM events""",
    "history": """SELECT dataset, CAST(floor(epoch / 300) * 300 AS BIGINT) AS ts, CAST(sum(sys) AS BIGINT) AS nevents_total,
        CAST(coalesce(sum(sys) FILTER (WHERE usr > 10), 0) AS BIGINT) AS nevents_done, count(*) AS njobs_total,
        count(*) FILTER (WHERE usr > 10) AS njobs_done FROM samples GROUP BY 1, 2""",
    "chain": """SELECT n_regionkey AS path, n_nationkey AS position, n_name AS task,
        lag(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS requires FROM nation""",
    "task_state": """SELECT n_name AS task, coalesce(bool_and(c_acctbal > 0), true) AS complete
        FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""",
    "doc_lines": """SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents""",
}

# Views each view builds on.
NEEDS = {
    "manifest": ["counts"],
    "all_jobs": ["manifest"],
    "queue": ["all_jobs"],
    "last_attempt": ["attempts"],
    "summary": ["last_attempt", "queue"],
    "rollup": ["summary"],
    "history": ["samples"],
}


def with_views(names: str, body: str, more: str = "", recursive: bool = False) -> str:
    """SQL text with the named views, those they need, and ``more`` definitions in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for n in names.split():
        add(n)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order] + ([more] if more else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + f"\n{body}"
