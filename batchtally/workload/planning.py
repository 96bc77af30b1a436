"""Chunk planning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchtally.functions.paths import comma_join
from batchtally.operators import chunking as C
from batchtally.operators import events as E
from batchtally.operators.extend import ChunkAggregate, aggregate_chunks
from batchtally.plans.storage import fresh_path, write_and_read
from batchtally.sources.mapping import MappingTable
from batchtally.workload.tables import SETTLED, Tables, ntz, with_views

SPLIT_ROWS = 2000  # block size that cuts the datasets of the test tables
MERGED_FILES, MERGED_FOLDERS = 100, 4  # files of a merged output, folders of a dataset
CHUNK_COLUMNS = ["dataset", "chunk", "n_files", "n_events", "emitted"]


def _chunks(t: Tables, rule: C.ChunkRule, **options) -> DataFrame:
    files = t.manifest.select("dataset", "seq", "name", "nevents")
    assigned = C.assign_chunks(files, rule, census=t.census, **options)
    return C.chunk_table(assigned).select(*CHUNK_COLUMNS)


def chunk_by_files(t: Tables) -> DataFrame:
    return _chunks(t, C.ChunkRule(files=100))


def chunk_by_events(t: Tables) -> DataFrame:
    return _chunks(t, C.ChunkRule(events=100))


def chunk_by_events_split(t: Tables) -> DataFrame:
    """The same plan with every dataset cut into blocks, as a huge dataset would be."""
    return _chunks(t, C.ChunkRule(events=100), max_group_rows=SPLIT_ROWS)


def chunk_both_limits(t: Tables) -> DataFrame:
    return _chunks(t, C.ChunkRule(files=10, events=12))


def _greedy_sql(opens: str, held: str, after: str) -> str:
    return with_views(
        "manifest",
        """SELECT dataset, chunk, n_files, n_events, chunk < max(chunk) OVER (PARTITION BY dataset) {full} AS emitted
FROM (SELECT dataset, chunk, count(*) AS n_files, CAST(sum(nevents) AS BIGINT) AS n_events FROM walk GROUP BY 1, 2)""",
        more=f"""n AS (SELECT dataset, nevents, row_number() OVER (PARTITION BY dataset ORDER BY seq, name) AS rn FROM manifest),
walk AS (
  SELECT dataset, rn, nevents, CAST({held} AS BIGINT) AS held, CAST(0 AS BIGINT) AS chunk FROM n WHERE rn = 1
  UNION ALL
  SELECT n.dataset, n.rn, n.nevents, CAST(CASE WHEN {opens} THEN {after} ELSE w.held + {after} END AS BIGINT),
    CASE WHEN {opens} THEN w.chunk + 1 ELSE w.chunk END
  FROM walk w JOIN n ON n.dataset = w.dataset AND n.rn = w.rn + 1
)""",
        recursive=True,
    )


EVENTS_SQL = _greedy_sql("w.held + n.nevents > 100", "nevents", "n.nevents").format(full="")
BOTH_SQL = _greedy_sql("w.held >= 10 OR w.held + n.nevents > 12", "1", "1").format(full="OR n_files = 10")
FILES_SQL = with_views(
    "manifest",
    """SELECT dataset, chunk, n_files, n_events, chunk < max(chunk) OVER (PARTITION BY dataset) OR n_files = 100 AS emitted
FROM (SELECT dataset, chunk, count(*) AS n_files, CAST(sum(nevents) AS BIGINT) AS n_events
  FROM (SELECT dataset, nevents, (row_number() OVER (PARTITION BY dataset ORDER BY seq, name) - 1) // 100 AS chunk FROM manifest)
  GROUP BY 1, 2)""",
)


def _no_mapping(t: Tables) -> DataFrame:
    schema = "dataset string, out_index bigint, out_name string, in_seq bigint, in_name string, in_nevents bigint"
    return t.spark.createDataFrame([], schema)


def incremental_mapping(t: Tables) -> DataFrame:
    """Old files are mapped; an open dataset then gets the later ones."""
    rule = C.ChunkRule(files=50)
    table = MappingTable.create(fresh_path(t.spark, "mapping"), buckets=16)
    manifest = write_and_read(t.manifest.select("dataset", "seq", "name", "nevents", "o_orderdate"), "manifest")
    datasets = write_and_read(t.datasets, "datasets")
    table.extend(manifest.filter(F.col("o_orderdate") < ntz(SETTLED)), datasets, rule)
    return C.output_totals(table.plan(manifest, datasets.withColumn("open", F.lit(True)), rule))


INCREMENTAL_SQL = with_views(
    "manifest",
    """SELECT dataset, coalesce(used, 0) + g + 1 AS out_index, '/out/output_' || (coalesce(used, 0) + g + 1) || '.root' AS out_name,
  n_inputs, out_nevents FROM fresh LEFT JOIN base USING (dataset) WHERE g < last_g OR n_inputs = 50""",
    more=f"""placed AS (SELECT dataset, nevents, o_orderdate < TIMESTAMP '{SETTLED}' AS old,
  (row_number() OVER (PARTITION BY dataset, o_orderdate < TIMESTAMP '{SETTLED}' ORDER BY seq, name) - 1) // 50 AS g FROM manifest),
base AS (SELECT dataset, max(g) + 1 AS used FROM placed WHERE old GROUP BY 1),
fresh AS (SELECT dataset, g, count(*) AS n_inputs, CAST(sum(nevents) AS BIGINT) AS out_nevents,
  max(g) OVER (PARTITION BY dataset) AS last_g FROM placed WHERE NOT old GROUP BY 1, 2)""",
)


def override_mapping(t: Tables) -> DataFrame:
    """Caller-made chunks: files by calendar month."""
    files = t.manifest.select("dataset", "seq", "name", "nevents")
    made = t.manifest.select("dataset", "name", F.month("o_orderdate").alias("chunk"))
    return C.output_totals(C.override_mapping(files, made, _no_mapping(t), t.datasets)).drop("out_name")


OVERRIDE_SQL = with_views(
    "manifest",
    """SELECT dataset, dense_rank() OVER (PARTITION BY dataset ORDER BY m) AS out_index, n_inputs, out_nevents
FROM (SELECT dataset, month(o_orderdate) AS m, count(*) AS n_inputs, CAST(sum(nevents) AS BIGINT) AS out_nevents FROM manifest GROUP BY 1, 2)""",
)


def _paid(t: Tables) -> DataFrame:
    """Customers as datasets of as many events as they paid for."""
    return t.orders.groupBy(F.col("o_custkey").cast("string").alias("dataset")).agg(
        F.sum(F.floor("o_totalprice")).cast("bigint").alias("total_nevents"), F.lit(100_000).cast("bigint").alias("events_per_output")
    )


def event_ranges(t: Tables) -> DataFrame:
    return C.event_ranges(_paid(t)).drop("expected")


def range_inputs(t: Tables) -> DataFrame:
    """The inputs of every third output of the ranges: all files of its dataset."""
    files = t.orders.select(F.col("o_custkey").cast("string").alias("dataset"), F.concat(F.lit("file_"), F.col("o_orderkey").cast("string")).alias("name"))
    return C.inputs_of_ranges(C.event_ranges(_paid(t)).filter("out_index % 3 = 0"), files)


RANGE_INPUTS_SQL = """WITH c AS (SELECT o_custkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) // 100000 AS n FROM orders GROUP BY 1),
r AS (SELECT o_custkey, unnest(range(3, n + 1, 3)) AS out_index FROM c)
SELECT CAST(o_custkey AS VARCHAR) AS dataset, out_index, 'file_' || o_orderkey AS in_name FROM r JOIN orders USING (o_custkey)"""


RANGES_SQL = """WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS dataset, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total FROM orders GROUP BY 1)
SELECT dataset, out_index, 1 + (out_index - 1) * 100000 AS first_event, CAST(100000 AS BIGINT) AS n_events, total % 100000 AS dropped_events
FROM (SELECT dataset, total, unnest(range(1, total // 100000 + 1)) AS out_index FROM c)"""


def combine_stages(t: Tables) -> DataFrame:
    inputs = t.orders.select(
        F.col("o_orderpriority").alias("task"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderkey").alias("seq")
    )
    rows = C.combine_stages(inputs, [6, 4, 5])
    return rows.groupBy("stage", "task", "out_index", "out_name").agg(F.count(F.lit(1)).alias("n_inputs"))


COMBINE_SQL = """WITH s0 AS (SELECT o_orderpriority AS task, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i FROM orders),
s1 AS (SELECT task, i // 6 AS i, count(*) AS n_inputs FROM s0 GROUP BY 1, 2),
s2 AS (SELECT task, i // 4 AS i, count(*) AS n_inputs FROM s1 GROUP BY 1, 2),
s3 AS (SELECT task, i // 5 AS i, count(*) AS n_inputs FROM s2 GROUP BY 1, 2)
SELECT CAST(stage AS INTEGER) AS stage, task, i AS out_index, 'stage' || stage || '_out_' || i || '.root' AS out_name, n_inputs
FROM (SELECT 1 AS stage, * FROM s1 UNION ALL SELECT 2, * FROM s2 UNION ALL SELECT 3, * FROM s3)"""


def dedupe_inputs(t: Tables) -> DataFrame:
    """Customers seen in early orders are known; all orders arrive."""
    orders = t.orders.select(
        F.col("o_orderpriority").alias("task"), F.col("o_custkey").cast("string").alias("name"), F.col("o_orderkey").alias("arrival"), "o_orderdate"
    )
    none = orders.filter("false").select("task", "name", F.col("arrival").alias("seq"))
    known = C.add_inputs(none, orders.filter(F.col("o_orderdate") < ntz(SETTLED)))
    return C.add_inputs(known, orders)


DEDUPE_SQL = f"""WITH o AS (SELECT o_orderpriority AS task, CAST(o_custkey AS VARCHAR) AS name, o_orderkey AS k, o_orderdate < TIMESTAMP '{SETTLED}' AS old FROM orders),
first AS (SELECT task, name, min(k) FILTER (WHERE old) AS k_old, min(k) AS k_all FROM o GROUP BY 1, 2)
SELECT task, name, row_number() OVER (PARTITION BY task ORDER BY k_old IS NULL, coalesce(k_old, k_all)) AS seq FROM first"""


def dedupe_pairs(t: Tables) -> DataFrame:
    pairs = t.lineitem.select(
        F.array(F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")).alias("inputs"),
        F.array("l_returnflag", "l_linestatus").alias("outputs"),
        F.col("l_orderkey").alias("seq"),
    )
    return C.dedupe_pairs(pairs).select(comma_join("inputs").alias("inputs"), comma_join("outputs").alias("outputs"), "seq")


PAIRS_SQL = """SELECT l_linenumber || ',' || CAST(l_quantity AS INTEGER) AS inputs, l_returnflag || ',' || l_linestatus AS outputs, min(l_orderkey) AS seq
FROM lineitem GROUP BY 1, 2"""


def pair_inputs_outputs(t: Tables) -> DataFrame:
    """i-th customer with i-th supplier of a nation."""
    ins = t.customer.select(F.col("c_nationkey").alias("task"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("name"))
    outs = t.supplier.select(F.col("s_nationkey").alias("task"), F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name"))
    return C.pair_in_order(ins, outs)


ZIP_SQL = """SELECT task, pos, in_name, out_name
FROM (SELECT c_nationkey AS task, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos, c_name AS in_name FROM customer)
JOIN (SELECT s_nationkey AS task, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS pos, s_name AS out_name FROM supplier) USING (task, pos)"""


def flatten_inputs(t: Tables) -> DataFrame:
    nested = t.documents.select(F.col("doc_id").alias("out_index"), F.split("text", "\n").alias("inputs"))
    return C.flatten_inputs(nested)


FLATTEN_SQL = with_views("doc_lines", "SELECT doc_id AS out_index, CAST(line_no - 1 AS INTEGER) AS in_pos, line AS in_name FROM doc_lines")


def _mapping(t: Tables, k: int = 100) -> DataFrame:
    return C.extend_mapping(t.manifest, _no_mapping(t), t.datasets, C.ChunkRule(files=k))


def inputs_of_output(t: Tables) -> DataFrame:
    return C.inputs_of_output(_mapping(t), "/out/./x/..//output_3.root").select("dataset", "out_index", "in_name")


OF_OUTPUT_SQL = """SELECT dataset, CAST(3 AS BIGINT) AS out_index, in_name FROM (
  SELECT o_orderpriority AS dataset, 'file_' || o_orderkey || '.root' AS in_name,
    (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 100 + 1 AS idx FROM orders) WHERE idx = 3"""


def materialised_counts(t: Tables) -> DataFrame:
    """Write the outputs, read them back and compare with the plan.

    The records of fake files get lost on the way, so their outputs are rejected.
    """
    mapping = write_and_read(_mapping(t, MERGED_FILES), "mapping")
    fakes = t.orders.filter(F.col("o_totalprice") > 450000).select(
        F.concat(F.lit("file_"), F.col("o_orderkey").cast("string"), F.lit(".root")).alias("file")
    )
    records = t.events_of_files.join(fakes, "file", "left_anti")
    path = fresh_path(t.spark, "merged")
    C.materialise(records, mapping, path, folders=MERGED_FOLDERS)
    actual = t.spark.read.parquet(path).groupBy("dataset", "out_index").agg(F.count(F.lit(1)).alias("actual"))
    plan = C.output_totals(mapping).select("dataset", "out_index", F.col("out_nevents").alias("expected"))
    return E.check_counts(plan, actual, ["dataset", "out_index"])


MATERIALISED_SQL = with_views(
    "manifest",
    f"""SELECT dataset, out_index, expected, actual, CASE WHEN expected > 0 AND actual <> expected THEN 'count mismatch' ELSE '' END AS reason,
  NOT (expected > 0 AND actual <> expected) AS accepted
FROM (SELECT dataset, out_index, CAST(sum(nevents) AS BIGINT) AS expected, CAST(coalesce(sum(nevents) FILTER (WHERE NOT fake), 0) AS BIGINT) AS actual
  FROM (SELECT dataset, nevents, fake, (row_number() OVER (PARTITION BY dataset ORDER BY seq, name) - 1) // {MERGED_FILES} + 1 AS out_index FROM manifest)
  GROUP BY 1, 2)""",
)


def user_code_per_chunk(t: Tables) -> DataFrame:
    """A user's aggregate over the records of each output: the sum of negative weights."""

    def of_records(frame):
        weights = frame["weight"]
        return {"n": len(weights), "negative_sum": float(weights[weights < 0].sum())}

    aggregate = ChunkAggregate("n bigint, negative_sum double", of_records, lambda states: states.sum().to_dict())
    routed = C.route_records(t.events_of_files, _mapping(t, 50))
    found = aggregate_chunks(routed.select("dataset", "out_index", "weight"), aggregate, scattered=True)  # chunks of 50 files, in any task
    return found.withColumn("negative_sum", F.round("negative_sum", 4))


USER_SQL = """WITH m AS (SELECT o_orderpriority AS dataset, o_orderkey,
    (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 50 + 1 AS out_index FROM orders)
SELECT dataset, out_index, count(*) AS n, round(coalesce(sum(l_discount - 0.05) FILTER (WHERE l_discount - 0.05 < 0), 0), 4) AS negative_sum
FROM m JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"""

QUERIES = {
    "chunk_by_files": (chunk_by_files, FILES_SQL),
    "chunk_by_events": (chunk_by_events, EVENTS_SQL),
    "chunk_by_events_split": (chunk_by_events_split, EVENTS_SQL),
    "chunk_both_limits": (chunk_both_limits, BOTH_SQL),
    "incremental_mapping": (incremental_mapping, INCREMENTAL_SQL),
    "override_mapping": (override_mapping, OVERRIDE_SQL),
    "event_ranges": (event_ranges, RANGES_SQL),
    "range_inputs": (range_inputs, RANGE_INPUTS_SQL),
    "combine_stages": (combine_stages, COMBINE_SQL),
    "dedupe_inputs": (dedupe_inputs, DEDUPE_SQL),
    "dedupe_pairs": (dedupe_pairs, PAIRS_SQL),
    "pair_inputs_outputs": (pair_inputs_outputs, ZIP_SQL),
    "flatten_inputs": (flatten_inputs, FLATTEN_SQL),
    "inputs_of_output": (inputs_of_output, OF_OUTPUT_SQL),
    "materialised_counts": (materialised_counts, MATERIALISED_SQL),
    "user_code_per_chunk": (user_code_per_chunk, USER_SQL),
}
