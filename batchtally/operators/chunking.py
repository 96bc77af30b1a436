"""Chunk planning: ordered, bounded grouping of files into outputs.

Manifest columns used: ``dataset, seq, name, nevents``. ``(seq, name)`` orders
the files of a dataset.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchtally.functions.paths import normpath
from batchtally.plans.jumps import greedy_groups
from batchtally.plans.scan import MAX_GROUP_ROWS, Census, largest_group, number_rows

ORDER = ("seq", "name")


@dataclass(frozen=True)
class ChunkRule:
    """Limits of one output: files, events, or both.

    With both given, the held number counts files while it is tested against
    both limits.
    """

    files: int | None = None
    events: float | None = None

    def __post_init__(self):
        for n in (self.files, self.events):
            if n is not None and n <= 0:
                raise ValueError("chunk limits must be positive")


def assign_chunks(
    files: DataFrame,
    rule: ChunkRule,
    *,
    keys: Sequence[str] = ("dataset",),
    order: Sequence[str] = ORDER,
    census: Census = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add ``chunk`` (0-based) to each file, and whether the chunk is ``closed``.

    Only the trailing chunk of a key is open; with a file limit it is closed when
    exactly full. Both come out of one pass, without joining the files to
    their chunks.
    """
    if rule.events is not None:
        counted = files.withColumn("nevents", F.coalesce(F.col("nevents"), F.lit(0)).cast("bigint"))
        return greedy_groups(
            counted, keys, order, count="nevents", files=rule.files, limit=rule.events,
            census=census, max_group_rows=max_group_rows,
        )
    if rule.files is None:
        return files.withColumns({"chunk": F.lit(0).cast("bigint"), "closed": F.lit(False)})
    placed = number_rows(files, keys, order, pos="_pos", total="_n", census=census, max_group_rows=max_group_rows)
    chunk = F.floor((F.col("_pos") - 1) / rule.files).cast("bigint")
    return placed.withColumns({"chunk": chunk, "closed": (chunk + 1) * rule.files <= F.col("_n")}).drop("_pos", "_n")


def chunk_table(assigned: DataFrame, *, flush: bool | Column = False, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """One row per chunk: file and event totals, and whether it is emitted.

    An open chunk is a leftover unless flushed; ``flush`` may be a column.
    """
    flushed = flush if isinstance(flush, Column) else F.lit(flush)
    return assigned.groupBy(*keys, "chunk").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum(F.coalesce("nevents", F.lit(0))).cast("bigint").alias("n_events"),
        F.bool_or(flushed | F.col("closed")).alias("emitted"),
    )


def output_name(directory: Column | str, base: str, index: Column | str) -> Column:
    """``<dir>/<prefix>_<index>.<suffix>``, split at the last dot of ``base``."""
    prefix, suffix = base.rsplit(".", 1)
    d = F.col(directory) if isinstance(directory, str) else directory
    i = F.col(index) if isinstance(index, str) else index
    return F.concat(d, F.lit(f"/{prefix}_"), i.cast("string"), F.lit(f".{suffix}"))


def output_totals(mapping: DataFrame) -> DataFrame:
    """Inputs and events per output."""
    return mapping.groupBy("dataset", "out_index", "out_name").agg(
        F.count(F.lit(1)).alias("n_inputs"), F.sum(F.coalesce("in_nevents", F.lit(0))).cast("bigint").alias("out_nevents")
    )


def _mapping_rows(numbered: DataFrame, directory: Column, base: str) -> DataFrame:
    return numbered.select(
        "dataset",
        F.col("out_index").cast("bigint").alias("out_index"),
        output_name(directory, base, "out_index").alias("out_name"),
        F.col("seq").alias("in_seq"),
        F.col("name").alias("in_name"),
        F.col("nevents").alias("in_nevents"),
    )


def unmapped_files(manifest: DataFrame, mapping: DataFrame, datasets: DataFrame) -> DataFrame:
    """Files still to plan: not mapped by name, and not of a closed dataset that already has a mapping."""
    mapped = mapping.select("dataset").distinct()
    settled = datasets.filter(~F.coalesce("open", F.lit(False))).select("dataset").join(mapped, "dataset", "left_semi")
    fresh = manifest.join(settled, "dataset", "left_anti")
    known = mapping.select("dataset", F.col("in_name").alias("name"))
    return fresh.join(known, ["dataset", "name"], "left_anti")


def plan_files(
    files: DataFrame,
    used: DataFrame,
    datasets: DataFrame,
    rule: ChunkRule,
    *,
    flush: bool = False,
    census: Census = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Every file ``(dataset, seq, name, nevents)`` with its ``out_index``, its ``output_dir``, and whether that output is ``complete``.

    ``used`` holds the largest index of each dataset as ``(dataset, last_index)``; indices go on after it, from 1. Files
    of incomplete outputs are leftovers; so are all files of a closed dataset that has outputs already.
    """
    assigned = assign_chunks(files, rule, census=census, max_group_rows=max_group_rows)
    opened = F.coalesce("open", F.lit(False)).alias("_open")
    plan = datasets.select("dataset", opened, "output_dir").join(used.select("dataset", F.col("last_index").alias("_used")), "dataset", "left")
    unknown = F.raise_error(F.concat(F.lit("no row in datasets for "), F.coalesce("dataset", F.lit("NULL")))).cast("boolean")
    settled = ~F.col("_open") & F.col("_used").isNotNull()
    complete = F.when(F.col("_open").isNull(), unknown).otherwise(~settled & (F.col("closed") | ~F.col("_open") | F.lit(flush)))
    index = (F.coalesce("_used", F.lit(0)) + F.col("chunk") + 1).cast("bigint")
    return assigned.join(plan, "dataset", "left").select(
        "dataset", "seq", "name", "nevents", index.alias("out_index"), "output_dir", complete.alias("complete")
    )


def extend_mapping(
    manifest: DataFrame,
    mapping: DataFrame,
    datasets: DataFrame,
    rule: ChunkRule,
    *,
    base: str = "output.root",
    flush: bool = False,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """New mapping rows for the files not mapped yet.

    ``datasets`` holds ``dataset, open, output_dir``. A closed dataset is always
    flushed. Indices go on after the largest one in use, from 1. A file of a
    dataset without a row in ``datasets`` is an error.

    The whole manifest bounds the files to plan; they are only counted
    themselves where that bound is too large for the plain plan.
    """
    files = unmapped_files(manifest, mapping, datasets).select("dataset", "seq", "name", "nevents")
    sizes = largest_group(manifest, ["dataset"])
    if sizes[0] > max_group_rows:
        sizes = largest_group(files, ["dataset"])
    used = mapping.groupBy("dataset").agg(F.max("out_index").alias("last_index"))
    planned = plan_files(files, used, datasets, rule, flush=flush, census=sizes, max_group_rows=max_group_rows)
    return mapping_rows(planned.filter("complete"), base)


def mapping_rows(planned: DataFrame, base: str) -> DataFrame:
    """Mapping rows of planned files."""
    return _mapping_rows(planned, F.col("output_dir"), base)


def override_mapping(
    files: DataFrame, chunks: DataFrame, mapping: DataFrame, datasets: DataFrame, *, base: str = "output.root"
) -> DataFrame:
    """Mapping rows from caller-made chunks ``(dataset, name, chunk)`` instead of a plan."""
    used = mapping.groupBy("dataset").agg(F.max("out_index").alias("_used"))
    order = number_rows(chunks.select("dataset", "chunk").distinct(), ["dataset"], ["chunk"], pos="_rank")
    numbered = (
        files.join(chunks, ["dataset", "name"])
        .join(order, ["dataset", "chunk"])
        .join(datasets.select("dataset", "output_dir"), "dataset")
        .join(used, "dataset", "left")
        .withColumn("out_index", F.coalesce("_used", F.lit(0)) + F.col("_rank"))
    )
    return _mapping_rows(numbered, F.col("output_dir"), base)


_SPAN = 100_000


def event_ranges(datasets: DataFrame) -> DataFrame:
    """Outputs that split one dataset by event number.

    ``datasets`` holds ``dataset, total_nevents, events_per_output``, both at
    least 1. The remainder is dropped and reported. Every output reads all
    inputs of its dataset (equi join on ``dataset`` when they are needed).
    """
    total, per = F.col("total_nevents"), F.col("events_per_output")
    checked = datasets.withColumn(
        "_n",
        F.when((total >= 1) & (per >= 1), F.floor(total / per).cast("bigint")).otherwise(
            F.raise_error(F.lit("total_nevents and events_per_output must be at least 1")).cast("bigint")
        ),
    )
    spans = (
        checked.filter("_n >= 1")
        .withColumn("_span", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / _SPAN).cast("bigint"))))
        .repartition("dataset", "_span")
    )
    low = F.col("_span") * _SPAN + 1
    return spans.withColumn("out_index", F.explode(F.sequence(low, F.least(low + (_SPAN - 1), F.col("_n"))))).select(
        "dataset",
        "out_index",
        first_event("out_index", per).alias("first_event"),
        per.cast("bigint").alias("n_events"),
        F.lit(-1).cast("bigint").alias("expected"),
        (total - F.col("_n") * per).cast("bigint").alias("dropped_events"),
    )


def first_event(index: Column | str, per: Column) -> Column:
    i = F.col(index) if isinstance(index, str) else index
    return (F.lit(1) + (i - 1) * per).cast("bigint")


def inputs_of_ranges(asked: DataFrame, files: DataFrame) -> DataFrame:
    """Every input of the asked-for outputs ``(dataset, out_index)`` of ``event_ranges``: all files of their dataset."""
    return asked.select("dataset", "out_index").join(files.select("dataset", F.col("name").alias("in_name")), "dataset")


def add_inputs(known: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Append names not present yet, in arrival order.

    ``known(task, name, seq)``, ``arrivals(task, name, arrival)``; returns all rows.
    """
    first = arrivals.groupBy("task", "name").agg(F.min("arrival").alias("arrival"))
    fresh = first.join(known.select("task", "name"), ["task", "name"], "left_anti")
    placed = number_rows(fresh, ["task"], ["arrival", "name"], census=arrivals)
    last = known.groupBy("task").agg(F.max("seq").alias("_last"))
    added = placed.join(last, "task", "left").select(
        "task", "name", (F.coalesce("_last", F.lit(0)) + F.col("pos")).cast("bigint").alias("seq")
    )
    return known.select("task", "name", F.col("seq").cast("bigint").alias("seq")).unionByName(added)


def dedupe_pairs(pairs: DataFrame) -> DataFrame:
    """Keep the first of equal (inputs, outputs) pairs; both are ordered arrays."""
    return pairs.groupBy("inputs", "outputs").agg(F.min("seq").alias("seq"))


def combine_stage(
    inputs: DataFrame,
    per_output: int,
    pattern: str,
    *,
    mapped: DataFrame | None = None,
    flush: bool = False,
    census: Census = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Group inputs ``(task, name, seq)`` by ``per_output``; output indices count from 0.

    With ``mapped`` (rows of earlier calls) only inputs after the last mapped one
    are taken, and indices go on. ``pattern`` is a printf pattern of the index.
    """
    if not isinstance(per_output, int) or per_output < 1:
        raise ValueError("per_output must be a positive int")
    rows = inputs.select("task", "name", "seq")
    if mapped is not None:
        done = mapped.groupBy("task").agg(F.max("seq").alias("_seen"), (F.max("out_index") + 1).alias("_base"))
        rows = rows.join(done, "task", "left").filter(F.col("_seen").isNull() | (F.col("seq") > F.col("_seen")))
    else:
        rows = rows.withColumn("_base", F.lit(0))
    placed = number_rows(rows, ["task"], ["seq", "name"], total="_n", census=census or inputs, max_group_rows=max_group_rows)
    grouped = placed.withColumn("_g", F.floor((F.col("pos") - 1) / per_output))
    if not flush:
        grouped = grouped.filter((F.col("_g") + 1) * per_output <= F.col("_n"))
    index = (F.coalesce("_base", F.lit(0)) + F.col("_g")).cast("bigint")
    return grouped.select(
        "task", index.alias("out_index"), F.format_string(pattern, index).alias("out_name"), "name", "seq"
    )


def combine_stages(inputs: DataFrame, sizes: Sequence[int], pattern: str = "stage%d_out_%%d.root", *, flush: bool = True) -> DataFrame:
    """Chain of combines; each stage reads the outputs of the one before.

    Returns the mapping rows of all stages with ``stage`` (from 1). The inputs are
    numbered once: outputs of a stage count from 0, so the first input below an
    output stands for it in the later stages, and indices are whole divisions.
    """
    if not all(isinstance(k, int) and k >= 1 for k in sizes):
        raise ValueError("sizes must be positive ints")
    placed = number_rows(inputs.select("task", "name", "seq"), ["task"], ["seq", "name"], pos="_pos", total="_n")
    at, held = F.col("_pos") - 1, F.col("_n")  # place of the input, inputs of the stage
    name, seq, below = F.col("name"), F.col("seq").cast("bigint"), 1
    rows = []
    for stage, k in enumerate(sizes, 1):
        i = F.floor(at / below).cast("bigint")
        index = F.floor(i / k).cast("bigint")
        stands = (at % below == 0) & (i < held)
        taken = stands if flush else stands & ((index + 1) * k <= held)
        out_name = F.format_string(pattern % stage, index)
        row = F.struct(F.lit(stage).alias("stage"), index.alias("out_index"), out_name.alias("out_name"), name.alias("name"), seq.alias("seq"))
        rows.append(F.when(taken, row))
        held = (F.ceil(held / k) if flush else F.floor(held / k)).cast("bigint")
        name, seq, below = out_name, index, below * k
    return placed.select("task", F.inline(F.array_compact(F.array(*rows))))


def flatten_inputs(nested: DataFrame) -> DataFrame:
    """``(out_index, inputs ARRAY)`` to one row per input, list order kept."""
    return nested.select("out_index", F.posexplode("inputs").alias("in_pos", "in_name"))


def inputs_of_output(mapping: DataFrame, output: Column | str) -> DataFrame:
    """Mapping rows of one output, found by normalised path; none when unknown."""
    wanted = F.lit(output) if isinstance(output, str) else output
    return mapping.filter(normpath("out_name") == normpath(wanted))


def pair_in_order(inputs: DataFrame, outputs: DataFrame, *, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """i-th input with i-th output per task, up to the shorter list; both ``(task, seq, name)``."""
    left = number_rows(inputs, ["task"], ["seq", "name"], max_group_rows=max_group_rows)
    right = number_rows(outputs, ["task"], ["seq", "name"], max_group_rows=max_group_rows)
    return left.select("task", "pos", F.col("name").alias("in_name")).join(
        right.select("task", "pos", F.col("name").alias("out_name")), ["task", "pos"]
    )


def route_records(records: DataFrame, mapping: DataFrame, *, file: str = "file") -> DataFrame:
    """Records with the output they belong to."""
    return records.join(mapping.select("dataset", "out_index", F.col("in_name").alias(file)), file)


def materialise(records: DataFrame, mapping: DataFrame, path: str, *, file: str = "file", folders: int | None = None) -> None:
    """Write the records of each output's inputs, one folder per output.

    The records are read once and rebalanced by output in one exchange; sizes are
    known when that has run, so Spark then splits the outputs that are too large for
    one task and merges small ones. With ``folders`` the outputs of a dataset
    share that many folders, and ``out_index`` stays a column.
    """
    routed = route_records(records, mapping, file=file).hint("rebalance", "dataset", "out_index")
    if folders is None:
        routed.write.partitionBy("dataset", "out_index").parquet(path)
    else:
        bucket = F.pmod(F.col("out_index"), F.lit(folders)).alias("folder")
        routed.select("*", bucket).write.partitionBy("dataset", "folder").parquet(path)
