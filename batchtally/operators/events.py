"""Event records: signed counts, skims, slices and output validation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchtally.functions.paths import is_data_by_name
from batchtally.plans.scan import MAX_GROUP_ROWS, number_rows


def event_counts(events: DataFrame, *, file: str = "file", weight: str = "weight") -> DataFrame:
    """Per file: records, records with weight < 0, and records not > 0.

    The last two differ for zero weights.
    """
    w = F.col(weight)
    n, positive = F.count(F.lit(1)), F.count_if(w > 0)
    return events.groupBy(file).agg(
        n.alias("n"), F.count_if(w < 0).alias("n_negative"), (n - positive).alias("n_nonpositive")
    )


def lacking_counts(stored: DataFrame, *, file: str = "file") -> DataFrame:
    """Files without one of the stored counts: the only ones whose records must be read."""
    return stored.filter(F.col("n").isNull() | F.col("n_negative").isNull()).select(file)


def prefer_stored(stored: DataFrame, computed: DataFrame, *, file: str = "file") -> DataFrame:
    """Every stored file with its stored counts, each of the two on its own, else the computed ones.

    A file without records has zero counts. ``n_nonpositive`` is never stored, so
    it is NULL for files that need no reading.
    """
    c = computed.select(file, *[F.col(k).alias(f"_{k}") for k in ("n", "n_negative", "n_nonpositive")])
    needed = F.col("n").isNull() | F.col("n_negative").isNull()
    return stored.select(file, "n", "n_negative").join(c, file, "left").select(
        file,
        F.coalesce("n", "_n", F.lit(0)).alias("n"),
        F.coalesce("n_negative", "_n_negative", F.lit(0)).alias("n_negative"),
        F.when(needed, F.coalesce("_n_nonpositive", F.lit(0))).alias("n_nonpositive"),
    )


def needs_scan(manifest: DataFrame) -> DataFrame:
    """Files whose negatives must be counted: neither fake nor data by name.

    Use its names to prune the event scan before ``event_counts``.
    """
    return manifest.filter(~F.coalesce("fake", F.lit(False)) & ~is_data_by_name("name"))


def negative_events(manifest: DataFrame, counts: DataFrame) -> DataFrame:
    """Add ``neg``: stored for fake files, 0 for data by name, else computed."""
    c = counts.select(F.col("file").alias("name"), F.col("n_negative").alias("_neg"))
    neg = (
        F.when(F.coalesce("fake", F.lit(False)), F.col("nevents_negative"))
        .when(is_data_by_name("name"), F.lit(0))
        .otherwise(F.coalesce("_neg", F.lit(0)))
    )
    return manifest.join(c, "name", "left").withColumn("neg", neg.cast("bigint")).drop("_neg")


def positive_count(n: Column, neg: Column) -> Column:
    return n - neg


def effective_count(n: Column, neg: Column, is_tree: Column | bool = True) -> Column:
    """Positive minus rest; a non-tree output has no positives."""
    tree = is_tree if isinstance(is_tree, Column) else F.lit(is_tree)
    pos = F.when(tree, n - neg).otherwise(F.lit(0))
    return pos - (n - pos)


def output_metadata(outputs: DataFrame, *, is_tree: bool = True) -> DataFrame:
    """Done outputs with their total and effective counts."""
    return outputs.filter("done").select(
        "dataset",
        "out_index",
        F.col("nevents").alias("n"),
        effective_count(F.col("nevents"), F.col("neg"), is_tree).cast("bigint").alias("effective"),
    )


def dataset_metadata(outputs: DataFrame, datasets: DataFrame, *, is_tree: bool = True) -> DataFrame:
    """One record per dataset with what its done outputs add up to.

    ``datasets`` holds ``dataset, open, live_nevents`` and any columns to carry
    along (tag, gtag, xsec, kfact, efact, ...).
    """
    sums = (
        output_metadata(outputs, is_tree=is_tree)
        .groupBy("dataset")
        .agg(F.count(F.lit(1)).alias("n_outputs"), F.sum("n").alias("_n"), F.sum("effective").alias("_e"))
    )
    merged = F.coalesce("_n", F.lit(0)).cast("bigint")
    return (
        datasets.join(sums, "dataset", "left")
        .withColumns(
            {
                "n_outputs": F.coalesce("n_outputs", F.lit(0)),
                "nevents_merged": merged,
                "nevents_effective": F.coalesce("_e", F.lit(0)).cast("bigint"),
                "nevents_das": F.when(F.coalesce("open", F.lit(False)), F.col("live_nevents")).otherwise(merged),
            }
        )
        .drop("_n", "_e")
    )


PART_OUTPUTS = 1000


def metadata_documents(
    outputs: DataFrame, mapping: DataFrame, datasets: DataFrame, *, per_part: int = PART_OUTPUTS, is_tree: bool = True
) -> DataFrame:
    """Metadata documents of datasets: the record of ``dataset_metadata`` with, per done output, its inputs and counts.

    A dataset may have any number of outputs, so its document comes in parts of
    ``per_part`` consecutive indices; a part and an output's list of inputs are bounded by
    that and by the chunk limits. ``ijob_to_miniaod`` maps an index to the input names in
    order, ``ijob_to_nevents`` to ``[total, effective]``; entries are sorted by index. A dataset
    without a done output has one part with empty maps.
    """
    keys = ["dataset", "out_index"]
    made = output_metadata(outputs, is_tree=is_tree)
    rows = mapping.join(made.select(*keys), keys, "left_semi").select(*keys, F.struct("in_seq", "in_name").alias("_in"))
    inputs = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("_in")), lambda x: x["in_name"]).alias("_names"))
    part = F.floor((F.col("out_index") - 1) / per_part).cast("bigint")
    none = F.array().cast("array<string>")
    entry = F.struct("out_index", F.coalesce("_names", none).alias("names"), F.array("n", "effective").alias("counts"))
    parts = made.join(inputs, keys, "left").groupBy("dataset", part.alias("part")).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    entries = F.coalesce("_e", F.array().cast(parts.schema["_e"].dataType))
    by_index = lambda field: F.map_from_entries(F.transform(entries, lambda e: F.struct(e["out_index"].cast("string"), e[field])))
    records = dataset_metadata(outputs, datasets, is_tree=is_tree).join(parts, "dataset", "left")
    return records.withColumns(
        {"part": F.coalesce("part", F.lit(0)), "ijob_to_miniaod": by_index("names"), "ijob_to_nevents": by_index("counts")}
    ).drop("_e")


def count_matching(array: Column | str, predicate: Callable[[Column], Column]) -> Column:
    """Number of array elements for which the predicate holds."""
    a = F.col(array) if isinstance(array, str) else array
    return F.size(F.filter(a, lambda x: F.coalesce(predicate(x), F.lit(False))))


def skim(events: DataFrame, conditions: Sequence[Column], columns: Sequence[str] | None = None) -> DataFrame:
    """Events that meet all conditions, e.g. ``count_matching(...) >= 1``."""
    for c in conditions:
        events = events.filter(c)
    return events.select(*columns) if columns else events


def skim_rows(elements: DataFrame, keys: Sequence[str], conditions: dict[str, tuple[Column, int | None, int | None]]) -> DataFrame:
    """The same skim when branch elements are rows: ``name -> (predicate, least, most)``.

    Counts are aggregated, so one event with very many elements is no problem.
    """
    kept = elements.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_elements"), *[F.count_if(p).alias(name) for name, (p, _, _) in conditions.items()]
    )
    for name, (_, least, most) in conditions.items():
        if least is not None:
            kept = kept.filter(F.col(name) >= least)
        if most is not None:
            kept = kept.filter(F.col(name) <= most)
    return kept


def event_slice(
    events: DataFrame, keys: Sequence[str], order: Sequence[str], first: int, count: int,
    *, max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Events from number ``first`` on (1-based; below 0 nothing is skipped), ``count`` of them or all (-1)."""
    skip = max(first - 1, 0) if first >= 0 else 0
    placed = number_rows(events, keys, order, max_group_rows=max_group_rows).filter(F.col("pos") > skip)
    return placed.filter(F.col("pos") <= skip + count) if count >= 0 else placed


def event_ranges_of(
    events: DataFrame, keys: Sequence[str], order: Sequence[str], per: int, *, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Events with the number of the full range of ``per`` events they fall in.

    The range join is an equation: range = floor((position - 1) / per) + 1. The
    remainder after the last full range is dropped.
    """
    placed = number_rows(events, keys, order, total="_n", max_group_rows=max_group_rows)
    ranged = placed.withColumn("range_no", (F.floor((F.col("pos") - 1) / per) + 1).cast("bigint"))
    return ranged.filter(F.col("range_no") * per <= F.col("_n")).drop("_n")


def check_counts(plan: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accept an output unless a positive expected count differs from the actual one.

    ``plan(keys, expected)``, ``actual(keys, actual)``; outputs of either side are kept.
    """
    joined = plan.join(actual, list(keys), "full_outer").withColumn("actual", F.coalesce("actual", F.lit(0)))
    reason = (
        F.when(F.col("expected").isNull(), F.lit("unplanned"))
        .when((F.col("expected") > 0) & (F.col("actual") != F.col("expected")), F.lit("count mismatch"))
        .otherwise(F.lit(""))
    )
    return joined.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "")


def bad_outputs(records: DataFrame, keys: Sequence[str], bad: Column) -> DataFrame:
    """Outputs with at least one unreadable record."""
    return records.groupBy(*keys).agg(F.bool_or(F.coalesce(bad, F.lit(True))).alias("_bad")).filter("_bad").drop("_bad")


def missing_files(manifest: DataFrame, read: DataFrame) -> DataFrame:
    """Manifest files of which nothing could be read; ``read(name)``."""
    return manifest.join(read.select("name").distinct(), "name", "left_anti")


def drop_rejected(outputs: DataFrame, rejects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outputs with rejected ones no longer existing, so that they are planned again.

    ``rejects(keys, reason)``.
    """
    r = rejects.groupBy(*keys).agg(F.min("reason").alias("reason"))
    gone = F.col("reason").isNotNull()
    return outputs.join(r, list(keys), "left").withColumn("exists", F.col("exists") & ~gone)
