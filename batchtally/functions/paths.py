"""File and dataset name functions. All are row-local built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STORE_PREFIX = "/hadoop/cms"
DATA_NAME_MARK = "Run2017"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extension(name: Column | str) -> Column:
    """Text after the last dot; the whole name when there is none."""
    return F.substring_index(_c(name), ".", -1)


def basepath(name: Column | str) -> Column:
    """Text before the last slash, ``.`` when there is none."""
    n = _c(name)
    return F.when(n.contains("/"), F.regexp_replace(n, r"(?s)/[^/]*$", "")).otherwise(F.lit("."))


def basename(name: Column | str) -> Column:
    return F.substring_index(_c(name), "/", -1)


def _drop_last_dot(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\.[^.]*$", "")


def basename_noext(name: Column | str) -> Column:
    return _drop_last_dot(basename(name))


def file_index(name: Column | str) -> Column:
    """Integer after the last underscore of the name without extension.

    NULL when the name has no dot, no underscore or no integer there.
    """
    n = _c(name)
    stem = _drop_last_dot(n)
    return F.when(
        n.contains(".") & stem.contains("_"),
        F.substring_index(stem, "_", -1).try_cast("bigint"),
    )


def join_basepath(base: Column | str, name: Column | str) -> Column:
    b, n = _c(base), _c(name)
    return (
        F.when(n.startswith("/") | b.isNull() | (b == ""), n)
        .when(b.endswith("/"), F.concat(b, n))
        .otherwise(F.concat(b, F.lit("/"), n))
    )


def same_file(left: Column | str, right: Column | str) -> Column:
    """Files are equal when their names are."""
    return _c(left) == _c(right)


def normpath(path: Column | str) -> Column:
    """POSIX path normal form: no empty, ``.`` or resolvable ``..`` segments."""
    p = _c(path)
    lead = (
        F.when(p.startswith("//") & ~p.startswith("///"), F.lit("//"))
        .when(p.startswith("/"), F.lit("/"))
        .otherwise(F.lit(""))
    )

    def step(done: Column, seg: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        climbs = seg == ".."
        return (
            F.when(seg.isin("", "."), done)
            .when(climbs & last.isNotNull() & (last != ".."), F.slice(done, F.lit(1), F.size(done) - 1))
            .when(climbs & (lead != ""), done)
            .otherwise(F.concat(done, F.array(seg)))
        )

    parts = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step)
    text = F.concat(lead, F.array_join(parts, "/"))
    return F.when(text == "", F.lit(".")).otherwise(text)


def same_path(left: Column | str, right: Column | str) -> Column:
    return normpath(left) == normpath(right)


def dataset_slug(dataset: Column | str) -> Column:
    """Slashes become underscores, the first character goes."""
    return F.substring(F.replace(_c(dataset), F.lit("/"), F.lit("_")), 2, 2_147_483_647)


def output_dir(root: str, user: Column | str, area: str, dataset: Column | str, tag: Column | str) -> Column:
    return F.format_string("%s/%s/%s/%s_%s/", F.lit(root), _c(user), F.lit(area), dataset_slug(dataset), _c(tag))


def unique_name(task: Column | str, dataset: Column | str, tag: Column | str) -> Column:
    return F.format_string("%s_%s_%s", _c(task), dataset_slug(dataset), _c(tag))


def strip_store_prefix(path: Column | str, anchored: bool = False) -> Column:
    """Drop the store prefix: everywhere, or only at the start of the path."""
    p = _c(path)
    if anchored:
        return F.regexp_replace(p, "^" + STORE_PREFIX, "")
    return F.replace(p, F.lit(STORE_PREFIX), F.lit(""))


def dataset_tier_swap(dataset: Column | str, old: str, new: str) -> Column:
    return F.replace(_c(dataset), F.lit(old), F.lit(new))


def is_data_by_name(name: Column | str) -> Column:
    return _c(name).contains(DATA_NAME_MARK)


def task_key(kind: Column | str, tag: Column | str, dataset: Column | str) -> Column:
    """Portable task key: digest of class, tag and dataset."""
    return F.md5(F.concat_ws("\u0001", _c(kind), _c(tag), _c(dataset)))


def comma_join(names: Column | str) -> Column:
    return F.array_join(_c(names), ",")


def comma_split(text: Column | str) -> Column:
    return F.split(_c(text), ",")


def log_path(logdir: Column | str, cluster_id: Column | str, ext: str) -> Column:
    """Path of one attempt's log, ``<logdir>/1e.<cluster>.0.<ext>``."""
    return F.concat(_c(logdir), F.lit("/1e."), _c(cluster_id).cast("string"), F.lit(f".0.{ext}"))
