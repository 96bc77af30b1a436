"""Small column helpers the document operators share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 100_000  # rows of a small table that may be broadcast


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once per row.

    Inside a lambda an outer expression would be evaluated anew for every
    element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint only if counting shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def packed(df: DataFrame, *extra: Column) -> DataFrame:
    """All columns as one struct ``row``, so that new columns cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias("row"), *extra)


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def prefix_sums(values: Column, block: int = 64) -> Column:
    """Running sums of an array of longs, each including its own element."""
    return _running(values, lambda a, b: a + b, block)


def prefix_max(values: Column, block: int = 64) -> Column:
    """Running maxima of an array of longs that are not negative, each including its own element."""
    return _running(values, lambda a, b: F.greatest(a, b), block)


def _running(values: Column, both: Callable[[Column, Column], Column], block: int) -> Column:
    """What ``both`` makes of the elements up to each one, and of 0.

    Inside blocks it is taken from a slice, for whole blocks from one
    fold over block totals, so the work stays near ``block`` steps per element.
    """
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), both)

    def run(a: Column) -> Column:
        n_blocks = F.floor((F.size(a) + block - 1) / block).cast("int")
        of_block = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: total(F.slice(a, b * block + 1, block)))
        before = lambda t: F.aggregate(
            t,
            F.array(F.lit(0).cast("bigint")),
            lambda acc, x: F.concat(acc, F.array(both(F.element_at(acc, -1), x))),
        )
        return let(
            let(of_block, before),
            lambda start: F.transform(
                a,
                lambda _, i: both(
                    F.get(start, F.floor(i / block).cast("int")),
                    total(F.slice(a, (F.floor(i / block) * block + 1).cast("int"), (i % block + 1).cast("int"))),
                ),
            ),
        )

    empty = F.array().cast("array<bigint>")
    return let(values, lambda a: F.when(F.size(a) > 0, run(a)).otherwise(empty))


def n_below(values: Column, limit: Column) -> Column:
    """How many elements of a sorted array of longs are smaller than ``limit``: a binary search."""
    steps = F.sequence(F.lit(0), F.floor(F.log2(F.size(values) + 1)).cast("int"))
    middle = lambda at: F.floor((at["low"] + at["high"]) / 2).cast("int")

    def step(at: Column, _: Column) -> Column:
        below = F.coalesce(F.get(values, middle(at)) < limit, F.lit(False))
        return F.struct(F.when(below, middle(at) + 1).otherwise(at["low"]).alias("low"), F.when(below, at["high"]).otherwise(middle(at)).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))
    return F.aggregate(steps, start, step, lambda at: at["low"])


def required(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")
