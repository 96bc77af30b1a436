"""User code on the rows of a chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any, Tuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANES = 64  # tasks that may share the partial states of one chunk


@dataclass(frozen=True)
class ChunkAggregate:
    """A user's aggregate in mergeable parts.

    ``state`` names the fields of a state. ``lift`` makes the state of some records
    of a chunk (a frame with at least one row), ``merge`` that of several states
    (a frame of the state's columns); the way the records are split must not
    matter. Both return a mapping of the fields.
    """

    state: str
    lift: Callable[[pd.DataFrame], Mapping[str, Any]]
    merge: Callable[[pd.DataFrame], Mapping[str, Any]]


def aggregate_chunks(
    routed: DataFrame, aggregate: ChunkAggregate, keys: Sequence[str] = ("dataset", "out_index"), *, lanes: int = LANES, scattered: bool = False
) -> DataFrame:
    """The state of each chunk as columns.

    States are lifted where the records lie, one per chunk and batch of rows, so no record is
    shuffled and a huge chunk is worked on by all tasks that hold some of it. Its states, few to a
    task, are merged in ``lanes`` tasks and then in one.

    Where there are many chunks and the records of each lie ``scattered`` over the tasks, a batch would hold
    about one record of a chunk, and the user's code would run once a record. They are then gathered by chunk first,
    in one exchange whose partitions Spark splits where they are too large, and sorted, so that it runs about once a chunk.
    """
    keys = list(keys)
    state = T.StructType.fromDDL(aggregate.state)
    names = [f.name for f in state.fields]
    schema = T.StructType([routed.schema[k] for k in keys] + state.fields)

    def lift(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _folded(frames, keys, schema, aggregate.lift, aggregate.merge)

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = lambda part: {n: part[n].iloc[0] for n in names} if len(part) == 1 else aggregate.merge(part[names])
        yield from _folded(frames, keys, schema, one, aggregate.merge)

    rows = routed.hint("rebalance", *keys).sortWithinPartitions(*keys) if scattered else routed
    lifted = rows.mapInPandas(lift, schema).withColumn("_lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
    in_lanes = lifted.repartition(*keys, "_lane").drop("_lane").sortWithinPartitions(*keys).mapInPandas(merge, schema)
    return in_lanes.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(merge, schema)


def _folded(
    frames: Iterator[pd.DataFrame],
    keys: Sequence[str],
    schema: T.StructType,
    state_of: Callable[[pd.DataFrame], Mapping[str, Any]],
    merge: Callable[[pd.DataFrame], Mapping[str, Any]],
) -> Iterator[pd.DataFrame]:
    """One row of ``schema`` per run of a frame's equal keys; a run that goes on in the next frame is merged."""
    names = schema.names[len(keys) :]
    at, held = None, None  # key and state of the run that may go on
    for frame in frames:
        rows = []
        for key, part in frame.groupby(list(keys), dropna=False, sort=False):
            state = dict(zip(names, _fields(state_of(part), names), strict=True))
            if held is not None and _same_key(key, at):
                held = merge(pd.DataFrame([held, state], columns=names))
                continue
            if held is not None:
                rows.append((*at, *_fields(held, names)))
            at, held = key, state
        if rows:
            yield _frame(rows, schema)
    if held is not None:
        yield _frame([(*at, *_fields(held, names))], schema)


def _same_key(a: tuple, b: tuple) -> bool:
    return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b, strict=True))


def _fields(state: Mapping[str, Any], names: Sequence[str]) -> list[Any]:
    return [state[n] for n in names]


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    """Rows as columns of objects, so that a null makes no float of a column of whole numbers."""
    columns = {}
    for field, values in zip(schema.fields, zip(*rows, strict=True), strict=True):
        whole = isinstance(field.dataType, T.IntegralType)
        columns[field.name] = pd.Series([_whole(x) for x in values] if whole else list(values), dtype=object)
    return pd.DataFrame(columns, columns=schema.names)


def _whole(x: Any) -> Any:
    return None if pd.isna(x) else int(x) if x == int(x) else x


def process_chunks(
    routed: DataFrame,
    step: Callable[[tuple, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: str,
    keys: Sequence[str] = ("dataset", "out_index"),
) -> DataFrame:
    """Run a user's function once per chunk, as one job per output did.

    For functions that are no aggregate. The function gets the key and an iterator of batches, so a chunk larger than
    memory still passes through; the chunk limits bound the work of one task.
    """

    def run(key: Tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from step(key, batches)

    run.__annotations__ = {"key": Tuple[Any, ...], "batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return routed.groupBy(*keys).applyInPandas(run, schema)
