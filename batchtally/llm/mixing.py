r"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent between 0 (all equal) and 1
(as they are) and normalised. The exponent is found by bisection: the lowest that
keeps every source within a number of repetitions, or the one whose weights have
a wanted entropy. Each source then gets its part of the token budget: its
documents are split into blocks, and every epoch is a new permutation of the
blocks; epochs are taken whole, the last one up to the budget, where the block
on the border is cut between two documents.

Only the totals per source reach the driver. Blocks are numbered by a hash of the
id, so a source that holds a third of the rows is spread over ``BLOCKS`` groups.

Defined results
* null text has no tokens; null sources are one source of their own;
* a source without tokens has weight 0 and gives no rows;
* repeated rows lie in the same block and are taken or left together;
* an empty table gives an empty result; other columns are carried by ``mixed_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from batchtally.llm.common import WORD, documents, packed, required, small, text_of
from batchtally.plans.storage import write_and_read

BLOCKS = 1024
MAX_REPEATS = 2.0
SEED = 17


def tempered(tokens: list[int], exponent: float) -> list[float]:
    """Weights from token shares raised to ``exponent``; sources without tokens get none."""
    total = sum(tokens)
    raised = [(t / total) ** exponent if t else 0.0 for t in tokens]
    return [x / sum(raised) for x in raised]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w)


def _bisect(holds, steps: int = 60) -> float:
    """Smallest exponent in 0 to 1 from which on ``holds`` is true; 1 if there is none."""
    if holds(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if holds(mid) else (mid, high)
    return high


def exponent_for_repeats(tokens: list[int], budget: int, most: float = MAX_REPEATS) -> float:
    """The flattest mix in which no source is read more than ``most`` times."""
    fits = lambda e: all(w * budget <= most * t for w, t in zip(tempered(tokens, e), tokens, strict=True))
    return _bisect(fits)


def exponent_for_entropy(tokens: list[int], target: float) -> float:
    """Entropy falls as the exponent grows; the smallest exponent at or below the target."""
    return _bisect(lambda e: entropy(tempered(tokens, e)) <= target)


def _block(source: Column, doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(source, doc_id, F.lit(SEED)), F.lit(BLOCKS)).cast("int")


def _rank(doc_id: Column, epoch: Column) -> Column:
    """Order of the documents inside the block on the border."""
    return F.xxhash64(doc_id, epoch, F.lit(SEED + 1))


def token_counts(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        "source",
        _block(F.col("source"), F.col("doc_id")).alias("block"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("bigint").alias("tokens"),
    )


def source_budgets(rows: DataFrame, budget: int | None, most: float, target_entropy: float | None) -> list[tuple]:
    """(source, tokens, weight, budget) of every source with tokens."""
    sums = rows.groupBy("source").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0").collect()
    sums = sorted(((r["source"], r["tokens"]) for r in sums), key=lambda x: (x[0] is not None, str(x[0])))
    tokens = [t for _, t in sums]
    if not tokens:
        return []
    budget = budget or sum(tokens)
    e = exponent_for_repeats(tokens, budget, most) if target_entropy is None else exponent_for_entropy(tokens, target_entropy)
    return [(s, t, w, int(w * budget)) for (s, t), w in zip(sums, tempered(tokens, e), strict=True)]


def mixing_plan(
    docs: DataFrame, *, budget: int | None = None, most: float = MAX_REPEATS, target_entropy: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """The counted rows, and per (source, epoch, block) what is read.

    The plan has the block's place in its epoch (``place``) and, on the border, the
    last document that is read (``cut_rank``, ``cut_id``). The budget defaults to all
    tokens; ``most`` bounds how often a document is read unless an entropy is asked for.
    """
    spark = docs.sparkSession
    rows = write_and_read(token_counts(docs), "tokens")
    schema = f"source {rows.schema['source'].dataType.simpleString()}, source_tokens bigint, weight double, source_budget bigint"
    sources = small(spark.createDataFrame(source_budgets(rows, budget, most, target_entropy), schema))
    blocks = rows.groupBy(F.col("source").alias("s"), "block").agg(F.sum("tokens").alias("block_tokens"))
    epochs = F.sequence(F.lit(0), F.floor((F.col("source_budget") - 1) / F.col("source_tokens")).cast("int"))
    drawn = (
        blocks.join(sources.filter("source_budget > 0"), F.col("s").eqNullSafe(F.col("source")))
        .select("source", "weight", "source_tokens", "source_budget", "block", "block_tokens", F.explode(epochs).alias("epoch"))
        .withColumn("shuffle", F.xxhash64("epoch", "block", F.lit(SEED)))
    )
    epoch = W.partitionBy("source", "epoch").orderBy("shuffle", "block")
    plan = drawn.withColumns(
        {
            "place": F.row_number().over(epoch) - 1,
            "upto": F.col("epoch") * F.col("source_tokens") + F.sum("block_tokens").over(epoch.rowsBetween(W.unboundedPreceding, 0)),
        }
    ).withColumn("room", F.col("source_budget") - (F.col("upto") - F.col("block_tokens")))
    plan = write_and_read(plan.filter("room > 0").drop("shuffle", "upto", "source_tokens", "source_budget"), "blocks")

    border = small(plan.filter("room < block_tokens").select("source", "epoch", "block", "room"))
    inside = (
        rows.join(
            border.withColumnsRenamed({"source": "s", "block": "b"}),
            F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")),
        )
        .withColumn("rank", _rank(F.col("doc_id"), F.col("epoch")))
        .groupBy("source", "epoch", "block", "room", "rank", "doc_id")
        .agg(F.sum("tokens").alias("tokens"))
    )
    order = W.partitionBy("source", "epoch").orderBy("rank", F.asc_nulls_first("doc_id"))
    cut = (
        inside.withColumn("sum", F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .filter("sum <= room")
        .groupBy("source", "epoch", "block")
        .agg(F.max(F.struct("rank", "doc_id")).alias("last"))
        .select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("block").alias("b"), "last")
    )
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("block") == F.col("b"))
    full = plan.join(small(write_and_read(cut, "cuts")), same, "left").select(
        "source", "weight", "epoch", "block", "place", (F.col("room") < F.col("block_tokens")).alias("on_border"), "last"
    )
    return rows, write_and_read(full, "mix")


def _chosen(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of ``rows`` (doc_id, source, block, ...) once per epoch that reads them."""
    p = small(plan.withColumnsRenamed({"source": "s", "block": "b"}))
    both = rows.join(p, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    here = F.struct(_rank(F.col("doc_id"), F.col("epoch")).alias("rank"), F.col("doc_id"))
    return both.filter(~F.col("on_border") | F.coalesce(here <= F.col("last"), F.lit(False)))


def mixed_ids(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, epoch, place (of the block in its epoch), block, tokens and weight for every reading of a row."""
    required(docs, ["doc_id", "text", "source"])
    rows, plan = mixing_plan(docs, **options)
    return _chosen(rows, plan).select("doc_id", "source", "epoch", "place", "block", "tokens", "weight")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``, a row once per reading."""
    required(docs, ["doc_id", "text", "source"])
    _, plan = mixing_plan(docs, **options)
    id_, source = F.col("doc_id"), F.col("source")
    rows = packed(docs, id_, source, _block(source, id_).alias("block"))
    return _chosen(rows, plan).select("row.*")


def op9_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed_ids(documents(spark, sf_dir))
