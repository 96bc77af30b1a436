"""Exact deduplication with a heavy-hitter split.

Digests that repeat very often would meet in one task each when rows are dealt
by digest. So a Misra-Gries summary first finds the frequent digests in one pass
with bounded memory (``approx_top_k`` keeps the counters of the Misra-Gries
family in a mergeable sketch). Their exact winners come from one aggregate that
combines before the shuffle; the winners, at most ``tracked`` rows, are
broadcast, and the copies leave on the map side. All other digests, none of
which can be frequent, take an ordinary shuffle and a window.

Defined results
* null text counts as empty; two such rows are copies of each other;
* of equal texts the one with the most code points stays, then the smallest
  doc_id (null ids last); of rows equal in both, exactly one stays;
* an empty table gives an empty result; other columns are carried unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from batchtally.llm.common import SPACE, documents, packed, required, text_of
from batchtally.plans.storage import write_and_read

TRACKED = 10_000  # counters of the summary; also the most winners that are broadcast


def digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(text, SPACE, ""), 256)


def frequent(rows: DataFrame, column: str, tracked: int = TRACKED) -> DataFrame:
    """Values of ``column`` that a Misra-Gries summary holds as frequent, at most ``tracked`` rows."""
    hashed = rows.select(F.xxhash64(column).alias("h"))
    top = hashed.agg(F.expr(f"approx_top_k(h, {tracked}, {tracked})").alias("t"))
    return top.select(F.explode("t.item").alias("h"))


def _order(n: Column, doc_id: Column, *more: Column) -> Column:
    """Smallest for the row that stays."""
    return F.struct((-n).alias("a"), doc_id.isNull().alias("b"), doc_id.alias("c"), *more)


def exact_copies(docs: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """A verdict for every row: doc_id, keep_id, group_size, kept, text_sha256."""
    required(docs, ["doc_id", "text"])
    rows = write_and_read(
        docs.select(
            "doc_id",
            digest(text_of()).alias("text_sha256"),
            F.char_length(text_of()).alias("n"),
            F.monotonically_increasing_id().alias("row_id"),
        ),
        "digests",
    )
    place = _order(F.col("n"), F.col("doc_id"), F.col("row_id"))
    candidates = F.broadcast(frequent(rows, "text_sha256", tracked))
    found = rows.withColumn("h", F.xxhash64("text_sha256")).join(candidates, "h", "left_semi")
    winners = (
        found.groupBy("text_sha256")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(place).alias("best"))
        .select("text_sha256", "group_size", F.col("best.c").alias("keep_id"), F.col("best.row_id").alias("keep_row"))
    )
    # stored, so that both branches below see the same winners
    winners = F.broadcast(write_and_read(winners, "winners"))
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    hot = rows.join(winners, "text_sha256").withColumn("kept", F.col("row_id") == F.col("keep_row"))
    group = W.partitionBy("text_sha256")
    ordered = group.orderBy(F.desc("n"), F.asc_nulls_last("doc_id"), F.asc("row_id"))
    rest = rows.join(winners.select("text_sha256"), "text_sha256", "left_anti").withColumns(
        {
            "keep_id": F.first("doc_id").over(ordered),
            "group_size": F.count(F.lit(1)).over(group),
            "kept": F.row_number().over(ordered) == 1,
        }
    )
    return hot.select(*out).unionByName(rest.select(*out))


def drop_exact_copies(docs: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """The rows that stay, with all their columns."""
    required(docs, ["doc_id", "text"])
    rows = packed(docs, digest(text_of()).alias("d"), _order(F.char_length(text_of()), F.col("doc_id")).alias("o"))
    # stored, so that both branches below see the same digests
    hot = F.broadcast(write_and_read(frequent(rows, "d", tracked), "frequent"))
    marked = rows.withColumn("h", F.xxhash64("d"))
    winners = marked.join(hot, "h", "left_semi").groupBy("d").agg(F.min_by("row", "o").alias("row"))
    rest = marked.join(hot, "h", "left_anti").withColumn("p", F.row_number().over(W.partitionBy("d").orderBy("o"))).filter("p = 1")
    return winners.select("row.*").unionByName(rest.select("row.*"))


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_copies(documents(spark, sf_dir))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER o AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER o = 1 AS kept, text_sha256
FROM d WINDOW o AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
