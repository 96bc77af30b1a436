r"""Host-level quality rules.

Every document is measured; rules that it fails are counted per host; each
host's failure rates are shrunk with a beta prior fitted to all hosts by
moments; a host whose shrunk rate passes the limit is rejected, and that verdict
is joined back to its documents.

Hosts are few or many: the rejected ones are broadcast only if a count shows
that they are few. The host totals combine before the shuffle, so a host that
holds a third of the rows costs no more than another.

Defined results
* null text has no words and fails; null hosts form one host of their own;
* a row is judged by itself, so repeated rows get equal verdicts;
* one host, or hosts of equal rates: every rate shrinks to the mean;
* hosts that differ as much as can be, all rates 0 or 1: the prior vanishes, rates stay as they are;
* an empty table gives an empty result; other columns are carried unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchtally.llm.common import documents, let, packed, required, small, text_of, words_of
from batchtally.plans.storage import write_and_read

MIN_WORDS = 20
REPEAT_WINDOW = 8
HOST_LIMIT = 0.5  # shrunk failure rate beyond which a host goes
RATE_UNIT = 10**12  # rates are summed in whole numbers, alike in any order of hosts

#: Rules counted per host, as conditions on the measures.
RULES = {
    "base": "n_words < 20 OR 100 * n_repeat_words > 30 * n_words",
    "symbols": "n_symbols > 2 * n_words",
    "lines": "n_dup_lines > 20 AND 2 * n_dup_lines > n_words",
    "long_words": "n_words > 0 AND word_chars > 30 * n_words",
}


def repeated_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Number of words inside windows that occur twice or more in the text.

    Windows are compared by 64-bit hash. A text without a repeated window, the
    usual case, ends at the comparison of two sizes.
    """
    zero = F.lit(0).cast("bigint")

    def covered(starts: Column) -> Column:
        step = lambda p, i: F.least(F.lit(window), F.coalesce(F.get(starts, i + 1) - p, F.lit(window)))
        return F.aggregate(F.transform(starts, step), zero, lambda s, x: s + x)

    def starts(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda a: F.filter(
            a,
            lambda x, i: F.coalesce(x["h"] == F.get(a, i - 1)["h"], F.lit(False))
            | F.coalesce(x["h"] == F.get(a, i + 1)["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(let(ordered, twice), lambda x: x["i"]))

    def count(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - window)
        hashes = F.transform(at, lambda i: F.xxhash64(F.slice(w, i + 1, window)))
        return let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(let(starts(h), covered)),
        )

    return F.when(F.size(words) > window, count(words)).otherwise(zero)


def measures(text: Column) -> Column:
    """Struct of the measures of a text."""

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        let(words_of(text), of_words).alias("w"),
        let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("bigint")).alias("n_dup_lines"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
    )


def _measured(docs: DataFrame, host: str, *keep: Column) -> DataFrame:
    named = docs.select(*keep, F.col(host).alias("host"), measures(text_of()).alias("m"))
    flat = named.select(*[c for c in named.columns if c != "m"], "m.w.*", "m.n_symbols", "m.n_dup_lines")
    failed = [F.expr(rule).alias(f"failed_{name}") for name, rule in RULES.items()]
    return flat.select("*", *failed)


def beta_prior(hosts: int, total: int, squares: int) -> tuple[float | None, float | None]:
    """Mean and strength from the sums of rates and of their squares, in units; no strength where all rates are equal.

    The strength is 0 where all rates are 0 or 1, and never below.
    """
    spread = hosts * squares - total * total
    mean = total / (hosts * RATE_UNIT) if hosts else None
    return mean, (total * (hosts * RATE_UNIT - total) - spread) / spread if spread else None


def rejected_hosts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Hosts whose shrunk failure rate of any rule passes ``limit``, with the rates."""
    hosts = measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(f"failed_{r}").alias(f"k_{r}") for r in RULES]
    )
    sums = []
    for r in RULES:
        rate = F.round(F.col(f"k_{r}") / F.col("n") * RATE_UNIT).cast("decimal(13,0)")
        sums += [F.sum(rate).alias(f"s_{r}"), F.sum(rate * rate).alias(f"q_{r}")]
    prior = hosts.agg(F.count(F.lit(1)).alias("hosts"), *sums).first()  # one row
    shrunk = {}
    for r in RULES:
        mean, strength = beta_prior(prior["hosts"], int(prior[f"s_{r}"] or 0), int(prior[f"q_{r}"] or 0))
        shrunk[f"rate_{r}"] = (
            F.lit(mean).cast("double")
            if strength is None
            else (F.col(f"k_{r}") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
        )
    over = F.lit(False)
    for name in shrunk:
        over = over | F.coalesce(F.col(name) > limit, F.lit(False))
    return hosts.withColumns(shrunk).filter(over)


def quality_verdicts(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Measures and verdict for every row."""
    required(docs, ["doc_id", "text", host])
    rows = write_and_read(_measured(docs, host, F.col("doc_id")), "measures")
    bad = small(rejected_hosts(rows, limit).select(F.col("host").alias("bad_host")))
    good = rows.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left_anti").withColumn("host_ok", F.lit(True))
    gone = rows.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left_semi").withColumn("host_ok", F.lit(False))
    measured = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return good.unionByName(gone).select(
        *measured,
        F.col("failed_base").alias("base_failed"),
        (~F.col("failed_base") & F.col("host_ok")).alias("kept"),
    )


def keep_good(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows that pass their own rules and whose host passes, with all their columns."""
    required(docs, ["doc_id", "text", host])
    every = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row")
    rows = write_and_read(_measured(docs, host, every), "measured")
    bad = small(rejected_hosts(rows, limit).select(F.col("host").alias("bad_host")))
    good = rows.filter("NOT failed_base").join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left_anti")
    return good.select("row.*")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir))


OP10_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS s
    FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n_repeat_words
    FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM dup) GROUP BY r),
m AS (SELECT w.r, doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN cov ON w.r = cov.r),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols > 2 * n_words AS f2,
    n_dup_lines > 20 AND 2 * n_dup_lines > n_words AS f3, n_words > 0 AND word_chars > 30 * n_words AS f4 FROM m),
rates AS (SELECT host, rule, count(*) AS n, count(*) FILTER (WHERE failed) AS k FROM (
    SELECT host, unnest([1, 2, 3, 4]) AS rule, unnest([base_failed, f2, f3, f4]) AS failed FROM f) GROUP BY host, rule),
prior AS (SELECT rule, avg(k / n) AS mu, var_pop(k / n) AS v FROM rates GROUP BY rule),
bad AS (SELECT DISTINCT host FROM (SELECT host, k, n, mu, CASE WHEN v > 0 THEN greatest(mu * (1 - mu) / v - 1, 0) END AS s
    FROM rates JOIN prior USING (rule)) WHERE CASE WHEN s IS NOT NULL THEN (k + mu * s) / (n + s) ELSE mu END > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.host IS NOT DISTINCT FROM f.host) AS kept
FROM f
"""
