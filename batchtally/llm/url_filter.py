r"""URL filters: host and path rules, word lists, and a Bloom filter cascade for membership.

A URL has few candidate keys: each rule-shaped (host suffix, path prefix), and
the words of its host. The corpus's complete key universe is the distinct
candidate keys of all its URLs. For a list, a cascade of Bloom filters is built
over it: the first level encodes the listed keys of the universe, the second
those other keys that pass the first, the third the listed keys that pass the
second, and so on until no key passes wrongly. A key is listed if the first level
that rejects it is an even one (of 1, 2, ...), or if it passes all of an odd number
of levels. For every key of the universe this is exact, so URLs are judged where
they lie: the levels are literals of the expression, and no URL is joined or moved.

The levels together take a few bits a listed key of the universe. Lists with a
level of more than ``max_bits`` are matched by an equi join of the candidate
keys instead.

Defined results
* host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; path: from there up to ``?``, ``#`` or the
  end; a null URL and one without ``://`` have both empty;
* a rule fits its host and all subdomains if the path starts with its path; the longest fitting rule decides (as long:
  ``block`` before ``allow``, then the smaller text); without one, a listed word in the host blocks, and all else is allowed;
* hosts of rules are compared as given, in lower case; repeated rules count once; rules with a null part are left out;
* repeated rows are judged alike; an empty table gives an empty result; without rules and words all is allowed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchtally.llm.common import let, packed, required
from batchtally.plans.storage import write_and_read

# The base rules (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
# Words that block a host when one stands between its other characters than a-z and 0-9.
HOST_WORDS = "adult bet bets betting bitcoin bonus casino escort gambling jackpot loan loans lottery pharma pharmacy pill pills poker porn replica sex slots torrent viagra xxx".split()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BITS = 1 << 24  # 2 MB a level
RULE_SCHEMA = "host string, path string, verdict string"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_keys(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """The candidate keys of a URL: for each shape (labels, characters) the host's last labels and the path's first characters."""
    if not shapes:
        return F.array().cast("array<string>")
    table = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("chars")) for a, b in shapes])

    def keys(labels: Column) -> Column:
        fits = F.filter(table, lambda s: (s["labels"] <= F.size(labels)) & (s["chars"] <= F.length(path)))
        return F.transform(
            fits,
            lambda s: F.concat(
                F.array_join(F.slice(labels, F.size(labels) - s["labels"] + 1, s["labels"]), "."),
                F.substring(path, F.lit(1), s["chars"]),
            ),
        )

    return let(F.split(host, r"\."), keys)


def host_words(host: Column) -> Column:
    """Distinct words of a host, marked so that they differ from every rule key."""
    words = F.array_distinct(F.array_remove(F.split(host, "[^a-z0-9]+"), ""))
    return F.transform(words, lambda w: F.concat(F.lit(" "), w))


def _position(key: Column, level: int, probe: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(probe)), F.lit(bits))


def _level(keys: DataFrame, level: int, bits: int, probes: int) -> Column:
    """The bits of a level as an array of longs, a literal that Spark folds when it plans; at most ``max_bits`` are collected."""
    at = F.explode(F.array(*[_position(F.col("key"), level, i, bits) for i in range(probes)]))
    set_bits = keys.select(at.alias("p")).select(F.shiftright("p", 6).alias("i"), F.expr("shiftleft(1L, int(p % 64))").alias("b"))
    words = [0] * (bits // 64)
    for r in set_bits.groupBy("i").agg(F.bit_or("b").alias("w")).collect():
        words[r["i"]] = r["w"]
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def _passes(key: Column, words: Column, level: int, bits: int, probes: int) -> Column:
    found = F.lit(True)
    for i in range(probes):
        p = _position(key, level, i, bits)
        found = found & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1)
    return found


class Cascade:
    """Levels of Bloom filters (words, bits, probes); ``member`` is exact for the keys of the universe it was built over."""

    def __init__(self, levels: list[tuple[Column, int, int]]):
        self.levels = levels

    def member(self, key: Column) -> Column:
        verdict = F.lit(len(self.levels) % 2 == 1)
        for n, (words, bits, probes) in reversed(list(enumerate(self.levels))):
            verdict = F.when(~_passes(key, words, n, bits, probes), F.lit(n % 2 == 1)).otherwise(verdict)
        return verdict


def _bits(n: int, rate: float) -> int:
    """Bits for ``n`` keys at a false-positive rate, in whole longs."""
    return 64 * max(1, math.ceil(n * math.log2(1 / rate) / math.log(2) / 64))


def build_cascade(universe: DataFrame, listed: DataFrame, max_bits: int = MAX_BITS) -> Cascade | None:
    """The cascade of ``listed`` keys over the distinct keys ``universe``; None where a level would pass ``max_bits``."""
    inside = write_and_read(universe.join(listed, "key", "left_semi"), "listed")
    outside = write_and_read(universe.join(listed, "key", "left_anti"), "others")
    n_in, n_out = inside.count(), outside.count()
    # as many false positives of the first level as listed keys by the square root of one half, then halves
    rate = min(0.5, max(math.sqrt(0.5) * n_in / max(n_out, 1), 2.0**-30))
    levels: list[tuple[DataFrame, int, int]] = []
    while n_in:
        probes = max(1, round(math.log2(1 / rate)))
        bits = _bits(n_in, rate)
        if bits > max_bits:
            return None
        words = _level(inside, len(levels), bits, probes)
        levels.append((words, bits, probes))
        passed = outside.filter(_passes(F.col("key"), words, len(levels) - 1, bits, probes))
        inside, outside = write_and_read(passed, "false"), inside
        n_in, rate = inside.count(), 0.5
    return Cascade(levels)


def judged(
    pages: DataFrame, rules: DataFrame, words: Sequence[str] = (), *, url: str = "url", max_bits: int = MAX_BITS
) -> DataFrame:
    """All columns of ``pages`` as ``row``, with host, path, rule and verdict; ``rules`` holds host, path and verdict.

    ``rules`` may be long; its distinct shapes (number of labels, length of the path) are collected, at most 64 x 2048.
    """
    required(pages, [url])
    spark = pages.sparkSession
    clean = rules.dropna(subset=["host", "path", "verdict"]).select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    listed = write_and_read(
        clean.select(
            F.concat("host", "path").alias("key"),
            F.size(F.split("host", r"\.")).alias("labels"),
            F.length("path").alias("chars"),
            F.col("verdict") == "block",
        ).toDF("key", "labels", "chars", "blocks"),
        "rules",
    )
    shapes = [tuple(r) for r in listed.filter("labels <= 64 and chars <= 2048").select("labels", "chars").distinct().collect()]
    if listed.filter("labels > 64 or chars > 2048").limit(1).count():
        raise ValueError("rules have at most 64 labels and paths of at most 2048 characters")
    shapes.sort()
    host, path = split_url(F.col(url))
    named = packed(pages, host.alias("host"), path.alias("path"))
    urls = named.select("row", "host", "path", rule_keys(F.col("host"), F.col("path"), shapes).alias("keys"), host_words(F.col("host")).alias("words"))
    universe = write_and_read(urls.select(F.explode(F.concat("keys", "words")).alias("key")).distinct(), "universe")
    marked = spark.createDataFrame([(f" {w}",) for w in dict.fromkeys(words)], "key string")
    blocks = listed.filter("blocks").select("key").distinct().unionByName(marked)
    allows = listed.filter("not blocks").select("key").distinct()
    cascades = [build_cascade(universe, keys, max_bits) for keys in (blocks, allows)]
    if None in cascades:
        found = _by_join(urls, blocks, allows)
    else:
        block, allow = cascades
        found = urls.select(
            "row", "host", "path",
            F.filter("keys", block.member).alias("blocking"),
            F.filter("keys", allow.member).alias("allowing"),
            F.exists("words", block.member).alias("bad_host"),
        )
    # in order: the longest, of equal length those that block
    fit = lambda verdict: lambda k: F.struct((-F.length(k)).alias("n"), F.lit(verdict == "allow").alias("late"), k.alias("k"), F.lit(verdict).alias("d"))
    fits = F.concat(F.transform("blocking", fit("block")), F.transform("allowing", fit("allow")))
    best = F.get(F.array_sort(fits), F.lit(0))
    picked = found.select("row", "host", "path", "bad_host", best.alias("best"))
    verdict = F.coalesce(F.col("best.d"), F.when(F.col("bad_host"), F.lit("block")).otherwise(F.lit("allow")))
    return picked.select("row", "host", "path", F.col("best.k").alias("rule"), verdict.alias("verdict"))


def _by_join(urls: DataFrame, blocks: DataFrame, allows: DataFrame) -> DataFrame:
    """The matched keys of each row by an equi join, for lists beyond the bound of the cascade."""
    rows = write_and_read(urls.withColumn("row_id", F.monotonically_increasing_id()), "urls")
    keys = rows.select("row_id", F.explode(F.concat("keys", "words")).alias("key"))
    listed = blocks.select("key", F.lit(True).alias("b")).unionByName(allows.select("key", F.lit(False).alias("b")))
    hits = keys.join(listed, "key").groupBy("row_id").agg(F.collect_set(F.struct("key", "b")).alias("hits"))
    of = lambda blocking: F.transform(F.filter("hits", lambda h: (h["b"] == blocking) & ~F.startswith(h["key"], F.lit(" "))), lambda h: h["key"])
    none = F.array().cast("array<string>")
    return rows.join(hits, "row_id", "left").select(
        "row", "host", "path",
        F.coalesce(of(True), none).alias("blocking"),
        F.coalesce(of(False), none).alias("allowing"),
        F.coalesce(F.exists("hits", lambda h: F.startswith(h["key"], F.lit(" "))), F.lit(False)).alias("bad_host"),
    )


def kept_pages(pages: DataFrame, rules: DataFrame, words: Sequence[str] = (), *, url: str = "url") -> DataFrame:
    """The allowed rows, with their own columns."""
    return judged(pages, rules, words, url=url).filter("verdict = 'allow'").select("row.*")


def op12_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    return judged(pages, rules, HOST_WORDS).select("row.page_id", "host", "path", "rule", "verdict")


OP12_SQL = rf"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
u AS (
  SELECT page_id, row_number() OVER () AS id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
fits AS (
  SELECT p.id, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.id ORDER BY length(r.host || r.path) DESC, r.verdict DESC, r.host || r.path) AS place
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, f.rule, coalesce(f.verdict,
    CASE WHEN list_has_any(regexp_split_to_array(host, '[^a-z0-9]+'), {HOST_WORDS}) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN (SELECT * FROM fits WHERE place = 1) f USING (id)
"""
