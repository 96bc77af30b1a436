r"""Phrase collocation mining: Misra-Gries summaries per hash partition, then an exact count of the survivors.

Phrases are the n-grams of 1 to 4 words within a piece of text; the score of
a phrase compares how often it occurs with how often its parts do. A
phrase that occurs ``least`` times has no part that occurs less, so only frequent
n-grams matter, and there are at most mass / ``least`` of them.

1. Tasks hash the n-grams of their documents and deal them into slots by the
   leading bits of the hash. What leaves a task is a mergeable summary of each
   slot: the other bits with their counts. A slot's summaries are merged into one of
   Misra-Gries with more counters than the slot's mass divided by ``least``, so
   its error stays below ``least`` and no frequent n-gram is lost. Hashes that
   collide only add up. The slot's survivors become bits of a filter.
2. Tasks read the documents again, take the n-grams that pass the filter, and
   count them by their words; Spark adds the counts and keeps the frequent ones.
   False survivors go here, so results are exact.

The filters take 64 bits a survivor, 32 MB together at most, and are broadcast;
slots whose share of that is used up pass more n-grams to the exact count, which stays right
and shuffles more. Slots grow in number with the bytes of the texts, so that one
of them, its summary and its hashes have a bounded size.

Defined results
* null text counts as empty, a null language as ``und``; A-Z are lowered, nothing else;
* repeated rows count each time; ties in score go by count, then by phrase in byte order;
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from batchtally.llm.common import documents, required
from batchtally.plans.storage import write_and_read

LEAST, LONGEST, SHOWN, COVER = 30, 4, 2000, 80
SCALE = 2_000_000
BLOCK = 1 << 19  # words a task works on at a time; longer texts are cut into blocks that overlap
VOCABULARY = 1 << 18  # words after which a task starts a new numbering
AT_ONCE = 1 << 16  # n-grams that are looked up or written out at a time
SLOT_BYTES = 64 << 20  # of text for a slot
LEAST_SLOTS = 64
FILTER_BITS = 1 << 28  # of all slots
ROW = 1024  # hashes in a row of a summary

# one byte for every boundary of pieces; it does not occur in UTF-8
BREAK = b"\xff"
_FROM = bytes(range(65, 91)) + b".,;:!?\x0a\x0b\x0c\x0d\x09"
_TO = bytes(range(97, 123)) + b"\n" * 10 + b" "
TABLE = bytes.maketrans(_FROM, _TO)


def words_and_breaks(text: str) -> list[bytes]:
    """The words of a text, with ``BREAK`` between pieces."""
    return text.encode().translate(TABLE).replace(b"\n", b" " + BREAK + b" ").split(b" ")


class Words(dict):
    """Numbers words as they come; the break is 0, the empty word between two spaces is -1."""

    def __init__(self):
        super().__init__({BREAK: 0, b"": -1})
        self.words, self.hashes = [BREAK], array("Q", [0])

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


class Block:
    """Some texts as numbers of words, with the hashes of their n-grams."""

    def __init__(self, ids: np.ndarray, langs: np.ndarray, names: list[str], words: Words, skip: np.ndarray):
        self.ids, self.langs, self.names, self.words = ids, langs, names, words
        self.own = ~skip  # places whose n-grams have not been seen in the block before

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """n, the places where an n-gram starts, and its hashes."""
        hashes = np.array(self.words.hashes, dtype=np.uint64)[self.ids]  # a copy: a view would forbid the array to grow
        seeds = np.array([xxhash.xxh64_intdigest(x, 1) for x in self.names], dtype=np.uint64)
        h, ok = seeds[self.langs], self.own.copy()
        for n in range(1, LONGEST + 1):
            m = len(self.ids) - n + 1
            if m <= 0:
                return
            ok = ok[:m] & (self.ids[n - 1 :] != 0)
            h = _mix(h[:m] + hashes[n - 1 :])
            at = np.flatnonzero(ok)
            yield n, at, h[at]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of about ``BLOCK`` words; every n-gram within a piece of a text starts in exactly one of them."""
    words, parts, langs, skips, names, held = Words(), [], [], [], {}, 0

    def block() -> Block:
        sizes = [len(p) for p in parts]
        of = np.repeat(np.array(langs, dtype=np.int64), sizes)
        return Block(np.concatenate(parts), of, list(names), words, np.concatenate(skips))

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tokens = words_and_breaks(text.as_py() or "")
            lang = "und" if lang is None else lang
            for start in range(0, len(tokens), BLOCK):
                # the places after a cut whose n-grams belong to the next stretch are read, not counted
                ids = np.fromiter(map(words.__getitem__, tokens[start : start + BLOCK]), dtype=np.int64)
                ids = ids[ids >= 0]
                tail = np.zeros(0, dtype=np.int64)
                if start + BLOCK < len(tokens):
                    more = _next_words(tokens, start + BLOCK)
                    tail = np.fromiter(map(words.__getitem__, more), dtype=np.int64, count=len(more))
                ids_all = np.concatenate([ids, tail, np.zeros(1, dtype=np.int64)])
                skip = np.ones(len(ids_all), dtype=bool)
                skip[: len(ids)] = ids == 0
                parts.append(ids_all)
                skips.append(skip)
                langs.append(names.setdefault(lang, len(names)))
                held += len(ids_all)
                if held >= BLOCK:
                    yield block()
                    parts, langs, skips, names, held = [], [], [], {}, 0
                    if len(words.words) > VOCABULARY:
                        words = Words()
    if parts:
        yield block()


def _next_words(tokens: list[bytes], at: int) -> list[bytes]:
    """The words that n-grams starting before ``at`` may reach."""
    found: list[bytes] = []
    while at < len(tokens) and len(found) < LONGEST - 1:
        if tokens[at]:
            found.append(tokens[at])
        at += 1
    return found


SUMMARY = "slot int, late boolean, mass long, hashes binary, counts binary"


def summaries(docs: DataFrame, slots: int) -> DataFrame:
    """Summaries of the blocks, by slot; of each slot first its mass, in a row of its own."""
    bits = slots.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            for _, _, found in block.grams():  # equal n-grams have one n, so each n is summed up by itself
                if len(found):
                    yield from summary(found)

    def summary(h: np.ndarray) -> Iterator[pa.RecordBatch]:
        h.sort()
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff(first, append=len(h)).astype(np.uint32)
        h = h[first]
        of = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), dtype=np.int64)
        rest = (h << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
        ends = np.searchsorted(of, np.arange(slots + 1))
        rows: list[tuple] = []
        for s in np.flatnonzero(np.diff(ends)):
            low, high = ends[s], ends[s + 1]
            rows.append((int(s), False, int(n[low:high].sum(dtype=np.int64)), b"", b""))
            for at in range(low, high, ROW):
                to = min(at + ROW, high)
                rows.append((int(s), True, 0, rest[at:to].tobytes(), n[at:to].tobytes()))
            if len(rows) >= 256:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SUMMARY_TYPES, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["slot", "late", "mass", "hashes", "counts"])

    return docs.select("lang", "text").mapInArrow(run, SUMMARY)


SUMMARY_TYPES = [pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]


class MisraGries:
    """Counters for all keys that may weigh ``least`` or more in a known mass; summaries are merged as they come."""

    def __init__(self, mass: int, least: int):
        self.capacity, self.least = mass // least + 1, least
        self.keys, self.counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        self.error, self.waiting, self.n_waiting = 0, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting >= max(self.capacity, 1 << 16):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.n_waiting = [], 0
        if not len(keys):
            return
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        if len(keys) > self.capacity:
            # each of the counters above capacity + 1 loses what the next one holds
            cut = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.error += cut
            keep = counts > cut
            keys, counts = keys[keep], counts[keep] - cut
        self.keys, self.counts = keys, counts

    def survivors(self) -> np.ndarray:
        self.merge()
        return self.keys[self.counts + self.error >= self.least]


def _probes(rest: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint32(32 - (bits.bit_length() - 1))
    return rest >> shift, (rest * np.uint32(0x9E3779B1)) >> shift


def slot_filter(survivors: np.ndarray, most: int) -> np.ndarray:
    """A bit array (bytes) in which two bits stand for each survivor; a power of two of bits, at most ``most``."""
    bits = min(1 << max(6, (64 * max(len(survivors), 1) - 1).bit_length()), most)
    out = np.zeros(bits, dtype=bool)
    for at in _probes(survivors, bits):
        out[at] = True
    return np.packbits(out, bitorder="little")


def filters(parts: DataFrame, slots: int, least: int) -> dict[int, bytes]:
    """The filter of every slot that has survivors, at most ``FILTER_BITS`` bits together."""
    most = min(max(64, FILTER_BITS // slots), 1 << 31)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, mass, summary = None, 0, None

        def done() -> Iterator[pa.RecordBatch]:
            if summary is not None:
                left = summary.survivors()
                if len(left):
                    yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([slot_filter(left, most).tobytes()])], ["slot", "bits"])

        for b in batches:
            for s, late, m, h, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if s != slot:
                    yield from done()
                    slot, mass, summary = s, 0, None
                if not late:
                    mass += m
                    continue
                if summary is None:
                    summary = MisraGries(mass, least)
                summary.add(np.frombuffer(h, dtype=np.uint32), np.frombuffer(n, dtype=np.uint32).astype(np.int64))
        yield from done()

    dealt = parts.repartition(slots, "slot").sortWithinPartitions("slot", "late")
    return {r["slot"]: bytes(r["bits"]) for r in dealt.mapInArrow(run, "slot int, bits binary").collect()}


class Filter:
    """The filters of all slots as one array of bytes."""

    def __init__(self, slots: int, bits: dict[int, bytes]):
        self.slot_bits = slots.bit_length() - 1
        self.start, self.shift = np.zeros(slots, dtype=np.int64), np.full(slots, 32, dtype=np.uint32)
        at, parts = 8, [bytes(8)]  # slots without survivors point at zeros
        for s, b in sorted(bits.items()):
            self.start[s], self.shift[s] = 8 * at, 32 - ((8 * len(b)).bit_length() - 1)
            parts.append(b)
            at += len(b)
        self.bits = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def passes(self, h: np.ndarray) -> np.ndarray:
        s = (h >> np.uint64(64 - self.slot_bits)).astype(np.int64) if self.slot_bits else np.zeros(len(h), dtype=np.int64)
        rest = (h << np.uint64(self.slot_bits) >> np.uint64(32)).astype(np.uint32)
        start, shift = self.start[s], self.shift[s].astype(np.uint64)
        found = start > 0
        for x in (rest, rest * np.uint32(0x9E3779B1)):
            at = start + np.where(found, (x.astype(np.uint64) >> shift).astype(np.int64), 0)
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def _exact(block: Block, n: int, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place for each distinct n-gram that starts at ``at``, and its count; equal hashes are told apart by their words."""
    order = np.argsort(h, kind="stable")
    at, h = at[order], h[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
    for k in range(n):
        x = block.ids[at + k]
        new[1:] |= x[1:] != x[:-1]
    new[1:] |= block.langs[at[1:]] != block.langs[at[:-1]]
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at)))


COUNTS = "lang string, n int, phrase string, count long"


def survivor_counts(docs: DataFrame, passes: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Counts of the blocks: of each language's words (n = 0), and of the n-grams that pass. A run of equal n-grams counts at once; what it adds up to is left to Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            for n, at, h in block.grams():
                if n == 1:
                    of = np.bincount(block.langs[at], minlength=len(block.names))
                    yield _counts(block.names, 0, [b""] * len(of), of)
                keep = np.concatenate([passes(h[i : i + AT_ONCE]) for i in range(0, max(len(h), 1), AT_ONCE)])
                if keep.any():
                    places, counts = _exact(block, n, at[keep], h[keep])
                    for i in range(0, len(places), AT_ONCE):
                        place, count = places[i : i + AT_ONCE], counts[i : i + AT_ONCE]
                        words, ids = block.words.words, [block.ids[place + k].tolist() for k in range(n)]
                        phrase = [b" ".join([words[i] for i in x]) for x in zip(*ids, strict=True)]
                        yield _counts([block.names[i] for i in block.langs[place].tolist()], n, phrase, count)

    def _counts(langs, n, phrases, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(np.full(len(langs), n, dtype=np.int32)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())],
            ["lang", "n", "phrase", "count"],
        )

    return docs.select("lang", "text").mapInArrow(run, COUNTS)


def slots_for(docs: DataFrame) -> int:
    """A power of two that grows with the bytes of the texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 << max(LEAST_SLOTS - 1, int(size) // SLOT_BYTES).bit_length()


def frequent_ngrams(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, n, phrase and exact count of every n-gram of at least ``least`` occurrences; with n = 0 each language's words."""
    required(docs, ["lang", "text"])
    slots = slots_for(docs)
    found = Filter(slots, filters(summaries(docs, slots), slots, least))
    shared = docs.sparkSession.sparkContext.broadcast(found)
    counts = survivor_counts(docs, lambda h: shared.value.passes(h))
    total = counts.groupBy("lang", "n", "phrase").agg(F.sum("count").alias("count"))
    return write_and_read(total.filter((F.col("n") == 0) | (F.col("count") >= least)), "ngrams")


def scored(ngrams: DataFrame) -> DataFrame:
    """Every phrase of two words or more with its weakest cut: lang, phrase, a, l, r, n, score."""
    of = ngrams.filter("n > 0").select("lang", "phrase", F.col("count").alias("part"))
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k")
    cuts = ngrams.filter("n > 1").select("lang", "phrase", F.col("count").alias("a"), words.alias("words"), cut)
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("rest"),
    )
    both = cuts.join(of.select("lang", F.col("phrase").alias("first"), F.col("part").alias("l")), ["lang", "first"]).join(
        of.select("lang", F.col("phrase").alias("rest"), F.col("part").alias("r")), ["lang", "rest"]
    )
    score = F.expr(f"(cast(a as decimal(19,0)) * cast({SCALE} as decimal(7,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    weakest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
    total = ngrams.filter("n = 0").select("lang", F.col("count").alias("n"))
    return weakest.join(F.broadcast(total) if total.limit(1001).count() <= 1000 else total, "lang").select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")


def maximal(ngrams: DataFrame, phrases: DataFrame, cover: int = COVER) -> DataFrame:
    """``phrases`` without those that stand, in ``cover`` of a hundred of their places or more, inside one longer phrase."""
    words = F.split("phrase", " ")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size("words") - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " ")),
        )
    )
    longer = ngrams.filter("n > 2").select("lang", "count", words.alias("words")).select("lang", "count", F.explode(F.array_distinct(inner)).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("count").alias("longest"))
    covered = F.col("longest").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * cover
    return phrases.join(most, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False))).drop("longest")


def collocations(docs: DataFrame, *, least: int = LEAST, shown: int = SHOWN, cover: int = COVER) -> DataFrame:
    """The best ``shown`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    ngrams = frequent_ngrams(docs, least)
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = maximal(ngrams, scored(ngrams), cover).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= shown)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP11_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
f AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS a FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
    FROM w, (VALUES (1), (2), (3), (4)) AS t(m) WHERE len(w) >= m)
  GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND a >= {LEAST}),
split AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM cand, (VALUES (1), (2), (3)) AS t(k) WHERE k < m),
heads AS MATERIALIZED (SELECT s.*, f.a AS l FROM split s JOIN f ON f.lang = s.lang AND f.phrase = s.head),
cuts AS MATERIALIZED (
  SELECT h.*, f.a AS r, (h.a::HUGEINT * {SCALE} // (l + f.a))::BIGINT AS score FROM heads h JOIN f ON f.lang = h.lang AND f.phrase = h.tail),
s AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longest
  FROM cand, (VALUES (2), (3)) AS t(k), (VALUES (1), (2), (3)) AS p(i) WHERE k < m AND i + k - 1 <= m GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n, score
FROM s JOIN totals USING (lang) LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
WHERE i.longest IS NULL OR 100 * i.longest < {COVER} * a
QUALIFY rank <= {SHOWN}
"""
