r"""Near-duplicate detection: SimHash fingerprints, generalised pigeonhole search.

Fingerprints within 3 differing bits are linked. If the 64 bits fall into
partitions whose thresholds sum up to 3 - m + 1, then two linked fingerprints
differ in some partition by no more than its threshold (general pigeonhole
principle). Bits that are set together are grouped into one partition. For two
and three partitions the number of candidates is estimated from counts over
all fingerprints, and a dynamic programme allocates the thresholds that cost
least; the cheapest layout is probed, and every candidate is verified.

Texts that are equal meet as one fingerprint before the search, so copies make no
pairs. Probes enumerate the flips of a partition, the index holds every
fingerprint; the join verifies the distance, so only true links leave it.

Defined results
* null or empty text, or one of white space only, has fingerprint zero and is linked like any other;
* fewer words than a shingle: the whole sequence is the only shingle;
* repeated rows share fingerprint and component; null ids take part, but name no component
  unless all ids of it are null;
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchtally.llm.common import documents, required
from batchtally.llm.components import components
from batchtally.plans.storage import write_and_read

DISTANCE = 3
SHINGLE = 3
SEED = 42
PARTS = (2, 3)  # of 32 or about 21 bits; narrower ones have too few values to tell many fingerprints apart
PROBE_COST, CANDIDATE_COST = 1.0, 8.0


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of a text as an unsigned number."""
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z, splits at ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(size)])) if len(words) >= size else iter([b" ".join(words)])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64, count=n)
    return int(np.packbits(2 * _bit_counts(hashes) > n, bitorder="little").view(np.uint64)[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([_signed(fingerprint(t.as_py())) for t in b.column(1)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    rows = docs.select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())])
    return rows.mapInArrow(run, schema)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how often both are set; 4097 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64))
        for b in batches:
            x = b.column(0).to_numpy().astype(np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(bits), both + bits.T @ bits
        if n:
            sums = np.append(both.astype(np.int64).ravel(), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(sums)], ["i", "n"])

    sums = fps.select("fp").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(4097, dtype=np.int64)
    for r in sums:
        out[r["i"]] = r["n"]
    return int(out[4096]), out[:4096].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[int]:
    """Masks of partitions of near equal width; each starts at the free bit of most correlation and takes its closest bits."""
    p = np.diag(both) / max(n, 1)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(var, var))
    np.fill_diagonal(corr, 0)
    free, masks = list(range(64)), []
    for width in [64 // parts + (i < 64 % parts) for i in range(parts)]:
        chosen = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(chosen[0])
        while len(chosen) < width:
            nearest = max(free, key=lambda b: (corr[b, chosen].sum(), -b))
            chosen.append(nearest)
            free.remove(nearest)
        masks.append(sum(1 << b for b in chosen))
    return masks


def _flips(mask: int, most: int) -> list[int]:
    bits = [1 << b for b in range(64) if mask >> b & 1]
    return [sum(c) for d in range(most + 1) for c in itertools.combinations(bits, d)]


def _candidates(mask: int, equal_pairs: int, p: np.ndarray) -> list[float]:
    """Estimated candidate pairs of a partition for each threshold 0 to 3.

    Pairs that agree in the partition are counted exactly; from them, those that
    differ in d of its bits follow from how often each bit differs.
    """
    odds = [2 * p[b] * (1 - p[b]) / max(p[b] ** 2 + (1 - p[b]) ** 2, 1e-9) for b in range(64) if mask >> b & 1]
    by_distance = [1.0, 0.0, 0.0, 0.0]
    for r in odds:
        for d in (3, 2, 1):
            by_distance[d] += by_distance[d - 1] * r
    return [(equal_pairs + 1) * sum(by_distance[: t + 1]) for t in range(4)]


def allocate(
    masks: list[int], n: int, equal_pairs: list[int], p: np.ndarray, distance: int = DISTANCE, most: int | None = None
) -> tuple[float, list[int]]:
    """Thresholds (-1: unused; none above ``most``) that sum to distance - m + 1 at least cost, by dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for mask, pairs in zip(masks, equal_pairs, strict=True):
        width, found, step = bin(mask).count("1"), _candidates(mask, pairs, p), {}
        probes = np.cumsum([1, width, width * (width - 1) / 2, width * (width - 1) * (width - 2) / 6])
        for used, (cost, so_far) in best.items():
            for t in range(-1, min(distance if most is None else most, len(found) - 1) + 1):
                more = 0.0 if t < 0 else PROBE_COST * n * (1 + probes[t]) + CANDIDATE_COST * found[t]
                if used + t not in step or cost + more < step[used + t][0]:
                    step[used + t] = (cost + more, [*so_far, t])
        best = step
    return best[distance - len(masks) + 1]


def layout(fps: DataFrame) -> list[tuple[int, int]]:
    """The cheapest partitions as (mask, threshold)."""
    n, both = bit_statistics(fps)
    options = [group_bits(n, both, m) for m in PARTS]
    masks = [mask for o in options for mask in o]
    part = lambda i, mask: F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("v"))
    values = fps.select(F.explode(F.array(*[part(i, mask) for i, mask in enumerate(masks)])).alias("x")).select("x.*")
    sizes = values.groupBy("i", "v").agg(F.count(F.lit(1)).alias("c"))
    equal = {r["i"]: int(r["pairs"] or 0) for r in sizes.groupBy("i").agg(F.sum(F.expr("c * (c - 1) / 2")).alias("pairs")).collect()}
    p, at, costs = np.diag(both) / max(n, 1), 0, []
    for o in options:
        cost, thresholds = allocate(o, n, [equal.get(at + k, 0) for k in range(len(o))], p)
        costs.append((cost, list(zip(o, thresholds, strict=True))))
        at += len(o)
    return [(mask, t) for mask, t in min(costs, key=lambda x: x[0])[1] if t >= 0]


def links(fps: DataFrame, parts: list[tuple[int, int]], distance: int = DISTANCE) -> DataFrame:
    """Every two fingerprints (a < b) within ``distance``, each pair once."""
    key = lambda i, mask, flip: F.struct(
        F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.lit(_signed(flip))).alias("v")
    )
    every = [key(i, mask, flip) for i, (mask, t) in enumerate(parts) for flip in _flips(mask, t)]
    probes = fps.select(F.col("fp").alias("a"), F.explode(F.array(*every)).alias("k")).select("a", "k.i", "k.v")
    exact = [key(i, mask, 0) for i, (mask, _) in enumerate(parts)]
    index = fps.select(F.col("fp").alias("b"), F.explode(F.array(*exact)).alias("k")).select("b", "k.i", "k.v")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    near = probes.join(index, (probes.i == index.i) & (probes.v == index.v) & close)
    return near.select("a", "b").distinct()


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) for every row."""
    required(docs, ["doc_id", "text"])
    rows = write_and_read(with_fingerprints(docs), "fingerprints")
    fps = write_and_read(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = write_and_read(links(fps, layout(fps)), "links")
    roots = components(found)
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = write_and_read(named, "roots")
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = write_and_read(named.join(ids, "root").select("fp", "component_id"), "components")
    return rows.join(component, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_components(documents(spark, sf_dir))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
