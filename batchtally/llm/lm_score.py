r"""Masked pseudo-likelihood of documents.

A small bidirectional network predicts every token from the two tokens on either
side; the sum of the conditional log-probabilities scores a document. Tokens are
lower-cased words. The network knows them by hash only, as one of ``BUCKETS``
numbers, and gives the probability of a class of buckets; classes hold near equal
mass. A word's probability is that of its class, times the bucket's share of the
class, times the word's own share of the bucket, from exact counts of all words.

The counts are a stored table that grows with the vocabulary. Words that hold at
least 1 / ``COMMON`` of all tokens, so at most ``COMMON`` words, go to every task; other words
are joined with the table, so no key of that join is frequent. Logarithms of
counts are summed in whole numbers of 1 / ``UNIT``, alike in any order.

Three passes over all documents: word counts; training; scoring. In training the
documents are dealt by a hash of their tokens to fit-shards, one for every
``FIT_TOKENS`` tokens of the corpus, and stand in one order inside a shard, so the
networks do not depend on the number of tasks. Equal documents are counted before
they are shuffled and dealt in parts of ``COPIES``. A network is fitted in numpy on
every position of its shard, once: for each run of documents in ``MASK`` passes,
each over another share of positions by hash. All networks begin at one common
start; they are then averaged by token count in a tree of aggregates of about half
``FAN_IN`` networks each.

Defined results
* null or empty text: no tokens, log_prob 0, mean_log_prob null;
* repeated rows get equal scores; null ids are scored like others;
* a word outside the counted documents scores like one that occurs once in them;
* a window that runs over an end of the text is filled with a token of its own;
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby, repeat
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchtally.llm.common import documents, required
from batchtally.plans.storage import write_and_read

BUCKETS, CLASSES = 4096, 64
SIDE, WIDTH, HIDDEN = 2, 16, 32
MASK, BATCH, RATE = 8, 2048, 0.25
LANE = 128  # positions in one product of matrices
FAN_IN = 32
FIT_TOKENS = 1 << 21
COPIES = 64
FIT_TASKS = 4096  # fit-shards beyond this number share tasks
TOKENS_AT_ONCE, BYTES_AT_ONCE = 1 << 16, 1 << 19
COMMON = 1 << 18
WORDS_HELD = 300_000
UNIT = 1 << 32

_byte = np.arange(256)
_SPACES = np.isin(_byte, list(b" \t\n\r\x0b\x0c"))
_LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint64) + np.uint64(1)


def words_in(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def tokens(text: str | None) -> np.ndarray:
    return numbered([(text or "").encode()])[0]


def numbers(words: list[bytes]) -> np.ndarray:
    """The bucket of every word."""
    return numbered([b"\n".join(words)])[0]


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of texts, one text after the other, and the number of words of each.

    The hash of a word is a polynomial in its lower-cased bytes, summed for all words at once.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _SPACES[data]
    inside = np.flatnonzero(~space)
    begins = np.flatnonzero(np.append(True, space[:-1])[inside])  # places in ``inside``
    sizes = np.diff(np.append(begins, len(inside)))
    power = np.full(sizes.max(initial=1), 0x9E3779B97F4A7C15, dtype=np.uint64).cumprod(dtype=np.uint64)
    place = np.arange(len(inside)) - np.repeat(begins, sizes)
    terms = _LOWER[data[inside]] * power[place]
    h = np.add.reduceat(terms, begins) if len(begins) else np.zeros(0, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(inside[begins], ends)
    return ((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32), np.diff(upto, prepend=0)


def word_counts(docs: DataFrame) -> DataFrame:
    """Table (word, bucket, n) of every word of all documents, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words, n = list(held), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(numbers(words)), pa.array(n, pa.int64())], ["word", "bucket", "n"])

        for b in batches:
            for t in b.column(0):
                held.update(words_in(t.as_py()))
                if len(held) > WORDS_HELD:
                    yield out()
        if held:
            yield out()

    parts = docs.select("text").mapInArrow(run, "word binary, bucket int, n long")
    return write_and_read(parts.groupBy("word", "bucket").agg(F.sum("n").alias("n")), "words")


def token_counts(words: DataFrame) -> np.ndarray:
    """Number of tokens per bucket."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for r in words.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def in_units(n: np.ndarray) -> np.ndarray:
    """Logarithms of counts in whole numbers; 0 counts as 1."""
    return np.rint(np.log(np.maximum(n, 1)) * UNIT).astype(np.int64)


class Network:
    """Embeddings of the window, one hidden layer, a softmax over classes."""

    def __init__(self, counts: np.ndarray, words: DataFrame | None = None):
        self.counts, self.words = counts, words
        share = (counts + 1) / (counts + 1).sum()
        order = np.argsort(-share, kind="stable")
        middle = np.cumsum(share[order]) - share[order] / 2
        self.class_of = np.zeros(BUCKETS, dtype=np.int64)
        self.class_of[order] = np.minimum((middle * CLASSES).astype(np.int64), CLASSES - 1)
        mass = np.bincount(self.class_of, share, CLASSES)
        self.inside = np.log(share / mass[self.class_of])
        rng = np.random.default_rng(5)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.embed = (rng.standard_normal((BUCKETS + 1, WIDTH)) * 0.3).astype(np.float32)
        self.w1, self.b1 = draw(2 * SIDE * WIDTH, HIDDEN), np.zeros(HIDDEN, dtype=np.float32)
        self.w2 = draw(HIDDEN, CLASSES) * np.float32(0.1)
        self.b2 = np.log(np.maximum(mass, 1e-6)).astype(np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": None}  # the table stays with the driver

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.w1, self.b1, self.w2, self.b2]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, hidden layer and logits of classes (the largest is 0), as stacks of (values, ``LANE`` positions).

        Products this small stay in one thread, so tasks on one machine do not compete for cores.
        The number of windows is a multiple of ``LANE``.
        """
        x = self.embed.take(windows, axis=0).reshape(-1, LANE, 2 * SIDE * WIDTH).transpose(0, 2, 1)
        h = self.w1.T @ x
        h += self.b1[:, None]
        np.tanh(h, out=h)
        z = self.w2.T @ h
        z += self.b2[:, None]
        z -= z.max(axis=1, keepdims=True)
        return x, h, z

    def log_probs(self, ids: np.ndarray, windows: np.ndarray) -> np.ndarray:
        z = self.forward(_filled(windows))[2]
        at = np.arange(len(ids))
        own = z[at // LANE, self.class_of[ids], at % LANE]
        return own - np.log(np.exp(z, out=z).sum(axis=1)).ravel()[: len(ids)] + self.inside[ids]


def _filled(windows: np.ndarray) -> np.ndarray:
    """``windows``, with empty ones behind them up to a multiple of ``LANE``."""
    return np.pad(windows, ((0, -len(windows) % LANE), (0, 0)), constant_values=BUCKETS)


def windows(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Neighbour tokens of every position; BUCKETS stands beyond the ends of a document."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    last = np.repeat(np.cumsum(lengths) - 1, lengths)
    at = np.arange(len(doc))
    out = np.full((len(ids), 2 * SIDE), BUCKETS, dtype=np.int32)
    for k, d in enumerate([d for d in range(-SIDE, SIDE + 1) if d]):
        inside = (at + d >= first) & (at + d <= last)
        out[inside, k] = ids[at[inside] + d]
    return out


def _chunks(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, texts) of runs of documents of some hundred kilobytes."""
    start, held, size = 0, [], 0
    for i, t in enumerate(b.column(column)):
        held.append((t.as_py() or "").encode())
        size += len(held[-1])
        if size >= BYTES_AT_ONCE or i == b.num_rows - 1:
            yield start, i + 1, held
            start, held, size = i + 1, [], 0


def _learn(net: Network, sums: list[np.ndarray], ids: np.ndarray, around: np.ndarray) -> None:
    """One Adagrad step on the log loss of the classes of ``ids``."""
    around = _filled(around)
    x, h, z = net.forward(around)
    d = np.exp(z, out=z)
    d /= d.sum(axis=1, keepdims=True)
    at = np.arange(len(ids))
    d[at // LANE, net.class_of[ids], at % LANE] -= 1
    d[-1, :, LANE - (len(around) - len(ids)) :] = 0  # the windows that fill the last lane
    d /= np.float32(len(ids))
    dh = net.w2 @ d
    dh -= dh * h * h
    dx = (dh.transpose(0, 2, 1) @ net.w1.T).reshape(-1, WIDTH)
    flat = around.ravel().astype(np.min_scalar_type(BUCKETS))
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    rows, de = ordered[first], np.add.reduceat(dx.take(order, axis=0), first, axis=0)
    sums[0][rows] = so_far = sums[0][rows] + de * de
    net.embed[rows] -= RATE * de / np.sqrt(so_far + 1e-8)
    of_layers = [(x @ dh.transpose(0, 2, 1)).sum(0), dh.sum((0, 2)), (h @ d.transpose(0, 2, 1)).sum(0), d.sum((0, 2))]
    for p, s, g in zip(net.parts()[1:], sums[1:], of_layers, strict=True):
        s += g * g
        p -= RATE * g / np.sqrt(s + 1e-8)


def passes(ids: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """The positions of each of ``MASK`` passes; every position is in one of them."""
    place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    mixed = (place * 2654435761 + np.repeat(lengths, lengths) * 40503 + ids * 97) % 4294967296
    turn = (mixed >> 7) % MASK
    for k in range(MASK):
        yield np.flatnonzero(turn == k)


def fit_shards(docs: DataFrame, n_tokens: int) -> DataFrame:
    """(shard, ids) of every document with tokens, in the order in which a shard's network reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, texts in _chunks(b, 0):
                ids, lengths = numbered(texts)
                raw, ends = ids.astype("<i2"), np.cumsum(lengths)
                found = [raw[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True) if n]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["ids"])

    shards = max(1, -(-n_tokens // FIT_TOKENS))
    equal = docs.select("text").mapInArrow(run, "ids binary").groupBy("ids").agg(F.count(F.lit(1)).alias("n"))
    part = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES).cast("int")))
    parts = equal.select("ids", "n", part.alias("part")).withColumn("copies", F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES).cast("int"))
    keyed = parts.withColumn("key", F.xxhash64("ids", "part")).withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    # every shard in a partition of its own, or dealt evenly to FIT_TASKS partitions
    dealt = keyed.repartitionById(min(shards, FIT_TASKS), F.pmod("shard", F.lit(min(shards, FIT_TASKS))))
    return dealt.sortWithinPartitions("shard", "key", "ids", "part").select("shard", "ids", "copies")


def local_networks(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """One row (shard, n, params) per fit-shard with text: the network fitted on its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for shard, own in groupby(rows, key=itemgetter(0)):
            net, n = Network(counts), 0
            sums = [np.full_like(p, 1e-3) for p in net.parts()]
            held, size = [], 0
            for ids, last in _with_last(np.frombuffer(ids, dtype="<i2") for _, ids, copies in own for _ in range(copies)):
                held.append(ids)
                size += len(ids)
                if size >= TOKENS_AT_ONCE or last:
                    _fit(net, sums, np.concatenate(held).astype(np.int32), np.array([len(x) for x in held], dtype=np.int64))
                    n += size
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n]), pa.array([net.flat().tobytes()])], ["shard", "n", "params"])

    return fit_shards(docs, int(counts.sum())).mapInArrow(run, "shard int, n long, params binary")


def _with_last(items: Iterator) -> Iterator[tuple]:
    """Every item, and whether it is the last."""
    items = iter(items)
    before = next(items, None)
    for x in items:
        yield before, False
        before = x
    if before is not None:
        yield before, True


def _fit(net: Network, sums: list[np.ndarray], ids: np.ndarray, lengths: np.ndarray) -> None:
    """All passes over a run of documents."""
    around = windows(ids, lengths)
    for masked in passes(ids, lengths):
        near, own = around[masked], ids[masked]
        for at in range(0, len(masked), BATCH):
            _learn(net, sums, own[at : at + BATCH], near[at : at + BATCH])


def _mean(rows: pd.DataFrame) -> tuple[int, np.ndarray]:
    rows = rows.sort_values(["n", "params"])  # sums of fractions depend on their order
    total = int(rows["n"].sum())
    out = sum(np.frombuffer(p, dtype=np.float32).astype(np.float64) * (n / total) for n, p in zip(rows["n"], rows["params"], strict=True))
    return total, out


def average(models: DataFrame) -> np.ndarray | None:
    """Mean of the networks, weighted by tokens; groups of FAN_IN, level by level, the last one here."""
    models = write_and_read(models, "networks")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        n, params = _mean(rows)
        return pd.DataFrame({"n": [n], "params": [params.astype(np.float32).tobytes()]})

    while (count := models.count()) > FAN_IN:
        # dealt by hash, half of FAN_IN to a group on average; fewer groups than networks, so every level shrinks
        groups = min(-(-2 * count // FAN_IN), count // 2)
        group = F.pmod(F.xxhash64("params"), F.lit(groups)).alias("g")
        merged = models.select(group, "n", "params").groupBy("g").applyInPandas(merge, "n long, params binary")
        models = write_and_read(merged, "networks")
    return _mean(models.toPandas())[1] if count else None


def train(docs: DataFrame) -> Network:
    words = word_counts(docs)
    counts = token_counts(words)
    net = Network(counts, words)
    mean = average(local_networks(docs, counts))
    if mean is not None:
        net.load(mean)
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_tokens, log_prob and mean_log_prob for every row; the words of ``net`` are those of its training."""
    required(docs, ["doc_id", "text"])
    rows = docs.select("doc_id", "text")
    least = -(-int(net.counts.sum()) // COMMON)
    common = net.words.filter(F.col("n") >= least).select("word", "n").toPandas()  # at most COMMON words
    known = dict(zip(map(bytes, common["word"]), in_units(common["n"].to_numpy(dtype=np.int64)).tolist(), strict=True))
    of_bucket = in_units(net.counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end, texts in _chunks(b, 1):
                words = b"\n".join(texts).lower().split()
                ids, lengths = numbered(texts)
                around = windows(ids, lengths)
                p = np.zeros(len(ids))
                for at in range(0, len(ids), BATCH):
                    p[at : at + BATCH] = net.log_probs(ids[at : at + BATCH], around[at : at + BATCH])
                doc = np.repeat(np.arange(len(lengths)), lengths)
                units = np.array(list(map(known.get, words, repeat(-1))), dtype=np.int64)
                rare = np.flatnonzero(units < 0)
                inside = np.append(0, np.cumsum(np.maximum(units, 0) - of_bucket[ids]))
                ends = np.cumsum(lengths)
                first_rare = np.append(0, np.searchsorted(rare, ends)).astype(np.int32)
                unknown = pa.ListArray.from_arrays(first_rare, pa.array([words[i] for i in rare.tolist()], pa.binary()))
                columns = [b.column("doc_id").slice(start, end - start), pa.array(lengths), pa.array(np.bincount(doc, p, len(lengths)).astype(float))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(inside[ends] - inside[ends - lengths]), unknown], ["doc_id", "n_tokens", "p", "u", "rare"])

    kinds = [("n_tokens", T.LongType()), ("p", T.DoubleType()), ("u", T.LongType()), ("rare", T.ArrayType(T.BinaryType()))]
    scored = rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *[T.StructField(n, t) for n, t in kinds]]))
    scored = write_and_read(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # the logarithm of 1 is 0: words that occur once need no partner
    table = net.words.filter((F.col("n") > 1) & (F.col("n") < least)).select("word", F.rint(F.log("n") * UNIT).cast("bigint").alias("v"))
    found = scored.select("row", F.explode("rare").alias("word")).join(table, "word").groupBy("row").agg(F.sum("v").alias("v"))
    total = F.col("p") + (F.col("u") + F.coalesce("v", F.lit(0))) / UNIT
    out = scored.select("doc_id", "n_tokens", "p", "u", "row").join(found, "row", "left").withColumn("log_prob", total)
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return out.select("doc_id", "n_tokens", "log_prob", mean.alias("mean_log_prob"))


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs))
