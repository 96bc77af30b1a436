r"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each is a logistic model over word
features and over the probabilities of all earlier categories; in training those
probabilities are out-of-fold predictions, so a later model learns from what it
will see. The categories come from the label table: a document is poor
(``quality`` 0), toxic, or both.

Models are fitted in numpy on a bounded sample of labelled documents (the
``SAMPLE`` smallest id hashes); the scoring pass reads every document in batches
inside the tasks. Weights have a fixed size (``FEATURES``) and travel with the function.

Features of a document: its distinct words (letters, lower case) and their byte
prefixes of 4 to 7, hashed to 2^20 numbers, of which the sample's most telling
ones are kept, and marks of its form.

Defined results
* null text counts as empty: no words, only the mark of a short text;
* repeated rows get equal scores; null ids are scored, and never in the sample;
* labels that are null leave a document out of the sample;
* fewer than two labels of a kind: that category's probability is its share in the sample (0 without a sample);
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchtally.llm.common import documents, required

SAMPLE = 6000  # labelled documents that are fitted on, at most
FEATURES = 600  # features that are kept
FOLDS = 5
HASHED = 1 << 20
MARKS = 8  # the first numbers are marks of form
L1, STEPS = 1e-4, 200
CATEGORIES = ["poor", "toxic", "toxic_poor"]

_LETTERS = re.compile(rb"[a-z\x80-\xff]+")
_cache: dict[bytes, tuple[int, ...]] = {}


def _of_word(word: bytes) -> tuple[int, ...]:
    known = _cache.get(word)
    if known is None:
        if len(_cache) > 200_000:  # memory only; the result is the same
            _cache.clear()
        parts = [b"w" + word] + [b"p" + word[:n] for n in range(4, 8) if len(word) >= n]
        known = _cache[word] = tuple(MARKS + xxhash.xxh32_intdigest(p) % (HASHED - MARKS) for p in parts)
    return known


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    text = text or ""
    raw = text.encode()
    found: set[int] = set()
    for word in set(_LETTERS.findall(raw.lower())):
        found.update(_of_word(word))
    n_words = max(1, len(raw.split()))
    upper, symbols = sum(map(raw.count, _UPPER)), sum(map(raw.count, _SYMBOLS))
    marks = [n_words < 20, symbols > 0.3 * n_words, upper > 0.5 * len(raw), raw.count(b"|") > 0.2 * n_words]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marks += [len(lines) > 2 and len(set(lines)) < 0.7 * len(lines), raw.count(b"!!") > 0.2 * n_words]
    found.update(i for i, on in enumerate(marks) if on)
    return np.sort(np.fromiter(found, dtype=np.int64, count=len(found)))


_UPPER = [bytes([c]) for c in range(65, 91)]
_SYMBOLS = [b"#", b"*", b"$", b"%", b"&"]


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, label columns and feature numbers (packed 32-bit integers) of a bounded sample."""
    wanted = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    wanted = wanted.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(chosen, "doc_id")
    # one document of each doc_id, however often it is repeated
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    rows = found.groupBy("doc_id", "quality", "toxic").agg(one).select("doc_id", "text", "quality", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([features(t.as_py()).astype("<i4").tobytes() for t in b.column("text")], type=pa.binary())
            columns = [b.column("doc_id"), b.column("quality"), b.column("toxic"), found]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality", "toxic", "features"])

    kinds = [rows.schema[c] for c in ("doc_id", "quality", "toxic")]
    return rows.mapInArrow(run, T.StructType([*kinds, T.StructField("features", T.BinaryType())]))


@dataclass
class Sparse:
    """Rows of feature numbers 0 to ``width`` - 1, each of value 1."""

    row: np.ndarray
    col: np.ndarray
    n: int
    width: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def transposed(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.width)

    def some(self, keep: np.ndarray) -> Sparse:
        to = np.cumsum(keep) - 1
        of = keep[self.row]
        return Sparse(to[self.row[of]], self.col[of], int(keep.sum()), self.width)


def sparse(lists: list[np.ndarray], vocabulary: np.ndarray) -> Sparse:
    """The kept features of each list; ``vocabulary`` is sorted."""
    rows, cols = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    if len(vocabulary):
        for row, flat in _flat(lists):
            col = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
            known = vocabulary[col] == flat
            rows.append(row[known])
            cols.append(col[known])
    return Sparse(np.concatenate(rows), np.concatenate(cols), len(lists), len(vocabulary))


def _flat(lists: list[np.ndarray], at_once: int = 500) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and feature numbers of all lists, some rows at a time."""
    for at in range(0, len(lists), at_once):
        part = lists[at : at + at_once]
        yield np.repeat(np.arange(at, at + len(part)), [len(x) for x in part]), np.concatenate(part)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Linear:
    weights: np.ndarray
    extra: np.ndarray
    bias: float

    def predict(self, x: Sparse, more: np.ndarray) -> np.ndarray:
        return sigmoid(x.times(self.weights) + more @ self.extra + self.bias)


def fit_linear(x: Sparse, more: np.ndarray, y: np.ndarray) -> Linear:
    """Logistic model with L1 weights, by accelerated proximal steps; word features only are penalised."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1e-3
    out = Linear(np.zeros(x.width), np.zeros(more.shape[1]), float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        if len(y):
            out.bias = 30.0 if y[0] else -30.0
        return out
    per_row = np.bincount(x.row, minlength=x.n).max() if len(x.row) else 0
    # largest eigenvalue of the Gram matrix by power steps, for the step size
    v = np.ones(x.width)
    for _ in range(15):
        u = x.transposed(x.times(v))
        v = u / max(np.linalg.norm(u), 1e-12)
    top = float(np.linalg.norm(x.times(v)) ** 2) if x.width else 0.0
    step = 1 / (0.25 * (top + len(y) * (1 + more.shape[1])) / len(y) + 1e-9) if per_row else 1.0
    w, e, b = out.weights, out.extra, out.bias
    zw, ze, zb, t = w.copy(), e.copy(), b, 1.0
    for _ in range(STEPS):
        g = (sigmoid(x.times(zw) + more @ ze + zb) - y) / len(y)
        moved = zw - step * x.transposed(g)
        nw = np.sign(moved) * np.maximum(np.abs(moved) - step * L1, 0)
        ne, nb = ze - step * (more.T @ g), zb - step * float(g.sum())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        k = (t - 1) / nt
        zw, ze, zb = nw + k * (nw - w), ne + k * (ne - e), nb + k * (nb - b)
        w, e, b, t = nw, ne, nb, nt
    return Linear(w, e, b)


@dataclass
class Chain:
    vocabulary: np.ndarray
    models: list[Linear] = field(default_factory=list)
    limits: list[float] = field(default_factory=list)

    def probabilities(self, lists: list[np.ndarray]) -> np.ndarray:
        """One column per category, each fed to the models after it."""
        x = sparse(lists, self.vocabulary)
        got = np.zeros((len(lists), 0))
        for m in self.models:
            got = np.column_stack([got, m.predict(x, got)])
        return got


def telling(lists: list[np.ndarray], labels: np.ndarray, most: int = FEATURES) -> np.ndarray:
    """Features whose document counts differ most between label values, over all categories; sorted."""
    total, hits_of = np.zeros(HASHED, dtype=np.int64), np.zeros((labels.shape[1], HASHED))
    for row, flat in _flat(lists):
        np.add.at(total, flat, 1)
        for hits, y in zip(hits_of, labels.T, strict=True):
            np.add.at(hits, flat, y[row])
    names = np.flatnonzero(total)
    total, best = total[names], np.zeros(len(names))
    for y, hits in zip(labels.T, hits_of[:, names], strict=True):
        share = y.mean() if len(y) else 0.0
        best = np.maximum(best, np.abs(hits - share * total) / np.sqrt(total * max(share * (1 - share), 1e-9) + 1))
    order = np.lexsort((names, -best))[:most]
    return np.sort(names[order[total[order] >= 2]])


def best_limit(p: np.ndarray, y: np.ndarray) -> float:
    """Threshold of the best F1 of out-of-fold probabilities."""
    options = np.round(np.arange(0.1, 0.91, 0.05), 2)
    score = [2 * np.sum((p >= t) & (y == 1)) / max(np.sum(p >= t) + np.sum(y == 1), 1) for t in options]
    good = np.flatnonzero(np.array(score) >= max(score) - 1e-12)
    return float(options[good[len(good) // 2]])


def fit_chain(ids: np.ndarray, lists: list[np.ndarray], labels: np.ndarray) -> Chain:
    """Models in the order of the label columns, later ones fitted on out-of-fold probabilities of the earlier."""
    chain = Chain(telling(lists, labels))
    x = sparse(lists, chain.vocabulary)
    fold = np.array([xxhash.xxh32_intdigest(str(i).encode(), 7) % FOLDS for i in ids], dtype=np.int64)
    earlier = np.zeros((len(lists), 0))
    for y in labels.T:
        held = np.zeros(len(lists))
        for f in range(FOLDS):
            test = fold == f
            if test.any():
                m = fit_linear(x.some(~test), earlier[~test], y[~test])
                held[test] = m.predict(x.some(test), earlier[test])
        chain.models.append(fit_linear(x, earlier, y))
        chain.limits.append(best_limit(held, y))
        earlier = np.column_stack([earlier, held])
    return chain


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Chain:
    rows = sorted(labelled_sample(docs, labels, most).collect(), key=lambda r: r["doc_id"])  # at most ``most`` rows
    lists = [np.frombuffer(r["features"], dtype="<i4") for r in rows]
    poor = np.array([r["quality"] == 0 for r in rows], dtype=float)
    toxic = np.array([r["toxic"] == 1 for r in rows], dtype=float)
    return fit_chain(np.array([r["doc_id"] for r in rows]), lists, np.column_stack([poor, toxic, poor * toxic]))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, a probability per category, and ``toxic`` at the calibrated limit."""
    required(docs, ["doc_id", "text"])
    rows = docs.select("doc_id", "text")
    names = [f"p_{c}" for c in CATEGORIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                p = chain.probabilities([features(t.as_py()) for t in part.column(1)])
                columns = [part.column(0), *[pa.array(np.round(c, 6)) for c in p.T], pa.array(p[:, 1] >= chain.limits[1])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "toxic"])

    fields = [T.StructField(n, T.DoubleType()) for n in names]
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *fields, T.StructField("toxic", T.BooleanType())]))


def op6_toxicity_chain(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
