r"""Subword encoding by sampling without replacement, and decoding.

The model file is that of a public tokenizer and is never trained here. All
segmentations of a text into its pieces form a lattice; a piece's probability
follows its rank in the model (1 / (rank + 10), normalised), a segmentation's is
the product over its pieces, normalised over the lattice. From this distribution
the first ``k`` segmentations of a Gumbel top-k are drawn: an A* search keeps sets of
segmentations (a common beginning and the arcs excluded after it) in a queue,
each with the perturbed log-probability of its best member as bound, drawn as a
Gumbel truncated at the bound of the set it was split from. The set of the
highest bound gives the next segmentation and is split along it, so the
segmentations are distinct and come in falling order. The bound left on top of
the queue is the threshold of the inclusion scores.

No piece has a word boundary inside, so the lattice is a chain of one small
lattice per word; those of the distinct words of a batch are built and sampled
together in numpy. Random numbers are hashes of (row key, draw, word, step): a
row gives the same result wherever it is processed.

Defined results
* null text counts as empty; empty text has one segmentation, without pieces, of inclusion 1;
* a text of fewer than k segmentations gives all of them, each of inclusion 1;
* a character outside the model becomes its bytes; U+2581 is the model's own sign for a space and is decoded as one;
* repeated rows get equal results; a null id is a key like any other;
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from batchtally.llm.common import documents, required

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SEED = 11
UNITS_AT_ONCE = 60_000
UNITS_KEPT = 120_000  # distinct words whose lattices a worker keeps; memory only
SPACE = "▁"

_UNIT = re.compile(" +[^ ]*")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _uniform(seed, *parts) -> np.ndarray:
    """Numbers in (0, 1) that depend on all arguments."""
    with np.errstate(over="ignore"):
        x = np.asarray(seed, dtype=np.uint64)
        for p in parts:
            x = _mix(x * _STEP + np.asarray(p, dtype=np.uint64) + _STEP)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _key(*parts: int) -> int:
    return xxhash.xxh64_intdigest(np.array(parts, dtype=np.uint64).tobytes())


def _number(*parts: int) -> float:
    return ((_key(*parts) >> 11) + 0.5) / (1 << 53)


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


class HashTable:
    """Places of sorted 64-bit keys, found over their top 16 bits."""

    def __init__(self, keys: np.ndarray):
        top = (keys >> np.uint64(48)).astype(np.int64)
        self.keys = np.append(keys, np.uint64(0))
        self.low = np.searchsorted(top, np.arange(1 << 16)).astype(np.int32)
        self.most = int(np.bincount(top, minlength=1).max()) if len(keys) else 0

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        at = self.low[(x >> np.uint64(48)).astype(np.int64)]
        same = self.keys[at] == x
        out = np.where(same, at, -1)
        rest = np.flatnonzero(~same)
        for step in range(1, self.most):
            if not len(rest):
                break
            there = np.minimum(at[rest] + step, len(self.keys) - 1)
            same = self.keys[there] == x[rest]
            out[rest[same]] = there[same]
            rest = rest[~same]
        return out


class Pieces:
    """Pieces of a model with their log-probabilities, found by length and hash."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_of = {i: int(self.text[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.raw = pa.array([bytes([self.bytes_of[i]]) if i in self.bytes_of else t.encode() for i, t in enumerate(self.text)], pa.large_binary())
        self.byte_id = {b: i for i, b in self.bytes_of.items()}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        inside = [self.text[i] for i in plain if SPACE in self.text[i].lstrip(SPACE)]
        if inside:
            raise ValueError(f"pieces with a word boundary inside: {inside[:5]}")
        weight = 1 / (np.arange(len(plain)) + 10.0)
        self.log_p = np.full(n, np.log(weight[-1] / weight.sum()))
        self.log_p[plain] = np.log(weight / weight.sum())
        self.longest = max(len(self.text[i]) for i in plain)
        # per length: pieces and beginnings of longer pieces, by hash
        entries: list[dict[int, int]] = [{} for _ in range(self.longest + 1)]
        self.goes_on: list[np.ndarray] = [np.zeros(0, dtype=bool)]
        begins: list[set[int]] = [set() for _ in range(self.longest + 1)]
        for i in plain:
            h = np.uint64(0)
            for k, c in enumerate(self.text[i], 1):
                h = self.roll(h, np.uint64(ord(c)))
                if k == len(self.text[i]):
                    entries[k][int(h)] = i
                else:
                    begins[k].add(int(h))
                    entries[k].setdefault(int(h), -1)
        self.tables = [HashTable(np.zeros(0, dtype=np.uint64))]
        self.ids = [np.zeros(0, dtype=np.int32)]
        for d, more in zip(entries[1:], begins[1:], strict=True):
            keys = sorted(d)
            self.tables.append(HashTable(np.array(keys, dtype=np.uint64)))
            self.ids.append(np.array([d[h] for h in keys], dtype=np.int32))
            self.goes_on.append(np.array([h in more for h in keys], dtype=bool))

    @staticmethod
    def roll(h, c):
        with np.errstate(over="ignore"):
            return (h + c + np.uint64(1)) * _STEP ^ (h >> np.uint64(29))


class Lattices:
    """Lattices of words as one graph: state = place in a word; arcs of a state lie together, longest piece first.

    Per arc: piece, target state, conditional log-probability given the state,
    running probability inside the state.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

        self.first = np.zeros(1, dtype=np.int64)  # arcs of state s: first[s] to first[s + 1]
        self.piece = np.zeros(0, dtype=np.int32)  # below 0: -1 - code point, to be written as bytes
        self.target = np.zeros(0, dtype=np.int32)
        self.log_q = np.zeros(0)
        self.log_other = np.zeros(0, dtype=np.float32)  # log of what the other arcs of the state hold
        self.upto = np.zeros(0)
        self.clear()

    def clear(self) -> None:
        """Forget all words; the arrays are used again."""
        self.start: dict[str, int] = {}
        self.n_states = self.n_arcs = 0

    def _append(self, name: str, used: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if used + len(values) > len(held):
            wider = np.empty((used + len(values)) * 3 // 2, dtype=held.dtype)
            wider[:used] = held[:used]
            setattr(self, name, wider)
            held = wider
        held[used : used + len(values)] = values

    def add(self, words: list[str]) -> None:
        """Build the lattices of new words (without the space in front)."""
        p, units = self.pieces, [SPACE + w.replace(" ", SPACE) for w in words]
        size = np.array([len(u) for u in units], dtype=np.int64)
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        n_chars, unit = len(codes), np.repeat(np.arange(len(units)), size)
        ends = np.cumsum(size)
        left = (ends[unit] - np.arange(n_chars)).astype(np.int32)  # characters from here to the end of the word
        hits: list[tuple[np.ndarray, np.ndarray]] = []  # by length: places and pieces
        alive, h = np.arange(n_chars), np.zeros(n_chars, dtype=np.uint64)
        for k in range(1, p.longest + 1):
            inside = left[alive] >= k
            alive, h = alive[inside], h[inside]
            h = Pieces.roll(h, codes[alive + (k - 1)])
            at = p.tables[k].find(h)
            known = np.flatnonzero(at >= 0)
            at, alive, h = at[known], alive[known], h[known]
            ids = p.ids[k][at]
            hit = ids >= 0
            hits.append((alive[hit], ids[hit]))
            go = p.goes_on[k][at]
            alive, h = alive[go], h[go]
            if not len(alive):
                break
        lone = np.ones(n_chars, dtype=bool)
        lone[hits[0][0]] = False
        lone = np.flatnonzero(lone)
        raw = {c: chr(c).encode("utf-8", "surrogatepass") for c in np.unique(codes[lone]).astype(np.int64).tolist()}
        sign = {c: p.byte_id[r[0]] if len(r) == 1 else -1 - c for c, r in raw.items()}
        as_bytes = codes[lone].astype(np.int64).tolist()
        hits[0] = (np.concatenate([hits[0][0], lone]), np.concatenate([hits[0][1], np.array([sign[c] for c in as_bytes], dtype=np.int32)]))

        count = np.zeros(n_chars, dtype=np.int64)
        for where, _ in hits:
            count[where] += 1
        offset = np.concatenate([[0], np.cumsum(count)])
        n_arcs, free = int(offset[-1]), offset[:-1].copy()
        piece, source, size_of = np.zeros(n_arcs, dtype=np.int32), np.zeros(n_arcs, dtype=np.int64), np.zeros(n_arcs, dtype=np.int32)
        for k in range(len(hits), 0, -1):  # longest pieces first
            where, ids = hits[k - 1]
            slot = free[where]
            piece[slot], source[slot], size_of[slot] = ids, where, k
            free[where] += 1
        log_p = p.log_p[np.maximum(piece, 0)]
        wide = np.flatnonzero(piece < 0)
        log_p[wide] = [len(raw[-1 - int(c)]) * p.log_p.min() for c in piece[wide]]

        place = source + unit[source]  # every word has one more state than characters
        reach = place + size_of
        rest = np.zeros(n_chars + len(units))  # log mass of all ways from a state to the word's end
        of_left = left[source]
        order = np.argsort(of_left.astype(np.uint16) if left.max(initial=0) < 65536 else of_left, kind="stable")
        bounds = np.searchsorted(of_left[order], np.arange(1, size.max(initial=0) + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            arcs = order[a:b]
            at = place[arcs]
            begin = np.flatnonzero(np.diff(at, prepend=-1))
            total = log_p[arcs] + rest[reach[arcs]]
            top = np.maximum.reduceat(total, begin)
            spread = np.repeat(top, np.diff(begin, append=len(arcs)))
            rest[at[begin]] = top + np.log(np.add.reduceat(np.exp(total - spread), begin))
        log_q = np.minimum(log_p + rest[reach] - rest[place], 0.0)
        running = np.cumsum(np.exp(log_q))
        upto = running - np.concatenate([[0.0], running])[offset[source]]
        upto[offset[1:] - 1] = np.inf  # the last arc takes what rounding leaves
        per_state = np.zeros(n_chars + len(units), dtype=np.int64)
        per_state[np.arange(n_chars) + unit] = count

        base, used = self.n_states, self.n_arcs
        with np.errstate(divide="ignore"):
            log_other = np.where(count[source] > 1, np.log1p(-np.minimum(np.exp(log_q), 1.0)), -np.inf)
        self._append("first", base + 1, used + np.cumsum(per_state))
        for name, values in (("piece", piece), ("target", base + reach), ("log_q", log_q), ("log_other", log_other), ("upto", upto)):
            self._append(name, used, values)
        self.n_states, self.n_arcs = base + len(per_state), used + n_arcs
        for w, s in zip(words, base + ends - size + np.arange(len(units)), strict=True):
            self.start[w] = int(s)

    def states(self, words: list[str]) -> np.ndarray:
        known = self.start.get
        found = list(map(known, words))
        if None in found:
            new = list(dict.fromkeys(w for w, s in zip(words, found, strict=True) if s is None))
            self.add(new)
            found = list(map(known, words))
        return np.array(found, dtype=np.int64)

    def is_end(self, states: np.ndarray) -> np.ndarray:
        return self.first[states + 1] == self.first[states]

    def draw(self, start: np.ndarray, seed: np.ndarray, number: np.ndarray, round_: int) -> tuple[np.ndarray, np.ndarray]:
        """A path for each word, independent of each other: (arcs, offsets of the words)."""
        state, active = start.copy(), np.arange(len(start))
        taken, step = [], 0
        length = np.zeros(len(start), dtype=np.int64)
        while len(active):
            here = state[active]
            u = _uniform(seed[active], number[active], (round_ << 32) + step)  # a word may have any number of steps
            arc = self.first[here]
            more = np.flatnonzero(u >= self.upto[arc])
            while len(more):
                arc[more] += 1
                more = more[u[more] >= self.upto[arc[more]]]
            taken.append((active, arc))
            length[active] += 1
            to = self.target[arc]
            state[active] = to
            active = active[~self.is_end(to)]
            step += 1
        offsets = np.concatenate([[0], np.cumsum(length)])
        path = np.zeros(offsets[-1], dtype=np.int64)
        for k, (words, arcs) in enumerate(taken):
            path[offsets[words] + k] = arcs
        return path, offsets

    def other(self, avoid: set[int], state: int, seed: int, tag: int) -> list[int]:
        """A path from ``state`` to its word's end whose first arc is none of ``avoid``."""
        out: list[int] = []
        begin, end = int(self.first[state]), int(self.first[state + 1])
        while begin < end:
            arcs = [a for a in range(begin, end) if out or a not in avoid]
            q = np.exp(self.log_q[arcs]).tolist()
            u = _number(seed, tag, 1 << 20, len(out)) * sum(q)
            for arc, share in zip(arcs, q, strict=True):
                u -= share
                if u < 0:
                    break
            out.append(arc)
            state = int(self.target[arc])
            begin, end = int(self.first[state]), int(self.first[state + 1])
        return out

    def state_of(self, arc: int) -> int:
        return int(np.searchsorted(self.first[: self.n_states + 1], arc, side="right")) - 1


def top_k(lattices: Lattices, draws: list[tuple[np.ndarray, np.ndarray]], seed: int, k: int) -> list[tuple[np.ndarray, float, float]]:
    """(arcs, log-probability, inclusion) of the k segmentations of highest perturbed log-probability.

    ``draws`` holds k independent paths of the text with the offsets of its words;
    the first is the top segmentation, the others supply the words after a split.
    """
    found: list[tuple[np.ndarray, np.ndarray, float]] = []
    queue: list[tuple[float, int, int, frozenset]] = []  # -bound, sample that it was split from, arc, excluded arcs

    def split(path: np.ndarray, bound: float, at: int, avoid: frozenset) -> None:
        """Queue the sets that agree with ``path`` up to an arc from ``at`` on and leave it there."""
        if len(path) == at:
            return
        own = path[at:]
        log_q = lattices.log_q[path]
        before = np.cumsum(log_q) - log_q
        left = lattices.log_other[own].astype(np.float64)
        if avoid:
            taken = np.exp(lattices.log_q[[*avoid, path[at]]]).sum()
            left[0] = np.log1p(-taken) if taken < 1 - 1e-12 else -np.inf
        z = before[at:] + left + _gumbel(_uniform(_key(seed, len(found), 1 << 21), np.arange(at, len(path))))
        with np.errstate(over="ignore"):
            bounds = -np.log(np.exp(-bound) + np.exp(-z))
        some = np.argpartition(-bounds, k)[: k + 1] if len(bounds) > k + 1 else np.arange(len(bounds))
        for i in some:
            if bounds[i] > -np.inf:
                gone = frozenset([int(own[i])]) | (avoid if i == 0 else frozenset())
                heapq.heappush(queue, (-float(bounds[i]), len(found), at + int(i), gone))

    path, offsets = draws[0]
    bound = -math.log(-math.log(_number(seed, 0, 1 << 22, 0)))
    at, avoid = 0, frozenset()
    while True:
        split(path, bound, at, avoid)
        found.append((path, offsets, bound))
        if len(found) == k or not queue:
            break
        minus, origin, at, avoid = heapq.heappop(queue)
        bound = -minus
        old, old_offsets, _ = found[origin]
        word = int(np.searchsorted(old_offsets, at, side="right")) - 1
        turn = lattices.other(set(avoid), lattices.state_of(int(old[at])), seed, len(found))
        fresh, fresh_offsets = draws[len(found)]
        head = np.concatenate([old[:at], np.array(turn, dtype=np.int64)])
        path = np.concatenate([head, fresh[fresh_offsets[word + 1] :]])
        offsets = np.concatenate([old_offsets[: word + 1], len(head) + fresh_offsets[word + 1 :] - fresh_offsets[word + 1]])
    threshold = -queue[0][0] if queue else -np.inf
    out = []
    for path, _, _ in found:
        log_p = float(lattices.log_q[path].sum())
        out.append((path, log_p, 1.0 if threshold == -np.inf else float(-np.expm1(-np.exp(min(log_p - threshold, 50.0))))))
    return out


_workers: dict[bytes, Lattices] = {}


def lattices_of(model: bytes) -> Lattices:
    """The worker's lattices of a model, kept between batches."""
    key = xxhash.xxh64_digest(model)
    if key not in _workers:
        _workers[key] = Lattices(Pieces(model))
    return _workers[key]


def units(text: str) -> list[str]:
    """The words of a text, each without the one space in front of it that the model adds or finds."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if "  " not in text and text[-1] != " " and text[0] != " ":
        return text.split(" ")
    return [u[1:] for u in _UNIT.findall(" " + text)]


def _ids(lattices: Lattices, paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Piece numbers of paths, one after the other, and their offsets."""
    lengths = np.array([len(p) for p in paths], dtype=np.int64)
    ids = lattices.piece[np.concatenate([*paths, np.zeros(0, dtype=np.int64)])]
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        raw = {int(c): [lattices.pieces.byte_id[b] for b in chr(-1 - int(c)).encode("utf-8", "surrogatepass")] for c in np.unique(ids[odd])}
        size = np.ones(len(ids), dtype=np.int64)
        size[odd] = [len(raw[int(c)]) for c in ids[odd]]
        place = np.cumsum(size) - size
        wide = np.repeat(ids, size)
        for i in odd:
            wide[place[i] : place[i] + size[i]] = raw[int(ids[i])]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(lengths)])]
        return wide, ends
    return ids, np.concatenate([[0], np.cumsum(lengths)])


def encode_rows(lattices: Lattices, keys: list, texts: list[str | None], k: int) -> tuple[list[int], list[int], np.ndarray, np.ndarray, list, list]:
    """For rows: row index, sample number, piece numbers and their offsets, log-probability, inclusion."""
    if len(lattices.start) > UNITS_KEPT:
        lattices.clear()
    words = [units(t or "") for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    seeds = np.array([xxhash.xxh64_intdigest(repr(key).encode(), SEED) for key in keys], dtype=np.uint64)
    start = lattices.states([w for ws in words for w in ws])
    first = np.cumsum(sizes) - sizes
    number = np.arange(len(start)) - np.repeat(first, sizes)
    flat = [lattices.draw(start, np.repeat(seeds, sizes), number, r) for r in range(k)]
    rows, samples, paths, log_ps, inclusion = [], [], [], [], []
    for i in range(len(texts)):
        draws = []
        for path, offsets in flat:
            own = offsets[first[i] : first[i] + sizes[i] + 1]
            draws.append((path[own[0] : own[-1]], own - own[0]))
        for s, (path, log_p, inc) in enumerate(top_k(lattices, draws, int(seeds[i]), k)):
            rows.append(i)
            samples.append(s)
            paths.append(path)
            log_ps.append(log_p)
            inclusion.append(inc)
    ids, ends = _ids(lattices, paths)
    return rows, samples, ids, ends, log_ps, inclusion


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, k: int = SAMPLES, model_path: str = MODEL, check: bool = False) -> DataFrame:
    """doc_id, sample, ids, n_pieces, log_prob and inclusion: k distinct segmentations of every text.

    With ``check`` every sample is decoded again, and ``round_trip`` says whether that
    gives the text (null: empty; U+2581 counts as a space).

    The model (half a megabyte) is read on the driver and sent along, so executors need no file.
    """
    required(docs, ["doc_id", "text"])
    rows = docs.select("doc_id", "text")
    model = rows.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = lattices_of(model.value)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1)
            at = 0
            while at < b.num_rows:
                held, chars, end = [], 0, at
                while end < b.num_rows and chars < 5 * UNITS_AT_ONCE:
                    held.append(texts[end].as_py())
                    chars += len(held[-1] or "")
                    end += 1
                of, sample, ids, ends, log_p, inclusion = encode_rows(lattices, keys[at:end], held, k)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                extra = []
                if check:
                    back = decoded(lattices.pieces, ids, ends)
                    plain = [(t or "").replace(SPACE, " ").encode() for t in held]
                    extra = [pa.array([x == plain[i] for x, i in zip(back, of, strict=True)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(np.array(of, dtype=np.int64) + at)),
                        pa.array(np.array(sample, dtype=np.int32)),
                        lists,
                        pa.array(np.diff(ends).astype(np.int32)),
                        pa.array(np.array(log_p, dtype=np.float64)),
                        pa.array(np.array(inclusion, dtype=np.float64)),
                        *extra,
                    ],
                    schema.names,
                )
                at = end

    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("sample", T.IntegerType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("n_pieces", T.IntegerType()),
            T.StructField("log_prob", T.DoubleType()),
            T.StructField("inclusion", T.DoubleType()),
            *([T.StructField("round_trip", T.BooleanType())] if check else []),
        ]
    )
    return rows.mapInArrow(run, schema)


def decoded(pieces: Pieces, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The texts, in UTF-8, of piece numbers that follow one another; text i has those from ``ends[i]`` to ``ends[i + 1]``."""
    joined = pieces.raw.take(pa.array(ids, pa.int32()))
    upto = np.frombuffer(joined.buffers()[1], dtype=np.int64, count=len(joined) + 1) if len(joined) else np.zeros(1, dtype=np.int64)
    data = memoryview(joined.buffers()[2] or b"")
    places = upto[ends].tolist()
    texts = (bytes(data[a:b]).replace(SPACE.encode(), b" ") for a, b in zip(places, places[1:]))
    return [t[1:] if t.startswith(b" ") else t for t in texts]


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, sample and the text that ``ids`` stand for; null ids give null."""
    rows = encoded.select("doc_id", "sample", "ids")
    model = rows.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattices_of(model.value).pieces
        for b in batches:
            lists = b.column(2)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            back = decoded(pieces, lists.flatten().to_numpy(zero_copy_only=False), ends)
            texts = [x.decode("utf-8", "replace") if known else None for x, known in zip(back, lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, type=pa.string())], ["doc_id", "sample", "text"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], rows.schema["sample"], T.StructField("text", T.StringType())]))


def op5_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), check=True)
