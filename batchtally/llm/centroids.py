r"""Centroid clustering in whole numbers, with geometric drift tightening.

Every vector carries an upper bound of the distance to its centroid and a lower
bound of that to any other. When centroids move, the upper bound grows by the
drift of its own. The vectors of cluster i lie in a sphere around the old
centroid i; how much nearer the moved centroid j can come to any of them is a
question in one plane: with the line from the old to the new centroid j as axis,
the gain d(x, old) - d(x, new) grows along the axis and falls with the distance
from it, so its largest value over the sphere is bounded by corners of a few arcs.
That is never more than the full drift of j and mostly far less; it may be negative. The
lower bound falls by the largest of these over j. Vectors whose bounds still
part are settled without looking at other centroids; the others are ambiguous and
are compared with all centroids exactly.

Spark deals the vectors; tasks work on Arrow batches and hold the centroids only.
Sums of a cluster are partial sums of tasks, added in exact decimals. Each pass
reads the table the pass before wrote and replaces it.

Defined results
* vectors of another length, or with a null or non-finite component, are left out, and so is a null vector;
* components become floor(256 * x); beyond 2^27 in size they raise an error, since squared distances would not fit 64 bits;
* ties go to the smaller centroid number; empty clusters keep their centroid;
* the first centroids are the vectors with the smallest hashes of their id (of equal ids the smaller vector first); rows without an id are
  clustered, but start no cluster while any other row can; fewer rows than ``k`` make fewer clusters;
* repeated rows each count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchtally.llm.common import required
from batchtally.plans.storage import fresh_path, remove

SIZE, K, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
LARGEST = 1 << 27
EXACT = 1 << 22  # up to this size all sums of products are exact in doubles
ARCS = 16
SLACK = 1e-9  # relative, far above the rounding of a few dozen additions


def whole_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", column: str = "embedding", size: int = SIZE) -> DataFrame:
    """vec_id and ``v``, the whole-number components, of the vectors that are kept."""
    required(vectors, [vec_id, column])
    x = F.col(column).cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    scaled = lambda e: F.floor(e * SCALE)
    too_large = F.raise_error(F.lit(f"components beyond {LARGEST}/{SCALE} are not clustered")).cast("int")
    whole = F.transform(x, lambda e: F.when(F.abs(e) * SCALE <= LARGEST - 1, scaled(e).cast("int")).otherwise(too_large))
    return vectors.filter((F.size(x) == size) & ~bad).select(F.col(vec_id).alias("vec_id"), whole.alias("v"))


def first_centroids(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """Bounded top-k by the hash of the id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return np.array([r["v"] for r in found], dtype=np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``v`` to all of ``c``, as 64-bit integers."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(1) for row in c], axis=1)


def gain_bound(radius: np.ndarray, centres: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """[i, j]: no vector within ``radius[i]`` of ``centres[i]`` is nearer to ``new[j]`` than to ``old[j]`` by more than this."""
    move = new - old
    drift = np.sqrt((move**2).sum(1))
    axis = np.divide(move, drift[:, None], out=np.zeros_like(move), where=drift[:, None] > 0)
    middle = (old + new) / 2
    along = centres @ axis.T - (middle * axis).sum(1)[None, :]  # [i, j], measured from between old and new
    square = (centres**2).sum(1)[:, None] - 2 * centres @ middle.T + (middle**2).sum(1)[None, :]
    off = np.sqrt(np.maximum(square - along**2, 0))
    half, r = drift[None, :] / 2, radius[:, None]

    def gain(x, y):
        near, far = np.hypot(x - half, y), np.hypot(x + half, y)
        # (far^2 - near^2) / (far + near), which does not cancel
        return np.divide(4 * x * half, near + far, out=np.zeros_like(x), where=near + far > 0)

    best = np.full(along.shape, -np.inf)
    angle = np.linspace(-np.pi / 2, np.pi / 2, 2 * ARCS + 1)
    for low, high in zip(angle[:-1], angle[1:], strict=True):
        # arc of the sphere's front: furthest along, and nearest to (ahead) or furthest from (behind) the axis
        x = along + r * np.maximum(np.cos(low), np.cos(high))
        y = np.where(x >= 0, np.maximum(off + r * np.sin(low), 0), off + r * np.sin(high))
        best = np.maximum(best, gain(x, y))
    # the front reaches the axis, or the back holds the largest value where all lies behind the middle
    behind = along + r <= 0
    best = np.where((off <= r) & ~behind, np.minimum(gain(along + r, np.zeros_like(along)), drift[None, :]), best)
    return np.minimum(best, drift[None, :]) + SLACK * (1 + np.abs(along) + off + r + drift[None, :])


STATE = "vec_id {id}, v array<int>, c int, u double, l double"


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64) if len(column) else np.zeros((0, 1), dtype=np.int64)


def scan(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, distance to it, and distance to the next."""
    d = squared(v, c)
    best = d.argmin(axis=1)
    own = d[np.arange(len(v)), best]
    d[np.arange(len(v)), best] = np.iinfo(np.int64).max
    other = np.sqrt(d.min(axis=1).astype(np.float64)) if len(c) > 1 else np.full(len(v), np.inf)
    return best.astype(np.int32), np.sqrt(own.astype(np.float64)), other


def settle(
    v: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, new: np.ndarray, drift: np.ndarray, loss: np.ndarray, apart: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Assignment and bounds after a move of the centroids, and how many vectors were ambiguous."""
    a, upper, lower = a.copy(), upper + drift[a], lower - loss[a]
    bound = np.maximum(lower, apart[a])
    part = lambda at: upper[at] * (1 + SLACK) + SLACK < bound[at] * (1 - SLACK)
    open_ = np.flatnonzero(~part(slice(None)))
    if len(open_):
        diff = (v[open_] - new[a[open_]]).astype(np.float64)
        upper[open_] = np.sqrt((diff * diff).sum(1)) * (1 + SLACK)
        open_ = open_[~part(open_)]
    if len(open_):
        a[open_], upper[open_], lower[open_] = scan(v[open_], new)
    return a, upper, lower, len(open_)


def assigned(rows: DataFrame, c: np.ndarray) -> DataFrame:
    """The first assignment: every vector with all centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, upper, lower = scan(_vectors(b.column(1)), c)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(a), pa.array(upper), pa.array(lower)], ["vec_id", "v", "c", "u", "l"])

    return rows.mapInArrow(run, _state_schema(rows))


def _state_schema(rows: DataFrame) -> T.StructType:
    more = [T.StructField("c", T.IntegerType()), T.StructField("u", T.DoubleType()), T.StructField("l", T.DoubleType())]
    return T.StructType([rows.schema["vec_id"], T.StructField("v", T.ArrayType(T.IntegerType())), *more])


def moved(state: DataFrame, old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> DataFrame:
    """The assignment after ``old`` centroids became ``new``; ``radius`` bounds the cluster spheres around ``old``."""
    o, n = old.astype(np.float64), new.astype(np.float64)
    drift = np.sqrt(((n - o) ** 2).sum(1)) * (1 + SLACK)
    gains = gain_bound(radius, o, o, n)
    np.fill_diagonal(gains, -np.inf)
    loss = gains.max(axis=1) if len(o) > 1 else np.zeros(len(o))
    between = np.sqrt(np.maximum(squared(new, new).astype(np.float64), 0))
    np.fill_diagonal(between, np.inf)
    apart = between.min(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bounds = [b.column(i).to_numpy() for i in (2, 3, 4)]
                a, upper, lower, _ = settle(_vectors(b.column(1)), *bounds, new, drift, loss, apart)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(a), pa.array(upper), pa.array(lower)], b.schema.names)

    return state.mapInArrow(run, state.schema)


def sums(state: DataFrame, k: int, size: int) -> tuple[list[list[int]], list[int], np.ndarray]:
    """Exact component sums, counts and sphere radii of the clusters: k x (size + 1) numbers from partial sums of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, radius = np.zeros((k, size + 1), dtype=np.int64), np.zeros(k)
        for b in batches:
            if b.num_rows:
                v, a, upper = _vectors(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
                order = np.argsort(a, kind="stable")
                at = np.flatnonzero(np.diff(a[order], prepend=-1))
                total[a[order][at], :size] += np.add.reduceat(v[order], at, axis=0)
                total[:, size] += np.bincount(a, minlength=k)
                np.maximum.at(radius, a, upper)
        c, pos = np.divmod(np.arange(k * (size + 1), dtype=np.int32), np.int32(size + 1))
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(pos), pa.array(total.ravel()), pa.array(radius[c])], ["c", "pos", "n", "r"])

    parts = state.select("v", "c", "u").mapInArrow(run, "c int, pos int, n long, r double")
    found = parts.groupBy("c", "pos").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.max("r").alias("r")).collect()
    total, radius = [[0] * (size + 1) for _ in range(k)], np.zeros(k)
    for r in found:
        total[r["c"]][r["pos"]], radius[r["c"]] = int(r["n"]), r["r"]
    return [t[:size] for t in total], [t[size] for t in total], radius


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def _distance(v: Column, centroid: Column) -> Column:
    terms = F.zip_with(v, centroid, lambda x, y: (x.cast("bigint") - y) * (x.cast("bigint") - y))
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda s, x: s + x)


def clustered(
    vectors: DataFrame, *, vec_id: str = "vec_id", column: str = "embedding", size: int = SIZE, k: int = K, rounds: int = ROUNDS, seed: int = SEED
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, v and c (cluster) of every kept vector after ``rounds`` rounds and a last assignment; and the final centroids."""
    spark = vectors.sparkSession

    def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
        path = fresh_path(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    rows, path = stored(whole_vectors(vectors, vec_id=vec_id, column=column, size=size), "vectors")
    now = first_centroids(rows, k, seed)
    if not len(now):
        return rows.withColumn("c", F.lit(0)), now
    state, next_path = stored(assigned(rows, now), "assigned")
    remove(spark, path)
    path = next_path
    for _ in range(rounds):
        total, counts, radius = sums(state, len(now), size)
        new = np.array([[s // n for s in t] if n else row for t, n, row in zip(total, counts, now.tolist(), strict=True)], dtype=np.int64)
        state, next_path = stored(moved(state, now, new, radius), "assigned")
        remove(spark, path)  # every later pass starts from the table just written
        path, now = next_path, new
    return state.select("vec_id", "v", "c"), now


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    rows, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    if not len(centroids):
        centroids = np.zeros((1, SIZE), dtype=np.int64)  # of an empty result
    texts = ";".join(",".join(map(str, c)) for c in centroids.tolist())
    table = F.transform(F.split(F.lit(texts), ";"), lambda t: F.split(t, ",").cast("array<bigint>"))
    digests = F.array(*[F.lit(_digest(c)) for c in centroids])
    at = F.col("c") + 1
    found = rows.select("vec_id", F.col("c").alias("cluster"), _distance(F.col("v"), F.element_at(table, at)).alias("distance"), F.element_at(digests, at).alias("centroid_sha256"))
    of = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # one row a cluster
    inertia = {r["cluster"]: int(r["d"]) for r in of}
    per = F.array(*[F.lit(inertia.get(i, 0)).cast("bigint") for i in range(len(centroids))])
    return found.select("vec_id", "cluster", "distance", F.element_at(per, F.col("cluster") + 1).alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), "centroid_sha256")


def _sql() -> str:
    """The rounds as named tables."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {SIZE} AND list_count(embedding) = {SIZE} AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))),
parts AS MATERIALIZED (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM kept),
c0 AS MATERIALIZED (
  SELECT k, v FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS k, v FROM kept) WHERE k < {K})"""
    ]
    for r in range(ROUNDS + 1):
        square = "list_sum(list_transform(list_zip(kept.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT id, min(struct_pack(d := d, k := k)) AS best FROM (SELECT id, k, {square} AS d FROM kept, c{r} AS c) GROUP BY id)""")
        if r < ROUNDS:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT k, coalesce(m.v, c.v) AS v FROM c{r} AS c LEFT JOIN (
    SELECT k, list(x ORDER BY p) AS v FROM (
      SELECT best.k AS k, p, (sum(x) - ((sum(x) % count(*) + count(*)) % count(*))) // count(*) AS x
      FROM parts JOIN a{r} USING (id) GROUP BY best.k, p) GROUP BY k) m USING (k))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM kept JOIN a{ROUNDS} USING (id) JOIN c{ROUNDS} AS c ON c.k = best.k"""


OP13_SQL = _sql()
