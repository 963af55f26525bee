"""Nearest neighbours by inner product over shifted Hilbert orderings.

Several curves order all vectors: each projects them on its own random directions, shifts its
grid and numbers the cells along a Hilbert curve.  Spark range-partitions each ordering and
numbers its rows, so that every vector has a rank on every curve.  A query's window on a curve
are the blocks of ``ROWS`` ranks that come within ``w`` ranks of its own; what stands there is
scored with the original vectors, and the windows of all curves merge and are ranked anew.

How wide windows must be depends on the vectors, so ``w`` is measured: for ``SAMPLE`` queries the
true neighbours are found by brute force, and ``w`` is the distance in ranks, on the curve where
it is least, within which a share ``TARGET`` of them stands.  Where vectors have few real
dimensions windows are narrow; spread evenly over many dimensions they must be a good part of the
table, which no ordering mends.

Equal vectors are one point of the curves, however many rows they have; of its rows the k + 1
smallest can be among k neighbours.

Defined results: vectors that are null, zero, of another length than most or that hold null or
non-finite components take no part; equal products go to the smaller id; fewer candidates than k
are all returned; a query's own row alone is no candidate, rows that repeat its id are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .components import salted_join
from .storage import map_batches, written

CURVES = 4
DIMENSIONS = 8
BITS = 4
#: Ranks of a block.
ROWS = 2048
#: Queries whose true neighbours are found to measure windows, and the share of these within them.
SAMPLE, TARGET = 64, 0.95
#: Queries whose neighbours so far a task holds.
HELD = 10_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer cells (rows) of so many bits (Skilling, 2004)."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swapped = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swapped)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swapped)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    keys = np.zeros(cells.shape[0], dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            keys = keys << 1 | (x[i] >> bit & 1)
    return keys


def curve_keys(vectors: np.ndarray, curve: int) -> np.ndarray:
    """Keys of the vectors' directions on one curve: its own projection and shift of the grid."""
    rng = np.random.default_rng(1000 + curve)
    basis = np.linalg.qr(rng.standard_normal((vectors.shape[1], min(DIMENSIONS, vectors.shape[1]))))[0]
    shift = rng.random(basis.shape[1])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    spread = unit @ basis * np.sqrt(vectors.shape[1])  # about one in each direction
    cells = np.floor((np.clip(spread, -3, 3) + 3) / 6 * ((1 << BITS) - 1) + shift)
    return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS)


def valid_vectors(rows: DataFrame, asks) -> DataFrame:
    """vec_id, embedding and asks (a condition) of the rows that take part."""
    kind = "array<float>" if dict(rows.dtypes)["embedding"] == "array<float>" else "array<double>"
    e = F.col("embedding").cast(kind)
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"), asks.alias("asks")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    size = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (size["n"] if size else -1))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _best(scores: np.ndarray, x: np.ndarray, q: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, products) of the k largest products, ties to the smaller id.

    The scores are matrix products; those that may count are summed anew in the order of the components, so that
    a product doesn't depend on how many were formed together.
    """
    near = np.arange(len(scores))
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge - 1e-12 * (1 + abs(edge)))
    exact = np.add.accumulate(x[near] * q, axis=1)[:, -1] if len(near) else np.empty(0)
    order = np.lexsort((ids[near], -exact))[:k]
    return near[order], exact[order]


def _points(taking: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(point, vec_id, asks, embedding of each distinct vector; point, vec_id, row of its k + 1 smallest rows)."""
    points = taking.groupBy("point").agg(F.min("vec_id").alias("vec_id"), F.max("asks").alias("asks"), F.first("embedding").alias("embedding"))
    order = Window.partitionBy("point").orderBy("vec_id", "row")
    rows = taking.select("point", "vec_id", "row").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place")
    return points, rows


def _named(vectors: DataFrame) -> DataFrame:
    """vectors with the digest of each vector as its point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding")) + 0.0 if batch.num_rows else np.empty((0, 0))  # without negative zeros
            names = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.binary())], [*batch.schema.names, "point"])

    return map_batches(vectors, run, StructType([*vectors.schema.fields, StructField("point", BinaryType())]))


def _ordered(points: DataFrame, partitions: int) -> DataFrame:
    """Each point on each curve: curve, part, place in the part, and the point's columns."""
    kind = dict(points.dtypes)["embedding"]
    names = ["curve", "key", "point", "vec_id", "asks", "embedding"]

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, n = _matrix(batch.column("embedding")), batch.num_rows
                for curve in range(CURVES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, curve, dtype=np.int32)), pa.array(curve_keys(x, curve)), *(batch.column(c) for c in names[2:])], names)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), dict.fromkeys(range(CURVES), 0)
        for batch in batches:
            curve = batch.column("curve").to_numpy()
            places = np.empty(batch.num_rows, dtype=np.int64)
            for c in np.unique(curve).tolist():
                here = np.flatnonzero(curve == c)
                places[here] = at[c] + np.arange(len(here))
                at[c] += len(here)
            yield pa.RecordBatch.from_arrays([batch.column("curve"), pa.array(np.full(batch.num_rows, part, dtype=np.int32)), pa.array(places), *(batch.column(c) for c in names[2:])], ["curve", "part", "place", *names[2:]])

    columns = f"point binary, vec_id long, asks boolean, embedding {kind}"
    keyed = map_batches(points.select(*names[2:]), key, f"curve int, key long, {columns}")
    dealt = keyed.repartitionByRange(partitions, "curve", "key", "point").sortWithinPartitions("curve", "key", "point")
    return map_batches(dealt, number, f"curve int, part int, place long, {columns}")


def _ranked(points: DataFrame, partitions: int) -> tuple[DataFrame, int]:
    """(curve, rank and the point's columns; number of points)."""
    ordered = written(_ordered(points, partitions), "ann-curves")
    counts = sorted((r["curve"], r["part"], r["count"]) for r in ordered.groupBy("curve", "part").count().collect())  # a row a part and curve
    before, rows = {}, []
    for curve, part, n in counts:
        rows.append((curve, part, before.get(curve, 0)))
        before[curve] = before.get(curve, 0) + n
    offsets = ordered.sparkSession.createDataFrame(rows, "of int, of_part int, before long")
    ranked = ordered.join(F.broadcast(offsets), (F.col("curve") == F.col("of")) & (F.col("part") == F.col("of_part")))
    return ranked.select("curve", (F.col("before") + F.col("place")).alias("rank"), "point", "vec_id", "asks", "embedding"), max(before.values(), default=0)


_HITS = "point binary, other binary, vec_id long, score double"


def _hits(rows: list[tuple]) -> pa.RecordBatch:
    """From (point, others, their ids, products) of each query."""
    many = [len(r[2]) for r in rows]
    asked = [p for (p, *_), n in zip(rows, many) for _ in range(n)]
    columns = [asked, [o for r in rows for o in r[1]], *(np.concatenate([r[j] for r in rows]) if rows else () for j in (2, 3))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.float64()))], ["point", "other", "vec_id", "score"])


def _first(hits: DataFrame, k: int) -> DataFrame:
    """The k nearest others of each point."""
    order = Window.partitionBy("point").orderBy(F.desc("score"), "vec_id", "other")
    return hits.distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at")


def brute_force(points: DataFrame, asked: list[tuple[bytes, np.ndarray]], k: int) -> DataFrame:
    """The k nearest others of a bounded number of points, by all products: each task keeps k of each."""
    shared = points.sparkSession.sparkContext.broadcast(([p for p, _ in asked], np.stack([v for _, v in asked])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        best: list[tuple] = [([], np.empty(0, dtype=np.int64), np.empty(0)) for _ in names]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids, others = _matrix(batch.column("embedding")), batch.column("vec_id").to_numpy(), batch.column("point")
            scores = q @ x.T
            for j in range(len(names)):
                found, exact = _best(scores[j], x, q[j], ids, k)
                merged = [*best[j][0], *others.take(pa.array(found)).to_pylist()], np.concatenate((best[j][1], ids[found])), np.concatenate((best[j][2], exact))
                order = np.lexsort((merged[1], -merged[2]))[:k]
                best[j] = [merged[0][o] for o in order], merged[1][order], merged[2][order]
        yield _hits([(names[j], *best[j]) for j in range(len(names))])

    return _first(map_batches(points.select("point", "vec_id", "embedding"), run, _HITS), k)


def _window(points: DataFrame, ranked: DataFrame, k: int) -> int:
    """Ranks to both sides within which, on the nearest curve, a share TARGET of true neighbours stands."""
    sample = points.where("asks").orderBy(F.xxhash64("point"), "point").limit(SAMPLE).select("point", "embedding").collect()
    if not sample:
        return 0
    true = brute_force(points, [(bytes(r["point"]), np.array(r["embedding"], dtype=np.float64)) for r in sample], k).select("point", "other").collect()  # SAMPLE * k rows
    wanted = {bytes(r[c]) for r in true for c in ("point", "other")}
    places = ranked.join(F.broadcast(ranked.sparkSession.createDataFrame([(bytearray(p),) for p in wanted], "wanted binary")), F.col("point") == F.col("wanted")).select("point", "curve", "rank").collect()
    at = {(bytes(r["point"]), r["curve"]): r["rank"] for r in places}
    least = [min(abs(at[bytes(r["point"]), c] - at[bytes(r["other"]), c]) for c in range(CURVES)) for r in true]
    return int(np.quantile(least, TARGET, method="higher"))


def _in_windows(ranked: DataFrame, points: int, window: int, k: int, partitions: int) -> DataFrame:
    """The k nearest others of each asking point in the blocks of its windows, those of one task together."""
    block = lambda rank: F.floor(rank / ROWS).cast("long")
    from_, to = block(F.greatest(F.col("rank") - window, F.lit(0))), block(F.least(F.col("rank") + window, F.lit(max(0, points - 1))))
    visits = ranked.where("asks").withColumn("block", F.explode(F.sequence(from_, to)))
    both = ranked.withColumns({"block": block(F.col("rank")), "asks": F.lit(False)}).unionByName(visits).select("curve", "block", "asks", "point", "vec_id", "embedding")
    # neighbouring blocks come to one task, where a query's windows merge before anything is sent on
    dealt = both.repartitionByRange(partitions, "curve", "block").sortWithinPartitions("curve", "block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, there, seen = None, [], None, set()
        best: dict[bytes, tuple] = {}  # of the queries that the last block had

        def sent(names: list[bytes]) -> pa.RecordBatch:
            return _hits([(n, *best.pop(n)) for n in names])

        for batch in batches:
            curve, blocks, asks = batch.column("curve").to_numpy(), batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            if not batch.num_rows:
                continue
            x, ids, names = _matrix(batch.column("embedding")), batch.column("vec_id").to_numpy(), batch.column("point").to_pylist()
            edges = np.flatnonzero(np.concatenate(([True], (curve[1:] != curve[:-1]) | (blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1]))))
            for a, b in zip(edges, [*edges[1:], len(curve)]):
                if (curve[a], blocks[a]) != current:
                    yield sent([n for n in best if n not in seen])
                    current, held, there, seen = (curve[a], blocks[a]), [], None, set()
                if not asks[a]:
                    held.append((x[a:b], ids[a:b], names[a:b]))  # ROWS at most
                    continue
                if there is None:
                    there = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [n for h in held for n in h[2]]
                for at in range(a, b, 256):
                    upto = min(b, at + 256)
                    scores = x[at:upto] @ there[0].T
                    for j, name in enumerate(names[at:upto]):
                        seen.add(name)
                        found, exact = _best(scores[j], there[0], x[at + j], there[1], k)
                        others, known, products = best.get(name, ([], np.empty(0, dtype=np.int64), np.empty(0)))
                        others, known, products = others + [there[2][o] for o in found], np.concatenate((known, there[1][found])), np.concatenate((products, exact))
                        order = np.lexsort((known, -products))[:k]
                        best[name] = [others[o] for o in order], known[order], products[order]
                    if len(best) > HELD:
                        yield sent(list(best))
        yield sent(list(best))

    return map_batches(dealt, run, _HITS)


def search(vectors: DataFrame, queries, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows found nearest to each row for which the condition queries holds."""
    spark = vectors.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    taking = written(_named(valid_vectors(vectors, F.coalesce(queries, F.lit(False)))).withColumn("row", F.monotonically_increasing_id()), "ann-vectors")
    points, rows = _points(taking, k)
    points = written(points, "ann-points")
    ranked, n = _ranked(points, partitions)
    # a point is its own neighbour by its other rows, so one more is looked for
    near = _first(_in_windows(ranked, n, _window(points, ranked, k + 1), k + 1, partitions), k + 1)
    members = rows.select(F.col("point").alias("of"), F.col("vec_id").alias("id"), F.col("row").alias("other_row"))
    each = near.join(members, F.col("other") == F.col("of")).select("point", "other_row", "id", "score")
    order = Window.partitionBy("point").orderBy(F.desc("score"), "id", "other_row")
    lists = each.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1).drop("at").withColumnRenamed("point", "asked")
    asking = taking.where("asks").select("point", F.col("vec_id").alias("query_id"), "row")
    hits = salted_join(asking, F.col("row"), lists, F.col("point") == F.col("asked")).where(F.col("row") != F.col("other_row"))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id", "other_row"))
    return hits.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
