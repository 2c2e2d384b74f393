"""Exact top-k inner products by a pivot-distance index.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, and queries a zero: the largest inner product
is then the smallest Euclidean distance, d^2 = |q|^2 + M^2 - 2 q.x, and the triangle inequality holds. Every vector is
keyed by its nearest pivot and its distance to it; vectors of one pivot, sorted by distance, are cut into annuli, and
neighbouring annuli make up a shard, the part of the index that one task holds.

A block of queries first walks the shard nearest to it, then all others that its bounds don't exclude. A walk takes the
shard's annuli in order of their least possible distance, keeps every query's k best so far, and stops as soon as the
triangle inequality lets no further annulus hold a better one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch

K = 20
SCALE = 64
PIVOTS = 64
#: Pivots are fitted on this many vectors at most, drawn by a hash of their ids.
SAMPLE = 4096
ANNULUS_ROWS = 1024
#: A shard's rows: the more vectors there are, the larger, so that fewer shards meet every query.
SHARD_ROWS = (8192, 65536)
QUERY_ROWS = 512
#: Queries that meet a shard in one task.
GROUP_QUERIES = 1 << 17
LARGEST = (1 << 63) - 1


@dataclass
class Space:
    """What keys a vector: pivots in the lengthened space, the largest squared norm, and the number of components."""

    pivots: np.ndarray
    top: float
    dims: int

    def distances(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Distances of the rows of x to the pivots; queries have the added coordinate 0."""
        norm = (x * x).sum(1)
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top - norm, 0))
        p = self.pivots
        d = (norm + extra * extra)[:, None] + (p * p).sum(1) - 2 * (x @ p[:, :-1].T + extra[:, None] * p[:, -1])
        return np.sqrt(np.maximum(d, 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of lists as a float64 matrix, short ones padded by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    out = np.zeros((len(column), dims))
    n = np.diff(offsets)
    out[np.repeat(np.arange(len(column)), n), np.arange(len(flat)) - np.repeat(offsets[:-1], n)] = flat
    return out


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x): components as floor(scale * component), whole numbers in doubles. Rows without id, without vector or with a null or non-finite component take no part."""
    whole = F.transform(F.col(vec_col), lambda c: F.rint(c.cast("double") * scale) - F.when(F.rint(c.cast("double") * scale) > c.cast("double") * scale, 1.0).otherwise(0.0))
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(F.col(vec_col), lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x"))


def fit(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> Space | None:
    """k-means centres of a bounded sample as pivots; the largest norm and length come from all rows."""
    norm = F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)
    top, dims = rows.agg(F.max(norm), F.max(F.size("x"))).first()
    if top is None:
        return None
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").collect()
    x = np.zeros((len(got), dims))
    for i, r in enumerate(got):
        x[i, : len(r["x"])] = r["x"]
    x = np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], 1)
    x = np.unique(x[np.isfinite(x).all(1)], axis=0) if np.isfinite(top) else x[:1] * 0
    rng = np.random.default_rng(5)
    chosen, near = [int(rng.integers(len(x)))], np.full(len(x), np.inf)
    while len(chosen) < min(pivots, len(x)):
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(rng.choice(len(x), p=near / near.sum())))
    centres = x[chosen]
    for _ in range(5):
        owner = ((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
        for k in np.unique(owner):
            centres[k] = x[owner == k].mean(0)
    return Space(centres, float(top), int(dims))


def _key(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = space.distances(_matrix(batch.column(1), space.dims))
            d = np.where(np.isfinite(d), d, 0)
            p = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(d)), p])], ["vec_id", "x", "pivot", "dist"])

    return run


SHARD = "pivots array<int>, los array<double>, his array<double>, ends array<int>, ids binary, x binary"
_SHARD = [pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]


def _pack(dims: int, annulus: int, size: int):
    """Cuts rows sorted by (pivot, distance) into shards of `size`: one row each, with the annuli, the ids and the matrix; in an annulus rows are by id."""

    def shard(p: np.ndarray, d: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero(p[1:] != p[:-1]) + 1
        cuts = np.unique(np.concatenate([[0], new, *[np.arange(a, b, annulus) for a, b in zip([0, *new], [*new, len(p)], strict=True)], [len(p)]])).astype(int)
        order = np.lexsort((ids, np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))))
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        row = [[int(p[a]) for a, _ in spans], [float(d[a:b].min()) for a, b in spans], [float(d[a:b].max()) for a, b in spans], [int(b) for _, b in spans], ids[order].tobytes(), _shrunk(x[order])]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SHARD, strict=True)], ["pivots", "los", "his", "ends", "ids", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            held.append((batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(0).to_numpy(), _matrix(batch.column(1), dims)))
            rows += batch.num_rows
            if rows >= size:
                all_ = [np.concatenate(c) for c in zip(*held, strict=True)]
                for at in range(0, rows - size + 1, size):
                    yield shard(*[c[at : at + size] for c in all_])
                held, rows = [tuple(c[rows - rows % size :] for c in all_)], rows % size
        if rows:
            yield shard(*[np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _shrunk(x: np.ndarray) -> bytes:
    """A matrix of whole numbers in the smallest type that holds it, which a leading byte names."""
    top = np.abs(x).max(initial=0)
    for i, kind in enumerate((np.int8, np.int16, np.int32)):
        if top <= np.iinfo(kind).max:
            return bytes([i]) + x.astype(kind).tobytes()
    return bytes([3]) + np.ascontiguousarray(x).tobytes()


def _grown(raw: bytes, rows: int) -> np.ndarray:
    kind = (np.int8, np.int16, np.int32, np.float64)[raw[0]]
    return np.frombuffer(raw, kind, offset=1).reshape(rows, -1).astype(np.float64)


def _shards(keyed: DataFrame, dims: int, annulus: int, size: int) -> DataFrame:
    """Ranges of (pivot, distance, id) go to tasks, so a crowded pivot, or one vector repeated, spreads over many."""
    spread = keyed.repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    return spread.mapInArrow(_pack(dims, annulus, size), SHARD).withColumn("shard", F.monotonically_increasing_id())


@dataclass
class Shard:
    pivots: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    x: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Shard:
        ids = np.frombuffer(row["ids"], np.int64)
        return cls(np.array(row["pivots"]), np.array(row["los"]), np.array(row["his"]), np.array(row["ends"]), ids, _grown(row["x"], len(ids)))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, held to 64 bits: by floats where they hold them all, by Python's integers elsewhere."""
    limit = max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if limit < 1 << 53:
        return q @ x.T
    whole = [np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (q, x)]
    return np.clip(whole[0].dot(whole[1].T), -LARGEST - 1, LARGEST)


class Best:
    """The k best of each query so far: by score, ties to the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None) -> None:
        self.n, self.k = n, k
        self.floor = np.full(n, -np.inf) if floor is None else floor.copy()
        self.who, self.ids, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, who: np.ndarray, ids: np.ndarray, score: np.ndarray, own: np.ndarray) -> None:
        """A block of scores (queries x rows); own tells a query's own rows. Only scores that reach the k-th so far are looked at."""
        floor = self.floor[who]
        if score.shape[1] > self.k and score.dtype != object:
            free = np.where(own, -np.inf, score)
            floor = np.maximum(floor, np.partition(free, -self.k, axis=1)[:, -self.k])
        at, row = np.nonzero((score >= floor[:, None]) & ~own)
        w, i, s = (np.concatenate(c) for c in ((self.who, who[at]), (self.ids, ids[row]), (self.score, score[at, row])))
        order = sorted(range(len(w)), key=lambda j: (w[j], -s[j], i[j])) if s.dtype == object else np.lexsort((i, -s, w))
        w, i, s = w[order], i[order], s[order]
        first = np.searchsorted(w, np.arange(self.n))
        keep = np.arange(len(w)) - first[w] < self.k
        self.who, self.ids, self.score = w[keep], i[keep], s[keep]
        count = np.bincount(self.who, minlength=self.n)
        full = np.flatnonzero(count >= self.k)
        last = np.searchsorted(self.who, full, side="right") - 1
        # As a float below the exact score, if that has too many digits.
        kth = self.score[last].astype(np.float64)
        self.floor[full] = np.maximum(self.floor[full], np.nextafter(kth, -np.inf) if s.dtype == object else kth)


def walk(space: Space, shard: Shard, qid: np.ndarray, q: np.ndarray, best: Best) -> int:
    """Adds a shard's rows to the best of the queries; returns how many products were made."""
    d = space.distances(q, query=True)[:, shard.pivots]
    least = np.maximum(0, np.maximum(d - shard.hi, shard.lo - d))
    made = 0
    nearest = np.where(np.isfinite(least), least, 0).min(0)
    for j in np.argsort(nearest, kind="stable"):
        reach = _reach(space, q, best.floor)
        if nearest[j] > reach.max():
            break
        who = np.flatnonzero(~(least[:, j] > reach))  # what can't be compared is looked at
        if len(who):
            part = slice(shard.ends[j - 1] if j else 0, shard.ends[j])
            ids = shard.ids[part]
            best.add(who, ids, products(q[who], shard.x[part]), qid[who][:, None] == ids)
            made += len(who) * len(ids)
    return made


def _reach(space: Space, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """The distance beyond which no vector scores floor or more, with room for rounding; infinite without a k-th score."""
    with np.errstate(invalid="ignore"):
        d = np.sqrt(np.maximum((q * q).sum(1) + space.top - 2 * floor, 0))
    d = d * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(space.top))
    return np.where(np.isfinite(floor) & np.isfinite(d), d, np.inf)


_FOUND = ["query_id", "vec_id", "score"]


def _found(qid: np.ndarray, best: Best) -> list[pa.Array]:
    return [pa.array(qid[best.who]), pa.array(best.ids), pa.array([int(s) for s in best.score] if best.score.dtype == object else best.score.astype(np.int64), pa.int64())]


def _walks(space: Space, k: int, first: bool):
    """Rows (shard, part, role, shard payload | query block payload), a shard before its queries, to what the walks find.

    In the first round a row per query block: its bounds and results; later a row per result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["role"] == 0:
                    shard = Shard.of(row)
                    continue
                qid = np.frombuffer(row["q_ids"], np.int64)
                q = _grown(row["q_x"], len(qid))
                best = Best(len(qid), k, np.frombuffer(row["q_floor"]) if row["q_floor"] else None)
                walk(space, shard, qid, q, best)
                found = _found(qid, best)
                if not first:
                    yield pa.RecordBatch.from_arrays(found, _FOUND)
                    continue
                d, reach = space.distances(q, query=True), _reach(space, q, best.floor)[:, None]
                lower, upper = (d - reach).min(0), (d + reach).max(0)
                bounds = [pa.array([np.where(np.isfinite(b), b, v)], pa.list_(pa.float64())) for b, v in ((lower, -np.inf), (upper, np.inf))]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array([row["q_block"]], pa.int64()), pa.array([best.floor.tobytes()], pa.binary()), *bounds, *lists], ["q_block", "q_floor", "lower", "upper", *_FOUND])

    return run


FIRST = "q_block long, q_floor binary, lower array<double>, upper array<double>, query_id array<long>, vec_id array<long>, score array<long>"


def _meet(visits: DataFrame, queries: DataFrame, shards: DataFrame, groups: int, run, schema: str) -> DataFrame:
    """Walks of (q_block, shard): a task gets a shard once, then its query blocks one after another."""
    asked = visits.join(queries, "q_block").select("shard", F.pmod(F.xxhash64("q_block"), F.lit(groups)).alias("part"), F.lit(1).alias("role"), "q_block", "q_ids", "q_x", "q_floor")
    needed = asked.select("shard", "part").distinct() if groups > 1 else visits.select("shard", F.lit(0).cast("long").alias("part")).distinct()
    held = shards.join(needed, "shard").withColumn("role", F.lit(0))
    rows = held.unionByName(asked, allowMissingColumns=True)
    return rows.repartition("shard", "part").sortWithinPartitions("shard", "part", "role").mapInArrow(run, schema)


def _pairs(queries: DataFrame, shards: DataFrame, columns: list[str]) -> DataFrame:
    """Query blocks with the annuli of every shard: numbers only, no vectors. Shards are numbered by task and place."""
    counts = shards.groupBy(F.shiftright("shard", 33).alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per task
    tasks = F.array(*[F.struct(F.lit(r["task"] << 33).cast("long").alias("first"), F.lit(r["n"]).cast("long").alias("n")) for r in counts])
    numbers = F.flatten(F.transform(tasks, lambda t: F.sequence(t["first"], t["first"] + t["n"] - 1)))
    return queries.select("q_block", *columns, F.explode(numbers).alias("shard")).join(shards.select("shard", "pivots", "los", "his"), "shard")


def _annuli(test) -> Column:  # noqa: ANN001
    return F.transform(F.arrays_zip("pivots", "los", "his"), test)


def search(vectors: DataFrame, every: int = 20, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS, annulus_rows: int = ANNULUS_ROWS, shard_rows: int | None = None) -> DataFrame:
    """Each query's k largest integer inner products, ties to the smaller id: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by `every`, candidates all rows but the query's own id. Vectors that are
    null or hold null or non-finite components, and rows without id, take no part; shorter vectors count as padded by
    zeros; a product beyond 64 bits counts as the nearest long. Rows that repeat an id are candidates each; such a query is asked once, with its smallest vector. Fewer candidates than k give all of
    them; an empty table gives no rows; other columns are ignored.

    The driver holds the pivots and how many shards each task made.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows = integers(vectors, id_col, vec_col, scale)
    space = fit(rows, pivots)
    if space is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    keyed = rows.mapInArrow(_key(space), "vec_id long, x array<double>, pivot int, dist double")
    size = shard_rows or min(SHARD_ROWS[1], max(SHARD_ROWS[0], rows.count() // 64))
    shards = scratch.put(_shards(keyed, space.dims, annulus_rows, size))
    asked = keyed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("x", "pivot", "dist")).alias("v")).select("vec_id", "v.*")
    blocks = _shards(asked, space.dims, QUERY_ROWS, QUERY_ROWS).select(F.col("shard").alias("q_block"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), F.col("pivots").alias("q_pivots"), F.col("los").alias("q_los"))
    queries = scratch.put(blocks)
    groups = max(1, -(-queries.count() * QUERY_ROWS // GROUP_QUERIES))
    # The nearest shard: the one with an annulus around the block's own keys, as far as that can be.
    near = F.array_min(_annuli(lambda a: F.array_min(F.transform(F.arrays_zip("q_pivots", "q_los"), lambda q: F.when(q["q_pivots"] == a["pivots"], F.greatest(F.lit(0.0), q["q_los"] - a["his"], a["los"] - q["q_los"])).otherwise(F.lit(float("inf")))))))
    one = _pairs(queries, shards, ["q_pivots", "q_los"]).groupBy("q_block").agg(F.min(F.struct(near.alias("d"), "shard"))["shard"].alias("shard"))
    one = scratch.put(one)
    none = queries.select("q_block", "q_ids", "q_x", F.lit(None).cast("binary").alias("q_floor"))
    first = scratch.put(_meet(one, none, shards, groups, _walks(space, k, True), FIRST))
    # Then every other shard with an annulus that some query's bounds overlap.
    overlap = F.array_max(_annuli(lambda a: (F.get("lower", a["pivots"]) <= a["his"]) & (F.get("upper", a["pivots"]) >= a["los"])))
    rest = _pairs(first, shards, ["lower", "upper"]).where(overlap).select("q_block", "shard").join(one, ["q_block", "shard"], "left_anti")
    bounded = queries.select("q_block", "q_ids", "q_x").join(first.select("q_block", "q_floor"), "q_block")
    more = _meet(rest, bounded, shards, groups, _walks(space, k, False), "query_id long, vec_id long, score long")
    found = first.select(F.explode(F.arrays_zip("query_id", "vec_id", "score")).alias("f")).select("f.*")
    return _top(found.unionByName(more), k).select("query_id", "rank", "vec_id", "score")


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
