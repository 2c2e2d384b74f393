"""All pairs of queries and vectors by blocks: a task holds a block of queries and meets the vectors block by block.

Pairs are counted, scored, cut and multiplied as matrices where they are made, and never shuffled. A block is a row
(cluster_id, block, rows), rows being structs (id, size, keys, dims, vals); keys are a vector's hashes, in order, or its slots.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.storage import durable

PPM = 1_000_000
#: Vectors and queries of a block, and bytes of candidates that a block of queries may hold.
BASE_BLOCK, QUERY_BLOCK, HELD_BYTES = 2048, 256, 128 << 20
#: Blocks of so many bytes in all are sent to the blocks of queries; beyond, both meet by a shuffle.
BROADCAST_BYTES = 128 << 20
#: Columns of one matrix product; a dim is multiplied as a column if this share of its block's pairs has it, else pair by pair.
COLUMNS, DENSE, PRODUCTS = 512, 1 / 64, 2_000_000
NO_ID = np.iinfo(np.int64).min


WHOLE = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}


def narrow(vectors: DataFrame, *columns: str) -> DataFrame:
    """Whole-number columns in the narrowest type that holds all their values: blocks are held, and may be moved, many times."""
    whole = [c for c in columns if dict(vectors.dtypes)[c] in WHOLE]
    if not whole:
        return vectors
    ends = vectors.agg(*[f(c).alias(f"{n}_{c}") for c in whole for n, f in (("lo", F.min), ("hi", F.max))]).first()
    fits = lambda c: next(t for t, b in WHOLE.items() if -(1 << (8 * b - 1)) <= (ends[f"lo_{c}"] or 0) and (ends[f"hi_{c}"] or 0) < 1 << (8 * b - 1))
    return vectors.withColumns({c: F.col(c).cast(fits(c)) for c in whole})


def packed(vectors: DataFrame, id_col: str, val: str = "val") -> DataFrame:
    """(id, dims, vals): a row per vector."""
    return vectors.where("dim is not null").groupBy(id_col).agg(F.collect_list(F.struct("dim", F.col(val).alias("val"))).alias("c")).select(id_col, F.col("c.dim").alias("dims"), F.col("c.val").alias("vals"))


def blocks(rows: DataFrame, id_col: str, n: int, per: int, *more: str) -> DataFrame:
    """(cluster_id, block, rows) of rows (cluster_id, id, columns), at most about `per` of n ids in a block of a cluster."""
    n_blocks = max(1, ceil(n / per))
    spread = rows.withColumn("block", F.pmod(F.xxhash64(id_col), F.lit(n_blocks)))
    tasks = min(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * n_blocks)
    held = F.collect_list(F.struct(F.col(id_col).cast("long").alias("id"), *more)).alias("rows")
    return spread.repartition(tasks, "cluster_id", "block").groupBy("cluster_id", "block").agg(held)


def settled(base: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of vectors, computed once, and how many bytes they hold."""
    kept = durable(base)
    fields = base.schema["rows"].dataType.elementType.fields
    width = lambda t: WHOLE.get(t.simpleString(), 16)
    bytes_ = sum((F.size(f"x.{f.name}") * width(f.dataType.elementType) + 24 for f in fields if f.dataType.typeName() == "array"), F.lit(40))
    total = kept.select(F.explode("rows").alias("x")).agg(F.sum(bytes_).alias("n")).first()["n"]
    return kept, int(total or 0)


def met(queries: DataFrame, base: DataFrame, size: int) -> DataFrame:
    """(cluster_id, block, q, v): every block of queries with the blocks of vectors of its cluster, one after another."""
    right = base.select("cluster_id", F.col("rows").alias("v"))
    left = queries.withColumnRenamed("rows", "q")
    if size <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), "cluster_id").select("cluster_id", "block", "q", "v")
    tasks = 4 * int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.join(right, "cluster_id").select("cluster_id", "block", "q", "v").repartition(tasks, "cluster_id", "block").sortWithinPartitions("cluster_id", "block")


class Block:
    """A block's columns; dims are numbered by the queries' dims."""

    def __init__(self, rows: pa.Array) -> None:
        self.column = {f.name: rows.field(i) for i, f in enumerate(rows.type)}
        self.n = len(rows)
        self.ids = pc.fill_null(self.column["id"], NO_ID).to_numpy(zero_copy_only=False)

    def numbers(self, name: str) -> np.ndarray:
        return self.column[name].to_numpy(zero_copy_only=False)

    def lists(self, name: str) -> tuple[np.ndarray, pa.Array]:
        """The row of every element, and the elements."""
        col = self.column[name]
        return np.repeat(np.arange(self.n), pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)), col.flatten()

    def hashes(self) -> np.ndarray:
        flat = self.column["keys"].flatten().to_numpy(zero_copy_only=False)
        return np.ascontiguousarray(flat.reshape(self.n, -1).T)


class Queries(Block):
    """A block of queries with what is derived from it once."""

    def __init__(self, rows: pa.Array) -> None:
        super().__init__(rows)
        self.known: dict[str, tuple] = {}

    def sparse(self, name: str, vals: str | None) -> tuple:
        if name not in self.known:
            at, dims = self.lists(name)
            values = pc.unique(dims.cast(pa.int64()) if pa.types.is_integer(dims.type) else dims)
            self.known[name] = values, *matrix(self, name, vals, values)
        return self.known[name]


def matrix(block: Block, name: str, vals: str | None, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the elements among `values`."""
    at, dims = block.lists(name)
    code = pc.fill_null(pc.index_in(dims if dims.type == values.type else dims.cast(values.type, safe=True), value_set=values), -1).to_numpy(zero_copy_only=False)
    x = np.ones(len(at), np.int64) if vals is None else block.lists(vals)[1].to_numpy(zero_copy_only=False).astype(np.int64)
    if len(code) and code.min() < 0:
        known = np.flatnonzero(code >= 0)
        return at[known], code[known], x[known]
    return at, code, x


def _bits(x: np.ndarray) -> int:
    return int(max(abs(int(x.max())), abs(int(x.min())))).bit_length() if len(x) else 0


def _limbs(x: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    if _bits(x) <= width:
        yield 0, x
        return
    sign, size = np.sign(x), np.abs(x)
    for shift in range(0, max(1, _bits(x)), width):
        yield shift, sign * (size >> shift & ((1 << width) - 1))


def _by_column(x: tuple) -> tuple:
    order = np.argsort(x[1], kind="stable")
    return tuple(c[order] for c in x)


def product(nq: int, nv: int, q: tuple, v: tuple, columns: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The whole-number products of all rows of two sparse matrices, exact modulo 2^64, and, if any may leave 64 bits, about how large they are."""
    (qr, qc, qx), (vr, vc, vx) = q, v
    out = np.zeros((nq, nv), np.int64)
    most = int(np.bincount(qr, minlength=1).max()) if len(qr) else 0
    wide = _bits(qx) + _bits(vx) + most.bit_length() > 62
    about = np.zeros((nq, nv)) if wide else None
    qn, vn = np.bincount(qc, minlength=columns), np.bincount(vc, minlength=columns)
    dense = qn * vn >= DENSE * nq * nv
    chosen = np.flatnonzero(dense & (qn > 0) & (vn > 0))
    for cols in np.array_split(chosen, ceil(len(chosen) / COLUMNS)) if len(chosen) else []:
        place = np.full(columns, -1)
        place[cols] = np.arange(len(cols))

        def parts(r: np.ndarray, c: np.ndarray, x: np.ndarray, n: int, width: int) -> list[tuple[int, np.ndarray]]:
            if len(cols) < columns:
                here = place[c] >= 0
                r, c, x = r[here], c[here], x[here]
            flat = r * len(cols) + place[c]
            return [(shift, np.bincount(flat, limb, n * len(cols)).reshape(n, len(cols))) for shift, limb in _limbs(x, width)]

        room = 53 - int(len(cols)).bit_length() - 2
        whole = _bits(qx) + _bits(vx) <= room
        for i, a in parts(qr, qc, qx, nq, 63 if whole else room // 2):
            for j, b in parts(vr, vc, vx, nv, 63 if whole else room // 2):
                part = a @ b.T
                if i + j < 64:
                    out += part.astype(np.int64) << (i + j)
                if wide:
                    about += part * 2.0 ** (i + j)
    rest = np.flatnonzero(~dense & (qn > 0) & (vn > 0))
    if len(rest):
        (qr, qc, qx), (vr, vc, vx) = _by_column(q), _by_column(v)
    q0, v0 = np.cumsum(qn) - qn, np.cumsum(vn) - vn
    made = qn[rest] * vn[rest]
    for cols in np.split(rest, np.flatnonzero(np.diff(np.cumsum(made) // PRODUCTS)) + 1) if len(rest) else []:
        n = qn[cols] * vn[cols]
        which = np.repeat(np.arange(len(cols)), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        a, b = q0[cols][which] + place // vn[cols][which], v0[cols][which] + place % vn[cols][which]
        flat = qr[a] * nv + vr[b]
        np.add.at(out.reshape(-1), flat, qx[a] * vx[b])
        if wide:
            np.add.at(about.reshape(-1), flat, qx[a].astype(float) * vx[b])
    return out, about


def beyond(out: np.ndarray, about: np.ndarray | None) -> np.ndarray:
    """Where exact sums leave 64 bits."""
    return np.zeros(out.shape, bool) if about is None else np.abs(about - out.astype(np.float64)) > 2.0**63


def dots(q: Queries, v: Block, wide: bool = False) -> tuple:
    """The products of all pairs, and which pairs share a dim; an error if a product leaves 64 bits, unless wide: then also about how large they are."""
    values, *a = q.sparse("dims", "vals")
    b = matrix(v, "dims", "vals", values)
    out, about = product(q.n, v.n, tuple(a), b, len(values))
    if not wide and beyond(out, about).any():
        raise ArithmeticError("long overflow in a sum of products")
    shared = _shared(q, v, a, b, len(values), out if about is None else about)
    return (out, shared, about) if wide else (out, shared)


def _shared(q: Queries, v: Block, a: list, b: tuple, columns: int, out: np.ndarray) -> np.ndarray:
    if (len(a[2]) and a[2].min() <= 0) or (len(b[2]) and b[2].min() <= 0):
        one = lambda t: (t[0], t[1], np.ones(len(t[0]), np.int64))
        return product(q.n, v.n, one(a), one(b), columns)[0] > 0
    return out != 0


def common(q: Queries, v: Block) -> np.ndarray:
    """How many slots each pair has in common."""
    values, *a = q.sparse("keys", None)
    return product(q.n, v.n, tuple(a), matrix(v, "keys", None, values), len(values))[0]


def agreeing(q: Queries, v: Block) -> np.ndarray:
    """In how many hashes each pair agrees."""
    if "hashes" not in q.known:
        q.known["hashes"] = (q.hashes(),)
    return equal(q.known["hashes"][0], v.hashes())


def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many rows each pair of columns of two matrices agrees."""
    out, same = np.zeros((a.shape[1], b.shape[1]), np.uint8 if len(a) < 256 else np.int16), np.empty((a.shape[1], b.shape[1]), bool)
    for x, y in zip(a, b, strict=True):
        out += np.equal(x[:, None], y, out=same).view(np.uint8)
    return out


def _places(x: np.ndarray) -> np.ndarray:
    """x in units of 10^-9, rounded as Spark rounds: half up in the shortest decimals."""
    y = x * 1e9
    out = np.floor(y + 0.5).astype(np.int64)
    for i in zip(*np.nonzero(np.abs(y - np.floor(y) - 0.5) < 1e-3), strict=True):
        out[i] = int(Decimal(repr(float(x[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP).scaleb(9))
    return out


_OVERLAPS: dict[int, np.ndarray] = {}


def overlaps(s: np.ndarray, cc: np.ndarray, m: int) -> np.ndarray:
    """sketch.with_overlap()'s overlap of pairs with set sizes of s in all, in units of 10^-9."""
    known, need = _OVERLAPS.get(m), int(s.max(initial=0)) + 1
    if known is None or len(known) < need:
        with np.errstate(divide="ignore"):
            share = 1 + m / np.arange(m + 1)
        _OVERLAPS[m] = known = _places(np.arange(need + need // 4)[:, None] / share)
    return known[s, cc]


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the k largest scores are, ties to smaller ids."""
    if len(score) <= k:
        return np.arange(len(score))
    least = np.partition(score, len(score) - k)[len(score) - k]
    above, tie = np.flatnonzero(score > least), np.flatnonzero(score == least)
    need = k - len(above)
    return np.concatenate([above, tie if need >= len(tie) else tie[np.argpartition(ids[tie], need - 1)[:need]]])


FOUND = "qid long, cluster_id long, vec_id long, cc int, score long, place int, ip long, n long"


def _found(c: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_ids(c[0]), pa.array(c[1]), _ids(c[2]), pa.array(c[3]), pa.array(c[4]), pa.array(c[5]), pa.array(c[6], mask=~c[7]), pa.array(c[8])], ["qid", "cluster_id", "vec_id", "cc", "score", "place", "ip", "n"])


def search(queries: DataFrame, base: DataFrame, size: int, by: str, give: str, k: int = 0) -> DataFrame:
    """Of every query's `most` best vectors in a cluster, by score and then id: what `give` names.

    by: the product "ip", "common" slots, or by agreeing hashes "cc" or "overlap" (in 10^-9). Pairs that have nothing in common are none.
    give: "ids" or "ranked" all of them, with their place in the latter; "n" their number; "best" the k of largest product, among those that
    share a dim, and in any row their number n (at least a row, of no product, if there are any).
    """
    products = give == "best"

    def result(q: Queries, cluster: int, i: int, ids: np.ndarray, score: np.ndarray, cc: np.ndarray, ip: np.ndarray, shared: np.ndarray) -> list[np.ndarray] | None:
        place = np.zeros(len(ids), np.int32)
        if give == "best":
            at = np.flatnonzero(shared)
            at = at[best(ip[at], ids[at], k)] if len(at) else np.arange(min(1, len(ids)))
        elif give == "ranked":
            at = np.lexsort((ids, -score))
            place = np.arange(1, len(ids) + 1, dtype=np.int32)
        else:
            at = np.arange(len(ids))
        if give == "n":
            return [np.array([x], t) for x, t in ((q.ids[i], np.int64), (cluster, np.int64), (0, np.int64), (0, np.int32), (0, np.int64), (0, np.int32), (0, np.int64), (True, bool), (len(ids), np.int64))] if len(ids) else None
        n = len(at)
        return [np.full(n, q.ids[i]), np.full(n, cluster), ids[at], cc[at].astype(np.int32), score[at], place[:n], ip[at] if products else np.zeros(n, np.int64), shared[at] if products else np.zeros(n, bool), np.full(n, len(ids))]

    def finished(q: Queries, cluster: int, kept: list[list], most: np.ndarray) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for i, parts in enumerate(kept):
            if parts:
                all_ = [np.concatenate(x) for x in zip(*parts, strict=True)]
                at = best(all_[1], all_[0], int(most[i]))
                got = result(q, cluster, i, *[x[at] for x in all_])
                if got is not None:
                    out.append(got)
                    size += len(got[0])
            if size > 200_000 or (i == q.n - 1 and out):
                yield _found([np.concatenate(x) for x in zip(*out, strict=True)])
                out, size = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q, kept, most = None, None, [], None
        for rows in batches:
            for r in range(rows.num_rows):
                key = rows.column(0)[r].as_py(), rows.column(1)[r].as_py()
                if key != now:
                    if q is not None:
                        yield from finished(q, now[0], kept, most)
                    now, q = key, Queries(rows.column(2)[r].values)
                    kept, most = [[] for _ in range(q.n)], q.numbers("most")
                    held, floor = np.zeros(q.n, np.int64), np.full(q.n, 1, np.int64)
                v = Block(rows.column(3)[r].values)
                ip, shared = dots(q, v) if products or by == "ip" else (None, None)
                cc = shared if by == "ip" else common(q, v) if by == "common" else agreeing(q, v)
                score = ip if by == "ip" else cc.astype(np.int64)
                if by == "overlap":
                    score = overlaps(q.numbers("size")[:, None] + v.numbers("size"), cc, len(q.known["hashes"][0]))
                for i in range(q.n):
                    at = np.flatnonzero((score[i] >= floor[i]) & (cc[i] > 0)) if floor[i] > 1 else np.flatnonzero(cc[i])
                    if not len(at):
                        continue
                    none = np.zeros(0 if products else len(at), np.int64)
                    kept[i].append([v.ids[at], score[i, at], cc[i, at], ip[i, at] if products else none, shared[i, at] if products else none])
                    held[i] += len(at)
                    if held[i] > 2 * most[i] + 256:
                        all_ = [np.concatenate(x) for x in zip(*kept[i], strict=True)]
                        top = best(all_[1], all_[0], int(most[i]))
                        kept[i] = [[x[top] for x in all_]]
                        held[i], floor[i] = len(top), max(1, all_[1][top].min())
        if q is not None:
            yield from finished(q, now[0], kept, most)

    return met(queries, base, size).mapInArrow(run, FOUND)


def by_cluster(block: Block) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of every cluster: its rows in the block, the places of their memberships, and their hashes, a column each."""
    row, clusters = block.lists("clusters")
    n, flat = block.lists("lens")[1].to_numpy(), block.lists("keys")[1].to_numpy()
    cluster, starts, out = clusters.to_numpy(), np.cumsum(n) - n, {}
    for c in np.unique(cluster):
        at = np.flatnonzero(cluster == c)
        out[int(c)] = row[at], at, np.ascontiguousarray(flat[starts[at] + np.arange(n[at[0]])[:, None]])
    return out


#: A (query, cluster)'s scores of every set size and number of agreeing hashes are kept if they are so few.
SCORES = 1 << 15


def clustered(queries: DataFrame, base: DataFrame, size: int, give: str, k: int = 0, l_base: int = 1) -> DataFrame:
    """Of every query and each of its clusters: the `mosts` best members by fused score, then id; of them what `give` names.

    A vector is sent once for all its clusters, and multiplied once. give: "ranked" all, with their place; "n" their number; "best" the k of
    largest product among those that share a dim, and in any row their number n (at least a row, of no product, if there are any);
    "proxy" the k of most collisions, then score, of all clusters of a query, each vector at its best, with its product if it shares a dim.
    """
    products = give in ("best", "proxy")

    class Held:
        """A query's candidates in a cluster."""

        def __init__(self, q: Queries, i: int, cluster: int, at: int, m: int) -> None:
            self.most, self.size, self.m = int(q.column["mosts"].flatten()[at].as_py()), int(q.numbers("size")[i]), m
            self.aim, self.cluster, self.qid = float(q.column["aims"].flatten()[at].as_py()), cluster, q.ids[i]
            self.parts, self.n, self.floor, self.table = [], 0, NO_ID + 1, np.zeros((0, m + 1), np.int64)

        def fused(self, sizes: np.ndarray, cc: np.ndarray) -> np.ndarray:
            # The operations, and their order, of the SQL expression.
            score = np.floor((0.7 * (overlaps(self.size + sizes, cc, self.m) / 1e9) / l_base + 0.3 * self.aim * (cc / self.m)) * PPM + 0.5).astype(np.int64)
            return np.where(cc > 0, score, NO_ID)

        def scores(self, sizes: np.ndarray, top: int, cc: np.ndarray, code: np.ndarray) -> np.ndarray:
            if (top + 1) * (self.m + 1) > SCORES:
                return self.fused(sizes, cc)
            if len(self.table) <= top:
                self.table = self.fused(np.arange(top + 1 + top // 4)[:, None], np.arange(self.m + 1))
            return self.table.reshape(-1).take(code)

        def meet(self, v: Block, rows: np.ndarray, sizes: np.ndarray, top: int, cc: np.ndarray, code: np.ndarray, ip: np.ndarray | None, shared: np.ndarray | None) -> None:
            score = self.scores(sizes, top, cc, code)
            at = np.flatnonzero(score >= self.floor)
            if len(at):
                here = rows[at]
                self.parts.append([v.ids[here], score[at], cc[at], *([ip[here], shared[here]] if products else [])])
                self.n += len(at)
                if self.n > 2 * self.most + 256:
                    self.cut()
                    self.floor = self.parts[0][1].min()

        def cut(self) -> list[np.ndarray]:
            all_ = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            top = best(all_[1], all_[0], self.most)
            self.parts, self.n = [[x[top] for x in all_]], len(top)
            return self.parts[0]

    def rows_of(h: Held, at: np.ndarray, place: np.ndarray | None = None) -> list[np.ndarray]:
        ids, score, cc, *more = h.parts[0]
        n = len(at)
        ip, shared = (x[at] for x in more) if more else (np.zeros(n, np.int64), np.zeros(n, bool))
        return [np.full(n, h.qid), np.full(n, h.cluster), ids[at], cc[at].astype(np.int32), score[at], np.zeros(n, np.int32) if place is None else place, ip, shared, np.full(n, len(ids))]

    def result(of: list[Held]) -> list[np.ndarray] | None:
        out = []
        for h in (h for h in of if h.parts):
            ids, score, cc, *more = h.cut()
            if give == "ranked":
                out.append(rows_of(h, np.lexsort((ids, -score)), np.arange(1, len(ids) + 1, dtype=np.int32)))
            elif give == "proxy":
                out.append(rows_of(h, best((cc.astype(np.int64) << 46) + score, ids, k)))
            else:
                at = np.flatnonzero(more[1]) if give == "best" else np.zeros(0, np.int64)
                out.append(rows_of(h, at[best(more[0][at], ids[at], k)] if len(at) else np.arange(1)))
        all_ = [np.concatenate(x) for x in zip(*out, strict=True)] if out else None
        if all_ and give == "proxy":
            first = np.lexsort((all_[1], -all_[4], -all_[3], all_[2]))
            ids = all_[2][first]
            all_ = [x[first[np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))]] for x in all_]
            order = np.lexsort((all_[2], -all_[4], -all_[3]))[:k]
            all_ = [x[order] for x in all_]
            all_[5] = np.arange(1, len(order) + 1, dtype=np.int32)
        return all_

    def finished(held: list[list[Held]]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for of in held:
            got = result(of)
            of.clear()
            if got is not None:
                out.append(got)
                n += len(got[0])
            if n > 200_000:
                yield _found([np.concatenate(x) for x in zip(*out, strict=True)])
                out, n = [], 0
        if out:
            yield _found([np.concatenate(x) for x in zip(*out, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, asked, place = None, [], {}, {}
        for q, v in _blocks(batches):
            if q is not now:
                yield from finished(held)
                now, asked, held = q, by_cluster(q), [[] for _ in range(q.n)]
                place = {c: [Held(q, i, c, j, len(keys)) for i, j in zip(rows, at, strict=True)] for c, (rows, at, keys) in asked.items()}
                for c, (rows, _, _) in asked.items():
                    for i, h in zip(rows, place[c], strict=True):
                        held[i].append(h)
            ip, shared = dots(q, v) if products else (None, None)
            sizes = v.numbers("size")
            for c, (rows, _, keys) in by_cluster(v).items():
                if c in asked:
                    cc, own = equal(asked[c][2], keys), sizes[rows]
                    top, code = int(own.max()), own.astype(np.int64) * (len(keys) + 1) + cc
                    for j, (i, h) in enumerate(zip(asked[c][0], place[c], strict=True)):
                        h.meet(v, rows, own, top, cc[j], code[j], ip[i] if products else None, shared[i] if products else None)
        yield from finished(held)

    return met(queries, base, size).mapInArrow(run, FOUND)


def nearest(queries: DataFrame, base: DataFrame, size: int, sums: str | None = None) -> DataFrame:
    """(qid, vec_id, score): of every query the base vector of largest product, ties to the smaller id; 0 and 0 if no product is positive.

    With sums, a type of dims: (vec_id, dim, s), parts of the sums of the queries at each base vector.
    """

    def finished(q: Queries | None, score: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
        if q is not None and not sums:
            yield pa.RecordBatch.from_arrays([_ids(q.ids), pa.array(found), pa.array(score)], ["qid", "vec_id", "score"])
        elif q is not None:
            values, row, column, x = q.sparse("dims", "vals")
            to, at = np.unique(found, return_inverse=True)
            cell, where = np.unique(at[row] * len(values) + column, return_inverse=True)
            s = np.zeros(len(cell), np.int64)
            np.add.at(s, where, x)
            yield pa.RecordBatch.from_arrays([pa.array(to[cell // max(1, len(values))]), values.take(pa.array(cell % max(1, len(values)))), pa.array(s)], ["vec_id", "dim", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, score, found = None, None, None
        for q, v in _blocks(batches):
            if q is not now:
                yield from finished(now, score, found)
                now, score, found = q, np.zeros(q.n, np.int64), np.zeros(q.n, np.int64)
            order = np.argsort(v.ids)
            out = dots(q, v)[0][:, order]
            at = out.argmax(1)
            top, to = out[np.arange(q.n), at], v.ids[order][at]
            better = (top > score) | ((top == score) & (top > 0) & (to < found))
            score, found = np.where(better, top, score), np.where(better, to, found)
        yield from finished(now, score, found)

    return met(queries, base, size).mapInArrow(run, f"vec_id long, dim {sums}, s long" if sums else "qid long, vec_id long, score long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Queries, Block]]:
    now, q = None, None
    for rows in batches:
        for r in range(rows.num_rows):
            key = rows.column(0)[r].as_py(), rows.column(1)[r].as_py()
            if key != now:
                now, q = key, Queries(rows.column(2)[r].values)
            yield q, Block(rows.column(3)[r].values)


def _ids(x: np.ndarray) -> pa.Array:
    return pa.array(x, mask=x == NO_ID)


def common_pairs(queries: DataFrame, base: DataFrame, size: int, name: str) -> DataFrame:
    """(qid, vec_id, name): how many slots each pair has in common, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, v in _blocks(batches):
            out = common(q, v)
            i, j = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([_ids(q.ids[i]), _ids(v.ids[j]), pa.array(out[i, j])], ["qid", "vec_id", name])

    return met(queries, base, size).mapInArrow(run, f"qid long, vec_id long, {name} long")


def leaves_64_bits(queries: DataFrame, base: DataFrame, size: int) -> bool:
    """Whether any product of a pair does: by the largest values at first, by all products only if those don't tell."""
    ends = [x.select(F.explode("rows").alias("x")).select(F.array_max(F.transform("x.vals", lambda y: F.abs(y.cast("double")))).alias("m"), F.size("x.vals").alias("n")).agg(F.max("m").alias("m"), F.max("n").alias("n")).first() for x in (queries, base)]
    if (ends[0]["m"] or 0) * (ends[1]["m"] or 0) * min(ends[0]["n"] or 0, ends[1]["n"] or 0) < 2.0**62:
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = False
        for q, v in _blocks(batches):
            if not found:
                out, _, about = dots(q, v, wide=True)
                found = bool(beyond(out, about).any())
        yield pa.RecordBatch.from_arrays([pa.array([found])], ["found"])

    return bool(met(queries, base, size).mapInArrow(run, "found boolean").agg(F.max("found")).first()[0])


def pairs(queries: DataFrame, base: DataFrame, size: int, name: str) -> DataFrame:
    """(qid, vec_id, name): the product of every pair that shares a dim: long, or decimal(38,0) if any product leaves 64 bits."""
    wide = leaves_64_bits(queries, base, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, v in _blocks(batches):
            out, shared, about = dots(q, v, wide=True)
            i, j = np.nonzero(shared)
            over = beyond(out, about)[i, j]
            values = pa.array(out[i, j])
            if over.any() and not wide:
                raise ArithmeticError("long overflow in a sum of products")
            if wide:
                values = values.cast(pa.decimal128(38, 0))
                if over.any():
                    # The sum is known modulo 2^64, and its size to far less than that.
                    low, size_ = out[i[over], j[over]], about[i[over], j[over]]
                    exact = [Decimal(int(x) + round((float(s) - float(x)) / 2.0**64) * 2**64) for x, s in zip(low, size_, strict=True)]
                    values = pc.replace_with_mask(values, pa.array(over), pa.array(exact, pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([_ids(q.ids[i]), _ids(v.ids[j]), values], ["qid", "vec_id", name])

    return met(queries, base, size).mapInArrow(run, f"qid long, vec_id long, {name} {'decimal(38,0)' if wide else 'long'}")


def per_block(most: int) -> int:
    """Queries of a block that hold `most` candidates each, of some 27 bytes, and up to twice as many before they are cut."""
    return max(16, min(QUERY_BLOCK, HELD_BYTES // (54 * max(1, most))))
