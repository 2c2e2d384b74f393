"""Binary sketches of sparse vectors and their MinHash signatures, buckets and collisions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import hashing
from lodestone.operators.vectors import max_normalised, positive

BASE_SALT, QUERY_SALT = 17, 29
SEED = 2026
#: Vectors whose slots are drawn at once, and hashes of all slots that are kept for a family.
DRAWN, TABLE = 1024, 1 << 22


def _chances(vectors: DataFrame, weights: DataFrame, id_col: str, use_idf: bool, dim_limit: int | None) -> DataFrame:
    """(id, p, prefix_l, l): the slots of every coordinate, and with what probability, in parts per million, each is drawn."""
    used = positive(vectors) if dim_limit is None else positive(vectors).where(F.col("dim") < dim_limit)
    norm = max_normalised(used, id_col).join(weights.select("dim", "l", "prefix_l", *(["idf_ppm"] if use_idf else [])), "dim")
    p = F.expr(f"least({hashing.PPM}, norm_ppm * idf_ppm div {hashing.PPM})") if use_idf else F.col("norm_ppm")
    return norm.select(id_col, p.alias("p"), "prefix_l", "l")


def sketch(vectors: DataFrame, weights: DataFrame, salt: int = BASE_SALT, id_col: str = "vec_id", use_idf: bool = True, dim_limit: int | None = None) -> DataFrame:
    """(id, slot): of the l slots of each dim, those drawn with the probability of its weight.

    The probability is min(1, normalised value * idf), or the normalised value alone. Draws are stateless hashes of
    (id, slot), so any task makes them alike. Values that aren't positive, and dims from dim_limit on, are left out.
    """
    slots = _chances(vectors, weights, id_col, use_idf, dim_limit).select(id_col, "p", F.explode(F.expr("sequence(prefix_l, prefix_l + l - 1)")).alias("slot"))
    return slots.where(F.expr(hashing.draw(id_col, "slot", salt)) < F.col("p")).select(id_col, "slot")


def sketch_sets(vectors: DataFrame, weights: DataFrame, salt: int = BASE_SALT, id_col: str = "vec_id", use_idf: bool = True, dim_limit: int | None = None) -> DataFrame:
    """(id, slots): sketch() with a row per vector, its slots drawn by numpy: no row per slot."""
    return _drawn(_chances(vectors, weights, id_col, use_idf, dim_limit), salt, id_col)


def global_sets(vectors: DataFrame, layout: DataFrame, salt: int = BASE_SALT) -> DataFrame:
    """(vec_id, slots): global_sketch() with a row per vector."""
    return _drawn(_global_chances(vectors, layout), salt, "vec_id")


def _drawn(chances: DataFrame, salt: int, id_col: str) -> DataFrame:
    sides = chances.where(F.col(id_col).isNotNull() & F.col("p").isNotNull() & (F.col("l") > 0)).select(id_col, F.struct(*[F.col(c).cast("long").alias(c) for c in ("p", "prefix_l", "l")]).alias("c"))
    rows = sides.groupBy(id_col).agg(F.collect_list("c").alias("c")).select(id_col, *[F.col(f"c.{x}").alias(x) for x in ("p", "prefix_l", "l")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, DRAWN):
                batch = whole.slice(at, DRAWN)
                ids = batch.column(0).cast(pa.int64()).to_numpy()
                p, first, l = (batch.column(i).flatten().to_numpy() for i in (1, 2, 3))  # noqa: E741
                row = np.repeat(np.repeat(np.arange(len(ids)), pc.list_value_length(batch.column(1)).to_numpy()), l)
                slot = np.repeat(first - (np.cumsum(l) - l), l) + np.arange(len(row))
                kept = hashing.drawn(ids[row], slot, salt) < np.repeat(p, l)
                n = np.bincount(row[kept], minlength=len(ids))
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                slots = pa.ListArray.from_arrays(pa.array(ends), pa.array(slot[kept]))
                yield pa.RecordBatch.from_arrays([batch.column(0), slots], [id_col, "slots"]).filter(pa.array(n > 0))

    return rows.mapInArrow(run, f"{id_col} {dict(chances.dtypes)[id_col]}, slots array<long>")


def _global_chances(vectors: DataFrame, layout: DataFrame) -> DataFrame:
    top = positive(vectors).agg(F.max("val").alias("top"))
    return positive(vectors).crossJoin(F.broadcast(top)).join(layout, "dim").select("vec_id", F.expr(f"val * {hashing.PPM} div top").alias("p"), "prefix_l", "l")  # one row


def global_sketch(vectors: DataFrame, layout: DataFrame, salt: int = BASE_SALT) -> DataFrame:
    """The baseline's base sketch: constant l, values over the largest of all vectors, no IDF."""
    slots = _global_chances(vectors, layout).select("vec_id", "p", F.explode(F.expr("sequence(prefix_l, prefix_l + l - 1)")).alias("slot"))
    return slots.where(F.expr(hashing.draw("vec_id", "slot", salt)) < F.col("p")).select("vec_id", "slot")


def sketch_sizes(slots: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return slots.groupBy(id_col).agg(F.count(F.lit(1)).alias("size"))


def minhash(slots: DataFrame, members: DataFrame, domain: int, seed: int = SEED, id_col: str = "vec_id") -> DataFrame:
    """(cluster_id, id, h, mh): the least hash of every member's slots under each of its cluster's m_i hashes.

    members: (id, cluster_id, m_i). An empty set has domain - 1 throughout. Hashes of a slot are one explode and one
    partially combined minimum; minhash_arrow gives the same rows from packed slots.
    """
    a, b = hashing.family_a("h", "cluster_id", seed), hashing.family_b("h", "cluster_id", seed)
    rows = members.join(slots, id_col, "left").select(id_col, "cluster_id", "slot", F.explode(F.expr("sequence(0L, cast(m_i - 1 as bigint))")).alias("h"))
    value = F.when(F.col("slot").isNull(), F.lit(domain - 1)).otherwise(F.expr(hashing.affine_hash(a, b, "slot", str(domain))))
    return rows.groupBy("cluster_id", id_col, "h").agg(F.min(value).alias("mh"))


def minhash_arrow(slots: DataFrame, members: DataFrame, domain: int, seed: int = SEED, id_col: str = "vec_id") -> DataFrame:
    """minhash() with the slots of a vector packed in one row and hashed by numpy: no row per (slot, hash)."""
    return unpacked(minhash_packed(slots, members, domain, seed, id_col), id_col)


def unpacked(signatures: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(cluster_id, id, h, mh) of whole signatures."""
    return signatures.select("cluster_id", id_col, F.posexplode("mhs").alias("h", "mh")).select("cluster_id", id_col, F.col("h").cast("long").alias("h"), "mh")


def repacked(signatures: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(cluster_id, id, mhs) of hashes in rows."""
    return signatures.groupBy("cluster_id", id_col).agg(F.array_sort(F.collect_list(F.struct("h", "mh"))).alias("s")).select("cluster_id", id_col, F.col("s.mh").alias("mhs"))


def minhash_packed(slots: DataFrame, members: DataFrame, domain: int, seed: int = SEED, id_col: str = "vec_id") -> DataFrame:
    """(cluster_id, id, mhs): whole signatures, their hashes in order."""
    return minhash_sets(slots.groupBy(id_col).agg(F.collect_list("slot").alias("slots")), members, domain, seed, id_col)


def minhash_sets(sets: DataFrame, members: DataFrame, domain: int, seed: int = SEED, id_col: str = "vec_id") -> DataFrame:
    """minhash_packed() of sets (id, slots). A set is sent to Python once for all its clusters, and met with the hashes of all slots if those are few."""
    own = members.select(id_col, F.struct(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("m_i").cast("int").alias("m_i")).alias("c")).groupBy(id_col).agg(F.collect_list("c").alias("c"))
    rows = own.join(sets, id_col, "left").select(id_col, F.col("c.cluster_id").alias("clusters"), F.col("c.m_i").alias("ms"), F.coalesce("slots", F.array().cast("array<bigint>")).alias("slots"))
    family, prime = hashing.family, hashing.PRIME

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray | None]] = {}

        def hashed(f: np.ndarray, x: np.ndarray) -> np.ndarray:
            return (x[:, None] * f[:, 0] + f[:, 1]) % prime % domain

        def least(c: int, m: int, x: np.ndarray) -> np.ndarray:
            if (c, m) not in tables:
                f = np.array(family(m, c, seed), np.int64).reshape(-1, 2)
                few = m * domain <= TABLE
                tables[c, m] = f, np.concatenate([hashed(f, part) for part in np.array_split(np.arange(domain, dtype=np.int64), domain // 4096 + 1)]).astype(np.int32) if few else None
            f, table = tables[c, m]
            if not len(x):
                return np.full(m, domain - 1, np.int64)
            if table is not None:
                return table[x].min(0)
            return np.min([hashed(f, part).min(0) for part in np.array_split(x, max(1, len(x) // 4096))], 0)

        for batch in batches:
            n = pc.list_value_length(batch.column(1)).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), n)
            cluster, m = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            flat, at = batch.column(3).flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(3)).to_numpy())])
            for part in np.array_split(np.arange(len(row)), len(row) // 10_000 + 1):
                values = [least(int(cluster[j]), int(m[j]), flat[at[row[j]] : at[row[j] + 1]]) for j in part]
                ends = np.concatenate([[0], np.cumsum(m[part])]).astype(np.int32)
                mhs = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).astype(np.int64) if values else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(cluster[part]), batch.column(0).take(pa.array(row[part])), mhs], ["cluster_id", id_col, "mhs"])

    kind = dict(members.dtypes)[id_col]
    return rows.mapInArrow(run, f"cluster_id long, {id_col} {kind}, mhs array<long>")


def set_sizes(sets: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return sets.select(id_col, F.size("slots").cast("long").alias("size"))


def buckets(signatures: DataFrame) -> DataFrame:
    """(cluster_id, h, mh, n): the bucket index's cells and how many points each holds."""
    return signatures.groupBy("cluster_id", "h", "mh").agg(F.count(F.lit(1)).alias("n"))


def collisions(query_signatures: DataFrame, signatures: DataFrame) -> DataFrame:
    """(qid, cluster_id, vec_id, cc): in how many tables a query and a point meet."""
    both = query_signatures.select("qid", "cluster_id", "h", "mh").join(signatures.select("vec_id", "cluster_id", "h", "mh"), ["cluster_id", "h", "mh"])
    return both.groupBy("qid", "cluster_id", "vec_id").agg(F.count(F.lit(1)).alias("cc"))


def with_overlap(counts: DataFrame, query_sizes: DataFrame, sizes: DataFrame, m: str = "m_i") -> DataFrame:
    """Adds sq, sd and overlap = (sq + sd) / (1 + m / cc), the overlap of two sets by their estimated Jaccard similarity."""
    out = counts.join(query_sizes.select("qid", F.col("size").alias("sq")), "qid", "left").join(sizes.select("vec_id", F.col("size").alias("sd")), "vec_id", "left")
    out = out.withColumn("sq", F.coalesce("sq", F.lit(0))).withColumn("sd", F.coalesce("sd", F.lit(0)))
    return out.withColumn("overlap", F.round((F.col("sq") + F.col("sd")) / (1 + F.col(m) / F.col("cc")), 9))
