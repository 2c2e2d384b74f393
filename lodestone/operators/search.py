"""Search over a composite index and over the baselines: all queries of a batch in one job."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import parameters
from lodestone.operators import cluster as cl
from lodestone.operators import blocks, idf, sketch
from lodestone.operators.storage import durable, fingerprint, load_manifest, load_tables, placed, save_tables
from lodestone.operators.vectors import BROADCAST_ROWS, block_topk, row_limit, top_k

PPM = 1_000_000


@dataclass
class Index:
    """The tables of a composite index; dims, slots and signatures are plain DataFrames that can be saved and joined."""

    vectors: DataFrame
    weights: DataFrame
    centroids: DataFrame
    members: DataFrame
    params: DataFrame
    sizes: DataFrame
    signatures: DataFrame
    domain: int
    meta: dict = field(default_factory=dict)
    packed: DataFrame | None = None
    held: dict = field(default_factory=dict)

    TABLES = ("weights", "centroids", "members", "params", "sizes", "signatures")

    def settled(self) -> Index:
        """The index with its large tables dealt by vec_id, so that counting, scoring and verifying a batch of queries move none of them."""
        by = ("vectors", "sizes") if self.packed is not None else ("vectors", "sizes", "signatures")
        meta = self.meta | {"centroid_rows": self.centroids.count()}
        out = replace(self, **{x: placed(getattr(self, x), "vec_id") for x in by}, params=durable(self.params), meta=meta, held={})
        if self.packed is not None:
            out.packed = placed(self.packed, "vec_id")
            out.signatures = sketch.unpacked(out.packed)
        return out

    def blocks(self) -> tuple[DataFrame, int]:
        """The vectors in blocks, made once: sketch size, coordinates, clusters and the signatures there."""
        if "blocks" not in self.held:
            own = blocks.packed(blocks.narrow(self.vectors, "dim", "val"), "vec_id")
            packed = self.packed if self.packed is not None else sketch.repacked(self.signatures)
            rows = _of_clusters(packed.withColumn("keys", F.col("mhs").cast(_key_type(self.domain))), "vec_id").join(own, "vec_id", "left").join(self.sizes, "vec_id", "left")
            self.held["blocks"] = blocks.settled(blocks.blocks(durable(_one_cluster(rows)), "vec_id", self.meta["n"], blocks.BASE_BLOCK, "size", "dims", "vals", "clusters", "lens", "keys"))
        return self.held["blocks"]

    def save(self, path: str) -> None:
        save_tables({x: getattr(self, x) for x in self.TABLES}, path, self.meta | {"domain": self.domain, "data": fingerprint(self.vectors)})

    @classmethod
    def load(cls, vectors: DataFrame, path: str) -> Index | None:
        """The index under path if it was built from these very vectors."""
        spark = vectors.sparkSession
        known = load_manifest(spark, path)
        if known is None or known["data"] != fingerprint(vectors):
            return None
        return cls(vectors, **load_tables(spark, path, list(cls.TABLES)), domain=known["domain"], meta={k: v for k, v in known.items() if k not in ("domain", "data")})


def build(
    vectors: DataFrame, k_clusters: int = 15, tau_percent: int = 80, m0: int = 170, eta: float = 0.03, k: int = 50, l_base: int = 20, idf_range: tuple[float, float] = (0.5, 3.0),
    adaptive_length: bool = True, adaptive_m: bool = True, use_idf: bool = True, dim_limit: int | None = None, seed: int = 2026, max_iter: int = 25, tol: float = 1e-4, clustering: cl.Clustering | None = None, arrow: bool = True,
) -> Index:
    """Weights, clusters, spill, sketches and signatures. Sketches are dropped once hashed; only their sizes stay."""
    weights = durable(idf.idf_weights(vectors, l_base, *idf_range, adaptive=adaptive_length))
    domain, n = idf.domain_of(weights), vectors.select("vec_id").distinct().count()
    clustering = clustering or cl.kmeans(vectors, k_clusters, max_iter, tol, seed)
    members = durable(cl.memberships(clustering, cl.spill(vectors, clustering, tau_percent)))
    rule = parameters.adaptive_params if adaptive_m else parameters.uniform_params
    params = rule(cl.sizes(members), n, k, m0, eta)
    own = members.join(params.select("cluster_id", "m_i"), "cluster_id")
    if arrow:
        sets = durable(sketch.sketch_sets(vectors, weights, use_idf=use_idf, dim_limit=dim_limit))
        packed, sizes = sketch.minhash_sets(sets, own, domain, seed), sketch.set_sizes(sets)
        hashed = sketch.unpacked(packed)
    else:
        slots = sketch.sketch(vectors, weights, use_idf=use_idf, dim_limit=dim_limit)
        packed, sizes, hashed = None, sketch.sketch_sizes(slots), sketch.minhash(slots, own, domain, seed)
    meta = {"k_clusters": clustering.k, "tau": tau_percent, "m0": m0, "l_base": l_base, "use_idf": use_idf, "dim_limit": dim_limit, "seed": seed, "n": n}
    return Index(vectors, weights, clustering.centroids, members, params, sizes, hashed, domain, meta, packed)


def _key_type(domain: int) -> str:
    return "array<smallint>" if domain < 1 << 15 else "array<int>"


def _block_rows(rows: DataFrame, domain: int) -> DataFrame:
    """Columns of a block's rows from mhs and size."""
    return rows.withColumn("size", F.coalesce("size", F.lit(0)).cast("int")).withColumn("keys", F.col("mhs").cast(_key_type(domain)))


def _of_clusters(rows: DataFrame, id_col: str, *more: str) -> DataFrame:
    """(id, clusters, lens, keys, columns): the signatures of an id one after another, and how long each is."""
    s = rows.groupBy(id_col).agg(F.collect_list(F.struct("cluster_id", "keys", *more)).alias("s"))
    return s.select(id_col, F.col("s.cluster_id").alias("clusters"), F.transform("s.keys", lambda x: F.size(x)).alias("lens"), F.flatten("s.keys").alias("keys"), *[F.col(f"s.{x}").alias(f"{x}s") for x in more])


def _one_cluster(rows: DataFrame) -> DataFrame:
    return rows.withColumn("size", F.coalesce("size", F.lit(0)).cast("int")).withColumn("cluster_id", F.lit(0).cast("long"))


def few(rows: DataFrame, n: int) -> DataFrame:
    """A table of n rows at most, broadcast if that is within the bound."""
    return F.broadcast(rows) if 0 <= n <= BROADCAST_ROWS else rows


@dataclass
class Batch:
    """A batch of queries, dealt by qid, and bounds of what its steps can make."""

    queries: DataFrame
    n: int
    coordinates: int
    nprobe: int
    most_m: int
    most_t: int

    @classmethod
    def of(cls, index: Index, queries: DataFrame, nprobe: int) -> Batch:
        own = durable(queries.select("qid", "dim", "val").repartition("qid"))
        n, coordinates = own.agg(F.countDistinct("qid"), F.count(F.lit(1))).first()
        most_m, most_t = index.params.agg(F.max("m_i"), F.max("t_budget")).first()
        return cls(own, n, coordinates, nprobe, int(most_m or 0), int(most_t or 0))

    def probes(self, rows: DataFrame) -> DataFrame:
        return few(rows, self.n * self.nprobe * self.most_m)

    def pairs(self, rows: DataFrame) -> DataFrame:
        return few(rows, self.n * self.nprobe * self.most_t)


def route(queries: DataFrame, centroids: DataFrame, nprobe: int, centroid_rows: int = -1) -> DataFrame:
    """(qid, cluster_id, centroid_score, rank): the nprobe best clusters of every query, ties to the lower number.

    The score is the product with the unit centroid over the query's largest value. Queries that are dealt by qid stay
    where they are if the centroids are few enough to be sent to them.
    """
    top = F.max("val").over(Window.partitionBy("qid"))
    both = queries.select("qid", "dim", "val", top.alias("top")).join(few(centroids, centroid_rows), "dim").groupBy("qid", "cluster_id").agg(F.sum(F.col("val") * F.col("w")).alias("s"), F.max("top").alias("top"))
    return top_k(both, nprobe, by="s", tie="cluster_id").select("qid", "cluster_id", F.round(F.col("s") / PPM / F.col("top"), 9).alias("centroid_score"), "rank")


def matches(index: Index, queries: DataFrame, nprobe: int, give: str, k: int = 0, batch: Batch | None = None) -> DataFrame:
    """blocks.clustered() of every query: a block of queries meets all vectors block by block."""
    batch = batch or Batch.of(index, queries, nprobe)
    routed = route(batch.queries, index.centroids, nprobe, index.meta.get("centroid_rows", -1))
    sets = durable(sketch.sketch_sets(batch.queries, index.weights, sketch.QUERY_SALT, "qid", index.meta["use_idf"], index.meta["dim_limit"]))
    aims = durable(routed.select("qid", "cluster_id", F.col("centroid_score").alias("aim")).join(F.broadcast(index.params.select("cluster_id", "m_i", F.col("t_budget").cast("long").alias("most"))), "cluster_id"))  # a row per cluster
    probes = sketch.minhash_sets(sets, aims.select("qid", "cluster_id", "m_i"), index.domain, index.meta["seed"], "qid")
    rows = probes.withColumn("keys", F.col("mhs").cast(_key_type(index.domain))).join(aims, ["qid", "cluster_id"])
    rows = _of_clusters(rows, "qid", "aim", "most").join(sketch.set_sizes(sets, "qid"), "qid", "left").join(blocks.packed(batch.queries, "qid"), "qid", "left")
    asked = blocks.blocks(durable(_one_cluster(rows)), "qid", batch.n, blocks.per_block(nprobe * batch.most_t), "size", "dims", "vals", "clusters", "lens", "keys", "aims", "mosts")
    return blocks.clustered(durable(asked), *index.blocks(), give, k, index.meta["l_base"])


def candidates(index: Index, queries: DataFrame, nprobe: int, batch: Batch | None = None) -> DataFrame:
    """(qid, cluster_id, vec_id, cc, score, place): the budgeted candidates of every query in each of its clusters.

    The score is floor(x * 10^6 + 1/2) millionths, which rounds alike in all engines; decimal rounding of a binary fraction doesn't.
    """
    found = matches(index, queries, nprobe, "ranked", batch=batch)
    return found.select("qid", "cluster_id", "vec_id", F.col("cc").cast("long").alias("cc"), (F.col("score") / PPM).alias("score"), "place")


def products(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, vec_id, ip) of distinct pairs that share a dim; with pairs and queries broadcast, vectors dealt by id stay in place."""
    both = vectors.select("vec_id", "dim", F.col("val").alias("dv")).join(pairs, "vec_id").join(queries, ["qid", "dim"])
    return both.groupBy("qid", "vec_id").agg(F.sum(F.col("qv") * F.col("dv")).alias("ip"))


def verified(candidate_ids: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds the exact product ip to candidates (qid, vec_id, ...); those that share no dim fall out."""
    found = products(candidate_ids.select("qid", "vec_id").distinct(), queries.select("qid", "dim", F.col("val").alias("qv")), vectors)
    return candidate_ids.join(found, ["qid", "vec_id"])


def clustered_search(index: Index, queries: DataFrame, k: int, nprobe: int, dedup: bool = True) -> DataFrame:
    """(qid, rank, vec_id, ip): route, sketch, probe, score, budget, verify, rank.

    A cluster's best k are told where its candidates are. A spilled point may be a candidate in several clusters; with
    dedup=False each verification is a result of its own.
    """
    return best_of(matches(index, queries, nprobe, "best", k), k, dedup)


def best_of(found: DataFrame, k: int, dedup: bool = True) -> DataFrame:
    """clustered_search() from matches() that give the best k of every cluster."""
    found = found.where("ip is not null")
    if dedup:
        return top_k(found.select("qid", "vec_id", "ip").distinct(), k).select("qid", "rank", "vec_id", "ip")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("ip"), "vec_id", "cluster_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "ip")


def verified_counts(index: Index, queries: DataFrame, nprobe: int) -> DataFrame:
    """(qid, n_verified, n_clusters): how many candidates each query verifies, over all clusters that gave any."""
    return counts_of(matches(index, queries, nprobe, "n"))


def counts_of(found: DataFrame) -> DataFrame:
    """verified_counts() from matches() of any kind that tells n."""
    return found.select("qid", "cluster_id", "n").distinct().groupBy("qid").agg(F.sum("n").alias("n_verified"), F.count(F.lit(1)).alias("n_clusters"))


@dataclass
class Baseline:
    """A global sketch with one hash family: the un-clustered index."""

    vectors: DataFrame
    layout: DataFrame
    slots: DataFrame
    signatures: DataFrame
    domain: int
    m: int
    seed: int
    sets: DataFrame | None = None
    packed: DataFrame | None = None
    held: dict = field(default_factory=dict)

    def blocks(self, slots: bool = False) -> tuple[DataFrame, int]:
        """The vectors in blocks, made once: sketch size, signature (or slots), coordinates."""
        name = "slots" if slots else "signatures"
        if name not in self.held:
            own = durable(blocks.packed(blocks.narrow(self.vectors, "dim", "val"), "vec_id"))
            sets = self.sets if self.sets is not None else self.slots.groupBy("vec_id").agg(F.collect_list("slot").alias("slots"))
            if slots:
                keys = sets.select("vec_id", F.col("slots").cast(_key_type(self.domain)).alias("keys"), F.size("slots").alias("size"))
                rows = keys.withColumn("cluster_id", F.lit(0).cast("long")).join(own, "vec_id", "left")
            else:
                packed = self.packed if self.packed is not None else sketch.repacked(self.signatures)
                rows = _block_rows(packed.join(own, "vec_id", "left").join(sketch.set_sizes(sets), "vec_id", "left"), self.domain)
            rows = durable(rows)
            self.held[name] = blocks.settled(blocks.blocks(rows, "vec_id", rows.select("vec_id").count(), blocks.BASE_BLOCK, "size", "keys", "dims", "vals"))
        return self.held[name]

    def asked(self, queries: DataFrame, most: int, tables: int | None = None, slots: bool = False) -> DataFrame:
        """Blocks of queries with their sketches, each to keep `most` candidates."""
        own = durable(queries.select("qid", "dim", "val"))
        sets = sketch.sketch(own, self.layout, sketch.QUERY_SALT, "qid", use_idf=False)
        n = own.select("qid").distinct().count()
        per = min(blocks.per_block(most), max(16, n // (2 * int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1))
        if slots:
            rows = sets.groupBy("qid").agg(F.collect_list("slot").cast(_key_type(self.domain)).alias("keys"), F.count(F.lit(1)).cast("int").alias("size")).withColumn("cluster_id", F.lit(0).cast("long"))
        else:
            one = own.select("qid").distinct().select("qid", F.lit(0).cast("long").alias("cluster_id"), F.lit(min(tables or self.m, self.m)).alias("m_i"))
            rows = _block_rows(sketch.minhash_packed(sets, one, self.domain, self.seed, "qid").join(sketch.sketch_sizes(sets, "qid"), "qid", "left"), self.domain)
        rows = durable(rows.join(blocks.packed(own, "qid"), "qid", "left").withColumn("most", F.lit(most).cast("long")))
        return blocks.blocks(rows, "qid", n, per, "size", "keys", "dims", "vals", "most")


def build_baseline(vectors: DataFrame, l: int = 10, m: int = 150, seed: int = 2026, arrow: bool = True) -> Baseline:  # noqa: E741
    """Every affine hash stands for one of the permutations that the surveyed method draws."""
    layout = durable(idf.fixed_layout(vectors, l))
    domain = idf.domain_of(layout)
    one = vectors.select("vec_id").distinct().select("vec_id", F.lit(0).cast("long").alias("cluster_id"), F.lit(m).alias("m_i"))
    if not arrow:
        slots = sketch.global_sketch(vectors, layout)
        return Baseline(vectors, layout, slots, sketch.minhash(slots, one, domain, seed), domain, m, seed)
    sets = durable(sketch.global_sets(vectors, layout))
    packed = durable(sketch.minhash_sets(sets, one, domain, seed))
    return Baseline(vectors, layout, sets.select("vec_id", F.explode("slots").alias("slot")), sketch.unpacked(packed), domain, m, seed, sets, packed)


def _baseline_counts(index: Baseline, queries: DataFrame, tables: int | None = None) -> tuple[DataFrame, DataFrame]:
    slots = sketch.sketch(queries, index.layout, sketch.QUERY_SALT, "qid", use_idf=False)
    one = queries.select("qid").distinct().select("qid", F.lit(0).cast("long").alias("cluster_id"), F.lit(min(tables or index.m, index.m)).alias("m_i"))
    counts = sketch.collisions(sketch.minhash(slots, one, index.domain, index.seed, "qid"), index.signatures)
    return counts.drop("cluster_id").withColumn("m_i", F.lit(min(tables or index.m, index.m))), slots


def baseline_candidates(index: Baseline, queries: DataFrame, k: int, ub: int, tables: int | None = None, by: str = "overlap") -> DataFrame:
    """(qid, vec_id) of the k + ub points of largest estimated overlap (or, with by='cc', of most collisions)."""
    return blocks.search(index.asked(queries, k + ub, tables), *index.blocks(), by, "ids").select("qid", "vec_id")


def baseline_matches(index: Baseline, queries: DataFrame, k: int, ub: int, tables: int | None = None, by: str = "overlap", inverted: bool = False) -> DataFrame:
    """blocks.search(): the best k of the k + ub candidates, by estimated or, inverted, exact overlap, with the number of candidates."""
    return blocks.search(index.asked(queries, k + ub, tables, inverted), *index.blocks(inverted), "common" if inverted else by, "best", k)


def ranked_best(found: DataFrame, k: int) -> DataFrame:
    return top_k(found.where("ip is not null"), k).select("qid", "rank", "vec_id", "ip")


def baseline_counts(index: Baseline, queries: DataFrame, k: int, ub: int, inverted: bool = False) -> DataFrame:
    """(qid, n_verified): how many candidates each query verifies."""
    found = blocks.search(index.asked(queries, k + ub, slots=inverted), *index.blocks(inverted), "common" if inverted else "overlap", "n")
    return found.select("qid", F.col("n").alias("n_verified"))


def baseline_counts_of(found: DataFrame) -> DataFrame:
    """baseline_counts() from baseline_matches()."""
    return found.select("qid", F.col("n").alias("n_verified")).distinct()


def baseline_search(index: Baseline, queries: DataFrame, k: int, ub: int, tables: int | None = None, by: str = "overlap") -> DataFrame:
    """The k best of the baseline's candidates."""
    return ranked_best(baseline_matches(index, queries, k, ub, tables, by), k)


def first_candidates_search(index: Baseline, queries: DataFrame, k: int, most: int = 200) -> DataFrame:
    """The legacy scan that stops after `most` points, in the order of the tables in which they first collide."""
    slots = sketch.sketch(queries, index.layout, sketch.QUERY_SALT, "qid", use_idf=False)
    one = queries.select("qid").distinct().select("qid", F.lit(0).cast("long").alias("cluster_id"), F.lit(index.m).alias("m_i"))
    probes = sketch.minhash(slots, one, index.domain, index.seed, "qid").select("qid", "h", "mh")
    met = probes.join(index.signatures.select("vec_id", "h", "mh"), ["h", "mh"]).groupBy("qid", "vec_id").agg(F.min("h").alias("first_h"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("first_h", "vec_id"))
    few = met.withColumn("place", place).where(F.col("place") <= most).select("qid", "vec_id")
    return top_k(verified(few, queries, index.vectors), k).select("qid", "rank", "vec_id", "ip")


def inverted_overlap_search(index: Baseline, queries: DataFrame, k: int, ub: int) -> DataFrame:
    """The same by exact set overlaps."""
    return ranked_best(baseline_matches(index, queries, k, ub, inverted=True), k)


def inverted_candidates(index: Baseline, queries: DataFrame, k: int, ub: int) -> DataFrame:
    """(qid, vec_id) of the k + ub points of most slots in common."""
    return blocks.search(index.asked(queries, k + ub, slots=True), *index.blocks(slots=True), "common", "ids").select("qid", "vec_id")


def inverted_scores(index: Baseline, queries: DataFrame) -> DataFrame:
    """(qid, vec_id, n_common): slots in common."""
    return blocks.common_pairs(index.asked(queries, 1, slots=True), *index.blocks(slots=True), "n_common")


def banded_search(index: Baseline, queries: DataFrame, k: int, rows: int = 2, by_count: bool = True) -> DataFrame:
    """The legacy banded tables: points that agree with a query in all hashes of some band, ranked by the number of such bands."""
    slots = sketch.sketch(queries, index.layout, sketch.QUERY_SALT, "qid", use_idf=False)
    one = queries.select("qid").distinct().select("qid", F.lit(0).cast("long").alias("cluster_id"), F.lit(index.m).alias("m_i"))

    def bands(signatures: DataFrame, id_col: str) -> DataFrame:
        cut = signatures.withColumn("band", F.expr(f"h div {rows}"))
        return cut.groupBy(id_col, "band").agg(F.array_sort(F.collect_list(F.struct("h", "mh"))).alias("s"), F.count(F.lit(1)).alias("c")).where(F.col("c") == rows).select(id_col, "band", F.xxhash64("s.mh").alias("key"), "s.mh")

    met = bands(sketch.minhash(slots, one, index.domain, index.seed, "qid"), "qid").join(bands(index.signatures, "vec_id"), ["band", "key", "mh"])
    counted = met.groupBy("qid", "vec_id").agg(F.count(F.lit(1)).alias("cc"))
    few = counted.select("qid", "vec_id") if not by_count else top_k(counted, 200 + k, by="cc", rank="place").select("qid", "vec_id")
    return top_k(verified(few, queries, index.vectors), k).select("qid", "rank", "vec_id", "ip")


def subset_truth(queries: DataFrame, vectors: DataFrame, k: int, n: int) -> DataFrame:
    """The exact answer among the first n vectors."""
    return block_topk(queries, row_limit(vectors, n), k).select("qid", "rank", "vec_id", "ip")


def proxy_candidates(index: Index, queries: DataFrame, nprobe: int, most: int = 1000, products: bool = False) -> DataFrame:
    """(qid, vec_id, cc, score, cluster_id, place): per point its best (collisions, score), then the first `most` by them.

    A point among the first has its best row among the first of that row's cluster. With products, also ip, null if no dim is shared.
    A query's clusters meet in one task, so candidates are told apart and ranked there.
    """
    found = matches(index, queries, nprobe, "proxy", most)
    return found.select("qid", "vec_id", F.col("cc").cast("long").alias("cc"), (F.col("score") / PPM).alias("score"), "cluster_id", *(["ip"] if products else []), "place")


def query_sample(queries: DataFrame, n: int, seed: int = 2026) -> DataFrame:
    """n query ids by a seeded hash."""
    from lodestone.functions import hashing

    return queries.select("qid").distinct().orderBy(F.expr(hashing.draw("qid", "1", seed)), "qid").limit(n)


