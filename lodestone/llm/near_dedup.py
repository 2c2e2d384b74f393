"""MinHash near-dedup with sequential Bayesian verification.

Texts become sets of five-word shingles; texts of equal sets are one class, and only a class's representative goes on.
Bands of the MinHash signature propose pairs. A pair's signatures are compared batch by batch: with a uniform prior the
posterior of the similarity after m matches in n is Beta(1 + m, 1 + n - m), and a pair is dropped as soon as the posterior
chance of reaching the threshold is below the miss probability. Survivors are verified on their full sets.

A bucket of m representatives never yields all its pairs: first all are compared with the bucket's hub, its smallest id;
links give components; then only members outside the hub's component are compared with the members of other components.
What is skipped are pairs already in one component, whose links could not change it, so no component is lost.

Classes are numbered, and numbers, signatures and, for pairs whose signatures agree, texts are all that is shuffled. Pairs
meet in groups of one class and a bounded number of partners, so that a class of many partners is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, join_unique
from lodestone.llm.textbatch import as_strings, slices

SHINGLE = 5
#: Similarity 0.75 or more, as whole numbers: 100 * |A & B| >= 75 * |A | B|.
PERCENT = 75
#: A pair at the threshold shares no band with a chance of (1 - 0.75^3)^24, or 2 in a million.
BANDS = 24
ROWS = 3
BATCH = 16
#: Those beyond the bands' serve the comparison only.
HASHES = 96
#: The chance, per comparison step, of dropping a pair that reaches the threshold.
MISS = 1e-5
#: Ids are broadcast to a scan up to this many, and joined by a shuffle beyond.
BROADCAST_IDS = 500_000
#: The partners of a class meet it in blocks of about this many.
PARTNERS = 128
#: Strays and members of a bucket meet in blocks of about so many rows and shingles.
BLOCK_ROWS = 512
BLOCK_SHINGLES = 1 << 20
PIECE = 1 << 21
_BASE, _BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _random(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


def _lower() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def _is_space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[32, 9, 10, 11, 12, 13]] = True
    return out


class Hasher:
    """Word hashes by prefix sums of a polynomial over bytes: no loop over words."""

    def __init__(self) -> None:
        self.byte, self.space = _random(256, 11)[_lower()], _is_space()
        self.power = self.inverse = np.ones(1, np.uint64)

    def words(self, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of every word [^\\x20\\x09-\\x0D]+ of one run of bytes."""
        n = len(body)
        if len(self.power) < n:
            for name, base in (("power", _BASE), ("inverse", _BASE_INVERSE)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        gap = np.concatenate([[True], self.space[body], [True]])
        start = np.flatnonzero(~gap[1:-1] & gap[:-2])
        end = np.flatnonzero(~gap[1:-1] & gap[2:]) + 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.byte[body] * self.power[:n])])
        return start, _mix((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def texts(self, body: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The word hashes of each text; texts are cut apart, and long runs are hashed in pieces that end at a space."""
        out = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            parts = []
            while a < b:
                stop = min(a + PIECE, b)
                if stop < b:
                    gaps = np.flatnonzero(self.space[body[a:stop]])
                    if len(gaps):
                        stop = a + gaps[-1] + 1
                    else:
                        rest = np.flatnonzero(self.space[body[stop:b]])
                        stop = stop + rest[0] + 1 if len(rest) else b
                parts.append(self.words(body[a:stop])[1])
                a = stop
            out.append(np.concatenate(parts) if parts else np.zeros(0, np.uint64))
        return out


def shingles(words: np.ndarray) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; a text of fewer words is one shingle, a text without words none."""
    n = min(len(words), SHINGLE)
    if not n:
        return words
    x = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        x = x * np.uint64(_BASE) + words[k : len(words) - n + 1 + k]
    return np.unique(_mix(x))


def signature(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(x), 512):
        h = x[at : at + 512, None] * a
        h += b
        h >>= np.uint64(32)
        np.minimum(out, h.min(0), out=out)
    return out.astype(np.uint32)


def _each_set(text: pa.Array) -> Iterator[np.ndarray]:
    hasher = Hasher()
    for _, body, offsets in slices(text):
        for words in hasher.texts(body, offsets):
            yield shingles(words)


def _sketch(kept: list[str]):
    """(doc_id, text_hash, text, kept columns) to the same without text, but with n_shingles, a hash of the set in two halves, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _random(HASHES, 1) | np.uint64(1), _random(HASHES, 2)
        for batch in batches:
            sizes, one, two, sigs = [], [], [], []
            for x in _each_set(as_strings(batch.column(2))):
                sizes.append(len(x))
                one.append(x.sum(dtype=np.uint64))
                two.append(_mix(x ^ np.uint64(_BASE)).sum(dtype=np.uint64))
                sigs.append(signature(x, a, b).tobytes() if len(x) else None)
            hashes = [pa.array(np.array(h, np.uint64).view(np.int64)) for h in (one, two)]
            rest = [batch.column(i) for i in range(3, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *hashes, pa.array(sigs, pa.binary()), *rest], ["doc_id", "text_hash", "n_shingles", "h1", "h2", "sig", *kept])

    return run


def _keys(sig: np.ndarray) -> np.ndarray:
    """The key of every band (columns) of every signature (rows)."""
    part = sig[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(_random(BANDS, 3), part.shape[:2]).copy()
    for r in range(ROWS):
        key = _mix(key * np.uint64(_BASE) + part[:, :, r])
    return key


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sig) to a row per band: (key, id)."""
    for batch in batches:
        key = _keys(_signatures(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "id"])


def least_matches(percent: int = PERCENT, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> list[int]:
    """After each batch, the fewest matches with which a pair may go on: P(similarity >= t | m of n) >= miss.

    P(Beta(1 + m, 1 + n - m) >= t) is the chance of at most m successes in n + 1 draws of probability t.
    """
    out, t = [], percent / 100
    for n in range(batch, hashes + 1, batch):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                break
        out.append(m)
    return out


def survivors(least: list[int], mine: np.ndarray, sig: np.ndarray, n: int, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those of `at`, rows of sig, that may be as similar to a signature as the threshold asks: by size, then batch by batch."""
    at = at[np.minimum(sizes[at], n) * 100 >= np.maximum(sizes[at], n) * PERCENT]
    matches = np.zeros(len(at), np.int64)
    for step, need in enumerate(least):
        part = slice(step * BATCH, (step + 1) * BATCH)
        matches = matches + (sig[at, part] == mine[part]).sum(1)
        at, matches = at[matches >= need], matches[matches >= need]
    return at


def only_ids(rows: DataFrame, ids: DataFrame, on: list[str] | Column, how: str = "left_semi", bound: int = BROADCAST_IDS) -> DataFrame:
    """Rows whose key is (not) among ids. Up to `bound` ids go to the rows, so that texts aren't shuffled for it."""
    return rows.join(F.broadcast(ids) if ids.count() <= bound else ids, on, how)


def grouped(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) as members of groups (a, block, role, id): a in role 0, and about PARTNERS of its partners in role 1."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("blocks"))
    heads = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("a").alias("id"))
    many = blocks.where("blocks > 1")
    partners = join_unique(pairs, many, ["a"]).select("a", F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"), F.lit(1).alias("role"), F.col("b").alias("id"))
    return heads.unionByName(partners)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, bool, bool]]]]:
    """Each batch, sorted by (group columns, role), with its runs of equal group and role: (from, to, is it a new group, role 1)."""
    now = None
    for batch in batches:
        if batch.num_rows:
            group = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            role = batch.column(3).to_numpy()
            edges = np.flatnonzero((group[1:] != group[:-1]).any(1) | (role[1:] != role[:-1])) + 1
            runs = []
            for x, y in zip([0, *edges], [*edges, len(role)], strict=True):
                runs.append((x, y, tuple(group[x]) != now, bool(role[x])))
                now = tuple(group[x])
            yield batch, runs


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in (a, b)], ["a", "b"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, block, 0, role, id, n, sig) to the pairs that no step drops."""
    least = least_matches()
    for batch, runs in _groups(batches):
        ids, sizes, sig, a, b = batch.column(4).to_numpy(), batch.column(5).to_numpy(), _signatures(batch.column(6)), [], []
        for x, y, _, partners in runs:
            if not partners:
                head = ids[x], sizes[x], sig[x]
                continue
            at = survivors(least, head[2], sig, head[1], sizes, np.arange(x, y))
            a += [head[0]] * len(at)
            b += ids[at].tolist()
        yield _pairs(a, b)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, block, 0, role, id, text) to the pairs that are links, by their full sets."""
    for batch, runs in _groups(batches):
        ids, a, b = batch.column(4).to_numpy(), [], []
        sets = _each_set(as_strings(batch.column(5)))
        for x, y, _, partners in runs:
            for i in range(x, y):
                other = next(sets)
                if not partners:
                    head, own = ids[i], other
                    continue
                inter = len(np.intersect1d(own, other, assume_unique=True))
                if inter * 100 >= (len(own) + len(other) - inter) * PERCENT:
                    a.append(head)
                    b.append(ids[i])
        yield _pairs(a, b)


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures leave a chance of the threshold."""
    met = grouped(pairs).join(classes.select("id", "n", "sig"), "id").select("a", "block", F.lit(0).alias("third"), "role", "id", "n", "sig")
    return met.repartition("a", "block").sortWithinPartitions("a", "block", "role", "id").mapInArrow(_likely, "a long, b long")


def read_texts(ids: DataFrame, classes: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, text) of classes, from texts (doc_id, text_hash, text)."""
    want = scratch.put(classes.join(ids, "id", "left_semi").select("id", F.coalesce("doc_id", F.lit(0)).alias("__doc"), F.col("text_hash").alias("__hash")))
    named = texts.select(F.coalesce("doc_id", F.lit(0)).alias("__doc"), F.col("text_hash").alias("__hash"), "text")
    few = F.broadcast(want) if want.count() <= BROADCAST_IDS else want
    # Rows that repeat id and text are alike; one of them stands for the class.
    return named.join(few, ["__doc", "__hash"]).groupBy("id").agg(F.first("text").alias("text"))


def verify(pairs: DataFrame, classes: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of classes that are links, by the full sets of their texts."""
    read = read_texts(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), classes, texts, scratch)
    met = grouped(pairs).join(read, "id").select("a", "block", F.lit(0).alias("third"), "role", "id", "text")
    return scratch.put(met.repartition("a", "block").sortWithinPartitions("a", "block", "role", "id").mapInArrow(_linked, "a long, b long"))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id reachable.

    Labels fall to the least among neighbours, then jump to their label's label, until nothing changes. Each round is
    written to the shared folder; nothing but counts and a bounded list of crowded ids reaches the driver.
    """
    both = scratch.put(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = scratch.put(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("c")))
    while True:
        near = join_unique(both, labels.select(F.col("id").alias("b"), "c"), ["b"]).groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        new = scratch.put(labels.join(near, "id").select("id", F.col("c").alias("old"), F.least("c", "m").alias("c")))
        after = scratch.put(join_unique(new, labels.select(F.col("id").alias("c"), F.col("c").alias("cc")), ["c"]).select("id", "old", F.least("c", "cc").alias("c")))
        scratch.drop(labels, new)
        if after.where("c <> old").isEmpty():
            scratch.drop(both)
            return after.select("id", F.col("c").alias("component"))
        labels = scratch.put(after.select("id", "c"))
        scratch.drop(after)


MET = ["key", "sb", "mb", "role", "id"]


def strays(crowded: DataFrame, label: DataFrame, classes: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between strays and members of other components, from bucket members (key, id, hub) and labels (id, component).

    A stray is a member outside the hub's component. Strays and members of a bucket are cut into blocks; a block of
    strays meets a block of members in one task. There their signatures tell who has a likely partner; the texts of those
    alone meet in the same blocks again, and only links between what isn't linked yet leave the task. So neither round
    gives more than its rows, however many pairs are alike. A pair that shares several buckets is compared in the first.
    """
    placed = crowded.where("id <> hub").join(label, "id", "left").join(classes.select("id", "n"), "id").withColumn("c", F.coalesce("component", "id")).drop("component")
    at_hub = label.select(F.col("id").alias("hub"), F.col("component").alias("hub_c"))
    placed = placed.join(at_hub, "hub", "left").withColumn("hub_c", F.coalesce("hub_c", "hub"))
    stray = (F.col("c") != F.col("hub_c")).cast("int")
    blocks = lambda one: F.ceil(F.greatest(F.sum(one) / BLOCK_ROWS, F.sum(one * F.col("n")) / BLOCK_SHINGLES)).cast("int")
    sizes = placed.groupBy("key").agg(blocks(stray).alias("s"), blocks(F.lit(1)).alias("m"), F.count(F.lit(1)).alias("all")).where("s > 0 and all > 1")
    cut = scratch.put(placed.join(sizes, "key").select("key", "id", "c", "hub_c", "s", "m"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = cut.where("c <> hub_c").withColumn("sb", own("s")).withColumn("mb", every("m")).withColumn("role", F.lit(0))
    rows = rows.unionByName(cut.withColumn("mb", own("m")).withColumn("sb", every("s")).withColumn("role", F.lit(1)))
    columns = [*MET, "n", "sig", "c", "hub_c"]
    met = rows.join(classes.select("id", "n", "sig"), "id").select(*columns)
    dealt = lambda x: x.repartition("key", "sb", "mb").sortWithinPartitions("key", "sb", "mb", "role", "id")
    likely = scratch.put(dealt(met).mapInArrow(_meet(False), "key long, sb int, mb int, role int, id long"))
    ids = scratch.put(likely.select("id").distinct())
    if ids.isEmpty():
        return ids.select(F.col("id").alias("a"), F.col("id").alias("b"))
    load = classes.select("id", "n", "sig").join(label, "id", "left").select("id", "n", "sig", F.coalesce("component", "id").alias("c"))
    hubs = cut.select("key", "hub_c").distinct()
    met = likely.join(load.join(ids, "id", "left_semi"), "id").join(hubs, "key").join(read_texts(ids, classes, texts, scratch), "id").select(*columns, "text")
    return scratch.put(dealt(met).mapInArrow(_meet(True), "a long, b long").distinct())


def _meet(exact: bool):
    """Strays and members of a block by their signatures: who has a likely partner; or, with texts, the links that join components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches()
        top: dict[int, int] = {}  # of components that links of this task have joined

        def root(x: int) -> int:
            while (y := top.get(x, x)) != x:
                top[x] = x = top.get(y, y)
            return x

        for batch, runs in _groups(batches):
            ids, sizes, sig, c, hub_c = batch.column(4).to_numpy(), batch.column(5).to_numpy(), _signatures(batch.column(6)), batch.column(7).to_numpy(), batch.column(8).to_numpy()
            keys, a, b, found = batch.column(0).to_numpy(), [], [], set()
            sets = _each_set(as_strings(batch.column(9))) if exact else iter([None] * batch.num_rows)
            for x, y, new, members in runs:
                here = [next(sets) for _ in range(x, y)]
                if new:
                    held, group = [], tuple(int(batch.column(k)[x].as_py()) for k in range(3))
                if not members:
                    held += [(int(ids[i]), int(sizes[i]), int(c[i]), sig[i], here[i - x]) for i in range(x, y)]
                    continue
                for who, n, comp, mine, own in held:
                    ok = (c[x:y] != comp) & ((c[x:y] == hub_c[x:y]) | (ids[x:y] > who))
                    at = survivors(least, mine, sig, n, sizes, np.flatnonzero(ok) + x)
                    if len(at):
                        band = np.flatnonzero(_keys(mine[None])[0] == keys[x : x + 1].view(np.uint64))[0]
                        at = at[(_keys(sig[at]) == _keys(mine[None])).argmax(1) == band]
                    if not exact:
                        found |= {(*group, 0, who)} if len(at) else set()
                        found |= {(*group, 1, int(ids[i])) for i in at}
                        continue
                    for i in at:
                        one, two = root(comp), root(int(c[i]))
                        if one != two:
                            inter = len(np.intersect1d(own, here[i - x], assume_unique=True))
                            if inter * 100 >= (len(own) + len(here[i - x]) - inter) * PERCENT:
                                top[max(one, two)] = min(one, two)
                                a.append(min(who, int(ids[i])))
                                b.append(max(who, int(ids[i])))
            if exact:
                yield _pairs(a, b)
            else:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], MET)

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and group_id of every row, and the columns of `keep`.

    Documents are linked if their shingle sets agree by PERCENT of their union; component_id is the smallest id reachable,
    and the row with that id is kept. group_id numbers the components and is null for texts without shingles. Null, empty
    and blank texts have no shingles and no links: they are their own component. Rows that repeat an id are documents of
    their own, linked by their texts alone; a row without id is linked like any other, and where a component has no id at
    all, component_id is null and its rows are kept. An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"__keep_{c}") for c in keep])
    kept = texts.columns[3:]
    sketch = scratch.put(texts.mapInArrow(_sketch(kept), "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, sig binary" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[3:])))
    first = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")
    classes = sketch.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min(first).alias("r"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = scratch.put(classes.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", F.col("r.doc_id").alias("doc_id"), F.col("r.text_hash").alias("text_hash"), "n", "sig"))
    rows = scratch.put(sketch.drop("sig", "text_hash"))
    scratch.drop(sketch)
    bands = classes.select("id", "sig").mapInArrow(_bands, "key long, id long")
    hubs = bands.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    crowded = scratch.put(bands.join(hubs, "key"))
    pairs = scratch.put(crowded.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    close = scratch.put(likely(pairs, classes))
    scratch.drop(pairs)
    found = verify(close, classes, texts, scratch)
    scratch.drop(close)
    label = components(found, scratch)
    scratch.drop(found)
    more = strays(crowded, label, classes, texts, scratch)
    named = label
    if not more.isEmpty():
        # Links among components: few, so labels are found for components and not again for all ids.
        ends = more.join(label.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(label.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
        joined = components(scratch.put(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), scratch)
        both = scratch.put(label.unionByName(joined.select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("component")))
        lifted = join_unique(both, joined.select(F.col("id").alias("component"), F.col("component").alias("top")), ["component"])
        named = scratch.put(lifted.select("id", F.coalesce("top", "component").alias("component")))
    # The smallest doc_id of every component, then every class's component.
    ids = scratch.put(named.join(classes.select("id", "doc_id"), "id"))
    least = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = join_unique(ids, least, ["component"]).select("id", "component", "component_id")
    whole = classes.select("id", "h1", "h2", F.col("doc_id").alias("own")).join(ids, "id", "left")
    whole = scratch.put(whole.select("h1", "h2", F.coalesce("component", "id").alias("group_id"), F.when(F.col("component").isNull(), F.col("own")).otherwise(F.col("component_id")).alias("component_id")))
    scratch.drop_all_but(rows, whole)
    out = join_unique(rows, whole, ["h1", "h2"])
    component = F.when(F.col("group_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "group_id", *[F.col(f"__keep_{c}").alias(c) for c in keep])
