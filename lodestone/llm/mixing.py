"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key -ln(u) / weight, u being a hash of its id and text and weight its quality; in key
order a source is a weighted sample without replacement. A source's target is met by complete epochs first; the rest is a prefix
of the key order, cut where the prefix sum of sizes comes nearest to the budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, hash_unit, join_unique

#: Keys are cut into this many ranges; prefix sums run within a range and ranges are offset by their sums.
BUCKETS = 4096
WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; 0 for null. Splitting leaves an empty piece at either end of a padded text."""
    parts = F.split(text, r"[\x20\x09-\x0D]+")
    n = F.size(parts)
    pad = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((n > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.when(text.isNull(), 0).otherwise(n - pad).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """One row per source with its target: share of all sizes dealt by weight, no target above cap times the source's size.

    sizes: __null (is the source null), __source, __size. Sources in code point order, null last, weigh `weights` in turn.
    What capped sources leave is dealt again by weight; the fixed point is a water level found in one pass over the
    sources by cap / weight: the first at which the level of the rest isn't above. One row per source is all this sorts.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.selectExpr("*", "row_number() over (order by __null, __source) as __i")
    weighted = ranked.select("*", F.element_at(cycle, (F.col("__i") - 1) % len(weights) + 1).alias("__w"), (F.col("__size") * cap).alias("__cap"))
    level = weighted.selectExpr(
        "*",
        "sum(__size) over () as __total",
        "sum(__w) over () as __all_w",
        "coalesce(sum(__cap) over (order by __cap / __w, __i rows between unbounded preceding and 1 preceding), 0) as __cap_before",
        "coalesce(sum(__w) over (order by __cap / __w, __i rows between unbounded preceding and 1 preceding), 0) as __w_before",
    )
    at = (F.lit(float(share)) * F.col("__total").cast("double") - F.col("__cap_before").cast("double")) / (F.col("__all_w") - F.col("__w_before"))
    level = level.select("*", F.when(at <= F.col("__cap") / F.col("__w"), F.struct((F.col("__cap") / F.col("__w")).alias("r"), F.col("__i").alias("i"), at.alias("level"))).alias("__at"))
    level = level.selectExpr("*", "min(__at) over () as __first")
    water = F.col("__first.level")
    return level.select("__null", "__source", "__size", F.when(water.isNull(), F.col("__cap").cast("double")).otherwise(F.least(F.col("__cap").cast("double"), water * F.col("__w"))).alias("target"))


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    share: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = SEED,
    keep: Sequence[str] = (),
) -> DataFrame:
    """How many words of every document the mix takes.

    quality (doc_id, quality): the larger, the earlier a document is drawn; weight 1 + quality, 1 where there is none, held
    to [1/16, 16]; of several rows the largest counts. Returns doc_id, size, source_size, target, taken (copies * size),
    copies, and the columns of `keep`. A null text has size 0 and is never taken; a null source is a source of its own;
    repeated rows count as documents of their own; ties in key are ordered by id and size, beyond which rows are alike.
    An empty table gives an empty result; other columns are ignored. With cap 3 no document is taken more than 3 times:
    a target of exactly 3 times the size is three complete epochs and nothing else.

    Texts are read once, for their size and hash; joins and windows see a narrow table. The largest source may hold any
    share of the rows: sums run per (source, key range), in the same partitioning in which rows meet their source's
    figures, so neither a join nor a window ever gathers a source. Rows alike in id and text share a key range.
    """
    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), word_count(F.col(text_col)).alias("size"), hash_unit(F.lit(seed), F.col(id_col).cast("long"), F.md5(F.col(text_col).cast("binary"))).alias("__unit"),
        F.col(source_col).isNull().alias("__null"), F.coalesce(F.col(source_col), F.lit("")).alias("__source"), *[F.col(c).alias(f"__keep_{c}") for c in keep],
    )
    own = Scratch(docs.sparkSession).put(own)
    if quality is not None:
        best = quality.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("double")).alias("__q"))
        own = join_unique(own, best, ["doc_id"])
        weight = F.greatest(F.lit(1 / 16), F.least(F.lit(16.0), 1 + F.coalesce(F.col("__q"), F.lit(0.0))))
    else:
        weight = F.lit(1.0)
    own = own.withColumn("__key", -F.ln("__unit") / weight).drop("__unit")
    # 1 - exp(-key) grows with the key and is uniform for weight 1.
    own = own.withColumn("__bucket", F.least(F.lit(BUCKETS - 1), F.floor(F.lit(BUCKETS) * (1 - F.exp(-F.col("__key"))))).cast("int"))
    group = ["__null", "__source"]
    sums = own.groupBy(*group, "__bucket").agg(F.sum("size").alias("__n"))
    goal = targets(sums.groupBy(*group).agg(F.sum("__n").alias("__size")), weights, cap, share)
    offsets = sums.selectExpr("*", "coalesce(sum(__n) over (partition by __null, __source order by __bucket rows between unbounded preceding and 1 preceding), 0) as __before")
    offsets = offsets.join(goal, group).select(*group, "__bucket", "__before", F.col("__size").alias("source_size"), "target")
    # The rows' shuffle by (source, range) serves the window and the join alike.
    placed = own.selectExpr("*", "sum(size) over (partition by __null, __source, __bucket order by __key, doc_id, size rows between unbounded preceding and current row) as __within")
    placed = placed.join(offsets, [*group, "__bucket"])
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - (full * F.col("source_size")).cast("double")
    upto = (F.col("__before") + F.col("__within")).cast("double")
    # A document is in the prefix if more than half of it lies below the budget: the sum of such a prefix is nearest to it.
    copies = full + F.when((F.col("size") > 0) & (upto - F.col("size") / 2 < rest) & (full < cap), 1).otherwise(0)
    return placed.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"), *[F.col(f"__keep_{c}").alias(c) for c in keep])
