"""Hierarchical weighted hash tree: rows descend region, rack and shard levels by weighted hash draws.

At each level a row draws -ln(u) / weight for every child, u being a hash of the row's id and the child's name, and
takes the child of the smallest draw. A child is so taken in proportion to its weight, and when weights change, only
children whose weight (or whose sibling's weight) changed win or lose rows: movement is confined to those subtrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch

#: Rows of one shard are numbered in this many chunks, so that no task holds a whole shard.
CHUNKS = 512


@dataclass(frozen=True)
class Leaf:
    """A shard and its place. Weights are relative capacities and must be positive."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(shards: int, base: int = 24, racks: int = 2, per_rack: int = 4) -> list[Leaf]:
    """The tree of a cluster commissioned with `base` shards: regions of `racks` racks of `per_rack` shards.

    Every shard beyond the base is a region of its own. Growing from n >= base to n + 1 changes no weight below an old
    region, so rows move only into the new shard. Fewer shards than the base are another cluster, and refused.
    """
    if not 0 < base <= shards:
        raise ValueError(f"{shards} shards of a cluster commissioned with {base}")
    out = []
    for s in range(base):
        region = s // (racks * per_rack)
        out.append(Leaf(f"r{region}", f"r{region}k{s // per_rack % racks}", s))
    out += [Leaf(f"r+{s}", f"r+{s}k0", s) for s in range(base, shards)]
    return out


def _node(level: str, name: str) -> int:
    """A node's identity as a signed 64-bit number: the hash of its level and name."""
    return int.from_bytes(hashlib.blake2b(f"{level}:{name}".encode(), digest_size=8).digest(), "little", signed=True)


def _descend(key: Column, level: str, children: Sequence[Sequence[tuple[str, float, int]]], parent: Column) -> Column:
    """The number of the child whose weighted draw is smallest; children: per parent (name, weight, number).

    The table is a constant, and the parent is named once, so that levels nest without growing the plan.
    """
    table = F.array(*[F.array(*[F.struct(F.lit(_node(level, n)).alias("node"), F.lit(float(w)).alias("weight"), F.lit(i).alias("number")) for n, w, i in row]) for row in children])

    def draw(c: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, c["node"]), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.ln(u) / c["weight"]).alias("x"), c["number"].alias("number"))

    return F.array_min(F.transform(F.get(table, parent), draw))["number"]


def _by(leaves: Sequence[Leaf], what: str) -> dict[str, list[Leaf]]:
    out: dict[str, list[Leaf]] = {}
    for x in leaves:
        out.setdefault(getattr(x, what), []).append(x)
    return out


def _weight(leaves: Sequence[Leaf]) -> float:
    return sum(x.weight for x in leaves)


def shard_of(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard of a key: one draw among regions, one among the region's racks, one among the rack's shards."""
    if len({x.shard for x in tree}) != len(tree) or not all(x.weight > 0 for x in tree):
        raise ValueError("shards must be distinct and weights positive")
    regions = _by(tree, "region")
    top = [[(name, _weight(own), i) for i, (name, own) in enumerate(regions.items())]]
    racks: list[tuple[str, list[Leaf]]] = []
    middle = []
    for own in regions.values():
        row = []
        for name, leaves in _by(own, "rack").items():
            row.append((name, _weight(leaves), len(racks)))
            racks.append((name, leaves))
        middle.append(row)
    leaves = [[(str(x.shard), x.weight, x.shard) for x in own] for _, own in racks]
    return _descend(key, "shard", leaves, _descend(key, "rack", middle, _descend(key, "region", top, F.lit(0))))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", base: int = 24) -> DataFrame:
    """Puts every row into a shard of layout(shards, base) by the law `key`: id and shard count alone decide.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot (0, 1, ... within the shard) and
    grown_shard, the shard under one shard more, which is what shard() gives for that count and the same base. A null text has size 8 and the
    CRC of no bytes; a null id is a key of its own. Repeated rows fall into one shard and get slots of their own. Other
    columns of docs are ignored, an empty table gives an empty result. Slots follow (chunk, id, CRC, size), chunk being a
    hash of id and CRC: rows are numbered within chunks and chunks are offset by counts, so that no task sorts a whole
    shard, nor all rows of one id. Texts are read once, for their size and CRC.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    tree, grown = layout(shards, base), layout(shards + 1, base)
    chunk = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(CHUNKS)).cast("int")
    rows = rows.select("*", F.lit("key").alias("law"), shard_of(F.col("doc_id"), tree).alias("shard"), shard_of(F.col("doc_id"), grown).alias("grown_shard"), chunk.alias("__chunk"))
    rows = Scratch(docs.sparkSession).put(rows)
    counts = rows.groupBy("shard", "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    # shards * CHUNKS rows at most, whatever the input: a bound that holds for broadcast.
    before = counts.selectExpr("shard", "__chunk", "sum(__n) over (partition by shard order by __chunk rows between unbounded preceding and 1 preceding) as __before")
    local = rows.selectExpr("*", "row_number() over (partition by shard, __chunk order by doc_id, text_crc32, size) as __row")
    return local.join(F.broadcast(before), ["shard", "__chunk"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.coalesce(F.col("__before"), F.lit(0)) + F.col("__row") - 1).cast("long").alias("slot"), "grown_shard",
    )
