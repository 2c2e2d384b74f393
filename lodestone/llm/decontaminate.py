"""Benchmark decontamination: training text is scanned for n-grams of the benchmark and verified word by word.

A window of `window` words that occurs in a document holds, whole, one of the document's grams at every stride-th
position, as gram + stride - 1 <= window. So only those grams are hashed and probed against a broadcast set of the
benchmark's grams; around each hit the windows that may hold it are cut out and joined with the benchmark's windows on
the words themselves. A benchmark too large to broadcast is joined by shuffles of gram positions, without words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, ascii_lower

WINDOW = 10
#: The benchmark's windows, and with them its grams, are broadcast up to this many bytes, and joined by shuffles beyond.
BROADCAST_BYTES = 64 << 20
#: What a window takes besides its text.
ROW_BYTES = 48
#: What parts words, before and after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _split(df: DataFrame, text: Column, gap: str) -> DataFrame:
    """Adds __w, the pieces between gaps, __lead, 1 if the first piece is the empty one before a gap, and __n, the words.

    A text of gaps alone, an empty text and null have no words.
    """
    df = df.withColumn("__w", F.split(F.coalesce(text, F.lit("")), gap))
    df = df.withColumn("__lead", F.when(F.get("__w", F.lit(0)) == "", 1).otherwise(0))
    last = F.when((F.size("__w") > 1) & (F.element_at("__w", -1) == ""), 1).otherwise(0)
    return df.withColumn("__n", F.size("__w") - F.col("__lead") - last)


def _gram(first: Column, n: int, words: str = "__w") -> Column:
    return F.xxhash64(*[F.get(F.col(words), first + k) for k in range(n)])


@dataclass
class Windows:
    """The benchmark's windows (wid, len, text), the items of each (wid, item_id), its grams, and how documents must be probed for them."""

    windows: DataFrame
    items: DataFrame
    grams: DataFrame
    lengths: list[int]
    gram: int
    stride: int
    small: bool


def benchmark_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> Windows | None:
    """Cuts items into windows of `window` consecutive words; a shorter item, but not one without words, is one window.

    None if no item has words. An item without id takes part in hits but isn't counted among the items.
    """
    scratch = Scratch(items.sparkSession)
    cut = _split(items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("__t")), ascii_lower(F.col("__t")), GAP).where("__n > 0")
    cut = scratch.put(cut.select("item_id", F.slice("__w", F.col("__lead") + 1, F.col("__n")).alias("__w"), F.least(F.col("__n"), F.lit(window)).alias("len")))
    spots = cut.select("item_id", "len", F.explode(F.expr("transform(sequence(1, size(__w) - len + 1), i -> array_join(slice(__w, i, len), ' '))")).alias("text"))
    windows = scratch.put(spots.select("len", "text").distinct().withColumn("wid", F.monotonically_increasing_id()))
    shape = windows.groupBy("len").agg(F.sum(F.octet_length("text") + F.lit(ROW_BYTES)).alias("bytes")).collect()  # `window` rows at most
    if not shape:
        return None
    lengths = sorted(r["len"] for r in shape)
    gram = (lengths[0] + 1) // 2
    grams = cut.select("__w", F.explode(F.expr(f"sequence(0, size(__w) - {gram})")).alias("i")).select(_gram(F.col("i"), gram).alias("gram")).distinct()
    held = spots.where("item_id is not null").join(windows, ["len", "text"]).select("wid", "item_id").distinct()
    return Windows(windows, scratch.put(held), scratch.put(grams), lengths, gram, lengths[0] - gram + 1, sum(r["bytes"] for r in shape) <= BROADCAST_BYTES)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Marks the words of every document that lie inside an occurrence of a benchmark window.

    Returns doc_id, __h (a hash of the text, which tells rows of one id apart), n_words, n_hit (words inside occurrences), n_items (items with an occurring window), items_sha256,
    hits (array of struct(start, len) in words: the spans to cut), contaminated, and the columns of `keep`. A null or
    empty text has no words and no hits. Rows that repeat id and text each get the same figures. Documents without hits,
    and all documents if the benchmark is empty, have n_hit 0 and the hash of an empty list. Other columns are ignored.
    """
    doc = [F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("__h")]
    counted = _split(docs.select(*doc, F.col(text_col).alias("__t"), *[F.col(c).alias(f"__keep_{c}") for c in keep]), F.col("__t"), GAP_RAW)
    counted = counted.select("doc_id", "__h", F.col("__n").cast("long").alias("n_words"), *[f"__keep_{c}" for c in keep])
    bench = benchmark_windows(items, window)
    if bench is None:
        found = counted.select("*", F.expr("cast(array() as array<struct<start:int,len:int>>)").alias("hits"), F.lit(0).alias("n_hit"), F.expr("cast(array() as array<string>)").alias("__items"))
    else:
        hits = occurrences(docs.select(*doc, F.col(text_col).alias("__t")), bench)
        hits = Scratch(docs.sparkSession).put(hits)
        named = hits.select("doc_id", "__h", "wid").distinct().join(bench.items, "wid").groupBy("doc_id", "__h").agg(F.collect_set("item_id").alias("__items"))
        named = named.select(F.col("doc_id").alias("__i"), F.col("__h").alias("__ih"), "__items")
        per_doc = hits.groupBy("doc_id", "__h").agg(F.collect_set(F.struct("start", "len")).alias("hits"))
        per_doc = per_doc.join(named, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__ih")), "left").select(
            F.col("doc_id").alias("__id"), F.col("__h").alias("__hh"), F.array_sort("hits").alias("hits"),
            F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1))))).alias("n_hit"),
            F.array_sort(F.transform(F.coalesce("__items", F.array()), lambda x: x.cast("string"))).alias("__items"),
        )
        found = counted.join(per_doc, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hh")), "left")
    items_of = F.coalesce("__items", F.expr("cast(array() as array<string>)"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return found.select(
        "doc_id", "__h", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.coalesce("hits", F.expr("cast(array() as array<struct<start:int,len:int>>)")).alias("hits"), *[F.col(f"__keep_{c}").alias(c) for c in keep],
    )


def occurrences(docs: DataFrame, bench: Windows) -> DataFrame:
    """(doc_id, __h, start, len, wid) of every occurrence of a window in docs (doc_id, __h, __t), each once."""
    g, s, longest = bench.gram, bench.stride, max(bench.lengths)
    cut = _split(docs, ascii_lower(F.col("__t")), GAP).where(F.col("__n") >= g).drop("__t")
    probe = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("__n") - g, F.lit(s))).alias("i")).withColumn("gram", _gram(F.col("i") + F.col("__lead"), g))
    if bench.small:
        hit = probe.join(F.broadcast(bench.grams), "gram")
    else:
        # Only positions are shuffled to the grams; each document with hits then meets its words once.
        at = probe.select("doc_id", "__h", "i", "gram").join(bench.grams, "gram", "left_semi").groupBy("doc_id", "__h").agg(F.collect_set("i").alias("at"))
        at = at.select(F.col("doc_id").alias("__id"), F.col("__h").alias("__hh"), "at")
        hit = cut.join(at, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hh"))).select("doc_id", "__h", "__w", "__lead", "__n", F.explode("at").alias("i"))
    # The words around a hit: windows that hold the gram begin at `from` or later and end before from + size.
    lo = F.greatest(F.lit(0), F.col("i") - (longest - g))
    near = hit.select("doc_id", "__h", "i", lo.alias("from"), F.slice("__w", lo + F.col("__lead") + 1, F.least(F.col("__n"), F.col("i") + longest) - lo).alias("near"))
    starts = F.concat(*[F.expr(f"transform(filter(sequence(greatest(`from`, i - {n - g}), i), p -> p - `from` + {n} <= size(near)), p -> struct(p as start, {n} as len, array_join(slice(near, p - `from` + 1, {n}), ' ') as text))") for n in bench.lengths])
    spots = near.select("doc_id", "__h", F.explode(starts).alias("at")).select("doc_id", "__h", "at.*")
    windows = F.broadcast(bench.windows) if bench.small else bench.windows
    return spots.join(windows, ["len", "text"]).select("doc_id", "__h", "start", "len", "wid").distinct()
