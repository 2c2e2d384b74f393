"""Secret scan with corpus-wide ownership frequency.

Candidates are found per text, hashed, and counted over the corpus by the distinct repositories and owners that hold them.
A value that many owners share is a widely copied example; one that stays with few owners looks live. Base kinds (assign,
access, hex) are always reported, each judged live or example; the method adds `opaque` spans: high-entropy tokens outside
the base spans, reported only where the counts say that they are live-looking.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, join_unique
from lodestone.llm.textbatch import as_strings

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "opaque")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
#: A maximal run that is too short holds no run that is long enough, so the length can be part of the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIN_ASSIGNED = 6
MIN_ENTROPY = 3.2
#: A value held by this many owners or more, in as many repositories, is an example.
EXAMPLE_OWNERS = 3


def entropy(value: str) -> float:
    """Shannon entropy in bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base kinds: leftmost, non-overlapping per kind, failing matches dropped."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def opaque_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """High-entropy tokens of letters and digits that touch no base span."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((s, e) for s, _, e, _ in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for m in OPAQUE.finditer(text):
        value, k = m[0], bisect.bisect_left(starts, m.end()) - 1
        if k >= 0 and ends[k] > m.start() or not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
            continue
        if entropy(value) >= MIN_ENTROPY:
            out.append((m.start(), 3, m.end(), value))
    return out


def spell(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in sorted(spans))


def _value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.int64())])
_EMPTY = hashlib.sha256(b"").hexdigest()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, owner, text) to (doc_id, owner, counts, base_sha256, spans). Only texts that a linear-time engine finds suspect are parsed."""
    for batch in batches:
        text = as_strings(batch.column(2))
        maybe = pc.match_substring_regex(text, r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
        maybe = pc.or_(maybe, pc.and_(pc.match_substring_regex(text, "[0-9]"), pc.match_substring_regex(text, "[A-Za-z0-9+/_=-]{20}")))
        counts, digests, spans = [[0] * len(text) for _ in BASE], [_EMPTY] * len(text), [[] for _ in range(len(text))]
        for i in pc.indices_nonzero(maybe).to_pylist():
            body = text[i].as_py()
            base = base_spans(body)
            if base:
                digests[i] = hashlib.sha256(spell(base).encode()).hexdigest()
                for _, kind, _, _ in base:
                    counts[kind][i] += 1
            spans[i] = [{"start": s, "kind": k, "end": e, "value": _value_hash(v)} for s, k, e, v in base + opaque_spans(body, base)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in counts], pa.array(digests, pa.string()), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "cands"])


def ownership(cands: DataFrame) -> DataFrame:
    """(value, repos, owners) over the corpus from (value, repo, owner): distinct pairs first, then counts, both combined before each shuffle."""
    facets = cands.select("value", F.explode(F.array(F.concat(F.lit("r"), F.coalesce(F.col("repo").cast("string"), F.lit("\0"))), F.concat(F.lit("o"), F.coalesce("owner", F.lit("\0"))))).alias("facet")).distinct()
    is_repo = F.col("facet").startswith("r")
    return facets.groupBy("value").agg(F.count(F.when(is_repo, 1)).alias("repos"), F.count(F.when(~is_repo, 1)).alias("owners"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Finds secrets in every whole text and tells owner-specific ones from widely copied ones.

    A repository is a document, an owner its source. Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live
    and n_example (how many spans hold a live-looking value, and how many a copied one), live_spans (the former, spelt
    like spans) and found: array of struct(start, kind, end, live). A null text is empty; a null source is one owner;
    repeated rows are scanned each, but count once as repository if their ids agree; a null id counts as one repository.
    An empty table gives an empty result; other columns are ignored. Only spans leave the scan, texts are never shuffled;
    spans of a value that millions of documents hold are judged where they are.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).cast("string").alias("text"))
    found = own.mapInArrow(_scan, "doc_id long, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, cands array<struct<start:long,kind:int,end:long,value:long>>")
    found = scratch.put(found.withColumn("rid", F.monotonically_increasing_id()))
    cands = found.where(F.size("cands") > 0).select("rid", "doc_id", "owner", F.explode("cands").alias("c")).select("rid", F.col("doc_id").alias("repo"), "owner", "c.*")
    copied = ownership(cands).where((F.col("owners") >= example_owners) & (F.col("repos") >= example_owners)).select("value", F.lit(False).alias("live"))
    judged = join_unique(cands, copied, ["value"]).withColumn("live", F.coalesce("live", F.lit(True))).where("kind < 3 or live")
    per_doc = judged.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("found"))
    out = found.drop("cands").join(per_doc, "rid", "left").withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<start:long,kind:int,end:long,live:boolean>>)")))
    live = F.filter("found", lambda x: x["live"])
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", _spelt(F.col("found")).alias("spans"), F.size(live).cast("long").alias("n_live"), (F.size("found") - F.size(live)).cast("long").alias("n_example"), _spelt(live).alias("live_spans"), "found")


def _spelt(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
