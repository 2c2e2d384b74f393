"""What the operators share: tables, text expressions, tables in the shared folder, row keys and joins that stand skew."""

from __future__ import annotations

import atexit
import functools
import operator
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A key is hot if it holds more than one in so many rows; so there are fewer hot keys than this, whatever the input.
HOT_SHARE = 1000
#: Plans whose rows are still those of the files they are read from.
_PLAIN = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, so that no letter changes its length or its class."""
    return F.translate(text, UPPER, LOWER)


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it.

    Where it is unset, as in tests, a session of one process has a folder of its own, which goes with the process; on a
    cluster no folder is shared unless it is named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="lodestone-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        named = _OWN[0]
    return named.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_MADE: list[Scratch] = []


def mark() -> int:
    """How many sets of tables there are; release() drops those made later, when what needed them is written."""
    return len(_MADE)


def release(since: int) -> None:
    for x in _MADE[since:]:
        remove(x.spark, x.base)
    del _MADE[since:]


class Scratch:
    """Parquet tables of one run in the shared folder. They outlive executors and cut lineage; each goes when its user drops it."""

    def __init__(self, spark: SparkSession) -> None:
        _MADE.append(self)
        self.spark, self.base = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.made = 0

    def put(self, df: DataFrame) -> DataFrame:
        """Computes df once, writes it and gives it back as read from there."""
        path = f"{self.base}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for x in tables:
            remove(self.spark, self.paths.pop(id(x))[1])

    def drop_all_but(self, *tables: DataFrame) -> None:
        kept = {id(x) for x in tables}
        self.drop(*[x for k, (x, _) in self.paths.items() if k not in kept])


def durable(df: DataFrame) -> DataFrame:
    """One table of that kind that nobody drops."""
    return Scratch(df.sparkSession).put(df)


def with_row_key(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds __file and __row, which name a row of a Parquet table whatever it holds; other rows are written to one first."""
    node, plain = rows._jdf.queryExecution().analyzed(), True
    todo = [node]
    while todo:
        node = todo.pop()
        plain = plain and node.nodeName() in _PLAIN
        todo += [node.children().apply(i) for i in range(node.children().size())]
    files = rows if plain and "_metadata" not in rows.columns and rows._jdf.queryExecution().analyzed().metadataOutput().size() else scratch.put(rows)
    return files.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def same(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return functools.reduce(operator.and_, [x.eqNullSafe(y) for x, y in zip(a, b, strict=True)])


def join_unique(left: DataFrame, right: DataFrame, keys: Sequence[str], share: int = HOT_SHARE) -> DataFrame:
    """left with the columns of right, which has a row per key at most, or nulls where it has none; null keys have none.

    Rows of left that share a key aren't gathered in a task: keys of more than 1 / share of the rows, so fewer than
    share, are looked up in a broadcast, and only the others' rows are shuffled. left should be a table, as it is read twice.
    """
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = left.count()
    hot = [tuple(r[k] for k in keys) for r in counts.where(F.col("__n") > max(total / share, 16)).select(*keys).collect()]  # fewer than share rows
    if not hot:
        return left.join(right, list(keys), "left")
    named = left.sparkSession.createDataFrame(hot, left.select(*[F.col(k).alias(f"__{k}") for k in keys]).schema)
    is_hot = same([F.col(k) for k in keys], [F.col(f"__{k}") for k in keys])
    few = right.join(F.broadcast(named), is_hot, "left_semi")
    often = left.join(F.broadcast(named), is_hot, "left_semi").join(F.broadcast(few), list(keys), "left")
    return often.unionByName(left.join(F.broadcast(named), is_hot, "left_anti").join(right, list(keys), "left"))


def hash_unit(*cols: Column) -> Column:
    """A uniform draw in (0, 1) from the MD5 of the columns, the same in any SQL engine: 52 bits, half a step off zero."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _ship_by_value() -> None:
    """Functions of this subpackage travel to executors as code, so that executors need not have it installed."""
    import lodestone.llm
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(lodestone.llm)


_ship_by_value()
