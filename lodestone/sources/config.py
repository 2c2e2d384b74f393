"""Run configurations (JSON or key=value lines), CSV tables and text reports."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Dataset:
    name: str
    base_path: str
    query_path: str = ""
    groundtruth_path: str = ""


@dataclass
class Config:
    """Unset numbers (-1) take the run's defaults."""

    output_dir: str = "results"
    topk: int = 50
    random_seed: int = 2026
    query_subset_size: int = -1
    eta: float = -1.0
    k_clusters: int = -1
    tau: float = -1.0
    nprobes: list[int] = field(default_factory=lambda: list(range(1, 21)))
    budgets: list[int] = field(default_factory=lambda: [500, 1000, 2000, 5000, 10000, 20000, 50000])
    methods: list[str] = field(default_factory=lambda: ["linear", "baseline", "clustered"])
    datasets: list[Dataset] = field(default_factory=list)


ALIASES = {"seed": "random_seed"}


def _value(kind: str, text: str) -> object:
    if kind.startswith("list[int"):
        return [int(x) for x in text.replace("[", "").replace("]", "").split(",") if x.strip()]
    if kind.startswith("list[str"):
        return [x.strip() for x in text.split(",") if x.strip()]
    return {"int": int, "float": float}.get(kind, str)(text)


def parse(text: str) -> Config:
    """A configuration from JSON, or else from key=value lines; # begins a comment, unknown keys are errors."""
    known = {f.name: str(f.type) for f in fields(Config)}
    try:
        raw = json.loads(text)
    except json.JSONDecodeError:
        raw = {}
        for line in text.splitlines():
            line = line.partition("#")[0].strip()
            if line:
                key, eq, value = line.partition("=")
                if not eq:
                    raise ValueError(f"neither JSON nor key=value: {line!r}") from None
                key = ALIASES.get(key.strip(), key.strip())
                raw[key] = _value(known.get(key, "str"), value.strip())
    raw = {ALIASES.get(k, k): v for k, v in raw.items()}
    if unknown := set(raw) - set(known):
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    if isinstance(raw.get("methods"), dict):
        raw["methods"] = [k for k, on in raw["methods"].items() if on]
    raw["datasets"] = [x if isinstance(x, Dataset) else Dataset(**x) for x in raw.get("datasets", [])]
    return Config(**raw)


def dump(config: Config) -> str:
    return json.dumps(asdict(config), indent=2)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Small result tables: one file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A report as one text file in a folder, on whatever file system that is."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def markdown(df: DataFrame) -> str:
    """A small result table as Markdown, all its rows."""
    line = lambda cells: "| " + " | ".join("" if x is None else str(x) for x in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in df.collect()]])


def write_results(df: DataFrame, path: str) -> None:
    """Results of any size: Parquet, or CSV with a header if the path says so."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if path.endswith(".csv") else writer.parquet(path)
