"""Results as a folder of Parquet tables with a JSON manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_results(spark: SparkSession, path: str, tables: dict[str, DataFrame], manifest: dict, partition_by: str | None = "segment") -> None:
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if partition_by in df.columns:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_results(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def load_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def run_tag(asset: str, timeframe: str, side: str, seed: int, exit_mode: str, horizon: int, stamp: str) -> str:
    return f"run_{asset}_{timeframe}_{side}_seed{seed}_{exit_mode}_H{horizon}_{stamp}"


def save_trees(spark: SparkSession, path: str, trees: dict[str, dict]) -> None:
    """Conditions by id, as JSON lines."""
    spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(trees.items())], "condition_id string, tree string").write.mode("overwrite").json(f"{path}/trees")


def load_trees(spark: SparkSession, path: str) -> dict[str, dict]:
    return {r["condition_id"]: json.loads(r["tree"]) for r in spark.read.schema("condition_id string, tree string").json(f"{path}/trees").collect()}


def load_folds(spark: SparkSession, pattern: str, name: str) -> DataFrame:
    """A table of all runs whose folders match a pattern, with the run's folder as a column."""
    df = spark.read.parquet(f"{pattern}/{name}")
    return df.withColumn("run", F.regexp_extract(F.input_file_name(), rf"([^/]+)/{name}/", 1))


def report(rows: DataFrame, columns: list[str], by: str, top: int = 20) -> str:
    """The best rows as a text table: a top-k report."""
    found = rows.orderBy(F.desc(by)).limit(top).select(*columns).collect()
    cells = [columns, *[[f"{v:.4g}" if isinstance(v, float) else str(v) for v in r] for r in found]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    return "\n".join("  ".join(c.rjust(w) for c, w in zip(r, widths)) for r in cells)
