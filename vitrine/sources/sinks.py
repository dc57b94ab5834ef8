"""Sinks (SNK1-SNK3): result tables, prediction tables, fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """SNK1/SNK2: overwrite ``path`` with ``df`` as Parquet (default) or a
    headered CSV; the write is distributed (one file per task)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def save_model(model: PipelineModel, path: str) -> None:
    """SNK3: persist a fitted pipeline (Spark ML format, overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
