"""Series tables from files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import arrow_files
from .arrow_files import ArrowFiles

#: Session setting: the folder under which named datasets lie, as <root>/<path>/<config>.
ROOT = "tsmeter.datasets.root"


def load_file(spark: SparkSession, path: str, options: dict | None = None) -> DataFrame:
    """A parquet or Arrow file, folder or glob; ``options`` go to the file system."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in ("parquet", "arrow"):
        raise ValueError(f"Files must end in .parquet or .arrow, got {path!r}")
    if suffix == "parquet":
        # options of one read reach its file system, and no other read's
        return spark.read.options(**{k.removeprefix("spark.hadoop."): str(v) for k, v in (options or {}).items()}).parquet(path)
    arrow_files.register(spark)
    return spark.read.format("arrow_file").options(**{f"fs.{k}": str(v) for k, v in (options or {}).items()}).load(path)


def load(spark: SparkSession, path: str, config: str | None = None, options: dict | None = None, root: str | None = None) -> DataFrame:
    """A file (no config), or the named dataset: a catalog table ``path.config`` or the
    parquet files in ``<root>/<path>/<config>``."""
    if config is None:
        return load_file(spark, path, options)
    root = root or spark.conf.get(ROOT, None)
    if root:
        return spark.read.parquet(f"{root.rstrip('/')}/{path}/{config}")
    name = f"{path.replace('/', '_')}.{config}"
    if spark.catalog.tableExists(name):
        return spark.read.table(name)
    raise ValueError(f"No dataset {path!r} with config {config!r}: set {ROOT} or create the table {name!r}")


def save(df: DataFrame, path: str, mode: str = "error", partition_by: list[str] | None = None) -> None:
    """Series or results as parquet (or .csv or .arrow, by the path's end)."""
    writer = df.write.mode(mode)
    if path.rstrip("/").endswith(".arrow"):
        if partition_by or mode not in ("append", "overwrite"):
            raise ValueError("Arrow folders are written whole: mode 'append' or 'overwrite', no partition columns")
        arrow_files.register(df.sparkSession)
        return writer.format("arrow_file").save(path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path.endswith(".csv"):
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.parquet(path)


__all__ = ["ROOT", "ArrowFiles", "load", "load_file", "save"]
