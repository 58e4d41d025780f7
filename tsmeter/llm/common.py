"""What the operators share: reading tables, the shared folder, hash folds and
connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that end a word in every operator: space and \\x09-\\x0D.
SPACES = " \t\n\x0b\x0c\r"
_own_dirs: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str, **options: str) -> DataFrame:
    return spark.read.options(**options).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``; a null text counts as empty."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def id_fold(mod: int, doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo ``mod`` (a null id counts as '')."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


def parts(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes of text (a longer text is in a run with few others)."""
    bytes_ = np.fromiter((len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text")), np.int64, batch.num_rows)
    which = (np.cumsum(bytes_) - bytes_) // size
    edges = np.concatenate(([0], np.flatnonzero(np.diff(which)) + 1, [batch.num_rows]))
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where a local session names none (tests) a temporary folder is made, one for
    each application; a cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _own_dirs[app] if app in _own_dirs else _own_dirs.setdefault(app, tempfile.mkdtemp(prefix="tsmeter-shared-"))
    return base.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, label: str, **options: str | int) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and
    survives the loss of any executor.  ``options`` are the writer's."""
    path = shared_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    """A table of the shared folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def connected_components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` has two long columns, ``a`` and ``b``.  Alternates the large-star and
    small-star steps, which reach the smallest node in O(log^2 n) rounds however
    long a chain is.  Each round is written to the shared folder.  Both steps
    aggregate with a map-side ``min`` and join back, so a node that holds a third
    of all edges is never gathered into one list; adaptive execution splits its
    join partition.  A round's table goes when the next is written.  Returns ``node``,
    ``component``; empty for no edges.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        # large: every neighbour, kept where larger than the node; small: smaller ones and the node
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        linked = both.join(low, "a")
        if large:
            out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = linked.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        return out.filter("a <> b").distinct()

    def unsettled(e: DataFrame) -> bool:
        """Whether a node still has two links, or is a root and a child."""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(e.select("b", F.lit(0), F.lit(1)))
        found = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
        return bool(found.filter((F.col("child") > 1) | ((F.col("child") > 0) & (F.col("root") > 0))).limit(1).count())

    def written(e: DataFrame) -> tuple[DataFrame, str]:
        path = shared_path(spark, label)
        e.write.parquet(path)
        return spark.read.schema(e.schema).parquet(path), path

    now, path = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    for _ in range(max_rounds):
        if not unsettled(now):
            break
        last = path
        now, path = written(star(star(now, True), False))
        _remove(spark, last)
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
