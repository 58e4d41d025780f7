"""The operators as stages of a corpus pipeline: documents in, documents out.

Each stage takes all rows its predecessor kept, and its decisions take effect.  In all of
them a null text counts as empty, repeated rows are rows of their own, an empty table
gives an empty result, and further columns of any name go with their row (``pack``,
the last, returns its own columns).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, packing, secrets, similar, toxicity
from .common import read_table, shared_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that the toxicity operator predicts toxic, whatever their doc_id (null
    too).  Null and empty texts stay."""
    lexicon, weights = toxicity.train(docs, read_table(spark, sf_dir, "labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = toxicity.Scorer(lexicon)
        for batch in batches:
            x = scorer.all_features([t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(toxicity.probability(x, weights) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def _boxed(docs: DataFrame, label: str) -> DataFrame:
    """``docs`` written as ``doc`` (the whole row) with a number ``row``, so that no name of
    a column can clash."""
    return shared_table(docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row")), label)


def _without(boxed: DataFrame, gone: DataFrame) -> DataFrame:
    return boxed.join(gone, "row", "left_anti").select("doc.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the one with the largest doc_id; null is the smallest, and of
    rows with one doc_id and text the first read stays.  A null text equals the empty one.
    Any other columns, whatever their names, go with their row."""
    boxed = _boxed(docs, "exact-rows")
    rows = boxed.select(F.col("doc.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc.text").cast("string"), F.lit("")).alias("text"), "row")
    decided = shared_table(exact_dedup.decide(rows).select("row", "kept", "text_sha256"), "exact-decided")
    first = decided.filter("kept").groupBy("text_sha256").agg(F.min("row").alias("first"))
    repeated = decided.filter("kept").join(first, "text_sha256").filter("row <> first").select("row")
    return _without(boxed, decided.filter("not kept").select("row").union(repeated))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: the one with the smallest doc_id (null is
    the largest; then by the hash of the text, then the first read).

    Near copies share 0.8 or more (Jaccard) of their shingles of five words, which is
    verified for every link.  Rows are nodes of their own, whether doc_id is null or
    repeated; null and blank texts are alike.  Any other columns, whatever their names,
    go with their row.
    """
    boxed = _boxed(docs, "near-rows")
    found = shared_table(similar.components(boxed.select("row", F.col("doc.text").alias("text")), words=5), "near-found")
    rank = F.struct(F.col("doc.doc_id").isNull(), F.col("doc.doc_id").cast("long"), F.sha2(F.coalesce("doc.text", F.lit("")).cast("binary"), 256), "row")
    members = found.withColumnRenamed("node", "row").join(boxed.select("row", rank.alias("rank")), "row")
    stays = members.groupBy("component").agg(F.min("rank")["row"].alias("kept"))
    return _without(boxed, found.join(stays, "component").filter("node <> kept").select(F.col("node").alias("row")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in ``text`` replaced by a mark; no row goes; a null text stays null."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null or empty text is the end id alone."""
    return packing.digest(packing.pack(docs))
