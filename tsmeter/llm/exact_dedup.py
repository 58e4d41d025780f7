"""Exact deduplication through an extendible-hash index on shared files.

DataFrame functions only.  Every text has a 64-bit hash.  The directory maps the
hash's leading bits to a bucket; it doubles (one bit more) wherever a bucket holds more
hashes than its capacity, until none does.  Rows find their bucket in the directory;
within a bucket, texts are told by their bytes, texts that share a hash form a chain,
and each chain link knows its group.  Owner tasks hold ranges of (bucket, hash) and
write them sorted to shared files, which the rows are then looked up in.

Scale: the directory is one byte a slot.  Texts are combined before the shuffle (one
row for each task and distinct text leaves a map task, however many copies there are)
and move once; all else moves rows of about 70 bytes.  The look-up join is split by
adaptive execution where one text owns many rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, shared_table

BUCKET_CELLS = 1 << 14  # hashes that a bucket holds, at most
SPARE = 3  # bits of the first count of hashes beyond those that even buckets need


class Directory:
    """``depths[slot]`` is the depth of the bucket that holds the hashes of a slot."""

    def __init__(self, bits: int, depths: bytes):
        self.bits, self.depths = bits, depths

    def bucket(self, hash_column: Column) -> Column:
        """The bucket's name: its first hash (as a signed number)."""
        slot = F.shiftrightunsigned(hash_column, 64 - self.bits) if self.bits else F.lit(0).cast("long")
        depth = F.conv(F.hex(F.substring(F.lit(bytearray(self.depths)), slot.cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.call_function("shiftrightunsigned", hash_column, 64 - depth), 64 - depth))


def build_directory(hashes: DataFrame, bucket_cells: int) -> Directory:
    """Doubles the directory until no bucket holds more than ``bucket_cells`` hashes.

    ``hashes`` has a row for each different ``hash``.  Only counts by slot reach the
    driver, about ``2**SPARE`` for each bucket.
    """
    total = hashes.count()
    bits = 0 if total <= bucket_cells else min(63, math.ceil(math.log2(total / bucket_cells)) + SPARE)
    while True:  # more leading bits are counted as long as a single slot is overfull
        slots = hashes.groupBy((F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0)).cast("long").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        counts = {r["slot"]: r["n"] for r in slots.collect()}
        if bits == 63 or max(counts.values(), default=0) <= bucket_cells:
            break
        bits = min(63, bits + SPARE)
    held = [counts]  # hashes under each prefix: of all bits, of one bit less, ...
    for _ in range(bits):
        up: dict[int, int] = {}
        for prefix, n in held[-1].items():
            up[prefix >> 1] = up.get(prefix >> 1, 0) + n
        held.append(up)
    depths, todo = bytearray(1 << bits), [(0, 0)]
    while todo:
        depth, prefix = todo.pop()
        if depth < bits and held[bits - depth].get(prefix, 0) > bucket_cells:  # split
            todo += [(depth + 1, 2 * prefix), (depth + 1, 2 * prefix + 1)]
        else:
            width = 1 << (bits - depth)
            depths[prefix * width : (prefix + 1) * width] = bytes([depth]) * width
    return Directory(bits, bytes(depths))


def build_index(rows: DataFrame, directory: Directory) -> DataFrame:
    """The index as files in the shared folder: bucket, hash, chain, text_sha256, keep_id,
    group_size.

    ``rows`` has bucket, hash, text and doc_id.  A chain's links are the different texts
    under one hash; they are told by their bytes.
    """
    links = rows.groupBy("bucket", "hash", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    links = links.select("bucket", "hash", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    owned = links.repartitionByRange("bucket", "hash")
    chained = owned.withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "hash").orderBy("text_sha256")))
    return shared_table(chained.sortWithinPartitions("bucket", "hash", "chain"), "dedup-index")


def decide(rows: DataFrame, bucket_cells: int = BUCKET_CELLS) -> DataFrame:
    """``rows`` (doc_id, text and others) without text, with keep_id, group_size, kept,
    text_sha256."""
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    directory = build_directory(shared_table(hashed.select("hash").distinct(), "dedup-hashes"), bucket_cells)
    placed = hashed.withColumn("bucket", directory.bucket(F.col("hash")))
    index = build_index(placed, directory)
    keyed = placed.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")
    found = keyed.join(index.drop("chain"), ["bucket", "hash", "text_sha256"])
    return found.drop("bucket", "hash").withColumn("kept", F.expr("doc_id <=> keep_id"))


def exact_dedup(docs: DataFrame, bucket_cells: int = BUCKET_CELLS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Of rows with identical text the one with the largest doc_id stays.  A null text
    equals the empty text.  Repeated rows with one doc_id are rows of the group:
    each is returned, and each with the largest id is kept.  A null doc_id loses to
    any other.  An empty table gives an empty result.  Other columns are ignored.
    """
    return decide(id_and_text(docs), bucket_cells).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
