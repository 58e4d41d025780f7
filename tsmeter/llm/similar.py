"""Near copies: SimHash links by the trie self-join, verified; what SimHash can't see by an exact join.

SimHash comes first.  The rows' fingerprints (of the same word shingles) are joined with each other
through their binary trie (``simhash.links``, ``BUDGET`` bits), and a link holds if the rows'
sets of shingles have a Jaccard similarity of 0.8 or more.  Fingerprints with many links are compared with
their smallest neighbour, then along the links that this leaves between different components.

A pair at 0.8 often differs in more bits than a trie can bear, so the rows that SimHash leaves apart
meet again.  Candidates share a bucket: a band of minima of seeded permutations of their shingle
hashes.  A pair at 0.8 misses all 16 bands of six with probability 0.008.  The rows of a bucket are
compared with its smallest row (unless SimHash has linked them), and those that this leaves outside the bucket's largest
component with some rows of that one (``PIVOTS``), which settles most groups of copies cheaply.
Where a bucket's rows are still in more than one
component, they are *open*, and all pairs of open rows of different components that reach the
similarity are found by an exact join with prefix and position filters:

* The shingles of each row are put in one order for all rows, those first that few open
  rows hold (by a table of ``CELLS`` counters; any order gives the same links, this one few
  candidates).  Of two rows at 0.8, the smaller holds one of the larger's first fifth of
  shingles among its own first ninth.
* So rows are dealt by the shingles of these prefixes, and meet if a shingle's place leaves
  room for the overlap that the similarity needs.

A crowd that shares a passage but is not alike has the passage behind its prefixes, so it makes no
pairs; copies are one component after the first step and are not compared again.  Every link is
verified on the rows' whole sets of shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import connected_components, shared_table

BUDGET = 2  # bits by which linked fingerprints differ at most
TRIE_LEAVES = 16
BANDS, MINIMA = 16, 6
BLOCK = 1 << 12  # shingles whose permutations are held at once
#: Counters that order the shingles, and parts in which tasks' counters are added up.
CELLS, CHUNKS = 1 << 20, 64
#: Rows of a bucket's largest component that its other rows are compared with before the join.
PIVOTS = 8

_rng = np.random.default_rng(42)
_times = (_rng.integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_plus = _rng.integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64)[:, None]


def shingles(text: str, words: int = 5) -> set[bytes]:
    """Runs of ``words`` lower-cased words; a shorter text is one run."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def hashes(text: str, words: int = 5) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, sorted."""
    return _distinct(simhash.shingle_hashes(text, words))


def _distinct(hashed: np.ndarray) -> np.ndarray:
    return np.unique(hashed) if len(hashed) else np.array([xxhash.xxh64_intdigest(b"", 42)], np.uint64)


def buckets(hashed: np.ndarray) -> list[int]:
    """One signed 64-bit hash for each band."""
    low = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashed), BLOCK):
        low = np.minimum(low, (hashed[at : at + BLOCK] * _times + _plus).min(axis=1))
    return [int(np.uint64(xxhash.xxh64_intdigest(band.tobytes(), i)).view(np.int64)) for i, band in enumerate(low.reshape(BANDS, MINIMA))]


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """A Jaccard similarity of 0.8 or more of two sorted sets."""
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs ``a``, ``b`` of rows whose sets are alike (a written table)."""
    both = pairs.distinct().join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return shared_table(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "similar-links")


def counters(rows: DataFrame) -> np.ndarray:
    """How many of the rows' shingles fall into each cell: ``CELLS`` numbers, whatever the rows.
    Tasks send the cells that they have seen, in parts that are added up apart."""
    width = CELLS // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            own = batch.column("shingles").flatten().to_numpy().view(np.uint64)
            total += np.bincount((own % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        seen = np.flatnonzero(total)
        borders = np.searchsorted(seen, np.arange(CHUNKS + 1) * width)
        cells, counts = (pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(x)) for x in ((seen % width).astype(np.int32), total[seen]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS)), cells, counts], names=["chunk", "cells", "counts"])

    def add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk = np.zeros(width, np.int64), 0
        for batch in group:
            chunk = batch.column("chunk")[0].as_py()
            total += np.bincount(batch.column("cells").flatten().to_numpy(), weights=batch.column("counts").flatten().to_numpy(), minlength=width).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([total.tobytes()], pa.binary())], names=["chunk", "counts"])

    summed = rows.select("shingles").mapInArrow(count, "chunk long, cells array<int>, counts array<long>").groupBy("chunk").applyInArrow(add, "chunk long, counts binary")
    out = np.zeros((CHUNKS, width), np.int64)
    for r in summed.toLocalIterator():
        out[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


def prefixes(rows: DataFrame, order: np.ndarray) -> DataFrame:
    """shingle, row, component, place, size, inner of each row's first shingles: a fifth of them and one
    more; ``inner`` are those of the first ninth and one more."""
    held = rows.sparkSession.sparkContext.broadcast(order.astype(np.int64))  # CELLS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = held.value
        for batch in batches:
            for row, component, own in zip(batch.column("row").to_pylist(), batch.column("component").to_pylist(), batch.column("shingles")):
                own = own.values.to_numpy()
                n = len(own)
                first = own[np.lexsort((own, order[(own.view(np.uint64) % np.uint64(CELLS)).astype(np.int64)]))][: n - (4 * n + 4) // 5 + 1]
                k, place = len(first), np.arange(len(first))
                inner = place < n - (8 * n + 8) // 9 + 1
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(np.full(k, row)), pa.array(np.full(k, component)), pa.array(place), pa.array(np.full(k, n)), pa.array(inner)], names=["shingle", "row", "component", "place", "size", "inner"])

    return rows.mapInArrow(run, "shingle long, row long, component long, place long, size long, inner boolean")


def candidates(rows: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of rows (``row``, ``component``, ``shingles``) of different components that
    may be alike; none that is alike is missing."""
    found = shared_table(prefixes(rows, counters(rows)), "similar-prefixes")
    by_component = found.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner"))
    main = F.max_by("component", F.struct("n", "component")).alias("main")
    shared = by_component.groupBy("shingle").agg(main, F.count(F.lit(1)).alias("k"), F.max("inner").alias("inner")).filter("k > 1 and inner").select("shingle", "main")
    some = found.join(shared, "shingle").withColumn("apart", F.col("component") != F.col("main")).drop("main")
    names = ("row", "component", "place", "size", "apart")
    x = some.filter("inner").select("shingle", *(F.col(c).alias(f"x_{c}") for c in names))
    y = some.select("shingle", *(F.col(c).alias(f"y_{c}") for c in names))
    # the smaller row (then the one that comes first) gives the inner prefix
    smaller = (F.col("x_size") < F.col("y_size")) | ((F.col("x_size") == F.col("y_size")) & (F.col("x_row") < F.col("y_row")))
    room = F.least(F.col("x_size") - F.col("x_place"), F.col("y_size") - F.col("y_place"))
    fits = (9 * room >= 4 * (F.col("x_size") + F.col("y_size"))) & (5 * F.col("x_size") >= 4 * F.col("y_size"))
    on = (F.col("x_component") != F.col("y_component")) & smaller & fits
    # a shingle's largest component does not meet itself
    met = x.filter("x_apart").join(y, "shingle").filter(on).union(x.filter("not x_apart").join(y.filter("y_apart"), "shingle").filter(on))
    return met.select(F.least("x_row", "y_row").alias("a"), F.greatest("x_row", "y_row").alias("b"))


def _opened(members: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, row, component of the rows of buckets with more than one component."""
    named = members.join(found, members["row"] == found["node"], "left").select("bucket", "row", F.coalesce("component", "row").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket")
    return named.join(mixed, "bucket")


def _with_pivots(opened: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b``: rows outside their bucket's largest component with some rows of it."""
    sizes = opened.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    # the rows that come first in some orders (row xor a number), the same orders in all buckets
    orders = np.random.default_rng(5).integers(0, 1 << 62, PIVOTS).tolist()
    inside = opened.join(main, "bucket")
    first = inside.filter("component = main").groupBy("bucket").agg(F.array_distinct(F.array(*(F.min(F.col("row").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x)) for x in orders))).alias("pivots"))
    pairs = inside.filter("component <> main").join(first, "bucket").select("row", F.explode("pivots").alias("pivot"))
    return pairs.select(F.least("row", "pivot").alias("a"), F.greatest("row", "pivot").alias("b"))


def fingerprint_links(marked: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of rows by SimHash: each row with the first of its fingerprint, and the
    first rows of fingerprints that differ in at most ``BUDGET`` bits.  ``marked``: row, fp."""
    classes = shared_table(marked.groupBy("fp").agg(F.min("row").alias("id"), F.count(F.lit(1)).alias("n")), "similar-fingerprints")
    leaf_size = int(np.clip(classes.count() // TRIE_LEAVES, *simhash.LEAF))
    near = simhash.links(classes.select("fp", "id"), BUDGET, leaf_size)
    same = marked.join(classes.filter("n > 1").select("fp", "id"), "fp").filter("row <> id").select(F.col("id").alias("a"), F.col("row").alias("b"))
    return shared_table(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(same), "similar-near")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those pairs whose rows are in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(found.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")), end, "left")
    return pairs.filter(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select("a", "b")


def components(texts: DataFrame, words: int = 5) -> DataFrame:
    """node, component (the smallest row reached) of every row that has a near copy.

    ``texts`` has ``row`` (distinct longs) and ``text``; it is read several times and has
    to be the same each time.  Null and blank texts are alike.
    """
    texts = texts.select("row", F.coalesce(texts["text"].cast("string"), F.lit("")).alias("text"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, dealt = [], []
            for t in batch.column("text"):
                own = simhash.shingle_hashes(t.as_py(), words)
                fps.append(simhash.majority(own))
                dealt.append(buckets(_distinct(own)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(dealt, pa.list_(pa.int64()))], names=["row", "fp", "buckets"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([hashes(t.as_py(), words).view(np.int64) for t in batch.column("text")], pa.list_(pa.int64()))], names=["row", "shingles"])

    marked = shared_table(texts.mapInArrow(deal, "row long, fp long, buckets array<long>"), "similar-buckets")
    dealt = marked.select("row", F.explode("buckets").alias("bucket"))
    common = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("low")).filter("n > 1").drop("n")
    members = shared_table(dealt.join(common, "bucket"), "similar-members")
    near = fingerprint_links(marked.select("row", "fp"))
    some = members.select("row").union(near.select("a")).union(near.select("b")).distinct()
    sets = shared_table(texts.join(some, "row", "left_semi").mapInArrow(hashed, "row long, shingles array<long>"), "similar-sets")
    links = verified(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets)
    found = connected_components(links, "similar-components")
    links = links.union(verified(_apart(near, found), sets))
    links = links.union(verified(_apart(members.filter("row <> low").select(F.col("low").alias("a"), F.col("row").alias("b")), found), sets))
    found = connected_components(links, "similar-components")
    opened = shared_table(_opened(members, found), "similar-open-buckets")
    links = shared_table(links.union(verified(_with_pivots(opened), sets)), "similar-links")
    found = connected_components(links, "similar-components")
    opened = _opened(members, found).select("row", "component").distinct()
    rows = shared_table(sets.join(opened, "row"), "similar-open")
    more = verified(candidates(rows), sets)
    found = connected_components(links.union(more), "similar-components")
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())
