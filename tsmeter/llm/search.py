"""Ranked lexical search over document-sharded postings with integer impacts.

The index is a table of shards.  A shard holds some documents as compressed sparse rows: its
terms in order, and for each term the documents that hold it with the impact that the
term has there.  Impacts depend on the document and on corpus-wide lengths alone, so they are
computed once, when the index is built.  A search goes through an item's terms one at a
time and adds weight x impact into a dense array over the shard's documents; the best
are selected with argpartition, ties at the border by doc_id.

Scale: the lengths are one aggregate.  Building and searching are narrow passes; a
shard has at most ``SHARD`` postings unless one document alone has more.  A shard is a row of two
binary columns, each a compressed Arrow stream of its lists, and row groups and pages are cut
after a few shards, so that a task holds a few of them at a time however much it reads or writes.  Items are searched
in blocks of bounded size, each against all shards; what leaves a task is the best
``top`` of each item over all its shards, and these are merged in two steps.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, parts, shared_table

#: Letters and digits of ASCII and everything beyond ASCII, in bytes that are lower-cased.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
IN_TERM = np.array([TERM.match(bytes([b]).lower()) is not None for b in range(256)])
#: Bytes of text whose terms are counted together.
PART = 4 << 20
#: Postings of a shard; terms of the items that are searched together; merging tasks for each item.
SHARD, BLOCK, SALTS = 1 << 20, 1 << 20, 16
#: For reading documents: else a task reads a row group's texts into one direct buffer beside the heap, however large.
READ = {"parquet.hadoop.vectored.io.enabled": "false"}
INDEX = "terms binary, postings binary"
#: Bytes of a row group of the index (a shard at least).  Sizes are looked at after each row; Spark's writer
#: looks after 100, which a file of shards seldom has, and its pages are as large as the file then.
GROUP = 8 << 20
WRITTEN = {"parquet.block.size": GROUP, "parquet.page.size.row.check.min": 1, "compression": "none"}

ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS raw FROM documents),
words AS (SELECT doc_id, translate(unnest(raw), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
lens AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lens),
m AS (SELECT doc_id, 100 - 75 + ((75 * n * big_n) // big_l) AS m FROM lens, total),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, total),
q AS (SELECT item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS k FROM q GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM qt JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def terms(text: str) -> list[bytes]:
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower())  # bytes: A-Z only


def lengths(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts(batch, PART)):
            text = part.column("text").cast(pa.large_binary())
            at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            inside = IN_TERM[np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
            at = at - at[0]
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            starts = at[:-1][at[:-1] < at[1:]]
            first[starts] = inside[starts]
            n = np.diff(np.searchsorted(np.flatnonzero(first), at))
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["docs", "terms"])

    row = id_and_text(docs).select("text").mapInArrow(run, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    return row["docs"], row["terms"]


def postings(texts: list[str], n_docs: int, n_terms: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms in order, the start of each one's postings, and the postings' documents and impacts."""
    found = [terms(t) for t in texts]
    size = np.fromiter(map(len, found), np.int64, len(found))
    coded = pa.array([t for own in found for t in own], pa.binary()).dictionary_encode()
    names = coded.dictionary
    order = pc.sort_indices(names).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    key, tf = np.unique(place[coded.indices.to_numpy()] * max(1, len(texts)) + np.repeat(np.arange(len(texts)), size), return_counts=True)
    term, doc = key // max(1, len(texts)), key % max(1, len(texts))
    m = 100 - 75 + (75 * size * n_docs) // max(1, n_terms)
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    return names.take(pa.array(order)), np.searchsorted(term, np.arange(len(order) + 1)), doc, impact


def build(docs: DataFrame, shard: int = SHARD) -> tuple[DataFrame, int]:
    """The index of ``docs``, a written table of shards (``INDEX``), and its documents with a term."""
    n_docs, n_terms = lengths(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, waiting = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                size = len(text.as_buffer()) // 2  # more terms than that no text has
                if texts and waiting + size > shard:
                    yield _shard(ids, texts, n_docs, n_terms)
                    ids, texts, waiting = [], [], 0
                ids.append(doc_id)
                texts.append(text.as_py())
                waiting += size
        if texts:
            yield _shard(ids, texts, n_docs, n_terms)

    return shared_table(id_and_text(docs).mapInArrow(run, INDEX), "search-index", **WRITTEN), n_docs


def _shard(ids: list[int | None], texts: list[str], n_docs: int, n_terms: int) -> pa.RecordBatch:
    names, starts, doc, impact = postings(texts, n_docs, n_terms)
    held = _packed(terms=names, starts=pa.array(starts, pa.int32())), _packed(doc_ids=pa.array(ids, pa.int64()), docs=pa.array(doc, pa.int32()), impacts=pa.array(impact, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in held], names=["terms", "postings"])


def _packed(**lists: pa.Array) -> bytes:
    """Lists of any lengths as one row of an Arrow stream."""
    row = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(x)], x) for x in lists.values()], names=list(lists))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: pa.BinaryScalar) -> dict[str, pa.Array]:
    row = pa.ipc.open_stream(packed.as_buffer(), options=pa.ipc.IpcReadOptions(use_threads=False)).read_next_batch()
    return {name: row.column(name)[0].values for name in row.schema.names}


def best(score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores above 0, equal ones by ascending id, in order."""
    some = np.flatnonzero(score > 0)
    if len(some) > top:
        border = score[some[np.argpartition(-score[some], top - 1)[:top]]].min()
        above, ties = some[score[some] > border], some[score[some] == border]
        left = top - len(above)
        if len(ties) > left:
            ties = ties[np.argpartition(ids[ties], left - 1)[:left]]
        some = np.concatenate((above, ties))
    return some[np.lexsort((ids[some], -score[some]))]


def _item_blocks(items: DataFrame, block: int) -> Iterator[tuple[list, list[Counter]]]:
    """Items with their terms' counts, in runs of about ``block`` distinct terms."""
    ids, counts, held = [], [], 0
    for r in items.toLocalIterator():
        found = Counter(terms(r["text"] or ""))
        if ids and held + len(found) > block:
            yield ids, counts
            ids, counts, held = [], [], 0
        ids.append(r["item_id"])
        counts.append(found)
        held += len(found)
    if ids:
        yield ids, counts


def search(docs: DataFrame, items: DataFrame, top: int = 10, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents above 0 of each row of ``items``.

    Null and empty texts have no terms: such documents are in no result, such items have
    no rows.  Equal scores are ranked by ascending doc_id, a null one last.  Rows that
    repeat a doc_id are ranked each; so are rows that repeat an item_id.  Empty tables give
    an empty result; other columns are ignored.
    """
    index, n_docs = build(docs, shard)
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for ids, counts in _item_blocks(items.select("item_id", items["text"].cast("string").alias("text")), block):
        wanted = sorted(set().union(*counts))
        found = _frequencies(index, wanted)
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found[t] + 1))) for t in wanted if t in found}
        used = [t for t in wanted if weight.get(t)]
        place = {t: i for i, t in enumerate(used)}
        rows = [[(place[t], k * weight[t]) for t, k in sorted(c.items()) if t in place] for c in counts]
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
        ranked = _merge(_search(index, used, rows, top), top).join(F.broadcast(names), "item")  # `block` terms bound the items
        out = out.union(shared_table(ranked.select("item_id", "rank", "doc_id", "score"), "search-found"))
    return out


def _frequencies(index: DataFrame, wanted: list[bytes]) -> dict[bytes, int]:
    """Documents that hold each wanted term (a block's terms at most reach the driver)."""
    held = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, total = pa.array(held.value, pa.binary()), np.zeros(len(held.value), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                own = _unpacked(batch.column("terms")[k])
                at = pc.index_in(names, own["terms"]).fill_null(-1).to_numpy()
                there = at >= 0
                total[there] += np.diff(own["starts"].to_numpy())[at[there]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "n"])

    counted = index.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {wanted[r["term"]]: r["n"] for r in counted.collect()}


def _search(index: DataFrame, used: list[bytes], rows: list[list[tuple[int, int]]], top: int) -> DataFrame:
    """item, doc_id, score: the best of each task."""
    held = index.sparkSession.sparkContext.broadcast((used, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, rows = held.value
        names = pa.array(used, pa.binary())
        so_far: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        last = np.iinfo(np.int64).max
        for batch in batches:
            for k in range(batch.num_rows):
                own = _unpacked(batch.column("terms")[k]) | _unpacked(batch.column("postings")[k])
                ids = own["doc_ids"].fill_null(last).to_numpy()
                starts, docs, impacts = (own[c].to_numpy() for c in ("starts", "docs", "impacts"))
                at = pc.index_in(names, own["terms"]).fill_null(-1).to_numpy()
                for item, query in enumerate(rows):
                    score = np.zeros(len(ids), np.int64)
                    for term, weight in query:
                        if (p := at[term]) >= 0:
                            lo, hi = starts[p], starts[p + 1]
                            score[docs[lo:hi]] += weight * impacts[lo:hi].astype(np.int64)
                    if len(some := best(score, ids, top)):
                        new_ids, new = ids[some], score[some]
                        if item in so_far:
                            new_ids, new = np.concatenate((so_far[item][0], new_ids)), np.concatenate((so_far[item][1], new))
                            keep = best(new, new_ids, top)
                            new_ids, new = new_ids[keep], new[keep]
                        so_far[item] = new_ids, new
        for item, (doc, score) in so_far.items():
            doc = pa.array(doc, mask=doc == last)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), item, np.int32)), doc, pa.array(score)], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id long, score long")


def _merge(found: DataFrame, top: int) -> DataFrame:
    """The best of all tasks: first within some parts of each item, then of these."""
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    first = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
