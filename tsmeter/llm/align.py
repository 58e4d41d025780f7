"""Alignment of two tokenizers' tokens over the bytes of each text.

The texts of a part of an Arrow batch lie one after the other in one array of bytes.  The
ends of all tokens of either tokenizer are counted once at their byte offsets; where both
have an end, the text is cut into groups.  Prefix sums over these counts, read at the
documents' borders, give each document's numbers.

Both tokenizers work on words alone: a cut before a single space between other characters
changes no token of either (checked for the pieces of the second), so each word of a part is
encoded once, with the space before it.

Scale: one narrow pass tokenises and writes each document's distinct linked id pairs.  Their
document counts are one hash aggregate with a map-side part.  Of the pair counts at most
``HOT`` pairs, the most frequent ones, are broadcast (a threshold that a histogram of 64
rows gives); a pair below it is held by few documents, so the join of the rest has no hot key.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, parts, shared_table

#: Bytes of text that are aligned together (a longer text is a part of its own).
PART = 2 << 20
#: Linked pairs that are held at once before equal ones are added up.
BLOCK = 1 << 21
#: Pairs whose counts are broadcast, at most.
HOT = 1 << 20
MEASURES = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


@dataclass(frozen=True)
class Side:
    """A tokenizer: ``encode`` takes a list of strings that begin with a space."""

    encode: object
    table: pa.Array  # bytes of each id
    sizes: np.ndarray


@functools.lru_cache(maxsize=2)
def sides(ranks_path: str | None = None, model_path: str | None = None) -> tuple[Side, Side]:
    """A: byte-level BPE by its ranks file (the JSON file's vocabulary).  B: a sentencepiece model."""
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("align", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    a = Side(lambda texts: [bpe.encode_ordinary(t) for t in texts], pa.array(table, pa.binary()), np.array([len(t) for t in table], np.int64))
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path or public_tokenizers.path("piece_bpe_32k.model"))
    table = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if "▁" in piece.lstrip("▁"):
            raise ValueError(f"The piece {piece!r} spans words")
        table.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else piece.replace("▁", " ").encode())
    b = Side(lambda texts: sp.encode([t[1:] for t in texts], num_threads=1), pa.array(table, pa.binary()), np.array([len(t) for t in table], np.int64))
    return a, b


def _next_ok() -> np.ndarray:
    """Bytes that begin a character which is surely no white space and no space mark."""
    ok = np.zeros(256, bool)
    ok[0x21:0x7F] = ok[0xC3:0xF5] = True
    ok[[0xE1, 0xE2, 0xE3]] = False
    return ok


NEXT_OK = _next_ok()


def word_starts(data: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Offsets of the spaces before which a text may be cut: single, after a visible ASCII
    character or one of two bytes (beyond the first 64 of these), and before one that is no
    white space.  The start of each document is one."""
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 1) & (at + 1 < len(data))]
    before = data[at - 1]
    plain = (before > 0x20) & (before < 0x7F)
    two = (before >= 0x80) & (data[at - 2] >= 0xC3) & (data[at - 2] < 0xE0)
    start = np.zeros(len(data), bool)
    start[at[(plain | two) & NEXT_OK[data[at + 1]]]] = start[doc_starts] = True
    return np.flatnonzero(start)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All indices of the ranges, one range after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for ids in lists for x in ids), np.int64, int(sizes.sum())), sizes


def encode_words(words: pa.Array, side: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all words, ids of each word, and whether their bytes are the word's."""
    ids, sizes = _flat(side.encode(words.to_pylist()))
    pieces = side.table.take(pa.array(ids))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pieces), b"")
    return ids, sizes, pc.equal(joined, words.cast(pa.binary())).to_numpy(zero_copy_only=False)


@dataclass
class Aligned:
    """The tokens of a part: ids, their groups and the documents' borders in each array."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    at_a: np.ndarray  # tokens before each document (one entry more than documents)
    at_b: np.ndarray
    at_group: np.ndarray


def align(texts: list[str], a: Side, b: Side) -> Aligned:
    """Texts that are empty or whose bytes a tokenizer does not keep have no tokens."""
    raw = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    size = np.array([len(x) for x in raw], np.int64)
    data = b"".join(raw)
    ends = np.cumsum(size)
    bytes_ = np.frombuffer(data, np.uint8)
    cuts = word_starts(bytes_, (ends - size)[size > 0])
    offsets = np.append(cuts, len(data)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
    code = words.indices.to_numpy()
    (ids_a, n_a, fine_a), (ids_b, n_b, fine_b) = (encode_words(words.dictionary, side) for side in (a, b))
    doc = np.searchsorted(ends, cuts, side="right")
    broken = np.bincount(doc, weights=~(fine_a & fine_b)[code], minlength=len(texts)) > 0
    code = code[~broken[doc]]
    size = np.where(broken, 0, size)
    ends = np.concatenate(([0], np.cumsum(size)))
    tokens = [flat[ranges((np.cumsum(n) - n)[code], n[code])] for flat, n in ((ids_a, n_a), (ids_b, n_b))]
    stops = [np.cumsum(side.sizes[ids]) for side, ids in zip((a, b), tokens)]
    counted = [np.bincount(stop, minlength=int(ends[-1]) + 1) for stop in stops]
    groups = np.cumsum((counted[0] > 0) & (counted[1] > 0))
    before = [np.cumsum(c)[ends] for c in counted]
    return Aligned(*tokens, *(groups[stop - 1] for stop in stops), *before, groups[ends])


def _digits(n: int) -> np.ndarray:
    """Each id's decimal text and a separator, padded with zero bytes: [separator, id, byte]."""
    width = len(str(n - 1)) + 1
    out = np.zeros((3, n, width), np.uint8)
    for k, mark in enumerate(",|;"):
        out[k] = np.frombuffer("".join(f"{i}{mark}".ljust(width, "\0") for i in range(n)).encode(), np.uint8).reshape(n, width)
    return out


@functools.lru_cache(maxsize=2)
def _digit_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    table = _digits(n)
    return table, (table[0] > 0).sum(axis=1)


def digests(x: Aligned, n_ids: int) -> list[str]:
    """sha256 of each document's groups written as ``a1,a2|b1;a3|b2,b3``; without tokens ''."""
    table, widths = _digit_table(n_ids)
    n_groups = int(x.at_group[-1])
    n_a, n_b = np.bincount(x.group_a, minlength=n_groups), np.bincount(x.group_b, minlength=n_groups)
    ids, marks = np.empty(len(x.a) + len(x.b), np.int64), np.zeros(len(x.a) + len(x.b), np.int8)
    ids[np.arange(len(x.a)) + (np.cumsum(n_b) - n_b)[x.group_a]] = x.a
    ids[np.arange(len(x.b)) + np.cumsum(n_a)[x.group_b]] = x.b
    marks[np.cumsum(n_a + n_b) - n_b - 1] = 1
    marks[np.cumsum(n_a + n_b) - 1] = 2
    chars = table[marks, ids].reshape(-1)
    text = memoryview(chars[chars > 0].tobytes())
    at = np.concatenate(([0], np.cumsum(widths[ids])))[x.at_a + x.at_b].tolist()
    return [hashlib.sha256(text[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(at, at[1:])]


def _added(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their times."""
    key, n = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def linked(x: Aligned, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys ``document << 2 * bits | a << bits | b`` of linked pairs and how often each is linked."""
    n_groups = int(x.at_group[-1])
    n_a, n_b = np.bincount(x.group_a, minlength=n_groups), np.bincount(x.group_b, minlength=n_groups)
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    doc = np.repeat(np.arange(len(x.at_group) - 1), np.diff(x.at_group)) << (2 * bits)
    product = n_a * n_b
    keys, times, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def add(key: np.ndarray, n: np.ndarray) -> None:
        nonlocal keys, times, held
        keys.append(key)
        times.append(n)
        held += len(key)
        if held > 4 * BLOCK:
            (key, n) = _added(keys, times)
            keys, times, held = [key], [n], 0

    small = np.flatnonzero(product <= BLOCK)
    block = (np.cumsum(product[small]) - product[small]) // BLOCK
    for part in np.split(small, np.flatnonzero(np.diff(block)) + 1):
        own = np.repeat(part, product[part])
        k = np.arange(len(own)) - np.repeat(np.cumsum(product[part]) - product[part], product[part])
        key = doc[own] | x.a[first_a[own] + k // n_b[own]] << bits | x.b[first_b[own] + k % n_b[own]]
        add(*_added([key], [np.ones(len(key), np.int64)]))
    for g in np.flatnonzero(product > BLOCK).tolist():  # distinct ids first, then some rows of their product at once
        (ua, ca), (ub, cb) = (np.unique(v[f : f + n], return_counts=True) for v, f, n in ((x.a, first_a[g], n_a[g]), (x.b, first_b[g], n_b[g])))
        step = max(1, BLOCK // len(ub))
        for at in range(0, len(ua), step):
            add((doc[g] | ua[at : at + step, None] << bits | ub).reshape(-1), (ca[at : at + step, None] * cb).reshape(-1))
    return _added(keys, times)


def _lists(values: np.ndarray, borders: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(borders - borders[0], pa.int32()), pa.array(values, kind))


def alignments(docs: DataFrame, ranks_path: str | None = None, model_path: str | None = None) -> DataFrame:
    """doc_id, a, b (ids), a_group, b_group (each token's group, from 0) of every row of ``docs``.

    Null and empty texts, and texts whose bytes one of the tokenizers does not keep (the
    second reads U+2581 as a space), have empty arrays.  Repeated rows are aligned each; an
    empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(ranks_path, model_path)
        for part in (p for batch in batches for p in parts(batch, PART)):
            x = align(part.column("text").to_pylist(), a, b)
            inside = [group - np.repeat(x.at_group[:-1], np.diff(at)) for group, at in ((x.group_a, x.at_a), (x.group_b, x.at_b))]
            columns = [_lists(v, at, pa.int32()) for v, at in ((x.a, x.at_a), (x.b, x.at_b), (inside[0], x.at_a), (inside[1], x.at_b))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "a", "b", "a_group", "b_group"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, a array<int>, b array<int>, a_group array<int>, b_group array<int>")


def measured(docs: DataFrame, ranks_path: str | None = None, model_path: str | None = None) -> DataFrame:
    """The measures of each row, its distinct linked pairs (``a << 32 | b``) and how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(ranks_path, model_path)
        n_ids = max(len(a.table), len(b.table))
        bits = int(n_ids - 1).bit_length()
        for part in (p for batch in batches for p in parts(batch, PART)):
            x = align(part.column("text").to_pylist(), a, b)
            sha = digests(x, n_ids)
            n_groups = int(x.at_group[-1])
            product = np.bincount(x.group_a, minlength=n_groups) * np.bincount(x.group_b, minlength=n_groups)
            links = np.diff(np.concatenate(([0], np.cumsum(product)))[x.at_group])
            key, times = linked(x, bits)
            borders = np.searchsorted(key >> (2 * bits), np.arange(part.num_rows + 1))
            pairs = ((key >> bits) & ((1 << bits) - 1)) << 32 | key & ((1 << bits) - 1)
            columns = [pa.array(v) for v in (np.diff(x.at_a), np.diff(x.at_b), np.diff(x.at_group), links)]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), *columns, pa.array(sha, pa.string()), _lists(pairs, borders, pa.int64()), _lists(times, borders, pa.int64())],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    rows = id_and_text(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, f"{MEASURES}, pairs array<long>, times array<long>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (rows that hold it), best (whether no pair of the same A id has more)."""
    counts = shared_table(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "align-counts")
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))  # a row for each id of the vocabulary
    with_most = counts.join(highest, F.shiftright(counts["pair"], 32) == highest["a"])
    return shared_table(with_most.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "align-pairs")


def threshold(counts: DataFrame, most: int) -> tuple[int, int]:
    """The smallest power of two that at most ``most`` pairs' counts reach, and the pairs below it."""
    log = F.length(F.bin("n")) - 1
    by_log = {r["log"]: r["k"] for r in counts.groupBy(log.alias("log")).agg(F.count(F.lit(1)).alias("k")).collect()}  # 64 rows at most
    level, above = 64, 0
    while level and above + by_log.get(level - 1, 0) <= most:
        level -= 1
        above += by_log.get(level, 0)
    return level, sum(by_log.values()) - above


def cross_align(docs: DataFrame, hot: int = HOT, ranks_path: str | None = None, model_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    A pair's count is the number of rows that hold it linked.  ``hot`` bounds the pairs
    that are broadcast; those beyond it are joined.  Null and empty texts and texts whose bytes
    are not kept have zeros and ''; repeated rows count each; an empty table gives an
    empty result; other columns are ignored.
    """
    rows = shared_table(measured(docs, ranks_path, model_path), "align-rows")
    counts = pair_counts(rows)
    level, below = threshold(counts, hot)
    frequent = counts.filter(F.length(F.bin("n")) > level).sort("pair").toArrow()  # `hot` rows at most
    pair, n, best = (frequent.column(c).to_numpy() for c in ("pair", "n", "best"))
    held = rows.sparkSession.sparkContext.broadcast((pair, n, best.astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = held.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            own = lists.flatten().to_numpy()
            at = np.searchsorted(pair, own)
            at[at == len(pair)] = 0
            there = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            borders = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            total = lambda v: pa.array(np.diff(np.concatenate(([0], np.cumsum(v)))[borders]))  # noqa: B023, E731
            hits = lambda v: np.where(there, times * v[at], 0) if len(pair) else np.zeros(len(own), np.int64)  # noqa: B023, E731
            columns = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*columns, total(hits(best)), total(hits(n))], names=[*(c.split()[0] for c in MEASURES.split(", ")), "n_best", "count_sum"])

    out = rows.mapInArrow(run, f"{MEASURES}, n_best long, count_sum long")
    if below:
        rare = counts.filter(F.length(F.bin("n")) <= level)
        exploded = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        rest = exploded.join(rare, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("n")).alias("sum"))
        out = out.join(rest, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("sum", F.lit(0))})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
