"""SimHash near-duplicates through a self-join of the binary trie of fingerprints.

Sorted fingerprints are an implicit binary trie: a node is a range.  Two nodes are
walked together; each level where they take different branches uses up one bit of
the Hamming budget, and a pair of nodes whose budget is spent is pruned.

Scale: equal fingerprints become one class first.  A histogram of leading bits cuts
the trie into leaves of bounded size (leaves that are too full are cut deeper); the
pairs of leaves that the budget allows are the tasks.  Each fingerprint goes to the
few tasks of its leaf.  Links stay distributed; components come from star
contraction over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, id_and_text, shared_table

BLOCK = 1 << 15  # shingles whose bits are counted at once
#: The trie is cut into about this many leaves, of LEAF[0] to LEAF[1] fingerprints.
LEAVES, LEAF = 64, (512, 1_000_000)
#: Two ranges with at most so many pairs are compared pair by pair.
DIRECT = 64
#: So many pairs of nodes are walked at once.
FRONT = 1 << 13


def shingle_hashes(text: str, words: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of all shingles, repeats included; none for a text without words."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(w) - words + 1)
    starts, ends = starts[:n].tolist(), (ends[words - 1 :] if len(w) >= words else ends[-1:]).tolist()
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, n)


def majority(hashed: np.ndarray) -> int:
    """64 bits: those set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashed), BLOCK):
        votes += np.unpackbits(hashed[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashed)).view(">u8")[0])


def fingerprint(text: str, words: int = 3) -> int:
    """The bits set in over half of the hashes of all shingles."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def near_pairs(a: np.ndarray, b: np.ndarray | None, budget: int, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs of sorted uint64 arrays that differ in at most ``budget`` bits.

    ``b`` None: pairs i < j of ``a``.  All of ``a`` agree in the first ``depth`` bits,
    and all of ``b``; the bits in which the two differ there are counted here.
    """
    own = b is None
    b = a if own else b
    none = np.zeros(0, np.int64)
    if not len(a) or not len(b):
        return none, none
    used = int(np.bitwise_count((a[0] ^ b[0]) >> np.uint64(64 - depth))) if depth else 0
    if used > budget:
        return none, none
    out_a, out_b = [], []
    todo = [(depth, np.array([[0, len(a), 0, len(b), budget - used]], np.int64).T)]
    while todo:  # depth first, so that few node pairs wait however many there are
        level, front = todo.pop()
        if front.shape[1] > FRONT:
            todo += [(level, front[:, at : at + FRONT]) for at in range(0, front.shape[1], FRONT)]
            continue
        alo, ahi, blo, bhi, left = front
        direct = ((ahi - alo) * (bhi - blo) <= DIRECT) | (level == 64)
        if direct.any():
            x, y = _products(alo[direct], ahi[direct], blo[direct], bhi[direct])
            close = np.bitwise_count(a[x] ^ b[y]) <= budget
            if own:
                close &= x < y
            out_a.append(x[close])
            out_b.append(y[close])
            front = front[:, ~direct]
        if not front.shape[1]:
            continue
        alo, ahi, blo, bhi, left = front
        bit = np.uint64(1 << (63 - level))
        middle = lambda v, lo: np.searchsorted(v, ((v[lo] >> np.uint64(63 - level)) << np.uint64(63 - level)) | bit)  # noqa: B023, E731
        am, bm = middle(a, alo), middle(b, blo)
        same = (alo == blo) & (ahi == bhi) if own else np.zeros(len(alo), bool)
        front = np.hstack([
            np.stack([alo, am, blo, bm, left]),
            np.stack([am, ahi, bm, bhi, left]),
            np.stack([alo, am, bm, bhi, left - 1]),
            np.stack([am, ahi, blo, bm, left - 1])[:, ~same],
        ])
        front = front[:, (front[1] > front[0]) & (front[3] > front[2]) & (front[4] >= 0)]
        if front.shape[1]:
            todo.append((level + 1, front))
    return np.concatenate(out_a or [none]), np.concatenate(out_b or [none])


def _products(alo, ahi, blo, bhi) -> tuple[np.ndarray, np.ndarray]:
    wide = bhi - blo
    n = (ahi - alo) * wide
    which = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return alo[which] + k // wide[which], blo[which] + k % wide[which]


def cut(fps: DataFrame, leaf_size: int | None) -> list[tuple[int, int]]:
    """(depth, prefix) of the leaves, in order.  Only counts by prefix reach the driver:
    2**16 at most, then 256 for each prefix that is still too full."""
    top = lambda bits: F.shiftrightunsigned("fp", 64 - bits)
    counts = {r["p"]: r["n"] for r in fps.groupBy(top(16).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    size = leaf_size or int(np.clip(sum(counts.values()) // LEAVES, *LEAF))
    levels = [dict() for _ in range(65)]
    levels[16] = counts
    bits = 16
    while bits < 64 and (full := [p for p, n in levels[bits].items() if n > size]):
        heavy = fps.filter(top(bits).isin(full))
        bits += 8
        got = heavy.groupBy(F.shiftrightunsigned("fp", 64 - bits).alias("p") if bits < 64 else F.col("fp").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        levels[bits] = {r["p"] % (1 << bits): r["n"] for r in got}
    for deep in (*range(16, bits + 1, 8),):  # the counts between the measured depths
        for d in range(deep - 1, max(deep - 16 if deep == 16 else deep - 8, 0) - (deep == 16), -1):
            if d < 0 or (deep > 16 and d == deep - 8):
                break
            for p, n in levels[d + 1].items():
                levels[d][p >> 1] = levels[d].get(p >> 1, 0) + n
    leaves, todo = [], [(0, 0)]
    while todo:
        depth, prefix = todo.pop()
        n = levels[depth].get(prefix, 0)
        children = [(depth + 1, 2 * prefix), (depth + 1, 2 * prefix + 1)]
        if n > size and depth < bits and any(levels[d].get(p) for d, p in children):
            todo += children
        else:
            leaves.append((depth, prefix))
    return sorted(leaves, key=lambda x: x[1] << (64 - x[0]))


def leaf_pairs(leaves: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """Pairs i <= j of leaves whose common leading bits differ in at most ``budget``,
    by walking the trie of leaves against itself."""
    starts = [p << (64 - d) for d, p in leaves]
    out, todo = [], [((0, len(leaves)), (0, len(leaves)), 0, budget)]

    def parts(lo: int, hi: int, depth: int) -> tuple[tuple[int, int], tuple[int, int]]:
        bit = 1 << (63 - depth)
        middle = next((i for i in range(lo, hi) if starts[i] & bit), hi)
        return (lo, middle), (middle, hi)

    while todo:
        x, y, depth, left = todo.pop()
        if left < 0 or x[0] == x[1] or y[0] == y[1]:
            continue
        x_leaf = x[1] - x[0] == 1 and leaves[x[0]][0] <= depth
        y_leaf = y[1] - y[0] == 1 and leaves[y[0]][0] <= depth
        if x_leaf or y_leaf:  # the rest of the deeper one's bits meets any bits
            out += [(min(i, j), max(i, j)) for i in range(*x) for j in range(*y)]
            continue
        (x0, x1), (y0, y1) = parts(*x, depth), parts(*y, depth)
        todo += [(x0, y0, depth + 1, left), (x1, y1, depth + 1, left), (x0, y1, depth + 1, left - 1)] + ([] if x == y else [(x1, y0, depth + 1, left - 1)])
    return sorted(set(out))


def links(classes: DataFrame, budget: int = 2, leaf_size: int | None = None) -> DataFrame:
    """Pairs ``a``, ``b`` of class ids whose fingerprints differ in 1 to ``budget`` bits.

    ``classes`` has one row for each distinct fingerprint: ``fp`` and ``id``.
    """
    sc = classes.sparkSession.sparkContext
    leaves = cut(classes, leaf_size)
    pairs = leaf_pairs(leaves, budget)
    tasks: list[list[tuple[int, int]]] = [[] for _ in leaves]
    for k, (i, j) in enumerate(pairs):
        tasks[i].append((k, 0))
        if i != j:
            tasks[j].append((k, 1))
    sizes = np.array([len(t) for t in tasks], np.int64)
    flat = np.array([x for t in tasks for x in t], np.int64).reshape(-1, 2)
    plan = sc.broadcast((np.array([p << (64 - d) for d, p in leaves], np.uint64), sizes, np.cumsum(sizes) - sizes, flat, [(i == j, min(leaves[i][0], leaves[j][0])) for i, j in pairs]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, sizes, first, flat, _ = plan.value
        for batch in batches:
            for part in (batch.slice(at, 1 << 14) for at in range(0, batch.num_rows, 1 << 14)):
                fp, ids = part.column("fp").to_numpy(), part.column("id")
                leaf = np.searchsorted(starts, fp.view(np.uint64), side="right") - 1
                row = np.repeat(np.arange(len(fp)), sizes[leaf])
                k = np.arange(len(row)) - np.repeat(np.cumsum(sizes[leaf]) - sizes[leaf], sizes[leaf]) + first[leaf][row]
                yield pa.RecordBatch.from_arrays([pa.array(flat[k, 0]), pa.array(flat[k, 1].astype(np.int8)), pa.array(fp[row]), ids.take(pa.array(row))], names=["task", "side", "fp", "id"])

    def join(group: pa.Table) -> pa.Table:
        own, depth = plan.value[4][group.column("task")[0].as_py()]
        fp, ids, side = group.column("fp").to_numpy().view(np.uint64), group.column("id").to_numpy(), group.column("side").to_numpy()
        order = np.argsort(fp, kind="stable")
        left, right = order[side[order] == 0], order[side[order] == 1]
        x, y = near_pairs(fp[left], None if own else fp[right], budget, depth)
        return pa.table({"a": ids[left][x], "b": ids[left if own else right][y]})

    dealt = classes.mapInArrow(deal, "task long, side byte, fp long, id long")
    return dealt.groupBy("task").applyInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 2, leaf_size: int | None = None) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``.

    component_id is the smallest doc_id that links of at most ``budget`` bits reach.
    Null and empty texts and texts without words have fingerprint 0 and are linked like
    any other; a text with fewer words than a shingle is one shingle.  The nodes are
    fingerprints: rows that repeat a doc_id with other fingerprints are not linked by
    that, and rows with a null doc_id link others; their component_id is null only if
    nothing else is reached.  An empty table gives an empty result; other columns are
    ignored.
    """
    marked = shared_table(fingerprints(docs, words), "simhash-fingerprints")
    classes = shared_table(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    found = connected_components(links(classes.select("fp", F.col("fp").alias("id")), budget, leaf_size), "simhash-links")
    named = shared_table(classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "simhash-named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
