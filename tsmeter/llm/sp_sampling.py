"""SentencePiece encoding and decoding, with segmentations sampled without replacement.

A text's segmentations form a lattice whose paths have a probability (pieces weigh by
the rank the model's file gives them).  A* over Gumbel-perturbed log-probabilities
emits the k paths with the largest perturbed values: k distinct segmentations, drawn
without replacement.  A region of the search is a path's prefix with the next pieces
that were not taken; its perturbed maximum is a Gumbel truncated at its parent's,
so regions are opened only when they win.  Inclusion scores follow from the best value
that was left over.

No piece continues over the start of a white-space run, so the lattice is a chain of
word lattices; equal words share one.  All words of a batch are walked in lockstep.
Randomness depends on the seed, the row's key, the sample, the word and the step, not
on batches or partitions.

Scale: one narrow pass over whole texts; what a task holds is a batch.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame

from .common import id_and_text

SAMPLES, SEED = 3, 11
SPACE = "▁"
BATCH_CHARS = 1_000_000  # characters of the texts that are walked together, about
HASH_BITS = 19
FIRST = 128  # steps of a path whose regions are opened at first
#: Stands for a U+2581 of the text itself while spaces are written so: no text holds it.
OWN_SPACE = "\ud800"

#: -ln of a uniform number lies between exp(-REACH) and REACH, so that a region's value
#: lies between mu - ln(exp(mu - top) + REACH) and mu + REACH.
REACH = 37.5

_units = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_u = np.uint64


def units_of(text: str) -> list[str]:
    """The words of a text with the spaces before them, its first space included; spaces at the end are one."""
    text = text.replace(SPACE, OWN_SPACE)
    if not text or "  " in text or text[0] == " " or text[-1] == " ":
        return _units.findall(SPACE + text.replace(" ", SPACE)) if text else []
    return (SPACE + text.replace(" ", " " + SPACE)).split(" ")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


def uniforms(seed: np.ndarray, counter: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1), the same for the same seed, counter and stream."""
    x = _mix(seed.astype(np.uint64) + counter.astype(np.uint64) * _u(0x9E3779B97F4A7C15) + _u(stream * 0x632BE59BD9B4E019 % 2**64))
    return ((x >> _u(12)).astype(np.float64) + 0.5) / 2.0**52


class Pieces:
    """The model's pieces as a trie, their weights, and bytes for unknown characters."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = [b""] * sp.get_piece_size()
        self.byte_ids = [0] * 256
        normal = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and SPACE not in piece.lstrip(SPACE):
                self.bytes[i] = piece.replace(SPACE, " ").encode()
                normal.append((i, piece))
        self.byte_sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.flat_bytes = np.frombuffer(b"".join(self.bytes), np.uint8)
        total = math.log(sum(1 / (rank + 10) for rank in range(len(normal))))
        self.byte_weight = -math.log(len(normal) + 10) - total
        nodes: dict[str, int] = {"": 0}
        for _, piece in normal:
            for n in range(1, len(piece) + 1):
                nodes.setdefault(piece[:n], len(nodes))
        #: The trie: node << 21 | character of each step, in order, and the node it leads to.
        steps = sorted(((nodes[x[:-1]] << 21) | ord(x[-1]), nodes[x]) for x in nodes if x)
        self.step, self.child = (np.array(c, np.int64) for c in zip(*steps))
        #: The steps once more by a hash; where several share a slot, the sorted ones decide.
        slot = self._slot(self.step)
        self.slot_step, self.slot_child = np.full(1 << HASH_BITS, -1, np.int64), np.full(1 << HASH_BITS, -1, np.int64)
        self.slot_step[slot], self.slot_child[slot] = self.step, self.child
        self.shared = np.bincount(slot, minlength=1 << HASH_BITS) > 1
        self.piece, self.weight = np.full(len(nodes), -1, np.int64), np.zeros(len(nodes))
        for rank, (i, piece) in enumerate(normal):  # a piece weighs its rank's share under Zipf's law
            self.piece[nodes[piece]], self.weight[nodes[piece]] = i, -math.log(rank + 10) - total
        self.known, self.from_root = np.zeros(0x110000, bool), np.full(0x110000, -1, np.int32)  # by character
        for x, node in nodes.items():
            if len(x) == 1:
                self.from_root[ord(x)], self.known[ord(x)] = node, self.piece[node] >= 0

    @staticmethod
    def _slot(step: np.ndarray) -> np.ndarray:
        return ((step.astype(np.uint64) * _u(0x9E3779B97F4A7C15)) >> _u(64 - HASH_BITS)).astype(np.int64)

    def follow(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes that characters lead to; -1 where there is none."""
        step = (node << 21) | char
        slot = self._slot(step)
        out = np.where(self.slot_step[slot] == step, self.slot_child[slot], -1)
        open_ = np.flatnonzero((out < 0) & self.shared[slot])
        k = np.minimum(np.searchsorted(self.step, step[open_]), len(self.step) - 1)
        out[open_] = np.where(self.step[k] == step[open_], self.child[k], -1)
        return out

    def text_bytes(self, ids: np.ndarray) -> bytes:
        """What ``decode`` gives, as bytes."""
        n = self.byte_sizes[ids]
        return self.flat_bytes[np.repeat(self.byte_starts[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes()[1:]

    def decode(self, ids) -> str:
        """The text of ids; its first space is the one that encoding put there."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


@functools.lru_cache(maxsize=2)
def pieces_of(path: str | None) -> Pieces:
    return Pieces(path or public_tokenizers.path("piece_bpe_32k.model"))


class Walk:
    """The word lattices of a batch, as arrays over states (word, position) and edges.

    Edges are found by running all positions of all words along the trie together; then
    the weight behind each position is summed from the words' ends, all words together.
    """

    def __init__(self, words: list[str], pieces: Pieces):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]  # state of a word's start
        n_states = int((lengths + 1).sum())
        char = np.zeros(n_states, np.int64)  # the character after each state; 0 at ends
        inner = np.ones(n_states, bool)
        inner[self.first + lengths] = False
        char[inner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        start = np.flatnonzero(inner)
        at, node, origin = start.copy(), np.zeros(len(start), np.int64), start
        source, target, weight, piece = [], [], [], []
        while len(at):
            if not source:
                node = pieces.from_root[char[at]].astype(np.int64)
            else:
                node = pieces.follow(node, char[at])
            going = node >= 0
            at, node, origin = at[going] + 1, node[going], origin[going]
            ends = pieces.piece[node] >= 0
            source.append(origin[ends])
            target.append(at[ends])
            weight.append(pieces.weight[node[ends]])
            piece.append(pieces.piece[node[ends]])
        lone = start[~pieces.known[char[start]]]  # characters that become bytes
        raw = [(SPACE if chr(c) == OWN_SPACE else chr(c)).encode("utf-8", "surrogatepass") for c in char[lone].tolist()]
        for x, own in ((source, lone), (target, lone + 1), (weight, np.array([pieces.byte_weight * len(b) for b in raw], float)), (piece, -1 - lone)):
            x.insert(0, own)
        # a state's edges stand together, the longest pieces, which are the likeliest, first: each round of
        # the walk has one edge of a state at most, so places are counted without a sort
        self.degree = np.zeros(n_states, np.int64)
        for x in source:
            self.degree[x] += 1
        self.edge = np.cumsum(self.degree) - self.degree
        free = self.edge.copy()
        n_edges = int(self.degree.sum())
        self.source, self.target, sorted_weight, sorted_piece = np.zeros(n_edges, np.int64), np.zeros(n_edges, np.int64), np.zeros(n_edges), np.zeros(n_edges, np.int64)
        for x, y, w, p in zip(reversed(source), reversed(target), reversed(weight), reversed(piece)):
            to = free[x]
            self.source[to], self.target[to], sorted_weight[to], sorted_piece[to] = x, y, w, p
            free[x] += 1
        weight, piece = sorted_weight, sorted_piece
        behind = np.zeros(n_states)
        left = np.repeat(lengths, lengths + 1) - (np.arange(n_states) - np.repeat(self.first, lengths + 1))  # to the word's end
        most = int(lengths.max(initial=0))
        of_edge = left[self.source].astype(np.uint16 if most < 1 << 16 else np.int64)
        by_left = np.argsort(of_edge, kind="stable")
        bounds = np.searchsorted(of_edge[by_left], np.arange(1, most + 2))
        for lo, hi in zip(bounds, bounds[1:]):
            own = by_left[lo:hi]
            if len(own):
                of = self.source[own]
                heads = np.append(0, np.flatnonzero(of[1:] != of[:-1]) + 1)
                behind[of[heads]] = np.logaddexp.reduceat(weight[own] + behind[self.target[own]], heads)
        self.logp = np.minimum(weight + behind[self.target] - behind[self.source], 0.0)
        total = np.cumsum(np.exp(self.logp))
        base = np.concatenate(([0.0], total))[self.edge[self.source]]
        self.key = self.source + np.clip(total - base, 1e-12, 1.0)  # sorted: states ascend, and so do sums in a state
        last = self.edge[inner] + self.degree[inner] - 1
        self.key[last] = self.source[last] + 1.0
        many = dict(zip((-1 - lone).tolist(), raw))
        self.n_ids = np.ones(len(piece), np.int64)
        unknown = np.flatnonzero(piece < 0)
        self.n_ids[unknown] = [len(many[x]) for x in piece[unknown].tolist()]
        self.id_at = np.cumsum(self.n_ids) - self.n_ids
        self.ids = np.repeat(piece.astype(np.int32), self.n_ids)
        for e in unknown.tolist():
            self.ids[self.id_at[e] : self.id_at[e] + self.n_ids[e]] = [pieces.byte_ids[b] for b in many[int(piece[e])]]

    def pick(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge at which the sums of a state's probabilities pass ``u``."""
        edge = self.edge[state]
        live = np.flatnonzero((self.degree[state] > 1) & (self.key[edge] < state + u))
        want, last = (state + u)[live], (edge + self.degree[state] - 1)[live]
        while len(live):
            edge[live] += 1
            more = (self.key[edge[live]] < want) & (edge[live] < last)
            live, want, last = live[more], want[more], last[more]
        return edge

    def run(self, state: np.ndarray, seed: np.ndarray, counter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Random paths from states to their words' ends: (which, edge) in path order.

        ``counter``: a number of each start under its seed; steps count on from it.
        """
        which, edges = [], []
        live = np.flatnonzero(self.degree[state] > 0)
        state = state.copy()
        step = 0
        while len(live):
            edge = self.pick(state[live], uniforms(seed[live], counter[live] + step, 1))
            which.append(live)
            edges.append(edge)
            state[live] = self.target[edge]
            live = live[self.degree[state[live]] > 0]
            step += 1
        if not which:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which, edges = np.concatenate(which), np.concatenate(edges)
        order = np.argsort(which, kind="stable")
        return which[order], edges[order]

    def path_ids(self, edges: np.ndarray) -> np.ndarray:
        n = self.n_ids[edges]
        if len(n) == n.sum():  # no character stands as several bytes
            return self.ids[self.id_at[edges]]
        return self.ids[np.repeat(self.id_at[edges] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def truncated(mu: np.ndarray, top: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """Gumbel maxima with location ``mu`` that do not exceed ``top``."""
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(np.isneginf(mu), -np.inf, mu - np.log(np.exp(np.minimum(mu - top, 700.0)) - np.log(u)))


def _rest(logp: np.ndarray) -> np.ndarray:
    """ln(1 - exp(logp))."""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(np.minimum(logp, 0.0)))


class Path:
    """A path emitted, and the regions that branch off it at ``first`` and later steps."""

    __slots__ = ("edges", "words", "first", "before", "region", "taken", "value")

    def __init__(self, edges, words, first, before, region, value):
        self.edges, self.words, self.first, self.before, self.region, self.value = edges, words, first, before, region, value
        self.taken: dict[int, list[int]] = {}  # at a step: the edges that paths took besides this one's


def sample_batch(texts: list[str], seeds: np.ndarray, k: int, pieces: Pieces) -> list[tuple[list[tuple[np.ndarray, float, float]], float]]:
    """For each text: up to k (ids, log-probability, perturbed value), best first, and
    the best perturbed value that was left."""
    units = [units_of(t) for t in texts]
    sizes = np.array([len(u) for u in units], np.int64)
    index: defaultdict[str, int] = defaultdict(count().__next__)  # words are numbered as they come
    occurrence = np.fromiter(map(index.__getitem__, chain.from_iterable(units)), np.int64, int(sizes.sum()))
    walk = Walk(list(index), pieces)
    begin = np.cumsum(sizes) - sizes
    start = walk.first[occurrence] if len(occurrence) else occurrence
    root = -np.log(-np.log(uniforms(seeds, np.zeros(len(texts), np.int64), 2)))
    paths: list[list[Path]] = [[] for _ in texts]
    left = np.full(len(texts), -np.inf)

    def extend(which: list[int], heads: list[tuple[Path, int, int] | None], tops: np.ndarray, number: int) -> None:
        """Complete paths: from the start, or from a region (path, step, new edge)."""
        states, docs, words = [], [], []
        for d, head in zip(which, heads):
            first = 0
            if head is not None:
                path, step, edge = head
                first = int(path.words[step]) + 1
                states.append(walk.target[[edge]])
                words.append(np.array([first - 1]))
                docs.append(np.array([d]))
            states.append(start[begin[d] + first : begin[d] + sizes[d]])
            words.append(np.arange(first, sizes[d]))
            docs.append(np.full(sizes[d] - first, d))
        states, docs, words = (np.concatenate(x).astype(np.int64) for x in (states, docs, words))
        seed = _mix(seeds[docs] + _u(number)) if len(docs) else seeds[:0]
        at, edges = walk.run(states, seed, (words + 1) << 24)
        of_doc, of_word = docs[at], words[at]
        place = np.zeros(len(texts), np.int64)
        place[which] = np.arange(len(which))
        per = np.bincount(place[of_doc], minlength=len(which))
        ends = np.cumsum(per)
        made: list[tuple[np.ndarray, np.ndarray]] = []
        for i, head in enumerate(heads):
            own = slice(ends[i] - per[i], ends[i])
            e, w = edges[own], of_word[own]
            if head is not None:
                path, step, edge = head
                e = np.concatenate((path.edges[:step], [edge], e))
                w = np.concatenate((path.words[: step + 1], w))
            made.append((e, w))
        # regions of the steps before ``first`` belong to the path it left
        first = np.array([0 if head is None else head[1] + 1 for head in heads], np.int64)
        so_far = np.array([0.0 if head is None else head[0].before[head[1] - head[0].first] + walk.logp[head[2]] for head in heads])
        long = np.array([len(e) for e, _ in made], np.int64)
        todo, n = np.arange(len(made)), FIRST
        while len(todo):  # all texts together; regions beyond n can't be among the best: see REACH
            n_of = np.maximum(np.minimum(long[todo] - first[todo], n), 0)
            wide = max(int(n_of.max(initial=0)), 1)
            some = np.arange(wide)[None, :] < n_of[:, None]
            e = np.zeros(some.shape, np.int64)
            e[some] = np.concatenate([made[i][0][first[i] : first[i] + m] for i, m in zip(todo, n_of)])
            logs = np.where(some, walk.logp[e] if len(walk.logp) else 0.0, 0.0)
            before = so_far[todo][:, None] + np.cumsum(logs, axis=1) - logs
            mu = np.where(some & (walk.degree[walk.source[e]] > 1), before + _rest(logs), -np.inf) if len(walk.logp) else np.full(some.shape, -np.inf)
            top = tops[todo][:, None]
            with np.errstate(over="ignore"):
                sure = mu - np.log(np.exp(np.minimum(mu - top, 700.0)) + REACH)
            kth = np.partition(sure, -1 - k, axis=1)[:, -1 - k] if wide > k else np.full(len(todo), -np.inf)
            done = (first[todo] + n_of >= long[todo]) | (before[:, -1] + REACH < kth)
            steps = first[todo][:, None] + np.arange(wide)[None, :]
            region = truncated(mu, top, uniforms(np.broadcast_to(seeds[which][todo][:, None], mu.shape), steps, 16 + number))
            for row in np.flatnonzero(done):
                i, m = todo[row], n_of[row]
                paths[which[i]].append(Path(*made[i], int(first[i]), before[row, :m], region[row, :m], float(tops[i])))
            todo, n = todo[~done], n * 4

    which = np.arange(len(texts))
    extend(which, [None] * len(texts), root, 0)
    for number in range(1, k + 1):
        which, heads, tops, steps = [], [], [], []
        for d in range(len(texts)):
            if len(paths[d]) < number:
                continue
            best, i = max(((float(p.region.max()), i) for i, p in enumerate(paths[d]) if len(p.region)), default=(-np.inf, 0))
            left[d] = best
            if number == k or best == -np.inf:
                continue
            path = paths[d][i]
            which.append(d)
            heads.append(path)
            tops.append(best)
            steps.append(int(np.argmax(path.region)))
        if not which:
            continue
        which, tops, at = np.array(which), np.array(tops), np.array(steps)
        absolute = at + np.array([p.first for p in heads])
        choice = uniforms(seeds[which], absolute, 1000 + number)
        again = uniforms(seeds[which], absolute, 2000 + number)
        mus, branches = np.full(len(which), -np.inf), []
        for i, (path, step) in enumerate(zip(heads, absolute.tolist())):
            state = int(walk.source[path.edges[step]])
            low, n = int(walk.edge[state]), int(walk.degree[state])
            p = np.exp(walk.logp[low : low + n])
            gone = [int(path.edges[step]), *path.taken.get(step, [])]
            for edge in gone:
                p[edge - low] = 0.0
            sums = np.cumsum(p)
            edge = low + min(int(np.searchsorted(sums, choice[i] * sums[-1], side="right")), n - 1)
            if edge in gone:
                edge = low + int(np.argmax(p))
            path.taken.setdefault(step, []).append(edge)
            rest = float(sums[-1] - p[edge - low]) if len(gone) + 1 < n else 0.0
            if rest > 1e-300:
                mus[i] = path.before[at[i]] + math.log(rest)
            branches.append((path, step, edge))
        values = truncated(mus, tops, again)
        for path, step, value in zip(heads, at, values):
            path.region[step] = value
        extend(which, branches, tops, number)
    return [([(walk.path_ids(p.edges), float(walk.logp[p.edges].sum()), p.value) for p in paths[d]], float(left[d])) for d in range(len(texts))]


def row_seeds(doc_ids: list, seed: int) -> np.ndarray:
    """A seed for each row, from its key alone."""
    keys = np.array([xxhash.xxh64_intdigest(str(d)) for d in doc_ids], np.uint64)
    return _mix(keys + _u(seed * 0x9E3779B97F4A7C15 % 2**64))


def encode_samples(docs: DataFrame, k: int = SAMPLES, seed: int = SEED, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """Rows of doc_id, sample (1 is the best perturbed value), n_pieces, ids_crc32,
    log_prob, perturbed, log_inclusion, round_trip, and ids if asked for.

    A text with fewer than k segmentations gives them all, with inclusion 1 (log 0).
    Null and empty texts have one segmentation, the empty one.  Texts are taken as they
    are: characters unknown to the model become bytes, and decoding gives the text
    back (round_trip).  Repeated rows have the same samples; an empty table gives an
    empty result; other columns are ignored.
    """
    fields = [("doc_id", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("round_trip", pa.bool_())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def work(ids: list, texts: list[str], pieces: Pieces) -> pa.RecordBatch:
        out = []
        for doc_id, text, (found, left) in zip(ids, texts, sample_batch(texts, row_seeds(ids, seed), k, pieces)):
            raw = text.encode("utf-8", "surrogatepass")
            for number, (got, logp, value) in enumerate(found, 1):
                inclusion = 0.0 if left == -np.inf else logp - left if logp - left < -30 else math.log(-math.expm1(-math.exp(min(logp - left, 700.0))))
                out.append((doc_id, number, len(got), zlib.crc32(got.astype("<i4").tobytes()), logp, value, inclusion, pieces.text_bytes(got) == raw, got)[: len(schema)])
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids.append(doc_id)
                texts.append(text.as_py())
                held += len(texts[-1])
                if held >= BATCH_CHARS or len(ids) >= 2000:
                    yield work(ids, texts, pieces)
                    ids, texts, held = [], [], 0
        if ids:
            yield work(ids, texts, pieces)

    ddl = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, round_trip boolean" + ", ids array<int>" * with_ids
    return id_and_text(docs).mapInArrow(run, ddl)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, sample and the text of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sample"), pa.array([pieces.decode(x) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "sample", "text"])

    return encoded.select("doc_id", "sample", "ids").mapInArrow(run, "doc_id long, sample int, text string")


def encode_best(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and the ids of the model's own segmentation of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path("piece_bpe_32k.model"))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sp.encode(batch.column("text").to_pylist(), num_threads=1), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")
