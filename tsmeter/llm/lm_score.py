"""Language-model scoring: word unigrams as the base, causal self-attention as the model.

The model reads subword ids; every word is encoded by itself.  One attention head with a
bias for each distance looks back over a window; the state predicts a class of
subwords, and the corpus's counts give the subword within its class, so that the
probability of a text is proper: P(id | before) = P(class | before) * P(id | class).  The
frequent subwords are classes of their own; the others are clustered by what stands
before them.  A word's probability is the product over its subwords, mixed with its share
of the corpus.  Windows overlap, and each token is scored once, in the later half of its
window (batched, masked).

Learning.  Windows cut the ids of every training row from end to end, so that each token of the
corpus is learned from.  Only the starting point comes from ``start_windows`` of them (a parameter);
then ``ROUNDS`` rounds follow, each with windows of its own, which together are all windows.  They
are dealt into shards by their own hashes, each shard goes on from the common weights in the order
of these hashes, and Spark averages what the shards changed.  So neither files nor partitions
decide what is learned.

Scale: word counts, class statistics and weight changes are summed by Spark's aggregates;
the driver sees IDS rows of numbers, the starting windows and a histogram of word counts.
Words at least as frequent as a threshold (``top_words`` of them at most, a parameter) are
broadcast; counts of all others reach the texts through a shuffle join, where they
count just as the frequent ones do.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _remove, id_and_text, id_fold, parts, shared_path, shared_table
from .tokens import SPECIAL, byte_bpe, token_bytes

TOP_WORDS = 1 << 17
START_WINDOWS = 60_000  # windows that the weights start from, at most
IDS, END = 50257, SPECIAL["<|endoftext|>"]
WIDTH, WINDOW, STRIDE = 32, 32, 16
CLASSES, CLUSTERS = 256, 64  # all classes; those that hold several subwords
STEPS, BATCH = 1500, 48
ROWS = 384  # rows of class probabilities at once: they fit a core's cache
EVEN = 3  # strides are laid out in multiples of so many: fewer tokens are rounded by their place (1 % of them, else 2.5 %, by 1e-6 at most)
ROUNDS = 2  # each window is in one of them
SHARD = 1 << 15  # windows of a shard, about
EXACT = 2.0**30  # what is summed is rounded to its inverse, so that sums are the same in any order
ATTENTION = 0.85  # the attention model's share of a word's probability
#: Counts of a task are handed on when it holds so many different words.
HELD = 500_000
PART = 1 << 21  # bytes of text whose windows are held at once, about
END_WORD = "\n"  # stands for the end token: no word holds a newline


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # A-Z and the six ASCII spaces only


@functools.lru_cache(maxsize=1)
def _ranks_encoder():
    return byte_bpe()


@functools.lru_cache(maxsize=1)
def _starts() -> np.ndarray:
    """True for ids that begin with a space, and for the end."""
    return np.array([i == END or token_bytes(i)[:1] == b" " for i in range(IDS)])


def ids_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, each encoded by itself after a space, and where each word begins.

    Encoding all of them at once gives the same, but where white space that is not
    ASCII stands in a word; whether it does is told by the number of beginnings.
    """
    encode = _ranks_encoder()
    ids = encode(" " + b" ".join(words).decode("utf-8", "surrogatepass")).astype(np.int32) if words else np.zeros(0, np.int32)
    at = np.flatnonzero(_starts()[ids])
    if len(at) != len(words):
        each = [encode(" " + w.decode("utf-8", "surrogatepass")).astype(np.int32) for w in words]
        ids = np.concatenate(each)
        at = np.cumsum([0, *map(len, each[:-1])])
    return ids, at


# -- the model ---------------------------------------------------------------------------------


_before = np.round(np.random.default_rng(3).standard_normal((IDS, WIDTH)) * 1024) / 1024  # sums are exact


def classes_of(counts: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The class of each id: frequent ids alone, the others clustered by the ids before.

    seen: for each id the sum of the random vectors of the ids before it.
    """
    order = np.argsort(-counts, kind="stable")
    out = np.zeros(IDS, np.int32)
    alone = CLASSES - CLUSTERS
    out[order[:alone]] = np.arange(CLUSTERS, CLASSES)
    rest = order[alone:]
    x = seen[rest].astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    centre = x[:CLUSTERS].copy()
    own = np.zeros(len(x), np.int64)
    for _ in range(12):
        own = np.argmax(x @ centre.T, axis=1)
        for c in range(CLUSTERS):
            members = x[own == c]
            if len(members):
                centre[c] = members.sum(0) / max(float(np.linalg.norm(members.sum(0))), 1e-6)
    out[rest] = np.where(np.abs(x).sum(1) > 0, own, np.arange(len(rest)) % CLUSTERS)
    return out


def start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    return {"e": (0.3 * rng.standard_normal((IDS, WIDTH))).astype(np.float32), "q": normal(WIDTH, WIDTH), "k": normal(WIDTH, WIDTH), "v": normal(WIDTH, WIDTH), "r": normal(WIDTH, WIDTH), "o": normal(WIDTH, CLASSES), "b": np.zeros(CLASSES, np.float32), "d": np.zeros(WINDOW, np.float32)}


_far = np.clip(np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :], 0, WINDOW - 1)
_causal = np.arange(WINDOW)[:, None] >= np.arange(WINDOW)[None, :]


def _projections(w: dict[str, np.ndarray]) -> np.ndarray:
    """The four projections side by side, the queries' with its scale: one product gives all."""
    return np.concatenate((w["q"] * w["q"].dtype.type(1 / np.sqrt(WIDTH)), w["k"], w["v"], w["r"]), axis=1)


def _longest(m: np.ndarray) -> float:
    return float(np.sqrt(np.einsum("ij,ij->i", m, m).max()))


def _factors(w: dict[str, np.ndarray]) -> tuple[bool, np.ndarray, np.ndarray]:
    """Whether exp of the classes' logits can't overflow; if so, factors exp(b) that go with the
    classes instead of a sum over every logit, and their logarithms (else 1 and 0)."""
    small = float((np.abs(w["o"]).sum(0) + np.abs(w["b"])).max()) < 60 and float(np.abs(w["b"]).max()) < 20
    logs = w["b"] if small else np.zeros_like(w["b"])
    return small, np.exp(logs), logs


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Mean loss and gradients for windows ``x`` of ids and their next classes ``y``, and
    the ids whose vectors the gradient of ``e`` holds.

    times: how often each window counts (once, if not given), as if it stood there as often.
    Classes are reckoned in blocks of rows that fit the cache, and scaled by row and class
    only where a product has made them small.
    """
    n, flat_x, flat_y = y.size, x.reshape(-1), y.reshape(-1)
    at = flat_x.astype(np.uint16).argsort(kind="stable")
    ordered = flat_x.take(at)
    first = np.append(0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1)
    e = w["e"].take(flat_x, axis=0)
    wide = lambda m: m.reshape(*x.shape, -1)
    every = _projections(w)
    m = e @ every
    q, k, v, r = (m[:, i : i + WIDTH] for i in range(0, 4 * WIDTH, WIDTH))
    far = _longest(q) * _longest(k) + float(np.abs(w["d"]).max()) >= 60  # else exp can't overflow
    q, k, v = wide(q), wide(k), wide(v)
    a = q @ k.transpose(0, 2, 1)
    a += np.where(_causal, w["d"][_far], e.dtype.type(-1e9))
    if far:
        a -= a.max(-1, keepdims=True)
    np.exp(a, out=a)
    a /= wide(a.reshape(n, -1) @ np.ones(WINDOW, e.dtype))
    h = (a @ v).reshape(n, -1)
    h += r
    np.tanh(h, out=h)
    share = np.full(n, 1 / n, e.dtype) if times is None else np.repeat((times / (times.sum() * x.shape[1])).astype(e.dtype), x.shape[1])
    small, factor, log_factor = _factors(w)
    back = np.ascontiguousarray(w["o"].T) * factor[:, None]
    loss, go, gb, dt = 0.0, np.zeros((CLASSES, WIDTH), e.dtype), np.zeros(CLASSES, e.dtype), np.empty_like(h)
    held = np.empty((ROWS, CLASSES), e.dtype)
    for lo in range(0, n, ROWS):
        own_h, own_y, own_share = h[lo : lo + ROWS], flat_y[lo : lo + ROWS], share[lo : lo + ROWS]
        p = np.matmul(own_h, w["o"], out=held[: len(own_h)])
        if not small:
            p += w["b"]
            p -= p.max(-1, keepdims=True)
        own = np.arange(len(p)), own_y
        chosen = p[own]
        np.exp(p, out=p)
        sums = p @ factor
        loss += float((np.log(sums) - chosen - log_factor.take(own_y)) @ own_share)
        p[own] = np.exp(chosen) - sums / factor.take(own_y)
        part = own_share / sums
        np.matmul(p, back, out=dt[lo : lo + ROWS])
        dt[lo : lo + ROWS] *= part[:, None]
        go += p.T @ (own_h * part[:, None])
        gb += part @ p
    g = {"o": (go * factor[:, None]).T, "b": gb * factor}
    h *= h
    np.subtract(1, h, out=h)
    dm = np.empty_like(m)
    dq, dk, dv, dr = (wide(dm)[:, :, i : i + WIDTH] for i in range(0, 4 * WIDTH, WIDTH))
    np.multiply(dt, h, out=dm[:, 3 * WIDTH :])
    da = dr @ v.transpose(0, 2, 1)
    da -= np.einsum("nij,nij->ni", da, a)[:, :, None]
    da *= a
    g["d"] = np.bincount(_far[_causal], da.sum(0)[_causal], minlength=WINDOW).astype(e.dtype)
    np.matmul(da, k, out=dq)
    np.matmul(da.transpose(0, 2, 1), q, out=dk)  # q has the scale
    np.matmul(a.transpose(0, 2, 1), dr, out=dv)
    own = dm.T @ e
    for i, name in enumerate("qkvr"):
        g[name] = own[i * WIDTH : (i + 1) * WIDTH].T
    g["q"] = g["q"] * e.dtype.type(1 / np.sqrt(WIDTH))
    g["e"] = np.add.reduceat((dm @ every.T).take(at, axis=0), first)
    return loss, g, ordered[first]


class Trainer:
    """Adam over batches of windows; of the subword vectors only those in the batch move."""

    def __init__(self, w: dict[str, np.ndarray], of: np.ndarray):
        """The vectors ``w["e"]`` move in place, the other weights in a copy (``self.w``)."""
        self.of, self.step = of, 0
        self.rest = [n for n in sorted(w) if n != "e"]
        flat = np.concatenate([w[n].reshape(-1) for n in self.rest])
        ends = np.cumsum([w[n].size for n in self.rest])[:-1]
        self.w = {"e": w["e"], **{n: x.reshape(w[n].shape) for n, x in zip(self.rest, np.split(flat, ends))}}  # views
        self.moved = [(x, np.zeros_like(x), np.zeros_like(x)) for x in (w["e"], flat)]

    def learn(self, windows: np.ndarray, rate: float, times: np.ndarray | None = None) -> None:
        """windows: rows of WINDOW + 1 ids; times: how often each counts."""
        self.step += 1
        _, g, ids = gradients(self.w, windows[:, :-1], self.of.take(windows[:, 1:]), times)
        scale = np.float32(rate / (1 - 0.9**self.step)), np.float32(1 - 0.99**self.step)
        rest = np.concatenate([g[n].reshape(-1) for n in self.rest])
        for (w, firsts, seconds), at, own in zip(self.moved, (ids, slice(None)), (g["e"], rest)):
            first, second = firsts[at], seconds[at]
            first += np.float32(0.1) * (own - first)
            second += np.float32(0.01) * (own * own - second)
            firsts[at], seconds[at] = first, second
            w[at] -= scale[0] * first / (np.sqrt(second / scale[1]) + np.float32(1e-8))


def fit(windows: np.ndarray, of: np.ndarray, steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights to start from, by ``steps`` random batches of ``windows``."""
    rng = np.random.default_rng(seed)
    trainer = Trainer(start_weights(rng), of)
    for step in range(1, steps + 1):
        trainer.learn(windows[rng.integers(0, len(windows), BATCH)], 0.01 * min(1.0, step / 20) * (1 - 0.9 * step / steps))
    return trainer.w


class Scorer:
    """Sums of log10 P(id | before) for texts, by overlapping windows."""

    def __init__(self, w: dict[str, np.ndarray], of: np.ndarray, inside: np.ndarray):
        """inside: log10 P(id | its class)."""
        self.every = w["e"] @ _projections(w)  # of each id, made once, so that they don't depend on its place
        self.o, self.b, self.of, self.inside = w["o"], w["b"], of, inside
        longest = [_longest(self.every[:, i : i + WIDTH]) for i in (0, WIDTH)]
        self.far = longest[0] * longest[1] + float(np.abs(w["d"]).max()) >= 60  # else exp can't overflow
        self.small, self.factor, self.log_factor = _factors(w)
        rows, cols = np.arange(WINDOW - STRIDE, WINDOW)[:, None], np.arange(WINDOW)[None, :]
        self.bias = np.where(rows >= cols, w["d"][np.clip(rows - cols, 0, WINDOW - 1)], np.float32(-1e9)).astype(np.float32)

    def token_logs(self, texts: list[np.ndarray], block: int = 120) -> np.ndarray:
        """log10 P(id | before) of every token of the texts, one after the other.

        Texts are laid out from the start of a stride each, so that the windows of a block
        overlap in memory: each id's projections are made once, and nothing is copied for them.
        """
        if not texts:
            return np.zeros(0)
        sizes = np.array([len(t) for t in texts], np.int64)
        y = np.concatenate(texts)
        windows = -(-sizes // STRIDE)
        begin, total = np.cumsum(windows) - windows, -(-int(windows.sum()) // EVEN) * EVEN
        place = np.arange(len(y)) + np.repeat(STRIDE * begin - (np.cumsum(sizes) - sizes), sizes)
        target = np.full(total * STRIDE, END, np.int32)
        target[place] = y
        x = np.full((total + 1) * STRIDE, END, np.int32)  # what stands before each, after one empty stride
        x[STRIDE + 1 :] = target[:-1]
        x[STRIDE * (begin + 1)] = END
        opens = np.zeros(total, bool)
        opens[begin] = True
        of = self.of.take(target)
        out = np.empty(len(target), np.float32)
        held = np.empty((ROWS, CLASSES), np.float32)
        for lo in range(0, total, block):
            n = min(block, total - lo)
            m = self.every.take(x[lo * STRIDE : (lo + n + 1) * STRIDE], axis=0)
            q, k, v, r = (m[:, i : i + WIDTH] for i in range(0, 4 * WIDTH, WIDTH))
            k, v = (np.lib.stride_tricks.as_strided(z, (n, WINDOW, WIDTH), (STRIDE * m.strides[0], *m.strides), writeable=False) for z in (k, v))
            s = q[STRIDE:].reshape(n, STRIDE, WIDTH) @ k.transpose(0, 2, 1)
            s += self.bias
            s[opens[lo : lo + n], :, : WINDOW - STRIDE] = -1e9  # another text
            if self.far:
                s -= s.max(-1, keepdims=True)
            np.exp(s, out=s)
            h = (s @ v).reshape(-1, WIDTH)
            h /= (s.reshape(-1, WINDOW) @ np.ones(WINDOW, s.dtype))[:, None]
            h += r[STRIDE:]
            np.tanh(h, out=h)
            for a in range(0, len(h), ROWS):
                z = np.matmul(h[a : a + ROWS], self.o, out=held[: len(h) - a])
                if not self.small:
                    z += self.b
                    z -= z.max(-1, keepdims=True)
                at = slice(lo * STRIDE + a, lo * STRIDE + a + len(z))
                chosen = z[np.arange(len(z)), of[at]]
                np.exp(z, out=z)
                out[at] = chosen + self.log_factor.take(of[at]) - np.log(z @ self.factor)
        return out[place] / np.log(10) + self.inside[y]


# -- the corpus ---------------------------------------------------------------------------------


def count_words(docs: DataFrame) -> DataFrame:
    """word, n (in training rows), everywhere (in all rows); the end is a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            held, train = counts
            keys = list(train.keys() | held.keys())
            batch = pa.RecordBatch.from_arrays([pa.array([k if isinstance(k, str) else k.decode("utf-8", "replace") for k in keys], pa.string()), pa.array([train[k] for k in keys], pa.int64()), pa.array([train[k] + held[k] for k in keys], pa.int64())], names=["word", "n", "everywhere"])
            held.clear()
            train.clear()
            return batch

        for batch in batches:
            for text, train in zip(batch.column("text"), batch.column("train").to_pylist()):
                counts[train].update(words_of(text.as_py()))
                counts[train][END_WORD] += 1
                if len(counts[0]) + len(counts[1]) > HELD:
                    yield flush()
        yield flush()

    marked = id_and_text(docs).select("text", (id_fold(10) != 0).alias("train"))
    return marked.mapInArrow(run, "word string, n long, everywhere long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("everywhere").alias("everywhere"))


def count_subwords(words: DataFrame) -> np.ndarray:
    """Training counts of each subword id, from the counted words (not the texts again)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(IDS, np.int64)
        for whole in batches:
            for batch in (whole.slice(a, 4096) for a in range(0, whole.num_rows, 4096)):
                n = batch.column("n").to_numpy()
                words = [w.encode("utf-8", "surrogatepass") for w in batch.column("word").to_pylist()]
                end = np.array([w == END_WORD.encode() for w in words], bool)
                counts[END] += n[end].sum()
                ids, at = ids_of([w for w, x in zip(words, end) if not x])
                np.add.at(counts, ids, np.repeat(n[~end], np.diff(np.append(at, len(ids)))))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["id", "n"])

    out = np.zeros(IDS, np.int64)
    for r in words.select("word", "n").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().itertuples():  # at most IDS rows
        out[r.id] = r.n
    return out


def cut(ids: np.ndarray) -> np.ndarray:
    """Windows of WINDOW + 1 ids that hold each id of a text and the end behind it as a next
    id; the last window begins earlier, and a short text goes on from its start."""
    own = np.concatenate(([END], ids, [END])).astype("<u2")
    if len(own) <= WINDOW:
        return np.resize(own, (1, WINDOW + 1))
    at = np.append(np.arange(0, len(own) - 1 - WINDOW, WINDOW), len(own) - 1 - WINDOW)
    return own[at[:, None] + np.arange(WINDOW + 1)]


def windows_of(docs: DataFrame) -> DataFrame:
    """window (WINDOW + 1 ids as binary) and draw (a random number that the window and its place
    decide): all windows of every training row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (x for held in (whole.slice(a, 256) for a in range(0, whole.num_rows, 256)) for x in parts(held, PART)):
                made = [cut(ids_of(words_of(text.as_py()))[0]) for text in batch.column("text")]
                rows = [x.tobytes() for x in np.concatenate(made)]
                places = [k for x in made for k in range(len(x))]
                draws = [xxhash.xxh64_intdigest(x, k) >> 2 for x, k in zip(rows, places)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(draws, pa.int64())], names=["window", "draw"])

    return id_and_text(docs).filter(id_fold(10) != 0).select("text").mapInArrow(run, "window binary, draw long")


def _ids_of(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("window").to_pylist()), "<u2").reshape(-1, WINDOW + 1).astype(np.int64)


_COLUMNS = [f"v{i}" for i in range(WIDTH)]
_ROWS = "key int, " + ", ".join(f"{c} double" for c in _COLUMNS)


def _rows(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *(pa.array(np.ascontiguousarray(values[:, i], np.float64)) for i in range(WIDTH))], names=["key", *_COLUMNS])


def _summed(rows: DataFrame, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of each key, and how many they were; ``n_keys`` rows reach the driver."""
    got = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in _COLUMNS)).toPandas()
    out, n = np.zeros((n_keys, WIDTH)), np.zeros(n_keys)
    out[got["key"]], n[got["key"]] = got[_COLUMNS].to_numpy(), got["n"]
    return out, n


def seen_before(windows: DataFrame) -> np.ndarray:
    """For each id the sum of the random vectors of the ids before it, over all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((IDS, WIDTH))
        for batch in batches:
            if batch.num_rows:
                x = _ids_of(batch).astype(np.uint32)
                pairs = np.sort(((x[:, 1:] << 16) | x[:, :-1]).reshape(-1))
                at = np.flatnonzero(np.diff(pairs, prepend=~pairs[:1]))
                times = np.diff(at, append=len(pairs))
                then = pairs[at] >> 16
                first = np.flatnonzero(np.diff(then, prepend=~then[:1]))
                seen[then[first]] += np.add.reduceat(_before[pairs[at] & 0xFFFF] * times[:, None], first)
        some = np.flatnonzero(seen.any(axis=1))
        yield _rows(some, seen[some])

    return _summed(windows.select("window").mapInArrow(run, _ROWS), IDS)[0]


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    """All weights but the subword vectors, as rows of WIDTH numbers."""
    x = np.concatenate([w[n].reshape(-1) for n in sorted(w) if n != "e"])
    return np.resize(np.concatenate((x, np.zeros(-len(x) % WIDTH, x.dtype))), (-(-len(x) // WIDTH), WIDTH))


def of_round(windows: DataFrame, number: int) -> DataFrame:
    """The windows that round ``number`` learns from; each window is in one round."""
    return windows.filter(F.pmod("draw", F.lit(ROUNDS)) == number)


def batches_of(windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each BATCH windows in turn: the different ones, and how often each stands there (copies
    stand together, so they are reckoned once and count as often)."""
    new = np.append(True, (windows[1:] != windows[:-1]).any(axis=1))
    for at in range(0, len(windows), BATCH):
        own = new[at : at + BATCH].copy()
        own[0] = True
        first = np.flatnonzero(own)
        yield windows[at + first], np.diff(first, append=len(own))


def train_round(windows: DataFrame, w: dict[str, np.ndarray], of: np.ndarray, number: int, n_windows: int) -> dict[str, np.ndarray]:
    """``w`` after every shard has gone on from it with its own windows of this round: the
    mean of their changes (of a subword's vector: over the shards that moved it)."""
    common = windows.sparkSession.sparkContext.broadcast((w, of))  # IDS rows of WIDTH numbers, and few others
    n_flat = len(_flat(w))

    def run(group: pa.Table) -> pa.Table:
        start, of = common.value
        trainer = Trainer({n: x.copy() for n, x in start.items()}, of)
        x = _ids_of(group.sort_by([("draw", "ascending"), ("window", "ascending")]))
        for own, times in batches_of(x):
            trainer.learn(own, 0.003 / (1 + number), times)
        moved = np.flatnonzero((trainer.w["e"] != start["e"]).any(axis=1))
        changes = np.concatenate((trainer.w["e"][moved] - start["e"][moved], _flat(trainer.w) - _flat(start))).astype(float)
        return pa.Table.from_batches([_rows(np.append(moved, IDS + np.arange(n_flat)), np.round(changes * EXACT) / EXACT)])

    shards = max(1, round(n_windows / ROUNDS / SHARD))
    own = of_round(windows, number).withColumn("shard", F.pmod(F.xxhash64("draw"), F.lit(shards)))
    change, n = _summed(own.groupBy("shard").applyInArrow(run, _ROWS), IDS + n_flat)
    change /= np.maximum(n, 1)[:, None]
    out, at = {}, 0
    rest = change[IDS:].reshape(-1)
    for name in sorted(w):
        if name != "e":
            out[name] = (w[name] + rest[at : at + w[name].size].reshape(w[name].shape)).astype(np.float32)
            at += w[name].size
    out["e"] = (w["e"] + change[:IDS]).astype(np.float32)
    return out


def frequent_words(counts: DataFrame, top_words: int) -> dict[bytes, int]:
    """Training counts of all words at least as frequent as the least threshold (a power of
    two) that ``top_words`` words reach at most."""
    level = F.floor(F.log2(F.col("everywhere").cast("double"))).cast("int")
    levels = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 64 rows at most
    held, least = 0, 64
    for x in sorted(levels, reverse=True):
        held += levels[x]
        if held > top_words:
            break
        least = x
    return {r.word.encode(): int(r.n) for r in counts.filter(level >= least).select("word", "n").toPandas().itertuples()}


def score(docs: DataFrame, start_windows: int = START_WINDOWS, top_words: int = TOP_WORDS, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Null, empty and blank texts are the end token alone.  Repeated rows are scored
    each and each is counted.  With no training row every count is 0 and the weights
    stay as they start.  An empty table gives an empty result; other columns are
    ignored.
    """
    counts = shared_table(count_words(docs), "lm-words")
    total = counts.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n_train, vocabulary = int(total["n"] or 0), int(total["v"] or 0)
    norm = float(np.log10(n_train + 0.1 * (vocabulary + 1)))
    top = frequent_words(counts, top_words)

    each = count_subwords(counts)
    kept = shared_path(docs.sparkSession, "lm-windows")
    windows = windows_of(docs)
    windows.write.option("compression", "zstd").parquet(kept)
    windows = docs.sparkSession.read.schema(windows.schema).parquet(kept)
    of = classes_of(each, seen_before(windows))
    n_windows = windows.count()
    chosen = windows.filter(F.pmod(F.xxhash64("draw"), F.lit(1 << 30)) < int(min(1.0, 0.9 * start_windows / max(n_windows, 1)) * (1 << 30)))
    start = chosen.orderBy("draw", "window").limit(start_windows).select("window").toArrow()
    weights = fit(_ids_of(start), of, steps) if start.num_rows else fit(np.zeros((1, WINDOW + 1), np.int64), of, 0)
    if n_windows and steps:
        for number in range(ROUNDS):
            weights = train_round(windows, weights, of, number, n_windows)
    _remove(docs.sparkSession, kept)
    smooth = each + 0.1
    inside = np.log10(smooth / np.bincount(of, smooth, minlength=CLASSES)[of])
    model = docs.sparkSession.sparkContext.broadcast((top, weights, of, inside))  # top_words words, IDS rows of WIDTH numbers
    own = np.log10(ATTENTION)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, weights, of, inside = model.value
        scorer, index = Scorer(weights, of, inside), dict.fromkeys(top)
        for i, w in enumerate(top):
            index[w] = i
        number, counted = index.get, np.array([*top.values(), -1], np.int64)
        row, end = TaskContext.get().partitionId() << 36, END_WORD.encode()
        for whole in batches:
            for batch in (whole.slice(a, 256) for a in range(0, whole.num_rows, 256)):
                texts, ids, at, so_far = [], [], [], 0
                for text in batch.column("text"):
                    words = words_of(text.as_py())
                    got, begins = ids_of(words)
                    ids.append(np.append(got, np.int32(END)))
                    at.append(np.append(begins, len(got)) + so_far)
                    so_far += len(ids[-1])
                    words.append(end)
                    texts.append(words)
                sizes = np.array([len(t) for t in texts], np.int64)
                first = np.cumsum(sizes) - sizes
                held = counted[np.fromiter((number(w, -1) for t in texts for w in t), np.int64, int(sizes.sum()))]
                logs = np.add.reduceat(scorer.token_logs(ids), np.concatenate(at)) if len(texts) else np.zeros(0)
                is_rare = held < 0
                share = np.maximum(held, 0) / max(n_train, 1)
                with np.errstate(divide="ignore"):
                    mixed = np.where(is_rare, 0.0, np.logaddexp((logs + own) * np.log(10), np.log(share * (1 - ATTENTION))) / np.log(10))
                base = np.where(is_rare, 0.0, np.log10(np.maximum(held, 0) + 0.1) - norm)
                rare = np.flatnonzero(is_rare)
                doc_of = np.searchsorted(first, rare, side="right") - 1
                ends = np.searchsorted(doc_of, np.arange(len(texts) + 1))
                rare_words = pa.array([texts[d][i].decode("utf-8", "replace") for d, i in zip(doc_of.tolist(), (rare - first[doc_of]).tolist())], pa.string())
                lone = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([rare_words, pa.array(logs[rare])], names=["word", "log"]))
                names = ["row", "doc_id", "n_tokens", "top_known", "top_score", "rare", "top_log"]
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(batch.num_rows)), batch.column("doc_id"), pa.array(sizes), pa.array(np.add.reduceat(held > 0, first).astype(np.int64)), pa.array(np.add.reduceat(base, first)), lone, pa.array(np.add.reduceat(mixed, first))], names=names)
                row += batch.num_rows

    scored = shared_table(id_and_text(docs).mapInArrow(run, "row long, doc_id long, n_tokens long, top_known long, top_score double, rare array<struct<word: string, log: double>>, top_log double"), "lm-scored")
    seldom = scored.select("row", F.explode("rare").alias("rare")).select("row", "rare.word", "rare.log")
    n = F.coalesce(F.col("n"), F.lit(0))
    mixed = F.log10(F.pow(F.lit(10.0), F.col("log")) * ATTENTION + n / max(n_train, 1) * (1 - ATTENTION))
    mixed = F.when(n > 0, mixed).otherwise(F.col("log") + float(own))  # where 10 ** log may be too small
    rest = seldom.join(counts.select("word", "n"), "word", "left").groupBy("row").agg(F.sum(F.log10(n + 0.1) - norm).alias("rare_score"), F.count_if(n > 0).alias("rare_known"), F.sum(mixed).alias("rare_log"))
    whole = scored.drop("rare").join(rest, "row", "left")
    return whole.select(
        "doc_id",
        (id_fold(10) == 0).alias("held_out"),
        "n_tokens",
        (F.col("top_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("top_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
        (F.col("top_log") + F.coalesce("rare_log", F.lit(0.0))).alias("score"),
    )
