"""Toxicity: a learned lexicon, matched through Levenshtein automata.

The lexicon (terms far likelier in toxic than in other labelled documents) is a trie;
a word's Levenshtein automaton, run along the trie, finds the terms within one edit
(two for terms of nine letters or more), so misspelled terms count.  Each hit is
weighed by its context window: quotation marks and reporting words speak for
quotation, second-person words for abuse.  A logistic model over these sums scores.

Scale: the fit uses at most ``sample`` labelled rows (a parameter); scoring is one
narrow pass.  What is broadcast is the lexicon (all words that the sampled rows prove)
and the weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, id_fold, shared_table

SAMPLE = 20_000  # labelled rows for the fit, at most
FLOOR, LEVEL = 4, 1e-3  # a term's least toxic documents; the chance of its counts under the base rate
WINDOW = 8  # words on each side that make a hit's context
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—"
QUOTES = re.compile("[\"“”„«»]")
REPORTING = frozenset("said says say called calls wrote writes quoted quote term word phrase known means slur reported claims claimed dit écrit sagte schrieb dijo escribió".split())
DIRECTED = frozenset("you your yours youre you're u ur yourself tu toi vous du dich dir sie ihr tú usted ustedes".split())
#: Distinct words remembered as clean by a task, before it starts anew.
REMEMBER = 200_000
BAND = 2  # the most edits of a term
FAR = np.int8(BAND + 1)
#: Words that walk the trie together.
BLOCK = 50_000
#: Letters of a lexicon term.
LEAST, MOST = 3, 40


def edits(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class Lexicon:
    """A trie of terms and the words that its Levenshtein automata accept.

    A state of the automaton after a path of the trie is the band of distances between
    that path and the word's prefixes that are at most BAND letters shorter or longer.
    All words walk the trie together; a node keeps the words whose band still allows
    as many edits as some term below it has.
    """

    def __init__(self, terms: list[str]):
        self.terms = sorted(set(terms))
        index: dict[str, int] = {"": 0}
        for term in self.terms:
            for n in range(1, len(term) + 1):
                index.setdefault(term[:n], len(index))
        self.children: list[list[int]] = [[] for _ in index]
        self.char, self.term, self.allowed = [0] * len(index), [-1] * len(index), [0] * len(index)
        for path, node in index.items():
            if path:
                self.char[node] = ord(path[-1])
                self.children[index[path[:-1]]].append(node)
        for i, term in enumerate(self.terms):
            self.term[index[term]] = i
            for n in range(len(term) + 1):
                node = index[term[:n]]
                self.allowed[node] = max(self.allowed[node], edits(term))
        # A word within d edits holds one of d + 1 parts of the term unchanged: first, last or inner.
        self.first, self.last, inner = set(), set(), []
        for term in self.terms:
            n = edits(term) + 1
            cuts = [len(term) * i // n for i in range(n + 1)]
            parts = [term[a:b] for a, b in zip(cuts, cuts[1:])]
            self.first.add(parts[0])
            self.last.add(parts[-1])
            inner += parts[1:-1]
        self.heads, self.tails = sorted({len(x) for x in self.first}), sorted({len(x) for x in self.last})
        self.inner = re.compile("|".join(map(re.escape, sorted(set(inner)))) or r"(?!)")
        self.least, self.most = min(map(len, self.terms), default=0) - BAND, max(map(len, self.terms), default=0) + BAND

    def _possible(self, word: str) -> bool:
        return self.least <= len(word) <= self.most and (any(word[:n] in self.first for n in self.heads) or any(word[-n:] in self.last for n in self.tails) or self.inner.search(word) is not None)

    def near(self, words: list[str]) -> dict[str, tuple[str, int]]:
        """The closest term (its text decides ties) and its distance, of the words that have one."""
        found: dict[str, tuple[str, int]] = {}
        words = [w for w in words if self._possible(w)]
        for at in range(0, len(words), BLOCK):
            part = words[at : at + BLOCK]
            best, distance = self._walk(part)
            for i in np.flatnonzero(best < len(self.terms)).tolist():
                found[part[i]] = (self.terms[best[i]], int(distance[i]))
        return found

    def _walk(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words], np.int64)
        width = int(size.max(initial=1))
        deepest = self.most + BAND + 1
        letters = np.zeros((len(words), max(width, deepest) + 2 * BAND + 1), np.uint32)  # word[j] is at column j + BAND
        letters[:, BAND : BAND + width] = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
        best, distance = np.full(len(words), len(self.terms), np.int64), np.full(len(words), FAR, np.int64)
        # the band's row k holds the distance to the word's first (depth + k - BAND) letters
        start = np.full((2 * BAND + 1, len(words)), FAR, np.int8)
        for k in range(BAND + 1):
            start[BAND + k] = np.where(size >= k, k, FAR)
        todo = [(0, 0, np.arange(len(words)), start)]
        while todo:
            node, depth, own, band = todo.pop()
            term = self.term[node]
            if term >= 0:
                k = size[own] - depth + BAND
                inside = np.flatnonzero((k >= 0) & (k <= 2 * BAND))
                d = band[k[inside], inside].astype(np.int64)
                who = own[inside]
                better = (d <= edits(self.terms[term])) & ((d < distance[who]) | ((d == distance[who]) & (term < best[who])))
                best[who[better]], distance[who[better]] = term, d[better]
            for child in self.children[node]:
                new = np.full_like(band, FAR)
                for k in range(2 * BAND + 1):
                    j = depth + 1 + k - BAND  # letters of the word's prefix
                    if j < 0:
                        continue
                    cell = band[k + 1] + np.int8(1) if k < 2 * BAND else np.full(len(own), FAR, np.int8)
                    if j:
                        cell = np.minimum(cell, band[k] + (letters[own, j - 1 + BAND] != self.char[child]))
                        if k:
                            cell = np.minimum(cell, new[k - 1] + np.int8(1))
                    new[k] = np.where(size[own] >= j, np.minimum(cell, FAR), FAR)
                live = np.flatnonzero(new.min(axis=0) <= self.allowed[child])
                if len(live):
                    todo.append((child, depth + 1, own[live], new[:, live]))
        return best, distance


N_FEATURES = 8


class Scorer:
    def __init__(self, terms: dict[str, float]):
        """terms: each with its weight, the log odds of its labelled documents."""
        self.terms, self.lexicon, self.clean, self.hits = terms, Lexicon(list(terms)), set(), {}

    def _look_up(self, words: set[str]) -> None:
        """Sorts words that are not known yet into ``hits`` and ``clean``."""
        if len(self.clean) > REMEMBER:
            self.clean.clear()
        if len(self.hits) > REMEMBER:
            self.hits.clear()
        new = [w for w in words if w not in self.clean and w not in self.hits]
        bare = [w.strip(EDGE).lower() for w in new]
        near = self.lexicon.near(list(set(bare)))
        for w, b in zip(new, bare):
            if b in near:
                self.hits[w] = near[b]
            else:
                self.clean.add(w)

    def all_features(self, texts: list[str]) -> np.ndarray:
        """A row of features for each text; so many texts look words up together that
        they have BLOCK words, about."""
        out, waiting, words = [], [], set()
        for text in [*texts, None]:
            if text is not None:
                waiting.append(text)
                words.update(text.split())
            if waiting and (text is None or len(words) > BLOCK):
                self._look_up(words)
                out += [self.features(t) for t in waiting]
                waiting, words = [], set()
        return np.array(out, dtype=float).reshape(-1, N_FEATURES)

    def features(self, text: str) -> list[float]:
        """Of a text whose words are looked up."""
        words = text.split()
        found = self.hits
        exact = fuzzy = quoted = directed = 0.0
        kinds, inside, seen = set(), 0, 0
        at = [i for i, w in enumerate(words) if w in found]
        if not at:
            return [0.0] * N_FEATURES
        for i in at:
            inside += sum(len(QUOTES.findall(w)) for w in words[seen:i])
            seen = i
            window = {w.strip(EDGE).lower() for w in words[max(0, i - WINDOW) : i + WINDOW + 1]}
            cited = inside % 2 == 1 or bool(QUOTES.match(words[i])) or bool(window & REPORTING)
            aimed = bool(window & DIRECTED)
            term, distance = found[words[i]]
            kinds.add(term)
            exact += distance == 0
            fuzzy += distance > 0
            quoted += cited
            directed += aimed and not cited
        n = len(at)
        plain = n - quoted
        return [1.0 if exact else 0.0, math.log1p(exact), math.log1p(fuzzy), math.log1p(len(kinds)), math.log1p(plain + directed), math.log1p(quoted), 100.0 * min(n / len(words), 0.1), max(self.terms[t] for t in kinds)]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic weights (the last is the constant) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
    return w


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def _independent(rows: DataFrame, words: set[str]) -> list[str]:
    """Those words that FLOOR unrelated contexts in toxic texts hold.

    Near copies of one document repeat a word among the same neighbours.  A word stays
    if FLOOR contexts (with the commonest) share neither neighbour with its commonest
    one, or if its contexts of two words on each side are worth FLOOR equally
    frequent ones.
    """

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter()
            for text in batch.column("text").to_pylist():
                w = ["", "", *(x.strip(EDGE).lower() for x in text.split()), "", ""]
                seen.update((w[i], w[i - 1], w[i + 1], w[i - 2], w[i + 2]) for i in range(2, len(w) - 2) if w[i] in words)
            yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in seen], pa.string()) for i in range(5)), pa.array(list(seen.values()), pa.int64())], names=["word", "before", "after", "before2", "after2", "n"])

    found = rows.filter("toxic = 1").mapInArrow(contexts, "word string, before string, after string, before2 string, after2 string, n long")
    found = shared_table(found.groupBy("word", "before", "after", "before2", "after2").agg(F.sum("n").alias("n")), "toxicity-contexts")
    worth = found.groupBy("word").agg((F.pow(F.sum("n"), 2) / F.sum(F.col("n") * F.col("n"))).alias("worth"))
    pairs = found.groupBy("word", "before", "after").agg(F.sum("n").alias("n"))
    common = pairs.groupBy("word").agg(F.max_by(F.struct("before", "after"), F.struct("n", "before", "after")).alias("common"))
    apart = pairs.join(common, "word").groupBy("word").agg(F.count_if((F.col("before") != F.col("common.before")) & (F.col("after") != F.col("common.after"))).alias("apart"))
    return [r["word"] for r in apart.join(worth, "word").filter((F.col("apart") + 1 >= FLOOR) | (F.col("worth") >= FLOOR)).select("word").collect()]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon and the weights, from rows outside the held-out fold.

    Labelled rows beyond ``sample`` are left out by the order of a hash of their id.
    Of contradicting labels the worse counts.  A term is known by its own documents, so
    the share of the corpus that its language has does not matter.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.filter((id_fold(5) != 0) & F.col("toxic").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = shared_table(id_and_text(docs).join(F.broadcast(chosen), "doc_id"), "toxicity-sample")  # at most `sample` rows are broadcast

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                counts[toxic == 1].update({w.strip(EDGE).lower() for w in text.split()})
        words = sorted(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], names=["word", "toxic", "other"])
        rest = sorted(counts[0].keys() - counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([counts[0][w] for w in rest], pa.int64())], names=["word", "toxic", "other"])

    single = shared_table(rows.select("text", "toxic").distinct(), "toxicity-texts")  # copies of a text prove nothing more
    n = {bool(r["toxic"]): r["n"] for r in single.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = n.get(True, 0), n.get(False, 0)
    if not pos:
        return {}, np.append(np.zeros(N_FEATURES), -5.0)
    table = single.mapInArrow(count, "word string, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (pos + 1.0)) - F.log((F.col("other") + 0.5) / (neg + 1.0))
    n_in, rate = F.col("toxic") + F.col("other"), pos / max(pos + neg, 1)
    # how unlikely so many toxic ones of a term's documents are at the base rate (Chernoff)
    chance = -F.col("toxic") * F.log(F.col("toxic") / n_in / rate) - F.when(F.col("other") > 0, F.col("other") * F.log(F.col("other") / n_in / max(1 - rate, 1e-9))).otherwise(0.0)
    picked = table.filter(F.length("word").between(LEAST, MOST) & (F.col("toxic") >= FLOOR) & (odds > math.log(20.0)) & (chance < math.log(LEVEL)))
    likely = {r["word"]: r["odds"] for r in picked.select("word", odds.alias("odds")).collect()}  # words of FLOOR of the sampled rows, at least
    lexicon = {w: likely[w] for w in sorted(_independent(single, set(likely)))}
    width = N_FEATURES

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(scorer.all_features(batch.column("text").to_pylist()).tolist(), pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    got = rows.select("text", "toxic").mapInArrow(measure, "x array<double>, toxic int").toPandas()  # at most `sample` rows of 8 numbers
    return lexicon, fit(np.array(got["x"].tolist(), dtype=float).reshape(-1, width), (got["toxic"] == 1).to_numpy(float))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts have no hits and get the score of a text without hits.  With
    no toxic training label there is no lexicon and every score is low.  Repeated
    rows are scored each; an empty table gives an empty result; other columns are
    ignored.
    """
    lexicon, weights = train(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            score = probability(scorer.all_features(batch.column("text").to_pylist()), weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (id_fold(5) == 0).alias("held_out"), "score", "predicted")
