"""A quality classifier by compression.

Two zstandard dictionaries are built from pieces of labelled texts, one of good and one
of bad ones.  A text is compressed piece by piece with either; the difference of the two sizes
for each byte of text says which dictionary knows it better.  A logistic curve over
that difference and the size without a dictionary (which shows repetition) turns it into
a calibrated score; its weights come from labelled texts that are in no dictionary.

Scale: the fit uses at most ``sample`` labelled rows and ``pieces`` pieces of a class (both
parameters); scoring is one narrow pass over whole texts.  What is broadcast is two
dictionaries of ``DICTIONARY`` bytes and five numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, id_fold, shared_table
from .toxicity import fit, probability

#: Labelled rows for the fit, and pieces of a dictionary's class, at most.
SAMPLE, PIECES = 20_000, 16_384
#: Bytes of a piece and of a dictionary; zstandard's level.
PIECE, DICTIONARY, LEVEL = 1024, 1 << 17, 3
#: Added to a text's bytes, so that a few bytes prove little.
FLOOR = 16


def pieces_of(text: str) -> list[bytes]:
    """All of the text, at least one piece."""
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[at : at + PIECE] for at in range(0, max(1, len(raw)), PIECE)]


def dictionary(pieces: list[bytes]) -> bytes:
    """The stretches that the pieces share most; of too few pieces to tell, the pieces themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICTIONARY]


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    center: np.ndarray
    width: np.ndarray
    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return probability((x - self.center) / self.width, self.weights)


class Sizes:
    """Measures texts with two dictionaries and with none."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)]
        for d in (good, bad):
            kept = zstandard.ZstdCompressionDict(d)
            kept.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_dict_id=False))

    def features(self, texts: list[str]) -> np.ndarray:
        """For each byte: the size with the good dictionary less that with the bad one, and that with none."""
        out = np.zeros((len(texts), 2))
        for i, text in enumerate(texts):
            cut = pieces_of(text)
            none, good, bad = (sum(len(c.compress(p)) for p in cut) for c in self.by)
            n = sum(map(len, cut)) + FLOOR
            out[i] = (good - bad) / n, none / n
        return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pieces: int = PIECES) -> Model | float:
    """The model, or the score of every text if one of the classes has no text.

    Rows of the held-out fold take no part.  Labelled rows beyond ``sample`` are left out by
    the order of a hash of their id, pieces beyond ``pieces`` by a hash of the piece.  Of
    contradicting labels the worse counts.  A hash of the text decides whether it is in a
    dictionary or in the calibration, so copies are on one side.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.filter((id_fold(5) != 0) & F.col("quality").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = id_and_text(docs).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows are broadcast
    rows = shared_table(rows.groupBy("text").agg((F.min("quality") == 1).alias("good")).withColumn("side", F.pmod(F.xxhash64("text"), F.lit(2))), "compress-texts")
    n = {r["good"]: r["n"] for r in rows.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    flat = (n.get(True, 0) + 1) / (sum(n.values()) + 2)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, good in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist()):
                own = pieces_of(text)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([good] * len(own))], names=["piece", "good"])

    made = rows.filter("side = 0 and text <> ''").mapInArrow(cut, "piece binary, good boolean").distinct()
    kept = {good: [bytes(r["piece"]) for r in made.filter(F.col("good") == good).orderBy(F.xxhash64("piece"), "piece").limit(pieces).collect()] for good in (True, False)}  # `pieces` KB of each class
    if not all(kept.values()):
        return flat
    held = tuple(dictionary(kept[good]) for good in (True, False))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(*held)
        for batch in batches:
            x = sizes.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("good")], names=["x", "z", "good"])

    got = rows.filter("side = 1").select("text", "good").mapInArrow(measure, "x double, z double, good boolean").toPandas()  # at most `sample` rows
    x, y = got[["x", "z"]].to_numpy(float).reshape(-1, 2), got["good"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return flat
    order = np.lexsort((y, *x.T))  # one order of the sums, however the rows came
    x, y = x[order], y[order]
    center, width = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    return Model(*held, center, width, fit((x - center) / width, y))


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3, sample: int = SAMPLE, pieces: int = PIECES) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``cutoff`` on) for every row of ``docs``.

    Null and empty texts are one empty piece and get its score.  If one of the classes has no
    training text, every score is the (smoothed) share of good ones.  Repeated rows are
    scored each; an empty table gives an empty result; other columns are ignored.
    """
    model = train(docs, labels, sample, pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad) if isinstance(model, Model) else None
        for batch in batches:
            score = model.scores(sizes.features(batch.column("text").to_pylist())) if sizes else np.full(batch.num_rows, model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= cutoff).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (id_fold(5) == 0).alias("held_out"), "score", "predicted")
