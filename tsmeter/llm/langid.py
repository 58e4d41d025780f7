"""Language identification with bit-sliced Bloom filters of letter trigrams.

Each language is one bit.  A filter slot is a mask of languages, so that slice ``l``
of the slots is the Bloom filter of language ``l``; the AND of a trigram's slots
gives all languages that hold it at once.  A document's set bits are counted for
each language, corrected for that slice's false-positive rate, and the largest
corrected share decides.

Scale: languages are learned from at most ``per_language`` rows each (a parameter);
trigrams are counted inside tasks and summed by Spark; the filter has at least twelve
slots for each trigram learned, so its false-positive rate does not grow.  Prediction is one narrow pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, id_fold

PER_LANGUAGE = 5_000  # training rows of a language, about
HASHES = 3
BLOCK = 1 << 20  # code points handled at once


_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """True at the code points that are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Codes of all trigrams of lower-case letters and word ends, block by block."""
    text = f" {text.lower()} "
    for at in range(0, len(text), BLOCK):
        cp = np.frombuffer(text[at : at + BLOCK + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        word = letters()[cp]
        c = np.where(word, cp, 32).astype(np.uint64)
        if len(c) < 3:
            continue
        keep = word[1:-1] | (word[:-2] & word[2:])
        yield (c[:-2] | (c[1:-1] << np.uint64(21)) | (c[2:] << np.uint64(42)))[keep]


def slots_of(codes: np.ndarray, size: int) -> list[np.ndarray]:
    """HASHES slots (``size`` is a power of two) of every code."""
    h = codes * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    mask, step = np.uint64(size - 1), (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & mask).astype(np.int64) for i in range(HASHES)]


class Filters:
    """The slots: a row of 64-language masks for each."""

    def __init__(self, languages: list[str], codes: np.ndarray, owners: np.ndarray):
        """owners: the language's index of each code (codes repeat)."""
        self.languages = languages
        planes = (len(languages) + 63) // 64
        distinct = len(np.unique(codes))
        size = 1 << max(10, int(np.ceil(np.log2(max(distinct, 1) * 12))))
        self.masks = np.zeros((max(planes, 1), size), np.uint64)
        for slot in slots_of(codes, size):
            for plane in range(planes):
                own = owners // 64 == plane
                np.bitwise_or.at(self.masks[plane], slot[own], np.uint64(1) << (owners[own] % 64).astype(np.uint64))
        ones = np.array([((self.masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
        self.false = ones**HASHES

    def predict(self, text: str) -> tuple[str, float]:
        """The language and its share of the corrected counts; ties: the first by name."""
        total, counts = 0, np.zeros(len(self.languages))
        for codes in trigrams(text):
            total += len(codes)
            slots = slots_of(codes, self.masks.shape[1])
            for plane, masks in enumerate(self.masks):
                held = masks[slots[0]]
                for s in slots[1:]:
                    held &= masks[s]
                for i in range(plane * 64, min(len(self.languages), plane * 64 + 64)):
                    counts[i] += np.count_nonzero(held & (np.uint64(1) << np.uint64(i % 64)))
        if not total or not self.languages:
            return "und", 0.0
        share = np.maximum((counts / total - self.false) / (1 - np.minimum(self.false, 0.999)), 0.0)
        best = int(np.argmax(share))
        return self.languages[best], float(share[best] / share.sum()) if share.sum() > 0 else 0.0


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Filters:
    """Filters from rows with a language outside the held-out fold."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang")).filter(id_fold(4) != 2).filter("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    # the share of a language's rows whose id hash falls below per_language / rows
    part = sizes.select("lang", (F.lit(float(per_language)) / F.col("rows")).alias("share"))
    languages = sorted(r["lang"] for r in part.select("lang").collect())  # the labels that can be predicted
    if not languages:
        return Filters([], np.zeros(0, np.uint64), np.zeros(0, np.int64))
    chosen = rows.join(part, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                got = [np.unique(g, return_counts=True) for i in np.flatnonzero(langs == lang) for g in trigrams(texts[i])]
                if not got:
                    continue
                codes, where = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
                n = np.bincount(where, np.concatenate([g[1] for g in got])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    grams = chosen.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = grams.join(totals, "lang").select("lang", "code", "n", (F.col("n") / F.col("total")).alias("rate"))
    tops = rates.groupBy("code").agg(F.max("rate").alias("top"))
    # a language holds a trigram that is at least half as frequent there as anywhere
    held = rates.join(tops, "code").filter("n >= 2 and rate >= 0.5 * top").select("lang", "code", "n")
    got = held.select("lang", "code").toPandas()  # trigrams of per_language rows of each language
    where = {lang: i for i, lang in enumerate(languages)}
    return Filters(languages, got["code"].to_numpy(np.int64).astype(np.uint64), got["lang"].map(where).to_numpy(np.int64) if len(got) else np.zeros(0, np.int64))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    ``und`` with score 0 for a text that is null or has no letter, and for every text
    when there is no training row.  Repeated rows are judged each; an empty table
    gives an empty result; other columns are ignored.
    """
    filters = docs.sparkSession.sparkContext.broadcast(train(docs, per_language))  # twelve to 24 slots for each trigram learned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [filters.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (id_fold(4) == 2).alias("held_out"), "lang_pred", "score")
