"""Packing documents into training sequences: vector bin packing.

A bin has three limits: tokens, segments and loss-bearing tokens.  In instruction data the
prompt bears no loss, so the three are independent; a document without a prompt bears
loss on all but a piece's first token.  The open bin
takes the waiting piece that fits and whose demand has the largest dot product with
what is left of the bin.  A gap that nothing fits is closed by cutting a piece, so a
bin is full; the last tokens of a partition become sequences at powers of two.

Scale: one narrow pass; each task packs its own rows with a pool of waiting pieces
of bounded size.  No shuffle; what a task holds does not grow with its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import byte_bpe

LENGTH, SEGMENTS = 2048, 128
END = 1  # the id after a document
POOL = 1024  # pieces that wait, at most
FIELDS = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Piece:
    """Ids of a document from ``start`` on; ``total`` ids and ``prompt`` leading ones without
    loss in the whole document."""

    __slots__ = ("doc_id", "ids", "start", "total", "prompt")

    def __init__(self, doc_id, ids: np.ndarray, start: int, total: int, prompt: int):
        self.doc_id, self.ids, self.start, self.total, self.prompt = doc_id, ids, start, total, prompt

    def free(self) -> int:
        """Leading ids that bear no loss here: the prompt's rest; the first in any case."""
        return max(1, min(len(self.ids), self.prompt - self.start))

    def loss(self) -> int:
        return len(self.ids) - self.free()

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.ids[:n], self.start, self.total, self.prompt), Piece(self.doc_id, self.ids[n:], self.start + n, self.total, self.prompt)


class Packer:
    """Packs documents in the order given; ``out`` gets the placed pieces."""

    def __init__(self, length: int, segments: int, loss: int, first_id: int):
        self.limits, self.next_id, self.out = np.array([length, segments, loss], float), first_id, []
        self.waiting: list[Piece] = []

    def add(self, doc_id, ids: np.ndarray, prompt: int = 0) -> None:
        """A document's ids; what fills whole bins by itself is placed at once."""
        full = int(self.limits[0])
        rest = Piece(doc_id, ids, 0, len(ids), prompt)
        while len(rest.ids) >= full:
            head, tail = rest.split(full)
            if head.loss() > self.limits[2]:
                break
            self._emit([head])
            rest = tail
        if len(rest.ids):
            rest.ids = rest.ids.copy()  # a long document does not wait for its tail
            self.waiting.append(rest)

    def _emit(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            self.out.append((p.doc_id, p.start, len(p.ids), p.ids.astype("<u4").tobytes(), p.total, self.next_id, offset, p.loss()))
            offset += len(p.ids)
        self.next_id += 1

    def pack(self, down_to: int) -> None:
        """Fill bins until at most ``down_to`` pieces wait."""
        need = np.array([(len(p.ids), 1, p.loss()) for p in self.waiting], float).reshape(-1, 3)
        open_ = np.ones(len(need), bool)
        while open_.sum() > down_to:
            left, pieces = self.limits.copy(), []
            while left[0] > 0 and left[1] > 0 and open_.any():
                fits = open_ & (need <= left).all(axis=1)
                if fits.any():
                    gain = (need / self.limits) @ (left / self.limits)
                    i = int(np.argmax(np.where(fits, gain, -np.inf)))
                    n = int(need[i, 0])
                else:  # nothing fits: cut the piece that leaves the most
                    i = int(np.argmax(np.where(open_, need[:, 0], -np.inf)))
                    n = int(min(left[0], left[2] + self.waiting[i].free(), need[i, 0]))
                head, tail = self.waiting[i].split(n)
                pieces.append(head)
                left -= (n, 1, head.loss())
                if len(tail.ids):
                    self.waiting[i] = tail
                    need[i] = (len(tail.ids), 1, tail.loss())
                else:
                    open_[i] = False
            self._close(pieces)
        self.waiting = [p for p, x in zip(self.waiting, open_) if x]

    def _close(self, pieces: list[Piece]) -> None:
        """Emit one bin; a bin that is not full becomes bins at powers of two."""
        total = sum(len(p.ids) for p in pieces)
        while total:
            room = int(self.limits[0]) if total == self.limits[0] else 1 << (total.bit_length() - 1)
            total -= room
            now = []
            while room:
                head = pieces.pop(0)
                if len(head.ids) > room:
                    head, tail = head.split(room)
                    pieces.insert(0, tail)
                now.append(head)
                room -= len(head.ids)
            self._emit(now)


def pack(docs: DataFrame, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None, encoder: Callable[[], Callable[[str], np.ndarray]] = byte_bpe, end: int = END, prompt_chars: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian uint32),
    doc_tokens, sequence_id, offset, loss_tokens.

    Each document's ids and one ``end`` lie in exactly one piece each.  A null or
    empty text is the end alone.  A piece's first id bears no loss, nor do the ids of a
    text's first ``prompt_chars`` characters (the name of a column; null counts as 0).  The
    ids are those of the public tokenizer's file.  Sequence ids are
    unique, and the same in a task that is run again.  Repeated rows are packed each;
    an empty table gives an empty result; other columns are ignored.
    """
    if min(length, segments) < 1 or (loss is not None and loss < 1):
        raise ValueError("limits must be positive")
    limit = length if loss is None else loss
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        packer = Packer(length, segments, limit, TaskContext.get().partitionId() << 36)

        def flush() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)] if rows else [pa.array([], t.type) for t in schema], schema=schema)

        for batch in batches:
            for doc_id, text, chars in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("prompt").to_pylist()):
                text = text.as_py()
                packer.add(doc_id, np.append(encode(text), np.uint32(end)), len(encode(text[:chars])) if chars > 0 else 0)
                if len(packer.waiting) >= POOL:
                    packer.pack(POOL // 2)
                if len(packer.out) >= 2048:
                    yield flush()
        packer.pack(0)
        yield flush()

    prompt = F.lit(0) if prompt_chars is None else F.coalesce(docs[prompt_chars].cast("int"), F.lit(0))
    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), prompt.alias("prompt"))
    return named.mapInArrow(run, FIELDS)


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with a CRC in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
