"""Training-order materialisation: token-id shards in a keyed random order.

Texts become token ids, cut into sequences of one length.  A keyed Feistel
permutation with cycle-walking gives every sequence a global slot in 0..n-1, without
a sort or a table.  A shard is a range of slots, written as one file of fixed stride,
so a reader finds slot s at byte (s mod shard) * stride, reads on sequentially, and can
resume anywhere.

Scale: a first pass counts each partition's sequences (only those counts reach the
driver); a second makes them again and sends each to its shard once.  A shard has
bounded size, whatever the corpus's.  Files appear whole: a task writes under a name of
its own attempt and renames it, so tasks may be run again.
"""

from __future__ import annotations

import contextlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, shared_path
from .tokens import SPECIAL, byte_bpe

LENGTH = 1024  # ids of a sequence; two bytes each
SHARD = 8192  # sequences of a shard
ROUNDS = 4
MANIFEST = "manifest.json"
END = SPECIAL["<|endoftext|>"]


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot in 0..n-1 of each index in 0..n-1: a bijection that ``key`` decides."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def feistel(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for i in range(ROUNDS):
            left, right = right, left ^ (_mix(right, (key * 0x100000001B3 + i * 0x9E3779B1) & (2**64 - 1)) & mask)
        return (left << np.uint64(half)) | right

    out = feistel(np.asarray(index, np.uint64))
    while (far := out >= np.uint64(n)).any():  # the domain is at most four times n
        out[far] = feistel(out[far])
    return out.astype(np.int64)


def _sequences(batches: Iterator[pa.RecordBatch], length: int, encode: Callable[[str], np.ndarray]) -> Iterator[tuple[np.ndarray, int, list]]:
    """(ids padded with the end, ids that count, doc ids) of a partition's rows in order."""
    parts: list[np.ndarray] = []
    docs: list = []
    held = 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = np.append(encode(text.as_py()), np.uint32(END)).astype("<u2")
            while len(ids):
                take = ids[: length - held]
                parts.append(take)
                docs.append(doc_id)
                held += len(take)
                ids = ids[len(take) :]
                if held == length:
                    yield np.concatenate(parts), length, docs
                    parts, docs, held = [], [], 0
    if held:
        yield np.concatenate([*parts, np.full(length - held, END, "<u2")]), held, docs


def materialise(docs: DataFrame, path: str | None = None, key: int = 20_24, length: int = LENGTH, shard: int = SHARD, encoder: Callable[[], Callable[[str], np.ndarray]] = byte_bpe) -> DataFrame:
    """Writes a manifest and, when it is run, the shards under ``path`` (default: the shared
    folder), and returns a row for each sequence: slot, sequence, shard, byte_offset, n_tokens,
    ids_crc32, doc_ids.

    Every id of every text, and an end after each, lies in exactly one sequence; only the
    last sequence of a partition is padded.  Null and empty texts are the end alone.
    ``docs`` must give the same rows in the same partitions each time it is read (as
    files and tables do); a partition that changes between the passes fails the job.
    Repeated rows are written each; an empty table writes nothing; other columns are
    ignored.
    """
    spark = docs.sparkSession
    target = path or shared_path(spark, "token-shards")
    rows = id_and_text(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total = encoder(), 0
        for batch in batches:
            total += sum(len(encode(t.as_py())) + 1 for t in batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([-(-total // length)])], names=["part", "n"])

    counted = sorted((r.part, r.n) for r in rows.mapInArrow(count, "part long, n long").collect())  # a row for each partition
    offsets, n = {}, 0
    for part, k in counted:
        offsets[part] = (n, k)
        n += k

    fs, root = pyarrow.fs.FileSystem.from_uri(target)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
        f.write(json.dumps({"sequences": n, "length": length, "shard": shard, "key": key, "dtype": "<u2", "end": END}).encode())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, expected = offsets[TaskContext.get().partitionId()]
        made = 0
        waiting: list = []

        def flush() -> pa.RecordBatch:
            index = np.arange(first + made - len(waiting), first + made)
            slot = permute(index, n, key)
            return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(index), pa.array([x[0].tobytes() for x in waiting], pa.binary()), pa.array([x[1] for x in waiting], pa.int64()), pa.array([x[2] for x in waiting], pa.list_(pa.int64()))], names=["slot", "sequence", "ids", "n_tokens", "doc_ids"])

        for x in _sequences(batches, length, encoder()):
            waiting.append(x)
            made += 1
            if made > expected:
                break
            if len(waiting) == 1024:
                yield flush()
                waiting = []
        if made != expected:
            raise ValueError("the rows of a partition changed between the two passes; write the input to a table first")
        if waiting:
            yield flush()

    def write(group: pa.Table) -> pa.Table:
        group = group.sort_by("slot")
        slots = group.column("slot").to_numpy()
        number = int(slots[0]) // shard
        data = group.column("ids").to_pylist()
        fs, root = pyarrow.fs.FileSystem.from_uri(target)
        fs.create_dir(root, recursive=True)
        name, own = f"{root}/shard-{number:08d}.bin", f"{root}/.{uuid.uuid4().hex}"
        try:
            with fs.open_output_stream(own) as f:
                for x in data:
                    f.write(x)
            fs.move(own, name)
        except BaseException:
            with contextlib.suppress(OSError):
                fs.delete_file(own)
            raise
        return pa.table({"slot": slots, "sequence": group.column("sequence"), "shard": pa.array([number] * len(slots), pa.int64()), "byte_offset": (slots - number * shard) * 2 * length, "n_tokens": group.column("n_tokens"), "ids_crc32": pa.array([zlib.crc32(x) for x in data], pa.int64()), "doc_ids": group.column("doc_ids")})

    placed = rows.mapInArrow(place, "slot long, sequence long, ids binary, n_tokens long, doc_ids array<long>")
    by_shard = placed.withColumn("shard", F.expr(f"slot div {shard}")).groupBy("shard")
    out = by_shard.applyInArrow(lambda t: write(t), "slot long, sequence long, shard long, byte_offset long, n_tokens long, ids_crc32 long, doc_ids array<long>")
    return out


def manifest(path: str) -> dict:
    """sequences, length, shard, key, dtype and end of a folder of shards."""
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def read(path: str, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """The sequences of slots ``start`` to ``stop`` (default: all), shard after shard; the
    folder itself says how they lie, so a reader resumes from any slot."""
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    how = manifest(path)
    stride = np.dtype(how["dtype"]).itemsize * how["length"]
    stop = how["sequences"] if stop is None else stop
    while start < stop:
        number, at = divmod(start, how["shard"])
        k = min(stop - start, how["shard"] - at)
        with fs.open_input_file(f"{root}/shard-{number:08d}.bin") as f:
            f.seek(at * stride)
            yield from np.frombuffer(f.read(k * stride), how["dtype"]).reshape(k, how["length"])
        start += k
