"""Documents in blocks that ask a sharded table something and meet the answers.

A task of a scan packs its rows into blocks. In a first pass each block sends questions to shards;
in a second pass the documents are read again, travel as compressed blocks and meet the answers
for their block. That takes less room than sending a row for each question and document. Both
passes have to see the same rows in the same order; a checksum of each block makes sure of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import mixed, slices

#: Characters of a block, about.
BLOCK = 16_000_000
#: Characters that a task works on at a time, about.
SLICE = 1_000_000
ASKED = "shard int, lang string, block long, seal long, keys binary, counts binary"
BODY = "block long, kind int, seal long, lang string, keys binary, body binary"
LONG = np.uint64


def packed(values: np.ndarray) -> bytes:
    """Sorted keys as compressed differences, byte by byte."""
    steps = np.diff(values, prepend=values[:1] * 0).view(np.uint8).reshape(-1, 8)
    return pa.compress(np.ascontiguousarray(steps.T).tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(blob, 8 * n, "zstd", asbytes=True), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).view(LONG).ravel(), dtype=LONG)


def blocks_of(batches: Iterator[pa.RecordBatch]):
    """Slices of a task's rows with the block they belong to: ``block, last, rows``; a block ends with its last slice."""
    task, number, size, held = TaskContext.get().partitionId(), 0, 0, None
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in slices(texts, SLICE):
            if held is not None:
                last = size >= BLOCK
                yield (task << 32) + number, last, held
                if last:
                    number, size = number + 1, 0
            held = batch.slice(a, b - a)
            size += sum(map(len, texts[a:b])) + (b - a)
    if held is not None:
        yield (task << 32) + number, True, held


def sealed(seal: int, rows: pa.RecordBatch) -> int:
    """A checksum of the ids and text sizes that a block has seen."""
    ids = rows.column(0).to_numpy(zero_copy_only=False)
    ids = np.nan_to_num(ids.astype(np.float64)).astype(np.int64).view(LONG)
    sizes = np.array([len(t) for t in rows.column(1).to_pylist()], dtype=LONG)
    with np.errstate(over="ignore"):
        order = np.arange(1, len(ids) + 1, dtype=LONG)
        new = int(mixed(mixed(ids) + sizes * LONG(31) + order).sum())
    return (seal * 31 + new) % 2**63


def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seal = 0
    for block, last, rows in blocks_of(batches):
        seal = sealed(seal, rows)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.array([1], pa.int32()), pa.array([seal if last else 0]), pa.array([""]), pa.array([b""], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
            names=["block", "kind", "seal", "lang", "keys", "body"],
        )
        seal = 0 if last else seal


def opened(body: bytes) -> pa.RecordBatch:
    """The rows that `send` packed."""
    with pa.ipc.open_stream(body) as reader:
        return reader.read_all().combine_chunks().to_batches()[0]


def meeting(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (``BODY``, kind 0) and blocks of ``docs`` together, sorted by block, answers first."""
    # the documents first: tasks of a union are numbered through, and blocks carry the task's number
    return docs.mapInArrow(send, BODY).unionByName(answers).repartition("block").sortWithinPartitions("block", "kind")


def check_seals(kinds: list[int], seals: list[int]) -> None:
    answered, sent = ({s for k, s in zip(kinds, seals, strict=True) if k == kind} for kind in (0, 1))
    if answered != sent - {0}:
        raise ValueError("the documents came in another order when read again: stage them first")


def shards_for(docs: DataFrame) -> int:
    """Shards follow the tasks that read the documents, so that what a shard merges stays bounded."""
    return max(8, docs.rdd.getNumPartitions() // 2)
