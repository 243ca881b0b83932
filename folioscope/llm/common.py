"""What the operators share: row identity, words, and blocks of rows for work inside tasks."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of ``words_of``: a run of anything but space and the ASCII controls 9 to 13.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(29)
MULTIPLY = np.uint64(0xBF58476D1CE4E5B9)
NO_ID = -(2**63)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def narrowed(docs: DataFrame, *columns: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id``, ``text`` (null: empty) and the named columns; others, clashing names included, go."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *(F.col(c) for c in columns))


def known(column: Column | str) -> Column:
    """An id as a join key: null ids meet under the smallest long, so that joins keep their rows."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NO_ID))


def unknown(column: Column | str) -> Column:
    """The id that ``known`` was given."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column != NO_ID, column)


def text_key(text: Column | str = "text") -> Column:
    """A hash of a row's text (null as empty). With the id it tells rows that share an id, or have none, apart."""
    column = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(F.coalesce(column.cast("string"), F.lit("")))


def mixed(keys: np.ndarray) -> np.ndarray:
    """Scatter the bits of unsigned 64-bit keys."""
    with np.errstate(over="ignore"):
        keys = (keys ^ (keys >> SHIFT)) * MULTIPLY
        return keys ^ (keys >> SHIFT)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Start of each run, and the end of the last, for runs laid end to end."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


class Hasher:
    """Hashes of any stretch of a byte buffer, from running sums of powers.

    The sum of ``value[byte] * base ** place`` up to each place gives the hash of ``[a, b)`` as the
    difference at its ends, moved back to place 0 by the inverse power; all modulo 2^64, then mixed.
    """

    def __init__(self, seed: int = 7):
        random = np.random.default_rng(seed)
        self.values = random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = (int(random.integers(2**40, 2**62)) * 8 + 5) % 2**64
        self.inverse = pow(self.base, -1, 2**64)
        self.power = self.back = np.ones(1, dtype=np.uint64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        powers = np.ones(n, dtype=np.uint64)
        powers[1:] = np.uint64(base)
        return np.multiply.accumulate(powers)

    def feed(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if len(self.power) < n:
            room = n + n // 8
            self.power, self.back = self._powers(self.base, room), self._powers(self.inverse, room)
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(self.values[data] * self.power[: n - 1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts])


def runs_of_bytes(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which the table ``inside`` is true."""
    flags = np.zeros(len(data) + 2, dtype=np.int8)
    flags[1:-1] = inside[data]
    change = np.diff(flags)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def buffer_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as UTF-8, each followed by a zero byte, and the start of each and of what would follow."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = starts_of(np.array([len(e) + 1 for e in encoded], dtype=np.int64))
    return np.frombuffer(b"\0".join([*encoded, b""]), dtype=np.uint8), starts


def slices(texts: list[str], most: int = 2_000_000):
    """Ranges of consecutive texts of about ``most`` characters in all, one text at least."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield first, i
            first, total = i, 0
        total += len(t)
    if texts:
        yield first, len(texts)


def consecutive(batches, keys: int):
    """Rows of Arrow batches that are sorted by their first ``keys`` columns, one table for each key."""
    import pyarrow as pa

    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for i in range(keys):
            values = batch.column(i).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(a, b - a)
            own = tuple(part.column(i)[0].as_py() for i in range(keys))
            if held and own != key:
                yield key, pa.Table.from_batches(held)
                held = []
            held.append(part)
            key = own
    if held:
        yield key, pa.Table.from_batches(held)
