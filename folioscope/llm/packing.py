"""Concatenate and cut: all documents as one stream of ids, cut into windows of a fixed length.

Pass one turns each document into ids where it is read and notes how many ids its task had before
it. Prefix sums over the tasks' totals then give every document its place in the stream, and pass
two cuts it at the multiples of the window length. Only the last window has padding.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from .common import narrowed, slices

#: Chunks, and pieces inside chunks, whose ids a worker remembers; the older half goes when there are more.
REMEMBERED = 900_000
#: A single space between two other characters: no piece reaches across it from the left.
SPACE = re.compile(r"(?<=\S) (?=\S)")
#: White space other than space, line break, tab and carriage return.
UNUSUAL = re.compile(r"[^\S \n\t\r]")
UNUSUAL_MARKS = tuple(c for c in map(chr, range(0x3001)) if UNUSUAL.match(c))
BESIDE, BESIDE_RARE = ("  ", "\n ", " \n"), {"\t": ("\t ", " \t"), "\r": ("\r ", " \r")}
#: Pieces that the file's pattern makes of plain chunks: runs of letters, of digits and of other marks but
#: the apostrophe, and a line break before one of them. A chunk is plain if its pieces are all of it.
PIECES_OF = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]++|[0-9]++|[!-&(-/:-@\[-`{-~]++|\n(?=\S)")
PACKED = "doc_id long, task long, before long, n_tokens long, ids binary"
PIECES = "doc_id long, sequence_id long, start long, length long, offset long, doc_tokens long, ids binary, ids_crc32 long"


class ByteEncoder:
    """Ids of a byte-level BPE file for ``tokenizers``, as little-endian unsigned 32-bit bytes.

    In the file's pattern a space belongs to the piece after it, so a text can be cut before every
    space that stands alone. A chunk not seen before is cut further, into the pieces of the pattern,
    if it is plain; the library then encodes the new pieces of many texts in one call, each once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]
        names = sorted(self.tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.spaced = np.zeros(names[-1][1] + 1, dtype=bool)
        self.spaced[[i for name, i in names if name.startswith("\u0120")]] = True  # how the file writes a space
        line = self._encoded("\n")
        self.newline, self.line = line.tobytes(), line[0] if len(line) == 1 else -1
        self.known: dict[str, bytes] = {}  # by chunk, without the space before it
        self.inner: dict[str, bytes] = {}  # by piece after another, without the line break

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _ids(self, chunks: list[str]) -> list[bytes]:
        return [array("I", made.ids).tobytes() for made in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _joined(self, pieces: list[str], between: str) -> list[bytes]:
        """Ids of pieces that hold no space or line break: all in one text, cut where ``between`` is found again."""
        if not pieces:
            return []
        ids = self._encoded("".join([between + p for p in pieces]))
        starts = np.flatnonzero(self.spaced[ids] if between == " " else ids == self.line)
        if len(starts) != len(pieces):
            return self._ids([" " + p for p in pieces] if between == " " else pieces)
        blob, skip = ids.tobytes(), 0 if between == " " else 1
        edges = np.append(starts, len(ids)).tolist()
        return [blob[4 * (x + skip) : 4 * y] for x, y in zip(edges[:-1], edges[1:], strict=True)]

    def _learn(self, chunks: list[str], special: bool) -> None:
        """Remember the ids of chunks that are not known; ``special`` if they may hold an added token."""
        cut, odd, heads, tails = [], [], set(), set()
        for c in chunks:
            if c.isalpha() and c.isascii():
                heads.add(c)
                continue
            pieces = PIECES_OF.findall(c)
            if sum(map(len, pieces)) == len(c) and pieces and not (special and any(a in c for a in self.added)):
                head, *rest = pieces
                heads.add(head)
                if rest:
                    cut.append((c, head, rest))
                    tails.update(rest)
            else:
                odd.append(c)
        heads, tails = list(heads.difference(self.known)), list(tails.difference(self.inner, "\n"))
        known, inner = self.known, self.inner
        known.update(zip(heads, self._joined(heads, " "), strict=True))
        inner.update(zip(tails, self._joined(tails, "\n"), strict=True))
        inner["\n"] = self.newline
        known.update(zip(odd, self._ids([" " + c for c in odd]), strict=True))
        for c, head, rest in cut:
            known[c] = known[head] + (inner[rest[0]] if len(rest) == 1 else b"".join([inner[p] for p in rest]))

    def _forget(self, memory: dict[str, bytes]) -> None:
        if len(memory) > REMEMBERED:
            for key in list(islice(memory, len(memory) // 2)):
                del memory[key]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; what is new in any of them is encoded at once."""
        self._forget(self.known)
        self._forget(self.inner)
        even = [_is_even(text) for text in texts]
        special = any(a in text for text in texts for a in self.added)
        plain = self._cut([t for t, e in zip(texts, even, strict=True) if e], special, pc.split_pattern)
        other = self._cut([t for t, e in zip(texts, even, strict=True) if not e], special, _split_alone)
        return [next(plain if e else other) for e in even]

    def _cut(self, texts: list[str], special: bool, split: Callable[[pa.Array, str], pa.ListArray]) -> Iterator[bytes]:
        """Ids of each text, cut by ``split`` before spaces: a chunk that comes again is looked up once for all of them."""
        if not texts:
            return iter(())
        lists = split(pa.array(texts, pa.large_string()), " ")
        starts, chunks = lists.offsets.to_numpy().astype(np.int64), lists.values
        follows = np.ones(len(chunks), dtype=bool)
        follows[starts[:-1]] = False
        chunks = chunks.filter(pa.array(follows)).dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = [*map(self.known.get, distinct)]
        if new := [c for c, found in zip(distinct, known, strict=True) if found is None]:
            self._learn(new, special)
            known = [*map(self.known.__getitem__, distinct)]
        ids = pa.array(known, pa.large_binary()).take(chunks.indices)
        # the chunks after the first of each text, as one stretch of ids
        edges = starts - np.arange(len(starts))
        at = np.frombuffer(ids.buffers()[1], dtype=np.int64, count=len(ids) + 1)[edges].tolist()
        blob = memoryview(ids.buffers()[2] or b"")
        firsts = self._ids(pc.list_element(lists, 0).to_pylist())
        return iter([first + blob[x:y] for first, x, y in zip(firsts, at[:-1], at[1:], strict=True)])


def _split_alone(texts: pa.Array, space: str) -> pa.ListArray:
    """Cut only at each ``space`` between two characters that are no white space."""
    return pa.array([SPACE.split(t) for t in texts.to_pylist()], pa.large_list(pa.large_string()))


def _is_even(text: str) -> bool:
    """Whether every space stands alone, between two characters that are no white space, or at an end.

    One character is found much faster than a pattern or a pair, so marks that most texts lack come first.
    """
    if any(mark in text for mark in UNUSUAL_MARKS) or any(pair in text for pair in BESIDE):
        return False
    return not any(mark in text and any(pair in text for pair in pairs) for mark, pairs in BESIDE_RARE.items())


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """``doc_id, task, before, n_tokens, ids``: the ids of each row, ``end_id`` last, and its place in its task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, end = encoder(vocabulary).encode_all, np.array([end_id], dtype="<u4").tobytes()
        task, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            for at, to in slices(texts):
                ids = [x + end for x in make(texts[at:to])]
                sizes = np.array([len(x) // 4 for x in ids], dtype="int64")
                before = total + np.cumsum(sizes) - sizes
                total += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [names.slice(at, to - at), pa.array(np.full(len(ids), task, dtype="int64")), pa.array(before), pa.array(sizes), pa.array(ids, pa.binary())],
                    names=["doc_id", "task", "before", "n_tokens", "ids"],
                )

    return narrowed(docs).mapInArrow(encode, PACKED)


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids, one row for each document and sequence.

    Output: ``doc_id``, ``sequence_id``, ``start`` (the document's ids before the piece),
    ``length``, ``offset`` (in the sequence), ``doc_tokens`` (with the end id), ``ids`` (the
    piece's ids, little-endian unsigned 32-bit) and ``ids_crc32``. A null or empty text is the end
    id alone. Repeated rows are packed each. No rows give no pieces.

    The stream is staged with ids, so pass two can't see other ids or another order than pass one.
    What meets in one task, for the prefix sums, is one row for each task of pass one.
    """
    stream = stage(encode_documents(docs, vocabulary, end_id), "stream")
    totals = stream.groupBy("task").agg(F.sum("n_tokens").alias("total"))
    base = F.coalesce(F.sum("total").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = stream.join(F.broadcast(totals.select("task", base.alias("base"))), "task")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, firsts, blobs = (batch.column(i).to_pylist() for i in range(3))
            for at in range(0, len(names), 256):
                rows = []
                for name, first, blob in zip(names[at : at + 256], firsts[at : at + 256], blobs[at : at + 256], strict=True):
                    size, start = len(blob) // 4, 0
                    while start < size:
                        sequence, offset = divmod(first + start, length)
                        n = min(length - offset, size - start)
                        part = blob[4 * start : 4 * (start + n)]
                        rows.append((name, sequence, start, n, offset, size, part, zlib.crc32(part)))
                        start += n
                types = [pa.int64()] * 6 + [pa.binary(), pa.int64()]
                names_ = [c.split()[0] for c in PIECES.split(", ")]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names_)

    return placed.select("doc_id", (F.col("base") + F.col("before")).alias("first"), "ids").mapInArrow(cut, PIECES)


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """The windows with their boundary records: ``sequence_id, ids, boundaries``.

    ``boundaries`` lists ``offset, doc_id, start, length``; the last sequence is padded with
    ``pad_id`` to ``length``, or left as it is if its size is a power of two.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").cast("int").alias("size"))
    pad = F.when(F.expr("size & (size - 1)") == 0, 0).otherwise(length - F.col("size"))
    unit = F.lit(int(pad_id).to_bytes(4, "little").hex())
    joined = F.concat(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""), F.repeat(unit, pad))
    boundary = F.transform("parts", lambda p: F.struct(p["offset"], p["doc_id"], p["start"], p["length"]))
    return rows.select("sequence_id", F.unhex(joined).alias("ids"), boundary.alias("boundaries"))
