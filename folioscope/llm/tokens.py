"""Token counts by byte-pair merging with a heap and a linked list; no ids are made.

A text is normalised and split as its vocabulary file says. Each piece then starts as its symbols
and loses one for every merge, so its count is symbols minus merges. The pair of lowest rank is
popped from a heap; links to the neighbours give the pairs that a merge makes and breaks. A piece
of n symbols takes n log n steps, however long it is.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import narrowed

CONTROLS = re.compile("[\x1c-\x1f]")
#: Chunks and pieces whose counts a worker remembers; beyond it the memory starts anew.
REMEMBERED = 600_000


def merges_of(symbols: list[int], pairs: dict[int, int]) -> int:
    """How many merges byte-pair merging makes: always the adjacent pair of lowest rank, leftmost first.

    ``pairs`` maps ``left << 32 | right`` to ``rank << 32 | merged symbol``.
    """
    n = len(symbols)
    if n < 2:
        return 0
    after, before, symbols = [*range(1, n), -1], [*range(-1, n - 1)], list(symbols)
    heap = [(r, i) for i in range(n - 1) if (r := pairs.get(symbols[i] << 32 | symbols[i + 1])) is not None]
    heapq.heapify(heap)
    made = 0
    while heap:
        found, i = heapq.heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] < 0 or pairs.get(symbols[i] << 32 | symbols[j]) != found:
            continue  # one of the two has been merged since
        symbols[i] = merged = found & 0xFFFFFFFF
        symbols[j] = -1
        after[i] = k = after[j]
        made += 1
        if k >= 0:
            before[k] = i
            if (r := pairs.get(merged << 32 | symbols[k])) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := pairs.get(symbols[h] << 32 | merged)) is not None:
            heapq.heappush(heap, (r, h))
    return made


class PieceCounter:
    """Counts tokens as the vocabulary file at ``path`` (``tokenizers`` JSON, BPE) defines them.

    Takes a word-end suffix, a sequence of NFC, white space and lower-case normalisers, a splitting
    pattern that matches no white space, and added tokens that are found in the raw text and count
    as one each. White space bounds pieces, so a text is cut there first and each chunk between is
    normalised, split and merged once for as long as the worker remembers it.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.symbol = model["vocab"]
        self.pairs = {
            self.symbol[left] << 32 | self.symbol[right]: rank << 32 | self.symbol[left + right]
            for rank, (left, right) in enumerate(merges)
        }
        self.suffix = model["end_of_word_suffix"] or ""
        self.normalizer = Tokenizer.from_file(path).normalizer
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.split = regex.compile(split["pattern"]["Regex"]).findall
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_in = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        moved = [b for b in range(256) if b not in kept]
        letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}
        self.start = [self.symbol[letters[b]] for b in range(256)]
        self.end = [self.symbol[letters[b] + self.suffix] for b in range(256)]
        self.pieces: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        encoded = piece.encode("utf-8")
        symbols = [self.start[b] for b in encoded]
        symbols[-1] = self.end[encoded[-1]]
        return len(symbols) - merges_of(symbols, self.pairs)

    def chunk(self, chunk: str) -> int:
        # Python and the library agree on ASCII; elsewhere the library's own normaliser decides
        normal = chunk.lower() if chunk.isascii() else self.normalizer.normalize_str(chunk)
        known, total = self.pieces, 0
        for p in self.split(normal):
            if (n := known.get(p)) is None:
                n = known[p] = self.piece(p)
            total += n
        return total

    def plain(self, text: str) -> int:
        # four controls are white space to Python only: such a text stays in one chunk
        chunks = [text] if CONTROLS.search(text) else text.split()
        known = self.chunks
        try:
            return sum(map(known.__getitem__, chunks))
        except KeyError:
            for memory in (known, self.pieces):
                if len(memory) > REMEMBERED:
                    memory.clear()
            for c in set(chunks).difference(known):
                known[c] = self.chunk(c)
            return sum(map(known.__getitem__, chunks))

    def count(self, text: str) -> int:
        if not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.special_in.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """One counter for each vocabulary in a worker process."""
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; ``vocabulary`` is the path of the file.

    Null and empty texts have no tokens. Repeated rows each give a row. No shuffle: a row is
    counted where it is read.
    """

    @pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(vocabulary).count
        for batch in texts:
            yield pd.Series([count(t) for t in batch], dtype="int64")

    counted = narrowed(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), tokens("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
