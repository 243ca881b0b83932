"""Exact dedup of long byte strings by prefix-free parsing.

A rolling hash over grams of 32 bytes sets triggers: the trigger of a string of 100 bytes is its
gram of smallest hash, the first of equals. It depends on the string alone, so equal strings have
equal triggers at the same place, and neighbouring strings share theirs: the text falls into
phrases, one around each trigger, and the distinct trigger grams are the dictionary.

A string can only repeat if its trigger does, so of the parse only the phrases are followed whose
trigger occurs again anywhere. The phrases of one dictionary entry come together with their
context; their strings are put in order (by distance from the trigger, content, and place in the
corpus), in which equal strings are neighbours and the first is the one that stays. Content is
ordered by two 64-bit hashes rather than byte by byte: all that the removal needs of a suffix
array is which suffixes agree on 100 bytes, and which of them comes first.

Phrases of a trigger that is very frequent don't meet in one task. Their strings are dealt out by
their own hash, after each slice of a task has kept the first of its equal ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..session import stage
from .blocks import ASKED, BODY, LONG, blocks_of, check_seals, meeting, opened, packed, sealed, shards_for, unpacked
from .common import Hasher, buffer_of, consecutive, known, mixed, slices, text_key, unknown

LENGTH, GRAM = 100, 32
#: Phrases of a trigger that may meet in one task.
MOST_TOGETHER = 1_000
#: Characters that a parser takes at a time, about; phrases that are settled at a time, about; texts that are cut at a time.
RUN, SETTLED, TEXTS = 250_000, 4_000, 1_000
PHRASES = "key long, kind int, g long, doc long, at long, low int, high int, context binary"
COVERS = "doc long, start long, end long"


class Parser:
    """Phrases of texts: for each trigger where it is, and the strings that it is the trigger of."""

    def __init__(self, length: int, gram: int = GRAM):
        self.length, self.gram = length, min(gram, length)
        self.hasher, self.second = Hasher(5), Hasher(6)

    def parse(self, texts: list[str]):
        """``data, origin, text, trigger, low, high, hash``: strings start ``low`` to ``high`` bytes before the trigger.

        The buffer is gone through in runs of whole texts, since a place takes several long integers meanwhile.
        """
        data, starts = buffer_of(texts)
        found = []
        for a, b in slices(texts, RUN):
            text, trigger, *rest = self._run(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
            found.append((text + a, trigger + starts[a], *rest))
        none = np.zeros(0, dtype=np.int64)
        return data, starts[:-1], *map(np.concatenate, zip((none, none, none, none, none.view(LONG)), *found, strict=True))

    def _run(self, data: np.ndarray, starts: np.ndarray):
        self.hasher.feed(data)
        n = len(data) - self.gram + 1
        windows = self.length - self.gram + 1
        empty = np.zeros(0, dtype=np.int64)
        if n < windows:
            return empty, empty, empty, empty, empty.view(LONG)
        at = np.arange(n, dtype=np.int64)
        hashes = self.hasher.of(at, at + self.gram)
        least, width = (hashes & ~LONG(0xFFFFFFFF)) | at.view(LONG), 1
        while 2 * width <= windows:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < windows:
            rest = windows - width
            least = np.minimum(least[:-rest], least[rest:])
        trigger = (least & LONG(0xFFFFFFFF)).astype(np.int64)
        origin, sizes = starts[:-1], np.diff(starts) - 1
        count = np.maximum(sizes - self.length + 1, 0)  # strings of each text
        text = np.repeat(np.arange(len(sizes)), count)
        first = np.cumsum(count) - count
        begin = origin[text] + np.arange(len(text)) - first[text]
        own = trigger[begin]
        change = np.ones(len(text), dtype=bool)
        change[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
        runs = np.flatnonzero(change)
        last = np.append(runs[1:], len(text)) - 1 if len(runs) else runs
        own = own[runs]
        return text[runs], own, own - begin[last], own - begin[runs], hashes[own]

    def feed(self, data: np.ndarray) -> None:
        self.hasher.feed(data)
        self.second.feed(data)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.hasher.of(starts, ends), self.second.of(starts, ends)


def _later(keys: tuple[np.ndarray, ...], doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows have an equal in all ``keys`` that comes earlier in the corpus."""
    order = np.lexsort((at, doc, *keys))
    new = np.ones(len(order), dtype=bool)
    if len(order) > 1:
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    d, a = doc[order], at[order]
    later = np.zeros(len(order), dtype=bool)
    later[order] = (d != d[head]) | (a != a[head])
    return later


def _first(keys: tuple[np.ndarray, ...], doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row, of the earliest, for each distinct value of ``keys``."""
    order = np.lexsort((at, doc, *keys))
    new = np.ones(len(order), dtype=bool)
    if len(order) > 1:
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order[new]


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every string of every phrase: the phrase, and how far its start is before the trigger, furthest first."""
    count = high - low + 1
    phrase = np.repeat(np.arange(len(count)), count)
    return phrase, high[phrase] - (np.arange(len(phrase)) - (np.cumsum(count) - count)[phrase])


def _spans(covered: np.ndarray, phrase: np.ndarray, start: np.ndarray, length: int):
    """Runs of covered strings of a phrase: the phrase, first byte and end."""
    at = np.flatnonzero(covered)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(phrase[at]) != 0)
    runs = np.flatnonzero(new)
    last = np.append(runs[1:], len(at)) - 1 if len(runs) else runs
    return phrase[at[runs]], start[at[runs]], start[at[last]] + length


def _ask(shards: int, length: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, held, seal = Parser(length), [], 0
        for block, last, rows in blocks_of(batches):
            seal = sealed(seal, rows)
            held.append(parser.parse(rows.column(1).to_pylist())[-1])
            if last:
                keys, counts = np.unique(np.concatenate(held), return_counts=True)
                place = (mixed(keys) % LONG(shards)).astype(np.int64)
                for shard in range(shards):
                    pick = place == shard
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard], pa.int32()), pa.array([""]), pa.array([block]), pa.array([seal]),
                            pa.array([packed(keys[pick])], pa.binary()), pa.array([counts[pick].astype("<i4").tobytes()], pa.binary()),
                        ],
                        names=["shard", "lang", "block", "seal", "keys", "counts"],
                    )
                held, seal = [], 0

    return ask


def _answer(most: int):
    """Tells each block which of its triggers occur twice or more in the corpus, and which very often."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in consecutive(batches, 1):
            counts = [np.frombuffer(c, dtype="<i4") for c in part.column("counts").to_pylist()]
            asked = [unpacked(k, len(c)) for k, c in zip(part.column("keys").to_pylist(), counts, strict=True)]
            keys, where = np.unique(np.concatenate(asked), return_inverse=True)
            total = np.bincount(where, weights=np.concatenate(counts), minlength=len(keys))
            for block, seal, own in zip(part.column("block").to_pylist(), part.column("seal").to_pylist(), asked, strict=True):
                n = total[np.searchsorted(keys, own)]
                again = own[n >= 2]
                often = (n[n >= 2] > most).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([0], pa.int32()), pa.array([seal]), pa.array([""]), pa.array([packed(again)], pa.binary()), pa.array([often.tobytes()], pa.binary())],
                    names=["block", "kind", "seal", "lang", "keys", "body"],
                )

    return answer


def _rows(kind: int, key, g, doc, at, low, high, context=None) -> pa.RecordBatch:
    n = len(key)
    context = pa.array(context, pa.binary()) if context is not None else pa.nulls(n, pa.binary())
    columns = [key.view(np.int64), np.full(n, kind, dtype=np.int32), g.view(np.int64), doc, at, low.astype(np.int32), high.astype(np.int32)]
    return pa.RecordBatch.from_arrays(
        [*map(pa.array, columns), context], names=["key", "kind", "g", "doc", "at", "low", "high", "context"]
    )


def _phrases(length: int):
    """Of each block: phrases whose trigger occurs again (kind 0), single strings of frequent ones (1), and what is settled (2)."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(length)
        for _, part in consecutive(batches, 1):
            kinds, seals, asked, bodies = (part.column(c).to_pylist() for c in ("kind", "seal", "keys", "body"))
            check_seals(kinds, seals)
            again, often = [], []
            for kind, keys, body in zip(kinds, asked, bodies, strict=True):
                if kind == 0 and body:
                    often.append(np.frombuffer(body, dtype=np.uint8))
                    again.append(unpacked(keys, len(often[-1])))
            if not again:
                continue
            again, often = np.concatenate(again), np.concatenate(often)
            order = np.argsort(again)
            again, often = again[order], often[order]
            for kind, body in zip(kinds, bodies, strict=True):
                if kind == 0:
                    continue
                rows = opened(body)
                data, origin, text, trigger, low, high, g = parser.parse(rows.column(1).to_pylist())
                place = np.minimum(np.searchsorted(again, g), len(again) - 1)
                pick = np.flatnonzero(again[place] == g)
                if not len(pick):
                    continue
                hot, text, trigger, low, high, g = often[place[pick]], text[pick], trigger[pick], low[pick], high[pick], g[pick]
                doc = rows.column(0).to_numpy()[text]
                at = trigger - origin[text]
                parser.feed(data)
                h1, h2 = parser.hashes(trigger - high, trigger - low + length)
                extent = (low * 1000 + high).view(LONG)
                later = _later((h1, h2, extent), doc, at)
                gone = np.flatnonzero(later)
                if len(gone):
                    yield _rows(2, mixed(doc[gone].view(LONG)), g[gone], doc[gone], at[gone], low[gone], high[gone])
                cold = np.flatnonzero(~later & (hot == 0))
                if len(cold):
                    whole = data.tobytes()
                    begin, end = (trigger - high)[cold].tolist(), (trigger - low + length)[cold].tolist()
                    context = [whole[a:b] for a, b in zip(begin, end, strict=True)]
                    yield _rows(0, g[cold], g[cold], doc[cold], at[cold], low[cold], high[cold], context)
                left = np.flatnonzero(~later & (hot == 1))
                for some in np.array_split(left, max(1, len(left) // 10_000)):
                    if not len(some):
                        continue
                    phrase, back = _expanded(low[some], high[some])
                    start = trigger[some][phrase] - back
                    h1, h2 = parser.hashes(start, start + length)
                    own, begin = doc[some][phrase], at[some][phrase] - back
                    later = _later((h1, h2), own, begin)
                    of, first, end = _spans(later, phrase, begin, length)
                    if len(of):
                        size = end - first - length
                        yield _rows(2, mixed(doc[some][of].view(LONG)), g[some][of], doc[some][of], first, -size, size * 0)
                    keep = _first((h1, h2), own, begin)
                    yield _rows(1, h1[keep], h2[keep], own[keep], begin[keep], back[keep] * 0, back[keep] * 0)

    return phrases


def _settle(length: int):
    """Covered stretches: of phrases that share a trigger, of equal single strings, and those already settled."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(length)

        def made(doc, start, end):
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(end)], names=["doc", "start", "end"])

        def settled(table: pa.Table) -> Iterator[pa.RecordBatch]:
            kind = table.column("kind").to_numpy()
            key, g, doc, at, low, high = (table.column(c).to_numpy() for c in ("key", "g", "doc", "at", "low", "high"))
            low, high = low.astype(np.int64), high.astype(np.int64)
            done = np.flatnonzero(kind == 2)
            if len(done):
                yield made(doc[done], at[done] - high[done], at[done] - low[done] + length)
            single = np.flatnonzero(kind == 1)
            if len(single):
                gone = single[_later((key[single], g[single]), doc[single], at[single])]
                yield made(doc[gone], at[gone], at[gone] + length)
            whole = np.flatnonzero(kind == 0)
            if len(whole):
                key, doc, at, low, high = key[whole], doc[whole], at[whole], low[whole], high[whole]
                blobs = table.column("context").take(pa.array(whole)).to_pylist()
                sizes = np.array([len(b) for b in blobs])
                data = np.frombuffer(b"".join(blobs), dtype=np.uint8)
                parser.feed(data)
                phrase, back = _expanded(low, high)
                start = (np.cumsum(sizes) - sizes)[phrase] + high[phrase] - back
                h1, h2 = parser.hashes(start, start + length)
                begin = at[phrase] - back
                later = _later((h1, h2, key[phrase], back), doc[phrase], begin)
                of, first, end = _spans(later, phrase, begin, length)
                yield made(doc[of], first, end)

        held: list[pa.Table] = []
        size = 0
        # whole keys together, about SETTLED rows at a time
        for batch in _cut(batches, SETTLED):
            keys = batch.column(0).to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if len(keys) and keys[0] != keys[-1] else 0
            if held and held[-1].column("key")[-1].as_py() != keys[0]:
                cut = max(cut, 0)
                if size > SETTLED:
                    yield from settled(pa.concat_tables(held))
                    held, size = [], 0
            if cut and size + cut > SETTLED:
                held.append(pa.Table.from_batches([batch.slice(0, cut)]))
                yield from settled(pa.concat_tables(held))
                held, size = [], 0
                batch = batch.slice(cut)
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
        if held:
            yield from settled(pa.concat_tables(held))

    return settle


def _cut(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _identified(docs: DataFrame) -> DataFrame:
    """``doc, name, text``: a number that orders the documents, the id, and the text (null: empty).

    The number is the id, unless rows share an id or have none; then ids and hashes of the text are
    numbered, and the rows are staged, since they have to come in the same order at each reading.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    given = docs.select(known(F.col("doc_id").cast("long")).alias("name"), text)
    if given.groupBy("name").count().where("count > 1").isEmpty():
        return given.select(F.col("name").alias("doc"), "name", "text")
    given = given.withColumn("row", text_key())
    numbers = numbered(given.select("name", "row").distinct(), ["name", "row"], "doc")
    return stage(given.join(numbers, ["name", "row"]).select("doc", "name", "text"), "identified")


def repeated_stretches(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc, start, end``: stretches covered by strings of ``length`` bytes that also start earlier.

    ``docs`` has ``doc`` and ``text``. Earlier is a smaller ``doc``, or the same and an earlier start;
    rows of one ``doc`` have the same text, and none of them is earlier than another. The stretches
    overlap. ``docs`` is read twice and has to come in the same order both times (see `blocks`).
    """
    given = docs.select("doc", "text")
    asked = given.mapInArrow(_ask(shards_for(given), length), ASKED).repartition("shard").sortWithinPartitions("shard")
    answers = asked.mapInArrow(_answer(MOST_TOGETHER), BODY)
    phrases = meeting(given, answers).mapInArrow(_phrases(length), PHRASES)
    return phrases.repartition("key").sortWithinPartitions("key").mapInArrow(_settle(length), COVERS)


def drop_repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_bytes, n_removed, spans, kept``.

    Removes every byte covered by a string of ``length`` bytes that also starts earlier; matches
    don't cross documents and are judged on the given texts. ``spans`` lists the maximal removed
    runs, ``kept`` is what remains, as bytes: a cut may fall inside a character. Null texts are
    empty. Rows that share an id, or have none, are documents of their own, null ids first and then
    by a hash of the text; rows equal in id and text count as one document.
    """
    given = _identified(docs)
    covers = stage(repeated_stretches(given, length), "covers")
    spans = covers.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("covers"))
    joined = given.select("doc", "name", F.col("text").cast("binary").alias("text")).join(spans, "doc", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches, TEXTS):
            names, texts, lists = (batch.column(i).to_pylist() for i in range(3))
            for a, b in slices(texts):
                rows = []
                for name, whole, stretches in zip(names[a:b], texts[a:b], lists[a:b], strict=True):
                    merged: list[list[int]] = []
                    for s in stretches or ():
                        start, end = s["start"], min(s["end"], len(whole))
                        if merged and start <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], end)
                        elif start < end:
                            merged.append([start, end])
                    edges = [0, *(x for m in merged for x in m), len(whole)]
                    kept = b"".join(whole[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                    spans_ = [{"start": x, "end": y} for x, y in merged]
                    rows.append((name, len(whole), len(whole) - len(kept), spans_, kept, hashlib.sha256(kept).hexdigest()))
                kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])

    out = "doc long, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary, kept_sha256 string"
    made = joined.select("name", "text", "covers").mapInArrow(cut, out)
    return made.select(unknown("doc").alias("doc_id"), "n_bytes", "n_removed", "spans", "kept", "kept_sha256")
