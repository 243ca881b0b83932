"""Fill-in-the-middle texts by a piece table.

A document is one descriptor, ``(buffer, start, end)`` in code points, over its own text, which is
never changed. Cutting splits descriptors; an arrangement lists parts and sentinels in a new order;
hashes and outputs read the buffers descriptor by descriptor, in pieces of bounded size. The way
back finds the sentinels of an output, which gives descriptors over that output, and puts them in
order by the inverse of the arrangement's permutation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrowed

SENTINELS = ("<P>", "<S>", "<M>")
TEXT, PREFIX, SUFFIX, MIDDLE = range(4)
#: Sentinel buffer and number of the part (0 prefix, 1 middle, 2 suffix) after it.
FORMS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
#: Code points that are encoded at once.
STREAMED = 1 << 16
ARRANGED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"

Piece = tuple[int, int, int]


def cut(pieces: list[Piece], place: int) -> tuple[list[Piece], list[Piece]]:
    """The descriptors of the first ``place`` code points, and those of the rest."""
    left, right = [], []
    for buffer, start, end in pieces:
        at = min(max(place, 0), end - start) + start
        if at > start:
            left.append((buffer, start, at))
        if at < end:
            right.append((buffer, at, end))
        place -= end - start
    return left, right


def arrange(parts: list[list[Piece]], form: str, sentinels: tuple[str, ...] = SENTINELS) -> list[Piece]:
    """Descriptors of the output: each sentinel and the part that follows it."""
    out: list[Piece] = []
    for sentinel, part in FORMS[form]:
        out += [(sentinel, 0, len(sentinels[sentinel - 1])), *parts[part]]
    return out


def take_apart(output: str, form: str, sentinels: tuple[str, ...] = SENTINELS) -> list[Piece]:
    """Descriptors over ``output`` that spell the text it was made of."""
    if form not in FORMS:
        return [(TEXT, 0, len(output))]
    rest, found = [(TEXT, 0, len(output))], []
    for sentinel, _ in FORMS[form]:
        mark = sentinels[sentinel - 1]
        at = output.index(mark, rest[0][1])
        before, rest = cut(rest, at - rest[0][1])
        _, rest = cut(rest, len(mark))
        found.append(before)
        rest = rest or [(TEXT, len(output), len(output))]
    found = [*found[1:], rest]  # nothing stands before the first sentinel
    order = [part for _, part in FORMS[form]]
    return [piece for part in range(len(order)) for piece in found[order.index(part)]]


def spelled(pieces: list[Piece], buffers: tuple[str, ...]) -> Iterator[str]:
    """What the descriptors spell, in strings of at most `STREAMED` code points."""
    for buffer, start, end in pieces:
        for at in range(start, end, STREAMED):
            yield buffers[buffer][at : min(at + STREAMED, end)]


def streamed_sha256(pieces: list[Piece], buffers: tuple[str, ...]) -> str:
    digest = hashlib.sha256()
    for part in spelled(pieces, buffers):
        digest.update(part.encode("utf-8", "surrogatepass"))
    return digest.hexdigest()


def planned(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """``doc_id, text, n, form, first, second``: where each text is cut, and how it is arranged.

    Four numbers come from the SHA-256 of ``seed:doc_id`` (a null id: nothing after the colon). Rows
    that share an id get the same numbers, each cut to its own length.
    """
    rows = narrowed(docs).withColumn("n", F.length("text").cast("long"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = rows.withColumn("_key", key)
    h1, h2, h3, h4 = (F.conv(F.substring("_key", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    kept = F.col("n") == 0
    for mark in sentinels:
        kept = kept | F.contains("text", F.lit(mark))
    form = F.when(kept | (h3 % 100 >= 100 - plain), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    return rows.select("doc_id", "text", "n", form.alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


def transform(
    docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, sentinels: tuple[str, ...] = SENTINELS, outputs: bool = True
) -> DataFrame:
    """One row per document: ``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, output``.

    ``plain`` and ``spm`` are percentages: of all texts, and of those that are not plain. A text that
    is null (as an empty one), empty or holds a sentinel is plain: its output is the text and its
    part lengths are null. ``restored_sha256`` is the hash of the text rebuilt from output and form.
    Repeated rows come out each; other columns are dropped; without ``outputs`` there is no
    ``output``. A row is worked on by itself, so nothing is shuffled; its text and output are the
    most that is held.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [one(*row) for row in zip(*(part.column(c).to_pylist() for c in ("text", "form", "first", "second")), strict=True)]
                prefix, middle, hashes, restored, texts = zip(*made, strict=True)
                columns = [part.column("doc_id"), part.column("n"), part.column("form"), pa.array(prefix, pa.int64()),
                           pa.array(middle, pa.int64()), pa.array(hashes, pa.string()), pa.array(restored, pa.string())]
                names = [c.split()[0] for c in ARRANGED.split(", ")]
                if outputs:
                    columns.append(pa.array(texts, pa.string()))
                    names.append("output")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def one(text: str, form: str, first: int, second: int) -> tuple:
        buffers = (text, *sentinels)
        pieces: list[Piece] = [(TEXT, 0, len(text))]
        if form == "plain":
            output, sizes = text, (None, None)
        else:
            head, suffix = cut(pieces, second)
            prefix, middle = cut(head, first)
            pieces = arrange([prefix, middle, suffix], form, sentinels)
            output, sizes = "".join(spelled(pieces, buffers)), (first, second - first)
        back = streamed_sha256(take_apart(output, form, sentinels), (output,))
        return *sizes, streamed_sha256(pieces, buffers), back, output

    return planned(docs, seed, plain, spm, sentinels).mapInArrow(work, ARRANGED + (", output string" if outputs else ""))


def restore(made: DataFrame, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """``doc_id, text`` from ``doc_id, form, output``: the way back of `transform`.

    A null output is an empty text, a null form is ``plain``. An output without the sentinels of its
    form is an error.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, forms = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            texts = ["".join(spelled(take_apart(o, f, sentinels), (o,))) for o, f in zip(outputs, forms, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    filled = made.select("doc_id", F.coalesce("output", F.lit("")).alias("output"), F.coalesce("form", F.lit("plain")).alias("form"))
    return filled.mapInArrow(work, "doc_id long, text string")
