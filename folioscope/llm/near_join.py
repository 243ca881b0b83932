"""Similarity join on sets of word 5-grams by MinHash banding, verified on the full sets.

Words are runs of letters and digits (any byte outside ASCII counts as a letter), A-Z in lower
case. A text of one to four words has one gram of all its words; a text without words is compared
with nothing. Texts with the same set of grams make a class, and classes are compared once.

Band and row counts follow from the wanted recall. Classes meet in buckets by band hash. Buckets
with the same members count once. A large bucket is dealt into chunks, and pairs of chunks are
checked in tasks of bounded size; a task returns a row for each class, not for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stage
from .common import Hasher, buffer_of, consecutive, known, mixed, narrowed, runs_of_bytes, slices, unknown
from .components import components

GRAM = 5
#: A chunk of a bucket holds about so many grams, or classes, at most.
CHUNK_GRAMS, CHUNK_CLASSES = 400_000, 2_000
SKETCH = "doc_id long, size long, d1 long, d2 long, bands array<bigint>"
SETS = "class long, d1 long, grams binary"
LINKED = "class long, links long, root long"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
INSIDE = np.zeros(256, dtype=bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True


def band_counts(similarity: float, recall: float, most_hashes: int = 96) -> tuple[int, int]:
    """Bands and rows: the most rows with which so many hashes find a pair of that similarity with that chance."""
    found = (1, 1)
    for rows in range(1, 17):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))) if similarity < 1 else 1
        if bands * rows <= most_hashes:
            found = (bands, rows)
    return found


def gram_sets(texts: list[str], hasher: Hasher) -> list[np.ndarray]:
    """The sorted distinct gram hashes of each text."""
    data, starts = buffer_of(texts)
    data = LOWER[data]
    first, last = runs_of_bytes(data, INSIDE)
    hasher.feed(data)
    words = hasher.of(first, last)
    bounds = np.searchsorted(first, starts)
    with np.errstate(over="ignore"):
        grams = np.zeros(max(len(words) - GRAM + 1, 0), dtype=np.uint64)
        for k in range(GRAM):
            grams = grams * np.uint64(hasher.base) + words[k : len(words) - GRAM + 1 + k] if len(grams) else grams
        grams = mixed(grams)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= GRAM:
                out.append(np.unique(grams[a : b - GRAM + 1]))
            else:
                whole = np.uint64(b - a)
                for w in words[a:b]:
                    whole = whole * np.uint64(hasher.base) + w
                out.append(mixed(np.array([whole] * (b > a), dtype=np.uint64)))
    return out


def sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``doc_id, size, d1, d2, bands`` of each row: size and digests of the set of grams, and its band hashes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, random = Hasher(), np.random.default_rng(11)
        odd = random.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        turn = random.integers(0, 2**63, bands * rows, dtype=np.uint64)
        old = np.seterr(over="ignore")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                sets = gram_sets(texts[a:b], hasher)
                sizes = np.array([len(s) for s in sets])
                full, flat = np.flatnonzero(sizes), np.concatenate(sets)
                at = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
                made = np.zeros((len(sets), bands), dtype=np.int64)
                digests = np.zeros((2, len(sets)), dtype=np.int64)
                if len(full):
                    for k in range(2):
                        digests[k, full] = np.add.reduceat(mixed(flat + np.uint64(k)), at).view(np.int64)
                    for band in range(bands):
                        key = np.full(len(full), band + 1, dtype=np.uint64)
                        for r in range(band * rows, band * rows + rows):
                            key = mixed(key * odd[0] + np.minimum.reduceat((flat ^ turn[r]) * odd[r], at))
                        made[full, band] = key.view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, bands), pa.int32()), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(digests[0]), pa.array(digests[1]), lists],
                    names=["doc_id", "size", "d1", "d2", "bands"],
                )
        np.seterr(**old)

    return spread(narrowed(docs)).mapInArrow(sketch, SKETCH)


def _sets(docs: DataFrame) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                sets = gram_sets(texts[a:b], hasher)
                digests = pa.array([int(mixed(s).sum().view(np.int64)) for s in sets], pa.int64())
                blobs = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), digests, blobs], names=["class", "d1", "grams"])

    return docs.mapInArrow(make, SETS)


def _verify(similarity: float):
    """For each pair of chunks: how many documents each class is linked with, and the smallest class it hangs together with."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, left, right, band), part in consecutive(batches, 5):
            names, chunk, copies = (part.column(c).to_numpy() for c in ("class", "chunk", "copies"))
            blobs = part.column("grams").to_pylist()
            flat = np.frombuffer(b"".join(blobs), dtype=np.uint64)
            sizes = np.array([len(x) // 8 for x in blobs], dtype=np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            ids = np.unique(flat, return_inverse=True)[1]
            marks = np.zeros(len(flat), dtype=np.int64)
            bands = np.array(part.column("bands").to_pylist(), dtype=np.int64)
            links, root = np.zeros(len(names), dtype=np.int64), np.arange(len(names))
            rows = np.flatnonzero(chunk == left)
            for i in rows.tolist():
                marks[ids[at[i] : at[i + 1]]] = 1
                others = np.flatnonzero(chunk == right)
                others = others[others > i] if left == right else others
                size = sizes[others]
                others = others[np.minimum(size, sizes[i]) >= similarity * np.maximum(size, sizes[i])]
                if band:  # a pair that shares an earlier band is counted there
                    others = others[~(bands[others, :band] == bands[i, :band]).any(axis=1)]
                if len(others):
                    if 4 * len(others) > len(names):
                        shared = np.add.reduceat(marks[ids], at[:-1])[others]
                    else:
                        shared = np.array([marks[ids[at[k] : at[k + 1]]].sum() for k in others.tolist()])
                    near = others[shared >= similarity * (sizes[i] + sizes[others] - shared) - 1e-9]
                    if len(near):
                        links[i] += copies[near].sum()
                        links[near] += copies[i]
                        joined = np.unique(root[[i, *near.tolist()]])
                        root[np.isin(root, joined)] = joined.min()
                marks[ids[at[i] : at[i + 1]]] = 0
            linked = np.flatnonzero(links)
            if len(linked):
                # the smallest class that hangs together stands for all
                order = np.lexsort((names[linked], root[linked]))
                groups, begin, where = np.unique(root[linked][order], return_index=True, return_inverse=True)
                least = names[linked][order][begin][where]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[linked][order]), pa.array(links[linked][order]), pa.array(least)], names=["class", "links", "root"]
                )

    return verify


def near_join(docs: DataFrame, similarity: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, class_id, copy_of, n_links``.

    Needs ``doc_id`` and ``text``. ``copy_of`` is the smallest id with the same set of grams.
    ``n_links`` counts the other rows whose set has a Jaccard similarity of ``similarity`` or more,
    copies included. ``class_id`` is the smallest id that links lead to, directly or in steps; a
    document without links is its own class. A pair at the threshold is found with a chance of
    ``recall``, a closer one with a higher. Null and empty texts have no links. Rows that share an
    id count each and are copies if their texts are; if not, one of their texts (of the smallest
    digest) is compared for all. Null ids count as one id.
    """
    bands, rows = band_counts(similarity, recall)
    sketch = stage(sketches(docs, bands, rows).withColumn("doc", known("doc_id")).drop("doc_id"), "sketches")
    digest = ["size", "d1", "d2"]
    classes = sketch.where("size > 0").groupBy(*digest).agg(
        F.min("doc").alias("class"), F.count("*").alias("copies"), F.first("bands").alias("bands")
    )
    classes = stage(classes, "classes")

    placed = classes.select("class", "size", F.posexplode("bands").alias("band", "hash"))
    buckets = placed.groupBy("band", "hash").agg(
        F.count("*").alias("members"), F.sum("size").alias("grams"),
        F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64("class", F.lit(1)).cast("decimal(38,0)")).alias("s2"),
    ).where("members > 1")
    buckets = buckets.groupBy("members", "grams", "s1", "s2").agg(F.min(F.struct("band", "hash")).alias("bucket"))
    parts = F.ceil(F.greatest(F.col("grams") / CHUNK_GRAMS, F.col("members") / CHUNK_CLASSES)).cast("int")
    buckets = stage(buckets.select("bucket.*", parts.alias("parts")), "buckets")
    members = placed.join(buckets, ["band", "hash"]).select("band", "hash", "parts", "class")
    members = stage(members.withColumn("chunk", F.expr("cast(pmod(xxhash64(class, 2), parts) as int)")), "members")

    # sorted joins at every size: what is small here grows with the documents
    wanted = members.select(F.col("class").alias("doc_id")).distinct()
    own = narrowed(docs).select(known("doc_id").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id", "left_semi")
    sets = _sets(own).join(classes.select("class", "d1", "copies", "bands").hint("merge"), ["class", "d1"])
    sets = sets.groupBy("class").agg(F.min(F.struct("d1", "copies", "bands", "grams")).alias("one")).select("class", "one.*")
    sets = stage(sets.drop("d1"), "sets")

    tiles = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.select("hash", "class", "chunk", F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"), "band")
    tiles = tiles.join(sets.hint("merge"), "class").withColumn("key", F.xxhash64("band", "hash", "left", "right"))
    tiles = tiles.select("key", "hash", "left", "right", "band", "class", "chunk", "copies", "bands", "grams").repartition("key")
    linked = tiles.sortWithinPartitions("key", "hash", "left", "right", "band", "class").mapInArrow(_verify(similarity), LINKED)
    linked = stage(linked, "linked")

    links = linked.groupBy("class").agg(F.sum("links").alias("links"))
    hung = components(linked.select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = classes.select(*digest, "class", "copies").join(links, "class", "left").join(hung, F.col("class") == F.col("node"), "left")
    named = named.select(
        *digest, F.col("class").alias("first"), F.coalesce("component", "class").alias("component"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
    )
    out = sketch.select("doc", *digest).join(named, digest, "left")
    return out.select(
        unknown("doc").alias("doc_id"), unknown(F.coalesce("component", "doc")).alias("class_id"),
        unknown(F.coalesce("first", "doc")).alias("copy_of"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, similarity: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """``docs`` with the document of the smallest id of each class; a row that repeats id and text stays once."""
    found = near_join(docs, similarity, recall).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = found.select(known("doc_id").alias("_doc")).distinct()
    joined = docs.withColumn("_doc", known(F.col("doc_id").cast("long"))).withColumn("_text", F.xxhash64("text"))
    return joined.join(kept, "_doc", "left_semi").dropDuplicates(["_doc", "_text"]).select(*docs.columns)
