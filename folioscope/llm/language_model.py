"""Perplexity under a modified Kneser-Ney model, counted and looked up in shards.

The model predicts characters (UTF-16 units of the lower-cased text, white space as single
blanks) from the three before them, one model for each language. A 4-gram is its own 64-bit hash,
so the lower orders are its low bits and no dictionary of symbols is needed.

1. Each task packs its documents into blocks and asks: the sorted distinct 4-grams of a block, by
   language, with their counts, dealt to shards by a hash. What travels follows the input.
2. A shard merges its questions. The distinct grams of all shards make a table on which counts of
   all orders, discounts and probabilities are worked out with joins.
3. The model is stored as sorted hash arrays, one pair of arrays for each shard and language. Each
   shard answers its questions from its own arrays by binary search.
4. The documents are read a second time, meet the answers for their block and get their scores.

With ``teaches`` there are two models for each language. A text teaches one of them, by a hash of
the text, and is scored by the other, so that neither its own counts nor those of a copy of it
are in its score.

No task or broadcast holds the whole model, and a hot language or text is split over blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from ..session import stage
from .blocks import ASKED, BODY, LONG, blocks_of, check_seals, meeting, opened, packed, sealed, shards_for, unpacked
from .common import consecutive, mixed

ORDER = 4
START, END = 2, 3
#: Added to the count of a gram for each time it is asked for, while a block is merged.
ASKED_FOR = 2**40


def units(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-16-le", "surrogatepass")


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams that predict each unit and the end of each text, and how many each text has."""
    start, end = START.to_bytes(2, "little") * (ORDER - 1), END.to_bytes(2, "little")
    coded = [units(t) for t in texts]
    sizes = np.array([len(c) // 2 + 1 for c in coded], dtype=np.int64)
    flat = np.frombuffer(b"".join(x for c in coded for x in (start, c, end)), dtype="<u2").astype(LONG)
    keys = (flat[:-3] << LONG(48)) | (flat[1:-2] << LONG(32)) | (flat[2:-1] << LONG(16)) | flat[3:]
    keep = np.ones(len(keys), dtype=bool)
    keep[(np.cumsum(sizes + ORDER - 1)[:-1, None] - np.arange(1, ORDER)).ravel()] = False  # those across two texts
    return keys[keep], sizes


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.int64)


def _model(lang: str, half: int) -> str:
    """The name of the model taught by one half of a language's texts; -1: by all."""
    return lang if half < 0 else f"{lang}\n{half}"


def _ask(shards: int, teaches: Callable[[list[str]], np.ndarray] | None):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seal = {}, 0
        for block, last, rows in blocks_of(batches):
            seal = sealed(seal, rows)
            texts, langs = rows.column(1).to_pylist(), np.array(rows.column(2).to_pylist(), dtype=object)
            train, halves = (rows.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            if teaches:
                train = train & teaches(texts)
            for lang, half, taught in sorted(set(zip(langs.tolist(), halves.tolist(), train.tolist(), strict=True))):
                own = np.flatnonzero((langs == lang) & (halves == half) & (train == taught)).tolist()
                keys, counts = np.unique(grams_of([texts[i] for i in own])[0], return_counts=True)
                taught_to, asked_of = _model(lang, half), _model(lang, half if half < 0 else 1 - half)
                held.setdefault(asked_of, []).append((keys, np.full(len(keys), ASKED_FOR)))
                if taught:
                    held.setdefault(taught_to, []).append((keys, counts))
            for lang in held:
                if len(held[lang]) > 8 or last:
                    held[lang] = [_merge(held[lang])]
            if last:
                for lang, [(keys, counts)] in held.items():
                    counts = counts % ASKED_FOR * 2 + (counts >= ASKED_FOR)
                    place = (mixed(keys) % LONG(shards)).astype(np.int64)
                    for shard in np.unique(place).tolist():
                        pick = place == shard
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([shard], pa.int32()), pa.array([lang]), pa.array([block]), pa.array([seal]),
                                pa.array([packed(keys[pick])], pa.binary()), pa.array([counts[pick].astype("<i4").tobytes()], pa.binary()),
                            ],
                            names=["shard", "lang", "block", "seal", "keys", "counts"],
                        )
                held, seal = {}, 0

    return ask


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (shard, lang), part in consecutive(batches, 2):
        counts = [np.frombuffer(c, dtype="<i4") // 2 for c in part.column("counts").to_pylist()]
        keys, total = _merge([(unpacked(k, len(c)), c) for k, c in zip(part.column("keys").to_pylist(), counts, strict=True)])
        n = len(keys)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, shard, dtype=np.int32)), pa.array([lang] * n, pa.string()), pa.array(keys.view(np.int64)), pa.array(total)],
            names=["shard", "lang", "key", "n"],
        )


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (shard, lang), part in consecutive(batches, 2):
        keys, logs = part.column("key").to_numpy().view(LONG), part.column("log").to_numpy().astype("<f4")
        order = np.argsort(keys)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int32()), pa.array([lang], pa.string()), pa.array([-1], pa.int64()), pa.array([0], pa.int64()),
                pa.array([packed(keys[order])], pa.binary()), pa.array([logs[order].tobytes()], pa.binary()),
            ],
            names=["shard", "lang", "block", "seal", "keys", "counts"],
        )


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (_, lang), part in consecutive(batches, 2):
        keys = logs = np.zeros(0, dtype=LONG)
        columns = [part.column(c).to_pylist() for c in ("block", "seal", "keys", "counts")]
        for block, seal, asked, values in zip(*columns, strict=True):
            if block < 0:
                logs = np.frombuffer(values, dtype="<f4")
                keys = unpacked(asked, len(logs))
                continue
            wanted = unpacked(asked, len(values) // 4)[np.frombuffer(values, dtype="<i4") % 2 > 0]
            found = logs[np.searchsorted(keys, wanted)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([0], pa.int32()), pa.array([seal]), pa.array([lang], pa.string()), pa.array([packed(wanted)], pa.binary()), pa.array([found.tobytes()], pa.binary())],
                names=["block", "kind", "seal", "lang", "keys", "body"],
            )


def _score(features: Callable[[list[str]], list[pa.Array]] | None, names: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in consecutive(batches, 1):
            model: dict[str, list] = {}
            kinds, langs, keys, bodies, marks = (part.column(c).to_pylist() for c in ("kind", "lang", "keys", "body", "seal"))
            for kind, lang, asked, body in zip(kinds, langs, keys, bodies, strict=True):
                if kind == 0:
                    logs = np.frombuffer(body, dtype="<f4")
                    model.setdefault(lang, []).append((unpacked(asked, len(logs)), logs))
            check_seals(kinds, marks)
            for lang, own in model.items():
                known, logs = (np.concatenate(x) for x in zip(*own, strict=True))
                order = np.argsort(known)
                model[lang] = (known[order], logs[order])
            for kind, body in zip(kinds, bodies, strict=True):
                if kind == 0:
                    continue
                rows = opened(body)
                texts, halves = rows.column(1).to_pylist(), rows.column(4).to_pylist()
                own = np.array([_model(x, h if h < 0 else 1 - h) for x, h in zip(rows.column(2).to_pylist(), halves, strict=True)], dtype=object)
                total, count = np.full(len(texts), np.nan), np.zeros(len(texts), dtype=np.int64)
                for lang in set(own.tolist()):
                    at = np.flatnonzero(own == lang)
                    grams, sizes = grams_of([texts[i] for i in at.tolist()])
                    known, logs = model[lang]
                    found = -logs[np.searchsorted(known, grams)].astype(np.float64)
                    total[at] = np.add.reduceat(found, np.cumsum(sizes) - sizes)
                    count[at] = sizes
                more = features(texts) if features else []
                columns = [rows.column(0), rows.column(2), pa.array(count), pa.array(total, from_pandas=True), *more]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "n_units", "surprise", *names])

    return score


def _probabilities(grams: DataFrame) -> DataFrame:
    """``shard, lang, key, log`` from ``shard, lang, key, n``; ``n`` is 0 for grams that were only asked for.

    The counts of an order below the highest are the numbers of different units seen before a gram.
    Where a language has no counts at all, ``log`` is NaN.
    """
    lower, levels = grams.select("lang", F.col("key").alias("gram"), "n"), {}
    for order in range(ORDER, 0, -1):
        levels[order] = lower if order == ORDER else stage(lower, f"order-{order}")
        cut = F.col("gram").bitwiseAND((1 << 16 * (order - 1)) - 1)
        lower = levels[order].groupBy("lang", cut.alias("gram")).agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("n"))
    below = None
    for order in range(1, ORDER + 1):
        level = levels[order].withColumn("context", F.shiftrightunsigned("gram", 16) if order > 1 else F.lit(0).cast("long"))
        of = {k: F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)}
        seen = F.sum(F.when(F.col("n") > 0, 1).otherwise(0))
        d = level.groupBy("lang").agg(*of.values(), seen.alias("types"))
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        cuts = [
            F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), F.coalesce(k - (k + 1) * y * F.col(f"n{k + 1}") / F.when(F.col(f"n{k}") > 0, F.col(f"n{k}")), F.lit(k / 2))))
            for k in (1, 2, 3)
        ]
        d = d.select("lang", "types", *(c.alias(f"d{k}") for k, c in zip((1, 2, 3), cuts, strict=True)))
        d = broadcast_if_small(stage(d, f"discounts-{order}"))  # a row for each model
        more = F.sum(F.when(F.col("n") >= 3, 1).otherwise(0)).alias("n3")
        contexts = level.groupBy("lang", "context").agg(F.sum("n").alias("total"), of[1], of[2], more).where("total > 0").join(d, "lang")
        rest = (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total")
        contexts = contexts.select("lang", "context", "total", "d1", "d2", "d3", "types", rest.alias("rest"))
        joined = level.join(contexts, ["lang", "context"], "left")
        if below is None:
            joined = joined.withColumn("less", 1 / (F.col("types") + 1))
        else:
            suffix = F.col("gram").bitwiseAND((1 << 16 * (order - 1)) - 1)
            joined = joined.withColumn("suffix", suffix).join(below, ["lang", "suffix"], "left")
        off = F.when(F.col("n") == 0, 0).when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        p = F.when(F.col("total").isNull(), F.col("less")).otherwise((F.col("n") - off) / F.col("total") + F.col("rest") * F.col("less"))
        below = joined.select("lang", F.col("gram").alias("suffix"), p.alias("less"))
    logs = below.select("lang", F.col("suffix").alias("key"), F.coalesce(F.log("less"), F.lit(float("nan"))).alias("log"))
    return grams.select("shard", "lang", "key").join(logs, ["lang", "key"]).select("shard", "lang", "key", "log")


def surprise(
    docs: DataFrame, features: Callable[[list[str]], list[pa.Array]] | None = None, schema: str = "", taught: DataFrame | None = None,
    teaches: Callable[[list[str]], np.ndarray] | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, lang, n_units, surprise`` and the columns of ``features``.

    ``docs`` has ``doc_id, text, lang`` (null text and null lang: empty); ``surprise`` is the sum of
    the negative natural logarithms of the probabilities of the text's ``n_units`` units, its end
    included, so that ``exp(surprise / n_units)`` is the perplexity; null for a language that
    taught the model nothing. The model learns from all rows, or from those whose ``doc_id`` is
    in ``taught`` (one column of distinct ids, which are broadcast, as a join that moves the documents would
    change their order). ``features``
    gives further columns, described by ``schema``, from a list of texts.

    ``teaches`` tells which of a list of texts the model may learn from, and has each text scored
    by a model that neither it nor an equal text has taught.

    ``docs`` is read twice and has to come in the same order both times, as a scan of files does;
    otherwise the job fails and says so, and the caller stages the documents first.
    """
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
    )
    half = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(2)).cast("int") if teaches else F.lit(-1)
    if taught is None:
        asking = given.withColumn("train", F.lit(True)).withColumn("half", half)
    else:
        chosen = taught.select(F.col(taught.columns[0]).alias("t"))
        asking = given.join(F.broadcast(chosen), F.col("doc_id") == F.col("t"), "left").select("doc_id", "text", "lang", F.col("t").isNotNull().alias("train"), half.alias("half"))
    shards = shards_for(given)
    asked = stage(asking.mapInArrow(_ask(shards, teaches), ASKED), "asked")
    by = ["shard", "lang"]
    grams = asked.select("shard", "lang", "keys", "counts").repartition("shard").sortWithinPartitions(*by)
    grams = stage(grams.mapInArrow(_count, "shard int, lang string, key long, n long"), "grams")
    logs = _probabilities(grams).repartition("shard").sortWithinPartitions(*by)
    model = stage(logs.mapInArrow(_store, ASKED), "model")
    sides = asked.unionByName(model).repartition("shard").sortWithinPartitions(*by, "block")
    answers = sides.mapInArrow(_answer, BODY)
    again = given.withColumn("train", F.lit(False)).withColumn("half", half)  # the same columns, so that the batches are cut alike
    both = meeting(again, answers)
    out = "doc_id long, lang string, n_units long, surprise double" + (f", {schema}" if schema else "")
    names = [c.split()[0] for c in schema.split(", ")] if schema else []
    return both.mapInArrow(_score(features, names), out)


def _quantiles(scored: DataFrame, value: str, shares: dict[str, float], step: float = 0.002) -> DataFrame:
    """``lang, n_texts`` and quantiles of ``value`` by language, named as in ``shares``.

    Equal texts count once, so that copies cannot draw the quantiles together: rows of equal
    ``lang, n_units, value`` are one. The quantiles are those of values rounded down to ``step``;
    what is sorted is one row for each step in use, not for each document.
    """
    bins = scored.where(F.col(value).isNotNull()).groupBy("lang", "n_units", value).agg(F.lit(1).alias("one"))
    bins = bins.groupBy("lang", F.floor(F.col(value) / step).alias("bin")).agg(F.count("*").alias("n"))
    share = F.sum("n").over(W.partitionBy("lang").orderBy("bin")) / F.sum("n").over(W.partitionBy("lang"))
    at = [(F.min(F.when(F.col("share") >= q, F.col("bin"))) * step).alias(name) for name, q in shares.items()]
    return bins.withColumn("share", share).groupBy("lang").agg(F.sum("n").alias("n_texts"), *at)


def fences(scored: DataFrame, reach: float, step: float = 0.002) -> DataFrame:
    """``lang, middle, wide, low, high``: quartiles of ``level`` by language, carried outwards.

    ``wide`` is the quartile distance (0.05 at least); ``low`` and ``high`` lie ``reach`` of it outside the quartiles.
    """
    three = _quantiles(scored, "level", {"q1": 0.25, "middle": 0.5, "q3": 0.75}, step)
    wide = F.greatest(F.col("q3") - F.col("q1"), F.lit(0.05))
    return three.select("lang", "middle", wide.alias("wide"), (F.col("q1") - reach * wide).alias("low"), (F.col("q3") + step + reach * wide).alias("high"))


def judged(scored: DataFrame, counted, reach: float, band: tuple[float, float], short: int = 50, room: float = 0.0, step: float = 0.002) -> DataFrame:
    """Adds ``perplexity``, ``low``, ``high`` (perplexities), ``inside`` and ``below``.

    ``counted`` says which rows set the band of a language. It goes from one quantile to the
    other of ``band``, and no farther than the `fences`. What few texts tell of a quantile is uncertain, so
    that each end lies ``room`` quartile distances, divided by the root of the number of counted texts, further
    out. A text of n units is drawn
    towards its language's median as if it had ``short`` units more of that level, for the
    quantiles as for the verdict: short texts scatter more, and so are given more room. A row
    without a perplexity, or of a language without fences, is inside.

    Both tables of limits have a row for each language and are staged; they are broadcast if a count shows that they are small.
    """
    levelled = scored.withColumn("level", F.col("surprise") / F.col("n_units"))
    marks = broadcast_if_small(stage(fences(levelled.where(counted), reach), "fences"))
    drawn = F.col("middle") + (F.col("level") - F.col("middle")) * F.col("n_units") / (F.col("n_units") + short)
    joined = levelled.join(marks, "lang", "left").withColumn("drawn", drawn)
    ends = _quantiles(joined.where(counted), "drawn", {"first": band[0], "last": band[1]}, step)
    ends = broadcast_if_small(stage(ends, "ends"))
    joined = joined.join(ends, "lang", "left")
    further = room * F.col("wide") / F.sqrt("n_texts")
    low, high = F.greatest("low", F.col("first") - further), F.least("high", F.col("last") + step + further)
    return joined.select(
        *scored.columns, F.exp("level").alias("perplexity"), F.exp(low).alias("low"), F.exp(high).alias("high"),
        F.coalesce(F.col("drawn").between(low, high), F.lit(True)).alias("inside"),
        F.coalesce(F.col("drawn") <= high, F.lit(True)).alias("below"),
    )
