"""Quality rules: counts of words, symbols and repetition, and a perplexity band for each language."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import WORD, known, mixed, text_key
from .language_model import judged, surprise

SYMBOLS = "#*$%&|<>"
WINDOW = 5
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Quantiles of a language's levels where its band begins and ends.
BAND = (0.005, 0.99)
#: Quartile distances from the quartiles beyond which the band never reaches.
REACH = 6.0
#: A text with more symbols a word does not teach the model.
TAUGHT_SYMBOLS = 0.1


def repeated_words(words: list[str]) -> int:
    """Words inside the 5-word windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    if len(number) > len(words) - WINDOW:
        return 0
    windows = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            windows = mixed(windows * np.uint64(0x9E3779B97F4A7C15) + ids[k : n + k] + np.uint64(1))
    where, counts = np.unique(windows, return_inverse=True, return_counts=True)[1:]
    again = counts[where] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(WINDOW):
        covered[k : n + k] |= again
    return int(covered.sum())


def features(texts: list[str]) -> list[pa.Array]:
    rows = []
    for text in texts:
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        symbols = sum(map(text.count, SYMBOLS))
        rows.append((len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeated_words(words)))
    return [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]


def teaches(texts: list[str]) -> np.ndarray:
    """Which texts pass the base rules and hold few symbols."""
    n_words, _, n_symbols, _, n_repeat = (c.to_numpy() for c in features(texts))
    return (n_words >= 10) & (100 * n_repeat <= 20 * n_words) & (n_symbols <= TAUGHT_SYMBOLS * n_words)


def _hashed(texts: list[str]) -> list[pa.Array]:
    """`features`, and the hash that `text_key` makes of a text."""
    hashes = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 42) for t in texts], dtype=np.uint64)
    return [*features(texts), pa.array(hashes.view(np.int64))]


def quality(docs: DataFrame, reach: float = REACH) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id, text, lang``), with counts, perplexity and verdict.

    ``base_failed``: fewer than 10 words, or more than a fifth of the words in repeated 5-word
    windows. ``kept``: not base_failed, and the perplexity lies in the band ``low`` to ``high`` of
    its language: the quantiles ``BAND`` of the texts that may teach, but no farther than ``reach``
    quartile distances outside their quartiles. Texts that pass the base rules and hold few symbols
    teach the model; none is scored by a model that it or an equal text has taught. A null text is empty and so fails; null languages
    are one language; repeated rows give a row each and set the band once.
    """
    return _quality(docs, reach, features, FEATURES)


def _quality(docs: DataFrame, reach: float, measure: Callable[[list[str]], list[pa.Array]], names: tuple[str, ...]) -> DataFrame:
    scored = surprise(docs, measure, ", ".join(f"{name} long" for name in names), teaches=teaches)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = stage(scored.withColumn("base_failed", failed), "scored")
    clean = ~F.col("base_failed") & (F.col("n_symbols") <= TAUGHT_SYMBOLS * F.col("n_words"))
    rows = judged(scored, clean, reach, BAND)
    return rows.select(
        "doc_id", *names, "base_failed", (~F.col("base_failed") & F.col("inside")).alias("kept"), "lang", "perplexity", "low", "high"
    )


def good_documents(docs: DataFrame, reach: float = REACH) -> DataFrame:
    """The documents that the rules keep, all columns as they are.

    Rows that share an id, or have none, are kept or rejected each by its own text and language.
    """
    rows = _quality(docs, reach, _hashed, (*FEATURES, "text_hash")).where("kept")
    kept = rows.select(F.struct(known("doc_id"), F.col("text_hash"), "lang").alias("_row")).distinct()
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    row = F.struct(known(F.col("doc_id").cast("long")), text_key(), lang)
    return docs.withColumn("_row", row).join(kept, "_row", "left_semi").select(*docs.columns)
