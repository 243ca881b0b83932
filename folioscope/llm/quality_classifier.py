"""A quality classifier: how well a model of trusted text predicts a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from ..session import stage
from .language_model import judged, surprise

#: Quartile distances above the upper quartile of a language beyond which its limit never lies.
REACH = 6.0
#: Quantile of a language's spared texts where its limit lies.
LIMIT = 0.99
#: Quartile distances that the limit lies above the quantile of one text; the root of the number of texts divides it.
ROOM = 8.0
#: One in so many trusted documents sets the limit and does not teach.
SPARED = 5


def trusted_ids(labels: DataFrame, most: int | None = None) -> DataFrame:
    """``doc_id`` of documents labelled good and not toxic: all of them, or about ``most`` by a hash of the id."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    if most is not None and (n := good.count()) > most:
        good = good.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return good


def classify(docs: DataFrame, labels: DataFrame, reach: float = REACH, most_trusted: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, lang, n_units, perplexity, high, kept``.

    The model (interpolated modified Kneser-Ney) learns from the documents labelled good and not
    toxic, each language for itself, but for one in ``SPARED`` of them, by a hash of the id. These
    alone set ``high``, the language's limit: the quantile ``LIMIT`` of their levels, with ``ROOM`` quartile
    distances by the root of their number for what few texts can't tell, and no more than
    ``reach`` quartile distances above their upper quartile. So it does not depend on how much bad text there is. ``kept``
    is false above it. Documents of a language without text to teach have no perplexity and are
    kept, as are those of a language without a limit. Null texts are
    empty and null languages one language; repeated rows give a row each; repeated labels count once.
    """
    trusted = stage(trusted_ids(labels, most_trusted).withColumn("spared", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(SPARED)) == 0), "trusted")
    scored = stage(surprise(docs, taught=trusted.where("not spared").select("doc_id")), "scored")
    spared = trusted.where("spared").select(F.col("doc_id").alias("_spared"))
    marked = scored.join(broadcast_if_small(spared), F.col("doc_id") == F.col("_spared"), "left")
    rows = judged(marked, F.col("_spared").isNotNull(), reach, (0.0, LIMIT), room=ROOM)
    return rows.select("doc_id", "lang", "n_units", "perplexity", "high", F.col("below").alias("kept"))
