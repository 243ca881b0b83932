"""Word counts by month and the share of a word over time.

Counts are long tables ``(month, idx, count)``; ``idx`` is the position of a token in the
vocabulary ``(token, idx)``. Both may be as large as the text: a month in which a token does not
occur has no row, and the published series, dense by nature, are filled in from a token's few
months of use.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.text import count_tokens
from .numbering import numbered


def vocabulary(tokens: DataFrame) -> DataFrame:
    """``token, idx``: the distinct tokens of rows of ``token``, numbered from 0 in token order."""
    return numbered(tokens.select("token").distinct(), ["token"])


def in_counted_months(diffs: DataFrame) -> DataFrame:
    """Add ``month``; drop rows whose time does not parse or lies outside the counted months."""
    month = cal.month_key(F.try_to_timestamp(F.col("time").cast("string")))
    return diffs.withColumn("month", month).filter(cal.in_months(F.col("month")))


def keep_vocabulary(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows whose ``token`` is in the vocabulary, with its ``idx``.

    Count first where counts will do: then a very frequent token is one row here.
    """
    return tokens.join(vocab.select("token", "idx"), "token")


def month_token_count(diffs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Uses of each vocabulary token per month, from rows of ``time, words``.

    Counts are combined in the tasks that read the text, and made before the vocabulary is looked at:
    what meets a token there is one row per month, however frequent it is.
    """
    tokens = in_counted_months(diffs).select("month", F.explode(count_tokens(F.col("words"))).alias("token"))
    used = tokens.groupBy("month", "token").agg(F.count("*").alias("count"))
    return keep_vocabulary(used, vocab).select("month", "idx", "count")


def token_total(counts: DataFrame) -> DataFrame:
    return counts.groupBy("idx").agg(F.sum("count").alias("count"))


def _month_number(month: Column) -> Column:
    return (F.year(month) - F.year(F.lit(cal.FIRST_MONTH).cast("date"))) * 12 + F.month(month) - 1


def dense_matrix(counts: DataFrame, vocab: DataFrame, last: str = cal.LAST_COUNTED_MONTH) -> DataFrame:
    """``idx, counts``: a row per token of the vocabulary with its count in every month, zeros included.

    A token has at most one row for each month, so its months meet in one row.
    """
    kept = counts.filter(cal.in_months(F.col("month"), last=last) & (F.col("count") != 0))
    used = kept.groupBy("idx").agg(
        F.map_from_entries(F.collect_list(F.struct(_month_number(F.col("month")), F.col("count")))).alias("used")
    )
    months = F.transform(cal.month_sequence(last=last), lambda m, n: n)
    filled = F.transform(months, lambda n: F.coalesce(F.element_at("used", n), F.lit(0).cast("long")))
    return vocab.select("idx").join(used, "idx", "left").select("idx", filled.alias("counts"))


def dense_calendar(
    counts: DataFrame, vocab: DataFrame, last: str = cal.LAST_COUNTED_MONTH
) -> DataFrame:
    """A row for every month and token, zero where there is no count; unfolded from `dense_matrix`."""
    rows = dense_matrix(counts, vocab, last).select("idx", F.posexplode("counts").alias("n", "count"))
    return rows.select(F.add_months(F.lit(cal.FIRST_MONTH).cast("date"), F.col("n")).alias("month"), "idx", "count")


def _share(df: DataFrame, value: str, name: str) -> DataFrame:
    # One row per calendar month, so the totals are small whatever the vocabulary.
    totals = df.groupBy("month").agg(F.sum(value).alias("__total"))
    share = F.when(F.col("__total") == 0, F.lit(float("nan"))).otherwise(F.col(value) / F.col("__total"))
    return df.join(F.broadcast(totals), "month").withColumn(name, share).drop("__total")


def month_norm(counts: DataFrame, value: str = "count") -> DataFrame:
    """Share of each token in its month; NaN in a month without counts."""
    return _share(counts, value, "freq").select("month", "idx", "freq")


def cumulative_counts(counts: DataFrame) -> DataFrame:
    """Running count per token in each of its rows; a token has one row per month, so its window stays short."""
    so_far = W.partitionBy("idx").orderBy("month").rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.withColumn("cumul", F.sum("count").over(so_far))


class Series(NamedTuple):
    """Running counts as steps: a token's count stands from ``month`` until the month before ``until``."""

    steps: DataFrame  # idx, month, until, cumul
    totals: DataFrame  # month, total: running count of all tokens, a row for each published month


def running_series(counts: DataFrame, wanted: DataFrame | None = None) -> Series:
    """Steps of all tokens, or of those with an ``idx`` in ``wanted``; totals of all in any case."""
    published = counts.filter(cal.in_months(F.col("month"), last=cal.LAST_SERIES_MONTH) & (F.col("count") != 0))
    by_month = published.groupBy("month").agg(F.sum("count").alias("count"))
    calendar = counts.sparkSession.range(1).select(F.explode(cal.month_sequence()).alias("month"))
    # One row per calendar month, whatever the vocabulary.
    so_far = W.orderBy("month").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = calendar.join(by_month, "month", "left").select("month", F.coalesce(F.sum("count").over(so_far), F.lit(0)).alias("total"))
    if wanted is not None:
        published = published.join(wanted.select("idx").distinct(), "idx", "left_semi")
    end = F.add_months(F.lit(cal.LAST_SERIES_MONTH).cast("date"), 1)
    until = F.coalesce(F.lead("month").over(W.partitionBy("idx").orderBy("month")), end)
    return Series(cumulative_counts(published).select("idx", "month", until.alias("until"), "cumul"), totals)


def _freq(value: str) -> Column:
    return F.when(F.col("total") == 0, F.lit(float("nan"))).otherwise(F.col(value) / F.col("total"))


def frequency_steps(counts: DataFrame) -> DataFrame:
    """``month, idx, freq``: the published measure in the months in which a token is used."""
    series = running_series(counts)
    return series.steps.join(F.broadcast(series.totals), "month").select("month", "idx", _freq("cumul").alias("freq"))


def _filled(series: Series, tokens: DataFrame) -> DataFrame:
    """``month, idx, freq`` for every published month of the ``idx`` in ``tokens``."""
    first = series.steps.groupBy("idx").agg(F.min("month").alias("until"))
    start, end = (F.lit(d).cast("date") for d in (cal.FIRST_MONTH, cal.LAST_SERIES_MONTH))
    unused = tokens.select("idx").join(first, "idx", "left").select(
        "idx", start.alias("month"), F.coalesce("until", F.add_months(end, 1)).alias("until"), F.lit(0).cast("long").alias("cumul")
    )
    stretches = series.steps.unionByName(unused.filter("month < until"))
    months = F.sequence(F.col("month"), F.add_months(F.col("until"), -1), F.expr("interval 1 month"))
    rows = stretches.select("idx", "cumul", F.explode(months).alias("month"))
    return rows.join(F.broadcast(series.totals), "month").select("month", "idx", _freq("cumul").alias("freq"))


def cumulative_freq(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Published measure: running count of a token over that of all tokens, for 189 months.

    A row for every token of the vocabulary and month. `frequency_steps` has the same in the months
    in which something changes for a token, `token_series` for the tokens that are asked for.
    """
    wanted = vocab.select("idx").distinct()
    return _filled(running_series(counts.join(wanted, "idx", "left_semi")), wanted)


def _asked(vocab: DataFrame, requests: DataFrame) -> DataFrame:
    """``label, idx`` of the tokens asked for; ``idx`` is null for unknown ones."""
    labels = requests.select(F.explode(F.split("tokens", ",")).alias("label")).distinct()
    return labels.withColumn("token", F.lower("label")).join(vocab.select("token", "idx"), "token", "left").select("label", "idx")


def _labelled(asked: DataFrame, freqs: DataFrame) -> DataFrame:
    known = asked.filter("idx is not null").join(freqs.select("idx", "month", "freq"), "idx").select("label", "month", "freq")
    unknown = asked.filter("idx is null").select("label", F.explode(cal.month_sequence()).alias("month"), F.lit(0.0).alias("freq"))
    return known.unionByName(unknown).select(F.col("label").alias("token"), cal.month_date(F.col("month")).alias("date"), "freq")


def series_lookup(freqs: DataFrame, vocab: DataFrame, requests: DataFrame) -> DataFrame:
    """Series of the tokens asked for in rows of comma-separated ``tokens``, from a table of `cumulative_freq`.

    A token is looked up in lower case and labelled as it was asked for; an unknown one has zeros
    in all months.
    """
    return _labelled(_asked(vocab, requests), freqs)


def token_series(counts: DataFrame, vocab: DataFrame, requests: DataFrame) -> DataFrame:
    """As `series_lookup`, from counts: running counts are made of the tokens asked for only.

    ``counts`` are those of the vocabulary.
    """
    asked = _asked(vocab, requests)
    known = asked.filter("idx is not null").select("idx").distinct()
    return _labelled(asked, _filled(running_series(counts, known), known))


def series_pivot(series: DataFrame, tokens: list[str]) -> DataFrame:
    """One row per month, one column per token."""
    return series.groupBy("date").pivot("token", tokens).agg(F.first("freq"))


def series_extent(series: DataFrame) -> DataFrame:
    """Range of dates and values of a set of series."""
    return series.agg(
        F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        F.min("freq").alias("min_freq"), F.max("freq").alias("max_freq"),
    )


def per_million(series: DataFrame) -> DataFrame:
    return series.withColumn("freq", F.col("freq") * 1_000_000)


def vocab_lookup(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Counts with the token spelled out."""
    return counts.join(vocab.select("idx", "token"), "idx")
