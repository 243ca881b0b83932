"""Word counts by month and word series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text as tx
from ..operators import ngrams as ng
from ..session import fresh_path
from ..sources import sinks
from ..sources import tables as tb
from .catalog import query
from .derived import SERIES_TOKENS, Inputs

WIDE = ", ".join(f"max(case when token = '{t}' then freq end) as {{}}".replace("{}", f'"{t}"') for t in SERIES_TOKENS)
SERIES_PARTS = {"labels_asked": "select unnest([{}]) as label".format(", ".join(f"'{t}'" for t in SERIES_TOKENS))}


def picked_series(i: Inputs):
    request = i.spark.createDataFrame([(",".join(SERIES_TOKENS),)], "tokens STRING")
    return ng.token_series(i.counts, i.vocab, request)


def day(df):
    return df.withColumn("month", cal.month_date(F.col("month")))


@query("scan_diffs", "select time, words from diffs")
def _(i: Inputs):
    path = fresh_path(i.spark, "diffs")
    blank = F.lit("x")
    i.diffs.select(
        blank.alias("c0"), blank.alias("c1"), "time", blank.alias("c3"), blank.alias("c4"),
        "words",
    ).write.csv(path, escape='"')
    return tb.scan_diffs(i.spark, path)


@query("scan_vocab", "select token, idx from vocab")
def _(i: Inputs):
    path = fresh_path(i.spark, "vocab")
    # Files in order of their names, rows in order in each.
    i.vocab.orderBy("idx").select(F.col("token").alias("index"), F.lit(1).alias("n")).write.csv(path, header=True, escape='"')
    return tb.scan_vocab(i.spark, path)


@query("scan_month_counts", "select strftime(month, '%Y-%m-%d') as month, idx, count from counts")
def _(i: Inputs):
    path = fresh_path(i.spark, "month-csv")
    sinks.write_month_counts(i.counts, i.vocab, path, csv=True)
    return day(tb.scan_month_counts(i.spark, f"{path}/freq"))


@query(
    "write_month_counts",
    """select strftime(month, '%Y-%m-%d') as month, count(*) as tokens, count(*) filter (count > 0) as used,
              cast(sum(count) as bigint) as total, cast(sum(idx * count) as bigint) as weighted from dense group by month""",
)
def _(i: Inputs):
    path = fresh_path(i.spark, "month-counts")
    sinks.write_month_counts(ng.dense_calendar(i.counts, i.vocab), i.vocab, path)
    stored = day(tb.scan_table(i.spark, f"{path}/freq"))
    return stored.groupBy("month").agg(
        F.count("*").alias("tokens"), F.count_if(F.col("count") > 0).alias("used"), F.sum("count").alias("total"),
        F.sum(F.col("idx") * F.col("count")).alias("weighted"),
    )


@query(
    "f_month_range",
    """select time, md5(words) as words from diffs
       where cast(time as timestamp) >= timestamp '2001-01-01' and cast(time as timestamp) < timestamp '2017-01-01'""",
)
def _(i: Inputs):
    return ng.in_counted_months(i.diffs).select("time", F.md5("words").alias("words"))


@query("f_vocab", "select token, idx, count(*) as n from spoken join vocab using (token) group by all")
def _(i: Inputs):
    tokens = i.diffs.select(F.explode(tx.count_tokens(F.col("words"))).alias("token"))
    return ng.keep_vocabulary(tokens.groupBy("token").agg(F.count("*").alias("n")), i.vocab).select("token", "idx", "n")


@query("month_token_count", "select strftime(month, '%Y-%m-%d') as month, idx, count from counts")
def _(i: Inputs):
    return day(ng.month_token_count(i.diffs, i.vocab))


@query("join_vocab_lookup", "select strftime(month, '%Y-%m-%d') as month, token, count from counts join vocab using (idx)")
def _(i: Inputs):
    return day(ng.vocab_lookup(i.counts, i.vocab)).select("month", "token", "count")


@query(
    "dense_calendar",
    "select idx, count(*) as months, md5(string_agg(cast(count as varchar), ',' order by month)) as counts from dense group by idx",
)
def _(i: Inputs):
    matrix = ng.dense_matrix(i.counts, i.vocab)
    return matrix.select("idx", F.size("counts").cast("long").alias("months"), F.md5(F.array_join("counts", ",")).alias("counts"))


@query("token_total", "select idx, cast(sum(count) as bigint) as count from counts group by idx")
def _(i: Inputs):
    return ng.token_total(i.counts)


@query("month_norm", "select strftime(month, '%Y-%m-%d') as month, idx, count / sum(count) over (partition by month) as freq from counts")
def _(i: Inputs):
    return day(ng.month_norm(i.counts))


@query("cumulative_counts", "select strftime(month, '%Y-%m-%d') as month, idx, count, cumul from cumul")
def _(i: Inputs):
    return day(ng.cumulative_counts(i.counts.filter(cal.in_months(F.col("month"), last=cal.LAST_SERIES_MONTH))))


@query("cumulative_freq", "select strftime(month, '%Y-%m-%d') as month, idx, freq from freqs")
def _(i: Inputs):
    return day(ng.frequency_steps(i.counts))


@query("series_lookup", "select token, date, freq from series")
def _(i: Inputs):
    return ng.token_series(i.counts, i.vocab, i.requests)


@query("series_pivot", f"select date, {WIDE} from series group by date", **SERIES_PARTS)
def _(i: Inputs):
    return ng.series_pivot(picked_series(i), SERIES_TOKENS)


@query(
    "export_series_csv",
    "select date, {} from series group by date".format(
        ", ".join(f"printf('%.15f', max(case when token = '{t}' then freq end)) as \"{t}\"" for t in SERIES_TOKENS)
    ),
    **SERIES_PARTS,
)
def _(i: Inputs):
    path = fresh_path(i.spark, "series-csv")
    sinks.export_series_csv(picked_series(i), SERIES_TOKENS, path)
    schema = ", ".join(f"`{c}` STRING" for c in ["date", *SERIES_TOKENS])
    return i.spark.read.schema(schema).csv(path, header=True)


@query(
    "series_extent",
    "select min(date) as min_date, max(date) as max_date, min(freq) as min_freq, max(freq) as max_freq from series",
)
def _(i: Inputs):
    return ng.series_extent(ng.token_series(i.counts, i.vocab, i.requests))


@query("per_million", "select token, date, freq * 1000000 as freq from series")
def _(i: Inputs):
    return ng.per_million(ng.token_series(i.counts, i.vocab, i.requests))


@query(
    "month_key",
    """select time, strftime(cast(time as timestamp), '%Y-%m-01') as date,
              year(cast(time as timestamp)) || '_' || month(cast(time as timestamp)) as label from diffs""",
)
def _(i: Inputs):
    month = cal.month_key(F.to_timestamp("time"))
    return i.diffs.select("time", cal.month_date(month).alias("date"), cal.month_label(month).alias("label"))


@query(
    "month_sequence",
    """select strftime(m.month, '%Y-%m-%d') as month, count(d.time) as edits
       from (select * from all_months where month <= date '2016-09-01') m
       left join diffs d on cast(date_trunc('month', cast(d.time as timestamp)) as date) = m.month group by m.month""",
)
def _(i: Inputs):
    months = i.spark.range(1).select(F.explode(cal.month_sequence()).alias("month"))
    edits = i.diffs.groupBy(cal.month_key(F.to_timestamp("time")).alias("month")).agg(F.count("*").alias("edits"))
    return day(months.join(edits, "month", "left")).select("month", F.coalesce("edits", F.lit(0)).alias("edits"))
