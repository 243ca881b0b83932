"""Browsing history, as tables and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import visits as v
from ..operators import history as hist
from ..session import fresh_path
from ..sources import tables as tb
from ..streaming import views as st
from .catalog import query
from .derived import Inputs

SQL_RECENT = "select lang, timestamp, title from views order by timestamp desc, title, lang limit 100"
SQL_DECODED = "url_decode(replace(title, '+', '%2B'))"


@query("scan_view_events", "select url, timestamp from messages")
def _(i: Inputs):
    return tb.scan_view_events(i.spark, i.message_files)


@query("f_wiki_host", r"select url, timestamp from messages where regexp_matches(url, '^https?://[a-z]{2}\.wikipedia\.org')")
def _(i: Inputs):
    return hist.site_messages(i.messages)


@query("parse_view_url", "select url, timestamp, lang, path from parsed")
def _(i: Inputs):
    return hist.parse_view_url(i.messages)


@query(
    "view_fragment",
    """select path, case when starts_with(path, '#') then regexp_extract(path, '^([#]*)#(.*)', 1) else path end as title,
              split_part(path, '#', 1) as stripped from parsed""",
)
def _(i: Inputs):
    path = F.col("path")
    return hist.parse_view_url(i.messages).select(
        "path", v.view_fragment(path).alias("title"), v.view_fragment(path, strip_fragment=True).alias("stripped")
    )


@query("view_time", "select timestamp, strftime(make_timestamp(cast(timestamp as bigint) * 1000) + interval 5 hour, '%Y-%m-%d %H:%M') as time from views")
def _(i: Inputs):
    return i.views.select("timestamp", v.view_time(F.col("timestamp")).alias("time"))


@query("view_url", "select lang, title, 'https://' || lang || '.wikipedia.org/wiki/' || title as url from views")
def _(i: Inputs):
    return i.views.select("lang", "title", v.view_url(F.col("lang"), F.col("title")).alias("url"))


@query("percent_decode", f"select title, {SQL_DECODED} as out from views")
def _(i: Inputs):
    return i.views.select("title", v.percent_decode(F.col("title")).alias("out"))


@query(
    "recent_views",
    f"""select strftime(make_timestamp(cast(timestamp as bigint) * 1000) + interval 5 hour, '%Y-%m-%d %H:%M') as time,
               'https://' || lang || '.wikipedia.org/wiki/' || title as url, {SQL_DECODED} as title
        from newest_views""",
    newest_views=SQL_RECENT,
)
def _(i: Inputs):
    return hist.recent_views(i.views)


@query("seen_history", "select title, min(timestamp) as first_seen from views group by title")
def _(i: Inputs):
    return hist.seen_history(i.views)


@query("stream_views", "select lang, timestamp, title from views")
def _(i: Inputs):
    path = fresh_path(i.spark, "view")
    messages = tb.scan_view_events(i.spark, i.message_files, stream=True)
    st.stream_views(messages, path, fresh_path(i.spark, "view-state"), once=True).awaitTermination()
    return tb.scan_table(i.spark, path)


@query(
    "append_views",
    "select lang, timestamp, title from views union all select lang, timestamp, title from views",
)
def _(i: Inputs):
    # The same stream runs again after more messages have come in.
    arriving, path, state = (fresh_path(i.spark, name) for name in ("arriving", "view", "view-state"))
    for _ in range(2):
        i.messages.write.mode("append").json(arriving)
        messages = tb.scan_view_events(i.spark, arriving, stream=True)
        st.stream_views(messages, path, state, once=True).awaitTermination()
    return tb.scan_table(i.spark, path)


@query("stream_recent_views", SQL_RECENT)
def _(i: Inputs):
    path = fresh_path(i.spark, "recent")
    reader = i.spark.readStream.schema(tb.VISIT_SCHEMA).option("maxFilesPerTrigger", 1)
    st.stream_recent_views(reader.json(i.message_files), path, fresh_path(i.spark, "recent-state"), once=True).awaitTermination()
    return st.read_recent(i.spark, path)
