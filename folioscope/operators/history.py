"""Browsing history: visit messages to views, and reports over views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import visits as v

RECENT = 100  # Fixed value: views on the history page.


def site_messages(messages: DataFrame) -> DataFrame:
    """Messages from the encyclopedia's hosts; what the browser side sends on."""
    return messages.filter(v.is_site_host(F.col("url")))


def parse_view_url(messages: DataFrame) -> DataFrame:
    """Add ``lang`` and ``path``; messages whose address is no page are dropped."""
    url = F.col("url")
    return messages.filter(v.is_page_address(url)).withColumns(
        {"lang": v.address_lang(url), "path": v.address_path(url)}
    )


def view_rows(messages: DataFrame, strip_fragment: bool = False) -> DataFrame:
    """``view`` rows ``lang, timestamp, title`` of visit messages; batch or stream."""
    return parse_view_url(site_messages(messages)).select(
        "lang", "timestamp", v.view_fragment(F.col("path"), strip_fragment).alias("title")
    )


def newest(views: DataFrame, n: int = RECENT) -> DataFrame:
    return views.orderBy(F.desc("timestamp"), "title", "lang").limit(n)


def recent_views(views: DataFrame, n: int = RECENT, utc_offset: int = v.DEFAULT_UTC_OFFSET) -> DataFrame:
    """Newest views as shown: time, address and decoded title."""
    return newest(views, n).select(
        v.view_time(F.col("timestamp"), utc_offset).alias("time"),
        v.view_url(F.col("lang"), F.col("title")).alias("url"),
        v.percent_decode(F.col("title")).alias("title"),
    )


def seen_history(views: DataFrame) -> DataFrame:
    """Each title once, with the time it was first seen; latest first."""
    return views.groupBy("title").agg(F.min("timestamp").alias("first_seen")).orderBy(F.desc("first_seen"), "title")
