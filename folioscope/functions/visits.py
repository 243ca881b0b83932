"""Page-visit addresses and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The address patterns of page visits and the address a title is shown with.
HOST = r"^https?://[a-z]{2}\.wikipedia\.org"
ADDRESS = r"(?d)^https?://([a-z]{2}).wikipedia.org/wiki/(.*)"
SITE = ".wikipedia.org/wiki/"
DEFAULT_UTC_OFFSET = -5


def is_site_host(url: Column) -> Column:
    return F.rlike(url, F.lit(HOST))


def is_page_address(url: Column) -> Column:
    return F.rlike(url, F.lit(ADDRESS))


def address_lang(url: Column) -> Column:
    return F.regexp_extract(url, ADDRESS, 1)


def address_path(url: Column) -> Column:
    return F.regexp_extract(url, ADDRESS, 2)


def view_fragment(path: Column, strip_fragment: bool = False) -> Column:
    """Title part of a path.

    By default only a path that starts with ``#`` is cut, at the last ``#`` of that leading run;
    ``strip_fragment`` cuts any path at its first ``#``.
    """
    if strip_fragment:
        return F.substring_index(path, "#", 1)
    return F.when(F.startswith(path, F.lit("#")), F.regexp_extract(path, "^(#*)#", 1)).otherwise(path)


def percent_decode(text: Column) -> Column:
    """``%XX`` decoded; ``+`` and malformed escapes stay as they are."""
    kept = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(kept)


def view_time(epoch_ms: Column, utc_offset: int = DEFAULT_UTC_OFFSET) -> Column:
    """``2024-01-31 09:05`` for a time in epoch milliseconds; the offset in hours is subtracted."""
    zero = F.lit(0)
    past = F.make_dt_interval(zero, zero, zero, epoch_ms / 1000 - F.lit(3600 * utc_offset))
    return F.date_format(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + past, "yyyy-MM-dd HH:mm")


def view_url(lang: Column, title: Column) -> Column:
    return F.concat(F.lit("https://"), lang, F.lit(SITE), title)
