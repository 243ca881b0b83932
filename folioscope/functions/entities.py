"""Entity decoding, the only step that needs Python."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _decoder(pattern: str | None):
    """A column function; defined here so that it travels to the executors by value."""

    def decode(texts: pd.Series) -> pd.Series:
        if pattern is None:
            return texts.map(html.unescape, na_action="ignore")
        found = re.compile(pattern)
        return texts.map(lambda t: found.sub(lambda m: html.unescape(m[0]), t), na_action="ignore")

    return F.pandas_udf(decode, T.StringType())


_decode = _decoder(None)
_decode_closed = _decoder(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[0-9A-Za-z]+);")


def _only_with_ampersand(decode, text: Column) -> Column:
    # Rows without "&" reach Python as nulls, so their text is not shipped.
    return F.coalesce(decode(F.when(F.contains(text, F.lit("&")), text)), text)


def blank_nbsp(text: Column) -> Column:
    """No-break spaces as plain blanks."""
    return F.replace(text, F.lit("\u00a0"), F.lit(" "))


def unescape(text: Column) -> Column:
    """HTML entities decoded once, no-break spaces as blanks."""
    return blank_nbsp(_only_with_ampersand(_decode, text))


def unescape_closed(text: Column) -> Column:
    """Decode only entities that end in a semicolon."""
    return _only_with_ampersand(_decode_closed, text)
