"""Text expressions. All run in the JVM; `entities.unescape` is the one Python function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters treated as punctuation, the shortest token kept in features,
# the shortest token counted, and the patterns stripped from a body.
PUNCTUATION = ".,-/#!$%^&*;:{}=_`~()@+?><[]'\"|\n–"
FEATURE_MIN_LENGTH = 4
TEMPLATE = r"(?s)\{\{.*?\}\}"
NAMED_LINK = r"(?md)^(?>(.*?)\[\[)[^:\n]*+:.*\]\]"
BRACKET_LINK = r"\[[^\[\]]*+\]"
HTML_TAG = r"<[^>]*>"
COUNTED_TOKEN = r"[\p{L}\p{N}_]{2,}"
WORD = r"[\p{L}\p{N}_]+"

# Whitespace as Python's str methods see it; Java's \s knows only the ASCII part.
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
# The same characters one by one.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def running_sum(steps: Column) -> Column:
    """Inclusive running sum of an integer array, inside the row.

    Doubling: round k adds to each entry the one 2^k places before it, so n entries take
    n * log2(n) additions. A sum over a slice for each entry would take n * n.
    """

    def add_back(sums: Column, k: Column) -> Column:
        return F.transform(
            sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))
        )

    def rounds(xs: Column) -> Column:
        count = F.ceil(F.log2(F.greatest(F.size(xs), F.lit(1)))).cast("int")
        return F.transform(F.array_repeat(F.lit(0), count), lambda _, k: k)

    return let(steps.cast("array<bigint>"), lambda xs: F.aggregate(rounds(xs), xs, add_back))


def _feature_tokens(text: Column) -> Column:
    spaced = F.translate(text, PUNCTUATION, " " * len(PUNCTUATION))
    words = F.split(F.lower(spaced), f"[{SPACE}]+")
    return F.filter(words, lambda w: F.length(w) >= FEATURE_MIN_LENGTH)


def title_tokens(text: Column) -> Column:
    """Lower-cased words of four or more characters, punctuation blanked, duplicates kept."""
    return _feature_tokens(text)


def body_tokens(text: Column) -> Column:
    """As `title_tokens`, after templates, links and tags are removed.

    A line loses everything from its first ``[[`` to its last ``]]`` if a colon lies between;
    the pattern is anchored to line starts so that each line is looked at once. Closing tags
    need no step of their own, the tag pattern takes them too.
    """
    text = F.regexp_replace(text, TEMPLATE, " ")
    text = F.regexp_replace(text, NAMED_LINK, "$1 ")
    text = F.regexp_replace(text, BRACKET_LINK, " ")
    text = F.regexp_replace(text, HTML_TAG, " ")
    return _feature_tokens(text)


def reduce_text(text: Column) -> Column:
    """Lower-cased letters and digits with single blanks between."""
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def count_tokens(text: Column) -> Column:
    """Lower-cased words of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(COUNTED_TOKEN), 0)


def match_tokens(text: Column) -> Column:
    """Lower-cased words as the ranked search sees them."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def strip(text: Column) -> Column:
    """Drop whitespace of any kind at both ends."""
    return F.btrim(text, F.lit(SPACES))


def normalize_text(text: Column) -> Column:
    """Strip each line, squeeze blank lines to one, strip the whole."""
    lines = F.array_join(F.transform(F.split(text, "\n"), strip), "\n")
    return strip(F.regexp_replace(lines, "\n\n\n+", "\n\n"))


def normalize_html(html: Column) -> Column:
    """Squeeze runs of ``<br/>`` to one and strip."""
    return strip(F.regexp_replace(html, "(?:<br/>){2,}", "<br/>"))


def escape_link(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("_"))


def unescape_link(text: Column) -> Column:
    return F.translate(text, "_", " ")


def capitalize(text: Column) -> Column:
    """First letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))
