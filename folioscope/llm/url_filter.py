"""URL filters: a short list of host and path rules, then a long list of blocked addresses.

The list of blocked addresses may be as long as the web, so it is neither broadcast nor joined with
every page. A blocked Bloom filter of it is a table of blocks of 512 bits: a key sets one bit in
each of the eight words of one block. The number of blocks is bounded, so the filter can be
broadcast; a join on the block number and a test of eight bits leaves the pages that may be listed,
and an exact join of those with the list removes the false hits. Beyond the bound the filter lets
more pass and the exact join has more to do; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import ROWS_PER_SLOT, salted_join
from ..session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
#: Listed addresses a block is meant for, and the most blocks there are: 64 bytes each, 16 MB in all.
KEYS_PER_BLOCK, MOST_BLOCKS = 40, 1 << 18
#: Parts of a query that say where a visitor came from and not which page is asked for.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for a null address or one without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"\A([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"\A[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """An address in the one spelling that the list and the pages are compared in.

    Without scheme, fragment, ``www.`` and ``m.``, the ports 80 and 443, tracking parts of the query and
    slashes at the end; the host in lower case. Null if there is no host.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"\A(?:www|m)\.", ""), r":(?:80|443)?\z", "")
    path = F.regexp_replace(path_of(url), r"/+\z", "")
    query = F.regexp_extract(after_scheme(url), r"\A[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(rf"\A{TRACKING}\z"))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``_ruling`` to ``pages`` (with ``url``).

    ``rules`` are ``(verdict, host, path)``. A rule fits its host and all hosts that end in a dot and
    it, if the path of the address starts with the rule's. The longest that fits wins, host and path
    counted together; of equal ones that of the longer host. A short list, so a chain of tests in the
    row; no rule fits an empty host.
    """
    pages = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1] + r[2])):
        own = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
        fits = own & F.startswith(F.col("path"), F.lit(path))
        rule, ruling = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(ruling)
    return pages.withColumn("rule", rule).withColumn("_ruling", ruling)


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block number of a key, and each word with the one bit that it sets there."""
    places, one = F.xxhash64(F.lit(1), key), F.lit(1).cast("long")
    words = [F.call_function("shiftleft", one, F.shiftright(places, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(WORDS)]
    return F.pmod(F.xxhash64(key), F.lit(blocks)), words


def blocks_for(n: int, most: int = MOST_BLOCKS) -> int:
    return min(max(1, -(-n // KEYS_PER_BLOCK)), most)


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """``block, w0 .. w7``: the blocks of ``address`` (null: none) in ``listed`` that have a bit set."""
    block, words = _bits(F.col("address"), blocks)
    bits = listed.where("address is not null").select(block.alias("block"), *(w.alias(f"w{k}") for k, w in enumerate(words)))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)))


def probed(rows: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """Adds ``_maybe`` to ``rows``: whether ``address`` may be listed. True for all that are, and a few that are not."""
    block, words = _bits(F.col("address"), blocks)
    hit = F.lit(True)
    for k, word in enumerate(words):
        hit = hit & (F.col(f"w{k}").bitwiseAND(word) != 0)
    # At most MOST_BLOCKS rows of nine numbers, however long the list is.
    joined = rows.withColumn("block", block).join(F.broadcast(bloom), "block", "left")
    return joined.select(*rows.columns, F.coalesce(hit & F.col("address").isNotNull(), F.lit(False)).alias("_maybe"))


def judge(
    pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], most_blocks: int = MOST_BLOCKS, rows_per_slot: int = ROWS_PER_SLOT
) -> DataFrame:
    """Every row of ``pages`` (``page_id, url``): ``page_id, host, path, rule, verdict, address, listed``.

    ``listed`` has the blocked addresses as ``url``, in any spelling, in any number, repeated or null.
    The verdict is that of the rule that fits; without one, ``block`` if the page's canonical address
    is listed, else ``allow``. A null ``url``, or one without ``://``, has an empty host and path, no
    rule and no address, and is allowed. Repeated rows and rows that share an id are judged each;
    other columns of ``pages`` are dropped. An empty list allows all that no rule blocks.

    ``pages`` is not shuffled as a whole: only the distinct addresses that pass the filter meet the
    list, and only the rows that pass it meet what was found there, an address of more than
    ``rows_per_slot`` rows in several tasks.
    """
    listing = stage(listed.select(canonical(F.col("url")).alias("address")).where("address is not null").distinct(), "listed")
    blocks = blocks_for(listing.count(), most_blocks)
    bloom = stage(bloom_filter(listing, blocks), "bloom")
    rows = ruled(pages.select("page_id", F.col("url").cast("string").alias("url")), rules)
    rows = probed(rows.withColumn("address", canonical(F.col("url"))).drop("url"), bloom, blocks)
    maybe = stage(rows.where("_maybe"), "possible")
    counts = stage(maybe.groupBy("address").agg(F.count("*").alias("rows")), "possible-addresses")
    found = stage(counts.join(listing, "address").select("address", F.lit(True).alias("listed")), "found")
    exact = salted_join(maybe, found, "address", "left", rows_per_slot, counts).select(*rows.columns, F.coalesce("listed", F.lit(False)).alias("listed"))
    judged = exact.unionByName(rows.where("not _maybe").withColumn("listed", F.lit(False)))
    verdict = F.coalesce("_ruling", F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "address", "listed")
