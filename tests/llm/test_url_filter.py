"""Address rules and the list of blocked addresses against plain sets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.llm import url_filter as uf
from folioscope.llm.queries import RULES

PAGES = "page_id long, url string, html string, host string, path string, verdict string, block long, rule string, address string"


def pages_of(spark, urls):
    return spark.createDataFrame([(k, u, "h", "x", "y", "z", 1, "r", "a") for k, u in enumerate(urls)], PAGES)


def parts(url):
    rest = url.partition("://")[2] if url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    query = re.match(r"[^?#]*\??([^#]*)", rest).group(1)
    return "".join(c.lower() if c.isascii() else c for c in host), path, query


def spelled(url):
    host, path, query = parts(url)
    host = re.sub(r":(80|443)?\Z", "", re.sub(r"\A(www|m)\.", "", host))
    kept = [p for p in query.split("&") if p and not re.fullmatch(uf.TRACKING, p)]
    return host + path.rstrip("/") + ("?" + "&".join(kept) if kept else "") if host else None


def expected(urls, listed, rules):
    held = {spelled(u) for u in listed} - {None}
    out = []
    for k, u in enumerate(urls):
        host, path, _ = parts(u)
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        is_listed = spelled(u) in held
        out.append((k, host, path, best and best[2], best[3] if best else "block" if is_listed else "allow", spelled(u), is_listed))
    return out


def judged(pages, listed, **options):
    return sorted(map(tuple, uf.judge(pages, listed, RULES, **options).collect()))


HOSTS = ["com", "example.com", "www.example.com", "a.example.com", "notexample.com", "net", "x.net", "b.org", "WWW.B.org", "m.b.ORG:80", "É.org", "b.org:443", "b.org:", ""]
PATHS = ["", "/", "/en/", "/en", "/en/a", "/es/1/", "/fr/", "/fr/x//", "//", "/A"]
TAILS = ["", "?", "?a=1", "?a=1&utm_source=f", "?ref=x", "#t", "?b=2#t?c", "#a/b", "?fbclid=1&c=://"]


def addresses():
    r = random.Random(8)
    urls = [f"{s}://{h}{p}{t}" for s in ("http", "https") for h in HOSTS for p in PATHS for t in TAILS]
    return r.sample(urls, 1500) + [None, "", "no scheme", "://", "a://b://c/d", "x:/b.org/en/", "http://b.org/1\n/2", "http://b.org\n", "http://b.org/1/\n"]


@pytest.mark.parametrize("options", [{}, {"most_blocks": 1}, {"rows_per_slot": 2}])
def test_against_sets(spark, options):
    urls = addresses()
    listed = random.Random(4).sample(urls[:1500], 300) + [None, "nothing"]
    got = judged(pages_of(spark, urls), pages_of(spark, listed), **options)
    assert got == expected(urls, listed, RULES)


def test_filter_lets_all_listed_and_few_others_pass(spark):
    key = F.concat(F.lit("host.org/"), F.col("id").cast("string"))
    listed, others = spark.range(20_000).select(key.alias("address")), spark.range(20_000, 40_000).select(key.alias("address"))
    blocks = uf.blocks_for(20_000)
    bloom = uf.bloom_filter(listed, blocks)
    assert uf.probed(listed, bloom, blocks).where("_maybe").count() == 20_000
    assert uf.probed(others, bloom, blocks).where("_maybe").count() < 1_000
    assert bloom.count() <= blocks and uf.blocks_for(10**12) == uf.MOST_BLOCKS


def test_one_address_in_most_rows(spark):
    urls = ["https://b.org/hot?ref=1"] * 400 + [f"http://b.org/{k}" for k in range(100)]
    got = judged(pages_of(spark, urls), pages_of(spark, ["http://www.b.org/hot", "http://b.org/7/"]), rows_per_slot=50)
    assert [x[0] for x in got if x[6]] == [*range(400), 407] and len(got) == 500


def test_empty_tables(spark):
    none = pages_of(spark, [])
    assert judged(none.limit(0) if none else none, pages_of(spark, ["http://a.org/"])) == []
    assert judged(pages_of(spark, [None, "http://a.org/"]), none) == [(0, "", "", None, "allow", None, False), (1, "a.org", "/", None, "allow", "a.org", False)]


def test_longest_rule_wins_and_ties_go_to_the_longer_host(spark):
    rules = [("block", "a.org", "/xx/"), ("allow", "b.a.org", "/x"), ("block", "org", "/")]
    rows = uf.ruled(pages_of(spark, ["http://b.a.org/xx/1", "http://c.a.org/xx/1", "http://c.a.org/x"]), rules).orderBy("page_id").collect()
    assert [(x.rule, x._ruling) for x in rows] == [("b.a.org/x", "allow"), ("a.org/xx/", "block"), ("org/", "block")]
