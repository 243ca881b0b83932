"""Time the headline queries; prints one line of JSON.

The derived tables are staged first and reported as ``prepare``: in use they are the stored
output of the load jobs. Each query is then run to its end, every row computed, no row kept.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from folioscope.operators.search import search_title  # noqa: E402
from folioscope.registry import QUERIES  # noqa: E402
from folioscope.registry.derived import inputs  # noqa: E402
from folioscope.session import build_session  # noqa: E402

HEADLINE = [
    "scan_dump", "article_rows", "extract_links", "join_link_ids", "redirect_closure", "join_final_links",
    "month_token_count", "cumulative_freq", "search_title", "search_title_1000", "search_field", "search_like", "page_rank",
    "markup_segments", "plain_text",
]
STAGED = [
    "article", "dump_page", "dump_file", "documents", "features", "search_article", "page", "title_link",
    "redirect", "id_link", "id_redirect", "final_redirect", "final_link", "vocab", "counts", "title_index", "text_index", "like_index",
]


def thousand_titles(spark, folder):
    """Ranked search on titles for 1,000 questions: the titles of the articles with the smallest ids."""
    made = inputs(spark, folder)
    titles = made.search_article.orderBy("aid").limit(1_000).selectExpr("aid AS qid", "title AS query")
    return search_title(made.search_article, titles, index=made.title_index)


MORE = {"search_title_1000": thousand_titles}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare = {}
    made = inputs(spark, folder)
    for name in STAGED:
        began = time.time()
        getattr(made, name)
        prepare[name] = round(time.time() - began, 2)
    times = {}
    for key in keys:
        began = time.time()
        (MORE.get(key) or QUERIES[key])(spark, folder).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - began, 2)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 2), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "prepare": prepare,
        "with_prepare": round(sum(times.values()) + sum(prepare.values()), 2),
    }))


if __name__ == "__main__":
    main()
