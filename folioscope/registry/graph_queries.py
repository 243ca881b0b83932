"""Link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..session import PART, fresh_path
from ..sources import sinks
from ..sources.tables import scan_table
from .article_queries import STAMP, dated
from .catalog import query
from .derived import Inputs

ROUNDS, DAMPING = 10, 0.85


def rank_parts() -> dict[str, str]:
    parts = {
        "pairs": "select src, dst, sum(2 / (1 + 3 * frac)) as w from final_link group by src, dst",
        "outs": "select src, sum(w) as total from pairs group by src",
        "nodes": "select src as id from pairs union select dst from pairs",
        "node_count": "select count(*) as n from nodes",
        "rank_0": "select id, 1.0::double / n as rank from nodes cross join node_count",
    }
    for k in range(1, ROUNDS + 1):
        last = f"rank_{k - 1}"
        parts[f"loose_{k}"] = f"select coalesce(sum(rank), 0) as loose from {last} where id not in (select src from outs)"
        parts[f"given_{k}"] = f"""
            select p.dst as id, sum(r.rank * p.w / o.total) as got
            from pairs p join outs o on o.src = p.src join {last} r on r.id = p.src group by p.dst"""
        parts[f"rank_{k}"] = f"""
            select x.id, {1 - DAMPING} / n + {DAMPING} * loose / n + {DAMPING} * coalesce(got, 0) as rank
            from nodes x cross join node_count cross join loose_{k} left join given_{k} g on g.id = x.id"""
    return parts


RANKS = rank_parts()
LAST_RANK = f"rank_{ROUNDS}"


@query("extract_links", "select src, dst, pos, frac from title_link")
def _(i: Inputs):
    return gr.extract_links(i.dump_page, decode=False)


@query("join_link_ids", "select src, dst, frac from id_link")
def _(i: Inputs):
    return gr.join_link_ids(i.title_link, i.page).select("src", "dst", "frac")


@query("join_redirect_ids", "select src, dst from id_redirect")
def _(i: Inputs):
    return gr.join_redirect_ids(i.redirect, i.page)


@query("f_dst_not_null", "select src, dst from (select r.src, p.id as dst from redirect r left join page p on p.title = r.dst and p.type = 0) where dst is not null")
def _(i: Inputs):
    articles = i.page.filter("type = 0").select(F.col("title").alias("dst"), "id")
    return gr.with_target(i.redirect.join(articles, "dst", "left").select("src", F.col("id").alias("dst")))


@query("redirect_sinks", "select distinct dst as id from id_redirect where dst not in (select src from id_redirect)")
def _(i: Inputs):
    return gr.redirect_sinks(i.id_redirect)


@query("redirect_closure", "select src, dst from final_redirect")
def _(i: Inputs):
    return gr.redirect_closure(i.id_redirect)


@query(
    "union_edges",
    "select dst, count(*) as sources from final_redirect group by dst",
)
def _(i: Inputs):
    return gr.redirect_closure(i.id_redirect).groupBy("dst").agg(F.count("*").alias("sources"))


@query("join_final_links", "select src, dst0, dst, frac from final_link")
def _(i: Inputs):
    return gr.join_final_links(i.id_link, i.final_redirect)


@query(
    "degree",
    """select id, sum(n) as out_degree
       from (select src as id, 1 as n from final_link union all select dst, 0 from final_link) group by id""",
)
def _(i: Inputs):
    return gr.degree(i.final_link)


@query("link_count", "select count(*) as links from final_link")
def _(i: Inputs):
    return gr.link_count(i.final_link)


@query("link_weight", "select src, dst, 2 / (1 + 3 * frac) as weight from final_link")
def _(i: Inputs):
    return i.final_link.select("src", "dst", gr.link_weight(F.col("frac")).alias("weight"))


@query("page_rank", f"select id, round(rank, 9) as rank from {LAST_RANK}", **RANKS)
def _(i: Inputs):
    return i.ranks.select("id", F.round("rank", 9).alias("rank"))


@query("top_ranked", f"select id, round(rank, 9) as rank from {LAST_RANK} order by rank desc, id limit 10", **RANKS)
def _(i: Inputs):
    return gr.top_ranked(i.ranks).select("id", F.round("rank", 9).alias("rank"))


@query(
    "top_pages",
    f"""select id, rev, strftime(date, '{STAMP}') as date, type, length, title from page
        where id in (select id from {LAST_RANK} order by rank desc, id limit 10)""",
    **RANKS,
)
def _(i: Inputs):
    return dated(gr.top_pages(i.page, i.ranks)).select("id", "rev", "date", "type", "length", "title")


@query(
    "write_graph",
    """select 'page' as name, count(*) as n from page union all select 'title_link', count(*) from title_link
       union all select 'redirect', count(*) from redirect union all select 'id_link', count(*) from id_link
       union all select 'id_redirect', count(*) from id_redirect
       union all select 'final_redirect', count(*) from final_redirect
       union all select 'final_link', count(*) from final_link""",
)
def _(i: Inputs):
    path = fresh_path(i.spark, "graph")
    names = ["page", "title_link", "redirect", "id_link", "id_redirect", "final_redirect", "final_link"]
    sinks.write_graph({name: getattr(i, name).drop(PART) for name in names}, path)
    counts = None
    for name in names:
        part = scan_table(i.spark, f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = part if counts is None else counts.unionByName(part)
    return counts
