"""Link graph: links, redirects resolved to their ends, degrees and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entities import unescape
from ..functions.text import capitalize, let, running_sum
from ..session import PART, PART_ROWS, bucketed, in_parts, parts_kept, stage
from .articles import in_main_namespace, text_length, without_redirect_element
from .joins import ROWS_PER_SLOT, looked_up, salted_join

# Fixed value: a link is all from "[[" to the next "]", when that is followed by another.
LINK = r"\[\[([^\]]*)\]\]"


def link_spans(text: Column) -> Column:
    """Array of ``(inner, pos)`` for every link of a text, in order, ``pos`` in characters.

    A link starts where the gaps and links before it end, so positions are a running sum of
    lengths inside the row.
    """

    def spans(found: Column) -> Column:
        inner, gaps = found["inner"], found["gaps"]
        before = F.transform(
            inner,
            lambda _, i: F.get(gaps, i) + F.when(i == 0, 0).otherwise(F.length(F.get(inner, i - 1)) + 4),
        )
        return F.arrays_zip(inner.alias("inner"), running_sum(before).alias("pos"))

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(LINK), 1).alias("inner"),
        F.transform(F.split(text, LINK, -1), lambda gap: F.length(gap)).alias("gaps"),
    )
    return let(parts, spans)


def extract_links(pages: DataFrame, decode: bool = True) -> DataFrame:
    """``title_link`` rows ``src, dst, pos, frac`` of all articles.

    ``pos`` counts in the decoded text and ``frac`` divides by the length of the text before.
    """
    articles = without_redirect_element(in_main_namespace(pages))
    body = F.coalesce("text", F.lit(""))
    plain = unescape(body) if decode else body
    texts = articles.select("title", text_length(articles).alias("length"), plain.alias("wiki"))
    links = texts.select("title", "length", F.inline(link_spans(F.col("wiki"))).alias("inner", "pos"))
    target = F.substring_index(F.substring_index("inner", "|", 1), "#", 1)
    return (
        links.withColumn("target", target)
        .filter("target != ''")
        .select(
            F.col("title").alias("src"),
            capitalize(F.col("target")).alias("dst"),
            F.col("pos").cast("int").alias("pos"),
            (F.col("pos") / F.col("length")).alias("frac"),
        )
    )


def _title_ids(page: DataFrame, side: str) -> DataFrame:
    return page.select(F.col("title").alias(side), F.col("id").alias(f"__{side}"))


def _to_ids(edges: DataFrame, page: DataFrame, rows_per_slot: int) -> DataFrame:
    found = edges
    for side in ("dst", "src"):
        # Counted before the first join, which then need not run once more for the second.
        counts = edges.groupBy(side).agg(F.count("*").alias("rows"))
        found = salted_join(found, _title_ids(page, side), side, rows_per_slot=rows_per_slot, counts=counts)
        found = found.withColumn(side, F.col(f"__{side}")).drop(f"__{side}")
    return found


def join_link_ids(title_link: DataFrame, page: DataFrame, rows_per_slot: int = PART_ROWS) -> DataFrame:
    """Links by page id; links from or to unknown titles vanish.

    Links are staged in parts of ``rows_per_slot`` rows at most and stay there: only the distinct titles of a
    part meet the pages. If ``title_link`` lies in parts already, so does the result, with their column.
    """
    links = title_link if PART in title_link.columns else in_parts(title_link.select("src", "dst", "frac"), "links", rows_per_slot)
    found = links.select("src", "dst", "frac", PART)
    with parts_kept(links.sparkSession):
        for side in ("dst", "src"):
            found = looked_up(found, _title_ids(page, side), side).withColumn(side, F.col(f"__{side}")).drop(f"__{side}")
        found = found.select("src", "dst", "frac", PART)
        return in_parts(found, "id-link") if PART in title_link.columns else stage(found.drop(PART), "id-link")


def join_redirect_ids(redirect: DataFrame, page: DataFrame, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    return _to_ids(redirect.select("src", "dst"), page, rows_per_slot).select("src", "dst")


def with_target(edges: DataFrame) -> DataFrame:
    return edges.filter("dst is not null")


def redirect_sinks(edges: DataFrame) -> DataFrame:
    """Nodes that are pointed to and point nowhere."""
    targets = edges.select(F.col("dst").alias("id")).distinct()
    return targets.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def redirect_closure(edges: DataFrame, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """``(src, dst)`` for every sink ``dst`` and every node ``src`` that leads to it.

    A redirect has one target, so nearly all nodes have one edge; those are followed by doubling. The
    few nodes with several targets stop the others on their way, are joined up among themselves, and
    then stand for what they lead to.
    """
    edges = stage(with_target(edges).select("src", "dst").distinct(), "redirect-edges")
    forks = stage(edges.groupBy("src").agg(F.count("*").alias("n")).filter("n > 1").select("src"), "redirect-forks")
    if forks.isEmpty():
        return _chain_ends(edges, rows_per_slot)
    chains = stage(edges.join(forks, "src", "left_anti"), "redirect-chains")
    ends = stage(_chain_ends(chains, rows_per_slot), "chain-ends")
    onward = chains.select(F.col("src").alias("dst"), F.lit(True).alias("__chained"))
    reached = edges.join(forks, "src", "left_semi").join(onward, "dst", "left")
    reached = reached.join(ends.select(F.col("src").alias("dst"), F.col("dst").alias("__end")), "dst", "left")
    # A target on a chain without an end leads into a cycle.
    hops = reached.filter("__end is not null or __chained is null").select("src", F.coalesce("__end", "dst").alias("dst")).distinct()
    at_fork = forks.select(F.col("src").alias("dst"))
    joined = stage(_fork_ends(stage(hops, "fork-hops"), rows_per_slot).join(at_fork, "dst", "left_anti"), "fork-ends")
    through = ends.withColumnRenamed("dst", "__fork").join(joined.withColumnRenamed("src", "__fork"), "__fork").select("src", "dst")
    return ends.join(at_fork, "dst", "left_anti").select("src", "dst").unionByName(joined.select("src", "dst")).unionByName(through)


def _chain_ends(edges: DataFrame, rows_per_slot: int) -> DataFrame:
    """`redirect_closure` where every source has one target.

    An open row holds a node some way ahead that is itself open, or was found to have an end in the
    round before. Each round moves it to where that node leads, twice as far, and looks the new node
    up among the ends found in the round before. So what is found is read once, by the open rows, a
    round touches no others, and d steps take log2(d) rounds. A round that finds nothing ends the loop:
    the rest leads into cycles.
    """
    sources = edges.select(F.col("src").alias("dst"), F.lit(True).alias("__onward"))
    end = F.when(F.col("__onward").isNull(), F.col("dst")).alias("end")
    step = stage(edges.join(sources, "dst", "left").select("src", F.col("dst").alias("via"), end), "redirect-step")
    found, done = step.filter("end is not null").select("src", "end"), None
    while True:
        ends = found.select("src", F.col("end").alias("dst"))
        done = ends if done is None else done.unionByName(ends)
        pending = step.filter("end is null").select("src", "via")
        new, left = _counts(step)
        if not new or not left:
            return done
        # No node can be the target of more rows than there are.
        join = (lambda a, b: a.join(b, "via", "left")) if left <= rows_per_slot else (lambda a, b: salted_join(a, b, "via", "left", rows_per_slot))
        moved = join(pending, pending.select(F.col("src").alias("via"), F.col("via").alias("__next")))
        moved = moved.select("src", F.coalesce("__next", "via").alias("via"))
        if left > rows_per_slot:
            moved = stage(moved, "redirect-moved")
        step = stage(join(moved, found.select(F.col("src").alias("via"), "end")).select("src", "via", "end"), "redirect-step")
        found = step.filter("end is not null").select("src", "end")


def _counts(step: DataFrame) -> tuple[int, int]:
    row = step.agg(F.count("end").alias("found"), F.count_if(F.col("end").isNull()).alias("open")).first()
    return row["found"], row["open"]


def _fork_ends(edges: DataFrame, rows_per_slot: int) -> DataFrame:
    """`redirect_closure` for nodes of any number of targets.

    After round k a node holds the nodes exactly 2^k steps ahead (``open``) and the sinks at most 2^k
    steps ahead. A node may come to a sink in several ways, so what a round finds is compared with
    what was found before.
    """
    sources = edges.select(F.col("src").alias("dst")).distinct()
    is_source = F.col("__step").isNotNull()
    first = stage(edges.join(sources.withColumn("__step", F.lit(1)), "dst", "left").select("src", "dst", is_source.alias("open")), "fork-step")
    done, pending = first.filter("not open"), first.filter("open")
    while True:
        ahead = done.unionByName(pending).select(F.col("src").alias("via"), F.col("dst").alias("end"), F.col("open").alias("end_open"))
        moved = salted_join(
            pending.select("src", F.col("dst").alias("via")), ahead, "via", rows_per_slot=rows_per_slot
        ).select("src", F.col("end").alias("dst"), F.col("end_open").alias("open"))
        moved = stage(moved.distinct(), "fork-step")
        new = stage(moved.filter("not open").join(done.select("src", "dst"), ["src", "dst"], "left_anti"), "fork-found")
        if new.isEmpty():
            return done.select("src", "dst").distinct()
        done, pending = done.unionByName(new), moved.filter("open")


def join_final_links(id_link: DataFrame, final_redirect: DataFrame, rows_per_slot: int = PART_ROWS) -> DataFrame:
    """Links with ``dst0`` as linked and ``dst`` after redirects; links move no more than in `join_link_ids`."""
    ends = final_redirect.select(F.col("src").alias("dst0"), F.col("dst").alias("__end"))
    links = id_link if PART in id_link.columns else in_parts(id_link.select("src", "dst", "frac"), "links", rows_per_slot)
    links = links.select("src", F.col("dst").alias("dst0"), "frac", PART)
    with parts_kept(links.sparkSession):
        joined = looked_up(links, ends, "dst0", "left")
        return stage(joined.select("src", "dst0", F.coalesce("__end", "dst0").alias("dst"), "frac"), "final-link", compression="zstd")


def degree(edges: DataFrame) -> DataFrame:
    """Out-degree of every node, zero for nodes only pointed to."""
    ends = edges.select("src", F.lit(1).alias("n")).unionByName(
        edges.select(F.col("dst").alias("src"), F.lit(0).alias("n"))
    )
    return ends.groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("out_degree"))


def link_count(final_link: DataFrame) -> DataFrame:
    return final_link.agg(F.count("*").alias("links"))


def link_weight(frac: Column) -> Column:
    """Weight of a link by its place in the article: 2 at the top, 0.5 at the end."""
    return F.lit(2) / (F.lit(1) + F.lit(3) * frac)


def page_rank(
    final_link: DataFrame, rounds: int | None = None, damping: float = 0.85, edges_per_slot: int = ROWS_PER_SLOT,
    tolerance: float = 1e-6, most_rounds: int = 1_000,
) -> DataFrame:
    """``(id, rank)`` over weighted links, converged or after ``rounds`` rounds.

    Without ``rounds`` it goes on until the ranks of a round differ from those before by less than
    ``tolerance`` times the number of pages, all differences added; ``most_rounds`` without that is an error.

    Parallel links are summed to one edge first. The out-edges of a page with very many are
    spread over slots, and its rank is repeated once per slot. Each round stages only the ranks.
    The rank of pages without out-links goes evenly to all pages.
    """
    # A page has no more edges than links, so links tell how many slots are enough. They move once, to the slots.
    links = final_link.groupBy("src").agg(F.count("*").alias("links")).filter(F.col("links") > edges_per_slot)
    slots = stage(links.select("src", F.ceil(F.col("links") / edges_per_slot).cast("int").alias("__slots")), "rank-slots")
    slot = F.when(F.col("__slots") > 1, F.pmod(F.xxhash64("dst"), F.col("__slots")).cast("int")).otherwise(0)
    # At most rows / edges_per_slot pages have more than one slot.
    slotted = final_link.join(F.broadcast(slots), "src", "left")
    weighted = slotted.select("src", slot.alias("slot"), "dst", link_weight(F.col("frac")).alias("w"))
    # The edges keep one layout over all rounds, in the shared folder: no round moves or sorts them,
    # and a lost task reads its bucket again.
    pairs, drop = bucketed(
        weighted, "src", "slot", name="rank-edges", change=lambda df: df.groupBy("src", "slot", "dst").agg(F.sum("w").alias("w"))
    )
    try:
        out = pairs.groupBy("src", "slot").agg(F.sum("w").alias("w")).groupBy("src").agg(F.sum("w").alias("total"))
        out = out.join(F.broadcast(slots), "src", "left").select("src", "total", F.coalesce("__slots", F.lit(1)).alias("slots"))
        nodes = stage(
            pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct()
            .join(out.withColumnRenamed("src", "id"), "id", "left"),
            "rank-nodes",
        )
        return _rank_rounds(nodes, pairs, nodes.count(), rounds, damping, tolerance, most_rounds)
    finally:
        drop()


def _rank_rounds(
    nodes: DataFrame, edges: DataFrame, count: int, rounds: int | None, damping: float, tolerance: float, most_rounds: int
) -> DataFrame:
    ranks = nodes.withColumn("rank", F.lit(1.0 / count))
    done = 0
    while done != rounds:
        if rounds is None and done == most_rounds:
            raise RuntimeError(f"ranks have not settled in {most_rounds} rounds")
        done += 1
        loose = ranks.filter("total is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).scalar()
        giving = ranks.filter("total is not null").select(
            F.col("id").alias("src"),
            F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"),
            (F.col("rank") / F.col("total")).alias("unit"),
        )
        # What a bucket's pages give is looked up in a hash table of theirs, so its edges need no order.
        given = (
            edges.join(giving.hint("shuffle_hash"), ["src", "slot"])
            .groupBy(F.col("dst").alias("id"))
            .agg(F.sum(F.col("w") * F.col("unit")).alias("got"))
        )
        base = F.lit((1.0 - damping) / count) + loose * (damping / count)
        ranks = stage(
            ranks.join(given, "id", "left").select(
                *nodes.columns, F.col("rank").alias("before"), (base + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank")
            ),
            "ranks",
        )
        if rounds is None and ranks.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] < count * tolerance:
            break
    return ranks.select("id", "rank")


def top_ranked(ranks: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` pages of highest rank."""
    return ranks.orderBy(F.desc("rank"), "id").limit(n)


def top_pages(page: DataFrame, ranks: DataFrame, n: int = 10) -> DataFrame:
    """``page`` rows of the highest ranked."""
    return page.join(F.broadcast(top_ranked(ranks, n).select("id")), "id", "left_semi")
