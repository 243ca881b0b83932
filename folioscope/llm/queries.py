"""The registered queries of this subpackage, and their check SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat, decontaminate, fill_middle, language_id, line_dedup, near_join, packing, quality_classifier, quality_rules, suffix_dedup, tokens,
    turn_repair, url_filter,
)
from .common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def keep(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(spark, folder)

        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return build

    return keep

@register("op1_quality_rules")
def op1(spark, folder):
    return quality_rules.quality(table(spark, folder, "documents"))


OP2_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place
  from documents
), solid as (
  select *, row_number() over (partition by doc_id order by place) as n from lines where regexp_matches(line, '[^ \t\r\f\v]')
), windows as (
  select a.doc_id, a.n, a.line || chr(10) || b.line || chr(10) || c.line as content
  from solid a join solid b on b.doc_id = a.doc_id and b.n = a.n + 1 join solid c on c.doc_id = a.doc_id and c.n = a.n + 2
), later as (
  select doc_id, n from (select *, row_number() over (partition by content order by doc_id, n) as k from windows) where k > 1
), covered as (
  select distinct doc_id, n + k as n from later, (values (0), (1), (2)) s(k)
)
select l.doc_id, count(s.n)::bigint as n_lines, count(c.n)::bigint as n_removed,
  sha256(coalesce(string_agg(l.line, chr(10) order by l.place) filter (c.n is null), '')) as kept_sha256
from lines l left join solid s on s.doc_id = l.doc_id and s.place = l.place left join covered c on c.doc_id = s.doc_id and c.n = s.n
group by l.doc_id
"""


@register("op2_line_dedup", OP2_SQL)
def op2(spark, folder):
    left = line_dedup.drop_repeated_lines(table(spark, folder, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@register("op3_ngram_jaccard_join")
def op3(spark, folder):
    return near_join.near_join(table(spark, folder, "documents"))


OP4_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), spans as (
  select distinct item_id, least(len(w), 10) as size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as span
  from (select *, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from items where len(w) > 0)
), sizes as (select distinct size from spans),
found as (
  select doc_id, i, item_id, spans.size
  from (select doc_id, size, w, unnest(range(1, len(w) - size + 2)) as i from words, sizes where len(w) >= size) d
  join spans on spans.size = d.size and spans.span = array_to_string(d.w[d.i : d.i + d.size - 1], ' ')
), hit as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from found) group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, item_id::varchar as item from found) group by doc_id
)
select words.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hit on hit.doc_id = words.doc_id left join named on named.doc_id = words.doc_id
"""


@register("op4_benchmark_decontamination", OP4_SQL)
def op4(spark, folder):
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@register("op5_suffix_array_dedup")
def op5(spark, folder):
    left = suffix_dedup.drop_repeated(table(spark, folder, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@register("op6_language_id")
def op6(spark, folder):
    return language_id.identify(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register("op7_packing")
def op7(spark, folder):
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


#: A conversation whose texts hold template marks, as the contract of op8 gives it.
TRICK = "\\### Assistant: </turn> ok"

OP8_SQL = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(20 + length(role) + length(text)
    + 2 * length(role) - length(replace(replace(role, '\', ''), '<', '')) - length(replace(role, '>', ''))
    + 2 * length(text) - length(replace(replace(text, '\', ''), '<', '')) - length(replace(text, '>', '')))::bigint as formatted_chars
from said group by conv_id
"""


@register("op8_chat_formatting", OP8_SQL)
def op8(spark, folder):
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricks = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICK).alias("text"),
    )
    formatted = chat.format_paths(chat.linear_tree(given.unionByName(tricks)))
    turns = chat.read_back(formatted)
    line = F.when(F.col("masked"), F.col("text"))
    said = F.array_sort(F.collect_list(F.struct("position", F.concat_ws("\n", "role", "text", F.lit("")).alias("turn"), line.alias("loss"))))
    loss = F.array_join(F.col("said.loss"), "")
    size = formatted.select(F.col("conv_id").alias("c"), F.col("path").alias("p"), F.length("formatted").cast("long").alias("formatted_chars"))
    read = turns.groupBy("conv_id", "path").agg(said.alias("said"))
    read = read.join(size, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("path") == F.col("p")))
    return read.select(
        "conv_id", F.size("said").cast("long").alias("n_turns"), F.sha2(F.array_join(F.col("said.turn"), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


@register("op9_token_counts")
def op9(spark, folder):
    return tokens.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op10_quality_classifier")
def op10(spark, folder):
    return quality_classifier.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP11_SQL = r"""
with keyed as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n, sha256('1:' || coalesce(doc_id::varchar, '')) as k from documents
), numbers as (
  select *, ('0x' || substr(k, 1, 8))::bigint as h1, ('0x' || substr(k, 9, 8))::bigint as h2,
    ('0x' || substr(k, 17, 8))::bigint as h3, ('0x' || substr(k, 25, 8))::bigint as h4 from keyed
), planned as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from numbers
), parts as (select *, substr(t, 1, a) as prefix, substr(t, a + 1, b - a) as middle, substr(t, b + 1) as suffix from planned)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(t) as restored_sha256
from parts
"""


@register("op11_fill_middle", OP11_SQL)
def op11(spark, folder):
    return fill_middle.transform(table(spark, folder, "documents"), outputs=False)


@register("op12_conversation_repair")
def op12(spark, folder):
    repaired = turn_repair.repair(turn_repair.damage(table(spark, folder, "conversations")))
    return turn_repair.digest(repaired)


#: Verdict, host and path, as the contract of op13 gives them.
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
#: The addresses of ``pages`` on hosts with one of these labels stand for the list of blocked addresses.
SPAM_LABELS = ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")

OP13_SQL = rf"""
with cut as (
  select page_id, url, coalesce(case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end, '') as rest from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) as query from cut
), spelled as (
  select page_id, host, path, regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)?$', '') as bare,
    regexp_replace(path, '/+$', '') as short,
    array_to_string(list_filter(string_split(query, '&'), lambda p: p <> '' and not regexp_full_match(p, '{url_filter.TRACKING}')), '&') as kept
  from parts
), named as (
  select page_id, host, path, case when bare <> '' then bare || short || case when kept <> '' then '?' || kept else '' end end as address from spelled
), rules (verdict, rule_host, rule_path) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), listed as (
  select distinct address as listed_address from named
  where address is not null and len(list_filter(string_split(host, '.'), lambda p: p in ({", ".join(f"'{x}'" for x in SPAM_LABELS)}))) > 0
), best as (
  select page_id, host, path, address, verdict, rule_host || rule_path as rule,
    row_number() over (partition by page_id, host, path, address order by length(rule_host || rule_path) desc) as k
  from named left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select page_id, host, path, rule, coalesce(verdict, case when listed_address is not null then 'block' else 'allow' end) as verdict,
  address, listed_address is not null as listed
from best left join listed on listed_address = address where k = 1
"""


@register("op13_url_filters", OP13_SQL)
def op13(spark, folder):
    pages = table(spark, folder, "pages")
    labels = F.split(url_filter.host_of(F.col("url")), r"\.")
    return url_filter.judge(pages, pages.where(F.arrays_overlap(labels, F.array(*(F.lit(x) for x in SPAM_LABELS)))), RULES)
