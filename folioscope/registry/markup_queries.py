"""Plain text and segments of the derived articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markup as mk
from .catalog import query
from .check_sql import SPACE, quoted
from .derived import Inputs

# The derived articles nest templates once and hold no tables, lists or tags but ref, so these
# simple patterns say all about them.
NOTES = r"<ref>[^<]*</ref>|\{\{cite[^{}]*\}\}"
SEGMENT = NOTES + r"|\[\[[^\]]*\]\]|\[http[^\]]*\]|== [^=\n]* =="
PARTS = {
    "wiki_clean": r"""
        select id as aid, regexp_replace(regexp_replace(text, '\{\{note\|\{\{lang\|[^{}]*\}\}\}\}', '', 'g'),
                                         '\[\[Category:[^\]]*\]\]', '', 'g') as wiki from article""",
    "segment_list": f"select aid, regexp_extract_all(wiki, {quoted(SEGMENT)}) as found from wiki_clean",
    "segment": "select aid, unnest(range(len(found))) as pos, unnest(found) as s from segment_list",
    "segment_kind": """
        select aid, pos, s, case when s like '<ref%' or s like '{{%' then 'note' when s like '[[%' then 'link'
                                 when s like '==%' then 'heading' else 'external' end as kind from segment""",
    "plain_lines": rf"""
        select aid, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                   wiki, {quoted(NOTES)}, '', 'g'), '\[\[([^\]|]*)(\|[^\]]*)?\]\]', '\1', 'g'),
                   '\[http[^ \]]* ([^\]]*)\]', '\1', 'g'), '(?m)^== ([^=\n]*) ==$', ' \1 ', 'g'),
                   '(?m)^[*#:;]+', '', 'g'), '(?m)^[|!]', '', 'g'), chr(10)) as lines
        from wiki_clean""",
}
SQL_SEGMENTS = r"""
    select aid, cast(pos as int) as pos, kind,
           case kind when 'link' then replace(regexp_extract(s, '^\[\[([^\]|]*)', 1), ' ', '_')
                     when 'external' then regexp_extract(s, '^\[([^ ]*)', 1) end as target,
           case kind when 'link' then regexp_extract(s, '^\[\[([^\]|]*)', 1) when 'heading' then regexp_extract(s, '== (.*) ==', 1)
                     when 'external' then regexp_extract(s, ' ([^\]]*)\]', 1) end as label
    from segment_kind"""
SQL_PLAIN = rf"""
    select aid, regexp_replace(regexp_replace(array_to_string(list_transform(lines,
               lambda s: regexp_replace(s, '^{SPACE}+|{SPACE}+$', '', 'g')), chr(10)), '\n{{2,}}', chr(10) || chr(10), 'g'),
               '\A{SPACE}+|{SPACE}+\z', '', 'g') as text
    from plain_lines"""


def wikis(i: Inputs):
    return i.article.select(F.col("id").alias("aid"), F.col("text").alias("wiki"))


@query("plain_text", SQL_PLAIN, **PARTS)
def _(i: Inputs):
    return mk.plain_text(wikis(i))


@query("markup_segments", SQL_SEGMENTS, **PARTS)
def _(i: Inputs):
    return mk.markup_segments(wikis(i))


@query(
    "footnote_numbers",
    """select aid, cast(pos as int) as pos, cast(row_number() over (partition by aid order by pos) as int) as number
       from segment_kind where kind = 'note'""",
    **PARTS,
)
def _(i: Inputs):
    return mk.footnote_numbers(wikis(i))


@query(
    "text_and_segments",
    "select t.aid, t.text, len(l.found) as segments from plain_out t join segment_list l using (aid)",
    **PARTS, plain_out=SQL_PLAIN,
)
def _(i: Inputs):
    return mk.text_and_segments(wikis(i)).select("aid", "text", F.size("segments").alias("segments"))
