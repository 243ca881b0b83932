"""The derived inputs once more, in DuckDB SQL, as named parts that check queries are built from."""

from __future__ import annotations

import re

from .derived import ID_STEP, LIKE_QUERIES, WIKI_STEPS

TOKEN = r"[\p{L}\p{N}_]{2,}"
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cap(x: str) -> str:
    return (
        f"case when left({x}, 1) = 'ß' then 'SS' || substr({x}, 2) "
        f"else upper(left({x}, 1)) || substr({x}, 2) end"
    )


def date_of(number: str) -> str:
    return f"timestamp '2001-01-01 00:00:00' + to_days(cast({number} * 7 % 6000 as int))"


def _wiki(text: str) -> str:
    for pattern, change in WIKI_STEPS:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(change)}, 'g')"
    return text


def decoded(x: str) -> str:
    """The entities that occur in the given pages, decoded in one layer."""
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, {quoted(entity)}, {quoted(char)})"
    return x


def feature_tokens(x: str) -> str:
    punctuation = ".,-/#!$%^&*;:{}=_`~()@+?><[]'\"|\n–"
    spaced = f"translate({x}, {quoted(punctuation)}, {quoted(' ' * len(punctuation))})"
    words = f"regexp_split_to_array(lower({spaced}), {quoted(SPACE + '+')})"
    return f"list_filter({words}, lambda w: length(w) > 3)"


def body_tokens(x: str) -> str:
    for pattern in (r"(?s)\{\{.*?\}\}", r"\[\[.*:.*\]\]", r"\[([^\[\]]*)\]", "<[^>]*>", "</[^>]*>"):
        x = f"regexp_replace({x}, {quoted(pattern)}, ' ', 'g')"
    return feature_tokens(x)


def reduced(x: str) -> str:
    x = f"regexp_replace({x}, {quoted(r'[^\p{L}\p{N} ]')}, ' ', 'g')"
    return f"trim(lower(regexp_replace({x}, ' {{2,}}', ' ', 'g')), ' ')"


SKIPPED = ["Wikipedia", "Talk:", "User:", "User talk:", "Category:", "Category talk:", "Template:", "File:"]
NO_REDIRECT_TEXT = "not (starts_with(text, '#redirect') or starts_with(text, '#REDIRECT'))"
ARTICLE_TITLE = "not (" + " or ".join(f"starts_with(title, {quoted(s)})" for s in SKIPPED) + ")"

PARTS: dict[str, str] = {
    "words": rf"""
        select word, count(*) as n, min(doc_id) as owner
        from (select doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) as word from documents)
        group by word""",
    "ranked": """
        select owner, word, row_number() over w - 1 as r, lag(word) over w as before, lead(word) over w as after,
               first_value(word) over w as head
        from words window w as (partition by owner order by n desc, word)""",
    "owned": """
        select owner, word, r,
               case when r % 10 = 8 and after is not null then after when r % 10 = 9 then before
                    when r % 50 = 25 then word when r % 4 = 0 then head else before end as target
        from ranked""",
    "article": f"""
        select d.doc_id * {ID_STEP} as id, 0 as ns, coalesce({cap('w.word')}, 'Document ' || d.doc_id) as title,
               cast(null as varchar) as redirect, d.doc_id + 500000 as rid, {date_of('d.doc_id')} as date,
               {_wiki('d.text')} as text, d.text as plain
        from documents d left join owned w on w.owner = d.doc_id and w.r = 0""",
    "dump_page": f"""
        select id, ns, title, redirect, rid, date, text from article
        union all
        select owner * {ID_STEP} + r, 0, {cap('word')}, {cap('target')}, owner * {ID_STEP} + r + 1, {date_of('owner')},
               case r % 3 when 0 then '#REDIRECT ' when 1 then '#redirect ' else '#Redirect ' end
               || '[[' || {cap('target')} || ']]'
        from owned where r > 0
        union all
        select page_id * {ID_STEP} + {ID_STEP - 1}, [1, 2, 4, 14, 10, 0][page_id % 6 + 1],
               ['Talk:', 'User:', 'Wikipedia:', 'Category:', 'Template:', 'Wikipedia '][page_id % 6 + 1] || url,
               null, page_id + 900000, {date_of('page_id')}, case when page_id % 12 <> 11 then html end
        from pages""",
    "document": f"""
        select id, title, {decoded('text')} as body from dump_page
        where text is not null and {NO_REDIRECT_TEXT} and {ARTICLE_TITLE}""",
    "feature": f"""
        select id, 'title' as type, unnest({feature_tokens('title')}) as value from document
        union all
        select id, 'body', unnest({body_tokens('body')}) from document""",
    "search_article": f"""
        select id as aid, title, rid, date, {reduced("coalesce(text, '')")} as text, coalesce(text, '') as wiki
        from dump_page where ns = 0 and {NO_REDIRECT_TEXT.replace('text', "coalesce(text, '')")}""",
    "questions": "select item_id as qid, text as query from benchmark",
    "page": """
        select id, rid as rev, date, case when redirect is not null then 1 else 0 end as type,
               length(coalesce(text, '')) as length, title
        from dump_page where ns = 0""",
    "redirect": "select title as src, redirect as dst from dump_page where ns = 0 and redirect is not null",
    "link_parts": r"""
        select id, title, length(text) as total, regexp_extract_all(text, '\[\[([^\]]*)\]\]', 1) as inners,
               regexp_split_to_array(text, '\[\[[^\]]*\]\]') as gaps
        from dump_page where ns = 0 and redirect is null and text is not null""",
    "link_rows": """
        select id, title, total, n, inners[n] as body, length(gaps[n]) as gap
        from (select *, unnest(range(1, len(inners) + 1)) as n from link_parts)""",
    "link_spots": """
        select id, title, total, split_part(split_part(body, '|', 1), '#', 1) as target,
               cast(sum(gap + length(body) + 4) over (partition by id order by n) - length(body) - 4 as int) as pos
        from link_rows""",
    "title_link": f"""
        select title as src, {cap('target')} as dst, pos, pos / total as frac from link_spots where target <> ''""",
    "id_link": """
        select s.id as src, d.id as dst, l.frac
        from title_link l join page s on l.src = s.title join page d on l.dst = d.title""",
    "id_redirect": """
        select s.id as src, d.id as dst
        from redirect l join page s on l.src = s.title join page d on l.dst = d.title""",
    "reach": """
        select src, dst from id_redirect
        union
        select reach.src, e.dst from reach join id_redirect e on reach.dst = e.src""",
    "final_redirect": "select src, dst from reach where dst not in (select src from id_redirect)",
    "final_link": """
        select l.src, l.dst as dst0, coalesce(f.dst, l.dst) as dst, l.frac
        from id_link l left join final_redirect f on l.dst = f.src""",
    "diffs": "select strftime(date, '%Y-%m-%d %H:%M:%S') as time, plain as words from article",
    "vocab": "select word as token, row_number() over (order by word) - 1 as idx from words",
    "spoken": rf"""
        select cast(date_trunc('month', cast(time as timestamp)) as date) as month,
               unnest(regexp_extract_all(lower(words), '{TOKEN}')) as token
        from diffs""",
    "counts": """
        select month, idx, count(*) as count from spoken join vocab using (token)
        where month between date '2001-01-01' and date '2016-12-01' group by month, idx""",
    "all_months": """
        select cast(unnest(generate_series(timestamp '2001-01-01', timestamp '2016-12-01', interval 1 month)) as date)
               as month""",
    "dense": """
        select m.month, v.idx, coalesce(c.count, 0) as count
        from all_months m cross join vocab v left join counts c on c.month = m.month and c.idx = v.idx""",
    "used": "select month, idx, count from counts where month <= date '2016-09-01'",
    "cumul": "select month, idx, count, cast(sum(count) over (partition by idx order by month) as bigint) as cumul from used",
    "month_sums": """
        select m.month, sum(coalesce(s.count, 0)) over (order by m.month) as total
        from all_months m left join (select month, sum(count) as count from used group by month) s on s.month = m.month
        where m.month <= date '2016-09-01'""",
    "freqs": "select c.month, c.idx, c.cumul / nullif(t.total, 0) as freq from cumul c join month_sums t on t.month = c.month",
    "asked_tokens": rf"select distinct unnest(regexp_extract_all(lower(query), '{TOKEN}')) as token from questions",
    "labels_asked": f"select {cap('token')} as label from asked_tokens union select token || '_x' from asked_tokens",
    "known": "select a.label, v.idx from labels_asked a join vocab v on v.token = lower(a.label)",
    "known_months": """
        select k.label, m.month, cast(sum(coalesce(u.count, 0)) over (partition by k.label order by m.month) as bigint) as cumul
        from known k cross join (select * from all_months where month <= date '2016-09-01') m
        left join used u on u.idx = k.idx and u.month = m.month""",
    "series": """
        select k.label as token, strftime(k.month, '%Y-%m-%d') as date, k.cumul / nullif(t.total, 0) as freq
        from known_months k join month_sums t on t.month = k.month
        union all
        select label, strftime(month, '%Y-%m-%d'), 0.0 from (select label from labels_asked except select label from known)
        cross join (select * from all_months where month <= date '2016-09-01')""",
    "messages": """
        select concat(case when event_type = 'error' then 'https://www.example.org/wiki/'
                      else concat('https://', case when user_id % 2 = 0 then 'en' else 'de' end, '.wikipedia.org/wiki/') end,
                      case event_id % 4 when 0 then concat('Page_', user_id) when 1 then concat('C%2B%2B+', user_id)
                      when 2 then concat('Page_', user_id, '#Top') else concat('#', user_id, '#x') end) as url,
               cast(epoch_us(ts) // 1000 as double) as timestamp
        from events""",
    "parsed": r"""
        select url, timestamp, regexp_extract(url, '^https?://([a-z]{2}).wikipedia.org/wiki/(.*)', 1) as lang,
               regexp_extract(url, '^https?://([a-z]{2}).wikipedia.org/wiki/(.*)', 2) as path
        from messages where regexp_matches(url, '^https?://([a-z]{2}).wikipedia.org/wiki/(.*)')""",
    "views": r"""
        select lang, timestamp,
               case when starts_with(path, '#') then regexp_extract(path, '^([#]*)#(.*)', 1) else path end as title
        from parsed where regexp_matches(url, '^https?://[a-z]{2}\.wikipedia\.org')""",
}


def scored_parts(field: str) -> dict[str, str]:
    """Ranked match of ``questions`` on a field of ``search_article``."""
    return {
        f"t_{field}": rf"select aid as id, regexp_extract_all(lower({field}), '[\p{{L}}\p{{N}}_]+') as terms from search_article",
        f"p_{field}": f"""
            select id, term, len, count(*) as tf
            from (select id, len(terms) as len, unnest(terms) as term from t_{field}) group by all""",
        f"c_{field}": f"select count(*) as docs, avg(len(terms)) as mean from t_{field} where len(terms) > 0",
        f"d_{field}": f"select term, count(*) as df from p_{field} group by term",
        f"s_{field}": f"""
            select qid, id, round(sum(times * ln(1 + (docs - df + 0.5) / (df + 0.5))
                   * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) as score
            from asked join p_{field} using (term) join d_{field} using (term) cross join c_{field} group by qid, id""",
    }


PARTS["asked"] = r"""
    select qid, term, count(*) as times
    from (select qid, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')) as term from questions) group by all"""
PARTS |= scored_parts("title") | scored_parts("text")
PARTS["s_best"] = """
    select qid, id, max(score) as score from (select * from s_title union all select * from s_text) group by qid, id"""
for _name in ("title", "text", "best"):
    PARTS[f"h_{_name}"] = f"""
        select s.qid, cast(row_number() over (partition by s.qid order by s.score desc, s.id) as int) as rank,
               s.id as aid, a.title, s.score
        from s_{_name} s join search_article a on a.aid = s.id"""


PARTS["long_words"] = rf"""
    select qid, list_filter(regexp_extract_all(lower(query), '{TOKEN}'), lambda w: length(w) > 5) as w from questions"""
PARTS["like_queries"] = f"""
    select qid + 100 as qid, '@' || substr(w[1], 1, 3) || ' ' || substr(w[1], 1, 4) || ' @' || substr(w[2], 2, 4) as query
    from long_words where len(w) > 1
    union all values {", ".join(f"({qid}, {quoted(query)})" for qid, query in LIKE_QUERIES)}"""
PARTS["like_terms"] = "select qid, unnest(string_split(query, ' ')) as term from like_queries"
PARTS["like_conditions"] = """
    select distinct qid, type, ltrim(term, '@') as term from like_terms cross join (values ('title'), ('body')) k(type)
    where type = 'title' or not starts_with(term, '@')"""
PARTS["feature_values"] = "select distinct type, value from feature"
PARTS["like_values"] = """
    select distinct c.type, c.term, v.value
    from (select distinct type, term from like_conditions) c join feature_values v on v.type = c.type and v.value ilike '%' || c.term || '%'"""
PARTS["like_met"] = """
    select distinct c.qid, c.type, c.term, f.id
    from like_conditions c join like_values v on v.type = c.type and v.term = c.term
    join feature f on f.type = v.type and f.value = v.value"""
PARTS["like_needed"] = "select qid, count(*) as needed from like_conditions group by qid"
LIKE_SQL = """
    select m.qid, m.id from (select qid, id, count(*) as met from like_met group by qid, id) m
    join like_needed n on n.qid = m.qid and n.needed = m.met"""


def check(final: str, **extra: str) -> str:
    """``final`` with the parts it names, and those they name, put before it."""
    parts = PARTS | extra
    found: list[str] = []

    def collect(body: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b(?:from|join) (\w+)", body)):
            if word in parts and word not in found and parts[word] is not body:
                collect(parts[word])
                if word not in found:
                    found.append(word)

    collect(final)
    if not found:
        return final
    listed = ", ".join(f"{name} as ({parts[name]})" for name in found)
    return f"with recursive {listed} {final}"
