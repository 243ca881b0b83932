"""Plain text and segments of wikitext, inside each row.

Templates, links, comments and literal blocks are found by folds over the marks of the text, so a
row costs what it is long, however deep its marks nest and however many have no partner. Marks
without a partner are text. The rest are ordered replacements.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entities import unescape, unescape_closed
from ..functions.text import escape_link, let, normalize_text

# Link starts that are dropped, tags whose contents are dropped from plain text,
# tags whose contents are no markup, the template start that makes a footnote, and the schemes of external links.
MEDIA_LINKS = "Image:|Category:|File:"
DROPPED_TAGS = "gallery|ref"
LITERAL_TAGS = "nowiki|pre"
CITE = "cite"
SCHEMES = "(?:https?:|ftps?:|irc:|gopher:|news:)//|mailto:"
SCHEME_MARKS, SCHEME_STARTS = ("://", "mailto:"), "hfignm"  # that they hold and start with

# Pieces of a text that are a mark or lie between marks; each pattern takes every character once.
BRACES = r"\{{2,}(?:\s*" + CITE + r")?|\}{2,}|[{}]|[^{}]++"
BRACKETS = (
    r"\[\[(?:" + MEDIA_LINKS + r"|(?=[^\[\]|]*+(?:\||\]\]|\[\[)))|\]\]|\||"  # a target holds no single brackets
    r"\[[^\[\]]*+\]|[\[\]]|[^\[\]|]++"
)
# Templates, arguments and links that hold no other: taking
# them out leaves the partners of all other marks as they are. Patterns start with what they look for, and look behind
# after it: a pattern that looks behind first does so at every character.
SINGLE_ARGUMENT = r"(?<!\{)\{{3}[^{}]*+\}{3}(?!\})"
def _alone(inside: str) -> str:
    """Template of those contents; one that ends where others end must not leave or join a single brace."""
    return rf"\{{\{{(?:(?<![{{}}]\{{\{{){inside}\}}\}}(?:(?!\}})|(?=\}}\}}))|(?<=\}}\{{\{{){inside}\}}\}}(?!\}}))"


SINGLE_TEMPLATE = _alone("[^{}]*+")
SINGLE_CITE = _alone(r"\s*" + CITE + "[^{}]*+")
_MEDIA = r"(?:" + MEDIA_LINKS + r")[^\[\]]*+\]\]"
SINGLE_MEDIA = rf"\[\[(?:(?<![\[\]]\[\[){_MEDIA}|(?<=\]\[\[){_MEDIA}(?!\]))"
SINGLE_LINK = r"\[\[(?<!\[\[\[)([^\[\]|]++)(?:\|[^\[\]]*+)?\]\]"
BLOCKS = r"<!--|-->|</?(?:" + LITERAL_TAGS + r")(?:\s[^<>]*+)?+(?<!/)>|[^<-]++|[<-]"
HEADING = r"(?md)^(={1,6})(.+?)\1[ \t]*$"
EXTERNAL = r"\[((?:" + SCHEMES + r")[^\s\[\]]*+)[ \t]*([^\[\]]*+)\]"
BARE_URL = r"\b(?:" + SCHEMES + r")[^\s\[\]<>{}|\x{E000}-\x{E01F}]++"
TAG = r"</?[a-zA-Z][^<>]*+>"
TABLE = r"(?md)^[ \t]*(?:\{\|.*|\|\}|\|-.*|[|!](?:[^|\n\[{]*+\|(?!\|))?)"
QUOTES = "'{2,}"
LIST_MARKS = "(?m)^[*#:;]+"
RULE = "(?md)^-{4,}"

# Marks that stand for a footnote and around a link target; private-use characters.
NOTE, LINK_OPEN, LINK_CLOSE = "\ue001", "\ue002", "\ue003"
MARK_BYTES = len((LINK_OPEN + LINK_CLOSE).encode()) - 2  # More than their characters.
# Characters that mark something up, and those that stand for them where they are text.
MARKUP = "[]{}<>|!='*#:;-"
LITERAL = "".join(chr(0xE010 + i) for i in range(len(MARKUP)))
LITERAL_BYTES = b"\xee\x80"  # All of them start like this in UTF-8.

#: Innermost levels that are taken by replacement; the fold, slower on plain rows, meets what is left.
LEVELS = 2
#: Pieces whose results are put together before they join those of the whole text.
CHUNK = 64


def _scan(items: Column, state: Column, out: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What a fold over ``items`` gives out, as an array with an entry for each `CHUNK` items.

    ``step`` makes the next state and an addition to ``out`` (a string or an array) of a state and
    an item. Adding each to one result for the whole text would copy that as often as there are items.
    """

    def fold(known: Column) -> Column:  # items by place: a slice would read all of them for each chunk
        def one(acc: Column, place: Column) -> Column:
            after, more = step(acc["state"], F.get(known, place))
            return F.struct(after.alias("state"), F.concat(acc["out"], more).alias("out"))

        def chunk(acc: Column, first: Column) -> Column:
            start = F.struct(acc["state"].alias("state"), out.alias("out"))
            return let(
                F.aggregate(F.sequence(first, F.least(first + CHUNK, F.size(known)) - 1), start, one),
                lambda done: F.struct(done["state"].alias("state"), F.concat(acc["outs"], F.array(done["out"])).alias("outs")),
            )

        start = F.struct(state.alias("state"), F.slice(F.array(out), 1, 0).alias("outs"))
        return F.aggregate(F.sequence(F.lit(0), F.size(known) - 1, F.lit(CHUNK)), start, chunk, lambda acc: acc["outs"])

    return let(items, fold)


def _ints() -> Column:
    return F.array().cast("array<int>")


def _holds(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(m)) for m in marks])


def _where(text: Column, marks: tuple[str, ...], *changes: tuple[str, str]) -> Column:
    """``text`` after replacements in turn, where it holds one of ``marks``; the patterns match nothing without."""

    def changed(t: Column) -> Column:
        return reduce(lambda x, change: F.regexp_replace(x, *change), changes, t)

    return let(text, lambda t: F.when(_holds(t, marks), changed(t)).otherwise(t))


def _rewrite(
    text: Column, marks: tuple[str, ...], pieces: str, back: Callable[[Column, Column], tuple[Column, Column]], state: Column,
    step: Callable[[Column, Column, Column], tuple[Column, Column]],
) -> Column:
    """``text`` rewritten piece by piece, where it holds one of ``marks``.

    ``back`` folds from the end and gives an integer for each piece: what follows it. ``step`` folds
    from the start, with a state, a piece and that integer, and gives the text to write.
    """

    def write(found: Column) -> Column:
        known = F.reverse(F.flatten(_scan(F.reverse(found), F.lit(0), _ints(), lambda s, p: _as_array(back(s, p)))))
        both = F.arrays_zip(found.alias("piece"), known.alias("known"))
        return let(both, lambda z: F.array_join(_scan(z, state, F.lit(""), lambda s, p: step(s, p["piece"], p["known"])), ""))

    return let(text, lambda t: F.when(_holds(t, marks), let(F.regexp_extract_all(t, F.lit(pieces), 0), write)).otherwise(t))


def _as_array(result: tuple[Column, Column]) -> tuple[Column, Column]:
    return result[0], F.array(result[1])


def _without_templates(text: Column, cite: str = "") -> Column:
    """``text`` without templates and arguments; ``cite`` stands for a cite template that is in no other.

    Braces count one by one in runs of two or more, so ``{{{a|{{b}}}}}`` closes both of its marks. A single
    one that is left of a run that opens something goes with it.
    """

    def width(piece: Column) -> Column:
        return F.length(piece) - F.length(F.ltrim(piece, F.lit("{")))

    def back(closing: Column, piece: Column) -> tuple[Column, Column]:
        opening = F.when(piece.startswith("{{"), F.least(width(piece), closing)).otherwise(0)
        more = F.when(piece.startswith("}}"), F.length(piece)).otherwise(0)
        return closing + more - opening, opening

    def step(depth: Column, piece: Column, opening: Column) -> tuple[Column, Column]:
        closes = piece.startswith("}}")
        left = width(piece) - opening
        before = F.when(left >= 2, F.substring(piece, F.lit(1), left)).otherwise("")
        note = F.when((opening == 2) & piece.endswith(CITE), cite).otherwise("")
        after = F.when(closes, F.greatest(depth - F.length(piece), F.lit(0))).otherwise(depth + opening)
        written = (
            F.when(closes, F.substring(piece, depth + 1, F.length(piece)))
            .when(depth > 0, "").when(opening > 0, F.concat(before, note)).otherwise(piece)
        )
        return after, written

    for _ in range(LEVELS):
        text = _where(text, ("{{{",), (SINGLE_ARGUMENT, ""))
        text = _where(text, ("{{",), *([(SINGLE_CITE, cite)] if cite else []), (SINGLE_TEMPLATE, ""))
    return _rewrite(text, ("{{",), BRACES, back, F.lit(0), step)


def _with_targets(text: Column, opened: str = "", closed: str = "") -> Column:
    """``text`` with links as their targets, between ``opened`` and ``closed``, and without media links.

    The state is how deep in links a piece lies and how deep the link is that hides it: a media
    link from its start, another from its first pipe.
    """

    def back(closing: Column, piece: Column) -> tuple[Column, Column]:
        opens = F.when(piece.startswith("[["), F.least(closing, F.lit(1))).otherwise(0)
        return closing + F.when(piece == "]]", 1).otherwise(0) - opens, opens

    def step(state: Column, piece: Column, opens: Column) -> tuple[Column, Column]:
        depth, hidden = state["depth"], state["hidden"]
        seen, inside = hidden == 0, depth > 0
        media = F.length(piece) > 2
        closes, pipe = inside & (piece == "]]"), inside & (piece == "|")
        depth_after = F.when(opens > 0, depth + 1).when(closes, depth - 1).otherwise(depth)
        hidden_after = (
            F.when((opens > 0) & seen & media, depth + 1).when(closes & (hidden == depth), 0).when(pipe & seen, depth).otherwise(hidden)
        )
        outer_end = F.when(seen & (depth == 1), closed).otherwise("")
        written = (
            F.when(opens > 0, F.when(media | inside, "").otherwise(opened))
            .when(closes | pipe, outer_end).when(seen, piece).otherwise("")
        )
        return F.struct(depth_after.alias("depth"), hidden_after.alias("hidden")), written

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("hidden"))
    for _ in range(LEVELS):
        text = _where(text, tuple("[[" + start for start in MEDIA_LINKS.split("|")), (SINGLE_MEDIA, ""))
        text = _where(text, ("[[",), (SINGLE_LINK, f"{opened}$1{closed}"))
    return _rewrite(text, ("[[",), BRACKETS, back, start, step)


def _literal_blocks(wiki: Column) -> Column:
    """``wiki`` without comments, and with the contents of literal tags as text: see ``LITERAL``.

    What opens first holds up to its own end; what has no end is text. Where a row has such a block,
    characters of ``LITERAL`` that it holds itself are dropped.
    """
    kinds = {"<!--": 1, "<nowiki": 2, "<pre": 4}
    ends = {"-->": 1, "</nowiki": 2, "</pre": 4}

    def kind(piece: Column, starts: dict[str, int]) -> Column:
        found = F.lit(0)
        for start, number in starts.items():
            found = F.when(piece.startswith(start), number).otherwise(found)
        return F.when(F.left(piece, F.lit(1)).isin("<", "-"), found).otherwise(0)

    def back(ended: Column, piece: Column) -> tuple[Column, Column]:
        return ended.bitwiseOR(kind(piece, ends)), ended

    def step(block: Column, piece: Column, ended: Column) -> tuple[Column, Column]:
        opens = F.when(block == 0, kind(piece, kinds).bitwiseAND(ended)).otherwise(0)
        closes = (block > 0) & (kind(piece, ends) == block)
        written = F.when((opens > 0) | closes | (block == 1), "").when(block > 0, F.translate(piece, MARKUP, LITERAL)).otherwise(piece)
        return F.when(closes, 0).when(opens > 0, opens).otherwise(block), written

    some = ("<!--", *("<" + tag for tag in LITERAL_TAGS.split("|")))
    own = let(wiki, lambda t: F.when(_holds(t, some), F.translate(t, LITERAL, "")).otherwise(t))
    return _rewrite(own, some, BLOCKS, back, F.lit(0), step)


def _as_written(text: Column) -> Column:
    return F.translate(text, LITERAL, MARKUP)


def _drop_tags(text: Column, tags: str, mark: str) -> Column:
    """``text`` with ``mark`` for the tags and what they hold; only what lies ahead of the last end of each is searched."""

    def without(tag: str) -> Callable[[Column], Column]:
        def change(t: Column) -> Column:
            end = F.length(F.regexp_extract(t, rf"(?s)^.*</{tag}\s*+>", 0))
            held = F.regexp_replace(F.substring(t, F.lit(1), end), rf"(?s)<{tag}\b[^<>]*>.*?</{tag}\s*>", mark)
            return F.when(F.contains(t, F.lit(f"</{tag}")), F.concat(held, F.substring(t, end + 1, F.length(t)))).otherwise(t)

        return change

    text = F.regexp_replace(text, rf"<(?:{tags})\b[^<>]*/>", mark)
    for tag in tags.split("|"):
        text = let(text, without(tag))
    return text


def to_plain_text(wiki: Column) -> Column:
    """Readable text of decoded wikitext; a link reads as its target, the contents of ``nowiki`` and ``pre`` as they are."""
    text = _drop_tags(_literal_blocks(wiki), DROPPED_TAGS, "")
    text = _with_targets(_without_templates(text))
    text = _where(F.regexp_replace(text, EXTERNAL, "$2"), SCHEME_MARKS, (BARE_URL, ""))
    text = F.regexp_replace(text, HEADING, "$2")
    text = _where(text, ("<", "|", "!", "''", "----"), (TAG, ""), (TABLE, ""), (QUOTES, ""), (RULE, ""))
    text = F.regexp_replace(text, LIST_MARKS, "")
    return let(text, lambda t: F.when(F.contains(t.cast("binary"), F.lit(LITERAL_BYTES)), _as_written(t)).otherwise(t))


def plain_text(articles: DataFrame) -> DataFrame:
    """``(aid, text)`` of the ``wiki`` column."""
    plain = articles.select("aid", _once(to_plain_text(unescape(F.col("wiki")))).alias("text"))
    return plain.select("aid", normalize_text(unescape_closed(F.col("text"))).alias("text"))


def _once(text: Column) -> Column:
    """``text`` as a generator of one row, so that later steps read it and do not compute it again."""
    return F.explode(F.array(text))


def _segment(pos: Column, kind: str, target: Column | None = None, label: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        pos.alias("pos"),
        F.lit(kind).alias("kind"),
        (none if target is None else target).alias("target"),
        (none if label is None else label).alias("label"),
    )


def segments_of(wiki: Column) -> Column:
    """Array of ``(pos, kind, target, label)`` for decoded wikitext, in text order.

    Kinds are link, heading, external and note; a note is a ``ref`` tag or a ``cite`` template.
    Nothing inside another template, a media link or a ``ref`` is listed.
    """

    text = reduce(lambda x, mark: F.replace(x, F.lit(mark), F.lit("")), (NOTE, LINK_OPEN, LINK_CLOSE), _literal_blocks(wiki))
    text = _drop_tags(_without_templates(text, NOTE), "ref", NOTE)
    text = _with_targets(text, LINK_OPEN, LINK_CLOSE)
    link = f"{LINK_OPEN}([^{LINK_CLOSE}]*){LINK_CLOSE}"
    any_segment = "|".join([HEADING, NOTE, link, EXTERNAL, f"(?=[{SCHEME_STARTS}])" + BARE_URL])
    found = F.regexp_extract_all(text, F.lit(any_segment), 0)

    def describe(s: Column, pos: Column) -> Column:
        first = F.left(s, F.lit(1))
        heading = F.translate(s, LINK_OPEN + LINK_CLOSE + NOTE, "")
        # Only ASCII between its marks holds nothing to translate.
        inside = F.when(
            F.octet_length(s) - F.length(s) == MARK_BYTES, F.substring(s, F.lit(2), F.length(s) - 2)
        ).otherwise(F.translate(s, LITERAL + LINK_OPEN + LINK_CLOSE + NOTE, MARKUP))
        url = _as_written(F.when(first == "[", F.regexp_extract(s, EXTERNAL, 1)).otherwise(s))
        words = _as_written(F.when(first == "[", F.regexp_extract(s, EXTERNAL, 2)).otherwise(""))
        return (
            F.when(first == LINK_OPEN, _segment(pos, "link", escape_link(inside), inside))
            .when(first == NOTE, _segment(pos, "note"))
            .when(first == "=", _segment(pos, "heading", label=_as_written(F.trim(F.regexp_extract(heading, HEADING, 2)))))
            .otherwise(_segment(pos, "external", url, F.when(words != "", words).otherwise(url)))
        )

    return F.transform(found, describe)


def markup_segments(articles: DataFrame) -> DataFrame:
    """``(aid, pos, kind, target, label)`` rows of the ``wiki`` column; ``pos`` counts segments."""
    return articles.select("aid", F.inline(segments_of(unescape(F.col("wiki")))))


def footnote_numbers(articles: DataFrame) -> DataFrame:
    """``(aid, pos, number)`` of the notes, numbered from 1 in each article.

    The number is the place among the notes of the row, so nothing is shuffled.
    """
    notes = F.filter(segments_of(unescape(F.col("wiki"))), lambda s: s["kind"] == "note")
    numbered = articles.select("aid", F.posexplode(notes).alias("n", "note"))
    return numbered.select("aid", "note.pos", (F.col("n") + 1).alias("number"))


def text_and_segments(articles: DataFrame) -> DataFrame:
    """``(aid, text, segments)`` from one decoded scan."""
    decoded = articles.select("aid", unescape(F.col("wiki")).alias("wiki"))
    both = decoded.select("aid", segments_of(F.col("wiki")).alias("segments"), _once(to_plain_text(F.col("wiki"))).alias("text"))
    return both.select("aid", normalize_text(unescape_closed(F.col("text"))).alias("text"), "segments")
