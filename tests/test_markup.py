import random
import re
import time

import pytest

from folioscope.operators import markup as mk


def one(spark, wiki, job):
    return job(spark.createDataFrame([(1, wiki)], "aid BIGINT, wiki STRING"))


CASES = [
    ("'''Bold''' and ''it''", "Bold and it"),
    ("a {{t|{{u|{{v}} x}} y}} b {{{arg|d}}} c", "a  b  c"),
    ("{{a|{{b|{{c|{{d|{{e|{{f|{{g|{{h}}}}}}}}}}}}}}}}end", "end"),
    ("{{t|{single} brace}} k", "k"),
    ("x <!-- gone\n{{ --> y", "x  y"),
    ("n<ref name=a>[[In ref]]</ref> m<ref name=b/> o", "n m o"),
    ("<gallery>\nFile:a.jpg|x\n</gallery>z", "z"),
    ("<div class=\"c\">kept <b>too</b></div>", "kept too"),
    ("[[Target|label]] [[Plain]] [[A#b|c]]", "Target Plain A#b"),
    ("[[File:a.jpg|thumb|see [[Other|this]] ok]]after [[Category:C]]end [[Image:x]]!", "after end !"),
    ("[http://x.org the title] [http://x.org] see http://y.org/a_b now", "the title  see  now"),
    ("== Head ==\ntext\n=== Sub [[L]] ===\n\n\n\nmore", "Head\ntext\nSub L\n\nmore"),
    ("* one\n** two\n# three\n: four", "one\ntwo\nthree\nfour"),
    ("&lt;b&gt;x&lt;/b&gt; &amp;eacute; &amp;amp;", "x é &"),
    ("  a  \n\n \n  b ", "a\n\nb"),
    ("", ""),
    ("<nowiki>{{x}} [[y]]</nowiki> z", "{{x}} [[y]] z"),
    ("a<nowiki/>b <nowiki> {{t}} c", "ab   c"),
    ("{{t|<nowiki>}}</nowiki> in}} out", "out"),
    ("<pre>\n* {{x}}\n== no ==\n</pre>\n== Yes ==", "* {{x}}\n== no ==\n\nYes"),
    ("<!-- <nowiki> --> [[a]] <nowiki><!-- k --></nowiki> <!-- no end {{t}}", "a <!-- k --> <!-- no end"),
    ("<nowiki>[http://x.org y]</nowiki> &amp;lt;", "[http://x.org y] <"),
    ("one\n----\ntwo ---- three\n-----four", "one\n\ntwo ---- three\nfour"),
    ("{{{a|{{b}}}}} {{#if:{{{1|}}}|x}} c {{{{d}}}}", "c"),
    ("{{a {{b}} c [[D|d]] }", "{{a  c D }"),
    ("x}} {{y [[z]] ]] [[ {{w}}", "x}} {{y z ]] [["),
    ("{{x}}} {{{{y}} {{{z}}", "} {{"),
    ("[[A|b [[C|c]] d]] [[E [f] g]] [[File:a [b] c]][[H|[i]]]", "A [[E [f] g]] H"),
    ("[[File:a|x [[B|b]] e", "[[File:a|x B e"),
    ("[[A]]]] | [[|n]] [[B [[C|c]] |d]]", "A]] |  B C"),
    ("a<ref>b <gallery>c</gallery> d</ref> <ref>e", "a e"),
    (None, None),
    ("{| class=x\n|-\n| cell || other\n|}\nend", "cell || other\n\nend"),
]


@pytest.fixture(scope="module")
def plain(spark):
    rows = spark.createDataFrame([(i, wiki) for i, (wiki, _) in enumerate(CASES)], "aid BIGINT, wiki STRING")
    return {row["aid"]: row["text"] for row in mk.plain_text(rows).collect()}


@pytest.mark.parametrize("case", range(len(CASES)), ids=lambda i: str(CASES[i][0]))
def test_plain_text(plain, case):
    assert plain[case] == CASES[case][1]


WIKI = (
    "Intro [[Big Cat|cat]]<ref>see [[Hidden]] {{cite web|x}}</ref> and {{cite book|title=[[In cite]]|n={{x}}}}.\n"
    "== A [[Link]] Head ==\n"
    "[http://x.org the site] [https://y.org] http://z.org/q {{note|<ref>no</ref> {{cite z}} [[no]]}}\n"
    "[[File:f.jpg|cap [[Inner]] end]] <ref name=r /> {{ cite journal}} {{Cite upper}} [[Last]]"
)


def test_segments(spark):
    got = [tuple(r)[1:] for r in one(spark, WIKI, mk.markup_segments).orderBy("pos").collect()]
    assert got == [
        (0, "link", "Big_Cat", "Big Cat"),
        (1, "note", None, None),
        (2, "note", None, None),
        (3, "heading", None, "A Link Head"),
        (4, "external", "http://x.org", "the site"),
        (5, "external", "https://y.org", "https://y.org"),
        (6, "external", "http://z.org/q", "http://z.org/q"),
        (7, "note", None, None),
        (8, "note", None, None),
        (9, "link", "Last", "Last"),
    ]


def test_segments_with_literals(spark):
    wiki = (
        "<nowiki>[[a]] <ref>n</ref> {{cite}}</nowiki> == <!-- [[b]] -->\n== H <nowiki>[[i]]</nowiki> ==\n<pre>== no ==\nhttp://n.org</pre>"
        "[http://x.org a <nowiki>b]</nowiki> c] [[A|b {{cite x}} [[no]]]] {{x {{cite y}} {{{cite z}}} [[B|{{cite in}}]]"
    )
    got = [tuple(r)[2:] for r in one(spark, wiki, mk.markup_segments).orderBy("pos").collect()]
    assert got == [
        ("heading", None, "H [[i]]"), ("external", "http://x.org", "a b] c"), ("link", "A", "A"), ("note", None, None), ("link", "B", "B"),
    ]


def matched(text, pair):
    """Places that lie in marks with a partner, by a stack."""
    opened, inside, i = [], set(), 0
    while i < len(text):
        two = text[i : i + 2]
        if two == pair[0]:
            opened.append(i)
        elif two == pair[1] and opened:
            inside.update(range(opened.pop(), i + 2))
        i += 2 if two in pair else 1
    return inside


def test_random_braces(spark):
    chance = random.Random(5)
    wikis = ["".join(chance.choice(["{{", "}}", "a", " b ", "{c}", "é"]) + "." for _ in range(chance.randrange(300))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(wikis)), "aid INT, wiki STRING")
    got = dict(rows.select("aid", mk._without_templates(mk.F.col("wiki")).alias("t")).collect())
    for i, wiki in enumerate(wikis):
        gone = matched(wiki, ("{{", "}}"))
        assert got[i] == "".join(c for k, c in enumerate(wiki) if k not in gone)


@pytest.mark.parametrize("mark", ["{{a ", "[[a| ", "<!-- ", "<nowiki> ", "<ref> ", "[[File:a "])
def test_marks_without_end_take_linear_time(spark, mark):
    def seconds(n):
        began = time.time()
        assert mark.strip() in one(spark, mark * n + "end", lambda d: d.select(mk._without_templates(mk._with_targets(mk._drop_tags(
            mk._literal_blocks(mk.F.col("wiki")), "ref", ""))).alias("t"))).first()["t"]
        return time.time() - began

    seconds(10)
    assert seconds(8000) < 5


def test_footnotes_are_numbered(spark):
    got = sorted(tuple(r)[1:] for r in one(spark, WIKI, mk.footnote_numbers).collect())
    assert got == [(1, 1), (2, 2), (7, 3), (8, 4)]


def test_both_outputs_agree_with_each_alone(spark):
    both = one(spark, WIKI, mk.text_and_segments).first()
    assert both["text"] == one(spark, WIKI, mk.plain_text).first()["text"]
    assert len(both["segments"]) == one(spark, WIKI, mk.markup_segments).count()


def test_long_and_deep_rows(spark):
    for n in (60, 4000):
        deep = "{{a|" * n + "}}" * n + "[[b " * n + "]]" * n + "[[File:a|" * n + "]]" * n + "end"
        assert one(spark, deep, mk.plain_text).first()["text"].replace("b ", "") == "end"
    deep = "{{a|" * 60 + "}}" * 60 + "end"
    assert one(spark, deep, mk.plain_text).first()["text"] == "end"
    wide = "[[A|b]] {{t|x}} <ref>r</ref>" * 4000
    assert one(spark, wide, mk.footnote_numbers).count() == 4000
    assert one(spark, "{{t|" + "{x} " * 1500 + "}}end", mk.plain_text).first()["text"] == "end"


def test_rows_without_marks_meet_no_pattern_of_them(spark):
    from pyspark.sql import functions as F

    texts = ["plain", None, "", "{{a}}", "{{{b}}}c", "x {{y|{{z}}}} {{{q}}}", "[[File:a|b]]c", "[[a|b]] [[c", "<!-- n -->m", "<nowiki>[[k]]</nowiki>", "<pre>{{p}}</pre>", "}} ]] {{ [["]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "aid INT, wiki STRING")
    plain = df.select("aid", mk.to_plain_text(F.col("wiki")).alias("text"))
    assert [r["text"] for r in plain.orderBy("aid").collect()] == [
        "plain", None, "", "", "c", "x  ", "c", "a [[c", "m", "[[k]]", "{{p}}", "}} ]] {{ [[",
    ]
    # What marks a row holds is asked by searches for strings, not by patterns.
    assert "RLIKE" not in plain._jdf.queryExecution().analyzed().toString().upper()


@pytest.mark.parametrize(
    "pattern, before, inside, mark",
    [
        (mk.SINGLE_TEMPLATE, "{", r"\{\{[^{}]*+\}\}", "}"),
        (mk.SINGLE_CITE, "{", r"\{\{\s*cite[^{}]*+\}\}", "}"),
        (mk.SINGLE_MEDIA, "[", r"\[\[(?:Image:|Category:|File:)[^\[\]]*+\]\]", "]"),
    ],
)
def test_patterns_start_with_what_they_look_for(pattern, before, inside, mark):
    """A pattern that looks behind first does so at every character."""
    followed = rf"(?=\{mark}\{mark})" if mark == "}" else ""
    plain = rf"(?<!\{before}){inside}(?!\{mark})|(?<![\{before}\{mark}]){inside}{followed}"
    assert pattern.startswith(re.escape(before * 2))
    rng = random.Random(4)
    pieces = [before, before * 2, mark, mark * 2, "a", " ", "cite", "File:", "{{cite x}}", "[[File:y]]", "}", "["]
    for _ in range(5_000):
        text = "".join(rng.choices(pieces, k=12))
        assert [m.span() for m in re.finditer(pattern, text)] == [m.span() for m in re.finditer(plain, text)]
