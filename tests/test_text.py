import random
import re
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from folioscope.functions import calendar as cal
from folioscope.functions import text as tx
from folioscope.functions import visits as v
from folioscope.functions.entities import unescape, unescape_closed
from folioscope.operators.graph import link_spans

PIECES = ["[[", "]]", "[", "]", "{{", "}}", "{", "}", ":", "|", "#", "\n", " ", "<b>", "</b>", "<", ">", "word",
          "File", "Ünder_bar", "été", "x", "\t", "\u00a0", "\r", "\u2028", "日本語の", "–", "a.b", "'quoted'"]


def texts(count, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(count)]


def run(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "n INT, t STRING").select("n", expression.alias("out"))
    return [r["out"] for r in rows.orderBy("n").collect()]


def words_of(text):
    for mark in tx.PUNCTUATION:
        text = text.replace(mark, " ")
    return [w for w in text.lower().split() if len(w) > 3]


def test_title_tokens_follow_python_splitting(spark):
    values = texts(400, 1) + ["Talk: A-B_c (disambiguation)", "", "abc abcd ABCD abcd"]
    assert run(spark, values, tx.title_tokens(F.col("t"))) == [words_of(t) for t in values]


def test_body_tokens_strip_in_order(spark):
    def expected(text):
        text = re.sub(r"{{.*?}}", " ", text, flags=re.DOTALL)
        text = re.sub(r"\[\[.*:.*\]\]", " ", text)
        text = re.sub(r"\[[^\[\]]*\]", " ", text)
        text = re.sub(r"<[^>]*>", " ", text)
        return words_of(text)

    values = texts(1500, 2) + ["[[plain]] stay", "[[a]] lost [[b:c]] kept [[d]]\n[[e]] kept2", "[[a:b\n]] word"]
    assert run(spark, values, tx.body_tokens(F.col("t"))) == [expected(t) for t in values]


def test_link_spans_equal_finditer(spark):
    def expected(text):
        return [(m[1], m.start()) for m in re.finditer(r"\[\[([^\]]*)\]\]", text)]

    values = texts(1500, 3) + ["[[File:a|x [[B]] y", "é" * 50 + "[[z]]" * 300, ""]
    got = run(spark, values, link_spans(F.col("t")))
    assert [[(s["inner"], s["pos"]) for s in spans] for spans in got] == [expected(t) for t in values]


def test_normalize_text_equals_line_by_line(spark):
    def expected(text):
        text = "\n".join(line.strip() for line in text.split("\n"))
        return re.sub(r"\n{2,}", "\n\n", text).strip()

    rng = random.Random(4)
    values = ["".join(rng.choice(["a", "b c", "\n", "\n", " ", "\t", "\u00a0", "\u3000", "\x1f"]) for _ in range(25)) for _ in range(800)]
    assert run(spark, values, tx.normalize_text(F.col("t"))) == [expected(t) for t in values]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 1000])
def test_running_sum(spark, n):
    steps = [(k * 37) % 11 for k in range(n)]
    out = spark.createDataFrame([(steps,)], "s ARRAY<INT>").select(tx.running_sum(F.col("s")).alias("o")).first()["o"]
    assert out == [sum(steps[: k + 1]) for k in range(n)]


@pytest.mark.parametrize("text, reduced", [
    ("A_b  c\nd!", "a b c d"), ("''Été'' [[x]]", "été x"), ("", ""), ("--", ""), ("x²½", "x²½"),
])
def test_reduce_text(one, text, reduced):
    assert one(tx.reduce_text(F.col("t")), t=text) == reduced


def test_count_tokens(one):
    assert one(tx.count_tokens(F.col("t")), t="A an AN_1 é éa x-yz") == ["an", "an_1", "éa", "yz"]


@pytest.mark.parametrize("text, out", [("éa b", "Éa b"), ("", ""), ("ABC", "ABC"), ("ß", "SS"), ("x", "X")])
def test_capitalize(one, text, out):
    assert one(tx.capitalize(F.col("t")), t=text) == out


def test_normalize_html(one):
    assert one(tx.normalize_html(F.col("t")), t=" a<br/><br/><br/>b<br/>c \n") == "a<br/>b<br/>c"


def test_links_to_and_from_addresses(one):
    assert one(tx.escape_link(F.col("t")), t="A b_c d") == "A_b_c_d"
    assert one(tx.unescape_link(F.col("t")), t="A_b c") == "A b c"


@pytest.mark.parametrize("text, out", [
    ("a&nbsp;b", "a b"), ("a\u00a0b", "a b"), ("&#233;&eacute;", "éé"), ("1 &lt 2", "1 < 2"), ("&bogus;", "&bogus;"),
    ("&amp;lt;", "&lt;"), ("plain", "plain"), (None, None),
])
def test_unescape(spark, text, out):
    assert run(spark, [text], unescape(F.col("t"))) == [out]


def test_unescape_closed_needs_the_semicolon(spark):
    assert run(spark, ["&lt &lt; &#65;"], unescape_closed(F.col("t"))) == ["&lt < A"]


def test_percent_decode_equals_unquote(spark):
    values = ["C%2B%2B+x", "100%", "%zz%41", "%C3%A9t%C3%A9", "a%2", "", "%25"]
    assert run(spark, values, v.percent_decode(F.col("t"))) == [unquote(t) for t in values]


@pytest.mark.parametrize("path, as_written, stripped", [
    ("A#b", "A#b", "A"), ("#1#x", "", ""), ("##x", "#", ""), ("A", "A", "A"), ("", "", ""),
])
def test_view_fragment(one, path, as_written, stripped):
    assert one(v.view_fragment(F.col("t")), t=path) == as_written
    assert one(v.view_fragment(F.col("t"), strip_fragment=True), t=path) == stripped


def test_view_time_subtracts_the_offset(one):
    assert one(v.view_time(F.lit(1704067259999.0))) == "2024-01-01 05:00"
    assert one(v.view_time(F.lit(1704067200000.0), utc_offset=3)) == "2023-12-31 21:00"


def test_months(one):
    assert one(F.size(cal.month_sequence())) == 189
    assert one(F.size(cal.month_sequence(last=cal.LAST_COUNTED_MONTH))) == 192
    month = cal.month_key(F.lit("2009-03-17 10:00:00").cast("timestamp"))
    assert (one(cal.month_label(month)), one(cal.month_date(month))) == ("2009_3", "2009-03-01")
    assert str(one(cal.label_month(F.lit("2009_3")))) == "2009-03-01"
