"""Fill-in-the-middle texts against plain slicing, and back."""

import hashlib
import random

from pyspark.sql import functions as F

from folioscope.llm import fill_middle as fm


def plain_version(doc_id, text, seed=1):
    text = text or ""
    key = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(key[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or any(m in text for m in fm.SENTINELS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(docs):
    made = fm.transform(docs)
    want = sorted((x.doc_id is None, x.doc_id or 0, *plain_version(x.doc_id, x.text), sha(x.text or "")) for x in docs.select("doc_id", "text").collect())
    rows = made.collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.n, x.form, x.prefix_chars, x.middle_chars, x.output, x.restored_sha256) for x in rows) == want
    assert all(sha(x.output) == x.output_sha256 for x in rows)
    back = sorted(((x.doc_id or 0), x.text) for x in fm.restore(made).collect())
    assert back == sorted(((x.doc_id or 0), x.text or "") for x in docs.select("doc_id", "text").collect())
    digests = fm.transform(docs, outputs=False)
    assert "output" not in digests.columns and {tuple(x) for x in digests.collect()} == {tuple(x)[:-1] for x in rows}
    return rows


def test_against_slices(as_docs):
    r = random.Random(3)
    texts = ["".join(r.choice("ab<>PSM é😀\n") for _ in range(r.randrange(0, 40))) for _ in range(900)]
    forms = [x.form for x in check(as_docs(texts))]
    assert all(forms.count(f) > 90 for f in ("plain", "spm", "psm"))


def test_long_text_is_read_in_pieces(as_docs):
    check(as_docs({k: "é😀x" * 70_000 for k in range(4)}))


def test_awkward_texts(awkward, nothing):
    rows = check(awkward)
    assert len(rows) == awkward.count()
    assert [(x.n, x.form, x.prefix_chars) for x in rows if x.doc_id in (1, 2)] == [(0, "plain", None)] * 2
    assert fm.transform(nothing).count() == 0 and fm.restore(fm.transform(nothing)).count() == 0


def test_pieces():
    parts = [(fm.TEXT, 0, 5), (fm.PREFIX, 0, 3), (fm.TEXT, 7, 9)]
    for place in range(11):
        left, right = fm.cut(parts, place)
        buffers = ("abcdefghi", *fm.SENTINELS)
        assert "".join(fm.spelled(left, buffers)) + "".join(fm.spelled(right, buffers)) == "abcde<P>hi"
        assert len("".join(fm.spelled(left, buffers))) == min(place, 10)
    # parts that end in the start of a sentinel, or are empty
    for form in fm.FORMS:
        for prefix, middle, suffix in (("a<", "<P", "<S"), ("", "", ""), ("<", "", "<M"), ("", "x", "")):
            buffers = (prefix + middle + suffix, *fm.SENTINELS)
            head, tail = fm.cut([(fm.TEXT, 0, len(buffers[0]))], len(prefix + middle))
            output = "".join(fm.spelled(fm.arrange([*fm.cut(head, len(prefix)), tail], form), buffers))
            assert "".join(fm.spelled(fm.take_apart(output, form), (output,))) == buffers[0]


def test_other_sentinels_and_shares(as_docs):
    marks = ("[pre]", "[suf]", "[mid]")
    docs = as_docs([f"text {k} with words" for k in range(300)] + ["holds [mid] itself"])
    made = fm.transform(docs, seed=9, plain=0, spm=100, sentinels=marks)
    forms = made.groupBy("form").agg(F.count("*").alias("n")).collect()
    assert {x.form: x.n for x in forms} == {"spm": 300, "plain": 1}
    assert sorted(x.text for x in fm.restore(made, marks).collect()) == sorted(x.text for x in docs.collect())
