"""Line windows, benchmark spans, repeated byte strings and similar sets against brute force."""

import hashlib
import random
import re
import tracemalloc

import pytest
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, line_dedup, near_join, suffix_dedup
from folioscope.llm.components import components


def sharing(make_prose, seed, n=40):
    """Texts with copies, near copies, shared passages and runs of equal lines."""
    r = random.Random(seed)
    passage = " ".join(make_prose(seed + 1000, 60))
    texts = []
    for k in range(n):
        words = make_prose(seed * 100 + k, r.choice([3, 30, 120, 400]))
        kind = r.randrange(6)
        if kind == 0 and texts:
            words = r.choice(texts).split(" ")
        if kind == 1 and texts:
            words = r.choice(texts).split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[r.randrange(len(words))] = "changed"
        if kind == 2:
            at = r.randrange(len(words))
            words = words[:at] + passage.split(" ") + words[at:]
        if kind == 3:
            words = (["same"] * 8 + ["\n"]) * r.randrange(1, 9) + words
        text = " ".join(words)
        texts.append("\n".join(text[i : i + 70] for i in range(0, len(text), 70)) if kind == 4 else text)
    return texts


# --- three-line windows ---


def plain_line_dedup(docs):
    seen, out = set(), {}
    for doc, text in sorted(docs.items()):
        lines = (text or "").split("\n")
        solid = [i for i, x in enumerate(lines) if re.search(r"[^ \t\r\f\v]", x)]
        gone = set()
        for k in range(len(solid) - 2):
            window = tuple(lines[i] for i in solid[k : k + 3])
            if window in seen:
                gone.update(solid[k : k + 3])
            seen.add(window)
        out[doc] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(solid), len(gone))
    return out


def test_line_windows_by_brute_force(as_docs, make_prose):
    r = random.Random(5)
    lines = [" ".join(make_prose(k, 4)) for k in range(9)] + ["", "  "]
    docs = {k: "\n".join(r.choice(lines) for _ in range(r.randrange(0, 14))) for k in range(60)}
    rows = line_dedup.drop_repeated_lines(as_docs(docs)).collect()
    assert {x.doc_id: (x.text, x.n_lines, x.n_removed) for x in rows} == plain_line_dedup(docs)


def test_awkward_lines(awkward, nothing):
    rows = line_dedup.drop_repeated_lines(awkward).collect()
    assert len(rows) == awkward.count() and rows[0].words == "w"
    by = {}
    for x in rows:
        by.setdefault(x.doc_id, []).append(x)
    assert by[1][0].text is None
    assert {x.n_removed for x in by[5] + by[4]} == {6} and sorted(x.n_removed for x in by[None]) == [0, 0]
    kept = line_dedup.documents_left(awkward)
    assert kept.columns == awkward.columns
    left = {x.doc_id: x for x in kept.collect()}
    assert set(left) == {1, 2, 3, 6, 7, 8, None, 9, 10} and left[10].n_chars == len(left[10].text)
    assert line_dedup.documents_left(nothing).count() == 0


# --- benchmark spans ---


def plain_spans(docs, items, span):
    def words(text):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = {}
    for item, text in items.items():
        w = words(text)
        size = min(span, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = {}
    for doc, text in docs.items():
        w, hit, named = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    named |= found
        out[doc] = (len(w), len(hit), sorted(named), bool(hit))
    return out


@pytest.mark.parametrize("span", [10, 7])
def test_spans_by_brute_force(spark, as_docs, make_prose, span):
    r = random.Random(9)
    items = {k: " ".join(make_prose(k, r.choice([1, 2, 5, 9, 10, 11, 30]), 60)) for k in range(30)} | {90: "a " * 25, 91: None, 92: " .. "}
    docs = {}
    for k in range(80):
        words = make_prose(500 + k, r.choice([0, 2, 8, 50]), 60)
        for _ in range(r.randrange(3)):
            part = (items[r.randrange(30)]).split(" ")
            a, n = r.randrange(len(part)), r.randrange(1, 14)
            at = r.randrange(len(words) + 1)
            words[at:at] = part[a : a + n]
        docs[k] = r.choice([" ", ", ", "\n"]).join(w.upper() if r.random() < 0.1 else w for w in words)
    docs[100], docs[101] = "A a-" * 20, None
    bench = spark.createDataFrame([(k, t, "w") for k, t in items.items()], "item_id long, text string, words string")
    rows = decontaminate.contamination(as_docs(docs), bench, span).collect()
    assert {x.doc_id: (x.n_words, x.n_hit, x["items"], x.contaminated) for x in rows} == plain_spans(docs, items, span)


def test_awkward_spans(spark, awkward, nothing, make_prose):
    bench = spark.createDataFrame([(None, " ".join(make_prose(3, 12))), (1, None), (2, "one two")], "item_id long, text string")
    rows = decontaminate.contamination(awkward, bench).collect()
    assert len(rows) == awkward.count()
    assert {x.doc_id for x in rows if x.contaminated} == {4, 5, 7, 10, None}
    clean = decontaminate.clean_documents(awkward, bench)
    left = clean.collect()
    assert clean.columns == awkward.columns and {x.doc_id for x in left} == {1, 2, 3, 6, 8, 9, None}
    assert [x.text[:3] for x in left if x.doc_id is None] == ["odd"]
    empty = bench.limit(0)
    assert decontaminate.clean_documents(awkward, empty).count() == awkward.count()
    assert decontaminate.contamination(nothing, bench).count() == 0


# --- repeated byte strings ---


def plain_repeats(docs, length):
    seen, out = set(), {}
    for doc, text in sorted(docs.items()):
        data, gone = (text or "").encode(), set()
        for i in range(len(data) - length + 1):
            part = data[i : i + length]
            if part in seen:
                gone.update(range(i, i + length))
            seen.add(part)
        spans = sum(1 for i in gone if i - 1 not in gone)
        kept = bytes(b for i, b in enumerate(data) if i not in gone)
        out[doc] = (len(data), len(gone), spans, kept)
    return out


@pytest.mark.parametrize("together", [1_000, 2])
@pytest.mark.parametrize("length", [100, 20])
def test_repeats_by_brute_force(as_docs, make_prose, monkeypatch, together, length):
    monkeypatch.setattr(suffix_dedup, "MOST_TOGETHER", together)
    texts = [*sharing(make_prose, 4), "aaaa" * 90, "ab" * 150, "é" * 120, "", None, "x" * 99, "x" * 101, "ab" * 49 + "c"]
    docs = {2 * k: t for k, t in enumerate(texts)}
    rows = suffix_dedup.drop_repeated(as_docs(docs).repartition(3).sortWithinPartitions(F.desc("doc_id")), length).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, len(x.spans), bytes(x.kept)) for x in rows} == plain_repeats(docs, length)
    assert all(x.kept_sha256 == hashlib.sha256(x.kept).hexdigest() for x in rows)


def test_awkward_repeats(awkward, nothing):
    rows = suffix_dedup.drop_repeated(awkward).collect()
    assert len(rows) == awkward.count()
    removed = {}
    for x in rows:
        removed.setdefault(x.doc_id, []).append(x.n_removed)
    copy = next(x.n_bytes for x in rows if x.doc_id == 4)
    assert removed[1] == removed[2] == [0] and removed[4] == [copy] and removed[5] == [copy, copy]
    assert removed[8] == [59_999] and sorted(removed[None]) == [0, 0]
    assert suffix_dedup.drop_repeated(nothing).count() == 0


# --- similar sets ---


def plain_links(docs):
    sets = {}
    for doc, text in docs.items():
        words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        sets[doc] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    root, links = {d: d for d in docs}, dict.fromkeys(docs, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(docs)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in docs}


@pytest.mark.parametrize("chunk", [None, 5])
def test_links_by_brute_force(as_docs, make_prose, monkeypatch, chunk):
    if chunk:
        monkeypatch.setattr(near_join, "CHUNK_CLASSES", chunk)
    base = make_prose(77, 150)
    hot = []
    for k in range(40):  # near copies of one text, all different
        words = list(base)
        for j in range(k % 4):
            words[(k * 13 + j * 31) % 150] = f"other{k}"
        hot.append(" ".join(words))
    docs = dict(enumerate([*sharing(make_prose, 6, 60), *hot, "one two", "One, two!", "", None, "...", "a b c d e", "a b c d"]))
    rows = near_join.near_join(as_docs(docs), recall=0.999999).collect()
    assert {x.doc_id: (x.class_id, x.n_links) for x in rows} == plain_links(docs)


def test_awkward_links(awkward, nothing):
    rows = near_join.near_join(awkward).collect()
    assert len(rows) == awkward.count()
    assert {(x.doc_id, x.class_id) for x in rows if x.doc_id in (1, 2, 6, 7)} == {(k, k) for k in (1, 2, 6, 7)}
    copies = [x for x in rows if x.doc_id in (4, 5)]
    assert len({x.copy_of for x in copies}) == 1 and all(x.n_links == 3 for x in copies)
    kept = near_join.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = [x.doc_id for x in kept.collect()]
    assert {1, 2, 3, 6, 7, 8, 9}.issubset(ids) and 4 not in ids and 5 not in ids
    assert near_join.near_join(nothing).count() == 0 and near_join.one_of_each(nothing).count() == 0


def test_bands_reach_the_recall():
    for s in (0.5, 0.8, 0.9):
        bands, rows = near_join.band_counts(s, 0.999)
        assert 1 - (1 - s**rows) ** bands >= 0.999


def test_components_by_brute_force(spark):
    r = random.Random(2)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(110)] + [(k, k + 1) for k in range(300, 360)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    root = {n: n for pair in links for n in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert sorted((x.node, x.component) for x in rows) == sorted((n, find(n)) for n in linked)


# --- rows that share an id, or have none ---


def lines_of(make_prose, seed, n=6):
    return [" ".join(make_prose(seed * 50 + k, 9)) for k in range(n)]


@pytest.mark.parametrize("doc_id", [None, 7])
def test_a_passage_at_different_places_of_rows_with_one_id(spark, make_prose, doc_id):
    passage = lines_of(make_prose, 1, 4)
    texts = ["\n".join(lines_of(make_prose, 2, 3) + passage + lines_of(make_prose, 3)), "\n".join(lines_of(make_prose, 4, 5) + passage + lines_of(make_prose, 5))]
    docs = spark.createDataFrame([(doc_id, t) for t in [*texts, texts[0]]], "doc_id long, text string")
    rows = line_dedup.drop_repeated_lines(docs).collect()
    lost = {x.n_removed: x.text for x in rows}
    assert sorted(x.n_removed for x in rows) in ([0, 0, 4], [0, 4, 4])
    whole = next(t for t in texts if "\n".join(passage) not in lost[4] and t.replace("\n".join(passage) + "\n", "") == lost[4])
    assert {x.text for x in rows if not x.n_removed} == set(texts) - {whole}
    cut = suffix_dedup.drop_repeated(docs).collect()
    spoken = "\n".join(passage).encode()
    kept = {bytes(x.kept) for x in cut}
    assert len(cut) == 3 and {x.doc_id for x in cut} == {doc_id} and len(kept) == 2 and sum(spoken in k for k in kept) == 1
    first = next(k for k in kept if spoken in k).decode()
    assert first in texts
    other = next(t for t in texts if t != first).encode()
    at = other.index(spoken)
    assert next(bytes(x.kept) for x in cut if x.n_removed) in [other[:a] + other[b:] for a in (at - 1, at) for b in range(at + len(spoken), at + len(spoken) + 2)]


def test_clean_rows_without_id_stay(spark, make_prose):
    item = " ".join(make_prose(1, 12))
    rows = [(None, " ".join(make_prose(2, 40))), (None, item + " tail"), (3, "x " + item), (3, " ".join(make_prose(4, 40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = decontaminate.clean_documents(docs, items).collect()
    assert {x.text for x in clean} == {rows[0][1], rows[3][1]}
    hot = spark.createDataFrame([(None, " ".join(make_prose(k, 60)), None) for k in range(40)] + [(None, "too short", None), (None, "a b " * 90, "en")], "doc_id long, text string, lang string")
    from folioscope.llm import quality_rules

    good = {x.text for x in quality_rules.good_documents(hot).collect()}
    assert "too short" not in good and "a b " * 90 not in good and len(good) > 30


def test_parser_memory_follows_its_runs(monkeypatch):
    random_words = random.Random(3)
    texts = ["".join(random_words.choices("abcdefgh \né", k=2_000)) for _ in range(200)] + ["", "short"]
    monkeypatch.setattr(suffix_dedup, "RUN", 10**9, raising=False)
    whole = suffix_dedup.Parser(100).parse(texts)
    monkeypatch.setattr(suffix_dedup, "RUN", 20_000)
    tracemalloc.start()
    try:
        in_runs = suffix_dedup.Parser(100).parse(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(in_runs, whole, strict=True))
    assert peak < 16 * len(whole[0])  # in one run: about 100 bytes for each byte of text
