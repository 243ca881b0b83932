"""The Kneser-Ney model and the quality rules against plain versions; language identification on held-out text."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folioscope.llm import language_id, language_model, quality_classifier, quality_rules


def plain_model(texts):
    """Interpolated modified Kneser-Ney over 4-grams of UTF-16 units, by dictionaries; a function from text to surprise."""

    def grams(text):
        raw = " ".join(text.lower().split()).encode("utf-16-le")
        seq = [2, 2, 2, *(raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)), 3]
        return [tuple(seq[i : i + 4]) for i in range(len(seq) - 3)]

    counts = {4: Counter(g for t in texts for g in grams(t))}
    for order in (3, 2, 1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    cuts, contexts = {}, {}
    for order, own in counts.items():
        n = Counter(own.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else None
        cuts[order] = {}
        for k in (1, 2, 3):
            d = k / 2 if y is None or not n[k] else k - (k + 1) * y * n[k + 1] / n[k]
            cuts[order][k] = max(0.05, min(k - 0.05, d))
        contexts[order] = defaultdict(Counter)
        for g, c in own.items():
            contexts[order][g[:-1]][g[-1]] = c
    types = len(counts[1])

    def chance(gram):
        order = len(gram)
        less = chance(gram[1:]) if order > 1 else 1 / (types + 1)
        seen = contexts[order].get(gram[:-1])
        if not seen:
            return less
        total, d = sum(seen.values()), cuts[order]
        rest = sum(d[min(c, 3)] for c in seen.values()) / total
        c = seen[gram[-1]]
        return (c - d[min(c, 3)] if c else 0) / total + rest * less

    return lambda text: (len(grams(text)), -sum(math.log(chance(g)) for g in grams(text)))


@pytest.fixture(scope="module")
def corpus(make_prose):
    texts = {k: " ".join(make_prose(k, 40 + k)) for k in range(30)}
    texts |= {30: "", 31: "Aa  aA\naa", 32: "\U0001f600 é ÀÉ", 33: texts[3], 34: "zzzz qqqq"}
    return texts


def close(rows, plain, texts):
    for x in rows:
        n, total = plain(texts[x.doc_id] or "")
        assert x.n_units == n and abs(x.surprise - total) < 1e-4 * max(1, total), (x, total)


def test_surprise_by_brute_force(as_docs, corpus):
    rows = language_model.surprise(as_docs(corpus).repartitionByRange(3, "doc_id")).collect()
    assert len(rows) == len(corpus)
    close(rows, plain_model(corpus.values()), corpus)


def test_taught_by_some_and_two_languages(spark, as_docs, corpus):
    docs = as_docs(corpus).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").when(F.col("doc_id") % 3 == 0, "de"))
    taught = spark.createDataFrame([(k,) for k in range(0, 30) if k % 4 != 1 and k % 6 != 3], "id long")
    rows = language_model.surprise(docs, taught=taught).collect()
    ids = {r.id for r in taught.collect()}
    lang = {k: "en" if k % 2 == 0 else "de" if k % 3 == 0 else "" for k in corpus}
    for name in ("en", ""):
        plain = plain_model([t for k, t in corpus.items() if k in ids and lang[k] == name])
        close([x for x in rows if x.lang == name], plain, corpus)
    assert not [k for k in ids if lang[k] == "de"] and {x.surprise for x in rows if x.lang == "de"} == {None}


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), symbols, dup, len(covered), failed)


def test_base_rules_by_brute_force(as_docs, make_prose):
    r = random.Random(8)
    texts = [None, "", "one\n\n one\none\n \x0b\n", "a b c d e a b c d e", "x " * 40, "#*$%&|<>" * 3, "\x1c\x85 \xa0a", "a\x0bb\x0cc"]
    for k in range(40):
        words = make_prose(k, r.choice([4, 9, 10, 60]))
        for _ in range(r.randrange(4)):
            a, n = r.randrange(len(words)), r.randrange(1, 12)
            words += words[a : a + n]
        texts.append(r.choice([" ", "\n", " | "]).join(words))
    rows = quality_rules.quality(as_docs(texts)).collect()
    got = {x.doc_id: (*(x[c] for c in quality_rules.FEATURES), x.base_failed) for x in rows}
    assert got == {k: plain_base(t) for k, t in enumerate(texts)}
    assert not any(x.kept and x.base_failed for x in rows)


def test_bands_reject_what_stands_out(spark, as_docs, make_prose):
    texts = {k: " ".join(make_prose(k, 80)) for k in range(120)}
    r = random.Random(1)
    texts[200] = " ".join("".join(chr(r.randrange(33, 0x2FF)) for _ in range(7)) for _ in range(80))
    texts |= {k: texts[7] for k in range(300, 420)}  # copies don't draw the band together
    rows = {x.doc_id: x for x in quality_rules.quality(as_docs(texts)).collect()}
    assert not rows[200].kept and not rows[200].low <= rows[200].perplexity <= rows[200].high
    assert all(x.kept for k, x in rows.items() if k != 200)
    docs = as_docs(texts).withColumn("low", F.lit(1)).withColumn("_doc", F.lit(2))
    good = quality_rules.good_documents(docs)
    assert good.columns == docs.columns and {x.doc_id for x in good.collect()} == set(texts) - {200}


def plain_crossed(texts, half):
    """Each text's surprise under the model taught by the other half of the texts."""
    models = [plain_model([t for k, t in texts.items() if half[k] == h]) for h in (0, 1)]
    return {k: models[1 - half[k]](t) for k, t in texts.items()}


def test_no_text_teaches_its_own_model(as_docs, corpus):
    docs = as_docs(corpus)
    half = {x.doc_id: x.h for x in docs.select("doc_id", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(2)).alias("h")).collect()}
    assert half[3] == half[33] and set(half.values()) == {0, 1}
    wanted = plain_crossed(corpus, half)
    rows = language_model.surprise(docs.repartitionByRange(3, "doc_id"), teaches=lambda texts: np.ones(len(texts), dtype=bool)).collect()
    assert {x.doc_id for x in rows} == set(corpus)
    for x in rows:
        n, total = wanted[x.doc_id]
        assert x.n_units == n and abs(x.surprise - total) < 1e-4 * max(1, total)


def test_bands_reject_symbols_tables_and_the_too_predictable(as_docs, make_prose):
    """Junk is a third of the rows, so neither the model nor the band may learn from it."""
    r = random.Random(6)
    drone = lambda n: ["an" * r.randrange(1, 10) for _ in range(n)]
    texts = {k: " ".join(r.sample(words := make_prose(k, 70) + drone(20), len(words))) for k in range(150)}
    junk = {1000 + k: " ".join(w + r.choice("%$&*#") * 3 for w in make_prose(500 + k, 80)) for k in range(40)}
    junk |= {2000 + k: " | ".join(make_prose(600 + k, 80)) for k in range(40)}
    junk |= {3000 + k: " ".join(drone(120)) for k in range(3)}
    rows = {x.doc_id: x for x in quality_rules.quality(as_docs(texts | junk)).collect()}
    assert not any(x.base_failed for x in rows.values())
    assert not [k for k in junk if rows[k].kept]
    assert all(rows[k].perplexity < rows[k].low for k in junk if k >= 3000)
    assert sum(not rows[k].kept for k in texts) <= 3


def test_classifier_keeps_what_trusted_text_predicts(spark, as_docs, make_prose):
    texts = {k: " ".join(make_prose(k, 80)) for k in range(100)}
    r = random.Random(1)
    texts |= {200 + k: " ".join("".join(r.choice("xqzjkw") for _ in range(9)) for _ in range(80)) for k in range(5)}
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 60)] + [(200, 0, 0), (201, 1, 1), (None, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    rows = {x.doc_id: x for x in quality_classifier.classify(as_docs(texts), labels).collect()}
    assert {k for k, x in rows.items() if not x.kept} == {200 + k for k in range(5)}
    assert quality_classifier.trusted_ids(labels).count() == 60
    assert quality_classifier.trusted_ids(labels, most=10).count() < 40
    none = quality_classifier.classify(as_docs(texts), labels.limit(0)).collect()
    assert all(x.kept and x.perplexity is None for x in none)


def test_limit_bears_bad_text_at_two_fifths(spark, as_docs, make_prose):
    r = random.Random(2)
    texts = {k: " ".join(make_prose(k, 80)) for k in range(120)}
    bad = {1000 + k: " ".join(w + r.choice("%$&*#") * 3 for w in make_prose(500 + k, 80)) for k in range(80)}
    labels = spark.createDataFrame([(k, 1, 0) for k in range(80)], "doc_id long, quality int, toxic int")
    rows = {x.doc_id: x for x in quality_classifier.classify(as_docs(texts | bad), labels).collect()}
    assert not [k for k in bad if rows[k].kept] and all(rows[k].kept for k in texts)
    alone = quality_classifier.classify(as_docs(texts), labels).first()
    assert abs(math.log(alone.high / rows[0].high)) < 0.1


def plain_quantile(values, share, step=0.002):
    bins = sorted(math.floor(v / step) for v in values)
    return bins[max(0, math.ceil(share * len(bins) - 1e-9) - 1)] * step


def plain_band(rows, band, room, reach=6.0, short=50, step=0.002):
    """``low, high, drawn`` of one language from ``(n_units, level)`` of the rows that count; a pair counts once."""
    rows = set(rows)
    q1, middle, q3 = (plain_quantile([level for _, level in rows], q) for q in (0.25, 0.5, 0.75))
    wide, drawn = max(q3 - q1, 0.05), lambda n, level: middle + (level - middle) * n / (n + short)
    first, last = (plain_quantile([drawn(*x) for x in rows], q) for q in band)
    further = room * wide / math.sqrt(len(rows))
    return max(q1 - reach * wide, first - further), min(q3 + step + reach * wide, last + step + further), drawn


def unit_count(text):
    return len(" ".join(text.lower().split()).encode("utf-16-le")) // 2 + 1


def two_tongues(make_prose, many):
    r = random.Random(12)
    texts = {k: ("en" if k < many else "de", " ".join(make_prose(k, r.randrange(12, 40)))) for k in range(many + 150)}
    for k in range(10_000, 10_060):
        texts[k] = (r.choice(["en", "de"]), " ".join(w + r.choice("%$&*#") * r.randrange(4) for w in make_prose(k, 30)))
    return texts


def level_of(x):
    return math.log(x.perplexity)


def holds(rows, texts, counted, band, room, upper_only):
    for lang in ("en", "de"):
        own = [x for x in rows if x.lang == lang]
        place = {x.doc_id: (unit_count(texts[x.doc_id][1]), level_of(x)) for x in own}
        low, high, drawn = plain_band([place[x.doc_id] for x in own if counted(x)], band, room)
        edge = 0.005  # a step to either side, where rounded levels may fall apart
        for x in own:
            at = drawn(*place[x.doc_id])
            assert abs(math.log(x.high) - high) < edge
            if not upper_only:
                assert abs(math.log(x.low) - low) < edge
            if abs(at - high) > edge and abs(at - low) > edge and not getattr(x, "base_failed", False):
                assert x.kept == (at <= high and (upper_only or at >= low)), (x, at, low, high)


def test_verdicts_of_the_rules_by_brute_force(spark, make_prose):
    texts = two_tongues(make_prose, 700)
    docs = spark.createDataFrame([(k, t, g) for k, (g, t) in texts.items()], "doc_id long, text string, lang string")
    rows = quality_rules.quality(docs).collect()
    assert len(rows) == len(texts) and {x.kept for x in rows} == {True, False}
    clean = lambda x: not x.base_failed and x.n_symbols <= 0.1 * x.n_words
    holds(rows, texts, clean, quality_rules.BAND, 0.0, False)


def test_verdicts_of_the_classifier_by_brute_force(spark, make_prose):
    """One language with more than 500 spared texts, one with about 30: the same rule for both."""
    texts = two_tongues(make_prose, 3000)
    docs = spark.createDataFrame([(k, t, g) for k, (g, t) in texts.items()], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in texts if k < 10_000], "doc_id long, quality int, toxic int")
    spared = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(quality_classifier.SPARED)) == 0)
    spared = {x.doc_id for x in spared.collect()}
    assert sum(texts[k][0] == "en" for k in spared) > 500 and 10 < sum(texts[k][0] == "de" for k in spared) < 60
    rows = quality_classifier.classify(docs, labels).collect()
    assert sum(not x.kept for x in rows if x.doc_id >= 10_000) > 20 and sum(not x.kept for x in rows if x.doc_id < 10_000) < 0.03 * len(texts)
    holds(rows, texts, lambda x: x.doc_id in spared, (0.0, quality_classifier.LIMIT), quality_classifier.ROOM, True)


def test_awkward_models(spark, awkward, nothing):
    rows = quality_rules.quality(awkward).collect()
    assert len(rows) == awkward.count() and sum(x.doc_id == 5 for x in rows) == 2
    assert all(x.base_failed for x in rows if x.doc_id in (1, 2, 6, 7, 8, 9))
    assert quality_rules.good_documents(awkward).columns == awkward.columns
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(awkward, labels).count() == awkward.count()
    assert quality_rules.quality(nothing).count() == 0 and quality_classifier.classify(nothing, labels).count() == 0


# --- language identification ---

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    known = language_id.Pieces(VOCABULARY)
    r = np.random.default_rng(4)
    chance = np.vstack([r.random((len(known.pieces), 2)), [[1e-7, 1e-7]]])
    number = {p: i for i, p in enumerate(known.pieces)}

    def plain(word, lang):
        total = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            total[end] = total[end - 1] * chance[-1, lang]
            for start in range(end):
                if (i := number.get(word[start:end])) is not None:
                    total[end] += total[start] * chance[i, lang]
        return total[-1]

    words = ["the", "und", "zzzq", "éa", "straße", "日本", "a"]
    for at, codes in language_id._by_length(words):
        last = language_id._forward(known.found(codes), chance)[:, -1] / language_id.SCALE ** codes.shape[1]
        for i, w in zip(at.tolist(), last, strict=True):
            assert np.allclose(w, [plain(language_id.MARK + words[i], g) for g in (0, 1)], rtol=1e-9)


@pytest.fixture(scope="module")
def tongues(spark):
    r = random.Random(5)
    syllables = {"xa": "the th ing er ou st and ly".split(), "xb": "eau que ment oi tre elle ç".split(), "xc": "sch ung keit ver ich ß".split()}
    rows = []
    for i in range(240):
        lang = r.choice(sorted(syllables))
        words = ["".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 4))) for _ in range(30)]
        rows.append((i, " ".join(words).capitalize(), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark, tongues):
    rows = language_id.identify(tongues, VOCABULARY).collect()
    truth = {x.doc_id: x.lang for x in tongues.collect()}
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in rows)
    held = [x for x in rows if x.held_out]
    assert len(held) > 20 and sum(x.lang_pred == truth[x.doc_id] for x in held) >= 0.95 * len(held)
    assert all(0 <= x.score <= 1 for x in rows)


def test_learns_from_training_rows_alone(tongues):
    other = tongues.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "zz").otherwise(F.col("lang")))
    langs, chance = language_id.learn(other, VOCABULARY)
    assert langs == ["xa", "xb", "xc"] and np.allclose(chance[:-1].sum(axis=0), 1)
    assert language_id.labelled(tongues, most=20).count() < 60


def test_awkward_languages(awkward, nothing, tongues):
    rows = language_id.identify(awkward, VOCABULARY).collect()
    assert len(rows) == awkward.count()
    assert {x.lang_pred for x in rows if x.doc_id in (1, 2, 6)} == {"und"} and {x.score for x in rows if x.doc_id == 1} == {0.0}
    assert language_id.identify(nothing, VOCABULARY).count() == 0
    unlabelled = language_id.identify(tongues.withColumn("lang", F.lit(None).cast("string")), VOCABULARY).collect()
    assert {x.lang_pred for x in unlabelled} == {"und"}


def test_every_trusted_document_counts(spark):
    labels = spark.range(1_100_000).selectExpr("id as doc_id", "1L as quality", "0L as toxic")
    assert quality_classifier.trusted_ids(labels).count() == 1_100_000
