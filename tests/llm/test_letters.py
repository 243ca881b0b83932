"""What counts as a letter when languages are told apart; runs of letters of any length; rare languages."""

import random

import numpy as np
import public_tokenizers
import pytest

from folioscope.llm import language_id
from folioscope.llm.language_id import words_of

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def test_number_signs_are_no_letters():
    assert words_of("\u00b2 \u00bd \u2460 \u2167 12 _ ,") == []
    assert words_of("a\u00b2b X\u00bd \u00e9t\u00e9 \u65e5\u672c") == ["a", "b", "x", "\u00e9t\u00e9", "\u65e5\u672c"]


@pytest.fixture(scope="module")
def known():
    return language_id.Pieces(VOCABULARY)


def plain_sums(known, chance, word):
    """Forward sums of one language over all cuts of a marked word, scaled as the library scales them."""
    number = {p: i for i, p in enumerate(known.pieces)}
    word, total = language_id.MARK + word, [1.0]
    for end in range(1, len(word) + 1):
        one = total[end - 1] * chance[-1] * language_id.SCALE
        for start in range(max(0, end - known.longest), end):
            if (i := number.get(word[start:end])) is not None:
                one += total[start] * chance[i] * language_id.SCALE ** (end - start)
        total.append(one)
    return total


def some_word(seed, letters):
    r = random.Random(seed)
    return "".join(r.choice(["the", "ung", "ation", "q", "é", "日", "straße"]) for _ in range(letters))[:letters]


def chances(known, langs, seed=3):
    r = np.random.default_rng(seed)
    shares = r.random((len(known.pieces), langs)) ** 4 + 1e-6
    return np.vstack([shares / shares.sum(axis=0), np.full((1, langs), language_id.ALIEN)])


@pytest.mark.parametrize("letters", [1, 33, 200, 300])
def test_long_runs_equal_the_plain_sum(known, letters, monkeypatch):
    monkeypatch.setattr(language_id, "STRETCH", 100)
    chance, word = chances(known, 3), some_word(letters, letters)
    wanted = [np.log(plain_sums(known, chance[:, k], word)[-1]) - (letters + 1) * np.log(language_id.SCALE) for k in range(3)]
    assert np.allclose(language_id.run_total(known, chance, word), wanted, rtol=1e-9)


def test_long_and_short_runs_expect_the_same(known):
    chance = chances(known, 2)
    for word in ("the", "straßenbahn", some_word(1, 30)):
        [(_, codes)] = language_id._by_length([word])
        weight = np.array([[0.0, 1.0]])
        wanted = language_id._expected(known.found(codes), chance, weight)[:, 1]
        got = np.zeros(len(chance))
        np.add.at(got, *language_id.run_expected(known, chance[:, 1], word))
        assert np.allclose(got, wanted, rtol=1e-8, atol=1e-12)


def test_very_long_run_and_many_languages(known):
    chance = chances(known, 120)
    logs = language_id.run_total(known, chance, some_word(5, 20_000))
    assert logs.shape == (120,) and np.isfinite(logs).all()
    texts = [["the", some_word(6, 50)], [], ["the"], ["the", "the", some_word(6, 50)]]
    scorer = language_id.Scorer(VOCABULARY, chance)
    assert scorer.scores.size <= language_id.SCORES
    for _ in range(2):
        a, none, the, b = scorer.totals(texts)
        assert np.allclose(b - a, the) and not none.any() and np.isfinite(a).all()


def test_language_of_one_row_in_20000_is_learnt(spark):
    common = spark.range(1, 20_000).selectExpr("id as doc_id", "concat('the thing ', id % 7) as text", "'xa' as lang")
    rare = spark.createDataFrame([(20_001, "eaux quelle", "xb")], "doc_id long, text string, lang string")
    sample = language_id.labelled(common.unionByName(rare), most=400).collect()
    assert sum(x.lang == "xb" for x in sample) == 1 and 100 < sum(x.lang == "xa" for x in sample) < 300
