"""Language identification by unigram pieces, all segmentations summed.

The pieces are those of a fixed public vocabulary. Each language has a probability for each piece;
a word's probability is the sum over all ways to cut it into pieces, by the forward algorithm. The
piece probabilities are learnt by expectation maximisation on words of labelled texts. Runs of letters
longer than ``LONGEST`` are summed one at a time, in logarithms and with room that does not grow
with them; the shorter ones many at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from ..session import spread, stage
from .common import mixed

#: Labelled rows to learn from, in all, about, the same number for each language; where a language has more, a share by a hash of the id.
MOST_ROWS = 8_000
ROUNDS = 2
#: Runs of letters are words; longer runs are summed one at a time. No piece is longer.
LONGEST = 32
#: Letters of a long run that are worked on at a time, and after which its sums are scaled anew.
STRETCH, RESCALED = 4_096, 8
WORD = re.compile(r"[^\W\d_]+")
MARK = "▁"
#: Probability of one letter outside the vocabulary, and counts added to each piece.
ALIEN, ADDED = 1e-7, 0.01
#: Keeps products of many small numbers in range: each letter counts so many times its probability.
SCALE = 8.0
#: Words whose scores a worker remembers, and scores in all, one for each word and language; beyond it the memory starts anew.
REMEMBERED, SCORES = 300_000, 3_000_000
#: Sums that are worked on at a time, one for each letter and language.
TOGETHER = 600_000


class Pieces:
    """The vocabulary as sorted hashes, by piece length."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [
            model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self.pieces = sorted({p for p in plain if all(c == MARK or c.isalpha() for c in p) and len(p) <= LONGEST})
        sizes = np.array([len(p) for p in self.pieces])
        self.longest = int(sizes.max())
        self.by_size = {}
        for n in range(1, self.longest + 1):
            ids = np.flatnonzero(sizes == n)
            if len(ids):
                codes = np.array([[*map(ord, self.pieces[i])] for i in ids], dtype=np.uint64)
                keys = self.hashed(codes)
                order = np.argsort(keys)
                self.by_size[n] = (keys[order], ids[order])

    @staticmethod
    def hashed(codes: np.ndarray) -> np.ndarray:
        key = np.zeros(len(codes), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(codes.shape[1]):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + codes[:, k] + np.uint64(1))
        return key

    def found(self, codes: np.ndarray) -> np.ndarray:
        """For words of one length: the piece from ``end - n`` to ``end``, as ``[word, end, n]``, or -1."""
        words, size = codes.shape
        out = np.full((words, size + 1, min(self.longest, size) + 1), -1, dtype=np.int32)
        with np.errstate(over="ignore"):
            for start in range(size):
                key = np.zeros(words, dtype=np.uint64)
                for n in range(1, min(self.longest, size - start) + 1):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + codes[:, start + n - 1] + np.uint64(1))
                    if n in self.by_size:
                        keys, ids = self.by_size[n]
                        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                        out[:, start + n, n] = np.where(keys[at] == key, ids[at], -1)
        return out

    def found_in_run(self, codes: np.ndarray, first: int, last: int) -> np.ndarray:
        """For one run: the piece from ``end - n`` to ``end`` for the ends from ``first`` to ``last``, as ``[end - first, n]``, or -1."""
        out = np.full((last - first, self.longest + 1), -1, dtype=np.int32)
        ends = np.arange(first, last)
        for n, (keys, ids) in self.by_size.items():
            some = ends[ends >= n]
            if len(some):
                key = self.hashed(codes[some[:, None] + np.arange(-n, 0)])
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                out[some - first, n] = np.where(keys[at] == key, ids[at], -1)
        return out


def _sums(stretches: Iterator[np.ndarray], chance: np.ndarray) -> Iterator[np.ndarray]:
    """Logarithms of the forward sums of one run, ``[end, language]``, stretch by stretch; ``[end, n]`` pieces come in.

    A letter outside the vocabulary is a step of one letter besides the pieces. The last sums are kept
    in a ring, nearest first, and brought back to a size of one every few letters.
    """
    ring, log = None, np.zeros(chance.shape[1])
    for found in stretches:
        if ring is None:
            ring = np.zeros((found.shape[1] - 1, chance.shape[1]))
            ring[0] = 1.0
        step = np.where(found[:, 1:, None] >= 0, chance[found[:, 1:]], 0.0) * SCALE ** np.arange(1, found.shape[1])[:, None]
        step[:, 0] += chance[-1] * SCALE
        out = np.empty((len(found), chance.shape[1]))
        for k in range(len(found)):
            new = (ring * step[k]).sum(axis=0)
            ring[1:] = ring[:-1]
            ring[0] = new
            out[k] = np.log(new) + log
            if k % RESCALED == 0:
                ring /= new
                log = log + np.log(new)
        yield out


def _stretches(known: Pieces, codes: np.ndarray, langs: int) -> Iterator[np.ndarray]:
    size = max(1, STRETCH // langs)
    for first in range(1, len(codes) + 1, size):
        yield known.found_in_run(codes, first, min(first + size, len(codes) + 1))


def run_total(known: Pieces, chance: np.ndarray, word: str) -> np.ndarray:
    """The logarithm of a long run's probability, all segmentations summed, by language."""
    codes = _codes(word)
    for logs in _sums(_stretches(known, codes, chance.shape[1]), chance):
        last = logs[-1]
    return last - len(codes) * np.log(SCALE)


def run_expected(known: Pieces, chance: np.ndarray, word: str) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of a long run and their expected uses; ``chance`` is that of one language, ``[piece + 1]``."""
    codes, chance = _codes(word), chance[:, None]
    found = np.concatenate([np.full((1, known.longest + 1), -1, dtype=np.int32), *_stretches(known, codes, 1)])
    # from the other end: the piece from an end's mirror image forward
    back = np.full_like(found, -1)
    for n in known.by_size:
        back[n:, n] = found[n:, n][::-1]
    alpha, beta = (np.concatenate([[0.0], *(x[:, 0] for x in _sums((f[k : k + STRETCH] for k in range(1, len(f), STRETCH)), chance))]) for f in (found, back))
    ends, sizes = np.nonzero(found >= 0)
    ids = found[ends, sizes]
    use = alpha[ends - sizes] + np.log(chance[ids, 0]) + sizes * np.log(SCALE) + beta[len(codes) - ends]
    return ids, np.exp(use - alpha[-1])


def _forward(found: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Scaled forward sums ``[word, end, language]``; ``chance`` is ``[piece, language]``, its last row for aliens."""
    words, ends, most = found.shape
    alpha = np.zeros((words, ends, chance.shape[1]))
    alpha[:, 0] = 1.0
    for end in range(1, ends):
        alpha[:, end] = alpha[:, end - 1] * chance[-1] * SCALE
        for n in range(1, min(most - 1, end) + 1):
            some = np.flatnonzero(found[:, end, n] >= 0)
            if len(some):
                alpha[some, end] += alpha[some, end - n] * chance[found[some, end, n]] * SCALE**n
    return alpha


def _expected(found: np.ndarray, chance: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, by language; ``weight`` is ``[word, language]``."""
    words, ends, most = found.shape
    alpha = _forward(found, chance)
    beta = np.zeros_like(alpha)
    beta[:, ends - 1] = 1.0
    counts = np.zeros_like(chance)
    share = weight / np.maximum(alpha[:, ends - 1], 1e-300)
    for end in range(ends - 1, 0, -1):
        beta[:, end - 1] += beta[:, end] * chance[-1] * SCALE
        for n in range(1, min(most - 1, end) + 1):
            some = np.flatnonzero(found[:, end, n] >= 0)
            if len(some):
                ids = found[some, end, n]
                use = chance[ids] * SCALE**n * beta[some, end]
                np.add.at(counts, ids, alpha[some, end - n] * use * share[some])
                beta[some, end - n] += use
    return counts


def words_of(text: str) -> list[str]:
    words = WORD.findall(text.lower())
    if not all(map(str.isalpha, words)):  # number signs such as a square or a fraction are no letters
        words = [w for run in words for w in "".join(c if c.isalpha() else " " for c in run).split()]
    return words


def _codes(text: str) -> np.ndarray:
    """Code points of a word with a mark before it."""
    return np.frombuffer((MARK + text).encode("utf-32-le"), dtype="<u4").astype(np.uint64)


def _by_length(words: list[str], langs: int = 10):
    """Words of equal length as code points, with a mark before each: ``places, codes``."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    for n in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == n)
        for part in np.array_split(places, max(1, len(places) * (n + 1) * langs // TOGETHER)):
            text = "".join(MARK + words[i] for i in part.tolist())
            yield part, np.frombuffer(text.encode("utf-32-le"), dtype="<u4").reshape(len(part), n + 1).astype(np.uint64)


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def labelled(docs: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``lang, text`` of the rows to learn from: a language is named, and crc32 of the id as text is not 0 modulo 5.

    About ``most`` in all: each language may give the same number, by a hash of the id, or gives all that it has.
    """
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sizes = stage(rows.groupBy("lang").agg(F.count("*").alias("_rows")), "languages")
    each = 1_000_000 * most / max(1, sizes.count())
    rows = rows.join(broadcast_if_small(sizes), "lang")  # a row for each language
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_000)) * F.col("_rows") < each).select("lang", "text")


def learn(docs: DataFrame, vocabulary: str, most: int = MOST_ROWS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities ``[piece + 1, language]``; the last row is for letters outside the vocabulary.

    The counts of each round are summed by tasks over the words of the sample, a row for each
    language and piece in use. All that the driver sees is bounded by the sample: at most as many
    languages as sampled rows, and as many counts as the sample has pieces.
    """
    sample = labelled(docs, most)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = pd.DataFrame({"lang": frame["lang"], "word": [words_of(t) for t in frame["text"]]}).explode("word").dropna()
            yield rows.groupby(["lang", "word"], sort=False).size().rename("n").reset_index()

    words = spread(sample).mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stage(words, "words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    size = len(pieces(vocabulary).pieces)
    chance = np.full((size + 1, len(langs)), 1.0 / size)
    chance[-1] = ALIEN
    for _ in range(rounds if langs else 0):

        def expect(frames: Iterator[pd.DataFrame], chance=chance) -> Iterator[pd.DataFrame]:
            known, counts = pieces(vocabulary), np.zeros_like(chance)
            for frame in frames:
                lang = frame["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
                n, words = frame["n"].to_numpy(), frame["word"].tolist()
                short = np.array([i for i, w in enumerate(words) if len(w) <= LONGEST], dtype=np.int64)
                for i in set(range(len(words))).difference(short.tolist()):
                    ids, uses = run_expected(known, chance[:, lang[i]], words[i])
                    np.add.at(counts, (ids, lang[i]), uses * n[i])
                for places, codes in _by_length([words[i] for i in short.tolist()], len(langs)):
                    at = short[places]
                    weight = np.zeros((len(at), len(langs)))
                    weight[np.arange(len(at)), lang[at]] = n[at]
                    counts += _expected(known.found(codes), chance, weight)
            piece, lang = np.nonzero(counts)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": counts[piece, lang]})

        made = words.mapInPandas(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((size, len(langs)), ADDED)
        counts[made["piece"], made["lang"]] += made["n"]
        chance = np.vstack([counts / counts.sum(axis=0), np.full((1, len(langs)), ALIEN)])
    return langs, chance


class Scorer:
    def __init__(self, vocabulary: str, chance: np.ndarray):
        self.pieces, self.chance = pieces(vocabulary), chance
        self.number: dict[str, int] = {}
        self.scores = np.zeros((max(1, min(REMEMBERED, SCORES // max(1, chance.shape[1]))), chance.shape[1]))

    def totals(self, texts: list[list[str]]) -> np.ndarray:
        """Summed log probabilities ``[text, language]``."""
        number, scores = self.number, self.scores
        new = {w for words in texts for w in words}.difference(number)
        long = {w: run_total(self.pieces, self.chance, w) for w in new if len(w) > LONGEST}
        new = list(new.difference(long))
        if len(number) + len(new) > len(scores):
            number.clear()
            new = list({w for words in texts for w in words}.difference(long))
            if len(new) > len(scores):
                self.scores = scores = np.zeros((len(new), scores.shape[1]))
        first = len(number)
        number.update(zip(new, range(first, first + len(new)), strict=True))
        for at, codes in _by_length(new, scores.shape[1]):
            last = _forward(self.pieces.found(codes), self.chance)[:, -1]
            scores[first + at] = np.log(np.maximum(last, 1e-300)) - codes.shape[1] * np.log(SCALE)
        out = np.zeros((len(texts), scores.shape[1]))
        for i, words in enumerate(texts):
            if long:
                out[i] = sum(long[w] for w in words if w in long)
                words = [w for w in words if w not in long]
            if words:
                out[i] += scores[np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
        return out


def identify(docs: DataFrame, vocabulary: str, most: int = MOST_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, held_out, lang_pred, score``.

    Learns from ``doc_id, text, lang`` of the rows that `labelled` takes, and predicts from the text
    alone. ``score`` is the share of the predicted language in the mean probability of a word, from
    0 to 1. A null text, one without letters, and every text if nothing was learnt are ``und`` with
    score 0. Ties go to the language that sorts first. Repeated rows give a row each; a null id is not held out.
    """
    langs, chance = learn(docs, vocabulary, most, rounds)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(vocabulary, chance)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 64):
                words = [words_of(t or "") for t in texts[a : a + 64]]
                own = np.array([len(w) for w in words], dtype=np.int64)
                name, score = ["und"] * len(words), np.zeros(len(words))
                if langs:
                    mean = scorer.totals(words) / np.maximum(own, 1)[:, None]
                    best = mean.argmax(axis=1)
                    score = np.where(own > 0, 1 / np.exp(mean - mean.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
                    name = [langs[b] if n else "und" for b, n in zip(best.tolist(), own.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, 64), pa.array(name, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"]
                )

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = given.mapInArrow(predict, "doc_id long, lang_pred string, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return made.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
