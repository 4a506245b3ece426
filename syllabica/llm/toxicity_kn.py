"""Toxicity by two Kneser-Ney bigram models that share what they back off to.

Counts of each class come from a bounded sample of labelled documents: all its
pairs of words with an absolute discount, below them the number of words that
each word follows. What both classes back off to is one table of the words of
all documents, which grows with the input, and the pairs of both classes
together. A word that the sample doesn't hold has the same probability in both
models, so only the sample's words are read from that table. Words are told
apart by 64-bit hashes.

The length-normalised log-likelihoods of a whole text under both models are
compared. Languages differ in their share of toxic documents; so a word's counts
are held against the share that the words before it have in both classes
together. A logistic curve fitted on labelled documents that gave no counts makes
a score of the difference.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import documents, give_back, slices, staged, tidy
from .quality_knn import labelled_sample
from .words import word_hashes

#: Pairs that the model's own arithmetic holds at a time.
BLOCK = 1 << 18
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of text that a task scores at a time, and rows that Spark gives it at a time: executors keep the Python
#: processes of earlier stages, each of which holds a model and what a batch takes.
PIECE, ROWS = 500_000, 2_000
#: Deviation of counts beyond chance, as a share of the expected count: words come in clusters.
SPREAD = 0.15


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    hashes, at = word_hashes(texts)
    return hashes.view(np.int64), at


def pairs(vocabulary: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each word with the word before it, the word's place in the vocabulary, and where texts begin.

    Unknown words have the place after the last, and what is before a text the one after that.
    """
    found, at = words_of(texts)
    word = places(vocabulary, found)
    before = np.roll(word, 1)
    before[at[:-1][at[:-1] < len(word)]] = len(vocabulary) + 1
    return before * (len(vocabulary) + 2) + word, word, at


def places(known: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Where values are in an ordered array; its length for those that aren't there."""
    place = np.searchsorted(known, sought)
    place[np.append(known, 0)[place] != sought] = len(known)
    return place


@dataclass
class Smoothing:
    """``pair``: discount of a pair; ``pairs`` and ``word``: strength of both classes together
    against the counts of one, for a pair and a word; ``local``: strength of the share of all
    toxic words against that of a word's neighbours; ``chance``: discount of what a class has
    over or under the count that both together let expect, in usual deviations."""

    pair: float = 0.75
    pairs: float = 5000.0
    word: float = 5.0
    local: float = 50.0
    chance: float = 3.0


def _held_back(found: np.ndarray, expected: np.ndarray, strength: float, discount: float) -> np.ndarray:
    """How many times its expected count something has in a class; 1 without counts.

    What is over or under the expected count is discounted by its usual deviation.
    """
    out = np.empty(len(found), np.result_type(expected, np.float32))
    for i in range(0, len(found), 1 << 18):
        usual = expected[i: i + (1 << 18)]
        over = found[i: i + (1 << 18)] - usual
        over = np.sign(over) * np.maximum(np.abs(over) - discount * np.sqrt(usual + 0.5 + (SPREAD * usual) ** 2), 0)
        out[i: i + (1 << 18)] = (usual + over + strength) / np.maximum(usual + strength, 1e-30)
    return out


class Comparison:
    """Both models. ``keys`` are the pairs of the sample in order, ``counts`` how often it holds
    each, ``pair`` how many documents of each class do; ``words`` are the hashes of the
    sample, in order, and ``shared`` their probabilities in all documents."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, pair: list[np.ndarray], words: np.ndarray, shared: np.ndarray,
                 smoothing: Smoothing) -> None:
        self.keys, self.words, self.shared, self.curve, self.sent = keys, words, shared, np.zeros(3), None
        size = len(words) + 2
        part = [slice(i, i + BLOCK) for i in range(0, len(keys), BLOCK)]
        before, word = (lambda i: keys[i] // size), (lambda i: keys[i] % size)

        def tally(place, weight) -> np.ndarray:
            """Sums by place, block by block: no array of all pairs is made for them."""
            total = np.zeros(size)
            for i in part:
                total += np.bincount(place(i), weight(i), minlength=size)
            return total

        own = [tally(before, lambda i, n=n: n[i]) for n in pair]
        share = own[1].sum() / max(own[0].sum() + own[1].sum(), 1)
        near = ((own[1] + smoothing.local * share) / (own[0] + own[1] + smoothing.local)).astype(np.float32)
        begun = tally(before, lambda i: counts[i]).astype(np.float32)
        seen = np.empty(len(keys), np.float32)
        for i in part:
            seen[i] = np.maximum(counts[i] - np.float32(smoothing.pair), 0) / begun[before(i)]
        known = tally(before, lambda i: seen[i])
        back = (1 - known).astype(np.float32)
        likely, of_words = [], []
        for c, of_class in ((0, 1 - share), (1, share)):
            usual = lambda i, c=c: near[before(i)] if c else 1 - near[before(i)]
            found = lambda i: pair[0][i] + pair[1][i]
            mine = np.empty(len(keys), np.float32)
            for i in part:
                mine[i] = seen[i] * _held_back(pair[c][i], found(i) * usual(i), np.float32(smoothing.pairs * of_class), np.float32(smoothing.chance))
            whole = (known / np.maximum(tally(before, lambda i: mine[i]), 1e-30)).astype(np.float32)
            # leaders of a word: those of the class, and those to expect when both classes are alike
            leaders = tally(word, lambda i: pair[c][i] > 0)[:-2]
            expected = tally(word, lambda i: 1 - (1 - usual(i)) ** found(i))[:-2]
            mine_word = shared * _held_back(leaders, expected, smoothing.word * of_class, smoothing.chance)
            mine_word *= shared.sum() / max(mine_word.sum(), 1e-30)
            lower = mine_word.astype(np.float32)
            for i in part:
                mine[i] = mine[i] * whole[before(i)] + back[before(i)] * lower[word(i)]
            likely.append(mine)
            of_words.append(mine_word)
        # what a comparison needs: of a pair that isn't kept, the share of the backoff is the same in both models
        np.divide(likely[1], likely[0], out=likely[1])
        self.pair = np.append(np.log(likely[1], out=likely[1]), np.float32(0))
        self.word = np.append(np.log(of_words[1] / of_words[0]), 0).astype(np.float32)

    def __getstate__(self) -> dict:
        """What scoring needs: in place of the keys, where the pairs of each first word begin, and their second words, half as large."""
        if not hasattr(self, "keys"):
            return self.__dict__
        size = len(self.words) + 2
        return {"words": self.words, "pair": self.pair, "word": self.word, "second": (self.keys % size).astype(np.int32),
                "begins": np.searchsorted(self.keys, np.arange(size + 1) * size)}

    def _places(self, key: np.ndarray) -> np.ndarray:
        """Where pairs are among those of the sample; the number of these for others."""
        if hasattr(self, "keys"):
            return places(self.keys, key)
        before, word = np.divmod(key, len(self.words) + 2)
        low, high = self.begins[before], self.begins[before + 1]
        end, left = high.copy(), np.flatnonzero(low < high)
        while len(left):
            middle = (low[left] + high[left]) >> 1
            less = self.second[middle] < word[left]
            low[left[less]] = middle[less] + 1
            high[left[~less]] = middle[~less]
            left = left[low[left] < high[left]]
        known = low < end
        known[known] = self.second[low[known]] == word[known]
        return np.where(known, low, len(self.second))

    def ratios(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The log of toxic over ordinary of each word, and where the texts begin."""
        key, word, at = pairs(self.words, texts)
        place = self._places(key)
        return np.where(place < len(self.pair) - 1, self.pair[place], self.word[word]).astype(np.float64), at

    def figures(self, texts: list[str]) -> np.ndarray:
        """The difference of the log-likelihoods of each text by its words, and by their root, and 1."""
        ratio, at = self.ratios(texts)
        total = np.diff(np.concatenate([[0], np.cumsum(ratio)])[at])
        n = np.maximum(np.diff(at), 1)
        bent = lambda x: np.sign(x) * np.log1p(10 * np.abs(x))
        return np.stack([bent(total / n), bent(total / np.sqrt(n)), np.ones(len(texts))], axis=1)

    def fit(self, figures: np.ndarray, labels: np.ndarray, rounds: int = 60) -> None:
        """Logistic regression by Newton steps, slightly held back."""
        for _ in range(rounds if len(labels) else 0):
            p = 1 / (1 + np.exp(-np.clip(figures @ self.curve, -30, 30)))
            slope = figures.T @ (labels - p) - 1e-3 * self.curve
            bend = (figures * (p * (1 - p))[:, None]).T @ figures + 1e-3 * np.eye(3)
            self.curve = self.curve + np.clip(np.linalg.solve(bend, slope), -5, 5)

    def score(self, texts: list[str], curve: np.ndarray | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.figures(texts) @ (self.curve if curve is None else curve), -30, 30)))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            word, n = np.unique(words_of(part.column("text").to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], names=["word", "n"])


def _pair_counts(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            key, _, at = pairs(vocabulary, part.column("text").to_pylist())
            of = np.repeat(np.arange(len(at) - 1), np.diff(at))
            order = np.lexsort((key, of))
            of, key = of[order], key[order]
            # once a text for the documents, each time for the count
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
            first = np.flatnonzero(new)
            toxic = part.column("label").to_numpy().astype(np.int64)[of[first]]
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(np.diff(np.append(first, len(of)))), pa.array(1 - toxic),
                                              pa.array(toxic)], names=["pair", "n", "n0", "n1"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", sample: int = 20_000,
                 smoothing: Smoothing | None = None, id_col: str = "doc_id", text_col: str = "text") -> Comparison | None:
    """The two models and the curve that ``add_score`` uses; None without labels of both classes.

    ``learn`` is a condition on ``doc_id`` that says whose labels may be learnt
    from; at most ``sample`` of them are, a quarter of these only for the curve.
    The models keep all words and word pairs of the sample. Word counts shared by
    both classes come from all documents. Texts are read whole, empty and null ones
    hold no words. An id labelled twice counts once.

    From here on the session gives Python at most ``ROWS`` rows at a time.
    """
    spark = docs.sparkSession
    if not 0 < int(spark.conf.get(BATCH)) <= ROWS:
        spark.conf.set(BATCH, ROWS)
    texts = documents(docs, id_col, text_col)
    chosen = labelled_sample(labels, label, learn, sample)
    # at most ``sample`` rows
    known = staged(texts.join(F.broadcast(chosen), "doc_id").withColumn("curve", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0),
                   "toxicity-sample")
    counts_type = "word long, n long"
    everywhere = staged(texts.mapInArrow(tidy(_word_counts), counts_type).groupBy("word").agg(F.sum("n").alias("n")), "toxicity-words")
    n_words, n_different = everywhere.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # as many words and pairs as at most ``sample`` rows hold
    learnt = known.where(~F.col("curve")).select("text", "label")
    found = learnt.select("text").mapInArrow(tidy(_word_counts), counts_type).select("word").distinct().join(everywhere, "word").toArrow()
    order = np.argsort(found.column("word").to_numpy())
    words, n = (found.column(c).to_numpy()[order] for c in ("word", "n"))
    vocabulary = spark.sparkContext.broadcast(words)
    few = "smallint" if sample < 1 << 15 else "int"
    # in order from Spark, and column by column, so that the driver holds each once
    counted = (learnt.mapInArrow(tidy(lambda batches: _pair_counts(batches, vocabulary.value)), "pair long, n long, n0 long, n1 long")
               .groupBy("pair").agg(F.sum("n").cast("int").alias("n"), *(F.sum(c).cast(few).alias(c) for c in ("n0", "n1"))).orderBy("pair").toArrow())
    taken = []
    for name in ("pair", "n", "n0", "n1"):
        column = counted.column(name).to_numpy()
        counted = counted.drop_columns([name])
        taken.append(column if name == "pair" else column.astype(np.float32))
        del column
    keys, counts, *pair = taken
    del counted, taken
    give_back()
    if not all(n_c.any() for n_c in pair):
        return None
    model = Comparison(keys, counts, pair, words, (n + 1) / (n_words + n_different + 1), smoothing or Smoothing())
    del counts, pair
    # a copy: what is broadcast must not hold its own broadcast
    first = model.sent = spark.sparkContext.broadcast(copy.copy(model))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, PIECE):
                figures = first.value.figures(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(figures[:, 0]), pa.array(figures[:, 1]), part.column("label").cast("double")],
                                                 names=["mean", "root", "label"])

    seen = known.where("curve").select("text", "label").mapInArrow(tidy(measure), "mean double, root double, label double").toArrow()
    columns = [seen.column(name).to_numpy() for name in ("mean", "root", "label")]
    order = np.lexsort(columns)
    mean, root, marks = (c[order] for c in columns)
    model.fit(np.stack([mean, root, np.ones(len(mean))], axis=1), marks)
    # the driver has its later stages to run
    give_back()
    return model


def add_score(docs: DataFrame, model: Comparison | None, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``name``: 0 to 1, higher for likelier toxic.

    Rows and other columns stay as they are; repeated rows are scored alike.
    Empty and null texts score as a text does that both models find as likely; without a model
    every score is 0.
    """
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    fitted, curve = model.sent, model.curve
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, PIECE, text_col):
                score = fitted.value.score([text or "" for text in part.column(at).to_pylist()], curve)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, name])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
