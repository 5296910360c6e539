"""Toxic documents by a linear model on character n-grams."""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, free_name, table
from .nbsvm import BITS, Featuriser, Model, classified, fit_labelled, scored

SIZES = (3, 4, 5)
FOLDS, HELD_OUT = 3, 1
TOXIC_FROM = 0.7
KNOWN_WORDS, KNOWN_GRAMS = 100_000, 300_000


class Numbers(dict):
    """Feature number of an n-gram; None where it isn't wanted."""

    def __init__(self, wanted: set[int] | None):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, gram: str) -> int | None:
        if len(self) > KNOWN_GRAMS:
            self.clear()
        found = xxhash.xxh3_64_intdigest(gram) & ((1 << BITS) - 1)
        self[gram] = found = found if self.wanted is None or found in self.wanted else None
        return found


class WordGrams(dict):
    """Feature numbers of the character n-grams of a word with its ends marked."""

    def __init__(self, wanted: set[int] | None):
        super().__init__()
        self.numbers = Numbers(wanted)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > KNOWN_WORDS:
            self.clear()
        marked, number = f" {word} ", self.numbers.__getitem__
        found = {number(marked[i : i + n]) for n in SIZES for i in range(len(marked) - n + 1)}
        self[word] = found = tuple(found - {None})
        return found


def char_grams(wanted: set[int] | None = None) -> Featuriser:
    """Distinct n-grams of 3 to 5 characters in the words of a text, lower-cased."""
    known = WordGrams(wanted)
    return lambda text: set().union(*map(known.__getitem__, set(text.lower().split())))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> Model:
    return fit_labelled(docs, labels, "toxic", fold(F.col("doc_id"), FOLDS) == HELD_OUT, char_grams)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text for toxicity.

    Returns doc_id, held_out, score (0 to 1, higher: likelier toxic) and predicted
    (1 from 0.7 on), a row for each row of ``docs``. Learns from ``labels.toxic``
    of the rows that aren't held out, at most ``nbsvm.FIT_DOCS`` of each label; a
    null id is never held out and never learned from. Null and empty texts have no
    n-grams and get the score of the bias. Without labels every score is 0.5.
    Texts of any length are read whole; repeated rows get equal values; other columns
    are ignored, so their names can't clash; an empty table gives an empty result. A
    score on the threshold counts as toxic.
    """
    return classified(docs, toxicity_model(docs, labels), char_grams, FOLDS, HELD_OUT, TOXIC_FROM)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns, whatever their names.

    Null and empty texts get the score of the bias, like any other text without
    n-grams; repeated rows are judged alike, and an empty table gives an empty result.
    """
    model, score = toxicity_model(docs, labels), free_name(docs, "_toxicity_score")
    return scored(docs.withColumn("text", F.col("text").cast("string")), model, char_grams, score).where(F.col(score) < TOXIC_FROM).drop(score)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
