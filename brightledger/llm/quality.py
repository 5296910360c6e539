"""Document quality by naive Bayes support vectors on token n-grams."""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table
from .nbsvm import BITS, Featuriser, Model, classified, fit_labelled

FOLDS, HELD_OUT = 5, 0
GOOD_FROM = 0.3
KNOWN_TOKENS = 100_000
#: Characters of a shape that stands in one piece, and of a token kept in the table of shapes, at most.
LONG = 40
#: A piece of a longer shape: letters and digits with the marks behind them. The pieces of a shape make up the whole of it.
PIECE = re.compile(r"[Aa9]{1,8}[^Aa9]{0,8}|[^Aa9]{1,8}")
#: White space that isn't a space or a line end.
OTHER_SPACE = re.compile(r"[^\S\n ]")


class Shapes(dict):
    """Shape of a whole token: letters by case, digits, other characters as they are, runs shortened to one, two or more."""

    runs = re.compile(r"(.)\1*", re.DOTALL)

    def __missing__(self, token: str) -> str:
        if len(self) > KNOWN_TOKENS:
            self.clear()
        kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in token)
        found = self.runs.sub(lambda m: m[1] if m[1] in "Aa9" or len(m[0]) == 1 else m[1] * 2, kinds)
        if len(token) <= LONG:
            self[token] = found
        return found

    def pieces(self, token: str) -> list[str]:
        """The shape in pieces, so that tokens without an end (text without spaces, code, base64) have shapes in common."""
        whole = self[token]
        return [whole] if len(whole) <= LONG else PIECE.findall(whole)


class Grams(dict):
    """Feature number of an n-gram."""

    def __missing__(self, gram: tuple[str, ...]) -> int:
        if len(self) > KNOWN_TOKENS:
            self.clear()
        self[gram] = found = xxhash.xxh3_64_intdigest("\x00".join(gram)) & ((1 << BITS) - 1)
        return found


def token_grams(wanted: set[int] | None = None) -> Featuriser:
    """Distinct n-grams of one to three token shapes; a token equal to the one before counts as a shape of its own.

    Line ends are tokens, so that lines that are alike in shape are seen as well,
    and so is all white space but the plain space. Every character is read: a shape
    longer than ``LONG`` counts as several shapes in a row.
    """
    shapes, grams = Shapes(), Grams()

    def features(text: str) -> set[int]:
        tokens = OTHER_SPACE.sub(r" \g<0> ", text.replace("\n", " \n ")).split(" ")
        if max(map(len, tokens)) <= LONG:
            seen = [shapes[t] if t != before else "=" for t, before in zip(tokens, ["", *tokens], strict=False)]
        else:
            seen = [s for t, before in zip(tokens, ["", *tokens], strict=False) for s in (shapes.pieces(t) if t != before else ["="])]
        found = {(s,) for s in set(seen)} | set(zip(seen, seen[1:], strict=False)) | set(zip(seen, seen[1:], seen[2:], strict=False))
        numbers = set(map(grams.__getitem__, found))
        return numbers if wanted is None else numbers & wanted

    return features


def quality_model(docs: DataFrame, labels: DataFrame) -> Model:
    return fit_labelled(docs, labels, "quality", fold(F.col("doc_id"), FOLDS) == HELD_OUT, token_grams)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text for quality.

    Returns doc_id, held_out, score (0 to 1, higher: likelier of label 1) and
    predicted (1 from 0.3 on), a row for each row of ``docs``. Learns from
    ``labels.quality`` of the rows that aren't held out, at most
    ``nbsvm.FIT_DOCS`` of each label; a null id is never held out and never
    learned from. A null text counts as empty. Without labels every score is 0.5.
    Texts of any length are read whole; repeated rows get equal values; other columns
    are ignored, so their names can't clash; an empty table gives an empty result. A
    score on the threshold counts as good.
    """
    return classified(docs, quality_model(docs, labels), token_grams, FOLDS, HELD_OUT, GOOD_FROM)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
