"""SentencePiece encoding and decoding through tables of distinct chunks.

Where no piece of the model crosses from a character to the white-space marker
after it, a text's pieces are those of its marked words, one after another. Each
task segments every distinct marked word of its batches once, keeps its ids in a
table and joins them back by position. A table of the whole corpus isn't built:
the (document, position, word) rows would be shuffled, at several times the size
of the input, to spare a segmentation that costs less than the shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Distinct chunks that a worker's table holds. A full one is set aside, and what is met again moves to the next.
TABLE_ROWS = 200_000
#: Chunks that are segmented in one call.
JOINED = 5_000
#: A longer chunk is segmented where it stands and not kept in the table.
KEPT_CHARS = 64
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_model() -> str:
    """Path of the public tokenizer file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def crosses_words(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether chunks can't be segmented apart.

    True where some piece has a marker after another character, or where the
    model rewrites text (normalises, drops or trims white space) before it splits.
    """
    if any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size())):
        return True
    probe = "  a\t ﬁ ① é "
    return model.decode(model.encode(probe)) != probe or model.normalize(probe) != MARK + probe.replace(" ", MARK)


class ChunkTable:
    """Distinct chunks with the ids of each, as decimal text; one in each worker.

    A chunk is a run of markers with the characters after it, up to the next
    marker. Where no piece holds a line feed, a chunk ends before one, too.
    """

    def __init__(self, model_path: str | None):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path or default_model())
        self.whole = crosses_words(self.model)
        lines = not any("\n" in self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.chunk = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*" if lines else f"{MARK}+[^{MARK}]*")
        self.starts = np.array([self.model.id_to_piece(i).startswith(MARK) for i in range(self.model.get_piece_size())])
        self.rows: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def segment(self, chunks: list[str]) -> list[str]:
        """The ids of each chunk as decimal text.

        Chunks of one marker and more are joined, segmented in one call, and cut
        apart at the pieces that begin with the marker: each has exactly one.
        """
        found: dict[str, str] = {}
        plain = [c for c in chunks if len(c) > 1 and c[0] == MARK and c[1] != MARK]
        for i in range(0, len(plain), JOINED):
            part = plain[i : i + JOINED]
            ids = np.array(self.model.encode("".join(part)[1:].replace(MARK, " ")), dtype=np.int64)
            cuts = np.flatnonzero(self.starts[ids]).tolist() + [len(ids)]
            texts = list(map(str, ids.tolist()))
            found.update((c, ",".join(texts[x:y])) for c, x, y in zip(part, cuts[:-1], cuts[1:], strict=True))
        return [found[c] if c in found else self.segment_one(c) for c in chunks]

    def segment_one(self, chunk: str) -> str:
        """The model adds a first marker itself: the id of that one is dropped before a line feed."""
        if chunk == MARK:
            return str(self.model.piece_to_id(MARK))
        own = chunk[0] == "\n"
        return ",".join(map(str, self.model.encode((chunk if own else chunk[1:]).replace(MARK, " "))[own:]))

    def encode(self, texts: list[str]) -> Iterator[str]:
        """For each text its ids as decimal text joined by commas."""
        if self.whole:
            for ids in self.model.encode(texts, num_threads=1):
                yield ",".join(map(str, ids))
            return
        for text in texts:
            chunks = self.chunk.findall(MARK + text.replace(" ", MARK)) if text else []
            try:
                yield ",".join([self.rows[c] for c in chunks])
            except KeyError:
                yield self.encode_new(chunks)

    def encode_new(self, chunks: list[str]) -> str:
        """As encode, where some chunk isn't in the table: it comes from the older table or is segmented."""
        new = set(chunks).difference(self.rows)
        found = {c: self.older[c] for c in new if c in self.older}
        unseen = list(new.difference(found))
        found.update(zip(unseen, self.segment(unseen), strict=True))
        text = ",".join([self.rows[c] if c in self.rows else found[c] for c in chunks])
        if len(self.rows) + len(found) > TABLE_ROWS:
            self.older, self.rows = self.rows, {}
        self.rows.update((c, x) for c, x in found.items() if len(c) <= KEPT_CHARS)
        return text


@lru_cache(1)
def chunk_table(model_path: str | None) -> ChunkTable:
    return ChunkTable(model_path)


def as_ids(text: str) -> list[int]:
    return list(map(int, text.split(","))) if text else []


def sentencepiece_digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Encode and decode every whole text.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the decoded text), a row for each row of ``docs``. A null
    text counts as empty: no ids, digests of the empty string. Nothing else is
    read, so other columns can't clash; repeated rows are repeated; texts of any
    length are encoded whole; an empty table gives an empty result. ``model_path``
    must be readable on every machine; by default each takes its installed file.
    """
    small_batches(docs.sparkSession)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_table(model_path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for text in chunks.encode([t or "" for t in batch.column("text").to_pylist()]):
                ids = as_ids(text)
                n.append(len(ids))
                ids_sha.append(sha(text))
                decoded_sha.append(sha(chunks.model.decode(ids) if ids else ""))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(digests, SCHEMA)


def sentencepiece_encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id and the ids of every whole text; a null text has an empty list."""
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_table(model_path)
        for batch in batches:
            ids = [as_ids(x) for x in chunks.encode([t or "" for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, ids array<int>")


def sentencepiece_decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id and the text of its ids; null ids give an empty text."""
    small_batches(encoded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_file=model_path or default_model())
        for batch in batches:
            texts = [model.decode(ids) if ids else "" for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(decode, "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_digests(table(spark, sf_dir, "documents"))
