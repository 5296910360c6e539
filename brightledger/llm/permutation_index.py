"""Nearest neighbours by a permutation index over pivot inverted files.

Each vector is represented by its nearest pivots in order. The index is a table,
built once, of segments of at most SEGMENT vectors: a segment holds its vectors and
posts them in inverted files, a list of (vector, place) for each pivot. A query reads
the lists of its own pivots and adds up footrule distances: for each of them, by how
far the places differ, or the length of the order where the vector isn't in the list.
The share of a segment with the smallest footrule is ranked again by distance on the
original vectors. Queries are a table of blocks; blocks meet segments by broadcast
while they are few, else in a grid of groups (see ``met``). Neither vectors nor
queries pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, small_batches, table

#: Pivots, the vectors with the smallest hashes of the id, and those in an order.
PIVOTS, ORDER = 256, 128
#: Part of a segment that is ranked again by distance, and the vectors that are at least.
#: Vectors without any cluster structure, where orders say least, need about 0.045 for a recall of 0.9.
RERANKED, LEAST = 0.06, 100
#: Vectors in one segment, queries in one block.
SEGMENT, QUERY_BLOCK = 4096, 1024
#: Query blocks are broadcast up to so many bytes.
BROADCAST_BYTES = 32 << 20
#: Queries whose best are held in one task at a time.
HELD = 50_000
#: Lengths of vectors that are searched together; others follow, as their pivots are held by the driver.
LENGTHS = 16
SEGMENT_SCHEMA = "dim int, ids array<bigint>, flat array<double>, vector array<smallint>, place array<smallint>, ends array<int>"
BLOCK_SCHEMA = "dim int, block bigint, qids array<bigint>, qflat array<double>, qorder array<smallint>"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding as doubles, of rows with an id and a finite, non-zero vector; the smallest one of a repeated id."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)) & F.exists("embedding", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)


def orders(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each vector its nearest pivots, the nearest first."""
    near = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.argsort(near, axis=1, kind="stable")[:, : min(ORDER, len(pivots))].astype(np.int16)


class InvertedFiles:
    """The postings of one segment of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, length: int, vector: np.ndarray, place: np.ndarray, ends: np.ndarray):
        self.ids, self.x, self.length, self.vector, self.place, self.ends = ids, x, length, vector, place, ends

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray) -> InvertedFiles:
        order = orders(x, pivots)
        post = np.argsort(order.ravel(), kind="stable")
        ends = np.searchsorted(order.ravel()[post], np.arange(len(pivots) + 1))
        return cls(ids, x, order.shape[1], (post // order.shape[1]).astype(np.int16), (post % order.shape[1]).astype(np.int16), ends.astype(np.int32))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of every vector to a query's order: a vector is in a list once at most."""
        common = np.zeros(len(self.ids), np.int32)
        for i, p in enumerate(order):
            s = slice(self.ends[p], self.ends[p + 1])
            common[self.vector[s]] += self.length - np.abs(self.place[s] - i)
        return self.length * self.length - common

    def nearest(self, own: int, query: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest of the vectors with the smallest footrule."""
        few = reranked(len(self.ids), k)
        away = self.footrule(order)
        at = np.arange(len(away)) if few >= len(away) else np.flatnonzero(away <= np.partition(away, few - 1)[few - 1])
        at = at[self.ids[at] != own]
        score = np.sqrt(((self.x[at] - query) ** 2).sum(1))
        best = np.lexsort((self.ids[at], score))[:k]
        return self.ids[at][best], score[best]


def reranked(vectors: int, k: int) -> int:
    """Distances on original vectors that a query costs in a segment (more where footrules tie)."""
    return max(math.ceil(RERANKED * vectors), LEAST, k + 1)


def pivots_of(vectors: DataFrame, lengths: list[int]) -> dict[int, np.ndarray]:
    """A bounded sample: for each of the lengths of vectors, those with the PIVOTS smallest hashes of the id."""
    sized = vectors.withColumn("dim", F.size("embedding")).where(F.col("dim").isin(lengths))
    first = F.row_number().over(W.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id", "embedding"))
    rows = sized.withColumn("n", first).where(F.col("n") <= PIVOTS).orderBy("dim", "n").collect()  # at most LENGTHS * PIVOTS
    return {d: np.array([r["embedding"] for r in rows if r["dim"] == d]) for d in lengths}


def in_blocks(vectors: DataFrame, size: int, schema: str, made: Callable[[int, np.ndarray, np.ndarray], list]) -> DataFrame:
    """One row, made of (length, ids, vectors), for at most ``size`` vectors of one length of a partition."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def row(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            values = made(dim, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            ids, flat = batch.column("vec_id").to_numpy(), batch.column("embedding")
            dims, values, cuts = np.diff(flat.offsets.to_numpy()), flat.values.to_numpy(), flat.offsets.to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = np.stack([values[cuts[i] : cuts[i] + dim] for i in at])
                for i in range(0, len(at), size):
                    part = held.setdefault(dim, [])
                    part.append((ids[at[i : i + size]], x[i : i + size]))
                    if sum(len(p[0]) for p in part) + len(batch) > size:
                        yield row(dim)
        for dim in list(held):
            yield row(dim)

    return vectors.mapInArrow(each, schema)


def index_of(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """The segments of all vectors, saved."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def made(dim: int, ids: np.ndarray, x: np.ndarray) -> list:
        files = InvertedFiles.of(ids, x, sent.value[dim])
        return [np.int32(dim), ids, x.ravel(), files.vector, files.place, files.ends]

    return saved(in_blocks(vectors, SEGMENT, SEGMENT_SCHEMA, made))


def blocks_of(queries: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """The blocks of all queries with their orders, saved; queries of a length that no vector has find nothing."""
    sent = queries.sparkSession.sparkContext.broadcast(pivots)

    def made(dim: int, ids: np.ndarray, x: np.ndarray) -> list:
        return [np.int32(dim), np.int64(ids.min()), ids, x.ravel(), orders(x, sent.value[dim]).ravel()]

    asked = queries.where(F.size("embedding").isin(list(pivots)))
    return saved(in_blocks(asked, QUERY_BLOCK, BLOCK_SCHEMA, made))


def met(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every query block with every segment of its length.

    While the blocks are small enough, they are broadcast and segments stay where
    they lie. Beyond that, segments are dealt into rows and blocks into columns of a
    grid whose cells are joined: a segment is sent to every column and a block to
    every row, so that a cell holds few of either, and no task all of one.
    """
    bytes_ = blocks.agg(F.sum(F.size("qflat") * 8 + F.size("qorder") * 2)).first()[0] or 0
    if bytes_ <= BROADCAST_BYTES:
        return segments.join(F.broadcast(blocks), "dim")
    columns = math.ceil(bytes_ / BROADCAST_BYTES)
    rows = max(1, math.ceil(segments.count() / 16))
    left = segments.withColumn("i", F.pmod(F.xxhash64("ids"), F.lit(rows))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    right = blocks.withColumn("j", F.pmod(F.xxhash64("qids"), F.lit(columns)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))))
    return left.join(right, ["dim", "i", "j"]).drop("i", "j")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k vectors found nearest to each query by Euclidean distance.

    Both tables have vec_id and embedding. Returns query_id, rank (from 1), vec_id
    and score (the distance, in double precision, on the original vectors), nearest
    first and ties to the smaller vec_id. Rows with a null id, or a vector that is
    null, empty, zero or holds a null or non-finite component, take no part. Vectors
    are searched among those of their own length, LENGTHS lengths at a time.
    A query is no candidate of its own: rows with its id are left out. Of several
    different queries with one id the smallest vector (compared component by
    component) asks; a vector id that is repeated with equal vectors counts once, and
    with different ones by its nearest. Every row is indexed; recall comes from the
    part of each segment that is ranked again. Other columns are ignored; empty tables
    give no rows.
    """
    small_batches(vectors.sparkSession)
    whole = usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    lengths = sorted(r["dim"] for r in whole.select(F.size("embedding").alias("dim")).distinct().collect())
    pairs = None
    for i in range(0, max(len(lengths), 1), LENGTHS):
        pivots = pivots_of(whole, lengths[i : i + LENGTHS])
        own = whole.where(F.size("embedding").isin(list(pivots)))
        part = met(index_of(own, pivots), blocks_of(asked, pivots))
        pairs = part if pairs is None else pairs.unionByName(part)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for q, (near, score) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), q)), pa.array(near), pa.array(score)], names=["query_id", "vec_id", "score"])
            best.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                own = {c: batch.column(c).slice(i, 1).flatten().to_numpy() for c in batch.schema.names if c not in ("dim", "block")}
                dim = batch.column("dim")[i].as_py()
                length = len(own["qorder"]) // len(own["qids"])
                files = InvertedFiles(own["ids"], own["flat"].reshape(-1, dim), length, own["vector"], own["place"], own["ends"])
                x, order = own["qflat"].reshape(-1, dim), own["qorder"].reshape(-1, length)
                for n, q in enumerate(own["qids"].tolist()):
                    near, score = files.nearest(q, x[n], order[n], k)
                    if q in best:
                        near, score = np.concatenate([best[q][0], near]), np.concatenate([best[q][1], score])
                        top = np.lexsort((near, score))[:k]
                        near, score = near[top], score[top]
                    best[q] = near, score
                if len(best) > HELD:
                    yield from told()
        yield from told()

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.select("query_id", place.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"), 10)
