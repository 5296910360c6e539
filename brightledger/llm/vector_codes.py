"""Vectors as short codes of codebook entries, assigned through memoised grid cells.

A vector is cut into parts; each part is coded as its nearest entry of the codebook of
its position. Components are integers, so that distances, sums and ties are exact.

A part lies in a coarse cell of a grid, a box. An entry whose least distance to the box
is above another one's greatest distance is nearest to no point of it. The entries left
are worked out once for a cell and kept by the cell's hash; only they are measured
exactly for the parts that fall into it.

The vectors are a saved table of integers; a round of fitting is one pass that sums the
parts of each entry in every task. Codebooks, PARTS * ENTRIES rows of a part's length, are
all that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hot_keys, saved, small_batches, spread_join, table

#: Steps of a component in 1; parts of a vector, entries of a codebook, rounds of fitting.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: A cell is 2^CELL steps wide; a task keeps so many cells of a part at most, then begins anew.
CELL, CELLS = 10, 1 << 15
#: Vectors that a task codes at a time.
BATCH = 4096
#: Components of the codebooks that are fitted together: lengths beyond are fitted after one another.
TOGETHER = 1 << 22

Books = dict[int, np.ndarray]


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v, of the rows whose vector has finite components only.

    A component is floor(SCALE * x). Beyond some 2^27 steps (of 64 components), where
    distances would exceed a long, it is the last number that doesn't.
    """
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    most = F.floor(F.sqrt(F.lit(2.0**60) / F.greatest(F.size("embedding"), F.lit(1))))
    cut = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.greatest(-most, F.least(most, F.floor(x * SCALE))))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), "label", cut.alias("v"))


def cuts(dim: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end: equal, or as equal as its length allows."""
    ends = [i * dim // PARTS for i in range(PARTS + 1)]
    return list(zip(ends[:-1], ends[1:], strict=True))


class Cells:
    """The nearest entry of one codebook, by way of the cells of the grid."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.memo: dict[int, int] = {}  # hash of a cell -> its place in the two arrays
        self.cells, self.found = np.zeros((0, entries.shape[1]), np.int64), np.zeros(0, np.int64)
        self.mixer = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, entries.shape[1]) | 1
        self.measured = 0

    def possible(self, cells: np.ndarray) -> np.ndarray:
        """Bits of the entries that aren't dominated over the box of each cell.

        An entry is dominated when its least distance to the box is above the greatest
        one of another entry, or when the greatest difference, over the box, of the
        distance to the entry nearest to its middle and the distance to itself, which
        is linear in the point, is below zero.
        """
        low = cells[:, None, :] << CELL
        high = low + (1 << CELL) - 1
        least = np.maximum(np.maximum(low - self.entries, self.entries - high), 0)
        most = np.maximum(np.abs(low - self.entries), np.abs(high - self.entries))
        fine = (least * least).sum(2) <= (most * most).sum(2).min(1, keepdims=True)
        middle = low + (1 << (CELL - 1)) - self.entries
        rival = self.entries[(middle * middle).sum(2).argmin(1)][:, None, :]
        apart = self.entries - rival
        square = (rival * rival).sum(2) - (self.entries * self.entries).sum(1)
        fine &= square + 2 * (np.where(apart > 0, high, low) * apart).sum(2) >= 0
        return (fine << np.arange(len(self.entries))).sum(1)

    def bits(self, x: np.ndarray) -> np.ndarray:
        """The bits of each part's cell, from the cells kept, by a 64-bit hash; cells are compared, so that hashes that collide do no harm."""
        cells = x >> CELL
        hashes = (cells * self.mixer).sum(1)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        own = cells[first]
        if (own[inverse] != cells).any():  # two cells of this batch share a hash
            own, inverse = np.unique(cells, axis=0, return_inverse=True)
            return self.possible(own)[inverse.ravel()]
        at = np.array([self.memo.get(h, -1) for h in hashes[first].tolist()])
        new = at < 0
        if len(self.memo) + new.sum() > CELLS:
            self.memo, self.cells, self.found, new = {}, own[:0], own[:0, 0], np.ones(len(own), bool)
        if new.any():
            at[new] = len(self.cells) + np.arange(new.sum())
            self.memo.update(zip(hashes[first][new].tolist(), at[new].tolist(), strict=True))
            self.cells, self.found = np.concatenate([self.cells, own[new]]), np.concatenate([self.found, self.possible(own[new])])
        bits = self.found[at]
        other = (self.cells[at] != own).any(1)  # a cell kept by the same hash
        if other.any():
            bits[other] = self.possible(own[other])
        return bits[inverse]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry, ties to the lower index."""
        if not x.shape[1] or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        row, entry = np.nonzero(self.bits(x)[:, None] >> np.arange(len(self.entries)) & 1)
        self.measured += len(row)
        away = x[row] - self.entries[entry]
        away = (away * away).sum(1)
        start = np.searchsorted(row, np.arange(len(x)))
        best = np.minimum.reduceat(away, start)
        least = np.flatnonzero(away == best[row])
        return entry[least[np.searchsorted(row[least], np.arange(len(x)))]], best


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each length of vectors in a batch, and their vectors."""
    v = batch.column("v")
    ends, values = v.offsets.to_numpy(), v.values.to_numpy()
    sizes = np.diff(ends)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield at, values[(ends[at][:, None] + np.arange(dim)).ravel()].reshape(len(at), dim)


def first_books(ints: DataFrame) -> Books:
    """The vectors with the smallest ids (null last, then by their components) of each length in ``ints``."""
    sized = ints.withColumn("dim", F.size("v"))
    place = F.row_number().over(W.partitionBy("dim").orderBy(F.asc_nulls_last("vec_id"), "v"))
    rows = sized.withColumn("n", place).where(F.col("n") <= ENTRIES).orderBy("dim", "n").collect()
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(r["dim"], []).append(r["v"])
    return {d: np.array(v, np.int64).reshape(len(v), d) for d, v in found.items()}


def next_books(ints: DataFrame, books: Books) -> Books:
    """One round: every entry becomes the floor of the mean of the parts that are nearest to it; entries without any stay."""
    sent = ints.sparkSession.sparkContext.broadcast(books)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[int, int], Cells] = {}
        count = {d: np.zeros((len(b), d), np.int64) for d, b in sent.value.items()}
        total = {d: np.zeros((len(b), d), np.int64) for d, b in sent.value.items()}
        for batch in batches:
            for _, x in by_length(batch):
                dim = x.shape[1]
                for p, (i, j) in enumerate(cuts(dim)):
                    part = np.ascontiguousarray(x[:, i:j])
                    own = cells.setdefault((dim, p), Cells(sent.value[dim][:, i:j]))
                    index, _ = own.nearest(part)
                    for e in np.unique(index):
                        mine = part[index == e]
                        count[dim][e, i:j] += len(mine)
                        total[dim][e, i:j] += mine.sum(0)
        for dim in count:
            at = np.flatnonzero(count[dim].ravel())
            dims = np.full(len(at), dim, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (dims, at, count[dim].ravel()[at], total[dim].ravel()[at])], names=["dim", "at", "n", "total"])

    sums = ints.mapInArrow(summed, "dim int, at long, n long, total long").groupBy("dim", "at")
    rows = sums.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # at most one for each component of the codebooks
    after = {d: b.copy() for d, b in books.items()}
    for r in rows:
        after[r["dim"]].ravel()[r["at"]] = int(r["total"]) // r["n"]
    return after


def digest_of(book: np.ndarray) -> str:
    """SHA-256 of all components as decimals joined by commas: by part, entry and place."""
    parts = [book[:, i:j].ravel() for i, j in cuts(book.shape[1])]
    return hashlib.sha256(",".join(map(str, np.concatenate(parts).tolist())).encode()).hexdigest()


def fitted(ints: DataFrame) -> Books:
    """The codebooks of each length of vectors in ``ints``."""
    books = first_books(ints)
    for _ in range(ROUNDS):
        books = next_books(ints, books)
    return books


def coded(ints: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, code, error and codebooks_sha256 of each row of ``ints``."""
    sent = ints.sparkSession.sparkContext.broadcast((books, {d: digest_of(b) for d, b in books.items()}))
    label = ints.schema["label"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[int, int], Cells] = {}
        known, digests = sent.value
        for batch in batches:
            for at, x in by_length(batch):
                dim = x.shape[1]
                code, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
                for p, (i, j) in enumerate(cuts(dim)):
                    own = cells.setdefault((dim, p), Cells(known[dim][:, i:j]))
                    code[:, p], away = own.nearest(np.ascontiguousarray(x[:, i:j]))
                    error += away
                whole = [batch.column("vec_id").take(pa.array(at)), batch.column("label").take(pa.array(at))]
                whole += [pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error), pa.array([digests[dim]] * len(at), pa.string())]
                yield pa.RecordBatch.from_arrays(whole, names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    return ints.mapInArrow(each, f"vec_id long, label {label}, code string, error long, codebooks_sha256 string")


def decoded(codes: DataFrame, book: np.ndarray) -> DataFrame:
    """``codes`` with ``approximate``: the middles of the steps that a code's entries of ``book`` stand for."""
    parts = [F.array(*[F.array(*[F.lit((float(c) + 0.5) / SCALE) for c in row]) for row in book[:, i:j]]) for i, j in cuts(book.shape[1])]
    index = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("approximate", F.concat(*[F.get(part, index(p)) for p, part in enumerate(parts)]))


def vector_codes(vectors: DataFrame) -> DataFrame:
    """Codes of vectors by codebooks fitted on all of them.

    ``vectors`` has vec_id, embedding and label; other columns are ignored. Rows whose
    vector is null or holds a null or non-finite component are dropped. Returns vec_id,
    label, code (an index of two hex digits for each part), error (squared distance to
    the entries, in steps), label_error (the errors of all rows of the same label; nulls
    are one label; null beyond a long) and codebooks_sha256. Vectors of each length have
    codebooks of their own; a length that isn't a multiple of PARTS is cut as equally
    as it can be. Of fewer vectors than ENTRIES each is an entry. Repeated ids and
    rows count and are returned each; a null id comes after all others. An empty table
    gives no rows.
    """
    small_batches(vectors.sparkSession)
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))  # bounded in bytes all the same
    ints = saved(integers(vectors))
    groups: list[list[int]] = [[]]
    for dim in sorted(r[0] for r in ints.select(F.size("v")).distinct().collect()):
        if groups[-1] and (sum(groups[-1]) + dim) * ENTRIES > TOGETHER:
            groups.append([])
        groups[-1].append(dim)
    whole = None
    for group in groups:
        own = ints.where(F.size("v").isin(group))
        rows = saved(coded(own, fitted(own)))
        whole = rows if whole is None else whole.union(rows)
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    whole = whole.withColumn("_key", key)
    sums = saved(whole.groupBy("_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count(F.lit(1)).alias("n")))
    told = spread_join(whole, sums.select("_key", "label_error"), "_key", hot_keys(sums, "_key"), "vec_id")
    return told.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


def _round(before: str, after: str) -> str:
    """SQL of one round: assign ``before``, then floor the means into ``after``."""
    return f"""
{before}_a AS ({_assigned(before)}),
{after} AS (SELECT b.part, b.entry, b.pos, coalesce(m.mean, b.x) AS x FROM {before} AS b LEFT JOIN (
  SELECT v.part, a.entry, v.pos, CAST(floor(sum(v.x) / count(*)) AS BIGINT) AS mean FROM v JOIN {before}_a AS a USING (vec_id, part) GROUP BY 1, 2, 3) AS m USING (part, entry, pos)),"""


def _assigned(book: str) -> str:
    return f"""SELECT vec_id, part, min_by(entry, d * 16 + entry) AS entry, min(d) AS d FROM (
  SELECT v.vec_id, v.part, b.entry, CAST(sum((v.x - b.x) * (v.x - b.x)) AS BIGINT) AS d FROM v JOIN {book} AS b USING (part, pos) GROUP BY 1, 2, 3) GROUP BY 1, 2"""


OP12_SQL = (
    """
WITH k AS (SELECT vec_id, label, embedding AS e, len(embedding) // 8 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, w, unnest(e) AS x, unnest(range(len(e))) AS i FROM k),
v AS (SELECT vec_id, i // w AS part, i % w AS pos, CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM u),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 16),
b0 AS (SELECT part, entry, pos, x FROM v JOIN f USING (vec_id)),"""
    + "".join(_round(f"b{i}", f"b{i + 1}") for i in range(ROUNDS))
    + f"""
z AS ({_assigned("b6")}),
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b6) AS codebooks_sha256
FROM c JOIN k USING (vec_id)
"""
)
