"""What the operators of this subpackage share: tables, checkpoints, folds."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes, of one Arrow batch handed to Python: the bytes bound batches of very long texts.
ARROW_ROWS, ARROW_BYTES = 500, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder ``sf_dir``, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made and noted in the session,
    but only on a local master (unit tests): on a cluster each machine would have its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.brightledger.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="brightledger-")
        spark.conf.set("spark.brightledger.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    Cuts the lineage: a lost executor costs a reread of the file, not a rerun.
    The folder's owner expires its files; they can't be removed here because the
    returned DataFrame is read later.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key is hot when it has more than this part of all rows (and HOT_ROWS of them): fewer than 20,000 keys are.
HOT_PART, HOT_ROWS = 1 / 20_000, 1000


def hot_keys(sizes: DataFrame, key: str, n: str = "n") -> DataFrame:
    """key and parts: the hot keys of a saved table of sizes, and into how many parts each is to be dealt."""
    whole = sizes.agg(F.sum(n)).first()[0] or 0
    share = max(HOT_ROWS, math.ceil(whole * HOT_PART))
    return sizes.where(F.col(n) > share).select(key, F.ceil(F.col(n) / share).cast("int").alias("parts"))


def spread_join(rows: DataFrame, facts: DataFrame, key: str, hot: DataFrame, by: str) -> DataFrame:
    """``rows`` joined to ``facts``, which has a row for each key, with no task that gets a whole hot key.

    ``hot`` (of ``hot_keys``) is broadcast, as its rows are bounded: a hot key's rows
    are dealt into its parts by a hash of the column ``by``, and its fact is repeated
    for each of them. At most 40,000 facts are added so.
    """
    parts = F.coalesce("parts", F.lit(1))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("parts")
    right = facts.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, [key, "_part"]).drop("_part")


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or the first longer name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def small_batches(spark: SparkSession) -> None:
    """Bound what one Python worker holds of the input at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")
