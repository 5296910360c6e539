"""Sinks: guarded CSV, JSON, and upserts of keyed tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import csv_guard


def guarded(df: DataFrame) -> DataFrame:
    """Every text cell made safe for spreadsheets."""
    return df.select(*[csv_guard(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def csv_lines(df: DataFrame) -> DataFrame:
    """``line``: the rows as CSV, every cell quoted, quotes doubled, nulls as empty cells, formulas neutralised."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return guarded(df).select(F.concat_ws(",", *[quoted(F.col(f"`{c}`").cast("string")) for c in df.columns]).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files, each with a byte order mark, a header and CRLF line ends; every cell is quoted and formulas are neutralised."""
    header = "\ufeff" + ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    headed = lambda lines: chain([header], lines)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for batch in batches:
            yield pd.DataFrame({"line": list(headed(batch["line"]) if first else batch["line"])})
            first = False

    csv_lines(df).mapInPandas(each, "line string").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old table with the new rows in place of those of the same key, to be written elsewhere and published."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def append_once(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table doesn't have; the number of rows written.

    The fresh rows are written to a folder of their own first and counted there, so
    that ``df`` is worked out once; Spark's commit then adds their files to the table.
    One writer at a time.
    """
    spark = df.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    staged = f"{path.rstrip('/')}__staged_{uuid.uuid4().hex}"
    df.write.parquet(staged)
    fresh = spark.read.schema(df.schema).parquet(staged)
    fresh.write.mode("append").parquet(path)
    return fresh.count()


def publish(df: DataFrame, folder: str, name: str) -> str:
    """Write a table under a new name and make it the current one of ``name``: readers see the old or the new table, whole.

    The pointer is written last, itself by Spark's commit; a run that fails before leaves the old table current.
    """
    version = f"{folder}/{name}__{uuid.uuid4().hex}"
    df.write.parquet(version)
    df.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{folder}/{name}__published")
    return version


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table that was published last under the name."""
    pointers = spark.read.parquet(f"{folder}/{name}__published").select("version", F.col("_metadata.file_modification_time").alias("at"))
    return spark.read.parquet(pointers.orderBy(F.desc("at"), F.desc("version")).first()["version"])


def schema_json(schemas: dict[str, str]) -> dict[str, str]:
    """JSON schema of every table that is given as DDL, by name."""
    return {name: StructType.fromDDL(ddl).json() for name, ddl in schemas.items()}
