"""Provider responses that were landed, as a data source of its own: ``provider_modules``.

Responses lie in folders module_key=.../currency=.../rate=..., a response on each line of
a file. A module is a partition of the scan, so that a module that is fetched anew is a
task that is run anew. Equality and IN filters on the three folder columns are taken
over by the source: what they rule out is never listed or opened.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

FOLDERS = ["module_key", "currency", "rate"]
SCHEMA = "module_key string, currency string, rate string, response_sha256 string, payload string"
PUSH_DOWN = "spark.sql.python.filterPushdown.enabled"


def land(responses: DataFrame, path: str) -> None:
    """Write responses (module_key, currency, rate, payload) as they came; line breaks inside a payload, which JSON doesn't need, become spaces."""
    rows = responses.select(*FOLDERS, F.regexp_replace("payload", "[\r\n]+", " ").alias("value"))
    rows.repartition(*FOLDERS).write.mode("append").partitionBy(*FOLDERS).text(path)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it: whatever Arrow can reach (local, HDFS, object stores)."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class ModuleFiles(InputPartition):
    """The folders of one module that are read."""

    def __init__(self, module: str, folders: list[tuple[str, str, str]]):
        self.module, self.folders = module, folders


class ModuleReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes over what the folders' names decide; Spark evaluates the rest."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in FOLDERS:
                yield f
                continue
            name = f.attribute[0]
            self.wanted[name] = self.wanted[name] & values if name in self.wanted else values

    def inside(self, files: fs.FileSystem, folder: str, column: str) -> Iterator[tuple[str, str]]:
        """The values of a folder column below ``folder``, and where they lie, as far as they are wanted."""
        for found in files.get_file_info(fs.FileSelector(folder)):
            name, _, value = found.base_name.partition("=")
            value = unquote(value)
            if found.type == fs.FileType.Directory and name == column and value in self.wanted.get(column, {value}):
                yield value, found.path

    def partitions(self) -> list[InputPartition]:
        files, root = opened(self.path)
        out = []
        for module, at in self.inside(files, root, FOLDERS[0]):
            folders = [(currency, rate, there) for currency, below in self.inside(files, at, FOLDERS[1]) for rate, there in self.inside(files, below, FOLDERS[2])]
            if folders:
                out.append(ModuleFiles(module, folders))
        return sorted(out, key=lambda p: p.module) or [ModuleFiles("", [])]

    def read(self, partition: ModuleFiles) -> Iterator[tuple]:
        files, _ = opened(self.path)
        for currency, rate, folder in partition.folders:
            for found in files.get_file_info(fs.FileSelector(folder)):
                if found.type != fs.FileType.File or found.base_name.startswith(("_", ".")):
                    continue
                with files.open_input_stream(found.path) as stream:
                    for line in stream.read().decode().split("\n"):
                        if line:
                            yield partition.module, currency, rate, hashlib.sha256(line.encode()).hexdigest(), line


class ProviderModules(DataSource):
    @classmethod
    def name(cls) -> str:
        return "provider_modules"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return ModuleReader(self.options["path"])


def landed_modules(spark: SparkSession, path: str) -> DataFrame:
    """The responses landed under ``path``: module_key, currency, rate, response_sha256 and payload. Filters on the first three choose folders."""
    spark.dataSource.register(ProviderModules)
    spark.conf.set(PUSH_DOWN, "true")
    return spark.read.format("provider_modules").option("path", path).load()
