"""A data source for tab-separated tables inside zip archives: `spark.read.format("zipped_tables")`.

One partition for each archive; a member is read as a stream, never unpacked or held whole, and only the columns of the
schema are taken from a line."""

from __future__ import annotations

import csv
import io
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

LINE = "_line"


def _opened(path: str):
    """A file of any store that Arrow has a reader for, for reading at any place."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return store.open_input_file(name)


def archives(path: str) -> list[str]:
    """The zip archives of a folder, or the one that is named."""
    from pyarrow import fs

    if path.endswith(".zip"):
        return [path]
    uri = path if "://" in path else f"file://{path}"
    store, name = fs.FileSystem.from_uri(uri)
    head = uri[: len(uri) - len(name)]
    return sorted(head + f.path for f in store.get_file_info(fs.FileSelector(name)) if f.path.endswith(".zip"))


class ZippedTables(DataSource):
    """Options: `path`, a zip archive or a folder of them; `member`, the table's file name in each.

    Columns are text, named by the member's first line; a column of the schema that a member lacks is NULL. `_line` in
    the schema gives the number of the line, which is the order that a member's rows were written in. Archives without
    the member have no row. Bytes that aren't UTF-8 become replacement characters."""

    @classmethod
    def name(cls):
        return "zipped_tables"

    def schema(self):
        for path in archives(self.options["path"]):
            with _opened(path) as raw, zipfile.ZipFile(raw) as box:
                if self.options["member"] in box.namelist():
                    with box.open(self.options["member"]) as member:
                        head = next(csv.reader(io.TextIOWrapper(member, "utf-8", "replace", newline=""), delimiter="\t"), [])
                    return ", ".join(f"`{c}` string" for c in head)
        return f"`{LINE}` long"

    def reader(self, schema: StructType):
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.member, self.names = options["path"], options["member"], [f.name for f in schema.fields]

    def partitions(self):
        return [InputPartition(a) for a in archives(self.path)]

    def read(self, partition):
        with _opened(partition.value) as raw, zipfile.ZipFile(raw) as box:
            if self.member not in box.namelist():
                return
            with box.open(self.member) as member:
                lines = csv.reader(io.TextIOWrapper(member, "utf-8", "replace", newline=""), delimiter="\t")
                head = {name: i for i, name in enumerate(next(lines, []))}
                at = [head.get(name) for name in self.names]
                for number, line in enumerate(lines):
                    value = lambda i: line[i] if i is not None and i < len(line) else None  # noqa: B023, E731
                    yield tuple(number if name == LINE else value(i) for name, i in zip(self.names, at, strict=True))


def zipped(spark: SparkSession, path: str, member: str, names: list[str]):
    """Columns of a member of all archives of a path, as text, with the number of each line."""
    spark.dataSource.register(ZippedTables)
    schema = ", ".join([f"`{n}` string" for n in names] + [f"`{LINE}` long"])
    return spark.read.format("zipped_tables").schema(schema).option("member", member).load(path)
