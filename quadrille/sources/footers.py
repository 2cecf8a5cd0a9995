"""What Parquet footers say about the tables of a folder, as a Spark data source: no data page is read and no count job started.

``spark.read.format("parquet_footers").load(folder)`` has a row for each file: table, file, bytes, rows, columns, and for dates and times
their least and largest value as the footers' statistics give them. Files are dealt to partitions, and the footers are read in
tasks. A table is a file ``NAME.parquet`` or a folder of that name with files at any depth.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "name string, file string, bytes long, n_rows long, n_cols long, spans array<struct<column: string, low: timestamp, high: timestamp>>"
#: Files whose footers a task reads.
FILES = 64


def _store(path: str):
    """(file system, path within it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, int]]):
        self.files = files


class FooterReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _store(self.folder)
        found = []
        for f in store.get_file_info(fs.FileSelector(root, recursive=True)):
            parts = f.path[len(root) :].strip("/").split("/")
            hidden = any(p.startswith(("_", ".")) for p in parts)
            if f.is_file and parts[0].endswith(".parquet") and parts[-1].endswith(".parquet") and not hidden:
                found.append((parts[0].removesuffix(".parquet"), f.path, f.size))
        found.sort()
        return [Files(found[k : k + FILES]) for k in range(0, len(found), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        store, _ = _store(self.folder)
        for name, path, size in partition.files:
            with store.open_input_file(path) as f:
                footer = pq.ParquetFile(f).metadata
            yield name, path, size, footer.num_rows, len(footer.schema.to_arrow_schema()), list(_spans(footer))


def _spans(footer) -> Iterator[tuple]:
    """(column, least, largest) of columns of dates or times that have statistics in every row group with rows."""
    import datetime as dt

    time = lambda v: v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
    for c in range(footer.num_columns):
        column = footer.schema.column(c)
        if column.logical_type.type not in ("DATE", "TIMESTAMP"):  # 96-bit times have no statistics
            continue
        stats = [footer.row_group(g).column(c).statistics for g in range(footer.num_row_groups) if footer.row_group(g).num_rows]
        known = [s for s in stats if s is not None and s.has_min_max]
        if known and all(s is not None and (s.has_min_max or s.num_values == 0) for s in stats):
            yield column.path, time(min(s.min for s in known)), time(max(s.max for s in known))


class Footers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FooterReader:
        return FooterReader(self.options["path"])


def read_footers(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each file of the folder's tables."""
    spark.dataSource.register(Footers)
    return spark.read.format("parquet_footers").load(folder)


def table_spans(spark: SparkSession, folder: str) -> DataFrame:
    """name, column, first_time, last_time of every column of dates or times whose files all have statistics."""
    files = read_footers(spark, folder).filter("n_rows > 0")
    whole = files.groupBy("name").agg(F.count(F.lit(1)).alias("files"))
    spans = files.select("name", F.explode("spans").alias("s")).groupBy("name", F.col("s.column").alias("column"))
    spans = spans.agg(F.min("s.low").alias("first_time"), F.max("s.high").alias("last_time"), F.count(F.lit(1)).alias("k"))
    return spans.join(whole, "name").filter("k = files").drop("k", "files")
