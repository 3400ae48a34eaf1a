"""A folder for each cell, `key=value` as partitioned tables name them, with Parquet files: written and read by many tasks, at
what a small file costs for each cell and with nothing done by the driver for each of them but to list its name.

Rows come sorted by folder, so a task has one file open at a time and holds GATHERED_BYTES of rows. All folders are made below
a hidden one beside the target, which takes the target's name in one move when all tasks have committed; what was there before
stays until then. A file is written under a hidden name of its attempt and gets its own when it is whole. That one is made of
the task's partition, so a task that runs again replaces what an attempt before it left.

For reading, the driver lists the names of the folders and deals them out; tasks list and open what is in them. Values of the
key are text. Pages carry checksums, which are verified. Spark's own reader takes these folders too, as a table partitioned by
the key. Files are opened through pyarrow's file systems, by the path's scheme; such a store has to have folders that move.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from itertools import groupby

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of rows of one cell that are written, or of several that are given on, at a time; the fewest cells of a reading task.
GATHERED_BYTES, LEAST_CELLS = 4 << 20, 64
#: The folder of null, and of empty text, which no folder can be named by; characters that are escaped in names.
NONE = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = {k: f"%{k:02X}" for k in (*range(1, 32), 127, *map(ord, "\"#%'*/:=?\\{[]^"))}


def store(path: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark itself would take it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def deleted(fs, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    there = fs.get_file_info(path)
    if there.is_file:
        fs.delete_file(path)
    elif there.type.name != "NotFound":
        fs.delete_dir(path)


def folder(key: str, value: str | None) -> str:
    return f"{key.translate(ESCAPED)}={NONE if value is None else value.translate(ESCAPED)}"


def value(name: str) -> str | None:
    own = name.split("=", 1)[1]
    return None if own == NONE else re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), own)


def runs(column) -> list[tuple[int, int]]:
    """[start, end) of each run of equal values, nulls equal to each other."""
    import pyarrow.compute as pc

    codes = pc.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    borders = [0, *((codes[1:] != codes[:-1]).nonzero()[0] + 1).tolist(), len(codes)]
    return list(zip(borders[:-1], borders[1:], strict=True)) if len(codes) else []


def slices(batches):
    """(key, rows) for each run of keys, which are the last column."""
    for b in batches:
        keys, rows = b.column(b.num_columns - 1), b.select(b.schema.names[:-1])
        for start, end in runs(keys):
            yield keys[start].as_py(), rows.slice(start, end - start)


def gathered(batches):
    """Tables of GATHERED_BYTES or little more, of the same rows in the same order."""
    import pyarrow as pa

    parts, size = [], 0
    for b in batches:
        parts.append(b)
        size += b.nbytes
        if size >= GATHERED_BYTES:
            yield pa.Table.from_batches(parts)
            parts, size = [], 0
    if parts:
        yield pa.Table.from_batches(parts)


class CellWriter(DataSourceArrowWriter):
    """The last column of what it is given is the key as text, by which rows are sorted."""

    def __init__(self, path: str, key: str):
        top, name = path.rstrip("/").rsplit("/", 1)
        self.path, self.key, self.staging = path, key, f"{top}/_{name}-{uuid.uuid4().hex}"

    def write(self, iterator):
        import pyarrow.parquet as pq

        fs, top = store(self.staging)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}.parquet"
        for key, own in groupby(slices(iterator), lambda s: s[0]):
            at = f"{top}/{folder(self.key, key)}"
            hidden, writer = f"{at}/_{task.taskAttemptId()}-{name}", None
            fs.create_dir(at, recursive=True)
            for rows in gathered(rows for _, rows in own):
                writer = writer or pq.ParquetWriter(hidden, rows.schema, filesystem=fs, write_page_checksum=True)
                writer.write_table(rows)
            writer.close()
            fs.move(hidden, f"{at}/{name}")
        return WriterCommitMessage()

    def commit(self, messages):
        (fs, staging), (_, top) = store(self.staging), store(self.path)
        fs.create_dir(staging, recursive=True)
        fs.open_output_stream(f"{staging}/_SUCCESS").close()
        deleted(fs, top)
        fs.move(staging, top)

    def abort(self, messages):
        deleted(*store(self.staging))


@dataclass
class Cells(InputPartition):
    """Names of folders."""

    names: list[str]


class CellReader(DataSourceReader):
    def __init__(self, path: str, key: str, columns: list[str], tasks: int):
        self.path, self.key, self.columns, self.tasks = path, key, columns, tasks

    def partitions(self):
        from pyarrow.fs import FileSelector, FileType

        fs, top = store(self.path)
        begin = folder(self.key, "")
        names = sorted(f.base_name for f in fs.get_file_info(FileSelector(top)) if f.type == FileType.Directory and f.base_name.startswith(begin))
        n = max(LEAST_CELLS, -(-len(names) // self.tasks))
        return [Cells(names[k : k + n]) for k in range(0, len(names), n)] or [Cells([])]

    def read(self, partition):
        for rows in gathered(self._batches(partition.names)):
            yield from rows.combine_chunks().to_batches()

    def _batches(self, names: list[str]):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector

        fs, top = store(self.path)
        own = [c for c in self.columns if c != self.key]
        for name in names:
            for f in fs.get_file_info(FileSelector(f"{top}/{name}")):
                if f.base_name[0] in "_.":
                    continue
                with pq.ParquetFile(f.path, filesystem=fs, page_checksum_verification=True) as file:
                    for b in file.iter_batches(columns=own):
                        key = pa.repeat(pa.scalar(value(name), pa.string()), b.num_rows)
                        yield pa.RecordBatch.from_arrays([key if c == self.key else b.column(c) for c in self.columns], self.columns)


class CellSource(DataSource):
    """format("chiasma_cells"). Options: path, key; to read, tasks (at most) and a schema."""

    @classmethod
    def name(cls):
        return "chiasma_cells"

    def reader(self, schema):
        if self.options["key"] in schema.names and schema[self.options["key"]].dataType.simpleString() != "string":
            raise ValueError(f"{self.options['key']}: the key is read as a string")
        return CellReader(self.options["path"], self.options["key"], schema.names, int(self.options.get("tasks", 1)))

    def writer(self, schema, overwrite):
        return CellWriter(self.options["path"], self.options["key"])


def write(df: DataFrame, path: str, key: str, *order: str) -> None:
    """Overwrites. Rows are dealt by ranges of folder and order, and stand in that order in the files."""
    spark, name = df.sparkSession, "_folder"
    while name in df.columns:
        name += "_"
    spark.dataSource.register(CellSource)
    rows = df.withColumn(name, F.nullif(F.col(f"`{key}`").cast("string"), F.lit(""))).drop(key)
    rows = rows.repartitionByRange(name, *order).sortWithinPartitions(name, *order)
    rows.select(*[f"`{c}`" for c in rows.columns if c != name], name).write.format("chiasma_cells").mode("append").option("key", key).save(qualified(spark, path))


def read(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The columns of schema, in which the key is a string, from all folders of it."""
    spark.dataSource.register(CellSource)
    tasks = 4 * spark.sparkContext.defaultParallelism
    return spark.read.format("chiasma_cells").schema(schema).option("key", key).option("tasks", tasks).load(qualified(spark, path))
