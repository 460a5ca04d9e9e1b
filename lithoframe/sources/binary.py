"""Pure binary arrays: values of one width, one after the other, without any header.

The kind is in the file's ending. A file is read in ranges of whole values, each a task's
work, through Arrow's file systems; writers name their parts by the order of the cells.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Endings of the kinds of arrays, with their little-endian numpy codes and Spark types.
KINDS = {".db": ("<f8", "double"), ".fb": ("<f4", "float"), ".lb": ("<i8", "bigint"), ".ib": ("<i4", "int"), ".bb": ("|i1", "tinyint")}
#: Endings by what an array holds; wide and narrow.
ENDINGS = {"real": (".db", ".fb"), "float": (".db", ".fb"), "int": (".lb", ".ib"), "integer": (".lb", ".ib"), "bool": (".bb", ".bb"), "boolean": (".bb", ".bb")}
SPLIT_BYTES = 32 << 20
_MOST_TASKS = 10_000


def ending(data_type: str, wide: bool = True) -> str:
    """The ending of files with values of a type."""
    return ENDINGS[data_type.lower()][0 if wide else 1]


def read_array(spark: SparkSession, path: str, kind: str, over_files: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, cell_id (from 0 in each file) and value of the arrays at a path, folder or glob, whose ending says nothing else than ``kind``.

    With ``over_files`` the files, in the order of their names, are one array of the given
    path. Bytes behind the last whole value of a file are passed over.
    """
    code, name = KINDS[kind]
    width = int(code[-1])
    found = spark.read.format("binaryFile").load(path).select("path", F.floor(F.col("length") / width).alias("n"))
    # a row for each file
    before = F.sum("n").over(Window.orderBy(F.length(F.regexp_extract("path", r"[^/]*$", 0)), "path").rowsBetween(Window.unboundedPreceding, -1)) if over_files else F.lit(0)
    per = max(1, split_bytes // width)
    files = found.withColumn("before", F.coalesce(before, F.lit(0)).cast("long")).filter("n > 0")
    count = files.agg(F.sum(F.ceil(F.col("n") / per))).first()[0] or 1
    ranges = files.select("path", "before", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(per).cast("long"))).alias("start"))
    # a range is a row of few bytes, but work for a task: the number of tasks is given, lest they be put together
    ranges = ranges.repartition(int(min(count, _MOST_TASKS)), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for file, before, n, start in zip(*(c.to_pylist() for c in batch.columns)):
                files, at = pafs.FileSystem.from_uri(file)
                with files.open_input_file(at) as source:
                    for low in range(start, min(start + per, n), 1 << 20):
                        some = min(1 << 20, min(start + per, n) - low)
                        values = np.frombuffer(source.read_at(some * width, low * width), dtype=code)
                        ids = before + low + np.arange(len(values), dtype=np.int64)
                        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path if over_files else file), len(values)), pa.array(ids), pa.array(values)], names=["path", "cell_id", "value"])

    return ranges.mapInArrow(run, f"path string, cell_id long, value {name}")


def write_array(values: DataFrame, folder: str, kind: str, cell: str = "cell_id", value: str = "value") -> DataFrame:
    """Writes the values of cells 0, 1, 2 ... in their order, and returns path and n of the parts.

    Each task writes a range of cells under a name of its own and then gives the part its
    final name, which follows from the order of the ranges, so that a task that runs again
    replaces what it wrote.
    """
    code, name = KINDS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        final = f"{root}/part-{TaskContext.get().partitionId():05d}{kind}"
        own, n = f"{root}/_{uuid.uuid4().hex}", 0
        with files.open_output_stream(own, compression=None) as out:
            for batch in batches:
                out.write(np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=code).tobytes())
                n += batch.num_rows
        if n:
            files.move(own, final)
            yield pa.RecordBatch.from_pydict({"path": [final], "n": [n]})
        else:
            files.delete_file(own)

    rows = values.select(F.col(cell).alias("__cell"), F.col(value).cast(name).alias("__value"))
    return rows.repartitionByRange("__cell").sortWithinPartitions("__cell").select("__value").mapInArrow(run, "path string, n long")
