"""Landed raw messages: a folder with one JSON object per file."""

import re
from collections.abc import Iterator
from itertools import groupby, islice
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from spendlake.staging import file_system, qualified

#: Tasks send on so many bytes of files, or so many paths, at a time.
SENT_BYTES = 4 << 20
SENT_PATHS = 10_000
#: What Java's URIs write as %XX, in a path.
_QUOTED = re.compile(r"[^\w.!~*'():@&=+$,;/\x80-\U0010ffff-]|[\x80-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", re.A)


def as_messages(files: DataFrame) -> DataFrame:
    """Path and text of whole-text files, read as a batch or as a stream.

    A file that is not UTF-8 has a NULL text, so that it becomes an unreadable
    message and not a failed job.
    """
    return files.select(F.col("_metadata.file_path").alias("raw_path"), _text(F.col("value")))


def _text(value: Column) -> Column:
    return F.when(F.is_valid_utf8(value), value).alias("text")


def scan_messages(spark: SparkSession, folder: str, nested: bool = False) -> DataFrame:
    """Path and text of every ``*.json`` file; other files are ignored.

    ``nested`` also looks into sub-folders; tasks then list and read the files, each time that the result is
    computed, and the driver holds none of them. Spark's reader, whose driver holds every file, reads
    one folder alone, a pattern of folders, and a store that ``pyarrow.fs`` does not know.
    """
    if nested and _is_known_folder(spark, folder):
        return _scan_in_tasks(spark, folder)
    files = (
        spark.read.option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", nested)
        .text(folder, wholetext=True)
    )
    return as_messages(files)


def _is_known_folder(spark: SparkSession, folder: str) -> bool:
    """Whether tasks can list ``folder`` themselves."""
    if not set("{}[]*?\\").isdisjoint(folder):
        return False
    try:
        files, base = file_system(qualified(spark, folder))
        return files.get_file_info(base).type == pyarrow.fs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def _is_hidden(name: str, is_folder: bool) -> bool:
    """Whether Spark's reader passes over a file or folder of this name."""
    if is_folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _children(files: pyarrow.fs.FileSystem, base: str, inside: str) -> Iterator[tuple[str, bool]]:
    """Path under ``base``, and whether it is a folder, of the folders and ``*.json`` files that stand in ``inside``.

    Files without a byte have no text, and no row.
    """
    found = pyarrow.fs.FileSelector(f"{base}{inside}" or "/", allow_not_found=inside != "")
    for info in files.get_file_info(found):
        is_folder = info.type == pyarrow.fs.FileType.Directory
        is_message = info.is_file and info.size != 0 and info.base_name.endswith(".json")
        if (is_folder or is_message) and not _is_hidden(info.base_name, is_folder):
            yield f"{inside}/{info.base_name}", is_folder


def _scan_in_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """One task lists ``folder``, tasks walk its sub-folders, tasks read the files.

    A task holds the list of one folder, and SENT_BYTES or one file.
    """
    target = qualified(spark, folder)
    shown = spark._jvm.org.apache.hadoop.fs.Path(target).toUri().toString().rstrip("/")
    schema = "path string, is_folder boolean"

    def located() -> tuple[pyarrow.fs.FileSystem, str]:
        files, base = file_system(target)
        return files, base.rstrip("/")

    def sent(found: Iterator[tuple[str, bool]]) -> Iterator[pa.RecordBatch]:
        while part := list(islice(found, SENT_PATHS)):
            paths, folders = zip(*part)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(folders)], ["path", "is_folder"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = located()
        for batch in batches:
            for _ in range(batch.num_rows):
                yield from sent(_children(files, base, ""))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = located()

        def below() -> Iterator[tuple[str, bool]]:
            for batch in batches:
                for path, is_folder in zip(batch.column("path").to_pylist(), batch.column("is_folder").to_pylist()):
                    if not is_folder:
                        yield path, False
                    folders = [path] * is_folder
                    while folders:
                        for child, is_folder in _children(files, base, folders.pop()):
                            if is_folder:
                                folders.append(child)
                            else:
                                yield child, False

        yield from sent(below())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = located()
        held, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with files.open_input_stream(f"{base}{path}", compression=None) as file:
                    value = file.read()
                raw_path = shown + _QUOTED.sub(lambda found: quote(found[0], safe=""), path)
                if held and size + len(value) > SENT_BYTES:
                    yield _read_batch(held)
                    held, size = [], 0
                held.append((raw_path, value))
                size += len(raw_path) + len(value)
        if held:
            yield _read_batch(held)

    # Dealt by path, so that a task that runs again finds its own files; by number, as paths are too
    # small for adaptive execution to see what is behind them.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = spark.range(0, 1, 1, 1).mapInArrow(listed, schema).repartition(tasks, "path")
    paths = top.mapInArrow(walked, schema).select("path").repartition(tasks, "path")
    found = paths.mapInArrow(read, "raw_path string, value binary")
    return found.select("raw_path", _text(F.col("value").cast("string")))


def _read_batch(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
    paths, values = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.binary())], ["raw_path", "value"])


def land_messages(messages: DataFrame, folder: str) -> None:
    """Write each ``text`` of ``messages`` to the ``*.json`` file of its ``file``, in sub-folders of ``folder``.

    Rows with one ``file`` (or none) are lines of one file. Tasks write the files where they stay:
    a writer of Spark moves every file on the driver. File names are hashes of ``file``.
    """
    target = qualified(messages.sparkSession, folder)
    files, base = file_system(target)
    files.create_dir(base)

    def write(rows: Iterator[Row]) -> None:
        files, base = file_system(target)
        for part, named in groupby(rows, lambda r: r["name"][:2]):
            files.create_dir(f"{base}/{part}")
            for name, lines in groupby(named, lambda r: r["name"]):
                with files.open_output_stream(f"{base}/{part}/{name}.json") as out:
                    for line in lines:
                        out.write(f"{line['text']}\n".encode())

    name = F.coalesce(F.sha2("file", 256), F.lit("none")).alias("name")
    messages.select(name, "text").repartition("name").sortWithinPartitions("name").foreachPartition(write)


def compact(messages: DataFrame, path: str) -> None:
    """Store scanned messages as Parquet, so that later runs read few files."""
    messages.hint("rebalance").write.mode("append").parquet(path)
