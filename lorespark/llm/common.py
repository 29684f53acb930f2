"""Word rule, given tables and files written by tasks, shared by the operators."""

from __future__ import annotations

import gzip
import json
from contextlib import suppress

from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A word is a run of characters other than ASCII white space; bytes.split() cuts alike.
SPACES = r"[\x20\x09-\x0D]+"
SHINGLE = 5
SIMILAR = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for a null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, SPACES), lambda w: w != "")


def byte_words(text: bytes | None) -> list[bytes]:
    """The same for UTF-8 bytes, in a task."""
    return (text or b"").lower().split()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def with_text(df: DataFrame, column: str, probe: str) -> tuple[DataFrame, int]:
    """``df`` with the text that tasks read, and its place.

    A string column is read where it stands, so no text is sent twice; others are cast into ``probe`` at the end.
    """
    if [t for c, t in df.dtypes if c == column] == ["string"]:
        return df, df.columns.index(column)
    return df.withColumn(probe, F.col(column).cast("string")), len(df.columns)


def open_folder(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a shared folder as Hadoop writes its address."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return arrow_fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class TaskFile:
    """A file that one attempt of a task writes.

    Its name carries the attempt, so a repeated or speculative attempt never touches the file
    of another; only names in the written result of the committed attempt are ever read.
    """

    def __init__(self, folder: str, stem: str, ending: str, number: int = 0):
        self.store, root = open_folder(folder)
        context = TaskContext.get()
        attempt = context.taskAttemptId() if context else 0
        part = context.partitionId() if context else 0
        self.name = f"{stem}-{part:05d}-{number:04d}-{attempt}{ending}"
        with suppress(OSError):
            self.store.create_dir(root, recursive=True)
        self.out = self.store.open_output_stream(f"{root}/{self.name}", compression=None)
        self.size = 0

    def write(self, data: bytes) -> tuple[int, int]:
        """Offset and length of what was written."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at, len(data)

    def close(self) -> None:
        self.out.close()


class Reader:
    """Range reads from the files of a folder; a few stay open."""

    def __init__(self, folder: str, keep: int = 16):
        self.store, self.root = open_folder(folder)
        self.keep, self.open = keep, {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        file = self.open.pop(name, None) or self.store.open_input_file(f"{self.root}/{name}")
        self.open[name] = file
        if len(self.open) > self.keep:
            self.open.pop(next(iter(self.open))).close()
        return file.read_at(length, offset)

    def size(self, name: str) -> int:
        return self.store.get_file_info(f"{self.root}/{name}").size


def put_json(folder: str, name: str, value: object) -> None:
    store, root = open_folder(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{name}", compression=None) as out:
        out.write(gzip.compress(json.dumps(value).encode()))


def get_json(folder: str, name: str) -> object:
    store, root = open_folder(folder)
    with store.open_input_file(f"{root}/{name}") as file:
        return json.loads(gzip.decompress(file.read()))


def spread(df: DataFrame, count: int) -> DataFrame:
    """Rows dealt round over tasks; for small tables whose work per row is large."""
    return df.repartition(max(1, count))
