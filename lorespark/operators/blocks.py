"""Tables that tasks read block by block from the shared folder, instead of a broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame

from lorespark.session import shared_folder


def write_blocks(df: DataFrame, rows: int) -> str:
    """``df`` as files of at most ``rows`` rows in a new shared folder; its name."""
    folder = f"{shared_folder(df.sparkSession, 'blocks')}/rows"
    df.write.option("maxRecordsPerFile", max(1, rows)).parquet(folder)
    return folder


def read_blocks(folder: str) -> Iterator[pa.Table]:
    """The blocks, one at a time; for use in tasks."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:"):]
    store, root = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    for info in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda x: x.path):
        if info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as file:
                yield pq.read_table(file)


def held(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Batches gathered, or cut, to about ``limit`` bytes; a larger row is alone."""
    kept, size = [], 0
    for batch in batches:
        step = max(1, limit * batch.num_rows // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, step):
            kept.append(batch.slice(start, step))
            size += batch.nbytes * kept[-1].num_rows // batch.num_rows
            if size >= limit:
                yield pa.Table.from_batches(kept)
                kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept)
