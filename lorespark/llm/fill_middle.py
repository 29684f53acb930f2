"""Fill-in-middle texts by rotating blocks in place, and the texts rebuilt from them.

A text is cut at two places into prefix, middle and suffix. One bytearray takes the text and the
three sentinels in reading order: <P> prefix <M> middle <S> suffix. Two neighbouring blocks change
places by three reversals within that array: ``psm`` swaps middle and suffix, ``spm`` then also
swaps prefix and suffix. Rebuilding finds each sentinel once, undoes the swaps in the opposite
order and takes the sentinels out, so the very bytes of the text come back.

The cuts and the form follow from a hash of the seed and the id alone, so a lost task writes the
same again. Lengths and cuts count code points; a byte that is not UTF-8 counts as one.

Defined results: a null text is an empty one; an empty text, one that holds a sentinel, and the
share ``plain`` of the others stay as they are (no cuts); a null id is hashed as no digits, so
equal ids make equal cuts; repeated rows stay rows; an empty table gives no rows; columns of the
input are kept, and those named like a column of FORMED give way to it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The sentinels.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes that one step of a reversal takes out of the array.
STEP = 1 << 16
#: Bytes of text that go out in one Arrow batch; a longer text is a batch of its own.
SLICE = 8 << 20
SEED = 1
FORMED = "n long, form string, prefix_chars long, middle_chars long, output binary"


def reverse(buf: bytearray, start: int, end: int) -> None:
    """``buf[start:end]`` backwards, in place, with two pieces of at most STEP bytes beside it."""
    while end - start > 1:
        step = min(STEP, (end - start) // 2)
        left = buf[start:start + step]
        buf[start:start + step] = buf[end - step:end][::-1]
        buf[end - step:end] = left[::-1]
        start, end = start + step, end - step


def rotate(buf: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange the blocks ``buf[start:cut]`` and ``buf[cut:end]``: each reversed, then both."""
    reverse(buf, start, cut)
    reverse(buf, cut, end)
    reverse(buf, start, end)


def points(text: bytes) -> str:
    """Code points; a byte that is not UTF-8 is one of its own."""
    return text.decode("utf-8", "surrogateescape")


def form(text: bytes, first: int, second: int, spm: bool) -> bytearray:
    """The text with its three parts in the order of the form; cuts are byte offsets."""
    buf = bytearray(text)
    buf[second:second] = SUFFIX
    buf[first:first] = MIDDLE
    buf[0:0] = PREFIX
    middle = len(PREFIX) + first
    suffix = middle + len(MIDDLE) + second - first
    rotate(buf, middle, suffix, len(buf))
    if spm:
        rotate(buf, 0, middle, middle + len(buf) - suffix)
    return buf


def restore_one(output: bytes, kind: str) -> bytes:
    """The text of an output."""
    if kind == PLAIN:
        return output
    buf = bytearray(output)
    last = buf.find(MIDDLE)
    if kind == SPM:
        rotate(buf, 0, buf.find(PREFIX), last)
    suffix = buf.find(SUFFIX)
    rotate(buf, suffix, last, len(buf))
    middle = buf.find(MIDDLE)
    suffix = middle + len(buf) - last
    del buf[suffix:suffix + len(SUFFIX)], buf[middle:middle + len(MIDDLE)], buf[:len(PREFIX)]
    return bytes(buf)


def transform_one(
    doc_id: int | None, text: bytes, seed: int, plain: int, spm: int,
) -> tuple[int, str, int | None, int | None, bytes]:
    """FORMED of one text; ``plain`` and ``spm`` are shares in hundredths."""
    chars = points(text)
    n = len(chars)
    key = f"{seed}:{'' if doc_id is None else doc_id}".encode()
    h1, h2, h3, h4 = struct.unpack(">4I", sha256(key).digest()[:16])
    if not text or h3 % 100 >= 100 - plain or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    before, within = chars[:first], chars[first:second]
    cut = first if chars.isascii() else len(before.encode("utf-8", "surrogateescape"))
    end = second if chars.isascii() else cut + len(within.encode("utf-8", "surrogateescape"))
    kind = SPM if h4 % 100 < spm else PSM
    return n, kind, first, second - first, bytes(form(text, cut, end, kind == SPM))


def _by_row(work: Callable[..., tuple], inputs: int, schema: T.StructType) -> Callable:
    """A function of batches whose last ``inputs`` columns feed ``work`` and give way to its result.

    Rows go out in batches of at most SLICE bytes of results, so memory follows the longest text.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.num_columns - inputs
            done, size, begun = [], 0, 0
            for i in range(batch.num_rows):
                done.append(work(*(batch.column(kept + c)[i].as_py() for c in range(inputs))))
                size += len(done[-1][-1])
                if size >= SLICE or i == batch.num_rows - 1:
                    own = batch.slice(begun, len(done)).columns[:kept]
                    made = [pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), list(target)[kept:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [c.cast(f.type) for c, f in zip(own, target, strict=False)] + made, schema=target)
                    done, size, begun = [], 0, i + 1

    return run


def _without(df: DataFrame, names: list[str]) -> DataFrame:
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, plain: int = 10, spm: int = 20,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``docs`` without its text, and FORMED of it; ``output`` is what a trainer reads, in UTF-8."""
    kept = _without(docs, [text_column, *T.StructType.fromDDL(FORMED).names])
    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(FORMED).fields])
    columns = [*(F.col(f"`{c}`") for c in kept.columns), F.col(id_column).cast("long").alias("_id"),
               F.coalesce(F.col(text_column).cast("string").cast("binary"), F.lit(b"")).alias("_text")]

    def work(doc_id: int | None, text: bytes) -> tuple:
        return transform_one(doc_id, text, seed, plain, spm)

    return docs.select(*columns).mapInArrow(_by_row(work, 2, schema), schema)


def restore(formed: DataFrame, form_column: str = "form", output_column: str = "output") -> DataFrame:
    """``formed`` and ``restored``, the bytes of every text, from output and form alone."""
    kept = _without(formed, ["restored"])
    schema = T.StructType([*kept.schema.fields, T.StructField("restored", T.BinaryType())])
    columns = [*(F.col(f"`{c}`") for c in kept.columns), F.col(output_column).alias("_output"), F.col(form_column).alias("_form")]

    def work(output: bytes, kind: str) -> tuple:
        return (restore_one(output, kind),)

    return formed.select(*columns).mapInArrow(_by_row(work, 2, schema), schema)
