"""Web archives with a two-level capture index.

Records are gzip members of WARC 1.1 files. A capture line is keyed by the URL with its host
reversed, the capture time and the record id. Lines sorted by that key are cut into compressed
blocks; a sparse directory holds the first key and the place of every block. A lookup finds
the index file by its first keys, the block by binary search in that file's directory, the
line by binary search in the block, and then reads one range of the archive.

Defined results: a null payload counts as empty, a null URL has the empty key, a null page id is
kept as null. Repeated rows are archived as often as they occur, and are found once each. Of
payloads repeated within one page id, every row of the smallest id is a response. An empty
table gives no file and no row.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import Reader, TaskFile
from lorespark.operators.joins import materialize

# Fixed values of the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "f" * 17
# Tasks that may share the lookups of one index file.
WAYS = 64
CAPTURE = "key string, file string, offset long, length long"
INDEX = "file string, first string, last string, lines long, offset long, length long"
READ = ("page_id long, url string, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long, payload binary")


def surt(url: str | None) -> str:
    """URL key: host parts reversed, then the path; no scheme, user, fragment or usual port."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip().split("#", 1)[0].lower())
    host, slash, path = re.match(r"([^/?]*)([/?]?)(.*)", rest, re.S).groups()
    host = re.sub(r":(80|443)$", "", host.rsplit("@", 1)[-1])
    key = f"{','.join(reversed(host.split('.')))}){slash if slash == '?' else '/'}{path}"
    return re.sub(r"\s", "%20", key) if host or path else ""


def _id_key(page_id: int | None) -> str:
    return NO_ID if page_id is None else f"{page_id + 2**63:017x}"


def capture_key(url: str | None, page_id: int | None, captured: str) -> str:
    return f"{surt(url)} {re.sub('[^0-9]', '', captured)} {_id_key(page_id)}"


def _urn(page_id: int) -> str:
    return uuid.UUID(int=page_id % 2**64).urn


def _from_urn(urn: str | None) -> int | None:
    if urn is None:
        return None
    number = uuid.UUID(urn).int
    return number - 2**64 if number >= 2**63 else number


def _record(page_id, url, payload: bytes, digest, first_id, captured: str) -> bytes:
    """One compressed record; a revisit keeps the HTTP head and names the first capture."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    revisit = first_id is not None and page_id != first_id
    body = http.encode() + (b"" if revisit else payload)
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}"]
    head += [f"WARC-Record-ID: <{_urn(page_id)}>"] if page_id is not None else []
    head += [f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}"] if url is not None else []
    head += [f"WARC-Date: {captured}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <{_urn(first_id)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse_record(member: bytes) -> dict:
    """The fields of a record and its payload, checked against its digest."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response":
        digest, payload_bytes = hashlib.sha256(payload).hexdigest(), len(payload)
        if digest != fields["WARC-Payload-Digest"].removeprefix("sha256:"):
            raise ValueError(f"damaged record of {fields.get('WARC-Target-URI')}")
    else:
        payload, payload_bytes = None, int(re.search(rb"Content-Length: (\d+)", http)[1])
    return {
        "page_id": _from_urn(fields.get("WARC-Record-ID", "").strip("<>") or None),
        "url": fields.get("WARC-Target-URI"), "payload_bytes": payload_bytes,
        "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": _from_urn(fields.get("WARC-Refers-To", "").strip("<>") or None),
        "payload": payload,
    }


def write_archives(
    pages: DataFrame, folder: str, least_bytes: int = 100, file_bytes: int = 1 << 30,
    captured: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) into ``folder``; a row per record, as written.

    Of equal payloads of ``least_bytes`` or more, the smallest page id is the response and the
    others revisit it. Only digests that occur more than once are joined back, from a written
    table, so Spark sends them to every task when they are small and splits skewed ones if not.
    """
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    again = materialize(
        page.filter(F.length("payload") >= least_bytes).groupBy("digest")
        .agg(F.count("*").alias("rows"), F.min("page_id").alias("first_id"))
        .filter("rows > 1 AND first_id IS NOT NULL").drop("rows")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number = None, 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if file is None or file.size >= file_bytes:
                    if file is not None:
                        file.close()
                    file, number = TaskFile(folder, "pages", ".warc.gz", number), number + 1
                member = _record(row["page_id"], row["url"], row["payload"], row["digest"],
                                 row["first_id"], captured)
                at, length = file.write(member)
                rows.append((capture_key(row["url"], row["page_id"], captured), file.name, at, length))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in zip(*rows, strict=True)],
                    names=["key", "file", "offset", "length"])
        if file is not None:
            file.close()

    return materialize(page.join(again, "digest", "left").mapInArrow(write, CAPTURE))


def write_index(captures: DataFrame, folder: str, block_lines: int = 3000) -> DataFrame:
    """Sorted, compressed index blocks and their directories in ``folder``.

    Returns a row per index file, as written: its first and last key and where its directory
    lies, which follows the blocks and has the first and last key and the place of each.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, directory, lines = None, [], [], 0

        def flush() -> None:
            text = "".join(f"{k}\t{f}\t{o}\t{n}\n" for k, f, o, n in block)
            at, length = file.write(gzip.compress(text.encode(), 6, mtime=0))
            directory.append((block[0][0], block[-1][0], at, length))
            block.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = file or TaskFile(folder, "index", ".cdx.gz")
                block.append(row)
                lines += 1
                if len(block) == block_lines:
                    flush()
        if block:
            flush()
        if file:
            at, length = file.write(gzip.compress(json.dumps(directory).encode(), 6, mtime=0))
            file.close()
            yield pa.RecordBatch.from_pylist([{
                "file": file.name, "first": directory[0][0], "last": directory[-1][1],
                "lines": lines, "offset": at, "length": length}])

    ordered = captures.select("key", "file", "offset", "length").repartitionByRange(
        "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return materialize(ordered.mapInArrow(write, INDEX))


class _Directory:
    """The blocks of one index file; finds the lines of a key."""

    def __init__(self, reader: Reader, file: str, offset: int, length: int):
        self.reader, self.file = reader, file
        self.blocks = json.loads(gzip.decompress(reader.read(file, offset, length)))
        self.lasts = [b[1] for b in self.blocks]
        self.at, self.lines, self.keys = None, [], []

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        for at in range(bisect.bisect_left(self.lasts, key), len(self.blocks)):
            first, _, offset, length = self.blocks[at]
            if first > key:
                return
            if at != self.at:
                text = gzip.decompress(self.reader.read(self.file, offset, length)).decode()
                self.lines = [x.split("\t") for x in text.splitlines()]
                self.keys, self.at = [x[0] for x in self.lines], at
            for i in range(bisect.bisect_left(self.keys, key), bisect.bisect_right(self.keys, key)):
                _, file, start, size = self.lines[i]
                yield file, int(start), int(size)


def lookup(keys: DataFrame, index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Read the records of ``keys`` (column ``key``, a full capture key) back from ``folder``.

    The driver holds one row of ``index`` for each index file; the directory of a file is read
    by the tasks that look into it. Keys are dealt to tasks by index file and hash, so a file
    that is asked for much has many tasks.
    """
    files = sorted(map(tuple, index.select("first", "last", "file", "offset", "length").collect()))
    places = {f[2]: f[2:] for f in files}
    lasts = [f[1] for f in files]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"key": [], "index": []}
            for key in batch.column(0).to_pylist():
                at = bisect.bisect_left(lasts, key)
                while at < len(files) and files[at][0] <= key:
                    out["key"].append(key)
                    out["index"].append(files[at][2])
                    at += 1
            yield pa.RecordBatch.from_pydict(
                {k: pa.array(v, pa.string()) for k, v in out.items()})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, directory = Reader(folder), None
        for batch in batches:
            out = []
            for name, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if directory is None or directory.file != name:
                    directory = _Directory(reader, *places[name])
                for place in directory.find(key):
                    out.append(parse_record(reader.read(*place)))
                    if len(out) == 500:
                        yield _batch(out, with_payload)
                        out = []
            yield _batch(out, with_payload)

    routed = keys.select("key").distinct().mapInArrow(route, "key string, index string")
    way = F.pmod(F.xxhash64("key"), F.lit(WAYS))
    dealt = routed.repartition("index", way).sortWithinPartitions("index", "key")
    return dealt.select("index", "key").mapInArrow(read, READ)


def _batch(rows: list[dict], with_payload: bool) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(),
             "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
             "payload": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.nulls(len(rows), kind) if name == "payload" and not with_payload
         else pa.array([r[name] for r in rows], kind) for name, kind in kinds.items()],
        names=list(kinds))
