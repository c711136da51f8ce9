"""WARC capture files with a two-level index.

``write_archive`` writes captures as gzip members of WARC files and gives one index line for each: key (the URL with its
host reversed), capture id, file, offset, length. ``write_index`` sorts the lines into shards; a shard file is compressed
blocks of ``block`` lines, one after the other, and at its end a sparse directory: the first key of each block and where
the block is. ``lookup`` finds the shards by their first and last keys, and in each shard binary-searches the directory,
reads only the blocks in question, and binary-searches their lines. ``read_captures`` then range-reads the WARC members.

Files lie in the shared folder and are reached through pyarrow's file systems, so any executor can read what another
wrote. A task writes under a name of its own; only names of tasks that ended well get into the tables.
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
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspar.llm.shared import numbered, scratch, table

BLOCK = 3000
DATE = "1970-01-01T00:00:00Z"  # the tables hold no time of capture


def url_key(url: Column) -> Column:
    """The sort key of a URL: its host in lower case, reversed, labels with commas (without 'www.' and port), ')', then
    path and query as they stand ('/' where there is none); the fragment goes. A null URL has the key ''."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(F.trim(url), F.lit("")), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^.*@", ""), r":\d*$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(F.substring(path, 1, 1) == "/", path).otherwise(F.concat(F.lit("/"), path)))
    return F.when(rest == "", F.lit("")).otherwise(key)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def header_value(url: str) -> str:
    """A URL as it may stand in a header: control characters and blanks percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c.group()):02X}", url)


def warc_member(url: str, record: str, payload: bytes, date: str = DATE) -> bytes:
    """One WARC record as a gzip member (without a time stamp of its own, so that equal records are equal bytes)."""
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{record}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {header_value(url)}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return gzip.compress(head.encode() + payload + b"\r\n\r\n", 6, mtime=0)


def _archive(folder: str, limit: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            lines: list[list] = [[], [], []]
            for i in range(batch.num_rows):
                url, html = (batch.column(c)[i].as_py() for c in (1, 2))
                if out is None or at >= limit:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                record = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}/{at}"))  # a place is used once
                member = warc_member(url or "", record, (html or "").encode())
                out.write(member)
                for v, x in zip(lines, (name, at, len(member))):
                    v.append(x)
                at += len(member)
            yield pa.record_batch([batch.column(0), batch.column(3), *(pa.array(v, t) for v, t in zip(lines, (pa.string(), pa.int64(), pa.int64())))], names=["capture_id", "url_key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return write


def write_archive(pages: DataFrame, folder: str, limit: int = 256 << 20) -> DataFrame:
    """The index lines (capture_id, url_key, file, offset, length) of pages(page_id, url, html), now in WARC files of at
    ``limit`` bytes and a record more. Null html is an empty payload."""
    rows = numbered(pages, "page_id").select(F.col("page_id").cast("long").alias("capture_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), url_key(F.col("url")).alias("url_key"))
    return table(rows.mapInArrow(_archive(folder, limit), "capture_id long, url_key string, file string, offset long, length long"), "lines")


def _shards(folder: str, block: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        name, out, at, directory, lines, first, last, count = f"{uuid.uuid4().hex}.cdx", None, 0, [], [], None, None, 0

        def close_block() -> None:
            nonlocal at, lines
            data = zlib.compress(json.dumps(lines).encode(), 6)
            out.write(data)
            directory.append([lines[0][0], at, len(data)])
            at += len(data)
            lines = []

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (1, 0, 2, 3, 4))):
                if out is None:
                    out, first = store.open_output_stream(f"{root}/{name}", compression=None), row[0]
                lines.append(row)
                last, count = row[0], count + 1
                if len(lines) >= block:
                    close_block()
        if out is not None:
            if lines:
                close_block()
            data = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(data)
            out.close()
            yield pa.record_batch([pa.array([v]) for v in (name, first, last, count, len(directory), at, len(data))], names=["shard", "first_key", "last_key", "lines", "blocks", "directory_at", "directory_bytes"])

    return write


def write_index(lines: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Writes the shards; (shard, first_key, last_key, lines, blocks, directory_at, directory_bytes) of each. A key with
    very many captures may end one shard and begin the next."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["url_key", F.asc_nulls_last("capture_id"), "file", "offset"]
    rows = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return table(rows.mapInArrow(_shards(folder, block), "shard string, first_key string, last_key string, lines long, blocks long, directory_at long, directory_bytes long"), "shards")


class Shard:
    """Reader of one shard: the directory in memory, blocks read as needed (the last one is kept)."""

    def __init__(self, store: fs.FileSystem, path: str, at: int, size: int) -> None:
        self.file = store.open_input_file(path)
        self.directory = json.loads(zlib.decompress(self.file.read_at(size, at)))
        self.keys = [d[0] for d in self.directory]
        self.held: tuple[int, list, list] = (-1, [], [])

    def block(self, i: int) -> tuple[list, list]:
        if self.held[0] != i:
            _, at, size = self.directory[i]
            lines = json.loads(zlib.decompress(self.file.read_at(size, at)))
            self.held = (i, lines, [x[0] for x in lines])
        return self.held[1], self.held[2]

    def find(self, key: str) -> Iterator[list]:
        """All lines with the key."""
        i = max(bisect.bisect_left(self.keys, key) - 1, 0)
        while i < len(self.keys) and self.keys[i] <= key:
            lines, keys = self.block(i)
            for line in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                yield line
            i += 1


def _search(folder: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        name, shard = None, None
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for key, at_name, at, size in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if at_name != name:
                    if shard is not None:
                        shard.file.close()
                    name, shard = at_name, Shard(store, f"{root}/{at_name}", at, size)
                for line in shard.find(key):
                    for v, x in zip(out, line):
                        v.append(x)
                if len(out[0]) > 50_000:
                    yield pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds)], names=["url_key", "capture_id", "file", "offset", "length"])
                    out = [[] for _ in kinds]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds)], names=["url_key", "capture_id", "file", "offset", "length"])

    return search


SHARDS_SENT = 100_000


def _route(bounds: list[tuple]):
    """key -> rows (key, shard, directory_at, directory_bytes) of the shards whose bounds hold it, by binary search."""
    firsts = [b[0] for b in bounds]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for key in batch.column(0).to_pylist():
                i = bisect.bisect_right(firsts, key) - 1
                while i >= 0 and bounds[i][1] >= key:
                    for v, x in zip(out, (key, *bounds[i][2:])):
                        v.append(x)
                    i -= 1
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds)], names=["url_key", "shard", "directory_at", "directory_bytes"])

    return route


def lookup(keys: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """The index lines of each different key of keys(url_key). The shards' bounds are searched first (sent to all
    executors SHARDS_SENT at a time: shards of a later pass are other ones), and each task then works through its
    shards in order."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = keys.select(F.coalesce("url_key", F.lit("")).alias("url_key")).distinct()
    bounds = shards.orderBy("first_key", "last_key").select("first_key", "last_key", "shard", "directory_at", "directory_bytes")
    routed, held = None, []

    def more() -> DataFrame:
        one = wanted.mapInArrow(_route(list(held)), "url_key string, shard string, directory_at long, directory_bytes long")
        return one if routed is None else routed.unionByName(one)

    for row in bounds.toLocalIterator():
        held.append(tuple(row))
        if len(held) == SHARDS_SENT:
            routed, held = more(), []
    routed = more() if held or routed is None else routed
    rows = routed.repartition(parts, "shard").sortWithinPartitions("shard", "url_key")
    return rows.mapInArrow(_search(folder), "url_key string, capture_id long, file string, offset long, length long")


def _fetch(folder: str):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        name, file = None, None
        for batch in batches:
            sizes, digests = [], []
            for at_name, at, size in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4))):
                if at_name != name:
                    if file is not None:
                        file.close()
                    name, file = at_name, store.open_input_file(f"{root}/{at_name}")
                record = gzip.decompress(file.read_at(size, at))
                payload = record[record.index(b"\r\n\r\n") + 4 : -4]
                sizes.append(len(payload))
                digests.append(hashlib.md5(payload).hexdigest())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["url_key", "capture_id", "payload_bytes", "payload_md5"])

    return fetch


def read_captures(lines: DataFrame, folder: str) -> DataFrame:
    """(url_key, capture_id, payload_bytes, payload_md5) of index lines, by range reads in the order of each file."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.select("url_key", "capture_id", "file", "offset", "length").repartition(parts, "file").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(_fetch(folder), "url_key string, capture_id long, payload_bytes long, payload_md5 string")


def capture_index(pages: DataFrame, block: int = BLOCK) -> DataFrame:
    """Archives pages(page_id, url, html), indexes them, looks every page's URL up and reads what is found:
    (url_key, captures, page_id, payload_bytes, payload_md5), one row for each capture, captures counting those of its key.

    Pages with equal keys are captures of one another. A null URL has the key '' and is found under it; null html is
    an empty payload; repeated rows are captures of their own; an empty table gives no rows; other columns are ignored."""
    folder = scratch(pages.sparkSession, "captures")
    lines = write_archive(pages, folder)
    shards = write_index(lines, folder, block)
    found = read_captures(lookup(pages.select(url_key(F.col("url")).alias("url_key")), shards, folder), folder)
    counted = found.withColumn("captures", F.count("*").over(Window.partitionBy("url_key")))
    return counted.select("url_key", "captures", F.col("capture_id").alias("page_id"), "payload_bytes", "payload_md5")


def sql(pages: str = "pages") -> str:
    """``capture_index`` in DuckDB's SQL."""
    return f"""
    WITH a AS (SELECT page_id, html, regexp_replace(regexp_replace(coalesce(trim(url), ''), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM {pages}),
    b AS (SELECT page_id, html, rest, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''), ':\\d*$', ''), '^www\\.', '') AS host, regexp_extract(rest, '^[^/?]*(.*)$', 1) AS path FROM a),
    k AS (SELECT page_id, coalesce(html, '') AS html, CASE WHEN rest = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path LIKE '/%' THEN path ELSE '/' || path END END AS url_key FROM b)
    SELECT url_key, count(*) OVER (PARTITION BY url_key) AS captures, page_id, strlen(html) AS payload_bytes, md5(html) AS payload_md5 FROM k"""
