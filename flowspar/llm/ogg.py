"""Ogg media columns: physical bitstreams in, packets with times out.

A page is 'OggS', version, flags, granule position (64 bits), stream serial, page number, CRC-32 (polynomial 04c11db7, not
reflected, over the page with that field zero), the lacing values and their bytes. A packet is a run of segments that
ends with a lacing value below 255; a run that doesn't end in its page goes on in the stream's next one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowspar.llm.shared import numbered, small_batches

CONTINUED, FIRST, LAST = 1, 2, 4
RATE, SEGMENTS = 16_000, 2  # of the files that stand in for media
_HEAD = struct.Struct("<4sBBqIII B".replace(" ", ""))
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def crc(page: bytes) -> int:
    """Ogg's CRC by way of zlib's: that one is reflected, so the bytes and the result are bit-reversed."""
    value = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(value.to_bytes(4, "little").translate(_FLIP), "big")


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    """One page with its checksum."""
    raw = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return raw[:22] + crc(raw).to_bytes(4, "little") + raw[26:]


def stream_pages(serial: int, packets: list[tuple[bytes, int]], each: bool = True, segments: int = 255) -> list[bytes]:
    """The pages of a logical stream of (packet, granule position at its end). each: a page ends with every packet;
    otherwise pages are filled. A page holds at most
    ``segments`` segments, and a longer packet goes on in the next. A page on which no packet ends has granule position -1."""
    pages: list[tuple[int, int, bytes, bytes]] = []
    lacing, body, flags, granule = bytearray(), bytearray(), 0, -1

    def close(going_on: bool) -> None:
        nonlocal lacing, body, flags, granule
        pages.append((flags, granule, bytes(lacing), bytes(body)))
        lacing, body, flags, granule = bytearray(), bytearray(), CONTINUED if going_on else 0, -1

    for data, end in packets:
        values = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        at = 0
        while values:
            if len(lacing) == segments:
                close(at > 0)
            take = values[: segments - len(lacing)]
            n = sum(take)
            lacing += take
            body += data[at : at + n]
            at += n
            values = values[len(take) :]
            if not values:
                granule = end
        if each:
            close(False)
    if lacing or not pages:
        close(False)
    last = len(pages) - 1
    return [page(serial, i, f | (FIRST if i == 0 else 0) | (LAST if i == last else 0), g, x, b) for i, (f, g, x, b) in enumerate(pages)]


def interleave(streams: list[list[bytes]]) -> bytes:
    """Pages of several streams, taken in turn; all first pages come first."""
    out = []
    for i in range(max(map(len, streams), default=0)):
        out += [s[i] for s in streams if i < len(s)]
    return b"".join(out)


class _Stream:
    def __init__(self) -> None:
        self.next = 0
        self.part: list[bytes] | None = None
        self.packets = 0
        self.granule = 0


def sample_rate(head: bytes) -> int | None:
    """Granule positions a second of a stream, by its first packet: Vorbis and Speex state their rate, FLAC states it in
    its stream information, and Opus always counts 48,000. None where the packet is no such header."""
    if head[:8] == b"OpusHead":
        return 48_000
    if head[:7] == b"\x01vorbis" and len(head) >= 16:
        return int.from_bytes(head[12:16], "little") or None
    if head[:8] == b"Speex   " and len(head) >= 40:
        return int.from_bytes(head[36:40], "little") or None
    if head[:5] == b"\x7fFLAC" and len(head) >= 30:
        return int.from_bytes(head[27:30], "big") >> 4 or None
    return None


def vorbis_head(rate: int) -> bytes:
    """A Vorbis identification header: version 0, one channel, the rate, no bit rates, blocks of 256 and 2048, framing."""
    return b"\x01vorbis" + struct.pack("<IBIiiiBB", 0, 1, rate, 0, 0, 0, 0xB8, 1)


def packets(media: bytes | None) -> Iterator[tuple[int, int, bytes, int, int]]:
    """(serial, packet number, packet, granule position at its start, at its end), in the order of their ends.

    Bytes that are no page, and pages with a wrong checksum or version, are skipped to the next 'OggS'. A packet that a
    missing page leaves incomplete is dropped; so is one that the end of the media cuts off. A page that repeats or
    precedes the stream's last number is dropped. If several packets end on a page, its granule position belongs to the
    last of them, and the others' are spread evenly from the previous one on."""
    data = media or b""
    streams: dict[int, _Stream] = {}
    at = 0
    while (at := data.find(b"OggS", at)) >= 0 and at + 27 <= len(data):
        _, version, flags, granule, serial, number, check, count = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + count]
        size = 27 + count + sum(lacing)
        raw = data[at : at + size]
        if version or len(lacing) < count or len(raw) < size or crc(raw[:22] + b"\0\0\0\0" + raw[26:]) != check:
            at += 1
            continue
        at += size
        s = streams.setdefault(serial, _Stream())
        if flags & FIRST and number == 0 and s.next:
            s = streams[serial] = _Stream()  # a chained stream with the same serial
        if number < s.next:
            continue
        if number > s.next or not flags & CONTINUED:
            s.part = None
        skip = bool(flags & CONTINUED) and s.part is None
        s.next = number + 1
        held = s.part or []
        place, ended = 27 + count, []
        for v in lacing:
            held.append(raw[place : place + v])
            place += v
            if v < 255:
                if not skip:
                    ended.append(b"".join(held))
                skip = False
                held = []
        s.part = held if lacing and lacing[-1] == 255 and not skip else None
        if ended:
            first, span = s.granule, max(granule, s.granule) - s.granule
            for i, p in enumerate(ended):
                yield serial, s.packets, p, first + span * i // len(ended), first + span * (i + 1) // len(ended)
                s.packets += 1
            s.granule = first + span
        elif granule > s.granule and count == 0:
            s.granule = granule


def _demux(ids: int, default: int):
    names = ["serial", "packet", "bytes", "start_time", "end_time", "packet_md5"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(ids)
            rows: list[int] = []
            out: list[list] = [[] for _ in names]
            held = 0

            def made() -> pa.RecordBatch:
                take = pa.array(rows, pa.int64())
                return pa.record_batch([*(batch.column(i).take(take) for i in range(ids)), *(pa.array(v, k) for v, k in zip(out, kinds))], names=[*batch.schema.names[:ids], *names])

            for i in range(batch.num_rows):
                rates: dict[int, int] = {}
                for serial, n, data, start, end in packets(media[i].as_py()):
                    if n == 0 or serial not in rates:
                        rates[serial] = sample_rate(data) or default
                    rate = rates[serial]
                    rows.append(i)
                    for v, x in zip(out, (serial, n, len(data), start / rate, end / rate, hashlib.md5(data).hexdigest())):
                        v.append(x)
                if len(rows) - held > 50_000:
                    yield made()
                    rows.clear()
                    for v in out:
                        v.clear()
            if rows:
                yield made()

    return scan


def ogg_packets(df: DataFrame, media: str = "media", ids: tuple[str, ...] = ("doc_id",), rate: int = 8000) -> DataFrame:
    """One row for every whole packet of every logical stream in a binary column: the columns ``ids``, serial, packet
    (numbered within the stream), bytes, start_time and end_time (granule positions / rate, seconds), packet_md5. The rate is
    that of the stream's own header (see ``sample_rate``); ``rate`` is for streams without one.

    See ``packets`` for damaged pages. Null or empty media, and media that is no Ogg, have no rows; equal rows give equal
    results. Columns other than ids and media are ignored. Each row is worked on alone; nothing is shuffled."""
    small_batches(df.sparkSession)
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in ids), "serial long, packet long, bytes long, start_time double, end_time double, packet_md5 string"])
    return df.select(*ids, media).mapInArrow(_demux(len(ids), rate), schema)


def _mux(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, out, ids, held = batch.column(0), [], [], 0
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py()
            ids.append(i)
            if text is None:
                out.append(None)
                continue
            end, lines = 0, []
            for line in text.encode().split(b"\n"):
                end += len(line)
                lines.append((line, end))
            tags = [((batch.column(c)[i].as_py() or "").encode(), 0) for c in (2, 3)]
            out.append(interleave([stream_pages(1, [(vorbis_head(RATE), 0), *lines], segments=SEGMENTS), stream_pages(2, tags, each=False)]))
            held += len(out[-1])
            if held > 16 << 20:
                yield pa.record_batch([doc.take(pa.array(ids)), pa.array(out, pa.binary())], names=["doc_id", "media"])
                out, ids, held = [], [], 0
        if ids:
            yield pa.record_batch([doc.take(pa.array(ids)), pa.array(out, pa.binary())], names=["doc_id", "media"])


def documents_as_ogg(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each document as an Ogg file of two streams, for want of a media column in the tables. Stream 1
    has a Vorbis header of RATE and a packet for every line of the text, the granule position counting bytes, on pages of
    at most SEGMENTS segments, so that lines of 510 bytes and more go over several; stream 2 has lang and source. A null
    text is null media; a null lang or source is an empty packet."""
    return numbered(docs).selectExpr("cast(doc_id as long) as doc_id", "text", "cast(lang as string) as lang", "cast(source as string) as source").mapInArrow(_mux, "doc_id long, media binary")


def sql(docs: str = "documents", rate: int = RATE) -> str:
    """``ogg_packets(documents_as_ogg(docs))`` in DuckDB's SQL."""
    return f"""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM {docs} WHERE text IS NOT NULL),
    p AS (SELECT doc_id, unnest(w) AS line, unnest(range(0, len(w))) AS packet FROM l),
    t AS (SELECT doc_id, packet, strlen(line) AS bytes, md5(line) AS packet_md5, sum(strlen(line)) OVER (PARTITION BY doc_id ORDER BY packet) AS e FROM p)
    SELECT doc_id, 1::BIGINT AS serial, packet::BIGINT + 1 AS packet, bytes::BIGINT AS bytes, (e - bytes) / {rate}.0::DOUBLE AS start_time, e / {rate}.0::DOUBLE AS end_time, packet_md5 FROM t
    UNION ALL SELECT doc_id, 1, 0, {len(vorbis_head(rate))}, 0, 0, '{hashlib.md5(vorbis_head(rate)).hexdigest()}' FROM {docs} WHERE text IS NOT NULL
    UNION ALL SELECT doc_id, 2, 0, strlen(coalesce(lang, '')), 0, 0, md5(coalesce(lang, '')) FROM {docs} WHERE text IS NOT NULL
    UNION ALL SELECT doc_id, 2, 1, strlen(coalesce(source, '')), 0, 0, md5(coalesce(source, '')) FROM {docs} WHERE text IS NOT NULL"""
