"""Media columns in the Ogg container: a writer, a checking reader and their DataFrame forms.

Layout follows RFC 3533: pages of up to 255 lacing values, a CRC over the page,
one serial number per logical stream, granule positions that count samples.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples are single bytes at this rate; frames are dealt out over the streams in turn.
RATE, FRAME, STREAMS, UNIT = 8000, 3072, 2, 192
CAPTURE, HEADER, HEADER_SIZE = b"OggS", "<4sBBqIIIB", 27
CONTINUED, FIRST, LAST = 1, 2, 4
MAGIC, IDENT, IDENT_SIZE = b"PCM8", "<4sIHHI", 16
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """CRC-32 with polynomial 04C11DB7, no reflection, no inversion.

    zlib has the reflected form: mirroring the bits of every byte and of the
    result turns one into the other, and a start value of all ones cancels its
    inversion.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def lacing(length: int) -> bytes:
    """A packet's lacing values: 255 for each full segment, then the rest (0 too)."""
    return b"\xff" * (length // 255) + bytes([length % 255])


def stream_pages(serial: int, packets: list[bytes], ends: list[int]) -> Iterator[tuple[int, bytes]]:
    """The pages of one logical stream, each with the granule at its end.

    The first packet is alone on its page, as the first page of a stream has to
    be. A page without the end of any packet has granule -1.
    """
    segments = bytearray()
    owner: list[int] = []
    for k, packet in enumerate(packets):
        values = lacing(len(packet))
        segments += values
        owner += [k] * len(values)
    body, at, cut, number = b"".join(packets), 0, 0, 0
    first = len(lacing(len(packets[0])))
    while cut < len(segments):
        to = first if cut == 0 else min(cut + 255, len(segments))
        table = bytes(segments[cut:to])
        size = sum(table)
        done = [owner[i] for i in range(to - 1, cut - 1, -1) if segments[i] < 255][:1]
        granule = ends[done[0]] if done else -1
        flags = (CONTINUED if cut and segments[cut - 1] == 255 else 0) | (FIRST if cut == 0 else 0) | (LAST if to == len(segments) else 0)
        head = struct.pack(HEADER, CAPTURE, 0, flags, granule, serial, number, 0, len(table))
        page = head + table + body[at : at + size]
        crc = page_crc(page)
        yield granule, page[:22] + struct.pack("<I", crc) + page[26:]
        at, cut, number = at + size, to, number + 1


def mux(payload: bytes, rate: int = RATE, frame: int = FRAME, streams: int = STREAMS) -> bytes:
    """Store bytes as 8-bit samples: frames in turn over several logical streams, pages by time."""
    serials = [(zlib.crc32(payload) + i) & 0xFFFFFFFF for i in range(streams)]
    heads: list[bytes] = []
    pages: list[tuple[int, int, int, bytes]] = []
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    for s, serial in enumerate(serials):
        own = frames[s::streams]
        packets = [struct.pack(IDENT, MAGIC, rate, s, streams, frame), *own]
        ends = [0]
        for x in own:
            ends.append(ends[-1] + len(x))
        time = 0
        for k, (granule, page) in enumerate(stream_pages(serial, packets, ends)):
            if k == 0:
                heads.append(page)
            else:
                time = max(time, granule)
                pages.append((time, s, k, page))
    return b"".join(heads) + b"".join(x[3] for x in sorted(pages, key=lambda x: x[:3]))


@dataclass
class Packet:
    serial: int
    number: int
    data: bytes
    start: int
    end: int


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    marks: list[tuple[int, int]] = field(default_factory=list)
    pages: int = 0
    partial: bytearray = field(default_factory=bytearray)
    open: bool = False
    ended: bool = False


@dataclass
class Report:
    pages: int = 0
    bad_crc: int = 0
    lost_pages: int = 0
    continued: int = 0
    skipped_bytes: int = 0
    streams: dict[int, Stream] = field(default_factory=dict)


def demux(data: bytes) -> Report:
    """Read a physical stream: check pages, put packets together, part the logical streams.

    Bytes outside pages, truncated pages and pages with a wrong checksum are
    skipped and counted; a packet that such a page breaks is dropped. Any bytes
    are accepted, an empty value gives an empty report.
    """
    out = Report()
    at, size = 0, len(data)
    while True:
        start = data.find(CAPTURE, at)
        if start < 0 or start + HEADER_SIZE > size:
            out.skipped_bytes += size - at
            return out
        out.skipped_bytes += start - at
        _, version, flags, granule, serial, number, crc, count = struct.unpack_from(HEADER, data, start)
        table = data[start + HEADER_SIZE : start + HEADER_SIZE + count]
        end = start + HEADER_SIZE + count + sum(table)
        if version or len(table) < count or end > size or page_crc(data[start : start + 22] + b"\0\0\0\0" + data[start + 26 : end]) != crc:
            out.bad_crc += 1
            out.skipped_bytes += 4
            at = start + 4
            continue
        at = end
        out.pages += 1
        stream = out.streams.setdefault(serial, Stream(serial))
        if number != stream.pages:
            out.lost_pages += max(0, number - stream.pages)
            stream.open, stream.partial = False, bytearray()
        stream.pages = number + 1
        keep = True
        if flags & CONTINUED:
            out.continued += 1
            keep = stream.open
        elif stream.open:
            stream.partial, stream.open = bytearray(), False
        here, body = start + HEADER_SIZE + count, 0
        for value in table:
            body += value
            if value == 255:
                continue
            if keep:
                stream.packets.append(bytes(stream.partial) + data[here : here + body])
            keep, stream.partial, stream.open = True, bytearray(), False
            here, body = here + body, 0
        if table and table[-1] == 255:
            stream.partial += data[here : here + body]
            stream.open = keep
        if granule >= 0:
            stream.marks.append((len(stream.packets), granule))
        stream.ended |= bool(flags & LAST)


def timed_packets(stream: Stream) -> list[Packet]:
    """Sample positions of data packets, back from the granule of the page each ends on.

    The header packet has no samples; a data packet has one for each byte.
    Packets after the last granule go on from it.
    """
    lengths = [0, *(len(x) for x in stream.packets[1:])] if stream.packets else []
    out: list[Packet] = []
    done, last = 0, 0
    for upto, granule in [*stream.marks, (len(lengths), None)]:
        spans = lengths[done:upto]
        now = last if granule is None else granule - sum(spans)
        for k, n in enumerate(spans, done):
            out.append(Packet(stream.serial, k, stream.packets[k], now, now + n))
            now += n
        done, last = max(done, upto), now if spans or granule is None else granule
    return out


def unmux(report: Report) -> tuple[bytes, int]:
    """The payload of what ``mux`` wrote, by packet time and channel, and its rate."""
    order: list[tuple[int, int, bytes]] = []
    rate = RATE
    for stream in report.streams.values():
        if stream.packets and len(stream.packets[0]) == IDENT_SIZE and stream.packets[0][:4] == MAGIC:
            _, rate, channel, _, _ = struct.unpack(IDENT, stream.packets[0])
            order += [(p.start, channel, p.data) for p in timed_packets(stream)[1:]]
    order.sort(key=lambda x: x[:2])
    return b"".join(x[2] for x in order), rate


def describe(report: Report, payload: bytes, rate: int) -> str:
    samples = np.frombuffer(payload, np.uint8)
    mean = samples.mean() if len(samples) else 0.0
    steps = np.abs(np.diff(samples.astype(np.int16))).mean() if len(samples) > 1 else 0.0
    length = max((p.end for s in report.streams.values() for p in timed_packets(s)), default=0)
    packets = sum(max(0, len(s.packets) - 1) for s in report.streams.values())
    return f"streams={len(report.streams)};pages={report.pages};bad={report.bad_crc};lost={report.lost_pages};continued={report.continued};packets={packets};end_s={length / rate:.6f};mean={mean:.6f};step={steps:.6f}"


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + b" " * (unit - len(data) % unit if len(data) % unit or not data else 0)


def store_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text, padded, as an Ogg file.

    A null text reads as empty and an empty one as one unit of blanks. Rows are
    independent of each other: repeated rows give repeated results, an empty
    table none, and other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """Adds payload and feature, read back from the stored bytes alone (null: as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, features = [], []
            for media in batch.column("media"):
                report = demux(media.as_py() or b"")
                payload, rate = unmux(report)
                payloads.append(payload)
                features.append(describe(report, payload, rate))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(features, pa.string())], [*batch.schema.names, "payload", "feature"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
    return stored.mapInArrow(run, f"{schema}, payload binary, feature string")


def packet_table(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per packet: key, serial, packet, n_bytes, start_s, end_s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, media in zip(batch.column(0).to_pylist(), batch.column(1)):
                report = demux(media.as_py() or b"")
                rate = unmux(report)[1]
                rows += [(doc, p.serial, p.number, len(p.data), p.start / rate, p.end / rate) for s in report.streams.values() for p in timed_packets(s)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)]
            yield pa.RecordBatch.from_arrays(columns, [key, "serial", "packet", "n_bytes", "start_s", "end_s"])

    return stored.select(F.col(key).cast("long").alias(key), "media").mapInArrow(run, f"`{key}` long, serial long, packet long, n_bytes long, start_s double, end_s double")


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text, read it back, and digest both forms.

    Null, empty and repeated rows are as in ``store_texts``. A very long text takes
    memory for itself, its file and its packets, some four times its bytes, in one task.
    """
    both = read_media(store_texts(docs))
    return both.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
