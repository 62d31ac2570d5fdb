"""Media columns: Ogg containers, written to and read from binary columns.

The reader verifies every page's checksum, reassembles packets from the lacing values, demultiplexes the logical
streams by serial number and derives timestamps from granule positions. Samples travel as unsigned 8-bit PCM: each
logical stream starts with a header packet that states the sample rate, and its granule positions count samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from quarry.llm.common import map_texts, table

CONTINUED, FIRST, LAST = 1, 2, 4
HEAD = struct.Struct("<4sBBqIIIB")
#: Stream header packet of this module's own form: magic, version, channels, bits, sample rate.
MAGIC, STREAM_HEAD = b"QRYPCMU8", struct.Struct("<8sHBBI")
FRAME, STREAMS, RATE = 192, 2, 8000
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """The container breaks a rule of the format."""


def checksum(page: bytes) -> int:
    """The page's CRC: polynomial 04c11db7, highest bit first, from 0, without a final inversion.

    It is zlib's CRC with bits mirrored and both inversions undone.
    """
    value = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{value:032b}"[::-1], 2)


def page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def lace(size: int) -> bytes:
    """Lacing values of a packet: as many 255 as fit and a smaller last one."""
    return b"\xff" * (size // 255) + bytes([size % 255])


def stream_pages(serial: int, packets: list[tuple[bytes, int]], start: int = 0, segments: int = 255) -> list[bytes]:
    """Pages of one logical stream after its first page; packets come with their end granule. The last page ends it."""
    out, lacing, body, granule, continued = [], bytearray(), bytearray(), -1, False
    sequence = start

    def flush(last: bool, open_: bool) -> None:
        nonlocal lacing, body, granule, continued, sequence
        flags = (CONTINUED if continued else 0) | (LAST if last else 0)
        out.append(page(serial, sequence, flags, granule, bytes(lacing), bytes(body)))
        lacing, body, granule, continued = bytearray(), bytearray(), -1, open_
        sequence += 1

    for n, (packet, end) in enumerate(packets):
        values, at = lace(len(packet)), 0
        while values:
            room = values[: segments - len(lacing)]
            values = values[len(room) :]
            size = sum(room)
            lacing += room
            body += packet[at : at + size]
            at += size
            if not values:
                granule = end
            last = n == len(packets) - 1 and not values
            if len(lacing) == segments or last:
                flush(last, bool(values))
    if not packets:
        flush(True, False)
    return out


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int | None] = field(default_factory=list)  # granule where a page states it for its last whole packet
    pages: int = 0
    ended: bool = False


def read(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, in order of their first page. Raises OggError on any broken rule."""
    streams: dict[int, Stream] = {}
    partial: dict[int, bytearray | None] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEAD.size:
            raise OggError(f"page header cut off at byte {at}")
        mark, version, flags, granule, serial, sequence, crc, count = HEAD.unpack_from(data, at)
        if mark != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = data[at + HEAD.size : at + HEAD.size + count]
        start = at + HEAD.size + count
        end = start + sum(lacing)
        if len(lacing) < count or end > len(data):
            raise OggError(f"page cut off at byte {at}")
        if checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        if flags & FIRST:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial] = Stream(serial)
            partial[serial] = None
        stream = streams.get(serial)
        if stream is None or stream.ended:
            raise OggError(f"page of stream {serial} outside the stream")
        if sequence != stream.pages:
            raise OggError(f"stream {serial}: page {sequence} instead of {stream.pages}")
        if bool(flags & CONTINUED) != (partial[serial] is not None):
            raise OggError(f"stream {serial}: a continued packet is missing or unannounced")
        stream.pages += 1
        held, pos = partial[serial] or bytearray(), start
        whole = 0
        for value in lacing:
            held += data[pos : pos + value]
            pos += value
            if value < 255:
                stream.packets.append(bytes(held))
                stream.ends.append(None)
                held = bytearray()
                whole += 1
        partial[serial] = held if lacing and lacing[-1] == 255 else None
        if whole and granule == -1:
            raise OggError(f"stream {serial}: packets end on a page without a granule")
        if whole:
            stream.ends[-1] = granule
        elif lacing and granule != -1:
            raise OggError(f"stream {serial}: a granule on a page where no packet ends")
        if flags & LAST:
            if partial[serial] is not None:
                raise OggError(f"stream {serial} ends within a packet")
            stream.ended = True
        at = end
    for stream in streams.values():
        if not stream.ended:
            raise OggError(f"stream {stream.serial} has no end")
    return streams


def packet_ends(stream: Stream) -> list[int | None]:
    """The granule where each packet ends: a page states it for the last packet that ends there, those before it end
    earlier by the samples (bytes) of the packets behind them."""
    out = list(stream.ends)
    for i in range(len(out) - 2, -1, -1):
        if out[i] is None and out[i + 1] is not None:
            out[i] = out[i + 1] - len(stream.packets[i + 1])
    return out


def encode(payload: bytes, serial: int, frame: int = FRAME, streams: int = STREAMS, rate: int = RATE) -> bytes:
    """Frames of the payload dealt in turn to logical streams, each with a header page; data pages interleave."""
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    head = STREAM_HEAD.pack(MAGIC, 1, 1, 8, rate)
    first, rest = [], []
    for s in range(streams):
        own, end, packets = (serial + s) & 0xFFFFFFFF, 0, []
        for f in frames[s::streams]:
            end += len(f)
            packets.append((f, end))
        first.append(page(own, 0, FIRST, 0, lace(len(head)), head))
        rest.append(stream_pages(own, packets, 1))
    turns = max(map(len, rest), default=0)
    return b"".join(first + [p[i] for i in range(turns) for p in rest if i < len(p)])


@dataclass
class Decoded:
    payload: bytes
    streams: list[Stream]
    rate: int
    times: list[float]  # end of each stream in seconds, from its last granule


def decode(data: bytes, frame: int = FRAME) -> Decoded:
    """The payload of encode(), from the stored bytes alone; checks that granule positions count the samples."""
    found = list(read(data).values())
    rate, times, lanes = RATE, [], []
    for stream in found:
        if not stream.packets or len(stream.packets[0]) != STREAM_HEAD.size or stream.packets[0][:8] != MAGIC:
            raise OggError(f"stream {stream.serial} has no sample header")
        _, _, channels, bits, rate = STREAM_HEAD.unpack(stream.packets[0])
        if (channels, bits) != (1, 8) or not rate:
            raise OggError(f"stream {stream.serial}: samples of another form")
        samples = end = 0
        for packet, end in zip(stream.packets[1:], packet_ends(stream)[1:]):
            samples += len(packet)
            if end != samples:
                raise OggError(f"stream {stream.serial}: granule {end} after {samples} samples")
        times.append(end / rate)
        lanes.append(stream.packets[1:])
    payload = b"".join(p[i] for i in range(max(map(len, lanes), default=0)) for p in lanes if i < len(p))
    return Decoded(payload, found, rate, times)


def padded(text: str, unit: int = FRAME) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


PACKETS = StructType(
    [
        StructField("serial", LongType()), StructField("packet", LongType()), StructField("data", BinaryType()),
        StructField("granule", LongType()), StructField("seconds", DoubleType()), StructField("error", StringType()),
    ]
)


def ogg_packets(media: DataFrame, id_col: str, media_col: str, rate: int = RATE) -> DataFrame:
    """One row for each packet of each logical stream of a binary column: (id_col, serial, packet, data, granule,
    seconds, error). granule is where the packet ends: as its page states, or counted back from there in samples
    (bytes) for packets within a page; seconds divide it by rate. A broken or null container gives one row with its
    error and no packet; an empty one gives no row. A container is read whole, whatever its length.
    """
    schema = StructType([media.schema[id_col], *PACKETS.fields])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1)):
                try:
                    if (raw := data.as_py()) is None:
                        raise OggError("no media")
                    rows = [
                        (s.serial, n, p, g, None if g is None else g / rate, None)
                        for s in read(raw).values() for n, (p, g) in enumerate(zip(s.packets, packet_ends(s)))
                    ]
                except OggError as broken:
                    rows = [(None, None, None, None, None, str(broken))]
                columns = [pa.array([key.as_py()] * len(rows), arrow.field(0).type)]
                columns += [pa.array([r[i] for r in rows], arrow.field(i + 1).type) for i in range(6)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return media.select(id_col, media_col).mapInArrow(run, schema)


def text_as_ogg(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs with media (binary, the container), n_bytes (long, of the text) and payload_bytes.

    A null or empty text is one frame of blanks; a very long one is one container. Equal texts give equal containers, whatever their rows.
    """
    fields = [StructField("n_bytes", LongType()), StructField("payload_bytes", LongType()), StructField("media", BinaryType())]
    names = [c for c in keep if c not in {f.name for f in fields}]

    def run(texts):
        payloads = [padded(t) for t in texts]
        return {
            "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
            "payload_bytes": list(map(len, payloads)),
            "media": [encode(p, zlib.crc32(p)) for p in payloads],
        }

    return map_texts(docs, names, text_col, fields, run)


def media_features(media: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """The columns `keep` of media with what the stored bytes, read back, contain: payload_sha256, tail_crc32 (of the
    payload's last 16 bytes), media_bytes, media_sha256, feature, and error (null where the container is sound).

    A broken or null container has null payload columns and feature, and its error.
    """
    fields = [
        StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()), StructField("media_bytes", LongType()),
        StructField("media_sha256", StringType()), StructField("feature", StringType()), StructField("error", StringType()),
    ]
    names = [c for c in keep if c not in {f.name for f in fields}]
    schema = StructType([media.schema[c] for c in names] + fields)

    def one(data: bytes | None):
        if data is None:
            return None, None, None, None, None, "no media"
        base = (len(data), hashlib.sha256(data).hexdigest())
        try:
            found = decode(data)
        except OggError as broken:
            return None, None, *base, None, str(broken)
        payload = found.payload
        feature = (
            f"streams={len(found.streams)};pages={sum(s.pages for s in found.streams)};"
            f"packets={sum(len(s.packets) for s in found.streams)};rate={found.rate};"
            f"ends={','.join(f'{t:.6f}' for t in found.times)};mean={sum(payload) / max(1, len(payload)):.6f};"
            f"peak={max(payload, default=0)}"
        )
        return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *base, feature, None

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = [one(x.as_py()) for x in batch.column(len(names))]
            columns = [batch.column(i) for i in range(len(names))]
            columns += [pa.array([r[i] for r in rows], arrow.field(len(names) + i).type) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return media.select(*names, media_col).mapInArrow(run, schema)


def op2_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = text_as_ogg(table(spark, sf_dir, "documents"), ["doc_id"])
    return media_features(stored, ["doc_id", "n_bytes", "payload_bytes"]).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )
